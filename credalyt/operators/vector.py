"""Vector scores as expressions, and retrieval with filters before and thresholds after the top k.

The search itself is in ``matrix``: blocks of products, k best of each query in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from credalyt.operators import matrix


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, v: s + v))


def similarity(distance: Column, metric: str) -> Column:
    """1 / (1 + d) for l2, 1 - d otherwise."""
    return F.lit(1.0) / (F.lit(1.0) + distance) if metric == "l2" else F.lit(1.0) - distance


def sparse_dot(a: Column, b: Column) -> Column:
    """Inner product of two maps of term weights."""
    return F.aggregate(F.map_entries(a), F.lit(0.0), lambda s, e: s + e["value"] * F.coalesce(F.element_at(b, e["key"]), F.lit(0.0)))


def max_sim(query: Column, doc: Column) -> Column:
    """Late interaction: the sum over query vectors of the largest inner product with a document vector."""
    return F.aggregate(query, F.lit(0.0), lambda s, q: s + F.array_max(F.transform(doc, lambda d: dot(q, d))))


def knn(docs: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", where: Column | None = None, threshold: float | None = None, per: str | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, [per,] doc_id, score, rank): the k most similar documents of each query.

    ``where`` filters documents before the top k, ``threshold`` results after it (so fewer
    than k may stay); ``per`` ranks inside each of its values."""
    out = matrix.knn(docs if where is None else docs.where(where), queries, k, metric, per, id_col, vector_col)
    return out if threshold is None else out.where(F.col("score") >= threshold)


def merged(per_collection: DataFrame, k: int) -> DataFrame:
    """The k best of each query over all collections."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return per_collection.drop("rank").withColumn("rank", rank).where(F.col("rank") <= k)


def rerank_by_overlap(hits: DataFrame, k: int, query: str = "query", content: str = "content", share: float = 0.7) -> DataFrame:
    """Score again: ``share`` of the old score, the rest by query terms (as sets) that the content has."""
    terms = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(F.col(c)), F.lit(r"(?U)\S+"), 0))
    overlap = F.size(F.array_intersect(terms(query), terms(content))) / F.greatest(F.size(terms(query)), F.lit(1))
    scored = hits.withColumn("score", F.lit(share) * F.col("score") + F.lit(1 - share) * overlap)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def matrix_similarity(a: DataFrame, b: DataFrame, digits: int | None = None) -> DataFrame:
    """(i, j, s): inner products of a stated set of vectors (i, v) with all others (j, w), in blocks, rounded to ``digits``."""
    return matrix.products(a, b, digits=digits)
