"""Fusion of two ranked lists (query_id, doc_id, score, rank) by full outer join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RRF_K = 60


def _joined(vector: DataFrame, lexical: DataFrame) -> DataFrame:
    v = vector.select("query_id", "doc_id", F.col("score").alias("vector_score"), F.col("rank").alias("vector_rank"))
    b = lexical.select("query_id", "doc_id", F.col("score").alias("bm25_score"), F.col("rank").alias("bm25_rank"))
    return v.join(b, ["query_id", "doc_id"], "full")


def _best(rows: DataFrame, k: int) -> DataFrame:
    # equal scores: those of the vector list first, in its order, then the lexical ones in theirs
    order = [F.desc("score"), F.col("vector_rank").asc_nulls_last(), F.col("bm25_rank").asc_nulls_last(), F.col("doc_id")]
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)
    zero = {"vector_score": F.coalesce("vector_score", F.lit(0.0)), "bm25_score": F.coalesce("bm25_score", F.lit(0.0)), "vector_rank": F.coalesce("vector_rank", F.lit(0)), "bm25_rank": F.coalesce("bm25_rank", F.lit(0))}
    return ranked.withColumns(zero)


def _reciprocal(rank: Column, k: int) -> Column:
    return F.coalesce(F.lit(1.0) / (F.lit(k) + rank), F.lit(0.0))


def rrf(vector: DataFrame, lexical: DataFrame, k: int, rrf_k: int = RRF_K) -> DataFrame:
    """Sum of reciprocal ranks."""
    score = _reciprocal(F.col("vector_rank"), rrf_k) + _reciprocal(F.col("bm25_rank"), rrf_k)
    return _best(_joined(vector, lexical).withColumn("score", score), k)


def rrf_plus_score(vector: DataFrame, lexical: DataFrame, k: int, rrf_k: int = RRF_K, share: float = 0.1) -> DataFrame:
    """Reciprocal ranks and a share of each raw score."""
    raw = F.coalesce(F.col("vector_score"), F.lit(0.0)) + F.coalesce(F.col("bm25_score"), F.lit(0.0))
    score = _reciprocal(F.col("vector_rank"), rrf_k) + _reciprocal(F.col("bm25_rank"), rrf_k) + F.lit(share) * raw
    return _best(_joined(vector, lexical).withColumn("score", score), k)


def normalized(hits: DataFrame) -> DataFrame:
    """Scores to [0, 1] inside each query; equal scores become 1."""
    w = Window.partitionBy("query_id")
    lo, hi = F.min("score").over(w), F.max("score").over(w)
    return hits.withColumn("score", F.when(hi == lo, 1.0).otherwise((F.col("score") - lo) / (hi - lo)))


def weighted(vector: DataFrame, lexical: DataFrame, k: int, vector_weight: float = 0.5, bm25_weight: float = 0.5) -> DataFrame:
    """Weighted sum of min-max normalized scores."""
    rows = _joined(normalized(vector), normalized(lexical))
    score = F.lit(vector_weight) * F.coalesce("vector_score", F.lit(0.0)) + F.lit(bm25_weight) * F.coalesce("bm25_score", F.lit(0.0))
    return _best(rows.withColumn("score", score), k)


METHODS = {"rrf": rrf, "weighted": weighted, "rrf_plus_score": rrf_plus_score}


def fuse(method: str, vector: DataFrame, lexical: DataFrame, k: int, **parameters) -> DataFrame:
    """By name; an unknown method is ``rrf``."""
    return METHODS.get(method, rrf)(vector, lexical, k, **parameters)


def by_text(lists: list[DataFrame], k: int, rrf_k: int = RRF_K, share: float = 0.1) -> DataFrame:
    """Fusion keyed by document text: hits with one text add up."""
    rows = lists[0]
    for more in lists[1:]:
        rows = rows.unionByName(more)
    total = rows.groupBy("query_id", "content").agg(F.sum(F.lit(1.0) / (F.lit(rrf_k) + F.col("rank")) + F.lit(share) * F.col("score")).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "content"))
    return total.withColumn("rank", rank).where(F.col("rank") <= k)


def above(hits: DataFrame, threshold: float | None) -> DataFrame:
    """Fused hits from a score on; no threshold or one of zero keeps all."""
    return hits.where(F.col("score") >= threshold) if threshold else hits


def format_hits(hits: DataFrame, content: str = "content", scores: bool = True) -> DataFrame:
    """(query_id, text): '[rank] content' lines of each query, with the score if wanted."""
    line = F.concat(F.format_string("[%d] ", F.col("rank")), F.col(content), F.format_string("\n(score: %.4f)", F.col("score")) if scores else F.lit(""))
    return hits.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))
