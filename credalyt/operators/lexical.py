"""BM25 scores of all pairs in three variants, the k best, and TF-IDF.

``okapi``: idf = ln(N - df + 1/2) - ln(df + 1/2); negative ones become a quarter of the mean
of all terms' idf.  ``smooth_floor``: ln((N - df + 1/2) / (df + 1/2) + 1), at least 0.1.
``smooth``: the same without floor.  Terms of a query count as often as they occur in it.
The index, and the search that prunes, are in ``bm25index``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from credalyt.operators.bm25index import Index
from credalyt.operators.tfidf import tfidf  # noqa: F401

VARIANTS = {"okapi": "word", "smooth_floor": "cjk_ngram", "smooth": "space"}


def bm25(docs: DataFrame, queries: DataFrame, id_col: str = "doc_id", text_col: str = "text", variant: str = "okapi", tokenizer: str | None = None, k1: float = 1.5, b: float = 0.75, include_zero: bool = False) -> DataFrame:
    """(query_id, doc_id, score) for queries (query_id, text): every document that shares a term.

    ``include_zero`` also gives a stated set of queries a score of zero for the others."""
    scored = Index.build(docs, id_col, text_col, tokenizer or VARIANTS[variant]).scores(queries, variant, k1, b).drop("collection")
    if include_zero:
        every = queries.select("query_id").distinct().crossJoin(docs.select(F.col(id_col).alias("doc_id")))
        scored = every.join(scored, ["query_id", "doc_id"], "left").select("query_id", "doc_id", F.coalesce("score", F.lit(0.0)).alias("score"))
    return scored


def top_k(scored: DataFrame, k: int, by: str = "query_id", item: str = "doc_id", score: str = "score") -> DataFrame:
    """The k best of each ``by`` with rank; ties go to the smaller item."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), item))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)
