"""From raw documents to shuffled training shards, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a table with the columns of
``documents``; the last one adds the shard of each row and its place there.

In every stage nulls may stand in any column, texts may be empty or very long, rows may
repeat and extra columns, whatever their names, pass through; an empty table gives an empty
one.  Texts that are null or empty are not toxic and not contaminated, are copies of each
other, and are not drawn by the mix, which takes words.  Of near duplicates that share an id,
or have none, the text with the least hash stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from credalyt.llm import decontaminate, mixing, sharding, simhash, toxicity
from credalyt.llm.scratch import Scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine rejects go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.without_toxic(docs, toxicity.train(docs, labels))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8) the document with the smallest id stays."""
    return simhash.dissimilar(docs, shingle=5, similarity=0.8)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with at least one word in twenty inside windows of benchmark items go."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents once for each time that their source's target takes them, in curriculum order."""
    return mixing.draws(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, uniformly shuffled into shards of equal row counts."""
    return sharding.shards(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]
#: SQL can't express the learned stage; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another on all documents, each written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        now = scratch.save(stage(spark, docs, sf_dir))
        scratch.drop(before)
        docs = before = now
    return docs
