"""Intermediate tables in the folder that the whole cluster shares.

Iterative operators cut their lineage by writing a Parquet table below
``spark.checkpoint.dir`` and reading it back, so a lost executor costs a re-read
and not a recomputation.  A folder of our own is used only where that setting
is missing (tests, notebooks).  Results are read lazily, so tables stay until
``folders.release`` or the end of the driver's Python.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credalyt.sources.folders import remove, work_folder

#: Spark deletes a query's shuffle files once the query has ended
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def releasing(spark: SparkSession) -> Iterator[None]:
    """Inside, the shuffle files of each query go when the query ends."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


class Scratch:
    """Named tables of one operator call; as a context, an error inside deletes them."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = work_folder(spark, label)
        self._n = 0

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, kind: type | None, *_: object) -> None:
        if kind is not None:
            self.delete(self.root)

    def save(self, df: DataFrame) -> DataFrame:
        """Write ``df``, release the shuffle files that it took and return the table that was written."""
        self._n += 1
        path = f"{self.root}/{self._n:04d}"
        schema = df.schema
        with releasing(self.spark):
            df.write.parquet(path)
        out = self.spark.read.schema(schema).parquet(path)
        out._credalyt_path = path  # type: ignore[attr-defined]
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        """Delete tables that no later step reads."""
        for table in tables:
            if path := getattr(table, "_credalyt_path", None):
                self.delete(path)

    def delete(self, path: str) -> None:
        remove(self.spark, path)


class Plain:
    """A table under neutral column names, so that no input name can clash with ours."""

    def __init__(self, df: DataFrame):
        self.names = df.columns
        self.df = df.toDF(*self.cols())

    def cols(self) -> list[str]:
        return [f"c{i}" for i in range(len(self.names))]

    def __getitem__(self, name: str) -> str:
        """The neutral name of an input column."""
        at = self.names.index(name) if name in self.names else [x.lower() for x in self.names].index(name.lower())
        return f"c{at}"

    def back(self, out: DataFrame, keep: list[str], results: list[str]) -> DataFrame:
        """Input columns ``keep`` under their own names, then ``results``; where both have a name, the result's column stays."""
        new = {r.lower() for r in results}
        held = [n for n in keep if n.lower() not in new]
        return out.select(*(self[n] for n in held), *results).toDF(*held, *results)


def numbered(df: DataFrame, id_col: str, text: str, scratch: Scratch) -> tuple[DataFrame, int]:
    """``df`` with a long ``key`` that orders its rows, and the bits that a place in a text takes.

    The key is the id where ids are unique non-negative integers that leave room for a
    place in one long; other tables are sorted (nulls first, then by text) and numbered.
    """
    s = df.agg(F.count("*").alias("n"), F.count_distinct(id_col).alias("ids"), F.min(id_col).alias("lo"), F.max(id_col).alias("hi"), F.max(F.octet_length(text)).alias("most")).first()
    bits = max(7, int(s.most or 0).bit_length() + 1)
    whole = df.schema[id_col].dataType.typeName() in ("byte", "short", "integer", "long")
    if whole and s.n == s.ids and (not s.n or (s.lo >= 0 and int(s.hi).bit_length() + bits <= 62)):
        return df.withColumn("key", F.col(id_col).cast("long")), bits
    order = [F.col(id_col).asc_nulls_first(), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))]
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    put = scratch.save(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()))
    part = F.shiftright("place", 33)
    offset, before = 0, []
    for row in put.groupBy(part.alias("p")).count().orderBy("p").collect():  # a number for each partition
        before.append(F.struct(F.lit(row.p).alias("p"), F.lit(offset).cast("long").alias("o")))
        offset += row["count"]
    if not before:
        return df.withColumn("key", F.lit(0).cast("long")), bits
    known = F.map_from_entries(F.array(*before))
    return put.withColumn("key", F.element_at(known, part) + F.col("place").bitwiseAND((1 << 33) - 1)).drop("place"), bits
