"""Sinks: files, result tables and knowledge collections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credalyt.sources.folders import exists, saved, work_folder


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def append_csv(df: DataFrame, path: str, columns: list[str] | None = None, decimals: int | None = None) -> None:
    """Rows are added to the result set; columns in a fixed order, doubles with fixed decimals if wanted."""
    out = df.select(*columns) if columns else df
    if decimals is not None:
        out = out.withColumns({f.name: F.format_string(f"%.{decimals}f", f.name) for f in out.schema if f.dataType.typeName() in ("double", "float")})
    write_csv(out, path, "append")


def write_results(df: DataFrame, path: str, kind: str = "json", columns: list[str] | None = None) -> None:
    """JSON with all fields, or CSV of some; ValueError for other kinds."""
    if kind == "json":
        df.write.mode("overwrite").json(path)
    elif kind == "csv":
        write_csv(df.select(*columns) if columns else df, path)
    else:
        raise ValueError(f"unknown kind {kind!r}")


def write_details(df: DataFrame, path: str, by: str = "config") -> None:
    """One folder of JSON for each value of ``by``."""
    df.write.mode("overwrite").partitionBy(by).json(path)


def write_matrix(df: DataFrame, path: str, info: dict) -> None:
    """Prepared rows with their ids, and a JSON record of what was done."""
    df.write.mode("overwrite").parquet(f"{path}/rows")
    spark = df.sparkSession
    spark.createDataFrame([(str(k), str(v)) for k, v in info.items()], "key string, value string").coalesce(1).write.mode("overwrite").json(f"{path}/info")


def numbered(df: DataFrame, start: int = 0) -> DataFrame:
    """``df`` with _place: its rows counted on from ``start``, partition by partition (one count for each).

    The rows are written before they are numbered, so the counts and the numbers see the same partitions."""
    rows = saved(df.withColumn("_place", F.monotonically_increasing_id()), work_folder(df.sparkSession, "numbered"))
    part, offset, offsets = F.shiftright("_place", 33), start, []
    for r in rows.groupBy(part.alias("p")).count().orderBy("p").collect():
        offsets.append(F.struct(F.lit(r.p).alias("p"), F.lit(offset).cast("long").alias("o")))
        offset += r["count"]
    if not offsets:
        return rows
    return rows.withColumn("_place", F.element_at(F.map_from_entries(F.array(*offsets)), part) + F.col("_place").bitwiseAND((1 << 33) - 1))


class Collections:
    """Knowledge collections as one table (collection, id, content, metadata, embedding) partitioned by collection."""

    SCHEMA = "id string, content string, metadata map<string,string>, embedding array<float>, collection string"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def add(self, df: DataFrame, collection: str, failed: str = "drop", dim: int = 64, replace: bool = False) -> None:
        """Documents (id, content, metadata, embedding); missing ids are numbered on from the number of documents.

        failed: documents without embedding are dropped, or stored with zeros."""
        before = 0 if replace else self.read(collection).count()
        rows = numbered(df, before).withColumn("id", F.coalesce(F.col("id").cast("string"), F.concat(F.lit("doc_"), F.col("_place").cast("string"))))
        rows = rows.withColumn("metadata", F.coalesce("metadata", F.create_map().cast("map<string,string>")))
        if failed == "zeros":
            rows = rows.withColumn("embedding", F.when(F.size(F.coalesce("embedding", F.array().cast("array<float>"))) > 0, F.col("embedding")).otherwise(F.array_repeat(F.lit(0.0).cast("float"), dim)))
        else:
            rows = rows.where(F.size("embedding") > 0)
        rows = rows.select("id", "content", "metadata", F.col("embedding").cast("array<float>").alias("embedding"))
        rows.write.mode("overwrite" if replace else "append").parquet(f"{self.path}/collection={collection}")

    def read(self, *names: str) -> DataFrame:
        """Documents of all or some collections; an empty store gives no rows."""
        if exists(self.spark, self.path):
            rows = self.spark.read.schema(self.SCHEMA).parquet(self.path)
        else:
            rows = self.spark.createDataFrame([], self.SCHEMA)
        return rows.where(F.col("collection").isin(*names)) if names else rows

    def counts(self) -> DataFrame:
        return self.read().groupBy("collection").agg(F.count("*").alias("n"))

    def drop(self, *names: str) -> None:
        """Delete some collections, or all."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path
        for path in [f"{self.path}/collection={n}" for n in names] or [self.path]:
            p = hadoop(path)
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def report(title: str, df: DataFrame, decimals: int = 4, most_rows: int = 200) -> str:
    """A small result as a Markdown table; larger results are refused, not cut."""
    rows = df.limit(most_rows + 1).collect()
    if len(rows) > most_rows:
        raise ValueError(f"a report holds at most {most_rows} rows")
    cell = lambda v: f"{v:.{decimals}f}" if isinstance(v, float) else "" if v is None else str(v)
    lines = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(cell(v) for v in r) + " |" for r in rows]) + "\n"
