"""State that outlives a query: fitted preparation, caches of a bounded size, progress and the end of training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from credalyt.operators.ordered import ranked


class Preparation:
    """What preparation has learned from training rows: one row for each column or value.

    Numbers are filled with their mean and standardised (a constant becomes zero); texts become
    codes in the order of the values.  Unseen values and null texts become null."""

    SCHEMA = "column string, value string, mean double, std double, code int"

    def __init__(self, fitted: DataFrame):
        self.fitted = fitted

    @classmethod
    def fit(cls, rows: DataFrame, numeric: list[str], categorical: list[str]) -> Preparation:
        parts = []
        if numeric:
            figures = F.array(*[F.struct(F.lit(c).alias("column"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("std")) for c in numeric])
            parts.append(rows.agg(figures.alias("x")).select(F.inline("x")).select("column", F.lit(None).cast("string").alias("value"), "mean", "std", F.lit(None).cast("int").alias("code")))
        for c in categorical:
            values = ranked(rows.select(F.col(c).cast("string").alias("value")).where("value is not null").distinct(), "value", "code")
            parts.append(values.select(F.lit(c).alias("column"), "value", F.lit(None).cast("double").alias("mean"), F.lit(None).cast("double").alias("std"), (F.col("code") - 1).cast("int").alias("code")))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return cls(out)

    def save(self, path: str) -> None:
        self.fitted.write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Preparation:
        return cls(spark.read.schema(cls.SCHEMA).parquet(path))

    def apply(self, rows: DataFrame) -> DataFrame:
        """Rows prepared with the learned figures, none of their own."""
        names = {(r.column, r.coded) for r in self.fitted.groupBy("column", F.col("code").isNotNull().alias("coded")).count().collect()}
        out = rows
        for c, coded in sorted(names):
            own = self.fitted.where(F.col("column") == c)
            if coded:
                codes = own.select(F.col("value").alias("_v"), F.col("code").alias("_c"))
                out = out.join(codes, out[c].cast("string") == F.col("_v"), "left").withColumn(c, F.col("_c")).drop("_v", "_c")
            else:
                out = out.crossJoin(F.broadcast(own.select(F.col("mean").alias("_m"), F.col("std").alias("_s"))))  # one row
                out = out.withColumn(c, F.when(F.col("_s") > 0, (F.coalesce(F.col(c), F.col("_m")) - F.col("_m")) / F.col("_s")).otherwise(F.lit(0.0))).drop("_m", "_s")
        return out.select(*rows.columns)


def least_recent_gone(cache: DataFrame, capacity: int, used: str = "used_at", key: str = "cache_key") -> DataFrame:
    """The ``capacity`` entries of a cache that were used last (ties: the larger key): the limit is the feature."""
    return cache.orderBy(F.desc(used), F.desc(key)).limit(capacity)


def stopped_epochs(losses: DataFrame, patience: int, by: str = "run") -> DataFrame:
    """(by, epoch, best, stopped): the epochs that early stopping lets run, with the best loss so far.

    Training ends with the first epoch that is ``patience`` epochs past the last improvement."""
    before = Window.partitionBy(by).orderBy("epoch")
    best = F.min("loss").over(before.rowsBetween(Window.unboundedPreceding, -1))
    rows = losses.withColumn("_better", F.coalesce(F.col("loss") < best, F.lit(True))).withColumn("_n", F.row_number().over(before))
    rows = rows.withColumn("_since", F.col("_n") - F.max(F.when(F.col("_better"), F.col("_n"))).over(before.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("best", F.min("loss").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    ends = F.min(F.when(F.col("_since") >= patience, F.col("_n"))).over(Window.partitionBy(by))
    rows = rows.withColumn("_end", ends)
    return rows.where(F.col("_end").isNull() | (F.col("_n") <= F.col("_end"))).select(by, "epoch", "best", F.coalesce(F.col("_n") == F.col("_end"), F.lit(False)).alias("stopped"))


def progress(batches: DataFrame, done: Column, by: str, batch: str = "batch") -> DataFrame:
    """(by, batch, current, total, percent): how far each batch brings the work."""
    sums = batches.groupBy(by, batch).agg(F.count_if(done).alias("_done"), F.count("*").alias("_all"))
    far = Window.partitionBy(by).orderBy(batch).rowsBetween(Window.unboundedPreceding, 0)
    rows = sums.select(by, batch, F.sum("_done").over(far).alias("current"), F.sum("_all").over(Window.partitionBy(by)).alias("total"))
    return rows.withColumn("percent", F.round(F.col("current") / F.col("total") * 100, 1))


def questionnaire(samples: DataFrame, dimensions: list[str], columns: list[str]) -> DataFrame:
    """(sample_id, page): a page of Markdown for each sample, with its fields and an empty table of scores."""
    field = lambda c: F.concat(F.lit(f"**{c}**: "), F.coalesce(F.col(c).cast("string"), F.lit("N/A")), F.lit("\n"))
    table = "\n| 评估维度 | 评分 (1-5) | 备注 |\n|---|---|---|\n" + "".join(f"| {x} | | |\n" for x in dimensions)
    return samples.select("sample_id", F.concat(F.lit("### 样本 "), F.col("sample_id").cast("string"), F.lit("\n"), *[field(c) for c in columns], F.lit(table)).alias("page"))
