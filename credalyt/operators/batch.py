"""Batch prediction bookkeeping: caches, resuming, numbering, costs and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from credalyt.functions.explain import explanation_points


def to_do(requests: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Requests without a result yet."""
    return requests.join(done.select(key).distinct(), key, "left_anti")


def resumed(results: DataFrame, fresh: DataFrame) -> DataFrame:
    """Earlier results stay, new ones are added: nothing of a resumed batch is lost."""
    return results.unionByName(fresh)


def split_cached(requests: DataFrame, cache: DataFrame, key: str, value: str) -> DataFrame:
    """Requests with the cached value (null: a miss) and ``hit``."""
    known = cache.select(key, value).dropDuplicates([key]).withColumn("hit", F.lit(True))
    return requests.join(known, key, "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def reassembled(split: DataFrame, computed: DataFrame, key: str, value: str) -> DataFrame:
    """Cached or computed values; what is still unresolved is an empty array."""
    new = computed.select(key, F.col(value).alias("_new")).dropDuplicates([key])
    out = split.join(new, key, "left").withColumn(value, F.coalesce(value, "_new", F.array().cast(split.schema[value].dataType)))
    return out.drop("_new")


def numbered_batches(df: DataFrame, order: str, size: int, by: str) -> DataFrame:
    """``df`` with batch: rows of each ``by`` in order, ``size`` at a time, from 0."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1
    return df.withColumn("batch", F.floor(place / size).cast("long"))


def cost(calls: DataFrame, prices: DataFrame, model: str = "model") -> DataFrame:
    """``calls`` (model, input_tokens, output_tokens) with costs; prices (model, input_price,
    output_price) are for 1,000 tokens, an unknown model costs nothing."""
    p = prices.select(F.col("model").alias("_m"), "input_price", "output_price")
    rows = calls.join(p, calls[model] == F.col("_m"), "left").drop("_m")
    a = F.col("input_tokens") * F.coalesce(F.col("input_price") / 1000, F.lit(0.0))
    b = F.col("output_tokens") * F.coalesce(F.col("output_price") / 1000, F.lit(0.0))
    return rows.withColumns({"input_cost": F.round(a, 6), "output_cost": F.round(b, 6), "total_cost": F.round(a + b, 6)}).drop("input_price", "output_price")


def expected_cost(prompt_tokens: Column, max_tokens: int, input_price: float, output_price: float) -> Column:
    """Before a call: half of the most tokens is expected back."""
    return F.round(prompt_tokens * (input_price / 1000) + F.lit(max_tokens // 2) * (output_price / 1000), 6)


def call_stats(calls: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Calls, successes, tokens, cost and latency of a call log (success, tokens, cost, latency)."""
    g = calls.groupBy(*by) if by else calls.groupBy()
    return g.agg(
        F.count("*").alias("calls"),
        F.count_if("success").alias("succeeded"),
        F.count_if(~F.col("success")).alias("failed"),
        F.sum("tokens").alias("tokens"),
        F.sum("cost").alias("cost"),
        F.avg(F.when(F.col("success"), F.col("latency"))).alias("mean_latency"),
        (F.count_if("success") * 100.0 / F.count("*")).alias("success_percent"),
    )


def histogram(df: DataFrame, column: str, categories: list, name: str = "category") -> DataFrame:
    """(category, n) of stated categories, zero included."""
    every = df.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, categories))).alias(name))
    counts = df.groupBy(F.col(column).alias(name)).agg(F.count("*").alias("n"))
    return every.join(counts, name, "left").select(name, F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def batch_report(results: DataFrame) -> DataFrame:
    """One row: totals, successes, tokens and the mean, least and largest of the known scores."""
    known = F.when(F.col("score") >= 0, F.col("score"))
    return results.agg(F.count("*").alias("total"), F.count_if("success").alias("succeeded"), F.count_if("cached").alias("cached"), F.sum("tokens").alias("tokens"), F.try_divide(F.sum("tokens"), F.count_if("success")).alias("tokens_each"), F.avg(known).alias("score_mean"), F.min(known).alias("score_min"), F.max(known).alias("score_max"))


def decision_summary(results: DataFrame) -> DataFrame:
    """One row: levels (from 2: high) and approvals (other: review) counted."""
    a = F.col("approval")
    return results.agg(
        F.count_if(F.col("level") == 0).alias("low"), F.count_if(F.col("level") == 1).alias("medium"), F.count_if(F.col("level") >= 2).alias("high"),
        F.count_if(a == "批准").alias("approved"), F.count_if(a == "拒绝").alias("rejected"), F.count_if((a != "批准") & (a != "拒绝")).alias("review"),
    )


def grouped_summary(df: DataFrame, order: str, size: int, latency: str, by: str) -> DataFrame:
    """(by, groups, mean_latency): one call answers ``size`` rows, so latency is shared by the calls made."""
    n = numbered_batches(df, order, size, by).groupBy(by, "batch").agg(F.first(latency).alias("l"))
    return n.groupBy(by).agg(F.count("*").alias("groups"), F.avg("l").alias("mean_latency"))


def ablation_summary(results: DataFrame) -> DataFrame:
    """Accuracy, means and explanation points for each config; only successes count, points over all rows."""
    ok = F.col("success")
    points = explanation_points(ok, F.col("n_factors"), F.col("n_sources"), F.col("parsed"), F.col("score"), F.col("approval"))
    return results.groupBy("config").agg(
        F.count("*").alias("n"),
        F.count_if(ok).alias("succeeded"),
        F.coalesce(F.try_divide(F.count_if(ok & (F.col("level") == F.col("true_level"))), F.count_if(ok)), F.lit(0.0)).alias("accuracy"),
        F.avg(F.when(ok, F.col("tokens"))).alias("mean_tokens"),
        F.avg(points).alias("explainability"),
    )


def best_config(summary: DataFrame) -> DataFrame:
    """One row: the config of the best accuracy (ties: the first by name)."""
    return summary.agg(F.min_by("config", F.struct(-F.col("accuracy"), F.col("config"))).alias("config"), F.max("accuracy").alias("accuracy"))


def dedupe_keep_first(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("_r", rank).where("_r = 1").drop("_r")


def frequency(df: DataFrame, array: Column, k: int = 20) -> DataFrame:
    """(name, n): the k most frequent elements over all arrays: a top-k report."""
    return df.select(F.explode(array).alias("name")).groupBy("name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(k)
