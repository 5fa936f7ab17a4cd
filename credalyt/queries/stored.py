"""Fitted preparation, bounded caches, progress, early stopping and questionnaires."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credalyt.operators import stored
from credalyt.sources.folders import work_folder
from credalyt.streaming.events import read_stream
from credalyt.streaming.progress import run_observed
from credalyt.sources.tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str):
    def put(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, oracle
        return f

    return put


@query("""
WITH t AS (SELECT * FROM customer WHERE c_custkey % 4 <> 0 AND c_mktsegment <> 'BUILDING'),
s AS (SELECT avg(c_acctbal) AS m, stddev_pop(c_acctbal) AS s FROM t),
k AS (SELECT c_mktsegment AS v, CAST(row_number() OVER (ORDER BY c_mktsegment) - 1 AS INT) AS code FROM (SELECT DISTINCT c_mktsegment FROM t))
SELECT c_custkey, round((coalesce(CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal END, m) - m) / s, 6) AS c_acctbal, code AS segment FROM customer CROSS JOIN s LEFT JOIN k ON c_mktsegment = v""")
def saved_preparation(spark: SparkSession, d: str) -> DataFrame:
    """Preparation fitted on training rows, saved, loaded and applied to all rows; an unseen segment and missing numbers."""
    rows = table(spark, d, "customer").select("c_custkey", "c_acctbal", F.col("c_mktsegment").alias("segment"))
    path = work_folder(spark, "preparation")
    stored.Preparation.fit(rows.where("c_custkey % 4 <> 0 AND segment <> 'BUILDING'"), ["c_acctbal"], ["segment"]).save(path)
    sparse = rows.withColumn("c_acctbal", F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal")))
    return stored.Preparation.load(spark, path).apply(sparse).withColumn("c_acctbal", F.round("c_acctbal", 6))


@query("SELECT event_type AS cache_key, max(event_id) AS used_at FROM events GROUP BY event_type ORDER BY used_at DESC, cache_key DESC LIMIT 3")
def lru_eviction(spark: SparkSession, d: str) -> DataFrame:
    """The three entries of a cache that were used last."""
    cache = table(spark, d, "events").groupBy(F.col("event_type").alias("cache_key")).agg(F.max("event_id").alias("used_at"))
    return stored.least_recent_gone(cache, 3)


@query("""
WITH l AS (SELECT o_custkey AS run, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS epoch, o_totalprice AS loss FROM orders),
b AS (SELECT *, min(loss) OVER (PARTITION BY run ORDER BY epoch ROWS UNBOUNDED PRECEDING) AS best, coalesce(loss < min(loss) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS better FROM l),
s AS (SELECT *, epoch - max(CASE WHEN better THEN epoch END) OVER (PARTITION BY run ORDER BY epoch ROWS UNBOUNDED PRECEDING) AS since FROM b),
e AS (SELECT *, min(CASE WHEN since >= 3 THEN epoch END) OVER (PARTITION BY run) AS last FROM s)
SELECT run, epoch, best, coalesce(epoch = last, false) AS stopped FROM e WHERE last IS NULL OR epoch <= last""")
def early_stopping(spark: SparkSession, d: str) -> DataFrame:
    """Epochs that run until three bring no better loss."""
    o = table(spark, d, "orders")
    from pyspark.sql.window import Window

    losses = o.select(F.col("o_custkey").alias("run"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("epoch"), F.col("o_totalprice").alias("loss"))
    return stored.stopped_epochs(losses, 3)


@query("""
WITH s AS (SELECT event_type AS job, event_id // 500 AS batch, count(*) FILTER (event_id % 7 <> 0) AS d, count(*) AS n FROM events GROUP BY ALL),
f AS (SELECT job, batch, sum(d) OVER (PARTITION BY job ORDER BY batch) AS current, sum(n) OVER (PARTITION BY job) AS total FROM s)
SELECT job, batch, CAST(current AS BIGINT) AS current, CAST(total AS BIGINT) AS total, round(current / total * 100, 1) AS percent FROM f""")
def batch_progress(spark: SparkSession, d: str) -> DataFrame:
    """How far each batch brings its job."""
    rows = table(spark, d, "events").select(F.col("event_type").alias("job"), F.expr("event_id div 500").alias("batch"), "event_id")
    return stored.progress(rows, F.col("event_id") % 7 != 0, "job")


@query("SELECT count(*) AS n_rows, CAST(count_if(event_id % 7 = 0) AS BIGINT) AS n_failed, count(*) AS n_done, 100.0::DOUBLE AS percent, true AS in_parts, true AS while_running FROM events")
def live_progress(spark: SparkSession, d: str) -> DataFrame:
    """Calls of a batch, observed part by part while it runs; the parts sum to the table."""
    rows, path = table(spark, d, "events"), work_folder(spark, "progress")
    rows.repartition(8, "event_id").write.parquet(f"{path}/calls")
    stream = read_stream(spark, f"{path}/calls", rows.schema, files_each=2)
    store = lambda part, number: part.write.mode("overwrite").parquet(f"{path}/done/part={number}")
    parts = run_observed(stream, f"{path}/checkpoint", store, F.col("event_id") % 7 == 0, total=rows.count())
    return parts.agg(F.sum("n_rows").alias("n_rows"), F.sum("n_failed").alias("n_failed"), F.max("n_done").alias("n_done"), F.max("percent").alias("percent"), (F.count("*") > 1).alias("in_parts"), F.bool_and("while_running").alias("while_running"))


@query("SELECT doc_id AS sample_id, '### 样本 ' || doc_id || chr(10) || '**lang**: ' || coalesce(lang, 'N/A') || chr(10) || '**text**: ' || coalesce(text, 'N/A') || chr(10) || chr(10) || '| 评估维度 | 评分 (1-5) | 备注 |' || chr(10) || '|---|---|---|' || chr(10) || '| 逻辑清晰度 | | |' || chr(10) || '| 完整性 | | |' || chr(10) AS page FROM documents")
def questionnaire_pages(spark: SparkSession, d: str) -> DataFrame:
    """A page of questions for each document."""
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("sample_id"), "lang", "text")
    return stored.questionnaire(rows, ["逻辑清晰度", "完整性"], ["lang", "text"])
