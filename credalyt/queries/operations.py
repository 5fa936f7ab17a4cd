"""Batches, caches, costs, rules, summaries, and windows over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credalyt.functions import explain
from credalyt.operators import batch, rules
from credalyt.sources.tables import table
from credalyt.streaming import events as streams

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return put


# Events stand for a log of model calls.
_PRICES = (("model-large", 0.0008, 0.002), ("model-embed", 0.00005, 0.0))
_CALL = "CASE event_id % 3 WHEN 0 THEN 'model-large' WHEN 1 THEN 'model-embed' ELSE 'unknown' END AS model, 100 + event_id % 900 AS input_tokens, event_id % 300 AS output_tokens"
_CALLS_SQL = f"""
p(name, input_price, output_price) AS (VALUES {", ".join(f"('{m}', {i}::DOUBLE, {o}::DOUBLE)" for m, i, o in _PRICES)}),
c AS (SELECT event_id, user_id, event_type, value, {_CALL} FROM events),
k AS (SELECT c.*, input_tokens * coalesce(input_price / 1000, 0) AS a, output_tokens * coalesce(output_price / 1000, 0) AS b FROM c LEFT JOIN p ON model = name)"""


def calls(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.sql(f"SELECT event_id, user_id, event_type, value, {_CALL} FROM {{t}}", t=table(spark, d, "events"))
    prices = spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{m}', {i}D, {o}D)" for m, i, o in _PRICES) + " AS p(model, input_price, output_price)")
    return batch.cost(rows, prices)


@query(f"WITH {_CALLS_SQL} SELECT event_id, model, round(a, 6) AS input_cost, round(b, 6) AS output_cost, round(a + b, 6) AS total_cost FROM k")
def cost_estimate(spark: SparkSession, d: str) -> DataFrame:
    """Costs of calls by model prices."""
    return calls(spark, d).select("event_id", "model", "input_cost", "output_cost", "total_cost")


_LOG = "event_type <> 'error' AND event_id % 11 <> 0"


@query(f"""
WITH {_CALLS_SQL},
l AS (SELECT model, {_LOG} AS success, input_tokens + output_tokens AS tokens, round(a + b, 6) AS cost, value AS latency FROM k)
SELECT model, count(*) AS calls, count(*) FILTER (success) AS succeeded, count(*) FILTER (NOT success) AS failed, CAST(sum(tokens) AS BIGINT) AS tokens, round(sum(cost), 5) AS cost,
  round(avg(latency) FILTER (success), 6) AS mean_latency, round(count(*) FILTER (success) * 100.0::DOUBLE / count(*), 6) AS success_percent FROM l GROUP BY model""")
def call_stats(spark: SparkSession, d: str) -> DataFrame:
    """Calls, successes, tokens, cost and latency by model."""
    rows = calls(spark, d).select("model", F.expr(_LOG).alias("success"), (F.col("input_tokens") + F.col("output_tokens")).alias("tokens"), F.col("total_cost").alias("cost"), F.col("value").alias("latency"))
    s = batch.call_stats(rows, ["model"])
    return s.withColumns({"cost": F.round("cost", 5), "mean_latency": F.round("mean_latency", 6), "success_percent": F.round("success_percent", 6)})


# Results of a batch: levels, scores and approvals that follow from the event.
_RESULT = "event_id % 11 <> 0 AS success, event_id % 5 = 0 AS cached, 50 + event_id % 200 AS tokens, CASE WHEN event_id % 13 = 0 THEN -1 ELSE event_id % 101 END AS score, CAST(event_id % 4 AS INT) AS level, CASE event_id % 4 WHEN 0 THEN '批准' WHEN 1 THEN '人工复核' WHEN 2 THEN '拒绝' ELSE '待定' END AS approval"


def results(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(f"SELECT event_id, user_id, {_RESULT} FROM {{t}}", t=table(spark, d, "events"))


_RES = f"WITH r AS (SELECT event_id, user_id, {_RESULT} FROM events) "


@query(_RES + "SELECT count(*) AS total, count(*) FILTER (success) AS succeeded, count(*) FILTER (cached) AS cached, CAST(sum(tokens) AS BIGINT) AS tokens, round(sum(tokens)::DOUBLE / count(*) FILTER (success), 6) AS tokens_each, round(avg(score) FILTER (score >= 0), 6) AS score_mean, min(score) FILTER (score >= 0) AS score_min, max(score) FILTER (score >= 0) AS score_max FROM r")
def batch_report(spark: SparkSession, d: str) -> DataFrame:
    """Totals and scores of a batch."""
    return batch.batch_report(results(spark, d)).withColumns({"tokens_each": F.round("tokens_each", 6), "score_mean": F.round("score_mean", 6)})


@query(_RES + "SELECT count(*) FILTER (level = 0) AS low, count(*) FILTER (level = 1) AS medium, count(*) FILTER (level >= 2) AS high, count(*) FILTER (approval = '批准') AS approved, count(*) FILTER (approval = '拒绝') AS rejected, count(*) FILTER (approval NOT IN ('批准', '拒绝')) AS review FROM r")
def decision_summary(spark: SparkSession, d: str) -> DataFrame:
    """Levels and approvals of a batch."""
    return batch.decision_summary(results(spark, d))


@query(_RES + "SELECT category, count(event_id) AS n FROM (VALUES ('批准'), ('拒绝'), ('人工复核'), ('待定'), ('未处理')) v(category) LEFT JOIN r ON approval = category GROUP BY category")
def approval_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Counts of stated categories, zero included."""
    return batch.histogram(results(spark, d), "approval", ["批准", "拒绝", "人工复核", "待定", "未处理"])


@query("SELECT event_id, event_type FROM events WHERE event_id % 10 >= 3")
def resume_antijoin(spark: SparkSession, d: str) -> DataFrame:
    """Requests without a result yet."""
    e = table(spark, d, "events").select("event_id", "event_type")
    return batch.to_do(e, e.where("event_id % 10 < 3"), "event_id")


@query("SELECT event_id, event_type FROM events")
def resumed_results(spark: SparkSession, d: str) -> DataFrame:
    """Earlier and new results of a resumed batch."""
    e = table(spark, d, "events").select("event_id", "event_type")
    done = e.where("event_id % 10 < 3")
    return batch.resumed(done, batch.to_do(e, done, "event_id"))


@query("""
WITH r AS (SELECT conv_id, turn, md5(lower(text)) AS key, text FROM conversations),
cache AS (SELECT DISTINCT key, length(text) AS value FROM r WHERE turn % 2 = 0)
SELECT conv_id, turn, value, value IS NOT NULL AS hit FROM r LEFT JOIN (SELECT key, min(value) AS value FROM cache GROUP BY key) USING (key)""")
def cache_split(spark: SparkSession, d: str) -> DataFrame:
    """Requests with their cached values."""
    r = table(spark, d, "conversations").select("conv_id", "turn", F.md5(F.lower("text").cast("binary")).alias("key"), "text")
    cache = r.where("turn % 2 = 0").select("key", F.length("text").cast("long").alias("value"))
    return batch.split_cached(r, cache, "key", "value").select("conv_id", "turn", "value", "hit")


@query("SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 5 AS batch FROM conversations")
def numbered_batches(spark: SparkSession, d: str) -> DataFrame:
    """Turns in batches of five."""
    return batch.numbered_batches(table(spark, d, "conversations").select("conv_id", "turn"), "turn", 5, "conv_id")


@query("""
WITH b AS (SELECT conv_id, turn, length(text) AS l, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 5 AS batch FROM conversations),
g AS (SELECT conv_id, batch, max(l) AS l FROM (SELECT *, max(l) OVER (PARTITION BY conv_id) AS m FROM b) GROUP BY conv_id, batch)
SELECT conv_id, count(*) AS groups, round(avg(m), 6) AS mean_latency FROM (SELECT conv_id, batch, max(m) AS m FROM (SELECT *, max(l) OVER (PARTITION BY conv_id) AS m FROM b) GROUP BY conv_id, batch) GROUP BY conv_id""")
def grouped_batches(spark: SparkSession, d: str) -> DataFrame:
    """Calls that answer five rows at a time, and their latency."""
    c = table(spark, d, "conversations")
    m = c.groupBy("conv_id").agg(F.max(F.length("text")).alias("m"))
    rows = c.select("conv_id", "turn").join(m, "conv_id")
    return batch.grouped_summary(rows, "turn", 5, "m", "conv_id").withColumn("mean_latency", F.round("mean_latency", 6))


_ABLATION = "CASE event_id % 4 WHEN 0 THEN 'full' WHEN 1 THEN 'llm_only' WHEN 2 THEN 'bm25_only' ELSE 'vector_only' END AS config, event_id % 11 <> 0 AS success, CAST(event_id // 4 % 3 AS INT) AS level, CAST(event_id // 8 % 3 AS INT) AS true_level, event_id % 500 AS tokens, event_id % 5 AS n_factors, event_id % 4 AS n_sources, event_id % 7 <> 0 AS parsed, CASE WHEN event_id % 13 = 0 THEN -1 ELSE event_id % 101 END AS score, CASE event_id % 3 WHEN 0 THEN '待定' ELSE '批准' END AS approval"
_ABLATION_SQL = f"""
WITH r AS (SELECT {_ABLATION} FROM events),
s AS (SELECT *, CASE WHEN success THEN least(n_factors * 10, 30) + least(n_sources * 8, 25) + CASE WHEN parsed THEN 25 ELSE 0 END + CASE WHEN score >= 0 THEN 10 ELSE 0 END + CASE WHEN approval <> '待定' THEN 10 ELSE 0 END ELSE 0 END AS points FROM r),
t AS (SELECT config, count(*) AS n, count(*) FILTER (success) AS succeeded, round(count(*) FILTER (success AND level = true_level)::DOUBLE / count(*) FILTER (success), 6) AS accuracy, round(avg(tokens) FILTER (success), 6) AS mean_tokens, round(avg(points), 6) AS explainability FROM s GROUP BY config)
"""


def ablation_results(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(f"SELECT event_id, {_ABLATION} FROM {{t}}".replace("event_id // 4 % 3", "(event_id div 4) % 3").replace("event_id // 8 % 3", "(event_id div 8) % 3"), t=table(spark, d, "events"))


@query(_ABLATION_SQL + "SELECT * FROM t")
def ablation_summary(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy and means of each variant."""
    return batch.ablation_summary(ablation_results(spark, d)).withColumns({c: F.round(c, 6) for c in ("accuracy", "mean_tokens", "explainability")})


@query(_ABLATION_SQL + "SELECT config, accuracy FROM t ORDER BY accuracy DESC, config LIMIT 1")
def best_config(spark: SparkSession, d: str) -> DataFrame:
    """The most accurate variant."""
    return batch.best_config(ablation_summary(spark, d))


@query("SELECT event_id, CASE WHEN success THEN least(n_factors * 10, 30) + least(n_sources * 8, 25) + CASE WHEN parsed THEN 25 ELSE 0 END + CASE WHEN score >= 0 THEN 10 ELSE 0 END + CASE WHEN approval <> '待定' THEN 10 ELSE 0 END ELSE 0 END AS points FROM (SELECT event_id, " + _ABLATION + " FROM events)")
def explanation_points(spark: SparkSession, d: str) -> DataFrame:
    """0 to 100 points for each result."""
    c = F.col
    return ablation_results(spark, d).select("event_id", explain.explanation_points(c("success"), c("n_factors"), c("n_sources"), c("parsed"), c("score"), c("approval")).alias("points"))


@query("SELECT name, count(*) AS n FROM (SELECT unnest(list_filter(string_split(text, ' '), lambda x: x <> '')) AS name FROM conversations) GROUP BY name ORDER BY n DESC, name LIMIT 20")
def factor_frequency(spark: SparkSession, d: str) -> DataFrame:
    """The twenty most frequent elements of arrays."""
    return batch.frequency(table(spark, d, "conversations"), F.filter(F.split("text", " "), lambda x: x != ""))


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY user_id, event_type")
def dedupe_keep_first(spark: SparkSession, d: str) -> DataFrame:
    """The first event of each user and type."""
    e = table(spark, d, "events").select("user_id", "event_type", "event_id")
    return batch.dedupe_keep_first(e, ["user_id", "event_type"], ["event_id"])


@query("SELECT * FROM (SELECT c_custkey AS key, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier)")
def union_results(spark: SparkSession, d: str) -> DataFrame:
    """Results one below the other."""
    return table(spark, d, "customer").selectExpr("c_custkey AS key", "c_name AS name").unionByName(table(spark, d, "supplier").selectExpr("s_suppkey AS key", "s_name AS name"))


#: rule_id, age_min, age_max, profile, policy_type, claims_max, approve, discount, base_price
_RULES = (
    "(1, 18, 24, 'LOW', 'COMPREHENSIVE', 0, true, 1, 450)",
    "(2, 18, 24, 'MED', 'FIRE_THEFT', NULL, true, 0, 200)",
    "(3, 18, 24, 'MED', 'COMPREHENSIVE', 0, true, 0, 300)",
    "(4, 18, 24, NULL, 'FIRE_THEFT', 1, true, 0, 150)",
    "(5, 25, 60, NULL, 'COMPREHENSIVE', 1, true, 5, 150)",
    "(6, 25, 60, NULL, 'FIRE_THEFT', 2, true, 5, 120)",
    "(7, NULL, NULL, 'HIGH', NULL, 0, true, 2, NULL)",
    "(8, NULL, NULL, NULL, NULL, NULL, NULL, 1, NULL)",
    "(9, 61, NULL, 'HIGH', NULL, NULL, false, 0, NULL)",
)
_RULE_COLUMNS = "rule_id, age_min, age_max, profile, policy_type, claims_max, approve, discount, base_price"
_FACTS = "c_custkey AS fact_id, CAST(16 + c_custkey % 60 AS INT) AS age, CAST(c_custkey % 4 AS INT) AS claims, CASE c_custkey % 3 WHEN 0 THEN 'LOW' WHEN 1 THEN 'MED' ELSE 'HIGH' END AS profile, CASE WHEN c_nationkey % 2 = 0 THEN 'COMPREHENSIVE' ELSE 'FIRE_THEFT' END AS policy_type"


@query(f"""
WITH r({_RULE_COLUMNS}) AS (VALUES {", ".join(_RULES)}),
f AS (SELECT {_FACTS} FROM customer),
h AS (SELECT f.*, rule_id, approve, discount, base_price FROM f LEFT JOIN r ON (age_min IS NULL OR age >= age_min) AND (age_max IS NULL OR age <= age_max) AND (r.profile IS NULL OR r.profile = f.profile)
  AND (r.policy_type IS NULL OR r.policy_type = f.policy_type) AND (claims_max IS NULL OR claims <= claims_max)),
g AS (SELECT fact_id, age, claims, profile, policy_type, string_agg(rule_id, ',' ORDER BY rule_id) AS rule_ids, coalesce(bool_or(approve), false) AND coalesce(bool_and(approve), true) AS approved, CAST(coalesce(sum(discount), 0) AS BIGINT) AS discount,
  coalesce(arg_min(base_price, rule_id) FILTER (base_price IS NOT NULL), 0) AS base_price FROM h GROUP BY ALL)
SELECT *, base_price * (100 - least(discount, 100)) / 100.0::DOUBLE AS price FROM g""")
def rule_pricing(spark: SparkSession, d: str) -> DataFrame:
    """Drivers against a decision table."""
    table_of_rules = spark.sql(f"SELECT * FROM VALUES {', '.join(_RULES)} AS r({_RULE_COLUMNS})")
    out = rules.evaluate(spark.sql(f"SELECT {_FACTS} FROM {{t}}", t=table(spark, d, "customer")), table_of_rules)
    return out.withColumn("rule_ids", F.array_join("rule_ids", ","))


@query("SELECT event_type, user_id % 5 AS user_group, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY CUBE (event_type, user_id % 5)")
def ext_cube(spark: SparkSession, d: str) -> DataFrame:
    """All groupings of two columns."""
    e = table(spark, d, "events").withColumn("user_group", F.col("user_id") % 5)
    return e.cube("event_type", "user_group").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value"))


@query("SELECT epoch_ms(date_trunc('day', ts)) // 1000 AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL")
def ext_tumbling(spark: SparkSession, d: str) -> DataFrame:
    """Counts by day."""
    return streams.tumbling(table(spark, d, "events")).select(F.unix_timestamp("start").alias("start"), "event_type", "n", F.round("value", 4).alias("value"))


@query("SELECT epoch_ms(date_trunc('day', ts)) // 1000 - k * 86400 AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events, (VALUES (0), (1)) v(k) GROUP BY ALL")
def ext_sliding(spark: SparkSession, d: str) -> DataFrame:
    """Windows of two days that start every day."""
    return streams.sliding(table(spark, d, "events")).select(F.unix_timestamp("start").alias("start"), "event_type", "n", F.round("value", 4).alias("value"))


@query("""
WITH o AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new, event_id FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM o)
SELECT user_id, epoch_us(min(ts)) AS start, epoch_us(max(ts)) + 43200000000 AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def ext_session(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of users with gaps of twelve hours."""
    s = streams.sessions(table(spark, d, "events"))
    return s.select("user_id", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end"), "n")
