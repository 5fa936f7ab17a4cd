"""Classification metrics over labels, with scores that follow from the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credalyt.operators import metrics
from credalyt.sources.tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return put


_ROWS = "r AS (SELECT quality AS y, n_chars AS score, CAST(n_chars > 1500 AS INT) AS pred FROM labels JOIN documents USING (doc_id))"


def rows(spark: SparkSession, d: str) -> DataFrame:
    """(y, score, pred): quality labels and the length of the text as score."""
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    return table(spark, d, "labels").join(docs, "doc_id").select(F.col("quality").alias("y"), F.col("n_chars").alias("score"), (F.col("n_chars") > 1500).cast("int").alias("pred"))


_COUNTS = "c AS (SELECT count(*) FILTER (y = 1 AND pred = 1) AS tp, count(*) FILTER (y = 0 AND pred = 1) AS fp, count(*) FILTER (y = 1 AND pred = 0) AS fn, count(*) FILTER (y = 0 AND pred = 0) AS tn FROM r)"
_BINARY = """tp, fp, fn, tn, (tp + tn)::DOUBLE / (tp + fp + fn + tn) AS accuracy, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS precision,
  coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS recall, coalesce(2 * tp::DOUBLE / nullif(2 * tp + fp + fn, 0), 0) AS f1"""
_CURVE = """
g AS (SELECT score, sum(y) AS pos, sum(1 - y) AS neg FROM r GROUP BY score),
k AS (SELECT score, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM g WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))"""
_AUC = "(SELECT round(sum(pos * (n - fp + neg / 2.0::DOUBLE)) / (max(p) * max(n)), 8) FROM k)"
_AP = "(SELECT round(sum(pos::DOUBLE / p * (tp::DOUBLE / (tp + fp))), 8) FROM k)"


@query(f"WITH {_ROWS}, {_COUNTS} SELECT {_BINARY} FROM c")
def binary_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy, precision, recall and F1 of class 1."""
    return metrics.binary_metrics(rows(spark, d))


@query(f"WITH {_ROWS}, {_COUNTS}, {_CURVE} SELECT {_BINARY}, {_AUC} AS roc_auc, {_AP} AS average_precision FROM c")
def all_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Every binary metric in one row."""
    return metrics.all_metrics(rows(spark, d)).withColumns({c: F.round(c, 8) for c in ("roc_auc", "average_precision")})


@query(f"WITH {_ROWS} SELECT y, pred, count(*) AS n FROM r GROUP BY y, pred")
def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Counts by truth and prediction."""
    return metrics.confusion_matrix(rows(spark, d))


_REPORT = f"""
WITH {_ROWS},
v AS (SELECT y AS cls, 1 AS s, CAST(y = pred AS INT) AS h, 0 AS q FROM r UNION ALL SELECT pred, 0, 0, 1 FROM r),
g AS (SELECT cls, sum(s) AS support, sum(h) AS hit, sum(q) AS predicted FROM v GROUP BY cls),
report AS (SELECT cls, coalesce(hit::DOUBLE / nullif(predicted, 0), 0) AS precision, coalesce(hit::DOUBLE / nullif(support, 0), 0) AS recall, coalesce(2 * hit::DOUBLE / nullif(predicted + support, 0), 0) AS f1, CAST(support AS BIGINT) AS support FROM g)"""


@query(_REPORT + "SELECT * FROM report")
def class_report(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of each class."""
    return metrics.class_report(rows(spark, d))


@query(_REPORT + "SELECT " + ", ".join(f"round(sum({c} * support) / sum(support), 8) AS {n}" for c, n in (("recall", "accuracy"), ("precision", "precision_weighted"), ("recall", "recall_weighted"), ("f1", "f1_weighted"))) + " FROM report")
def weighted_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Metrics weighted by support."""
    m = metrics.weighted_metrics(rows(spark, d))
    return m.select(*[F.round(c, 8).alias(c) for c in m.columns])


@query(f"WITH {_ROWS}, {_CURVE} SELECT score, tp::DOUBLE / p AS tpr, fp::DOUBLE / n AS fpr FROM k")
def roc_curve(spark: SparkSession, d: str) -> DataFrame:
    """True and false positive rates at each score."""
    return metrics.roc_curve(rows(spark, d))


@query(f"WITH {_ROWS}, {_CURVE} SELECT score, tp::DOUBLE / (tp + fp) AS precision, tp::DOUBLE / p AS recall FROM k")
def pr_curve(spark: SparkSession, d: str) -> DataFrame:
    """Precision and recall at each score."""
    return metrics.pr_curve(rows(spark, d))


@query(f"WITH {_ROWS}, {_CURVE} SELECT {_AUC} AS roc_auc")
def roc_auc(spark: SparkSession, d: str) -> DataFrame:
    """Area under the ROC curve."""
    return metrics.roc_auc(rows(spark, d)).select(F.round("roc_auc", 8).alias("roc_auc"))


@query(f"WITH {_ROWS}, {_CURVE} SELECT {_AP} AS average_precision")
def average_precision(spark: SparkSession, d: str) -> DataFrame:
    """Average precision."""
    return metrics.average_precision(rows(spark, d)).select(F.round("average_precision", 8).alias("average_precision"))


#: five repeats of four models on two data sets: means of order prices by status, shifted by the repeat
_METRICS = """
m AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'a' ELSE 'b' END AS dataset, 'model' || (o_orderkey // 2 % 4) AS model, CASE WHEN o_orderkey // 8 % 2 = 0 THEN 'f1' ELSE 'auc' END AS metric,
  o_orderkey // 16 % 5 AS repeat, round(avg(o_totalprice) / 100000, 6) AS value FROM orders GROUP BY ALL)"""


def repeated(spark: SparkSession, d: str) -> DataFrame:
    """(dataset, model, metric, repeat, value)"""
    o = table(spark, d, "orders").selectExpr("CASE WHEN o_orderkey % 2 = 0 THEN 'a' ELSE 'b' END AS dataset", "concat('model', o_orderkey div 2 % 4) AS model", "CASE WHEN o_orderkey div 8 % 2 = 0 THEN 'f1' ELSE 'auc' END AS metric", "o_orderkey div 16 % 5 AS repeat", "o_totalprice")
    return o.groupBy("dataset", "model", "metric", "repeat").agg(F.round(F.avg("o_totalprice") / 100000, 6).alias("value"))


@query(f"WITH {_METRICS} SELECT dataset, model, metric, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM m GROUP BY ALL")
def repeats_mean_std(spark: SparkSession, d: str) -> DataFrame:
    """Mean and deviation of the population over repeats."""
    return metrics.repeats(repeated(spark, d)).select("dataset", "model", "metric", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query(f"WITH {_METRICS} SELECT dataset, model, " + ", ".join(f"round(avg(value) FILTER (metric = '{k}'), 6) AS {k}_mean, round(stddev_pop(value) FILTER (metric = '{k}'), 6) AS {k}_std" for k in ("auc", "f1")) + " FROM m GROUP BY dataset, model")
def results_table(spark: SparkSession, d: str) -> DataFrame:
    """One row for each model and data set."""
    t = metrics.results_table(repeated(spark, d), ["auc", "f1"])
    return t.select("dataset", "model", *[F.round(c, 6).alias(c) for c in t.columns if c not in ("dataset", "model")])


@query(f"""
WITH {_METRICS},
p AS (SELECT a.dataset, a.model, a.metric, a.value - b.value AS d FROM m a JOIN m b ON a.dataset = b.dataset AND a.metric = b.metric AND a.repeat = b.repeat AND b.model = 'model0' WHERE a.model <> 'model0'),
g AS (SELECT dataset, model, metric, count(*) AS n, avg(d) / (stddev_samp(d) / sqrt(count(*))) AS t FROM p GROUP BY dataset, model, metric),
h AS (SELECT *, 1 - (sin(atan(abs(t) / 2)) * (1 + pow(cos(atan(abs(t) / 2)), 2) / 2)) AS p FROM g)
SELECT dataset, model, metric, n, round(t, 5) AS t, round(p, 6) AS p, p < 0.05 AS significant FROM h""")
def paired_ttest(spark: SparkSession, d: str) -> DataFrame:
    """Each model's repeats against the first model's (four degrees of freedom)."""
    t = metrics.against_baseline(repeated(spark, d), "model0")
    return t.withColumns({"t": F.round("t", 5), "p": F.round("p", 6)})
