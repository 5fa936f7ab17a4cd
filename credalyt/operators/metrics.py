"""Classification metrics, curves, repeats and tests as aggregates and windows.

Curves first reduce rows to one for each distinct score (map-side combined); running sums
then go over stretches of scores, so a window never holds all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credalyt.operators.ordered import running


def ratio(a: Column, b: Column) -> Column:
    """a / b, zero where b is zero."""
    return F.when(b == 0, 0.0).otherwise(a / b)


def confusion(rows: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    """One row: tp, fp, fn, tn."""
    c = lambda a, b: F.count_if((F.col(y) == a) & (F.col(pred) == b))
    return rows.agg(c(1, 1).alias("tp"), c(0, 1).alias("fp"), c(1, 0).alias("fn"), c(0, 0).alias("tn"))


def confusion_matrix(rows: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    """(y, pred, n)"""
    return rows.groupBy(F.col(y).alias("y"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))


def binary_metrics(rows: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    """Accuracy, precision, recall and F1 of class 1; zero where undefined."""
    c = confusion(rows, y, pred)
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    accuracy = ratio(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))
    f1 = ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    return c.select("tp", "fp", "fn", "tn", accuracy.alias("accuracy"), p.alias("precision"), r.alias("recall"), f1.alias("f1"))


def class_report(rows: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    """(cls, precision, recall, f1, support) of each class that occurs."""
    votes = rows.select(F.explode(F.array(F.struct(F.col(y).alias("cls"), F.lit(1).alias("is_y"), (F.col(y) == F.col(pred)).cast("int").alias("hit"), F.lit(0).alias("is_p")), F.struct(F.col(pred).alias("cls"), F.lit(0).alias("is_y"), F.lit(0).alias("hit"), F.lit(1).alias("is_p")))).alias("v")).select("v.*")
    g = votes.groupBy("cls").agg(F.sum("is_y").alias("support"), F.sum("hit").alias("hit"), F.sum("is_p").alias("predicted"))
    return g.select("cls", ratio(F.col("hit"), F.col("predicted")).alias("precision"), ratio(F.col("hit"), F.col("support")).alias("recall"), ratio(2 * F.col("hit"), F.col("predicted") + F.col("support")).alias("f1"), "support")


def weighted_metrics(rows: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    """Precision, recall and F1 weighted by support (recall equals accuracy)."""
    w = lambda c: (F.sum(F.col(c) * F.col("support")) / F.sum("support"))
    return class_report(rows, y, pred).agg(w("recall").alias("accuracy"), *[w(c).alias(f"{c}_weighted") for c in ("precision", "recall", "f1")])


def _by_score(rows: DataFrame, y: str, score: str) -> DataFrame:
    return rows.groupBy(F.col(score).alias("score")).agg(F.sum(F.col(y).cast("long")).alias("pos"), F.sum(1 - F.col(y).cast("long")).alias("neg"))


def curve(rows: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    """(score, pos, neg, tp, fp, p, n): totals at and above each distinct score."""
    g = _by_score(rows, y, score)
    total = g.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return running(g, "score", {"tp": "pos", "fp": "neg"}, descending=True).crossJoin(F.broadcast(total))  # one row


def roc_curve(rows: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    """(score, tpr, fpr)"""
    return curve(rows, y, score).select("score", ratio(F.col("tp"), F.col("p")).alias("tpr"), ratio(F.col("fp"), F.col("n")).alias("fpr"))


def pr_curve(rows: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    """(score, precision, recall)"""
    return curve(rows, y, score).select("score", ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), ratio(F.col("tp"), F.col("p")).alias("recall"))


def roc_auc(rows: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    """One row: the area under the ROC curve, ties counting half; zero for a single class."""
    c = curve(rows, y, score)
    below = F.col("n") - F.col("fp")
    pairs = F.sum(F.col("pos") * (below + F.col("neg") / 2.0))
    area = c.agg(pairs.alias("s"), F.max("p").alias("p"), F.max("n").alias("n"))
    return area.select(ratio(F.coalesce("s", F.lit(0.0)), F.coalesce(F.col("p") * F.col("n"), F.lit(0))).alias("roc_auc"))


def average_precision(rows: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    """One row: the mean of precision over steps of recall."""
    c = curve(rows, y, score)
    step = F.col("pos") / F.col("p") * ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    return c.agg(F.coalesce(F.sum(F.when(F.col("p") > 0, step)), F.lit(0.0)).alias("average_precision"))


def all_metrics(rows: DataFrame, y: str = "y", pred: str = "pred", score: str = "score") -> DataFrame:
    """One row of all binary metrics with both areas."""
    return binary_metrics(rows, y, pred).crossJoin(roc_auc(rows, y, score)).crossJoin(average_precision(rows, y, score))


def repeats(metrics: DataFrame) -> DataFrame:
    """(dataset, model, metric, mean, std) over repeats; the deviation is of the population."""
    return metrics.groupBy("dataset", "model", "metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def results_table(metrics: DataFrame, names: list[str]) -> DataFrame:
    """One row for each model and dataset, a mean and a deviation for each metric."""
    return repeats(metrics).groupBy("dataset", "model").pivot("metric", names).agg(F.first("mean").alias("mean"), F.first("std").alias("std"))


def t_two_sided(t: Column, df: Column, terms: int = 200) -> Column:
    """Two-sided tail of Student's t for whole degrees of freedom, in closed form.

    With c = df / (df + t^2), A(t | df) is a finite sum of powers of c (from 1 for even, from
    the angle for odd degrees); terms beyond 2 * ``terms`` degrees are not reached."""
    x = F.abs(t) / F.sqrt(df)
    theta = F.atan(x)
    c2 = F.cos(theta) * F.cos(theta)
    even = F.sin(theta) * F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.floor(df / 2).cast("int") - 1, F.lit(1))),
        F.struct(F.lit(1.0).alias("sum"), F.lit(1.0).alias("term")),
        lambda a, k: F.when(k > F.floor(df / 2) - 1, a).otherwise(F.struct((a["sum"] + a["term"] * c2 * (2 * k - 1) / (2 * k)).alias("sum"), (a["term"] * c2 * (2 * k - 1) / (2 * k)).alias("term"))),
        lambda a: a["sum"],
    )
    first = F.sin(theta) * F.cos(theta)
    odd_sum = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.floor((df - 1) / 2).cast("int") - 1, F.lit(1))),
        F.struct(F.lit(1.0).alias("sum"), F.lit(1.0).alias("term")),
        lambda a, k: F.when(k > F.floor((df - 1) / 2) - 1, a).otherwise(F.struct((a["sum"] + a["term"] * c2 * (2 * k) / (2 * k + 1)).alias("sum"), (a["term"] * c2 * (2 * k) / (2 * k + 1)).alias("term"))),
        lambda a: a["sum"],
    )
    odd = F.lit(2 / 3.141592653589793) * (theta + F.when(df > 1, first * odd_sum).otherwise(0.0))
    return F.lit(1.0) - F.when(df % 2 == 0, even).otherwise(odd)


def paired_t_test(pairs: DataFrame, by: list[str], a: str = "a", b: str = "b", alpha: float = 0.05) -> DataFrame:
    """(by, n, t, p, significant); fewer than two pairs or no spread give t = 0 and p = 1."""
    d = F.col(a) - F.col(b)
    g = pairs.groupBy(*by).agg(F.count(d).alias("n"), F.avg(d).alias("m"), F.stddev_samp(d).alias("s"))
    ok = (F.col("n") >= 2) & (F.col("s") > 0)
    t = F.when(ok, F.col("m") / (F.col("s") / F.sqrt("n"))).otherwise(0.0)
    g = g.withColumn("t", t)
    p = F.when(ok, t_two_sided(F.col("t"), (F.col("n") - 1).cast("double"))).otherwise(1.0)
    return g.withColumn("p", p).select(*by, "n", "t", "p", (F.col("p") < alpha).alias("significant"))


def against_baseline(metrics: DataFrame, baseline: str) -> DataFrame:
    """Paired tests of every model's repeats against the baseline's, for each dataset and metric."""
    base = metrics.where(F.col("model") == baseline).select("dataset", "metric", "repeat", F.col("value").alias("b"))
    other = metrics.where(F.col("model") != baseline).withColumnRenamed("value", "a")
    return paired_t_test(other.join(base, ["dataset", "metric", "repeat"]), ["dataset", "model", "metric"])


def class_weight(rows: DataFrame, y: str = "y") -> DataFrame:
    """One row: negatives over positives; one without positives."""
    return rows.agg(F.count_if(F.col(y) == 1).alias("p"), F.count_if(F.col(y) == 0).alias("n")).select(F.when(F.col("p") == 0, 1.0).otherwise(F.col("n") / F.col("p")).alias("scale_pos_weight"))
