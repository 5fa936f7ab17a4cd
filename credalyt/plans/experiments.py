"""Experiments: models by data sets by repeats, to metrics, tests, cases and reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credalyt.functions import explain
from credalyt.functions.text import join_present
from credalyt.operators import lexical, metrics, ml, prep
from credalyt.sources.sinks import report

METRICS = ("accuracy", "precision", "recall", "f1", "roc_auc", "average_precision")


def evaluate(predictions: DataFrame, dataset: str, model: str, repeat: int) -> DataFrame:
    """(dataset, model, repeat, metric, value) of predictions (label, pred, score)."""
    row = metrics.all_metrics(predictions, "label")
    each = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in METRICS])
    return row.select(F.lit(dataset).alias("dataset"), F.lit(model).alias("model"), F.lit(repeat).alias("repeat"), F.inline(each))


def run(datasets: dict[str, DataFrame], models: list[str], features: dict[str, list[str] | str], id_col: str, repeats: int = 5, share: float = 0.2, settings: dict[str, dict] | None = None) -> DataFrame:
    """Metrics of every model on every data set (with label), a new stratified split for each repeat."""
    out = None
    for dataset, rows in datasets.items():
        for repeat in range(repeats):
            parts = prep.split(rows, id_col, share, 42 + repeat, "label")
            for name in models:
                model = ml.train(parts.where("not in_test"), name, features[dataset], **(settings or {}).get(name, {}))
                part = evaluate(ml.predict(model, parts.where("in_test"), features[dataset]), dataset, name, repeat)
                out = part if out is None else out.unionByName(part)
    return out


def text_features(docs: DataFrame, vocabulary: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, features): TF-IDF weights as arrays in the order of the terms."""
    weights = lexical.tfidf(docs, id_col, text_col, max_features=vocabulary)
    terms = weights.select("term").distinct().orderBy("term").agg(F.array_sort(F.collect_set("term")).alias("terms"))  # at most ``vocabulary``
    maps = weights.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("term", "weight"))).alias("m"))
    every = docs.select(F.col(id_col).alias("doc_id")).join(maps, "doc_id", "left").crossJoin(F.broadcast(terms))
    return every.select("doc_id", F.transform("terms", lambda t: F.coalesce(F.element_at("m", t), F.lit(0.0))).alias("features"))


def density(docs: DataFrame, vocabulary: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row: the share of TF-IDF cells that are not zero."""
    weights = lexical.tfidf(docs, id_col, text_col, max_features=vocabulary)
    cells = weights.agg(F.count("*").alias("cells"), F.count_distinct("term").alias("terms"))
    return cells.crossJoin(docs.agg(F.count("*").alias("n"))).select((F.col("cells") / (F.col("terms") * F.col("n"))).alias("density"))


def case_text(purpose: Column, appeal: Column, remark: Column) -> Column:
    """The text of a case: its fields that are not empty."""
    return join_present(" ", purpose, appeal, remark)


def analyze_cases(cases: DataFrame) -> DataFrame:
    """``cases`` (loan_purpose_text, customer_appeal, transaction_remark) with level, score and used factors."""
    text = case_text(*[F.coalesce(c, F.lit("")) for c in ("loan_purpose_text", "customer_appeal", "transaction_remark")])
    rows = cases.withColumn("case_text", text)
    rows = rows.withColumns({"_k": explain.keyword_risk(F.col("case_text")), "_f": explain.keyword_factors(F.col("case_text"))})
    k, f = F.col("_k"), F.col("_f")
    used = F.size(f["risk_factors"]) + F.size(f["favorable_factors"])
    return rows.withColumns({"level": k["level"], "score": k["score"], "n_factors": used, "utilisation": explain.text_utilisation(F.col("case_text"), used)}).drop("_k", "_f")


def interesting_cases(cases: DataFrame, first: DataFrame, second: DataFrame, most: int = 10) -> DataFrame:
    """Cases that both methods judged and on which they differ in correctness, or of a high level, or with three
    factors and more: the first ``most`` by id, for a report.  Results are (case_id, level, n_factors)."""
    a = first.dropDuplicates(["case_id"]).select("case_id", F.col("level").alias("first_level"))
    b = second.dropDuplicates(["case_id"]).select("case_id", F.col("level").alias("second_level"), F.col("n_factors"))
    rows = cases.join(a, "case_id").join(b, "case_id")
    differ = (F.col("first_level") == F.col("true_level")) != (F.col("second_level") == F.col("true_level"))
    return rows.where(differ | (F.col("true_level") == 2) | (F.col("n_factors") >= 3)).orderBy("case_id").limit(most)


def experiment_report(results: DataFrame, baseline: str) -> str:
    """Means, deviations and tests against the baseline, in Markdown."""
    table = metrics.repeats(results).orderBy("dataset", "metric", "model")
    tests = metrics.against_baseline(results, baseline).orderBy("dataset", "metric", "model")
    return report("Results", table) + "\n" + report(f"Tests against {baseline}", tests)


def observed(df: DataFrame, name: str, success: Column, tokens: Column, cost: Column) -> tuple[DataFrame, Callable[[], dict]]:
    """``df`` and a function that gives its call statistics once it has been computed, without a second pass."""
    from pyspark.sql import Observation

    seen = Observation(name)
    out = df.observe(seen, F.count(F.lit(1)).alias("calls"), F.count_if(success).alias("succeeded"), F.sum(tokens).alias("tokens"), F.round(F.sum(cost), 4).alias("cost"))
    return out, lambda: seen.get


def cache_stats(spark, path: str) -> DataFrame:
    """One row: files of a cache folder and their bytes."""
    return spark.read.format("binaryFile").load(path).agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))
