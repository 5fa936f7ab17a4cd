"""Classifiers by name: MLlib's, and the networks of ``deep``; numeric parity with other libraries is not claimed."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import FMClassifier, GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from credalyt.operators import deep

# Settings of the compared models, by name and data set.
CONFIGS: dict[str, dict[str, dict]] = {
    "logistic_regression": {"default": {"maxIter": 100, "regParam": 0.01, "standardization": False}},
    "random_forest": {"default": {"numTrees": 100, "maxDepth": 10, "featureSubsetStrategy": "sqrt", "seed": 42}},
    "gradient_boosting": {"default": {"maxIter": 50, "maxDepth": 6, "stepSize": 0.1, "seed": 42}},
    "factorization_machine": {"default": {"factorSize": 8, "maxIter": 100, "stepSize": 0.01, "seed": 42}},
    "multilayer_perceptron": {"default": {"maxIter": 100, "seed": 42}},
}
ALIASES = {"lr": "logistic_regression", "rf": "random_forest", "gbt": "gradient_boosting", "xgboost": "gradient_boosting", "fm": "factorization_machine", "tabnet": "attention", "mlp": "multilayer_perceptron"}
DISPLAY = {"deepfm": "DeepFM", "attention": "Attention network", "logistic_regression": "Logistic regression", "random_forest": "Random forest", "gradient_boosting": "Gradient boosting", "factorization_machine": "Factorization machine", "multilayer_perceptron": "Multilayer perceptron"}
_CLASSES = {"logistic_regression": LogisticRegression, "random_forest": RandomForestClassifier, "gradient_boosting": GBTClassifier, "factorization_machine": FMClassifier, "multilayer_perceptron": MultilayerPerceptronClassifier}


def model_config(name: str, dataset: str = "default") -> dict:
    full = ALIASES.get(name, name)
    if full in deep.MODELS:
        return dict(deep.SETTINGS[full])
    found = CONFIGS[full]
    return dict(found.get(dataset, found["default"]))


def available_models() -> list[str]:
    return sorted([*CONFIGS, *deep.MODELS])


def create_model(name: str, dataset: str = "default", **settings):
    """An estimator by name or alias; ValueError for others."""
    full = ALIASES.get(name, name)
    if full not in _CLASSES:
        raise ValueError(f"unknown model {name!r}; known: {available_models()}")
    return _CLASSES[full](featuresCol="features", labelCol="label", **{**model_config(full, dataset), **settings})


def balanced(df: DataFrame, label: str = "label") -> DataFrame:
    """``df`` with weight n / (2 * n of the row's class)."""
    counts = df.groupBy(label).agg(F.count("*").alias("_c"))
    total = df.agg(F.count("*").alias("_n"))
    return df.join(F.broadcast(counts), label).crossJoin(F.broadcast(total)).withColumn("weight", F.col("_n") / (2 * F.col("_c"))).drop("_c", "_n")


#: Rows of a partition of ``dealt``, at most
DEALT_ROWS = 500_000


def dealt(df: DataFrame, rows: int = DEALT_ROWS) -> DataFrame:
    """``df`` in equal partitions, as many for each core: what an iterative learner passes over again and again
    takes one wave of tasks of one length, however few or uneven partitions the rows came in."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores * max(1, -(-df.count() // (cores * rows))))


def train(df: DataFrame, name: str, features: list[str] | str, label: str = "label", balance: bool = True, **settings) -> PipelineModel | deep.Network:
    """A fitted pipeline or network; ``features`` are columns or one array column."""
    rows = df.withColumnRenamed(label, "label") if label != "label" else df
    if ALIASES.get(name, name) in deep.MODELS:
        rows = (balanced(rows) if balance else rows.withColumn("weight", F.lit(1.0))).withColumn("_features", _array(features))
        return deep.train(rows, ALIASES.get(name, name), "_features", id_col="_features", weight="weight", **settings)
    model = create_model(name, **settings)
    if isinstance(model, FMClassifier):  # passes over the rows once a step
        rows = dealt(rows.select("label", *([features] if isinstance(features, str) else features)))
    stages = []
    if isinstance(features, str):
        rows = rows.withColumn("features", array_to_vector(F.col(features)))
    else:
        stages.append(VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep"))
    if balance and hasattr(model, "setWeightCol"):
        rows = balanced(rows)
        model = model.setWeightCol("weight")
    return Pipeline(stages=[*stages, model]).fit(rows)


def _array(features: list[str] | str) -> Column:
    return F.col(features) if isinstance(features, str) else F.array(*[F.col(c).cast("double") for c in features])


def predict(model: PipelineModel | deep.Network, df: DataFrame, features: list[str] | str) -> DataFrame:
    """``df`` with score (probability of class 1) and pred, in one pass."""
    if isinstance(model, deep.Network):
        return model.predict(df.withColumn("_features", _array(features)), "_features").drop("_features")
    rows = df.withColumn("features", array_to_vector(F.col(features))) if isinstance(features, str) else df
    out = model.transform(rows)
    return out.select(*df.columns, vector_to_array("probability")[1].alias("score"), F.col("prediction").cast("int").alias("pred"))


def importances(model: PipelineModel, names: list[str]) -> list[tuple[str, float]]:
    """Names by importance (absolute weight for linear models), largest first."""
    last = model.stages[-1]
    values = last.featureImportances.toArray() if hasattr(last, "featureImportances") else [abs(x) for x in last.coefficients.toArray()]
    return sorted(zip(names, map(float, values)), key=lambda x: (-x[1], x[0]))


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_or_train(path: str, fit) -> PipelineModel:
    """The saved model, or a new one that is then saved."""
    from credalyt.sources.folders import exists

    if exists(SparkSession.active(), path):
        return PipelineModel.load(path)
    model = fit()
    save(model, path)
    return model
