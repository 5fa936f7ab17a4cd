"""Feature preparation: reports, imputation, scaling, encoding, splits, oversampling.

Statistics are one aggregate over all columns; what they give is one row, broadcast.
Random choices order rows by MD5 of seed and id, so every run and every cluster agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from credalyt.operators.neighbours import neighbours
from credalyt.operators.ordered import ranked
from credalyt.operators.selection import quantiles


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def features_and_target(df: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
    return df.drop(target), df.select(target)


def missing_report(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, missing, percent), one row for each column."""
    columns = columns or df.columns
    row = df.agg(F.count("*").alias("n"), *[F.count_if(F.col(c).isNull()).alias(f"m{i}") for i, c in enumerate(columns)])
    each = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("missing")) for i, c in enumerate(columns)])
    return row.select("n", F.inline(each)).select("column", "missing", F.when(F.col("n") > 0, F.col("missing") * 100.0 / F.col("n")).otherwise(0.0).alias("percent"))


def integrity_report(df: DataFrame, expected: list[str], target: str | None = None) -> DataFrame:
    """One row: expected columns that are missing, null cells, rows beyond the first of equals, target values."""
    missing = [c for c in expected if c not in df.columns]
    nulls = sum((F.count_if(F.col(c).isNull()) for c in df.columns[1:]), F.count_if(F.col(df.columns[0]).isNull()))
    facts = [F.array(*map(F.lit, missing)).cast("array<string>").alias("missing_columns"), nulls.alias("null_cells"), F.count("*").alias("n_rows")]
    if target:
        facts.append(F.array_sort(F.collect_set(F.col(target).cast("string"))).alias("target_values"))
    distinct = df.distinct().agg(F.count("*").alias("n_distinct"))
    out = df.agg(*facts).crossJoin(distinct)
    return out.withColumn("duplicate_rows", F.col("n_rows") - F.col("n_distinct")).drop("n_distinct")


def statistics(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, mean, std, min, q25, median, q75, max): deviation of the sample, exact quantiles."""
    exact = quantiles(df, {c: [0.25, 0.5, 0.75] for c in columns})

    def one(c: str) -> list[Column]:
        q25, median, q75 = (F.lit(q).cast("double") for q in exact[c])
        return [F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).cast("double").alias("min"), q25.alias("q25"), median.alias("median"), q75.alias("q75"), F.max(c).cast("double").alias("max")]

    aggs = [F.struct(*one(c)).alias(f"s{i}") for i, c in enumerate(columns)]
    each = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"s{i}").alias("s")) for i, c in enumerate(columns)])
    return df.agg(*aggs).select(F.inline(each)).select("column", "s.*")


def class_distribution(df: DataFrame, column: str) -> DataFrame:
    """(value, n, ratio)"""
    total = df.agg(F.count("*").alias("total"))
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).select("value", "n", (F.col("n") / F.col("total")).alias("ratio"))


def distinct_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n_distinct), exact."""
    row = df.agg(*[F.count_distinct(c).alias(f"d{i}") for i, c in enumerate(columns)])
    return row.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"d{i}").alias("n_distinct")) for i, c in enumerate(columns)])))


def _fitted(df: DataFrame, fit_on: DataFrame | None, aggs: list[Column]) -> DataFrame:
    """df beside the one row of statistics of ``fit_on`` (of df itself: the leaky form)."""
    return df.crossJoin(F.broadcast((df if fit_on is None else fit_on).agg(*aggs)))


def impute(df: DataFrame, columns: list[str], strategy: str = "mean", value: object = None, fit_on: DataFrame | None = None) -> DataFrame:
    """Nulls replaced by mean, median, most_frequent (ties: the smallest) or a constant."""
    if strategy == "constant":
        return df.fillna({c: value for c in columns})
    if strategy == "mean":
        out = _fitted(df, fit_on, [F.avg(c).alias(f"fill_{c}") for c in columns])
    elif strategy == "median":
        medians = quantiles(df if fit_on is None else fit_on, {c: [0.5] for c in columns})
        out = df.withColumns({f"fill_{c}": F.lit(medians[c][0]).cast("double") for c in columns})
    else:
        out = df
        for c in columns:
            counts = (df if fit_on is None else fit_on).where(F.col(c).isNotNull()).groupBy(c).count()
            out = out.crossJoin(F.broadcast(counts.agg(F.min_by(F.col(c), F.struct(-F.col("count"), F.col(c))).alias(f"fill_{c}"))))
    return out.withColumns({c: F.coalesce(F.col(c), F.col(f"fill_{c}")) for c in columns}).drop(*[f"fill_{c}" for c in columns])


def standardize(df: DataFrame, columns: list[str], fit_on: DataFrame | None = None) -> DataFrame:
    """(x - mean) / deviation of the population; a deviation of zero counts as one."""
    aggs = [a for c in columns for a in (F.avg(c).alias(f"mean_{c}"), F.stddev_pop(c).alias(f"std_{c}"))]
    out = _fitted(df, fit_on, aggs)
    z = {c: (F.col(c) - F.col(f"mean_{c}")) / F.coalesce(F.nullif(F.col(f"std_{c}"), F.lit(0.0)), F.lit(1.0)) for c in columns}
    return out.withColumns(z).select(*df.columns)


def minmax(df: DataFrame, columns: list[str], fit_on: DataFrame | None = None) -> DataFrame:
    """To [0, 1]; a constant column becomes 0."""
    aggs = [a for c in columns for a in (F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}"))]
    out = _fitted(df, fit_on, aggs)
    return out.withColumns({c: F.when(F.col(f"hi_{c}") == F.col(f"lo_{c}"), 0.0).otherwise((F.col(c) - F.col(f"lo_{c}")) / (F.col(f"hi_{c}") - F.col(f"lo_{c}"))) for c in columns}).select(*df.columns)


def label_encode(df: DataFrame, columns: list[str], fit_on: DataFrame | None = None) -> DataFrame:
    """Codes from 0 in the order of the values as text; an unseen value becomes null."""
    out = df
    for c in columns:
        values = (df if fit_on is None else fit_on).select(F.col(c).cast("string").alias(f"v_{c}")).where(f"v_{c} is not null").distinct()
        codes = ranked(values, f"v_{c}", f"code_{c}").withColumn(f"code_{c}", (F.col(f"code_{c}") - 1).cast("int"))
        out = out.join(codes, out[c].cast("string") == F.col(f"v_{c}"), "left").drop(c, f"v_{c}").withColumnRenamed(f"code_{c}", c)
    return out.select(*df.columns)


def one_hot(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """A 0/1 column ``column_value`` for each value; others give zeros."""
    return df.withColumns({f"{column}_{v}": F.coalesce((F.col(column) == v).cast("int"), F.lit(0)) for v in values}).drop(column)


def shift_label(df: DataFrame, column: str) -> DataFrame:
    """Labels 1/2 become 0/1; other ranges stay."""
    r = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    shift = F.when((F.col("lo") == 1) & (F.col("hi") == 2), 1).otherwise(0)
    return df.crossJoin(F.broadcast(r)).withColumn(column, F.col(column) - shift).select(*df.columns)


def shuffle_key(id_col: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(id_col).cast("string")).cast("binary"))


def split(df: DataFrame, id_col: str, share: float = 0.2, seed: int = 42, stratify: str | None = None) -> DataFrame:
    """``df`` with ``in_test``: exactly round(n * share) rows of each class (or of all).

    Ranks are computed from per-bucket counts and ranks inside hash buckets, so one large
    class is not sorted in one task."""
    key = shuffle_key(id_col, seed)
    cls = F.col(stratify) if stratify else F.lit(0)
    rows = df.withColumns({"_cls": cls, "_key": key, "_bucket": F.substring(key, 1, 2)})
    sizes = rows.groupBy("_cls", "_bucket").agg(F.count("*").alias("_n"))
    by = Window.partitionBy("_cls")
    sizes = sizes.withColumns({"_before": F.sum("_n").over(by.orderBy("_bucket")) - F.col("_n"), "_total": F.sum("_n").over(by)}).drop("_n")
    rank = F.row_number().over(Window.partitionBy("_cls", "_bucket").orderBy("_key", id_col))
    ranked = rows.withColumn("_rank", rank)
    joined = ranked.join(sizes, ranked["_cls"].eqNullSafe(sizes["_cls"]) & (ranked["_bucket"] == sizes["_bucket"]))
    return joined.select(*[ranked[c] for c in df.columns], (F.col("_before") + F.col("_rank") <= F.floor(F.col("_total") * F.lit(share) + 0.5)).alias("in_test"))


def sample_rows(df: DataFrame, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement: a sampling operator."""
    return df.orderBy(shuffle_key(id_col, seed), id_col).limit(n)


def positional_split(df: DataFrame, order: str, share: float = 0.7) -> DataFrame:
    """``df`` with ``in_train``: the first floor(n * share) rows in the order of a unique column."""
    total = df.agg(F.count("*").alias("_n"))
    return ranked(df, order, "_r").crossJoin(F.broadcast(total)).select(*df.columns, (F.col("_r") <= F.floor(F.col("_n") * F.lit(share))).alias("in_train"))


def minority_neighbours(df: DataFrame, id_col: str, vector_col: str, k: int = 5) -> DataFrame:
    """(id, neighbour, rank, d): the k nearest other rows by Euclidean distance."""
    return neighbours(df, id_col, vector_col, k)[0]


def uniform(seed: int, *columns: str) -> Column:
    """A number in [0, 1) from MD5 of seed and columns."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def oversample(minority: DataFrame, n_new: int, id_col: str, vector_col: str, k: int = 5, seed: int = 42) -> DataFrame:
    """(new_id, base, neighbour, lambda, vector): n_new points between minority rows and their neighbours.

    New points go round the minority rows in id order; the neighbour and the place between
    follow from MD5."""
    rows = minority.select(F.col(id_col).alias("base"), F.col(vector_col).alias("v"))
    n = rows.count()
    if not n or n_new <= 0:
        return rows.select(F.lit(0).cast("long").alias("new_id"), "base", F.lit(0).cast("long").alias("neighbour"), F.lit(0.0).alias("lambda"), F.col("v").cast("array<double>").alias("vector")).where("false")
    order = ranked(rows, "base", "place").withColumn("place", F.col("place") - 1)
    times = order.withColumn("copies", F.floor((n_new - F.col("place") + n - 1) / n).cast("int")).where("copies > 0")
    new = times.withColumn("c", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).withColumn("new_id", (F.col("c") * n + F.col("place")).cast("long"))
    new = new.withColumns({"rank": (F.floor(uniform(seed, "new_id") * min(k, max(n - 1, 1))) + 1).cast("int"), "lambda": uniform(seed + 1, "new_id")})
    near = minority_neighbours(minority, id_col, vector_col, k).select(F.col("id").alias("base"), "neighbour", "rank")
    other = rows.select(F.col("base").alias("neighbour"), F.col("v").alias("w"))
    full = new.join(near, ["base", "rank"]).join(other, "neighbour")
    vector = F.zip_with("v", "w", lambda x, y: x.cast("double") + F.col("lambda") * (y.cast("double") - x.cast("double")))
    return full.select("new_id", "base", "neighbour", "lambda", vector.alias("vector"))


def smote(df: DataFrame, label: str, minority: object, id_col: str, vector_col: str, k: int = 5, seed: int = 42) -> DataFrame:
    """As many new points of the minority class as the other rows have more."""
    few = F.col(label) == F.lit(minority)
    sizes = df.agg(F.count_if(few).alias("few"), F.count_if(~few).alias("many")).first()
    return oversample(df.where(few), sizes.many - sizes.few, id_col, vector_col, k, seed)


def prepare_german(df: DataFrame, categorical: list[str], numerical: list[str], target: str = "class", id_col: str = "row_id", encoding: str = "label", share: float = 0.2, seed: int = 42, leaky: bool = False) -> DataFrame:
    """Shifted label, codes or 0/1 columns, scaled numbers and ``in_test``; statistics come from the training rows."""
    rows = split(shift_label(df, target), id_col, share, seed, stratify=target)
    train = rows if leaky else rows.where("not in_test")
    if encoding == "label":
        rows = label_encode(rows, categorical, train)
    else:
        for c in categorical:
            values = [r[0] for r in train.select(F.col(c).cast("string")).where(F.col(c).isNotNull()).distinct().orderBy(c).collect()]  # code lists
            rows = one_hot(rows, c, values)
    return standardize(rows, numerical, train)


def prepare_card(df: DataFrame, scaled: list[str], target: str = "Class", id_col: str = "row_id", share: float = 0.2, seed: int = 42, leaky: bool = False) -> DataFrame:
    """Means for nulls, scaled columns and ``in_test``."""
    rows = split(df, id_col, share, seed, stratify=target)
    train = rows if leaky else rows.where("not in_test")
    numbers = [c for c in numeric_columns(df) if c not in (target, id_col)]
    return standardize(impute(rows, numbers, "mean", fit_on=train), scaled, train)
