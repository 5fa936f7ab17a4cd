"""Schemas, scans and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from credalyt.functions.decode import CODES
from credalyt.sources.folders import exists

#: The 21 fields of the German credit file, in order (it has no header).
GERMAN = (
    "checking_status string, duration int, credit_history string, purpose string, credit_amount int, savings_status string, employment string, "
    "installment_commitment int, personal_status string, other_parties string, residence_since int, property_magnitude string, age int, "
    "other_payment_plans string, housing string, existing_credits int, job string, num_dependents int, own_telephone string, foreign_worker string, class int"
)
CARD = T.StructType([T.StructField("Time", T.DoubleType()), *[T.StructField(f"V{i}", T.DoubleType()) for i in range(1, 29)], T.StructField("Amount", T.DoubleType()), T.StructField("Class", T.IntegerType())])
KNOWLEDGE = "case_id string, rule_id string, knowledge_id string, case_type string, title string, source string, category string, description string, case_summary string, content string, risk_indicators array<string>, decision string, risk_level string"
TEXT_CASE = (
    "case_id string, customer_id string, loan_purpose_text string, customer_appeal string, transaction_remark string, "
    "structured_data struct<age:int,employment:string,credit_amount:int,duration:int,credit_history:string,purpose:string,checking_status:string,savings_status:string>, risk_level string, risk_score int"
)
COLLECTIONS = ("regulations", "industry_knowledge", "risk_cases")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_german(spark: SparkSession, path: str) -> DataFrame:
    """Space-delimited, no header."""
    return spark.read.schema(GERMAN).option("sep", " ").csv(path)


def read_card(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CARD).option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """With header; types are inferred only if no schema is given."""
    reader = spark.read.option("header", True)
    return reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", True).csv(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A JSON array (or lines) of objects."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_knowledge(spark: SparkSession, path: str) -> DataFrame:
    """Knowledge documents with content from the first of content, description and summary that is not empty."""
    rows = read_json(spark, path, KNOWLEDGE)
    filled = F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in ("content", "description", "case_summary")])
    return rows.withColumn("content", filled).where(F.col("content").isNotNull())


def read_text_cases(spark: SparkSession, path: str) -> DataFrame:
    return read_json(spark, path, TEXT_CASE)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, content, source): each file one document."""
    return spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("doc_id"), F.col("value").alias("content"), F.col("_metadata.file_path").alias("source"))


def read_batch(spark: SparkSession, path: str, record: str) -> DataFrame:
    """(customer_id, data): an object with customers (and ids), one object, or a list of objects."""
    raw = spark.read.text(path, wholetext=True)
    wrapped = F.from_json("value", f"customers array<{record}>, customer_ids array<string>")
    many = F.from_json("value", f"array<{record}>")
    data = F.when(F.ltrim("value").startswith("["), many).when(F.size(wrapped["customers"]) > 0, wrapped["customers"]).otherwise(F.array(F.from_json("value", record)))
    return raw.select(F.posexplode(data).alias("i", "data"), wrapped["customer_ids"].alias("ids")).select(F.coalesce(F.get("ids", F.col("i")), F.format_string("CUST_%04d", F.col("i"))).alias("customer_id"), "data")


def scan_or_build(spark: SparkSession, path: str, build) -> DataFrame:
    """The stored table; it is built and stored where it is missing."""
    if not exists(spark, path):
        build().write.parquet(path)
    return spark.read.parquet(path)


class Datasets:
    """Named loaders; names are not case-sensitive."""

    def __init__(self):
        self._loaders: dict = {}

    def register(self, name: str, loader) -> None:
        self._loaders[name.lower()] = loader

    def load(self, name: str, *args) -> DataFrame:
        if name.lower() not in self._loaders:
            raise ValueError(f"unknown data set {name!r}; known: {sorted(self._loaders)}")
        return self._loaders[name.lower()](*args)


def pick(values: list, *key: Column) -> Column:
    """One of the values, by MD5 of the key."""
    n = F.conv(F.substring(F.md5(F.concat_ws("|", *[k.cast("string") for k in key]).cast("binary")), 1, 8), 16, 10).cast("long")
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))


def uniform(*key: Column) -> Column:
    n = F.conv(F.substring(F.md5(F.concat_ws("|", *[k.cast("string") for k in key]).cast("binary")), 1, 8), 16, 10).cast("double")
    return n / F.lit(float(1 << 32))


def between(low: int, high: int, *key: Column) -> Column:
    """A whole number from low to high."""
    return (F.floor(uniform(*key) * (high - low + 1)) + low).cast("int")


def card_transactions(spark: SparkSession, n: int, seed: int = 42, share: float = 0.00172, ids: DataFrame | None = None) -> DataFrame:
    """Synthetic card data: uniform times, exponential amounts, normal features, int(n * share) positives;
    ``ids``, n unique numbers in a column id, may come from a table."""
    rows = spark.range(n) if ids is None else ids.select("id")
    i = F.col("id")
    u = lambda name: F.greatest(uniform(F.lit(f"{seed}{name}"), i), F.lit(1e-12))
    normal = lambda k: F.sqrt(-2.0 * F.log(u(f"a{k}"))) * F.cos(F.lit(6.283185307179586) * u(f"b{k}"))
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), i.cast("string")).cast("binary"))
    positives = rows.orderBy(order).limit(int(n * share)).withColumn("Class", F.lit(1))
    features = rows.select("id", (u("t") * 172800).alias("Time"), *[normal(k).alias(f"V{k}") for k in range(1, 29)], (-88.35 * F.log(u("m"))).alias("Amount"))
    return features.join(positives, "id", "left").withColumn("Class", F.coalesce("Class", F.lit(0)))


# Ranges of synthetic applicants by level: amount, duration, age, histories, accounts, employments.
APPLICANTS = {
    0: ((500, 3000), (6, 18), (30, 55), ["A31", "A32"], ["A13", "A14"], ["A74", "A75"]),
    1: ((3000, 8000), (12, 36), (25, 50), ["A32", "A33"], ["A12", "A13"], ["A73", "A74"]),
    2: ((8000, 15000), (24, 48), (20, 40), ["A33", "A34"], ["A11", "A12"], ["A71", "A72", "A73"]),
}


def applicants(spark: SparkSession, n: int, seed: int = 42, ids: DataFrame | None = None) -> DataFrame:
    """Synthetic applicants with their true level (0.3, 0.4 and 0.3 of them low, medium and high); for
    numbers below n, or for those in column id of ``ids``."""
    i, s = F.col("id"), F.lit(str(seed))
    u = uniform(s, F.lit("level"), i)
    level = F.when(u < 0.3, 0).when(u < 0.7, 1).otherwise(2)

    def by_level(make) -> Column:
        return F.when(F.col("true_risk_level") == 0, make(APPLICANTS[0])).when(F.col("true_risk_level") == 1, make(APPLICANTS[1])).otherwise(make(APPLICANTS[2]))

    k = lambda name: (s, F.lit(name), i)
    codes = lambda c, drop=(): pick([x for x in CODES[c] if x not in drop], *k(c)).alias(c)
    rows = (spark.range(n) if ids is None else ids.select("id")).withColumn("true_risk_level", level)
    return rows.select(
        F.format_string("CUST_%04d", i).alias("customer_id"),
        by_level(lambda a: pick(a[4], *k("checking"))).alias("checking_status"),
        by_level(lambda a: between(*a[1], *k("duration"))).alias("duration"),
        by_level(lambda a: pick(a[3], *k("history"))).alias("credit_history"),
        codes("purpose"),
        by_level(lambda a: between(*a[0], *k("amount"))).alias("credit_amount"),
        codes("savings_status"),
        by_level(lambda a: pick(a[5], *k("employment"))).alias("employment"),
        between(1, 4, *k("installment")).alias("installment_commitment"),
        codes("personal_status", ("A95",)),
        F.lit("A101").alias("other_parties"),
        between(1, 4, *k("residence")).alias("residence_since"),
        codes("property_magnitude"),
        by_level(lambda a: between(*a[2], *k("age"))).alias("age"),
        F.lit("A143").alias("other_payment_plans"),
        codes("housing"),
        between(1, 3, *k("credits")).alias("existing_credits"),
        codes("job"),
        between(1, 2, *k("dependents")).alias("num_dependents"),
        codes("own_telephone"),
        F.lit("A202").alias("foreign_worker"),
        "true_risk_level",
    )
