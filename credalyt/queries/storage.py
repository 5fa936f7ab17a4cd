"""Sources and sinks: tables written in each format and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credalyt.sources import sinks, tables
from credalyt.sources.folders import availability, work_folder
from credalyt.sources.tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str):
    def put(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, oracle
        return f

    return put


_GERMAN_ROW = {
    "checking_status": "'A1' || (1 + c_custkey % 4)", "duration": "CAST(4 + c_custkey % 60 AS INT)", "credit_history": "'A3' || (c_custkey % 5)", "purpose": "'A4' || (c_custkey % 10)", "credit_amount": "CAST(250 + c_custkey % 9000 AS INT)",
    "savings_status": "'A6' || (1 + c_custkey % 5)", "employment": "'A7' || (1 + c_nationkey % 5)", "installment_commitment": "CAST(1 + c_nationkey % 4 AS INT)", "personal_status": "'A9' || (1 + c_custkey % 4)", "other_parties": "'A10' || (1 + c_custkey % 3)",
    "residence_since": "CAST(1 + c_custkey % 4 AS INT)", "property_magnitude": "'A12' || (1 + c_custkey % 4)", "age": "CAST(19 + c_custkey % 56 AS INT)", "other_payment_plans": "'A14' || (1 + c_custkey % 3)", "housing": "'A15' || (1 + c_custkey % 3)",
    "existing_credits": "CAST(1 + c_custkey % 4 AS INT)", "job": "'A17' || (1 + c_custkey % 4)", "num_dependents": "CAST(1 + c_custkey % 2 AS INT)", "own_telephone": "'A19' || (1 + c_custkey % 2)", "foreign_worker": "'A20' || (1 + c_nationkey % 2)", "class": "CAST(1 + c_custkey % 2 AS INT)",
}


@query("SELECT " + ", ".join(f"{e} AS {c}" for c, e in _GERMAN_ROW.items()) + " FROM customer")
def csv_headerless(spark: SparkSession, d: str) -> DataFrame:
    """Applicants as a space-delimited file without header, read with fixed names."""
    path = work_folder(spark, "german")
    table(spark, d, "customer").selectExpr(*[f"{e} AS {c}" for c, e in _GERMAN_ROW.items()]).write.option("sep", " ").csv(path)
    return tables.read_german(spark, path)


@query('SELECT l_orderkey::DOUBLE AS "Time", ' + ", ".join(f'l_quantity + {i} AS "V{i}"' for i in range(1, 29)) + ', l_extendedprice AS "Amount", CAST(l_linenumber % 2 AS INT) AS "Class" FROM lineitem')
def csv_card(spark: SparkSession, d: str) -> DataFrame:
    """Transactions as a file with header, read with the schema of card data through the named loaders."""
    path = work_folder(spark, "card")
    rows = table(spark, d, "lineitem")
    sinks.write_csv(rows.select(F.col("l_orderkey").cast("double").alias("Time"), *[(F.col("l_quantity") + i).alias(f"V{i}") for i in range(1, 29)], F.col("l_extendedprice").alias("Amount"), (F.col("l_linenumber") % 2).cast("int").alias("Class")), path)
    sets = tables.Datasets()
    sets.register("Credit_Card", tables.read_card)
    return sets.load("credit_card", spark, path)


@query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def csv_generic(spark: SparkSession, d: str) -> DataFrame:
    """A table as CSV, read with a given schema."""
    path = work_folder(spark, "csv")
    rows = table(spark, d, "supplier")
    sinks.write_results(rows, path, "csv", ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"])
    return tables.read_csv(spark, path, "s_suppkey long, s_name string, s_nationkey int, s_acctbal double")


@query("SELECT n_nationkey, n_name, printf('%.2f', n_regionkey::DOUBLE) AS v FROM nation UNION ALL SELECT r_regionkey, r_name, '0.50' FROM region")
def csv_append(spark: SparkSession, d: str) -> DataFrame:
    """Two result sets appended to one, columns in order and doubles with fixed decimals."""
    path = work_folder(spark, "append")
    sinks.append_csv(table(spark, d, "nation").select(F.col("n_regionkey").cast("double").alias("v"), "n_name", "n_nationkey"), path, ["n_nationkey", "n_name", "v"], 2)
    sinks.append_csv(table(spark, d, "region").select(F.col("r_regionkey").alias("n_nationkey"), F.col("r_name").alias("n_name"), F.lit(0.5).alias("v")), path, ["n_nationkey", "n_name", "v"], 2)
    return tables.read_csv(spark, path, "n_nationkey int, n_name string, v string")


@query("SELECT conv_id, turn, role, text FROM conversations")
def json_results(spark: SparkSession, d: str) -> DataFrame:
    """Results as JSON lines, read back."""
    path = work_folder(spark, "json")
    sinks.write_results(table(spark, d, "conversations").select("conv_id", "turn", "role", "text"), path)
    return spark.read.schema("conv_id long, turn long, role string, text string").json(path)


@query("SELECT event_type AS config, event_id, value FROM events")
def json_details(spark: SparkSession, d: str) -> DataFrame:
    """Details in one folder for each configuration."""
    path = work_folder(spark, "details")
    sinks.write_details(table(spark, d, "events").select(F.col("event_type").alias("config"), "event_id", "value"), path)
    return spark.read.schema("event_id long, value double, config string").json(path)


@query("SELECT CAST(doc_id AS VARCHAR) AS case_id, lang AS category, CASE WHEN doc_id % 3 = 0 THEN text ELSE source END AS content FROM documents WHERE coalesce(trim(CASE WHEN doc_id % 3 = 0 THEN text ELSE source END), '') <> ''")
def json_knowledge(spark: SparkSession, d: str) -> DataFrame:
    """Knowledge documents as JSON arrays; content comes from the first field that is not empty."""
    path = work_folder(spark, "knowledge")
    docs = table(spark, d, "documents")
    rows = docs.select(F.col("doc_id").cast("string").alias("case_id"), F.col("lang").alias("category"), F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise("").alias("content"), F.when(F.col("doc_id") % 3 != 0, F.col("source")).alias("case_summary"))
    rows.groupBy(F.pmod(F.xxhash64("case_id"), F.lit(64)).alias("part")).agg(F.to_json(F.collect_list(F.struct(*rows.columns))).alias("value")).select("value").write.text(path)
    # one array a line, as each bounded part is one file's worth of objects
    return spark.read.schema(tables.KNOWLEDGE).json(path).select("case_id", "category", F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in ("content", "description", "case_summary")]).alias("content")).where("content IS NOT NULL")


@query("SELECT 'C' || conv_id AS case_id, CAST(conv_id % 90 AS INT) AS age, text AS customer_appeal, '低' AS risk_level FROM conversations WHERE turn = 0")
def json_cases(spark: SparkSession, d: str) -> DataFrame:
    """Test cases with nested records, one object a file part."""
    path = work_folder(spark, "cases")
    rows = table(spark, d, "conversations").where("turn = 0").select(F.concat(F.lit("C"), "conv_id").alias("case_id"), F.col("text").alias("customer_appeal"), F.struct((F.col("conv_id") % 90).cast("int").alias("age")).alias("structured_data"), F.lit("低").alias("risk_level"))
    rows.write.json(path)
    return spark.read.schema(tables.TEXT_CASE).json(path).select("case_id", F.col("structured_data.age").alias("age"), "customer_appeal", "risk_level")


@query("SELECT 'region-' || r_regionkey AS doc_id, r_name || chr(10) || '第 ' || r_regionkey AS content FROM region")
def text_documents(spark: SparkSession, d: str) -> DataFrame:
    """Whole files as documents."""
    path = work_folder(spark, "texts")
    table(spark, d, "region").select(F.concat(F.lit("region-"), "r_regionkey").alias("name"), F.concat("r_name", F.lit("\n第 "), "r_regionkey").alias("value")).repartition(1).write.partitionBy("name").text(path)
    rows = tables.read_texts(spark, f"{path}/*/*.txt")
    return rows.select(F.regexp_extract("source", r"name=([^/]+)/", 1).alias("doc_id"), F.rtrim(F.regexp_replace("content", r"\n\z", "")).alias("content"))


@query("SELECT 'CUST_000' || (n_nationkey % 3) AS customer_id, count(*) AS n, CAST(sum(n_nationkey) AS BIGINT) AS total FROM nation GROUP BY 1")
def json_batches(spark: SparkSession, d: str) -> DataFrame:
    """Batch inputs in three forms: an object with customers, a list, one object."""
    path = work_folder(spark, "batches")
    rows = table(spark, d, "nation").select((F.col("n_nationkey") % 3).alias("i"), F.struct(F.col("n_nationkey").alias("k")).alias("r"), F.floor(F.col("n_nationkey") / 3).alias("g"))
    lists = rows.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("i", "r"))).alias("x")).select("g", F.transform("x", lambda y: y["r"]).alias("r"))
    form = F.when(F.size("r") == 1, F.to_json(F.get("r", F.lit(0)))).when(F.col("g") % 2 == 0, F.to_json(F.struct(F.col("r").alias("customers")))).otherwise(F.to_json("r"))
    lists.select("g", form.alias("value")).repartition(1).write.partitionBy("g").text(path)
    return tables.read_batch(spark, f"{path}/*/*.txt", "struct<k:int>").groupBy("customer_id").agg(F.count("*").alias("n"), F.sum("data.k").cast("long").alias("total"))


@query("SELECT doc_id, quality, toxic FROM labels")
def matrix_rows(spark: SparkSession, d: str) -> DataFrame:
    """A prepared matrix and its record, read back; and a table that is built only where it is missing."""
    path = work_folder(spark, "matrix")
    sinks.write_matrix(table(spark, d, "labels"), path, {"steps": "none"})
    assert spark.read.json(f"{path}/info").count() == 1
    built = lambda: spark.read.parquet(f"{path}/rows").select("doc_id", "quality", "toxic")
    tables.scan_or_build(spark, f"{path}/again", built)
    return tables.scan_or_build(spark, f"{path}/again", lambda: built().where("false"))


@query("""SELECT 'vectors' AS collection, CAST(vec_id AS VARCHAR) AS id, CAST(label AS VARCHAR) AS label, round(list_sum(list_transform(embedding, lambda x: abs(x::DOUBLE))), 4) AS size FROM embeddings
UNION ALL SELECT 'failed', 'f' || r_regionkey, 'r', 0.0 FROM region""")
def collection_rows(spark: SparkSession, d: str) -> DataFrame:
    """Collections: added, replaced, with zeros for failed embeddings, dropped and read."""
    store = sinks.Collections(spark, work_folder(spark, "collections"))
    rows = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.lit("").alias("content"), F.create_map(F.lit("label"), F.col("label").cast("string")).alias("metadata"), "embedding")
    failed = table(spark, d, "region").select(F.concat(F.lit("f"), "r_regionkey").alias("id"), F.col("r_name").alias("content"), F.create_map(F.lit("label"), F.lit("r")).alias("metadata"), F.lit(None).cast("array<float>").alias("embedding"))
    store.add(rows.limit(1), "vectors")
    store.add(rows, "vectors", replace=True)
    store.add(rows, "other")
    store.add(failed, "failed", failed="zeros")
    store.add(failed, "vectors")
    store.drop("other")
    return store.read("vectors", "failed", "other").select("collection", "id", F.col("metadata")["label"].alias("label"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + F.abs(x.cast("double"))), 4).alias("size"))


@query("SELECT 'regulations' AS collection, 2 * count(*) AS n, 2 * count(*) AS ids FROM region")
def collection_counts(spark: SparkSession, d: str) -> DataFrame:
    """Documents of each collection; missing ids are numbered on."""
    store = sinks.Collections(spark, work_folder(spark, "counts"))
    rows = table(spark, d, "region").select(F.lit(None).cast("string").alias("id"), F.col("r_name").alias("content"), F.lit(None).cast("map<string,string>").alias("metadata"), F.array(F.lit(1.0).cast("float")).alias("embedding"))
    for _ in range(2):
        store.add(rows, "regulations")
    return store.counts().join(store.read().groupBy("collection").agg(F.count_distinct("id").alias("ids")), "collection")


@query("SELECT * FROM (VALUES ('events', true), ('none', false)) v(source, available)")
def source_availability(spark: SparkSession, d: str) -> DataFrame:
    """Which sources are there."""
    return availability(spark, {"none": f"{d}/none.parquet", "events": f"{d}/events.parquet"})
