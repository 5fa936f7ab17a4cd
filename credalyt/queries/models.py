"""Models, model calls and experiments; most have no SQL form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credalyt.operators import batch, matrix, ml, prep, udf
from credalyt.operators.vector import sparse_dot
from credalyt.plans import experiments, retrieval
from credalyt.sources.folders import saved, work_folder
from credalyt.sources.tables import applicants, card_transactions, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(f=None, oracle: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return put(f) if f else put


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """Vectors, with one of two classes to tell apart, and the rows to test on."""
    rows = table(spark, d, "embeddings").select("vec_id", "embedding", (F.col("label") < 5).cast("int").alias("label"))
    return prep.split(rows, "vec_id", 0.2, 42, "label")


def _scores(spark: SparkSession, d: str, name: str, **settings) -> DataFrame:
    rows = vectors(spark, d)
    model = ml.train(rows.where("not in_test"), name, "embedding", **settings)
    return ml.predict(model, rows.where("in_test"), "embedding").select("vec_id", "label", F.round("score", 6).alias("score"), "pred")


@query
def lr_scores(spark: SparkSession, d: str) -> DataFrame:
    """Logistic regression."""
    return _scores(spark, d, "lr")


@query
def rf_scores(spark: SparkSession, d: str) -> DataFrame:
    """Random forest."""
    return _scores(spark, d, "rf")


@query
def gbt_scores(spark: SparkSession, d: str) -> DataFrame:
    """Gradient-boosted trees."""
    return _scores(spark, d, "gbt")


@query
def fm_scores(spark: SparkSession, d: str) -> DataFrame:
    """A factorization machine."""
    return _scores(spark, d, "fm")


@query
def mlp_scores(spark: SparkSession, d: str) -> DataFrame:
    """A small neural network."""
    return _scores(spark, d, "mlp", layers=[64, 16, 2])


@query
def deepfm_scores(spark: SparkSession, d: str) -> DataFrame:
    """A factorization machine beside a deep part, trained in barrier mode."""
    return _scores(spark, d, "deepfm")


@query
def attention_scores(spark: SparkSession, d: str) -> DataFrame:
    """The network of sparse attention, trained in barrier mode."""
    return _scores(spark, d, "tabnet")


@query
def attention_importances(spark: SparkSession, d: str) -> DataFrame:
    """What share of the network's masks each component has."""
    rows = vectors(spark, d)
    model = ml.train(rows.where("not in_test"), "tabnet", "embedding")
    return model.importances(rows, "embedding").select("feature", F.round("importance", 6).alias("importance"))


_UNIFORM = "(('0x' || substr(md5('{0}|' || c_custkey), 1, 8))::BIGINT)::DOUBLE / 4294967296"


@query(oracle=f"""
WITH u AS (SELECT c_custkey, {_UNIFORM.format(42)} AS u, {_UNIFORM.format(43)} AS v FROM customer),
s AS (SELECT c_custkey, least(greatest(0.3::DOUBLE + 0.4::DOUBLE * u + 0.1::DOUBLE * (sqrt(-2.0::DOUBLE * ln(greatest(u, 1e-12::DOUBLE))) * cos(6.283185307179586::DOUBLE * v)), 0.0::DOUBLE), 1.0::DOUBLE) AS score FROM u)
SELECT c_custkey, round(score, 9) AS score, CAST(score > 0.5 AS INT) AS label FROM s""")
def mock_scores(spark: SparkSession, d: str) -> DataFrame:
    """The reproducible stand-in for a model."""
    return table(spark, d, "customer").select("c_custkey", udf.mock_prediction("c_custkey").alias("p")).select("c_custkey", F.round("p.score", 9).alias("score"), "p.label")


@query(oracle="SELECT conv_id, turn, md5(lower(regexp_replace(left(text, 8000), '^[\\s\\x{0B}\\x{85}\\p{Z}]+|[\\s\\x{0B}\\x{85}\\p{Z}]+$', '', 'g'))) AS cache_key, 64 AS dim FROM conversations")
def udf_embed(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings of conversations by the stand-in, through a cache."""
    c = table(spark, d, "conversations").select("conv_id", "turn", "text")
    cache = spark.createDataFrame([], "cache_key string, embedding array<float>")
    return udf.embed_with_cache(c, cache, udf.HashingEmbedder()).select("conv_id", "turn", "cache_key", F.size("embedding").alias("dim"))


@query(oracle="""
WITH m AS (SELECT conv_id, turn, text, (('0x' || substr(md5(text), 1, 8))::BIGINT) % 101 AS n FROM conversations),
a AS (SELECT *, '风险等级：' || CASE WHEN n <= 30 THEN '低风险' WHEN n <= 70 THEN '中风险' ELSE '高风险' END || chr(10) || '风险评分：' || n || '分' || chr(10) || '风险因素：' || chr(10) || '1. 收入：收入不稳定' || chr(10) || '有利因素：' || chr(10) || '1. 储蓄：有储蓄' || chr(10)
  || '审批建议：' || CASE WHEN n <= 30 THEN '批准' WHEN n <= 70 THEN '人工复核' ELSE '拒绝' END || chr(10) || '知识来源：[1] 风险案例' AS answer FROM m)
SELECT conv_id, turn, answer AS text, CAST(length(text) // 4 AS BIGINT) AS input_tokens, CAST(length(answer) // 4 AS BIGINT) AS output_tokens, CAST(NULL AS VARCHAR) AS error FROM a""")
def udf_generate(spark: SparkSession, d: str) -> DataFrame:
    """Answers of the stand-in."""
    return table(spark, d, "conversations").select("conv_id", "turn", udf.generate(F.col("text"), udf.EchoGenerator()).alias("a")).select("conv_id", "turn", "a.*")


@query(oracle="""
WITH t AS (SELECT DISTINCT text, (('0x' || substr(md5(text), 1, 8))::BIGINT) % 5 AS fails FROM conversations)
SELECT md5(text) AS key, CASE WHEN fails < 3 THEN CAST(length(text) AS VARCHAR) END AS answer, CAST(least(fails + 1, 3) AS INT) AS attempts, CASE WHEN fails >= 3 THEN 'busy 3' END AS error FROM t""")
def udf_retries(spark: SparkSession, d: str) -> DataFrame:
    """Calls of a client that is busy at first: answers, attempts and last errors."""
    texts = table(spark, d, "conversations").select("text").distinct()
    return texts.select(F.md5(F.col("text").cast("binary")).alias("key"), udf.generate_with_attempts(F.col("text"), udf.FlakyGenerator(), delay=0.0).alias("a")).select("key", F.col("a.text").alias("answer"), "a.attempts", "a.error")


@query
def model_importances(spark: SparkSession, d: str) -> DataFrame:
    """Components by importance for a forest that was saved and loaded again."""
    rows = vectors(spark, d)
    path = work_folder(spark, "forest")
    ml.load_or_train(path, lambda: ml.train(rows.where("not in_test"), "rf", "embedding"))
    loaded = ml.load_or_train(path, lambda: None)
    found = ml.importances(loaded, [str(i) for i in range(64)])
    return spark.createDataFrame([(i + 1, int(n), v) for i, (n, v) in enumerate(found)], "place int, feature int, importance double")


COLUMNS = ["checking_status", "duration", "credit_history", "purpose", "credit_amount", "savings_status", "employment", "age", "housing", "job"]


def knowledge(spark: SparkSession, d: str) -> DataFrame:
    """All documents, with their whole texts, stand for three knowledge collections."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.element_at(F.array(F.lit("risk_cases"), F.lit("regulations"), F.lit("industry_knowledge")), (F.col("doc_id") % 3 + 1).cast("int")).alias("collection"), F.create_map(F.lit("source"), F.col("source")).alias("metadata"))
    # embedded once: every variant of the system reads the table
    return saved(docs.withColumn("embedding", udf.embed(F.col("content"), udf.HashingEmbedder())), work_folder(spark, "knowledge"))


def customers(spark: SparkSession, d: str) -> DataFrame:
    """Applications of every twentieth customer, their fields made from the customer's number."""
    ids = table(spark, d, "customer").where("c_custkey % 20 = 0").select(F.col("c_custkey").alias("id"))
    return applicants(spark, 0, ids=ids).withColumnRenamed("customer_id", "query_id").withColumnRenamed("true_risk_level", "true_level")


@query
def rag_analyze(spark: SparkSession, d: str) -> DataFrame:
    """Retrieval, prompt, answer and fields for synthetic applicants."""
    rows = retrieval.analyze(customers(spark, d), knowledge(spark, d), COLUMNS, udf.HashingEmbedder(), udf.EchoGenerator())
    return rows.select("query_id", "true_level", F.length("prompt").alias("prompt_length"), "analysis.risk_level", "analysis.risk_score", "analysis.approval")


@query
def rag_ablation(spark: SparkSession, d: str) -> DataFrame:
    """The variants of the system, summarised."""
    configs = retrieval.ABLATION
    return batch.ablation_summary(retrieval.ablation(customers(spark, d), knowledge(spark, d), COLUMNS, udf.HashingEmbedder(), udf.EchoGenerator(), configs))


@query
def synthetic_card(spark: SparkSession, d: str) -> DataFrame:
    """Prepared synthetic card transactions, one for each order."""
    ids = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    rows = prep.prepare_card(card_transactions(spark, ids.count(), share=0.01, ids=ids).withColumnRenamed("id", "row_id"), ["Amount", "Time"])
    return rows.groupBy("Class", "in_test").agg(F.count("*").alias("n"), F.round(F.avg("Amount"), 4).alias("amount"))


@query
def synthetic_german(spark: SparkSession, d: str) -> DataFrame:
    """Prepared synthetic applicants, one for each customer."""
    rows = applicants(spark, 0, ids=table(spark, d, "customer").select(F.col("c_custkey").alias("id"))).withColumn("class", (F.col("true_risk_level") == 2).cast("int") + 1).withColumnRenamed("customer_id", "row_id")
    out = prep.prepare_german(rows, ["purpose", "job"], ["duration", "credit_amount", "age"])
    return out.groupBy("class", "in_test").agg(F.count("*").alias("n"), F.max("purpose").alias("purposes"))


@query
def experiment_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Two models, two repeats, all metrics."""
    rows = table(spark, d, "embeddings").select("vec_id", "embedding", (F.col("label") < 5).cast("int").alias("label"))
    return experiments.run({"vectors": rows}, ["lr", "rf"], {"vectors": "embedding"}, "vec_id", repeats=2, settings={"rf": {"numTrees": 5, "maxDepth": 3}})


@query
def text_classifier(spark: SparkSession, d: str) -> DataFrame:
    """TF-IDF features and a forest, for the quality of documents."""
    docs = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id")
    rows = experiments.text_features(docs, 100).join(docs.select("doc_id", "label"), "doc_id")
    parts = prep.split(rows, "doc_id", 0.3, 42, "label")
    model = ml.train(parts.where("not in_test"), "rf", "features", numTrees=10, maxDepth=5)
    return ml.predict(model, parts.where("in_test"), "features").select("doc_id", "label", F.round("score", 6).alias("score"), "pred")


@query(oracle="""SELECT item_id, round(1.0::DOUBLE / (1.0::DOUBLE + exp(-len(list_intersect(list_distinct(string_split_regex(text, '\\s+')), ['the', 'of', 'and']))::DOUBLE)), 6) AS score FROM benchmark""")
def rerank_udf(spark: SparkSession, d: str) -> DataFrame:
    """Pairs scored by a stand-in for a cross-encoder."""
    pairs = table(spark, d, "benchmark").select("item_id", "text")

    def scorer(rows: list[tuple[str, str]]) -> list[float]:
        return [float(len(set(a.split()) & set(b.split()))) for a, b in rows]

    return pairs.select("item_id", F.round(udf.rerank(F.lit("the of and"), F.col("text"), scorer, sigmoid=True), 6).alias("score"))


_DENSITY = r"""
WITH docs AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda x: len(x) >= 2) AS w FROM documents),
grams AS (SELECT doc_id, unnest(list_concat(w, CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE [] END)) AS term FROM docs),
tf AS (SELECT doc_id, term, count(*) AS tf FROM grams GROUP BY doc_id, term),
voc AS (SELECT term FROM tf, (SELECT count(*) AS n FROM docs) GROUP BY term, n HAVING count(*) <= 0.95 * n ORDER BY sum(tf) DESC, term LIMIT 200)
SELECT count(*)::DOUBLE / (count(DISTINCT term) * (SELECT count(*) FROM docs)) AS density FROM tf JOIN voc USING (term)"""


@query(oracle=_DENSITY)
def tfidf_density(spark: SparkSession, d: str) -> DataFrame:
    """The share of TF-IDF cells in use."""
    return experiments.density(table(spark, d, "documents"), 200)


@query(oracle="SELECT x.p_partkey AS i, CAST(x.p_size * y.p_size AS DOUBLE) AS s FROM part x JOIN part y ON y.p_partkey = x.p_partkey + 1 AND y.p_brand = x.p_brand")
def sparse_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Inner products of term weights of neighbouring parts."""
    p = table(spark, d, "part").select("p_partkey", F.create_map(F.col("p_brand"), F.col("p_size").cast("double")).alias("m"))
    q = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("m").alias("n"))
    return p.join(q, "p_partkey").select(F.col("p_partkey").alias("i"), sparse_dot(F.col("m"), F.col("n")).alias("s")).where("s > 0")


@query(oracle="""
WITH v AS (SELECT vec_id, [embedding[k:k + 15] FOR k IN [1, 17, 33, 49]] AS p FROM embeddings),
x AS (SELECT q.vec_id AS query_id, v.vec_id AS doc_id, unnest(q.p) AS a, v.p AS b FROM v, v q WHERE q.vec_id % 20 = 0),
y AS (SELECT query_id, doc_id, list_max(list_transform(b, lambda w: list_sum(list_transform(range(1, 17), lambda i: a[i]::DOUBLE * w[i]::DOUBLE)))) AS m FROM x),
s AS (SELECT query_id, doc_id, round(sum(m), 8) AS score FROM y GROUP BY query_id, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s)
SELECT query_id, doc_id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 10""")
def late_interaction(spark: SparkSession, d: str) -> DataFrame:
    """Sums of best matches between the quarters of vectors: the ten best for every twentieth."""
    quarters = F.array(*[F.slice("embedding", 1 + 16 * k, 16) for k in range(4)])
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), quarters.alias("v"))
    asked = v.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), F.col("v").alias("q"))
    return matrix.max_sim(v, asked, 10).withColumn("score", F.round("score", 6))


@query(oracle="""
WITH c AS (SELECT o_orderkey AS case_id, o_orderkey % 3 AS t, o_orderkey % 2 AS a, o_orderkey % 5 % 3 AS b, o_orderkey % 4 AS n FROM orders)
SELECT case_id FROM c WHERE (a = t) <> (b = t) OR t = 2 OR n >= 3 ORDER BY case_id LIMIT 10""")
def interesting_cases(spark: SparkSession, d: str) -> DataFrame:
    """Cases for a report: methods differ, high level, or many factors."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("case_id"))
    k = F.col("case_id")
    cases = o.select("case_id", (k % 3).alias("true_level"))
    first = o.select("case_id", (k % 2).alias("level"))
    second = o.select("case_id", (k % 5 % 3).alias("level"), (k % 4).alias("n_factors"))
    return experiments.interesting_cases(cases, first, second).select("case_id")
