"""Invariants of operators."""

import random

import pytest
from pyspark.sql import functions as F

from credalyt.operators import batch, fusion, lexical, metrics, ml, prep, rules, udf, vector
from credalyt.sources import sinks, tables
from credalyt.streaming import events


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, "a b b"), (2, "a c"), (3, "c c c d"), (4, None)], "doc_id int, text string")
    got = {r.doc_id: r.score for r in lexical.bm25(docs, spark.createDataFrame([(0, "b b zz")], "query_id int, text string"), include_zero=True).collect()}
    import math

    n, avgdl = 4, 9 / 4
    raw = {t: math.log(n - d + 0.5) - math.log(d + 0.5) for t, d in {"a": 2, "b": 1, "c": 2, "d": 1}.items()}
    want = 2 * raw["b"] * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 3 / avgdl))
    assert got[1] == pytest.approx(want)
    assert got[2] == got[3] == got[4] == 0


def test_rrf_depends_on_ranks_only(spark):
    v = spark.createDataFrame([(0, 1, 9.0, 1), (0, 2, 8.0, 2)], "query_id int, doc_id int, score double, rank int")
    b = spark.createDataFrame([(0, 2, 5.0, 1), (0, 3, 1.0, 2)], "query_id int, doc_id int, score double, rank int")
    first = [tuple(r) for r in fusion.rrf(v, b, 5).select("doc_id", "score", "rank").orderBy("rank").collect()]
    again = [tuple(r) for r in fusion.rrf(v.withColumn("score", F.col("score") ** 3), b, 5).select("doc_id", "score", "rank").orderBy("rank").collect()]
    assert first == again
    assert [x[0] for x in first] == [2, 1, 3]
    assert fusion.fuse("no such method", v, b, 5).count() == 3


def test_weighted_fusion_of_equal_scores(spark):
    v = spark.createDataFrame([(0, 1, 2.0, 1), (0, 2, 2.0, 2)], "query_id int, doc_id int, score double, rank int")
    assert {r.score for r in fusion.weighted(v, v, 5).collect()} == {1.0}


def test_auc_of_reversed_scores(spark):
    rng = random.Random(1)
    rows = spark.createDataFrame([(rng.randint(0, 1), rng.randint(0, 20) / 20) for _ in range(300)], "y int, score double")
    a = metrics.roc_auc(rows).first().roc_auc
    assert metrics.roc_auc(rows.withColumn("score", -F.col("score"))).first().roc_auc == pytest.approx(1 - a)
    data = [(r.y, r.score) for r in rows.collect()]
    p, n = [s for y, s in data if y], [s for y, s in data if not y]
    assert a == pytest.approx(sum((x > z) + 0.5 * (x == z) for x in p for z in n) / len(p) / len(n))
    one_class = spark.createDataFrame([(1, 0.5)], "y int, score double")
    assert metrics.roc_auc(one_class).first().roc_auc == 0
    assert metrics.roc_auc(one_class.where("false")).first().roc_auc == 0


@pytest.mark.parametrize(("t", "df", "p"), [(2.776, 4, 0.05), (12.706, 1, 0.05), (2.571, 5, 0.05), (2.228, 10, 0.05), (4.032, 5, 0.01), (0.0, 7, 1.0)])
def test_t_tails(spark, t, df, p):
    assert spark.range(1).select(metrics.t_two_sided(F.lit(t), F.lit(float(df)))).first()[0] == pytest.approx(p, abs=2e-4)


def test_split_is_exact(spark):
    rows = spark.range(1003).withColumn("c", (F.col("id") % 3 == 0).cast("int"))
    got = prep.split(rows, "id", 0.2, 7, "c").groupBy("c").agg(F.count_if("in_test").alias("t"), F.count("*").alias("n")).collect()
    assert all(r.t == int(r.n * 0.2 + 0.5) for r in got)
    assert prep.split(rows.where("false"), "id").count() == 0


def test_fit_on_training_rows_only(spark):
    rows = spark.createDataFrame([(1, 0.0), (2, 2.0), (3, 100.0)], "id int, x double")
    z = {r.id: r.x for r in prep.standardize(rows, ["x"], fit_on=rows.where("id < 3")).collect()}
    assert z == {1: -1.0, 2: 1.0, 3: 99.0}


def test_rules(spark):
    facts = spark.createDataFrame([(1, 20, 0, "LOW", "A"), (2, 70, 5, "HIGH", "B")], "fact_id int, age int, claims int, profile string, policy_type string")
    table = spark.createDataFrame([(1, 18, 25, None, "A", 0, True, 10, 200), (2, 65, None, None, None, None, False, 0, 90)], rules.RULE_SCHEMA)
    got = {r.fact_id: r for r in rules.evaluate(facts, table).collect()}
    assert got[1].approved and got[1].price == 180
    assert not got[2].approved and got[2].price == 90


def test_cache_and_resume(spark):
    asked = spark.createDataFrame([("a",), ("b",), ("b",)], "key string")
    cache = spark.createDataFrame([("a", [1.0])], "key string, v array<double>")
    parts = batch.split_cached(asked, cache, "key", "v")
    new = spark.createDataFrame([("b", [2.0])], "key string, v array<double>")
    assert sorted((r.key, r.v) for r in batch.reassembled(parts, new, "key", "v").collect()) == [("a", [1.0]), ("b", [2.0]), ("b", [2.0])]
    assert batch.to_do(asked, cache, "key").count() == 2


def test_models_and_calls(spark, tmp_path):
    rows = spark.range(200).select(((F.col("id") % 2) * 2.0 + F.rand(1)).alias("x"), F.rand(2).alias("z"), (F.col("id") % 2).cast("int").alias("label"))
    model = ml.train(rows, "rf", ["x", "z"], numTrees=5)
    assert ml.predict(model, rows, ["x", "z"]).where("pred = label").count() > 190
    assert ml.importances(model, ["x", "z"])[0][0] == "x"
    assert ml.load_or_train(str(tmp_path / "m"), lambda: model).stages
    assert ml.load_or_train(str(tmp_path / "m"), None).stages
    with pytest.raises(ValueError, match="unknown model"):
        ml.create_model("none")

    def broken(texts):
        raise RuntimeError("no service")

    got = spark.createDataFrame([("x",)], "t string").select(udf.generate(F.col("t"), broken).alias("a")).first().a
    assert got.error == "no service" and got.text is None
    calls = []

    def flaky(texts):
        calls.append(1)
        if len(calls) < 3:
            raise RuntimeError
        return texts

    assert udf.with_retries(flaky, delay=0)(["x"]) == ["x"]


def test_collections(spark, tmp_path):
    store = sinks.Collections(spark, str(tmp_path / "kb"))
    docs = spark.createDataFrame([("1", "x", None, [1.0]), ("2", "y", None, [])], "id string, content string, metadata map<string,string>, embedding array<float>")
    store.add(docs, "a")
    store.add(docs, "b", failed="zeros", dim=1)
    assert {r.collection: r.n for r in store.counts().collect()} == {"a": 1, "b": 2}
    store.drop("a")
    assert store.read("a").count() == 0 and store.read().count() == 2


def test_sources(spark, tmp_path):
    (tmp_path / "g.data").write_text("A11 6 A34 A43 1169 A65 A75 4 A93 A101 4 A121 67 A143 A152 2 A173 1 A192 A201 1\n")
    assert tables.read_german(spark, str(tmp_path / "g.data")).first()["credit_amount"] == 1169
    (tmp_path / "k.json").write_text('[{"content": "", "description": "d"}, {"content": null}, {"content": "c"}]')
    assert sorted(r.content for r in tables.read_knowledge(spark, str(tmp_path / "k.json")).collect()) == ["c", "d"]
    for name, body, n in (("b1", '{"customers": [{"x": 1}, {"x": 2}], "customer_ids": ["p", "q"]}', 2), ("b2", '{"x": 3}', 1), ("b3", '[{"x": 4}, {"x": 5}]', 2)):
        (tmp_path / name).write_text(body)
        assert tables.read_batch(spark, str(tmp_path / name), "struct<x:int>").count() == n
    assert tables.applicants(spark, 50).where("true_risk_level = 0 and credit_amount > 3000").count() == 0
    d = tables.Datasets()
    d.register("German", lambda: spark.range(1))
    assert d.load("GERMAN").count() == 1
    with pytest.raises(ValueError, match="unknown data set"):
        d.load("x")


def test_knn_orders_ties_by_id(spark):
    docs = spark.createDataFrame([(i, [1.0, 0.0], "a") for i in (5, 3, 9)] + [(1, [], "a")], "vec_id int, embedding array<float>, c string")
    q = spark.createDataFrame([(0, [2.0, 0.0])], "query_id int, embedding array<float>")
    assert [r.doc_id for r in vector.knn(docs, q, 2).orderBy("rank").collect()] == [3, 5]
    assert vector.knn(docs, q, 2, threshold=1.5).count() == 0


def test_stream_equals_batch(spark, data, tmp_path):
    rows = tables.table(spark, data, "events")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    seen = []
    stream = events.tumbling(events.read_stream(spark, str(tmp_path / "in"), rows.schema), "1 day", late="40 days")
    events.run_available(stream, str(tmp_path / "cp"), lambda df, _: seen.extend(tuple(r) for r in df.select("start", "event_type", "n").collect()), "update")
    last = {r[:2]: r[2] for r in seen}
    assert last == {(r.start, r.event_type): r.n for r in events.tumbling(rows).collect()}


def test_knowledge_is_whole(spark, data):
    from credalyt.queries.models import knowledge

    docs = spark.read.parquet(f"{data}/documents.parquet")
    got = {r.id: r.content for r in knowledge(spark, data).select("id", "content").collect()}
    assert got == {r.doc_id: r.text for r in docs.collect()}


def test_running_over_stretches(spark):
    from credalyt.operators.ordered import ranked, running

    rng = random.Random(2)
    rows = [(i, rng.choice([None, rng.random(), 0.5]), rng.randrange(9)) for i in range(900)]
    df = spark.createDataFrame(rows, "id long, score double, n long").groupBy("score").agg(F.sum("n").alias("n")).repartition(5)
    plain = sorted(((r.score, r.n) for r in df.collect()), key=lambda x: (x[0] is None, -(x[0] or 0)))
    total, want = 0, {}
    for score, n in plain:
        total += n
        want[score] = total
    assert {r.score: r.t for r in running(df, "score", {"t": "n"}, descending=True).collect()} == want
    names = spark.createDataFrame([(f"{chr(97 + i % 26)}{i}",) for i in range(300)], "v string")
    got = {r.v: r.k for r in ranked(names, "v", "k").collect()}
    assert [v for v, _ in sorted(got.items(), key=lambda x: x[1])] == sorted(got) and sorted(got.values()) == list(range(1, 301))
    assert ranked(names.where("false"), "v").count() == 0


def test_failed_embeddings_are_null(spark):
    def client(texts):
        if any("bad" in t for t in texts):
            raise ValueError("no")
        return [[float(len(t))] for t in texts]

    rows = spark.createDataFrame([("a",), ("bad",), ("ccc",), (None,)], "t string").coalesce(1)
    assert {r.t: r.e for r in rows.select("t", udf.embed(F.col("t"), client).alias("e")).collect()} == {"a": [1.0], "bad": None, "ccc": [3.0], None: [0.0]}


def test_nothing_is_overwritten(spark, tmp_path):
    path = str(tmp_path / "table")
    (tmp_path / "table").mkdir()
    (tmp_path / "table" / "part.parquet").write_text("half written")
    with pytest.raises(Exception):
        tables.scan_or_build(spark, path, lambda: spark.range(1)).count()
    assert (tmp_path / "table" / "part.parquet").read_text() == "half written"


def test_factorization_machine_learns_on_all_cores(spark, monkeypatch):
    from credalyt.operators import ml

    rows = spark.range(400).select((F.col("id") % 2).cast("int").alias("label"), F.array(F.rand(1), F.rand(2)).alias("v")).coalesce(1)
    seen, fit = [], ml.Pipeline.fit
    monkeypatch.setattr(ml.Pipeline, "fit", lambda self, df: seen.append(df) or fit(self, df))
    ml.train(rows, "fm", "v", maxIter=2)
    sizes = [r["count"] for r in seen[0].groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == spark.sparkContext.defaultParallelism and max(sizes) <= 2 * min(sizes)
    assert ml.dealt(rows, 20).rdd.getNumPartitions() == 20  # and no partition grows with the rows
