"""Index, blocked search, selection, summaries, pivots and rules against plain Python."""

import math
import os
import random
import re
from collections import Counter
from functools import reduce

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from credalyt.operators import matrix, neighbours, rules, selection, tfidf, vector
from credalyt.operators.bm25index import Index
from credalyt.operators.pieces import PIECE_TOKENS, pieces
from credalyt.queries import retrieval
from tests.compare import same


def plan(df):
    return df._jdf.queryExecution().toString()


# ---- BM25


def bm25(docs, queries, variant, k1=1.5, b=0.75):
    """All scores, by collection."""
    words = {i: (c, re.findall(r"\w+", (t or "").lower())) for i, t, c in docs}
    out = {}
    for c in {c for c, _ in words.values()}:
        own = {i: w for i, (x, w) in words.items() if x == c}
        n, avgdl = len(own), sum(map(len, own.values())) / len(own)
        df = Counter(t for w in own.values() for t in set(w))
        raw = {t: math.log(n - d + 0.5) - math.log(d + 0.5) if variant == "okapi" else math.log((n - d + 0.5) / (d + 0.5) + 1) for t, d in df.items()}
        mean = sum(raw.values()) / len(raw) if raw else 0
        idf = {t: mean / 4 if variant == "okapi" and w < 0 else w for t, w in raw.items()}
        for q, text in queries:
            for i, w in own.items():
                tf, s, hit = Counter(w), 0.0, False
                for t in re.findall(r"\w+", (text or "").lower()):
                    if tf[t]:
                        hit, s = True, s + idf[t] * tf[t] * (k1 + 1) / (tf[t] + k1 * (1 - b + b * len(w) / avgdl))
                if hit:
                    out[q, c, i] = round(s, 8)
    return out


def best(scores, k, unit):
    out = {}
    for (q, c, i), s in scores.items():
        out.setdefault((q, c) if unit else q, []).append((-s, i))
    return {u: [i for _, i in sorted(x)[:k]] for u, x in out.items()}


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    docs = [(i, " ".join(rng.choices(vocabulary, weights, k=rng.choice([3, 10, 40, 200]))), rng.choice("abc")) for i in range(400)]
    docs += [(1000 + i, "w1 w2 w250 w251", "a") for i in range(30)] + [(2000, "", "a"), (2001, None, "b"), (2002, "w0 " * 5000, "c")]
    queries = [(q, " ".join(rng.choices(vocabulary, k=6))) for q in range(15)] + [(50, "w250 w251 w251 nowhere"), (51, "nowhere"), (52, None), (53, "w0 w1 w2")]
    return docs, queries


@pytest.mark.parametrize("variant", ["okapi", "smooth"])
@pytest.mark.parametrize("by_collection", [False, True])
def test_pruned_search_is_the_full_search(spark, corpus, variant, by_collection):
    docs, queries = corpus
    d = spark.createDataFrame(docs, "doc_id int, text string, c string").repartition(3)
    q = spark.createDataFrame(queries, "query_id int, text string")
    index = Index.build(d, collection="c" if by_collection else None, block_docs=4)
    want = best(bm25([(i, t, c if by_collection else "") for i, t, c in docs], queries, variant), 7, by_collection)
    for pairs in (500_000, 20):
        hits, took = index.search(q, 7, variant, by_collection=by_collection, slice_pairs=pairs)
        got = {}
        for r in hits.orderBy("query_id", "collection", "rank").collect():
            got.setdefault((r.query_id, r.collection) if by_collection else r.query_id, []).append(r.doc_id)
        assert got == want
        row = took.agg(F.sum("blocks").alias("all"), F.sum("blocks_read").alias("read")).first()
        assert row.read < row.all
    again = Index.open(spark, index.folder)
    assert again.search(q, 7, variant, by_collection=by_collection)[0].count() == sum(map(len, want.values()))


def test_index_of_texts_as_ids_and_of_nothing(spark):
    d = spark.createDataFrame([("b", "x y"), ("a", "x y"), ("é", "x"), (None, "z")], "doc_id string, text string")
    q = spark.createDataFrame([(0, "y z")], "query_id int, text string")
    hits = Index.build(d).search(q, 2)[0].orderBy("rank").collect()
    assert [r.doc_id for r in hits] == [None, "a"]
    assert Index.build(d.where("false")).search(q, 2)[0].count() == 0
    assert Index.build(d).search(q.where("false"), 2)[0].count() == 0


def test_texts_are_read_once(spark, corpus):
    d = spark.createDataFrame(corpus[0], "doc_id int, text string, c string")
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    index = Index.build(d.mapInArrow(count, d.schema).withColumn("text", F.col("text")))
    index.search(spark.createDataFrame(corpus[1], "query_id int, text string"), 5)[0].count()
    assert seen.value <= 2 * len(corpus[0])  # the texts, and the count of documents


def test_pieces_hold_few_tokens():
    sizes = [0, 3, None, 9, 1, 1, 1, 4, 0]
    batch = pa.record_batch({"id": list(range(9)), "tokens": pa.array([None if n is None else ["w"] * n for n in sizes], pa.list_(pa.string()))})
    parts = list(pieces(iter([batch, batch.slice(0, 0), batch.slice(4)]), most=4))
    assert [i for p in parts for i in p["id"].to_pylist()] == [*range(9), *range(4, 9)]
    assert all(p.num_rows == 1 or len(p["tokens"].flatten()) <= 4 for p in parts) and all(p.num_rows for p in parts)


def test_vocabulary_is_counted_in_pieces(monkeypatch):
    seen, grams = [], tfidf.grams
    monkeypatch.setattr(tfidf, "grams", lambda tokens, *more: seen.append(len(tokens.flatten())) or grams(tokens, *more))
    batch = pa.record_batch({"tokens": [["ab", "cd"] * (PIECE_TOKENS // 8)] * 10})
    found = pa.Table.from_batches(tfidf._summaries((1, 2), 100)(iter([batch]))).to_pylist()
    n = 10 * PIECE_TOKENS // 8
    assert {r["term"]: r["n"] for r in found} == {"ab": n, "cd": n, "ab cd": n, "cd ab": n - 10, None: 0}
    assert max(seen) <= PIECE_TOKENS and sum(seen) == 2 * n


def test_long_texts_are_packed_in_pieces(spark):
    text = "w " * (PIECE_TOKENS // 2 + 1)
    index = Index.build(spark.createDataFrame([(i, text) for i in range(3)], "doc_id int, text string").coalesce(1))
    assert index.entries.select("block").distinct().count() == 3  # two of them have more tokens than a piece
    hits = index.search(spark.createDataFrame([(0, "w")], "query_id int, text string"), 2, "smooth")[0].orderBy("rank").collect()
    assert [r.doc_id for r in hits] == [0, 1]


@pytest.mark.parametrize("name", ["hybrid_rrf", "fusion_by_text", "weighted_fusion"])
def test_fusion_over_an_index_of_pieces(spark, data, tmp_path, name):
    for t in os.listdir(data):
        if t != "documents.parquet":
            os.symlink(f"{data}/{t}", tmp_path / t)
    long = f"repeat('the and ', {PIECE_TOKENS // 4} + 1000 * doc_id::INT)"
    duckdb.sql(f"COPY (SELECT * REPLACE (CASE WHEN doc_id IN (1, 2, 3) THEN {long} ELSE text END AS text) FROM '{data}/documents.parquet') TO '{tmp_path}/documents.parquet'")
    same(retrieval.QUERIES[name](spark, str(tmp_path)), tmp_path, retrieval.ORACLES[name])
    entries = retrieval._index(spark, str(tmp_path)).entries.where("term = 'the'").select("block", F.explode("ids").alias("id"))
    assert entries.where("id in (1, 2, 3)").select("block").distinct().count() == 3  # alike in length, but more tokens than a piece


def test_scores_are_summed_in_their_blocks(spark, corpus):
    d = spark.createDataFrame(corpus[0], "doc_id int, text string, c string")
    scores = Index.build(d, collection="c").scores(spark.createDataFrame(corpus[1], "query_id int, text string"), "smooth")
    moved = [x for x in plan(scores).split("== Physical Plan ==")[1].splitlines() if "Exchange hashpartitioning" in x]
    assert moved and not any("query_id" in x.split("Exchange")[1] for x in moved)  # packed entries only
    assert {(r.query_id, r.collection, r.doc_id): round(r.score, 8) for r in scores.collect()} == pytest.approx(bm25(*corpus, "smooth"))


# ---- vectors


def test_knn_against_plain(spark):
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(500, 6)), 1)
    x[100:140] = x[100]
    x[140] = 0
    rows = [(i, v.tolist(), int(i % 3)) for i, v in enumerate(x)]
    odd = [(900, None, 0), (901, [], 1), (902, [1.0] * 5, 1), (903, [None] * 6, 1), (904, [float("nan")] * 6, 1)]
    d = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int").repartition(4)
    q = spark.createDataFrame([(100 + i, x[i * 20].tolist()) for i in range(20)], "query_id long, embedding array<double>")

    def score(a, b, metric):
        if metric == "l2":
            return 1 / (1 + math.sqrt(sum((s - t) ** 2 for s, t in zip(a, b))))
        dot = sum(s * t for s, t in zip(a, b))
        n = math.sqrt(sum(s * s for s in a)) * math.sqrt(sum(t * t for t in b))
        return dot if metric == "dot" else dot / n if n else 0.0

    for metric in ("cosine", "dot", "l2"):
        for per in (None, "label"):
            want = {}
            for r in q.collect():
                for i, v, label in rows:
                    want.setdefault((r.query_id, label if per else None), []).append((-score(r.embedding, v, metric), i))
            for numbers in (4_000_000, 30):
                got = {}
                for r in matrix.knn(d, q, 9, metric, per, numbers=numbers).orderBy("query_id", "rank").collect():
                    got.setdefault((r.query_id, r.label if per else None), []).append((r.doc_id, round(r.score, 12)))
                assert got == {k: [(i, round(-s, 12)) for s, i in sorted(v)[:9]] for k, v in want.items()}
    text = plan(vector.knn(d, q, 5))
    assert "NestedLoop" not in text and "Cartesian" not in text
    assert vector.knn(d.where("false"), q, 5).count() == 0 == vector.knn(d, q.where("false"), 5).count()
    named = d.withColumn("vec_id", F.concat(F.lit("é"), F.col("vec_id").cast("string")))
    assert [r.doc_id for r in vector.knn(named, q.limit(1), 3, "l2").orderBy("rank").collect()][0].startswith("é")


def test_products(spark):
    x = np.arange(40.0).reshape(10, 4)
    b = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "j int, w array<float>")
    a = b.where("j % 3 = 0").toDF("i", "v")
    for numbers in (4_000_000, 5):
        got = {(r.i, r.j): r.s for r in matrix.products(a, b, numbers).collect()}
        assert got == {(i, j): float(x[i] @ x[j]) for i in range(0, 10, 3) for j in range(10)}


def test_products_are_dealt_to_tasks(spark, monkeypatch):
    monkeypatch.setattr(matrix, "CELLS", 50)
    monkeypatch.setattr(matrix, "TASK_PRODUCTS", 100, raising=False)
    x = np.arange(400.0).reshape(100, 4)
    b = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "j int, w array<float>").coalesce(1)
    got = matrix.products(b.where("j % 10 = 0").toDF("i", "v"), b).withColumn("task", F.spark_partition_id()).collect()
    assert {(r.i, r.j): r.s for r in got} == {(i, j): float(x[i] @ x[j]) for i in range(0, 100, 10) for j in range(100)}
    sizes = Counter(r.task for r in got).values()
    assert len(got) == 1000 and len(sizes) == 10 and max(sizes) <= 2 * min(sizes)


def _rounded(q, x, digits):
    """As SQL: the sum in the order of the components, halves away from zero."""
    total = 0.0
    for a, b in zip(q, x):
        total += float(a) * float(b)
    y = total * 10.0**digits
    return math.copysign(math.floor(abs(y)) + (abs(y) - math.floor(abs(y)) >= 0.5), y) / 10.0**digits + 0.0


@pytest.mark.parametrize("case", ["unit", "halves", "large", "huge"])
def test_rounded_products(spark, case):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(90, 8))
    x = {"unit": x / np.linalg.norm(x, axis=1)[:, None], "halves": np.round(x * 4) / 4 + 0.0, "large": x * 1e4, "huge": x * 1e9}[case]
    digits = 1 if case == "halves" else 6
    b = spark.createDataFrame([(f"é{i}", v.tolist()) for i, v in enumerate(x)], "j string, w array<double>").coalesce(1)
    a = b.where("j like '%7'").toDF("i", "v")
    want = {(f"é{i}", f"é{j}"): _rounded(x[j], x[i], digits) for i in range(7, 90, 10) for j in range(90)}
    for numbers in (4_000_000, 30):  # one slice, some
        rows = matrix.products(a, b, numbers, digits).collect()
        assert len(rows) == len(want) and {(r.i, r.j): r.s for r in rows} == want
    assert matrix.products(a.where("false"), b, digits=6).count() == 0 == matrix.products(a, b.where("false"), digits=6).count()


def test_rounded_products_too_large_for_a_number():
    x = np.random.default_rng(3).normal(size=(9, 8))
    for odd, finite in ((1e150, True), (1e200, False)):
        with np.errstate(all="ignore"):
            got = list(matrix.by_size(x[:3] * odd, x * odd, 6))
        row, place, s = (np.concatenate(c) for c in zip(*got))
        assert len(set(zip(row.tolist(), place.tolist()))) == len(s) == 27 and np.isfinite(s).all() == np.isfinite(s).any() == finite
        assert not finite or np.allclose(s, np.einsum("nd,nd->n", x[row] * odd, x[place] * odd), rtol=1e-9)


def test_equal_similarities_stand_together(spark, data):
    """Every pair is a row, so the bytes of a row are what the query needs of the disk (8.65 when rows came vector by vector)."""
    rows = retrieval.matrix_similarity(spark, data).withColumn("task", F.spark_partition_id()).collect()
    for task in {r.task for r in rows}:
        s = [r.s for r in rows if r.task == task]
        assert sum(a != b for a, b in zip(s, s[1:])) + 1 == len(set(s))


def test_bytes_of_a_pair(spark, tmp_path):
    x = np.random.default_rng(4).normal(size=(8_000, 64))
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    pq.write_table(pa.table({"vec_id": np.arange(8_000), "embedding": list(x), "label": np.zeros(8_000, np.int32)}), tmp_path / "embeddings.parquet")
    retrieval.matrix_similarity(spark, str(tmp_path)).coalesce(1).write.parquet(out := str(tmp_path / "out"))
    assert spark.read.parquet(out).count() == 3_200_000
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 6.5 * 3_200_000


@pytest.mark.parametrize("pivots", [None, 1, 7])
def test_neighbours_against_plain(spark, pivots):
    rng = np.random.default_rng(6)
    x = np.round(np.concatenate([rng.normal(size=(150, 3)), rng.normal(size=(100, 3)) + 20, rng.normal(size=(60, 3)) * 0.1 - 30]), 1)
    x[40:70] = x[40]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(900, None), (901, [1.0]), (902, [float("inf")] * 3), (None, [0.0] * 3)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").repartition(3)
    out, took = neighbours.neighbours(df, "vec_id", "embedding", 4, pivots=pivots, block=40)
    got = {}
    for r in out.orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append((round(r.d, 9), r.neighbour))

    def distance(v, w):
        return math.sqrt(reduce(lambda s, p: s + (p[0] - p[1]) * (p[0] - p[1]), zip(v, w), 0.0))  # sum() would compensate

    want = {i: sorted((distance(v, w), j) for j, w in rows if i != j)[:4] for i, v in rows}
    assert got == {i: [(round(s, 9), j) for s, j in w] for i, w in want.items()}
    r = took.first()
    assert r.vectors == len({tuple(v) for _, v in rows}) and r.compared <= r.vectors**2
    if pivots is None:
        assert r.compared < 0.6 * r.vectors**2
    assert neighbours.neighbours(df.where("false"), "vec_id", "embedding")[0].count() == 0
    assert neighbours.neighbours(df.where("vec_id = 3"), "vec_id", "embedding")[0].count() == 0


# ---- selection and summaries


@pytest.mark.parametrize("few", [4096, 3])
def test_quantiles(spark, few):
    rng = random.Random(2)
    columns = {
        "normal": [rng.gauss(0, 1) for _ in range(3000)],
        "equal": [5.0] * 3000,
        "two": [1.0] * 1500 + [2.0] * 1500,
        "wild": [10.0 ** rng.randint(-300, 300) * rng.choice([-1, 1]) for _ in range(3000)],
        "few": [None] * 2990 + [float(i) for i in range(9)] + [float("nan")],
        "steps": [float(rng.randrange(4)) for _ in range(3000)],
        "none": [None] * 3000,
    }
    df = spark.createDataFrame(list(zip(*columns.values())), ", ".join(f"{c} double" for c in columns)).repartition(4)
    qs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = selection.quantiles(df, {c: qs for c in columns}, few=few)
    for c, values in columns.items():
        known = [v for v in values if v is not None and v == v]
        want = np.quantile(known, qs, method="linear") if known else [None] * len(qs)
        assert got[c] == [pytest.approx(w, rel=1e-9) if w is not None else None for w in want], c


@pytest.mark.parametrize(("counters", "candidates"), [(200_000, None), (30, 12), (5, 12)])
def test_vocabulary_is_exact(spark, counters, candidates):
    rng = random.Random(8)
    vocabulary, weights = [f"w{i:03d}" for i in range(200)], [1 / (i + 2) for i in range(200)]
    docs = [(i, " ".join(["every", *rng.choices(vocabulary, weights, k=rng.randrange(1, 40)), "x"])) for i in range(150)] + [(900, None), (901, "a"), (902, "")]
    df = spark.createDataFrame(docs, "doc_id int, text string").repartition(4)
    words = {i: [w for w in re.findall(r"\w+", (t or "").lower()) if len(w) >= 2] for i, t in docs}
    terms = {i: Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])]) for i, w in words.items()}
    total, df_ = Counter(), Counter()
    for c in terms.values():
        total.update(c)
        df_.update(c.keys())
    chosen = [t for t in sorted(total, key=lambda t: (-total[t], t)) if df_[t] <= 0.95 * len(docs)][:12]
    idf = {t: math.log((1 + len(docs)) / (1 + df_[t])) + 1 for t in chosen}
    want = {}
    for i, c in terms.items():
        w = {t: c[t] * idf[t] for t in chosen if c[t]}
        n = math.sqrt(sum(x * x for x in w.values()))
        want.update({(i, t): x / n for t, x in w.items()})
    got = {(r.doc_id, r.term): r.weight for r in tfidf.tfidf(df, max_features=12, counters=counters, candidates=candidates).collect()}
    assert got == {k: pytest.approx(v) for k, v in want.items()}
    assert tfidf.tfidf(df.where("false")).count() == 0


# ---- rules


def test_rules_against_plain(spark):
    rng = random.Random(9)
    some = lambda *v: rng.choice([None, *v])
    table = []
    for i in range(300):
        lo, hi = some(*range(-5, 90)), some(*range(-5, 90))
        if lo is not None and hi is not None and rng.random() < 0.9:
            lo, hi = min(lo, hi), max(lo, hi)
        table.append((i, lo, hi, some("LOW", "MED", "HIGH"), some("A", "B"), some(0, 1, 2, 5), some(True, False), rng.randrange(3), some(100, 200)))
    facts = [(i, some(*range(-20, 130)), some(*range(-1, 9)), some("LOW", "MED", "HIGH", "NEW"), some("A", "B", "C")) for i in range(300)]
    f = spark.createDataFrame(facts, "fact_id int, age int, claims int, profile string, policy_type string")
    schema = rules.RULE_SCHEMA

    def met(fact, rule):
        _, age, claims, profile, kind = fact
        _, lo, hi, p, t, most, *_ = rule
        return all([lo is None or age is not None and age >= lo, hi is None or age is not None and age <= hi, p is None or p == profile, t is None or t == kind, most is None or claims is not None and claims <= most])

    got = {r.fact_id: r for r in rules.evaluate(f, spark.createDataFrame(table, schema)).collect()}
    for fact in facts:
        hits = [r for r in table if met(fact, r)]
        r = got[fact[0]]
        assert r.rule_ids == [h[0] for h in hits]
        assert r.discount == sum(h[7] for h in hits)
        assert r.approved == (any(h[6] for h in hits) and not any(h[6] is False for h in hits))
        assert r.base_price == next((h[8] for h in hits if h[8] is not None), 0)
    empty = rules.evaluate(f, spark.createDataFrame([], schema)).collect()
    assert len(empty) == 300 and all(r.rule_ids == [] and not r.approved for r in empty)
    assert rules.evaluate(f.where("false"), spark.createDataFrame(table, schema)).count() == 0


def test_many_rules_without_a_nested_loop(spark):
    """100,000 rules, each for one or a few ages."""
    r = spark.range(100_000).selectExpr("CAST(id AS INT) AS rule_id", "CAST(id AS INT) AS age_min", "CAST(id + id % 7 AS INT) AS age_max", "CAST(NULL AS STRING) AS profile", "CASE WHEN id % 2 = 0 THEN 'A' END AS policy_type", "CAST(id % 3 AS INT) AS claims_max", "true AS approve", "1 AS discount", "CAST(id AS INT) AS base_price")
    f = spark.range(2000).selectExpr("CAST(id AS INT) AS fact_id", "CAST(id * 50 AS INT) AS age", "CAST(id % 3 AS INT) AS claims", "'LOW' AS profile", "CASE WHEN id % 2 = 0 THEN 'A' ELSE 'B' END AS policy_type")
    out = rules.evaluate(f, r)
    assert "NestedLoop" not in plan(out) and "Cartesian" not in plan(out)
    got = {x.fact_id: x.rule_ids for x in out.collect()}
    for i in range(0, 2000, 97):
        age = i * 50
        assert got[i] == [x for x in range(max(0, age - 7), min(age, 99_999) + 1) if x <= age <= x + x % 7 and (x % 2 == 1 or i % 2 == 0) and i % 3 <= x % 3]


def test_customers_of_one_question_share_a_search(spark, monkeypatch):
    from credalyt.operators import udf
    from credalyt.plans import retrieval
    from credalyt.sources.tables import applicants

    columns = ["duration", "purpose", "credit_amount", "age"]
    docs = spark.createDataFrame([(i, f"购买新车 {i} 教育 短期贷款 " + "长" * (i * 300), c) for i in range(12) for c in ("a", "b")], "id long, content string, collection string")
    docs = docs.withColumns({"metadata": F.expr("map('source', 's')"), "embedding": udf.embed(F.col("content"), udf.HashingEmbedder())})
    people = applicants(spark, 60).withColumnRenamed("customer_id", "query_id").withColumnRenamed("true_risk_level", "true_level").cache()
    people = people.withColumn("purpose", F.when(people.age % 2 == 0, "A40").otherwise("A46"))
    knn, search, asked = vector.knn, Index.search, []
    monkeypatch.setattr(vector, "knn", lambda docs, queries, *a, **b: asked.append(queries.count()) or knn(docs, queries, *a, **b))
    monkeypatch.setattr(Index, "search", lambda self, queries, *a, **b: asked.append(queries.count()) or search(self, queries, *a, **b))
    found = retrieval.ablation(people, docs, columns, udf.HashingEmbedder(), udf.EchoGenerator()).collect()
    texts = people.select(retrieval.decode.build_query(columns)).distinct().count()
    assert asked == [texts, texts] and texts < 60  # one search a side, whatever the customers and variants
    # the same as with a search and a context for every customer
    queries = people.select("query_id", retrieval.decode.build_query(columns).alias("text")).withColumn("embedding", udf.embed(F.col("text"), udf.HashingEmbedder()))
    for c in retrieval.ABLATION:
        hits = retrieval.retrieve(docs, queries, c) if c.use_retrieval else None
        each = retrieval.prompts(people, hits, columns, c).select("query_id", F.length("prompt").alias("n"), udf.generate(F.col("prompt"), udf.EchoGenerator()).alias("a"))
        want = {(r.query_id, int(r.score)) for r in each.select("query_id", F.regexp_extract("a.text", "风险评分：([0-9]+)", 1).alias("score")).collect()}
        assert {(r.query_id, r.score) for r in found if r.config == c.name} == want
        assert len(want) == 60


def test_embeddings_by_parts_in_pieces(monkeypatch):
    import hashlib

    from credalyt.operators import udf

    def plain(t: str) -> list[float]:
        v = np.zeros(64)
        for n in (2, 3):
            for part, times in Counter(t.lower()[i : i + n] for i in range(len(t.lower()) - n + 1)).items():
                h = int.from_bytes(hashlib.blake2b(part.encode(), digest_size=8).digest(), "little")
                v[h % 64] += times if h >> 63 else -times
        return (v / np.linalg.norm(v) if np.linalg.norm(v) else v).tolist()

    calls = []
    hashed = udf._part_hash
    monkeypatch.setattr(udf, "_part_hash", lambda code, n: calls.append(code) or hashed(code, n))
    texts = ["", "a", "ab", "İstanbul ẞ 😀😀😀", "\0\0a\0\0", "贷款目的: 购买新车"] + ["abc" * 100] * 50
    assert udf.HashingEmbedder()(texts) == [plain(t) for t in texts]
    assert len(calls) < 100  # a part is hashed once, however many texts have it
    monkeypatch.setattr(udf, "PIECE_CHARACTERS", 10)
    assert udf.HashingEmbedder()(texts) == [plain(t) for t in texts]
