"""URL lists, vectors and the pipeline."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from credalyt.llm import ann, catalog, mixing, simhash, toxicity, urlfilter
from credalyt.llm.textkernel import utf8
from tests.compare import duck, same
from tests.llm.test_text import groups


def test_url_filter_sql(spark, data):
    same(catalog.op2_url_filter(spark, data), data, catalog.OP2_SQL)


def test_url_filter_cases(spark):
    entries = spark.createDataFrame(
        [("a", "block", "domain", "bad.org", "add", 10), ("a", "block", "domain", "bad.org", "remove", 20), ("a", "block", "domain", "bad.org", "add", 30), ("b", "block", "word", "casino", "add", 0), ("c", "allow", "prefix", "bad.org/ok/", "add", 0), ("d", "block", "domain", None, "add", 0)],
        "list_name string, verdict string, kind string, pattern string, action string, since long",
    )
    cases = [("http://x.BAD.org/p", 9, False), ("http://x.BAD.org/p", 10, True), ("http://bad.org", 20, False), ("https://u:p@bad.org:80/ok/a?x#y", 35, False), ("http://notbad.org/", 35, False), ("http://z.com/Casino-1", 5, True), (None, 5, False), ("::", 5, False), ("http://bad.org", None, False)]
    captures = spark.createDataFrame([(*c, "mine") for c in cases] * 2, "url string, fetched_at long, want boolean, lists string")
    for limit in (100, 0):
        got = urlfilter.evaluate(captures, entries, broadcast_rows=limit).collect()
        assert len(got) == 2 * len(cases) and all(r.blocked == r.want for r in got)
    assert urlfilter.evaluate(captures, entries.where("false")).where("blocked").count() == 0
    assert urlfilter.evaluate(captures.where("false"), entries).count() == 0


def brute(rows, k):
    out = {}
    for q, v in rows:
        if q % 20 == 0:
            s = sorted(((-float(np.dot(v, w)), i) for i, w in rows if i != q))[:k]
            out[q] = [i for _, i in s]
    return out


def test_ann_small(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(60)]
    good = [(i, v) for i, v in rows if any(v)]
    odd = [(100, None), (120, [0.0] * 4), (140, [float("nan"), 1.0, 1.0, 1.0]), (160, [None, 1.0, 1.0, 1.0]), (180, [1.0, 2.0]), (200, [float("inf"), 0.0, 0.0, 0.0]), (None, [1.0] * 4)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")
    def found(table, **how):
        got = {}
        for r in ann.search(table, F.col("id") % 20 == 0, **how).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.vec_id)
        return got

    assert found(df, k=5, target_recall=1.1) == brute(good, 5)  # the learned parts, all of them probed
    assert found(df, k=5, target_recall=1.1, parts=6) == brute(good, 5)
    some, want = found(df, k=5, parts=4), brute(good, 5)
    assert all(len(some[q]) == 5 for q in want) and sum(len({*some[q]} & {*want[q]}) for q in want) >= 0.6 * 5 * len(want)
    assert found(df.where("vec_id < 21 and vec_id >= 0"), k=20) == brute(good[:21], 20)
    clash = df.withColumns({"id": F.lit("x"), "v": F.lit(1), "part": F.lit(None), "score": F.lit("s")}).unionByName(df.withColumns({"id": F.lit("x"), "v": F.lit(1), "part": F.lit(None), "score": F.lit("s")}))
    assert found(clash, k=5, target_recall=1.1) == brute(good, 5)  # repeated rows are one
    assert ann.search(df.where("false"), F.col("id") % 20 == 0).count() == 0
    assert ann.search(df.where("vec_id = 20"), F.col("id") % 20 == 0).count() == 0


def test_ann_recall_and_blocks(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(2500, 16))
    x[:400] = x[0]  # one vector is very common
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    rows = ann.search(df, F.col("id") % 20 == 0, k=20, parts=8, block_rows=100, block_queries=10).collect()
    got = {}
    for r in rows:
        got.setdefault(r.query_id, {})[r.vec_id] = r.score
    hit = 0
    for q in range(0, 2500, 20):
        s = x @ x[q]
        s[q] = -np.inf
        top = np.lexsort((np.arange(2500), -s.round(12)))[:20]
        hit += len(set(top.tolist()) & set(got[q]))
        assert len(got[q]) == 20
    assert hit / (125 * 20) >= 0.9


def test_parts_are_balanced():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(800, 8))
    part = ann.balanced_parts(ann.neighbour_graph(x, 10), x, 8)
    assert np.bincount(part, minlength=8).max() <= np.ceil(800 / 8 * 1.05)


def test_pipeline(spark, data):
    """Each stage on what its predecessor kept, against a plain version of its decisions."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    machine = toxicity.train(docs, spark.read.parquet(f"{data}/labels.parquet"))
    rows = {r.doc_id: r for r in docs.collect()}
    scores = {i: machine.score(*toxicity.terms(*utf8(pa.array([r.text]))))[0] for i, r in rows.items()}
    out = stages["toxicity"](spark, docs, data)
    assert out.columns == columns
    kept = {r.doc_id for r in out.collect()}
    assert kept == {i for i, p in scores.items() if p < 0.5}

    docs = spark.createDataFrame(out.toArrow())
    out = stages["near_duplicates"](spark, docs, data)
    order = sorted(kept)
    assert {r.doc_id for r in out.collect()} == {order[k] for k in groups([rows[i].text for i in order])}

    docs = spark.createDataFrame(out.toArrow())
    kept = {r.doc_id for r in docs.collect()}
    out = stages["decontamination"](spark, docs, data)
    names, digest = duck(data, catalog.OP1_SQL)
    bad = {r[names.index("doc_id")] for r in digest if r[names.index("contaminated")]}
    assert {r.doc_id for r in out.collect()} == kept - bad and bad

    docs = spark.createDataFrame(out.toArrow())
    out = stages["mixing"](spark, docs, data)
    assert out.columns == columns
    mixed = {r.doc_id: r for r in mixing.mix(docs).collect()}
    times = Counter(r.doc_id for r in out.collect())
    assert all(abs(times[i] * r["size"] - r.taken) <= r["size"] / 2 and times[i] <= 3 for i, r in mixed.items())

    docs = spark.createDataFrame(out.toArrow())
    last = stages["sharding"](spark, docs, data)
    got = last.collect()
    assert last.columns[: len(columns)] == columns and Counter(r.doc_id for r in got) == times
    size = Counter(r.shard for r in got)
    assert max(size.values()) - min(size[k] for k in range(24)) <= 1 and len({(r.shard, r.slot) for r in got}) == len(got)
    assert sorted((r.doc_id, r.shard, r.slot) for r in corpus_pipeline.run(spark, data).collect()) == sorted((r.doc_id, r.shard, r.slot) for r in got)


def test_pipeline_stages_on_odd_rows(spark, data):
    """Null columns, empty and long texts, repeated rows, extra columns with clashing names, empty tables."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    schema = "doc_id long, text string, lang string, source string, n_chars long, key string, size string, fp string, shard string, score string, n_words string"
    more = ("k", "s", "f", "h", "c", "w")
    odd = [(1, "a b c d e f", "en", "x", 1, *more), (1, "a b c d e f", "en", "x", 1, *more), (2, None, None, None, None, *more), (None, "", None, None, None, *[None] * 6), (None, None, None, None, None, *more), (3, "long text " * 80_000, "en", "y", 2, *more), (4, "ä", "de", None, None, *more)]
    df = spark.createDataFrame(odd, schema)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, data)
        n = len(out.collect())
        assert n == {"toxicity": 7, "near_duplicates": 4, "decontamination": 7}.get(name, n), name
        assert set(out.columns) >= set(df.columns)
        assert stage(spark, df.where("false"), data).count() == 0, name


def test_unknown_bits():
    with pytest.raises(ValueError, match="eight positional bytes"):
        simhash.fingerprint_links(None, None, 3)
