"""Operators on texts against plain Python, with nulls, ties, repeated rows, odd columns and empty tables."""

import binascii
import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from credalyt.llm import catalog, decontaminate, langid, linededup, mixing, setlinks, sharding, simhash, suffixdedup, toxicity
from credalyt.llm.textkernel import utf8
from tests.compare import same

LOWER = {i: i + 32 for i in range(65, 91)}
SCHEMA = "doc_id long, text string, source string"


def words(rng, n, size=60):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    base = [words(rng, n) for n in (0, 1, 2, 3, 40, 200, 3000)]
    passage = words(rng, 70, 4000)
    rows = [(i, t, f"s{i % 3}") for i, t in enumerate(base)]
    rows += [(10 + i, f"{words(rng, 30)}\n{passage}\n{words(rng, 20)}", "s0") for i in range(8)]
    rows += [(30 + i, base[5] if i % 2 else base[5].replace("w7 ", "w8 ", 1), "s1") for i in range(6)]
    rows += [(50, None, None), (51, "", "s2"), (52, "ÄÖ ß é 你好 " * 40, None), (53, "aaaa" * 100, "s2"), (7, passage, "s9"), (7, passage, "s9"), (None, passage, "s9"), (None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def plain(docs):
    return [tuple(r) for r in docs.collect()]


def test_simhash(spark, docs, plain):
    def fp(t):
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").translate(LOWER).encode())
        s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))

    want, fps = {}, [(d, fp(t)) for d, t, _ in plain]
    todo = {f for _, f in fps}
    while todo:
        group, edge = set(), {min(todo)}
        while edge:
            group |= edge
            edge = {f for f in todo - group if any(bin(f ^ g).count("1") <= 2 for g in edge)}
        todo -= group
        least = min((d for d, f in fps if f in group and d is not None), default=None)
        want.update({f: least for f in group})
    got = sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs, keep=["doc_id"]).collect())
    assert got == sorted((str(d), f"{f:016x}", want[f]) for d, f in fps)


def test_simhash_long_lists(spark):
    """Lists beyond the limit link the same fingerprints as short ones."""
    from credalyt.llm.components import components
    from credalyt.llm.scratch import Scratch

    rng = random.Random(3)
    centre = rng.getrandbits(63)
    values = {centre}
    while len(values) < 150:
        v = rng.choice(sorted(values))
        for _ in range(rng.randint(1, 4)):
            v ^= 1 << rng.randrange(63)
        values.add(v)
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    got = []
    for limit in (2, 1000):
        s = Scratch(spark, "test")
        got.append(sorted(tuple(r) for r in components(simhash.fingerprint_links(df, s, 2, limit), s).collect()))
    assert got[0] == got[1] and got[0]


def test_simhash_both_ways(spark):
    """Whole texts, more than a list's limit of near fingerprints: long lists and short ones give the same components; clashing names."""
    rng = random.Random(31)
    base, rows = words(rng, 1500, 5000).split(), []
    for i in range(60):
        c = list(base)
        for k in rng.sample(range(1500), i % 4):
            c[k] = f"x{rng.random()}"
        rows.append((i, " ".join(c), "mine", 1))
    rows += [(None, None, "mine", 1), (100, "", "mine", 1), (101, "long " * 200_000, "mine", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string, links long")
    got = []
    for limit in (1, 10**6):
        out = simhash.near_duplicates(df, list_limit=limit)
        assert out.columns == ["doc_id", "text", "fp", "fingerprint", "component_id", "links"]
        got.append(sorted((str(r.doc_id), r.fp, r.fingerprint, str(r.component_id), r.links) for r in out.collect()))
    assert got[0] == got[1] and len(got[0]) == 63
    assert max(Counter(x[3] for x in got[0]).values()) > 32
    assert {x[3] for x in got[0] if x[0] in ("None", "100")} == {"100"}


def test_mixing_clash_and_long(spark):
    df = spark.createDataFrame([(1, "w " * 300_000, "a", "t"), (2, "w", "a", "t"), (3, None, None, "t")], "doc_id long, text string, source string, target string")
    out = mixing.mix(df)
    assert out.columns == ["doc_id", "text", "source", *mixing.RESULT]
    assert {r.doc_id: r["size"] for r in out.collect()} == {1: 300_000, 2: 1, 3: 0}


def test_similar_documents(spark):
    rng = random.Random(8)
    rows, want, n = [], set(), 0
    for _ in range(25):
        t = words(rng, 300, 5000).split()
        want.add(n)
        for k in range(3):  # the first copy alters one word (similar), the last two thirds
            c = list(t)
            for i in rng.sample(range(300), (0, 2, 100)[k]):
                c[i] = f"x{rng.random()}"
            if k == 2:
                want.add(n)
            rows.append((n, " ".join(c), "s"))
            n += 1
    rows += [(n, None, None), (n + 1, "", None), (None, rows[0][1], None)]
    got = {r.doc_id for r in simhash.dissimilar(spark.createDataFrame(rows, SCHEMA)).collect()}
    # the row without id comes first, and so stands for its copies; null and empty texts are copies
    assert got == (want - {0}) | {None, n}


def test_suffix_dedup_long(spark):
    """A text of several chunks that repeats itself and another one; clashing names pass."""
    rng = random.Random(21)
    first = "".join(rng.choice("abcdefgh ") for _ in range(400_000))
    long = first + "é" * 150 + first[100_000:350_000] + "".join(rng.choice("xyz") for _ in range(50_000))
    df = spark.createDataFrame([(1, first[5000:5400], "g", 1), (2, long, "g", 2), (3, None, "g", 3)], "doc_id long, text string, gram string, n_bytes long")
    found = {r.doc_id: r for r in suffixdedup.repeated_substrings(df).collect()}
    assert [tuple(x) for x in found[2].removed_spans] == [(5000, 5400), (400_002, 400_300 + 250_000)]
    assert found[2].gram == "g" and found[2].n_bytes == len(long.encode()) and found[3].n_bytes == 0 and found[1].n_removed == 0


def test_suffix_dedup(spark, docs, plain):
    order = sorted(plain, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5((r[1] or "").encode()).hexdigest()))
    seen, want = set(), []
    for d, t, _ in order:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 99):
            if b[i : i + 100] in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(b[i : i + 100])
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        want.append((str(d), len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    found = suffixdedup.repeated_substrings(docs, keep=["doc_id"])
    got = [(str(r.doc_id), r.n_bytes, r.n_removed, len(r.removed_spans), r.kept_sha256) for r in found.collect()]
    assert sorted(got) == sorted(want)
    assert any(w[2] for w in want)


@pytest.mark.parametrize("min_lines", [1, 2, 3, 5])
def test_line_dedup(spark, min_lines):
    """Deleted lines, runs and texts against plain Python: odd blanks, null and shared ids, repeated rows, clashing names."""
    rng = random.Random(min_lines)
    pool = ["", " ", "\t\r", "short", "short \r", "l" * 60, *[f"line {i}" for i in range(9)]]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(12)))) for i in range(40)] + [(40, None), (41, "\n\n"), (42, "a\n" * 30 + "b"), (43, "b\n" + "a\n" * 20), (41, "line 1\nline 2\nline 3\nline 4\nline 5"), (None, "line 2\nline 3\nline 4\nline 5"), (None, None), (44, rows_text := "x\ny\nz\nx\ny\nq"), (44, rows_text)]
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5((r[1] or "").encode()).hexdigest()))
    seen, want = [set(), set()], []
    for d, t in order:
        q = [(i, x.strip(" \t\r\v\f")) for i, x in enumerate((t or "").split("\n"))]
        q, gone = [x for x in q if x[1]], set()
        for j in range(len(q)):
            g = tuple(x for _, x in q[j : j + min_lines])
            if len(g) == min_lines:
                if g in seen[0]:
                    gone |= set(range(j, j + min_lines))
                seen[0].add(g)
            if len(q[j][1]) >= 50 and q[j][1] in seen[1]:
                gone.add(j)
            seen[1].add(q[j][1])
        runs = [j for j in gone if j - 1 not in gone]
        longest = max((next(k for k in range(len(q) + 1) if j + k not in gone) for j in runs), default=0)
        cut = {i for j in gone for i in range(q[j][0], (q[j + 1][0] if j + 1 in gone else q[j][0]) + 1)}
        want.append((str(d), len(q), len(gone), len(runs), longest, "\n".join(x for i, x in enumerate((t or "").split("\n")) if i not in cut)))
    df = spark.createDataFrame([(*r, "mine") for r in rows], "doc_id long, text string, n_runs string").repartition(3)
    found = linededup.without_copies(df, min_lines=min_lines)
    assert found.columns == ["doc_id", "text", *linededup.RESULT]
    assert sorted((str(r.doc_id), r.n_lines, r.n_removed, r.n_runs, r.longest_run, r.kept_text) for r in found.collect()) == sorted(want)


def test_line_runs(spark, monkeypatch):
    """Maximal runs: their sources and lengths; classes with many places are joined alike."""
    from credalyt.llm.scratch import Scratch

    rng = random.Random(4)
    texts = ["\n".join(f"n{rng.randrange(3)}" for _ in range(40)) for _ in range(6)] + ["\n".join(f"u{i}" for i in range(50)), "\n".join(["v", *(f"u{i}" for i in range(7, 44)), "w"])]
    docs = spark.createDataFrame(list(enumerate(texts)), "key long, text string")
    got = []
    for hot in (1000, 1):
        monkeypatch.setattr(linededup, "HOT_PLACES", hot)
        scratch = Scratch(spark, "test")
        levels = linededup.line_classes(docs, "text", 8, scratch, 2)
        got.append(sorted(tuple(r) for r in linededup.maximal_runs(levels, 8, scratch, 2).collect()))
    assert got[0] == got[1]
    lines = [(k << 8 | j, t.split("\n")[j:]) for k, t in enumerate(texts) for j in range(len(t.split("\n")))]
    share = lambda x, y: next((i for i, (a, b) in enumerate(zip(x, y)) if a != b), min(len(x), len(y)))
    best = {}
    for n, (p, x) in enumerate(lines):
        lcp = [(share(x, y), q) for q, y in lines[:n]]
        level = max((1 << k for k in range(1, 7) if any(s >= 1 << k for s, _ in lcp)), default=0)
        if level:
            best[p] = next((q, s) for s, q in lcp if s >= level)
    assert got[0] == sorted((p, q, s) for p, (q, s) in best.items() if best.get(p - 1, (None,))[0] != q - 1)
    assert (7 << 8 | 1, 6 << 8 | 7, 37) in got[0]


def test_line_dedup_sql(spark, data):
    same(catalog.op4_line_dedup(spark, data), data, catalog.OP4_SQL)


def test_decontamination_sql(spark, data):
    same(catalog.op1_decontaminate(spark, data), data, catalog.OP1_SQL)


def test_decontamination_blocks(spark, docs, plain, monkeypatch):
    rng = random.Random(9)
    items = [(1, "W1 w2"), (2, None), (3, ""), (None, "w1"), (4, "w3"), (5, "no such words at all"), (1, "w5 w6"), (6, " ".join(plain[5][1].split()[20:60])), (7, words(rng, 13)), (None, "ä你好")]
    df = spark.createDataFrame(items, "item_id int, text string")
    split = lambda t: re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    want = []
    for d, t, _ in plain:
        w, hit, ids = split(t), set(), set()
        for i, x in items:
            v = split(x)
            for k in range(max(1, len(v) - 12) if v else 0):
                g = v[k : k + 13]
                for a in range(len(w) - len(g) + 1):
                    if w[a : a + len(g)] == g:
                        hit |= set(range(a, a + len(g)))
                        ids |= {str(i)} - {"None"}
        want.append((str(d), len(w), len(hit), sorted(ids)))
    for few, bits in ((decontaminate.FEW_PLACES, decontaminate.FILTER_BITS), (1, decontaminate.FILTER_BITS), (1, 6)):  # salted; a filter that passes all
        monkeypatch.setattr(decontaminate, "FILTER_BITS", bits)
        found = decontaminate.contamination(docs, df, keep=["doc_id"], few=few)
        assert sorted((str(r.doc_id), r.n_words, sum(x.end - x.start for x in r.hit_spans), r.item_ids) for r in found.collect()) == sorted(want)
    left = decontaminate.decontaminated(docs.withColumn("n_words", F.lit("mine")), df)
    assert left.columns == [*docs.columns, "n_words"] and {r.n_words for r in left.collect()} == {"mine"}
    assert decontaminate.contamination(docs, df.where("false")).where(decontaminate.contaminated()).count() == 0
    assert decontaminate.contamination(docs.where("false"), df).count() == 0
    long = spark.createDataFrame([(1, "x " * 600_000 + "no such words at all")], "doc_id long, text string")
    assert [(r.n_words, [tuple(x) for x in r.hit_spans]) for r in decontaminate.contamination(long, df).collect()] == [(600_005, [(600_000, 600_005)])]


def test_mixing_sql(spark, data):
    same(catalog.op6_mixing(spark, data), data, catalog.OP6_SQL)


def test_mixing_targets(spark, docs):
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count()
    by = {}
    for r in rows:
        assert r.taken <= 3 * r.size
        by.setdefault(r.source, []).append(r)
    assert sum(x[0].target for x in by.values()) == pytest.approx(sum(r.size for r in rows))
    for x in by.values():
        assert abs(sum(r.taken for r in x) - x[0].target) <= 1
    assert mixing.draws(docs).columns == docs.columns


def test_mixing_reruns(spark):
    """Rows without id or of one id, all of one size, in two orders: each text is taken alike."""
    rng = random.Random(6)
    rows = [(None if i % 2 else 7, words(rng, 10), "a" if i % 3 else None, i) for i in range(400)]
    rows += [(8, "same text", "a", i) for i in range(9)]
    got = []
    for seed in (1, 2):
        random.Random(seed).shuffle(rows)
        df = spark.createDataFrame(rows, SCHEMA + ", size long").repartition(5)
        got.append(sorted((r.doc_id is None, r.text, r.taken, r.first_position or -1) for r in mixing.mix(df).collect()))
        got.append(sorted(map(str, mixing.mix(df.withColumnRenamed("size", "n"), keep=["n"]).collect())))
        got.append(sorted(r.text for r in mixing.draws(df).collect()))
    assert got[:3] == got[3:]
    assert len({x[2] for x in got[0]}) > 1


def test_sharding(spark, docs):
    rows = sharding.shards(docs.withColumn("shard", F.lit("old")), n_shards=5, keep=["doc_id", "shard"]).collect()
    sizes = sorted(sum(r.shard == s for r in rows) for s in range(5))
    assert sum(sizes) == docs.count() and sizes[-1] - sizes[0] <= 1
    for s in range(5):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    plain = sorted(((str(r.doc_id), len((r.text or "").encode()) + 8, binascii.crc32((r.text or "").encode())) for r in docs.collect()))
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in rows) == plain
    whole = sharding.shards(docs, n_shards=5).collect()
    assert sorted((str(r.doc_id), r.size, r.shard, r.slot) for r in whole) == sorted((str(r.doc_id), r.size, r.shard, r.slot) for r in rows)
    long = docs.limit(1).select(F.lit(None).cast("long").alias("doc_id"), F.repeat(F.lit("é"), 3_000_000).alias("text"), "source")
    many = sharding.shards(long.unionByName(long).unionByName(docs), n_shards=3, block_rows=1).collect()
    assert [r.size for r in many if r.size > 10**6] == [6_000_008] * 2 and len({(r.shard, r.slot) for r in many}) == len(many) == docs.count() + 2


def test_sharding_brute_force(spark):
    """Shard and slot of every row against plain Python that draws from the same matrix."""
    rows = [(i, f"text {i % 37}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    spread = {s: {r.doc_id: r.h for r in df.select("doc_id", F.xxhash64(F.col("doc_id").cast("string"), (F.octet_length("text") + 8).cast("long"), F.crc32(F.col("text").cast("binary")), F.lit(sharding.SEED + s)).alias("h")).collect()} for s in range(3)}
    blocks = {}
    for i, _ in rows:
        blocks.setdefault(spread[0][i] % 256, []).append(i)
    matrix = sharding.communication_matrix([len(blocks.get(b, ())) for b in range(256)], [60] * 5, sharding.SEED)
    shards = {}
    for b, own in blocks.items():
        own.sort(key=lambda i: spread[1][i])
        at = 0
        for s, n in enumerate(matrix[b]):
            shards.setdefault(s, []).extend(own[at : at + n])
            at += n
    want = {i: (s, k) for s, own in shards.items() for k, i in enumerate(sorted(own, key=lambda i: spread[2][i] % (1 << 64)))}
    assert {r.doc_id: (r.shard, r.slot) for r in sharding.shards(df, n_shards=5).collect()} == want


def test_many_equal_rows_are_dealt_out(spark):
    """Half of the rows have no id and no text: they spread over all blocks, and layouts agree."""
    df = spark.range(20_000).select(F.col("id").cast("long").alias("doc_id"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    df = df.unionByName(spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text")))
    seen, deal = [], sharding.communication_matrix
    sharding.communication_matrix = lambda n, *a: seen.append(n) or deal(n, *a)
    try:
        every = [sharding.shards(df.repartition(p), keep=k).collect() for p, k in ((3, ["doc_id"]), (7, ["doc_id"]), (5, ["doc_id", "text"]))]
    finally:
        sharding.communication_matrix = deal
    got = [Counter((r.doc_id, r.shard) for r in rows) for rows in every]
    assert got[0] == got[1] == got[2] and all(max(n) < 300 and sum(n) == 40_000 for n in seen)
    assert all(len({(r.shard, r.slot) for r in rows}) == 40_000 and max(r.slot for r in rows) == 40_000 // 24 for rows in every)


def test_hypergeometric_law():
    rng = random.Random(2)
    draws = [sharding.hypergeometric(rng, 30, 70, 20) for _ in range(4000)]
    mean = sum(draws) / len(draws)
    assert abs(mean - 6) < 0.12
    assert abs(sum((x - mean) ** 2 for x in draws) / len(draws) - 20 * 0.3 * 0.7 * 80 / 99) < 0.35
    m = sharding.communication_matrix([5, 0, 17, 3], [7, 6, 6, 6], 1)
    assert [sum(r) for r in m] == [5, 0, 17, 3] and [sum(c) for c in zip(*m)] == [7, 6, 6, 6]


def test_language(spark, data):
    got = {r.doc_id: r for r in catalog.op7_langid(spark, data).collect()}
    truth = spark.read.parquet(f"{data}/documents.parquet").collect()
    assert all(got[r.doc_id].held_out == (binascii.crc32(str(r.doc_id).encode()) % 3 == 1) for r in truth)
    held = [r for r in truth if got[r.doc_id].held_out]
    assert sum(got[r.doc_id].lang_pred == r.lang for r in held) >= 0.95 * len(held)
    odd = spark.createDataFrame([(None, "x"), ("", "x"), ("12 !", "x"), ("a", None)], "text string, score string")
    known = langid.profiles(spark.createDataFrame([("the cat", "en"), ("der hund", "de")], "text string, lang string"))
    assert sorted(r.lang_pred for r in langid.predicted(odd, known).collect())[-3:] == ["und"] * 3
    assert {r.lang_pred for r in langid.predicted(odd, {}).collect()} == {"und"}


def test_language_brute_force(spark, monkeypatch):
    """Profiles, distances and predictions against plain Python, also of texts that are cut into pieces."""
    rng = random.Random(11)
    letters = {"aa": "abcdeé", "bb": "abxyzß", "cc": "你好吗abΣ"}
    text = lambda k, n: " ".join("".join(rng.choice(letters[k]) for _ in range(rng.randint(1, 6))) for _ in range(n))
    rows = [(text(k, rng.randint(1, 60)), k) for k in letters for _ in range(20)] + [("", "aa"), (None, "bb"), ("x1y_z", None)]

    def count(t):
        out = {}
        for word in re.findall(r"[^\W\d_]+", t.lower()):
            for n in (1, 2, 3):
                m = f"_{word}_"
                for i in range(len(m) - n + 1):
                    if m[i : i + n].strip("_"):
                        out[m[i : i + n]] = out.get(m[i : i + n], 0) + 1
        return out

    def top(c):
        return sorted(c, key=lambda g: (-c[g], [ord(x) for x in g]))[:25]

    known = {k: top(count(" ".join(t or "" for t, n in rows if n == k))) for k in letters}
    asked = [*(t for t, _ in rows), text("aa", 500) + " " + text("bb", 400), "é" * 40]
    want = []
    for t in asked:
        own = top(count(t or ""))
        if not own:
            want.append(("und", 0.0))
            continue
        far = {k: sum(abs(i - p.index(g)) if g in p else 25 for i, g in enumerate(own)) for k, p in known.items()}
        best = min(far, key=lambda k: (far[k], k))
        want.append((best, 1 - far[best] / (25 * len(own))))
    for piece in (langid.PIECE, 16):
        monkeypatch.setattr(langid, "PIECE", piece)
        found = langid.profiles(spark.createDataFrame(rows, "text string, lang string"), size=25)
        assert {k: [langid.gram_text(g) for g in p] for k, p in found.items()} == known
        ranker = langid.Ranker(found, 25)
        assert [ranker.of(t) for t in asked] == [(k, pytest.approx(x)) for k, x in want]
    out = langid.predicted(spark.createDataFrame([(t, i, 1.5) for i, t in enumerate(asked)] * 2, "text string, lang_pred long, score double"), found, size=25)
    assert out.columns == ["text", "lang_pred", "score"] and sorted(r.lang_pred for r in out.collect()) == sorted(k for k, _ in want * 2)
    assert langid.predicted(out.where("false"), found).count() == 0


def test_toxicity(spark):
    rng = random.Random(4)
    rows = []
    for i in range(2500):
        w = [f"w{rng.randrange(400)}" for _ in range(30)]
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        rows.append((i, " ".join(w + ["rude"] * insult + ["folk"] * group), int(insult and group)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(9000, None), (9001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (5000, None)], "doc_id long, toxic int")
    machine = toxicity.train(docs, labels)
    said = [toxicity.terms(*utf8(pa.array([t]))) for t in ("rude folk", "rude", "folk", "")]
    both, one, other, none = (machine.margin(*x)[0] for x in said)
    assert both - one - other + none > 0  # the pair tells more than its terms
    got = {r.doc_id: r for r in toxicity.scored(docs, machine).collect()}
    held = [(i, y) for i, _, y in rows if binascii.crc32(str(i).encode()) % 5 == 0]
    assert sum(got[i].predicted == y for i, y in held) >= 0.95 * len(held)
    assert got[9000].score == got[9001].score and 0 <= got[9000].score <= 1
    none = toxicity.train(docs, labels.where("false"))
    assert {r.score for r in toxicity.scored(docs, none).collect()} == {0.5}


def test_empty_tables(spark, docs):
    none = docs.where("false")
    assert simhash.near_duplicates(none).count() == 0
    assert simhash.dissimilar(none).count() == 0
    assert suffixdedup.repeated_substrings(none).count() == 0
    assert linededup.without_copies(none).count() == 0
    assert mixing.mix(none).count() == 0
    assert sharding.shards(none).count() == 0
    assert langid.profiles(none.withColumn("lang", F.lit("x"))) == {}


def groups(texts, shingle=5, similarity=0.8):
    """The first of each group of texts linked by the Jaccard similarity of their sets of shingles."""
    sets = []
    for t in texts:
        w = t.translate(LOWER).encode().split()
        sets.append({b" ".join(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))})
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            both = len(x & sets[j])
            if 5 * both >= 4 * (len(x) + len(sets[j]) - both):
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    return {top(i) for i in range(len(texts))}


def _left(spark, texts):
    return {r.doc_id for r in simhash.dissimilar(spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], SCHEMA).repartition(3)).collect()}


def test_similar_large_group(spark):
    """Hundreds of copies around the similarity: long lists lose no link."""
    rng = random.Random(12)
    base, texts = words(rng, 200, 5000).split(), []
    for _ in range(400):
        c = list(base)
        for i in rng.sample(range(200), rng.randint(2, 8)):
            c[i] = f"x{rng.randrange(10**9)}"
        texts.append(" ".join(c))
    want = groups(texts)
    assert 1 < len(want) < 400
    assert _left(spark, texts) == want


def test_similar_sets_not_counts(spark):
    """Repeats inside a text count once: boilerplate makes no copy, and more repeats no other text."""
    rng = random.Random(13)
    texts = []
    for _ in range(10):
        line = words(rng, 20, 5000)
        texts += [" ".join([line] * 30 + [words(rng, 100, 10**6)]) for _ in range(2)]
    for _ in range(10):
        line = words(rng, 32, 5000)
        texts += [" ".join([line] * k + [words(rng, 2, 5000)]) for k in (5, 4)]
    want = groups(texts)
    assert len(want) == 30
    assert _left(spark, texts) == want


def test_similar_short_texts(spark):
    """Pairs of exactly the similarity are found in short texts as in long ones."""
    rng = random.Random(14)
    texts = []
    for n in [8] * 40 + [16] * 40 + [304] * 10:  # 4 shingles of 5, 12 of 15, 300 of 375
        t = words(rng, n, 10**6)
        texts += [t, t + " " + words(rng, (n - 4) // 4, 10**6)]
    want = groups(texts)
    assert len(want) == 90
    assert _left(spark, texts) == want


def test_toxicity_exclusive_or():
    """Two terms of which neither tells alone: one without the other is the label."""
    rng = np.random.default_rng(16)
    n = 3000
    rude, folk = rng.random(n) < 0.5, rng.random(n) < 0.5
    y = (rude ^ folk).astype(float)
    rows = [np.unique(np.concatenate([10 + rng.integers(0, 400, 30), [1] * a, [2] * b])).astype(np.int64) for a, b in zip(rude.tolist(), folk.tolist())]
    slots, offs = np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    cut = 2000
    machine = toxicity.fit(slots[: offs[cut]], offs[: cut + 1], y[:cut], np.ones(cut), bits=10)
    assert (machine.v[1] != 0).all() and (machine.v[2] != 0).all()
    said = machine.score(slots[offs[cut] :], offs[cut:] - offs[cut]) >= 0.5
    assert (said == y[cut:]).mean() > 0.97


def test_toxicity_brute_force(monkeypatch):
    """Terms, margin and one step of learning against plain Python."""
    texts = ["Ärger über DICH, dummkopf dummkopf!", "", "x", "né café"]
    slots, offs = toxicity.terms(*utf8(pa.array(texts)))
    for i, t in enumerate(texts):
        w = set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower()))
        stems = {(k, x.encode()[:k]) for x in w for k in (4, 5, 6, 7) if len(x.encode()) > k}
        assert offs[i + 1] - offs[i] == len(w) + len(stems)
    rng = np.random.default_rng(1)
    m = toxicity.Machine(0.3, rng.normal(size=16), rng.normal(size=(16, 3)))
    slots, offs = np.array([1, 4, 7, 2, 15]), np.array([0, 3, 3, 5])
    for i in range(3):
        own = slots[offs[i] : offs[i + 1]]
        want = 0.3 + sum(m.w[k] for k in own) + sum(float(m.v[a] @ m.v[b]) for x, a in enumerate(own) for b in own[:x])
        assert m.margin(slots, offs)[i] == pytest.approx(want)
    monkeypatch.setattr(toxicity, "CHANCE", 0.0)
    y, weight = np.array([1.0, 0.0, 0.0]), np.array([0.5, 0.25, 0.25])
    got = toxicity.fit(slots, offs, y, weight, bits=4, rounds=1, least_rows=1, l1=0.0, l2=0.0, factors=2)
    p = 1 / (1 + np.exp(-np.log(0.5 / 0.5)))
    g = {k: sum(w * (p - t) for i, (t, w) in enumerate(zip(y, weight)) if k in slots[offs[i] : offs[i + 1]]) for k in set(slots.tolist())}
    first = {k: -x / np.sqrt(x * x + 1e-8) for k, x in g.items()}  # AdaGrad, the linear step; the second step moves on from it
    assert all(np.sign(got.w[k]) == np.sign(v) for k, v in first.items()) and got.bias != 0
    row = np.repeat(np.arange(3), np.diff(offs))
    names, at = np.unique(slots, return_inverse=True)
    e = np.array([0.5, -1.0, 2.0])
    ratio = toxicity.in_pairs(at, row, e, len(names), 3)
    both = np.zeros((5, 5))
    for i in range(3):
        for a in at[offs[i] : offs[i + 1]]:
            for b in at[offs[i] : offs[i + 1]]:
                both[a, b] += e[i] * (a != b)
    plain = (both**2).sum(1) / np.array([e[i] ** 2 * (offs[i + 1] - offs[i] - 1) for i in row[np.argsort(at)]])
    usual = np.array([np.mean([plain[b] for b in at[offs[i] : offs[i + 1]]]) for i in row[np.argsort(at)]])
    assert ratio == pytest.approx(plain / np.maximum(usual, 1), rel=1.0)


def test_toxicity_rare_label():
    """Insults of one text in twenty of a label of one in a hundred are learned."""
    rng = np.random.default_rng(15)
    y = (np.arange(10_000) % 100 == 0).astype(float)
    rows = [np.unique(np.concatenate([100 + rng.integers(0, 500, 20), np.flatnonzero(rng.random(60) < 0.05) if t else []])).astype(np.int64) for t in y]
    slots, offs = np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    machine = toxicity.fit(slots, offs, y, np.ones(len(y)), bits=10)
    said = machine.score(slots, offs) >= 0.5
    assert said[y == 1].mean() > 0.8 and said[y == 0].mean() < 0.01


def test_shingles_are_ordered_by_all_texts(spark):
    rng = random.Random(8)
    texts = [words(rng, 30, 3000) + (" a b c d e f" if i in (3, 5, 4090) else "") for i in range(300)] + [None, ""]
    place = setlinks.shingle_order(spark.createDataFrame([(t,) for t in texts], "text string").repartition(5), "text", 5)
    every = setlinks.bucket(setlinks.shingle_sets(*utf8(pa.array([t or "" for t in texts])), 5)[0])
    total = np.bincount(every, minlength=1 << setlinks.BUCKET_BITS)
    assert sorted(place) == list(range(len(total))) and (np.diff(total[np.argsort(place)]) >= 0).all()
    h, offs = setlinks.shingle_sets(*utf8(pa.array([texts[3]])), 5)
    first, _ = setlinks.prefixes(h, offs, place, 0.8)
    twice = set(setlinks.shingle_sets(*utf8(pa.array(["a b c d e f"])), 5)[0].tolist())
    assert len(first) == 7 and not twice & set(first.tolist())  # in two texts, so late in the order


def test_learning_takes_few_copies_of_the_terms(monkeypatch):
    import tracemalloc

    monkeypatch.setattr(toxicity, "BLOCK_TERMS", 1 << 14)
    rng, n = np.random.default_rng(4), 1500
    slots, offs = np.concatenate([np.sort(rng.choice(4096, 600, replace=False)) for _ in range(n)]).astype(np.int32), np.arange(n + 1) * 600
    y = (rng.random(n) < 0.5).astype(float)
    tracemalloc.start()
    toxicity.fit(slots, offs, y, np.ones(n), bits=12, rounds=1)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 24 * len(slots)  # it was 37 bytes a term
