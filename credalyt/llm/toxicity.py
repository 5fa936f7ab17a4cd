"""Toxicity by a factorization machine over hashed terms.

A text is the set of its terms, hashed into 2**bits slots: words
``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z and Latin-1 letters lowered, and the first 4, 5,
6 and 7 bytes of longer words, so that compounds of one stem are recognised.  The score is the sigmoid of

    bias + sum w_i + sum_{i<j} <v_i, v_j>,

so two terms can matter together (an insult with the mention of a group) where
neither does alone.  Both parts are learned by AdaGrad on the log loss, relative to the
weight of the rarer label.  Terms whose first gradient is within what chance gives a
neutral one, and those that L1 does not keep, stay at exactly zero in w, so thousands of
neutral words of a long text add nothing.

Factors v_i (with L2) go to the terms that L1 keeps and to every other term whose row of

    M_ij = sum over rows of residual * x_i * x_j

is longer than independent residuals would make it (``SURPRISE`` times its expected
square, and that of the terms beside it, as copied texts raise all their terms; estimated
for all terms at once by random projections of the rows): such a term tells in a pair even
if it says nothing alone.

Learning uses a bounded sample of labelled rows: of each label at most ``max_rows``
ids in the order of their hash, weighted back to the label's share.  The sample's ids are
broadcast (bounded), so texts are not shuffled for it; its texts are set aside once, terms
in fewer than ``LEAST_ROWS`` of them are dropped on the cluster, and all others go to the
driver, of whole texts (bounded by rows and the vocabulary that they share).  Rows of
equal terms are one.  Scoring reads every term of every text, and needs no shuffle.

Null and empty texts have no terms and the score of the bias.  Very long texts are scored
whole, one chunk each.  Labels that are null or without id are ignored; if an id has both
labels the larger counts, and rows that share an id are learned from each.  Without any
labelled row of either label the score is that label's share or 0.5.  An empty table of
documents gives an empty result.  Rows keep their number; extra columns pass through, and
where one has the name of a result column, the result's stays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from credalyt.llm.scratch import Plain, Scratch
from credalyt.llm.textkernel import ALNUM, Rolling, chunks, joined, mixed, words

BITS = 20
#: bytes at the start of a longer word that are terms too: compounds share them
STEMS = (4, 5, 6, 7)
FACTORS = 4
MAX_ROWS = 4000
LEAST_ROWS = 4
#: random projections, and the ratio of squares from which a term gets factors
PROJECTIONS, SURPRISE = 32, 4.0
#: standard deviations of a neutral term's gradient that a term must exceed to tell alone
CHANCE = 4.0
#: terms of the rows that are learned from at a time
BLOCK_TERMS = 1 << 19
_TERMS = Rolling(11)


def held_out(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo five, is zero: never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _lower_latin(raw: np.ndarray) -> np.ndarray:
    """Lower-case U+00C0 to U+00DE in UTF-8 (A-Z are lowered with the words)."""
    after = np.flatnonzero(raw[:-1] == 0xC3) + 1
    after = after[(raw[after] >= 0x80) & (raw[after] <= 0x9E) & (raw[after] != 0x97)]
    if len(after):
        raw = raw.copy()
        raw[after] += 0x20
    return raw


def terms(raw: np.ndarray, offs: np.ndarray, bits: int = BITS, among: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct slots of each row (those true in ``among``, if given), sorted, and their row offsets."""
    raw = _lower_latin(raw)
    starts, ends, of_row = words(raw, offs, ALNUM)
    text, ws, we = joined(raw, starts, ends, of_row)
    prefix, n = _TERMS.prefix(text), len(offs) - 1
    row = np.repeat(np.arange(n), np.diff(of_row))
    found = []
    for size in (0, *STEMS):
        long = slice(None) if not size else np.flatnonzero(we - ws > size)
        a = ws[long]
        h = _TERMS.spans(prefix, a, a + size if size else we) ^ np.uint64(size * 0x9E3779B97F4A7C15 % (1 << 64))
        slot, r = (mixed(h) >> np.uint64(64 - bits)).astype(np.int64), row[long]
        if among is not None:
            live = among[slot]
            slot, r = slot[live], r[live]
        found.append((r << bits) | slot)
    both = np.unique(np.concatenate(found))
    return both & ((1 << bits) - 1), np.searchsorted(both >> bits, np.arange(n + 1))


def _sums(x: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sums of x between offsets, row by row (also of empty rows)."""
    c = np.concatenate([np.zeros((1, *x.shape[1:])), np.cumsum(x, axis=0, dtype=np.float64)])
    return c[offs[1:]] - c[offs[:-1]]


@dataclass
class Machine:
    """Bias, linear weights and factors; all zero in slots without evidence."""

    bias: float
    w: np.ndarray
    v: np.ndarray

    def margin(self, slots: np.ndarray, offs: np.ndarray) -> np.ndarray:
        v = self.v[slots]
        return self.bias + _sums(self.w[slots], offs) + 0.5 * (_sums(v, offs) ** 2 - _sums(v * v, offs)).sum(axis=1)

    def score(self, slots: np.ndarray, offs: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(slots, offs), -35, 35)))


def in_pairs(at: np.ndarray, row: np.ndarray, residual: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Of each of ``n`` terms (``at``, in rows ``row``, ascending) the square of its row of residual-weighted
    co-occurrences, relative to what independent residuals give and, where that is more, to
    the mean of the terms in its rows.  Blocks of whole rows are taken one at a time."""
    rng, found, length = np.random.default_rng(seed), np.zeros(n), np.bincount(row, minlength=len(residual))
    ends = np.concatenate([[0], np.cumsum(length)])
    cuts = np.unique(np.concatenate([np.searchsorted(ends, np.arange(0, ends[-1], BLOCK_TERMS)), [0, len(length)]]))

    def each() -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            yield slice(lo, hi), at[ends[lo] : ends[hi]], row[ends[lo] : ends[hi]] - lo

    for _ in range(PROJECTIONS):
        g, with_others, own = rng.normal(size=n), np.zeros(n), np.zeros(n)
        for rows, i, r in each():
            e = residual[rows]
            z = np.bincount(r, g[i], len(e))
            with_others += np.bincount(i, (e * z)[r], n)
            own += np.bincount(i, e[r], n)
        found += (with_others - g * own) ** 2
    chance, usual, count = np.zeros(n), np.zeros(n), np.zeros(n, np.int64)
    for rows, i, r in each():
        chance += np.bincount(i, (residual[rows] ** 2 * np.maximum(length[rows] - 1, 0))[r], n)
        count += np.bincount(i, minlength=n)
    ratio = found / PROJECTIONS / np.maximum(chance, 1e-300)
    for rows, i, r in each():
        beside = np.bincount(r, ratio[i], rows.stop - rows.start) / np.maximum(length[rows], 1)
        usual += np.bincount(i, beside[r], n)
    return ratio / np.maximum(usual / np.maximum(count, 1), 1)


def fit(slots: np.ndarray, offs: np.ndarray, y: np.ndarray, weight: np.ndarray, bits: int = BITS, factors: int = FACTORS, rounds: int = 60, l1: float = 1e-3, l2: float = 1e-3, rate: float = 1.0, least_rows: int = LEAST_ROWS, seed: int = 7) -> Machine:
    """Learn from rows of slots; slots in fewer than ``least_rows`` rows stay zero.

    The linear part learns alone first; then its living slots, and those that tell in
    pairs (``in_pairs``), get factors, and both learn on.
    """
    size = 1 << bits
    weight = weight / max(weight.sum(), 1e-12)
    share = float((weight * y).sum())
    if not len(y) or share in (0.0, 1.0):
        p = min(max(share if len(y) else 0.5, 1e-6), 1 - 1e-6)
        return Machine(float(np.log(p / (1 - p))), np.zeros(size, np.float32), np.zeros((size, factors), np.float32))
    weight = weight / (2 * min(share, 1 - share))  # penalties are for a rarer label that weighs a half, however rare it is
    cuts = np.unique(np.concatenate([np.searchsorted(offs, np.arange(0, offs[-1], BLOCK_TERMS)), [0, len(y)]]))
    blocks = list(zip(cuts[:-1], cuts[1:]))

    def part(used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places among ``used`` of all slots that are there, row by row, and where each row ends."""
        place = np.full(size, -1, np.int32)
        place[used] = np.arange(len(used))
        kept, n = [], [np.zeros(1, np.int64)]
        for lo, hi in blocks:
            at = place[slots[offs[lo] : offs[hi]]]
            here = at >= 0
            kept.append(at[here])
            n.append(np.bincount(np.repeat(np.arange(hi - lo), np.diff(offs[lo : hi + 1]))[here], minlength=hi - lo))
        return np.concatenate(kept), np.cumsum(np.concatenate(n))

    seen = np.zeros(size, np.int64)
    for lo, hi in blocks:
        seen += np.bincount(slots[offs[lo] : offs[hi]], minlength=size)
    used = np.flatnonzero(seen >= least_rows)
    at, ends = part(used)
    w, v = np.zeros(len(used)), np.zeros((len(used), factors))
    # neutral terms: their gradients at the start are no more than chance gives
    start, pull = weight * (share - y), np.zeros(len(used))
    for lo, hi in blocks:
        pull += np.bincount(at[ends[lo] : ends[hi]], np.repeat(start[lo:hi], np.diff(ends[lo : hi + 1])), len(used))
    telling = np.abs(pull) >= CHANCE * np.sqrt(seen[used] * np.mean(start**2))
    bias, gb, gw, gv = float(np.log(share / (1 - share))), 1e-8, np.full(len(used), 1e-8), np.full(v.shape, 1e-8)
    for step in range(5 * rounds):  # factors are few, and start near a saddle
        if step == rounds:
            z = bias + np.concatenate([_sums(w[at[ends[lo] : ends[hi]]], ends[lo : hi + 1] - ends[lo]) for lo, hi in blocks])
            alive = np.flatnonzero((w != 0) | (in_pairs(at, np.repeat(np.arange(len(y), dtype=np.int32), np.diff(ends)), weight * (1 / (1 + np.exp(-np.clip(z, -35, 35))) - y), len(used), seed) >= SURPRISE))
            used, w, gw, telling, gv = used[alive], w[alive], gw[alive], np.ones(len(alive), bool), np.full((len(alive), factors), 1e-8)
            v = np.random.default_rng(seed).normal(0, 0.01, (len(used), factors))
            at, ends = part(used)
        pairs = step >= rounds
        g, gf, ge = np.zeros(len(used)), l2 * v, 0.0
        for lo, hi in blocks:  # rows in blocks, so memory does not grow with living terms
            i, off = at[ends[lo] : ends[hi]], ends[lo : hi + 1] - ends[lo]
            r = np.repeat(np.arange(hi - lo), np.diff(off))
            z = bias + _sums(w[i], off)
            if pairs:
                vs = v[i]
                total = _sums(vs, off)
                z = z + 0.5 * (total**2 - _sums(vs * vs, off)).sum(axis=1)
            e = weight[lo:hi] * (1 / (1 + np.exp(-np.clip(z, -35, 35))) - y[lo:hi])
            g += np.bincount(i, e[r], len(used))
            if pairs:
                for f in range(factors):
                    gf[:, f] += np.bincount(i, e[r] * (total[r, f] - vs[:, f]), len(used))
            ge += e.sum()
        gw += g * g
        lr = rate / np.sqrt(gw)
        w -= lr * g
        w = np.sign(w) * np.maximum(np.abs(w) - lr * l1, 0) * telling
        if pairs:
            gv += gf * gf
            v -= 0.05 * gf / np.sqrt(gv)
        gb += ge**2
        bias -= rate * ge / np.sqrt(gb)
    out_w, out_v = np.zeros(size, np.float32), np.zeros((size, factors), np.float32)
    out_w[used], out_v[used] = w, v
    return Machine(float(bias), out_w, out_v)


def _sampled_terms(text: str, label: str, weight: str, bits: int, among: np.ndarray | None):
    """Terms (those true in ``among``) of each row; without it, how many rows each term is in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.int64)
        for part, raw, offs in chunks(batches, text):
            slots, at = terms(raw, offs, bits, among)
            if among is None:
                total += np.bincount(slots, minlength=1 << bits)
                continue
            rows = [slots[a:b].astype(np.int32).tobytes() for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), *(part.column(part.schema.get_field_index(c)) for c in (label, weight))], names=["slots", "y", "w"])
        if among is None:
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["slot", "n"])

    return run


def _merged(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Slots, offsets, labels and weights of the distinct rows, in one order (the cluster may return rows in any,
    and sums in floating point want one)."""
    weights: dict[tuple[int, bytes], float] = {}
    for b in rows.to_batches(max_chunksize=256):
        for x, y, w in zip(*(b.column(c).to_pylist() for c in ("slots", "y", "w"))):
            weights[y, x] = weights.get((y, x), 0.0) + w
    order = sorted(weights, key=lambda k: (k[0], len(k[1]), hashlib.md5(k[1]).digest()))
    flat = np.frombuffer(b"".join(x for _, x in order), np.int32)
    offs = np.concatenate([[0], np.cumsum([len(x) // 4 for _, x in order])]).astype(np.int64)
    return flat, offs, np.array([y for y, _ in order], float), np.array([weights[k] for k in order])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = MAX_ROWS, bits: int = BITS) -> Machine:
    """A machine learned from a bounded sample of the labelled rows that are not held out."""
    d, lab = Plain(docs), Plain(labels)
    known = lab.df.select(F.col(lab[id_col]).alias("id"), F.col(lab[label_col]).cast("int").alias("y")).where("id is not null and y in (0, 1)").where(~held_out("id"))
    known = known.groupBy("id").agg(F.max("y").alias("y"))
    counts = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    parts = [known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(max_rows).withColumn("w", F.lit(n / min(n, max_rows))) for y, n in sorted(counts.items())]
    if not parts:
        return fit(np.empty(0, np.int64), np.zeros(1, np.int64), np.empty(0), np.empty(0), bits)
    sample = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    texts = d.df.select(F.col(d[id_col]).alias("id"), F.col(d[text_col]).alias("text")).where("id is not null")
    with Scratch(docs.sparkSession, "toxic") as scratch:
        chosen = scratch.save(texts.join(F.broadcast(sample), "id").select("text", "y", "w"))
        seen = chosen.mapInArrow(_sampled_terms("text", "y", "w", bits, None), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
        among = np.zeros(1 << bits, bool)
        among[seen.where(F.col("n") >= LEAST_ROWS).select("slot").toArrow()["slot"].to_numpy()] = True  # at most 2**bits
        learned = _merged(chosen.mapInArrow(_sampled_terms("text", "y", "w", bits, among), "slots binary, y int, w double").toArrow())
        scratch.drop(chosen)
    return fit(*learned, bits)


def scored(df: DataFrame, machine: Machine, text_col: str = "text", keep: list[str] | None = None, bits: int = BITS) -> DataFrame:
    """``df`` (or its columns ``keep``) with score and predicted (1 from a score of 0.5)."""
    keep = df.columns if keep is None else keep
    plain = Plain(df)
    text, held = plain[text_col], [plain[c] for c in keep]
    live = np.flatnonzero((machine.w != 0) | (machine.v != 0).any(axis=1))
    small = (machine.bias, live.astype(np.int32), machine.w[live], machine.v[live])
    sent = df.sparkSession.sparkContext.broadcast(small)  # at most 2**bits slots
    factors = machine.v.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bias, at, w, v = sent.value
        m = Machine(bias, np.zeros(1 << bits, np.float32), np.zeros((1 << bits, factors), np.float32))
        m.w[at], m.v[at] = w, v
        among = np.zeros(1 << bits, bool)
        among[at] = True
        for part, raw, offs in chunks(batches, text):
            p = m.score(*terms(raw, offs, bits, among))
            yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in held), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=[*held, "score", "predicted"])

    schema = T.StructType([*(plain.df.schema[c] for c in held), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    out = plain.df.select(*dict.fromkeys([*held, text])).mapInArrow(run, schema)
    return plain.back(out, keep, ["score", "predicted"])


def without_toxic(df: DataFrame, machine: Machine, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that the machine does not call toxic, with the columns of ``df``."""
    plain = Plain(df)
    return scored(plain.df, machine, plain[text_col]).where("predicted = 0").select(*plain.cols()).toDF(*plain.names)
