"""Exact substring dedup by a logarithmic family of sparse suffix arrays.

A byte goes if a ``width`` = 100 byte string that covers it also starts earlier
(smaller document id, or earlier in the same document).  Texts are UTF-8 bytes;
matches never cross documents.

*Suffixes.*  Indexing every byte would take many times the input, so suffixes are
sampled by content.  In each 100-byte window the 32-byte gram with the least hash is
the window's anchor (leftmost of equals); equal windows have equal anchors, so no
match is missed.  Consecutive windows with one anchor form a run, about one for each
35 bytes.  A run's text is everything its windows cover.  The suffix at an anchor is
ordered by its first four bytes, then by a fingerprint of the 32-byte gram (runs that
share a longer prefix stay side by side), then by a fingerprint of the run's text
(runs that match as a whole stay side by side).

*Levels.*  Documents arrive in batches in order of their ids.  A batch's suffixes are
made unique, each with its first position, and sorted: its suffix array.  It is
merge-scanned against each existing level (bucketed alike, so no level is shuffled),
which drops the runs that a level has.  What is left becomes a level of its own;
before the next batch arrives, levels of equal size merge, so each suffix is
rewritten a logarithmic number of times.

*Boundaries.*  A run that is no copy as a whole may still share some windows, but only
with runs of the same anchor gram.  Where several different runs share a gram, their
windows are compared one by one, in the same way (first position of each).

A document then keeps exactly the windows that are first occurrences: these lists are
sent to the documents, which shuffles positions of about the size of the anchors.
Texts are shuffled twice, to meet their lists.

Nulls and empty texts have no bytes; a text longer than a chunk is a chunk of its own, and
an empty table gives an empty result.  Documents whose id is null come first; rows that
share an id are ordered by their texts, and equal rows follow each other (such tables
are renumbered first).  Other columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credalyt.llm.scratch import Plain, Scratch, numbered, releasing
from credalyt.llm.textkernel import Rolling, chunks, mixed

WIDTH, GRAM = 100, 32
BATCHES = 4
_GRAMS, _RUNS = Rolling(3), Rolling(5)


class Runs:
    """The runs of a chunk: where each starts, how many windows it has, and its two fingerprints."""

    def __init__(self, raw: np.ndarray, offs: np.ndarray, width: int = WIDTH, gram: int = GRAM):
        self.width = width
        n = np.diff(offs) - width + 1
        fit = n > 0
        first = np.repeat(offs[:-1][fit], n[fit])
        begins = np.cumsum(n[fit]) - n[fit]
        at = first + np.arange(len(first)) - np.repeat(begins, n[fit])  # starts of all windows
        self.raw = raw
        if not len(at):
            self.lo = self.m = np.empty(0, np.int64)
            self.row_runs = np.zeros(len(offs), np.int64)
            return
        h = _GRAMS.grams(_GRAMS.prefix(raw), gram)
        bits = np.uint64(max(1, len(h).bit_length()))
        v = (h >> bits << bits) | np.arange(len(h), dtype=np.uint64)
        span, have = width - gram + 1, 1
        least = v
        while have * 2 <= span:
            least = np.minimum(least[:-have], least[have:])
            have *= 2
        if have < span:
            least = np.minimum(least[: len(least) - (span - have)], least[span - have :])
        anchor = (least[at] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)]))
        self.lo, self.m, self.anchor = at[new], np.diff(np.append(new, len(at))), anchor[new]
        self.hash = h
        self.row_runs = np.searchsorted(self.lo, offs)
        self._prefix: np.ndarray | None = None

    def prefix(self) -> np.ndarray:
        if self._prefix is None:
            self._prefix = _RUNS.prefix(self.raw)
        return self._prefix

    def gram_key(self) -> np.ndarray:
        """Order of the suffixes: four bytes, then a fingerprint of the gram."""
        four = np.zeros(len(self.lo), np.uint64)
        for i in range(4):
            four = (four << np.uint64(8)) | self.raw[self.anchor + i].astype(np.uint64)
        return ((four << np.uint64(32)) | (self.hash[self.anchor] >> np.uint64(32))).view(np.int64)

    def run_key(self) -> np.ndarray:
        whole = _RUNS.spans(self.prefix(), self.lo, self.lo + self.m - 1 + self.width)
        shape = (self.anchor - self.lo) * 4096 + self.m
        return mixed(whole ^ mixed(shape.astype(np.uint64))).view(np.int64)


def _suffixes(key: str, text: str, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw, offs in chunks(batches, text):
            r = Runs(raw, offs)
            if not len(r.lo):
                continue
            keys = part.column(part.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(keys)), np.diff(r.row_runs))
            pos = (keys[row].astype(np.int64) << bits) | (r.lo - offs[row])
            yield pa.RecordBatch.from_arrays([pa.array(r.gram_key()), pa.array(r.run_key()), pa.array(pos)], names=["gram", "run", "pos"])

    return run


class IndexFamily:
    """Levels of sorted suffixes; ``add`` returns nothing, ``firsts`` all first positions so far."""

    def __init__(self, scratch: Scratch):
        self.scratch, self.spark = scratch, scratch.spark
        self.buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[tuple[int, str]] = []  # (batches, table), large ones first

    def _write(self, df: DataFrame) -> str:
        name = f"credalyt_level_{uuid.uuid4().hex}"
        with releasing(self.spark):
            df.write.bucketBy(self.buckets, "gram", "run").sortBy("gram", "run").option("path", f"{self.scratch.root}/{name}").format("parquet").saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.scratch.delete(f"{self.scratch.root}/{name}")

    def _by_suffix(self, df: DataFrame) -> DataFrame:
        return df.repartition(self.buckets, "gram", "run")

    def _compact(self) -> None:
        """Merge the last levels while they have the same size."""
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (n, b), (_, a) = self.levels.pop(), self.levels.pop()
            self.levels.append((2 * n, self._write(self._by_suffix(self.spark.table(a).unionByName(self.spark.table(b))))))
            self._drop(a)
            self._drop(b)

    def add(self, suffixes: DataFrame) -> None:
        """A later batch (gram, run, pos): sort it, scan the levels and keep what they lack."""
        self._compact()
        fresh = suffixes.groupBy("gram", "run").agg(F.min("pos").alias("pos"))
        for _, name in self.levels:
            fresh = fresh.join(self.spark.table(name).select("gram", "run").hint("merge"), ["gram", "run"], "left_anti")
        self.levels.append((1, self._write(fresh)))

    def firsts(self) -> DataFrame:
        out = None
        for _, name in self.levels:
            t = self.spark.table(name).select("gram", "pos")
            out = t if out is None else out.unionByName(t)
        return out

    def close(self) -> None:
        for _, name in self.levels:
            self._drop(name)
        self.levels = []


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and row offsets of a list<int> column; null is empty."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return values, np.concatenate([[0], np.cumsum(sizes)])


def _marks(part: pa.RecordBatch, name: str, offs: np.ndarray, size: int) -> np.ndarray:
    """True at each listed place (relative to its row) of the chunk."""
    values, at = _lists(part.column(part.schema.get_field_index(name)))
    out = np.zeros(size, bool)
    out[values + np.repeat(offs[:-1], np.diff(at))] = True
    return out


def _windows(key: str, text: str, bits: int):
    """Windows of the runs listed in ``shared``: fingerprints and positions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw, offs in chunks(batches, text, 1 << 19):
            r = Runs(raw, offs)
            listed = _marks(part, "shared", offs, len(raw) + 1)[r.lo]
            if not listed.any():
                continue
            lo, m, gram = r.lo[listed], r.m[listed], r.gram_key()[listed]
            keys = part.column(part.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
            row = np.searchsorted(offs, lo, "right") - 1
            at = np.repeat(lo - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))
            win = _RUNS.spans(r.prefix(), at, at + r.width).view(np.int64)
            pos = (np.repeat(keys[row].astype(np.int64), m) << bits) | (at - np.repeat(offs[row], m))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(gram, m)), pa.array(win), pa.array(pos)], names=["gram", "run", "pos"])

    return run


def _kept(keep: list[str], text: str):
    """Removed spans of each text, from the lists of its first runs and first windows."""
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw, offs in chunks(batches, text):
            r = Runs(raw, offs)
            cover = np.zeros(len(raw) + 1, np.int64)
            if len(r.lo):
                first, shared = (_marks(part, x, offs, len(raw) + 1)[r.lo] for x in ("firsts", "shared"))
                again = ~first  # every window of such a run has been seen
                np.add.at(cover, r.lo[again], 1)
                np.add.at(cover, (r.lo + r.m - 1 + r.width)[again], -1)
                lo, m = r.lo[first & shared], r.m[first & shared]
                at = np.repeat(lo - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))
                at = at[~_marks(part, "windows", offs, len(raw) + 1)[at]]
                np.add.at(cover, at, 1)
                np.add.at(cover, at + r.width, -1)
            gone = np.cumsum(cover[:-1]) > 0
            edge = np.diff(np.concatenate([[0], gone.view(np.int8), [0]]))
            # a removed span never crosses a row, but two may touch at a border
            ups, downs = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            inner = offs[1:-1]
            inner = np.unique(inner[(inner > 0) & (inner < len(raw))])
            inner = inner[gone[inner - 1] & gone[inner]]
            ups, downs = np.sort(np.concatenate([ups, inner])), np.sort(np.concatenate([downs, inner]))
            of_row = np.searchsorted(ups, offs)
            removed = np.concatenate([[0], np.cumsum(gone)])[offs]
            data, spans, digests = raw.tobytes(), [], []
            for i in range(part.num_rows):
                a, b = int(offs[i]), int(offs[i + 1])
                own = [(int(ups[k]), int(downs[k])) for k in range(of_row[i], of_row[i + 1])]
                h, p = hashlib.sha256(), a
                for u, d in own:
                    h.update(data[p:u])
                    p = d
                h.update(data[p:b])
                digests.append(h.hexdigest())
                spans.append([{"start": u - a, "end": d - a} for u, d in own])
            yield pa.RecordBatch.from_arrays(
                [*(part.column(part.schema.get_field_index(c)) for c in keep), pa.array(np.diff(offs)), pa.array(np.diff(removed)), pa.array(spans, span_type), pa.array(digests)],
                names=[*keep, "n_bytes", "n_removed", "removed_spans", "kept_sha256"],
            )

    return run


def _as_lists(positions: DataFrame, bits: int, name: str) -> DataFrame:
    place = F.col("pos").bitwiseAND((1 << bits) - 1).cast("int")
    return positions.select(F.shiftright("pos", bits).alias("key"), place.alias("x")).groupBy("key").agg(F.collect_list("x").alias(name))


def repeated_substrings(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES, keep: list[str] | None = None) -> DataFrame:
    """``df`` (or its columns ``keep``) with n_bytes, n_removed, removed_spans (maximal
    removed byte ranges, end exclusive) and kept_sha256 of the bytes that stay."""
    keep = df.columns if keep is None else keep
    plain = Plain(df)
    scratch = Scratch(df.sparkSession, "suffix")
    text = plain[text_col]
    docs, bits = numbered(plain.df.select(*dict.fromkeys([plain[id_col], text, *(plain[c] for c in keep)])), plain[id_col], text, scratch)
    texts = docs.select("key", text)

    family = IndexFamily(scratch)
    try:
        cuts = docs.stat.approxQuantile("key", [i / batches for i in range(1, batches)], 0.01)
        cuts = sorted({int(c) for c in cuts or []})
        for lo, hi in zip([None, *cuts], [*cuts, None]):
            batch = texts if lo is None else texts.where(F.col("key") > lo)
            batch = batch if hi is None else batch.where(F.col("key") <= hi)
            family.add(batch.mapInArrow(_suffixes("key", text, bits), "gram long, run long, pos long"))

        firsts = family.firsts()
        several = firsts.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram")
        flagged = firsts.join(several.withColumn("shared", F.lit(1)), "gram", "left")
        place = F.col("pos").bitwiseAND((1 << bits) - 1).cast("int")
        lists = flagged.select(F.shiftright("pos", bits).alias("key"), place.alias("x"), "shared").groupBy("key").agg(F.collect_list("x").alias("firsts"), F.collect_list(F.when(F.col("shared") == 1, F.col("x"))).alias("shared"))
        lists = scratch.save(lists)
    finally:
        family.close()  # its tables are in the catalog

    near = texts.join(lists.where(F.size("shared") > 0).select("key", "shared").hint("shuffle_hash"), "key")
    windows = near.mapInArrow(_windows("key", text, bits), "gram long, run long, pos long")
    first_windows = windows.groupBy("gram", "run").agg(F.min("pos").alias("pos"))
    window_lists = scratch.save(_as_lists(first_windows, bits, "windows"))

    both = lists.join(window_lists, "key", "left")
    held = [plain[c] for c in keep]
    ready = docs.join(both.hint("shuffle_hash"), "key", "left")
    schema = ", ".join([*(f"{c} {docs.schema[c].dataType.simpleString()}" for c in held), "n_bytes long, n_removed long, removed_spans array<struct<start:int,end:int>>, kept_sha256 string"])
    out = ready.mapInArrow(_kept(held, text), schema)
    return plain.back(out, keep, ["n_bytes", "n_removed", "removed_spans", "kept_sha256"])
