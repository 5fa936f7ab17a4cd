"""Benchmark decontamination: a prefix-filtered set join of item windows with documents.

A window is ``window`` consecutive words of a benchmark item (an item of fewer, but
not none, is one window).  A document contains a window only if it contains all of
the window's shingles, so with shingles in one fixed order a prefix of a single
shingle is enough to find every occurrence.  The order is by rarity over all documents.

1. The items' distinct windows become a table, each with the hashes of its shingles.
2. One pass over the documents counts how often each of these shingles occurs.  A window
   that has one which never occurs goes; each other is filed under its rarest.
3. A second pass posts the places of filed shingles with the bytes around them, and
   posts meet windows by an equi-join on the shingle.  Where the shingle stands
   in the window gives the only possible start, which must lie inside the document with
   the whole window (place and length bounds); then the bytes of the window are compared.

Nothing has the size of the benchmark on the driver or in a task: windows, counts and posts
are tables, and documents are screened by a bit filter of at most ``2**FILTER_BITS`` bits (a
full one lets more shingles through to the joins and changes no result).  A shingle with more
than a 1,024th of all places is salted: its places are dealt out, its windows repeated.  Texts
are never shuffled to find hits; these are filed by the digest of the text, so copies share them.

Null or empty documents and documents without words have n_words 0 and no hits; very
long ones are read whole, one chunk each.  Items without words have no windows; those of an
item whose id is null hit words, but it has no id to list.  Items that share an id count
as one.  Repeated rows give a result row each.  Empty tables give no hits, or no rows.
Extra columns pass through; where one has the name of a result column, the result's stays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from credalyt.llm.scratch import Plain, Scratch
from credalyt.llm.textkernel import ALNUM, Rolling, chunks, joined, words

WINDOW, SHINGLE = 13, 5
#: bits of the filter that screens the documents' shingles (16 megabytes of them at most)
FILTER_BITS = 27
#: places of a shingle that are not worth salting
FEW_PLACES = 50_000
#: rows of a batch that a task gives back
BATCH = 10_000
RESULT = ("n_words", "hit_spans", "item_ids")
_ROLL = Rolling(20240)


class _Words:
    """Words of a chunk, their joined text and its hash prefix."""

    def __init__(self, raw: np.ndarray, offs: np.ndarray):
        starts, ends, self.of_row = words(raw, offs, ALNUM)
        self.text, self.starts, self.ends = joined(raw, starts, ends, self.of_row)
        self.prefix = _ROLL.prefix(self.text)
        self.row_end = np.repeat(self.of_row[1:], np.diff(self.of_row))

    def shingles(self, size: int) -> np.ndarray:
        """The hash of each ``size`` words; those that would cross a row are harmless, as bounds come later."""
        n = len(self.starts) - size + 1
        return _ROLL.spans(self.prefix, self.starts[:n], self.ends[size - 1 :]) if n > 0 else np.empty(0, np.uint64)


def item_windows(items: DataFrame, id_col: str, text_col: str, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """(item, w, text, size, s, hashes): each window of each item, the digest of its text (words, each
    followed by a space), its words, the words of its shingles and their hashes."""
    plain = Plain(items)
    rows = plain.df.select(F.col(plain[id_col]).cast("string").alias("item"), F.col(plain[text_col]).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw, offs in chunks(batches, "t"):
            w = _Words(raw, offs)
            text, ids = w.text.tobytes(), part.column(0).to_pylist()
            n = np.diff(w.of_row)
            many = np.where(n > 0, np.maximum(n - window + 1, 1), 0)
            row = np.repeat(np.arange(len(n)), many)
            first = w.of_row[:-1][row] + np.arange(len(row)) - (np.cumsum(many) - many)[row]
            size = np.minimum(n[row], window)
            by_size = {s: w.shingles(s).view(np.int64) for s in np.unique(np.minimum(size, shingle)).tolist()}
            for at in range(0, len(row), BATCH):
                out: dict[str, list] = {c: [] for c in ("item", "w", "text", "size", "s", "hashes")}
                for r, a, k in zip(*(x[at : at + BATCH].tolist() for x in (row, first, size))):
                    s = min(k, shingle)
                    own = text[w.starts[a] : w.ends[a + k - 1]] + b" "
                    for c, x in zip(out, (ids[r], hashlib.sha256(own).digest(), own, k, s, by_size[s][a : a + k - s + 1])):
                        out[c].append(x)
                kinds = (pa.string(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out.values(), kinds)], names=list(out))

    return rows.mapInArrow(run, "item string, w binary, text binary, size int, s int, hashes array<long>")


class Filter:
    """Bits that say which hashes may be in a table; built by Spark, of bounded size."""

    def __init__(self, hashes: DataFrame, expected: int):
        """``hashes``: one long column."""
        self.shift = 64 - min(FILTER_BITS, max(16, (64 * expected).bit_length()))
        slot = hashes.select(F.shiftrightunsigned(hashes.columns[0], self.shift).alias("slot"))
        bits = slot.groupBy(F.shiftright("slot", 6).alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(slot & 63 AS int)))").alias("bits")).toArrow()
        self.bits = np.zeros(1 << (64 - self.shift - 6), np.uint64)
        self.bits[bits["at"].to_numpy()] = bits["bits"].to_numpy().view(np.uint64)

    def passing(self, h: np.ndarray) -> np.ndarray:
        """Places in ``h`` whose hash may be in the table."""
        slot = h >> np.uint64(self.shift)
        return np.flatnonzero(self.bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63)) & np.uint64(1))


def _passing(w: _Words, sizes: list[int], screen: Filter) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each size of shingles: the places in a chunk that pass, inside their row, and the hashes there."""
    for s in sizes:
        h = w.shingles(s)
        at = screen.passing(h)
        at = at[at + s <= w.row_end[at]]
        yield s, at, h[at]


def shingle_counts(docs: DataFrame, text: str, sizes: list[int], screen: Filter) -> DataFrame:
    """(s, h, places): how often each shingle that passes the filter occurs in all documents."""
    sent = docs.sparkSession.sparkContext.broadcast(screen)  # at most 2**FILTER_BITS bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, raw, offs in chunks(batches, text):
            for s, _, h in _passing(_Words(raw, offs), sizes, sent.value):
                h, n = np.unique(h, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), s, np.int32)), pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["s", "h", "n"])

    return docs.select(text).mapInArrow(run, "s int, h long, n long").groupBy("s", "h").agg(F.sum("n").alias("places"))


def by_rarity(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """(w, size, s, h, places, before, pre, post): windows all of whose shingles occur, filed under the
    rarest (ties: the least hash, then the first), and their text in front of it and from it on."""
    each = windows.select("w", "s", F.posexplode("hashes").alias("before", "h"))
    rarest = each.join(counts, ["s", "h"], "left").groupBy("w").agg(F.min(F.struct(F.coalesce("places", F.lit(0)).alias("places"), "h", "before")).alias("r")).where("r.places > 0")
    filed = windows.join(rarest, "w").select("w", "size", "s", "r.h", "r.places", "r.before", "text")
    # a space stands behind each word and in front of the text, so words are compared whole
    cut = F.expr("octet_length(substring_index(CAST(text AS string), ' ', before))") + F.when(F.col("before") > 0, 1).otherwise(0)
    text = F.concat(F.lit(b" "), "text")
    filed = filed.withColumn("cut", cut + 1)
    return filed.select("w", "size", "s", "h", "places", "before", F.substring(text, F.lit(1), F.col("cut")).alias("pre"), F.substring(text, F.col("cut") + 1, F.octet_length(text)).alias("post"))


def posts(docs: DataFrame, text: str, sizes: list[int], screen: Filter, salts: dict[tuple[int, int], int], window: int, most: tuple[int, int]) -> DataFrame:
    """(s, h, salt, key, n, at, left, right): places of shingles that pass the filter, with the bytes of the
    words in front of them and from them on, as far as a window (``most`` bytes) can reach."""
    sent = docs.sparkSession.sparkContext.broadcast((screen, salts))  # salts: at most 1,024
    names = ("s", "h", "salt", "key", "n", "at", "left", "right")
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int32(), pa.binary(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        screen, salts = sent.value
        for _, raw, offs in chunks(batches, text):
            w = _Words(raw, offs)
            own: tuple[int, bytes] = (-1, b"")
            for s, places, hashes in _passing(w, sizes, screen):
                rows = np.searchsorted(w.of_row, places, "right") - 1
                for start in range(0, len(places), BATCH):
                    out: dict[str, list] = {c: [] for c in names}
                    part = slice(start, start + BATCH)
                    for p, h, row in zip(places[part].tolist(), hashes[part].view(np.int64).tolist(), rows[part].tolist()):
                        if own[0] != row:
                            own = (row, hashlib.sha256(raw[offs[row] : offs[row + 1]]).digest())
                        head, end = int(w.of_row[row]), int(w.of_row[row + 1])
                        a, z, here = max(head, p - window + 1), min(end, p + window), int(w.starts[p])
                        left = b" " + w.text[max(int(w.starts[a]), here - most[0]) : here].tobytes()
                        right = w.text[here : min(int(w.ends[z - 1]), here + most[1])].tobytes() + b" "
                        salt = (int.from_bytes(own[1][:6], "big") + p - head) % salts.get((s, h), 1)
                        for c, x in zip(names, (s, h, salt, own[1], end - head, p - head, left[-most[0] :], right[: most[1]])):
                            out[c].append(x)
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out.values(), kinds)], names=list(names))

    return docs.select(text).mapInArrow(run, "s int, h long, salt int, key binary, n long, at int, left binary, right binary")


def counted(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs`` and n_words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw, offs in chunks(batches, text):
            n = np.diff(words(raw, offs, ALNUM)[2]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in keep), pa.array(n)], names=[*keep, "n_words"])

    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("n_words", T.LongType())])
    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)


def _hits(docs: DataFrame, text: str, items: DataFrame, id_col: str, item_text: str, window: int, shingle: int, few: int) -> DataFrame:
    """(key, n_words, hit_spans, item_ids) of each distinct text with an occurrence of a window; key is the text's digest."""
    with Scratch(docs.sparkSession, "decontaminate") as scratch:
        raw = item_windows(items, id_col, item_text, window, shingle)
        windows = scratch.save(raw.drop("item").distinct())
        links = raw.where("item IS NOT NULL").select("w", "item").distinct()
        total, sizes = windows.agg(F.count("*"), F.sort_array(F.collect_set("s"))).first()  # at most ``shingle`` sizes
        wanted = windows.select(F.explode("hashes").alias("h"))
        filed = scratch.save(by_rarity(windows, shingle_counts(docs, text, sizes, Filter(wanted, total))))
        kept, sizes, pre, post, places = filed.agg(F.count("*"), F.sort_array(F.collect_set("s")), F.max(F.octet_length("pre")), F.max(F.octet_length("post")), F.max("places")).first()

        share, hot = few, {}
        if (places or 0) > few:
            used = filed.select("s", "h", "places").distinct()
            share = max(few, -(-used.agg(F.sum("places")).first()[0] // 1024))
            hot = {(r.s, r.h): -(-r.places // share) for r in used.where(F.col("places") > share).collect()}  # fewer than 1,024
        dealt = filed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("places") / share).cast("int") - 1))))
        dealt = scratch.save(dealt.withColumnRenamed("size", "words"))
        there = posts(docs, text, sizes, Filter(filed.select("h"), kept), hot, window, (pre or 1, post or 1))
        first = F.col("at") - F.col("before")
        met = there.join(dealt, ["s", "h", "salt"]).where((first >= 0) & (first + F.col("words") <= F.col("n")) & F.endswith("left", "pre") & F.startswith("right", "post"))
        met = scratch.save(met.select("key", "n", first.alias("a"), (first + F.col("words")).alias("b"), "w").distinct())

        # disjoint spans: a new one starts beyond all that started before
        before = Window.partitionBy("key").orderBy("a", "b")
        span = met.select("key", "n", "a", "b").distinct().withColumn("far", F.max("b").over(before.rowsBetween(Window.unboundedPreceding, -1)))
        span = span.withColumn("run", F.count(F.when(F.col("far").isNull() | (F.col("a") > F.col("far")), 1)).over(before.rowsBetween(Window.unboundedPreceding, 0)))
        span = span.groupBy("key", "run").agg(F.max("n").alias("n"), F.min("a").alias("start"), F.max("b").alias("end"))
        span = span.groupBy("key").agg(F.max("n").alias("n_words"), F.sort_array(F.collect_list(F.struct("start", "end"))).alias("hit_spans"))
        ids = met.select("key", "w").distinct().join(links, "w").select("key", "item").distinct().groupBy("key").agg(F.sort_array(F.collect_list("item")).alias("item_ids"))
        found = scratch.save(span.join(ids, "key", "left").withColumn("item_ids", F.coalesce("item_ids", F.array().cast("array<string>"))))
        scratch.drop(windows, filed, dealt, met)
        return found


def contamination(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, shingle: int = SHINGLE, keep: list[str] | None = None, few: int = FEW_PLACES) -> DataFrame:
    """``docs`` (or its columns ``keep``) with n_words (long), hit_spans (disjoint word
    ranges covered by windows, start inclusive and end exclusive) and item_ids (sorted
    ids, as strings, of the items with a window in the text).

    Spark broadcasts the table of hits if it is small; else the columns kept are shuffled by the text's digest."""
    keep = docs.columns if keep is None else keep
    plain = Plain(docs)
    text = plain[text_col]
    found = _hits(plain.df, text, items, item_id, item_text, window, shingle, few).drop("n_words")
    out = counted(plain.df.withColumn("key", F.unhex(F.sha2(text, 256))), text, [*dict.fromkeys(plain[c] for c in keep), "key"]).join(found, "key", "left")
    spans, ids = (F.coalesce(c, F.array().cast(t)).alias(c) for c, t in (("hit_spans", "array<struct<start:int,end:int>>"), ("item_ids", "array<string>")))
    return plain.back(out.select(*dict.fromkeys(plain[c] for c in keep), "n_words", spans, ids), keep, [*RESULT])


def n_hit():
    """Words inside hit spans."""
    return F.aggregate("hit_spans", F.lit(0).cast("long"), lambda acc, s: acc + (s["end"] - s["start"]))


def contaminated():
    """At least one word in twenty is hit."""
    return (n_hit() > 0) & (20 * n_hit() >= F.col("n_words"))


def decontaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, shingle: int = SHINGLE, few: int = FEW_PLACES) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with the columns of ``docs``."""
    plain = Plain(docs)
    text = plain[text_col]
    found = _hits(plain.df, text, items, item_id, item_text, window, shingle, few)
    out = plain.df.withColumn("key", F.unhex(F.sha2(text, 256))).join(found.where(contaminated()).select("key"), "key", "left_anti")
    return out.select(*plain.cols()).toDF(*plain.names)
