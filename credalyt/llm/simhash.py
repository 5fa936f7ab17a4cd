"""SimHash near-duplicates: a byte-position inverted index with count filtering.

A fingerprint has 64 bits, the majority of the XXH64 values of a text's word
shingles.  Two fingerprints that differ in at most ``max_bits`` = 2 bits differ in
at most two of their eight bytes, so they share at least six positional bytes.

* The index lists fingerprints under positional bytes, four at a time: the eight
  positions form four blocks of two, two differing bytes leave two whole blocks
  alike, so a pair meets under at least one of the six block pairs.
* Within a list the shared positional bytes of each pair are tallied; pairs below
  six are dropped, the rest are verified bit by bit.
* Lists longer than ``list_limit`` never emit pairs.  Their members agree on four
  bytes; each is written under itself and under each of its 64 one-bit changes.
  Two fingerprints are within two bits exactly if they meet under one of those
  values, and a star to the least member keeps all that meet connected.  That is
  linear in the list, and exact.

Only distinct fingerprints are compared: copies meet by equality.

Nulls and empty texts have no words and the fingerprint zero, linked like any
other.  Repeated rows and repeated ids keep one result row each.  Rows with a null
id take part in links but never name a component (it is null if all its ids are);
of such a component ``representatives`` keeps one row for each fingerprint.
Extra columns of the input pass through under their own names; where an input column
has the name of a result column, the result's stays.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from credalyt.llm import setlinks
from credalyt.llm.components import components
from credalyt.llm.scratch import Plain, Scratch, numbered
from credalyt.llm.textkernel import NON_SPACE, chunks, joined, words

SEED = 42
#: pairs of two-byte blocks: positional bytes that a list fixes
BLOCK_PAIRS = tuple(combinations(range(4), 2))


def _shingles(raw: np.ndarray, offs: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every shingle of a chunk, and how many each row has."""
    starts, ends, of_row = words(raw, offs, NON_SPACE)
    text, ws, we = joined(raw, starts, ends, of_row)
    n_words = np.diff(of_row)
    n = np.where(n_words >= shingle, n_words - shingle + 1, (n_words > 0).astype(np.int64))
    total = int(n.sum())
    row = np.repeat(np.arange(len(n)), n)
    first = of_row[:-1][row] + np.arange(total) - (np.cumsum(n) - n)[row]
    last = np.minimum(first + shingle, of_row[1:][row]) - 1
    data, digest = text.tobytes(), xxhash.xxh64_intdigest
    return np.fromiter((digest(data[a:b], SEED) for a, b in zip(ws[first].tolist(), we[last].tolist())), np.uint64, total), n


def _majority(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Bits set in over half of each row's values, eight bytes a row."""
    out, some = np.zeros((len(n), 8), np.uint8), n > 0
    if len(h):
        bits = np.unpackbits(h.view(np.uint8).reshape(len(h), 8), axis=1)
        ones = np.add.reduceat(bits, (np.cumsum(n) - n)[some], axis=0, dtype=np.int32)
        out[some] = np.packbits(ones * 2 > n[some, None], axis=1)
    return out


def fingerprints_of(raw: np.ndarray, offs: np.ndarray, shingle: int) -> np.ndarray:
    """The fingerprint of each text of a chunk."""
    return _majority(*_shingles(raw, offs, shingle)).view(np.uint64).ravel()


def with_fingerprint(df: DataFrame, text_col: str = "text", out_col: str = "simhash", shingle: int = 3) -> DataFrame:
    """``df`` and a long column with the fingerprint's 64 bits."""
    schema = T.StructType([*df.schema.fields, T.StructField(out_col, T.LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw, offs in chunks(batches, text_col):
            fp = fingerprints_of(raw, offs, shingle).view(np.int64)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(fp)], names=[*part.schema.names, out_col])

    return df.mapInArrow(run, schema)


def _byte(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * i).bitwiseAND(255)


def _list_key(fp: Column, pair: tuple[int, int]) -> Column:
    mask = sum(0xFFFF << (16 * b) for b in pair)
    mask -= (mask >> 63) << 64
    return F.struct(F.lit(BLOCK_PAIRS.index(pair)).cast("int").alias("blocks"), fp.bitwiseAND(F.lit(mask)).alias("bytes"))


def fingerprint_links(fps: DataFrame, scratch: Scratch, max_bits: int = 2, list_limit: int = 32) -> DataFrame:
    """Edges (u, v) that connect exactly what pairs of distinct ``fp`` within two bits connect."""
    if max_bits > 2:
        raise ValueError("eight positional bytes bound at most two differing bits here")
    fp = F.col("fp")
    postings = fps.select("fp", F.inline(F.array(*[F.struct(_list_key(fp, p).alias("list")) for p in BLOCK_PAIRS])))
    sizes = postings.groupBy("list").agg(F.count("*").alias("n")).where("n > 1")
    listed = scratch.save(postings.join(sizes, "list").select(F.col("list.blocks").alias("blocks"), F.col("list.bytes").alias("bytes"), "fp", "n"))
    short = listed.where(F.col("n") <= list_limit)
    a, b = (short.select("blocks", "bytes", F.col("fp").alias(x)) for x in "uv")
    u, v = F.col("u"), F.col("v")
    same = [(_byte(u, i) == _byte(v, i)).cast("int") for i in range(8)]
    tally = sum(same[1:], same[0])
    pairs = a.join(b, ["blocks", "bytes"]).where(u < v).where(tally >= 8 - max_bits).where(F.bit_count(u.bitwiseXOR(v)) <= max_bits).select("u", "v")
    long = listed.where(F.col("n") > list_limit).select("fp").distinct()
    one = [F.lit(1 << i if i < 63 else -(1 << 63)) for i in range(64)]
    if max_bits == 2:
        near = long.select(fp.alias("u"), F.explode(F.array(fp, *[fp.bitwiseXOR(x) for x in one])).alias("at"))
        least = near.groupBy("at").agg(F.min("u").alias("v"), F.count("*").alias("n")).where("n > 1").select("at", "v")
        stars = near.join(least, "at").where("u <> v").select("u", "v")
    else:  # one bit: a change of one is the other
        near = long.select(fp.alias("u"), F.explode(F.array(*[fp.bitwiseXOR(x) for x in one[: 64 * max_bits]])).alias("v"))
        stars = near.join(long.select(fp.alias("v")), "v", "left_semi").where("u < v")
    return pairs.unionByName(stars).distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 2, list_limit: int = 32, keep: list[str] | None = None) -> DataFrame:
    """``df`` (or its columns ``keep``), with fingerprint (hex), component_id and links.

    component_id: the smallest id among all rows reachable by links.
    links: the rows of the component whose fingerprint is this one (copies and
    equals, this row included); links between different fingerprints are in
    ``fingerprint_links``.
    """
    keep = df.columns if keep is None else keep
    plain = Plain(df)
    with Scratch(df.sparkSession, "simhash") as scratch:
        found = with_fingerprint(plain.df.select(*dict.fromkeys(plain[c] for c in [id_col, text_col, *keep])), plain[text_col], "fp", shingle)
        found = scratch.save(found.select(*dict.fromkeys(plain[c] for c in [id_col, *keep]), "fp"))  # texts are hashed once
        classes = _classes(found.select(F.col(plain[id_col]).alias("id"), "fp"), scratch, max_bits, list_limit)
    out = found.join(classes, "fp").withColumn("fingerprint", F.lower(F.lpad(F.hex("fp"), 16, "0")))
    return plain.back(out, keep, ["fingerprint", "component_id", "links"])


def _classes(ids: DataFrame, scratch: Scratch, max_bits: int, list_limit: int) -> DataFrame:
    """(fp, component_id, links) of rows (id, fp)."""
    small = scratch.save(ids.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("links")))
    roots = components(fingerprint_links(small.select("fp"), scratch, max_bits, list_limit), scratch)
    named = small.join(roots, small["fp"] == roots["node"], "left").select("fp", "least", "links", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return scratch.save(named.join(least, "root").select("fp", "component_id", "links"))


def fingerprint_pairs(nodes: DataFrame, scratch: Scratch, max_bits: int = 2) -> DataFrame:
    """(u, v): nodes (node, fp) of one fingerprint, each with their least, and these for linked fingerprints."""
    least = scratch.save(nodes.groupBy("fp").agg(F.min("node").alias("top")))
    same = nodes.join(least, "fp").where("node <> top").select(F.col("top").alias("u"), F.col("node").alias("v"))
    links = fingerprint_links(least.select("fp"), scratch, max_bits)
    side = lambda c: least.select(F.col("fp").alias(c), F.col("top").alias(f"top_{c}"))
    near = links.join(side("u"), "u").join(side("v"), "v").select(F.least("top_u", "top_v").alias("u"), F.greatest("top_u", "top_v").alias("v"))
    return same.unionByName(near)


def dissimilar(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of each group of near duplicates of ``df``, with the columns of ``df``: that with
    the smallest id (null before others; among rows of one id the least text hash).

    Rows are linked exactly if their sets of word shingles have a Jaccard similarity of
    ``similarity`` or more; copies always are, and null texts, empty ones and others without
    words are copies of each other.  Very long texts are compared whole, one chunk each.

    Sets that are equal are one node.  The byte-position index proposes the nodes whose SimHash
    fingerprints link, and as two bits of 64 are far less than the similarity allows, the index
    of prefixes (``setlinks``) proposes every other pair that could have it.  All that is linked
    is decided on the texts."""
    plain = Plain(df)
    text = plain[text_col]
    with Scratch(df.sparkSession, "similar") as scratch:
        docs, _ = numbered(plain.df, plain[id_col], text, scratch)
        found = scratch.save(setlinks.indexed(docs, text, shingle, similarity, lambda h, n: _majority(h, n).view(np.uint64).ravel()))
        nodes = scratch.save(found.groupBy("copies").agg(F.min("key").alias("node"), F.min("fp").alias("fp")).select("node", "fp"))
        listed = scratch.save(setlinks.lists(found, nodes, similarity))
        short, members = listed.where("u is not null").select("u", "v"), listed.where("u is null").drop("u", "v")
        likely = fingerprint_pairs(nodes, scratch).unionByName(short).unionByName(setlinks.long_pairs(members, found, None, similarity))
        pairs = scratch.save(setlinks.plausible(likely.distinct(), found, similarity))
        tested = scratch.save(setlinks.similar(pairs, docs, text, shingle, similarity))
        roots = components(tested.where("alike").select("u", "v"), scratch)
        rest = scratch.save(setlinks.long_pairs(members, found, roots, similarity).join(tested, ["u", "v"], "left_anti"))
        links = scratch.save(setlinks.similar(rest, docs, text, shingle, similarity).where("alike").select("u", "v"))
        joined = components(links.unionByName(roots.where("node <> root").select(F.col("root").alias("u"), F.col("node").alias("v"))), scratch)
        copies = found.select("key").join(nodes.select(F.col("node").alias("key")), "key", "left_anti")
        gone = scratch.save(copies.unionByName(joined.where("node <> root").select(F.col("node").alias("key"))))
        scratch.drop(found, nodes, listed, pairs, tested, rest, links)
    return docs.join(gone, "key", "left_anti").select(*plain.cols()).toDF(*plain.names)
