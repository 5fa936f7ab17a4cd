"""A stored BM25 index with score bounds, and exact top k by block-max pruning.

Build, one tokenisation of each text and no shuffle of texts or postings: a map task takes its
documents in pieces of at most ``PIECE_TOKENS`` tokens (or one document), sorts a piece by collection
and length, cuts it into blocks of ``BLOCK_DOCS`` (like lengths, so that a bound for a block is close
to its scores) and packs the postings of each (term, block) into one row:

* ``entries`` (term, collection, block, n, total, ids, tfs, dls, frontier), sorted by term in each
  file, so a filter on terms reads few row groups (of ``GROUP_BYTES``).  ``frontier`` has the (tf, dl)
  pairs of the block that no shorter document beats; the largest term score of a block for any k1, b
  and mean length is that of a pair of its frontier.  A task writes what it has packed, so a term that
  is in every document is no hot key.
* ``terms`` (term, collection, df, total, max_tf) and ``stats``, a row for each collection.

Search.  The bound of a block for a query is the sum of its terms' largest scores there; negative
weights count as zero.  Round one scores the ``k`` blocks of largest bound of each query; the k-th
best score is a threshold, and round two scores only the blocks whose bound reaches it.  No other
block can hold a better document, so the result is that of scoring everything.  Bounds and scores
are sums over (query, posting) pairs in numpy, a block at a time; a block gives back its k best
of each query.  The weights of queries go to the tasks in slices of ``SLICE_PAIRS`` (query, term)
pairs, one search a slice.  Collections are a key: one index, one plan, whatever their number.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType
from pyspark.sql.window import Window

from credalyt.functions.text import TOKENIZERS
from credalyt.operators.pieces import pieces
from credalyt.sources.folders import exists, saved, work_folder

BLOCK_DOCS = 16
GROUP_BYTES = 16 << 20
SLICE_PAIRS = 500_000
#: Up to here the terms of a search are written into the scan's filter
LITERAL_TERMS = 1000
#: So many blocks share a call when bounds are taken
CHUNK = 64
#: Sums in another order differ in their last digits: scores that agree in so many digits tie
DIGITS = 8
ENTRY = "term string, collection string, block long, n int, total long, ids array<{0}>, tfs array<int>, dls array<int>, frontier array<struct<dl int, tf int>>"


def idf(n: Column, df: Column, variant: str) -> Column:
    if variant == "okapi":
        return F.log(n - df + 0.5) - F.log(df + 0.5)
    smooth = F.log((n - df + 0.5) / (df + 0.5) + 1)
    return F.greatest(smooth, F.lit(0.1)) if variant == "smooth_floor" else smooth


def term_score(tf: Column, dl: Column, avgdl: Column, k1: float, b: float) -> Column:
    return tf * F.lit(k1 + 1) / (tf + F.lit(k1) * (F.lit(1 - b) + F.lit(b) * dl / avgdl))


def asked_terms(queries: DataFrame, tokenizer: str) -> DataFrame:
    """(query_id, term, times)"""
    return queries.select("query_id", F.explode(TOKENIZERS[tokenizer](F.coalesce("text", F.lit("")))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))


def _lists(ends: np.ndarray, *values: pa.Array) -> list[pa.ListArray]:
    return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), v) for v in values]


def packed(docs: pa.RecordBatch, first_block: int, block_docs: int) -> tuple[pa.Table, int]:
    """Entries of documents (collection, id, tokens), and how many blocks there are."""
    dl = pc.fill_null(pc.list_value_length(docs["tokens"]), 0).to_numpy().astype(np.int64)
    names = pc.rank(docs["collection"], tiebreaker="dense", null_placement="at_start").to_numpy().astype(np.int64)
    order = np.lexsort((dl, names))
    fresh = np.r_[True, np.diff(names[order]) != 0]
    start = np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))
    cut = fresh | ((np.arange(len(order)) - start) % block_docs == 0)
    block, place = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
    block[order], place[order] = np.cumsum(cut) - 1, np.arange(len(order))
    words = pc.list_flatten(docs["tokens"]).dictionary_encode()
    code, n_words = words.indices.to_numpy().astype(np.int64), max(len(words.dictionary), 1)
    doc = np.repeat(np.arange(len(dl)), dl)
    keys, tf = np.unique((block[doc] * n_words + code) * len(dl) + place[doc], return_counts=True)
    row, group = order[keys % len(dl)], keys // len(dl)
    begins = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(keys) else np.empty(0, np.int64)
    ends = np.r_[begins, len(keys)]
    # documents of a block stand by length: a pair stays if it has more tf than all before it in its group
    most = int(tf.max()) + 1 if len(tf) else 1
    tall = np.repeat(np.arange(len(begins)), np.diff(ends)) * most + tf
    kept = np.r_[True, tall[1:] > np.maximum.accumulate(tall)[:-1]] if len(keys) else np.empty(0, bool)
    pairs = pa.StructArray.from_arrays([pa.array(dl[row[kept]], pa.int32()), pa.array(tf[kept], pa.int32())], ["dl", "tf"])
    term, at = group[begins] % n_words, group[begins] // n_words
    ids, tfs, dls = _lists(ends, docs["id"].take(pa.array(row)), pa.array(tf, pa.int32()), pa.array(dl[row], pa.int32()))
    table = pa.table({
        "term": words.dictionary.take(pa.array(term)), "collection": docs["collection"].take(pa.array(row[begins])), "block": pa.array(at + first_block), "n": pa.array(np.diff(ends), pa.int32()),
        "total": pa.array(np.add.reduceat(tf, begins) if len(begins) else np.empty(0, np.int64), pa.int64()), "ids": ids, "tfs": tfs, "dls": dls, "frontier": _lists(np.r_[0, np.cumsum(kept)][ends], pairs)[0],
    })
    return table, int(cut.sum())


@dataclass
class Weights:
    """What the queries of a slice give each (collection, term): query numbers and weights, in rows of a table."""

    n_queries: int
    at: dict[tuple[str | None, str], int]
    begins: np.ndarray
    queries: np.ndarray
    weights: np.ndarray
    avgdl: dict[str | None, float]

    @staticmethod
    def of(known: list, times: dict[str, list], n_queries: int) -> Weights:
        """From (collection, term, idf, avgdl) and, of each term, (query, times)."""
        n = [len(times[r.term]) for r in known]
        pairs = [(q, t * r.idf) for r in known for q, t in times[r.term]]
        at = {(r.collection, r.term): i for i, r in enumerate(known)}
        return Weights(n_queries, at, np.r_[0, np.cumsum(n)].astype(np.int64), np.array([q for q, _ in pairs], np.int64), np.array([w for _, w in pairs], np.float64), {r.collection: r.avgdl for r in known})

    def pairs(self, collection: str | None, terms: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(entry, query, weight) of entries of one collection that have these terms."""
        rows = np.array([self.at.get((collection, t), -1) for t in terms], np.int64)
        entry = np.flatnonzero(rows >= 0)
        lo, hi = self.begins[rows[entry]], self.begins[rows[entry] + 1]
        n = hi - lo
        flat = np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(int(n.sum()))
        return np.repeat(entry, n), self.queries[flat], self.weights[flat]


def _values(lists: pa.ChunkedArray, field: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Flat values and the ends of the lists."""
    ends = np.r_[0, np.cumsum(pc.list_value_length(lists).to_numpy())]
    flat = pc.list_flatten(lists)
    return (pc.struct_field(flat, field) if field else flat).to_numpy().astype(np.float64), ends


_stored: dict[tuple, Index] = {}


@dataclass
class Index:
    spark: SparkSession
    folder: str
    tokenizer: str
    entries: DataFrame
    terms: DataFrame
    stats: DataFrame

    @staticmethod
    def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "word", collection: str | None = None, folder: str | None = None, block_docs: int = BLOCK_DOCS) -> Index:
        """Index of documents; of each value of ``collection`` on its own if given.  Null texts are empty."""
        spark = docs.sparkSession
        folder = folder or work_folder(spark, "bm25")
        named = (F.col(collection).cast("string") if collection else F.lit("")).alias("collection")
        rows = docs.select(named, F.col(id_col).alias("id"), TOKENIZERS[tokenizer](F.coalesce(F.col(text_col), F.lit(""))).alias("tokens"))

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = TaskContext.get().partitionId() << 40
            for b in pieces(batches):
                table, n = packed(b, block, block_docs)
                block += n
                yield from table.to_batches(max_chunksize=100_000)

        entry = rows.mapInArrow(pack, ENTRY.format(rows.schema["id"].dataType.simpleString()))
        entries = saved(entry.sortWithinPartitions("term", "collection", "block"), f"{folder}/entries", {"parquet.block.size": GROUP_BYTES})
        terms = saved(entries.groupBy("term", "collection").agg(F.sum("n").alias("df"), F.sum("total").alias("total"), F.max(F.array_max("tfs")).alias("max_tf")).sortWithinPartitions("term"), f"{folder}/terms")
        n_docs = docs.select(named).groupBy(F.col("collection").alias("c")).agg(F.count("*").alias("n_docs"))
        known = terms.join(n_docs, F.col("collection").eqNullSafe(F.col("c"))).groupBy("collection").agg(F.count("*").alias("n_terms"), F.sum("df").alias("n_postings"), F.sum("total").alias("n_tokens"), F.max("max_tf").alias("max_tf"), F.avg(idf(F.col("n_docs"), F.col("df"), "okapi")).alias("mean_idf"))
        full = n_docs.join(known, F.col("collection").eqNullSafe(F.col("c")), "left").select(F.col("c").alias("collection"), "n_docs", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("n_terms", "n_postings", "n_tokens", "max_tf")], (F.coalesce("n_tokens", F.lit(0)) / F.col("n_docs")).alias("avgdl"), "mean_idf")
        return Index(spark, folder, tokenizer, entries, terms, saved(full, f"{folder}/stats"))

    @staticmethod
    def stored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "word", collection: str | None = None) -> Index:
        """The index of these files if this session has built it and they have not changed since, else a new one."""
        spark = docs.sparkSession
        state = docs.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct().collect()  # a row for each file
        key = (spark.sparkContext.applicationId, id_col, text_col, tokenizer, collection, *sorted(map(tuple, state)))
        found = _stored.get(key)
        if found is None or not exists(spark, f"{found.folder}/stats/_SUCCESS"):
            found = _stored[key] = Index.build(docs, id_col, text_col, tokenizer, collection)
        return found

    @staticmethod
    def open(spark: SparkSession, folder: str, tokenizer: str = "word") -> Index:
        """An index that was built before."""
        return Index(spark, folder, tokenizer, *[spark.read.parquet(f"{folder}/{t}") for t in ("entries", "terms", "stats")])

    def weights(self, variant: str = "okapi") -> DataFrame:
        """(term, collection, df, idf, avgdl); negative idf of ``okapi`` become a quarter of the mean idf."""
        s = self.stats.select(F.col("collection").alias("c"), "n_docs", "avgdl", "mean_idf")
        raw = idf(F.col("n_docs"), F.col("df"), variant)
        floored = F.when(raw < 0, F.col("mean_idf") * 0.25).otherwise(raw) if variant == "okapi" else raw
        avgdl = F.greatest("avgdl", F.lit(1.0)) if variant == "smooth_floor" else F.col("avgdl")
        return self.terms.join(s, F.col("collection").eqNullSafe(F.col("c"))).select("term", "collection", "df", floored.alias("idf"), avgdl.alias("avgdl"))

    def scores(self, queries: DataFrame, variant: str = "okapi", k1: float = 1.5, b: float = 0.75) -> DataFrame:
        """(query_id, collection, doc_id, score) of every document that shares a term with a query (query_id, text).

        A document's postings meet in its block, packed: entries are shuffled once, by block, and the
        (query, posting) pairs that they give are summed where they are.  Rows that share an id and are in
        different blocks are documents of their own, as in ``search``."""
        asked = asked_terms(queries, self.tokenizer)
        w = asked.join(self.weights(variant), "term").select("query_id", "collection", F.col("term").alias("t"), (F.col("times") * F.col("idf")).alias("weight"), "avgdl")
        w = saved(w, f"{work_folder(self.spark, 'bm25-scores')}/weights")
        if not w.offset(SLICE_PAIRS).isEmpty():
            return self._summed(self.entries, w, k1, b)  # too many to send: pairs meet by term and again by block
        known = F.broadcast(w.select("t").distinct())
        mine = self.entries.join(known, F.col("term") == F.col("t"), "left_semi").select("term", "collection", "block", "ids", "tfs", "dls").repartition("collection", "block")
        return self._summed(mine, F.broadcast(w), k1, b)

    def _summed(self, entries: DataFrame, w: DataFrame, k1: float, b: float) -> DataFrame:
        met = entries.withColumnRenamed("collection", "c").join(w, (F.col("term") == F.col("t")) & F.col("collection").eqNullSafe(F.col("c")))
        each = met.select("query_id", "c", "block", "weight", "avgdl", F.inline(F.arrays_zip(F.col("ids").alias("doc_id"), F.col("tfs").alias("tf"), F.col("dls").alias("dl"))))
        part = F.col("weight") * term_score(F.col("tf"), F.col("dl"), F.col("avgdl"), k1, b)
        return each.groupBy("query_id", "c", "block", "doc_id").agg(F.sum(part).alias("score")).select("query_id", F.col("c").alias("collection"), "doc_id", "score")

    def search(self, queries: DataFrame, k: int, variant: str = "okapi", k1: float = 1.5, b: float = 0.75, by_collection: bool = False, digits: int = DIGITS, slice_pairs: int = SLICE_PAIRS) -> tuple[DataFrame, DataFrame]:
        """The ``k`` best documents of each query (query_id, text), over all collections or in each:
        (query_id, collection, doc_id, score, rank), ties to the smaller id; and what it took:
        (query_id, [collection,] blocks, blocks_read)."""
        work = work_folder(self.spark, "bm25-search")
        asked = asked_terms(queries, self.tokenizer)
        rows = asked.limit(slice_pairs + 1).collect()
        if len(rows) <= slice_pairs:
            return self._search(rows, asked.schema, k, variant, k1, b, by_collection, digits, f"{work}/0")
        asked = saved(asked, f"{work}/asked")
        slices = -(-asked.count() // slice_pairs)
        hits = report = None
        for i in range(slices):
            part = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(slices)) == i).collect()
            some, took = self._search(part, asked.schema, k, variant, k1, b, by_collection, digits, f"{work}/{i}")
            hits, report = (some, took) if hits is None else (hits.unionByName(some), report.unionByName(took))
        return hits, report

    def _search(self, asked: list, schema: StructType, k: int, variant: str, k1: float, b: float, by_collection: bool, digits: int, work: str) -> tuple[DataFrame, DataFrame]:
        numbers = {q: i for i, q in enumerate(sorted({r.query_id for r in asked}, key=lambda q: (q is not None, q)))}
        times: dict[str, list] = {}
        for r in asked:
            times.setdefault(r.term, []).append((numbers[r.query_id], r.times))
        if len(times) <= LITERAL_TERMS:
            mine, weights = [t.where(F.col("term").isin(list(times))) for t in (self.entries, self.weights(variant))]
        else:
            terms = F.broadcast(self.spark.createDataFrame([(t,) for t in times], "term string"))  # a slice
            mine, weights = [t.join(terms, "term", "left_semi") for t in (self.entries, self.weights(variant))]
        known = sorted(weights.collect(), key=lambda r: (r.collection is not None, r.collection, r.term))  # a slice's terms, once a collection
        shared = self.spark.sparkContext.broadcast(Weights.of(known, times, len(numbers)))
        unit = ["query", "collection"] if by_collection else ["query"]

        def bound(key: tuple, light: pa.Table) -> pa.Table:
            w, name = shared.value, light["collection"][0].as_py()
            blocks, at = np.unique(light["block"].to_numpy(), return_inverse=True)
            (tf, ends), (dl, _) = _values(light["frontier"], "tf"), _values(light["frontier"], "dl")
            part = tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / w.avgdl[name])) if name in w.avgdl else tf
            largest = np.maximum.reduceat(part, ends[:-1])
            entry, query, weight = w.pairs(name, light["term"].to_pylist())
            cell = at[entry] * w.n_queries + query
            total = np.bincount(cell, np.maximum(weight, 0) * largest[entry], len(blocks) * w.n_queries)
            found = np.unique(cell)
            return pa.table({"query": pa.array(found % w.n_queries, pa.int32()), "collection": pa.array([name] * len(found), pa.string()), "block": pa.array(blocks[found // w.n_queries], pa.int64()), "bound": pa.array(total[found], pa.float64())})

        chunk = F.floor(F.col("block") / CHUNK)
        bounds = mine.select("term", "collection", "block", "frontier").groupBy("collection", chunk.alias("chunk")).applyInArrow(bound, "query int, collection string, block long, bound double")
        bounds = saved(bounds, f"{work}/bounds")
        turn = F.row_number().over(Window.partitionBy(*unit).orderBy(F.desc("bound"), "collection", "block"))
        first = bounds.withColumn("turn", turn).where(F.col("turn") <= k).select("query", "collection", "block")
        id_type = self.entries.schema["ids"].dataType.elementType
        kind = f"query int, collection string, doc_id {id_type.simpleString()}, score double"

        def score(key: tuple, entries: pa.Table, needed: pa.Table) -> pa.Table:
            w, name = shared.value, needed["collection"][0].as_py()
            (tf, ends), (dl, _) = _values(entries["tfs"]), _values(entries["dls"])
            part = tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / w.avgdl[name]))
            docs = pc.list_flatten(entries["ids"]).combine_chunks().dictionary_encode("encode")
            doc, n = docs.indices.to_numpy(), len(docs.dictionary)
            order = pc.rank(docs.dictionary, null_placement="at_start").to_numpy()
            entry, query, weight = w.pairs(name, entries["term"].to_pylist())
            wanted = np.isin(query, needed["query"].to_numpy())
            entry, query, weight = entry[wanted], query[wanted], weight[wanted]
            size = np.diff(ends)[entry]
            flat = np.repeat(ends[:-1][entry] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(int(size.sum()))
            cell = np.repeat(query, size) * n + doc[flat]
            total = np.bincount(cell, np.repeat(weight, size) * part[flat], w.n_queries * n)
            found = np.unique(cell)
            q, d, s = found // n, found % n, total[found]
            best = np.lexsort((order[d], -np.round(s, digits), q))
            q, d, s = q[best], d[best], s[best]
            place = np.arange(len(q)) - np.maximum.accumulate(np.where(np.r_[True, q[1:] != q[:-1]], np.arange(len(q)), 0)) if len(q) else q
            q, d, s = q[place < k], d[place < k], s[place < k]
            return pa.table({"query": pa.array(q, pa.int32()), "collection": pa.array([name] * len(q), pa.string()), "doc_id": docs.dictionary.take(pa.array(d)), "score": pa.array(s)})

        def scored(blocks: DataFrame) -> DataFrame:
            at = blocks.select(F.col("collection").alias("c"), F.col("block").alias("at")).distinct()
            read = mine.join(at, F.col("collection").eqNullSafe(F.col("c")) & (F.col("block") == F.col("at")), "left_semi").select("term", "collection", "block", "ids", "tfs", "dls")
            return read.groupBy("collection", "block").cogroup(blocks.groupBy("collection", "block")).applyInArrow(score, kind).withColumn("score", F.round("score", digits))

        def best(rows: DataFrame) -> DataFrame:
            rank = F.row_number().over(Window.partitionBy(*unit).orderBy(F.desc("score"), "doc_id"))
            return rows.withColumn("rank", rank).where(F.col("rank") <= k)

        one = saved(best(scored(first)), f"{work}/one")
        alike = lambda names, other: [F.col(n).eqNullSafe(F.col(f"{other}{n}")) for n in names]
        reach = one.groupBy(*unit).agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
        reach = reach.withColumnsRenamed({u: f"r_{u}" for u in unit})
        met = bounds.join(reach, alike(unit, "r_"), "left").where(F.col("least").isNull() | (F.col("bound") + 10.0**-digits >= F.col("least")))
        cells = ["query", "collection", "block"]
        second = met.join(first.withColumnsRenamed({c: f"f_{c}" for c in cells}), alike(cells, "f_"), "left_anti").select(*cells)
        names = self.spark.createDataFrame([(i, q) for q, i in numbers.items()], StructType([StructField("query", IntegerType()), schema["query_id"]]))  # a slice
        hits = best(one.drop("rank").unionByName(scored(second))).join(F.broadcast(names), "query").select("query_id", "collection", "doc_id", "score", "rank")
        took = bounds.select(*unit, F.lit(0).alias("r")).unionByName(first.select(*unit, F.lit(1).alias("r"))).unionByName(second.select(*unit, F.lit(1).alias("r")))
        report = took.groupBy(*unit).agg(F.count_if(F.col("r") == 0).alias("blocks"), F.sum("r").alias("blocks_read")).join(F.broadcast(names), "query").drop("query")
        return hits, report.select("query_id", *unit[1:], "blocks", "blocks_read")
