"""Exact vector search by products of matrix blocks.

Queries, a stated set, go to the tasks as a matrix of at most ``SLICE_NUMBERS`` numbers; a larger
set goes in slices, one pass over the documents each.  Documents come in Arrow batches; a batch
times the queries is a block of scores, and a task keeps only the best ``k`` of each query (and
collection), with a threshold that rises from batch to batch.  What a task gives back does not
grow with its rows, and the best of all tasks are ranked by query.

A product of matrices sums in an order of its own, so it only proposes: every pair within its
rounding error of the threshold is scored again, component by component in their order, and
these scores decide.  Equal vectors therefore tie, to the smaller id.

Vectors that are null, empty, hold null or non-finite components, or have another length than the
queries take no part.  A cosine with a zero vector is 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType
from pyspark.sql.window import Window

SLICE_NUMBERS = 4_000_000
#: Scores of a block of documents and all queries of a slice
CELLS = 2_000_000
#: So many products are a task's, at most, where all are results, of so many queries, given out so many at a time:
#: ids of a task take 11 and 14 bits in a columnar file then
TASK_PRODUCTS = 31_000_000
SLICE_ROWS = 1 << 14
OUT = 1 << 18
ROUNDING = 1e-11


def usable(v: Column) -> Column:
    """Whether a vector has components, and all are finite."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(v) > 0) & ~bad, F.lit(False))


def in_order(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """For rows of a and b: inner products, or squared distances for l2, summed in the order of the components."""
    total = np.zeros(len(a))
    for t in range(a.shape[1]):
        total += a[:, t] * b[:, t] if metric != "l2" else (a[:, t] - b[:, t]) ** 2
    return total


def _norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt(in_order(x, x, "dot"))


def _over(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a / b, and 0 where b is 0."""
    return np.divide(a, b, out=np.zeros(np.broadcast(a, b).shape), where=b != 0)


def proposed(q: np.ndarray, x: np.ndarray, q_norm: np.ndarray, x_norm: np.ndarray, metric: str) -> tuple[np.ndarray, float]:
    """Keys of all pairs, larger is nearer, and how far rounding may put them off."""
    s = q @ x.T
    if metric == "cosine":
        return _over(s, q_norm[:, None] * x_norm), ROUNDING
    scale = float(q_norm.max(initial=0)) * float(x_norm.max(initial=0))
    if metric == "dot":
        return s, ROUNDING * (scale + 1e-300)
    return 2 * s - (q_norm**2)[:, None] - x_norm**2, ROUNDING * (float(q_norm.max(initial=0)) ** 2 + float(x_norm.max(initial=0)) ** 2 + scale)


def decided(q: np.ndarray, x: np.ndarray, q_norm: np.ndarray, x_norm: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Scores of pairs of rows, and their keys."""
    s = in_order(q, x, metric)
    if metric == "l2":
        return 1.0 / (1.0 + np.sqrt(s)), -s
    score = _over(s, q_norm * x_norm) if metric == "cosine" else s
    return score, score


class Best:
    """The k best (score, id) of each query so far, in one collection."""

    def __init__(self, n_queries: int, k: int, ids: pa.DataType):
        self.k = k
        self.query, self.score, self.key = np.empty(0, np.int64), np.empty(0), np.empty(0)
        self.ids = pa.array([], ids)
        self.least = np.full(n_queries, -np.inf)

    def add(self, query: np.ndarray, score: np.ndarray, key: np.ndarray, ids: pa.Array) -> None:
        if not len(query):
            return
        query, score, key = np.r_[self.query, query], np.r_[self.score, score], np.r_[self.key, key]
        ids = pa.concat_arrays([self.ids, ids])
        order = np.lexsort((pc.rank(ids, null_placement="at_start").to_numpy(), -score, query))
        fresh = np.r_[True, np.diff(query[order]) != 0]
        place = np.arange(len(order)) - np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))
        order = order[place < self.k]
        self.query, self.score, self.key, self.ids = query[order], score[order], key[order], ids.take(pa.array(order))
        full = place[place < self.k] == self.k - 1
        self.least[self.query[full]] = self.key[full]


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def slices(queries: DataFrame, vector: str = "embedding", numbers: int = SLICE_NUMBERS, most: int | None = None) -> Iterator[list]:
    """Rows of (query_id, q) of one length each, in parts of about so many numbers, and ``most`` rows, at most."""
    asked = queries.where(usable(F.col(vector))).select("query_id", F.col(vector).cast("array<double>").alias("q"))
    for r in asked.groupBy(F.size("q").alias("n")).count().orderBy("n").collect():  # a row for each length
        parts = max(-(-r["count"] * r.n // numbers), -(-r["count"] // most) if most else 1)
        for i in range(parts):
            part = asked.where(F.size("q") == r.n)
            yield (part if parts == 1 else part.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i)).collect()


def knn(docs: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", per: str | None = None, id_col: str = "vec_id", vector_col: str = "embedding", numbers: int = SLICE_NUMBERS) -> DataFrame:
    """(query_id, [per,] doc_id, score, rank): the k most similar documents of each query (query_id, embedding), or of each collection."""
    d = docs.where(usable(F.col(vector_col))).select(F.col(id_col).alias("doc_id"), F.col(vector_col).alias("v"), *([F.col(per)] if per else []))
    kept = [d.schema[per]] if per else []
    schema = StructType([StructField("query", IntegerType()), *kept, d.schema["doc_id"], StructField("score", DoubleType())])
    spark, out = docs.sparkSession, None
    for rows in slices(queries, numbers=numbers):
        if not rows:
            continue
        shared = spark.sparkContext.broadcast(np.array([r.q for r in rows], np.float64))  # at most `numbers` doubles
        found = d.where(F.size("v") == len(rows[0].q)).mapInArrow(_search(shared, k, metric, per), schema)
        names = spark.createDataFrame([(i, r.query_id) for i, r in enumerate(rows)], StructType([StructField("query", IntegerType()), queries.schema["query_id"]]))
        found = found.join(F.broadcast(names), "query").select("query_id", *([per] if per else []), "doc_id", "score")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = d.select(F.lit(None).cast(queries.schema["query_id"].dataType).alias("query_id"), *([per] if per else []), "doc_id", F.lit(0.0).alias("score")).where("false")
    rank = F.row_number().over(Window.partitionBy("query_id", *([per] if per else [])).orderBy(F.desc("score"), "doc_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k)


def _search(shared, k: int, metric: str, per: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        q_norm = _norms(q)
        best: dict[object, Best] = {}
        for b in batches:
            x, step = _matrix(b.column(1)), max(1, CELLS // len(q))
            groups = pc.dictionary_encode(b.column(2), "encode") if per else None
            for g in range(len(groups.dictionary) if per else 1):
                own = np.flatnonzero(groups.indices.to_numpy() == g) if per else np.arange(len(x))
                name = groups.dictionary[g].as_py() if per else None
                top = best.setdefault(name, Best(len(q), k, b.schema.field(0).type))
                for a in range(0, len(own), step):
                    part = own[a : a + step]
                    xs, n = x[part], _norms(x[part])
                    key, off = proposed(q, xs, q_norm, n, metric)
                    cut = top.least if len(part) < k else np.maximum(top.least, np.partition(key, len(part) - k, axis=1)[:, len(part) - k])
                    i, j = np.nonzero(key >= (cut - 2 * off)[:, None])
                    score, exact = decided(q[i], xs[j], q_norm[i], n[j], metric)
                    top.add(i, score, exact, b.column(0).take(pa.array(part[j])))
        for name, top in best.items():
            columns = [pa.array(top.query, pa.int32()), *([pa.array([name] * len(top.query), b.schema.field(2).type)] if per else []), top.ids, pa.array(top.score)]
            yield pa.RecordBatch.from_arrays(columns, names=["query", *([per] if per else []), "doc_id", "score"])

    return run


def max_sim(docs: DataFrame, queries: DataFrame, k: int, digits: int = 8, numbers: int = SLICE_NUMBERS) -> DataFrame:
    """(query_id, doc_id, score, rank): late interaction of queries (query_id, q) with documents (doc_id, v), both
    arrays of vectors of one length: the sum over a query's vectors of the largest inner product with one of
    the document's.  Scores that agree in ``digits`` tie, to the smaller id.  Rows without vectors take no part."""
    spark, out = docs.sparkSession, None
    whole = lambda v: (F.size(v) > 0) & ~F.exists(v, lambda x: ~usable(x))
    asked = queries.where(F.coalesce(whole(F.col("q")), F.lit(False))).select("query_id", F.col("q").cast("array<array<double>>").alias("q"))
    total = asked.agg(F.sum(F.aggregate("q", F.lit(0).cast("long"), lambda s, x: s + F.size(x)))).first()[0] or 0
    parts = max(1, -(-total // numbers))
    schema = StructType([StructField("query", IntegerType()), docs.schema["doc_id"], StructField("score", DoubleType())])
    d = docs.where(F.coalesce(whole(F.col("v")), F.lit(False))).select("doc_id", F.col("v").cast("array<array<double>>").alias("v"))
    for i in range(parts):
        rows = (asked if parts == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i)).collect()  # at most about `numbers` doubles
        if not rows:
            continue
        shared = spark.sparkContext.broadcast((np.array([x for r in rows for x in r.q]), np.cumsum([0, *(len(r.q) for r in rows[:-1])]), len(rows)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            q, starts, n = shared.value
            best = None
            for b in batches:
                best = best or Best(n, k, b.schema.field(0).type)
                sizes = pc.list_value_length(b.column(1)).to_numpy()
                ends = np.r_[0, np.cumsum(sizes)]
                x = b.column(1).flatten().flatten().to_numpy(zero_copy_only=False).reshape(-1, q.shape[1]) if b.num_rows else np.empty((0, q.shape[1]))
                step = max(1, CELLS // (len(q) * int(sizes.max(initial=1))))
                for a in range(0, b.num_rows, step):
                    z = min(a + step, b.num_rows)
                    each = np.maximum.reduceat(q @ x[ends[a] : ends[z]].T, ends[a:z] - ends[a], axis=1)
                    score = np.round(np.add.reduceat(each, starts, axis=0), digits)
                    cut = best.least if z - a < k else np.maximum(best.least, np.partition(score, z - a - k, axis=1)[:, z - a - k])
                    i, j = np.nonzero(score >= cut[:, None])
                    best.add(i, score[i, j], score[i, j], b.column(0).take(pa.array(a + j)))
            if best:
                yield pa.RecordBatch.from_arrays([pa.array(best.query, pa.int32()), best.ids, pa.array(best.score)], names=["query", "doc_id", "score"])

        names = spark.createDataFrame([(i, r.query_id) for i, r in enumerate(rows)], StructType([StructField("query", IntegerType()), queries.schema["query_id"]]))
        same = d.where(~F.exists("v", lambda x: F.size(x) != len(rows[0].q[0])))
        found = same.mapInArrow(run, schema).join(F.broadcast(names), "query").select("query_id", "doc_id", "score")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = d.select(F.lit(None).cast(queries.schema["query_id"].dataType).alias("query_id"), "doc_id", F.lit(0.0).alias("score")).where("false")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k)


def dealt(rows: DataFrame, n: int, each: int) -> DataFrame:
    """``n`` rows that give ``each`` products a row, in equal parts for all cores: no part has more than about
    ``TASK_PRODUCTS``, or fewer than ``CELLS`` without need, however few files or row groups the rows came in."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    parts = min(-(-n * each // CELLS), max(cores, -(-n * each // TASK_PRODUCTS)))
    return rows.repartition(parts) if parts > 1 else rows


def rounded(q: np.ndarray, x: np.ndarray, digits: int) -> np.ndarray:
    """Inner products of rows of x and rows of q times 10 ** digits, rounded, halves away from zero.  The matrix product
    proposes; within its rounding error of a half, the sum in the order of the components decides."""
    scale = 10.0**digits
    y = x @ q.T * scale
    k, part = np.rint(y), max(1, SLICE_NUMBERS // max(1, x.shape[1]))
    off = ROUNDING * scale * float(_norms(q).max(initial=0)) * float(_norms(x).max(initial=0))
    rows, places = np.nonzero(np.abs(y - k) >= 0.5 - off)
    for at in range(0, len(rows), part):
        row, place = rows[at : at + part], places[at : at + part]
        exact = in_order(x[row], q[place], "dot") * scale
        whole = np.floor(np.abs(exact))
        k[row, place] = np.copysign(whole + (np.abs(exact) - whole >= 0.5), exact)
    return k


def by_size(q: np.ndarray, x: np.ndarray, digits: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, place, s) of all pairs of rows of x and q, s rounded, in the order of its absolute value, then of s: equal
    scores stand side by side, which a columnar file stores as a run.  The smallest, which are the most frequent of
    directions in space, come first and so fill its dictionary.  A pair is one number: score, row, place."""
    low = max(len(q) - 1, 1).bit_length()
    bits = low + max(len(x) - 1, 1).bit_length()
    key, step = np.empty(len(x) * len(q), np.int64), max(1, CELLS // len(q))
    for at in range(0, len(x), step):
        k = rounded(q, x[at : at + step], digits)
        if not np.abs(k).max(initial=0) < 2.0 ** (61 - bits):  # too large, or not finite: as they come
            yield from as_they_come(q, x, digits)
            return
        part = k.astype(np.int64)
        part = np.abs(part) << 1 | (part < 0)
        part <<= bits
        part |= np.arange(at, at + len(part))[:, None] << low
        part |= np.arange(len(q))
        key[at * len(q) : at * len(q) + part.size] = part.ravel()
    key.sort()
    for at in range(0, len(key), OUT):
        part = key[at : at + OUT]
        score = part >> bits
        s = (score >> 1) / 10.0**digits
        yield part >> low & (1 << bits - low) - 1, part & (1 << low) - 1, np.where(score & 1, -s, s)


def as_they_come(q: np.ndarray, x: np.ndarray, digits: int | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, place, s) of all pairs, row by row."""
    step = max(1, CELLS // len(q))
    for at in range(0, len(x), step):
        s = x[at : at + step] @ q.T
        if digits is not None:
            k = rounded(q, x[at : at + step], digits) / 10.0**digits + 0.0  # no negative zero
            s = np.where(np.isfinite(k), k, s)
        row, place = np.divmod(np.arange(s.size), len(q))
        yield at + row, place, s.ravel()


def _blocks(batches: Iterator[pa.RecordBatch], queries: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and vectors of a task's rows, at once if they make about ``TASK_PRODUCTS`` with so many queries."""
    ids, parts, have = [], [], 0
    for b in batches:
        x = _matrix(b.column(1))
        most = max(1, min(TASK_PRODUCTS * 9 // 8 // queries, SLICE_NUMBERS // max(1, x.shape[1])))
        at = 0
        while at < len(x):
            take = min(most - have, len(x) - at)
            ids.append(b.column(0).slice(at, take))
            parts.append(x[at : at + take])
            at, have = at + take, have + take
            if have == most:
                yield pa.concat_arrays(ids), np.concatenate(parts)
                ids, parts, have = [], [], 0
    if have:
        yield pa.concat_arrays(ids), np.concatenate(parts)


def products(a: DataFrame, b: DataFrame, numbers: int = SLICE_NUMBERS, digits: int | None = None) -> DataFrame:
    """(i, j, s): inner products of a stated set (i, v) with all rows (j, w), each of them a row.

    With ``digits`` they are rounded, and the rows of a block come by the size of s (``by_size``): the result has as
    many rows as pairs, so what a row takes in a file is what the query takes of the disk."""
    spark, out, n = a.sparkSession, None, b.count()
    kind = a.select("i").limit(0).toArrow().schema.field("i").type
    schema = StructType([a.schema["i"], b.schema["j"], StructField("s", DoubleType())])
    d = b.where(usable(F.col("w"))).select("j", "w")
    for rows in slices(a.select(F.col("i").alias("query_id"), F.col("v").alias("embedding")), numbers=numbers, most=SLICE_ROWS):
        if not rows:
            continue
        shared = spark.sparkContext.broadcast((pa.array([r.query_id for r in rows], kind), np.array([r.q for r in rows], np.float64)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, q = shared.value
            for ids, x in _blocks(batches, len(q)):
                for row, place, s in as_they_come(q, x, None) if digits is None else by_size(q, x, digits):
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(place)), ids.take(pa.array(row)), pa.array(s)], names=["i", "j", "s"])

        own = dealt(d.where(F.size("w") == len(rows[0].q)), n, len(rows)).select("j", F.col("w").cast("array<double>").alias("w"))
        found = own.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else d.select(F.lit(None).cast(a.schema["i"].dataType).alias("i"), "j", F.lit(0.0).alias("s")).where("false")
