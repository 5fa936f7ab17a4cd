"""Approximate nearest neighbours by learned partitions.

1. Fit, on a bounded sample (``max_sample`` rows in hash order): the exact neighbour
   graph of the sample is cut into balanced parts that keep neighbours together (one for
   each ``part_rows`` rows of the table, ``MIN_PARTS`` to ``MAX_PARTS``), and a small classifier (one hidden layer) learns, for a vector, the share
   of its neighbours in each part.
2. Index, all rows: every vector belongs to the part that the classifier finds most
   probable.
3. Search: a query goes to its most probable parts, as many as the sample needed for
   ``target_recall`` (and as many as it takes to hold ``k`` candidates), where it meets
   every row.  Inner products are taken in double precision on the original vectors.

Parts are searched in blocks of at most about ``block_rows`` rows by ``block_queries``
queries, so a part with a third of all rows is many tasks; nothing is capped.

A vector that is null, zero, of a length other than the most frequent one, or with null
or non-finite components takes no part, nor does a row without id.  Of rows that share
an id, the one whose vector has the least hash takes part.  Ties go to the smaller id.
Tables of fewer than ``exact_rows`` rows are searched in all parts.  Other columns are
not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from credalyt.llm.scratch import Plain, Scratch

K, MAX_SAMPLE, TARGET_RECALL = 20, 8192, 0.95
PART_ROWS, MIN_PARTS, MAX_PARTS = 4096, 2, 64
BLOCK_ROWS, BLOCK_QUERIES = 16384, 4096


def neighbour_graph(x: np.ndarray, k: int, block: int = 1024) -> np.ndarray:
    """Indices of the k largest inner products of each row with other rows."""
    k = min(k, len(x) - 1)
    out = np.empty((len(x), k), np.int64)
    for a in range(0, len(x), block):
        s = x[a : a + block] @ x.T
        s[np.arange(len(s)), a + np.arange(len(s))] = -np.inf
        top = np.argpartition(-s, k - 1, axis=1)[:, :k]
        order = np.argsort(-np.take_along_axis(s, top, 1), axis=1, kind="stable")
        out[a : a + block] = np.take_along_axis(top, order, 1)
    return out


def balanced_parts(graph: np.ndarray, x: np.ndarray, parts: int, slack: float = 1.05, sweeps: int = 20, seed: int = 3) -> np.ndarray:
    """A part for each vertex, none above ``slack`` times the mean, with few cut edges.

    Starts from balanced k-means and moves vertices to the part of most neighbours
    while there is room, in the order of what a move gains."""
    n = len(x)
    room = int(np.ceil(n / parts * slack))
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(n, parts, replace=False)].astype(np.float64)
    part = np.zeros(n, np.int64)
    for _ in range(8):
        s = x @ centres.T
        part[:] = -1
        free = np.full(parts, room)
        for choice in range(parts):  # those that want a part most come first
            todo = np.flatnonzero(part < 0)
            if not len(todo):
                break
            open_parts = np.where(free > 0, 0.0, -np.inf)
            best = np.argmax(s[todo] + open_parts, axis=1)
            for p in range(parts):
                want = todo[best == p]
                want = want[np.argsort(-s[want, p], kind="stable")][: free[p]]
                part[want] = p
                free[p] -= len(want)
        for p in range(parts):
            own = x[part == p]
            c = own.mean(axis=0) if len(own) else x[rng.integers(n)]
            centres[p] = c / max(np.linalg.norm(c), 1e-12)
    both = np.concatenate([np.stack([np.repeat(np.arange(n), graph.shape[1]), graph.ravel()], 1), np.stack([graph.ravel(), np.repeat(np.arange(n), graph.shape[1])], 1)])
    for _ in range(sweeps):
        votes = np.bincount(both[:, 0] * parts + part[both[:, 1]], minlength=n * parts).reshape(n, parts)
        gain = votes - votes[np.arange(n), part][:, None]
        best = np.argmax(gain, axis=1)
        best_gain = gain[np.arange(n), best]
        movers = np.flatnonzero(best_gain > 0)
        movers = movers[rng.random(len(movers)) < 0.5]  # neighbours do not swap for ever
        size = np.bincount(part, minlength=parts)
        moved = 0
        for v in movers[np.argsort(-best_gain[movers], kind="stable")]:
            if size[best[v]] < room:
                size[part[v]] -= 1
                size[best[v]] += 1
                part[v] = best[v]
                moved += 1
        if moved < n // 500:
            break
    return part


@dataclass
class Router:
    """The classifier: probabilities of parts for vectors."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int = 0

    def hidden(self, x: np.ndarray) -> np.ndarray:
        unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
        return np.concatenate([unit, np.maximum(unit @ self.w1 + self.b1, 0)], axis=1)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return self.hidden(x) @ self.w2 + self.b2


def learn_router(x: np.ndarray, share: np.ndarray, width: int = 64, rounds: int = 40, batch: int = 256, rate: float = 0.01, seed: int = 5) -> Router:
    """Fit softmax outputs to the shares by Adam on the cross entropy."""
    rng = np.random.default_rng(seed)
    d, m = x.shape[1], share.shape[1]
    p = [rng.normal(0, np.sqrt(2.0), (d, width)), np.zeros(width), np.zeros((d + width, m)), np.zeros(m)]
    first, second, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(rounds):
        order = rng.permutation(len(x))
        for a in range(0, len(x), batch):
            i = order[a : a + batch]
            r = Router(*p)
            h = r.hidden(x[i])
            z = h @ p[2] + p[3]
            q = np.exp(z - z.max(axis=1, keepdims=True))
            q /= q.sum(axis=1, keepdims=True)
            e = (q - share[i]) / len(i)
            back = (e @ p[2].T)[:, d:] * (h[:, d:] > 0)
            grads = [h[:, :d].T @ back, back.sum(0), h.T @ e + 1e-5 * p[2], e.sum(0)]
            step += 1
            for j, g in enumerate(grads):
                first[j] = 0.9 * first[j] + 0.1 * g
                second[j] = 0.999 * second[j] + 0.001 * g * g
                p[j] = p[j] - rate * (first[j] / (1 - 0.9**step)) / (np.sqrt(second[j] / (1 - 0.999**step)) + 1e-8)
    return Router(*p)


def fit(x: np.ndarray, parts: int, k: int = K, target_recall: float = TARGET_RECALL) -> Router:
    """Partition the sample's graph, learn the router on most of it, and choose the number of probes on the rest."""
    x = x.astype(np.float64)
    test = np.zeros(len(x), bool)
    test[:: max(2, len(x) // 1000)] = True
    graph = neighbour_graph(x, k)
    part = balanced_parts(graph[:, :10], x, parts)
    share, near = 0.5 * np.eye(parts)[part], min(10, graph.shape[1])
    for j in range(near):
        share += 0.5 / near * np.eye(parts)[part[graph[:, j]]]
    router = learn_router(x[~test], share[~test])
    own = np.argmax(router.logits(x), axis=1)
    order = np.argsort(-router.logits(x[test]), axis=1)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(parts)[None, :].repeat(len(order), 0), 1)
    needed = np.take_along_axis(place, own[graph[test]], 1)  # probes that reach each true neighbour
    recall = [(needed < p).mean() for p in range(1, parts + 1)]
    router.probes = next((p for p, r in enumerate(recall, 1) if r >= target_recall), parts)
    return router


def usable(vector: Column) -> Column:
    """Not null, not zero, and all components are numbers."""
    ok = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(ok & F.exists(vector, lambda v: v != 0), F.lit(False))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(np.float64) if n else np.empty((0, 0))


def _nearest(rows: pa.Table, queries: pa.Table, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Exactly the k best rows of a block for each query: query ids, row ids, scores."""
    x, ids = _matrix(rows["v"]), rows["id"].to_numpy()
    q, qids = _matrix(queries["v"]), queries["id"].to_numpy()
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    step = max(1, (4 << 20) // max(1, len(x)))
    for a in range(0, len(q), step):
        s = q[a : a + step] @ x.T
        cut = np.partition(s, len(x) - min(len(x), k + 1), axis=1)[:, len(x) - min(len(x), k + 1)]
        for i in range(len(s)):
            # rounding differs between places of a matrix product: keep what may tie, and score alike
            near = np.flatnonzero(s[i] >= cut[i] - 1e-9 * max(1.0, abs(cut[i])))
            near = near[ids[near] != qids[a + i]]
            score = (x[near] * q[a + i]).sum(axis=1)
            best = np.lexsort((ids[near], -score))[:k]
            out.append((np.full(len(best), qids[a + i]), ids[near][best], score[best]))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    return tuple(np.concatenate(c) for c in zip(*out))  # type: ignore[return-value]


def search(df: DataFrame, queries: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, parts: int | None = None, max_sample: int = MAX_SAMPLE, target_recall: float = TARGET_RECALL, block_rows: int = BLOCK_ROWS, block_queries: int = BLOCK_QUERIES, part_rows: int = PART_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row that ``queries`` (a
    condition on column ``id``) selects, among all other rows."""
    scratch = Scratch(df.sparkSession, "ann")
    plain = Plain(df)
    rows = plain.df.select(F.expr(f"try_cast({plain[id_col]} AS BIGINT)").alias("id"), F.col(plain[vector_col]).cast("array<double>").alias("v")).where(F.col("id").isNotNull()).where(usable(F.col("v")))
    rows = rows.groupBy("id").agg(F.min_by("v", F.xxhash64("v")).alias("v"))
    rows = scratch.save(rows)
    result = "query_id long, rank int, vec_id long, score double"
    length = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if length is None:
        return df.sparkSession.createDataFrame([], result)
    rows = rows.where(F.size("v") == length.n)
    n = length["count"]
    parts = 1 if n <= k + 1 else min(n, parts or max(MIN_PARTS, min(MAX_PARTS, n // part_rows)))
    if parts == 1:
        router = None
        sorted_rows = rows.withColumns({"part": F.lit(0), "probes": F.array(F.lit(0))})
    else:
        sample = rows.orderBy(F.xxhash64("id"), "id").limit(max_sample).select("v").toArrow()
        router = fit(_matrix(sample["v"]), parts, k, target_recall)

        def route(batches):
            for b in batches:
                order = np.argsort(-router.logits(_matrix(b.column(1))), axis=1, kind="stable").astype(np.int32)
                probes = pa.FixedSizeListArray.from_arrays(pa.array(order.ravel()), parts).cast(pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(order[:, 0].copy() if len(order) else np.empty(0, np.int32)), probes], names=["id", "v", "part", "probes"])

        sorted_rows = rows.select("id", "v").mapInArrow(route, "id long, v array<double>, part int, probes array<int>")
    indexed = scratch.save(sorted_rows)
    held = {r.part: r["count"] for r in indexed.groupBy("part").count().collect()}  # one number for each part

    asked = indexed.where(queries)
    if router is not None:
        counts = F.array(*[F.lit(held.get(p, 0)).cast("long") for p in range(parts)])
        upto = lambda i: F.aggregate(F.slice("probes", 1, i), F.lit(0).cast("long"), lambda a, p: a + F.element_at(counts, p + 1))
        enough = F.filter(F.sequence(F.lit(1), F.lit(parts)), lambda i: (i >= router.probes) & ((upto(i) > k) | (i == parts)))
        asked = asked.withColumn("probes", F.slice("probes", 1, F.element_at(enough, 1)))
    asked = asked.select("id", "v", F.explode("probes").alias("part"))
    askers = {r.part: r["count"] for r in asked.groupBy("part").count().collect()}
    row_blocks = {p: -(-n // block_rows) for p, n in held.items()}
    query_blocks = {p: -(-n // block_queries) for p, n in askers.items()}
    known = sorted(set(row_blocks) & set(query_blocks))
    if not known:
        return df.sparkSession.createDataFrame([], result)
    blocks = lambda of: F.element_at(F.create_map(*[F.lit(int(x)) for p in known for x in (p, of[p])]), F.col("part"))
    own = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    in_known = F.col("part").isin(known)
    left = indexed.where(in_known).select("id", "v", "part", own(blocks(row_blocks)).alias("rb"), every(blocks(query_blocks)).alias("qb"))
    right = asked.where(in_known).select("id", "v", "part", own(blocks(query_blocks)).alias("qb"), every(blocks(row_blocks)).alias("rb"))

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        q, i, s = _nearest(a, b, k) if a.num_rows and b.num_rows else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(i, pa.int64()), "score": pa.array(s, pa.float64())})

    met = left.groupBy("part", "rb", "qb").cogroup(right.groupBy("part", "rb", "qb")).applyInArrow(meet, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
