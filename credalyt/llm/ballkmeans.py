"""Ball k-means on integer vectors, exact: the same clusters as Lloyd's rounds.

Components x become floor(``scale`` * x), x as a double.  The first centroids are the ``k``
vectors with the smallest SHA-256 of ``seed:id``.  Each round assigns every vector to the
nearest centroid (squared Euclidean distance, ties to the smaller number) and replaces every
centroid that has vectors by the floor of their mean, component by component; empty ones stay.
Vectors are assigned once more at the end.

Method.  A cluster is a ball: its centroid and the distance of its farthest member.  When
centroids move, a member's distance to its own centroid is taken first; the radius about the
new centroid is at most the old one plus the move, so centroids farther away than twice that
are no neighbours of the ball and are never looked at.  Neighbours are sorted by distance.
Members nearer to their centroid than half the way to the nearest neighbour are the stable
core: they stay, and nothing else is computed for them.  The others lie in annuli, the n-th
between half the ways to the n-th neighbour and to the one after, and are compared exactly with
the first n neighbours only.  A tie needs a distance of exactly half the way, which counts as
outside the core.  All comparisons are of whole numbers; only the choice of neighbours uses a
rounded radius, and that one is rounded up.

At scale: a round is one map over the vectors with the centroids (k times the length, bounded
by ``MAX_CENTROIDS`` numbers, checked) and one map-side combined sum of k rows; vectors are
never shuffled and no cluster is gathered in a task.  The table of vectors with cluster and
distance is written once a round.

A vector that is null, has another number of components than ``length``, null or non-finite
ones or one that is beyond ``MOST`` in size after scaling (whose squares may not fit a long)
takes no part and gives no row.  Rows without id are assigned but are no first centroids; of
rows that share an id each counts, and equal first centroids leave the later one empty.
Fewer than k vectors give fewer centroids; an empty table gives no rows.  Other columns are
read only if they are kept.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credalyt.llm.scratch import Plain, Scratch

K, ROUNDS, SCALE, LENGTH, SEED = 16, 3, 64, 64, 1
MOST = 1 << 26
MAX_CENTROIDS = 1 << 22
#: Up to here sums of 4,096 products of differences are exact in a double
_SMALL = 1 << 19


def usable(v: Column, length: int) -> Column:
    """Whether all ``length`` components are there and finite."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(v) == length) & ~bad, F.lit(False))


def _squared(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to one centre."""
    if len(x) and max(abs(int(x.max())), abs(int(x.min())), abs(int(centre.max())), abs(int(centre.min()))) < _SMALL and x.shape[1] <= 4096:
        d = x.astype(np.float64) - centre
        return np.einsum("ij,ij->i", d, d).astype(np.int64)
    d = x - centre
    return np.einsum("ij,ij->i", d, d)


@dataclass
class Balls:
    """Centroids and, for each, its neighbours in the order of their distance."""

    centres: np.ndarray
    neighbours: list[np.ndarray]
    ways: list[np.ndarray]  # squared distances to the neighbours

    @staticmethod
    def about(centres: np.ndarray, radii: list[float]) -> Balls:
        """``radii``: no member of a ball is farther from its centre."""
        near, ways = [], []
        for i, c in enumerate(centres):
            d = _squared(centres, c)
            limit = 4 * (radii[i] * (1 + 1e-9) + 1e-6) ** 2
            other = np.array([j for j in range(len(centres)) if j != i and float(d[j]) <= limit], np.int64)
            order = other[np.lexsort((other, d[other]))]
            near.append(order)
            ways.append(d[order])
        return Balls(centres, near, ways)

    def assign(self, x: np.ndarray, cluster: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Nearest centroid of each row, its squared distance, and how many distances it took."""
        out, best, taken = cluster.copy(), np.zeros(len(x), np.int64), len(x)
        for i in np.unique(cluster):
            rows = np.flatnonzero(cluster == i)
            own = _squared(x[rows], self.centres[i])
            # the annulus: how many neighbours are at most twice as far as the centroid itself
            ring = np.searchsorted(self.ways[i], 4 * own, side="right")
            nearest, number = own.copy(), np.full(len(rows), i, np.int64)
            for n in range(int(ring.max()) if len(rows) else 0):
                outer = np.flatnonzero(ring > n)
                j = self.neighbours[i][n]
                d = _squared(x[rows[outer]], self.centres[j])
                taken += len(outer)
                wins = (d < nearest[outer]) | ((d == nearest[outer]) & (j < number[outer]))
                nearest[outer[wins]], number[outer[wins]] = d[wins], j
            out[rows], best[rows] = number, nearest
        return out, best, taken


def _matrix(column: pa.Array, length: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, length)


def clusters(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, rounds: int = ROUNDS, scale: int = SCALE, length: int = LENGTH, seed: int = SEED, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (all), cluster, distance, cluster_inertia, inertia, centroid (array) and
    compared: how many distances the last assignment took in the row's batch, on average."""
    if k * length > MAX_CENTROIDS:
        raise ValueError(f"{k} centroids of {length} numbers are more than {MAX_CENTROIDS} numbers")
    if length * (2 * MOST) ** 2 >= 1 << 62:
        raise ValueError(f"squared distances of {length} components may not fit a long")
    spark = df.sparkSession
    scratch = Scratch(spark, "balls")
    plain = Plain(df)
    keep = df.columns if keep is None else keep
    held = list(dict.fromkeys(plain[c] for c in keep))
    doubles = F.col(plain[vector_col]).cast("array<double>")
    whole = F.transform(doubles, lambda x: F.floor(x * F.lit(float(scale))))
    fits = ~F.exists(doubles, lambda x: F.abs(x * F.lit(float(scale))) >= float(MOST))
    first = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(plain[id_col]).cast("string")), 256)
    rows = plain.df.where(usable(doubles, length)).where(fits).select(*held, whole.alias("v"), first.alias("first"))
    rows = scratch.save(rows)
    begun = rows.where(F.col("first").isNotNull()).orderBy("first", "v").limit(k).select("v").collect()  # k vectors
    results = ["cluster", "distance", "cluster_inertia", "inertia", "centroid", "compared"]
    if not begun:
        # vectors without any id have no first centroid either
        empty = rows.where("false").select(*held, F.lit(0).alias("cluster"), *[F.lit(0).cast("long").alias(c) for c in results[1:4]], F.array().cast("array<long>").alias("centroid"), F.lit(0.0).alias("compared"))
        return plain.back(empty, keep, results)
    centres = np.array([r.v for r in begun], np.int64)
    balls = Balls.about(centres, [math.inf] * len(centres))  # nothing is known yet: all are neighbours
    state = rows.drop("first").withColumns({"cluster": F.lit(0), "distance": F.lit(0).cast("long"), "compared": F.lit(0.0)})

    def moved(balls: Balls):
        def step(batches):
            for b in batches:
                if not b.num_rows:
                    continue
                at = {n: i for i, n in enumerate(b.schema.names)}
                cluster, distance, taken = balls.assign(_matrix(b.column(at["v"]), length), b.column(at["cluster"]).to_numpy().astype(np.int64))
                new = {"cluster": pa.array(cluster.astype(np.int32)), "distance": pa.array(distance), "compared": pa.array(np.full(b.num_rows, taken / b.num_rows))}
                yield pa.RecordBatch.from_arrays([new.get(n, b.column(i)) for n, i in at.items()], schema=b.schema)

        return step

    for turn in range(rounds + 1):
        after = scratch.save(state.mapInArrow(moved(balls), state.schema))
        scratch.drop(state if turn else rows)
        state = after
        wide = [F.sum(F.col("v")[i]).alias(f"s{i}") for i in range(length)] if turn < rounds else []
        found = state.groupBy("cluster").agg(F.count("*").alias("n"), F.max("distance").alias("far"), F.sum(F.col("distance").cast("decimal(38,0)")).alias("inertia"), *wide).collect()  # k rows
        if turn < rounds:
            before, radii = centres, [0.0] * len(centres)
            centres = centres.copy()
            for r in found:
                centres[r.cluster] = [int(r[f"s{i}"]) // r.n for i in range(length)]
                way = int(_squared(before[r.cluster : r.cluster + 1], centres[r.cluster])[0])
                radii[r.cluster] = math.sqrt(r.far) + math.sqrt(way)
            balls = Balls.about(centres, radii)
    total = sum(int(r.inertia) for r in found)
    text = ", ".join(f"({r.cluster}, {int(r.inertia)}BD, {total}BD, array({', '.join(f'{int(c)}L' for c in centres[r.cluster])}))" for r in found)
    known = spark.sql(f"SELECT CAST(c AS INT) AS number, try_cast(a AS BIGINT) AS cluster_inertia, try_cast(b AS BIGINT) AS inertia, centroid FROM VALUES {text} AS t(c, a, b, centroid)")
    out = state.join(F.broadcast(known), F.col("cluster") == F.col("number"))  # k rows
    return plain.back(out, keep, results)
