"""Exact nearest neighbours of all rows of a table among themselves, by pivots.

Equal vectors are one, with the smallest ids that any answer may need, so copies cost nothing.
Each vector belongs to the cell of its nearest pivot (at most ``PIVOTS`` rows, in hash order).
Round one searches a vector's own cell; its k-th distance there is a bound.  Round two sends the
vector only to cells that the bound reaches: by the triangle inequality no member of a cell of
radius R about pivot p is nearer than d(q, p) - R, nor one at distance r from p nearer than
|d(q, p) - r|.  Cells meet their visitors in blocks of ``BLOCK`` by ``BLOCK`` vectors, so a cell
with a third of all rows is many tasks, and a block gives back the best of each visitor only.

Products of blocks propose, distances summed in the order of the components decide (see
``matrix``).  Ties go to the smaller id.  Vectors that are null, empty, not finite or of another
length than the most frequent one take no part, nor rows without id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from credalyt.operators.matrix import ROUNDING, _matrix, _norms, in_order, usable
from credalyt.sources.folders import saved, work_folder

PIVOTS, BLOCK = 1024, 4096
#: Distances to pivots may be off by so much of the largest norm
SLACK = 1e-7


def _to_pivots(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    d2 = (_norms(x) ** 2)[:, None] - 2 * (x @ pivots.T) + _norms(pivots) ** 2
    return np.sqrt(np.maximum(d2, 0))


def _nearest(visitors: pa.Table, members: pa.Table, k: int) -> pa.Table:
    """(key, other, d) of the k nearest members of each visitor that its bound may admit, and the pairs that were compared."""
    q, x = _matrix(visitors["v"].combine_chunks()), _matrix(members["m_v"].combine_chunks())
    bound, way, r = visitors["bound"].to_numpy(), visitors["way"].to_numpy(), members["m_way"].to_numpy()
    least = pc.rank(members["m_ids"].combine_chunks().flatten().take(pa.array(np.r_[0, np.cumsum(pc.list_value_length(members["m_ids"]).to_numpy())[:-1]])) if members.num_rows else pa.array([], pa.int64())).to_numpy()
    keys, others = visitors["key"].to_numpy(), members["m_key"].to_numpy()
    q_norm, x_norm = _norms(q), _norms(x)
    found, compared = [], np.zeros(len(q), np.int64)
    step = max(1, 2_000_000 // max(len(x), 1))
    for a in range(0, len(q) if len(x) else 0, step):
        part = slice(a, a + step)
        slack = SLACK * (q_norm[part].max() + x_norm.max())
        near = np.abs(way[part, None] - r) <= bound[part, None] + slack
        compared[part] = near.sum(axis=1)
        d2 = (q_norm[part] ** 2)[:, None] - 2 * (q[part] @ x.T) + x_norm**2
        d2[~near] = np.inf
        cut = np.partition(d2, min(k, len(x)) - 1, axis=1)[:, min(k, len(x)) - 1]
        off = ROUNDING * (q_norm[part].max() + x_norm.max()) ** 2
        i, j = np.nonzero((d2 <= (cut + 2 * off)[:, None]) & near)
        d = np.sqrt(in_order(q[a + i], x[j], "l2"))
        order = np.lexsort((least[j], d, i))
        i, j, d = i[order], j[order], d[order]
        fresh = np.r_[True, np.diff(i) != 0] if len(i) else np.empty(0, bool)
        place = np.arange(len(i)) - np.maximum.accumulate(np.where(fresh, np.arange(len(i)), 0)) if len(i) else i
        kept = place < k
        found.append((keys[a + i[kept]], others[j[kept]], d[kept]))
    key, other, d = (np.concatenate(c) for c in zip(*found)) if found else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
    lists = pa.table({"key": pa.array(key, pa.int64()), "other": pa.array(other, pa.int64()), "d": pa.array(d, pa.float64()), "compared": pa.array(np.zeros(len(key), np.int64))})
    counts = pa.table({"key": pa.array(keys, pa.int64()), "other": pa.nulls(len(keys), pa.int64()), "d": pa.nulls(len(keys), pa.float64()), "compared": pa.array(compared)})
    return pa.concat_tables([lists, counts])


def _met(visitors: DataFrame, members: DataFrame, k: int, block: int) -> DataFrame:
    """Cells with their visitors, in blocks."""
    counts = lambda t, name: t.groupBy(F.col("cell").alias("c")).agg(F.ceil(F.count("*") / block).cast("int").alias(name))
    size = counts(members, "m").join(counts(visitors, "n"), "c")  # a row for each pivot
    own = lambda n: F.pmod(F.xxhash64("key"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = lambda t: t.join(F.broadcast(size), F.col("cell") == F.col("c"))
    left = dealt(visitors).select("key", "v", "way", "bound", "cell", own("n").alias("vb"), every("m").alias("mb"))
    right = dealt(members).select("key", "v", "way", "ids", "cell", every("n").alias("vb"), own("m").alias("mb")).toDF(*[f"m_{c}" for c in ("key", "v", "way", "ids", "cell", "vb", "mb")])
    meet = lambda a, b: _nearest(a, b, k)
    by = ["cell", "vb", "mb"]
    return left.groupBy(*by).cogroup(right.groupBy(*[f"m_{c}" for c in by])).applyInArrow(meet, "key long, other long, d double, compared long")


def neighbours(df: DataFrame, id_col: str, vector_col: str, k: int = 5, pivots: int | None = None, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(id, neighbour, rank, d): the k nearest other rows by Euclidean distance; and one row of what it took:
    (vectors, pairs, compared), pairs being all ordered pairs of different vectors."""
    spark = df.sparkSession
    work = work_folder(spark, "neighbours")
    rows = df.where(usable(F.col(vector_col)) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    most = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if most is None:
        kind = df.schema[id_col].dataType.simpleString()
        nothing = spark.createDataFrame([(0, None, 0)], "vectors long, pairs decimal(38,0), compared long")
        return spark.createDataFrame([], f"id {kind}, neighbour {kind}, rank int, d double"), nothing.withColumn("pairs", F.lit(0).cast("decimal(38,0)"))
    rows = rows.where(F.size("v") == most.n)
    some = rows.withColumn("turn", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("turn") <= k + 1)
    alone = some.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    one = saved(alone.withColumn("key", F.monotonically_increasing_id()), f"{work}/vectors")
    n = one.count()
    many = pivots or min(PIVOTS, max(1, int(n**0.5)))
    sample = spark.sparkContext.broadcast(np.array([r.v for r in one.orderBy(F.xxhash64("v"), "key").limit(many).select("v").collect()], np.float64).reshape(min(many, n), -1))

    def cells(batches):
        for b in batches:
            d = _to_pivots(_matrix(b.column(0)), sample.value) if b.num_rows else np.empty((0, 1))
            cell = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32()), pa.array(d[np.arange(len(d)), cell])], names=[*b.schema.names, "cell", "way"])

    kind = one.select("v", "ids", "key").schema.add("cell", "integer").add("way", "double")
    members = saved(one.select("v", "ids", "key").mapInArrow(cells, kind), f"{work}/members")
    radii = {r.cell: r.far for r in members.groupBy("cell").agg(F.max("way").alias("far")).collect()}  # a row for each pivot
    first = saved(_met(members.withColumn("bound", F.lit(float("inf"))), members, k + 1, block), f"{work}/first")
    rank = F.row_number().over(Window.partitionBy("key").orderBy("d", "least"))
    least = members.select(F.col("key").alias("other"), "ids", F.element_at("ids", 1).alias("least"))

    def best(found: DataFrame) -> DataFrame:
        return found.where("other is not null").join(least, "other").withColumn("rank", rank).where(F.col("rank") <= k + 1)

    reach = best(first).groupBy("key").agg(F.when(F.count("*") > k, F.max("d")).alias("bound"))
    reach = members.select("v", "ids", "key", "cell").join(reach, "key", "left").select("v", "key", "cell", F.coalesce("bound", F.lit(float("inf"))).alias("bound"))
    far = np.array([radii.get(i, -np.inf) for i in range(min(many, n))])

    def visits(batches):
        for b in batches:
            x = _matrix(b.column(0))
            d = _to_pivots(x, sample.value) if b.num_rows else np.empty((0, len(far)))
            slack = SLACK * (float(_norms(x).max(initial=0)) + float(_norms(sample.value).max(initial=0)))
            reached = d - far <= b.column(3).to_numpy()[:, None] + slack
            if len(d):
                reached[np.arange(len(d)), b.column(2).to_numpy()] = False  # seen in round one
            i, cell = np.nonzero(reached)
            at = pa.array(i)
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(cell, pa.int32()), b.column(3).take(at), pa.array(d[i, cell])], names=["v", "key", "cell", "bound", "way"])

    kind = reach.select("v", "key", "cell", "bound").schema.add("way", "double")
    visitors = saved(reach.select("v", "key", "cell", "bound").mapInArrow(visits, kind), f"{work}/visitors")
    second = saved(_met(visitors, members, k + 1, block), f"{work}/second")
    near = best(first.unionByName(second))
    ids = near.select("key", "d", F.explode("ids").alias("neighbour"))
    turn = F.row_number().over(Window.partitionBy("key").orderBy("d", "neighbour"))
    lists = ids.withColumn("turn", turn).where(F.col("turn") <= k + 1).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("d", "neighbour"))).alias("near"))
    whole = lists.join(one.select("key", F.col("v").alias("w")), "key")
    out = rows.join(whole, F.col("v") == F.col("w")).select("id", F.posexplode(F.slice(F.filter("near", lambda x: x["neighbour"] != F.col("id")), 1, k)).alias("place", "x"))
    taken = first.unionByName(second).agg(F.coalesce(F.sum("compared"), F.lit(0)).alias("compared"))
    report = taken.select(F.lit(n).cast("long").alias("vectors"), F.lit(n * (n - 1)).cast("decimal(38,0)").alias("pairs"), "compared")
    return out.select("id", F.col("x.neighbour").alias("neighbour"), (F.col("place") + 1).alias("rank"), F.col("x.d").alias("d")), report
