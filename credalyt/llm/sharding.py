"""A uniform shuffle into shards of exact size by a hypergeometric communication matrix.

1. Rows are dealt into logical blocks by a hash of id, size and checksum; their number
   grows with the rows (``block_rows`` on average, at least ``MIN_BLOCKS`` blocks).
2. For blocks of n_p rows and shards of m_s rows a matrix of counts is drawn: block
   after block takes its n_p places from all places that are left, a multivariate
   hypergeometric draw, so every assignment of rows to places is equally likely and
   every shard gets exactly its m_s rows.  It needs one count for each block on the
   driver; the matrix goes back as a table of one row a block.
3. Each block is permuted (by a hash with a second seed) and cut as its row of the
   matrix says; the rows travel to their shards.
4. Each shard is permuted again (third seed); ``slot`` is a row's place in it.

A shard is never sorted in one task: its rows are dealt into ranges of the third hash,
as many as ``block_rows`` asks for, and places are offsets of ranges plus ranks inside them.

Law ``rows``: counts of shards are at most one apart.  Given the same rows and seed the
result is the same on every cluster; rows that are equal in id, length and checksum are
interchangeable, and where many of them crowd a block they are numbered and dealt out one by one.  A null text has size 8 and checksum 0, as the empty text; long texts
count whole.  Rows without id and repeated rows are dealt like others.  With fewer rows
than shards some shards are empty, and an empty table gives an empty result.  Extra columns pass through; where one has the
name of a result column, the result's stays.  DataFrame functions only.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from credalyt.llm.scratch import Plain, Scratch

SHARDS, SEED = 24, 20240
#: rows of a block or a range of a shard, the least number of blocks and of ranges, and blocks whose matrix is broadcast
BLOCK_ROWS, MIN_BLOCKS, MIN_RANGES, BROADCAST_BLOCKS = 200_000, 256, 64, 1 << 16
#: more rows of one id, size and checksum than this are dealt out one by one where they crowd a block
COPIES = 100
RESULT = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]


def hypergeometric(rng: random.Random, good: int, bad: int, n: int) -> int:
    """How many of ``n`` draws without replacement are good: inversion outward from the mode."""
    low, high = max(0, n - bad), min(n, good)
    if low == high:
        return low
    lg = math.lgamma
    mode = min(max((n + 1) * (good + 1) // (good + bad + 2), low), high)
    log_p = lg(good + 1) - lg(mode + 1) - lg(good - mode + 1) + lg(bad + 1) - lg(n - mode + 1) - lg(bad - n + mode + 1) + lg(n + 1) + lg(good + bad - n + 1) - lg(good + bad + 1)
    p_up = p_down = p = math.exp(log_p)
    u, up, down = rng.random() - p, mode, mode
    while u > 0 and (up < high or down > low):
        if up < high:
            p_up *= (good - up) * (n - up) / ((up + 1) * (bad - n + up + 1))
            up += 1
            u -= p_up
            if u <= 0:
                return up
        if down > low:
            p_down *= down * (bad - n + down) / ((good - down + 1) * (n - down + 1))
            down -= 1
            u -= p_down
            if u <= 0:
                return down
    return mode


def communication_matrix(block_rows: list[int], shard_rows: list[int], seed: int) -> list[list[int]]:
    """Rows that each block sends to each shard; both margins are exact."""
    rng, left, out = random.Random(seed), list(shard_rows), []
    for n in block_rows:
        row, places = [], sum(left)
        for s, free in enumerate(left):
            places -= free
            x = n if s == len(left) - 1 else hypergeometric(rng, free, places, n)
            row.append(x)
            n -= x
        left = [a - b for a, b in zip(left, row)]
        out.append(row)
    return out


def _spread(seed: int, dealt: bool = False) -> Column:
    own = F.xxhash64("key", "size", "text_crc32", F.lit(seed))
    return F.when(F.col("copy").isNull(), own).otherwise(F.xxhash64("key", "size", "text_crc32", F.lit(seed), "copy")) if dealt else own


def _crowded(counts: dict[int, int], total: int) -> list[int]:
    """Blocks that have far more rows than blocks have by chance: rows of one key, size and checksum are in them."""
    mean = total / max(len(counts), 1)
    return [b for b, n in counts.items() if n > 2 * mean + 1000]


def _with_copies(rows: DataFrame, crowded: list[int], scratch: Scratch) -> DataFrame:
    """``rows`` with ``copy``: the rows of a large group that no hash can tell apart are counted from 0, in any
    order, as they are interchangeable; null for others.  Counts of the group's rows in each partition are summed
    first, so no task sees a whole group; the rows are written before, so all passes see the same partitions."""
    same = ["key", "size", "text_crc32"]
    groups = rows.where(F.col("block").isin(crowded)).groupBy(*same).agg(F.count("*").alias("copies")).where(F.col("copies") > COPIES)
    groups = scratch.save(groups.withColumn("group", F.monotonically_increasing_id())).select(*[F.col(c).alias(f"g_{c}") for c in same], "group")
    on = F.col("key").eqNullSafe(F.col("g_key")) & (F.col("size") == F.col("g_size")) & (F.col("text_crc32") == F.col("g_text_crc32"))
    tagged = scratch.save(rows.withColumn("at", F.monotonically_increasing_id()).join(groups, on, "left").drop(*[f"g_{c}" for c in same]).withColumn("part", F.shiftright("at", 33)))
    counts = tagged.where("group is not null").groupBy("group", "part").agg(F.count("*").alias("n"))
    before = counts.select(F.col("group").alias("o_group"), F.col("part").alias("o_part"), (F.sum("n").over(Window.partitionBy("group").orderBy("part")) - F.col("n")).alias("offset"))
    rank = F.row_number().over(Window.partitionBy("group", "part").orderBy("at"))
    copies = tagged.where("group is not null").withColumn("rank", rank).join(before, (F.col("group") == F.col("o_group")) & (F.col("part") == F.col("o_part")))
    held = [c for c in tagged.columns if c not in ("at", "group", "part")]
    others = tagged.where("group is null").select(*held, F.lit(None).cast("long").alias("copy"))
    return others.unionByName(copies.select(*held, (F.col("offset") + F.col("rank") - 1).alias("copy")))


def _power(n: int, least: int) -> int:
    return max(least, 1 << (max(1, n) - 1).bit_length())


def shards(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_shards: int = SHARDS, block_rows: int = BLOCK_ROWS, seed: int = SEED, keep: list[str] | None = None) -> DataFrame:
    """``df`` (or its columns ``keep``) with size (UTF-8 bytes and 8), text_crc32, law, shard,
    slot (from 0, without gaps) and grown_shard (null: the law is not ``key``)."""
    keep = df.columns if keep is None else keep
    plain = Plain(df)
    spark = df.sparkSession
    held = [plain[c] for c in keep]
    text = F.coalesce(F.col(plain[text_col]).cast("string"), F.lit(""))
    rows = plain.df.select(*held, F.col(plain[id_col]).cast("string").alias("key"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    scratch = Scratch(spark, "shards")
    if text_col not in keep:  # texts are read once
        rows = scratch.save(rows)
    total = rows.count()
    blocks, ranges = _power(total // block_rows, MIN_BLOCKS), _power(total // n_shards // block_rows, MIN_RANGES)
    rows = rows.withColumn("block", F.pmod(_spread(seed), F.lit(blocks)).cast("int"))

    counted = {r.block: r["count"] for r in rows.groupBy("block").count().collect()}  # one number for each block
    dealt = bool(crowded := _crowded(counted, total))
    if dealt:
        rows = _with_copies(rows, crowded, scratch).withColumn("block", F.pmod(_spread(seed, True), F.lit(blocks)).cast("int"))
        counted = {r.block: r["count"] for r in rows.groupBy("block").count().collect()}
    n = [counted.get(b, 0) for b in range(blocks)]
    wanted = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    ends = []
    for row in communication_matrix(n, wanted, seed):
        at = 0
        ends.append(",".join(str(at := at + x) for x in row))
    matrix = spark.range(1).select(F.posexplode(F.split(F.lit(";".join(ends)), ";")).alias("block", "ends")).select("block", F.split("ends", ",").cast("array<bigint>").alias("cuts"))
    matrix = F.broadcast(matrix) if blocks <= BROADCAST_BLOCKS else matrix
    last = ["key", "size", "text_crc32", *(["copy"] if dealt else [])]
    local = Window.partitionBy("block").orderBy(_spread(seed + 1, dealt), *last)
    sent = rows.withColumn("rank", F.row_number().over(local)).join(matrix, "block")
    sent = sent.withColumn("shard", F.size(F.filter("cuts", lambda c: c < F.col("rank"))).cast("int")).drop("cuts", "rank", "block")

    sent = sent.withColumn("mix", _spread(seed + 2, dealt))
    sent = sent.withColumn("range", F.shiftrightunsigned("mix", 64 - int(math.log2(ranges))).cast("int"))
    sizes = sent.groupBy("shard", "range").agg(F.count("*").alias("n"))
    offsets = sizes.withColumn("offset", F.sum("n").over(Window.partitionBy("shard").orderBy("range")) - F.col("n")).drop("n")
    final = Window.partitionBy("shard", "range").orderBy(F.shiftrightunsigned("mix", 1), "mix", *last)
    placed = sent.withColumn("place", F.row_number().over(final)).join(offsets, ["shard", "range"])
    out = placed.withColumns({"slot": (F.col("offset") + F.col("place") - 1).cast("long"), "law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")})
    return plain.back(out, keep, RESULT)
