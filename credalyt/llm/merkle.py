"""Merkle manifest of a table: a leaf for each row, a tree for each group, a tree of the groups.

``H`` is the lowercase hex SHA-256 of its inputs, concatenated; digests go in as hex text.
A row's leaf is H of its fields, each as ``-`` if null, else the UTF-8 byte count of its value
as text, ``:`` and the value.  In a group leaves ascend by id (nulls first; rows of one id by
leaf).  While a level has more than one node, every two consecutive ones, or a last one alone,
become their H; what remains is the group's subroot.  Subroots, in the order of groups (null
first, bytewise), give the root in the same way.

Method.  Only (group, id, leaf, row) leaves the scan of the texts.  A range sort numbers the
leaves of each group; aligned blocks of ``2**BLOCK_BITS`` leaves are the units of work.  Inside
a block a postorder recursion returns the digest of each subtree and, while it unwinds, appends
the sibling's digest to the leaves below.  An aligned block's root is a node of the tree, so the
block roots, one row for 4,096, feed another such traversal, until every group has one node and
the subroots one root.  Proofs of upper traversals then come down to the blocks, where the leaf
level is traversed again with them; proofs are never shuffled below that.

At scale: a task holds a block at a time, whatever the size of a group; the sort has the row's
number as its last key, so rows that are equal in all columns are dealt out too; the driver
holds one number for each partition of the sort.

Nulls in any column are hashed as ``-``; a group of one row has its leaf as subroot; a table of
one group has the subroot as root; an empty table gives no rows.  Equal rows have equal
leaves and each its own place, so the rows of the result do not depend on which is first.  Texts
of any length are hashed whole; other columns are read only if they are kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from credalyt.llm.scratch import Plain, Scratch

BLOCK_BITS = 12
STEP = "array<struct<sibling string, before boolean>>"


def leaf_digest(fields: Iterable[Column]) -> Column:
    """H of the fields of a row."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof give."""

    def climb(digest: Column, step: Column) -> Column:
        sibling = F.coalesce(step["sibling"], F.lit(""))  # a last node alone has none
        return F.sha2(F.when(step["before"], F.concat(sibling, digest)).otherwise(F.concat(digest, sibling)), 256)

    return F.aggregate(proof, leaf, climb)


def siblings_digest(proof: Column) -> Column:
    """H of the siblings of a proof, leaf level first."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: s["sibling"]), ""), 256)


def subtree(leaves: list[str], level: int, start: int = 0, proofs: list[list] | None = None) -> str:
    """The node of ``level`` above the leaves from ``start`` on; appends to their proofs while unwinding."""
    if not level:
        return leaves[start]
    half = 1 << (level - 1)
    left = subtree(leaves, level - 1, start, proofs)
    if start + half >= len(leaves):
        for k in range(start, len(leaves)) if proofs is not None else ():
            proofs[k].append((None, False))
        return hashlib.sha256(left.encode()).hexdigest()
    right = subtree(leaves, level - 1, start + half, proofs)
    for k in range(start, min(start + 2 * half, len(leaves))) if proofs is not None else ():
        proofs[k].append((right, False) if k < start + half else (left, True))
    return hashlib.sha256((left + right).encode()).hexdigest()


def _height(total: int, bits: int) -> int:
    """Levels to climb inside a block of a tree with ``total`` nodes at the block's lowest level."""
    return bits if total > 1 << bits else (total - 1).bit_length()


def numbered_in_groups(df: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows (g, id, leaf, row, ...) with ``at``, their place in group g, and ``total``, the rows of the group."""
    order = [F.col("g").asc_nulls_first(), F.col("id").asc_nulls_first(), F.col("leaf"), F.col("row")]
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    put = scratch.save(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()))
    part = F.shiftright("place", 33)
    offset, before = 0, []
    for r in put.groupBy(part.alias("p")).count().orderBy("p").collect():  # a number for each partition
        before.append(F.struct(F.lit(r.p).alias("p"), F.lit(offset).cast("long").alias("o")))
        offset += r["count"]
    if not before:
        return put.withColumns({"at": F.lit(0).cast("long"), "total": F.lit(0).cast("long")}).drop("place", "row")
    known = F.map_from_entries(F.array(*before))
    rows = put.withColumn("at", F.element_at(known, part) + F.col("place").bitwiseAND((1 << 33) - 1))
    groups = scratch.save(rows.groupBy("g").agg(F.min("at").alias("first"), F.count("*").alias("total")).withColumnRenamed("g", "group"))
    placed = rows.join(groups, F.col("g").eqNullSafe(F.col("group")))
    return placed.withColumn("at", F.col("at") - F.col("first")).drop("place", "row", "first", "group")


def climbed(nodes: DataFrame, scratch: Scratch, bits: int = BLOCK_BITS) -> list[DataFrame]:
    """Levels of aligned nodes (g, at, total, leaf) above ``nodes``, one traversal each; the last has a node for each group."""

    def roots(key: tuple, block: pa.Table) -> pa.Table:
        rows = block.sort_by("at")
        total = rows["total"][0].as_py()
        root = subtree(rows["leaf"].to_pylist(), _height(total, bits))
        up = -(-total >> bits) if total > 1 << bits else 1
        return pa.table({"g": pa.array([rows["g"][0].as_py()], pa.string()), "at": pa.array([rows["at"][0].as_py() >> bits], pa.int64()), "total": pa.array([up], pa.int64()), "leaf": [root]})

    levels = [nodes]
    while True:
        below = levels[-1].select("g", "at", "total", "leaf").withColumn("block", F.shiftright("at", bits))
        levels.append(scratch.save(below.groupBy("g", "block").applyInArrow(roots, "g string, at long, total long, leaf string")))
        if not levels[-1].where("total > 1").limit(1).count():
            return levels


def _proved(nodes: DataFrame, above: DataFrame, bits: int, carried: list[str]) -> DataFrame:
    """Nodes with ``proof``: their steps inside the block, then those of the block's root ``above``; and columns that they carry."""
    lower = nodes.select("g", "at", "total", "leaf", *carried, F.shiftright("at", bits).alias("block"))
    upper = above.select("g", F.col("at").alias("block"), "subroot", "root", "proof")
    schema = StructType([*lower.drop("block").schema.fields, *upper.drop("g", "block").schema.fields])
    kinds = to_arrow_schema(schema)

    def steps(key: tuple, block: pa.Table, roots: pa.Table) -> pa.Table:
        rows, root = block.sort_by("at"), roots.to_pylist()[0]
        leaves, proofs = rows["leaf"].to_pylist(), [[] for _ in range(rows.num_rows)]
        subtree(leaves, _height(rows["total"][0].as_py(), bits), 0, proofs)
        rest = [(s["sibling"], s["before"]) for s in root["proof"]]
        siblings, before, ends = [], [], [0]
        for p in proofs:
            p += rest
            siblings += [a for a, _ in p]
            before += [b for _, b in p]
            ends.append(len(before))
        flat = pa.StructArray.from_arrays([pa.array(siblings, pa.string()), pa.array(before, pa.bool_())], ["sibling", "before"])
        proof = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
        n = rows.num_rows
        found = rows.drop_columns("block").append_column("subroot", pa.array([root["subroot"]] * n)).append_column("root", pa.array([root["root"]] * n)).append_column("proof", proof)
        return found.cast(kinds)

    return lower.groupBy("g", "block").cogroup(upper.groupBy("g", "block")).applyInArrow(steps, schema)


def manifest(df: DataFrame, fields: list[str], id_col: str = "doc_id", group_col: str = "lang", keep: list[str] | None = None, bits: int = BLOCK_BITS) -> DataFrame:
    """``keep`` columns (all), leaf, subroot, root and proof: steps from the leaf up, each with the
    sibling's digest, null where a last node stands alone, and whether it comes before."""
    scratch = Scratch(df.sparkSession, "merkle")
    plain = Plain(df)
    keep = df.columns if keep is None else keep
    held = list(dict.fromkeys(plain[k] for k in keep))
    rows = plain.df.select(*held, F.col(plain[group_col]).cast("string").alias("g"), F.col(plain[id_col]).alias("id"), leaf_digest(F.col(plain[f]) for f in fields).alias("leaf"), F.monotonically_increasing_id().alias("row"))
    leaves = scratch.save(numbered_in_groups(scratch.save(rows), scratch))
    levels = climbed(leaves, scratch, bits)
    subroots = levels.pop()

    # the tree of the groups: one node for each, in their order, as one group
    nodes = subroots.select(F.lit(None).cast("string").alias("g"), F.struct(F.col("g").isNotNull(), "g").alias("id"), "leaf", F.lit(0).cast("long").alias("row"), F.col("g").alias("name"))
    top = scratch.save(numbered_in_groups(scratch.save(nodes), scratch).drop("id"))
    upper = climbed(top, scratch, bits)
    proved = upper.pop().select("g", "at", F.col("leaf").alias("subroot"), F.col("leaf").alias("root"), F.array().cast(STEP).alias("proof"))
    for nodes in reversed(upper[1:]):
        proved = scratch.save(_proved(nodes, proved, bits, []))
    named = _proved(top, proved, bits, ["name"])
    proved = scratch.save(named.select(F.col("name").alias("g"), F.lit(0).cast("long").alias("at"), F.col("leaf").alias("subroot"), "root", "proof"))
    for nodes in reversed(levels[1:]):
        proved = scratch.save(_proved(nodes, proved, bits, []))
    return plain.back(_proved(leaves, proved, bits, held), keep, ["leaf", "subroot", "root", "proof"])
