"""Running sums and ranks over a whole table without a window that holds all its rows.

Rows are cut into stretches of the order, at quantiles: of a sketch for numbers and times, of a
sample of the values for texts (so a prefix that all have in common does no harm).  Totals of
stretches are summed first, and windows run inside stretches.  The input is written once as a
table, as it is read for the cuts, the totals and the windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from credalyt.sources.folders import saved, work_folder

STRETCHES = 256
SAMPLE = 32 * STRETCHES


def stretch(df: DataFrame, column: str) -> Column:
    """A value that never falls as the column rises; nulls are below all."""
    kind = df.schema[column].dataType
    if isinstance(kind, (T.NumericType, T.TimestampType, T.DateType)):
        value = F.col(column) if isinstance(kind, T.NumericType) else F.unix_micros(F.col(column).cast("timestamp"))
        cuts = df.agg(F.percentile_approx(value, [i / STRETCHES for i in range(1, STRETCHES)], 10 * STRETCHES)).first()[0]  # at most STRETCHES numbers
        return F.size(F.filter(F.array(*map(F.lit, sorted(set(cuts or [])))), lambda c: c < value)) if cuts else F.lit(0)
    value = F.col(column).cast("string")
    some = df.select(value.alias("v")).where("v is not null").distinct().orderBy(F.xxhash64("v"), "v").limit(SAMPLE).collect()  # at most SAMPLE values
    known = sorted((r.v for r in some), key=lambda v: v.encode())
    cuts = [known[i * len(known) // STRETCHES] for i in range(1, STRETCHES)] if known else []
    return F.size(F.filter(F.array(*map(F.lit, sorted(set(cuts), key=lambda v: v.encode()))), lambda c: c < value)) if cuts else F.lit(0)


def running(df: DataFrame, column: str, sums: dict[str, str], descending: bool = False) -> DataFrame:
    """``df`` with inclusive running sums (new name: summed column) in the order of ``column``."""
    df = saved(df, work_folder(df.sparkSession, "running"))
    rows = df.withColumn("_stretch", F.coalesce(stretch(df, column), F.lit(-1)))
    turn = F.desc if descending else F.asc_nulls_first
    over = Window.orderBy(turn("_stretch")).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("_stretch").agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    before = totals.select(F.col("_stretch").alias("_s"), *[F.coalesce(F.sum(f"_{n}").over(over), F.lit(0)).alias(f"_{n}") for n in sums])
    inside = Window.partitionBy("_stretch").orderBy(turn(column)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.withColumns({n: F.sum(c).over(inside) for n, c in sums.items()}).join(before, F.col("_stretch") == F.col("_s"))
    return out.select(*df.columns, *[(F.col(n) + F.col(f"_{n}")).alias(n) for n in sums])


def ranked(df: DataFrame, column: str, name: str = "_rank") -> DataFrame:
    """``df`` with the place of each row, from 1, in the order of a unique column."""
    rows = running(df.withColumn("_one", F.lit(1).cast("long")), column, {name: "_one"})
    return rows.drop("_one")
