"""Mixing sources to target weights along a time-varying curriculum.

Targets.  Sources in code-point order (null last) weigh 1, 2, 3, repeating.  Together
they take as many words as all documents have; a source takes at most ``most_repeats``
= 3 times its own words, and what it cannot take is shared again by weight.  With
sources sorted by cap over weight the capped ones come first, so running sums give the
common level in closed form.

Takes.  The documents of a source stand in a fixed pseudo-random order (MD5 of the
id and the text).  A source's demand runs over that order, again and again: each whole round takes
every document, the last round takes words until the demand is met.  So a source's
taken words are its target, rounded, and no document exceeds the cap.

Positions.  Over training time t in [0, 1] a source's weight is 1 + a (2 t - 1); the
slope a is -1/2, 0 or 1/2 for weights 1, 2 and 3, so heavy sources come later.  The
share of a source's demand met by time t is the integral t + a (t^2 - t).  A draw that
starts at a share f of its source's demand happens when that integral is f; the
position is the number of words that all sources together have used by then.  Draws
are range-sorted by position.

Running sums inside a source go by bucket (the first hex digits of the MD5, three
and more as the rows grow): bucket totals first, then within buckets, so a source with a third
of all rows is dealt to 4,096 groups and more.

Null or empty texts have size 0 and are taken 0 words; long texts are read whole.  Rows
that share an id, or have none, stand where their texts' hashes put them; rows of one id
and text follow a hash of all their columns, so reruns agree whatever the order of the
input, and rows that are left are equal.  Empty tables give empty results.
Extra columns pass through; where one has the name of a result column, the result's stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from credalyt.llm.scratch import Plain, Scratch

MOST_REPEATS = 3
#: a bucket's rows on average at most: the hex digits of buckets, three at least, grow with the rows
BUCKET_ROWS = 50_000
WEIGHTS = (1, 2, 3)
#: slope of a weight's schedule, by weight
SLOPES = {1: -0.5, 2: 0.0, 3: 0.5}
RESULT = ["size", "source_size", "target", "taken", "first_position"]


def text_size(text: str) -> Column:
    """Words that are not white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def targets(sizes: DataFrame, most_repeats: int = MOST_REPEATS) -> DataFrame:
    """(source, source_size) -> with weight and target; the number of rows is that of the sources."""
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cap = F.lit(most_repeats) * F.col("source_size")
    rows = sizes.withColumn("at", F.row_number().over(by_name)).withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("at") - 1) % len(WEIGHTS) + 1).cast("long"))
    order = Window.orderBy(cap.cast("double") / F.col("weight"), "at")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns(
        {
            "k": F.row_number().over(order),
            "rest": F.sum("source_size").over(everything) - F.coalesce(F.sum(cap).over(before), F.lit(0)),
            "others": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
        }
    ).withColumn("level", F.col("rest").cast("double") / F.col("others").cast("double"))
    rows = rows.withColumn("free", F.col("level") * F.col("weight") <= cap.cast("double"))
    rows = rows.withColumn("first", F.min(F.when(F.col("free"), F.col("k"))).over(everything))
    rows = rows.withColumn("common", F.max(F.when(F.col("k") == F.col("first"), F.col("level"))).over(everything))
    target = F.when(F.col("k") < F.coalesce("first", F.lit(1 << 30)), cap.cast("double")).otherwise(F.col("common") * F.col("weight"))
    return rows.select("source", "source_size", "weight", target.alias("target"))


def _met(share: Column, slope: Column) -> Column:
    """The time at which t + a (t^2 - t) reaches a share."""
    b = 1 - slope
    return F.when(slope == 0, share).otherwise((F.sqrt(b * b + 4 * slope * share) - b) / (2 * slope))


def _sized(plain: Plain, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """Every row with size, source, its place in the pseudo-random order and what decides ties."""
    text = F.coalesce(F.col(plain[text_col]), F.lit(""))
    spread = F.md5(F.concat(F.coalesce(F.col(plain[id_col]).cast("string"), F.lit("")), F.lit(" "), text).cast("binary"))
    src = F.col(plain[source_col]).cast("string")
    rows = plain.df.withColumns({"size": text_size(plain[text_col]), "source": F.coalesce(F.concat(F.lit("s"), src), F.lit("~")), "spread": spread})
    hashed = [c for c in plain.cols() if "map<" not in plain.df.schema[c].dataType.simpleString() and "variant" not in plain.df.schema[c].dataType.simpleString()]
    total, digits = plain.df.count(), 3
    while total > BUCKET_ROWS * 16**digits:
        digits += 1
    return rows.withColumns({"bucket": F.substring("spread", 1, digits), "tie": F.xxhash64(*hashed)})


def _placed(rows: DataFrame, most_repeats: int) -> DataFrame:
    """Sized rows with their source's numbers and where their first draw starts (before)."""
    buckets = rows.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    sizes = buckets.groupBy("source").agg(F.sum("n").alias("source_size"))
    goals = targets(sizes.withColumn("source", F.when(F.col("source") != "~", F.col("source"))), most_repeats)
    goals = goals.withColumns({"source": F.coalesce("source", F.lit("~")), "demand": F.floor(F.col("target") + 0.5).cast("long"), "slope": F.element_at(F.create_map(*(F.lit(x) for kv in SLOPES.items() for x in kv)), F.col("weight").cast("int"))})
    every = Window.partitionBy()
    goals = goals.withColumns({"all_demand": F.sum("demand").over(every), "sloped": F.sum(F.col("slope") * F.col("demand")).over(every)})
    offsets = buckets.withColumn("offset", F.sum("n").over(Window.partitionBy("source").orderBy("bucket")) - F.col("n")).drop("n").join(goals, "source")
    inside = Window.partitionBy("source", "bucket").orderBy("spread", "tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("upto", F.sum("size").over(inside)).join(offsets, ["source", "bucket"])
    return rows.withColumn("before", F.col("offset") + F.col("upto") - F.col("size"))


def _position(start: Column) -> Column:
    """Words that all sources have used when a source's demand reaches ``start``."""
    t = _met(start.cast("double") / F.col("demand").cast("double"), F.col("slope"))
    return F.floor(F.col("all_demand") * t + F.col("sloped") * (t * t - t)).cast("long")


def _rounds() -> Column:
    return F.when(F.col("source_size") > 0, F.expr("demand div source_size")).otherwise(F.lit(0).cast("long"))


def _rest() -> Column:
    """Words of a row that the last round takes."""
    left = F.when(F.col("source_size") > 0, F.col("demand") % F.col("source_size")).otherwise(F.lit(0).cast("long"))
    return F.greatest(F.lit(0).cast("long"), F.least("size", left - F.col("before")))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", most_repeats: int = MOST_REPEATS, keep: list[str] | None = None) -> DataFrame:
    """``df`` (or its columns ``keep``) with size, source_size, target, taken (words, repeats
    counted) and first_position (null if nothing is taken), range-sorted by it."""
    keep = df.columns if keep is None else keep
    plain = Plain(df)
    taken = _rounds() * F.col("size") + _rest()
    rows = _sized(plain, id_col, text_col, source_col)
    if text_col not in keep:  # texts are read once
        held = [plain[c] for c in keep]
        rows = Scratch(df.sparkSession, "mix").save(rows.select(*held, "size", "source", "spread", "bucket", "tie"))
    rows = _placed(rows, most_repeats).withColumn("taken", taken)
    rows = rows.withColumn("first_position", F.when(F.col("taken") > 0, _position(F.col("before"))))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # what is not taken has no position: its MD5 spreads it over ranges
    rows = rows.select(*(plain[c] for c in keep), *RESULT, "spread").repartitionByRange(n, F.col("first_position"), F.col("spread")).sortWithinPartitions("first_position", "spread")
    return plain.back(rows, keep, RESULT)


def draws(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", most_repeats: int = MOST_REPEATS) -> DataFrame:
    """The mix as rows to train on: each document once for each time it is taken, with the
    columns of ``df``, range-sorted by position.

    Documents stay whole: the one that the last round cuts counts if at least half of it is taken."""
    plain = Plain(df)
    rows = _placed(_sized(plain, id_col, text_col, source_col), most_repeats)
    times = (_rounds() + (2 * _rest() >= F.col("size")).cast("long")) * (F.col("size") > 0).cast("long")
    rows = rows.withColumn("round", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(most_repeats).cast("long")))).where(F.col("round") <= times)
    rows = rows.withColumn("position", _position(F.col("before") + (F.col("round") - 1) * F.col("source_size")))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.select(*plain.cols(), "position").repartitionByRange(n, F.col("position")).sortWithinPartitions("position").drop("position").toDF(*plain.names)
