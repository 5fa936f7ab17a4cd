"""Line dedup: a suffix array over line ids by prefix doubling, and its intervals of common prefixes.

Lines are stripped of blanks (space, tab, carriage return, vertical tab, form feed); lines
that are empty then are left out of the sequences.  The class of a place at length L is the
first place (smaller document id, then line) with the same L lines: the places of one class
are an interval of the suffix array with a common prefix of L lines, named by its first
member instead of its rank.  Lengths double,

    class of length 2L at p = first place with the same (class_L(p), class_L(p + L)),

from one line to ``min_lines`` (the last step may overlap) and from there on.  Places whose
class is theirs alone drop out, so a round touches only what repeats, and the last round is
the logarithm of the longest repeated run.

A place p whose longest interval has an earlier first member q starts a copy of q.  If the
place before p is not a copy of the place before q, the copy is maximal to the left; how far
it goes to the right is the longest common prefix of p and q, which the levels give from the
longest down to one line.  These maximal repeated runs are deleted, and so are lines of at
least ``min_chars`` characters that occur earlier.  Blank lines between two deleted lines go
too; first copies stay.

Classes that hold a large share of all places (a line that a third of all documents has)
are few, at most ``HOT_CLASSES``, and are broadcast to their places; the others are joined.

Null and empty texts have no lines.  Rows whose ids are null or shared are numbered by (id,
text), so of repeated rows one stays whole.  Very long texts are single rows of the last
join and many places before it.  Empty tables give empty results.  Extra columns pass
through; where one has the name of a result column, the result's stays.  DataFrame
functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from credalyt.llm.scratch import Plain, Scratch, numbered

MIN_LINES, MIN_CHARS = 2, 50
#: a class is broadcast from 1 / HOT_CLASSES of all places on (and HOT_PLACES places)
HOT_CLASSES, HOT_PLACES = 4096, 1000
BLANKS = " \t\r\v\f"
RESULT = ["n_lines", "n_removed", "n_runs", "longest_run", "kept_text"]

Levels = list[tuple[int, DataFrame]]


def stripped(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS))


def _lines(docs: DataFrame, text: str, bits: int) -> DataFrame:
    """(pos, chars, h1, h2) of every line that is not blank; pos counts these in their document."""
    split = F.filter(F.transform(F.split(text, "\n", -1), stripped), lambda s: s != "")
    rows = docs.select("key", F.posexplode(split).alias("j", "line"))
    return rows.select((F.shiftleft("key", bits) + F.col("j")).alias("pos"), F.length("line").alias("chars"), F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2"))


def _classes(places: DataFrame, by: list[str], scratch: Scratch) -> DataFrame:
    """(pos, cls) of places that share their columns ``by`` with another, saved."""
    groups = scratch.save(places.groupBy(*by).agg(F.min("pos").alias("cls"), F.count("*").alias("n")).where("n > 1"))
    total = groups.agg(F.sum("n")).first()[0] or 0
    limit = max(HOT_PLACES, total // HOT_CLASSES)
    hot = groups.where(F.col("n") > limit).drop("n")
    rest = [c for c in places.columns if c not in ("pos", *by)]
    out = [places.join(F.broadcast(hot), by).select("pos", "cls", *rest)]  # at most HOT_CLASSES rows
    cold = places.join(F.broadcast(hot.select(*by)), by, "left_anti")
    out.append(cold.join(groups.where(F.col("n") <= limit).drop("n"), by).select("pos", "cls", *rest))
    done = scratch.save(out[0].unionByName(out[1]))
    scratch.drop(groups)
    return done


def _longer(level: DataFrame, by: int, scratch: Scratch) -> DataFrame:
    """Classes of runs that are ``by`` lines longer than those of ``level``."""
    a = level.select("pos", F.col("cls").alias("c1"))
    b = level.select((F.col("pos") - by).alias("pos"), F.col("cls").alias("c2"))
    both = scratch.save(a.join(b, "pos"))
    done = _classes(both, ["c1", "c2"], scratch)
    scratch.drop(both)
    return done


def line_classes(docs: DataFrame, text: str, bits: int, scratch: Scratch, min_lines: int = MIN_LINES) -> Levels:
    """[(L, (pos, cls))] for L = 1, 2, 4, ... up to ``min_lines``, and its doubles while something repeats; L = 1 also has chars."""
    lines = scratch.save(_lines(docs, text, bits))
    levels = [(1, _classes(lines, ["h1", "h2"], scratch))]
    scratch.drop(lines)
    while True:
        length, now = levels[-1]
        step = length if length >= min_lines else min(length, min_lines - length)
        found = _longer(now, step, scratch)
        if found.isEmpty():
            return levels
        levels.append((length + step, found))


def maximal_runs(levels: Levels, bits: int, scratch: Scratch, min_lines: int = MIN_LINES) -> DataFrame:
    """(pos, source, n): later copies of ``min_lines`` lines or more that are maximal to both sides, and where the first copy is."""
    long = [(n, t) for n, t in levels if n >= min_lines]
    if not long:
        return levels[0][1].select("pos", F.col("cls").alias("source"), F.lit(0).cast("long").alias("n")).where("false")
    best = None
    for n, t in long:
        own = t.where("cls < pos").select("pos", F.struct(F.lit(n).cast("long").alias("n"), F.col("cls").alias("source")).alias("at"))
        best = own if best is None else best.unionByName(own)
    copies = best.groupBy("pos").agg(F.max("at").alias("at")).select("pos", "at.source", "at.n")
    before = Window.partitionBy(F.shiftright("pos", bits)).orderBy("pos")
    starts = copies.withColumns({"p": F.lag("pos").over(before), "s": F.lag("source").over(before)})
    follows = F.coalesce((F.col("p") == F.col("pos") - 1) & (F.col("s") == F.col("source") - 1), F.lit(False))
    runs = scratch.save(starts.where(~follows).select("pos", "source", "n", F.col("n").alias("level")))
    for n, t in reversed(levels):  # a run is shorter than twice its level: each lower level is added once or not
        rows = runs.where(F.col("level") > n).select("pos", F.col("pos").alias("start"), F.col("source"), F.col("n").alias("have"))
        ahead = rows.withColumn("pos", F.col("start") + F.col("have")).join(t.select("pos", F.col("cls").alias("c1")), "pos")
        same = ahead.withColumn("pos", F.col("source") + F.col("have")).join(t.select("pos", F.col("cls").alias("c2")), "pos").where("c1 = c2")
        grown = runs.join(same.select(F.col("start").alias("pos"), F.lit(n).cast("long").alias("more")), "pos", "left")
        now = scratch.save(grown.select("pos", "source", (F.col("n") + F.coalesce("more", F.lit(0).cast("long"))).alias("n"), "level"))
        scratch.drop(runs)
        runs = now
    return runs.drop("level")


def removed_runs(levels: Levels, runs: DataFrame, bits: int, min_chars: int = MIN_CHARS) -> DataFrame:
    """(key, start, end): disjoint stretches of deleted lines that are not blank, end exclusive."""
    one = levels[0][1]
    single = one.where((F.col("chars") >= min_chars) & (F.col("cls") < F.col("pos"))).select("pos", F.lit(1).cast("long").alias("n"))
    place = F.col("pos").bitwiseAND((1 << bits) - 1)
    spans = runs.select("pos", "n").unionByName(single).select(F.shiftright("pos", bits).alias("key"), place.alias("start"), (place + F.col("n")).alias("end"))
    spans = spans.groupBy("key", "start").agg(F.max("end").alias("end"))
    order = Window.partitionBy("key").orderBy("start")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = spans.withColumn("new", F.when(F.col("start") <= reach, 0).otherwise(1))
    return fresh.withColumn("run", F.sum("new").over(order)).groupBy("key", "run").agg(F.min("start").cast("int").alias("start"), F.max("end").cast("int").alias("end")).drop("run")


def without_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = MIN_LINES, min_chars: int = MIN_CHARS, keep: list[str] | None = None) -> DataFrame:
    """``df`` (or its columns ``keep``) with n_lines and n_removed (not blank), n_runs
    (stretches of deleted lines), longest_run (lines of the longest one that are not
    blank; else 0) and kept_text."""
    keep = df.columns if keep is None else keep
    plain = Plain(df)
    text = plain[text_col]
    held = [plain[c] for c in keep]
    with Scratch(df.sparkSession, "lines") as scratch:
        docs, bits = numbered(plain.df.select(*dict.fromkeys([plain[id_col], text, *held])), plain[id_col], text, scratch)
        levels = line_classes(docs.select("key", text), text, bits, scratch, min_lines)
        found = removed_runs(levels, maximal_runs(levels, bits, scratch, min_lines), bits, min_chars)
        n = F.col("end") - F.col("start")
        lists = scratch.save(found.groupBy("key").agg(F.sum(n).cast("long").alias("n_removed"), F.count("*").alias("n_runs"), F.max(n).cast("long").alias("longest_run"), F.sort_array(F.collect_list(F.struct("start", "end"))).alias("runs")))
        scratch.drop(*(t for _, t in levels))
    lines = docs.select("key", *held, F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1).alias("lines"))
    both = lines.join(lists.hint("merge"), "key", "left").withColumn("runs", F.coalesce("runs", F.array().cast("array<struct<start:int,end:int>>")))
    places = F.filter(F.transform("lines", lambda x, i: F.when(stripped(x) != "", i)), lambda i: i.isNotNull())
    both = both.withColumn("places", places).withColumn("runs", F.transform("runs", lambda r: F.struct(F.get("places", r["start"]).alias("start"), F.get("places", r["end"] - 1).alias("end"))))
    size = F.size("runs")
    begin = lambda k: F.when(k > 0, F.get("runs", k - 1)["end"] + 1).otherwise(0)
    finish = lambda k: F.when(k < size, F.get("runs", k)["start"]).otherwise(F.size("lines"))
    pieces = F.transform(F.sequence(F.lit(0), size), lambda k: F.slice("lines", begin(k) + 1, finish(k) - begin(k)))
    zero = F.lit(0).cast("long")
    out = both.select(*held, F.size("places").cast("long").alias("n_lines"), *(F.coalesce(c, zero).alias(c) for c in ("n_removed", "n_runs", "longest_run")), F.array_join(F.flatten(pieces), "\n").alias("kept_text"))
    return plain.back(out, keep, RESULT)
