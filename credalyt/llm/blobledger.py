"""Secret scans with an incremental ledger of blobs.

A text is a blob, named by the SHA-256 of its bytes; a row of the table is a path (or one
historical version of a path) to a blob.  The ledger holds a row for each scan of a blob: which
rules, each with its version, and what they found.  A scan

1. names the blob of every row: (columns, blob), without texts;
2. subtracts the ledger: what is left is the blobs that are new and, for older blobs, the rules
   that are new or have a new version;
3. takes one text for each of these blobs, whichever of its copies, and scans it with just the
   missing rules;
4. appends to the ledger, and joins the findings of the wanted rule versions back to all rows.

Copies are dropped inside the map tasks before the shuffle, so a blob with a third of all rows
costs one row a task.  Blobs with something to do are broadcast up to ``BROADCAST_BLOBS`` names
(32 bytes each); beyond that texts and names meet by blob after copies are dropped.  A ledger is
a folder of tables, one for each scan; a scan that failed leaves no rows, and scanning a blob
again gives the same row, so a repeated one is harmless.

Matches of a rule are leftmost and do not overlap; those whose ``group`` is shorter than
``least`` characters are dropped.  Patterns are ASCII and run on UTF-8 bytes; places are in code
points, the end exclusive.  A null text is an empty one; empty texts have no findings; texts of
any length are scanned whole.  Repeated rows each get the findings; an empty table gives no
rows; other columns are read only if they are kept.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from credalyt.llm.scratch import Plain, Scratch, releasing
from credalyt.sources.folders import exists

BROADCAST_BLOBS = 200_000
SPANS = "array<struct<rule string, start long, end long>>"
_CONTINUATION = bytes(range(0x80, 0xC0))


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` whose ``group`` has at least ``least`` characters."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    any_case: bool = False
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


# The base kinds, then formats that issuers of credentials publish.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    Rule("hex", r"(?<![0-9a-f])[0-9a-f]{16,}", 16),
)
RULES = (
    *BASE,
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40),
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]+", 40),
    Rule("slack", r"xox[abeprs]-[A-Za-z0-9-]+", 20),
)


def matches(text: bytes, rule: Rule, compiled: re.Pattern) -> list[tuple[int, int]]:
    """Spans in code points."""
    found = [m.span() for m in compiled.finditer(text) if len(m.group(rule.group)) >= rule.least]
    if not found or text.isascii():
        return found
    out, at, points = [], 0, 0
    for start, end in found:  # they do not overlap
        points += len(text[at:start].translate(None, _CONTINUATION))
        out.append((points, points + end - start))  # matches are ASCII
        at, points = end, points + end - start
    return out


def blob(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def _scanner(rules: tuple[Rule, ...]):
    def scan(batches):
        compiled = {r.key: (r, re.compile(r.pattern.encode(), re.IGNORECASE if r.any_case else 0)) for r in rules}
        for b in batches:
            texts = b.column(1).cast(pa.large_binary())
            keys = b.column(2).to_pylist()
            spans = []
            for i, wanted in enumerate(keys):
                text = texts[i].as_py()
                spans.append([{"rule": k, "start": s, "end": e} for k in wanted for s, e in matches(text, *compiled[k])])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(spans, pa.list_(pa.struct([("rule", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))], names=["blob", "rules", "spans"])

    return scan


class Ledger:
    """Scans so far, as tables below a folder that the cluster shares: (blob, rules, spans)."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def rows(self) -> DataFrame:
        schema = f"blob binary, rules array<string>, spans {SPANS}"
        if not exists(self.spark, self.folder):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(self.folder)

    def append(self, scans: DataFrame) -> None:
        with releasing(self.spark):
            scans.write.mode("append").parquet(self.folder)


def unseen(names: DataFrame, ledger: Ledger, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, rules): each different blob with the rule versions that have not seen it."""
    wanted = F.array(*[F.lit(r.key) for r in rules])
    blobs = names.select("blob").distinct()
    if not exists(ledger.spark, ledger.folder):
        return blobs.withColumn("rules", wanted)
    seen = ledger.rows().groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("seen"))  # a list for each scan
    left = F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>")))
    return blobs.join(seen, "blob", "left").select("blob", left.alias("rules")).where(F.size("rules") > 0)


def scanned(texts: DataFrame, todo: DataFrame, rules: tuple[Rule, ...], broadcast_blobs: int = BROADCAST_BLOBS) -> DataFrame:
    """Ledger rows of the blobs in ``todo``, one text (blob, text) of each."""
    few = todo.limit(broadcast_blobs + 1).count() <= broadcast_blobs
    one = (texts.join(F.broadcast(todo.select("blob")), "blob", "left_semi") if few else texts).groupBy("blob").agg(F.first("text").alias("text"))
    with_rules = one.join(F.broadcast(todo) if few else todo.hint("shuffle_hash"), "blob")
    return with_rules.select("blob", "text", "rules").mapInArrow(_scanner(rules), f"blob binary, rules array<string>, spans {SPANS}")


def secrets(df: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, ledger: Ledger | None = None, keep: list[str] | None = None, broadcast_blobs: int = BROADCAST_BLOBS) -> DataFrame:
    """``keep`` columns (all), blob and spans: array of (kind, start, end) by start, then in the order of the rules."""
    scratch = Scratch(df.sparkSession, "blobs")
    ledger = ledger or Ledger(df.sparkSession, f"{scratch.root}/ledger")
    plain = Plain(df)
    keep = df.columns if keep is None else keep
    held = list(dict.fromkeys(plain[c] for c in keep))
    text = F.col(plain[text_col])
    names = scratch.save(plain.df.select(*held, blob(text).alias("blob")))
    todo = scratch.save(unseen(names, ledger, rules))
    texts = plain.df.select(blob(text).alias("blob"), F.coalesce(text, F.lit("")).alias("text"))
    ledger.append(scanned(texts, todo, rules, broadcast_blobs))

    order = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.key), F.lit(i))])
    wanted = F.filter("spans", lambda s: s["rule"].isin([r.key for r in rules]))
    hits = ledger.rows().select("blob", wanted.alias("spans")).where(F.size("spans") > 0)
    hits = hits.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"))
    placed = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.element_at(order, s["rule"]).alias("o"), s["end"].alias("end"), F.substring_index(s["rule"], "@", 1).alias("kind"))))
    hits = scratch.save(hits.select(F.col("blob").alias("b"), F.transform(placed, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("spans")))
    out = names.join(hits, F.col("blob") == F.col("b"), "left")
    spans = F.coalesce("spans", F.array().cast("array<struct<kind string, start long, end long>>"))
    return plain.back(out.withColumn("spans", spans), keep, ["blob", "spans"])


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
