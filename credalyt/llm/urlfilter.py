"""URL filters: a temporal join of captures with dated block and allow lists.

A list is a table of dated entries (list_name, verdict, kind, pattern, action, since):
``action`` add puts a pattern on the list from ``since`` on, remove takes it off.  Entries
become validity intervals: an add holds until the next entry of the same list, kind and
pattern (for ever if there is none); at one time remove wins.  A capture is evaluated
as of its fetch time: an entry counts if valid_from <= fetched_at < valid_to.

Kinds: ``domain`` matches a host and all its subdomains, ``prefix`` a host with leading
path segments (pattern ``host/a/b/``), ``word`` a run of [a-z0-9] in the lower-cased URL.
A URL becomes the keys under which an entry can stand (no more labels or segments than
the longest pattern has), and keys meet entries by equality plus the time range.  The
intervals are broadcast only if they are at most ``broadcast_rows``; beyond that the join
is shuffled, with skewed hosts split by adaptive execution.

A capture is blocked if a blocking entry is active and no allowing one.  Nulls: a null
or malformed URL has no host and no keys but its words; a null fetch time meets no
entry; entries with nulls are ignored.  Repeated rows keep one result row each.  Extra
columns pass through; where one has the name of a result column, the result's stays.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from credalyt.llm.scratch import Plain

BROADCAST_ROWS = 200_000
RESULT = ["host", "n_active", "lists", "blocked"]
KINDS = {"domain": "d:", "prefix": "p:", "word": "w:"}
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"


def intervals(entries: DataFrame) -> DataFrame:
    """(key, list_name, verdict, valid_from, valid_to) of entries; valid_to is null if open."""
    e = entries.dropna(subset=["list_name", "verdict", "kind", "pattern", "action", "since"]).select("list_name", "verdict", "kind", F.lower("pattern").alias("pattern"), "action", "since")
    w = Window.partitionBy("list_name", "kind", "pattern").orderBy("since", "action", "verdict")
    e = e.withColumn("valid_to", F.lead("since").over(w)).where("action = 'add'").where("valid_to is null or valid_to > since")
    lead = F.element_at(F.create_map(*(F.lit(x) for kv in KINDS.items() for x in kv)), F.col("kind"))
    return e.select(F.concat(lead, "pattern").alias("key"), "list_name", "verdict", F.col("since").alias("valid_from"), "valid_to").where("key is not null")


def host(url: str) -> Column:
    h = F.rtrim(F.lower(F.regexp_extract(url, HOST, 1)), F.lit("."))
    return F.when(h != "", h)


def keys(url: str, host_col: str, labels: int, segments: int) -> Column:
    """Keys of a URL; an array without repeats."""
    h, none = F.col(host_col), F.array().cast("array<string>")
    parts = F.split(h, r"\.")
    n = F.size(parts)
    domain = F.transform(F.sequence(F.lit(1), F.least(n, F.lit(labels))), lambda i: F.concat(F.lit("d:"), F.array_join(F.slice(parts, n - i + 1, i), ".")))
    segs = F.split(F.regexp_replace(F.lower(F.regexp_extract(url, PATH, 1)), "/+$", ""), "/")
    prefix = F.transform(F.sequence(F.lit(1), F.least(F.size(segs), F.lit(segments))), lambda i: F.concat(F.lit("p:"), h, F.array_join(F.slice(segs, 1, i), "/"), F.lit("/")))
    words = F.transform(F.regexp_extract_all(F.lower(F.col(url)), F.lit("([a-z0-9]+)"), 1), lambda w: F.concat(F.lit("w:"), w))
    found = [F.coalesce(words, none)]
    if labels:
        found.append(F.when(h.isNotNull(), domain).otherwise(none))
    if segments:
        found.append(F.when(h.isNotNull(), prefix).otherwise(none))
    return F.array_distinct(F.concat(*found))


def evaluate(captures: DataFrame, entries: DataFrame, url_col: str = "url", time_col: str = "fetched_at", keep: list[str] | None = None, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``captures`` (or its columns ``keep``) with host, n_active (active entries that match),
    lists (their list names, sorted, comma-joined) and blocked."""
    keep = captures.columns if keep is None else keep
    plain = Plain(captures)
    url, at = plain[url_col], plain[time_col]
    valid = intervals(entries)
    is_kind = lambda k: F.col("key").startswith(KINDS[k])
    depth = valid.agg(
        F.count("*").alias("n"),
        F.max(F.when(is_kind("domain"), F.size(F.split("key", r"\.")))).alias("labels"),
        F.max(F.when(is_kind("prefix"), F.size(F.split("key", "/")) - 1)).alias("segments"),
    ).first()
    rows = plain.df.select(*dict.fromkeys([*(plain[c] for c in keep), url, at])).withColumn("host", host(url))
    # equal URLs fetched at one time have one answer
    asked = rows.select(url, at, "host").where(F.col(at).isNotNull()).distinct() if depth.n else rows.select(url, at, "host").where("false")
    asked = asked.withColumn("key", F.explode(keys(url, "host", depth.labels or 0, depth.segments or 0)))
    valid = F.broadcast(valid) if depth.n <= broadcast_rows else valid
    active = asked.join(valid, "key").where((F.col("valid_from") <= F.col(at)) & (F.col("valid_to").isNull() | (F.col(at) < F.col("valid_to"))))
    found = active.groupBy(url, at).agg(
        F.count("*").alias("n_active"),
        F.array_join(F.array_sort(F.collect_set("list_name")), ",").alias("lists"),
        (F.max(F.when(F.col("verdict") == "block", 1).otherwise(0)) > F.max(F.when(F.col("verdict") == "allow", 1).otherwise(0))).alias("blocked"),
    )
    out = rows.join(found.withColumnsRenamed({url: "u", at: "t"}), rows[url].eqNullSafe(F.col("u")) & (rows[at] == F.col("t")), "left")
    out = out.withColumns({"n_active": F.coalesce("n_active", F.lit(0).cast("long")), "lists": F.coalesce("lists", F.lit("")), "blocked": F.coalesce("blocked", F.lit(False))})
    return plain.back(out, keep, RESULT)
