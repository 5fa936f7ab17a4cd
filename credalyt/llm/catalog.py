"""Queries of the training-data operators and, where SQL can express one, its DuckDB form."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credalyt.llm import ann, ballkmeans, blobledger, decontaminate, langid, linededup, merkle, mixing, sharding, simhash, suffixdedup, toxicity, urlfilter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in all documents, digested: words, hit words, items and the verdict."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    found = decontaminate.contamination(docs, items, keep=["doc_id"])
    return found.select(
        "doc_id",
        "n_words",
        decontaminate.n_hit().alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        decontaminate.contaminated().alias("contaminated"),
    )


OP1_SQL = r"""
WITH ascii_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
item_words AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[k : k + least(13, len(w)) - 1], ' ') AS g
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS k FROM item_words WHERE len(w) > 0)),
grams AS (
  SELECT doc_id, k, n, array_to_string(w[k : k + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k
        FROM ascii_words, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
hits AS (SELECT doc_id, k, n, item FROM grams JOIN windows USING (n, g)),
hit_words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM (SELECT DISTINCT doc_id, k, n FROM hits)) GROUP BY doc_id),
hit_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, item FROM hits WHERE item IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM ascii_words LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""


#: Dated entries of the lists that op2 applies: list, verdict, kind, pattern, action, since (days from 2024-01-01).
LIST_ENTRIES = (
    ("spam-hosts", "block", "domain", "spam-farm.example.org", "add", 20),
    ("spam-hosts", "block", "domain", "spam-farm.example.org", "remove", 200),
    ("spam-hosts", "block", "domain", "spam-farm.example.org", "add", 260),
    ("spam-hosts", "block", "domain", "spam-farm.example.com", "add", 45),
    ("spam-hosts", "block", "domain", "spam-farm.example.net", "add", 0),
    ("spam-hosts", "block", "domain", "cheap-pills.example.com", "add", 90),
    ("spam-hosts", "block", "domain", "cheap-pills.example.net", "add", 30),
    ("spam-hosts", "block", "domain", "cheap-pills.example.net", "remove", 150),
    ("gambling", "block", "word", "casino", "add", 60),
    ("gambling", "block", "word", "casino", "remove", 300),
    ("pharmacy", "block", "word", "pills", "add", 120),
    ("languages", "block", "prefix", "tionsh.example.net/es/", "add", 180),
    ("reviewed", "allow", "domain", "blog.cheap-pills.example.net", "add", 100),
    ("reviewed", "allow", "domain", "casino-win.example.org", "add", 10),
    ("reviewed", "allow", "domain", "casino-win.example.org", "remove", 250),
)
_VALUES = ", ".join(f"('{a}', '{b}', '{c}', '{d}', '{e}', {1704067200 + 86400 * f})" for a, b, c, d, e, f in LIST_ENTRIES)
#: The table of pages has no fetch time: seconds of 2024 that follow from the page's id stand for it.
_FETCHED = "1704067200 + (page_id * 7919) % 31622400"


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL against the list entries that were active when it was fetched."""
    entries = spark.sql(f"SELECT list_name, verdict, kind, pattern, action, CAST(since AS BIGINT) AS since FROM VALUES {_VALUES} AS e(list_name, verdict, kind, pattern, action, since)")
    pages = table(spark, sf_dir, "pages").selectExpr("page_id", "url", f"{_FETCHED} AS fetched_at")
    return urlfilter.evaluate(pages, entries, keep=["page_id", "fetched_at"])


OP2_SQL = rf"""
WITH entries(list_name, verdict, kind, pattern, action, since) AS (VALUES {_VALUES}),
valid AS (
  SELECT * FROM (SELECT *, lead(since) OVER (PARTITION BY list_name, kind, pattern ORDER BY since, action, verdict) AS valid_to FROM entries)
  WHERE action = 'add' AND (valid_to IS NULL OR valid_to > since)),
captures AS (
  SELECT page_id, {_FETCHED} AS fetched_at, lower(url) AS url,
    nullif(rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '.'), '') AS host,
    regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)), '/+$', '') || '/' AS path FROM pages),
active AS (
  SELECT page_id, list_name, verdict FROM captures JOIN valid ON since <= fetched_at AND (valid_to IS NULL OR fetched_at < valid_to)
    AND CASE kind WHEN 'domain' THEN host = pattern OR ends_with(host, '.' || pattern)
      WHEN 'prefix' THEN starts_with(host || path, pattern)
      ELSE list_contains(regexp_extract_all(url, '[a-z0-9]+'), pattern) END)
SELECT page_id, fetched_at, host, count(list_name) AS n_active, coalesce(string_agg(DISTINCT list_name, ',' ORDER BY list_name), '') AS lists,
  coalesce(max(CASE WHEN verdict = 'block' THEN 1 ELSE 0 END), 0) > coalesce(max(CASE WHEN verdict = 'allow' THEN 1 ELSE 0 END), 0) AS blocked
FROM captures LEFT JOIN active USING (page_id) GROUP BY page_id, fetched_at, host
"""


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later copies of repeated lines in all documents."""
    found = linededup.without_copies(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    return found.select("doc_id", "n_lines", "n_removed", "n_runs", "longest_run", F.sha2("kept_text", 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER (ORDER BY doc_id) AS d FROM documents),
raw AS (SELECT d, i, l[i] AS line, trim(l[i], chr(32) || chr(9) || chr(13) || chr(11) || chr(12)) AS bare
  FROM (SELECT d, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT d, string_split(text, chr(10)) AS l FROM docs))),
lines AS (SELECT d, i, bare, row_number() OVER (PARTITION BY d ORDER BY i) AS j FROM raw WHERE bare <> ''),
pairs AS (SELECT a.d, a.j, row_number() OVER (PARTITION BY a.bare, b.bare ORDER BY a.d, a.j) AS nth
  FROM lines a JOIN lines b ON a.d = b.d AND b.j = a.j + 1),
singles AS (SELECT d, j, row_number() OVER (PARTITION BY bare ORDER BY d, j) AS nth FROM lines WHERE length(bare) >= 50),
gone AS (SELECT d, j FROM pairs WHERE nth > 1 UNION SELECT d, j + 1 FROM pairs WHERE nth > 1 UNION SELECT d, j FROM singles WHERE nth > 1),
placed AS (SELECT d, j, i, j - row_number() OVER (PARTITION BY d ORDER BY j) AS run FROM gone JOIN lines USING (d, j)),
runs AS (SELECT d, count(*) AS n, min(i) AS lo, max(i) AS hi FROM placed GROUP BY d, run),
stats AS (SELECT d, sum(n) AS n_removed, count(*) AS n_runs, max(n) AS longest FROM runs GROUP BY d),
stays AS (SELECT d, string_agg(line, chr(10) ORDER BY i) AS kept FROM raw r
  WHERE NOT EXISTS (SELECT 1 FROM runs q WHERE q.d = r.d AND r.i BETWEEN q.lo AND q.hi) GROUP BY d)
SELECT doc_id, coalesce((SELECT max(j) FROM lines l WHERE l.d = docs.d), 0) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  coalesce(n_runs, 0) AS n_runs, coalesce(longest, 0) AS longest_run, sha256(coalesce(kept, '')) AS kept_sha256
FROM docs LEFT JOIN stats USING (d) LEFT JOIN stays USING (d)
"""


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of all documents that a 100-byte string seen earlier covers."""
    found = suffixdedup.repeated_substrings(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.select("doc_id", "n_bytes", "n_removed", F.size("removed_spans").cast("long").alias("n_spans"), "kept_sha256")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents, learned from the labelled ones that are not held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    found = toxicity.scored(docs, toxicity.train(docs, labels), keep=["doc_id"])
    return found.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents: words taken of each, and where the curriculum first takes it."""
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), keep=["doc_id"])


OP6_SQL = r"""
WITH docs AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    md5(coalesce(CAST(doc_id AS VARCHAR), '') || ' ' || coalesce(text, '')) AS spread FROM documents),
named AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rn FROM docs GROUP BY source),
weighed AS (SELECT *, CAST((rn - 1) % 3 + 1 AS BIGINT) AS weight, 3 * source_size AS cap FROM named),
sorted AS (
  SELECT *, row_number() OVER o AS k,
    CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
      / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS level
  FROM weighed WINDOW o AS (ORDER BY CAST(cap AS DOUBLE) / weight, rn)),
lowest AS (SELECT k AS first, level AS common FROM sorted WHERE level * weight <= cap ORDER BY k LIMIT 1),
goals AS (
  SELECT source, source_size, CASE WHEN k < first THEN CAST(cap AS DOUBLE) ELSE common * weight END AS target,
    CASE weight WHEN 1 THEN -0.5::DOUBLE WHEN 2 THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS slope FROM sorted, lowest),
asked AS (
  SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS demand FROM goals),
total AS (SELECT CAST(sum(demand) AS BIGINT) AS all_demand, sum(slope * demand) AS sloped FROM asked),
placed AS (
  SELECT d.doc_id, d.size, a.*, t.*,
    CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.spread, d.size ROWS UNBOUNDED PRECEDING) - d.size AS BIGINT) AS before
  FROM docs d JOIN asked a ON d.source IS NOT DISTINCT FROM a.source, total t),
taken AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE demand // source_size * size + greatest(0, least(size, demand % source_size - before)) END AS words,
    CAST(before AS DOUBLE) / CAST(demand AS DOUBLE) AS f FROM placed),
timed AS (
  SELECT *, CASE WHEN slope = 0 THEN f ELSE (sqrt((1 - slope) * (1 - slope) + 4 * slope * f) - (1 - slope)) / (2 * slope) END AS t FROM taken)
SELECT doc_id, size, source_size, target, CAST(words AS BIGINT) AS taken,
  CASE WHEN words > 0 THEN CAST(floor(all_demand * t + sloped * (t * t - t)) AS BIGINT) END AS first_position
FROM timed
"""


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of equal row counts, uniformly shuffled."""
    return sharding.shards(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of all documents, learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    known = langid.profiles(docs.where(~langid.held_out()).select("text", "lang"))
    found = langid.predicted(docs.select("doc_id", "text"), known, keep=["doc_id"])
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash near-duplicates of all documents: fingerprint and component of each."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, keep=["doc_id"])


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors found of every twentieth, among all."""
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all documents, and what each proof says of a row whose length may have been changed."""
    docs = table(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    shown = [F.when(tampered, F.col("n_chars") + 1).otherwise(F.col("n_chars")) if f == "n_chars" else F.col(f) for f in FIELDS]
    rows = docs.withColumn("shown", F.when(tampered, merkle.leaf_digest(shown)))
    found = merkle.manifest(rows, FIELDS, "doc_id", "lang", keep=["doc_id", "shown"])
    found = found.withColumn("folded_root", merkle.folded(F.coalesce("shown", "leaf"), F.col("proof")))
    return found.select("doc_id", "leaf", "subroot", "root", merkle.siblings_digest(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _field_sql(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"


def _leaf_sql(length: str) -> str:
    return "sha256(" + " || ".join(_field_sql(length if f == "n_chars" else f) for f in FIELDS) + ")"


OP11_SQL = rf"""
WITH RECURSIVE checked AS (
  SELECT *, list_reduce(
      flatten(list_transform(range(1, len(CAST(doc_id AS VARCHAR)) + 1), lambda i: [CAST(ascii(CAST(doc_id AS VARCHAR)[i]) AS BIGINT), 0, 0, 0, 0, 0, 0, 0])),
      lambda c, e: xor(xor(c, e) >> 1, (xor(c, e) & 1) * 3988292384), CAST(4294967295 AS BIGINT)) AS crc
  FROM documents),
leaves AS (
  SELECT doc_id, lang, {_leaf_sql("n_chars")} AS leaf, {_leaf_sql("(CASE WHEN xor(crc, 4294967295) % 7 = 0 THEN n_chars + 1 ELSE n_chars END)")} AS shown,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, {_leaf_sql("n_chars")}) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM checked),
nodes(lang, level, pos, n, digest) AS (
  SELECT lang, 0, pos, n, leaf FROM leaves
  UNION ALL SELECT lang, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY lang, level, pos // 2, n),
subroots AS (
  SELECT lang, level AS height, digest AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops(level, pos, n, digest) AS (
  SELECT 0, pos, n, subroot FROM subroots
  UNION ALL SELECT level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY pos)) FROM tops WHERE n > 1 GROUP BY level, pos // 2, n),
steps AS (
  SELECT l.lang, l.pos AS leaf_at, k AS k, b.digest AS sibling, (l.pos >> k) % 2 = 1 AS before
  FROM (SELECT l.lang, l.pos, unnest(range(0, height)) AS k FROM leaves l JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang) l
  LEFT JOIN nodes b ON b.lang IS NOT DISTINCT FROM l.lang AND b.level = l.k AND b.pos = xor(l.pos >> l.k, 1)
  UNION ALL
  SELECT l.lang, l.pos, 1000 + k, t.digest, (l.top >> k) % 2 = 1
  FROM (SELECT l.lang, l.pos, s.pos AS top, unnest(range(0, (SELECT max(level) FROM tops))) AS k FROM leaves l JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang) l
  LEFT JOIN tops t ON t.level = l.k AND t.pos = xor(l.top >> l.k, 1)),
proofs AS (
  SELECT lang, leaf_at, coalesce(string_agg(sibling, '' ORDER BY k), '') AS siblings,
    list(CASE WHEN sibling IS NULL THEN '' WHEN before THEN '<' || sibling ELSE '>' || sibling END ORDER BY k) AS way FROM steps GROUP BY lang, leaf_at),
climbed AS (
  SELECT l.*, coalesce(siblings, '') AS siblings,
    list_reduce(coalesce(way, []), lambda d, s: CASE s[1] WHEN '<' THEN sha256(s[2:] || d) WHEN '>' THEN sha256(d || s[2:]) ELSE sha256(d) END, shown) AS folded_root
  FROM leaves l LEFT JOIN proofs p ON p.lang IS NOT DISTINCT FROM l.lang AND p.leaf_at = l.pos)
SELECT doc_id, leaf, subroot, root, sha256(siblings) AS proof_sha256, folded_root, folded_root = root AS verified
FROM climbed c JOIN subroots s ON c.lang IS NOT DISTINCT FROM s.lang, (SELECT digest AS root FROM tops WHERE n = 1)
"""


def op12_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen clusters of all vectors, with the inertia of each and of all."""
    found = ballkmeans.clusters(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), keep=["vec_id"])
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256).alias("centroid_sha256"))


def _assigned_sql(turn: int) -> str:
    return f"""
a{turn} AS (
  SELECT i, vec_id, v, arg_min(c, d * 64 + c) AS cluster, min(d) AS distance
  FROM (SELECT i, vec_id, v, c, list_sum(list_transform(range(1, 65), lambda j: (v[j] - w[j]) * (v[j] - w[j]))) AS d FROM kept, c{turn}) GROUP BY i, vec_id, v)"""


def _replaced_sql(turn: int) -> str:
    return f"""
s{turn} AS (
  SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS w
  FROM (SELECT cluster, j, sum(v[j]) AS s, count(*) AS n FROM (SELECT cluster, v, unnest(range(1, 65)) AS j FROM a{turn}) GROUP BY cluster, j) GROUP BY cluster),
c{turn + 1} AS (SELECT c, coalesce(s.w, o.w) AS w FROM c{turn} o LEFT JOIN s{turn} s ON s.cluster = o.c)"""


OP12_SQL = f"""
WITH kept AS (
  SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v AS w FROM (SELECT sha256('1:' || vec_id) AS h, v FROM kept WHERE vec_id IS NOT NULL) ORDER BY h, v LIMIT 16),
{",".join(x for t in range(3) for x in (_assigned_sql(t), _replaced_sql(t)))},{_assigned_sql(3)}
SELECT vec_id, CAST(cluster AS INT) AS cluster, CAST(distance AS BIGINT) AS distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(w, ',')) AS centroid_sha256
FROM a3 JOIN c3 ON cluster = c
"""


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents, through a new ledger."""
    found = blobledger.secrets(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])

    def of(*kinds: str):
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    base = of(*[r.kind for r in blobledger.BASE])
    counts = [F.size(of(r.kind)).cast("long").alias(f"n_{r.kind}") for r in blobledger.BASE]
    return found.select("doc_id", *counts, F.sha2(blobledger.listed(base), 256).alias("base_sha256"), blobledger.listed(F.col("spans")).alias("spans"))


def _kind_sql(place: int, rule: blobledger.Rule) -> str:
    pattern = rule.pattern.replace("'", "''").replace("(?<![0-9a-f])", "").replace("\\x20", " ")
    if rule.any_case:  # of ASCII letters only
        pattern = re.sub("(password|passwd|secret|token|api|key)", lambda m: "".join(f"[{c.upper()}{c}]" for c in m[0]), pattern)
    return f"""
  SELECT doc_id, {place} AS place, '{rule.kind}' AS kind, until - len(m) AS start, until AS until FROM (
    SELECT doc_id, unnest(found) AS m, unnest(said) AS said,
      unnest(list_transform(range(1, len(upto) + 1), lambda i: CAST(list_sum(list_transform(upto[:i], lambda x: len(x))) AS BIGINT))) AS until
    FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS found, regexp_extract_all(t, '{pattern}', {rule.group}) AS said, regexp_extract_all(t, '(?s).*?(?:{pattern})') AS upto FROM docs))
  WHERE len(said) >= {rule.least}"""


OP13_SQL = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
spans AS ({" UNION ALL ".join(_kind_sql(i, r) for i, r in enumerate(blobledger.RULES))}),
joined AS (
  SELECT doc_id, count_if(place = 0) AS n_assign, count_if(place = 1) AS n_access, count_if(place = 2) AS n_hex,
    coalesce(string_agg(kind || ':' || start || ':' || until, ',' ORDER BY start, place) FILTER (place < 3), '') AS base,
    string_agg(kind || ':' || start || ':' || until, ',' ORDER BY start, place) AS spans FROM spans GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access, CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN joined USING (doc_id)
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_decontaminate": op1_decontaminate, "op2_url_filter": op2_url_filter, "op3_suffix_dedup": op3_suffix_dedup, "op4_line_dedup": op4_line_dedup, "op5_toxicity": op5_toxicity, "op6_mixing": op6_mixing, "op7_langid": op7_langid, "op8_simhash": op8_simhash, "op9_sharding": op9_sharding, "op10_ann": op10_ann, "op11_merkle": op11_merkle, "op12_ball_kmeans": op12_ball_kmeans, "op13_secrets": op13_secrets}
ORACLES: dict[str, str] = {"op1_decontaminate": OP1_SQL, "op2_url_filter": OP2_SQL, "op4_line_dedup": OP4_SQL, "op6_mixing": OP6_SQL, "op11_merkle": OP11_SQL, "op12_ball_kmeans": OP12_SQL, "op13_secrets": OP13_SQL}
