"""Lexical, vector and hybrid retrieval over documents and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credalyt.operators import fusion, lexical, vector
from credalyt.operators.bm25index import Index
from credalyt.sources.tables import table

QUERY = "the and ing that this"
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    """Register a function under its name."""

    def put(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return put


def one_query(spark: SparkSession) -> DataFrame:
    return spark.sql(f"SELECT 0 AS query_id, '{QUERY}' AS text")


def benchmark_queries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def vector_queries(spark: SparkSession, d: str) -> DataFrame:
    """Every twentieth vector asks."""
    return table(spark, d, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


WORD_SQL = "regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}_]+')"


def _bm25_sql(tokens: str, idf: str, asked: str, k: int, floor: bool = False, avgdl: str = "avgdl") -> str:
    quarter = "CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM weights0) ELSE raw END" if floor else "raw"
    return rf"""
WITH docs AS (SELECT doc_id, {tokens.format("text")} AS t FROM documents),
lens AS (SELECT doc_id, len(t) AS dl FROM docs),
stats AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM lens),
post AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM docs) GROUP BY doc_id, term),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
weights0 AS (SELECT term, {idf} AS raw FROM dfs, stats),
weights AS (SELECT term, {quarter} AS idf FROM weights0),
asked0 AS ({asked}),
asked AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({tokens.format("text")}) AS term FROM asked0) GROUP BY query_id, term),
scored AS (
  SELECT query_id, doc_id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / {avgdl}))), 8) AS score
  FROM post JOIN asked USING (term) JOIN weights USING (term) JOIN lens USING (doc_id), stats GROUP BY query_id, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored)
SELECT query_id, doc_id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM ranked WHERE rank <= {k}"""


OKAPI = "ln(n - df + 0.5) - ln(df + 0.5)"
SMOOTH = "ln((n - df + 0.5) / (df + 0.5) + 1)"
ONE = f"SELECT 0 AS query_id, '{QUERY}' AS text"
MANY = "SELECT item_id AS query_id, text FROM benchmark"
ASCII_SQL = "list_transform(regexp_extract_all({0}, '[a-zA-Z0-9]+'), lambda x: lower(x))"
SPACE_SQL = "list_filter(regexp_split_to_array({0}, '[\\s\\x{{0B}}\\x{{1C}}-\\x{{1F}}\\x{{85}}\\p{{Z}}]+'), lambda x: x <> '')"


def _index(spark: SparkSession, d: str, tokenizer: str = "word", collection: str | None = None) -> Index:
    """The stored index of the documents; the first query that needs it builds it."""
    return Index.stored(table(spark, d, "documents"), tokenizer=tokenizer, collection=collection)


def _bm25(spark: SparkSession, d: str, queries: DataFrame, k: int, variant: str = "okapi") -> DataFrame:
    return _index(spark, d, lexical.VARIANTS[variant]).search(queries, k, variant)[0].drop("collection")


def _top(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query(_bm25_sql(WORD_SQL, OKAPI, ONE, 10, floor=True))
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    """Okapi BM25 with the idf floor, one query."""
    return _top(_bm25(spark, d, one_query(spark), 10))


@query(_bm25_sql(WORD_SQL, OKAPI, MANY, 5, floor=True))
def bm25_batch_topk(spark: SparkSession, d: str) -> DataFrame:
    """Okapi BM25 for all benchmark items."""
    return _top(_bm25(spark, d, benchmark_queries(spark, d), 5))


@query(_bm25_sql(ASCII_SQL, f"greatest({SMOOTH}, 0.1)", MANY, 5, avgdl="greatest(avgdl, 1)"))
def bm25_floor_topk(spark: SparkSession, d: str) -> DataFrame:
    """Smooth idf of at least 0.1 over CJK n-grams and ASCII words."""
    return _top(_bm25(spark, d, benchmark_queries(spark, d), 5, "smooth_floor"))


@query(_bm25_sql(SPACE_SQL, SMOOTH, MANY, 5))
def bm25_space_topk(spark: SparkSession, d: str) -> DataFrame:
    """Smooth idf over space-separated tokens."""
    return _top(_bm25(spark, d, benchmark_queries(spark, d), 5, "smooth"))


@query(rf"""
WITH docs AS (SELECT doc_id, {WORD_SQL.format("text")} AS t FROM documents),
asked AS (SELECT DISTINCT item_id AS query_id, unnest({WORD_SQL.format("text")}) AS term FROM benchmark),
post AS (SELECT DISTINCT doc_id, unnest(t) AS term FROM docs)
SELECT query_id, least(5, count(DISTINCT doc_id)) AS n_hits, true AS same_as_all, true AS reads_a_part FROM asked JOIN post USING (term) GROUP BY query_id""")
def bm25_pruning(spark: SparkSession, d: str) -> DataFrame:
    """Whether the pruned search of each benchmark item finds what scoring every document finds, and reads no more blocks than there are."""
    index, asked = _index(spark, d), benchmark_queries(spark, d)
    hits, took = index.search(asked, 5)
    every = lexical.top_k(index.scores(asked).withColumn("score", F.round("score", 8)), 5)
    digest = lambda rows: rows.groupBy("query_id").agg(F.count("*").alias("n_hits"), F.array_sort(F.collect_list(F.struct("rank", "doc_id"))).alias("list"))
    both = digest(hits).join(digest(every).select("query_id", F.col("list").alias("full")), "query_id").join(took, "query_id")
    return both.select("query_id", "n_hits", (F.col("list") == F.col("full")).alias("same_as_all"), (F.col("blocks_read") <= F.col("blocks")).alias("reads_a_part"))


@query(rf"""
WITH docs AS (SELECT doc_id, {WORD_SQL.format("text")} AS t FROM documents),
post AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM docs) GROUP BY doc_id, term)
SELECT (SELECT count(*) FROM docs) AS n, (SELECT round(avg(len(t)), 6) FROM docs) AS avgdl, (SELECT count(*) FROM post) AS n_postings,
  (SELECT count(DISTINCT term) FROM post) AS n_terms, (SELECT CAST(max(tf) AS BIGINT) FROM post) AS max_tf""")
def bm25_index_stats(spark: SparkSession, d: str) -> DataFrame:
    """Size of the inverted index."""
    return _index(spark, d).stats.select(F.col("n_docs").alias("n"), F.round("avgdl", 6).alias("avgdl"), "n_postings", "n_terms", F.col("max_tf").cast("long").alias("max_tf"))


@query(rf"""
WITH docs AS (SELECT doc_id, {WORD_SQL.format("text")} AS t FROM documents),
dfs AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(t) AS term FROM docs) GROUP BY term),
raw AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS w FROM dfs, (SELECT count(*) AS n FROM docs))
SELECT term, df, round(CASE WHEN w < 0 THEN 0.25 * avg(w) OVER () ELSE w END, 6) AS idf FROM raw""")
def term_weights(spark: SparkSession, d: str) -> DataFrame:
    """Document frequency and floored idf of every term."""
    return _index(spark, d).weights("okapi").select("term", "df", F.round("idf", 6).alias("idf"))


@query(rf"""
WITH docs AS (SELECT doc_id, list_filter({WORD_SQL.format("text")}, lambda x: len(x) >= 2) AS w FROM documents),
grams AS (
  SELECT doc_id, unnest(list_concat(w, CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE [] END)) AS term FROM docs),
tf AS (SELECT doc_id, term, count(*) AS tf FROM grams GROUP BY doc_id, term),
voc AS (
  SELECT term, ln((1 + n) / (1 + count(*))) + 1 AS idf FROM tf, (SELECT count(*) AS n FROM docs)
  GROUP BY term, n HAVING count(*) <= 0.95 * n ORDER BY sum(tf) DESC, term LIMIT 500),
weighed AS (SELECT doc_id, term, tf * idf AS w FROM tf JOIN voc USING (term))
SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM weighed""")
def tfidf_weights(spark: SparkSession, d: str) -> DataFrame:
    """TF-IDF of words and pairs, 500 features."""
    return lexical.tfidf(table(spark, d, "documents"), max_features=500).withColumn("weight", F.round("weight", 6))


_DOT = "list_sum(list_transform(range(1, len(a) + 1), lambda i: a[i]::DOUBLE * b[i]::DOUBLE))"
_NORM = "sqrt(list_sum(list_transform({0}, lambda x: x::DOUBLE * x::DOUBLE)))"
_METRIC = {
    "cosine": f"{_DOT} / ({_NORM.format('a')} * {_NORM.format('b')})",
    "dot": _DOT,
    "l2": "1 / (1 + sqrt(list_sum(list_transform(range(1, len(a) + 1), lambda i: (a[i]::DOUBLE - b[i]::DOUBLE) * (a[i]::DOUBLE - b[i]::DOUBLE)))))",
}


def _knn_sql(metric: str, k: int, asked: str = "vec_id % 20 = 0", where: str = "true", after: str = "true", per: str = "") -> str:
    part = "query_id" + (f", {per}" if per else "")
    columns = f"query_id, {per + ', ' if per else ''}doc_id, round(score, 6) AS score, CAST(rank AS INT) AS rank"
    return f"""
WITH pairs AS (SELECT q.vec_id AS query_id, e.vec_id AS doc_id, e.label, q.embedding AS a, e.embedding AS b
  FROM (SELECT * FROM embeddings WHERE {asked}) q, (SELECT * FROM embeddings WHERE {where}) e),
scored AS (SELECT *, {_METRIC[metric]} AS score FROM pairs),
ranked AS (SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY score DESC, doc_id) AS rank FROM scored)
SELECT {columns} FROM ranked WHERE rank <= {k} AND {after}"""


def _knn(spark: SparkSession, d: str, metric: str, k: int, asked: DataFrame | None = None, **more) -> DataFrame:
    hits = vector.knn(table(spark, d, "embeddings"), vector_queries(spark, d) if asked is None else asked, k, metric, **more)
    return hits.withColumn("score", F.round("score", 6))


def _first(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").where("vec_id = 7").select(F.col("vec_id").alias("query_id"), "embedding")


@query(_knn_sql("cosine", 10, "vec_id = 7"))
def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    """Nearest by cosine."""
    return _knn(spark, d, "cosine", 10, _first(spark, d))


@query(_knn_sql("l2", 10, "vec_id = 7"))
def l2_topk(spark: SparkSession, d: str) -> DataFrame:
    """Nearest by distance, as similarity."""
    return _knn(spark, d, "l2", 10, _first(spark, d))


@query(_knn_sql("dot", 10, "vec_id = 7"))
def dot_topk(spark: SparkSession, d: str) -> DataFrame:
    """Largest inner products."""
    return _knn(spark, d, "dot", 10, _first(spark, d))


@query(_knn_sql("cosine", 5))
def knn_batch(spark: SparkSession, d: str) -> DataFrame:
    """Nearest of a set of queries."""
    return _knn(spark, d, "cosine", 5)


@query(_knn_sql("cosine", 3, per="label"))
def knn_by_collection(spark: SparkSession, d: str) -> DataFrame:
    """Three nearest in each collection (label)."""
    return _knn(spark, d, "cosine", 3, per="label")


@query(f"""
WITH per AS ({_knn_sql("cosine", 3, per="label")}),
best AS (SELECT query_id, label, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM per)
SELECT query_id, label, doc_id, score, CAST(rank AS INT) AS rank FROM best WHERE rank <= 5""")
def knn_merged(spark: SparkSession, d: str) -> DataFrame:
    """Three of each collection, then the best five."""
    return vector.merged(_knn(spark, d, "cosine", 3, per="label"), 5)


@query(_knn_sql("cosine", 5, where="label = 3"))
def knn_filtered(spark: SparkSession, d: str) -> DataFrame:
    """A metadata filter before the top k."""
    return _knn(spark, d, "cosine", 5, where=F.col("label") == 3)


@query(_knn_sql("cosine", 5, after="score >= 0.35"))
def knn_threshold(spark: SparkSession, d: str) -> DataFrame:
    """A threshold after the top k."""
    return _knn(spark, d, "cosine", 5, threshold=0.35)


@query(f"""
WITH s AS (SELECT x.vec_id AS i, y.vec_id AS j, x.embedding AS a, y.embedding AS b FROM embeddings x, embeddings y WHERE x.vec_id % 20 = 0)
SELECT i, j, round({_DOT}, 6) AS s FROM s""")
def matrix_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Inner products of every twentieth vector with all."""
    e = table(spark, d, "embeddings")
    a = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("i"), F.col("embedding").alias("v"))
    b = e.select(F.col("vec_id").alias("j"), F.col("embedding").alias("w"))
    return vector.matrix_similarity(a, b, 6)


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Vector and lexical hits of one query over documents with an embedding (doc_id = vec_id)."""
    b = _bm25(spark, d, one_query(spark), 20)
    v = vector.knn(table(spark, d, "embeddings"), _first(spark, d).withColumn("query_id", F.lit(0)), 20)
    return v, b


_SIDES_SQL = f"""
lex AS (SELECT doc_id, score, rank FROM ({_bm25_sql(WORD_SQL, OKAPI, ONE, 20, floor=True).replace("round(score, 6) AS score", "score")})),
vec AS (SELECT doc_id, score, rank FROM ({_knn_sql("cosine", 20, "vec_id = 7").replace("round(score, 6) AS score", "score")}))"""


def _fusion_sql(score: str, sides: str = _SIDES_SQL, v: str = "vec", b: str = "lex") -> str:
    return f"""
WITH {sides},
both_sides AS (SELECT coalesce(v.doc_id, b.doc_id) AS doc_id, v.score AS vs, v.rank AS vr, b.score AS bs, b.rank AS br FROM {v} v FULL JOIN {b} b ON v.doc_id = b.doc_id),
scored AS (SELECT *, {score} AS score FROM both_sides),
ranked AS (SELECT *, row_number() OVER (ORDER BY score DESC, vr NULLS LAST, br NULLS LAST, doc_id) AS rank FROM scored)
SELECT doc_id, round(score, 8) AS score, coalesce(vr, 0) AS vector_rank, coalesce(br, 0) AS bm25_rank, CAST(rank AS INT) AS rank FROM ranked WHERE rank <= 10"""


def _fused(method: str, spark: SparkSession, d: str, **more) -> DataFrame:
    v, b = _sides(spark, d)
    return fusion.fuse(method, v, b, 10, **more).select("doc_id", F.round("score", 8).alias("score"), "vector_rank", "bm25_rank", "rank")


_RRF = "coalesce(1.0::DOUBLE / (60 + vr), 0) + coalesce(1.0::DOUBLE / (60 + br), 0)"


@query(_fusion_sql(_RRF))
def hybrid_rrf(spark: SparkSession, d: str) -> DataFrame:
    """Flagship: BM25 and cosine, fused by reciprocal ranks."""
    return _fused("rrf", spark, d)


_NORMAL = _SIDES_SQL + """,
nv AS (SELECT doc_id, rank, CASE WHEN max(score) OVER () = min(score) OVER () THEN 1 ELSE (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) END AS score FROM vec),
nb AS (SELECT doc_id, rank, CASE WHEN max(score) OVER () = min(score) OVER () THEN 1 ELSE (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) END AS score FROM lex)"""


@query(_fusion_sql("0.6::DOUBLE * coalesce(vs, 0) + 0.4::DOUBLE * coalesce(bs, 0)", _NORMAL, "nv", "nb"))
def weighted_fusion(spark: SparkSession, d: str) -> DataFrame:
    """Min-max normalized scores, 0.6 to 0.4."""
    return _fused("weighted", spark, d, vector_weight=0.6, bm25_weight=0.4)


@query(_fusion_sql(f"{_RRF} + 0.1::DOUBLE * (coalesce(vs, 0) + coalesce(bs, 0))"))
def rrf_plus_score(spark: SparkSession, d: str) -> DataFrame:
    """Reciprocal ranks and a tenth of the raw scores."""
    return _fused("rrf_plus_score", spark, d)


_PER_LANG = rf"""
WITH docs AS (SELECT doc_id, lang, {WORD_SQL.format("text")} AS t FROM documents),
lens AS (SELECT doc_id, lang, len(t) AS dl FROM docs),
stats AS (SELECT lang, count(*) AS n, avg(dl) AS avgdl FROM lens GROUP BY lang),
post AS (SELECT doc_id, lang, term, count(*) AS tf FROM (SELECT doc_id, lang, unnest(t) AS term FROM docs) GROUP BY ALL),
dfs AS (SELECT lang, term, count(*) AS df FROM post GROUP BY lang, term),
weights0 AS (SELECT lang, term, {OKAPI} AS raw FROM dfs JOIN stats USING (lang)),
weights AS (SELECT lang, term, CASE WHEN raw < 0 THEN 0.25 * (avg(raw) OVER (PARTITION BY lang)) ELSE raw END AS idf FROM weights0),
asked AS (SELECT term, count(*) AS times FROM (SELECT unnest(regexp_extract_all(lower('{QUERY}'), '[a-z]+')) AS term) GROUP BY term),
lex0 AS (SELECT lang, doc_id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
  FROM post JOIN asked USING (term) JOIN weights USING (lang, term) JOIN lens USING (doc_id, lang) JOIN stats USING (lang) GROUP BY lang, doc_id),
lex AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, doc_id) AS br FROM lex0) WHERE br <= 6),
pairs AS (SELECT lang, doc_id, q.embedding AS a, e.embedding AS b FROM (SELECT * FROM embeddings WHERE vec_id = 7) q, embeddings e JOIN documents ON vec_id = doc_id),
vec AS (SELECT * FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY {_METRIC["cosine"]} DESC, doc_id) AS vr FROM pairs) WHERE vr <= 6),
fused AS (SELECT coalesce(v.lang, b.lang) AS lang, coalesce(v.doc_id, b.doc_id) AS doc_id, vr, br, {_RRF} AS score FROM vec v FULL JOIN lex b ON v.doc_id = b.doc_id AND v.lang = b.lang),
per AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, vr NULLS LAST, br NULLS LAST, doc_id) AS r FROM fused),
best AS (SELECT lang, doc_id, score, row_number() OVER (ORDER BY score DESC, lang, doc_id) AS rank FROM per WHERE r <= 3)
SELECT lang AS collection, doc_id, round(score, 8) AS score, CAST(rank AS INT) AS rank FROM best WHERE rank <= 5"""


@query(_PER_LANG)
def hybrid_multi_collection(spark: SparkSession, d: str) -> DataFrame:
    """Hybrid in each collection (language), three of each, then the best five."""
    from credalyt.plans.retrieval import Config, retrieve

    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    docs = table(spark, d, "documents").join(e, "doc_id", "left").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.coalesce("embedding", F.array().cast("array<float>")).alias("embedding"), F.col("lang").alias("collection"), F.create_map(F.lit("type"), F.col("source")).alias("metadata"))
    asked = one_query(spark).crossJoin(_first(spark, d).select("embedding"))
    return retrieve(docs, asked, Config()).select("collection", "doc_id", F.round("score", 8).alias("score"), "rank")


@query(rf"""
WITH hits AS ({_bm25_sql(WORD_SQL, OKAPI, ONE, 10, floor=True).replace("round(score, 6) AS score", "score")}),
terms AS (SELECT h.doc_id, h.score, list_distinct({SPACE_SQL.format("lower(text)")}) AS t, list_distinct(string_split('{QUERY}', ' ')) AS q FROM hits h JOIN documents d USING (doc_id)),
scored AS (SELECT doc_id, 0.7::DOUBLE * score + (1 - 0.7::DOUBLE) * (len(list_intersect(q, t))::DOUBLE / greatest(len(q), 1)) AS score FROM terms),
ranked AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored)
SELECT doc_id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM ranked WHERE rank <= 5""")
def rerank_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Ten hits reranked by term overlap, five stay."""
    docs = table(spark, d, "documents")
    hits = _bm25(spark, d, one_query(spark), 10).join(docs.select("doc_id", F.col("text").alias("content")), "doc_id").withColumn("query", F.lit(QUERY))
    return vector.rerank_by_overlap(hits, 5).select("doc_id", F.round("score", 6).alias("score"), "rank")


@query(f"""
WITH {_SIDES_SQL},
lists AS (SELECT d.text AS content, s.score, s.rank FROM (SELECT * FROM vec UNION ALL SELECT * FROM lex) s JOIN documents d USING (doc_id)),
total AS (SELECT content, sum(1.0::DOUBLE / (60 + rank) + 0.1::DOUBLE * score) AS score FROM lists GROUP BY content),
ranked AS (SELECT md5(content) AS key, score, row_number() OVER (ORDER BY score DESC, content) AS rank FROM total)
SELECT key, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM ranked WHERE rank <= 10""")
def fusion_by_text(spark: SparkSession, d: str) -> DataFrame:
    """Fusion keyed by the text of a hit."""
    text = table(spark, d, "documents").select("doc_id", F.col("text").alias("content"))
    lists = [x.join(text, "doc_id").select("query_id", "content", "score", "rank") for x in _sides(spark, d)]
    return fusion.by_text(lists, 10).select(F.md5(F.col("content").cast("binary")).alias("key"), F.round("score", 6).alias("score"), "rank")
