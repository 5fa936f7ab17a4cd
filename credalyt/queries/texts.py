"""Tokens, chunks, codes, prompts, answers and explanations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credalyt.functions import decode, explain, parse, text
from credalyt.plans.retrieval import knowledge_context
from credalyt.sources.tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return put


@query("SELECT doc_id, len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS n, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')[1] AS first FROM documents")
def word_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Words of every document."""
    t = text.word_tokens(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(t).cast("long").alias("n"), F.get(t, F.lit(0)).alias("first"))


_CJK = ("个人贷款risk管理", "逾期Loan 2024年", "好", "", "abc DEF", "征信记录良好，无逾期")


@query("""
WITH t AS (SELECT c_custkey AS id, [""" + ", ".join(f"'{s}'" for s in _CJK) + """][c_custkey % 6 + 1] || c_mktsegment || c_custkey AS s FROM customer),
runs AS (SELECT id, k, regexp_extract_all(s, '[\\x{4e00}-\\x{9fff}]+|[a-zA-Z0-9]+')[k] AS r FROM (SELECT id, s, unnest(range(1, len(regexp_extract_all(s, '[\\x{4e00}-\\x{9fff}]+|[a-zA-Z0-9]+')) + 1)) AS k FROM t)),
cjk AS (SELECT id, k, i, n, substr(r, i, n) AS token FROM (SELECT id, k, r, i, unnest(range(2, 5)) AS n FROM (SELECT id, k, r, unnest(range(1, len(r) + 1)) AS i FROM runs WHERE regexp_matches(r, '^[\\x{4e00}-\\x{9fff}]'))) WHERE i + n - 1 <= len(r)),
every AS (SELECT * FROM cjk UNION ALL SELECT id, k, 0, 0, lower(r) FROM runs WHERE NOT regexp_matches(r, '^[\\x{4e00}-\\x{9fff}]'))
SELECT id, string_agg(token, '|' ORDER BY k, i, n) AS tokens FROM every GROUP BY id""")  # fmt: skip
def cjk_ngram_tokens(spark: SparkSession, d: str) -> DataFrame:
    """CJK n-grams of a phrase beside each customer's segment (no table has CJK text)."""
    phrase = F.element_at(F.array(*map(F.lit, _CJK)), (F.col("c_custkey") % 6 + 1).cast("int"))
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.concat(phrase, "c_mktsegment", F.col("c_custkey").cast("string")).alias("s"))
    return rows.select("id", F.array_join(text.cjk_ngram_tokens(F.col("s")), "|").alias("tokens")).where("tokens <> ''")


@query("SELECT doc_id, CAST(k AS INT) AS k, substr(text, CAST(462 * k + 1 AS BIGINT), 512) AS chunk FROM (SELECT doc_id, text, unnest(range(0, CAST(ceil(length(text) / 462.0) AS BIGINT))) AS k FROM documents)")
def chunk_text(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping windows of 512 characters."""
    return table(spark, d, "documents").select("doc_id", F.posexplode(text.chunks(F.col("text"))).alias("k", "chunk"))


@query("SELECT conv_id, turn, CAST(k AS INT) AS k, substr(text, CAST(50 * k + 1 AS BIGINT), 50) AS piece FROM (SELECT conv_id, turn, text, unnest(range(0, CAST(ceil(length(text) / 50.0) AS BIGINT))) AS k FROM conversations)")
def pseudo_stream(spark: SparkSession, d: str) -> DataFrame:
    """Finished answers in pieces of 50 characters."""
    return table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(text.slices(F.col("text"))).alias("k", "piece"))


@query("SELECT doc_id, CASE WHEN length(text) > 100 THEN left(text, 97) || '...' ELSE text END AS short, left(text, 80) AS hard FROM documents")
def truncate_text(spark: SparkSession, d: str) -> DataFrame:
    """Cut with and without dots."""
    return table(spark, d, "documents").select("doc_id", text.truncate(F.col("text"), 100).alias("short"), text.truncate(F.col("text"), 80, ellipsis=False).alias("hard"))


@query("SELECT doc_id, CAST(floor(1.5 * length(regexp_replace(text, '[^\\x{4e00}-\\x{9fff}]', '', 'g')) + (length(text) - length(regexp_replace(text, '[^\\x{4e00}-\\x{9fff}]', '', 'g'))) / 4.0) AS BIGINT) AS estimate, CAST(floor(length(text) / 4.0) AS BIGINT) AS quarter FROM documents")
def token_estimate(spark: SparkSession, d: str) -> DataFrame:
    """Estimated tokens."""
    return table(spark, d, "documents").select("doc_id", text.token_estimate(F.col("text")).alias("estimate"), text.token_count(F.col("text")).alias("quarter"))


@query("SELECT conv_id, turn, md5(lower(regexp_replace(text, '^[\\s\\x{0B}\\x{85}\\p{Z}]+|[\\s\\x{0B}\\x{85}\\p{Z}]+$', '', 'g'))) AS key FROM conversations")
def cache_keys(spark: SparkSession, d: str) -> DataFrame:
    """MD5 keys of stripped texts."""
    return table(spark, d, "conversations").select("conv_id", "turn", text.cache_key(F.col("text")).alias("key"))


# Applications: codes and amounts that follow from orders.
_CODE_EXPR = {
    "checking_status": "concat('A1', 1 + o_orderkey % 5)",
    "credit_history": "concat('A3', o_orderkey % 5)",
    "purpose": "concat('A4', o_custkey % 11)",
    "employment": "concat('A7', 1 + o_custkey % 5)",
    "credit_amount": "CAST(o_totalprice / 20 AS INT)",
    "duration": "CAST(6 + o_orderkey % 55 AS INT)",
}
_APPLY = ", ".join(f"{e} AS {c}" for c, e in _CODE_EXPR.items())
_APPLY_SQL = _APPLY.replace("CAST(o_totalprice / 20 AS INT)", "CAST(trunc(o_totalprice / 20) AS INT)")


def applications(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").selectExpr("o_orderkey", *[f"{e} AS {c}" for c, e in _CODE_EXPR.items()])


def _case(column: str, values: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + f" ELSE {column} END"


_CODED = ("checking_status", "credit_history", "purpose", "employment")


@query(f"WITH a AS (SELECT o_orderkey, {_APPLY_SQL} FROM orders) SELECT o_orderkey, " + ", ".join(f"{_case(c, decode.CODES[c])} AS {c}" for c in _CODED) + " FROM a")
def decode_codes(spark: SparkSession, d: str) -> DataFrame:
    """Codes to texts; unknown codes stay."""
    return applications(spark, d).select("o_orderkey", *[decode.decoded(F.col(c), decode.CODES[c]).alias(c) for c in _CODED])


@query(
    f"WITH a AS (SELECT o_orderkey, {_APPLY_SQL} FROM orders) SELECT o_orderkey, concat_ws(' ', "
    + ", ".join(f"'{lead}' || {_case(c, v)}" for c, (lead, v) in decode.QUERY_PHRASES.items())
    + ", CASE WHEN credit_amount > 10000 THEN '高额贷款' WHEN credit_amount > 5000 THEN '中等额度贷款' ELSE '小额贷款' END, CASE WHEN duration > 36 THEN '长期贷款' WHEN duration > 12 THEN '中期贷款' ELSE '短期贷款' END) AS query FROM a"
)
def build_query(spark: SparkSession, d: str) -> DataFrame:
    """Retrieval queries of applications."""
    return applications(spark, d).select("o_orderkey", decode.build_query(list(_CODE_EXPR)).alias("query"))


@query(
    f"WITH a AS (SELECT o_orderkey, {_APPLY_SQL} FROM orders) SELECT o_orderkey, concat_ws(chr(10), "
    + ", ".join(f"'- {decode.FEATURES[c]}：' || " + (_case(c, decode.CODES[c]) if c in decode.CODES else f"{c}") for c in _CODE_EXPR)
    + ") AS info FROM a"
)
def format_record(spark: SparkSession, d: str) -> DataFrame:
    """Applications as lines of text."""
    return applications(spark, d).select("o_orderkey", decode.format_record(list(_CODE_EXPR)).alias("info"))


@query("""
WITH h AS (SELECT conv_id AS query_id, CAST(turn + 1 AS INT) AS rank, text AS content, 1.0::DOUBLE / (turn + 1) AS score FROM conversations),
items AS (SELECT query_id, rank, '[' || rank || '] 参考资料' || chr(10) || content || chr(10) || '(相关度: ' || printf('%.2f', score) || ')' AS item FROM h WHERE rank <= 10),
run AS (SELECT *, coalesce(sum(length(item) + 1) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM items),
flag AS (SELECT *, used + length(item) > 600 AS over FROM run),
cnt AS (SELECT *, sum(CAST(over AS INT)) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS overs FROM flag),
kept AS (SELECT query_id, rank, CASE WHEN over AND length(item) > 600 - used THEN left(item, CAST(600 - used - 3 AS BIGINT)) || '...' ELSE item END AS item FROM cnt WHERE overs = 0 OR (overs = 1 AND over AND 600 - used > 100))
SELECT query_id, string_agg(item, chr(10) || chr(10) ORDER BY rank) AS context FROM kept GROUP BY query_id""")
def prompt_context(spark: SparkSession, d: str) -> DataFrame:
    """Knowledge up to 600 characters for each conversation."""
    hits = table(spark, d, "conversations").select(
        F.col("conv_id").alias("query_id"), (F.col("turn") + 1).cast("int").alias("rank"), F.col("text").alias("content"), (F.lit(1.0) / (F.col("turn") + 1)).alias("score"), F.lit("").alias("collection"), F.create_map().cast("map<string,string>").alias("metadata")
    )
    return knowledge_context(hits, 600)


# Answers: text in the form of a model's answer, from orders.
_LEVEL = "CASE o_orderkey % 4 WHEN 0 THEN '低风险' WHEN 1 THEN '中风险' WHEN 2 THEN '高风险' ELSE '未定' END"
_ADVICE = "CASE o_custkey % 4 WHEN 0 THEN '批准' WHEN 1 THEN '拒绝' WHEN 2 THEN '人工复核' ELSE '再议' END"
_ANSWER = (
    f"concat('## 风险分析\\n风险等级：**', {_LEVEL}, '**\\n', CASE WHEN o_orderkey % 7 = 0 THEN concat('得到 ', o_orderkey % 120, '分') ELSE concat('风险评分：', o_orderkey % 130, '分') END, "
    f"'\\n风险因素：\\n1. 收入：收入波动\\n   权重：高\\n   来源 [', o_orderkey % 3, ']\\n2. 负债偏高而且持续\\n有利因素：\\n1. 储蓄：有储蓄\\n   可降低损失\\n审批建议：', {_ADVICE}, '\\n授信额度：', o_orderkey % 50, '万元\\n监控指标：还款记录、收入变化\\n知识来源：[1] 风险案例 [2] 监管法规 [1] 风险案例')"
)
_ANSWER_SQL = _ANSWER.replace("\\n", "' || chr(10) || '")


def answers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").selectExpr("o_orderkey", f"{_ANSWER} AS answer")


_WITH_ANSWER = f"WITH a AS (SELECT o_orderkey, {_ANSWER_SQL} AS answer FROM orders) "


@query(_WITH_ANSWER + """
SELECT o_orderkey, CASE WHEN lab <> '' THEN CASE WHEN contains(lab, '低') THEN 0 WHEN contains(lab, '高') THEN 2 WHEN contains(lab, '中') THEN 1 END
  WHEN contains(answer, '低风险') OR contains(answer, '风险较低') THEN 0 WHEN contains(answer, '高风险') OR contains(answer, '风险较高') THEN 2 WHEN contains(answer, '中风险') OR contains(answer, '风险中等') THEN 1 END AS level
FROM (SELECT *, regexp_extract(answer, '(?:风险等级|风险判定)[：:\\s]*[*]*([低中高]+风险?)[*]*', 1) AS lab FROM a)""")
def parse_level(spark: SparkSession, d: str) -> DataFrame:
    """Levels of answers."""
    return answers(spark, d).select("o_orderkey", parse.risk_level(F.col("answer")).alias("level"))


_LABELLED = "regexp_extract(answer, '(?:风险评分|综合评分|评分)[：:\\s]*(\\d{1,3})\\s*(?:分)?', 1)"
_SCORE_SQL = f"""CASE WHEN {_LABELLED} <> '' THEN least(CAST({_LABELLED} AS INT), 100)
  ELSE list_filter(list_transform(regexp_extract_all(answer, '(\\d{{1,3}})\\s*(?:分|/100)', 1), lambda x: CAST(x AS INT)), lambda x: x <= 100)[1] END"""


@query(_WITH_ANSWER + f"SELECT o_orderkey, {_SCORE_SQL} AS score FROM a")
def parse_score(spark: SparkSession, d: str) -> DataFrame:
    """Scores of answers."""
    return answers(spark, d).select("o_orderkey", parse.risk_score(F.col("answer")).alias("score"))


def _approval_sql(t: str) -> str:
    has = lambda *w: " OR ".join(f"contains({t}, '{x}')" for x in w)
    return f"CASE WHEN {has('拒绝', '不批准', '不予批准')} THEN '拒绝' WHEN {has('人工复核', '人工审核', '需复核')} THEN '人工复核' WHEN {has('批准', '通过', '同意')} THEN '批准' END"


@query(_WITH_ANSWER + rf"""
SELECT o_orderkey, coalesce({_approval_sql("part")}, {_approval_sql("answer")}) AS approval
FROM (SELECT *, regexp_extract(answer, '(?:(?:审批|决策|管理)建议)[^\n:：]*[:：]?\**[ \t]*([\s\S]*?)(?:\n[^\n]{{0,12}}(?:知识来源)|\z)', 1) AS part FROM a)""")
def parse_approval(spark: SparkSession, d: str) -> DataFrame:
    """Approvals of answers."""
    return answers(spark, d).select("o_orderkey", parse.approval(F.col("answer")).alias("approval"))


@query(_WITH_ANSWER + r"""
SELECT o_orderkey, string_agg(id || ' ' || kind, ',' ORDER BY k) AS sources FROM (
  SELECT o_orderkey, id, kind, k, row_number() OVER (PARTITION BY o_orderkey, id ORDER BY k) AS r FROM (
    SELECT o_orderkey, k, regexp_extract_all(answer, '\[(\d+)\]\s*(风险案例|监管法规|行业知识|参考资料)', 1)[k] AS id, regexp_extract_all(answer, '\[(\d+)\]\s*(风险案例|监管法规|行业知识|参考资料)', 2)[k] AS kind
    FROM (SELECT o_orderkey, answer, unnest(range(1, len(regexp_extract_all(answer, '\[(\d+)\]\s*(风险案例|监管法规|行业知识|参考资料)', 1)) + 1)) AS k FROM a)))
WHERE r = 1 GROUP BY o_orderkey""")
def parse_citations(spark: SparkSession, d: str) -> DataFrame:
    """Cited sources, the first of each id."""
    c = parse.citations(F.col("answer"))
    return answers(spark, d).select("o_orderkey", F.array_join(F.transform(c, lambda x: F.concat_ws(" ", x["source_id"], x["source_type"])), ",").alias("sources"))


@query("""
WITH expected AS (SELECT o_orderkey, '收入|收入波动|高|' || (o_orderkey % 3) || ';负债偏高而且持续|负债偏高而且持续|中|' AS risk, '储蓄|有储蓄|可降低损失' AS favorable, (o_orderkey % 50) || '万元' AS credit_limit, '还款记录,收入变化' AS monitoring FROM orders)
SELECT * FROM expected""")
def parse_factors(spark: SparkSession, d: str) -> DataFrame:
    """Factors and suggestions: a round trip of what the answers were made from."""
    a = F.col("a")
    risk = F.array_join(F.transform(a["risk_factors"], lambda f: F.concat(f["name"], F.lit("|"), f["description"], F.lit("|"), f["weight"], F.lit("|"), F.coalesce(f["source_reference"], F.lit("")))), ";")
    favorable = F.array_join(F.transform(a["favorable_factors"], lambda f: F.concat_ws("|", f["name"], f["description"], f["risk_mitigation"])), ";")
    return answers(spark, d).select("o_orderkey", parse.analysis(F.col("answer")).alias("a")).select("o_orderkey", risk.alias("risk"), favorable.alias("favorable"), a["suggestions"]["credit_limit"].alias("credit_limit"), F.array_join(a["suggestions"]["monitoring"], ",").alias("monitoring"))


@query(f"""
WITH a AS (SELECT o_orderkey, o_custkey, o_orderkey % 4 AS k, {_ANSWER_SQL} AS answer FROM orders),
s AS (SELECT o_orderkey, CASE k WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 END AS named, answer, o_custkey, {_SCORE_SQL} AS score FROM a),
l AS (SELECT *, named AS level, CASE WHEN score <= 30 THEN 0 WHEN score <= 70 THEN 1 WHEN score > 70 THEN 2 END AS of_score FROM s)
SELECT o_orderkey, concat_ws(',', CASE WHEN level IS NULL THEN 'level' END, CASE WHEN score IS NULL THEN 'score' END, CASE WHEN o_custkey % 4 = 3 THEN 'approval' END, CASE WHEN of_score <> level THEN 'score does not fit level' END) AS errors FROM l""")
def validate_result(spark: SparkSession, d: str) -> DataFrame:
    """Checks that answers fail."""
    return answers(spark, d).select("o_orderkey", F.array_join(parse.validation_errors(parse.analysis(F.col("answer"))), ",").alias("errors"))


_JSON = "CASE o_orderkey % 4 WHEN 0 THEN concat('回答 {{\"risk_score\": 0.', o_orderkey % 90 + 10, ', \"recommendation\": \"拒绝\"}}') WHEN 1 THEN concat('{{\"risk_score\": 0.', o_orderkey % 90 + 10, '}}') WHEN 2 THEN '{{risk_score: }}' ELSE 'none' END".replace("{{", "{").replace("}}", "}")


@query(f"""
WITH a AS (SELECT o_orderkey, {_JSON} AS answer FROM orders)
SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 2 THEN CAST('0.' || (o_orderkey % 90 + 10) AS DOUBLE) ELSE 0.5 END AS risk_score, CAST(o_orderkey % 4 = 0 AS INT) AS label, o_orderkey % 4 < 2 AS ok FROM a""")
def parse_json_answer(spark: SparkSession, d: str) -> DataFrame:
    """The first JSON object of answers."""
    rows = table(spark, d, "orders").selectExpr("o_orderkey", f"{_JSON} AS answer")
    return rows.select("o_orderkey", parse.json_answer(F.col("answer")).alias("j")).select("o_orderkey", "j.*")


@query("SELECT o_orderkey, CAST(coalesce(level >= 1, false) AS INT) AS label, CASE WHEN score > 0 THEN score / 100.0::DOUBLE ELSE 0.5 END AS proba FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 END AS level, o_orderkey % 101 AS score FROM orders)")
def label_binarise(spark: SparkSession, d: str) -> DataFrame:
    """Labels and probabilities from levels and scores."""
    rows = table(spark, d, "orders").selectExpr("o_orderkey", "CASE o_orderkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 END AS level", "o_orderkey % 101 AS score")
    return rows.select("o_orderkey", parse.binary_label(F.col("level")).alias("label"), parse.probability(F.col("score")).alias("proba"))


# Explanations: a choice of words repeated by order.
_WORDS = ["因此风险等级偏高。", "首先看收入，其次看负债，最后看担保。", "根据历史记录和案例[1]，", "## 结论\n", "可能逾期，也许拖欠，大概困难。", "授信额度与监控指标、风险缓释。", "收入稳定，按时还款，良好。", "综合各项评估，基于数据判断。", "即具体来说，例如：", "违约概率与抵押、质押、保证、合规、监管、内控。"]
_TEXT_EXPR = "concat(" + ", ".join(f"repeat('{w}', CAST((o_orderkey div {p}) % 3 AS INT))" for w, p in zip(_WORDS, (1, 2, 3, 5, 7, 11, 13, 17, 19, 23))) + ")"
_TEXT_SQL = _TEXT_EXPR.replace(" div ", " // ").replace("\n", "' || chr(10) || '")


def explanations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").selectExpr("o_orderkey", f"{_TEXT_EXPR} AS x".replace("\n", "\\n"))


def _count_sql(words: list[str]) -> str:
    return "(" + " + ".join(f"CAST((length(x) - length(replace(x, '{w}', ''))) / {len(w)} AS INT)" for w in words) + ")"


def _present_sql(words: list[str]) -> str:
    return "(" + " + ".join(f"CAST(contains(x, '{w}') AS INT)" for w in words) + ")"


def _clip(e: str) -> str:
    return f"least(greatest({e}, 1), 5)"


_SENTENCES = "list_filter(regexp_split_to_array(x, '[。！？\n]'), lambda s: regexp_matches(s, '[^\\s\\p{Z}]'))"
_SCORES_SQL = f"""
WITH t AS (SELECT o_orderkey, {_TEXT_SQL} AS x FROM orders),
n AS (SELECT *, {_count_sql(explain.CONNECTIVES)} AS links, {_count_sql(explain.HEDGES)} AS hedges, {_count_sql(explain.EVIDENCE)} AS evidence, {_present_sql(explain.PLAIN_SPEECH)} AS plain,
  coalesce(list_sum(list_transform({_SENTENCES}, lambda s: length(s))), 0)::DOUBLE / greatest(len({_SENTENCES}), 1) AS mean, {_present_sql(explain.REQUIRED)} / 7.0::DOUBLE AS share, {_present_sql(explain.TERMS)} AS terms,
  {" + ".join(f"CAST(regexp_matches(x, '{p}') AS INT)" for p in explain.REASONING)} AS reasons FROM t),
s AS (SELECT o_orderkey, x,
  {_clip(_clip(_clip("3 + CASE WHEN links >= 5 THEN 2 WHEN links >= 3 THEN 1 ELSE 0 END") + " - CAST(hedges >= 3 AS INT)") + " + CAST(regexp_matches(x, '(?s)首先.*其次.*最后') AS INT)")} AS logic_clarity,
  {_clip("CASE WHEN evidence >= 8 THEN 5 WHEN evidence >= 5 THEN 4 WHEN evidence >= 2 THEN 3 ELSE 2 END + CAST(regexp_matches(x, '[[][0-9]+[]]') AS INT)")} AS evidence_sufficiency,
  {_clip(_clip(_clip("3 + CAST(plain >= 3 AS INT)") + " + CASE WHEN mean < 50 THEN 1 WHEN mean > 100 THEN -1 ELSE 0 END") + " + CAST(regexp_matches(x, '(?m)^#+[ ]') AS INT)")} AS understandability,
  CASE WHEN share >= 0.9 THEN 5 WHEN share >= 0.7 THEN 4 WHEN share >= 0.5 THEN 3 WHEN share >= 0.3 THEN 2 ELSE 1 END AS completeness,
  {_clip("CASE WHEN terms >= 8 THEN 5 WHEN terms >= 5 THEN 4 WHEN terms >= 3 THEN 3 ELSE 2 END + CAST(reasons >= 2 AS INT)")} AS professionalism FROM n)"""
_DIMS = ", ".join(f"CAST({d} AS INT) AS {d}" for d in explain.DIMENSIONS)
_MEAN = "(" + " + ".join(explain.DIMENSIONS) + ") / 5.0::DOUBLE"


@query(_SCORES_SQL + f"SELECT o_orderkey, {_DIMS}, {_MEAN} AS average FROM s")
def explain_scores(spark: SparkSession, d: str) -> DataFrame:
    """Five scores of explanations."""
    return explanations(spark, d).select("o_orderkey", explain.scores(F.col("x")).alias("s")).select("o_orderkey", "s.*")


@query(_SCORES_SQL + " UNION ALL ".join(f"SELECT '{x}' AS dimension, round(avg({x}), 6) AS mean, CAST(max({x}) AS INT) AS max, CAST(min({x}) AS INT) AS min FROM s" for x in explain.DIMENSIONS))
def explain_stats(spark: SparkSession, d: str) -> DataFrame:
    """Mean, largest and smallest of each dimension."""
    s = explanations(spark, d).select(explain.scores(F.col("x")).alias("s"))
    long = s.select(F.explode(explain.dimension_map(F.col("s"))).alias("dimension", "v"))
    return long.groupBy("dimension").agg(F.round(F.avg("v"), 6).alias("mean"), F.max("v").alias("max"), F.min("v").alias("min"))


@query(_SCORES_SQL + "SELECT o_orderkey, round(" + " + ".join(f"{x} * {w}::DOUBLE" for x, w in zip(explain.DIMENSIONS, explain.WEIGHTS)) + ", 6) AS score FROM s")
def weighted_explainability(spark: SparkSession, d: str) -> DataFrame:
    """The weighted composite."""
    return explanations(spark, d).select("o_orderkey", F.round(explain.weighted(explain.scores(F.col("x"))), 6).alias("score"))


_KEYWORD_SQL = f"""
WITH t AS (SELECT o_orderkey, {_TEXT_SQL} AS x FROM orders),
n AS (SELECT *, {_present_sql(explain.HIGH)} AS h, {_present_sql(explain.MEDIUM)} AS m, {_present_sql(explain.LOW)} AS l, {_present_sql(explain.TEXT_FEATURES)} AS f FROM t)"""


@query(_KEYWORD_SQL + """
SELECT o_orderkey, CASE WHEN h >= 2 THEN 2 WHEN h >= 1 OR m >= 3 THEN 1 WHEN l >= 2 THEN 0 ELSE 1 END AS level,
  CASE WHEN h >= 2 THEN 70 + least(h * 5, 25) WHEN h >= 1 OR m >= 3 THEN 50 + least(m * 5, 20) WHEN l >= 2 THEN 20 + least(30 - l * 5, 30) ELSE 50 END AS score, h AS high, m AS medium, l AS low FROM n""")
def keyword_risk(spark: SparkSession, d: str) -> DataFrame:
    """Level and score by keywords."""
    return explanations(spark, d).select("o_orderkey", explain.keyword_risk(F.col("x")).alias("k")).select("o_orderkey", "k.*")


@query(_KEYWORD_SQL + "SELECT o_orderkey, CASE WHEN x = '' THEN 0 ELSE 0.5::DOUBLE * (f / 28.0::DOUBLE) + 0.5::DOUBLE * least((least(h, 5) + least(l, 3)) / 6.0::DOUBLE, 1) END AS utilisation FROM n")
def text_utilisation(spark: SparkSession, d: str) -> DataFrame:
    """How much of a text its analysis uses."""
    k = explain.keyword_factors(F.col("x"))
    return explanations(spark, d).select("o_orderkey", explain.text_utilisation(F.col("x"), F.size(k["risk_factors"]) + F.size(k["favorable_factors"])).alias("utilisation"))


@query("""
SELECT p_partkey, CASE p_partkey % 3
  WHEN 0 THEN '案例类型: ' || p_type || chr(10) || '案例描述: ' || p_name || chr(10) || '风险指标: ' || p_brand || ', ' || p_size || chr(10) || '处理决策: ' || '拒绝'
  WHEN 1 THEN '来源: ' || p_brand || chr(10) || '分类: ' || p_type || chr(10) || '规则内容: ' || p_name
  ELSE '分类: ' || p_type || chr(10) || '知识内容: ' || p_name END AS document,
  CASE p_partkey % 3 WHEN 0 THEN p_type WHEN 1 THEN p_brand END AS tag FROM part""")
def render_documents(spark: SparkSession, d: str) -> DataFrame:
    """Knowledge documents and their metadata from fields."""
    p = table(spark, d, "part")
    kind = F.element_at(F.array(F.lit("risk_case"), F.lit("regulation"), F.lit("industry_knowledge")), (F.col("p_partkey") % 3 + 1).cast("int"))
    rows = p.select("p_partkey", F.col("p_partkey").cast("string").alias("id"), kind.alias("kind"), F.col("p_type").alias("case_type"), F.col("p_type").alias("category"), F.col("p_name").alias("description"), F.col("p_name").alias("content"), F.col("p_brand").alias("source"), F.array("p_brand", F.col("p_size").cast("string")).alias("risk_indicators"), F.lit("拒绝").alias("decision"))
    m = decode.document_metadata(F.col("kind"))
    return rows.select("p_partkey", decode.document_text(F.col("kind")).alias("document"), F.coalesce(F.element_at(m, "case_type"), F.element_at(m, "source")).alias("tag"))
