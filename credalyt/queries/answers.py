"""Variants of answer parsing, prompts, knowledge entries and costs before a call."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credalyt.functions import decode, explain, parse, text
from credalyt.operators import batch, fusion, prep
from credalyt.plans import experiments, retrieval
from credalyt.queries.texts import _APPLY_SQL, _CODE_EXPR, _SCORE_SQL, _WITH_ANSWER, ORACLES as TEXT_ORACLES, answers, applications
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


_HAS = lambda t, *w: "(" + " OR ".join(f"contains({t}, '{x}')" for x in w) + ")"


@query(_WITH_ANSWER + f"""SELECT o_orderkey, coalesce(CASE WHEN {_HAS('answer', '低风险')} THEN 0 WHEN {_HAS('answer', '高风险')} THEN 2 WHEN {_HAS('answer', '中风险')} THEN 1 END,
  CASE WHEN {_HAS('answer', '低')} THEN 0 WHEN {_HAS('answer', '中')} THEN 1 WHEN {_HAS('answer', '高')} THEN 2 END, 1) AS level,
  CASE coalesce(CASE WHEN {_HAS('answer', '低风险')} THEN 0 WHEN {_HAS('answer', '高风险')} THEN 2 WHEN {_HAS('answer', '中风险')} THEN 1 END,
  CASE WHEN {_HAS('answer', '低')} THEN 0 WHEN {_HAS('answer', '中')} THEN 1 WHEN {_HAS('answer', '高')} THEN 2 END, 1) WHEN 0 THEN '低风险' WHEN 1 THEN '中风险' ELSE '高风险' END AS name FROM a""")
def parse_level_plain(spark: SparkSession, d: str) -> DataFrame:
    """Levels by the plain variant, and their names."""
    level = parse.risk_level_or_medium(F.col("answer"))
    return answers(spark, d).select("o_orderkey", level.alias("level"), parse.level_name(level).alias("name"))


_POINTS = lambda p: f"CASE WHEN regexp_extract(answer, '{p}', 1) <> '' THEN least(CAST(regexp_extract(answer, '{p}', 1) AS INT), 100) END"


@query(_WITH_ANSWER + "SELECT o_orderkey, coalesce(" + ", ".join(_POINTS(p) for p in (r"风险评分[：:]\s*(\d+)", r"评分[：:]\s*(\d+)", r"(\d+)\s*分")) + ") AS score FROM a")
def parse_score_plain(spark: SparkSession, d: str) -> DataFrame:
    """Scores by the plain variant."""
    return answers(spark, d).select("o_orderkey", parse.risk_score_plain(F.col("answer")).alias("score"))


@query(_WITH_ANSWER + f"SELECT o_orderkey, CASE WHEN {_HAS('answer', '拒绝', '不批准')} THEN '拒绝' WHEN {_HAS('answer', '人工复核', '人工审核')} THEN '人工复核' WHEN {_HAS('answer', '批准', '通过')} THEN '批准' ELSE '待定' END AS approval FROM a")
def parse_approval_plain(spark: SparkSession, d: str) -> DataFrame:
    """Approvals by the plain variant."""
    return answers(spark, d).select("o_orderkey", parse.approval_plain(F.col("answer")).alias("approval"))


@query("SELECT o_orderkey, 1 AS n, '储蓄' AS name, '有储蓄' AS description, '可降低损失' AS risk_mitigation FROM orders")
def parse_favorable(spark: SparkSession, d: str) -> DataFrame:
    """Favourable factors of answers."""
    rows = answers(spark, d).select("o_orderkey", parse.favorable_factors(F.col("answer")).alias("f"))
    return rows.select("o_orderkey", F.size("f").alias("n"), F.inline("f"))


@query("SELECT o_orderkey, (o_orderkey % 50) || '万元' AS credit_limit, '还款记录|收入变化' AS monitoring, '' AS mitigation FROM orders")
def parse_suggestions(spark: SparkSession, d: str) -> DataFrame:
    """Credit limit, monitoring and mitigation of answers."""
    s = F.col("s")
    return answers(spark, d).select("o_orderkey", parse.suggestions(F.col("answer")).alias("s")).select("o_orderkey", s["credit_limit"].alias("credit_limit"), F.array_join(s["monitoring"], "|").alias("monitoring"), F.array_join(s["mitigation"], "|").alias("mitigation"))


_PARSED = f"""WITH l AS ({TEXT_ORACLES['parse_level']}), p AS ({TEXT_ORACLES['parse_approval']}), s AS ({_WITH_ANSWER} SELECT o_orderkey, {_SCORE_SQL} AS score FROM a)
SELECT o_orderkey, coalesce(level, LEVEL_) AS level, coalesce(score, SCORE_) AS score, coalesce(approval, ADVICE_) AS approval FROM l JOIN p USING (o_orderkey) JOIN s USING (o_orderkey)"""


def _fields(parsed) -> list:
    return [parsed["risk_level"].alias("level"), parsed["risk_score"].alias("score"), parsed["approval"].alias("approval")]


@query(_PARSED.replace("LEVEL_", "1").replace("SCORE_", "50").replace("ADVICE_", "'人工复核'"))
def parse_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Unknown fields of answers replaced by stated ones."""
    parsed = parse.with_fallback(parse.analysis(F.col("answer")), F.lit(1), F.lit(50), F.lit(parse.REVIEW))
    return answers(spark, d).select("o_orderkey", parsed.alias("p")).select("o_orderkey", *_fields(F.col("p")))


@query(_PARSED.replace("LEVEL_", "-1").replace("SCORE_", "-1").replace("ADVICE_", "'待定'"))
def parse_sentinels(spark: SparkSession, d: str) -> DataFrame:
    """Unknown fields of answers as they leave the library."""
    return answers(spark, d).select("o_orderkey", parse.with_sentinels(parse.analysis(F.col("answer"))).alias("p")).select("o_orderkey", *_fields(F.col("p")))


@query("SELECT conv_id, turn, CAST(floor(length(text) / 4.0) AS BIGINT) AS tokens, round(CAST(floor(length(text) / 4.0) AS BIGINT) * (0.8 / 1000) + 500 * (2.0 / 1000), 6) AS cost FROM conversations")
def expected_costs(spark: SparkSession, d: str) -> DataFrame:
    """Tokens and cost of prompts before the call."""
    n = text.token_count(F.col("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", n.alias("tokens"), batch.expected_cost(n, 1000, 0.8, 2.0).alias("cost"))


@query("SELECT conv_id, turn, length(text) AS prompt_length, CAST(floor(1.5 * length(regexp_replace(text, '[^\\x{4e00}-\\x{9fff}]', '', 'g')) + (length(text) - length(regexp_replace(text, '[^\\x{4e00}-\\x{9fff}]', '', 'g'))) / 4.0) AS BIGINT) AS estimated_tokens, CAST(least(turn, 3) AS BIGINT) AS knowledge_items_used, 'zero_shot' AS template_type FROM conversations")
def prompt_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Length, tokens, knowledge items and template of prompts."""
    return table(spark, d, "conversations").select("conv_id", "turn", F.inline(F.array(decode.prompt_stats(F.col("text"), F.col("turn"), 3, "zero_shot"))))


_KIND = "CASE doc_id % 4 WHEN 0 THEN 'risk_cases' WHEN 1 THEN 'regulations' WHEN 2 THEN 'industry_knowledge' ELSE 'notes' END"


def _type_sql() -> str:
    known = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in decode.COLLECTION_TYPES.items())
    return f"coalesce(CASE {_KIND} {known} END, CASE WHEN doc_id % 8 = 3 THEN lang END, 'default')"


@query(f"""WITH t AS (SELECT doc_id, text, {_type_sql()} AS kind, (doc_id % 5) / 4.0::DOUBLE AS score FROM documents)
SELECT doc_id, kind, '[' || (doc_id % 10) || '] ' || CASE kind {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in decode.SOURCE_NAMES.items())} ELSE '{decode.SOURCE_NAMES["default"]}' END || chr(10) || text
  || CASE WHEN score > 0 THEN chr(10) || '(相关度: ' || printf('%.2f', score) || ')' ELSE '' END AS item FROM t""")
def knowledge_items(spark: SparkSession, d: str) -> DataFrame:
    """Search results as knowledge items: their type from collection or metadata, and their text."""
    rows = table(spark, d, "documents").withColumn("collection", F.expr(_KIND))
    kind = decode.source_type(F.col("collection"), F.when(F.col("doc_id") % 8 == 3, F.create_map(F.lit("type"), F.col("lang"))))
    item = decode.knowledge_item(F.col("doc_id") % 10, kind, F.col("text"), (F.col("doc_id") % 5) / F.lit(4.0))
    return rows.select("doc_id", kind.alias("kind"), item.alias("item"))


@query("SELECT doc_id, CASE WHEN (doc_id % 7) / 4.0 <= 1 THEN 1 - (doc_id % 7) / 4.0::DOUBLE ELSE 0.0 END AS relevance, source AS title, text AS content, lang FROM documents")
def knowledge_entries(spark: SparkSession, d: str) -> DataFrame:
    """Documents as knowledge entries with the relevance of a distance."""
    e = decode.entry(F.col("source"), F.col("text"), F.create_map(F.lit("lang"), F.col("lang")))
    return table(spark, d, "documents").select("doc_id", decode.relevance((F.col("doc_id") % 7) / F.lit(4.0)).alias("relevance"), e["title"].alias("title"), e["content"].alias("content"), e["metadata"]["lang"].alias("lang"))


@query("SELECT conv_id, concat_ws(' ', nullif(max(CASE WHEN turn = 0 THEN text END), ''), nullif(max(CASE WHEN turn = 1 THEN role END), ''), nullif(max(CASE WHEN turn = 2 THEN text END), '')) AS case_text FROM conversations GROUP BY conv_id")
def case_texts(spark: SparkSession, d: str) -> DataFrame:
    """Three fields of a case as one text; empty and missing ones are left out."""
    at = lambda k, c: F.coalesce(F.max(F.when(F.col("turn") == k, F.col(c))), F.lit(""))
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(at(0, "text").alias("a"), at(1, "role").alias("b"), at(2, "text").alias("c"))
    return rows.select("conv_id", experiments.case_text(F.col("a"), F.col("b"), F.col("c")).alias("case_text"))


_SPARSE = f"WITH a AS (SELECT o_orderkey, {_APPLY_SQL} FROM orders), b AS (SELECT * REPLACE (CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE purpose END AS purpose, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE duration END AS duration) FROM a) "


def _sparse(spark: SparkSession, d: str) -> DataFrame:
    rows = applications(spark, d)
    return rows.withColumns({"purpose": F.when(F.col("o_orderkey") % 3 != 0, F.col("purpose")), "duration": F.when(F.col("o_orderkey") % 5 != 0, F.col("duration"))})


@query(_SPARSE + "SELECT o_orderkey, u.name AS name, u.value AS value FROM (SELECT o_orderkey, unnest([" + ", ".join(f"{{'name': '{c}', 'value': CAST({c} AS VARCHAR)}}" for c in _CODE_EXPR) + "]) AS u FROM b) WHERE u.value IS NOT NULL")
def record_maps(spark: SparkSession, d: str) -> DataFrame:
    """Records as named values without their nulls."""
    return _sparse(spark, d).select("o_orderkey", F.explode(decode.record_map(list(_CODE_EXPR))).alias("name", "value"))


@query(f"WITH f AS ({TEXT_ORACLES['format_record']}) SELECT o_orderkey AS query_id, '客户：' || chr(10) || info || chr(10) || '资料：' || chr(10) || CASE WHEN o_orderkey % 2 = 0 THEN '[1] {decode.SOURCE_NAMES['default']}' || chr(10) || 'k' || o_orderkey || chr(10) || '(相关度: 0.50)' ELSE '{decode.NO_KNOWLEDGE}' END AS prompt FROM f")
def filled_prompts(spark: SparkSession, d: str) -> DataFrame:
    """Prompts from a template, with retrieved knowledge or without."""
    rows = applications(spark, d).withColumnRenamed("o_orderkey", "query_id")
    hits = rows.where("query_id % 2 = 0").select("query_id", F.lit(1).alias("rank"), F.concat(F.lit("k"), "query_id").alias("content"), F.lit(0.5).alias("score"), F.lit("").alias("collection"), F.create_map().cast("map<string,string>").alias("metadata"))
    config = retrieval.Config(template="客户：\n$customer_info\n资料：\n$knowledge_context")
    return retrieval.prompts(rows, hits, list(_CODE_EXPR), config).select("query_id", "prompt")


@query("SELECT doc_id, CAST(doc_id % 5 + 1 AS INT) AS checked FROM documents")
def checked_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores whose range has been checked."""
    return table(spark, d, "documents").select("doc_id", explain.checked((F.col("doc_id") % 5 + 1).cast("int")).alias("checked"))


@query("SELECT conv_id AS query_id, string_agg('[' || (turn + 1) || '] ' || text || chr(10) || '(score: ' || printf('%.4f', 1.0::DOUBLE / (turn + 1)) || ')', chr(10) ORDER BY turn) AS text FROM conversations WHERE 1.0::DOUBLE / (turn + 1) >= 0.3 GROUP BY conv_id")
def formatted_hits(spark: SparkSession, d: str) -> DataFrame:
    """Hits above a fused score as numbered lines."""
    hits = table(spark, d, "conversations").select(F.col("conv_id").alias("query_id"), (F.col("turn") + 1).cast("int").alias("rank"), F.col("text").alias("content"), (F.lit(1.0) / (F.col("turn") + 1)).alias("score"))
    return fusion.format_hits(fusion.above(hits, 0.3))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def numeric_features(spark: SparkSession, d: str) -> DataFrame:
    """The numeric columns of a table without its target."""
    rows, target = prep.features_and_target(table(spark, d, "orders"), "o_orderstatus")
    assert target.columns == ["o_orderstatus"]
    return rows.select(*prep.numeric_columns(rows))


_RISK_TEXT = "[{'n': '收入', 'd': '收入波动 ' || o_orderkey, 'w': '高', 's': '1'}, {'n': '负债', 'd': '负债偏高', 'w': NULL, 's': NULL}]"


@query(f"""
WITH o AS (SELECT o_orderkey, ['低风险', '中风险', '高风险'][o_orderkey % 3 + 1] AS level, CASE WHEN o_orderkey % 2 = 0 THEN {_RISK_TEXT} ELSE [] END AS risk, o_orderkey % 5 = 0 AS good, o_orderdate FROM orders),
r AS (SELECT *, coalesce(list_reduce([''] || list_transform(range(1, len(risk) + 1), lambda i: chr(10) || '**' || i || '. ' || risk[i].n || '** (权重: ' || coalesce(risk[i].w, '中') || ')' || chr(10) || '   ' || risk[i].d || chr(10) || CASE WHEN risk[i].s IS NOT NULL THEN '   *参考来源: [' || risk[i].s || ']*' || chr(10) ELSE '' END), lambda a, b: a || b), '') AS harm FROM o)
SELECT o_orderkey, md5('## 风险分析报告' || chr(10) || '**客户ID**: ' || o_orderkey || chr(10) || '**分析时间**: ' || strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')
  || chr(10) || chr(10) || '### 一、风险等级判定' || chr(10) || '根据综合评估，该客户的风险等级为**' || level || '**。' || chr(10)
  || chr(10) || '### 二、风险因素分析' || chr(10) || CASE WHEN harm <> '' THEN harm ELSE chr(10) || '暂未识别到明显风险因素。' || chr(10) END
  || chr(10) || '### 三、有利因素分析' || chr(10) || CASE WHEN good THEN chr(10) || '**1. 储蓄**' || chr(10) || '   有储蓄' || chr(10) || '   *风险缓释作用: 可降低损失*' || chr(10) ELSE chr(10) || '暂未识别到明显有利因素。' || chr(10) END
  || chr(10) || '### 四、决策建议' || chr(10) || '**审批建议**: 人工复核' || chr(10) || chr(10) || '**授信额度建议**: ' || CASE level WHEN '低风险' THEN '可给予较高授信额度，建议额度为申请金额的100%。' WHEN '中风险' THEN '建议适度控制授信额度，可给予申请金额的70%-80%。' ELSE '建议严格控制授信额度或拒绝申请。' END
  || chr(10) || chr(10) || '### 五、风险监控指标' || chr(10) || '- 还款记录' || chr(10) || chr(10) || '### 六、风险缓释措施' || chr(10)
  || chr(10) || '### 七、知识来源引用' || chr(10) || '- [1] 风险案例: 类似客户违约案例分析' || chr(10) || '- [2] 监管法规: 个人贷款管理暂行办法' || chr(10) || '- [3] 行业知识: 信贷风险评估最佳实践' || chr(10)) AS report FROM r""")
def rendered_explanations(spark: SparkSession, d: str) -> DataFrame:
    """Reports of applications, digested."""
    key = F.col("o_orderkey")
    kind = "array<struct<name string, description string, weight string, source_reference string>>"
    harm = F.array(F.struct(F.lit("收入").alias("name"), F.concat(F.lit("收入波动 "), key.cast("string")).alias("description"), F.lit("高").alias("weight"), F.lit("1").alias("source_reference")), F.struct(F.lit("负债").alias("name"), F.lit("负债偏高").alias("description"), F.lit(None).cast("string").alias("weight"), F.lit(None).cast("string").alias("source_reference")))
    good = F.array(F.struct(F.lit("储蓄").alias("name"), F.lit("有储蓄").alias("description"), F.lit("可降低损失").alias("risk_mitigation")))
    level = F.element_at(F.array(*[F.lit(parse.LEVEL_NAMES[i]) for i in range(3)]), (key % 3 + 1).cast("int"))
    t_kind = "array<struct<name string, description string, risk_mitigation string>>"
    report = explain.render_explanation(key.cast("string"), level, F.when(key % 2 == 0, harm.cast(kind)).otherwise(F.array().cast(kind)), F.when(key % 5 == 0, good.cast(t_kind)).otherwise(F.array().cast(t_kind)), F.lit("人工复核"), F.col("o_orderdate"), monitoring=F.array(F.lit("还款记录")))
    return table(spark, d, "orders").select("o_orderkey", F.md5(report.cast("binary")).alias("report"))


@query("""
WITH o AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, '- credit_amount_total：' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) || chr(10) || '- priority：' || o_orderpriority AS record FROM orders)
SELECT o_custkey, string_agg(chr(10) || '### 申请 ' || i || chr(10) || record, chr(10) ORDER BY i) AS text FROM o GROUP BY o_custkey""")
def batch_prompt_records(spark: SparkSession, d: str) -> DataFrame:
    """The orders of each customer as one batch of applications."""
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.floor("o_totalprice").alias("credit_amount_total"), F.col("o_orderpriority").alias("priority"))
    return decode.batch_records(rows, ["credit_amount_total", "priority"], "o_custkey", "o_orderkey")


@query(f"""
SELECT c_custkey, replace(replace('{decode.PLAIN_TEMPLATE}', '$features', '- c_mktsegment: ' || coalesce(c_mktsegment, 'None') || chr(10) || '- c_nationkey: ' || coalesce(CAST(c_nationkey AS VARCHAR), 'None')), '$knowledge', '[1] ' || c_name || chr(10) || '[2] ' || c_mktsegment) AS prompt FROM customer""")
def plain_prompts(spark: SparkSession, d: str) -> DataFrame:
    """Prompts for JSON answers, with features and knowledge."""
    prompt = decode.plain_prompt(["c_mktsegment", "c_nationkey"], F.array("c_name", "c_mktsegment"))
    return table(spark, d, "customer").select("c_custkey", prompt.alias("prompt"))
