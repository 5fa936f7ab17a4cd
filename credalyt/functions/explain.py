"""Rule-based scores of explanations and keyword-based classification of texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from credalyt.functions.text import let, present, total_count

# Words that the scores look for.
CONNECTIVES = ["因此", "综上所述", "基于以上分析", "由此可见", "主要原因", "根本原因", "导致", "使得", "首先", "其次", "最后", "一方面", "另一方面"]
HEDGES = ["可能", "也许", "大概", "似乎", "好像"]
EVIDENCE = ["根据", "参考", "引用", "数据表明", "统计显示", "案例", "法规", "规定", "条款", "第条", "历史记录", "过往经验", "行业惯例"]
PLAIN_SPEECH = ["即", "例如", "比如", "具体来说", "换句话说", "简单来说", "通俗地说", "可以理解为"]
REQUIRED = ["风险等级", "风险因素", "有利因素", "审批建议", "授信额度", "监控指标", "风险缓释"]
TERMS = ["风险缓释", "风险敞口", "信用评级", "授信额度", "贷后管理", "风险预警", "违约概率", "损失率", "担保", "抵押", "质押", "保证", "合规", "监管", "内控"]
REASONING = ["分析.*得出", "综合.*评估", "基于.*判断", "根据.*建议"]
# Words of the keyword classifier.
HIGH = ["伪造", "虚假", "欺诈", "洗钱", "赌博", "诈骗", "可疑", "异常", "不明", "失联", "非法", "违规", "透支", "逾期", "拖欠", "风险", "多头借贷", "高利贷", "套现", "盗取", "冒用"]
MEDIUM = ["负债", "困难", "紧张", "下滑", "亏损", "压力", "不稳定", "波动", "下降", "减少", "周转", "紧急"]
LOW = ["稳定", "良好", "正常", "按时", "信用记录良好", "有储蓄", "收入稳定", "无拖欠", "无逾期", "有经验", "详细计划"]
TEXT_FEATURES = ["贷款用途", "经营", "装修", "教育", "医疗", "购车", "购房", "创业", "投资", "消费", "旅游", "还款", "逾期", "信用", "收入", "负债", "风险", "欺诈", "可疑", "异常", "稳定", "良好", "困难", "紧急", "周转", "扩大", "购买", "支付"]
DIMENSIONS = ("logic_clarity", "evidence_sufficiency", "understandability", "completeness", "professionalism")
# Weights of the weighted composite.
WEIGHTS = (0.25, 0.25, 0.20, 0.15, 0.15)


def _within(score: Column) -> Column:
    return F.least(F.greatest(score, F.lit(1)), F.lit(5))


def _steps(value: Column, steps: list[tuple[float, int]], other: int) -> Column:
    out = None
    for least, score in steps:
        out = F.when(value >= least, score) if out is None else out.when(value >= least, score)
    return out.otherwise(other)


def mean_sentence(text: Column) -> Column:
    """Mean length of the sentences that are not blank."""
    parts = F.filter(F.split(text, "[。！？\n]"), lambda s: s.rlike(r"(?U)\S"))
    return let(parts, lambda p: F.aggregate(p, F.lit(0), lambda a, s: a + F.length(s)) / F.greatest(F.size(p), F.lit(1)))


def logic_clarity(links: Column, hedges: Column, structured: Column) -> Column:
    """Three, more for connectives and a first-second-last structure, less for hedges."""
    score = _within(F.lit(3) + _steps(links, [(5, 2), (3, 1)], 0))
    return _within(_within(score - (hedges >= 3).cast("int")) + structured.cast("int"))


def evidence_sufficiency(words: Column, cited: Column) -> Column:
    """By words of evidence, one more for a numbered citation."""
    return _within(_steps(words, [(8, 5), (5, 4), (2, 3)], 2) + cited.cast("int"))


def understandability(plain: Column, mean: Column, headed: Column) -> Column:
    """Three, more for explaining words, short sentences and headings, less for long sentences."""
    score = _within(F.lit(3) + (plain >= 3).cast("int"))
    return _within(_within(score + F.when(mean < 50, 1).when(mean > 100, -1).otherwise(0)) + headed.cast("int"))


def completeness(elements: Column) -> Column:
    """By the share of required elements."""
    return _steps(elements / F.lit(float(len(REQUIRED))), [(0.9, 5), (0.7, 4), (0.5, 3), (0.3, 2)], 1)


def professionalism(terms: Column, patterns: Column) -> Column:
    """By technical terms, one more for two patterns of reasoning."""
    return _within(_steps(terms, [(8, 5), (5, 4), (3, 3)], 2) + (patterns >= 2).cast("int"))


def counts(text: Column) -> Column:
    """struct of all that the scores count in a text."""
    patterns = [text.rlike(p).cast("int") for p in REASONING]
    return F.struct(
        total_count(text, CONNECTIVES).alias("links"), total_count(text, HEDGES).alias("hedges"), text.rlike("(?s)首先.*其次.*最后").alias("structured"),
        total_count(text, EVIDENCE).alias("evidence"), text.rlike(r"\[[0-9]+\]").alias("cited"),
        present(text, PLAIN_SPEECH).alias("plain"), mean_sentence(text).alias("mean"), text.rlike(r"(?m)^#+\s").alias("headed"),
        present(text, REQUIRED).alias("elements"), present(text, TERMS).alias("terms"), sum(patterns[1:], patterns[0]).alias("patterns"),
    )


def _dimensions(c: Column) -> Column:
    dims = [logic_clarity(c["links"], c["hedges"], c["structured"]), evidence_sufficiency(c["evidence"], c["cited"]), understandability(c["plain"], c["mean"], c["headed"]), completeness(c["elements"]), professionalism(c["terms"], c["patterns"])]
    return F.struct(*[d.alias(n) for d, n in zip(dims, DIMENSIONS)], c["elements"].alias("elements"))


def scores(text: Column) -> Column:
    """struct of the five dimensions and their mean; the text is counted once, the rest is arithmetic."""
    whole = lambda d: F.struct(*[d[n].alias(n) for n in DIMENSIONS], (sum((d[n] for n in DIMENSIONS[1:]), d[DIMENSIONS[0]]) / F.lit(5.0)).alias("average"))
    return let(counts(text), lambda c: let(_dimensions(c), whole))


def comments(text: Column) -> Column:
    """struct of one remark for each dimension, for readers of a score."""
    said = lambda c, good, fair, poor: F.when(c >= 4, good).when(c == 3, fair).otherwise(poor)

    def remarks(s: Column) -> Column:
        return F.struct(
            said(s["logic_clarity"], "逻辑连接充分", "逻辑基本合理", "逻辑不足").alias("logic_clarity"),
            said(s["evidence_sufficiency"], "证据充分", "有一定证据", "证据不足").alias("evidence_sufficiency"),
            said(s["understandability"], "易于理解", "基本清晰", "不易理解").alias("understandability"),
            F.concat(said(s["completeness"], "要素完整", "要素基本齐全", "要素缺失"), F.format_string("（%d/%d）", s["elements"], F.lit(len(REQUIRED)))).alias("completeness"),
            said(s["professionalism"], "术语丰富", "术语基本", "术语不足").alias("professionalism"),
        )

    return let(counts(text), lambda c: let(_dimensions(c), remarks))


def dimension_map(s: Column) -> Column:
    """The five scores as a map."""
    return F.create_map(*[x for d in DIMENSIONS for x in (F.lit(d), s[d])])


def checked(score: Column) -> Column:
    """The score; one outside 1 to 5 stops the query."""
    return F.when(score.between(1, 5), score).otherwise(F.raise_error(F.lit("a score must lie between 1 and 5")))


def weighted(s: Column) -> Column:
    """The weighted composite of the five scores."""
    def total(x: Column) -> Column:
        parts = [x[d] * F.lit(w) for d, w in zip(DIMENSIONS, WEIGHTS)]
        return sum(parts[1:], parts[0])

    return let(s, total)


def keyword_risk(text: Column) -> Column:
    """struct<level, score, high, medium, low> by which keywords occur."""
    return let(F.struct(present(text, HIGH).alias("h"), present(text, MEDIUM).alias("m"), present(text, LOW).alias("low")), lambda c: _keyword_risk(c["h"], c["m"], c["low"]))


def _keyword_risk(h: Column, m: Column, low: Column) -> Column:
    level = F.when(h >= 2, 2).when((h >= 1) | (m >= 3), 1).when(low >= 2, 0).otherwise(1)
    score = F.when(h >= 2, 70 + F.least(h * 5, F.lit(25))).when((h >= 1) | (m >= 3), 50 + F.least(m * 5, F.lit(20))).when(low >= 2, 20 + F.least(30 - low * 5, F.lit(30))).otherwise(50)
    return F.struct(level.alias("level"), score.alias("score"), h.alias("high"), m.alias("medium"), low.alias("low"))


def keyword_factors(text: Column) -> Column:
    """struct of up to five risk keywords and three favourable ones that occur, in list order."""
    found = lambda words, n: F.slice(F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(text, w)), 1, n)
    return F.struct(found(HIGH, 5).alias("risk_factors"), found(LOW, 3).alias("favorable_factors"))


def text_utilisation(text: Column, factors: Column) -> Column:
    """Half by the share of feature words, half by factors up to six; zero for no text."""
    used = F.lit(0.5) * (present(text, TEXT_FEATURES) / F.lit(float(len(TEXT_FEATURES)))) + F.lit(0.5) * F.least(factors / F.lit(6.0), F.lit(1.0))
    return F.when(F.coalesce(text, F.lit("")) == "", 0.0).otherwise(used)


def explanation_points(success: Column, factors: Column, sources: Column, parsed: Column, score: Column, approval: Column) -> Column:
    """0 to 100: capped points for factors and sources, then parse, score and approval; failures are 0."""
    points = F.least(factors * 10, F.lit(30)) + F.least(sources * 8, F.lit(25)) + F.when(parsed, 25).otherwise(0) + F.when(score >= 0, 10).otherwise(0) + F.when(approval != "待定", 10).otherwise(0)
    return F.when(success, points).otherwise(0)


# What a report says where nothing was found, of the limit by level, and its sources.
NO_RISK, NO_FAVORABLE = "\n暂未识别到明显风险因素。\n", "\n暂未识别到明显有利因素。\n"
LIMITS = {"低风险": "可给予较高授信额度，建议额度为申请金额的100%。", "中风险": "建议适度控制授信额度，可给予申请金额的70%-80%。"}
OTHER_LIMIT = "建议严格控制授信额度或拒绝申请。"
SOURCES = ("风险案例: 类似客户违约案例分析", "监管法规: 个人贷款管理暂行办法", "行业知识: 信贷风险评估最佳实践")


def _optional(lead: str, value: Column, end: str) -> Column:
    return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(lead), value, F.lit(end))).otherwise("")


def render_explanation(record_id: Column, level_text: Column, risk: Column, favorable: Column, approval: Column, at: Column, monitoring: Column | None = None, mitigation: Column | None = None) -> Column:
    """A report in Markdown: level, factors with weight, description and source (struct<name, description, weight,
    source_reference>), favourable ones with their mitigation (struct<name, description, risk_mitigation>), advice,
    limit, what to watch and how to mitigate (arrays of text), and sources.  ``at`` is the time of the analysis."""

    def listed(items: Column, one, none: str) -> Column:
        return F.when(F.size(items) > 0, F.array_join(F.transform(items, one), "")).otherwise(none)

    def harm(x: Column, i: Column) -> Column:
        head = F.concat(F.format_string("\n**%d. ", i + 1), x["name"], F.lit("** (权重: "), F.coalesce(x["weight"], F.lit("中")), F.lit(")\n   "), x["description"], F.lit("\n"))
        return F.concat(head, _optional("   *参考来源: [", x["source_reference"], "]*\n"))

    def help_(x: Column, i: Column) -> Column:
        head = F.concat(F.format_string("\n**%d. ", i + 1), x["name"], F.lit("**\n   "), x["description"], F.lit("\n"))
        return F.concat(head, _optional("   *风险缓释作用: ", x["risk_mitigation"], "*\n"))

    points = lambda items: F.lit("") if items is None else F.array_join(F.transform(F.coalesce(items, F.array().cast("array<string>")), lambda x: F.concat(F.lit("- "), x, F.lit("\n"))), "")
    limit = F.lit(OTHER_LIMIT)
    for level, text in LIMITS.items():
        limit = F.when(level_text == level, text).otherwise(limit)
    return F.concat(
        F.lit("## 风险分析报告\n**客户ID**: "), F.coalesce(record_id, F.lit("N/A")), F.lit("\n**分析时间**: "), F.date_format(at, "yyyy-MM-dd HH:mm:ss"),
        F.lit("\n\n### 一、风险等级判定\n根据综合评估，该客户的风险等级为**"), level_text, F.lit("**。\n"),
        F.lit("\n### 二、风险因素分析\n"), listed(risk, harm, NO_RISK), F.lit("\n### 三、有利因素分析\n"), listed(favorable, help_, NO_FAVORABLE),
        F.lit("\n### 四、决策建议\n**审批建议**: "), approval, F.lit("\n\n**授信额度建议**: "), limit,
        F.lit("\n\n### 五、风险监控指标\n"), points(monitoring), F.lit("\n### 六、风险缓释措施\n"), points(mitigation),
        F.lit("\n### 七、知识来源引用\n" + "".join(f"- [{i}] {x}\n" for i, x in enumerate(SOURCES, 1))),
    )
