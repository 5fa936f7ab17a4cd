"""Structured fields from model-written answers.

A section is the text between its heading and the next heading: the documented intent.
Levels are 0, 1, 2 for low, medium and high; unknown values are null inside the library
and become -1, 未知 or 待定 only in ``with_sentinels``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from credalyt.functions.text import let, strip

# Texts of levels and approvals.
LEVEL_NAMES = {0: "低风险", 1: "中风险", 2: "高风险", -1: "未知"}
APPROVED, REJECTED, REVIEW, PENDING = "批准", "拒绝", "人工复核", "待定"
# Headings that begin a section and headings that end one.
_STARTS = {"risk": ("风险因素",), "favorable": ("有利因素",), "approval": ("审批建议", "决策建议", "管理建议")}
_ENDS = {"risk": "有利因素|综合|风险评分|审批建议|管理建议|决策建议|知识来源", "favorable": "综合|风险评分|审批建议|管理建议|决策建议|知识来源", "approval": "知识来源"}
# The forms in which answers state their fields.
_BULLET = r"(?:^|\n)\s*(?:\d+\.|[-•*])\s*"
_LEVEL = r"(?:风险等级|风险判定)[：:\s]*[*]*([低中高]+风险?)[*]*"
_SCORE = r"(?:风险评分|综合评分|评分)[：:\s]*(\d{1,3})\s*(?:分)?"
_LOOSE_SCORE = r"(\d{1,3})\s*(?:分|/100)"
_PLAIN_SCORES = (r"风险评分[：:]\s*(\d+)", r"评分[：:]\s*(\d+)", r"(\d+)\s*分")
_CITATION = r"\[(\d+)\]\s*(风险案例|监管法规|行业知识|参考资料)"
_LIMIT = r"(?:授信额度|额度)[：:\s]*([^\n]+)"
_OBJECT = r"\{[^}]+\}"


def _any(text: Column, *parts: str) -> Column:
    found = F.contains(text, F.lit(parts[0]))
    for p in parts[1:]:
        found = found | F.contains(text, F.lit(p))
    return found


def level_of(text: Column) -> Column:
    """Low before high before medium; null if none is named."""
    return F.when(_any(text, "低"), 0).when(_any(text, "高"), 2).when(_any(text, "中"), 1)


def risk_level(answer: Column) -> Column:
    """The labelled level, else the first that the text speaks of."""
    labelled = F.regexp_extract(answer, _LEVEL, 1)
    spoken = F.when(_any(answer, "低风险", "风险较低"), 0).when(_any(answer, "高风险", "风险较高"), 2).when(_any(answer, "中风险", "风险中等"), 1)
    return F.when(labelled != "", level_of(labelled)).otherwise(spoken)


def risk_level_or_medium(text: Column) -> Column:
    """The plain variant: names of levels, then bare words; medium if there is none."""
    named = F.when(_any(text, "低风险"), 0).when(_any(text, "高风险"), 2).when(_any(text, "中风险"), 1)
    bare = F.when(_any(text, "低"), 0).when(_any(text, "中"), 1).when(_any(text, "高"), 2)
    return F.coalesce(named, bare, F.lit(1))


def level_name(level: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in LEVEL_NAMES.items() for x in kv)), level), F.lit(LEVEL_NAMES[-1]))


def _digits(text: Column, pattern: str) -> Column:
    d = F.regexp_extract(text, pattern, 1)
    return F.when(d != "", F.least(d.cast("decimal(38,0)"), F.lit(100)).cast("int"))


def risk_score(answer: Column) -> Column:
    """The labelled score up to 100, else the first number of points up to 100."""
    loose = F.filter(F.transform(F.regexp_extract_all(answer, F.lit(_LOOSE_SCORE), 1), lambda d: d.cast("int")), lambda n: n <= 100)
    return F.coalesce(_digits(answer, _SCORE), F.get(loose, F.lit(0)))


def risk_score_plain(text: Column) -> Column:
    """The plain variant: three patterns in order."""
    return F.coalesce(*[_digits(text, p) for p in _PLAIN_SCORES])


def approval_of(text: Column) -> Column:
    return F.when(_any(text, "拒绝", "不批准", "不予批准"), REJECTED).when(_any(text, "人工复核", "人工审核", "需复核"), REVIEW).when(_any(text, "批准", "通过", "同意"), APPROVED)


def sections(answer: Column, names: tuple[str, ...] = tuple(_STARTS)) -> Column:
    """struct of the texts of sections.  The answer is cut once, at the lines that have a heading within
    their first characters; a section goes from after its heading (and its line's colon, if any) to the
    next such line with one of its own ends."""
    cuts = F.split(answer, rf"\n(?=[^\n]{{0,12}}(?:{_ENDS['risk']}))")  # the ends of all sections are among these

    def one(pieces: Column, name: str) -> Column:
        first = F.array_position(F.transform(pieces, lambda x: _any(x, *_STARTS[name])), True).cast("int")

        def rest(at: Column) -> Column:
            head = F.regexp_replace(F.element_at(pieces, at), rf"^[\s\S]*?(?:{'|'.join(_STARTS[name])})[^\n:：]*[:：]?\**[ \t]*", "")
            if _ENDS[name] == _ENDS["risk"]:
                return head
            after = F.slice(pieces, at + 1, F.size(pieces))
            stop = F.array_position(F.transform(after, lambda x: x.rlike(rf"^[^\n]{{0,12}}(?:{_ENDS[name]})")), True).cast("int")
            more = let(stop, lambda n: F.slice(after, 1, F.when(n > 0, n - 1).otherwise(F.size(after))))
            return F.array_join(F.concat(F.array(head), more), "\n")

        return let(first, lambda at: F.when(at > 0, rest(at)).when(at == 0, F.lit("")))

    return let(cuts, lambda pieces: F.struct(*[one(pieces, n).alias(n) for n in names]))


def approval_in(part: Column, answer: Column) -> Column:
    """From the section on approval, else from the whole answer."""
    return F.coalesce(approval_of(part), approval_of(answer))


def approval(answer: Column) -> Column:
    return approval_in(sections(answer, ("approval",))["approval"], answer)


def approval_plain(text: Column) -> Column:
    """The plain variant, with fewer words and a default."""
    return F.when(_any(text, "拒绝", "不批准"), REJECTED).when(_any(text, "人工复核", "人工审核"), REVIEW).when(_any(text, "批准", "通过"), APPROVED).otherwise(PENDING)


def _blocks(part: Column) -> Column:
    blocks = F.filter(F.transform(F.split(part, _BULLET), lambda b: strip(b)), lambda b: F.length(b) >= 5)
    return F.slice(blocks, 1, 10)


def _told(line: Column) -> Column:
    """struct<name, text> of a block's first line."""
    colon = F.split(line, "[:：]", 2)
    return let(colon, lambda c: F.when(F.size(c) > 1, F.struct(strip(c[0]).alias("name"), strip(c[1]).alias("text"))).otherwise(F.struct(F.left(line, F.lit(50)).alias("name"), line.alias("text"))))


def _read(block: Column) -> Column:
    """struct<first struct<name, text>, more array<string>> of a block."""
    lines = F.transform(F.split(block, "\n"), strip)
    return let(lines, lambda x: F.struct(_told(x[0]).alias("first"), F.filter(F.slice(x, 2, F.size(x)), lambda y: y != "").alias("more")))


def risk_factors_in(part: Column) -> Column:
    """array<struct<name, description, weight, source_reference>> of a section, at most ten."""

    def fold(acc: Column, line: Column) -> Column:
        """What a line says: a weight, a description, a source, or more of the description."""

        def kept(k: Column) -> Column:
            told, ref = strip(F.regexp_extract(line, r"[:：]\s*(.+)", 1)), F.regexp_extract(line, r"\[(\d+)\]", 1)
            more = F.when(acc["description"] != "", F.concat(acc["description"], F.lit(" "), line)).otherwise(line)
            return F.struct(
                F.when(k == 0, acc["description"]).when(k == 1, F.when(told != "", told).otherwise(acc["description"])).when(k == 2, acc["description"]).otherwise(more).alias("description"),
                F.when(k == 0, F.when(_any(line, "高"), "高").when(_any(line, "低"), "低").otherwise("中")).otherwise(acc["weight"]).alias("weight"),
                F.when((k == 2) & (ref != ""), ref).otherwise(acc["source_reference"]).alias("source_reference"),
            )

        return let(F.when(_any(line, "权重", "风险等级"), 0).when(_any(line, "描述", "说明"), 1).when(_any(line, "来源", "参考"), 2).otherwise(3), kept)

    def factor(block: Column) -> Column:
        start = lambda b: F.struct(b["first"]["text"].alias("description"), F.lit("中").alias("weight"), F.lit(None).cast("string").alias("source_reference"))
        whole = lambda b: let(F.aggregate(b["more"], start(b), fold), lambda r: F.struct(F.left(b["first"]["name"], F.lit(100)).alias("name"), F.left(r["description"], F.lit(500)).alias("description"), r["weight"].alias("weight"), r["source_reference"].alias("source_reference")))
        return let(_read(block), whole)

    return F.filter(F.transform(_blocks(part), factor), lambda f: f["name"] != "")


def risk_factors(answer: Column) -> Column:
    return risk_factors_in(sections(answer, ("risk",))["risk"])


def favorable_factors_in(part: Column) -> Column:
    """array<struct<name, description, risk_mitigation>> of a section, at most ten."""
    helps = lambda x: _any(x, "降低", "缓释", "作用")

    def factor(block: Column) -> Column:
        def whole(b: Column) -> Column:
            description = F.concat_ws(" ", b["first"]["text"], F.array_join(F.filter(b["more"], lambda x: ~helps(x)), " "))
            mitigation = F.coalesce(F.get(F.reverse(F.filter(b["more"], helps)), F.lit(0)), F.lit(""))
            return F.struct(F.left(b["first"]["name"], F.lit(100)).alias("name"), F.left(strip(description), F.lit(500)).alias("description"), F.left(mitigation, F.lit(200)).alias("risk_mitigation"))

        return let(_read(block), whole)

    return F.transform(_blocks(part), factor)


def favorable_factors(answer: Column) -> Column:
    return favorable_factors_in(sections(answer, ("favorable",))["favorable"])


def _listed(part: Column, heading: str) -> Column:
    text = F.regexp_extract(part, rf"(?:{heading})[：:\s]*([\s\S]*?)(?:\n\n|\n[-•*]|\n\d+\.|\n(?:授信额度|监控指标|关注指标|风险缓释|缓释措施|其他措施)|\z)", 1)
    return F.slice(F.filter(F.transform(F.split(text, "[,，、\n]"), lambda x: strip(x)), lambda x: F.length(x) > 2), 1, 10)


def suggestions_in(part: Column) -> Column:
    """struct<credit_limit, monitoring, mitigation> of the section on approval."""
    limit = F.left(strip(F.regexp_extract(part, _LIMIT, 1)), F.lit(200))
    return F.struct(limit.alias("credit_limit"), _listed(part, "监控指标|关注指标").alias("monitoring"), _listed(part, "风险缓释|缓释措施|其他措施").alias("mitigation"))


def suggestions(answer: Column) -> Column:
    return let(sections(answer, ("approval",))["approval"], suggestions_in)


def citations(answer: Column) -> Column:
    """array<struct<source_id, source_type>>, the first of each id."""
    both = F.arrays_zip(F.regexp_extract_all(answer, F.lit(_CITATION), 1).alias("source_id"), F.regexp_extract_all(answer, F.lit(_CITATION), 2).alias("source_type"))
    return F.aggregate(both, F.array().cast("array<struct<source_id:string,source_type:string>>"), lambda acc, c: F.when(F.exists(acc, lambda a: a["source_id"] == c["source_id"]), acc).otherwise(F.concat(acc, F.array(c))))


def json_answer(answer: Column) -> Column:
    """struct<risk_score, label, ok> of the first JSON object in a text; (0.5, 0, false) if there is none."""
    found = F.from_json(F.regexp_extract(answer, _OBJECT, 0), "risk_score double, recommendation string, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    ok = found.isNotNull() & found["_bad"].isNull() & (F.regexp_extract(answer, _OBJECT, 0) != "")
    label = F.when(F.coalesce(found["recommendation"], F.lit(APPROVED)) == APPROVED, 0).otherwise(1)
    return F.struct(
        F.when(ok, F.coalesce(found["risk_score"], F.lit(0.5))).otherwise(F.lit(0.5)).alias("risk_score"),
        F.when(ok, label).otherwise(0).alias("label"),
        ok.alias("ok"),
    )


def analysis(answer: Column) -> Column:
    """All fields of an answer: its sections are found once, each field is read once."""

    def fields(p: Column) -> Column:
        return F.struct(
            p["level"].alias("risk_level"),
            level_name(p["level"]).alias("risk_level_text"),
            risk_score(answer).alias("risk_score"),
            risk_factors_in(p["parts"]["risk"]).alias("risk_factors"),
            favorable_factors_in(p["parts"]["favorable"]).alias("favorable_factors"),
            approval_in(p["parts"]["approval"], answer).alias("approval"),
            suggestions_in(p["parts"]["approval"]).alias("suggestions"),
            citations(answer).alias("knowledge_sources"),
        )

    return let(F.struct(sections(answer).alias("parts"), risk_level(answer).alias("level")), fields)


def strict(parsed: Column) -> Column:
    """The analysis; a missing level or score stops the query."""
    return let(parsed, lambda p: F.when(p["risk_level"].isNull() | p["risk_score"].isNull(), F.raise_error(F.lit("an answer has no level or no score"))).otherwise(p))


def _filled(parsed: Column, level: Column, score: Column, approval: Column) -> Column:
    return let(parsed, lambda p: p.withField("risk_level", F.coalesce(p["risk_level"], level)).withField("risk_score", F.coalesce(p["risk_score"], score)).withField("approval", F.coalesce(p["approval"], approval)))


def with_fallback(parsed: Column, level: Column, score: Column, suggestion: Column) -> Column:
    """Unknown level, score and approval replaced."""
    return _filled(parsed, level, score, suggestion)


def with_sentinels(parsed: Column) -> Column:
    """Nulls as -1 and 待定: the form that leaves the library."""
    return _filled(parsed, F.lit(-1), F.lit(-1), F.lit(PENDING))


def score_level(score: Column) -> Column:
    """Level of a score: up to 30, up to 70, above; null below zero."""
    return F.when(score < 0, F.lit(None).cast("int")).when(score <= 30, 0).when(score <= 70, 1).when(score.isNotNull(), 2)


def validation_errors(parsed: Column) -> Column:
    """Names of the checks that an analysis fails."""

    def failed(p: Column) -> Column:
        level, score = p["risk_level"], p["risk_score"]
        checks = F.array(
            F.when(level.isNull(), "level"),
            F.when(score.isNull(), "score"),
            F.when(F.size(p["risk_factors"]) <= 0, "factors"),
            F.when(p["approval"].isNull(), "approval"),
            F.when(score_level(score) != level, "score does not fit level"),
        )
        return F.filter(checks, lambda x: x.isNotNull())

    return let(parsed, failed)


def binary_label(level: Column) -> Column:
    """1 from medium up; unknown is 0."""
    return F.coalesce((level >= 1).cast("int"), F.lit(0))


def probability(score: Column) -> Column:
    """A hundredth of a positive score, else one half."""
    return F.when(score > 0, score / F.lit(100.0)).otherwise(F.lit(0.5))
