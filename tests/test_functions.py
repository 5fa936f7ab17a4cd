"""Golden values and edge cases of expressions."""

import pytest
from pyspark.sql import functions as F

from credalyt.functions import explain, parse, text

ANSWER = """## 风险分析
风险等级：**中风险**
综合评分：56分
关键风险因素：
1. 收入：收入波动较大
   权重：高
   参考来源：[2]
2. 负债率偏高
有利因素：
- 担保：有担保人
  可缓释部分风险
审批建议：人工复核
授信额度：5万元
监控指标：还款记录、收入变化、负债
风险缓释：增加担保，缩短期限
知识来源：[1] 风险案例 [2] 监管法规 [1] 风险案例
"""


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "t string").select(expression(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize(("t", "level"), [("风险等级：低风险", 0), ("风险判定: **高风险**", 2), ("总体风险较高", 2), ("风险中等", 1), ("", None), ("无", None)])
def test_level(spark, t, level):
    assert one(spark, t, parse.risk_level) == level


@pytest.mark.parametrize(("t", "score"), [("风险评分：75分", 75), ("评分 250", 100), ("得到 40/100", 40), ("约 999分, 12分", 12), ("none", None)])
def test_score(spark, t, score):
    assert one(spark, t, parse.risk_score) == score


def test_analysis(spark):
    a = one(spark, ANSWER, parse.analysis)
    assert (a.risk_level, a.risk_score, a.approval) == (1, 56, "人工复核")
    assert [(f.name, f.description, f.weight, f.source_reference) for f in a.risk_factors] == [("收入", "收入波动较大", "高", "2"), ("负债率偏高", "负债率偏高", "中", None)]
    assert [(f.name, f.description, f.risk_mitigation) for f in a.favorable_factors] == [("担保", "有担保人", "可缓释部分风险")]
    assert a.suggestions.credit_limit == "5万元"
    assert a.suggestions.monitoring == ["还款记录", "收入变化"]
    assert a.suggestions.mitigation == ["增加担保", "缩短期限"]
    assert [(c.source_id, c.source_type) for c in a.knowledge_sources] == [("1", "风险案例"), ("2", "监管法规")]
    assert one(spark, ANSWER, lambda t: parse.validation_errors(parse.analysis(t))) == []


def test_analysis_of_nothing(spark):
    a = one(spark, "", lambda t: parse.with_sentinels(parse.analysis(t)))
    assert (a.risk_level, a.risk_score, a.approval, a.risk_level_text) == (-1, -1, "待定", "未知")
    with pytest.raises(Exception, match="no level"):
        one(spark, "", lambda t: parse.strict(parse.analysis(t)))


def test_json_answer(spark):
    assert tuple(one(spark, 'x {"risk_score": 0.8, "recommendation": "拒绝"} y', parse.json_answer)) == (0.8, 1, True)
    assert tuple(one(spark, "no object", parse.json_answer)) == (0.5, 0, False)
    assert tuple(one(spark, "{broken", parse.json_answer)) == (0.5, 0, False)


def test_chunks(spark):
    assert one(spark, "abcdefghij", lambda t: text.chunks(t, 4, 1)) == ["abcd", "defg", "ghij", "j"]
    assert one(spark, "", text.chunks) == []
    assert "".join(one(spark, "x" * 123, text.slices)) == "x" * 123


def test_cjk_tokens(spark):
    assert one(spark, "个人贷AB", text.cjk_ngram_tokens) == ["个人", "个人贷", "人贷", "ab"]
    assert one(spark, "好", text.cjk_ngram_tokens) == []


def test_explain_scores_stay_in_range(spark):
    for t in ("", "因此" * 20 + "首先其次最后", "可能" * 9 + "x" * 500, "# 标题\n" + "".join(explain.TERMS + explain.REQUIRED)):
        s = one(spark, t, explain.scores)
        assert all(1 <= s[d] <= 5 for d in explain.DIMENSIONS)
    with pytest.raises(Exception, match="between 1 and 5"):
        spark.range(1).select(explain.checked(F.lit(7))).collect()


def test_keyword_risk(spark):
    assert tuple(one(spark, "逾期而且欺诈", explain.keyword_risk)) == (2, 80, 2, 0, 0)
    assert tuple(one(spark, "收入稳定良好", explain.keyword_risk)) == (0, 35, 0, 0, 3)
    assert one(spark, "", explain.keyword_risk).level == 1
