"""Codes to phrases, records to text, text to prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from credalyt.functions.text import token_estimate

# Codes of the German credit data set and their texts.
CODES: dict[str, dict[str, str]] = {
    "checking_status": {"A11": "< 0 DM（账户透支）", "A12": "0 <= ... < 200 DM", "A13": ">= 200 DM / 薪资分配至少1年", "A14": "无支票账户"},
    "credit_history": {"A30": "没有贷款记录/所有贷款已还清", "A31": "所有贷款已按时还清", "A32": "现有贷款按时还款至今", "A33": "存在延迟还款记录", "A34": "存在关键账户/其他银行存在风险"},
    "purpose": {"A40": "购买新车", "A41": "购买二手车", "A42": "购买家具/设备", "A43": "购买收音机/电视", "A44": "购买家用电器", "A45": "维修", "A46": "教育", "A47": "度假", "A48": "再培训", "A49": "商业用途", "A410": "其他"},
    "savings_status": {"A61": "< 100 DM", "A62": "100 <= ... < 500 DM", "A63": "500 <= ... < 1000 DM", "A64": ">= 1000 DM", "A65": "无储蓄账户/未知"},
    "employment": {"A71": "失业", "A72": "就业 < 1年", "A73": "就业 1 <= ... < 4年", "A74": "就业 4 <= ... < 7年", "A75": "就业 >= 7年"},
    "personal_status": {"A91": "男性 - 离婚/分居", "A92": "女性 - 离婚/分居/已婚", "A93": "男性 - 单身", "A94": "男性 - 已婚/丧偶", "A95": "女性 - 单身"},
    "other_parties": {"A101": "无", "A102": "共同申请人", "A103": "担保人"},
    "property_magnitude": {"A121": "房地产", "A122": "建筑协会储蓄协议/人寿保险", "A123": "汽车/其他", "A124": "无财产/未知"},
    "other_payment_plans": {"A141": "银行", "A142": "商店", "A143": "无"},
    "housing": {"A151": "租房", "A152": "自有住房", "A153": "免费住房"},
    "job": {"A171": "非技术工人 - 无固定住所", "A172": "非技术工人 - 有固定住所", "A173": "技术工人/职员", "A174": "管理层/个体经营者/高素质员工"},
    "own_telephone": {"A191": "无", "A192": "有（以客户名义注册）"},
    "foreign_worker": {"A201": "是", "A202": "否"},
}
# Display names of the features.
FEATURES = {
    "checking_status": "支票账户状态",
    "duration": "贷款期限（月）",
    "credit_history": "信用历史",
    "purpose": "贷款目的",
    "credit_amount": "贷款金额（DM）",
    "savings_status": "储蓄账户状态",
    "employment": "就业状态",
    "installment_commitment": "分期付款占收入比例",
    "personal_status": "个人状态",
    "other_parties": "其他担保人",
    "residence_since": "居住时间（年）",
    "property_magnitude": "财产规模",
    "age": "年龄",
    "other_payment_plans": "其他还款计划",
    "housing": "住房类型",
    "existing_credits": "现有信贷数量",
    "job": "工作类型",
    "num_dependents": "受抚养人数",
    "own_telephone": "是否拥有电话",
    "foreign_worker": "是否为外籍工人",
}
# Shorter texts that a retrieval query uses, in the order of the query.
QUERY_PHRASES = {
    "purpose": ("贷款目的: ", {"A40": "购买新车", "A41": "购买二手车", "A42": "购买家具设备", "A43": "购买收音机电视", "A44": "购买家用电器", "A45": "维修", "A46": "教育", "A47": "度假", "A48": "再培训", "A49": "商业用途", "A410": "其他"}),
    "credit_history": ("信用历史: ", {"A30": "没有贷款记录", "A31": "所有贷款已按时还清", "A32": "现有贷款按时还款", "A33": "存在延迟还款记录", "A34": "存在风险账户"}),
    "checking_status": ("支票账户: ", {"A11": "账户透支", "A12": "账户余额较低", "A13": "账户余额充足", "A14": "无支票账户"}),
    "employment": ("就业状态: ", {"A71": "失业", "A72": "就业不到1年", "A73": "就业1-4年", "A74": "就业4-7年", "A75": "就业7年以上"}),
}
# Names of knowledge sources.
SOURCE_NAMES = {"risk_case": "风险案例", "regulation": "监管法规", "industry_knowledge": "行业知识", "default": "参考资料"}
COLLECTION_TYPES = {"risk_cases": "risk_case", "regulations": "regulation", "industry_knowledge": "industry_knowledge"}
NO_KNOWLEDGE = "（未检索到相关知识库内容）"


def literal_map(values: dict) -> Column:
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))


def decoded(code: Column, values: dict[str, str]) -> Column:
    """The text of a code; an unknown code stays."""
    return F.coalesce(F.element_at(literal_map(values), code), code)


def amount_band(amount: Column) -> Column:
    return F.when(amount > 10000, "高额贷款").when(amount > 5000, "中等额度贷款").when(amount.isNotNull(), "小额贷款")


def duration_band(duration: Column) -> Column:
    return F.when(duration > 36, "长期贷款").when(duration > 12, "中期贷款").when(duration.isNotNull(), "短期贷款")


def build_query(columns: list[str]) -> Column:
    """A record's retrieval query from those of its columns that say something; nulls are left out."""
    parts = [F.concat(F.lit(lead), decoded(F.col(c), values)) for c, (lead, values) in QUERY_PHRASES.items() if c in columns]
    if "credit_amount" in columns:
        parts.append(amount_band(F.col("credit_amount")))
    if "duration" in columns:
        parts.append(duration_band(F.col("duration")))
    text = F.concat_ws(" ", *parts) if parts else F.lit("")
    return F.when(text != "", text).otherwise("信贷风险评估")


def format_record(columns: list[str]) -> Column:
    """One line for each column that is not null: display name and decoded value."""
    lines = [F.concat(F.lit(f"- {FEATURES.get(c, c)}："), decoded(F.col(c).cast("string"), CODES[c]) if c in CODES else F.col(c).cast("string")) for c in columns]
    return F.concat_ws("\n", *lines)


def record_map(columns: list[str]) -> Column:
    """The record as a map of strings without its nulls."""
    return F.map_filter(F.map_from_arrays(F.array(*map(F.lit, columns)), F.array(*[F.col(c).cast("string") for c in columns])), lambda _, v: v.isNotNull())


def document_text(kind: Column) -> Column:
    """Text of a knowledge document from its fields, by type."""
    case = F.concat(F.lit("案例类型: "), "case_type", F.lit("\n案例描述: "), "description", F.lit("\n风险指标: "), F.array_join("risk_indicators", ", "), F.lit("\n处理决策: "), "decision")
    rule = F.concat(F.lit("来源: "), "source", F.lit("\n分类: "), "category", F.lit("\n规则内容: "), "content")
    know = F.concat(F.lit("分类: "), "category", F.lit("\n知识内容: "), "content")
    return F.when(kind == "risk_case", case).when(kind == "regulation", rule).when(kind == "industry_knowledge", know).otherwise(F.to_json(F.struct("content", "category", "source")))


def document_metadata(kind: Column) -> Column:
    """Flat metadata of a knowledge document, by type; entries that do not apply are left out."""
    of = lambda t, c: F.when(kind == t, c) if t else c
    return F.map_filter(
        F.map_from_arrays(
            F.array(*map(F.lit, ("id", "type", "case_type", "risk_indicators", "source", "category"))),
            F.array(F.col("id"), kind, of("risk_case", F.col("case_type")), of("risk_case", F.array_join("risk_indicators", ", ")), of("regulation", F.col("source")), F.when(kind != "risk_case", F.col("category"))),
        ),
        lambda _, v: v.isNotNull(),
    )


def source_type(collection: Column, metadata: Column) -> Column:
    """From the collection, else from the metadata, else the default."""
    return F.coalesce(F.element_at(literal_map(COLLECTION_TYPES), collection), F.element_at(metadata, "type"), F.lit("default"))


def knowledge_item(index: Column, kind: Column, content: Column, score: Column) -> Column:
    """'[i] source', content and, for positive scores, the relevance."""
    name = F.coalesce(F.element_at(literal_map(SOURCE_NAMES), kind), F.lit(SOURCE_NAMES["default"]))
    head = F.format_string("[%d] %s\n%s", index.cast("int"), name, content)
    return F.when(score > 0, F.concat(head, F.format_string("\n(相关度: %.2f)", score.cast("double")))).otherwise(head)


def relevance(distance: Column) -> Column:
    """1 - d up to a distance of one, else zero."""
    return F.when(distance <= 1, 1 - distance).otherwise(F.lit(0.0))


def fill_template(template: str, **values: Column) -> Column:
    """``$name`` replaced by each value."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit(f"${name}"), value)
    return out


def prompt_stats(prompt: Column, items: Column, most_items: int, template: str) -> Column:
    return F.struct(F.length(prompt).alias("prompt_length"), token_estimate(prompt).alias("estimated_tokens"), F.least(items, F.lit(most_items)).alias("knowledge_items_used"), F.lit(template).alias("template_type"))


def entry(title: Column, content: Column, metadata: Column) -> Column:
    """A knowledge entry."""
    return F.struct(title.alias("title"), content.alias("content"), metadata.alias("metadata"))




def batch_records(records: DataFrame, columns: list[str], batch: str, order: str) -> DataFrame:
    """(batch, text): the records of each batch, numbered from 1 in their order, each under its heading.

    A batch is what one prompt holds, so its size is that of a prompt."""
    place = F.row_number().over(Window.partitionBy(batch).orderBy(order))
    one = records.select(batch, place.alias("i"), format_record(columns).alias("record"))
    items = F.array_sort(F.collect_list(F.struct("i", "record")))
    return one.groupBy(batch).agg(items.alias("items")).select(batch, F.array_join(F.transform("items", lambda x: F.concat(F.format_string("\n### 申请 %d\n", x["i"]), x["record"])), "\n").alias("text"))


# Fixed value: the fields of the answer that the plain prompt asks for.
ANSWER_FIELDS = ("risk_level", "risk_score", "risk_factors", "favorable_factors", "recommendation", "knowledge_sources")
PLAIN_TEMPLATE = "你是金融风控专家。请根据客户特征和专业知识评估风险。\n\n## 客户特征\n$features\n\n## 相关专业知识\n$knowledge\n\n请只输出JSON，字段：" + "、".join(ANSWER_FIELDS)


def plain_prompt(names: list[str], knowledge: Column | None = None, template: str = PLAIN_TEMPLATE) -> Column:
    """The prompt for a JSON answer: '- name: value' for each feature, '[i] text' for each piece of knowledge."""
    features = F.concat_ws("\n", *[F.concat(F.lit(f"- {n}: "), F.coalesce(F.col(n).cast("string"), F.lit("None"))) for n in names])
    pieces = F.lit("") if knowledge is None else F.array_join(F.transform(knowledge, lambda x, i: F.concat(F.format_string("[%d] ", i + 1), x)), "\n")
    return fill_template(template, features=features, knowledge=pieces)
