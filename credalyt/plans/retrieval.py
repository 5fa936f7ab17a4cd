"""End to end: record to query, hybrid retrieval, prompt, answer, fields."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from credalyt.functions import decode, parse

from credalyt.operators import fusion, udf, vector
from credalyt.operators.bm25index import Index
from credalyt.sources.folders import saved, work_folder

# Fixed value: the default prompt.
TEMPLATE = "客户信息：\n$customer_info\n\n参考知识：\n$knowledge_context\n\n请给出风险等级、风险评分、风险因素、有利因素和审批建议。"


@dataclass(frozen=True)
class Config:
    """What one variant of the system does; the ablation varies ``strategy`` and ``use_retrieval``."""

    name: str = "full"
    use_retrieval: bool = True
    strategy: str = "hybrid"  # hybrid, vector or bm25
    method: str = "rrf"
    per_collection: int = 3
    k: int = 5
    threshold: float = 0.0
    max_items: int = 10
    max_context: int = 4000
    template: str = TEMPLATE


ABLATION = (Config("full"), Config("llm_only", use_retrieval=False), Config("bm25_only", strategy="bm25"), Config("vector_only", strategy="vector"))


def hybrid(docs: DataFrame, queries: DataFrame, k: int, method: str = "rrf", vector_k: int | None = None, bm25_k: int | None = None, threshold: float = 0.0, index: Index | None = None) -> DataFrame:
    """Fused top k for each query and collection from 2k of either side; docs (id, content, embedding,
    collection), queries (query_id, text, embedding).  One scan of the texts and one of the vectors,
    whatever the number of collections."""
    v = vector.knn(docs, queries, vector_k or 2 * k, id_col="id", per="collection")
    b, _ = (index or Index.build(docs, "id", "content", collection="collection")).search(queries, bm25_k or 2 * k, by_collection=True)
    return _fused(v, b, k, method, threshold)


def _fused(v: DataFrame, b: DataFrame, k: int, method: str, threshold: float) -> DataFrame:
    unit = F.struct("query_id", "collection")
    fused = fusion.fuse(method, v.withColumn("query_id", unit), b.withColumn("query_id", unit), k)
    return fusion.above(fused, threshold).withColumn("collection", F.col("query_id.collection")).withColumn("query_id", F.col("query_id.query_id"))


def _depth(config: Config, side: str) -> int:
    """How many hits of a side a config takes from each collection."""
    return 2 * config.per_collection if config.strategy not in ("vector", "bm25") else config.per_collection if config.strategy == side else 0


def sides(docs: DataFrame, queries: DataFrame, configs: list[Config], index: Index | None = None) -> dict[str, DataFrame]:
    """Stored hits of either side, as deep as the deepest config takes: one search a side, whatever the number of configs."""
    folder, found = work_folder(docs.sparkSession, "sides"), {}
    most = {side: max((_depth(c, side) for c in configs), default=0) for side in ("vector", "bm25")}
    if most["vector"]:
        found["vector"] = saved(vector.knn(docs, queries, most["vector"], id_col="id", per="collection"), f"{folder}/vector")
    if most["bm25"]:
        hits, _ = (index or Index.build(docs, "id", "content", collection="collection")).search(queries, most["bm25"], by_collection=True)
        found["bm25"] = saved(hits, f"{folder}/bm25")
    return found


def _best(found: dict[str, DataFrame], config: Config) -> DataFrame:
    """(query_id, doc_id, collection, score, rank): the best of each collection, then the best of all."""
    v, b = [found[side].where(F.col("rank") <= _depth(config, side)) if _depth(config, side) else None for side in ("vector", "bm25")]
    hits = v if b is None else b if v is None else _fused(v, b, config.per_collection, config.method, config.threshold)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "collection", "doc_id"))
    return hits.select("query_id", "doc_id", "collection", "score").withColumn("rank", rank).where(F.col("rank") <= config.k)


def _with_texts(best: DataFrame, docs: DataFrame) -> DataFrame:
    """Hits with content and metadata.  They are stored first, so Spark knows their size and sends a few of
    them to the documents instead of shuffling all texts."""
    stored = saved(best, work_folder(docs.sparkSession, "hits"))
    return stored.join(docs.select(F.col("id").alias("doc_id"), "collection", "content", "metadata"), ["doc_id", "collection"])


def retrieve(docs: DataFrame, queries: DataFrame, config: Config, index: Index | None = None) -> DataFrame:
    """(query_id, doc_id, collection, content, score, rank): the best of each collection, then the best of all."""
    return _with_texts(_best(sides(docs, queries, [config], index), config), docs)


def questions(customers: DataFrame, columns: list[str], embedder: udf.Embedder) -> DataFrame:
    """(query_id, text, embedding): each retrieval query of the records once, under its own text, embedded once."""
    texts = customers.select(decode.build_query(columns).alias("text")).distinct()
    asked = texts.select(F.col("text").alias("query_id"), "text", udf.embed(F.col("text"), embedder).alias("embedding"))
    return saved(asked, work_folder(customers.sparkSession, "questions"))


def knowledge_context(hits: DataFrame, most: Column | int, max_items: int = 10) -> DataFrame:
    """(query_id, context): formatted hits in rank order up to ``most`` characters.

    The first hit that does not fit is cut if more than 100 characters are left, and ends the context."""
    most = F.lit(most) if isinstance(most, int) else most
    w = Window.partitionBy("query_id").orderBy("rank")
    kind = decode.source_type(F.col("collection"), F.col("metadata"))
    rows = hits.where(F.col("rank") <= max_items).withColumn("item", decode.knowledge_item(F.col("rank"), kind, F.col("content"), F.col("score")))
    rows = rows.withColumns({"used": F.coalesce(F.sum(F.length("item") + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "most": most})
    rows = rows.withColumn("over", F.col("used") + F.length("item") > F.col("most"))
    rows = rows.withColumn("overs", F.sum(F.col("over").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    left = F.col("most") - F.col("used")
    cut = F.when(F.length("item") > left, F.concat(F.left("item", left - 3), F.lit("..."))).otherwise(F.col("item"))
    rows = rows.where((F.col("overs") == 0) | ((F.col("overs") == 1) & F.col("over") & (left > 100))).withColumn("item", F.when(F.col("over"), cut).otherwise(F.col("item")))
    return rows.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "item"))), lambda x: x["item"]), "\n\n").alias("context"))


def prompts(customers: DataFrame, hits: DataFrame | None, columns: list[str], config: Config = Config(), by: str = "query_id") -> DataFrame:
    """``customers`` (query_id and the record's columns) with prompt; ``by`` is their column that hits have as query_id.

    Customers that share it and whose records are equally long share a context, which is made once.
    No context holds more than ``max_context`` characters of a text, so no more are joined."""
    rows = customers.withColumn("customer_info", decode.format_record(columns))
    if hits is not None:
        rows = rows.withColumns({"_by": F.col(by), "_room": F.lit(config.max_context) - F.length("customer_info") - 500})
        cut = hits.withColumn("content", F.left("content", F.lit(config.max_context))).withColumnRenamed("query_id", "_by")
        each = cut.join(rows.select("_by", "_room").distinct(), "_by").withColumn("query_id", F.struct("_by", "_room"))
        context = knowledge_context(each, F.col("_room"), config.max_items).select("query_id.*", "context")
        rows = rows.join(context, ["_by", "_room"], "left").drop("_by", "_room")
    else:
        rows = rows.withColumn("context", F.lit(None).cast("string"))
    text = decode.fill_template(config.template, customer_info=F.col("customer_info"), knowledge_context=F.coalesce("context", F.lit(decode.NO_KNOWLEDGE)))
    return rows.withColumn("prompt", text).drop("customer_info", "context")


def analyze(customers: DataFrame, docs: DataFrame, columns: list[str], embedder: udf.Embedder, generator: Callable, config: Config = Config(), index: Index | None = None, hits: DataFrame | None = None) -> DataFrame:
    """``customers`` with prompt, answer and its parsed fields (``analysis``).

    Customers with one retrieval query share a search; ``hits`` of ``questions`` may be given."""
    if config.use_retrieval and hits is None:
        hits = retrieve(docs, questions(customers, columns, embedder), config, index)
    asking = customers.withColumn("_question", decode.build_query(columns))
    rows = prompts(asking, hits if config.use_retrieval else None, columns, config, "_question").drop("_question")
    rows = rows.withColumn("answer", udf.generate(F.col("prompt"), generator))
    return rows.withColumn("analysis", parse.analysis(F.coalesce("answer.text", F.lit(""))))


def ablation(customers: DataFrame, docs: DataFrame, columns: list[str], embedder: udf.Embedder, generator: Callable, configs: tuple[Config, ...] = ABLATION) -> DataFrame:
    """Results of every config, one table: what ``batch.ablation_summary`` takes; customers have true_level."""
    out = every = hits = None
    retrieving = [c for c in configs if c.use_retrieval]
    if retrieving:
        found = sides(docs, questions(customers, columns, embedder), retrieving)  # one search a side for all variants
        for i, c in enumerate(configs):
            if c.use_retrieval:
                best = _best(found, c).withColumn("variant", F.lit(i))
                every = best if every is None else every.unionByName(best)
        most = max(c.max_context for c in retrieving)
        texts = _with_texts(every, docs).withColumn("content", F.left("content", F.lit(most)))  # and one scan of the texts
        hits = saved(texts, work_folder(docs.sparkSession, "texts"))
    for i, c in enumerate(configs):
        own = hits.where(F.col("variant") == i).drop("variant") if c.use_retrieval else None
        rows = analyze(customers, docs, columns, embedder, generator, c, hits=own)
        a = F.col("analysis")
        part = rows.select(
            F.lit(c.name).alias("config"), "query_id", "true_level", F.col("answer.error").isNull().alias("success"), parse.binary_label(a["risk_level"]).alias("level"), a["risk_score"].alias("score"), F.coalesce(a["approval"], F.lit(parse.PENDING)).alias("approval"),
            F.size(a["risk_factors"]).alias("n_factors"), F.size(a["knowledge_sources"]).alias("n_sources"), a["risk_level"].isNotNull().alias("parsed"), (F.col("answer.input_tokens") + F.col("answer.output_tokens")).alias("tokens"),
        )
        out = part if out is None else out.unionByName(part)
    return out


