"""Reports, scaling, encoding, splits and oversampling over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credalyt.operators import metrics, prep
from credalyt.operators.neighbours import neighbours
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


#: customers with gaps: every seventh balance and every ninth segment is unknown
_GAPS = "SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS c_acctbal, CASE WHEN c_custkey % 9 <> 0 THEN c_mktsegment END AS c_mktsegment, c_nationkey FROM customer"


def gaps(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").selectExpr("c_custkey", "CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS c_acctbal", "CASE WHEN c_custkey % 9 <> 0 THEN c_mktsegment END AS c_mktsegment", "c_nationkey")


@query("""
WITH g AS (""" + _GAPS + """)
""" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing, (count(*) - count({c})) * 100.0::DOUBLE / count(*) AS percent FROM g" for c in ("c_custkey", "c_acctbal", "c_mktsegment", "c_nationkey")))  # fmt: skip
def missing_report(spark: SparkSession, d: str) -> DataFrame:
    """Missing values of each column."""
    return prep.missing_report(gaps(spark, d))


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, min({c})::DOUBLE AS min, round(quantile_cont({c}, 0.25), 6) AS q25, round(median({c}), 6) AS median, round(quantile_cont({c}, 0.75), 6) AS q75, max({c})::DOUBLE AS max FROM lineitem" for c in ("l_quantity", "l_extendedprice", "l_discount")))
def dataset_stats(spark: SparkSession, d: str) -> DataFrame:
    """Mean, deviation and exact quantiles."""
    s = prep.statistics(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])
    return s.select("column", *[F.round(c, 6).alias(c) for c in ("mean", "std", "min", "q25", "median", "q75", "max")])


@query("SELECT o_orderstatus AS value, count(*) AS n, count(*)::DOUBLE / (SELECT count(*) FROM orders) AS ratio FROM orders GROUP BY o_orderstatus")
def class_distribution(spark: SparkSession, d: str) -> DataFrame:
    """Counts and shares of a class."""
    return prep.class_distribution(table(spark, d, "orders"), "o_orderstatus")


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_distinct FROM part" for c in ("p_brand", "p_type", "p_size")))
def nunique_report(spark: SparkSession, d: str) -> DataFrame:
    """Exact distinct counts."""
    return prep.distinct_counts(table(spark, d, "part"), ["p_brand", "p_type", "p_size"])


@query("""
WITH r AS (SELECT c_nationkey, c_mktsegment FROM (""" + _GAPS + """))
SELECT ['c_phone'] AS missing_columns, (SELECT count(*) - count(c_nationkey) + count(*) - count(c_mktsegment) FROM r) AS null_cells, (SELECT count(*) FROM r) AS n_rows,
  (SELECT list(DISTINCT c_mktsegment ORDER BY c_mktsegment) FILTER (c_mktsegment IS NOT NULL) FROM r) AS target_values,
  (SELECT count(*) FROM r) - (SELECT count(*) FROM (SELECT DISTINCT * FROM r)) AS duplicate_rows""")  # fmt: skip
def integrity_check(spark: SparkSession, d: str) -> DataFrame:
    """Missing columns, null cells and duplicate rows."""
    return prep.integrity_report(gaps(spark, d).select("c_nationkey", "c_mktsegment"), ["c_nationkey", "c_mktsegment", "c_phone"], "c_mktsegment")


@query("SELECT l_orderkey, l_linenumber, round((l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER (), 6) AS l_quantity, round((l_extendedprice - avg(l_extendedprice) OVER ()) / stddev_pop(l_extendedprice) OVER (), 6) AS l_extendedprice FROM lineitem")
def zscore(spark: SparkSession, d: str) -> DataFrame:
    """Standardized columns."""
    rows = prep.standardize(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"), ["l_quantity", "l_extendedprice"])
    return rows.withColumns({c: F.round(c, 6) for c in ("l_quantity", "l_extendedprice")})


@query("SELECT p_partkey, round((p_retailprice - min(p_retailprice) OVER ()) / (max(p_retailprice) OVER () - min(p_retailprice) OVER ()), 6) AS p_retailprice FROM part")
def minmax_scale(spark: SparkSession, d: str) -> DataFrame:
    """Columns to [0, 1]."""
    return prep.minmax(table(spark, d, "part").select("p_partkey", "p_retailprice"), ["p_retailprice"]).withColumn("p_retailprice", F.round("p_retailprice", 6))


@query("WITH g AS (" + _GAPS + ") SELECT c_custkey, round(coalesce(c_acctbal, (SELECT avg(c_acctbal) FROM g)), 6) AS c_acctbal FROM g")
def impute_mean(spark: SparkSession, d: str) -> DataFrame:
    """Nulls become the mean."""
    return prep.impute(gaps(spark, d).select("c_custkey", "c_acctbal"), ["c_acctbal"]).withColumn("c_acctbal", F.round("c_acctbal", 6))


@query("WITH g AS (" + _GAPS + ") SELECT c_custkey, round(coalesce(c_acctbal, (SELECT median(c_acctbal) FROM g)), 6) AS c_acctbal FROM g")
def impute_median(spark: SparkSession, d: str) -> DataFrame:
    """Nulls become the median."""
    return prep.impute(gaps(spark, d).select("c_custkey", "c_acctbal"), ["c_acctbal"], "median").withColumn("c_acctbal", F.round("c_acctbal", 6))


@query("WITH g AS (" + _GAPS + ") SELECT c_custkey, coalesce(c_mktsegment, (SELECT c_mktsegment FROM g WHERE c_mktsegment IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS c_mktsegment FROM g")
def impute_mode(spark: SparkSession, d: str) -> DataFrame:
    """Nulls become the most frequent value."""
    return prep.impute(gaps(spark, d).select("c_custkey", "c_mktsegment"), ["c_mktsegment"], "most_frequent")


@query("SELECT p_partkey, CAST(dense_rank() OVER (ORDER BY p_brand) - 1 AS INT) AS p_brand FROM part")
def label_encode(spark: SparkSession, d: str) -> DataFrame:
    """Codes in the order of the values."""
    return prep.label_encode(table(spark, d, "part").select("p_partkey", "p_brand"), ["p_brand"])


@query("SELECT o_orderkey, CAST(o_orderstatus = 'F' AS INT) AS o_orderstatus_F, CAST(o_orderstatus = 'O' AS INT) AS o_orderstatus_O, CAST(o_orderstatus = 'P' AS INT) AS o_orderstatus_P FROM orders")
def one_hot(spark: SparkSession, d: str) -> DataFrame:
    """A 0/1 column for each value."""
    return prep.one_hot(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", ["F", "O", "P"])


@query("SELECT nation_label - 1 AS nation_label, n FROM (SELECT 1 + n_regionkey % 2 AS nation_label, count(*) AS n FROM nation GROUP BY 1)")
def label_shift(spark: SparkSession, d: str) -> DataFrame:
    """Labels 1/2 become 0/1."""
    rows = table(spark, d, "nation").select((1 + F.col("n_regionkey") % 2).alias("nation_label"))
    return prep.shift_label(rows, "nation_label").groupBy("nation_label").agg(F.count("*").alias("n"))


@query("""
WITH r AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('42|' || c_custkey), c_custkey) AS r, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer)
SELECT c_custkey, c_mktsegment, r <= floor(n * 0.2::DOUBLE + 0.5) AS in_test FROM r""")
def stratified_split(spark: SparkSession, d: str) -> DataFrame:
    """A fifth of each segment for tests."""
    return prep.split(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_custkey", 0.2, 42, "c_mktsegment")


@query("SELECT c_custkey FROM customer ORDER BY md5('42|' || c_custkey), c_custkey LIMIT 100")
def subsample(spark: SparkSession, d: str) -> DataFrame:
    """A hundred rows without replacement."""
    return prep.sample_rows(table(spark, d, "customer").select("c_custkey"), "c_custkey", 100)


@query("SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) <= floor((SELECT count(*) FROM supplier) * 0.7::DOUBLE) AS in_train FROM supplier")
def positional_split(spark: SparkSession, d: str) -> DataFrame:
    """The first seven tenths train."""
    return prep.positional_split(table(spark, d, "supplier").select("s_suppkey"), "s_suppkey")


_NEAR = """
m AS (SELECT vec_id, embedding FROM embeddings WHERE label = 7),
pairs AS (SELECT x.vec_id AS id, y.vec_id AS neighbour, sqrt(list_sum(list_transform(range(1, len(x.embedding) + 1), lambda i: (x.embedding[i]::DOUBLE - y.embedding[i]::DOUBLE) * (x.embedding[i]::DOUBLE - y.embedding[i]::DOUBLE)))) AS d
  FROM m x JOIN m y ON x.vec_id <> y.vec_id),
near AS (SELECT id, neighbour, d, row_number() OVER (PARTITION BY id ORDER BY d, neighbour) AS rank FROM pairs)"""


def _minority(spark: SparkSession, d: str) -> DataFrame:
    """The class to oversample: one label's vectors."""
    return table(spark, d, "embeddings").where("label = 7").select("vec_id", "embedding")


@query(f"WITH {_NEAR} SELECT id, neighbour, CAST(rank AS INT) AS rank, round(d, 6) AS d FROM near WHERE rank <= 5")
def smote_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Five nearest rows of the same class."""
    return prep.minority_neighbours(_minority(spark, d), "vec_id", "embedding").withColumn("d", F.round("d", 6))


@query("SELECT count(DISTINCT embedding) AS vectors, CAST(count(DISTINCT embedding) * (count(DISTINCT embedding) - 1) AS DOUBLE) AS pairs, true AS no_more_than_all FROM embeddings WHERE label = 7")
def smote_pruning(spark: SparkSession, d: str) -> DataFrame:
    """What the neighbour search compares, of all pairs."""
    took = neighbours(_minority(spark, d), "vec_id", "embedding")[1]
    return took.select("vectors", F.col("pairs").cast("double").alias("pairs"), (F.col("compared") <= F.col("vectors") * F.col("vectors")).alias("no_more_than_all"))


_UNIT = "(('0x' || substr(md5('{seed}|' || new_id), 1, 8))::BIGINT)::DOUBLE / 4294967296"


@query(f"""
WITH {_NEAR},
base AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS place, count(*) OVER () AS n FROM m),
wanted AS (SELECT count_if(label <> 7) - count_if(label = 7) AS w FROM embeddings),
new0 AS (SELECT vec_id AS base, c * n + place AS new_id FROM base, wanted, range(0, 100) t(c) WHERE c * n + place < w),
new1 AS (SELECT *, CAST(floor({_UNIT.format(seed=42)} * 5) + 1 AS INT) AS rank, {_UNIT.format(seed=43)} AS l FROM new0)
SELECT new_id, base, neighbour, round(l, 6) AS lambda,
  round(list_sum(list_transform(range(1, len(x.embedding) + 1), lambda i: x.embedding[i]::DOUBLE + l * (y.embedding[i]::DOUBLE - x.embedding[i]::DOUBLE))), 5) AS total
FROM new1 JOIN near ON base = id AND new1.rank = near.rank JOIN m x ON x.vec_id = base JOIN m y ON y.vec_id = neighbour""")
def smote_oversample(spark: SparkSession, d: str) -> DataFrame:
    """New rows between neighbours, until the class has as many as all others."""
    rows = prep.smote(table(spark, d, "embeddings"), "label", 7, "vec_id", "embedding")
    return rows.select("new_id", "base", "neighbour", F.round("lambda", 6).alias("lambda"), F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


@query("SELECT count(*) FILTER (toxic = 0)::DOUBLE / count(*) FILTER (toxic = 1) AS scale_pos_weight FROM labels")
def class_weight(spark: SparkSession, d: str) -> DataFrame:
    """Negatives over positives."""
    return metrics.class_weight(table(spark, d, "labels"), "toxic")
