"""Decision tables: facts meet rules through an index of intervals.

A rule's age interval is cut into dyadic ranges (of 2**level values, starting at a multiple of
that), at most two of each level, and so is its interval of claims; conditions that a rule does
not have are ``any``.  A rule's row in the index is an equality key: its kind (which conditions
are any, and the two levels), its profile and policy type, and the two ranges.  A fact looks up
one key for each kind that occurs, the ranges of that level which hold its age and claims, and
meets a rule under exactly one key.  So matching is an equi-join that Spark broadcasts or
shuffles by size, with no comparison of all facts and rules.  Kinds are at most 4 times the
squared number of levels; levels are the binary digits of the span of the table's bounds, as
values beyond the bounds count as just beyond.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A rule applies where each of its conditions that is not null holds.
RULE_SCHEMA = "rule_id int, age_min int, age_max int, profile string, policy_type string, claims_max int, approve boolean, discount int, base_price int"
ANY = -1


def _cover(first: Column, last: Column, levels: int) -> Column:
    """Dyadic ranges of [first, last]: array of (level, node)."""
    pieces = []
    for k in range(levels + 1):
        l, r = F.shiftright(first + F.lit((1 << k) - 1), k), F.shiftright(last + 1, k)
        node = lambda at, here, k=k: F.when((l < r) & (at % 2 == 1), F.struct(F.lit(k).alias("level"), here.alias("node")))  # noqa: B023, E731
        pieces += [node(l, l), node(r, r - 1)]
    return F.filter(F.array(*pieces), lambda x: x.isNotNull())


def _any() -> Column:
    return F.array(F.struct(F.lit(ANY).alias("level"), F.lit(0).cast("long").alias("node")))


class _Axis:
    """A number that rules bound: its place among the bounds of the table."""

    def __init__(self, lo: int | None, hi: int | None):
        self.lo, self.hi = (lo, hi) if lo is not None and hi is not None else (0, 0)
        self.levels = (self.hi - self.lo + 3).bit_length()

    def place(self, value: Column) -> Column:
        """From 0, just below all bounds, to just above them."""
        return (F.least(F.greatest(value.cast("long"), F.lit(self.lo - 1)), F.lit(self.hi + 1)) - (self.lo - 1)).cast("long")

    def cover(self, low: Column, high: Column) -> Column:
        """Ranges of an interval whose missing ends are open; ``any`` if both are missing."""
        bounded = _cover(self.place(F.coalesce(low, F.lit(self.lo - 1))), self.place(F.coalesce(high, F.lit(self.hi + 1))), self.levels)
        return F.when(low.isNull() & high.isNull(), _any()).otherwise(bounded)


def indexed(rules: DataFrame) -> tuple[DataFrame, _Axis, _Axis]:
    """The index (kind, profile, type, ranges, rule) and its two axes."""
    r = rules.agg(F.least(F.min("age_min"), F.min("age_max")).alias("a0"), F.greatest(F.max("age_min"), F.max("age_max")).alias("a1"), F.min("claims_max").alias("c0"), F.max("claims_max").alias("c1")).first()
    ages, claims = _Axis(r.a0, r.a1), _Axis(r.c0, r.c1)
    none = F.lit(None).cast("int")
    rows = rules.select(*[F.col(c).alias(f"r_{c}") for c in ("rule_id", "approve", "discount", "base_price")], F.col("profile"), F.col("policy_type"), ages.cover(F.col("age_min"), F.col("age_max")).alias("a"), claims.cover(none, F.col("claims_max")).alias("c"))
    rows = rows.select("*", F.explode("a").alias("x")).select("*", F.explode("c").alias("y"))
    key = [F.col("profile").isNull().alias("any_profile"), F.col("policy_type").isNull().alias("any_type"), F.col("x.level").alias("age_level"), F.col("y.level").alias("claims_level"), F.coalesce("profile", F.lit("")).alias("k_profile"), F.coalesce("policy_type", F.lit("")).alias("k_type"), F.col("x.node").alias("age_node"), F.col("y.node").alias("claims_node")]
    return rows.select(*key, "r_rule_id", "r_approve", "r_discount", "r_base_price"), ages, claims


KIND = ["any_profile", "any_type", "age_level", "claims_level"]
KEY = [*KIND, "k_profile", "k_type", "age_node", "claims_node"]


def looked_up(facts: DataFrame, kinds: list, ages: _Axis, claims: _Axis) -> DataFrame:
    """``facts`` with a key for each kind; a fact with nulls has none where a condition asks for the value."""
    def node(axis: _Axis, column: str, level: int) -> Column:
        return F.lit(0).cast("long") if level == ANY else F.shiftright(axis.place(F.col(column)), level)

    keys = []
    for k in kinds:
        parts = [F.lit(k.any_profile), F.lit(k.any_type), F.lit(k.age_level), F.lit(k.claims_level), F.lit("") if k.any_profile else F.col("profile"), F.lit("") if k.any_type else F.col("policy_type"), node(ages, "age", k.age_level), node(claims, "claims", k.claims_level)]
        there = [F.col(c).isNotNull() for c, wanted in (("profile", not k.any_profile), ("policy_type", not k.any_type), ("age", k.age_level != ANY), ("claims", k.claims_level != ANY)) if wanted]
        whole = F.struct(*[p.alias(n) for p, n in zip(parts, KEY)])
        held = there[0] if there else F.lit(True)
        for t in there[1:]:
            held = held & t
        keys.append(F.when(held, whole))
    if not keys:
        none = F.struct(*[F.lit(None).cast(t).alias(n) for n, t in zip(KEY, ("boolean", "boolean", "int", "int", "string", "string", "long", "long"))])
        return facts.select(*facts.columns, none.alias("_key"))
    return facts.select(*facts.columns, F.explode_outer(F.filter(F.array(*keys), lambda x: x.isNotNull())).alias("_key"))


def evaluate(facts: DataFrame, rules: DataFrame) -> DataFrame:
    """(facts.*, rule_ids, approved, discount, base_price, price) of facts (fact_id, age, claims, profile, policy_type).

    Discounts add up; the base price is that of the smallest matching rule that has one; a
    fact is approved if a rule says so and none denies.  Stateless: rules do not chain."""
    index, ages, claims = indexed(rules)
    kinds = index.select(*KIND).distinct().orderBy(*KIND).collect()  # bounded by the levels
    rows = looked_up(facts, kinds, ages, claims)
    f = F.col
    on = f(f"_key.{KEY[0]}") == f(KEY[0])
    for k in KEY[1:]:
        on = on & (f(f"_key.{k}") == f(k))
    hits = rows.join(index, on, "left")
    has_price = F.when(f("r_base_price").isNotNull(), f("r_rule_id"))
    out = hits.groupBy(*facts.columns).agg(
        F.array_sort(F.collect_set("r_rule_id")).alias("rule_ids"),
        (F.coalesce(F.max(f("r_approve").cast("int")), F.lit(0)) == 1).alias("some"),
        (F.coalesce(F.min(f("r_approve").cast("int")), F.lit(1)) == 0).alias("denied"),
        F.coalesce(F.sum("r_discount"), F.lit(0)).cast("long").alias("total"),
        F.coalesce(F.min_by("r_base_price", has_price), F.lit(0)).alias("base"),
    )
    price = f("base") * (100 - F.least(f("total"), F.lit(100))) / F.lit(100.0)
    return out.select(*facts.columns, "rule_ids", (f("some") & ~f("denied")).alias("approved"), f("total").alias("discount"), f("base").alias("base_price"), price.alias("price"))
