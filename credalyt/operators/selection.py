"""Exact quantiles by distributed selection.

A quantile asks for one or two ranks.  Each rank is narrowed in rounds: a sketch of the values in
the open interval that holds it proposes two cuts close to either side, and exact counts of the
values below, at, between and above the cuts say where the rank is.  The interval shrinks to
about 4 / ``ACCURACY`` of its values a round (a cut that holds many equal values is an answer or
is left out), whatever the distribution; once it has no more than ``FEW`` values, these are sorted.
All ranks of all columns share a round's two aggregates; the state of a task is a sketch and
four counts a rank.  Nothing is shuffled but these.

Values are taken as doubles.  Nulls and NaN are left out; a column without values gives None.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACCURACY = 1000
FEW = 4096


@dataclass
class _Rank:
    """The value with ``rank`` smaller ones among the ``n`` values of a column between low and high (both excluded)."""

    column: str
    rank: int
    n: int
    low: float | None = None
    high: float | None = None
    value: float | None = None

    def inside(self) -> Column:
        x = _value(self.column)
        cond = x.isNotNull()
        cond = cond if self.low is None else cond & (x > self.low)
        return cond if self.high is None else cond & (x < self.high)

    def settle(self, lo: float, hi: float, below: int, at_lo: int, between: int, at_hi: int) -> None:
        """Where the rank is, given exact counts."""
        for count, answer, low, high in ((below, None, self.low, lo), (at_lo, lo, None, None), (between, None, lo, hi), (at_hi, hi, None, None)):
            if self.rank < count:
                if answer is not None:
                    self.value = answer
                else:
                    self.low, self.high, self.n = low, high, count
                return
            self.rank -= count
        self.low, self.n = hi, self.n - below - at_lo - between - at_hi


def _value(column: str) -> Column:
    x = F.col(column).cast("double")
    return F.when(~F.isnan(x), x)


def _narrowed(df: DataFrame, open_ranks: list[_Rank]) -> None:
    cuts = []
    for i, r in enumerate(open_ranks):
        p = (r.rank + 0.5) / r.n
        ends = [max(0.0, p - 2 / ACCURACY), min(1.0, p + 2 / ACCURACY)]
        cuts.append(F.percentile_approx(F.when(r.inside(), _value(r.column)), ends, ACCURACY).alias(f"c{i}"))
    found = df.agg(*cuts).first()
    counts = []
    for i, r in enumerate(open_ranks):
        lo, hi = found[f"c{i}"]
        x, inside = _value(r.column), r.inside()
        tests = (x < lo, x == lo, (x > lo) & (x < hi), (x == hi) & (x != lo))
        counts += [F.count_if(inside & t).alias(f"n{i}_{j}") for j, t in enumerate(tests)]
    row = df.agg(*counts).first()
    for i, r in enumerate(open_ranks):
        r.settle(*found[f"c{i}"], *[row[f"n{i}_{j}"] for j in range(4)])


def quantiles(df: DataFrame, wanted: dict[str, list[float]], few: int = FEW) -> dict[str, list[float | None]]:
    """For each column its exact quantiles, linear between the two closest ranks."""
    df = df.select(*wanted)
    sizes = df.agg(*[F.count(_value(c)).alias(f"n{i}") for i, c in enumerate(wanted)]).first()
    ranks: dict[tuple[str, int], _Rank] = {}
    for i, (c, qs) in enumerate(wanted.items()):
        n = sizes[f"n{i}"]
        for q in qs if n else ():
            at = (n - 1) * q
            for k in {math.floor(at), math.ceil(at)}:
                ranks[c, k] = _Rank(c, k, n)
    while True:
        todo = [r for r in ranks.values() if r.value is None]
        large = [r for r in todo if r.n > few]
        if not large:
            break
        _narrowed(df, large)
    if todo:
        row = df.agg(*[F.array_sort(F.collect_list(F.when(r.inside(), _value(r.column)))).alias(f"v{i}") for i, r in enumerate(todo)]).first()  # few values each
        for i, r in enumerate(todo):
            r.value = row[f"v{i}"][r.rank]

    def between(c: str, n: int, q: float) -> float | None:
        if not n:
            return None
        at = (n - 1) * q
        lo, hi = ranks[c, math.floor(at)].value, ranks[c, math.ceil(at)].value
        return lo + (hi - lo) * (at - math.floor(at))

    return {c: [between(c, sizes[f"n{i}"], q) for q in qs] for i, (c, qs) in enumerate(wanted.items())}
