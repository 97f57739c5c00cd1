"""Exact quantiles whose memory use does not grow with the rows.

The built-in exact percentile keeps every distinct value in one task. Here the
rank is narrowed down instead: count the rows in equal-width buckets, keep the
bucket that holds the rank, and repeat inside it until few rows are left. Each
round is one scan with partial aggregation and sends at most ``BUCKETS`` small
rows per task to the shuffle; the driver sees one row per rank.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

BUCKETS = 4096
# Rows of a bracket that one task may sort by value.
SORT_ROWS = 1_000_000


@dataclass
class _Bracket:
    """Rows whose values lie in [low, high], and the ranks sought among them."""

    low: float
    high: float
    below: int  # rows smaller than low
    rows: int
    ranks: list[int]

    def holds(self, value: Column) -> Column:
        return (value >= F.lit(self.low)) & (value <= F.lit(self.high))

    @property
    def width(self) -> float:
        return self.high / 2 - self.low / 2  # halves, so that it cannot overflow

    def settled(self, sort_rows: int) -> bool:
        return self.rows <= sort_rows or not self.width > 0


def exact_quantiles(
    df: DataFrame,
    column: str,
    probabilities: Sequence[float],
    sort_rows: int = SORT_ROWS,
    buckets: int = BUCKETS,
) -> list[float | None]:
    """Linearly interpolated quantiles of ``column``; nulls and NaN are left out.

    Infinite values count; between a finite and an infinite one the result is infinite,
    between both infinities it is NaN.

    The result is double, and the cast to double keeps the order, so all
    comparisons are made on doubles.
    """
    # Null in place of NaN rather than a filter, which would repeat the cast.
    values = df.select(F.nanvl(F.col(column).cast("double"), F.lit(None)).alias("v"))
    finite = F.when(F.abs("v") < math.inf, F.col("v"))
    head = values.agg(
        F.count("v").alias("n"),
        F.count_if(F.col("v") == -math.inf).alias("lowest"),
        F.count_if(F.col("v") == math.inf).alias("highest"),
        F.min(finite).alias("low"),
        F.max(finite).alias("high"),
    ).first()
    if head["n"] == 0:
        return [None for _ in probabilities]
    places = [p * (head["n"] - 1) for p in probabilities]
    ranks = sorted({f(x) for x in places for f in (math.floor, math.ceil)})
    # Infinite values have a rank by their count alone; only finite ones are bracketed.
    above = head["n"] - head["highest"]
    at = {r: -math.inf if r < head["lowest"] else math.inf for r in ranks}
    inner = [r - head["lowest"] for r in ranks if head["lowest"] <= r < above]
    if inner:
        whole = _Bracket(head["low"], head["high"], 0, above - head["lowest"], inner)
        found = _values_at(values.select(finite.alias("v")), whole, sort_rows, buckets)
        at |= {r + head["lowest"]: v for r, v in found.items()}

    def interpolate(place: float) -> float:
        low, high = at[math.floor(place)], at[math.ceil(place)]
        if low == high:
            return low
        if math.isinf(low) or math.isinf(high):
            return low + high if math.isinf(low) and math.isinf(high) else low if math.isinf(low) else high
        return low + (high - low) * (place - math.floor(place))

    return [interpolate(x) for x in places]


def _values_at(
    values: DataFrame, whole: _Bracket, sort_rows: int, buckets: int
) -> dict[int, float]:
    brackets = [whole]
    while any(not b.settled(sort_rows) for b in brackets):
        open_ = [b for b in brackets if not b.settled(sort_rows)]
        narrowed = _narrow(values, open_, buckets)
        if sum(b.rows for b in narrowed) >= sum(b.rows for b in open_) and not _tighter(narrowed, open_):
            raise RuntimeError(f"quantile brackets don't shrink: {open_}")
        brackets = [b for b in brackets if b.settled(sort_rows)] + narrowed
    found = {r: b.low for b in brackets if b.low == b.high for r in b.ranks}
    rest = [b for b in brackets if b.low != b.high]
    return found | (_sorted_lookup(values, rest) if rest else {})


def _tighter(narrowed: list[_Bracket], open_: list[_Bracket]) -> bool:
    """Whether the brackets cover less than before, or are more."""
    return len(narrowed) != len(open_) or any(
        (new.low, new.high) != (old.low, old.high) for new, old in zip(narrowed, open_)
    )


def _first_match(brackets: list[_Bracket], value: Column, outcome) -> Column:
    """``outcome(i, bracket)`` of the one bracket that holds the value, else null."""
    chain = F
    for i, b in enumerate(brackets):
        chain = chain.when(b.holds(value), outcome(i, b))
    return chain


def _narrow(values: DataFrame, brackets: list[_Bracket], buckets: int) -> list[_Bracket]:
    v = F.col("v")

    def bucket(i: int, b: _Bracket) -> Column:
        share = (v / 2 - F.lit(b.low / 2)) / F.lit(b.width)
        place = F.least(F.lit(buckets - 1), F.floor(share * buckets))
        return F.lit(i * buckets).cast("long") + place

    counted = (
        values.select("v", _first_match(brackets, v, bucket).alias("bucket"))
        .groupBy("bucket")
        .agg(F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        .filter(F.col("bucket").isNotNull())
        .withColumn("bracket", F.floor(F.col("bucket") / buckets))
    )
    hits = _rows_at_ranks(counted, brackets, "bucket")
    narrowed = [
        _Bracket(
            h["low"], h["high"], h["below"], h["n"],
            [r for r in brackets[h["bracket"]].ranks if h["below"] <= r < h["below"] + h["n"]],
        )
        for h in hits
    ]
    return narrowed


def _sorted_lookup(values: DataFrame, brackets: list[_Bracket]) -> dict[int, float]:
    v = F.col("v")
    bracket = F.col("bracket")
    distinct = (
        values.select("v", _first_match(brackets, v, lambda i, b: F.lit(i)).alias("bracket"))
        .groupBy(bracket, F.when(bracket.isNotNull(), v).alias("v"))
        .agg(F.count("v").alias("n"))
        .filter(bracket.isNotNull())
    )
    return {
        r: h["v"]
        for h in _rows_at_ranks(distinct, brackets, "v")
        for r in brackets[h["bracket"]].ranks
        if h["below"] <= r < h["below"] + h["n"]
    }


def _rows_at_ranks(counted: DataFrame, brackets: list[_Bracket], order: str):
    """The counted rows that cover a sought rank, with the number of rows below each."""
    earlier = (
        Window.partitionBy("bracket").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    )
    start, wanted = F, F.lit(False)
    for i, b in enumerate(brackets):
        start = start.when(F.col("bracket") == i, F.lit(b.below))
    below = start + F.coalesce(F.sum("n").over(earlier), F.lit(0))
    ranked = counted.withColumn("below", below)
    for i, b in enumerate(brackets):
        for r in b.ranks:
            covers = (F.col("below") <= r) & (F.col("below") + F.col("n") > r)
            wanted = wanted | ((F.col("bracket") == i) & covers)
    return ranked.filter(wanted).collect()
