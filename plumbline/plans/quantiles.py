"""Exact interpolated quantiles of many columns, without a global sort.

``percentile`` keeps one map entry per distinct value in a single task.  That
is fine for columns with few distinct values and is used there.  For the rest
the wanted ranks are narrowed step by step: a sketch proposes cut points, one
counting pass tells exactly where each rank falls between them, and the cut
points only ever steer the search, so the answer is exact whatever the sketch
returned.  Once the interval around a rank holds few distinct values, those
are counted and the value is read off.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.columns import as_double
from plumbline.plans.aggregates import melt, one_row

# Distinct values that a single task may hold at once, over all columns.
FEW_VALUES = 500_000
SKETCH_ACCURACY = 10_000


@dataclass
class _Interval:
    """Open interval (low, high) known to hold some wanted ranks of a column."""

    column: str
    low: float | None
    high: float | None
    below: int
    rows: int
    distinct: int
    ranks: list[int]

    def contains(self, value: Column) -> Column:
        inside = F.lit(True)
        if self.low is not None:
            inside = inside & (value > F.lit(self.low))
        if self.high is not None:
            inside = inside & (value < F.lit(self.high))
        return inside


def quantiles(
    df: DataFrame,
    columns: list[str],
    probabilities: list[float],
    distinct: dict[str, int] | None = None,
    approx: bool = False,
    few_values: int = FEW_VALUES,
) -> dict[str, list[float | None]]:
    """Quantiles per column, interpolated linearly; ``None`` for empty columns.

    ``distinct`` may pass (approximate) distinct counts that are already known.
    ``approx`` answers from one sketch pass and returns actual elements.
    """
    if not columns:
        return {}
    wanted = F.array(*[F.lit(p) for p in probabilities])
    if approx:
        found = one_row(df, {n: F.percentile_approx(as_double(n), wanted, SKETCH_ACCURACY) for n in columns})
        return {n: list(v) if v else [None] * len(probabilities) for n, v in found.items()}
    if distinct is None:
        distinct = one_row(df, {n: F.approx_count_distinct(as_double(n)) for n in columns})
    small, room = [], few_values
    for n in sorted(columns, key=lambda n: distinct[n]):
        if distinct[n] <= room:
            small.append(n)
            room -= distinct[n]
    large = [n for n in columns if n not in small]
    found = one_row(df, {n: F.percentile(as_double(n), wanted) for n in small})
    result = {n: list(v) if v else [None] * len(probabilities) for n, v in found.items()}
    if large:
        result |= _narrow(df, large, probabilities, few_values)
    return {n: result[n] for n in columns}


def _narrow(
    df: DataFrame, columns: list[str], probabilities: list[float], few_values: int
) -> dict[str, list[float | None]]:
    first = {("rows", n): F.count(as_double(n)) for n in columns}
    first |= {("cuts", n): _cut_points(as_double(n), probabilities) for n in columns}
    seen = one_row(df, first)
    rows = {n: seen["rows", n] for n in columns}
    cuts = {n: seen["cuts", n] for n in columns}
    ranks = {
        n: sorted({r for p in probabilities for r in (math.floor(p * (rows[n] - 1)), math.ceil(p * (rows[n] - 1)))})
        for n in columns
    }
    known: dict[tuple[str, int], float] = {}
    open_intervals = [_Interval(n, None, None, 0, rows[n], rows[n], ranks[n]) for n in columns if rows[n]]
    while open_intervals:
        ready = [i for i in open_intervals if i.distinct <= few_values]
        if ready:
            known |= _read_off(df, ready)
        wide = [i for i in open_intervals if i.distinct > few_values]
        open_intervals = _split(df, wide, known, cuts)
        cuts = {}

    def interpolate(name: str, p: float) -> float | None:
        if not rows[name]:
            return None
        position = p * (rows[name] - 1)
        low, high = known[name, math.floor(position)], known[name, math.ceil(position)]
        return low if low == high else low + (high - low) * (position - math.floor(position))

    return {n: [interpolate(n, p) for p in probabilities] for n in columns}


def _cut_points(value: Column, shares: list[float]) -> Column:
    """Sketched values just below and just above the given shares of the rows."""
    margin = 2.0 / SKETCH_ACCURACY
    around = sorted({min(1.0, max(0.0, s + d)) for s in shares for d in (-margin, margin)})
    return F.percentile_approx(value, F.array(*[F.lit(a) for a in around]), SKETCH_ACCURACY)


def _split(df: DataFrame, intervals: list[_Interval], known: dict, sketched: dict) -> list[_Interval]:
    """Cut each interval close to its ranks; settle ranks that hit a cut point.

    ``sketched`` has the cut points of whole columns when they are known already.
    """
    if not intervals:
        return []
    sketches = {}
    for k, interval in enumerate(intervals):
        if interval.column not in sketched:
            value = as_double(interval.column)
            shares = [(r - interval.below + 0.5) / interval.rows for r in interval.ranks]
            sketches[k] = _cut_points(F.when(interval.contains(value), value), shares)
    found = one_row(df, sketches)
    cuts = {k: _ascending_unique(found[k] if k in found else sketched[i.column]) for k, i in enumerate(intervals)}

    # A value's code counts the cut points it reaches and those it passes: odd
    # codes are the cut points themselves, even codes the gaps around them.
    cells = {}
    for k, interval in enumerate(intervals):
        value = as_double(interval.column)
        cells[str(k)] = F.when(interval.contains(value), value)
    code = F.lit(None).cast("int")
    for k in cuts:
        steps = [(F.col("value") >= F.lit(c)).cast("int") + (F.col("value") > F.lit(c)).cast("int") for c in cuts[k]]
        code = F.when(F.col("column_id") == k, sum(steps[1:], steps[0])).otherwise(code)
    counted = (
        melt(df, cells)
        .groupBy("column_id", code.alias("code"))
        .agg(F.count(F.lit(1)).alias("rows"), F.approx_count_distinct("value").alias("distinct"))
        .collect()
    )
    remaining = []
    for k, interval in enumerate(intervals):
        below = interval.below
        for row in sorted((r for r in counted if r.column_id == k), key=lambda r: r.code):
            inside = [r for r in interval.ranks if below <= r < below + row.rows]
            if inside and row.code % 2:
                known |= {(interval.column, r): cuts[k][row.code // 2] for r in inside}
            elif inside:
                gap = row.code // 2
                low = cuts[k][gap - 1] if gap else interval.low
                high = cuts[k][gap] if gap < len(cuts[k]) else interval.high
                remaining.append(_Interval(interval.column, low, high, below, row.rows, row.distinct, inside))
            below += row.rows
    return remaining


def _ascending_unique(values: list[float]) -> list[float]:
    """Drop repeats from sorted values; NaN (ordered last) counts as one value."""
    kept: list[float] = []
    for value in values:
        same = kept and (value == kept[-1] or (math.isnan(value) and math.isnan(kept[-1])))
        if not same:
            kept.append(value)
    return kept


def _read_off(df: DataFrame, intervals: list[_Interval]) -> dict[tuple[str, int], float]:
    """Look up ranks inside intervals that hold at most ``few_values`` values."""
    cells = {}
    for k, interval in enumerate(intervals):
        value = as_double(interval.column)
        cells[str(k)] = F.when(interval.contains(value), value)
    counted = melt(df, cells).groupBy("column_id", "value").agg(F.count(F.lit(1)).alias("rows"))
    running = Window.partitionBy("column_id").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    placed = counted.withColumn("through", F.sum("rows").over(running))
    hits = F.lit(False)
    for k, interval in enumerate(intervals):
        for rank in interval.ranks:
            place = rank - interval.below
            reached = (F.col("through") > place) & (F.col("through") - F.col("rows") <= place)
            hits = hits | ((F.col("column_id") == k) & reached)
    known = {}
    for row in placed.where(hits).collect():
        interval = intervals[row.column_id]
        for rank in interval.ranks:
            if row.through - row.rows <= rank - interval.below < row.through:
                known[interval.column, rank] = row.value
    return known
