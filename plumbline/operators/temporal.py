"""Joins along an axis: the latest row before, and all rows within a band.

No task sorts the whole history of a key.  Both sides are put in one order of key and
time and cut into ranges of equal size wherever that falls; what a range needs from those
before it is one row per range, which is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.columns import col
from plumbline.plans.durable import materialise

BACKWARD, FORWARD = "backward", "forward"


def asof_join(
    left: DataFrame,
    right: DataFrame,
    by: list[str],
    left_on: str,
    right_on: str,
    columns: dict[str, str],
    tie: list[str] | None = None,
    left_tie: list[str] | None = None,
    exact: bool = True,
    direction: str = BACKWARD,
    tolerance: object = None,
) -> DataFrame:
    """All rows of ``left`` with ``columns`` (new name: column of ``right``) of the nearest earlier row.

    The row of ``right`` has the same ``by`` values and the largest ``right_on`` that is not
    above ``left_on`` (with ``direction="forward"`` the smallest that is not below).  Among
    rows at one time the largest ``tie`` wins (forward: the smallest).  At equal times a row counts
    if ``exact``, or, where ``left_tie`` is given, if its ``tie`` lies before that.  ``tolerance``
    (a number, or an interval as SQL text for times) bounds the distance.  Null keys and
    times meet nothing; rows of ``left`` without a partner are kept with nulls.
    """
    tie = tie or []
    if left_tie is not None and len(left_tie) != len(tie):
        raise ValueError("left_tie has to name as many columns as tie")
    if direction not in (BACKWARD, FORWARD):
        raise ValueError(f"unknown direction: {direction}")
    keys = [f"k{i}" for i in range(len(by))]
    ties = [f"t{i}" for i in range(len(tie))]
    kind = left.schema[left_on].dataType

    def place(df: DataFrame, on: str, ties_of: list[str] | None, side: int, row: Column, found: Column) -> DataFrame:
        own = [col(c) for c in ties_of] if ties_of else [F.lit(None).cast(right.schema[c].dataType) for c in tie]
        at = [col(k).alias(n) for k, n in zip(by, keys)] + [col(on).cast(kind).alias("at")]
        return df.select(*at, *[c.alias(n) for c, n in zip(own, ties)], F.lit(side).alias("side"), row.alias("row"), found.alias("found"))

    found = F.struct(col(right_on).cast(kind).alias("at"), *[col(c).alias(f"c{i}") for i, c in enumerate(columns.values())])
    row = F.struct(*[col(c) for c in left.columns])
    found_kind = right.select(found.alias("f")).schema["f"].dataType
    row_kind = left.select(row.alias("r")).schema["r"].dataType
    there = [col(c).isNotNull() for c in [*by, right_on]]
    rights = place(right.where(_all(there)), right_on, tie, 1, F.lit(None).cast(row_kind), found)
    lefts = place(left, left_on, left_tie, 0, row, F.lit(None).cast(found_kind))

    # With ties of its own a row of the left side stands strictly behind what it sees.
    turn = (lambda c: c.desc_nulls_first()) if direction == FORWARD else (lambda c: c.asc_nulls_first())
    first_right = exact and left_tie is None
    side = F.col("side").desc() if first_right else F.col("side").asc()
    order = [turn(F.col("at")), side, *[turn(F.col(t)) for t in ties]] if left_tie is None else [
        turn(F.col("at")), *[turn(F.col(t)) for t in ties], side
    ]
    both = lefts.unionByName(rights)
    spread = F.xxhash64("row", "found") if _hashable(row_kind) and _hashable(found_kind) else F.rand(42)
    both = materialise(
        both.repartitionByRange(*keys, *order, spread).withColumn("slice", F.spark_partition_id()), "asof"
    )
    # Of each range, the last row of the right side that its last key has.
    best = F.max_by if direction == BACKWARD else F.min_by
    latest = both.where("side = 1").groupBy(*keys, "slice").agg(best("found", F.struct("at", *ties)).alias("latest"))
    slices = both.select(*keys, "slice").where(_all([F.col(k).isNotNull() for k in keys])).distinct()
    ends = slices.join(latest, [*keys, "slice"], "left")
    before = Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("carried", F.last("latest", ignorenulls=True).over(before)).where("carried IS NOT NULL")
    carried = carried.select(*[F.col(k).alias(f"of_{k}") for k in keys], F.col("slice").alias("of_slice"), "carried")

    so_far = Window.partitionBy("slice", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = both.withColumn("own", F.last("found", ignorenulls=True).over(so_far)).where("side = 0")
    # A range carries a row over only for the key that it shares with the range before.
    same = [F.col(k) == F.col(f"of_{k}") for k in keys] + [F.col("slice") == F.col("of_slice")]
    met = seen.join(F.broadcast(carried), same, "left")
    match = F.coalesce("own", "carried")
    known = _all([F.col(k).isNotNull() for k in [*keys, "at"]])
    near = known if tolerance is None else known & (_distance(F.col("at"), match["at"], direction) <= _span(tolerance))
    return met.withColumn("match", F.when(near, match)).select(
        *[F.col("row").getField(c).alias(c) for c in left.columns],
        *[F.col("match").getField(f"c{i}").alias(n) for i, n in enumerate(columns)],
    )


def band_join(
    left: DataFrame,
    right: DataFrame,
    by: list[str],
    left_on: str,
    right_on: str,
    lower: float,
    upper: float,
    left_columns: dict[str, str],
    right_columns: dict[str, str],
    closed: str = "both",
) -> DataFrame:
    """Pairs of rows with the same ``by`` values and ``right_on - left_on`` from ``lower`` to ``upper``.

    The axis is a number, or a time with bounds in seconds, on both sides.  ``closed`` (both, left, right,
    neither) says which bounds belong to the band.  Rows are cut into cells as wide as the
    band: a row of the left side meets two cells, one of the right side lies in one, so a task holds
    the rows of one key and cell, and those that are still too many are split by the skew join.
    Null keys and places meet nothing.
    """
    if closed not in ("both", "left", "right", "neither"):
        raise ValueError(f"unknown closed: {closed}")
    if not upper >= lower:
        raise ValueError("the band is empty: upper lies below lower")
    keys = [f"k{i}" for i in range(len(by))]
    if _is_time(left.schema[left_on].dataType):
        lower, upper = round(lower * 1_000_000), round(upper * 1_000_000)
    whole = isinstance(lower, int) and isinstance(upper, int) and all(_is_whole(d.schema[c].dataType) for d, c in ((left, left_on), (right, right_on)))
    width = (upper - lower) or 1

    def cell(at: Column, slack: int) -> Column:
        # Rounding must not push a partner out of the cells that are looked at.
        return F.call_function("div", at, F.lit(width)) if whole else F.floor((at + slack * F.abs(at) * 1e-12) / F.lit(float(width)))

    def side(df: DataFrame, on: str, columns: dict[str, str], mark: str) -> DataFrame:
        kept = df.where(_all([col(c).isNotNull() for c in [*by, on]]))
        out = [col(c).alias(f"{mark}{i}") for i, c in enumerate(columns.values())]
        return kept.select(*[col(k).alias(n) for k, n in zip(by, keys)], _number(df, on, whole).alias(f"{mark}_at"), *out)

    lefts = side(left, left_on, left_columns, "l")
    cells = F.sequence(cell(F.col("l_at") + F.lit(lower), -1), cell(F.col("l_at") + F.lit(upper), 1))
    lefts = lefts.withColumn("cell", F.explode(cells))
    rights = side(right, right_on, right_columns, "r").withColumn("cell", cell(F.col("r_at"), 0))
    gap = F.col("r_at") - F.col("l_at")
    above = gap >= F.lit(lower) if closed in ("both", "left") else gap > F.lit(lower)
    below = gap <= F.lit(upper) if closed in ("both", "right") else gap < F.lit(upper)
    pairs = lefts.join(rights, [*keys, "cell"]).where(above & below)
    return pairs.select(
        *[F.col(f"l{i}").alias(n) for i, n in enumerate(left_columns)],
        *[F.col(f"r{i}").alias(n) for i, n in enumerate(right_columns)],
    )


def _all(conditions: list[Column]) -> Column:
    found = F.lit(True)
    for c in conditions:
        found = found & c
    return found


def _hashable(kind: T.DataType) -> bool:
    return "map<" not in kind.simpleString() and "variant" not in kind.simpleString()


def _is_time(kind: T.DataType) -> bool:
    return isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType))


def _is_whole(kind: T.DataType) -> bool:
    return _is_time(kind) or isinstance(kind, T.IntegralType)


def _number(df: DataFrame, on: str, whole: bool) -> Column:
    """A place on the axis: a time in microseconds, another number as it is."""
    if _is_time(df.schema[on].dataType):
        return F.unix_micros(col(on).cast("timestamp"))
    return col(on).cast("long" if whole else "double")


def _distance(at: Column, match: Column, direction: str) -> Column:
    return at - match if direction == BACKWARD else match - at


def _span(tolerance: object) -> Column:
    return F.expr(tolerance) if isinstance(tolerance, str) else F.lit(tolerance)
