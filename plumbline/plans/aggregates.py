"""Aggregates fused over many columns: one job whatever the table's width."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce
from itertools import batched

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.columns import as_text, col, groupable, is_nested, name_lookup

# Distinct counts of several columns copy each row once per column, all columns
# wide.  Small groups keep the copies narrow; every group reads only its own
# columns, so the bytes scanned stay the same, and all groups are one job.
DISTINCT_GROUP = 4

# Average text length (bytes) beyond which distinct counts shuffle a SHA-256
# digest of the whole value instead of the value.
DIGEST_ABOVE = 128

# Integers within a range of 8 to 128 bitmaps of 32 768 bits are counted in those: so many
# stay in a task's hash table.  Of fewer values a task's partial count is small anyway, and
# cheaper; of more, bitmaps would have to be sorted.
BITMAP_BITS, FEWEST_BITMAPS, BITMAPS = 1 << 15, 8, 128

PASS_WIDTH = 96


def one_row(df: DataFrame, exprs: Mapping[object, Column], per_pass: int = PASS_WIDTH) -> dict:
    """Evaluate aggregates over the whole table; keys may be any hashable label.

    One pass for ordinary tables.  Very wide ones take one pass per
    ``per_pass`` aggregates, each reading only the columns it needs, because
    generated code has a size limit.  Keep a column's aggregates together.
    """
    seen: dict = {}
    for labels in batched(exprs, per_pass):
        row = df.agg(*[exprs[label].alias(f"v{i}") for i, label in enumerate(labels)]).first()
        seen |= zip(labels, row)
    return seen


def union_all(parts: Iterable[DataFrame]) -> DataFrame:
    return reduce(lambda left, right: left.unionAll(right), parts)


def count_distinct(
    df: DataFrame,
    columns: list[str],
    approx: bool = False,
    long_text: Iterable[str] = (),
    extent: Mapping[str, tuple] | None = None,
) -> dict[str, int]:
    """Distinct non-null values of each column.

    ``extent`` may give ``{column: (min, max)}`` of integer columns: those of a narrow
    range shuffle one bit per value instead of the value.
    """
    if not columns:
        return {}
    if extent and not approx:
        narrow = {n: int(extent[n][0]) for n in columns if _fits_bitmaps(df, n, extent.get(n))}
        if narrow:
            rest = [n for n in columns if n not in narrow]
            return _count_in_bitmaps(df, narrow, extent) | count_distinct(df, rest, approx, long_text)
    digest = set(long_text)

    def key(name: str) -> Column:
        if is_nested(df.schema[name].dataType):
            value = as_text(df, name)
            return F.sha2(value, 256)
        return F.sha2(col(name), 256) if name in digest else col(name)

    if approx:
        return one_row(df, {n: F.approx_count_distinct(key(n)) for n in columns})
    parts = []
    for start in range(0, len(columns), DISTINCT_GROUP):
        group = columns[start : start + DISTINCT_GROUP]
        row = df.agg(*[F.count_distinct(key(n)).alias(f"d{i}") for i, n in enumerate(group)])
        pairs = [F.struct(F.lit(start + i).alias("i"), F.col(f"d{i}").alias("d")) for i in range(len(group))]
        parts.append(row.select(F.inline(F.array(*pairs))))
    return {columns[r.i]: r.d for r in union_all(parts).collect()}


def _fits_bitmaps(df: DataFrame, name: str, extent: tuple | None) -> bool:
    if extent is None or extent[0] is None or not isinstance(df.schema[name].dataType, T.IntegralType):
        return False
    low, high = extent
    # Beyond 2**53 a minimum that came as a double may be off.
    return BITMAP_BITS * FEWEST_BITMAPS <= high - low < BITMAP_BITS * BITMAPS and max(abs(low), abs(high)) < 2**53


def _count_in_bitmaps(df: DataFrame, lows: Mapping[str, int], extent: Mapping[str, tuple]) -> dict[str, int]:
    """Distinct values by the bits they set; a few columns at a time, as their bitmaps fit a hash table (one job)."""
    groups: list[list[str]] = [[]]
    room = BITMAPS
    for n, low in lows.items():
        needed = 1 + (int(extent[n][1]) - low) // BITMAP_BITS
        if needed > room and groups[-1]:
            groups.append([])
            room = BITMAPS
        groups[-1].append(n)
        room -= needed
    names, parts = list(lows), []
    for group in groups:
        cells = {n: col(n).cast("bigint") - F.lit(lows[n]) + F.lit(1) for n in group}
        place = melt(df, cells).select(
            F.lit(names.index(group[0])) + F.col("column_id"), F.bitmap_bucket_number("value"), F.bitmap_bit_position("value")
        )
        bits = place.toDF("i", "bucket", "bit").groupBy("i", "bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
        parts.append(bits.groupBy("i").agg(F.sum(F.bitmap_count("bits")).alias("d")))
    found = {names[r.i]: r.d for r in union_all(parts).collect()}
    return {n: found.get(n, 0) for n in names}


def text_length(df: DataFrame, name: str) -> dict[object, Column]:
    """Average byte length of a plain string column, for choosing digests."""
    if not isinstance(df.schema[name].dataType, T.StringType):
        return {}
    return {("text_length", name): F.avg(F.octet_length(col(name)))}


def long_text(measured: Mapping[object, object]) -> list[str]:
    return [
        key[1]
        for key, value in measured.items()
        if isinstance(key, tuple) and key[0] == "text_length" and value is not None and value > DIGEST_ABOVE
    ]


def melt(df: DataFrame, values: Mapping[str, Column], *extra: Column) -> DataFrame:
    """Stack columns into rows (column_id, value), keeping ``extra`` columns.

    ``column_id`` is the position in ``values``; nulls are dropped at once.
    """
    cells = [F.struct(F.lit(i).alias("column_id"), v.alias("value")) for i, v in enumerate(values.values())]
    return df.select(*extra, F.inline(F.array(*cells))).where(F.col("value").isNotNull())


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, count) of the string form of every column, nulls skipped.

    Repeated values are combined before the shuffle, so a hot value costs one
    row per map task.
    """
    stacked = melt(df, {n: as_text(df, n) for n in columns})
    counted = stacked.groupBy("column_id", "value").agg(F.count(F.lit(1)).alias("count"))
    return counted.select(name_lookup(columns, F.col("column_id")).alias("column"), "value", "count")


def row_fingerprint(df: DataFrame) -> Column:
    """Order-independent aggregate that reads every output column of every row."""
    return F.bit_xor(F.xxhash64(*[groupable(df, n) for n in df.columns]))
