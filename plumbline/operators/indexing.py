"""A dense 0-based row index over an explicit order, without a global window."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import groupable
from plumbline.plans.durable import materialise

POSITION, PARTITION, OFFSET, COPY = "__position", "__partition", "__offset", "__copy"

# monotonically_increasing_id keeps the row's place in its partition here.
PLACE_BITS = 2**33 - 1


def total_order(df: DataFrame, keys: list[str] | None = None) -> list[Column]:
    """The keys, then every other column, so that only identical rows tie."""
    first = list(keys or [])
    return [groupable(df, n) for n in first + [c for c in df.columns if c not in first]]


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores in front while a column is called so."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def dense_index(df: DataFrame, keys: list[str] | None = None, name: str = "row_index") -> DataFrame:
    """Add ``name``: 0, 1, 2, ... in the order of ``keys``, as the last column.

    If the table has a column of that name, underscores are put in front.

    Rows are range-partitioned and sorted, written once with their partition
    and place, and shifted by the sizes of the partitions before them.  Ties
    are broken by the remaining columns; identical rows by ``__copy``, which
    lets even a row that makes up a third of the table spread over many
    partitions.  The local sort in front makes that number depend on the rows
    only, not on the order they arrived in, so a retried task repeats it.
    """
    order = total_order(df, keys)
    settled = df.sortWithinPartitions(F.xxhash64(*order)).withColumn(COPY, F.monotonically_increasing_id())
    ranged = settled.repartitionByRange(*order, F.col(COPY)).sortWithinPartitions(*order, F.col(COPY)).drop(COPY)
    placed = materialise(
        ranged.withColumn(PARTITION, F.spark_partition_id()).withColumn(
            POSITION, F.monotonically_increasing_id().bitwiseAND(F.lit(PLACE_BITS))
        ),
        "dense-index",
    )
    # One row per written partition, so the broadcast side cannot outgrow the
    # number of shuffle partitions.
    sizes = sorted(placed.groupBy(PARTITION).count().collect())
    starts = accumulate([r["count"] for r in sizes], initial=0)
    offsets = df.sparkSession.createDataFrame(
        [(r[PARTITION], start) for r, start in zip(sizes, starts)], f"{PARTITION} int, {OFFSET} bigint"
    )
    return placed.join(F.broadcast(offsets), PARTITION).select(
        *[F.col("`" + c.replace("`", "``") + "`") for c in df.columns],
        (F.col(OFFSET) + F.col(POSITION)).alias(free_name(df, name)),
    )
