"""Chart data: the aggregated points behind a chart, from the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.columns import DATETIME, NUMERIC, as_double, col, groupable, kind_of
from plumbline.plans.durable import materialise

# A task may hold the value maps of over a hundred groups at once, so the map
# form of the median is kept for groups of at most this many distinct values.
GROUP_VALUES = 10_000

AGGREGATES = ("none", "count", "sum", "mean", "median", "min", "max")


def encoding_type(df: DataFrame, field: str | None, declared: str = "auto") -> str:
    """quantitative, temporal or nominal, unless the chart declares a type."""
    if declared != "auto":
        return declared
    kind = kind_of(df.schema[field].dataType) if field else None
    return {NUMERIC: "quantitative", DATETIME: "temporal"}.get(kind, "nominal")


def chart_data(
    df: DataFrame, x: str, y: str | None = None, color: str | None = None, aggregate: str = "none"
) -> DataFrame:
    """(x, [color], y): one point per group, or every row for ``none``."""
    if aggregate not in AGGREGATES:
        raise ValueError(f"unknown aggregate: {aggregate}")
    if aggregate not in ("none", "count") and y is None:
        raise ValueError(f"{aggregate} needs a y column")
    keys = {"x": x} | ({"color": color} if color else {})
    if aggregate == "none":
        shown = [col(n).alias(k) for k, n in keys.items()]
        return df.select(*shown, *([col(y).alias("y")] if y else []))
    groups = [groupable(df, n).alias(k) for k, n in keys.items()]
    if aggregate == "median":
        return _medians(df.select(*groups, as_double(y).alias("y")), list(keys))
    value = as_double(y) if y else F.lit(1)
    point: Column = {
        "count": lambda: F.count(F.lit(1)),
        "sum": lambda: F.sum(value),
        "mean": lambda: F.avg(value),
        "min": lambda: F.min(value),
        "max": lambda: F.max(value),
    }[aggregate]()
    return df.groupBy(*groups).agg(point.alias("y"))


def _medians(points: DataFrame, keys: list[str], few_values: int = GROUP_VALUES) -> DataFrame:
    """Exact medians; groups of many distinct values are ranked across tasks."""
    widest = points.groupBy(*keys).agg(F.approx_count_distinct("y").alias("d")).agg(F.max("d")).first()[0]
    if widest is None or widest <= few_values:
        return points.groupBy(*keys).agg(F.percentile("y", F.lit(0.5)).alias("y"))
    return ranked_medians(points, keys)


def ranked_medians(points: DataFrame, keys: list[str]) -> DataFrame:
    """Medians by position in a range-partitioned table of value counts.

    A group may span many partitions: each (group, partition) chunk counts its
    own rows, chunk totals are accumulated per group (one row per partition at
    most), and the one or two middle rows are picked by global position.
    """
    present = points.where(F.col("y").isNotNull())
    counts = present.groupBy(*keys, "y").agg(F.count(F.lit(1)).alias("n"))
    ordered = counts.repartitionByRange(*keys, "y").withColumn("part", F.spark_partition_id())
    placed = materialise(ordered, "medians")
    chunks = placed.groupBy(*keys, "part").agg(F.sum("n").alias("chunk"))
    earlier = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    chunks = chunks.select(
        *[F.col(k).alias(f"c_{k}") for k in keys],
        F.col("part").alias("c_part"),
        F.coalesce(F.sum("chunk").over(earlier), F.lit(0)).alias("before"),
        F.sum("chunk").over(whole).alias("total"),
    )
    within = Window.partitionBy(*keys, "part").orderBy("y").rowsBetween(Window.unboundedPreceding, 0)
    same = [F.col(k).eqNullSafe(F.col(f"c_{k}")) for k in keys] + [F.col("part") == F.col("c_part")]
    joined = placed.withColumn("upto", F.sum("n").over(within)).join(chunks, same)
    end = F.col("before") + F.col("upto")
    start = end - F.col("n")
    low, high = F.floor((F.col("total") - 1) / 2), F.ceil((F.col("total") - 1) / 2)
    hits = joined.select(
        *keys,
        F.when((start <= low) & (low < end), F.col("y")).alias("low"),
        F.when((start <= high) & (high < end), F.col("y")).alias("high"),
    ).where(F.col("low").isNotNull() | F.col("high").isNotNull())
    middle = hits.groupBy(*keys).agg(((F.max("low") + F.max("high")) / 2).alias("y"))
    empty = points.groupBy(*keys).agg(F.count("y").alias("n")).where("n = 0")
    return middle.unionAll(empty.select(*keys, F.lit(None).cast("double").alias("y")))
