"""Top-k rows per column, with ties broken by value."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_by_count(counts: DataFrame, k: int, count: str = "count") -> DataFrame:
    """Keep the k most frequent values of each column and number them from 1.

    ``rank <= k`` lets the planner cut every partition to k rows per column
    before the shuffle, so no task receives a column's whole value set.
    """
    order = Window.partitionBy("column").orderBy(F.col(count).desc(), F.col("value"))
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def smallest_values(values: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("column").orderBy("value")
    return values.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
