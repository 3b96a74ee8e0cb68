"""Registered queries, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Loads the given tables: ``read("orders")``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def path(self, table: str) -> str:
        return f"{self.sf_dir}/{table}.parquet"

    def __call__(self, table: str) -> DataFrame:
        return self.spark.read.parquet(self.path(table))


def query(name: str, sql: str | None = None):
    """Register ``fn(read)``, where ``read`` is a ``Tables``."""

    def register(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    """Round computed doubles so that summation order cannot show."""
    return df.withColumns({n: F.round(n, digits) for n in names})




def sql_union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)
