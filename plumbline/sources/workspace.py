"""A shared set of named tables for SQL and Python steps."""

from __future__ import annotations

import random
from collections.abc import Callable
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from plumbline.operators.contracts import Rule, evaluate_all
from plumbline.operators.dictionary import dictionary, merge_dictionary
from plumbline.operators.groups import MAX_GROUP_ROWS, SLICE_ROWS, Apart, Frames, apply_groups, combine_groups
from plumbline.plans.aggregates import union_all
from plumbline.sources import io


class Workspace:
    """Named tables of a session: read with ``table``, add with ``publish``."""

    def __init__(self, spark: SparkSession, seed: int = 42):
        self.spark = spark
        self.seed = seed
        self.sources: dict[str, str] = {}

    def table(self, name: str) -> DataFrame:
        if not self.spark.catalog.tableExists(name):
            known = ", ".join(sorted(self.tables())) or "none"
            raise KeyError(f"table not found: {name} (available: {known})")
        return self.spark.table(name)

    def publish(self, name: str, data: Any) -> DataFrame:
        """Register a DataFrame (Spark or pandas) under a name."""
        df = data if isinstance(data, DataFrame) else self.spark.createDataFrame(data)
        df.createOrReplaceTempView(name)
        return df

    def load(self, path: str, name: str | None = None, **options) -> DataFrame:
        view = name or io.sanitize_name(path.rstrip("/").rsplit("/", 1)[-1])
        self.sources[view] = path
        return io.load(self.spark, path, view, **options)

    def reload(self) -> dict[str, DataFrame]:
        return io.load_all(self.spark, self.sources)

    def sql(self, text: str, name: str | None = None, persist: bool = False) -> DataFrame:
        return io.run_sql(self.spark, text, name, persist)

    def run(self, fn: Callable[["Workspace"], Any]) -> Any:
        """Run a Python step with this workspace as its argument, from the same random state each time."""
        random.seed(self.seed)
        np.random.seed(self.seed)
        return fn(self)

    def apply(self, name: str, by: list[str], fn: Frames, schema: str, max_rows: int = MAX_GROUP_ROWS) -> DataFrame:
        """Run pandas code over each whole group of a table; publish the result to name it."""
        return apply_groups(self.table(name), by, fn, schema, max_rows)

    def combine(
        self, name: str, by: list[str], partial: Frames, merge: Frames, finish: Frames, partial_schema: str, schema: str,
        slice_rows: int = SLICE_ROWS, apart: Apart | None = None,
    ) -> DataFrame:
        """Run pandas code over slices of each group of a table and merge what they give; groups may have any size."""
        return combine_groups(self.table(name), by, partial, merge, finish, partial_schema, schema, slice_rows, apart)

    def tables(self) -> list[str]:
        return [t.name for t in self.spark.catalog.listTables()]

    def describe(self, name: str) -> list[tuple[str, str]]:
        return [(f.name, f.dataType.simpleString()) for f in self.table(name).schema.fields]

    def count(self, name: str) -> int:
        return self.table(name).count()

    def drop(self, name: str) -> None:
        if not self.spark.catalog.dropTempView(name):
            self.spark.sql(f"DROP TABLE IF EXISTS `{name.replace('`', '``')}`")
        self.sources.pop(name, None)

    def reset(self) -> None:
        """Drop every table of the workspace."""
        for name in self.tables():
            self.drop(name)
        self.sources.clear()

    def describe_all(self, notes: DataFrame | None = None) -> DataFrame | None:
        """Data dictionary of all tables, with the notes of an earlier one carried over."""
        parts = [dictionary(self.table(name), name) for name in sorted(self.tables())]
        if not parts:
            return None
        fresh = union_all(parts)
        return fresh if notes is None else merge_dictionary(notes, fresh)

    def check(self, contracts: dict[str, list[Rule]]) -> DataFrame:
        """Re-check the contracts of all tables that exist right now."""
        present = {name: self.table(name) for name in contracts if self.spark.catalog.tableExists(name)}
        return evaluate_all(present, contracts)


def run_python(spark: SparkSession, fn: Callable[[Workspace], Any], seed: int = 42) -> Any:
    return Workspace(spark, seed).run(fn)
