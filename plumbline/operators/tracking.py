"""Experiment log, best runs, and the single ship-or-not verdict."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.plans.aggregates import union_all

# Relative drop that marks a run as fragile, and its floor.
FRAGILE_SHARE = 0.05
FRAGILE_FLOOR = 1e-4

RUN_SCHEMA = (
    "id string, ts string, source string, table string, target string, task string, algo string, n_features int,"
    " n_train bigint, n_test bigint, seed bigint, primary_name string, primary_model double, primary_baseline double,"
    " beats_baseline boolean, metrics map<string,double>, leakage_count int, worst_stress_delta double"
)


def run_row(result: dict, table: str, source: str = "", run_id: str | None = None, ts: str | None = None) -> DataFrame:
    """One log row for a ``train`` result."""
    deltas = [r.metric - r.clean for r in result["stress"].collect() if r.metric is not None]
    primary = result["primary"]
    row = (
        run_id or uuid.uuid4().hex,
        ts or datetime.now(timezone.utc).isoformat(),
        source,
        table,
        result["target"],
        result["task"],
        result["algo"],
        result["n_features"],
        result["n_train"],
        result["n_test"],
        result["seed"],
        primary["name"],
        primary["model"],
        primary["baseline"],
        result["beats_baseline"],
        result["metrics"],
        result["leakage"].count(),
        min(deltas) if deltas else None,
    )
    return result["stress"].sparkSession.createDataFrame([row], RUN_SCHEMA)


def log_run(result: dict, path: str, table: str, **labels: str) -> DataFrame:
    """Append a run to the parquet log at ``path`` and return the row."""
    row = run_row(result, table, **labels)
    row.write.mode("append").parquet(path)
    return row


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUN_SCHEMA).parquet(path)


def best_runs(runs: DataFrame) -> DataFrame:
    """Add lift, fragile and is_best (highest primary; the earliest on ties; none only without others).

    The winner of each (table, target) comes from a partial aggregate, so a
    group with very many runs is never sorted in one task.  Newest first.
    """
    lowest = F.lit(float("-inf"))
    score = F.coalesce(F.nanvl("primary_model", lowest), lowest)
    winner = F.min(F.struct((-score).alias("s"), F.col("ts").alias("ts"), F.col("id").alias("id")))
    best = runs.groupBy(F.col("table").alias("_table"), F.col("target").alias("_target")).agg(winner["id"].alias("best_id"))
    floor = F.greatest(F.lit(FRAGILE_FLOOR), F.abs("primary_model"))
    fragile = F.col("worst_stress_delta") < -FRAGILE_SHARE * floor
    same = F.col("table").eqNullSafe(F.col("_table")) & F.col("target").eqNullSafe(F.col("_target"))
    joined = runs.join(best, same)
    return joined.select(
        *[F.col(c) for c in runs.columns],
        (F.col("primary_model") - F.col("primary_baseline")).alias("lift"),
        (F.col("id") == F.col("best_id")).alias("is_best"),
        F.coalesce(fragile, F.lit(False)).alias("fragile"),
    ).orderBy(F.col("ts").desc(), F.col("id").desc())


def contract_states(tables: list[str], summary: DataFrame, spark: SparkSession) -> DataFrame:
    """(table, failed, errored) of every table that has a contract; null where it was not checked yet.

    ``summary`` has a row for each table that was checked.
    """
    wanted = spark.createDataFrame([(t,) for t in tables], "name string")
    met = wanted.join(summary, F.col("name") == F.col("table"), "left")
    return met.select(F.col("name").alias("table"), "failed", "errored")


def ship_gate(
    contracts: DataFrame | None = None,
    models: DataFrame | None = None,
    ab: DataFrame | None = None,
    drift: DataFrame | None = None,
) -> DataFrame:
    """(issues, unchecked, has_checks, label) over every signal given.

    ``contracts`` has failed and errored counts per table (null: not checked
    yet), ``models`` beats_baseline, ``ab`` mismatch, ``drift`` overall.
    """
    signals = []
    if contracts is not None:
        found = F.col("failed") + F.col("errored")
        signals.append(
            contracts.select(F.coalesce(found, F.lit(0)).cast("bigint").alias("issue"), found.isNull().alias("open"))
        )
    for frame, broken in (
        (models, ~F.col("beats_baseline")),
        (ab, F.col("mismatch")),
        (drift, F.col("overall") == "drift"),
    ):
        if frame is not None:
            issue = F.coalesce(broken.cast("bigint"), F.lit(0))
            signals.append(frame.select(issue.alias("issue"), F.lit(False).alias("open")))
    if not signals:
        spark = SparkSession.active()
        signals = [spark.createDataFrame([], "issue bigint, open boolean")]
    totals = union_all(signals).agg(
        F.coalesce(F.sum("issue"), F.lit(0)).alias("issues"),
        F.count_if("open").alias("unchecked"),
        (F.count(F.lit(1)) > 0).alias("has_checks"),
    )
    plural = F.when(F.col("issues") == 1, " issue").otherwise(" issues")
    label = (
        F.when(~F.col("has_checks"), "No checks")
        .when(F.col("issues") > 0, F.concat(F.col("issues").cast("string"), plural))
        .when(F.col("unchecked") > 0, "Checking…")
        .otherwise("Ship-ready")
    )
    return totals.withColumn("label", label)
