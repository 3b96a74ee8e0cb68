"""Scores of a prediction table with columns ``label`` and ``prediction``.

Everything is computed from one grouping of the two columns (classification)
or one aggregate (regression).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.plans.aggregates import union_all

REGRESSION_METRICS = ("r2", "mae", "rmse")


def outcome_counts(pred: DataFrame) -> DataFrame:
    return pred.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n"))


def class_scores(pred: DataFrame) -> DataFrame:
    """(label, support, predicted, hits): one row per class seen on either side."""
    counts = outcome_counts(pred)
    sides = counts.select(
        F.inline(
            F.array(
                F.struct(
                    F.col("label").alias("label"),
                    F.col("n").alias("support"),
                    F.lit(0).cast("bigint").alias("predicted"),
                    F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(F.lit(0)).alias("hits"),
                ),
                F.struct(
                    F.col("prediction").alias("label"),
                    F.lit(0).cast("bigint").alias("support"),
                    F.col("n").alias("predicted"),
                    F.lit(0).cast("bigint").alias("hits"),
                ),
            )
        )
    )
    return sides.groupBy("label").agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "hits")])


def classification_metrics(pred: DataFrame) -> DataFrame:
    """(metric, value): accuracy and support-weighted f1, precision, recall."""
    scores = class_scores(pred)
    zero = F.lit(0.0)
    precision = F.coalesce(F.col("hits") / F.nullif("predicted", F.lit(0)), zero)
    recall = F.coalesce(F.col("hits") / F.nullif("support", F.lit(0)), zero)
    f1 = F.coalesce(2 * precision * recall / F.nullif(precision + recall, zero), zero)
    total = F.nullif(F.sum("support"), F.lit(0))
    weighted = {"f1": f1, "precision": precision, "recall": recall}
    row = scores.agg(
        (F.sum("hits") / total).alias("accuracy"),
        *[(F.sum(F.col("support") * m) / total).alias(n) for n, m in weighted.items()],
    )
    return _long(row, ["accuracy", *weighted])


def confusion(pred: DataFrame) -> DataFrame:
    """(actual, predicted, count) of the pairs that occur; all others count 0."""
    return outcome_counts(pred).select(
        F.col("label").alias("actual"), F.col("prediction").alias("predicted"), F.col("n").alias("count")
    )


def regression_columns(label: Column, prediction: Column) -> dict[str, Column]:
    """Aggregates for r2, mae and rmse; r2 of a constant target is 1 or 0."""
    gap = label - prediction
    squared = F.sum(gap * gap)
    spread = F.var_pop(label) * F.count(label)
    flat = F.when(squared > 0, F.lit(0.0)).otherwise(F.lit(1.0))
    return {
        "r2": F.when(spread > 0, 1 - squared / F.nullif(spread, F.lit(0.0))).otherwise(flat),
        "mae": F.avg(F.abs(gap)),
        "rmse": F.sqrt(F.avg(gap * gap)),
    }


def regression_metrics(pred: DataFrame) -> DataFrame:
    """(metric, value): r2, mae, rmse."""
    exprs = regression_columns(F.col("label").cast("double"), F.col("prediction").cast("double"))
    return _long(pred.agg(*[e.alias(n) for n, e in exprs.items()]), list(exprs))


def _long(row: DataFrame, names: list[str]) -> DataFrame:
    cells = [F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names]
    return row.select(F.inline(F.array(*cells)))


def as_dict(metrics: DataFrame) -> dict[str, float]:
    return {r.metric: r.value for r in metrics.collect()}
