"""Exact quantiles: the narrowing search against a sort in numpy."""

import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.plans.quantiles import quantiles

PROBABILITIES = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 0.999, 1.0]


def expected(values):
    kept = np.sort(np.array([v for v in values if v is not None], dtype=float))
    out = []
    for p in PROBABILITIES:
        position = p * (len(kept) - 1)
        low, high = kept[math.floor(position)], kept[math.ceil(position)]
        out.append(low if low == high else low + (high - low) * (position - math.floor(position)))
    return out


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    n = 20_000
    spread = rng.normal(size=n).tolist()
    # A third of the rows share one value that sits between others.
    hot = np.where(np.arange(n) % 3 == 0, 0.25, rng.random(n)).tolist()
    gaps = [None if i % 5 == 0 else float(i % 4000) for i in range(n)]
    return spark.createDataFrame(list(zip(spread, hot, gaps)), "spread double, hot double, gaps double")


@pytest.mark.parametrize("few_values", [1, 50, 1_000, 10**9])
def test_any_task_limit_gives_the_same_quantiles(table, few_values):
    found = quantiles(table, table.columns, PROBABILITIES, few_values=few_values)
    data = table.toPandas()
    for name in table.columns:
        values = [None if math.isnan(v) else v for v in data[name]]
        assert found[name] == pytest.approx(expected(values), rel=1e-12), name


def test_infinities_and_nan_sort_last(spark):
    values = [float("-inf"), 1.0, 2.0, 3.0, float("inf"), float("nan")]
    df = spark.createDataFrame([(v,) for v in values * 40], "x double")
    found = quantiles(df, ["x"], [0.0, 0.3, 0.5, 0.8, 1.0], few_values=2)["x"]
    assert found[0] == float("-inf") and found[1] == 1.0 and found[2] == 2.5
    assert found[3] == float("inf") and math.isnan(found[4])


def test_empty_and_all_null_columns(spark):
    df = spark.createDataFrame([(None, 1.0)] * 3, "x double, y double")
    assert quantiles(df, ["x", "y"], [0.5]) == {"x": [None], "y": [1.0]}
    assert quantiles(df.limit(0), ["y"], [0.5]) == {"y": [None]}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.integers(-3, 3).map(float), st.floats(-1e9, 1e9)), min_size=5, max_size=200))
def test_narrowing_matches_the_builtin(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(3)
    narrow = quantiles(df, ["x"], PROBABILITIES, few_values=3)["x"]
    assert narrow == pytest.approx(expected(values), rel=1e-9, abs=1e-9)


def test_partitioning_does_not_matter(table):
    answers = [quantiles(table.repartition(n), ["hot"], PROBABILITIES, few_values=100) for n in (1, 4, 17)]
    assert answers[0] == answers[1] == answers[2]


def test_approx_returns_an_element(table):
    found = quantiles(table, ["spread"], [0.5], approx=True)["spread"][0]
    assert table.where(F.col("spread") == found).count() >= 1
