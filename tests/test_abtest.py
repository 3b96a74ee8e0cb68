import math

import pytest
from pyspark.sql import functions as F

from plumbline.functions.significance import chi_square_p, student_t_p
from plumbline.operators import abtest


def exact_normal(z):
    return math.erfc(abs(z) / math.sqrt(2))


def tails(spark, tail, pairs):
    """p-values of (statistic, degrees of freedom) pairs."""
    rows = [(i, float(x), float(df)) for i, (x, df) in enumerate(pairs)]
    df = spark.createDataFrame(rows, "i int, x double, df double")
    return [r.p for r in df.select("i", tail(F.col("x"), F.col("df")).alias("p")).orderBy("i").collect()]


def test_chi_square_closed_forms(spark):
    for x in (0.01, 0.603, 3.0, 40.0, 700.0):
        root = math.erfc(math.sqrt(x / 2))
        closed = {
            1: root,
            2: math.exp(-x / 2),
            3: root + math.sqrt(2 * x / math.pi) * math.exp(-x / 2),
            4: math.exp(-x / 2) * (1 + x / 2),
        }
        assert tails(spark, chi_square_p, [(x, df) for df in closed]) == pytest.approx(list(closed.values()), rel=1e-9)


def test_chi_square_edges(spark):
    found = tails(spark, chi_square_p, [(0, 3), (-1, 3), (5, 0), (2000, 2001), (2000, 2000), (1e6, 10)])
    assert found[:3] == [1, 1, 1] and found[5] == 0
    # The median of the distribution is close to its degrees of freedom.
    assert found[3:5] == pytest.approx([0.5, 0.5], abs=0.01)


def test_student_closed_forms(spark):
    for t in (0.0, 0.3, 1.0, 2.5, 30.0):
        closed = {
            1: 1 - 2 / math.pi * math.atan(t),
            2: 1 - t / math.sqrt(2 + t * t),
            4: 1 - (t / math.sqrt(4 + t * t)) * (1 + 2 / (4 + t * t)),
        }
        for side in (t, -t):
            found = tails(spark, student_t_p, [(side, df) for df in closed])
            assert found == pytest.approx(list(closed.values()), rel=1e-6, abs=1e-12)


@pytest.mark.parametrize("df", [1e6, 1e9, 1e13])
def test_student_tends_to_normal(spark, df):
    points = [0.5, 1.96, 5.0, 12.0]
    for t, p in zip(points, tails(spark, student_t_p, [(t, df) for t in points])):
        # The tails differ by about t^4 / (4 df).
        assert p == pytest.approx(exact_normal(t), rel=(t**4 + 1) / df + 1e-9)


def test_student_edges(spark):
    assert tails(spark, student_t_p, [(float("inf"), 5), (1.0, 0)]) == [1, 1]


def frame(spark, groups):
    rows = [(name, float(v)) for name, values in groups.items() for v in values]
    return spark.createDataFrame(rows, "arm string, x double")


def test_proportion_against_formulas(spark):
    df = frame(spark, {"a": [1] * 30 + [0] * 70, "b": [1] * 45 + [0] * 75})
    row = abtest.ab_compare(abtest.ab_variants(df, "arm", "x"), "proportion").first()
    pooled = 75 / 220
    z = (0.375 - 0.3) / math.sqrt(pooled * (1 - pooled) * (1 / 100 + 1 / 120))
    half = 1.96 * math.sqrt(0.3 * 0.7 / 100 + 0.375 * 0.625 / 120)
    assert row.p_value == pytest.approx(exact_normal(z), abs=2e-7)
    assert (row.ci_low, row.ci_high) == pytest.approx((0.075 - half, 0.075 + half))
    assert row.lift == pytest.approx(0.25) and row.significant is False


def test_interval_stays_at_95_percent(spark):
    found = abtest.ab_variants(frame(spark, {"a": [1, 2, 3], "b": [2, 3, 9]}), "arm", "x")
    strict, loose = (abtest.ab_compare(found, "mean", alpha=a).first() for a in (1e-9, 0.99))
    assert strict.ci_low == loose.ci_low and not strict.significant and loose.significant


def test_nulls_and_control_choice(spark):
    df = spark.createDataFrame([("b", 1.0), ("a", 2.0), (None, 9.0), ("a", None), ("c", 3.0)], "arm string, x double")
    found = {r.variant: r for r in abtest.ab_variants(df, "arm", "x").collect()}
    assert {v: r.n for v, r in found.items()} == {"a": 1, "b": 1, "c": 1} and found["a"].is_control
    assert sum(r.share for r in found.values()) == pytest.approx(1) and found["a"].std == 0
    named = {r.variant: r.is_control for r in abtest.ab_variants(df, "arm", "x", "c").collect()}
    assert named == {"a": False, "b": False, "c": True}
    gone = {r.variant: r.is_control for r in abtest.ab_variants(df, "arm", "x", "zzz").collect()}
    assert gone["a"]


def test_degenerate_variants(spark):
    groups = {"control": [0.0, 0.0, 0.0], "one": [5.0], "same": [0.0, 0.0], "spread": [1.0, 3.0]}
    found = {r.variant: r for r in abtest.ab_compare(abtest.ab_variants(frame(spark, groups), "arm", "x", "control")).collect()}
    assert all(r.lift is None for r in found.values())
    assert found["same"].p_value == pytest.approx(1) and found["one"].p_value == pytest.approx(1)
    mixed = {"control": [1.0, 2.0, 4.0], "one": [5.0]}
    row = abtest.ab_compare(abtest.ab_variants(frame(spark, mixed), "arm", "x")).first()
    assert row.p_value is None and row.significant is False


def test_whole_test_and_its_errors(spark):
    df = frame(spark, {"a": [1] * 3000, "b": [1] * 1000})
    result = abtest.ab_test(df, "arm", "x", "proportion")
    assert result["srm"].first().mismatch and result["srm"].first().expected_share == 0.5
    assert result["warnings"] == []
    warned = abtest.ab_test(frame(spark, {"a": [5.0], "b": [1.0]}), "arm", "x", "proportion")
    assert len(warned["warnings"]) == 1
    with pytest.raises(ValueError):
        abtest.ab_test(frame(spark, {"a": [1.0]}), "arm", "x")
    with pytest.raises(ValueError):
        abtest.ab_compare(result["variants"], "median")


def test_a_metric_that_is_no_number_counts_as_missing(spark):
    rows = [("a", 1.0), ("a", 2.0), ("a", float("nan")), ("b", 3.0), ("b", 5.0), ("b", None)]
    df = spark.createDataFrame(rows, "v string, m double")
    found = abtest.ab_test(df, "v", "m")
    assert {r.variant: (r.n, r.mean) for r in found["variants"].collect()} == {"a": (2, 1.5), "b": (2, 4.0)}
    assert found["comparisons"].first().p_value < 1


def test_too_many_variants_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(abtest, "MAX_VARIANTS", 5)
    df = spark.range(60).selectExpr("cast(id % 6 AS string) AS v", "id AS m")
    with pytest.raises(ValueError, match="more than 5 variants"):
        abtest.ab_variants(df, "v", "m")
