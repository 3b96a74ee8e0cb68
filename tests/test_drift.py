import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import drift


def report(base, cur, **kw):
    return {r.column: r for r in drift.drift_report(base, cur, **kw).collect()}


def test_same_rows_in_another_order_do_not_drift(read):
    orders = read("orders")
    for row in report(orders, orders.repartition(7).orderBy(F.rand(1))).values():
        assert row.psi == pytest.approx(0, abs=1e-12) and row.status == "ok" and row.note is None
        assert row.ks is None or row.ks == pytest.approx(0, abs=1e-12)


def test_numeric_index_against_numpy(spark):
    rng = np.random.default_rng(3)
    before, after = rng.normal(size=900), rng.normal(0.4, 1.3, size=700)
    base = spark.createDataFrame([(float(v),) for v in before], "x double")
    cur = spark.createDataFrame([(float(v),) for v in after], "x double")
    edges = np.quantile(before, drift.DECILES)
    shares = [np.bincount(np.searchsorted(edges, s, side="right"), minlength=10) / len(s) for s in (before, after)]
    floored = [np.maximum(s, 1e-4) for s in shares]
    row = report(base, cur)["x"]
    assert row.psi == pytest.approx(((floored[1] - floored[0]) * np.log(floored[1] / floored[0])).sum())
    assert row.ks == pytest.approx(np.abs(np.cumsum(shares[0]) - np.cumsum(shares[1])).max())
    assert row.mean_shift_pct == pytest.approx((after.mean() - before.mean()) / abs(before.mean()))


def test_empty_bins_add_their_floored_term(spark):
    base = spark.createDataFrame([(float(i),) for i in range(100)], "x double")
    cur = spark.createDataFrame([(1000.0,)] * 50, "x double")
    row = report(base, cur)["x"]
    term = 9 * (1e-4 - 0.1) * math.log(1e-4 / 0.1) + 0.9 * math.log(10)
    assert row.psi == pytest.approx(term) and row.ks == pytest.approx(0.9) and row.status == "drift"


def test_columns_without_edges_are_ok(spark):
    base = spark.createDataFrame([(None, float("inf"))] * 4, "none double, wild double")
    cur = spark.createDataFrame([(1.0, 2.0)] * 4, "none double, wild double")
    found = report(base, cur)
    assert (found["none"].psi, found["none"].ks, found["none"].base_null_pct) == (0, 0, 100)
    assert found["none"].mean_shift_pct is None and found["wild"].psi == 0


def test_zero_mean_has_no_shift(spark):
    base = spark.createDataFrame([(-1.0,), (1.0,)], "x double")
    cur = spark.createDataFrame([(5.0,)], "x double")
    assert report(base, cur)["x"].mean_shift_pct is None


def test_empty_current_side(spark):
    base = spark.createDataFrame([(float(i), "a") for i in range(20)], "x double, c string")
    found = report(base, base.limit(0))
    assert found["x"].cur_null_pct == 0 and found["x"].status == "drift"
    assert found["c"].missing_categories == ["a"] and found["c"].note == "category set changed"


def test_type_mismatch_skips_only_that_column(spark):
    base = spark.createDataFrame([(i, i, "a") for i in range(50)], "x int, y int, c string")
    cur = spark.createDataFrame([(f"v{i}", i, "a") for i in range(50)], "x string, y int, c string")
    found = report(base, cur)
    assert found["x"].note.startswith("skipped: ") and found["x"].psi == 0 and found["x"].status == "ok"
    assert found["y"].note is None and found["c"].psi == 0
    dates = cur.withColumn("x", F.current_date())
    assert report(base, dates)["x"].note.startswith("skipped: ")
    numbers = cur.withColumn("x", F.col("y").cast("string"))
    assert report(base, numbers)["x"].note is None


def test_many_categories_are_all_compared(spark):
    base = spark.createDataFrame([(f"v{i:03d}",) for i in range(500)], "c string")
    cur = spark.createDataFrame([(f"v{i:03d}",) for i in range(100, 600)], "c string")
    row = report(base, cur)["c"]
    assert row.missing_categories == [f"v{i:03d}" for i in range(10)]
    assert row.new_categories == [f"v{i:03d}" for i in range(500, 510)]
    assert len(report(base, cur, listed=70)["c"].new_categories) == 70
    changes = drift.category_changes(drift.category_counts(base, cur, ["c"])).collect()
    assert sorted((r.change, r.value) for r in changes) == sorted(
        [("missing", f"v{i:03d}") for i in range(100)] + [("new", f"v{i:03d}") for i in range(500, 600)]
    )


def test_equal_distributions_over_many_categories_are_ok(spark):
    base = spark.range(50_000).select((F.xxhash64("id") % 500).cast("string").alias("c"))
    cur = spark.range(50_000, 100_000).select((F.xxhash64("id") % 500).cast("string").alias("c"))
    row = report(base, cur)["c"]
    assert row.status == "ok" and row.psi < 0.05 and row.note is None


def test_every_shared_column_is_compared(spark):
    base = spark.range(40).select(*[F.col("id").cast("double").alias(f"n{i}") for i in range(41)])
    cur = base.withColumn("n40", F.col("n40") + 1000)
    found = report(base, cur)
    assert len(found) == 41 and found["n40"].status == "drift"
    assert drift.drift_verdict(base, cur).first().overall == "drift"


def test_new_categories_are_listed_by_count(spark):
    base = spark.createDataFrame([("a",)] * 5, "c string")
    cur = spark.createDataFrame([("a",)] * 5 + [("z",)] * 3 + [("b",)], "c string")
    row = report(base, cur)["c"]
    assert row.new_categories == ["z", "b"] and row.missing_categories == []


def test_columns_can_be_restricted(read):
    a, b = read("orders").where("o_orderkey % 2 = 0"), read("orders").where("o_orderkey % 2 = 1")
    assert set(report(a, b, columns=["o_orderstatus", "o_totalprice"])) == {"o_orderstatus", "o_totalprice"}
    with pytest.raises(ValueError):
        drift.drift_report(a, a)
    with pytest.raises(ValueError):
        drift.drift_report(a, b, columns=["nope"])


@pytest.mark.parametrize("parts", [1, 4, 17])
def test_partitions_do_not_change_results(read, parts):
    a, b = read("events").where("event_id < 400"), read("events").where("event_id >= 400")
    a, b = a.drop("props"), b.drop("props")
    first, again = report(a, b), report(a.repartition(parts), b.repartition(parts))
    for name, row in first.items():
        assert again[name].psi == pytest.approx(row.psi, abs=1e-12)
        assert again[name].new_categories == row.new_categories


def test_rollup_takes_the_worst_status(spark):
    rows = [("a", 0.3, "drift"), ("b", 0.1, "warn"), ("c", 0.0, "ok")]
    df = spark.createDataFrame(rows, "column string, psi double, status string")
    row = drift.drift_rollup(df, spark.range(5), spark.range(7)).first()
    assert tuple(row) == (5, 7, 3, 1, "drift")
    assert drift.drift_rollup(df.where("psi < 0.2"), spark.range(5), spark.range(7)).first().overall == "warn"


def test_a_constant_baseline_that_jumps_is_named(spark):
    base, cur, same = (spark.createDataFrame([(v,)] * n, "x double") for v, n in ((1.0, 20), (9.0, 20), (1.0, 5)))
    from plumbline.operators.drift import drift_report

    assert drift_report(base, cur).first().note == "the baseline has one value only"
    assert drift_report(base, same).first().note is None
    assert drift_report(base, cur.limit(0)).first().note is None
