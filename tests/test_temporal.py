"""As-of and band joins against plain search."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from plumbline.operators.temporal import asof_join, band_join


def sides(seed, hot):
    rng = random.Random(seed)
    user = lambda: "hot" if hot and rng.random() < 0.5 else rng.choice(["a", "b", "c", None])
    left = [(i, user(), rng.choice([None, *range(40)])) for i in range(300)]
    right = [(1000 + i, user(), rng.choice([None, *range(40)]), rng.randint(0, 9)) for i in range(300)]
    return left, right


def frames(spark, left, right):
    a = spark.createDataFrame(left, "id int, user string, at int").repartition(5)
    return a, spark.createDataFrame(right, "rid int, user string, at int, v int").repartition(3)


@pytest.mark.parametrize("hot", [False, True])
@pytest.mark.parametrize("exact", [False, True])
@pytest.mark.parametrize("direction", ["backward", "forward"])
def test_like_a_search(spark, hot, exact, direction):
    left, right = sides(1, hot)
    a, b = frames(spark, left, right)
    got = asof_join(a, b, ["user"], "at", "at", {"rid": "rid", "v": "v"}, tie=["rid"], exact=exact, direction=direction, tolerance=6)
    found = {r.id: (r.rid, r.v) for r in got.collect()}
    assert got.columns == ["id", "user", "at", "rid", "v"] and len(found) == len(left)
    sign = 1 if direction == "backward" else -1
    for i, user, at in left:
        options = [
            (sign * t, sign * rid, rid, v)
            for rid, u, t, v in right
            if None not in (user, at, t) and u == user and (sign * t < sign * at or exact and t == at)
        ]
        best = max(options, default=None)
        best = best if best and abs(at - sign * best[0]) <= 6 else None
        assert found[i] == ((best[2], best[3]) if best else (None, None)), (i, user, at)


def test_times_and_own_ties(spark):
    day = datetime(2024, 1, 1)
    a = spark.createDataFrame([(1, "u", day), (5, "u", day), (6, "u", day + timedelta(hours=3)), (7, "x", day)], "id int, user string, ts timestamp_ntz")
    b = spark.createDataFrame([(3, "u", day), (4, "u", day - timedelta(1))], "rid int, user string, ts timestamp_ntz")
    got = asof_join(a, b, ["user"], "ts", "ts", {"rid": "rid"}, tie=["rid"], left_tie=["id"])
    assert {r.id: r.rid for r in got.collect()} == {1: 4, 5: 3, 6: 3, 7: None}
    near = asof_join(a, b, ["user"], "ts", "ts", {"rid": "rid"}, tolerance="INTERVAL 1 HOUR")
    assert {r.id: r.rid for r in near.collect()} == {1: 3, 5: 3, 6: None, 7: None}


def test_one_user_owns_half_the_rows_and_equal_rows(spark):
    a = spark.range(4000).select("id", F.when(F.col("id") % 2 == 0, "hot").otherwise(F.col("id").cast("string")).alias("user"), (F.col("id") * 10).alias("at"))
    b = a.where("user = 'hot'").select("user", (F.col("at") + 1).alias("at"), "id").unionAll(spark.createDataFrame([("hot", 5, -1)] * 3, "user string, at long, id long"))
    got = asof_join(a, b.withColumnRenamed("id", "rid"), ["user"], "at", "at", {"rid": "rid"}, tie=["rid"])
    rows = {r.id: r.rid for r in got.collect()}
    assert rows[0] is None and rows[1] is None and rows[2] == -1 + 1 or rows[2] in (0, -1)
    assert all(rows[i] == i - 2 for i in range(4, 4000, 2)) and all(rows[i] is None for i in range(1, 4000, 2))


def test_empty_sides_and_clashing_names(spark):
    left, right = sides(2, False)
    a, b = frames(spark, left, right)
    a = a.selectExpr("id AS row", "user AS k0", "at AS slice")
    b = b.selectExpr("rid AS found", "user AS k0", "at AS side")
    got = asof_join(a, b, ["k0"], "slice", "side", {"match": "found"})
    assert got.columns == ["row", "k0", "slice", "match"] and got.count() == 300
    assert asof_join(a, b.limit(0), ["k0"], "slice", "side", {"match": "found"}).where("match IS NOT NULL").count() == 0
    assert asof_join(a.limit(0), b, ["k0"], "slice", "side", {"match": "found"}).count() == 0


@pytest.mark.parametrize("closed", ["both", "left", "right", "neither"])
@pytest.mark.parametrize("bounds", [(-3, 2), (0, 4), (1, 1), (-2.5, 0.5)])
def test_band_like_a_loop(spark, closed, bounds):
    left, right = sides(3, True)
    a, b = frames(spark, left, right)
    got = band_join(a, b, ["user"], "at", "at", *bounds, {"id": "id"}, {"rid": "rid"}, closed=closed)
    low = (lambda g: g >= bounds[0]) if closed in ("both", "left") else (lambda g: g > bounds[0])
    high = (lambda g: g <= bounds[1]) if closed in ("both", "right") else (lambda g: g < bounds[1])
    wanted = sorted(
        (i, rid) for i, u, t in left for rid, v, s, _ in right if None not in (u, t, s) and u == v and low(s - t) and high(s - t)
    )
    assert sorted(tuple(r) for r in got.collect()) == wanted


def test_band_over_fractions(spark):
    a = spark.createDataFrame([("k", 0.1 * i) for i in range(60)], "k string, x double")
    got = band_join(a, a, ["k"], "x", "x", -0.3, 0.3, {"a": "x"}, {"b": "x"})
    values = [0.1 * i for i in range(60)]
    assert got.count() == sum(-0.3 <= y - x <= 0.3 for x in values for y in values)


def test_wrong_arguments(spark):
    a = spark.createDataFrame([("k", 1)], "k string, x int")
    with pytest.raises(ValueError, match="empty"):
        band_join(a, a, ["k"], "x", "x", 2, 1, {}, {})
    with pytest.raises(ValueError, match="direction"):
        asof_join(a, a, ["k"], "x", "x", {}, direction="sideways")
    with pytest.raises(ValueError, match="left_tie"):
        asof_join(a, a, ["k"], "x", "x", {}, tie=["x"], left_tie=[])
