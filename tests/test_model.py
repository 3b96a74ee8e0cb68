import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from plumbline.operators import model, tracking
from plumbline.plans.durable import scratch_path


@pytest.fixture(scope="module")
def flowers(spark):
    """Two numbers and a word that decide a class; a little noise and some nulls."""
    kind = F.when(F.col("a") + F.col("b") > 100, "tall").otherwise("short")
    return (
        spark.range(1_200)
        .select(
            "id",
            F.when(F.col("id") % 50 != 0, F.pmod(F.hash("id"), F.lit(100)).cast("double")).alias("a"),
            F.pmod(F.hash(F.col("id") + 7), F.lit(100)).cast("double").alias("b"),
            F.when(F.col("id") % 9 != 0, F.concat(F.lit("w"), (F.col("id") % 4).cast("string"))).alias("word"),
        )
        .withColumn("kind", F.coalesce(kind, F.lit("short")))
        .withColumn("score", F.coalesce("a", F.lit(0.0)) * 3 - F.col("b"))
    )


def test_prepare_errors(spark, flowers):
    with pytest.raises(ValueError, match="not found"):
        model.prepare(flowers, "nope")
    with pytest.raises(ValueError, match="at least 10"):
        model.prepare(flowers.limit(9), "kind")
    with pytest.raises(ValueError, match="no feature"):
        model.prepare(flowers, "kind", ["KIND", "gone"])


def test_leakage_reasons(flowers):
    df = flowers.withColumns({"near": F.col("score") * 2 + F.col("id") % 3, "still": F.lit(1)})
    found = {(r.feature, r.reason) for r in model.leakage(df, "score", ["id", "near", "still", "word", "SCORE"]).collect()}
    assert ("SCORE", "is the target itself") in found and ("still", "has one value only") in found
    assert ("id", "tells nearly every row apart") in found
    assert any(f == "near" and r.startswith("correlation 1.000") for f, r in found)
    assert not [f for f, _ in found if f == "word"]


def test_encoder_bounds_levels_and_fills_nulls(spark):
    df = spark.createDataFrame(
        [(None, f"v{i % 30:02d}" if i % 4 else None, True) for i in range(240)] + [(4.0, "v01", False), (8.0, "v01", None)],
        "x double, w string, b boolean",
    )
    encoder = model.fit_encoder(df, ["x", "w", "b"], max_levels=5)
    assert encoder.medians == {"x": 6.0} and len(encoder.levels["w"]) == 5 and encoder.has_other == {"w"}
    assert "w___null__" in encoder.slots and "w___other__" in encoder.slots and "b___null__" in encoder.slots
    values = encoder.encode(df).select(vector_to_array("features").alias("v"))
    sums = values.select(F.aggregate("v", F.lit(0.0), lambda a, x: a + x).alias("s"), F.col("v")[0].alias("x"))
    assert sums.where(F.abs(F.col("s") - F.col("x") - 2) > 1e-9).count() == 0
    assert sums.where("x not in (6.0, 4.0, 8.0)").count() == 0


def test_times_become_seconds(read):
    orders = read("orders").select("o_orderdate")
    encoder = model.fit_encoder(orders, ["o_orderdate"])
    assert 6e8 < encoder.medians["o_orderdate"] < 1e9
    assert encoder.encode(orders).select(vector_to_array("features")[0].alias("s")).where("s < 6e8").count() == 0


@pytest.mark.parametrize("parts", [1, 4, 17])
def test_split_ignores_partitioning(read, parts):
    events = read("events").select("event_id", "event_type")
    _, test = model.split(events, 42, ["event_id"])
    _, again = model.split(events.repartition(parts), 42, ["event_id"])
    assert {r.event_id for r in test.collect()} == {r.event_id for r in again.collect()}
    assert 0.2 < test.count() / events.count() < 0.3
    _, other = model.split(events, 43, ["event_id"])
    assert {r.event_id for r in other.collect()} != {r.event_id for r in test.collect()}


def test_small_classes_reach_both_sides(spark):
    df = spark.range(400).select("id", F.when(F.col("id") < 2, "pair").when(F.col("id") < 9, "seven").otherwise("rest").alias("c"))
    train, test = model.split(df, 1, ["id"], "c")
    counts = {r.c: r["count"] for r in test.groupBy("c").count().collect()}
    assert counts["pair"] == 1 and 1 <= counts["seven"] <= 6
    assert train.count() + test.count() == 400 and train.columns == df.columns


def test_each_class_of_two_rows_or_more_reaches_both_sides(spark):
    """Whatever its size; only copies of one row stay together."""
    df = spark.range(600).select("id", (F.col("id") % 250).alias("c")).unionAll(spark.createDataFrame([(-1, -1)] * 3, "id long, c long"))
    sides = model.with_test_flag(df, 1, ["id"], "c").groupBy("c").agg(F.count_if("is_test").alias("t"), F.count("*").alias("n")).collect()
    assert all(0 < r.t < r.n for r in sides if r.c >= 0)
    assert [r.t in (0, 3) for r in sides if r.c == -1] == [True]


def test_features_may_be_called_like_internal_columns(spark):
    """A random feature called label, features or row_index teaches nothing."""
    df = spark.range(800).select(
        (F.xxhash64("id") % 2 == 0).cast("int").alias("y"), "id", *[(F.xxhash64("id", F.lit(n)) % 5).alias(n) for n in ("label", "features", "row_index")]
    )
    names = ["label", "features", "row_index"]
    clash = model.train(df, "y", names, "tree", max_depth=3, split_keys=["id"])
    plain = df.withColumnsRenamed({n: f"c_{n}" for n in names})
    other = model.train(plain, "y", [f"c_{n}" for n in names], "tree", max_depth=3, split_keys=["id"])
    assert clash["metrics"] == other["metrics"] and clash["metrics"]["accuracy"] < 0.7


def test_classifier_learns_and_repeats(flowers):
    runs = [
        model.train(df, "kind", ["a", "b", "word"], "tree", max_depth=6)
        for df in (flowers, flowers.repartition(5))
    ]
    first, again = runs
    assert first["task"] == "classification" and first["beats_baseline"]
    assert first["metrics"]["accuracy"] > 0.85 > first["baseline"]["accuracy"]
    assert first["n_train"] + first["n_test"] == 1_200 and first["n_features"] == 7
    cells = {(r.actual, r.predicted): r["count"] for r in first["confusion"].collect()}
    assert set(cells) <= {(a, p) for a in ("short", "tall") for p in ("short", "tall")}
    assert sum(cells.values()) == first["n_test"]
    assert first["importances"].first().feature in ("a", "b")
    stress = {r.name: r.metric for r in first["stress"].collect()}
    assert len(stress) == 3 and all(0 <= m <= 1 for m in stress.values())
    assert again["n_test"] == first["n_test"] and again["metrics"] == first["metrics"]
    assert {r.name: r.metric for r in again["stress"].collect()} == stress


@pytest.mark.parametrize("algo", ["linear", "tree", "forest"])
def test_every_algorithm_runs_on_both_tasks(flowers, algo):
    fitted = model.train(flowers, "score", ["a", "b"], algo, max_depth=5, trees=5)
    assert fitted["task"] == "regression" and fitted["beats_baseline"]
    assert fitted["primary"]["name"] == "R2" and fitted["metrics"]["rmse"] >= fitted["metrics"]["mae"]
    assert fitted["confusion"] is None and fitted["leakage"].count() == 0
    named = model.train(flowers, "kind", ["a", "b"], algo, max_depth=5, trees=5)
    assert named["beats_baseline"] and named["importances"].count() == 2


def test_perturbations_change_what_they_should(flowers):
    from plumbline.operators.indexing import dense_index

    encoder = model.fit_encoder(flowers, ["a", "b"])
    test = encoder.encode(dense_index(flowers).withColumn("label", F.lit(0.0))).select("row_index", "label", "features")
    copies = model.perturb(test, 2, 42, 0)
    values = {k: v.select("row_index", vector_to_array("features").alias("v")) for k, v in (copies | {"clean": test}).items()}
    pairs = {k: v.alias("x").join(values["clean"].alias("c"), "row_index") for k, v in values.items()}
    noise = pairs["noise"].select((F.col("x.v")[0] - F.col("c.v")[0]).alias("d"))
    spread = noise.agg(F.avg("d"), F.stddev("d")).first()
    sd = test.select(vector_to_array("features")[0].alias("v")).agg(F.stddev("v")).first()[0]
    assert abs(spread[0]) < 0.02 * sd and spread[1] == pytest.approx(0.1 * sd, rel=0.1)
    zeroed = pairs["zeroed"].agg(F.avg((F.col("x.v")[1] != F.col("c.v")[1]).cast("int"))).first()[0]
    assert 0.05 < zeroed < 0.15
    moved = [sorted(r.v[0] for r in values[k].collect()) for k in ("shuffled", "clean")]
    assert moved[0] == moved[1]
    changed = pairs["shuffled"].agg(F.avg((F.col("x.v")[0] != F.col("c.v")[0]).cast("int"))).first()[0]
    kept = pairs["shuffled"].where(F.col("x.v")[1] != F.col("c.v")[1]).count()
    assert changed > 0.9 and kept == 0


def test_levels_and_importances_are_not_cut(spark):
    df = spark.range(900).select("id", (F.col("id") % 300).cast("string").alias("w"), (F.col("id") % 2).alias("y"))
    encoder = model.fit_encoder(df, ["w"])
    assert len(encoder.levels["w"]) == 300 and not encoder.has_other
    fitted = model.train(df, "y", ["w"], "tree", max_depth=2, split_keys=["id"], top_importances=None)
    assert fitted["importances"].count() == 300


# -- log and gate --------------------------------------------------------------


def test_log_appends_and_ranks(spark, flowers):
    path = scratch_path(spark, "runs")
    for i, depth in enumerate((1, 6)):
        result = model.train(flowers, "kind", ["a", "b"], "tree", max_depth=depth)
        tracking.log_run(result, path, "flowers", run_id=f"r{i}", ts=f"2024-01-0{i + 1}")
    runs = tracking.best_runs(tracking.read_runs(spark, path)).collect()
    assert [r.id for r in runs] == ["r1", "r0"] and [r.is_best for r in runs] == [True, False]
    assert runs[0].lift == pytest.approx(runs[0].primary_model - runs[0].primary_baseline)


def test_first_run_wins_ties(spark):
    data = [("b", "2", 0.5, None), ("a", "1", 0.5, -0.1), ("c", "3", float("nan"), -0.01)]
    df = spark.createDataFrame(data, "id string, ts string, primary_model double, worst_stress_delta double")
    df = df.withColumns({"table": F.lit("t"), "target": F.lit("y"), "primary_baseline": F.lit(0.4)})
    found = {r.id: (r.is_best, r.fragile) for r in tracking.best_runs(df).collect()}
    assert found["a"] == (True, True) and found["b"] == (False, False)


def test_ship_gate_labels(spark):
    def contracts(*rows):
        return spark.createDataFrame(list(rows), "failed int, errored int")

    label = lambda **kw: tracking.ship_gate(**kw).first().label
    assert label() == "No checks"
    assert label(contracts=contracts((0, 0))) == "Ship-ready"
    assert label(contracts=contracts((0, 0), (None, None))) == "Checking…"
    assert label(contracts=contracts((0, 1), (None, None))) == "1 issue"
    models = spark.createDataFrame([(True,), (False,)], "beats_baseline boolean")
    ab = spark.createDataFrame([(True,)], "mismatch boolean")
    drift = spark.createDataFrame([("drift",), ("warn",)], "overall string")
    row = tracking.ship_gate(contracts((2, 1)), models, ab, drift).first()
    assert tuple(row) == (6, 0, True, "6 issues")


def test_best_run_with_missing_scores_and_names(spark):
    rows = [("a", "1", None, 0.5), ("b", "2", None, None), ("c", "3", None, float("nan")), ("d", "1", "t", None)]
    runs = spark.createDataFrame(
        [(i, ts, t, "y", score, 0.1, 0.0) for i, ts, t, score in rows],
        "id string, ts string, table string, target string, primary_model double, primary_baseline double, worst_stress_delta double",
    )
    from plumbline.operators import tracking

    assert {r.id: r.is_best for r in tracking.best_runs(runs).collect()} == {"a": True, "b": False, "c": False, "d": True}


def test_a_million_levels_stay_off_the_driver(spark, monkeypatch):
    """Slots are counted; the level of a third of all rows and the rare ones meet their slot in a join."""
    monkeypatch.setattr(model, "BROADCAST_LEVELS", 1000)
    code = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("c"), F.col("id").cast("string")))
    df = spark.range(1_500_000).select(code.alias("code"), (F.col("id") % 2 == 0).alias("flag"), "id")
    collected = []
    real = type(df).collect
    monkeypatch.setattr(type(df), "collect", lambda self: collected.append(rows := real(self)) or rows)
    encoder = model.fit_encoder(df, ["id", "code", "flag"])
    assert encoder.n_slots == 1 + 1_000_001 + 2 and max(map(len, collected)) < 100
    cells = encoder.parts(df, []).select(F.explode("features.indices").alias("slot"))
    per_slot = cells.groupBy("slot").count()
    assert per_slot.count() == encoder.n_slots
    top = per_slot.where("slot > 0").orderBy(F.desc("count")).limit(3).collect()
    assert [r["count"] for r in top] == [750_000, 750_000, 500_000]
    assert encoder.slot_names([0, top[2].slot]) == {0: "id", top[2].slot: "code_hot"}
    vectors = encoder.encode(df.limit(10))
    assert {(v.features.size, v.features.indices.size) for v in vectors.collect()} == {(encoder.n_slots, 3)}


def test_unseen_levels_are_an_error(spark):
    seen = spark.createDataFrame([("a",), ("b",)], "w string")
    encoder = model.fit_encoder(seen, ["w"])
    with pytest.raises(Exception, match="has not seen: c"):
        encoder.encode(spark.createDataFrame([("c",)], "w string")).collect()


def test_many_classes(spark):
    kind = F.col("id") % 150
    df = spark.range(6000).select("id", (kind % 12).alias("x"), F.floor(kind / 12).alias("z"), F.concat(F.lit("class"), kind.cast("string")).alias("y"))
    found = model.train(df, "y", ["x", "z"], "tree", max_depth=12, split_keys=["id"])
    assert found["task"] == "classification" and found["metrics"]["accuracy"] > 0.7
    names = {r.actual for r in found["confusion"].collect()}
    assert names == {f"class{i}" for i in range(150)}
    with pytest.raises(ValueError, match="150 classes, more than max_classes"):
        model.train(df, "y", ["x", "z"], "tree", max_classes=100, split_keys=["id"])


def test_fifty_thousand_classes_are_counted_first(spark):
    df = spark.range(100_000).select((F.col("id") % 50_000).cast("string").alias("y"), "id")
    with pytest.raises(ValueError, match="50000 classes"):
        model.train(df, "y", ["id"], "tree", split_keys=["id"])
    classes, n = model.class_table(df, "y", max_classes=50_000)
    labelled = model.with_label(df, "y", classes, n, "label")
    assert labelled.agg(F.count_distinct("label")).first()[0] == n == 50_000
    assert labelled.schema["label"].metadata["ml_attr"]["num_vals"] == 50_000


def test_unchecked_contracts_are_found(spark):
    summary = spark.createDataFrame([("a", 1, 0)], "table string, failed bigint, errored bigint")
    states = tracking.contract_states(["a", "b"], summary, spark)
    assert tracking.ship_gate(states).first()[:3] == (1, 1, True)
