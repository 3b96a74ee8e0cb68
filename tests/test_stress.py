import pytest
from pyspark.sql import functions as F

from plumbline.operators import stress
from plumbline.operators.contracts import Rule
from plumbline.operators.indexing import dense_index


@pytest.mark.parametrize("parts", [1, 4, 17])
def test_index_is_dense_and_ordered(read, parts):
    lines = read("lineitem").repartition(parts)
    keys = ["l_shipdate", "l_orderkey"]
    rows = dense_index(lines, keys).collect()
    by_index = sorted(rows, key=lambda r: r.row_index)
    assert [r.row_index for r in by_index] == list(range(len(rows)))
    order = [(r.l_shipdate, r.l_orderkey) for r in by_index]
    assert order == sorted(order) and len(rows) == lines.count()


def test_identical_rows_are_spread_and_kept(spark):
    """Half of the rows are equal in every column, yet no partition holds them all."""
    df = spark.range(4_000).select(F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id")).alias("k"))
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        found = dense_index(df, ["k"])
    finally:
        spark.conf.set(key, before)
    assert found.select("row_index").distinct().count() == 4_000
    assert found.agg(F.max("row_index")).first()[0] == 3_999
    hot = found.where("k = 7")
    assert hot.count() == df.where("k = 7").count()
    per_file = hot.groupBy(F.input_file_name()).count().agg(F.count("count"), F.max("count")).first()
    assert per_file[0] >= 4 and per_file[1] < 1_000


def test_index_with_nested_columns(spark):
    df = spark.createDataFrame([({"b": 1}, [2]), ({"a": 1}, [1]), (None, None)], "m map<string,int>, a array<int>")
    assert sorted(r.row_index for r in dense_index(df).collect()) == [0, 1, 2]
    assert dense_index(df.limit(0)).count() == 0


def test_every_attack_keeps_the_columns(read):
    customer = read("customer")
    for key in stress.ATTACKS:
        out = stress.apply_attack(customer, key)
        assert out.columns == customer.columns
        assert out.count() == stress.input_rows(key, customer.count()), key


def test_attacks_on_nulls_and_odd_types(spark):
    df = spark.createDataFrame([(None, None, [1], True)], "s string, n decimal(5,2), a array<int>, b boolean")
    assert stress.apply_attack(df, "whitespace").first().s is None
    assert stress.apply_attack(df, "unicode").first().s is None
    row = stress.apply_attack(df, "numeric_extremes").first()
    assert row.n == 1e15 and row.a == [1] and row.b is True
    assert stress.apply_attack(df, "null_bomb").first().a == [1]


def test_harness_grades(spark, read):
    events = read("events")

    def breaks_on_blank(df):
        return df.select(F.assert_true(F.col("event_type") != "").alias("ok"), "event_type")

    rows = {r.attack: r for r in stress.stress_test(breaks_on_blank, events).collect()}
    assert rows["blank_strings"].status == "error" and rows["blank_strings"].output_rows is None
    assert rows["baseline"].status == "ok" and rows["volume_x25"].output_rows == 25 * events.count()
    assert rows["empty"].output_rows == 0 and all(r.duration_ms > 0 for r in rows.values())


def test_errors_in_columns_nobody_reads_are_found(spark):
    """A plain count would prune the failing cast away."""
    df = spark.createDataFrame([("1",), ("2",)], "s string")
    rows = stress.stress_test(lambda d: d.select(F.col("s").cast("int").alias("i"), F.lit(1).alias("one")), df).collect()
    assert {r.attack for r in rows if r.status == "error"} == {"blank_strings", "unicode"}


def test_failing_baseline_skips_the_schema_check(spark):
    df = spark.createDataFrame([("x",)], "s string")
    rows = {r.attack: r for r in stress.stress_test("SELECT cast(s AS int) AS i FROM input", df).collect()}
    assert rows["baseline"].status == "error" and "CAST_INVALID_INPUT" in rows["baseline"].message
    assert rows["empty"].status == "ok" and not rows["empty"].schema_changed


def test_rules_in_error_count_as_failed(spark):
    df = spark.createDataFrame([("x",)], "s string")
    rules = [Rule("a", "regex", "s", pattern="("), Rule("b", "not_null", "s")]
    row = stress.stress_test(lambda d: d, df, rules, attacks=["baseline"]).first()
    assert row.status == "warning" and row.contract_failures == 1 and row.output_rows == 1


def test_map_output_is_forced(spark):
    df = spark.createDataFrame([("1",)], "s string")
    make = lambda d: d.select(F.create_map(F.lit("k"), F.col("s").cast("int")).alias("m"))
    rows = {r.attack: r.status for r in stress.stress_test(make, df).collect()}
    assert rows["baseline"] == "ok" and rows["unicode"] == "error"


def test_sql_transform_restores_the_view(spark):
    spark.range(3).createOrReplaceTempView("input")
    spark.range(1).createOrReplaceTempView("other")
    rows = stress.stress_test("SELECT count(*) AS n, (SELECT count(*) FROM other) AS o FROM input", spark.range(10))
    assert {r.status for r in rows.collect()} == {"ok"}
    assert spark.table("input").count() == 3
    spark.catalog.dropTempView("input")
    stress.sql_transform("SELECT * FROM input")(spark.range(2)).count()
    assert not spark.catalog.tableExists("input")


def test_a_column_called_like_the_index(spark):
    df = spark.createDataFrame([(7, "b"), (5, "a"), (6, None)], "row_index int, t string")
    found = dense_index(df, ["row_index"])
    assert found.columns == ["row_index", "t", "_row_index"]
    assert sorted(map(tuple, found.select("row_index", "_row_index").collect())) == [(5, 0), (6, 1), (7, 2)]
    from plumbline.operators.stress import apply_attack

    nulls = apply_attack(df, "null_bomb", ["row_index"]).collect()
    assert sorted(map(tuple, nulls), key=str) == [(5, "a"), (7, "b"), (None, None)]


def test_attacks_run_at_the_same_time(spark):
    """The same report whatever the number of jobs, in less than the sum of their times."""
    import time

    def slow(rows):
        for part in rows:
            time.sleep(1.5)
            yield part

    df = spark.range(50).selectExpr("id", "cast(id AS string) AS t").coalesce(1)
    transform = lambda d: d.coalesce(1).mapInPandas(slow, d.schema)
    rules = [Rule("there", "not_null", "id")]
    keys = ["baseline", "duplicates", "null_bomb", "whitespace", "unicode", "mixed_case"]
    started = time.monotonic()
    found = stress.stress_test(transform, df, rules, keys, jobs=6).collect()
    wall, each = 1000 * (time.monotonic() - started), sum(r.duration_ms for r in found)
    assert [r.attack for r in found] == keys and wall < 0.7 * each
    alone = stress.stress_test(transform, df, rules, keys, jobs=1).drop("duration_ms").collect()
    assert [tuple(r) for r in alone] == [tuple(x for n, x in r.asDict().items() if n != "duration_ms") for r in found]
