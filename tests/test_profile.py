import math

import pytest
from pyspark.sql import functions as F

from plumbline.operators import charts, dictionary, profile


@pytest.fixture(scope="module")
def odd(spark):
    """Empty, constant, unbounded and nested columns next to a plain one."""
    schema = "n int, none double, same double, wild double, tags array<string>, kv map<string,int>, flag boolean"
    data = [
        (i, None, 3.0, float("inf") if i == 9 else float(i), ["a", str(i % 2)], {"k": i % 3}, i % 2 == 0)
        for i in range(10)
    ]
    return spark.createDataFrame(data, schema)


def test_column_stats_of_odd_columns(odd):
    stats = {r.column: r for r in profile.column_stats(odd).collect()}
    assert stats["none"].nulls == 10 and stats["none"].null_pct == 100 and stats["none"].distinct == 0
    assert stats["none"].p50 is None and stats["none"].std is None
    assert stats["same"].std == 0 and stats["same"].distinct == 1
    assert stats["n"].p50 == 4.5 and stats["n"].kind == "numeric"
    assert stats["tags"].kind == "string" and stats["tags"].distinct == 2 and stats["kv"].distinct == 3
    assert stats["flag"].kind == "boolean" and stats["wild"].max == math.inf


def test_empty_table_has_no_null_share(odd):
    stats = profile.column_stats(odd.limit(0)).collect()
    assert {(r.row_count, r.null_pct, r.distinct) for r in stats} == {(0, 0.0, 0)}
    assert profile.histogram(odd.limit(0)).count() == 0
    assert profile.top_values(odd.limit(0)).count() == 0


def test_single_row_has_no_deviation(odd):
    assert {r.std for r in profile.column_stats(odd.limit(1)).collect()} == {None}


def test_histogram_special_columns(odd, rows):
    found = profile.histogram(odd, bins=5)
    assert rows(found.where("column = 'same'"), "bin", "lower_edge", "count") == [(0, 3.0, 10)]
    assert rows(found.where("column = 'wild'"), "bin", "count") == [(0, 10)]
    assert found.where("column = 'none'").count() == 0
    assert sum(r["count"] for r in found.where("column = 'n'").collect()) == 10


def test_histogram_skips_nulls(spark):
    df = spark.createDataFrame([(None,), (0.0,), (1.0,)], "x double")
    assert [tuple(r)[1:] for r in profile.histogram(df, 2).orderBy("bin").collect()] == [(0, 0.0, 1), (1, 0.5, 1)]


def test_top_values_break_ties_by_value(spark):
    df = spark.createDataFrame([(v,) for v in "cbaabcd"], "x string")
    found = [(r["rank"], r.value, r["count"]) for r in profile.top_values(df, 3).orderBy("rank").collect()]
    assert found == [(1, "a", 2), (2, "b", 2), (3, "c", 2)]


def test_correlation_guards(spark):
    df = spark.createDataFrame([(i, 3.0, -2.0 * i, None if i % 2 else float(i)) for i in range(8)], "a int, c double, d double, e double")
    r = {(x.a, x.b): x.r for x in profile.correlation(df).collect()}
    assert len(r) == 16
    assert r["a", "c"] == 0 and r["a", "d"] == pytest.approx(-1) and r["a", "e"] == pytest.approx(1) and r["a", "a"] == 1
    assert profile.correlation(df.select("a")).count() == 0


def test_approx_profile_is_close(read):
    exact = {r.column: r for r in profile.column_stats(read("lineitem")).collect()}
    near = {r.column: r for r in profile.column_stats(read("lineitem"), approx=True).collect()}
    for name, row in exact.items():
        assert near[name].distinct == pytest.approx(row.distinct, rel=0.2)
        assert near[name].nulls == row.nulls


def test_long_texts_are_counted_by_digest(spark):
    df = spark.range(60).select(F.concat(F.repeat(F.lit("x"), 500), (F.col("id") % 7).cast("string")).alias("t"))
    assert profile.nulls_and_distinct(df).first().distinct == 7


# -- dictionary --------------------------------------------------------------


def test_semantic_types_of_given_tables(read):
    """Columns of the given tables and some derived from them."""
    derived = read("lineitem").selectExpr(
        "l_linenumber", "l_tax", "l_extendedprice AS unit_price", "l_returnflag", "l_shipdate",
        "l_quantity > 25 AS bulky", "if(l_tax > 0.04, 'Y', 'n') AS taxed", "concat('£', l_suppkey) AS owed",
        "concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey) AS hash_of_line",
    )
    found = {r.column: r.semantic_type for r in dictionary.dictionary(derived, "lines").collect()}
    assert found == {
        "l_linenumber": "category", "l_tax": "category", "unit_price": "currency", "l_returnflag": "category",
        "l_shipdate": "datetime", "bulky": "boolean", "taxed": "boolean", "owed": "currency", "hash_of_line": "id",
    }


def test_one_late_value_decides_against_a_pattern(spark):
    mails = spark.range(992).select(F.concat(F.lit("text "), F.col("id").cast("string")).alias("m"))
    mails = mails.unionAll(spark.createDataFrame([(f"a{i}@b.c",) for i in range(8)], "m string"))
    assert dictionary.dictionary(mails, "t").first().semantic_type == "text"


def test_one_bad_sample_breaks_a_pattern(spark):
    data = [(f"a{i}@b.c", f"https://x/{i}", f"${i},000.50", "yes") for i in range(6)]
    good = spark.createDataFrame(data, "mail string, link string, money string, word string")
    found = {r.column: r.semantic_type for r in dictionary.dictionary(good, "t").collect()}
    assert found == {"mail": "email", "link": "url", "money": "currency", "word": "boolean"}
    bad = good.unionAll(spark.createDataFrame([("0 none", "0 none", "0 none", "0 none")], good.schema))
    found = {r.column: r.semantic_type for r in dictionary.dictionary(bad, "t").collect()}
    assert found == {"mail": "text", "link": "text", "money": "text", "word": "category"}


def test_samples_come_from_the_whole_table(spark):
    """The smallest values sit at the very end."""
    df = spark.range(30_000).select((100_000 - F.col("id")).cast("string").alias("x"))
    found = [r.value for r in dictionary.samples(df).orderBy("rank").collect()]
    assert found == sorted(str(100_000 - i) for i in range(30_000))[:8]


def test_dictionary_of_an_empty_table(spark):
    row = dictionary.dictionary(spark.createDataFrame([], "a_id string"), "t").first()
    assert row.sample_values == [] and row.semantic_type == "text" and row.null_pct == 0


# -- charts ------------------------------------------------------------------


def test_ranked_medians_match_percentile(spark):
    df = spark.range(3_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 4).cast("string"))).alias("x"),
        F.when(F.col("id") % 11 != 0, F.pmod(F.hash("id"), F.lit(700)).cast("double")).alias("y"),
    )
    df = df.unionAll(spark.createDataFrame([("nothing", None), (None, 4.0)], "x string, y double"))
    found = {r.x: r.y for r in charts.ranked_medians(df, ["x"]).collect()}
    exact = {r.x: r.y for r in df.groupBy("x").agg(F.percentile("y", F.lit(0.5)).alias("y")).collect()}
    assert found == exact
    assert charts._medians(df, ["x"], few_values=5).count() == len(exact)


def test_chart_encodings(read):
    orders = read("orders")
    types = [charts.encoding_type(orders, c) for c in ("o_orderdate", "o_totalprice", "o_orderstatus", None)]
    assert types == ["temporal", "quantitative", "nominal", "nominal"]
    assert charts.encoding_type(orders, "o_custkey", "ordinal") == "ordinal"
    with pytest.raises(ValueError):
        charts.chart_data(orders, "o_orderstatus", aggregate="sum")


def test_all_numeric_columns_are_correlated(spark):
    df = spark.range(50).select(*[(F.col("id") * (i + 1)).cast("double").alias(f"n{i}") for i in range(12)])
    found = profile.correlation(df).collect()
    assert len(found) == 144 and all(abs(r.r - 1) < 1e-9 for r in found)


def test_three_hundred_columns_in_one_scan(spark):
    """All pairs over rows where both are present, as numpy has them."""
    import numpy as np
    from pyspark.sql import functions as F

    from plumbline.operators import profile

    n = 300
    rng = np.random.default_rng(7)
    mix = rng.normal(size=(4, n))
    values = rng.normal(size=(700, 4)) @ mix + rng.normal(size=(700, n)) + 1e6 * rng.integers(0, 3, n)
    values[rng.random(values.shape) < 0.1] = np.nan
    values[:, 5], values[:, 6] = 0.1, np.nan
    rows = [[None if np.isnan(v) else float(v) for v in r] for r in values]
    df = spark.createDataFrame(rows, ", ".join(f"c{i} double" for i in range(n))).repartition(9)
    found = {(r.a, r.b): r.r for r in profile.correlation(df).collect()}
    assert len(found) == n * n and all(found[f"c{i}", f"c{i}"] == 1 for i in range(n))
    for i, j in [(0, 1), (3, 250), (130, 131), (299, 0), (127, 128), (255, 256), *rng.integers(0, n, (200, 2))]:
        if i == j:
            continue
        both = ~np.isnan(values[:, i]) & ~np.isnan(values[:, j])
        x, y = values[both, i], values[both, j]
        wanted = 0.0 if len(x) < 2 or x.std() < 1e-12 or y.std() < 1e-12 else np.corrcoef(x, y)[0, 1]
        assert abs(found[f"c{i}", f"c{j}"] - wanted) < 1e-9, (i, j)
    pairs = df.select(*[F.corr(f"c{i}", f"c{i + 7}").alias(str(i)) for i in range(10, 60)]).first()
    assert all(abs(found[f"c{i}", f"c{i + 7}"] - pairs[str(i)]) < 1e-9 for i in range(10, 60))


@pytest.mark.parametrize("parts", [1, 4, 70])
def test_wide_correlation_edges(spark, parts, monkeypatch):
    from plumbline.operators import profile
    from plumbline.plans import comoments

    monkeypatch.setattr(comoments, "BLOCK", 3)
    monkeypatch.setattr(comoments, "FAN_IN", 4)
    names = [f"c{i}" for i in range(10)]
    exprs = [f"cast(id * {i + 1} % 17 AS double) AS c{i}" for i in range(5)]
    exprs += ["double('NaN') AS c5", "cast(null AS double) AS c6", "0.1D AS c7", "if(id = 3, double('Infinity'), id) AS c8", "if(id % 2 = 0, 0.1D, id) AS c9"]
    df = spark.range(200).selectExpr(*exprs).repartition(parts)
    found = {(r.a, r.b): r.r for r in profile.correlation(df).collect()}
    monkeypatch.setattr(profile, "PAIRS_PER_PASS", 100)
    native = {(r.a, r.b): r.r for r in profile.correlation(df).collect()}
    assert set(found) == set(native) == {(a, b) for a in names for b in names}
    for pair, r in native.items():
        assert (r != r and found[pair] != found[pair]) or abs(r - found[pair]) < 1e-9, pair
    empty = {(r.a, r.b): r.r for r in profile.correlation(df.limit(0)).collect()}
    assert empty == {(a, b): float(a == b) for a in names for b in names}


def test_distinct_integers_by_bitmaps(spark, monkeypatch):
    from plumbline.plans import aggregates

    exprs = ["id - 70000 AS low", "id % 1000 AS few", "if(id % 3 = 0, null, id * 7) AS gaps", "cast(id % 100 AS tinyint) AS t",
             "id * 1000003 AS wide", "9007199254740993 + id AS high", "cast(null AS int) AS none", "5 AS one", "double(id) AS x"]
    df = spark.range(400_000).selectExpr(*exprs)
    expected = df.agg(*[F.count_distinct(c).alias(c) for c in df.columns]).first().asDict()
    counted = []
    real = aggregates._count_in_bitmaps
    monkeypatch.setattr(aggregates, "_count_in_bitmaps", lambda d, lows, extent: counted.append(list(lows)) or real(d, lows, extent))
    assert {r.column: r.distinct for r in profile.nulls_and_distinct(df).collect()} == expected
    assert {r.column: r.distinct for r in profile.column_stats(df).collect()} == expected
    assert counted == [["low", "gaps"]] * 2
    empty = df.limit(0)
    assert {r.distinct for r in profile.nulls_and_distinct(empty).collect()} == {0}


def test_appended_files_only_are_read(spark, tmp_path):
    from plumbline.operators import profile_store

    table, store = str(tmp_path / "table"), str(tmp_path / "store")
    part = lambda a, b: spark.range(a, b).selectExpr("id", "if(id % 5 = 0, null, id / 7.0D) AS x", "concat('t', id % 40) AS t", "cast(null AS double) AS none", "id % 2 = 0 AS flag", "array(id % 3) AS l")
    part(0, 3000).coalesce(1).write.parquet(table)
    assert profile_store.update(spark, store, table) == 1 and profile_store.update(spark, store, table) == 0
    part(3000, 4000).coalesce(2).write.mode("append").parquet(table)
    assert profile_store.update(spark, store, table) == 2
    assert spark.read.parquet(store).select("file").distinct().count() == 3
    mine = {r.column: r for r in profile_store.profile(spark, store).collect()}
    exact = {r.column: r for r in profile.column_stats(spark.read.parquet(table)).collect()}
    assert list(mine) == list(exact)
    for name, e in exact.items():
        m = mine[name]
        assert (m.kind, m.physical_type, m.row_count, m.nulls) == (e.kind, e.physical_type, e.row_count, e.nulls)
        assert abs(m.distinct - e.distinct) <= 0.06 * e.distinct
        for f in ("null_pct", "min", "max", "mean", "std"):
            assert m[f] == (None if e[f] is None else pytest.approx(e[f], rel=1e-9)), (name, f)
        for f in ("p25", "p50", "p75"):
            assert (m[f] is None) == (e[f] is None) and (m[f] is None or abs(m[f] - e[f]) <= 0.05 * (e.max - e.min))
    first = [f for f in spark.read.parquet(table).inputFiles()][:1]
    assert profile_store.profile(spark, store, first).first().row_count in (500, 3000)
    assert profile_store.profile(spark, str(tmp_path / "no store")).count() == 0
