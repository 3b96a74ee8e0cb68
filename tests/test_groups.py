"""Python code over groups, whole and in slices."""

import pandas as pd
import pytest

from plumbline.operators.groups import Apart, GroupTooLarge, apply_groups, combine_groups
from plumbline.sources.workspace import Workspace
from plumbline.workload import QUERIES


@pytest.fixture(scope="module")
def sales(spark):
    """3 000 rows, a third of them of one group, many of those equal in all columns."""
    rows = [("hot", 1.0) if i % 3 == 0 else (None if i % 31 == 0 else f"g{i % 40}", float(i % 7)) for i in range(3000)]
    return spark.createDataFrame(rows, "shop string, value double").repartition(6)


def expected(sales):
    return {
        None if k is None or k != k else k: (len(v), float(v["value"].sum()), float(v["value"].max()))
        for k, v in sales.toPandas().groupby("shop", dropna=False)
    }


def test_whole_groups(sales):
    fn = lambda rows: pd.DataFrame({"n": [len(rows)], "total": [rows["value"].sum()], "most": [rows["value"].max()]})
    found = apply_groups(sales, ["shop"], fn, "n bigint, total double, most double").collect()
    assert {r.shop: (r.n, r.total, r.most) for r in found} == expected(sales)


def test_a_group_that_is_too_large_is_an_error(sales):
    with pytest.raises(GroupTooLarge, match="1 groups of shop hold more than 500 rows, the largest 1000"):
        apply_groups(sales, ["shop"], lambda rows: rows[["value"]], "value double", max_rows=500)


def test_slices_of_a_hot_group(sales):
    """No call sees much more than a slice, and all rows count once."""
    def partial(rows):
        return pd.DataFrame({"n": [len(rows)], "total": [rows["value"].sum()], "most": [rows["value"].max()], "seen": [len(rows)]})

    def merge(rows):
        return pd.DataFrame({"n": [rows["n"].sum()], "total": [rows["total"].sum()], "most": [rows["most"].max()], "seen": [rows["seen"].max()]})

    schema = "n bigint, total double, most double, seen bigint"
    found = combine_groups(sales, ["shop"], partial, merge, merge, schema, schema, slice_rows=50).collect()
    assert {r.shop: (r.n, r.total, r.most) for r in found} == expected(sales)
    hot = next(r for r in found if r.shop == "hot")
    assert hot.seen < 400


def test_merging_in_rounds(sales):
    one = lambda rows: rows[["value"]].drop_duplicates()
    found = combine_groups(sales, ["shop"], one, one, lambda rows: pd.DataFrame({"n": [len(rows)]}), "value double", "n bigint", 8)
    assert {r.shop: r.n for r in found.collect()}["g1"] >= 1
    with pytest.raises(GroupTooLarge, match="merge has to return fewer"):
        same = lambda rows: rows[["value"]]
        combine_groups(sales, ["shop"], same, same, same, "value double", "value double", 100)


def test_workspace_and_edges(spark, sales):
    ws = Workspace(spark)
    ws.publish("sales", sales)
    count = lambda rows: pd.DataFrame({"n": [len(rows)]})
    assert ws.apply("sales", ["shop"], count, "n bigint").count() == len(expected(sales))
    add = lambda rows: pd.DataFrame({"n": [rows["n"].sum()]})
    found = ws.combine("sales", ["shop", "value"], count, add, add, "n bigint", "n bigint")
    assert found.columns == ["shop", "value", "n"] and sum(r.n for r in found.collect()) == 3000
    empty = sales.limit(0)
    assert apply_groups(empty, ["shop"], count, "n bigint").collect() == []
    assert combine_groups(empty, ["shop"], count, add, add, "n bigint", "n bigint").collect() == []
    odd = spark.createDataFrame([(1, 2), (1, 3)], "`a.b c` int, __slice int")
    assert [tuple(r) for r in apply_groups(odd, ["a.b c"], count, "n bigint").collect()] == [(1, 2)]
    assert [tuple(r) for r in combine_groups(odd, ["a.b c"], count, add, add, "n bigint", "n bigint").collect()] == [(1, 2)]


def test_a_set_larger_than_a_slice(spark):
    """1 201 values, null among them, which is a third of the rows: no merging sees much more than a slice."""
    rows = [("a" if i % 4 else None, None if i % 3 == 0 else i % 1801) for i in range(9000)]
    df = spark.createDataFrame(rows, "shop string, value int").repartition(5)

    def per_value(rows):
        return rows.groupby("value", as_index=False, dropna=False)[["n", "most"]].agg({"n": "sum", "most": "max"})

    def close(rows):
        return pd.DataFrame({"n": [rows["n"].sum()], "values": [len(rows)], "most": [rows["most"].max()]})

    def add(rows):
        return pd.DataFrame({"n": [rows["n"].sum()], "values": [rows["values"].sum()], "most": [rows["most"].max()]})

    partial = lambda rows: pd.DataFrame({"value": rows["value"], "n": 1, "most": 0})
    merge = lambda rows: per_value(rows.assign(most=rows["most"].clip(lower=len(rows))))
    apart = Apart(["value"], close, add, "n bigint, values bigint, most bigint")
    schema = "value int, n bigint, most bigint"
    found = Workspace(spark).publish("sets", df) and Workspace(spark).combine(
        "sets", ["shop"], partial, merge, add, schema, apart.schema, 60, apart
    )
    expected = {k: (sum(s == k for s, _ in rows), len({v for s, v in rows if s == k})) for k in ("a", None)}
    found = found.collect()
    assert {r.shop: (r.n, r["values"]) for r in found} == expected
    assert 30 < max(r.most for r in found) < 300
    assert combine_groups(df.limit(0), ["shop"], partial, merge, add, schema, apart.schema, 60, apart).collect() == []


def test_a_value_that_does_not_merge_is_an_error(spark):
    df = spark.createDataFrame([("a", 1)] * 300, "shop string, value int")
    same = lambda rows: rows[["value"]]
    apart = Apart(["value"], same, same, "value int")
    with pytest.raises(GroupTooLarge, match="300 rows of one value of value"):
        combine_groups(df, ["shop"], same, same, same, "value int", "value int", 100, apart)


def test_hot_groups_of_more_users_than_a_slice(spark, tmp_path):
    """30 000 users of one type, in slices of 20 000 rows; rows without a user or a value are as in small groups."""
    rows = [("view", i % 30_000, float(i % 101)) for i in range(36_000)] + [("click", i % 7, None if i % 7 == 3 else float(i)) for i in range(70)]
    rows += [("view", None, 5.0), (None, 1, 2.0), ("error", None, 1.0)]
    spark.createDataFrame(rows, "event_type string, user_id bigint, value double").write.parquet(f"{tmp_path}/events.parquet")
    found = {r.event_type: r for r in QUERIES["python_groups_hot"](spark, str(tmp_path)).collect()}
    assert set(found) == {"view", "click", None}
    for kind, r in found.items():
        mine = [(u, v) for k, u, v in rows if k == kind and u is not None]
        values = pd.Series([v for _, v in mine], dtype=float)
        assert (r.n, r.users) == (values.count(), len({u for u, _ in mine}))
        assert r["mean"] == pytest.approx(values.mean(), abs=1e-4)
        assert r.deviation == (pytest.approx(values.std(), abs=1e-4) if r.n > 1 else None)
