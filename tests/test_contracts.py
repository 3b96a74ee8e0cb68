import pytest
from pyspark.sql import functions as F

from plumbline.operators.contracts import Rule, describe, evaluate, evaluate_all, summarize
from plumbline.plans.durable import scratch_path
from plumbline.streaming.contracts import contract_stream, read_results


def failing(df, *rules):
    return {r.rule_id: r.failing_rows for r in evaluate(df, "t", list(rules)).collect()}


def test_unique_counts_every_duplicated_row(spark):
    df = spark.createDataFrame([(k,) for k in [1, 2, 2, 3, 3, 3, None, None]], "k int")
    assert failing(df, Rule("u", "unique", "k")) == {"u": 5}


def test_unique_on_nested_keys(spark):
    df = spark.createDataFrame([({"a": 1, "b": 2},), ({"b": 2, "a": 1},), ({"a": 3},)], "m map<string,int>")
    assert failing(df, Rule("u", "unique", "m")) == {"u": 2}


def test_nulls_only_break_not_null(spark):
    df = spark.createDataFrame([(None, None), (5, "x")], "n int, s string")
    found = failing(
        df,
        Rule("null", "not_null", "n"),
        Rule("range", "range", "n", min=6),
        Rule("no_bounds", "range", "n"),
        Rule("values", "allowed_values", "s", values=("y",)),
        Rule("nothing_allowed", "allowed_values", "s"),
        Rule("regex", "regex", "s", pattern="^y"),
        Rule("any_text", "regex", "s"),
    )
    assert found == {
        "null": 1, "range": 1, "no_bounds": 0, "values": 1, "nothing_allowed": 1, "regex": 1, "any_text": 0,
    }


def test_empty_table_passes_all_but_row_count(spark):
    df = spark.createDataFrame([], "n int, s string")
    rules = [Rule("a", "not_null", "n"), Rule("b", "unique", "n"), Rule("c", "range", "n", min=1)]
    assert failing(df, *rules, Rule("d", "row_count", min=1)) == {"a": 0, "b": 0, "c": 0, "d": 1}


def test_bad_rules_do_not_disturb_the_others(spark):
    df = spark.createDataFrame([("abc",), ("12",)], "s string")
    result = {
        r.rule_id: r
        for r in evaluate(
            df,
            "t",
            [
                Rule("regex", "regex", "s", pattern="("),
                Rule("number", "range", "s", max=5),
                Rule("gone", "unique", "nope"),
                Rule("no_column", "not_null"),
                Rule("odd", "odd_type", "s"),
                Rule("fine", "regex", "s", pattern="[0-9]"),
                Rule("unique", "unique", "s"),
                Rule("size", "row_count", min=1, max=1),
            ],
        ).collect()
    }
    for name in ("regex", "number", "gone", "no_column", "odd"):
        assert result[name].failing_rows == -1 and not result[name].passed and result[name].detail
    assert result["fine"].failing_rows == 1 and result["unique"].passed
    assert result["size"].failing_rows == 1 and result["size"].detail == "2 rows"
    summary = summarize(evaluate(df, "t", [Rule("a", "not_null", "s"), Rule("b", "regex", "s", pattern="(")])).first()
    assert (summary.passed, summary.failed, summary.errored) == (1, 0, 1)


def test_column_names_with_odd_characters(spark):
    df = spark.createDataFrame([(1,), (1,)], "`a.b ``c` int")
    assert failing(df, Rule("u", "unique", "a.b `c"), Rule("n", "not_null", "a.b `c")) == {"u": 2, "n": 0}


def test_missing_tables_are_skipped(spark):
    df = spark.range(3)
    rules = [Rule("a", "not_null", "id")]
    assert evaluate_all({"t": df}, {"t": rules, "gone": rules, "empty": []}).count() == 1
    assert evaluate_all({}, {"gone": rules}).count() == 0


def test_descriptions():
    assert describe(Rule("a", "range", "x", min=0)) == "x from 0 to any"
    assert describe(Rule("a", "range", "x", max=1.5)) == "x from any to 1.5"
    assert describe(Rule("a", "row_count", max=9)) == "rows from 0 to 9"
    assert describe(Rule("a", "allowed_values", "x", values=("a", "b"))) == "x is one of: a, b"
    assert describe(Rule("a", "regex", "x", pattern="^a")) == "x fits the pattern ^a"


@pytest.mark.parametrize("parts", [1, 4, 17])
def test_partitions_do_not_change_results(read, parts):
    df = read("lineitem")
    rules = [Rule("u", "unique", "l_orderkey"), Rule("r", "range", "l_discount", max=0.05)]
    assert failing(df.repartition(parts), *rules) == failing(df, *rules)


def test_stream_checks_each_batch_and_can_be_replayed(spark):
    source, results, checkpoint = (scratch_path(spark, n) for n in ("in", "out", "check"))
    rules = [Rule("u", "unique", "k"), Rule("n", "not_null", "k")]

    def run():
        stream = spark.readStream.schema("k int").parquet(source)
        contract_stream(stream, "t", rules, results, checkpoint, once=True).awaitTermination()
        return {(r.batch_id, r.rule_id): r.failing_rows for r in read_results(spark, results).collect()}

    spark.createDataFrame([(1,), (1,), (None,)], "k int").coalesce(1).write.parquet(source)
    assert run() == {(0, "u"): 2, (0, "n"): 1}
    spark.createDataFrame([(1,)], "k int").write.mode("append").parquet(source)
    expected = {(0, "u"): 2, (0, "n"): 1, (1, "u"): 1, (1, "n"): 0}
    assert run() == expected and run() == expected
    assert read_results(spark, results).where(F.col("batch_id").isNull()).count() == 0


def test_keys_that_recur_in_a_later_batch(spark, tmp_path):
    from plumbline.operators.contracts import Rule
    from plumbline.streaming.contracts import contract_stream, read_results

    source, results = tmp_path / "in", str(tmp_path / "out")
    rules = [Rule("key", "unique", "k"), Rule("there", "not_null", "k")]
    for keys in ([1, 2, None], [2, 3, 3], [4, None]):
        spark.createDataFrame([(k,) for k in keys], "k int").coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema("k int").parquet(str(source))
        contract_stream(stream, "t", rules, results, str(tmp_path / "check"), once=True).awaitTermination()
    found = {(r.batch_id, r.rule_id): r.failing_rows for r in read_results(spark, results).collect()}
    assert found == {(0, "key"): 0, (1, "key"): 3, (2, "key"): 0, (0, "there"): 1, (1, "there"): 0, (2, "there"): 1}


def test_text_that_is_no_number_is_counted_in_the_same_pass(spark):
    from plumbline.operators.contracts import Rule, evaluate

    df = spark.createDataFrame([("1",), ("x",), ("9",), (None,)], "t string")
    bad = evaluate(df, "t", [Rule("r", "range", "t", max=5)]).first()
    assert (bad.failing_rows, bad.detail) == (-1, "1 values of t are not numbers")
    good = evaluate(df.where("t <> 'x'"), "t", [Rule("r", "range", "t", max=5)]).first()
    assert good.failing_rows == 1


def test_cost_of_a_stream_batch_does_not_grow(spark, tmp_path):
    """Six batches: the state that a batch touches is that of its own keys, and no key files are kept beside it."""
    source, results = str(tmp_path / "in"), str(tmp_path / "out")
    rules = [Rule("a", "unique", "k"), Rule("a/b", "unique", "k"), Rule("bad", "range", "gone", max=1)]
    touched = []
    for b in range(6):
        spark.range(b * 50, b * 50 + 50).selectExpr("cast(id as int) AS k").coalesce(1).write.mode("append").parquet(source)
        query = contract_stream(spark.readStream.schema("k int").parquet(source), "t", rules, results, str(tmp_path / "check"), once=True)
        query.awaitTermination()
        progress = [p for p in query.recentProgress if p["numInputRows"]]
        touched.append(sum(p["stateOperators"][0]["numRowsUpdated"] for p in progress))
    # Per batch: 50 keys of all time and 50 of the batch, for two rules, and the batch itself.
    assert touched == [201] * 6
    assert sorted(p.name for p in tmp_path.iterdir()) == ["check", "in", "out"]
    found = {(r.batch_id, r.rule_id): r.failing_rows for r in read_results(spark, results).collect()}
    assert found == {(b, r): v for b in range(6) for r, v in (("a", 0), ("a/b", 0), ("bad", -1))}


def test_hot_key_and_text_in_a_stream(spark, tmp_path):
    source, results = str(tmp_path / "in"), str(tmp_path / "out")
    rules = [Rule("u", "unique", "k"), Rule("r", "range", "t", max=5), Rule("n", "row_count", max=4000)]
    for b in range(2):
        spark.range(3000).selectExpr("if(id % 3 = 0, -1, id * 2 + {b}) AS k".format(b=b), "if(id = 7, 'x', '4') AS t").write.mode("append").parquet(source)
        contract_stream(spark.readStream.schema("k long, t string").parquet(source), "t", rules, results, str(tmp_path / "check"), once=True).awaitTermination()
    found = {(r.batch_id, r.rule_id): (r.failing_rows, r.detail) for r in read_results(spark, results).collect()}
    unread = (-1, "1 values of t are not numbers")
    assert found == {(b, r): v for b in range(2) for r, v in (("u", (1000, None)), ("r", unread), ("n", (0, "3000 rows")))}


def test_stream_without_unique_rules(spark, tmp_path):
    source, results = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1,), (None,)], "k int").write.parquet(source)
    contract_stream(spark.readStream.schema("k int").parquet(source), "t", [Rule("n", "not_null", "k")], results, str(tmp_path / "c"), once=True).awaitTermination()
    assert [(r.rule_id, r.failing_rows, r.total) for r in read_results(spark, results).collect()] == [("n", 1, 2)]
