import datetime

import pytest
from pyspark.sql import functions as F

from plumbline.operators.contracts import Rule
from plumbline.plans.durable import scratch_path
from plumbline.sources import io
from plumbline.sources.workspace import Workspace, run_python


def test_names():
    names = {"my data.csv": "my_data", "2024.parquet": "_2024", ".csv": "dataset", "a.b.json": "a_b", "x": "x"}
    assert {k: io.sanitize_name(k) for k in names} == names


def test_csv_keeps_odd_text(spark, rows):
    path = scratch_path(spark, "odd") + ".csv"
    data = [(1, 'say "hi", twice', datetime.date(2024, 1, 2)), (2, "  padded  ", None), (3, "tab\tand, comma", None)]
    df = spark.createDataFrame(data, "i int, s string, d date")
    io.save_csv(df, path)
    loaded = io.load(spark, path, "odd")
    assert rows(loaded) == rows(df)
    assert dict(loaded.dtypes) == {"i": "int", "s": "string", "d": "date"}
    assert spark.table("odd").count() == 3


def test_csv_writes_nested_columns_as_json(spark):
    path = scratch_path(spark, "nested") + ".csv"
    io.save_csv(spark.createDataFrame([([1, 2],)], "a array<int>"), path)
    assert io.load(spark, path).first().a == "[1,2]"


def test_inference_reads_all_rows(spark):
    path = scratch_path(spark, "late") + ".csv"
    late = spark.range(5_000).select(F.when(F.col("id") == 4_999, "word").otherwise(F.col("id").cast("string")).alias("v"))
    io.save_csv(late, path)
    assert dict(io.load(spark, path).dtypes) == {"v": "string"}


def test_json_layouts(spark, tmp_path):
    texts = {"array.json": '[{"a": 1},\n {"a": 2}]', "lines.json": '{"a": 1}\n{"a": 2}\n', "lines.jsonl": '{"a": 1}\n{"a": 2}',
             "one.json": '{\n "a": 3\n}'}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    found = {n: sorted(r.a for r in io.load(spark, str(tmp_path / n)).collect()) for n in texts}
    assert found == {"array.json": [1, 2], "lines.json": [1, 2], "lines.jsonl": [1, 2], "one.json": [3]}


def test_load_all_reloads_changed_files(spark, tmp_path):
    path = tmp_path / "data.tsv"
    path.write_text("a\tb\n1\tx\n")
    assert io.load_all(spark, {"data": str(path)})["data"].first().b == "x"
    path.write_text("a\tb\n1\ty\n")
    io.load_all(spark, {"data": str(path)})
    assert spark.table("data").first().b == "y"


def test_named_results(spark):
    io.run_sql(spark, "SELECT 1 AS a;", "named")
    io.run_sql(spark, "SELECT a + 1 AS a FROM named", "named_next")
    assert spark.table("named_next").first().a == 2
    for value in (1, 2):
        assert io.run_sql(spark, f"SELECT {value} AS a", "stored", persist=True).first().a == value
    Workspace(spark).drop("stored")
    assert not spark.catalog.tableExists("stored")


def test_workspace(spark, tmp_path):
    (tmp_path / "in put.csv").write_text("k\n1\n1\n")
    ws = Workspace(spark)
    ws.load(str(tmp_path / "in put.csv"))
    assert ws.describe("in_put") == [("k", "int")] and ws.count("in_put") == 2
    import pandas as pd

    ws.publish("from_pandas", pd.DataFrame({"x": [1, 2, 3]}))
    assert {"in_put", "from_pandas"} <= set(ws.tables())
    checked = ws.check({"in_put": [Rule("u", "unique", "k")], "gone": [Rule("u", "unique", "k")]})
    assert [r.failing_rows for r in checked.collect()] == [2]
    (tmp_path / "in put.csv").write_text("k\n1\n2\n3\n")
    ws.reload()
    assert ws.count("in_put") == 3
    ws.drop("in_put")
    with pytest.raises(KeyError, match="available"):
        ws.table("in_put")


def test_python_step_gets_the_seed(spark):
    draws = [run_python(spark, lambda ws: spark.range(5).select(F.rand(ws.seed)).collect(), seed=7) for _ in range(2)]
    assert draws[0] == draws[1]


def test_group_wise_pandas_step(spark, rows):
    def step(ws):
        df = spark.range(10).select((F.col("id") % 2).alias("g"), F.col("id").cast("double").alias("v"))
        centred = df.groupBy("g").applyInPandas(lambda p: p.assign(v=p.v - p.v.mean()), "g long, v double")
        return ws.publish("centred", centred)

    run_python(spark, step)
    assert rows(spark.table("centred").groupBy("g").agg(F.round(F.sum("v"), 6).alias("s"))) == [(0, 0.0), (1, 0.0)]


def test_compressed_and_mixed_json(spark, tmp_path):
    import gzip

    with gzip.open(tmp_path / "x.json.gz", "wt") as file:
        file.write('{"a": 1}\n{"a": 2}\n')
    assert sorted(r.a for r in io.load(spark, str(tmp_path / "x.json.gz")).collect()) == [1, 2]
    with gzip.open(tmp_path / "y.tsv.gz", "wt") as file:
        file.write("a\tb\n1\t2\n")
    assert io.load(spark, str(tmp_path / "y.tsv.gz")).collect() == [(1, 2)]
    (tmp_path / "z.ndjson").write_text('{"a": 5}\n')
    assert io.load(spark, str(tmp_path / "z.ndjson")).first().a == 5
    folder = tmp_path / "both kinds.json"
    folder.mkdir()
    (folder / "a.json").write_text('[{"a": 1},\n {"a": 2}]')
    (folder / "b.json").write_text('{"a": 3, "b": 9}\n{"a": 4}\n')
    (folder / "c.json").write_text("{\n \"a\": 5\n}")
    assert sorted(r.a for r in io.load(spark, str(folder)).collect()) == [1, 2, 3, 4, 5]


def test_newlines_and_quotes_survive_csv(spark, tmp_path):
    df = spark.createDataFrame([("a\nb", 1), ('say "x", y\r\nz', 2), (None, 4)], "t string, i int")
    io.save_csv(df, str(tmp_path / "t.csv"))
    assert sorted(io.load(spark, str(tmp_path / "t.csv"), schema=df.schema).collect(), key=str) == sorted(df.collect(), key=str)


def test_workspace_reset_seed_and_dictionary(spark):
    import random

    ws = Workspace(spark, seed=5)
    ws.reset()
    assert ws.describe_all() is None
    ws.publish("one", spark.range(3))
    ws.publish("two", spark.range(2).selectExpr("id AS k"))
    notes = ws.describe_all().withColumn("description", F.lit("kept"))
    assert sorted((r.table, r.column, r.description) for r in ws.describe_all(notes).collect()) == [("one", "id", "kept"), ("two", "k", "kept")]
    assert ws.run(lambda w: random.random()) == ws.run(lambda w: random.random())
    ws.reset()
    assert ws.tables() == []


def test_scratch_needs_a_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    from plumbline.plans.durable import scratch_path

    conf = lambda **kw: SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: kw.get(key.replace(".", "_"), default)))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_path(conf(spark_master="spark://host:7077"), "x")
    assert scratch_path(conf(spark_master="yarn", spark_checkpoint_dir="hdfs:///c"), "x").startswith("hdfs:///c/plumbline/")
    assert scratch_path(conf(spark_master="local[4]"), "x").startswith("file:")
