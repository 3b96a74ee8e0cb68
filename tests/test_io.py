"""CSV and JSON files whatever their layout and splits."""

import csv
import random

import pytest
from pyspark.sql import functions as F

from plumbline.sources import csv_records
from plumbline.sources.io import _read_json, json_layouts, load


@pytest.fixture
def small_splits(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def same_as_spark(spark, path, parts=None, **options):
    """The rows that Spark's reader of whole files gives."""
    mine = load(spark, path, "mine", **options)
    theirs = load(spark, path, "theirs", multiLine=True, **options)
    assert mine.schema == theirs.schema
    assert rows_of(mine) == rows_of(theirs)
    if parts:
        assert csv_records.lines_of(spark, path, {}).rdd.getNumPartitions() >= parts
    return mine


def written(path, rows, **options):
    with open(path, "w", newline="", encoding="utf-8") as file:
        csv.writer(file, **options).writerows(rows)
    return str(path)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_texts_with_newlines_over_many_splits(spark, tmp_path, small_splits, end):
    rng = random.Random(1)
    letters = ["a", "é", ",", '"', "\n", "\n\n", " ", '""', "\r\n", "b"]
    rows = [["id", "text", "n"]] + [[i, "x" + "".join(rng.choices(letters, k=rng.randint(0, 40))) + "y", i * 1.5] for i in range(400)]
    rows[200][1] = "z" + "long \n text, " * 400
    path = written(tmp_path / "texts.csv", rows, lineterminator=end)
    # Where lines end in two characters, Spark's reader of whole files turns those inside quotes into one.
    df = same_as_spark(spark, path, parts=8) if end == "\n" else load(spark, path)
    assert df.count() == 400 and dict(df.dtypes) == {"id": "int", "text": "string", "n": "double"}
    assert {r.id: r.text for r in df.collect()} == {r[0]: r[1] for r in rows[1:]}


def test_files_without_newlines_and_quotes_inside_fields(spark, tmp_path, small_splits):
    plain = written(tmp_path / "plain.csv", [["a", "b"]] + [[i, f'say "{i}", twice'] for i in range(300)])
    same_as_spark(spark, plain, parts=5)
    odd = tmp_path / "odd.csv"
    odd.write_text("size,note\n" + "\n".join(f'{i},5" pipe {i}' for i in range(300)) + '\n7,"open\nand ""closed"""\n')
    assert same_as_spark(spark, str(odd), parts=5).where("note LIKE 'open%'").count() == 1


def test_folders_separators_and_repeated_headers(spark, tmp_path, small_splits):
    folder = tmp_path / "many.tsv"
    folder.mkdir()
    for f in range(3):
        written(folder / f"part-{f}.tsv", [["k", "t"]] + [[f * 100 + i, f"line {i}\nmore\t{f}"] for i in range(60)], delimiter="\t")
    assert same_as_spark(spark, str(folder)).count() == 180
    twice = written(tmp_path / "twice.csv", [["k", "t"], [1, "a\nb"], ["k", "t"], [2, "c"]])
    assert same_as_spark(spark, twice).count() == 3


@pytest.mark.parametrize(
    "text",
    ["", "a,b\n", "a,b\n1,2", 'a,b\n1,"x\ny"', 'a,b\n\n1,"x\n\ny"\n\n', 'a,b\n1,"never closed\nat all', '"a\nb",c\n1,2\n', "a,b\r1,2\r3,4", 'a,b\n1\n2,"p\nq",5\n'],
)
def test_odd_files(spark, tmp_path, text):
    path = tmp_path / "odd.csv"
    path.write_bytes(text.encode())
    same_as_spark(spark, str(path), schema="a string, b string")


@pytest.mark.parametrize("line, opened, leaves", [
    ('a,"b', False, True), ('"a""b",c', False, False), ('5" pipe,x', False, False), ('x"",y', True, True),
    ('x","y', True, True), ('x",y', True, False), ("", True, True), ('"a"b,"c', False, True), ('"",""', False, False),
])
def test_quotes(line, opened, leaves):
    assert csv_records.Quotes(",", '"').leaves_open(line, opened) is leaves


def test_splits_are_chained():
    from types import SimpleNamespace

    def note(start, closed_end, open_end, closes):
        return SimpleNamespace(file="f", start=start, closed_end=closed_end, open_end=open_end, closed_breaks=closed_end, open_breaks=open_end, open_closes=closes)

    # A record begins in the first split, fills the second and ends in the third.
    begins, breaks = csv_records.plan([note(20, False, False, True), note(0, True, False, True), note(10, True, True, False)])
    assert breaks and begins == {("f", 0): (False, 0), ("f", 10): (True, 0), ("f", 20): (True, 0)}


def test_json_layouts(spark, tmp_path, monkeypatch):
    import plumbline.sources.io as mine

    texts = {
        "rows.json": '{"a": 1}\n{"a": 2}\n',
        "pretty.json": '{\n  "a": 3\n}\n',
        "array.json": '[{"a": 4}, {"a": 5}]\n',
        "blank first.json": '\n  \n{"a": 6}\n',
        "long row.json": '{"a": 7, "t": "' + "x" * 500 + '"}\n{"a": 8}\n',
        "long array.json": '[{"a": 9, "t": "' + "y" * 500 + '"}]',
        "cut.json": '{"a": 10, "b": \n 1}',
    }
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    monkeypatch.setattr(mine, "START", 200)
    found = {k.rsplit("/", 1)[-1].replace("%20", " "): v for k, v in json_layouts(spark, str(tmp_path)).items()}
    assert found == {n: n in ("rows.json", "blank first.json", "long row.json") for n in texts}
    df = _read_json(spark, spark.read, str(tmp_path), {})
    assert sorted(r.a for r in df.collect()) == list(range(1, 11))


def test_names_of_columns_of_paths(spark):
    from plumbline.sources.io import sanitize_name, sanitized

    raw = ["a.csv", "9 lives.tsv", "", ".json", "x.y.z", "héé", "_", "a/b.c/d"]
    df = spark.createDataFrame([(r,) for r in raw], "raw string").select("raw", sanitized(F.col("raw")).alias("name"))
    assert {r.raw: r.name for r in df.collect()} == {r: sanitize_name(r) for r in raw}
