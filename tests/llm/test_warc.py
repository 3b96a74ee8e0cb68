"""Round trips of archives, and what the reader skips."""

import gzip
import hashlib
import io
import uuid

import pytest
from pyspark.sql import functions as F

from plumbline.llm import warc
from plumbline.plans.durable import scratch_path

BIG, OTHER = "x" * 3000 + "é", "\r\n\r\nWARC/1.1 " * 200


@pytest.fixture
def pages(spark):
    rows = [
        (1, "http://a.org/1", BIG), (5, "http://a.org/5", BIG), (3, "http://b.org/?q=\r\nX: y", BIG), (4, None, "short"), (6, "u", "short"),
        (7, "http://c.org/é", OTHER), (8, "http://d.org", None), (9, "", ""), (10, "http://e.org", "y" * 500_000), (None, "n", "z" * 2000),
    ]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("payload", F.lit("clash"))


def test_round_trip(spark, pages):
    folder = scratch_path(spark, "warc-test")
    warc.write(warc.records(pages), folder)
    got = {r["record_id"]: r for r in warc.read(spark, folder).collect()}
    assert len(got) == 10
    for page_id, url, html, _ in pages.collect():
        r = got[f"<urn:page:{'' if page_id is None else page_id}>"]
        payload = (html or "").encode()
        assert r["payload_digest"] == hashlib.sha1(payload).hexdigest()
        assert r["payload_bytes"] == len(payload)
        if page_id in (1, 3):
            assert (r["record_type"], r["refers_to"], r["payload"]) == ("revisit", "<urn:page:5>", b"")
        else:
            assert (r["record_type"], r["refers_to"], bytes(r["payload"])) == ("response", None, payload)
        assert r["target_uri"].split() == (url or "").split()


def test_filters_reach_the_reader_and_payload_can_be_left_out(spark, pages):
    folder = scratch_path(spark, "warc-test")
    warc.write(warc.records(pages), folder)
    some = warc.read(spark, folder, payload=False).where("record_type = 'revisit'")
    assert "payload" not in some.columns
    assert sorted(r["record_id"] for r in some.collect()) == ["<urn:page:1>", "<urn:page:3>"]
    two = warc.read(spark, folder).where(F.col("record_id").isin("<urn:page:4>", "<urn:page:7>")).collect()
    assert sorted(bytes(r["payload"]).decode() for r in two) == sorted(["short", OTHER])
    reader = warc.WarcReader(folder, warc.read(spark, folder).schema)
    from pyspark.sql.datasource import EqualTo, GreaterThan

    rest = list(reader.pushFilters([EqualTo(("record_type",), "revisit"), GreaterThan(("payload_bytes",), 1)]))
    assert [type(f) for f in rest] == [GreaterThan]
    assert [r.num_rows for p in reader.partitions() for r in reader.read(p)].count(0) == 0


def member(kind, body):
    head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nContent-Length: {len(body)}\r\n\r\n"
    return gzip.compress(head.encode() + body + b"\r\n\r\n")


def test_splits_find_every_record_once_in_any_archive():
    rows = [
        {"record_type": "response", "record_id": f"<urn:page:{i}>", "refers_to": None, "target_uri": "u", "payload_digest": "0" * 40,
         "payload_bytes": 9, "payload": bytes([31, 139, 8, 4]) * (i * 37 % 900)} for i in range(60)
    ]
    own = b"".join(map(warc.render, rows))
    foreign = b"".join(member("response" if i % 3 else "warcinfo", b"ab" * (i * 50)) for i in range(60))
    for data, n in ((own, 60), (foreign, 60)):
        for step in (7, 100, 5000, len(data)):
            got = []
            for start in range(0, len(data), step):
                got += warc.read_members(io.BytesIO(data), start, min(start + step, len(data)), lambda row: (True, True))
            assert len(got) == n
            for want in ((True, False), (False, False)):
                some = list(warc.read_members(io.BytesIO(data), 0, len(data), lambda row, w=want: w))
                assert len(some) == (n if want[0] else 0)
                assert all(r["payload"] is None for r in some)


def test_unwanted_payloads_are_not_inflated(monkeypatch):
    row = {"record_type": "response", "record_id": "r", "refers_to": None, "target_uri": "u", "payload_digest": "0" * 40,
           "payload_bytes": 9, "payload": bytes(range(256)) * 8000}
    data = warc.render(row) * 3
    read = 0

    class Counting(io.BytesIO):
        def read(self, n=-1):
            nonlocal read
            out = super().read(n)
            read += len(out)
            return out

    monkeypatch.setattr(warc, "CHUNK", 1024)
    assert len(list(warc.read_members(Counting(data), 0, len(data), lambda r: (True, False)))) == 3
    assert read < len(data) / 2


@pytest.mark.parametrize(
    "condition, n",
    [
        ("refers_to IN ('<urn:page:2>', NULL)", 1),
        ("refers_to = NULL", 0),
        ("refers_to IN (NULL)", 0),
        ("refers_to <=> NULL", 3),
        ("refers_to NOT IN ('<urn:page:2>', NULL)", 0),
        ("refers_to IS NULL", 3),
        ("record_type = 'revisit' AND refers_to = '<urn:page:2>'", 1),
    ],
)
def test_nulls_in_pushed_filters(spark, condition, n):
    html = "x" * 2000
    pages = spark.createDataFrame([(1, "u", html), (2, "u", html), (3, "v", "short"), (4, "v", None)], "page_id bigint, url string, html string")
    folder = scratch_path(spark, "warc-nulls")
    warc.write(warc.records(pages), folder)
    assert warc.read(spark, folder).where(condition).count() == n


def test_empty_table(spark, pages):
    folder = scratch_path(spark, "warc-test")
    warc.write(warc.records(pages.limit(0)), folder)
    assert warc.read(spark, folder).collect() == []


def test_broken_archive_is_an_error():
    data = warc.render({"record_type": "response", "record_id": "r", "refers_to": None, "target_uri": "u", "payload_digest": "0" * 40,
                        "payload_bytes": 9, "payload": bytes(range(256)) * 20})
    with pytest.raises(ValueError):
        list(warc.read_members(io.BytesIO(data[:-40]), 0, len(data), lambda r: (True, True)))
