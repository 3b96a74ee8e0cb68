"""Fill-in-middle over frames against plain cutting of whole texts."""

import hashlib
import random
import re

import pytest
from llm_helpers import docs_of

from plumbline.llm import fim, frames

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_way(doc_id, text):
    units = UNIT.findall(text)
    n = len(units)
    h = hashlib.sha256(f"42:{doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    if h4 % 100 < 80:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    letters = [*"abé中🙂", " ", "  ", "\n", "\t", "\x0b", " ", "\x85", "<P", "<", ">"]
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 60))) for _ in range(300)]
    texts += ["a <P> b", "x<M>", "<S>", "<p> <s>", "", " ", " \n ", "word", " word ", "x" * 500, "long text " * 3000]
    return list(enumerate(texts))


@pytest.mark.parametrize("size", [1, 7, 64, frames.FRAME_BYTES])
def test_like_plain_cutting(spark, rows, size):
    stored = fim.store(docs_of(spark, rows).repartition(3), frame_bytes=size)
    moved = fim.fill_in_middle(stored).cache()
    found = {r.doc_id: r for r in fim.texts(moved).collect()}
    counts = {r.doc_id: r for r in moved.drop("frames").collect()}
    digests = {r.doc_id: r for r in fim.fill_in_middle(stored, digests=True).collect()}
    assert len(found) == len(rows)
    for doc_id, text in rows:
        n, form, prefix, middle, output = plain_way(doc_id, text)
        r, c, d = found[doc_id], counts[doc_id], digests[doc_id]
        assert (r.output, r.rebuilt, r.form) == (output, text, form)
        assert (c.n, c.form, c.prefix_chars, c.middle_chars) == (n, form, prefix, middle)
        assert (d.output_sha256, d.restored_sha256) == (sha(output), sha(text))
    assert {r.form for r in found.values()} == {"plain", "psm", "spm"}


def test_only_cut_frames_are_opened(monkeypatch):
    text = ("word " * 20_000).encode()
    stored = frames.Frames.of(text, 1000)
    opened = []
    monkeypatch.setattr(frames, "decompress", lambda f, real=frames.decompress: opened.append(f) or real(f))
    output, _, _ = fim.move(stored, fim.PSM, (3333, 15_555, 0, 99))
    assert len(stored.ends) > 90 and 2 <= len(opened) <= 4
    assert b"".join(map(fim.decompress, output)).count(b"word") == 20_000


def test_frames_are_a_zstandard_file():
    import io

    import zstandard

    text = " ".join(map(str, range(30_000))).encode()
    data = frames.Frames.of(text, 999).data
    assert zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read() == text


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (None, "a b c d"), (1, None), (7, "w " * 200_000), (7, "w " * 200_000)]
    docs = docs_of(spark, rows).selectExpr("*", "1 AS n", "'x' AS form", "'y' AS _text", "2 AS data")
    got = fim.fill_in_middle(fim.store(docs, keep=("doc_id", "n", "form")), keep=("doc_id",), digests=True).collect()
    assert len(got) == 6
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert [r.form for r in by[1] + by[2]] == ["plain"] * 3 and by[2][0].restored_sha256 == sha("")
    assert by[None][0].n == 4 and by[None][0].restored_sha256 == sha("a b c d")
    assert by[7][0] == by[7][1] and by[7][0].n == 200_001
    assert fim.fill_in_middle(fim.store(docs_of(spark, [])), digests=True).collect() == []
