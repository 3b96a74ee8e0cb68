"""Packing against the tokenizer's library and plain sequences; the curve against its definition."""

import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from llm_helpers import docs_of
from tokenizers import Tokenizer

from plumbline.llm import distinct, packing, word_ids
from plumbline.llm.hilbert import hilbert_key
from plumbline.llm.queries import QUERIES

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    return tokenizer


@pytest.mark.parametrize("dims, bits", [(1, 5), (2, 1), (2, 5), (3, 3), (4, 3), (5, 2)])
def test_curve_steps_to_a_neighbour_each_time(dims, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    keys = hilbert_key(cells, bits)
    assert sorted(keys) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


@pytest.fixture(scope="module")
def words():
    with open(PATH, encoding="utf-8") as file:
        return word_ids.WordIds(file.read())


def test_words_between_blanks_give_the_ids_of_the_text(library, words):
    rng = random.Random(3)
    assert words.by_pieces
    letters = [*"abcdeé ĳß", "<|endoftext|>", "<|", *"'sΣσςİ́ \n\t\x0b\x0c\r12½中文字🙂!?#", " ", "\x85", " ", "가", "ᆨ"]
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 80))) for _ in range(4000)]
    texts += [None, "", " ", " \n\t a \x0b", "\x1c\x1d a\x1eb"]
    found = words.encode(pa.array([t if t is None else t.encode() for t in texts], pa.binary()))
    for i, text in enumerate(t or "" for t in texts):
        assert found.of(i).tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_letters_tails_and_forgetting(library, words, monkeypatch):
    monkeypatch.setattr(distinct, "REMEMBERED", 200)
    rng = random.Random(4)
    letters = [*"abcdefgXYZéßÀªµº", "İ", "ı", "'", "'s", "<|", "|>", "1", "ﬁ", "\x85", "\xa0", *distinct.TAIL]
    texts = [" ".join("".join(rng.choices(letters, k=rng.randint(1, 9))) for _ in range(30)) for _ in range(200)]
    for start in range(0, 200, 20):
        part = texts[start : start + 20]
        found = words.encode(pa.array(part))
        for i, text in enumerate(part):
            assert found.of(i).tolist() == library.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("total", [0, 1, 5, 4095, 4096, 4097, 3 * 4096 + 2048, 10_007])
def test_sequences_leave_nothing_to_pad(total):
    found = packing.Sequences(total, 4096)
    sizes = Counter()
    for _, size, number, offset in found.pieces(0, total):
        assert offset == sizes[number]
        sizes[number] += size
    assert sum(sizes.values()) == total and sorted(sizes) == list(range(len(sizes)))
    assert all(n == 4096 or n & (n - 1) == 0 for n in sizes.values())


def whole(pieces, expected, length):
    """Every id in exactly one piece, sequences without gaps, no padding but at powers of two."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in pieces:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(expected)
    for doc_id, ids in expected.items():
        at = 0
        for r in sorted(by_doc[doc_id], key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            piece = ids[at : at + r.length]
            assert (r.ids_crc32 if "ids_crc32" in r else r.ids) == (
                zlib.crc32(np.array(piece, "<u4").tobytes()) if "ids_crc32" in r else piece
            )
            at += r.length
        assert at == len(ids)
    for rows in by_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == length or at < length and at & (at - 1) == 0


def test_query(spark, read, library):
    texts = dict(read("documents").select("doc_id", "text").collect())
    expected = {d: [*library.encode(t or "", add_special_tokens=False).ids, 2] for d, t in texts.items()}
    whole(QUERIES["op13_packing"](spark, read.sf_dir).collect(), expected, 4096)


def test_neighbours_share_sequences(spark):
    rng = random.Random(8)
    topics = [[f"{t}{w}" for w in ("apple", "stone", "river", "cloud", "green", "seven")] for t in "bdfgk"]
    docs = [(i, " ".join(rng.choices(topics[i % 5], k=40))) for i in range(400)]
    rows = packing.pack(docs_of(spark, docs), PATH, length=512).collect()
    topics_of = defaultdict(set)
    for r in rows:
        topics_of[r.sequence_id].add(r.doc_id % 5)
    assert np.mean([len(t) for t in topics_of.values()]) < 2


def test_edge_cases(spark, library):
    texts = [None, "", " \n", "word " * 30_000, *["the same copy of a text"] * 300, "İ<|endoftext|> x", "one"]
    docs = docs_of(spark, list(enumerate(texts))).selectExpr("*", "1 AS ids", "'x' AS key", "2 AS n", "3 AS part").repartition(5)
    rows = packing.pack(docs, PATH, length=256).collect()
    expected = {i: [*library.encode(t or "", add_special_tokens=False).ids, 2] for i, t in enumerate(texts)}
    whole(rows, expected, 256)
    assert {r.doc_tokens for r in rows if r.doc_id < 3} == {1}
    kept = packing.pack(docs, PATH, keep=("doc_id", "key", "ids"), digests=True).where("doc_id = 0").collect()
    assert [(r.key, r.ids, r.start, r.length) for r in kept] == [("x", 1, 0, 1)]
    repeated = packing.pack(docs_of(spark, [(None, "a b"), (None, "a b"), (1, "c")]), PATH).collect()
    assert sorted(r.doc_tokens for r in repeated) == [2, 3, 3]
    assert packing.pack(docs_of(spark, []), PATH).collect() == []


def test_malformed_bytes_are_replaced(library, words):
    found = words.encode(pa.array([b"a \xff\xfe b\xe9", b"fine"], pa.binary()))
    assert found.of(0).tolist() == library.encode("a \ufffd\ufffd b\ufffd", add_special_tokens=False).ids
