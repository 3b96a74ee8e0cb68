"""The tokenizer against the library that the vocabulary belongs to."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from llm_helpers import docs_of
from tokenizers import Tokenizer

from plumbline.llm import bpe
from plumbline.llm.queries import QUERIES

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    return tokenizer


@pytest.fixture(scope="module")
def mine():
    with open(PATH, encoding="utf-8") as file:
        return bpe.WordBpe(file.read())


def check(library, mine, texts):
    ranks = bpe.RankIds(mine)
    found = ranks.encode(pa.array(texts))
    assert ranks.by_pieces
    for i, (text, theirs, decoded) in enumerate(zip(texts, library.encode_batch(texts, add_special_tokens=False), found.decoded(mine.tokens))):
        assert found.of(i).tolist() == theirs.ids, text[:80]
        assert decoded == library.decode(theirs.ids, skip_special_tokens=False)
    for text, theirs, ids in zip(texts, library.encode_batch(texts, add_special_tokens=False), mine.encode_batch(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == theirs.ids, text[:80]
        assert mine.decode(ids) == library.decode(theirs.ids, skip_special_tokens=False)


def test_every_character(library, mine):
    check(library, mine, [f"a{chr(c)}b {chr(c)}" for c in range(0x33500) if not 0xD800 <= c < 0xE000])


def test_random_and_odd_texts(library, mine):
    rng = random.Random(1)
    letters = [*"abcdeé ĳß", "<|endoftext|>", "<|", *"'sΣσςİ́ \n\t12½中文字🙂!?#"]
    check(library, mine, ["".join(rng.choices(letters, k=rng.randint(0, 80))) for _ in range(5000)])
    odd = ["", " ", "a<|endoftext|>b<|startoftext|>", "<|endoftext|><|endoftext|>", "x" * 70_000, "ab" * 40, "the" * 500]
    check(library, mine, [*odd, "Σ ΑΣ. ΑΣ", "é<|endoftext|>́", "it's we'll THEY'RE"])


def test_words_are_merged_alike_when_forgotten(library, mine, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 50)
    rng = random.Random(2)
    check(library, mine, [" ".join("".join(rng.choices("abcdefgh", k=rng.randint(1, 90))) for _ in range(60)) for _ in range(20)])


def test_query(spark, read, library):
    rows = read("documents").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in QUERIES["op2_bpe"](spark, read.sf_dir).collect()}
    assert len(got) == len(rows)
    for doc_id, text in rows:
        ids = library.encode(text, add_special_tokens=False).ids
        r = got[doc_id]
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        decoded = library.decode(ids, skip_special_tokens=False)
        assert r["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (None, "a b"), (1, None), (3, "word " * 50_000)]
    docs = docs_of(spark, rows).selectExpr("*", "1 AS ids", "'x' AS _text")
    got = bpe.encode(docs, PATH).collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in got) == [(0, 2), (1, 0), (1, 0), (2, 0), (3, 50_000)]
    assert bpe.encode(docs_of(spark, []), PATH).collect() == []
