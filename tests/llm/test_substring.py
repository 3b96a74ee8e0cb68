"""Repeated passages against brute force, and the index against plain search."""

import hashlib
import random

import numpy as np
import pytest
from llm_helpers import docs_of

from plumbline.llm import substring
from plumbline.llm.fmindex import FMIndex


def slow(rows, window=20):
    """{(doc_id, text): (n_words, kept words)} by comparing all windows."""
    first = {}
    split = [(LAST if i is None else i, i, t, (t or "").encode().split()) for i, t in rows]
    for order, _, _, words in split:
        for p in range(len(words) - window + 1):
            key = tuple(words[p : p + window])
            first[key] = min(first.get(key, (order, p)), (order, p))
    out = []
    for order, i, _, words in split:
        gone = [False] * len(words)
        for p in range(len(words) - window + 1):
            if first[tuple(words[p : p + window])] < (order, p):
                gone[p : p + window] = [True] * window
        kept = b" ".join(w for w, g in zip(words, gone) if not g)
        out.append((i, len(words), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


LAST = substring.LAST


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["the", "of", "a"]) if rng.random() < 0.3 else f"w{rng.randrange(3000)}é"
    passages = [[word() for _ in range(rng.randint(15, 70))] for _ in range(8)]
    rows = []
    for i in range(120):
        parts = []
        for _ in range(rng.randint(1, 6)):
            parts += rng.choice(passages) if rng.random() < 0.4 else [word() for _ in range(rng.randint(1, 40))]
        rows.append((rng.randrange(100_000), rng.choice([" ", "\n", "  \t"]).join(parts)))
    rows += [(200_000 + i, rows[i % 3][1]) for i in range(30)]
    rows += [(7, "und " * 500), (8, "a b " * 40), (9, None), (10, ""), (11, " \n "), (12, "word " * 19)]
    # Rows that share an id, equal and not, and rows without one.
    rows += [(3, rows[0][1]), (3, rows[0][1]), (3, rows[1][1]), (None, rows[2][1]), (None, rows[2][1]), (None, rows[4][1])]
    return rows


@pytest.mark.parametrize(("seed", "run", "sample"), [(1, 2048, 64), (2, 3, 64), (3, 4, 1)])
def test_against_brute_force(spark, monkeypatch, seed, run, sample):
    """Also with anchors that are dealt window by window, found on the way or in the sample."""
    monkeypatch.setattr(substring, "RUN", run)
    monkeypatch.setattr(substring, "SAMPLE_ONE_IN", sample)
    monkeypatch.setattr(substring, "HOT_LEAST", 5)
    rows = corpus(seed)
    got = sorted(map(tuple, substring.removal_digests(docs_of(spark, rows)).collect()), key=str)
    assert got == slow(rows)
    assert any(r[2] for r in got)


def test_spans_and_documents(spark):
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(1, f"one {passage} two"), (2, f"three\n{passage} four"), (3, passage), (4, "clean  text\nas it is"), (5, None)]
    docs = docs_of(spark, rows).selectExpr("*", "7 AS rk", "8 AS late", "9 AS n_words", "10 AS row", "11 AS kept")
    spans = {r["doc_id"]: r["spans"] for r in substring.removed_spans(docs).collect()}
    assert spans == {1: [], 2: [[1, 31]], 3: [[0, 30]], 4: [], 5: []}
    kept = substring.remove_repeats(docs)
    assert kept.columns == docs.columns
    texts = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert texts == {1: f"one {passage} two", 2: "three four", 4: "clean  text\nas it is", 5: None}


def test_empty_table(spark):
    assert substring.removal_digests(docs_of(spark, [])).collect() == []
    assert substring.remove_repeats(docs_of(spark, [])).collect() == []


def test_very_long_text(spark):
    rng = random.Random(4)
    text = " ".join(f"x{rng.randrange(10**6)}" for _ in range(120_000))
    rows = [(1, text), (2, text[1000:]), (3, "z" * 400_000)]
    got = sorted(map(tuple, substring.removal_digests(docs_of(spark, rows)).collect()))
    assert got == slow(rows)


def test_matching_statistics():
    rng = random.Random(3)
    for _ in range(60):
        sigma, depth = rng.choice([1, 2, 3, 50]), rng.choice([1, 3, 5])
        make = lambda top: [rng.randint(1, top) for _ in range(rng.randint(1, 12))]
        held = [make(sigma) for _ in range(rng.randint(1, 12))]
        asked = [make(sigma + 1) for _ in range(10)] + held
        index = FMIndex(np.concatenate(held), np.array([len(s) for s in held]), depth)
        length, low = index.matches(np.concatenate(asked), np.array([len(s) for s in asked]))
        text = [x for s in held for x in [*s, 0]]
        grams = {tuple(s[a : a + n]) for s in held for a in range(len(s)) for n in range(1, depth + 1)}
        at = 0
        for s in asked:
            for j in range(len(s)):
                best = max([n for n in range(1, depth + 1) if j + n <= len(s) and tuple(s[j : j + n]) in grams], default=0)
                assert length[at] == best
                if best == depth:
                    place = index.order[low[at]]
                    assert text[place : place + depth] == s[j : j + depth]
                at += 1
