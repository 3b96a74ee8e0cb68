"""Exact search against brute force."""

import random

import numpy as np
import pytest

from plumbline.llm import mtree


def slow(rows, k):
    def whole(v):
        return None if not v or any(x is None or not np.isfinite(x) for x in v) else [int(np.floor(1024 * float(np.float32(x)))) for x in v]

    sound = [(i, whole(v)) for i, v in rows if i is not None and whole(v)]
    out = set()
    for q, v in {(i, tuple(v)) for i, v in sound if i % 100 == 0}:
        found = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in sound if i != q and len(w) == len(v))[:k]
        out |= {(q, rank + 1, i, -s, v) for rank, (s, i) in enumerate(found)}
    return sorted((q, rank, i, s) for q, rank, i, s, _ in out)


def run(spark, rows, k=10):
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    return sorted(map(tuple, mtree.top_k(df, df.where("vec_id % 100 = 0"), k).collect()))


@pytest.mark.parametrize("page", [8192, 150])
def test_against_brute_force(spark, monkeypatch, page):
    """Also over many small pages; with a vector that a third of all rows share, and ties."""
    monkeypatch.setattr(mtree, "PAGE", page)
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 1, (7, 12))
    rows = []
    for i in range(1200):
        v = centres[i % 7] + rng.normal(0, 0.05 if i % 2 else 1, 12)
        v = centres[0] if i % 3 == 0 else np.round(v, 1) if i % 5 == 0 else v
        rows.append((i, [float(np.float32(x)) for x in v], 0))
    assert run(spark, rows) == slow([r[:2] for r in rows], 10)


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 2.0], 0), (100, [1.0, 2.0], 0), (1, [0.5, -3.0], 0), (2, None, 0), (3, [1.0, None], 0), (4, [nan, 1.0], 0),
        (5, [inf, 1.0], 0), (6, [], 0), (None, [9.0, 9.0], 0), (7, [1.0, 2.0, 3.0], 0), (200, [1.0, 1.0, 1.0], 0), (300, None, 0),
        (8, [0.0, 0.0], 0), (8, [0.0, 0.0], 0), (400, [-0.00001, 0.3], 0), (400, [-0.00001, 0.3], 0),
    ]
    assert run(spark, rows) == slow([r[:2] for r in rows], 10)
    assert run(spark, []) == []
    assert run(spark, [(0, [1.0], 0)]) == []


def test_pruning_leaves_out_what_is_far():
    """Few members are compared when groups lie apart."""
    rng = random.Random(2)
    centres = [[rng.randrange(-9000, 9000) for _ in range(8)] for _ in range(40)]
    x = np.array([[c + rng.randrange(-20, 20) for c in centres[i % 40]] for i in range(4000)])
    ids = np.arange(4000)
    largest = float(np.sqrt((x.astype(float) ** 2).sum(1).max()))
    page = mtree.build_page(ids, x, largest)
    compared = 0
    dot = mtree._dot

    def counting(a, b):
        nonlocal compared
        compared += len(a)
        return dot(a, b)

    mtree._dot = counting
    try:
        q = x[:20]
        found = list(mtree.search_page(page, q, ids[:20], np.full(20, np.nan), 5))
    finally:
        mtree._dot = dot
    assert compared < 0.5 * 20 * 4000
    scores = q @ x.T
    for i, vec, s in zip(*(np.concatenate(c) for c in zip(*found))):
        assert scores[i, vec] == s
        assert (np.delete(scores[i], i) > s).sum() < 5
