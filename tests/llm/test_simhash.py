"""SimHash groups against brute force."""

import random

import numpy as np
import pytest
from llm_helpers import docs_of
from xxhash import xxh64_intdigest

from plumbline.llm import simhash
from plumbline.llm.graph import components
from plumbline.llm.queries import QUERIES


def slow_fingerprint(text):
    words = [w for w in "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_groups(prints):
    """{doc_id: component} from {doc_id: fingerprint}, over all pairs."""
    ids = sorted(prints)
    fp = np.array([prints[i] for i in ids], np.uint64)
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(fp[i + 1 :] ^ fp[i]) <= 4):
            a, b = find(i), find(int(j) + i + 1)
            root[max(a, b)] = min(a, b)
    return {ids[i]: ids[find(i)] for i in range(len(ids))}


def test_query_against_brute_force(spark, read):
    texts = dict(read("documents").select("doc_id", "text").collect())
    prints = {i: slow_fingerprint(t) for i, t in texts.items()}
    wanted = slow_groups(prints)
    got = QUERIES["op6_simhash"](spark, read.sf_dir).collect()
    assert {r["doc_id"]: r["fingerprint"] for r in got} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {r["doc_id"]: r["component_id"] for r in got} == wanted
    assert len(set(wanted.values())) < len(wanted)


def test_every_mask_family_covers():
    rng = random.Random(1)
    masks = [m & (1 << 64) - 1 for m in simhash.masks(list(range(64)))]
    assert len(masks) == 31
    for _ in range(2000):
        apart = sum(1 << p for p in rng.sample(range(64), 4))
        assert any(not apart & m for m in masks)
        for m in masks[::7]:
            rest = [p for p in range(64) if not m >> p & 1]
            apart = sum(1 << p for p in rng.sample(rest, 4))
            assert any(not apart & (x & (1 << 64) - 1) for x in simhash.masks(rest))


@pytest.mark.parametrize("large", [256, 4])
def test_links_of_dense_and_sparse_fingerprints(spark, monkeypatch, large):
    """Balls of close fingerprints, chains and loners; also with buckets that are divided."""
    monkeypatch.setattr(simhash, "LARGE", large)
    rng = random.Random(2)
    prints = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        weak = rng.sample(range(64), 9)
        prints |= {centre ^ sum(1 << b for b in weak if rng.random() < 0.4) for _ in range(150)}
        prints.add(centre)
        for _ in range(12):
            centre ^= sum(1 << b for b in rng.sample(range(64), 4))
            prints.add(centre)
    prints |= {rng.getrandbits(64) for _ in range(300)}
    signed = {p - (1 << 64) if p >> 63 else p for p in prints}
    df = spark.createDataFrame([(p,) for p in signed], "fp bigint")
    root = {r["node"]: r["root"] for r in components(simhash.link(df)).collect()}
    mine = {}
    for p in signed:
        mine.setdefault(root.get(p, p), set()).add(p)
    wanted = {}
    for p, c in slow_groups({p: p & (1 << 64) - 1 for p in signed}).items():
        wanted.setdefault(c, set()).add(p)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, wanted.values()))


def test_edge_cases(spark):
    assert simhash.near_duplicates(docs_of(spark, [])).count() == 0
    words = " ".join(f"w{i}" for i in range(400))
    rows = [(1, None), (2, ""), (3, " \n"), (4, words), (4, words), (None, words), (5, "short text"), (6, "SHORT\ttext"), (7, "x" * 300_000)]
    got = sorted(map(tuple, simhash.near_duplicates(docs_of(spark, rows)).select("doc_id", "component_id").collect()), key=str)
    assert got == sorted([(1, 1), (2, 1), (3, 1), (4, 4), (4, 4), (None, 4), (5, 5), (6, 5), (7, 7)], key=str)
    kept = simhash.drop_near_duplicates(docs_of(spark, rows))
    assert kept.columns == docs_of(spark, rows).columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 4, 5, 7]


def test_clashing_columns(spark):
    df = docs_of(spark, [(1, "a b c d e"), (2, "a b c d e")]).selectExpr("*", "1 AS fp", "2 AS root", "3 AS component_id", "4 AS _kept")
    assert [r["doc_id"] for r in simhash.drop_near_duplicates(df).collect()] == [1]
    assert simhash.drop_near_duplicates(df).columns == df.columns
    assert simhash.near_duplicates(df).columns == ["doc_id", "fp", "component_id"]


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {100 + i: 100 for i in range(1, 40)} | {201: 200}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
