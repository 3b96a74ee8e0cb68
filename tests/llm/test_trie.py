"""The prefix trie against a dictionary of prefixes; slots against their definition."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from plumbline.llm import trie
from plumbline.llm.mphf import PerfectTable

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain_way(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        paths[c] = tuple(own.get(c - c % 5, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    sums = {}
    for node in sorted(members, key=len, reverse=True):
        size = len(node[-1][1].encode()) if node else 0
        below = [sums[x] for x in children[node]]
        saved = (len(members[node]) - 1) * size + sum(b[1] for b in below)
        sums[node] = (sum(b[0] for b in below) or 1, saved)
    out = []
    for node, convs in members.items():
        ends = ",".join(map(str, sorted(c for c in convs if paths[c] == node)))
        parent = min(members[node[:-1]]) if node else None
        leaves, saved = sums[node]
        digest = hashlib.sha256(ends.encode()).hexdigest()
        out.append((min(convs), len(node), parent, len(convs), len(children[node]), leaves, saved, digest))
    return sorted(out, key=repr)


def check(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = sorted((tuple(r[n] for n in NAMES) for r in trie.prefix_trie(df, **options).collect()), key=repr)
    assert got == plain_way(rows)
    return got


def some(seed, n, turns, words):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(3 * n), n):
        for t in range(rng.randint(1, turns)):
            rows.append((c, 2 * t, rng.choice("ua"), rng.choice(words)))
    return rows


@pytest.mark.parametrize("options", [{}, {"shard_entries": 3, "least_limit": 1}])
def test_like_a_dictionary_of_prefixes(spark, options):
    check(spark, some(1, 150, 12, ["a", "b", "é中"]), **options)


def test_hot_conversations_turns_and_ends(spark, monkeypatch):
    monkeypatch.setattr(trie, "BLOCK", 16)
    monkeypatch.setattr(trie, "PIECE_BYTES", 40)
    rows = some(2, 60, 4, ["x", "y"])
    rows += [(c, t, "u", f"long {t}") for c in (1000, 1005) for t in range(300)]
    rows += [(c, t, "u", f"same {t}") for c in range(2000, 2600, 5) for t in range(2)]
    check(spark, rows, least_limit=4, shard_entries=10)


def test_edge_cases(spark):
    rows = [(3, 0, "u", "a"), (8, None, None, None), (8, 0, "u", ""), (8, 1, None, "b"), (None, 0, "u", "a"), (11, 5, "u", "x" * 100_000)]
    rows += [(20, 0, "u", "twice"), (20, 0, "u", "twice"), (21, None, "u", "z"), (5, 1, "u:1", "c"), (10, 1, "u", ":1c")]
    check(spark, rows)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS k1", "'x' AS depth", "2 AS bytes", "3 AS row")
    assert trie.prefix_trie(df).count() == len(plain_way(rows))
    check(spark, [])
    check(spark, [(7, 0, "u", "only")])


def test_equal_digests_end_the_job(spark, monkeypatch):
    rows = trie.turns(spark.createDataFrame([(0, 0, "u", "a"), (5, 0, "u", "b")], SCHEMA))
    lanes = {f"t{i}": rows.t0 * 0 + i for i in trie.LANES}
    paths = rows.withColumns(lanes)
    summed = trie.summed(paths)
    plan = trie.plan_rebuilt(summed)
    clashing = trie.rebuilt(summed, plan).withColumn("t_a", trie.F.col("conv_id"))
    with pytest.raises(Exception, match="one digest"):
        trie.enumerate_nodes(clashing, plan).collect()


@pytest.mark.parametrize("n", [0, 1, 2, 100, 20_000])
def test_slots_are_minimal_and_perfect(n):
    rng = np.random.default_rng(n)
    a, b = rng.integers(0, 2**62, n), rng.integers(0, 3, n)
    table = PerfectTable(a, b)
    assert sorted(table.slots(a, b)) == list(range(n))
    assert (table.slots(a, b + 7) == -1).all() and (table.slots(a + 1, b) == -1).all()


def test_equal_keys_are_refused():
    with pytest.raises(ValueError):
        PerfectTable(np.array([1, 1]), np.array([2, 2]))
