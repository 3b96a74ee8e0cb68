"""Shares, quotas and pieces of the mix."""

import random
from fractions import Fraction

import pytest
from llm_helpers import docs_of
from pyspark.sql import functions as F

from plumbline.llm import mixing


def slow_quotas(votes, seats):
    """Highest quotients one by one."""
    won = [0] * len(votes)
    for _ in range(seats if sum(votes) else 0):
        best = max(range(len(votes)), key=lambda i: (Fraction(votes[i]) / (2 * won[i] + 1), -i))
        won[best] += 1
    return won


@pytest.mark.parametrize("seed", range(4))
def test_apportionment_against_one_seat_at_a_time(spark, seed):
    rng = random.Random(seed)
    groups = {g: [rng.choice([0, 1, rng.randrange(10**6)]) for _ in range(rng.randint(1, 12))] for g in ("a", "b", None)}
    seats = {"a": rng.randrange(300), "b": 0, None: rng.randrange(40)}
    rows = [(g, i, v) for g, votes in groups.items() for i, v in enumerate(votes)]
    df = spark.createDataFrame(rows, "g string, i int, v bigint")
    seat = F.when(F.col("g") == "a", seats["a"]).when(F.col("g") == "b", 0).otherwise(seats[None])
    got = {(r["g"], r["i"]): r["quota"] for r in mixing.apportion(df, ["g"], ["i"], "v", seat).collect()}
    assert got == {(g, i): q for g, votes in groups.items() for i, q in enumerate(slow_quotas(votes, seats[g]))}


def slow_targets(sizes):
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, (s or "").encode())))}
    capped, total = set(), sum(sizes.values())
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        open_ = sum(w for s, w in weights.items() if s not in capped)
        targets = {s: 3 * sizes[s] if s in capped else left * w / open_ for s, w in weights.items()}
        more = {s for s in weights if s not in capped and targets[s] > 3 * sizes[s]}
        if not more:
            return targets
        capped |= more


def corpus(seed):
    rng = random.Random(seed)
    names = ["a", "b", "Z", "é", None, "tiny", "none", "src𝕏"]
    rows = []
    for i in range(300):
        source = rng.choice(names[:5]) if i > 4 else names[i % 3 + 5]
        n = 0 if source == "none" else 3 if source == "tiny" else rng.choice([0, 5, 40, 400])
        rows.append((i, " ".join(["w"] * n) if n or i % 2 else None, "en", source))
    return [*rows, (5000, "w " * 30_000, "en", "b"), (7, "w w", "en", "a"), (7, "w w", "en", "a"), (None, "w w w", "en", "a")]


@pytest.mark.parametrize("shard_tokens", [1 << 20, 500])
def test_targets_and_taken(spark, monkeypatch, shard_tokens):
    monkeypatch.setattr(mixing, "SHARD_TOKENS", shard_tokens)
    rows = corpus(1)
    size = lambda t: len((t or "").split())
    sizes = {}
    for _, text, _, source in rows:
        sizes[source] = sizes.get(source, 0) + size(text)
    wanted = slow_targets(sizes)
    docs = docs_of(spark, rows)
    got = mixing.mix(docs).collect()
    assert sorted(r["size"] for r in got) == sorted(size(r[1]) for r in rows)
    source_of = {(r[0], size(r[1])): r[3] for r in rows}
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        source = source_of[r["doc_id"], r["size"]]
        assert r["source_size"] == sizes[source]
        assert r["target"] == pytest.approx(wanted[source], abs=1e-6)
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[source] += r["taken"]
    shards = 1 + sum(sizes.values()) // shard_tokens
    for source, n in taken.items():
        assert abs(n - wanted[source]) <= shards + 1, source
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)
    # The mixed documents hold just the words that were taken.
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    held = {}
    for r in mixed.collect():
        held[r["doc_id"]] = held.get(r["doc_id"], 0) + size(r["text"])
    by_id = {}
    for r in got:
        by_id[r["doc_id"]] = by_id.get(r["doc_id"], 0) + r["taken"]
    assert held == {i: n for i, n in by_id.items() if n}


def test_a_source_with_shards_smaller_than_a_block_gives_its_target(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_TOKENS", 1000)
    rng = random.Random(8)
    name = lambda i: "big" if i % 50 else "small" if i else "speck"
    rows = [(i, " ".join(["w"] * rng.randint(10, 60)), "en", name(i)) for i in range(3000)]
    sizes = {}
    for _, text, _, source in rows:
        sizes[source] = sizes.get(source, 0) + len(text.split())
    wanted, source_of = slow_targets(sizes), {r[0]: r[3] for r in rows}
    assert wanted["small"] == 3 * sizes["small"]
    for blocks in (20, 200, 100_000):
        taken = dict.fromkeys(sizes, 0)
        for r in mixing.mix(docs_of(spark, rows), blocks=blocks).collect():
            assert 0 <= r["taken"] <= 3 * r["size"]
            taken[source_of[r["doc_id"]]] += r["taken"]
        block = max(1, sum(sizes.values()) // blocks)
        assert all(abs(taken[s] - wanted[s]) <= 2 * block for s in sizes), (blocks, taken, wanted)
        assert taken["small"] == wanted["small"]


def test_what_a_shard_cannot_give_goes_to_the_others(spark):
    rows = [("a", s, n, 600, 900.0, 9) for s, n in enumerate([550, 0, 20, 30])] + [(None, 7, 5, 5, 15.0, 0)]
    lines = spark.createDataFrame(rows, "_source string, _shard bigint, _line bigint, source_size bigint, target double, _blocks bigint")
    given = {(r["_source"], r["_shard"]): r["_give"] for r in mixing.deal(lines, 100, 3).collect()}
    assert given[None, 7] == 15 and given["a", 1] == 0
    assert sum(n for (s, _), n in given.items() if s) == 900
    assert all(given[s, i] <= 3 * n for s, i, n, *_ in rows)


def test_whole_documents_keep_their_text(spark):
    rows = [(i, f"a{i}  b\nc", "en", "only") for i in range(20)]
    got = [r["text"] for r in mixing.mix_documents(docs_of(spark, rows)).collect()]
    assert sorted(got) == sorted(r[1] for r in rows)


def test_parts_are_the_words_of_their_place(spark):
    rows = [(i, " ".join(f"d{i}w{k}" for k in range(50)), "en", "big" if i else "little") for i in range(9)]
    planned = {r["doc_id"]: r for r in mixing.mix(docs_of(spark, rows)).collect()}
    texts = {}
    for r in mixing.mix_documents(docs_of(spark, rows)).collect():
        texts.setdefault(r["doc_id"], []).append(r["text"].split())
    for i, text, *_ in rows:
        p, words = planned[i], text.split()
        whole = [words] * p["turns"]
        part = words[p["then_from"] : p["then_to"]] + words[p["first_from"] : p["first_to"]]
        assert sorted(texts.get(i, [])) == sorted(whole + ([part] if part else []))


def test_empty_tables_and_clashing_columns(spark):
    assert mixing.mix(docs_of(spark, [])).collect() == []
    assert mixing.mix(docs_of(spark, [(1, None), (2, " ")])).select("taken", "target").distinct().collect() == [(0, 0.0)]
    docs = docs_of(spark, [(1, "a b c")]).selectExpr("*", "1 AS size", "2 AS row", "3 AS _text", "4 AS turns", "5 AS _line")
    assert mixing.mix_documents(docs).collect() == docs.collect()
