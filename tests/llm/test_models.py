"""Language, quality and rule models: held-out results, brute force, constraints."""

import math
import random
import re
import zlib

import numpy as np
import pytest
from llm_helpers import docs_of
from pyspark.sql import functions as F

from plumbline.llm import boosting, langid, pulearn, samples, stats
from plumbline.llm.queries import QUERIES
from plumbline.llm.text import WordHashes

WORDS = {"aa": ["lo", "mira", "sol", "ñandú", "que"], "bb": ["der", "und", "straße", "ich", "auf"], "cc": ["the", "of", "with", "ing", "thorn"]}


def texts(lang, n, seed):
    rng = random.Random(seed)
    return [" ".join(rng.choices(WORDS[lang], k=rng.randint(3, 60))).capitalize() for _ in range(n)]


def slow_code_length(training, text, model):
    """PPM with escapes by the definition: contexts of 2, 1, 0 bytes, then equal likelihood."""
    symbol = lambda data: [0, 0, *(int(model.classes[b]) for b in data)]
    follow = {}
    for t in training:
        s = symbol(t)
        for i in range(2, len(s)):
            for order in range(3):
                seen = follow.setdefault(tuple(s[i - order : i]) if order else (), {})
                seen[s[i]] = seen.get(s[i], 0) + 1
    classes = langid.CLASSES

    def probability(context, c):
        if context is None:
            return 1 / classes
        shorter = None if not context else context[1:]
        seen = follow.get(context)
        if seen is None:
            return probability(shorter, c)
        total = sum(seen.values())
        rest = [x for x in range(classes) if x not in seen]
        if not rest:
            return seen[c] / total
        if c in seen:
            return seen[c] / (total + len(seen))
        return len(seen) / (total + len(seen)) * probability(shorter, c) / sum(probability(shorter, x) for x in rest)

    s = symbol(text)
    bits = sum(-math.log2(probability((s[i - 2], s[i - 1]), s[i])) for i in range(2, len(s)))
    return bits + sum(x == classes - 1 for x in s[2:]) * math.log2(model.rare)


def test_code_lengths_are_exact(spark, monkeypatch):
    monkeypatch.setattr(langid, "CLASSES", 24)
    train = {lang: texts(lang, 12, 1) for lang in WORDS}
    rows = [(i, t, lang) for i, (lang, t) in enumerate((lang, t) for lang in WORDS for t in train[lang])]
    model = langid.train(docs_of(spark, [(*r, "s") for r in rows]), F.lit(True))
    assert model.languages == sorted(WORDS)
    for text in ["sol und the", "zzz \u4e2d ??", "a", "Straße mit ñ"]:
        bits = model.code_lengths(text.encode())
        for lang, b in zip(model.languages, bits):
            assert b == pytest.approx(slow_code_length([t.encode() for t in train[lang]], text.encode(), model), rel=1e-4)


def test_language_of_held_out_documents(spark, read):
    rows = QUERIES["op7_langid"](spark, read.sf_dir).collect()
    true = dict(read("documents").select("doc_id", "lang").collect())
    assert len(rows) == len(true)
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert sum(r["lang_pred"] == true[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_edge_cases(spark):
    rows = [(i, t, lang, "s") for i, (lang, t) in enumerate((lang, t) for lang in WORDS for t in texts(lang, 20, 2))]
    odd = [(900, None, "aa", "s"), (901, "", "aa", "s"), (902, "12 !? 34", None, "s"), (None, "the of with", None, "s"), (904, "中", "aa", "s"), (905, "the of with " * 40_000, None, "s")]
    docs = docs_of(spark, rows + odd + odd[-1:]).selectExpr("*", "1 AS score", "2 AS _text")
    model = langid.train(docs, F.lit(True))
    got = {r["doc_id"]: r for r in langid.identify(docs, model, ["doc_id"]).collect()}
    assert [got[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3
    assert got[None]["lang_pred"] == got[905]["lang_pred"] == "cc"
    assert got[904]["lang_pred"] in WORDS
    assert langid.train(docs_of(spark, []), F.lit(True)) is None
    assert {r["lang_pred"] for r in langid.identify(docs, None, ["doc_id"]).collect()} == {"und"}
    assert langid.identify(docs_of(spark, []), model, ["doc_id"]).collect() == []


def test_every_language_is_learned(spark):
    rng = random.Random(4)
    words = {f"l{k:02}": ["".join(rng.choices("abcdefghijklmnop", k=7)) for _ in range(5)] for k in range(90)}
    rows = [(3 * k + i, " ".join(rng.choices(w, k=30)), lang, "s") for k, (lang, w) in enumerate(words.items()) for i in range(3)]
    docs = docs_of(spark, rows)
    model = langid.train(docs, F.col("doc_id") % 3 != 0)
    assert model.languages == sorted(words)
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs, model, ["doc_id"]).collect()}
    assert got == {r[0]: r[2] for r in rows}


def test_quality_of_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    rows = {r["doc_id"]: r for r in QUERIES["op8_quality"](spark, folder).collect()}
    labels = spark.read.parquet(f"{folder}/labels.parquet").collect()
    held = [(rows[x["doc_id"]], x["quality"]) for x in labels if rows[x["doc_id"]]["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in rows.items())
    assert sum(r["predicted"] == q for r, q in held) >= 0.95 * len(held)
    assert all(r["predicted"] == (r["score"] >= 0.7) for r in rows.values())


def test_labels_of_the_held_out_fold_are_never_used(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices(["the", "of", "a", "cat"], k=40)) if i % 3 else "### " * 30, "en", "s") for i in range(200)]
    docs, group = docs_of(spark, rows), samples.remainder(F.col("doc_id"), 4)
    score = {}
    for flip in (0, 1):
        marks = [(i, (1 if i % 3 else 0) ^ (flip if zlib.crc32(str(i).encode()) % 4 == 2 else 0)) for i in range(200)]
        labels = spark.createDataFrame(marks, "doc_id bigint, quality int")
        score[flip] = sorted(map(tuple, pulearn.score(docs, pulearn.train(docs, labels, group != 2), ["doc_id"]).collect()))
    assert score[0] == score[1]
    assert all((s > 0.7) == bool(i % 3) for i, s in score[0])


def test_quality_edge_cases(spark):
    rows = [(1, None, "en", "s"), (2, "", "en", "s"), (None, "a b", "en", "s"), (1, None, "en", "s"), (3, "word " * 60_000, "en", "s")]
    docs = docs_of(spark, rows).selectExpr("*", "1 AS score", "2 AS label", "3 AS _label", "4 AS quality")
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert pulearn.train(docs, none, F.lit(True)) is None
    assert {r["score"] for r in pulearn.score(docs, None, ["doc_id"]).collect()} == {0.5}
    labels = spark.createDataFrame([(1, 1), (3, None), (None, 1), (2, 0), (1, 0), (77, 1)], "doc_id bigint, quality int")
    model = pulearn.train(docs, labels, F.lit(True))
    got = pulearn.score(docs, model, ["doc_id"]).collect()
    assert len(got) == 5 and all(0 <= r["score"] <= 1 for r in got)
    assert pulearn.score(docs_of(spark, []), model, ["doc_id"]).collect() == []
    assert boosting.train(docs, none) is None
    kept = boosting.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert boosting.judge(docs_of(spark, []), None, ["doc_id"]).collect() == []


def test_risk_stays_non_negative_and_finds_the_classes():
    rng = np.random.default_rng(3)
    good, bad = rng.normal(1, 0.5, (2000, 12)), rng.normal(-1, 0.5, (800, 12))
    model = pulearn.fit(good[:500], np.concatenate([good[500:], bad]), 0.65)
    model = pulearn.calibrate(model, np.concatenate([good[:200], bad[:100]]), np.r_[np.ones(200), np.zeros(100)])
    assert (model.score(good) > 0.7).mean() > 0.98
    assert (model.score(bad) < 0.3).mean() > 0.98


def slow_risk(weights, xp, xu, prior):
    """The non-negative risk, document by document."""
    w1, b1, w2, b2 = weights

    def mean_loss(rows, toward):
        total = 0.0
        for x in rows:
            z = sum(math.tanh(sum(a * w for a, w in zip(x, w1[:, k])) + b1[k]) * w2[k] for k in range(len(w2))) + b2[0]
            total += 1 / (1 + math.exp(toward * z))
        return total / len(rows)

    below = mean_loss(xu, -1) - prior * mean_loss(xp, -1)
    return prior * mean_loss(xp, 1) + max(0.0, below), below


def test_risk_and_gradient_by_definition():
    rng = np.random.default_rng(11)
    xp, xu = rng.normal(0.3, 1, (40, 3)), rng.normal(-0.3, 1, (90, 3))
    weights = [w + 0.1 for w in pulearn.start(3, 5)]
    lowest = min(xp.tolist(), key=lambda x: slow_risk(weights, [x], [x], 0.0)[1])
    signs = set()
    for u, prior in ((xu, 0.2), (xu, 0.9), (np.array([lowest]), 0.99)):
        grads, risk = pulearn.risk_gradient(weights, xp, u, prior)
        slow, below = slow_risk(weights, xp, u, prior)
        signs.add(below >= 0)
        assert risk == pytest.approx(slow, abs=1e-12)
        for i, g in enumerate(grads):
            for at in list(np.ndindex(g.shape))[::5]:
                moved = [w.copy() for w in weights]
                moved[i][at] += 1e-6
                now = slow_risk(moved, xp, u, prior)
                # Below zero the negative part is driven up.
                slope = (now[0] - slow) / 1e-6 if below >= 0 else -(now[1] - below) / 1e-6
                assert g[at] == pytest.approx(slope, abs=1e-5)
    assert signs == {True, False}


def test_every_allowed_document_takes_part(spark, monkeypatch):
    """Mean, scale and weights as from all documents at hand, and many tasks agree on the classes."""
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choices(["the", "of", "a", "cat"], k=rng.randint(20, 60))) if i % 3 else "### " * rng.randint(5, 40), "en", "s") for i in range(600)]
    docs = docs_of(spark, rows).repartition(4)
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(0, 600, 7)], "doc_id bigint, quality int")
    model = pulearn.train(docs, labels, F.col("doc_id") != 5)
    hashes = WordHashes()
    x = np.array([stats.counts(t.encode(), hashes)[1] for i, t, *_ in rows if i != 5])
    good = np.array([stats.counts(rows[i][1].encode(), hashes)[1] for i in range(0, 600, 7) if i % 3])
    assert model.mean == pytest.approx(x.mean(0), rel=1e-8, abs=1e-12) and model.scale == pytest.approx(x.std(0) + 1e-9, rel=1e-8, abs=1e-12)
    p, u = (pulearn.scaled(v, model.mean, model.scale) for v in (np.array(sorted(map(tuple, good))), x))
    weights = pulearn.start(12)
    prior = len(good) / len(range(0, 600, 7))
    for turn in range(pulearn.ROUNDS):
        weights = pulearn.improve(weights, p, u[np.lexsort(u.T)], prior, pulearn.PASSES, [0, turn, 0])
    for mine, theirs in zip(model.weights, weights):
        assert mine == pytest.approx(theirs, abs=1e-9)
    monkeypatch.setattr(pulearn, "TASK_ROWS", 100)
    spread = pulearn.train(docs, labels, F.lit(True))
    assert all((s > 0.7) == bool(i % 3) for i, s in pulearn.score(docs, spread, ["doc_id"]).collect())


def slow_base(text):
    text = text or ""
    split = lambda s: [w for w in re.split("[\x20\x09-\x0d]+", s) if w]
    found = split(text)
    lines = [line for line in text.split("\n") if split(line)]
    grams = {}
    for i in range(len(found) - 4):
        grams.setdefault(tuple(found[i : i + 5]), []).append(i)
    inside = {j for places in grams.values() if len(places) > 1 for i in places for j in range(i, i + 5)}
    failed = len(found) < 10 or 100 * len(inside) > 20 * len(found)
    dup = sum(line in lines[:i] for i, line in enumerate(lines))
    return len(found), sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside), failed


def test_base_statistics_against_brute_force(spark, read):
    docs = read("documents")
    labels = read("labels")
    got = {r["doc_id"]: r for r in QUERIES["op4_rules"](spark, read.sf_dir).collect()}
    for i, text in docs.select("doc_id", "text").collect():
        r = got[i]
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == slow_base(text)
        assert not (r["kept"] and r["base_failed"])
    marks = dict(labels.select("doc_id", "quality").collect())
    good = [got[i] for i, q in marks.items() if q == 1 and not got[i]["base_failed"]]
    bad = [got[i] for i, q in marks.items() if q == 0]
    assert sum(r["kept"] for r in good) >= 0.97 * len(good)
    assert sum(r["kept"] for r in bad) <= 0.1 * len(bad)


@pytest.mark.parametrize("text", [None, "", " \n\x0b ", "a\x85b c\u00a0d\u2028e", "x y z u v x y z u v\n\nx\n \nx", "é# " * 30, "a\r\nb\r\na\r\nb", "w " * 9])
def test_base_statistics_of_odd_texts(text):
    (n, chars, symbols, dup, repeated), features = stats.counts(None if text is None else text.encode(), WordHashes())
    assert (n, chars, symbols, dup, repeated) == slow_base(text)[:5]
    assert all(math.isfinite(f) for f in features) and len(features) == len(stats.FEATURES)


def test_trees_are_monotonic_and_flattened_walks_agree():
    rng = np.random.default_rng(4)
    x = rng.random((3000, 4))
    y = ((x[:, 0] + 0.5 * np.sin(9 * x[:, 1]) + 0.3 * rng.normal(size=3000)) > 0.6).astype(float)
    forest = boosting.fit(x, y, {0: 1, 1: -1}, trees=30, depth=4)
    assert ((forest.score(x) > 0.5) == (y == 1)).mean() > 0.7
    grid = np.linspace(0, 1, 60)
    for feature, sign in ((0, 1), (1, -1)):
        for row in x[:40]:
            rows = np.repeat(row[None], 60, 0)
            rows[:, feature] = grid
            assert (sign * np.diff(forest.margin(rows)) >= -1e-9).all()

    def walk(at, row):
        while forest.left[at] != at:
            at = forest.left[at] if row[forest.feature[at]] <= forest.threshold[at] else forest.right[at]
        return forest.value[at]

    slow = [forest.start + sum(walk(r, row) for r in forest.roots) for row in x[:50]]
    assert np.allclose(forest.margin(x[:50]), slow)
