"""Quality rules: base rules and gradient-boosted trees over document statistics.

The trees are grown here, on quantile bins, with logistic loss and second-order
gains.  Monotonic constraints bound both children of a split by the middle of their
values wherever a constrained feature splits, and refuse splits in the wrong
direction, so the score never rises with a feature that may only lower it.  A fitted
ensemble is flattened into node arrays, through which all rows of a batch walk
level by level.

Training takes at most ``LABELLED`` labelled documents, in whole; scoring takes
every text.  Null text is scored as empty, very long texts are read whole.  Without
labels of both kinds nothing can be learned and only the base rules decide.  Repeated
rows are judged each and alike; of several labels of an id the largest counts, of several
rows the smallest statistics, so ties and order do not matter.  An empty table gives an
empty result.  Columns to keep travel as ``k_<name>``, so they may have any name.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import samples
from plumbline.llm.stats import FEATURES, counts
from plumbline.llm.text import WordHashes, map_texts

LABELLED = 20_000
TREES, DEPTH, RATE, BINS, LEAST, SHRINK = 60, 4, 0.2, 64, 10.0, 1.0
#: Features that may only lower (-1) or raise (1) the score.
MONOTONE = {"symbols_per_word": -1, "dup_lines": -1, "repeat_words": -1, "marks_per_word": -1, "most_frequent_word": -1}
#: Base rules: fewest words, and the largest share of words in repeated windows, in percent.
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
KEEP_FROM = 0.5


@dataclass
class Forest:
    """All trees in one set of arrays; leaves point to themselves."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int
    start: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return self.start + self.value[at].sum(1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -50, 50)))


def _edges(x: np.ndarray) -> list[np.ndarray]:
    """Thresholds between quantile bins of each feature."""
    out = []
    for column in x.T:
        values = np.unique(column)
        middle = (values[1:] + values[:-1]) / 2
        take = np.unique(np.linspace(0, len(middle) - 1, min(BINS - 1, len(middle))).astype(int)) if len(middle) else []
        by_rank = np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1])
        out.append(np.unique(np.r_[middle[take], by_rank])[: 4 * BINS])
    return out


def fit(x: np.ndarray, y: np.ndarray, monotone: dict[int, int], trees: int = TREES, depth: int = DEPTH) -> Forest:
    """Boost trees of bounded depth on rows ``x`` and labels 0 or 1."""
    edges = _edges(x)
    binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)])
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    start = float(np.log(share / (1 - share)))
    margin = np.full(len(x), start)
    nodes: dict[str, list] = {k: [] for k in ("feature", "threshold", "left", "right", "value")}
    roots = []

    def add() -> int:
        for k, empty in (("feature", 0), ("threshold", 0.0), ("left", 0), ("right", 0), ("value", 0.0)):
            nodes[k].append(empty)
        at = len(nodes["value"]) - 1
        nodes["left"][at] = nodes["right"][at] = at
        return at

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, p * (1 - p)

        def best(rows: np.ndarray, low: float, high: float):
            """The split of largest gain that keeps to the constraints, or None."""
            g, h = grad[rows].sum(), hess[rows].sum()
            worth = lambda v, g_, h_: -(g_ * v + 0.5 * (h_ + SHRINK) * v * v)
            value = lambda g_, h_: np.clip(-g_ / (h_ + SHRINK), low, high)
            top = None
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                gl = np.cumsum(np.bincount(binned[f, rows], grad[rows], len(e) + 1))[:-1]
                hl = np.cumsum(np.bincount(binned[f, rows], hess[rows], len(e) + 1))[:-1]
                n = np.cumsum(np.bincount(binned[f, rows], minlength=len(e) + 1))[:-1]
                vl, vr = value(gl, hl), value(g - gl, h - hl)
                gain = worth(vl, gl, hl) + worth(vr, g - gl, h - hl) - worth(value(g, h), g, h)
                gain[(n < LEAST) | (len(rows) - n < LEAST)] = -np.inf
                sign = monotone.get(f, 0)
                if sign:
                    gain[sign * (vr - vl) < 0] = -np.inf
                k = int(gain.argmax())
                if gain[k] > 1e-6 and (top is None or gain[k] > top[0]):
                    top = (float(gain[k]), f, k, float(vl[k]), float(vr[k]))
            return top

        root = add()
        roots.append(root)
        todo = [(root, np.arange(len(x)), -np.inf, np.inf, 0)]
        while todo:
            at, rows, low, high, level = todo.pop()
            split = best(rows, low, high) if level < depth else None
            if split is None:
                value = float(np.clip(-grad[rows].sum() / (hess[rows].sum() + SHRINK), low, high))
                nodes["value"][at] = RATE * value
                margin[rows] += RATE * value
                continue
            _, f, k, vl, vr = split
            left, right = add(), add()
            nodes["feature"][at], nodes["threshold"][at] = f, float(edges[f][k])
            nodes["left"][at], nodes["right"][at] = left, right
            middle, sign = (vl + vr) / 2, monotone.get(f, 0)
            bounds = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}[sign]
            go = binned[f, rows] <= k
            todo += [(left, rows[go], *bounds[0], level + 1), (right, rows[~go], *bounds[1], level + 1)]
    arrays = {k: np.array(v, np.float64 if k in ("threshold", "value") else np.int64) for k, v in nodes.items()}
    return Forest(np.array(roots, np.int64), depth=depth, start=start, **arrays)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Forest | None:
    x, y = samples.labelled(docs, labels, label, LABELLED)
    if len(set(y.tolist())) < 2:
        return None
    return fit(x, (y == 1).astype(float), {FEATURES.index(n): s for n, s in MONOTONE.items()})


def judge(docs: DataFrame, forest: Forest | None, keep: list[str]) -> DataFrame:
    """``keep`` columns, the base statistics, base_failed, score and kept of every text."""
    given = docs.select(*[docs[c].alias(f"k_{c}") for c in keep], docs["text"].alias("_text"))
    kinds = {f.name: f.dataType.simpleString() for f in given.schema}
    hashes = WordHashes()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def run(batch) -> dict:
        found = [counts(t, hashes) for t in batch.column("_text").to_pylist()]
        base = np.array([b for b, _ in found], np.int64)
        x = np.array([f for _, f in found])
        failed = (base[:, 0] < MIN_WORDS) | (100 * base[:, 4] > MAX_REPEAT_PERCENT * base[:, 0])
        score = np.ones(len(x)) if forest is None else forest.score(x)
        out = {f"k_{c}": batch.column(f"k_{c}") for c in keep} | dict(zip(names, base.T))
        return out | {"base_failed": failed, "score": score, "kept": ~failed & (score >= KEEP_FROM)}

    outputs = [*(f"{n} bigint" for n in names), "base_failed boolean", "score double", "kept boolean"]
    schema = ", ".join([*(f"`k_{c}` {kinds[f'k_{c}']}" for c in keep), *outputs])
    return map_texts(given, "_text", run, schema).withColumnsRenamed({f"k_{c}": c for c in keep})


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that base rules and trees keep."""
    row = docs.select(docs["text"], F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    found = judge(row, train(docs, labels), ["row"]).where("kept")
    return found.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
