"""Quality scores by positive-unlabelled learning.

Trusted positives and unlabelled web text train a small network that minimises the
non-negative unbiased risk: with class prior ``p``, ``p R+(positives) + max(0,
R-(unlabelled) - p R-(positives))``, so overfitting cannot drive the estimate of the
negative part below zero.  The prior is the share of positives among the labelled
training rows.  The network's output is turned into a probability by a logistic fit
on the same rows.

Every allowed document takes part: mean and scale of the statistics are aggregates over
all, and so is the unlabelled risk.  Statistics are written once.  In each round a task
goes over its documents in minibatches from the common weights, next to the positives;
the rounds' weights are averaged by documents.  Only labelled rows are bounded, to those
``LABELLED`` with the smallest hash of their id.

Null text is scored as empty.  Very long texts are read whole.  Repeated rows count each
as unlabelled text, and once as labelled.  Rows of one task are sorted by their statistics,
so ties and the order of the input do not matter.  Without any positive, or any document,
nothing can be learned and every score is 0.5; an empty table is scored as an empty one.
Scores are a function of the text column, so columns to keep stay where they are and may
have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm import samples
from plumbline.llm.stats import FEATURES, counts
from plumbline.llm.text import WordHashes, give_back, map_texts, slices
from plumbline.plans.durable import materialise

#: Labelled documents that a model is fitted on, at most.
LABELLED = 20_000
HIDDEN, BATCH, RATE = 16, 512, 0.01
#: Rounds, passes over a task's documents in each, and documents that a task aims at.
ROUNDS, PASSES, TASK_ROWS = 12, 5, 200_000
#: Below minus this the negative risk is driven up again instead of down.
TOLERANCE = 0.0
THRESHOLD = 0.7


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]
    slope: float
    shift: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        return np.tanh((np.clip((x - self.mean) / self.scale, -8, 8)) @ w1 + b1) @ w2 + b2[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.slope * self.raw(x) + self.shift)


def _gradients(weights, x, toward):
    """Gradient of mean sigmoid loss for the class ``toward`` (1 or -1), and the loss."""
    w1, b1, w2, b2 = weights
    h = np.tanh(x @ w1 + b1)
    loss = _sigmoid(-toward * (h @ w2 + b2[0]))
    dz = -toward * loss * (1 - loss) / max(1, len(x))
    dh = np.outer(dz, w2) * (1 - h * h)
    return [x.T @ dh, dh.sum(0), h.T @ dz, np.array([dz.sum()])], float(loss.mean()) if len(x) else 0.0


def start(dimensions: int, seed: int = 0) -> list[np.ndarray]:
    """Weights before the first round."""
    rng = np.random.default_rng(seed)
    return [rng.normal(0, dimensions**-0.5, (dimensions, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]


def improve(weights: list[np.ndarray], p: np.ndarray, u: np.ndarray, prior: float, passes: int, seed) -> list[np.ndarray]:
    """Minimise the non-negative risk of scaled statistics with Adam on minibatches."""
    rng = np.random.default_rng(seed)
    weights = list(weights)
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    step = 0
    for _ in range(passes):
        order_p, order_u = rng.permutation(len(p)), rng.permutation(len(u))
        for k in range(max(1, -(-len(u) // BATCH))):
            xu = u[order_u[k * BATCH : (k + 1) * BATCH]]
            xp = p[np.take(order_p, np.arange(k * BATCH, k * BATCH + min(BATCH, len(p))), mode="wrap")]
            grads = risk_gradient(weights, xp, xu, prior)[0]
            step += 1
            for i, g in enumerate(grads):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                rate = RATE * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                weights[i] = weights[i] - rate * first[i] / (np.sqrt(second[i]) + 1e-8)
    return weights


def risk_gradient(weights, xp: np.ndarray, xu: np.ndarray, prior: float) -> tuple[list[np.ndarray], float]:
    """Direction of a step, and the non-negative risk: where its negative part is below zero, that part is driven up."""
    plus, risk_plus = _gradients(weights, xp, 1)
    minus_p, risk_p = _gradients(weights, xp, -1)
    minus_u, risk_u = _gradients(weights, xu, -1)
    negative = [gu - prior * gp for gu, gp in zip(minus_u, minus_p)]
    below = risk_u - prior * risk_p
    risk = prior * risk_plus + max(0.0, below)
    if below >= -TOLERANCE:
        return [prior * gp + gn for gp, gn in zip(plus, negative)], risk
    return [-gn for gn in negative], risk


def scaled(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.clip((x - mean) / scale, -8, 8)


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, seed: int = 0) -> Model:
    """The same for statistics at hand: one task's rounds, without averaging."""
    mean, scale = unlabelled.mean(0), unlabelled.std(0) + 1e-9
    p, u = scaled(positive, mean, scale), scaled(unlabelled, mean, scale)
    u = u[np.lexsort(u.T)]
    weights = start(u.shape[1], seed)
    for turn in range(ROUNDS):
        weights = improve(weights, p, u, prior, PASSES, [seed, turn, 0])
    return Model(mean, scale, weights, 1.0, 0.0)


def statistics(docs: DataFrame) -> DataFrame:
    """``features`` of every text."""
    hashes = WordHashes()

    def run(batch) -> dict:
        return {"features": [counts(t, hashes)[1] for t in batch.column("_text").to_pylist()]}

    return map_texts(docs.select(docs["text"].alias("_text")), "_text", run, "features array<double>")


def moments(rows: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, mean and deviation of each statistic; the last digits, which depend on the order of sums, are cut."""
    one = [F.col("features")[i] for i in range(len(FEATURES))]
    row = rows.agg(F.count(F.lit(1)), *[F.avg(c) for c in one], *[F.stddev_pop(c) for c in one]).first()
    cut = lambda values: np.array([float(f"{v or 0.0:.9g}") for v in values])
    return row[0], cut(row[1 : 1 + len(one)]), cut(row[1 + len(one) :]) + 1e-9


def averaged(rows: DataFrame, weights: list[np.ndarray], p: np.ndarray, mean, scale, prior: float, seed: list[int]) -> list[np.ndarray]:
    """One round: weights of all tasks, averaged by their documents."""

    def run(batches):
        parts = [b.column("features").flatten().to_numpy().reshape(b.num_rows, len(mean)) for b in batches if b.num_rows]
        if not parts:
            return
        u = scaled(np.concatenate(parts), mean, scale)
        u = u[np.lexsort(u.T)]
        del parts
        found = improve(weights, p, u, prior, PASSES, [*seed, TaskContext.get().partitionId()])
        n, flat = len(u), np.concatenate([w.ravel() for w in found])
        del u
        give_back()
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(flat)), pa.int32()), pa.array(flat), pa.array(np.full(len(flat), n, np.int64))], names=["place", "w", "n"]
        )

    each = rows.mapInArrow(run, "place int, w double, n bigint")
    mean_of = each.groupBy("place").agg((F.sum(F.col("w") * F.col("n")) / F.sum("n")).alias("w"))
    flat = np.array([r.w for r in sorted(mean_of.collect())])
    ends = np.cumsum([w.size for w in weights])
    return [part.reshape(w.shape) for part, w in zip(np.split(flat, ends[:-1]), weights)]


def calibrate(model: Model, x: np.ndarray, y: np.ndarray) -> Model:
    """Fit slope and shift of the output so that it is a probability; a little regularised."""
    z = model.raw(x)
    a, b = 1.0, 0.0
    for _ in range(100):
        p = _sigmoid(a * z + b)
        g = np.array([((p - y) * z).sum() + 1e-3 * a, (p - y).sum()])
        w = p * (1 - p)
        hess = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-3]])
        move = np.linalg.solve(hess, g)
        a, b = a - np.clip(move[0], -2, 2), b - np.clip(move[1], -2, 2)
    return Model(model.mean, model.scale, model.weights, float(max(a, 0.0)), float(b))


def train(docs: DataFrame, labels: DataFrame, allowed: Column, label: str = "quality") -> Model | None:
    """Fit on the rows that ``allowed`` (an expression over doc_id) lets through."""
    x, y = samples.labelled(docs, labels, label, LABELLED, allowed)
    if not (y == 1).any():
        return None
    prior = min(0.99, float((y == 1).mean()))
    rows = materialise(statistics(docs.where(allowed)), "quality-statistics")
    n, mean, scale = moments(rows)
    rows = rows.coalesce(max(1, -(-n // TASK_ROWS)))
    p, weights = scaled(x[y == 1], mean, scale), start(len(FEATURES))
    for turn in range(ROUNDS):
        weights = averaged(rows, weights, p, mean, scale, prior, [0, turn])
    return calibrate(Model(mean, scale, weights, 1.0, 0.0), x, (y == 1).astype(float))


def scores(text: Column, model: Model | None) -> Column:
    """Score of every text; only the texts go to Python, and only their scores come back."""
    hashes = WordHashes()

    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        try:
            for batch in batches:
                found = [np.zeros(0)]
                for piece in slices([pa.RecordBatch.from_arrays([batch], names=["_text"])], "_text"):
                    texts = piece.column("_text").to_pylist()
                    found.append(model.score(np.array([counts(t, hashes)[1] for t in texts])))
                yield pa.array(np.concatenate(found))
        finally:
            batch = piece = texts = None
            give_back()

    return F.lit(0.5) if model is None else run(text.cast("binary"))


def score(docs: DataFrame, model: Model | None, keep: list[str]) -> DataFrame:
    """``keep`` columns and ``score`` of every text."""
    return docs.select(*[docs[c] for c in keep], scores(docs["text"], model).alias("score"))
