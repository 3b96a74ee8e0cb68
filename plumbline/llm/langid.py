"""Language identification by prediction by partial matching over bytes.

Each language has a tree of byte contexts of up to ``ORDER`` bytes with the counts of
what followed.  A byte's probability in a context is its count over the total plus the
number of different bytes seen, the latter standing for an escape to the shorter
context; below the empty context all byte values are equally likely.  Statistics are
frozen after training, so the code length of a text is the sum over its bytes of a
cost that depends on the byte and ``ORDER`` bytes before it, and is exact.

Bytes are told apart by classes: each of the ``CLASSES - 1`` most frequent bytes of
training is a class, all others share one and divide its probability equally.

Only contexts that were seen are stored.  The code length of a byte is a sum of terms:
the cost of no context, and for every longer context that the language has seen what
its escape costs, or, where it has seen the byte too, what it saves.  A term is kept
once with all languages that have it, so the model grows with the contexts seen and
any number of languages is learned.

The predicted language has the shortest code (the smaller name if equal); the score
is its posterior with equal priors.  Training takes at most ``DOCUMENTS`` documents
per language, whole texts.  Text that is null or has no letter gives ``und`` with score 0.  If nothing
was learned everything is ``und``.  Very long texts are scored whole.  Repeated rows are
scored each and alike, and count each where they are learned; an empty table gives an empty result.
Columns to keep travel as ``k_<name>``, so they may have any name.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.text import map_texts
from plumbline.plans.durable import materialise

ORDER, CLASSES = 2, 128
#: Training documents per language, at most.
DOCUMENTS = 2000
UNKNOWN = "und"
#: Bytes that are scored at once.
PIECE = 1 << 20


@dataclass
class Model:
    """Terms ``keys`` (sorted), each with the languages and bits ``starts[i] : starts[i + 1]``."""

    languages: list[str]
    classes: np.ndarray
    rare: int
    keys: np.ndarray
    starts: np.ndarray
    of: np.ndarray
    bits: np.ndarray

    def code_lengths(self, text: bytes) -> np.ndarray:
        """Bits that each language needs for a text."""
        out = np.zeros(len(self.languages))
        symbols = np.r_[np.zeros(ORDER, np.int64), self.classes[np.frombuffer(text, np.uint8)]]
        for k in range(ORDER, len(symbols), PIECE):
            part = symbols[k - ORDER : k + PIECE]
            out += (len(part) - ORDER) * np.log2(CLASSES)
            if len(self.keys):
                keys, n = _terms(*np.unique(_codes(part, CLASSES), return_counts=True))
                out += self._sum(keys, n)
            if self.rare > 1:
                out += np.count_nonzero(part[ORDER:] == CLASSES - 1) * np.log2(self.rare)
        return out

    def _sum(self, keys: np.ndarray, n: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        known = self.keys[at] == keys
        at, n = at[known], n[known]
        first, many = self.starts[at], self.starts[at + 1] - self.starts[at]
        place = np.arange(many.sum()) + np.repeat(first - np.cumsum(many) + many, many)
        return np.bincount(self.of[place], self.bits[place] * np.repeat(n, many), len(self.languages))

    def predict(self, text: bytes) -> tuple[str, float]:
        bits = self.code_lengths(text)
        best = int(bits.argmin())
        with np.errstate(over="ignore"):
            return self.languages[best], float(1 / np.exp2(np.minimum(bits[best] - bits, 0)).sum())


def _codes(symbols: np.ndarray, classes: int) -> np.ndarray:
    """Each byte's class with the classes of the bytes before it, as one number."""
    n = len(symbols) - ORDER
    out = symbols[:n].copy()
    for k in range(1, ORDER + 1):
        out *= classes
        out += symbols[k : n + k]
    return out


def _fold(codes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes and the sums of their counts."""
    found, at = np.unique(codes, return_inverse=True)
    return found, np.bincount(at, n, len(found))


def _terms(codes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the terms that codes of ``ORDER + 1`` bytes with counts ``n`` need, and how often.

    Per order, a context has the key ``2 * code`` and a context with the next byte the
    key ``2 * code + 1`` in a range of its own, beginning at ``_base(order)``.
    """
    keys, times = [], []
    for order in range(ORDER, -1, -1):
        codes, n = _fold(codes % CLASSES ** (order + 1), n)
        context, total = _fold(codes // CLASSES, n)
        keys += [_base(order) + 2 * context, _base(order) + 2 * codes + 1]
        times += [total, n]
    return np.concatenate(keys), np.concatenate(times)


def _base(order: int) -> int:
    return sum(2 * CLASSES ** (k + 1) for k in range(order))


def _sample(docs: DataFrame, allowed: Column) -> DataFrame:
    """``lang, text`` of at most DOCUMENTS documents per language, those with the smallest hash."""
    ids = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & allowed).select(
        F.col("lang").alias("_lang"), F.col("doc_id").alias("_id")
    )
    ranked = Window.partitionBy("_lang").orderBy(F.xxhash64("_id"), "_id")
    chosen = ids.withColumn("_n", F.row_number().over(ranked)).where(F.col("_n") <= DOCUMENTS).drop("_n").distinct()
    # Written, so that the planner knows its size: small tables are sent whole, others joined by key.
    chosen = materialise(chosen, "lang-ids")
    same = (F.col("lang") == F.col("_lang")) & (F.col("doc_id") == F.col("_id"))
    return docs.select("lang", "doc_id", "text").join(chosen, same).select("lang", "text")


def _byte_counts(sample: DataFrame) -> np.ndarray:
    def run(batch) -> dict:
        text = b"".join(t or b"" for t in batch.column("text").to_pylist())
        found = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
        return {"byte": np.arange(256), "n": found}

    rows = map_texts(sample.select("text"), "text", run, "byte int, n bigint").groupBy("byte").agg(F.sum("n").alias("n"))
    out = np.zeros(256, np.int64)
    for r in rows.collect():
        out[r["byte"]] = r["n"]
    return out


def _tree(codes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys and bits of a language's terms, from counts of the longest contexts with their next byte.

    A shorter context's counts are the sums over the byte in front; escapes lead to it.
    """
    keys, bits = [], []
    below, chance = np.arange(CLASSES), np.full(CLASSES, 1 / CLASSES)
    for order in range(ORDER + 1):
        found, count = _fold(codes % CLASSES ** (order + 1), n)
        context, at = np.unique(found // CLASSES, return_inverse=True)
        total, seen = np.bincount(at, count), np.bincount(at)
        # Every byte seen here was seen in the shorter context too, so its chance there is at hand.
        shorter = chance[np.searchsorted(below, found % CLASSES ** max(order, 1))]
        # An escape excludes what the context itself predicts, so no probability is lost.
        full = seen == CLASSES
        room = np.maximum(1 - np.bincount(at, shorter), 1e-30)
        escape = np.where(full, 0, seen)
        here = count / (total + escape)[at]
        leave = np.where(full, 0.0, -np.log2(np.maximum(np.where(full, 1, seen) / (total + escape) / room, 1e-30)))
        keys += [_base(order) + 2 * context, _base(order) + 2 * found + 1]
        bits += [leave, -np.log2(here) + np.log2(shorter) - leave[at]]
        below, chance = found, here
    return np.concatenate(keys), np.concatenate(bits)


def train(docs: DataFrame, allowed: Column) -> Model | None:
    """Frozen context trees of every language that the allowed documents name."""
    sample = _sample(docs, allowed)
    seen = _byte_counts(sample)
    common = np.argsort(-seen, kind="stable")[: CLASSES - 1]
    common = np.sort(common[seen[common] > 0])
    classes = np.full(256, CLASSES - 1, np.int64)
    classes[common] = np.arange(len(common))

    def run(batch) -> dict:
        by_lang: dict[str, list[np.ndarray]] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            symbols = np.r_[np.zeros(ORDER, np.int64), classes[np.frombuffer(text or b"", np.uint8)]]
            by_lang.setdefault(lang, []).append(_codes(symbols, CLASSES))
        langs, codes, times = [], [], []
        for lang, parts in by_lang.items():
            code, n = np.unique(np.concatenate(parts), return_counts=True)
            langs += [lang] * len(code)
            codes.append(code)
            times.append(n)
        join = lambda x: np.concatenate(x) if x else np.empty(0, np.int64)
        return {"lang": langs, "code": join(codes), "n": join(times)}

    rows = map_texts(sample, "text", run, "lang string, code int, n bigint").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    table = rows.groupBy("lang").agg(F.collect_list(F.struct("code", "n")).alias("seen")).select("lang", "seen.code", "seen.n")
    # A language with empty texts only has no terms: all bytes cost the same.
    languages = sorted(r["lang"] for r in sample.select("lang").distinct().collect())
    if not languages:
        return None
    number = {lang: i for i, lang in enumerate(languages)}
    keys, of, bits = [np.empty(0, np.int64)], [np.empty(0, np.int32)], [np.empty(0, np.float32)]
    for r in table.toLocalIterator():
        key, cost = _tree(np.array(r["code"], np.int64), np.array(r["n"], np.float64))
        keys.append(key)
        bits.append(cost.astype(np.float32))
        of.append(np.full(len(key), number[r["lang"]], np.int32))
    key, of, bits = np.concatenate(keys), np.concatenate(of), np.concatenate(bits)
    order = np.lexsort((of, key))
    key, first = np.unique(key[order], return_index=True)
    return Model(languages, classes, 256 - len(common), key, np.r_[first, len(of)], of[order], bits[order])


def identify(docs: DataFrame, model: Model | None, keep: list[str]) -> DataFrame:
    """``keep`` columns, ``lang_pred`` and ``score`` of every text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    letter = F.coalesce(docs["text"].rlike(r"\p{L}"), F.lit(False))
    given = docs.select(
        *[docs[c].alias(f"k_{c}") for c in keep], F.when(letter, docs["text"]).alias("_text")
    )
    kinds = {f.name: f.dataType.simpleString() for f in given.schema}

    def run(batch) -> dict:
        texts = batch.column("_text").to_pylist()
        none = (UNKNOWN, 0.0)
        found = [none if t is None or sent.value is None else sent.value.predict(t) for t in texts]
        out = {f"k_{c}": batch.column(f"k_{c}") for c in keep}
        return out | {"lang_pred": [f[0] for f in found], "score": [f[1] for f in found]}

    schema = ", ".join([*(f"`k_{c}` {kinds[f'k_{c}']}" for c in keep), "lang_pred string, score double"])
    return map_texts(given, "_text", run, schema).withColumnsRenamed({f"k_{c}": c for c in keep})
