"""Statistics of whole texts, as the rule and quality operators use them.

Null text counts as empty; every ratio of an empty text is 0.
"""

from __future__ import annotations

import math

import numpy as np

from plumbline.llm.text import WordHashes

SPACES = b" \t\n\r\x0b\x0c"
CONTINUATION = bytes(range(0x80, 0xC0))
SYMBOLS = b"#*$%&|<>"
UPPER, LOWER, DIGITS = bytes(range(65, 91)), bytes(range(97, 123)), b"0123456789"
MARKS = b"!?"
SENTENCE = b".,;:"
#: Words per window in which repeats are looked for.
WINDOW = 5

#: Names of the model's features, in order.
FEATURES = (
    "log_words",
    "mean_word",
    "symbols_per_word",
    "dup_lines",
    "repeat_words",
    "upper",
    "digits",
    "marks_per_word",
    "sentence_marks_per_word",
    "distinct_words",
    "most_frequent_word",
    "words_per_line",
)
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _without(text: bytes, chars: bytes) -> int:
    """How many bytes of ``chars`` a text holds."""
    return len(text) - len(text.translate(None, chars))


def repeat_words(hashes: np.ndarray, window: int = WINDOW) -> int:
    """Words inside windows whose word sequence is found twice or more in the text."""
    n = len(hashes) - window + 1
    if n < 2:
        return 0
    grams = hashes[:n].copy()
    for k in range(1, window):
        grams *= MULTIPLIER
        grams += hashes[k : n + k]
    order = np.argsort(grams, kind="stable")
    ordered = grams[order]
    same = ordered[1:] == ordered[:-1]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    change = np.zeros(len(hashes) + 1, np.int32)
    change[:n] += twice
    change[window:] -= twice[: len(change) - window]
    return int((np.cumsum(change[:-1]) > 0).sum())


def counts(text: bytes | None, hashes: WordHashes) -> tuple[tuple[int, int, int, int, int], tuple[float, ...]]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) and the features of a text."""
    text = text or b""
    found = text.split()
    n = len(found)
    chars = len(text.translate(None, SPACES + CONTINUATION))
    symbols = _without(text, SYMBOLS)
    lines = [line for line in text.split(b"\n") if line.strip(SPACES)]
    dup_lines = len(lines) - len(set(lines))
    of_words = hashes.of(found)
    repeated = repeat_words(of_words)
    base = (n, chars, symbols, dup_lines, repeated)
    if not n:
        return base, (0.0,) * len(FEATURES)
    _, times = np.unique(of_words, return_counts=True)
    upper, lower = _without(text, UPPER), _without(text, LOWER)
    features = (
        math.log1p(n),
        chars / n,
        symbols / n,
        dup_lines / len(lines),
        repeated / n,
        upper / max(1, upper + lower),
        _without(text, DIGITS) / max(1, chars),
        _without(text, MARKS) / n,
        _without(text, SENTENCE) / n,
        len(times) / n,
        float(times.max()) / n,
        min(200.0, n / len(lines)),
    )
    return base, features
