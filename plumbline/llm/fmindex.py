"""A compressed full-text index over words, searched backwards in whole batches.

``FMIndex`` holds the Burrows-Wheeler transform of many short word sequences in a
wavelet tree whose levels are bit vectors with block counts.  ``matches`` streams
sequences through it from right to left, all side by side, and gives matching
statistics: for each position the length of the longest stretch from there that the
index contains, up to the threshold, and the suffix interval of the stretch.
"""

from __future__ import annotations

import numpy as np


class BitVector:
    """Packed bits with a running count per 64; 1.5 bits per bit."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        counts = np.bitwise_count(self.words).astype(np.int64)
        self.before = (np.cumsum(counts) - counts).astype(np.int32)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first ``i`` bits."""
        word = i >> 6
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & low)


class WaveletTree:
    """Ranks of symbols in a sequence; one bit vector per level, from the highest bit."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.bits = list(range(max(1, int(sigma - 1).bit_length()) - 1, -1, -1))
        self.levels: list[tuple[BitVector, int]] = []
        for bit in self.bits:
            ones = (symbols >> bit & 1).astype(np.uint8)
            self.levels.append((BitVector(ones), int(len(ones) - ones.sum())))
            symbols = np.concatenate([symbols[ones == 0], symbols[ones == 1]])
        self.first = self._down(np.arange(sigma), np.zeros(sigma, np.int64))

    def _down(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for bit, (vector, zeros) in zip(self.bits, self.levels):
            ones = vector.rank(i)
            i = np.where(symbol >> bit & 1, zeros + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Times that ``symbol`` occurs among the first ``i``."""
        return self._down(symbol, i) - self.first[symbol]


def suffix_array(symbols: np.ndarray, longest: int) -> np.ndarray:
    """Order of all suffixes, by doubling; each ends at a unique symbol after ``longest`` at most."""
    n, step = len(symbols), 1
    order = np.argsort(symbols, kind="stable")
    rank = symbols
    while True:
        ordered = rank[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.r_[0, ordered[1:] != ordered[:-1]])
        if step > longest or rank[order[-1]] == n - 1:
            return order
        rank = rank * (n + 1)
        rank[:-step] += rank[step:] // (n + 1) + 1
        order = np.argsort(rank)
        step *= 2


class FMIndex:
    """Index of word sequences; ``depth`` is the threshold up to which it matches."""

    def __init__(self, sequences: np.ndarray, lengths: np.ndarray, depth: int):
        """``sequences``: word numbers from 1 on, one sequence after the other."""
        n_seq, n = len(lengths), len(sequences) + len(lengths)
        ends = np.cumsum(lengths + 1) - 1
        self.depth, self.sigma = depth, int(sequences.max(initial=0)) + 1
        text = np.zeros(n, np.int64)
        is_word = np.ones(n, bool)
        is_word[ends] = False
        text[is_word] = sequences
        unique = np.where(is_word, text + n_seq, 0)
        unique[ends] = np.arange(n_seq)
        self.order = suffix_array(unique, int(lengths.max(initial=0)) + 1)
        self.tree = WaveletTree(text[self.order - 1], self.sigma)
        counts = np.bincount(text, minlength=self.sigma)
        self.smaller = np.cumsum(counts) - counts
        self.n = n
        self._blocks(text, is_word)

    def _blocks(self, text: np.ndarray, is_word: np.ndarray) -> None:
        """For each length up to the depth, where runs of suffixes that share so many words start."""
        common = np.zeros(self.n, np.int64)
        live = np.arange(1, self.n)
        for d in range(self.depth):
            a, b = self.order[live] + d, self.order[live - 1] + d
            inside = (a < self.n) & (b < self.n)
            live, a, b = live[inside], a[inside], b[inside]
            same = (text[a] == text[b]) & is_word[a] & is_word[b]
            live = live[same]
            common[live] = d + 1
            if not len(live):
                break
        self.starts = [np.r_[np.flatnonzero(common < d), self.n] for d in range(self.depth + 1)]
        self.starts[0] = np.array([0, self.n])

    def widen(self, at: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix interval of the first ``length`` words of the suffix at ``at``."""
        low, high = np.zeros_like(at), np.full_like(at, self.n)
        for d in np.unique(length):
            of = length == d
            block = np.searchsorted(self.starts[d], at[of], "right") - 1
            low[of], high[of] = self.starts[d][block], self.starts[d][block + 1]
        return low, high

    def extend(self, word: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward step: the interval of ``word`` followed by what ``low, high`` stand for."""
        both = self.tree.rank(np.r_[word, word], np.r_[low, high])
        k = len(word)
        return self.smaller[word] + both[:k], self.smaller[word] + both[k:]

    def matches(self, sequences: np.ndarray, lengths: np.ndarray):
        """Matching statistics of word sequences: length (up to depth) and interval start per position.

        Words that the index does not know have a number from ``sigma`` on.
        """
        starts = np.cumsum(lengths) - lengths
        length_at, low_at = np.zeros(len(sequences), np.int64), np.zeros(len(sequences), np.int64)
        low, high = np.zeros(len(lengths), np.int64), np.full(len(lengths), self.n)
        length = np.zeros(len(lengths), np.int64)
        for back in range(1, int(lengths.max(initial=0)) + 1):
            of = np.flatnonzero(lengths >= back)
            at = starts[of] + lengths[of] - back
            word = sequences[at]
            known = word < self.sigma
            length[of[~known]], low[of[~known]], high[of[~known]] = 0, 0, self.n
            todo, word = of[known], word[known]
            while len(todo):
                new_low, new_high = self.extend(word, low[todo], high[todo])
                hit = new_low < new_high
                done = todo[hit]
                low[done], high[done] = new_low[hit], new_high[hit]
                length[done] += 1
                # Nothing as long occurs: drop the last word of the match and try again.
                todo, word = todo[~hit], word[~hit]
                again = length[todo] > 0
                todo, word = todo[again], word[again]
                if len(todo):
                    length[todo] -= 1
                    low[todo], high[todo] = self.widen(low[todo], length[todo])
            over = of[length[of] > self.depth]
            length[over] = self.depth
            if len(over):
                low[over], high[over] = self.widen(low[over], length[over])
            length_at[at], low_at[at] = length[of], low[of]
        return length_at, low_at

    def block(self, low: np.ndarray) -> np.ndarray:
        """Number of the run of suffixes that share ``depth`` words."""
        return np.searchsorted(self.starts[self.depth], low, "right") - 1
