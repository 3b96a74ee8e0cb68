"""Minimal perfect hashing of 128-bit keys into flat array slots."""

from __future__ import annotations

import numpy as np

_MOST_LEVELS = 200


def _mixed(a: np.ndarray, b: np.ndarray, level: int) -> np.ndarray:
    x = a * np.uint64(0x9E3779B97F4A7C15) ^ (b + np.uint64(level * 0xD1B54A32D192ED03 % 2**64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ x >> np.uint64(shift)) * np.uint64(factor)
    return x ^ x >> np.uint64(31)


class PerfectTable:
    """Slots ``0 .. n-1`` for n distinct keys (pairs of 64-bit integers), each slot used once.

    Level by level the keys left are hashed into twice as many places; those that are
    alone in their place get the next slot, the others go down a level.  The key of each
    slot is kept and compared on lookup, so a key that is not in the table gives -1.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray):
        a, b = a.astype(np.uint64), b.astype(np.uint64)
        self.levels: list[np.ndarray] = []
        left, used = np.arange(len(a)), 0
        order = np.empty(len(a), np.int64)
        while len(left):
            if len(self.levels) == _MOST_LEVELS:
                raise ValueError("keys are not distinct")
            size = max(8, 2 * len(left))
            place = (_mixed(a[left], b[left], len(self.levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(place, minlength=size)[place] == 1
            slots = np.full(size, -1, np.int64)
            slots[place[alone]] = used + np.arange(int(alone.sum()))
            order[slots[place[alone]]] = left[alone]
            used += int(alone.sum())
            self.levels.append(slots)
            left = left[~alone]
        self.a, self.b = a[order], b[order]

    def __len__(self) -> int:
        return len(self.a)

    def slots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 where the table does not hold it."""
        a, b = a.astype(np.uint64), b.astype(np.uint64)
        found = np.full(len(a), -1, np.int64)
        left = np.arange(len(a))
        for level, slots in enumerate(self.levels):
            slot = slots[(_mixed(a[left], b[left], level) % np.uint64(len(slots))).astype(np.int64)]
            hit = slot >= 0
            at, slot = left[hit], slot[hit]
            same = (self.a[slot] == a[at]) & (self.b[slot] == b[at])
            found[at[same]] = slot[same]
            left = left[~hit]
        return found
