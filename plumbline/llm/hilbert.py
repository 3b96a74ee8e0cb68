"""Places on a Hilbert curve, for many points at once."""

from __future__ import annotations

import numpy as np


def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place along the curve of each row of ``cells`` (n x dims, integers of ``bits`` bits).

    The curve fills a grid of ``2**bits`` cells a side; cells next to each other on it
    share a face.  ``bits * dims`` may be 63 at most.  The axes are turned level by level
    into the curve's own frame, then Gray-decoded (Skilling 2004).
    """
    n, dims = cells.shape
    if bits * dims > 63:
        raise ValueError("the key would not fit 63 bits")
    x = cells.astype(np.int64).T.copy()
    for level in range(bits - 1, 0, -1):
        bit, below = 1 << level, (1 << level) - 1
        for axis in range(dims):
            far = (x[axis] & bit) != 0
            swap = np.where(far, 0, (x[0] ^ x[axis]) & below)
            x[0] = np.where(far, x[0] ^ below, x[0] ^ swap)
            x[axis] ^= swap
    for axis in range(1, dims):
        x[axis] ^= x[axis - 1]
    carry = np.zeros(n, np.int64)
    for level in range(bits - 1, 0, -1):
        carry ^= np.where(x[-1] & (1 << level), (1 << level) - 1, 0)
    x ^= carry
    key = np.zeros(n, np.int64)
    for level in range(bits - 1, -1, -1):
        for axis in range(dims):
            key = key << 1 | (x[axis] >> level) & 1
    return key
