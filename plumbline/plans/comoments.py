"""Correlation of all pairs of many columns in one scan.

A task holds, for each pair of column blocks, the number of rows where both sides are
present, the means and squared deviations of either side over just those rows, and their
co-moment.  A batch adds to all pairs of two blocks by a few matrix products over centred
values and null masks.  The states of tasks are merged (Chan, Golub and LeVeque 1979) in
rounds of at most ``FAN_IN``, block by block; only finished blocks become rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import as_double
from plumbline.plans.durable import materialise

#: Columns of a block, rows that are multiplied at a time, and states that one call merges.
BLOCK, ROWS, FAN_IN = 128, 4096, 64
#: Spread, relative to that of all values, below which it is rounding.
NOISE = 1e-13

_STATE = "i int, j int, part bigint, state binary"
#: What a state holds for each pair: rows, means of both sides, squared deviations, co-moment, rows that are not finite.
_PLANES = 7


def pairwise_correlation(df: DataFrame, names: list[str]) -> DataFrame:
    """(a, b, r) for column places ``a <= b``: over rows where both are present, 0 if undefined, NaN if not finite."""
    n, width, fan_in = len(names), BLOCK, FAN_IN
    starts = list(range(0, n, width))
    values = df.select(*[as_double(name).alias(f"c{i}") for i, name in enumerate(names)])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                add(states, batch.slice(at, ROWS))
        part = TaskContext.get().partitionId()
        for (i, j), state in states.items():
            yield _row(i, j, part, state)

    def add(states: dict, batch: pa.RecordBatch) -> None:
        blocks = [block(batch, start) for start in starts]
        for i, left in enumerate(blocks):
            for j in range(i, len(blocks)):
                state = products(left, blocks[j])
                states[i, j] = merged(states[i, j], state) if (i, j) in states else state

    def block(batch: pa.RecordBatch, start: int) -> tuple:
        columns = [batch.column(c) for c in range(start, min(start + width, n))]
        present = np.column_stack([np.asarray(c.is_valid()) for c in columns])
        x = np.column_stack([c.fill_null(0.0).to_numpy(zero_copy_only=False) for c in columns])
        finite = np.isfinite(x)
        used = present & finite
        x = np.where(used, x, 0.0)
        centre = x.sum(axis=0) / np.maximum(used.sum(axis=0), 1)
        # A constant is centred exactly, so that it has no spread at all.
        low, high = np.where(used, x, np.inf).min(axis=0), np.where(used, x, -np.inf).max(axis=0)
        centre = np.where(low == high, low, centre)
        x = np.where(used, x - centre, 0.0)
        return x, used.astype(np.float64), (present & ~finite).astype(np.float64), present.astype(np.float64), centre

    def finish(rows: pa.Table) -> pa.Table:
        out: dict[str, list] = {"a": [], "b": [], "r": []}
        for i, j, state in zip(*(rows.column(c).to_pylist() for c in ("i", "j", "state"))):
            r = correlation_of(_unpacked(state, i, j, n, width))
            a, b = np.meshgrid(np.arange(r.shape[0]) + starts[i], np.arange(r.shape[1]) + starts[j], indexing="ij")
            chosen = a <= b
            for name, found in (("a", a), ("b", b), ("r", r)):
                out[name] += found[chosen].tolist()
        return pa.table({"a": pa.array(out["a"], pa.int32()), "b": pa.array(out["b"], pa.int32()), "r": pa.array(out["r"], pa.float64())})

    def merge(rows: pa.Table) -> pa.Table:
        columns = [rows.column(c).to_pylist() for c in ("i", "j", "part", "state")]
        total = None
        for i, j, _, state in sorted(zip(*columns), key=lambda r: r[2]):
            state = _unpacked(state, i, j, n, width)
            total = state if total is None else merged(total, state)
        return pa.Table.from_batches([_row(columns[0][0], columns[1][0], min(columns[2]) // fan_in, total)])

    states = materialise(values.mapInArrow(scan, _STATE), "comoments")
    while (states.agg(F.max("part")).first()[0] or 0) > 0:
        group = F.expr(f"part div {fan_in}").alias("group")
        states = materialise(states.groupBy("i", "j", group).applyInArrow(merge, _STATE), "comoments")
    found = states.groupBy("i", "j").applyInArrow(finish, "a int, b int, r double")
    if states.isEmpty():
        places = [(i, j, 0.0) for i in range(n) for j in range(i, n)]
        return df.sparkSession.createDataFrame(places, "a int, b int, r double")
    return found


def products(left: tuple, right: tuple) -> np.ndarray:
    """State of one batch for two blocks."""
    x, mx, ox, px, cx = left
    y, my, oy, py, cy = right
    n = mx.T @ my
    rows = np.maximum(n, 1)
    sx, sy = x.T @ my, mx.T @ y
    qx, qy = (x * x).T @ my, mx.T @ (y * y)
    dx, dy = qx - sx * sx / rows, qy - sy * sy / rows
    dx, dy = np.where(dx <= NOISE * qx, 0.0, dx), np.where(dy <= NOISE * qy, 0.0, dy)
    odd = ox.T @ py + px.T @ oy
    return np.stack([n, cx[:, None] + sx / rows, cy[None, :] + sy / rows, dx, dy, x.T @ y - sx * sy / rows, odd])


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """State of the rows of both."""
    n = a[0] + b[0]
    rows = np.maximum(n, 1)
    # Where one side has no rows, its means mean nothing.
    gx, gy = (np.where((a[0] > 0) & (b[0] > 0), b[k] - a[k], 0.0) for k in (1, 2))
    weight = a[0] * b[0] / rows
    mean = [np.where(a[0] > 0, a[k], b[k]) + g * b[0] / rows for k, g in ((1, gx), (2, gy))]
    return np.stack([n, *mean, a[3] + b[3] + gx * gx * weight, a[4] + b[4] + gy * gy * weight, a[5] + b[5] + gx * gy * weight, a[6] + b[6]])


def correlation_of(state: np.ndarray) -> np.ndarray:
    n, mx, my, dx, dy, c, odd = state
    # Means of equal values may differ in their last digits from batch to batch.
    flat = (dx <= n * (4e-16 * mx) ** 2) | (dy <= n * (4e-16 * my) ** 2) | (n < 2)
    with np.errstate(divide="ignore", invalid="ignore"):
        r = np.where(flat, 0.0, c / (np.sqrt(dx) * np.sqrt(dy)))
    return np.where(odd > 0, np.nan, r)


def _row(i: int, j: int, part: int, state: np.ndarray) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary())
    columns = [pa.array([v], k) for v, k in zip((i, j, part, state.astype("<f8").tobytes()), kinds)]
    return pa.RecordBatch.from_arrays(columns, names=["i", "j", "part", "state"])


def _unpacked(state: bytes, i: int, j: int, n: int, width: int) -> np.ndarray:
    shape = (min(width, n - i * width), min(width, n - j * width))
    return np.frombuffer(state, "<f8").reshape(_PLANES, *shape)
