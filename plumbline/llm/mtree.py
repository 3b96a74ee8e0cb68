"""Exact top-k inner products with paged M-trees.

Components become integers, ``floor(scale * x)``.  Appending ``sqrt(m**2 - |x|**2)``
to each candidate and 0 to each query (m: the largest norm) turns the largest inner
product into the smallest Euclidean distance, a metric in which the tree prunes.

The top level is a bounded set of routing objects; each candidate belongs to the
cell of the nearest one, and a cell is cut into pages of bounded size, so a vector
that a third of all rows share fills many pages and not one task.  A page is one
row: leaf nodes with routing object, covering radius and distance to the page's
routing object, and members with their distance to the leaf's.

A query first searches the pages of its nearest cell, which bounds its k-th
distance.  It then goes to the other cells whose ball can hold something as near.
Within a page the leaves are taken best first; stored distances rule out leaves and
members by the triangle inequality before any distance to them is computed.
Bounds have a slack for rounding and keep ties, scores are exact integers.

Vectors that are null, empty or hold a null or non-finite component, and rows with
a null id, take no part.  A query meets candidates of its own length only and never
rows with its own id; repeated rows are candidates each, repeated queries are
answered once.  Ties go to the smaller id.  An empty table gives an empty result.  Other
columns are ignored, whatever their name.  Products must fit 64 bits: components whose
integers squared, times the length, pass 2**63 give wrong scores.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.plans.durable import materialise

#: Vectors per page that are aimed at, and routing objects at most.
PAGE, CELLS = 8192, 1024
#: Members of a leaf, queries searched together.
LEAF, BLOCK = 64, 256
#: Queries that meet a page in one task.
QUERIES_PER_TASK = 16_384
SLACK = 1e-6


def prepare(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """``vec_id, dim, v`` (array of bigint) of the rows that take part."""
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("bigint"))
    return vectors.where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & sound).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.size("embedding").alias("dim"), whole.alias("v")
    )


def _matrix(column, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), np.int64).reshape(-1, dim)


def _lift(x: np.ndarray, largest: float) -> np.ndarray:
    """Candidates with the coordinate that gives all of them the same norm."""
    x = x.astype(np.float64)
    return np.c_[x, np.sqrt(np.maximum(largest**2 - (x * x).sum(1), 0))]


def _pack(**arrays) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def build_page(ids: np.ndarray, x: np.ndarray, largest: float) -> bytes:
    """A page: members in leaf order, leaves, and the distances that are kept."""
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    y = _lift(x, largest)
    n = len(ids)
    centre = y[int(((y - y.mean(0)) ** 2).sum(1).argmin())]
    seeds = y[np.linspace(0, n - 1, max(1, -(-n // LEAF))).astype(int)]
    near = np.concatenate([((part**2).sum(1)[:, None] - 2 * part @ seeds.T + (seeds**2).sum(1)).argmin(1) for part in np.array_split(y, -(-n // 1024))])
    order = np.argsort(near, kind="stable")
    ids, x, y, near = ids[order], x[order], y[order], near[order]
    first = np.flatnonzero(np.r_[True, near[1:] != near[:-1]])
    within = np.arange(n) - np.repeat(first, np.diff(np.r_[first, n]))
    starts = np.flatnonzero(within % LEAF == 0)
    ends = np.r_[starts[1:], n]
    leaf = np.repeat(np.arange(len(starts)), ends - starts)
    routing = np.array([s + int(((y[s:e] - y[s:e].mean(0)) ** 2).sum(1).argmin()) for s, e in zip(starts, ends)])
    to_routing = np.sqrt(((y - y[routing][leaf]) ** 2).sum(1))
    to_centre = np.sqrt(((y[routing] - centre) ** 2).sum(1))
    radius = np.maximum.reduceat(to_routing, starts)
    return _pack(ids=ids, x=x, starts=starts, ends=ends, routing=routing, radius=radius, to_routing=to_routing,
                 to_centre=to_centre, centre=centre[:-1], largest=np.array([largest]))


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact row-wise inner products."""
    return np.einsum("ij,ij->i", a, b)


def search_page(page: bytes, q: np.ndarray, own: np.ndarray, worst: np.ndarray, k: int):
    """``query index, vec_id, score`` of the page's best k for each query.

    ``worst``: a score that k candidates elsewhere reach, below which nothing is needed.
    """
    p = np.load(io.BytesIO(page))
    ids, x, largest = p["ids"], p["x"], float(p["largest"][0])
    for start in range(0, len(q), BLOCK):
        part = slice(start, start + BLOCK)
        rows, vec, score = _search_block(p, ids, x, largest, q[part], own[part], worst[part], k)
        yield rows + start, vec, score


def _search_block(p, ids, x, largest, q, own, worst, k):
    starts, ends, routing, radius, to_routing = (p[n] for n in ("starts", "ends", "routing", "radius", "to_routing"))
    qf = q.astype(np.float64)
    norm2 = (qf * qf).sum(1) + largest**2
    slack = SLACK * (np.sqrt(norm2) + 1)
    distance = lambda dots, of: np.sqrt(np.maximum(norm2[of] - 2 * dots, 0))
    everyone = np.arange(len(q))
    tau = np.where(np.isfinite(worst), distance(np.where(np.isfinite(worst), worst, 0), everyone), np.inf)
    best = np.empty((0, 3), np.int64)
    to_page = distance(qf @ p["centre"], everyone)
    by_parent = np.abs(to_page[:, None] - p["to_centre"]) - radius
    needed = (by_parent <= (tau + slack)[:, None]).any(0)
    to_leaf = np.full(by_parent.shape, np.inf)
    to_leaf[:, needed] = np.sqrt(np.maximum(norm2[:, None] - 2 * qf @ x[routing[needed]].T.astype(np.float64), 0))
    bound = np.where(needed, np.maximum(to_leaf - radius, by_parent), np.inf)
    order = np.argsort(bound, axis=1, kind="stable")
    for step in range(order.shape[1]):
        leaf = order[:, step]
        active = np.flatnonzero(bound[everyone, leaf] <= tau + slack)
        if not len(active):
            break
        leaf = leaf[active]
        size = ends[leaf] - starts[leaf]
        of = np.repeat(active, size)
        member = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(starts[leaf], size)
        apart = np.abs(np.repeat(to_leaf[active, leaf], size) - to_routing[member])
        go = (apart <= tau[of] + slack[of]) & (ids[member] != own[of])
        of, member = of[go], member[go]
        best = np.concatenate([best, np.c_[of, _dot(q[of], x[member]), ids[member]]])
        best = best[np.lexsort((best[:, 2], -best[:, 1], best[:, 0]))]
        first = np.flatnonzero(np.r_[True, best[1:, 0] != best[:-1, 0]]) if len(best) else np.empty(0, int)
        place = np.arange(len(best)) - np.repeat(first, np.diff(np.r_[first, len(best)]))
        best = best[place < k]
        kth = best[place[place < k] == k - 1]
        tau[kth[:, 0]] = np.minimum(tau[kth[:, 0]], distance(kth[:, 1], kth[:, 0]))
    return best[:, 0], best[:, 2], best[:, 1]


def build(rows: DataFrame, dim: int, cells: list, largest: float) -> DataFrame:
    """Pages of the candidates of one length: cell, page, radius, tree."""
    pivots = np.array(cells, np.int64)
    lifted = _lift(pivots, largest)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                y = _lift(_matrix(batch.column("v"), dim), largest)
                d2 = (y * y).sum(1)[:, None] - 2 * y @ lifted.T + (lifted * lifted).sum(1)
                cell = d2.argmin(1)
                far = np.sqrt(((y - lifted[cell]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), batch.column("v"), pa.array(cell, pa.int32()), pa.array(far)],
                    ["vec_id", "v", "cell", "far"],
                )

    placed = materialise(rows.select("vec_id", "v").mapInArrow(assign, "vec_id long, v array<bigint>, cell int, far double"), "mtree-cells")
    cell_sizes = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / PAGE).cast("int").alias("pages"), F.max("far").alias("radius"))
    # A row's place in the stored table spreads even rows that are equal in all columns over the
    # pages of their cell; which page a row is in never shows in a result.
    spread = F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.col("pages")).cast("int")
    paged = placed.join(F.broadcast(cell_sizes), "cell").withColumn("page", spread)

    def make(table: pa.Table) -> pa.Table:
        tree = build_page(np.asarray(table.column("vec_id")), _matrix(table.column("v"), dim), largest)
        keys = {n: table.column(n)[:1].cast(t) for n, t in (("cell", pa.int32()), ("page", pa.int32()), ("radius", pa.float64()))}
        return pa.table(keys | {"tree": pa.array([tree], pa.binary())})

    pages = paged.groupBy("cell", "page").applyInArrow(make, "cell int, page int, radius double, tree binary")
    return materialise(pages, "mtree-pages")


def _search(pages: DataFrame, queries: DataFrame, dim: int, k: int) -> DataFrame:
    """``queries``: query_id, v, block, worst, cell; pages of the cell are searched for each."""
    places = pages.select("cell", "page")
    wanted = queries.join(places, "cell")
    blocks = wanted.select("cell", "page", "block").distinct()
    trees = pages.select("cell", "page", "tree").join(blocks, ["cell", "page"])
    trees = trees.select("tree", *[F.col(c).alias(f"of_{c}") for c in ("cell", "page", "block")])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query": [], "vec_id": [], "score": []}
        if left.num_rows and right.num_rows:
            q, own = _matrix(right.column("v"), dim), np.asarray(right.column("query_id"))
            worst = np.asarray(right.column("worst").to_numpy(zero_copy_only=False), np.float64)
            for at, vec, score in search_page(left.column("tree")[0].as_py(), q, own, worst, k):
                out["query"].append(at)
                out["vec_id"].append(vec)
                out["score"].append(score)
        joined = {n: np.concatenate(v) if v else np.empty(0, np.int64) for n, v in out.items()}
        at = joined["query"].astype(np.int64)
        return pa.table(
            {
                "query_id": right.column("query_id").take(at),
                "v": right.column("v").take(at),
                "vec_id": joined["vec_id"].astype(np.int64),
                "score": joined["score"].astype(np.int64),
            }
        )

    return (
        trees.groupBy("of_cell", "of_page", "of_block")
        .cogroup(wanted.groupBy("cell", "page", "block"))
        .applyInArrow(run, "query_id long, v array<bigint>, vec_id long, score long")
    )


def _top(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id", "v").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest integer inner products of each query."""
    rows = materialise(prepare(vectors, scale), "mtree-vectors")
    asked = materialise(prepare(queries, scale).distinct(), "mtree-queries")
    out = None
    for dim, n, largest in _lengths(rows):
        one = _one_length(rows.where(F.col("dim") == dim), asked.where(F.col("dim") == dim), dim, n, largest, k)
        out = one if out is None else out.unionByName(one)
    if out is None:
        out = rows.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score"))
    return out


def _lengths(rows: DataFrame) -> list[tuple[int, int, float]]:
    """Vector lengths that occur, with count and largest norm: a handful of rows."""
    norm2 = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    found = rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.max(norm2)).alias("m")).collect()
    return sorted((r["dim"], r["n"], r["m"]) for r in found)


def _one_length(rows: DataFrame, asked: DataFrame, dim: int, n: int, largest: float, k: int) -> DataFrame:
    n_cells = min(CELLS, -(-n // PAGE))
    picked = rows.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(n_cells).collect()
    cells = [r["v"] for r in picked]
    pages = build(rows, dim, cells, largest)
    radius = dict(pages.groupBy("cell").agg(F.max("radius")).collect())
    have = np.array(sorted(radius))
    pivots = np.array(cells, np.int64)[have].astype(np.float64)
    reach = np.array([radius[c] for c in have])

    def distances(q: np.ndarray) -> np.ndarray:
        qf = q.astype(np.float64)
        return np.sqrt(np.maximum((qf * qf).sum(1)[:, None] + largest**2 - 2 * qf @ pivots.T, 0))

    def route(first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                q = _matrix(batch.column("v"), dim)
                d = distances(q)
                home = d.argmin(1)
                if first:
                    chosen = [[int(have[h])] for h in home]
                else:
                    qf2 = (q.astype(np.float64) ** 2).sum(1) + largest**2
                    worst = np.asarray(batch.column("worst").to_numpy(zero_copy_only=False), np.float64)
                    tau = np.where(np.isnan(worst), np.inf, np.sqrt(np.maximum(qf2 - 2 * np.nan_to_num(worst), 0)))
                    open_ = d - reach <= (tau + SLACK * (np.sqrt(qf2) + 1))[:, None]
                    open_[np.arange(len(q)), home] = False
                    chosen = [have[np.flatnonzero(o)].tolist() for o in open_]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("query_id"), batch.column("v"), batch.column("block"), batch.column("worst"), pa.array(chosen, pa.list_(pa.int32()))],
                    ["query_id", "v", "block", "worst", "cells"],
                )

        return run

    schema = "query_id long, v array<bigint>, block int, worst double, cells array<int>"
    n_blocks = max(1, -(-asked.count() // QUERIES_PER_TASK))
    block = F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)).cast("int").alias("block")
    start = asked.select(F.col("vec_id").alias("query_id"), "v", block, F.lit(None).cast("double").alias("worst"))
    spread = lambda df: df.select("query_id", "v", "block", "worst", F.explode("cells").alias("cell"))
    near = materialise(_search(pages, spread(start.mapInArrow(route(True), schema)), dim, k), "mtree-near")
    kth = _top(near, k).where(F.col("rank") == k).select("query_id", "v", F.col("score").cast("double").alias("_worst"))
    known = start.join(kth, ["query_id", "v"], "left").select("query_id", "v", "block", F.col("_worst").alias("worst"))
    far = _search(pages, spread(known.mapInArrow(route(False), schema)), dim, k)
    return _top(near.unionByName(far), k).select("query_id", "rank", "vec_id", "score")
