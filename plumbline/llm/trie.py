"""Prefix trie of conversations: what a cache of shared prefixes would save.

A node is a distinct sequence of first turns.  Its key is a polynomial digest of them
(four lanes modulo a prime), which sums up in any order of partitions: turns are range
sorted, summed per partition, and shifted by the sums of the partitions before, so even a
conversation that holds a third of all turns spreads over many tasks.  Grouping by key
enumerates the nodes; rows of one key that differ in depth, parent or turn end the job.

Nodes of one conversation need no table: their figures are closed forms.  Runs of nodes
with the same conversations are one entry.  The entries of a shard get slots by a minimal
perfect hash of their key (``mphf.py``), compared on lookup; their counts are scattered
into flat arrays and added up through an array of parent slots, deepest entries first.
The root and nodes with more than ``limit`` conversations, the square root of all rows or
more, are heavy.  There are at most rows / ``limit`` + 1 of them, so they are broadcast and
make a table of their own; a shard holds the light subtrees below them, each of ``limit``
conversations at most.  No step depends on the depth of the trie.

Turns are ordered by ``turn`` (null first); ties by a SHA-256 of role and text, so repeated
rows are turns each and their order does not matter.  Null role or text is empty.  Rows
without ``conv_id`` take no part.  Very long texts enter as digests and byte counts.  No
conversations give no rows, not even a root.  Other columns are ignored, whatever their name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.mphf import PerfectTable
from plumbline.plans.durable import materialise

#: Conversations that share a base, and the turns of it that are taken at most, plus one.
FAMILY, HEADS = 5, 9
PRIME = (1 << 31) - 1
#: Bases of the four lanes.
BASES = (1_103_515_245, 1_664_525_113, 1_013_904_223, 1_406_932_607)
LANES = range(len(BASES))
#: Entries that a shard aims at, the least limit for heavy nodes, and turns that a join meets at a time.
SHARD_ENTRIES, LEAST_LIMIT, BLOCK = 1 << 14, 256, 4096
#: Bytes of ids that a piece of a long list of ends aims at.
PIECE_BYTES = 64 << 10

KEY, PARENT = ["k1", "k2"], ["p1", "p2"]


def _s(prefix: str) -> list[str]:
    return [f"{prefix}{i}" for i in LANES]


def _key(lanes: list[Column], names: list[str]) -> list[Column]:
    """Two 62-bit integers from four lanes."""
    return [(F.shiftleft(lanes[2 * i], 31) + lanes[2 * i + 1]).alias(n) for i, n in enumerate(names)]


@lru_cache(maxsize=1)
def _powers() -> list[tuple[np.ndarray, np.ndarray]]:
    """For each base, its powers below 2**16 and those of multiples of 2**16."""

    def row(base: int) -> np.ndarray:
        found = np.ones(1, np.int64)
        while len(found) < 1 << 16:
            found = np.r_[found, found * pow(base, len(found), PRIME) % PRIME]
        return found

    return [(row(b), row(pow(b, 1 << 16, PRIME))) for b in BASES]


def _power(lane: int, exponent: np.ndarray) -> np.ndarray:
    low, high = _powers()[lane]
    return low[exponent & 0xFFFF] * high[exponent >> 16] % PRIME


def turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn``, lanes of the turn's digest, and the bytes of its text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long"), "turn", F.octet_length(text).cast("long").alias("bytes"), digest.alias("digest")
    )
    lanes = [F.conv(F.substring("digest", 1 + 7 * i, 7), 16, 10).cast("long").alias(f"t{i}") for i in LANES]
    return rows.select("conv_id", "turn", *lanes, "bytes")


def summed(rows: DataFrame) -> DataFrame:
    """Add to ``turns``: place ``pos`` from 1, prefix digests with (``s``) and without (``q``) the turn, bytes up to it (``w``)."""
    # The row's number lets rows that are equal in all else spread over partitions.
    order = ["conv_id", "turn", *_s("t"), "row"]
    ordered = rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    names = ["conv_id", *_s("t"), "bytes", "part", "pos", *_s("s"), *_s("q"), "w"]
    local = materialise(ordered.drop("turn", "row").mapInArrow(_scan(names), ", ".join(f"{n} bigint" for n in names)), "trie-sums")

    last = F.max_by(F.struct("pos", *_s("s"), "w"), F.struct("conv_id", "pos")).alias("last")
    parts = local.groupBy("part").agg(F.min("conv_id").alias("first"), F.max("conv_id").alias("end"), last)
    carried, before = [], None
    for part in sorted(parts.collect(), key=lambda r: r.part):
        pos, w, lanes, end = 0, 0, [0] * len(BASES), None
        if before and before[0] == part.first:
            end, pos, w, lanes = before
        shifts = [pow(b, pos, PRIME) for b in BASES]
        carried.append((part.part, part.first, pos, w, *lanes, *shifts))
        if part.first != part.end:
            pos, w, lanes, shifts = 0, 0, [0] * len(BASES), [1] * len(BASES)
        sums = [(lanes[i] + part.last[f"s{i}"] * shifts[i]) % PRIME for i in LANES]
        before = (part.end, pos + part.last.pos, w + part.last.w, sums)

    schema = ", ".join(f"{n} bigint" for n in ["part_", "first", "pos_", "w_", *_s("c"), *_s("x")])
    carry = F.broadcast(rows.sparkSession.createDataFrame(carried, schema))
    met = local.join(carry, (F.col("part") == F.col("part_")) & (F.col("conv_id") == F.col("first")), "left")
    moved = lambda name, i: F.when(F.col("first").isNull(), F.col(f"{name}{i}")).otherwise(
        (F.col(f"c{i}") + F.col(f"{name}{i}") * F.col(f"x{i}")) % PRIME
    )
    return met.select(
        "conv_id",
        *_s("t"),
        "bytes",
        (F.col("pos") + F.coalesce("pos_", F.lit(0))).alias("pos"),
        *[moved(n, i).alias(f"{n}{i}") for n in "sq" for i in LANES],
        (F.col("w") + F.coalesce("w_", F.lit(0))).alias("w"),
    )


def _scan(names: list[str]):
    """Sums along the conversations of a sorted partition, from batch to batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, open_conv, open_pos, open_w = TaskContext.get().partitionId(), None, 0, 0
        open_s = [0] * len(BASES)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            get = lambda c, batch=batch: batch.column(c).to_numpy(zero_copy_only=False)
            conv, at = get("conv_id"), np.arange(n)
            starts = np.r_[conv[0] != open_conv, conv[1:] != conv[:-1]]
            first = np.maximum.accumulate(np.where(starts, at, 0))
            goes_on = np.cumsum(starts) == 0
            out = {"conv_id": conv, "bytes": get("bytes"), "part": np.full(n, part)}
            out["pos"] = at - first + 1 + goes_on * open_pos

            def along(values, carry, first=first, goes_on=goes_on):
                sums = np.cumsum(values)
                return sums - (sums[first] - values[first]) + goes_on * carry

            out["w"] = along(out["bytes"], open_w)
            for i in LANES:
                out[f"t{i}"] = get(f"t{i}")
                value = out[f"t{i}"] * _power(i, out["pos"]) % PRIME
                out[f"s{i}"] = along(value, open_s[i]) % PRIME
                out[f"q{i}"] = (out[f"s{i}"] - value) % PRIME
            open_conv, open_pos, open_w = conv[-1], int(out["pos"][-1]), int(out["w"][-1])
            open_s = [int(out[f"s{i}"][-1]) for i in LANES]
            yield pa.RecordBatch.from_arrays([pa.array(out[c], pa.int64()) for c in names], names=names)

    return run


def plan_rebuilt(rows: DataFrame) -> DataFrame:
    """One row per conversation: which turns of its base and of its own it is made of (from ``summed``)."""
    head = F.when(F.col("pos") < HEADS, F.struct("pos", *_s("t"), "bytes", *_s("s"), *_s("q"), "w"))
    own = rows.groupBy("conv_id").agg(F.max("pos").alias("n"), F.sort_array(F.collect_list(head)).alias("heads"))
    base = own.select(F.col("conv_id").alias("base"), F.col("heads").alias("base_heads"))
    c = F.col("conv_id")
    # The first of a family takes nothing, but it looks for itself: nulls would all meet in one task.
    own = own.withColumn("_base", c - c % FAMILY)
    drawn = F.when(c % FAMILY == 0, F.lit(0)).otherwise(F.crc32(c.cast("string").cast("binary")) % HEADS).cast("int")
    plan = own.withColumn("h", drawn).join(base, F.col("_base") == F.col("base"), "left")
    taken = F.least("h", F.coalesce(F.size("base_heads"), F.lit(0))).cast("int")
    plan = plan.withColumn("m", taken).withColumn("from_base", F.slice("base_heads", 1, F.col("m")))
    zero = F.lit(0).cast("long")
    last = lambda heads, at, name: F.when(at > 0, F.try_element_at(heads, at).getField(name)).otherwise(zero)
    return plan.select(
        "conv_id",
        "n",
        "h",
        "m",
        "from_base",
        (F.col("m") + F.greatest(F.col("n") - F.col("h"), zero)).alias("len"),
        *[last(F.col("heads"), F.col("h"), f).alias(f"own_{f}") for f in [*_s("s"), "w"]],
        *[last(F.col("base_heads"), F.col("m"), f).alias(f"base_{f}") for f in [*_s("s"), "w"]],
    )


def rebuilt(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """One row per conversation and turn: depth, key and parent's key, digest and bytes of the turn, bytes up to it."""

    def shaped(df: DataFrame, depth: Column, lane, w: Column) -> DataFrame:
        keys = [c for name, names in (("s", KEY), ("q", PARENT)) for c in _key([lane(name, i) for i in LANES], names)]
        same = _key([F.col(f"t{i}") for i in LANES], ["t_a", "t_b"])
        return df.select("conv_id", depth.cast("long").alias("depth"), *keys, *same, "bytes", w.alias("w"), (depth == F.col("len")).alias("ends"))

    heads = plan.where("m > 0").select("conv_id", "len", F.inline("from_base"))
    heads = shaped(heads, F.col("pos"), lambda name, i: F.col(f"{name}{i}"), F.col("w"))

    # A long conversation meets its plan block by block.
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"n div {BLOCK}"))).alias("block")
    plans = plan.where("n > h").drop("from_base").select(F.col("conv_id").alias("of"), *plan.drop("from_base", "conv_id").columns, blocks)
    own = rows.join(plans, (F.col("conv_id") == F.col("of")) & (F.expr(f"pos div {BLOCK}") == F.col("block"))).where("pos > h")
    back = [F.array(*[F.lit(pow(b, -i, PRIME)) for i in range(HEADS)]) for b in BASES]
    moved = lambda name, i: F.pmod(
        F.col(f"base_s{i}") + F.pmod(F.col(f"{name}{i}") - F.col(f"own_s{i}"), F.lit(PRIME)) * F.get(back[i], F.col("h") - F.col("m")),
        F.lit(PRIME),
    )
    depth = F.col("pos") - F.col("h") + F.col("m")
    own = shaped(own, depth, moved, F.col("base_w") + F.col("w") - F.col("own_w"))
    return heads.unionByName(own)


def enumerate_nodes(paths: DataFrame, plan: DataFrame) -> DataFrame:
    """Distinct keys with their counts, and the root."""
    what = F.struct("depth", *PARENT, "t_a", "t_b", "bytes", "w")
    found = paths.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n_convs"),
        F.min("conv_id").alias("conv_id"),
        F.min(what).alias("lo"),
        F.max(what).alias("hi"),
    )
    clash = F.raise_error(F.lit("two different prefixes have one digest"))
    depth = F.when(F.col("lo") == F.col("hi"), F.col("lo.depth")).otherwise(clash.cast("long"))
    nodes = found.select(*KEY, "n_convs", "conv_id", depth.alias("depth"), *[f"lo.{c}" for c in [*PARENT, "bytes", "w"]])
    zero, null = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = plan.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0")
    root = root.select(*[zero.alias(k) for k in KEY], "n_convs", "conv_id", zero.alias("depth"), *[null.alias(p) for p in PARENT])
    return nodes.unionByName(root.select("*", zero.alias("bytes"), zero.alias("w")))


def accumulate(batch: pa.Table) -> pa.Table:
    """Leaves and saved bytes of the entries of one shard, by a table of slots."""
    get = lambda c: batch.column(c).to_numpy()
    table = PerfectTable(get("k1"), get("k2"))
    slot, size = table.slots(get("k1"), get("k2")), len(table)
    parent, depth, leaves, saved = np.full(size, -1, np.int64), *(np.zeros(size, np.int64) for _ in range(3))
    has_parent = np.asarray(batch.column("p1").is_valid())
    up = table.slots(*(pc.fill_null(batch.column(p), 0).to_numpy() for p in PARENT))
    parent[slot] = np.where(has_parent, up, -1)
    depth[slot], leaves[slot], saved[slot] = get("depth"), get("leaves"), get("saved")
    order = np.argsort(-depth, kind="stable")
    levels = np.flatnonzero(np.r_[True, np.diff(depth[order]) != 0, True]) if size else []
    for start, end in zip(levels[:-1], levels[1:]):
        now = order[start:end]
        now = now[parent[now] >= 0]
        np.add.at(leaves, parent[now], leaves[now])
        np.add.at(saved, parent[now], saved[now])
    done = {"leaves": leaves[slot], "saved": saved[slot], "inside": parent[slot] >= 0}
    kept = ["conv_id", "n_convs", *PARENT, "before", "low", "high"]
    return pa.table([batch.column(c) for c in kept] + [pa.array(v) for v in done.values()], names=[*kept, *done])


_ENTRY = "conv_id bigint, n_convs bigint, p1 bigint, p2 bigint, before bigint, low bigint, high bigint, leaves bigint, saved bigint, inside boolean"


def prefix_trie(conversations: DataFrame, shard_entries: int = SHARD_ENTRIES, least_limit: int = LEAST_LIMIT) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    rows = materialise(summed(materialise(turns(conversations), "trie-turns")), "trie-turns")
    plan = materialise(plan_rebuilt(rows), "trie-plan")
    paths = materialise(rebuilt(rows, plan), "trie-paths")
    nodes = materialise(enumerate_nodes(paths, plan), "trie-nodes")
    total = nodes.agg(F.coalesce(F.sum("n_convs"), F.lit(0))).first()[0]
    limit = max(least_limit, isqrt(total))
    heavy = nodes.where((F.col("n_convs") > limit) | (F.col("depth") == 0))

    children = nodes.where("depth > 0").groupBy(*[F.col(p).alias(f"c_{p}") for p in PARENT])
    children = children.agg(F.count(F.lit(1)).alias("n_children"), F.count_if(F.col("n_convs") == 1).alias("n_single"))
    known = nodes.join(children, [F.col(k) == F.col(f"c_{p}") for k, p in zip(KEY, PARENT)], "left")
    known = known.drop("c_p1", "c_p2").fillna(0, ["n_children", "n_single"])
    known = materialise(_with_parents(known, nodes, heavy, limit), "trie-known")

    entries = known.where("n_convs > 1").groupBy("conv_id", "n_convs").agg(
        F.min_by(F.struct("depth", *PARENT, (F.col("w") - F.col("bytes")).alias("before")), "depth").alias("top"),
        F.max_by(F.struct("depth", *KEY, "n_children", "n_single", "w"), "depth").alias("bottom"),
    )
    entries = entries.select(
        "conv_id",
        "n_convs",
        *[f"bottom.{k}" for k in KEY],
        *[f"top.{c}" for c in ["depth", *PARENT, "before"]],
        F.col("top.depth").alias("low"),
        F.col("bottom.depth").alias("high"),
        (F.col("bottom.n_single") + (F.col("bottom.n_children") == 0).cast("long")).alias("leaves"),
        ((F.col("n_convs") - 1) * (F.col("bottom.w") - F.col("top.before"))).alias("saved"),
    )
    entries = materialise(entries, "trie-entries")
    figures = _figures(entries, paths, heavy, limit, shard_entries)
    blocks = F.explode(F.sequence(F.expr(f"low div {BLOCK}"), F.expr(f"high div {BLOCK}"))).alias("block")
    figures = figures.select(F.col("conv_id").alias("e_conv"), F.col("n_convs").alias("e_n"), "before", "leaves", "saved", blocks)
    same = (F.col("conv_id") == F.col("e_conv")) & (F.col("n_convs") == F.col("e_n")) & (F.expr(f"depth div {BLOCK}") == F.col("block"))
    above = F.col("w") - F.col("bytes") - F.col("before")
    shared = known.where("n_convs > 1").join(figures, same)
    shared = shared.withColumns({"n_leaves": F.col("leaves"), "saved_tokens": F.col("saved") - (F.col("n_convs") - 1) * above})
    alone = known.where("n_convs = 1").withColumns({"n_leaves": F.lit(1).cast("long"), "saved_tokens": F.lit(0).cast("long")})
    columns = [*KEY, "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    result = shared.select(*columns).unionByName(alone.select(*columns))

    ends = ends_digests(_ends(paths, plan))
    result = result.join(ends, KEY, "left").drop(*KEY)
    return result.fillna({"ends_sha256": hashlib.sha256(b"").hexdigest()})


def _with_parents(known: DataFrame, nodes: DataFrame, heavy: DataFrame, limit: int) -> DataFrame:
    """Add the parent's conversation.  A parent of more than ``limit`` children is heavy, so no key of the join is hot."""
    up = [F.col("conv_id").alias("parent_conv_id"), *[F.col(k).alias(f"u_{k}") for k in KEY]]
    on = [F.col(p) == F.col(f"u_{k}") for p, k in zip(PARENT, KEY)]
    tops = F.broadcast(heavy.select(*up))
    light = known.where("depth > 0").join(tops, on, "left_anti").join(nodes.where(F.col("n_convs") <= limit).select(*up), on)
    root = known.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))
    return known.join(tops, on).unionByName(light).drop("u_k1", "u_k2").unionByName(root)


def _figures(entries: DataFrame, paths: DataFrame, heavy: DataFrame, limit: int, shard_entries: int) -> DataFrame:
    """Leaves and saved bytes of every entry: shards of light subtrees first, then the heavy nodes above them."""
    top = paths.join(F.broadcast(heavy.select(*KEY)), KEY, "left_anti").groupBy(F.col("conv_id").alias("of"))
    top = top.agg(F.min(F.struct("depth", *KEY)).alias("root"))
    is_heavy = (F.col("n_convs") > limit) | (F.col("low") == 0)
    light = entries.where(~is_heavy).join(top, F.col("conv_id") == F.col("of"), "left")
    shards = 1 + entries.count() // shard_entries
    shard = F.pmod(F.xxhash64("root.k1", "root.k2"), F.lit(shards))
    light = light.withColumn("shard", shard).drop("of", "root")
    light = materialise(light.groupBy("shard").applyInArrow(accumulate, _ENTRY), "trie-light")

    given = light.where("NOT inside AND p1 IS NOT NULL").groupBy(*[F.col(p).alias(f"g_{p}") for p in PARENT])
    given = given.agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
    above = entries.where(is_heavy)
    above = above.join(given, [F.col(k) == F.col(f"g_{p}") for k, p in zip(KEY, PARENT)], "left").fillna(0, ["more_leaves", "more_saved"])
    above = above.withColumns({n: F.col(n) + F.col(f"more_{n}") for n in ("leaves", "saved")})
    above = above.drop("more_leaves", "more_saved", "g_p1", "g_p2").withColumn("shard", F.lit(0))
    return light.unionByName(above.groupBy("shard").applyInArrow(accumulate, _ENTRY))


def _ends(paths: DataFrame, plan: DataFrame) -> DataFrame:
    """The node at which each conversation ends."""
    zero = F.lit(0).cast("long")
    return paths.where("ends").select(*KEY, "conv_id").unionByName(
        plan.where("len = 0").select(*[zero.alias(k) for k in KEY], "conv_id")
    )


def ends_digests(ends: DataFrame) -> DataFrame:
    """SHA-256 of the ids that end at each node, in order, joined by commas.

    Sorted ranges turn ids into pieces of text, wherever a node's ids lie; then the few
    pieces of a node are read in order, one at a time.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, size = None, [], 0

        def flush():
            text = ",".join(map(str, ids)).encode()
            return pa.RecordBatch.from_arrays(
                [pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()), pa.array([ids[0]], pa.int64()), pa.array([text], pa.binary())],
                names=[*KEY, "first", "text"],
            )

        for batch in batches:
            for k1, k2, conv in zip(*(batch.column(c).to_pylist() for c in [*KEY, "conv_id"])):
                if ids and ((k1, k2) != key or size >= PIECE_BYTES):
                    yield flush()
                    ids, size = [], 0
                key = (k1, k2)
                ids.append(conv)
                size += len(str(conv)) + 1
        if ids:
            yield flush()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, found = None, None
        for batch in batches:
            out: list[tuple] = []
            for k1, k2, text in zip(*(batch.column(c).to_pylist() for c in [*KEY, "text"])):
                if (k1, k2) == key:
                    found.update(b",")
                else:
                    if found:
                        out.append((*key, found.hexdigest()))
                    key, found = (k1, k2), hashlib.sha256()
                found.update(text)
            yield _digest_rows(out)
        if found:
            yield _digest_rows([(*key, found.hexdigest())])

    sorted_ends = ends.repartitionByRange(*KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id")
    parts = sorted_ends.mapInArrow(pieces, "k1 bigint, k2 bigint, first bigint, text binary")
    together = parts.repartition(*KEY).sortWithinPartitions(*KEY, "first")
    return together.mapInArrow(digests, "k1 bigint, k2 bigint, ends_sha256 string")


def _digest_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[], [], []]
    kinds = (pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[*KEY, "ends_sha256"])
