"""Near-duplicates by SimHash with covering locality-sensitive hashing.

A document's fingerprint has a bit where more than half of the 64-bit hashes of its
word shingles have it.  Fingerprints are linked at ``RADIUS`` or fewer differing
bits.  Covering hashing finds every such pair: each bit position gets a vector of
``RADIUS + 1`` bits, and there is a mask for each of the ``2**(RADIUS + 1) - 1``
non-zero vectors, made of the positions at odd inner product with it.  Fewer than
``RADIUS + 1`` differing positions leave some non-zero vector orthogonal to all of
them, and under its mask the two fingerprints are equal.

Equal fingerprints are one class before any pair is looked at.  Each class goes to
one bucket per mask; a bucket that many classes share is divided again by the masks
of the other positions, with the same guarantee.  A bucket yields at most one link
per member, to the smallest member that it is connected with inside the bucket.

Null or empty text has fingerprint zero and is linked like any other; very long texts
are read whole; a bit that half of the hashes have, a tie, is 0; repeated rows share a class; null ids are kept and never name a component unless all are null; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from plumbline.llm.graph import components
from plumbline.llm.text import map_texts, packed, unpacked
from plumbline.plans.durable import materialise

SHINGLE, RADIUS, SEED = 4, 4, 42
#: A bucket of more classes is divided by a second set of masks.
LARGE = 256
#: Classes that are compared at once inside a bucket.
BLOCK = 1024
#: Shingle hashes that are counted at once.
COUNTED = 1 << 15


def fingerprint(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of a text: ASCII letters in lower case, words joined by spaces; 0 without words."""
    found = (text or b"").lower().split()
    if not found:
        return 0
    whole = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    n = max(1, len(found) - shingle + 1)
    ends = ends[shingle - 1 :] if len(found) >= shingle else ends[-1:]
    ones, a, b = np.zeros(64, np.int64), starts[:n].tolist(), ends.tolist()
    for k in range(0, n, COUNTED):
        hashes = [xxh64_intdigest(whole[i:j], seed) for i, j in zip(a[k : k + COUNTED], b[k : k + COUNTED])]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * ones > n).tolist())


def fingerprints(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), shingle: int = SHINGLE) -> DataFrame:
    """``keep`` columns and ``fp`` (the fingerprint's bits as a bigint)."""
    given = docs.select(*[docs[c].alias(f"k_{c}") for c in keep], docs["text"].alias("_text"))
    kinds = {f.name: f.dataType.simpleString() for f in given.schema}

    def run(batch) -> dict:
        prints = np.array([fingerprint(t, shingle) for t in batch.column("_text").to_pylist()], np.uint64)
        return {f"k_{c}": batch.column(f"k_{c}") for c in keep} | {"fp": prints.view(np.int64)}

    schema = ", ".join([*(f"`k_{c}` {kinds[f'k_{c}']}" for c in keep), "fp bigint"])
    return map_texts(given, "_text", run, schema).withColumnsRenamed({f"k_{c}": c for c in keep})


def masks(positions: list[int], radius: int = RADIUS) -> list[int]:
    """Covering masks over some bit positions, as signed 64-bit numbers.

    The position vectors run through all non-zero vectors in turn, so the masks have
    nearly equal weight; any choice of vectors covers.
    """
    vectors = 2 ** (radius + 1) - 1
    out = []
    for v in range(1, vectors + 1):
        mask = sum(1 << p for i, p in enumerate(positions) if bin((i * 7 % vectors + 1) & v).count("1") % 2)
        out.append(mask - (1 << 64) if mask >> 63 else mask)
    return out


def _buckets(fps: DataFrame, of: list[int], keys: list[str]) -> DataFrame:
    """A row per fingerprint and mask: ``table``, ``bucket`` and what identified it before."""
    table = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(m).alias("m")) for i, m in enumerate(of)])).alias("t")
    rows = fps.select("fp", *keys, table)
    return rows.select("fp", *keys, F.col("t.i").alias("table"), F.col("fp").bitwiseAND(F.col("t.m")).alias("bucket"))


def _divided(large: DataFrame, first: list[int], radius: int) -> DataFrame:
    """Rows of large buckets once more, by the masks of the positions their mask leaves out."""
    of = [masks([p for p in range(64) if not m >> p & 1], radius) for m in first]
    lists = F.array(*[F.array(*map(F.lit, ms)) for ms in of])
    rows = large.select("fp", "table", "bucket", F.posexplode(F.element_at(lists, F.col("table") + 1)).alias("table2", "m"))
    return rows.select("fp", "table", "bucket", "table2", F.col("fp").bitwiseAND(F.col("m")).alias("bucket2"))


def _near(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64)) <= radius


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index connected with each of ``n`` by the pairs ``a, b``."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        while (new[new] != new).any():
            new = new[new]
        new = new[root]
        if (new == root).all():
            break
        root = new
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    return root


def _links(group: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside runs of equal ``group``: each member to the smallest one of its part."""
    ends = np.flatnonzero(np.r_[group[1:] != group[:-1], True]) + 1
    end = np.repeat(ends, np.diff(np.r_[0, ends]))
    at, pairs_a, pairs_b = np.arange(len(fp)), [], []
    for step in range(1, min(LARGE, int(np.diff(np.r_[0, ends]).max())) + 1):
        left = at[at + step < end]
        if not len(left):
            break
        near = left[_near(fp[left], fp[left + step], radius)]
        pairs_a.append(near)
        pairs_b.append(near + step)
    for start, stop in zip(np.r_[0, ends[:-1]], ends):
        if stop - start > LARGE:
            for i in range(start, stop, BLOCK):
                one = fp[i : min(i + BLOCK, stop)]
                for j in range(i, stop, BLOCK):
                    other = fp[j : min(j + BLOCK, stop)]
                    x, y = np.nonzero(_near(one[:, None], other[None, :], radius))
                    # Only what a spanning forest of the block pair needs is kept.
                    root = _roots(len(one) + len(other), x, y + len(one))
                    node = np.flatnonzero(root != np.arange(len(root)))
                    place = lambda k, i=i, j=j, n=len(one): np.where(k < n, i + k, j + k - n)
                    pairs_a.append(place(node))
                    pairs_b.append(place(root[node]))
    a = np.concatenate(pairs_a) if pairs_a else np.empty(0, int)
    b = np.concatenate(pairs_b) if pairs_b else np.empty(0, int)
    root = _roots(len(fp), a, b)
    moved = np.flatnonzero(root != at)
    return fp[moved], fp[root[moved]]


def _linked(rows: DataFrame, keys: list[str], radius: int) -> DataFrame:
    """Links of all buckets; a bucket is a run of equal keys in a sorted partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(table: pa.Table):
            key = np.stack([np.asarray(table.column(k)).astype(np.int64) for k in keys])
            fp = np.asarray(table.column("fp")).astype(np.int64)
            change = np.r_[False, (key[:, 1:] != key[:, :-1]).any(0)]
            a, b = _links(np.cumsum(change), fp, radius)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            table = pa.Table.from_batches(held)
            last = [table.column(k)[-1].as_py() for k in keys]
            same = np.ones(table.num_rows, bool)
            for k, v in zip(keys, last):
                same &= np.asarray(table.column(k)) == v
            cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            if cut:
                yield flush(table.slice(0, cut))
                held = table.slice(cut).to_batches()
        if held:
            yield flush(pa.Table.from_batches(held))

    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, "fp")
    return dealt.mapInArrow(run, "a bigint, b bigint")


def link(classes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links ``a, b`` that connect the distinct fingerprints ``fp`` within the radius."""
    first = masks(list(range(64)), radius)
    rows = _buckets(classes, first, [])
    sizes = rows.groupBy(F.col("table").alias("_t"), F.col("bucket").alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    sizes = materialise(sizes.where("_n > 1"), "simhash-buckets")
    same = (F.col("table") == F.col("_t")) & (F.col("bucket") == F.col("_b"))
    rows = rows.join(sizes, same).select("fp", "table", "bucket", "_n")
    small = _linked(rows.where(F.col("_n") <= LARGE).drop("_n"), ["table", "bucket"], radius)
    large = _divided(rows.where(F.col("_n") > LARGE), first, radius)
    large = _linked(large, ["table", "bucket", "table2", "bucket2"], radius)
    return small.unionByName(large).distinct()


def groups(docs: DataFrame, keep: tuple[str, ...], radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """``keep`` columns (doc_id among them), ``fp``, ``root`` and ``component_id``, a row per document."""
    prints = materialise(fingerprints(docs, keep, shingle), "simhash-prints")
    classes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-classes")
    roots = components(link(classes.select("fp"), radius))
    rooted = classes.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    named = rooted.groupBy(F.col("root").alias("of")).agg(F.min("least").alias("component_id"))
    labels = rooted.join(named, F.col("root") == F.col("of")).select(F.col("fp").alias("_fp"), "root", "component_id")
    return prints.join(labels, F.col("fp") == F.col("_fp")).select(*keep, "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id``: the smallest doc_id that is reachable."""
    return groups(docs, ("doc_id",), radius, shingle).select("doc_id", "fp", "component_id")


def hexadecimal(fp: Column) -> Column:
    """A fingerprint as 16 lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """Keep one document of each group: the smallest id, nulls last, then the smallest hash of its text."""
    text_hash = F.xxhash64(docs["text"])
    found = groups(docs.select("doc_id", "text", text_hash.alias("_h")), ("doc_id", "_h"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), F.col("_h").alias("h"))).alias("k")
    kept = found.groupBy("root").agg(first).select(F.col("k.i").alias("_kept"), F.col("k.h").alias("_kept_h")).distinct()
    rows = packed(docs, id=docs["doc_id"], h=text_hash)
    same = F.col("id").eqNullSafe(F.col("_kept")) & (F.col("h") == F.col("_kept_h"))
    return unpacked(rows.join(kept, same, "left_semi").dropDuplicates(["id", "h"]), docs.columns)
