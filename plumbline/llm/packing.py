"""Pack documents into training sequences along a space-filling curve.

The token ids of a document are hashed into a vector of counts, which a fixed random
matrix projects to a few dimensions.  The place of that point on a Hilbert curve is the
document's key: documents of like wording lie near each other along the curve.  All
documents are put in the order of their keys (range partitions) and cut into sequences
of ``length`` ids wherever a sequence is full, so neighbours share sequences.  What is
left behind the last full sequence is cut at powers of two, which need no padding.

Texts are encoded once and written to shared storage.  Only (row, number of ids, key)
are sorted and summed; one number per range partition reaches the driver.  The ids are
then shuffled once, by row, to meet their place, and every document is cut where it is.

A null text counts as an empty one, which has the end id only.  Very long texts make many
pieces.  Documents with one key, copies included, keep the order in which the input is
read, and spread over range partitions by row, as many as there are.  Repeated rows are
packed each, null ids too.  An empty table gives an empty result.  Columns to keep travel
as ``k_<name>``, so they may have any name.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.hilbert import hilbert_key
from plumbline.llm.text import map_texts
from plumbline.llm.word_ids import word_ids
from plumbline.plans.durable import materialise

LENGTH, END_ID = 4096, 2
#: Buckets that ids are hashed into, dimensions they are projected to, and bits of each.
BUCKETS, DIMENSIONS, BITS = 256, 4, 15
SEED = 42


class Curve:
    """Keys of documents from their ids."""

    def __init__(self, buckets: int = BUCKETS, dimensions: int = DIMENSIONS, bits: int = BITS, seed: int = SEED):
        self.buckets, self.bits = buckets, bits
        matrix = np.random.default_rng(seed).normal(size=(buckets, dimensions))
        self.matrix = matrix / np.linalg.norm(matrix, axis=0)

    def point(self, ids: np.ndarray) -> np.ndarray:
        """The projected vector of a document, in [-1, 1]; document by document, so that batches do not matter."""
        spread = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)
        vector = np.sqrt(np.bincount((spread % np.uint64(self.buckets)).astype(np.int64), minlength=self.buckets))
        return (vector / max(np.linalg.norm(vector), 1e-12)) @ self.matrix

    def keys(self, points: np.ndarray) -> np.ndarray:
        side = 1 << self.bits
        cells = np.clip(np.floor((points + 1) / 2 * side), 0, side - 1).astype(np.int64)
        return hilbert_key(cells, self.bits)


class Sequences:
    """Where sequences begin: every ``length`` ids, and the rest at powers of two."""

    def __init__(self, total: int, length: int):
        self.length, self.full = length, total // length
        rest, self.starts = total - self.full * length, []
        at = self.full * length
        for bit in reversed(range(length.bit_length())):
            if rest >> bit & 1:
                self.starts.append(at)
                at += 1 << bit
        self.end = at

    def at(self, place: int) -> tuple[int, int, int]:
        """Number, begin and end of the sequence that holds an id."""
        if place < self.full * self.length:
            number = place // self.length
            return number, number * self.length, (number + 1) * self.length
        i = bisect_right(self.starts, place) - 1
        return self.full + i, self.starts[i], (self.starts[i + 1 :] or [self.end])[0]

    def pieces(self, place: int, n: int) -> Iterator[tuple[int, int, int, int]]:
        """Start in the document, length, sequence and offset of each piece of ``n`` ids from ``place``."""
        done = 0
        while done < n:
            number, begin, end = self.at(place + done)
            size = min(end - place - done, n - done)
            yield done, size, number, place + done - begin
            done += size


def pack(
    docs: DataFrame,
    vocabulary: str,
    length: int = LENGTH,
    keep: tuple[str, ...] = ("doc_id",),
    text: str = "text",
    end_id: int = END_ID,
    digests: bool = False,
) -> DataFrame:
    """``keep`` columns and one row per piece: start, length, ids (array of bigint), doc_tokens, sequence_id, offset.

    With ``digests``, the CRC-32 of the ids (little-endian, 32 bits) stands instead of them.
    ``vocabulary`` is the path of the tokenizer file on the driver.
    """
    coded = materialise(encoded(docs, vocabulary, keep, text, end_id), "pack-ids")
    places = materialise(running(coded.select("_row", "n", "key")), "pack-places")
    sizes = dict(places.groupBy("part").agg(F.sum("n")).collect())
    parts = sorted(sizes)
    before = list(zip(parts, accumulate((sizes[p] for p in parts), initial=0)))
    sequences = Sequences(sum(sizes.values()), length)
    bases = docs.sparkSession.createDataFrame(before, "part int, base bigint")

    places = places.join(F.broadcast(bases), "part").select("_row", (F.col("base") + F.col("start")).alias("place"))
    met = coded.drop("key").join(places.hint("shuffle_hash"), "_row").drop("_row")

    piece_name, kind = ("ids_crc32", "bigint") if digests else ("ids", "array<bigint>")

    def run(batch) -> dict:
        rows, out = [], {name: [] for name in ("start", "length", "sequence_id", "offset", "doc_tokens", piece_name)}
        unpack = zstandard.ZstdDecompressor().decompress
        lists = [batch.column(c).to_pylist() for c in ("place", "n", "width", "ids")]
        for row, (place, n, width, packed) in enumerate(zip(*lists)):
            ids = np.frombuffer(unpack(packed), f"<u{width}").astype("<u4")
            for start, size, number, offset in sequences.pieces(place, n):
                piece = ids[start : start + size]
                rows.append(row)
                for name, value in zip(out, (start, size, number, offset, n)):
                    out[name].append(value)
                out[piece_name].append(zlib.crc32(piece.tobytes()) if digests else piece.astype(np.int64))
        return {f"k_{c}": batch.column(f"k_{c}").take(pa.array(rows, pa.int64())) for c in keep} | out

    kinds = {f.name: f.dataType.simpleString() for f in met.schema}
    names = ["start", "length", "sequence_id", "offset", "doc_tokens"]
    schema = ", ".join([*(f"`k_{c}` {kinds[f'k_{c}']}" for c in keep), *(f"{n} bigint" for n in names), f"{piece_name} {kind}"])
    return map_texts(met, "ids", run, schema).withColumnsRenamed({f"k_{c}": c for c in keep})


def encoded(docs: DataFrame, vocabulary: str, keep: tuple[str, ...], text: str, end_id: int) -> DataFrame:
    """``keep`` columns (as ``k_<name>``), ``_row``, number of ids, key and the ids, packed."""
    with open(vocabulary, encoding="utf-8") as file:
        content = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batch) -> dict:
        words, curve, pack_bytes = word_ids(content.value), Curve(), zstandard.ZstdCompressor(level=1).compress
        # Half the bytes where every id fits.
        width = 2 if max(words.size, end_id) < 1 << 16 else 4
        out: dict = {"width": [width] * batch.num_rows, "n": [], "ids": []}
        points = np.zeros((batch.num_rows, curve.matrix.shape[1]))
        end = np.array([end_id], "<u4")
        coded = words.encode(batch.column("_text"))
        for i in range(len(coded)):
            ids = np.concatenate([coded.of(i), end])
            points[i] = curve.point(ids[:-1])
            out["n"].append(len(ids))
            out["ids"].append(pack_bytes(ids.astype(f"<u{width}").tobytes()))
        return {f"k_{c}": batch.column(f"k_{c}") for c in [*keep, "_row"]} | out | {"key": curve.keys(points)}

    given = docs.select(
        *[docs[c].alias(f"k_{c}") for c in keep], F.monotonically_increasing_id().alias("k__row"), docs[text].alias("_text")
    )
    kinds = {f.name: f.dataType.simpleString() for f in given.schema}
    own = [*(f"`k_{c}` {kinds[f'k_{c}']}" for c in keep), "k__row bigint", "n bigint", "key bigint", "width int", "ids binary"]
    return map_texts(given, "_text", run, ", ".join(own)).withColumnRenamed("k__row", "_row")


def running(rows: DataFrame) -> DataFrame:
    """``_row, n, part, start``: ids of this range partition in front of each document, along the curve."""

    def run(batches):
        part, done = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.column("n").to_numpy(zero_copy_only=False)
            start = done + np.cumsum(n) - n
            done += int(n.sum())
            yield pa.RecordBatch.from_arrays(
                [batch.column("_row"), batch.column("n"), pa.array(np.full(len(n), part, np.int32)), pa.array(start)],
                names=["_row", "n", "part", "start"],
            )

    ordered = rows.repartitionByRange("key", "_row").sortWithinPartitions("key", "_row")
    return ordered.mapInArrow(run, "_row bigint, n bigint, part int, start bigint")
