"""Words, word hashes and text batches shared by the operators.

A word is a maximal run of bytes other than space, tab, line feed, vertical
tab, form feed and carriage return; every other byte belongs to a word.  Text
travels to Python as UTF-8 bytes, so malformed text cannot crash a worker.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

#: The same words as a pattern for Spark SQL.
WORD = r"[^\x20\x09-\x0D]+"
#: Text handled at once by a Python worker; a longer text is a batch of its own.
BATCH_BYTES = 8 << 20
#: Distinct words whose hash a worker remembers.
REMEMBERED = 400_000


def n_words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def words(text: bytes | None) -> list[bytes]:
    return text.split() if text else []


class WordHashes(dict):
    """64-bit hash of each word; forgets everything when it grows too large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = xxh3_64_intdigest(word)
        return value

    def of(self, of_words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, of_words), np.uint64, len(of_words))


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that ``column`` (binary) holds about ``limit`` bytes in each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = np.array([v or 0 for v in pc.binary_length(batch.column(column)).to_pylist()])
        piece = (np.cumsum(lengths) - lengths) // limit
        starts = np.flatnonzero(np.r_[True, piece[1:] != piece[:-1]])
        for start, end in zip(starts, np.r_[starts[1:], batch.num_rows]):
            yield batch.slice(start, end - start)


def give_back() -> None:
    """Return freed memory to the system: Python workers outlive their task, and the next one may need far less."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def _array(values, kind: pa.DataType) -> pa.Array:
    return values.cast(kind) if isinstance(values, pa.Array) else pa.array(values, type=kind)


def map_texts(df: DataFrame, column: str, fn: Callable[[pa.RecordBatch], dict], schema: str) -> DataFrame:
    """``mapInArrow`` with ``column`` as bytes, in batches of bounded size.

    ``fn`` gets a record batch and returns columns by name.  What it freed is given back when a task ends.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in slices(batches, column):
                columns = fn(batch)
                yield pa.RecordBatch.from_arrays([_array(columns[f.name], f.type) for f in arrow], schema=arrow)
        finally:
            batch = columns = None
            give_back()

    return df.withColumn(column, F.col(column).cast("binary")).mapInArrow(run, schema)


def packed(df: DataFrame, **columns: Column) -> DataFrame:
    """All columns as one struct ``row`` next to new ones, so that no name can clash."""
    return df.select(F.struct(*[df[c] for c in df.columns]).alias("row"), *[v.alias(k) for k, v in columns.items()])


def unpacked(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*[F.col("row").getField(c).alias(c) for c in names])
