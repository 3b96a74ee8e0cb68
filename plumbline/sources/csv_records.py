"""CSV files with newlines inside quotes, read by many tasks.

Whether a newline ends a record depends on whether a quote is open there, and that on
everything before it in the file.  A first pass reads each split of a file on its own and
notes how it would leave the quote for either way of finding it.  Chained in order of the
splits, these notes (one per split) tell how each split really begins.  A second pass cuts
records there.  A record that runs over the end of a split is put together from its pieces.

Newlines inside quotes are kept as they are, whatever ends the lines of the file.  A quote
that is never closed takes in the rest of its file, but for a last newline.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.plans.durable import materialise

_NOTES = "file string, start bigint, lines bigint, closed_end boolean, open_end boolean, closed_breaks boolean, open_breaks boolean, open_closes boolean, odd boolean"
_RECORDS = "file string, owner bigint, start bigint, piece boolean, first boolean, value string"


class Quotes:
    """Does a line leave a quote open?  Only a quote at the start of a field opens one."""

    def __init__(self, separator: str, quote: str):
        s, q = re.escape(separator), re.escape(quote)
        self.quote = quote
        # Possessive, so that a long line is walked once.
        self.closed = re.compile(rf"(?:{q}(?:[^{q}]++|{q}{q})*+{q}[^{s}]*+(?:{s}|\Z)|(?!{q})[^{s}]*+(?:{s}|\Z))*+")
        self.inside = re.compile(rf"(?:[^{q}]++|{q}{q})*+{q}[^{s}]*+(?:{s}|\Z)")

    def leaves_open(self, line: str, opened: bool) -> bool:
        if self.quote not in line:
            return opened
        at = 0
        if opened:
            found = self.inside.match(line)
            if not found:
                return True
            at = found.end()
            if at == len(line):
                return False
        return self.closed.match(line, at).end() < len(line)


def lines_of(spark: SparkSession, path: str, options: dict) -> DataFrame:
    reader = spark.read.options(**{k: v for k, v in options.items() if k in ("pathGlobFilter", "recursiveFileLookup")})
    lines = reader.option("lineSep", "\n").text(path)
    return lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], str]]:
    for batch in batches:
        yield from zip(zip(batch.column("file").to_pylist(), batch.column("start").to_pylist()), batch.column("value").to_pylist())


def notes_of(lines: DataFrame, quotes: Quotes) -> DataFrame:
    """For each split: how it ends if it begins outside or inside quotes, and what happens between."""

    def run(batches):
        now, note = None, None
        for split, line in _splits(batches):
            if split != now:
                if note:
                    yield _batch([note], _NOTES)
                # file, start, lines, state from outside, from inside, breaks of either, closes, odd
                now, note = split, [*split, 0, False, True, False, False, False, False]
            note[2] += 1
            note[3], note[4] = quotes.leaves_open(line, note[3]), quotes.leaves_open(line, note[4])
            note[5] |= note[3]
            note[6] |= note[4]
            note[7] |= not note[4]
            note[8] |= "\r" in line[:-1]
        if note:
            yield _batch([note], _NOTES)

    return lines.mapInArrow(run, _NOTES)


def plan(notes: list) -> tuple[dict[tuple[str, int], tuple[bool, int]], bool]:
    """For each split, whether it begins inside quotes and which split began the record open there; any such record?"""
    begins: dict[tuple[str, int], tuple[bool, int]] = {}
    breaks, file, opened, owner = False, None, False, 0
    for n in sorted(notes, key=lambda n: (n.file, n.start)):
        if n.file != file:
            file, opened, owner = n.file, False, n.start
        begins[n.file, n.start] = (opened, owner if opened else n.start)
        breaks |= n.open_breaks if opened else n.closed_breaks
        # The record open at the end began here, unless this split is the middle of one.
        if not opened or n.open_closes:
            owner = n.start
        opened = n.open_end if opened else n.closed_end
    return begins, breaks


def records_of(lines: DataFrame, begins: dict, quotes: Quotes) -> DataFrame:
    """Records, and the pieces of those that cross the end of a split."""

    def run(batches):
        now, rows, held, opened, owner, first, piece = None, [], [], False, 0, False, False

        def close(split, whole: bool) -> None:
            nonlocal held, first, piece, owner
            rows.append((split[0], owner, split[1], piece or not whole, first and owner == split[1], "\n".join(held)))
            held, first, piece, owner = [], False, False, split[1]

        for split, line in _splits(batches):
            if split != now:
                if held:
                    close(now, False)
                now = split
                opened, owner = begins[split]
                piece, first = opened, split[1] == 0
            held.append(line)
            opened = quotes.leaves_open(line, opened)
            if not opened:
                close(split, True)
                if len(rows) >= 1000:
                    yield _batch(rows, _RECORDS)
                    rows = []
        if held:
            close(now, False)
        if rows:
            yield _batch(rows, _RECORDS)

    cut = materialise(lines.mapInArrow(run, _RECORDS), "csv-records")
    pieces = cut.where("piece").groupBy("file", "owner").agg(
        F.sort_array(F.collect_list(F.struct("start", "value"))).alias("pieces"), F.max("first").alias("first")
    )
    # Of two pieces of one split the later one is another record; it has that split as its owner.
    joined = pieces.select("file", "first", F.array_join(F.transform("pieces", lambda p: p["value"]), "\n").alias("value"))
    whole = cut.where("NOT piece").select("file", "first", "value").unionByName(joined)
    return whole.select("file", "first", F.regexp_replace("value", "\r\\z", "").alias("value"))


_KINDS = {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_()}


def _batch(rows: list, ddl: str) -> pa.RecordBatch:
    fields = [f.split() for f in ddl.split(", ")]
    columns = [pa.array(c, _KINDS[kind]) for c, (_, kind) in zip(zip(*rows), fields)]
    return pa.RecordBatch.from_arrays(columns, names=[name for name, _ in fields])


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None, options: dict) -> DataFrame | None:
    """The table of CSV files, or None where Spark's own reader has to read it."""
    quote, header = options.get("quote", '"'), str(options.get("header", False)).lower() == "true"
    separator = options.get("sep", options.get("delimiter", ","))
    plain = len(quote) == 1 and options.get("escape", quote) == quote and len(separator) == 1
    if not plain or not header or any(k in options for k in ("lineSep", "encoding", "comment", "charset")):
        return None
    quotes = Quotes(separator, quote)
    lines = lines_of(spark, path, options)
    notes = notes_of(lines, quotes).collect()
    begins, breaks = plan(notes)
    reading = options | {"multiLine": False}
    if any(n.odd for n in notes):
        # Lines that end in a carriage return alone.
        return None
    if not breaks:
        reader = spark.read.options(**reading)
        return (reader if schema is None else reader.schema(schema)).csv(path)
    records = records_of(lines, begins, quotes)
    top = records.where("first").orderBy("file").select("value").limit(1)
    rows = records.where("NOT first").select("value")
    if schema is None:
        inferred = _parsed(spark.read.options(**reading), top.unionAll(rows)).schema
        # Spark leaves rows that repeat the header out of the inference.
        same = rows.join(F.broadcast(top.withColumnRenamed("value", "top")), F.col("value") == F.col("top"), "left_semi")
        repeated = not same.isEmpty()
        schema = T.StructType([T.StructField(f.name, T.StringType() if repeated else f.dataType) for f in inferred])
    return _parsed(spark.read.schema(schema).options(**(reading | {"header": False, "inferSchema": False})), rows)


def _parsed(reader, rows: DataFrame) -> DataFrame:
    """Parse one record per row."""
    spark = rows.sparkSession
    texts = getattr(rows._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())
    return DataFrame(reader._jreader.csv(texts), spark)
