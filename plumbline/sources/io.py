"""Reading and writing tables on any file system Spark can reach."""

from __future__ import annotations

import re
from collections.abc import Mapping
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.columns import as_text, col, is_nested
from plumbline.plans.durable import materialise
from plumbline.sources.csv_records import read_csv

CSV_OPTIONS = {"header": True, "quote": '"', "escape": '"', "multiLine": True}
COMPRESSED = (".gz", ".bz2", ".zst", ".snappy", ".lz4", ".deflate", ".xz")


def sanitize_name(raw: str) -> str:
    """A view name from a file name: no extension, no odd characters."""
    base = re.sub(r"[^A-Za-z0-9_]", "_", re.sub(r"\.[^.]+$", "", raw))
    return re.sub(r"^(?=\d)", "_", base) or "dataset"


def sanitized(raw: Column) -> Column:
    """``sanitize_name`` of every value of a column."""
    base = F.regexp_replace(F.regexp_replace(raw, r"\.[^.]+$", ""), "[^A-Za-z0-9_]", "_")
    return F.when(base == "", "dataset").otherwise(F.regexp_replace(base, r"^(?=\d)", "_"))


def extension(path: str) -> str:
    """Lower-case extension in front of any compression suffix."""
    name = path.rstrip("/").rsplit("/", 1)[-1].lower()
    for suffix in COMPRESSED:
        name = name.removesuffix(suffix)
    return name.rpartition(".")[2] if "." in name else ""


def format_of(path: str) -> str:
    """File format by extension; unknown ones are read as CSV."""
    kind = extension(path)
    return "parquet" if kind == "parquet" else "json" if kind in ("json", "jsonl", "ndjson") else "csv"


def load(
    spark: SparkSession,
    path: str,
    name: str | None = None,
    format: str | None = None,
    schema: T.StructType | str | None = None,
    **options,
) -> DataFrame:
    """Read a file or folder and register it as a view.

    CSV and JSON infer their types from all rows unless a schema is given.  CSV files
    are split over tasks whether or not texts hold newlines (``csv_records.py``).
    """
    kind = format or format_of(path)
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if kind == "parquet":
        df = reader.options(**options).parquet(path)
    elif kind == "json":
        lines_only = extension(path) in ("jsonl", "ndjson") or "multiLine" in options
        df = reader.options(**options).json(path) if lines_only else _read_json(spark, reader, path, options)
    else:
        separator = {"sep": "\t"} if extension(path) == "tsv" else {}
        inference = {"inferSchema": True} if schema is None else {}
        wanted = CSV_OPTIONS | separator | inference | options
        # Who says how lines are to be read gets Spark's reader at once.
        df = None if "multiLine" in options else read_csv(spark, path, schema, wanted)
        df = reader.options(**wanted).csv(path) if df is None else df
    df.createOrReplaceTempView(name or sanitize_name(path.rstrip("/").rsplit("/", 1)[-1]))
    return df


#: Characters of a line that are enough to judge it; longer lines are judged whole, where they lie.
START = 1 << 16


def _read_json(spark: SparkSession, reader, path: str, options: dict) -> DataFrame:
    """Files of one row per line and files of one document, told apart file by file.

    A file holds a document if its first line that is not blank is no object by
    itself.  The judgement is made where the line lies; file names and yes or no
    reach the driver.
    """
    row_files, documents = [], []
    for file, is_row in json_layouts(spark, path).items():
        # Escaped characters of a path come back as such from input_file_name.
        (row_files if is_row else documents).append(unquote(file))
    parts = []
    if row_files:
        parts.append(reader.options(**options).json(row_files))
    if documents:
        parts.append(reader.options(**({"multiLine": True} | options)).json(documents))
    if not parts:
        return reader.options(**options).json(path)
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)


def json_layouts(spark: SparkSession, path: str) -> dict[str, bool]:
    """For each file with text, whether its first line is an object by itself."""
    line = F.trim("value")
    lines = spark.read.text(path).select(
        F.input_file_name().alias("file"), line.alias("line"), F.monotonically_increasing_id().alias("place")
    )
    filled = lines.where("line <> ''")
    start = F.struct("place", F.length("line").alias("length"), F.left("line", F.lit(START)).alias("start"))
    first = materialise(filled.groupBy("file").agg(F.min(start).alias("at")).select("file", "at.*"), "json-starts")
    found = {r.file: r.is_row for r in first.where(F.col("length") <= START).select("file", _is_object("start").alias("is_row")).collect()}
    longer = first.where(F.col("length") > START).select(F.col("file").alias("of"), F.col("place").alias("at"))
    # One row per file is broadcast; the line itself stays in its task.
    whole = filled.join(F.broadcast(longer), (F.col("file") == F.col("of")) & (F.col("place") == F.col("at")))
    return found | {r.file: r.is_row for r in whole.select("file", _is_object("line").alias("is_row")).collect()}


def _is_object(line: str) -> Column:
    """Is the text a JSON object?  Longer ones than a variant may be are only read for their keys."""
    kind = F.schema_of_variant(F.try_parse_json(line))
    by_keys = F.json_object_keys(line).isNotNull()
    known = F.length(line) <= START
    return F.when(known, F.coalesce(kind.startswith("OBJECT"), F.lit(False))).otherwise(by_keys)


def load_all(spark: SparkSession, sources: Mapping[str, str], **options) -> dict[str, DataFrame]:
    """(Re)load every source of a ``{name: path}`` map."""
    return {name: load(spark, path, name, **options) for name, path in sources.items()}


def save_csv(df: DataFrame, path: str, mode: str = "error", **options) -> None:
    """Write CSV with a header; nested columns become JSON text, and empty texts read back as null."""
    flat = df.select(*[as_text(df, f.name).alias(f.name) if is_nested(f.dataType) else col(f.name) for f in df.schema])
    keep_spaces = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    flat.write.mode(mode).options(**(CSV_OPTIONS | keep_spaces | options)).csv(path)


def save_json(df: DataFrame, path: str, mode: str = "error", **options) -> None:
    """Write one JSON object per line, with times to the microsecond."""
    exact = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
    df.write.mode(mode).options(**(exact | options)).json(path)


def run_sql(spark: SparkSession, sql: str, name: str | None = None, persist: bool = False) -> DataFrame:
    """Run Spark SQL; with a name, register the result for later statements.

    ``persist`` stores it as a managed table instead of a view.
    """
    df = spark.sql(sql.strip().rstrip(";"))
    if name is None:
        return df
    if persist:
        df.write.mode("overwrite").saveAsTable(name)
        return spark.table(name)
    df.createOrReplaceTempView(name)
    return df
