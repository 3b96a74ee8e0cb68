"""Column and type helpers shared by all operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC, DATETIME, BOOLEAN, STRING = "numeric", "datetime", "boolean", "string"


def col(name: str) -> Column:
    """Reference a top-level column by its exact name (dots, spaces, backticks)."""
    return F.col("`" + name.replace("`", "``") + "`")


def kind_of(dtype: T.DataType) -> str:
    """Bucket a Spark type; nested and interval types count as strings."""
    if isinstance(dtype, T.NumericType):
        return NUMERIC
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType, T.TimeType)):
        return DATETIME
    if isinstance(dtype, T.BooleanType):
        return BOOLEAN
    return STRING


def kinds(df: DataFrame) -> dict[str, str]:
    return {f.name: kind_of(f.dataType) for f in df.schema.fields}


def numeric_columns(df: DataFrame) -> list[str]:
    return [name for name, kind in kinds(df).items() if kind == NUMERIC]


def is_nested(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.ArrayType, T.MapType, T.StructType, T.VariantType))


def as_text(df: DataFrame, name: str) -> Column:
    """String form of a column: JSON for nested types, a cast for the rest."""
    dtype = df.schema[name].dataType
    if is_nested(dtype):
        return F.to_json(col(name))
    return col(name).cast("string")


def as_double(name: str) -> Column:
    return col(name).cast("double")


def holds_map(dtype: T.DataType) -> bool:
    if isinstance(dtype, (T.MapType, T.VariantType)):
        return True
    if isinstance(dtype, T.ArrayType):
        return holds_map(dtype.elementType)
    return isinstance(dtype, T.StructType) and any(holds_map(f.dataType) for f in dtype.fields)


def groupable(df: DataFrame, name: str) -> Column:
    """A form of the column that Spark can group, hash and sort by.

    Maps have no order of their own, so their sorted entry list stands in;
    other types that hold maps or variants are compared by their JSON text.
    """
    dtype = df.schema[name].dataType
    if isinstance(dtype, T.MapType) and not holds_map(dtype.valueType):
        return F.array_sort(F.map_entries(col(name)))
    return F.to_json(col(name)) if holds_map(dtype) else col(name)


def name_lookup(names: list[str], index: Column) -> Column:
    """Turn a small integer id back into the column name it stands for.

    Shuffles carry the id; the name is attached after the aggregation.
    """
    return F.element_at(F.array(*[F.lit(n) for n in names]), index + F.lit(1))


def double_lookup(values: list[float], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), index + F.lit(1))


def unit_hash(*parts: Column) -> Column:
    """A uniform number in (0, 1) that depends only on the values given, from their MD5."""
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    spread = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint").cast("double")
    return (spread + F.lit(0.5)) / F.lit(float(2**52))


def split_bucket(seed: int, *parts: Column) -> Column:
    """md5 of (seed, values) reduced to 0..99: a stable, shuffle-free split key."""
    text = F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % F.lit(100)
