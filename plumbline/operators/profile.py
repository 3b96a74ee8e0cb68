"""Table profiling: column statistics, histograms, top values, correlations.

All columns are handled together: one fused aggregate, one distinct count, one
quantile search, one stacked histogram count, one stacked value count and one
fused correlation aggregate.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.columns import (
    NUMERIC,
    as_double,
    col,
    double_lookup,
    kinds,
    name_lookup,
    numeric_columns,
)
from plumbline.plans.aggregates import (
    count_distinct,
    long_text,
    melt,
    one_row,
    text_length,
    union_all,
    value_counts,
)
from plumbline.plans.comoments import pairwise_correlation
from plumbline.plans.quantiles import quantiles
from plumbline.plans.ranking import top_by_count

QUARTILES = [0.25, 0.5, 0.75]

# A guarded correlation is made of three aggregates.
PAIRS_PER_PASS = 32

STATS_SCHEMA = (
    "column string, kind string, physical_type string, row_count bigint, nulls bigint, null_pct double,"
    " distinct bigint, min double, max double, mean double, std double, p25 double, p50 double, p75 double"
)
HISTOGRAM_SCHEMA = "column string, bin int, lower_edge double, count bigint"
CORRELATION_SCHEMA = "a string, b string, r double"


def presence(df: DataFrame) -> dict[object, Column]:
    """Aggregates for the row count, each column's nulls and its text length."""
    exprs: dict[object, Column] = {"rows": F.count(F.lit(1))}
    for n in df.columns:
        exprs |= {("nulls", n): F.count_if(col(n).isNull())} | text_length(df, n)
    return exprs


def moments(name: str) -> dict[object, Column]:
    value = as_double(name)
    return {
        ("min", name): F.min(value),
        ("max", name): F.max(value),
        ("mean", name): F.avg(value),
        ("std", name): F.stddev_samp(value),
    }


def column_stats(df: DataFrame, approx: bool = False) -> DataFrame:
    """One row per column: nulls, distinct values and, if numeric, its moments."""
    return df.sparkSession.createDataFrame(_stats_rows(df, approx), STATS_SCHEMA)


def _stats_rows(df: DataFrame, approx: bool) -> list[tuple]:
    kind = kinds(df)
    numeric = numeric_columns(df)
    # Narrow tables need a single pass for all of it.
    seen = one_row(df, presence(df) | {k: e for n in numeric for k, e in moments(n).items()})
    distinct = count_distinct(df, df.columns, approx, long_text(seen), {n: (seen["min", n], seen["max", n]) for n in numeric})
    quartile = quantiles(df, numeric, QUARTILES, distinct, approx)
    total = seen["rows"]
    rows = []
    for n in df.columns:
        nulls = seen["nulls", n]
        spread = [seen[m, n] for m in ("min", "max", "mean", "std")] if kind[n] == NUMERIC else [None] * 4
        rows.append(
            (n, kind[n], df.schema[n].dataType.simpleString(), total, nulls)
            + (100.0 * nulls / total if total else 0.0, distinct[n])
            + tuple(spread)
            + tuple(quartile.get(n, [None] * 3))
        )
    return rows


def nulls_and_distinct(df: DataFrame, approx: bool = False) -> DataFrame:
    """(column, row_count, nulls, null_pct, distinct) without the numeric work."""
    whole = [f.name for f in df.schema.fields if isinstance(f.dataType, T.IntegralType)]
    limits = {(m, n): f(col(n)) for n in whole for m, f in (("min", F.min), ("max", F.max))}
    seen = one_row(df, presence(df) | limits)
    distinct = count_distinct(df, df.columns, approx, long_text(seen), {n: (seen["min", n], seen["max", n]) for n in whole})
    total = seen["rows"]
    rows = [
        (n, total, seen["nulls", n], 100.0 * seen["nulls", n] / total if total else 0.0, distinct[n])
        for n in df.columns
    ]
    schema = "column string, row_count bigint, nulls bigint, null_pct double, distinct bigint"
    return df.sparkSession.createDataFrame(rows, schema)


def histogram(df: DataFrame, bins: int = 20, extent: dict[str, tuple] | None = None) -> DataFrame:
    """Equal-width bins of every numeric column; only non-empty bins appear.

    A column whose extremes are equal or not finite gets a single bin holding
    all rows, nulls included; a column without values gets none.  ``extent``
    may pass ``{column: (min, max)}`` when it is already known.
    """
    names = numeric_columns(df)
    exprs: dict[object, Column] = {}
    if extent is None:
        exprs |= {(m, n): f(as_double(n)) for n in names for m, f in (("min", F.min), ("max", F.max))}
        seen = one_row(df, exprs)
        extent = {n: (seen["min", n], seen["max", n]) for n in names}
    filled = [n for n in names if extent[n][0] is not None]
    regular = [n for n in filled if all(map(math.isfinite, extent[n])) and extent[n][0] != extent[n][1]]
    single = [n for n in filled if n not in regular]
    parts = []
    if regular:
        low = {n: float(extent[n][0]) for n in regular}
        width = {n: (float(extent[n][1]) - low[n]) / bins for n in regular}
        cells = {}
        for n in regular:
            place = F.floor((as_double(n) - F.lit(low[n])) / F.lit(width[n])).cast("int")
            # ``least`` alone would turn a null into the last bin.
            cells[n] = F.when(place >= bins, F.lit(bins - 1)).otherwise(place)
        counted = melt(df, cells).groupBy("column_id", F.col("value").alias("bin")).agg(F.count(F.lit(1)).alias("count"))
        lows = double_lookup([low[n] for n in regular], F.col("column_id"))
        widths = double_lookup([width[n] for n in regular], F.col("column_id"))
        parts.append(
            counted.select(
                name_lookup(regular, F.col("column_id")).alias("column"),
                "bin",
                (lows + F.col("bin") * widths).alias("lower_edge"),
                "count",
            )
        )
    if single:
        cells = [
            F.struct(F.lit(n).alias("column"), F.lit(0).alias("bin"), F.lit(float(extent[n][0])).alias("lower_edge"))
            for n in single
        ]
        total = df.agg(F.count(F.lit(1)).alias("count"))
        parts.append(total.select(F.inline(F.array(*cells)), "count"))
    if not parts:
        return df.sparkSession.createDataFrame([], HISTOGRAM_SCHEMA)
    return union_all(parts)


def top_values(df: DataFrame, k: int = 10) -> DataFrame:
    """(column, rank, value, count) of the k most frequent non-numeric values."""
    names = [n for n, kind in kinds(df).items() if kind != NUMERIC]
    if not names:
        return df.sparkSession.createDataFrame([], "column string, rank int, value string, count bigint")
    return top_by_count(value_counts(df, names), k).select("column", "rank", "value", "count")


def correlation(df: DataFrame, columns: list[str] | None = None, complete: set[str] | None = None) -> DataFrame:
    """Pearson correlation of all (or the given) numeric columns, long form.

    Computed from covariance and the deviations over rows where both sides are
    present; undefined pairs (no variance, too few rows) count as 0.  A few pairs are
    one compiled aggregate; more are blocks of co-moments, also in one scan.
    ``complete`` names columns known to hold no nulls: pairs of them share one
    deviation per column.
    """
    names = [n for n in numeric_columns(df) if columns is None or n in columns]
    if len(names) < 2:
        return df.sparkSession.createDataFrame([], CORRELATION_SCHEMA)
    if len(names) * (len(names) - 1) // 2 > PAIRS_PER_PASS:
        return _wide_correlation(df, names)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    full = complete or set()
    exprs = {(a, b): guarded_correlation(as_double(a), as_double(b), {a, b} <= full) for a, b in pairs}
    seen = one_row(df, exprs, PAIRS_PER_PASS)
    rows = [(n, n, 1.0) for n in names]
    for (a, b), r in seen.items():
        rows += [(a, b, r), (b, a, r)]
    return df.sparkSession.createDataFrame(rows, CORRELATION_SCHEMA)


def _wide_correlation(df: DataFrame, names: list[str]) -> DataFrame:
    """All pairs in one scan, from blocks of co-moments."""
    found = pairwise_correlation(df, names)
    a, b, r = (F.col(c) for c in ("a", "b", "r"))
    cells = F.array(F.struct(a.alias("i"), b.alias("j"), r.alias("r")), F.struct(b.alias("i"), a.alias("j"), r.alias("r")))
    both = found.where("a < b").select(F.inline(cells))
    own = found.where("a = b").select(a.alias("i"), b.alias("j"), F.lit(1.0).alias("r"))
    return both.unionAll(own).select(name_lookup(names, F.col("i")).alias("a"), name_lookup(names, F.col("j")).alias("b"), "r")


def guarded_correlation(a: Column, b: Column, complete: bool = False) -> Column:
    """Correlation that is 0 where ``corr`` would divide by zero."""
    spread_a = F.stddev_samp(a if complete else F.when(b.isNotNull(), a))
    spread_b = F.stddev_samp(b if complete else F.when(a.isNotNull(), b))
    return F.coalesce(F.covar_samp(a, b) / F.nullif(spread_a * spread_b, F.lit(0.0)), F.lit(0.0))


def profile_table(df: DataFrame, approx: bool = False) -> dict[str, DataFrame]:
    """Column statistics, histograms, top values and correlations of a table."""
    rows = _stats_rows(df, approx)
    extent = {r[0]: (r[7], r[8]) for r in rows if r[1] == NUMERIC}
    return {
        "columns": df.sparkSession.createDataFrame(rows, STATS_SCHEMA),
        "histogram": histogram(df, extent=extent),
        "top_values": top_values(df),
        "correlation": correlation(df, complete={r[0] for r in rows if r[4] == 0}),
    }


def profile_long(profile: dict[str, DataFrame]) -> DataFrame:
    """The whole profile as one table: (section, column, item, value)."""
    metrics = [
        "row_count", "nulls", "null_pct", "distinct", "min", "max", "mean", "std", "p25", "p50", "p75",
    ]
    cells = [F.struct(F.lit(m).alias("item"), F.col(m).cast("double").alias("value")) for m in metrics]
    stats = profile["columns"].select(F.lit("columns").alias("section"), "column", F.inline(F.array(*cells)))
    parts = [
        stats.where(F.col("value").isNotNull()),
        profile["histogram"].select(
            F.lit("histogram"), "column", F.col("bin").cast("string"), F.col("count").cast("double")
        ),
        profile["top_values"].select(F.lit("top_values"), "column", "value", F.col("count").cast("double")),
        profile["correlation"].select(F.lit("correlation"), "a", "b", "r"),
    ]
    return union_all(parts)
