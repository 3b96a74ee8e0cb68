"""Drift between a baseline and a current table, column by column.

Each step covers all columns at once: counts and means of either table,
baseline deciles, bin counts of both, category counts of both.  Categories are
counted for both sides in one grouping, so there is nothing to match and no
limit to how many a column has.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.columns import BOOLEAN, NUMERIC, as_double, as_text, col, kind_of, name_lookup
from plumbline.plans.aggregates import melt, one_row, union_all
from plumbline.plans.quantiles import quantiles
from plumbline.plans.ranking import top_by_count

DECILES = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]

# Smallest share used inside the index, and its two thresholds.
SHARE_FLOOR = 1e-4
WARN_FROM = 0.1
DRIFT_ABOVE = 0.25

#: New and missing categories that a report lists; ``category_changes`` has all.
LISTED_CATEGORIES = 10

REPORT_SCHEMA = (
    "column string, kind string, psi double, status string, base_null_pct double, cur_null_pct double,"
    " mean_shift_pct double, ks double, new_categories array<string>, missing_categories array<string>, note string"
)


def shared_columns(
    base: DataFrame, cur: DataFrame, columns: list[str] | None = None
) -> tuple[list[str], list[str]]:
    """Shared column names as (numeric, categorical), typed by the baseline."""
    if base is cur or base.sameSemantics(cur):
        raise ValueError("baseline and current must be different tables")
    present = set(cur.columns)
    shared = [f for f in base.schema.fields if f.name in present and (not columns or f.name in columns)]
    if not shared:
        raise ValueError("the two tables share no columns")
    numeric = [f.name for f in shared if kind_of(f.dataType) == NUMERIC]
    return numeric, [f.name for f in shared if f.name not in numeric]


def _stats(base: DataFrame, cur: DataFrame, numeric: list[str], categorical: list[str]) -> list[dict]:
    """Row counts, nulls and means of the baseline and the current table."""
    exprs: dict[object, Column] = {"rows": F.count(F.lit(1))}
    for n in numeric:
        exprs |= {("nulls", n): F.count_if(as_double(n).isNull()), ("mean", n): F.avg(as_double(n))}
        exprs |= {("min", n): F.min(as_double(n)), ("max", n): F.max(as_double(n))}
    exprs |= {("nulls", n): F.count_if(col(n).isNull()) for n in categorical}
    return [one_row(side, exprs) for side in (base, cur)]


def decile_edges(base: DataFrame, numeric: list[str], approx: bool = False) -> dict[str, list[float]]:
    """Finite, strictly ascending deciles of the baseline per numeric column."""
    found = quantiles(base, numeric, DECILES, approx=approx)
    return {n: sorted({e for e in v if e is not None and math.isfinite(e)}) for n, v in found.items()}


def bin_counts(base: DataFrame, cur: DataFrame, edges: dict[str, list[float]]) -> DataFrame:
    """(column, bin, base_count, cur_count), zero-filled; bin = edges reached."""
    numeric = [n for n, e in edges.items() if e]
    spark = base.sparkSession
    if not numeric:
        return spark.createDataFrame([], "column string, bin int, base_count bigint, cur_count bigint")
    sides = [
        df.select(F.lit(current).alias("side"), *[as_double(n).alias(f"n{i}") for i, n in enumerate(numeric)])
        for df, current in ((base, False), (cur, True))
    ]
    cells = {}
    for i, n in enumerate(numeric):
        value = F.col(f"n{i}")
        reached = [(value >= F.lit(e)).cast("int") for e in edges[n]]
        cells[n] = sum(reached[1:], reached[0])
    counted = (
        melt(union_all(sides), cells, F.col("side"))
        .groupBy("column_id", F.col("value").alias("bin"))
        .agg(F.count_if(~F.col("side")).alias("base_count"), F.count_if("side").alias("cur_count"))
    )
    zeros = [(i, b, 0, 0) for i, n in enumerate(numeric) for b in range(len(edges[n]) + 1)]
    blank = spark.createDataFrame(zeros, "column_id int, bin int, base_count bigint, cur_count bigint")
    return (
        counted.unionAll(blank)
        .groupBy("column_id", "bin")
        .agg(F.sum("base_count").alias("base_count"), F.sum("cur_count").alias("cur_count"))
        .select(name_lookup(numeric, F.col("column_id")).alias("column"), "bin", "base_count", "cur_count")
    )


def category_counts(base: DataFrame, cur: DataFrame, names: list[str]) -> DataFrame:
    """(column, value, base_count, cur_count) of every value on either side.

    One union, one grouping: counts are combined before the shuffle, so a hot
    value costs one row per map task.
    """
    sides = [
        df.select(F.lit(current).alias("side"), *[as_text(df, n).alias(f"c{i}") for i, n in enumerate(names)])
        for df, current in ((base, False), (cur, True))
    ]
    cells = {n: F.col(f"c{i}") for i, n in enumerate(names)}
    counted = (
        melt(union_all(sides), cells, F.col("side"))
        .groupBy("column_id", "value")
        .agg(F.count_if(~F.col("side")).alias("base_count"), F.count_if("side").alias("cur_count"))
    )
    return counted.select(name_lookup(names, F.col("column_id")).alias("column"), "value", "base_count", "cur_count")


def _term(base: Column, cur: Column) -> Column:
    """One row's term of the stability index, from its shares."""
    base, cur = F.greatest(base, F.lit(SHARE_FLOOR)), F.greatest(cur, F.lit(SHARE_FLOOR))
    return (cur - base) * F.ln(cur / base)


def _share(count: str, total: Column) -> Column:
    return F.col(count) / F.greatest(total, F.lit(1))


def numeric_index(bins: DataFrame) -> DataFrame:
    """(column, psi, ks) from zero-filled bin counts: at most ten rows per column."""
    column = Window.partitionBy("column")
    upto = column.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    shares = bins.select(
        "column",
        "bin",
        _share("base_count", F.sum("base_count").over(column)).alias("base_share"),
        _share("cur_count", F.sum("cur_count").over(column)).alias("cur_share"),
    )
    gap = F.abs(F.sum("base_share").over(upto) - F.sum("cur_share").over(upto))
    scored = shares.withColumn("gap", gap).withColumn("term", _term(F.col("base_share"), F.col("cur_share")))
    return scored.groupBy("column").agg(F.sum("term").alias("psi"), F.max("gap").alias("ks"))


def categorical_index(counts: DataFrame, listed: int = LISTED_CATEGORIES) -> DataFrame:
    """(column, psi, new_categories, missing_categories, note) from counts of both sides.

    The ``listed`` most frequent one-sided values are named.  No window ever
    holds all values of a column: totals are sums, and names are cut to
    ``listed`` before they are gathered.
    """
    totals = counts.groupBy(F.col("column").alias("of")).agg(
        F.sum("base_count").alias("base_total"), F.sum("cur_count").alias("cur_total")
    )
    # One row per column.
    scored = counts.join(F.broadcast(totals), F.col("column") == F.col("of")).withColumn(
        "term", _term(_share("base_count", F.col("base_total")), _share("cur_count", F.col("cur_total")))
    )
    scored = scored.groupBy("column").agg(
        F.sum("term").alias("psi"),
        F.count_if(F.col("base_count") == 0).alias("added"),
        F.count_if(F.col("cur_count") == 0).alias("dropped"),
    )
    one_sided = counts.where("base_count = 0 OR cur_count = 0").select(
        F.concat_ws("|", F.when(F.col("base_count") == 0, "new").otherwise("missing"), "column").alias("column"),
        F.col("column").alias("of"),
        "value",
        (F.col("base_count") + F.col("cur_count")).alias("count"),
        (F.col("base_count") == 0).alias("is_new"),
    )
    first = top_by_count(one_sided, listed)

    def names(is_new: bool) -> Column:
        own = F.when(F.col("is_new") == F.lit(is_new), F.struct("rank", "value"))
        return F.transform(F.array_sort(F.collect_list(own)), lambda s: s["value"])

    lists = first.groupBy("of").agg(names(True).alias("new"), names(False).alias("missing"))
    none = F.array().cast("array<string>")
    return scored.join(F.broadcast(lists), F.col("column") == F.col("of"), "left").select(
        "column",
        "psi",
        F.coalesce("new", none).alias("new_categories"),
        F.coalesce("missing", none).alias("missing_categories"),
        F.when((F.col("added") > 0) | (F.col("dropped") > 0), "category set changed").alias("note"),
    )


def category_changes(counts: DataFrame) -> DataFrame:
    """(column, change, value): every value seen on one side only."""
    change = F.when(F.col("base_count") == 0, "new").when(F.col("cur_count") == 0, "missing")
    return counts.select("column", change.alias("change"), "value").where(F.col("change").isNotNull())


def status(psi: Column) -> Column:
    return F.when(psi > DRIFT_ABOVE, "drift").when(psi >= WARN_FROM, "warn").otherwise("ok")


def rates_and_shift(base: DataFrame, cur: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, base_null_pct, cur_null_pct, mean_shift_pct) without any binning."""
    numeric, categorical = shared_columns(base, cur, columns)
    stats = _stats(base, cur, numeric, categorical)
    rows = [(n, *_rates(stats, n), _mean_shift(stats, n)) for n in numeric + categorical]
    schema = "column string, base_null_pct double, cur_null_pct double, mean_shift_pct double"
    return base.sparkSession.createDataFrame(rows, schema)


def _rates(stats: list[dict], name: str) -> tuple[float, float]:
    def rate(side: dict) -> float:
        return 100.0 * side["nulls", name] / side["rows"] if side["rows"] else 0.0

    return rate(stats[0]), rate(stats[1])


def _mean_shift(stats: list[dict], name: str) -> float | None:
    before, after = (side.get(("mean", name)) for side in stats)
    return None if not before or after is None else (after - before) / abs(before)


def _report_rows(
    base: DataFrame, cur: DataFrame, numeric: list[str], categorical: list[str], listed: int, approx: bool
) -> tuple[list[tuple], list[int]]:
    stats = _stats(base, cur, numeric, categorical)
    edges = decile_edges(base, numeric, approx)
    rows = []
    index = {r.column: r for r in numeric_index(bin_counts(base, cur, edges)).collect()} if numeric else {}
    for n in numeric:
        psi, ks = (index[n].psi, index[n].ks) if n in index else (0.0, 0.0)
        rows.append((n, "numeric", psi, None, *_rates(stats, n), _mean_shift(stats, n), ks, None, None, _one_value(stats, n)))
    if categorical:
        counts = category_counts(base, cur, categorical)
        index = {r.column: r for r in categorical_index(counts, listed).collect()}
    for n in categorical:
        found = index.get(n)
        lists = (found.new_categories, found.missing_categories, found.note) if found else ([], [], None)
        rows.append((n, "categorical", found.psi if found else 0.0, None, *_rates(stats, n), None, None, *lists))
    return rows, [side["rows"] for side in stats]


def _one_value(stats: list[dict], name: str) -> str | None:
    """Deciles of a constant cannot tell larger values from it; such a column is named."""
    base, cur = ((side["min", name], side["max", name]) for side in stats)
    constant = base[0] is not None and base[0] == base[1]
    return "the baseline has one value only" if constant and cur[0] is not None and cur != base else None


def _clash(cur: DataFrame, name: str) -> str | None:
    """Why a current column can never be read as the baseline's numbers."""
    kind = cur.schema[name].dataType
    castable = kind_of(kind) in (NUMERIC, BOOLEAN) or isinstance(kind, T.StringType)
    return None if castable else f"{kind.simpleString()} cannot be compared with numbers"


def _unreadable(cur: DataFrame, names: list[str]) -> dict[str, str]:
    """Text columns of the current table with values that are no numbers, counted in one pass."""
    texts = [n for n in names if isinstance(cur.schema[n].dataType, T.StringType)]
    if not texts:
        return {}
    bad = {n: F.count_if(col(n).isNotNull() & col(n).try_cast("double").isNull()) for n in texts}
    return {n: f"{count} values are not numbers" for n, count in one_row(cur, bad).items() if count}


def drift_report(
    base: DataFrame,
    cur: DataFrame,
    columns: list[str] | None = None,
    listed: int = LISTED_CATEGORIES,
    approx: bool = False,
) -> DataFrame:
    """One row per shared column, worst first.

    A column that cannot be compared gets a ``skipped`` note and index 0; it is
    found before anything is measured, so the others need no second pass.
    """
    return _measured(base, cur, columns, listed, approx)[0]


def _measured(base, cur, columns, listed, approx) -> tuple[DataFrame, list[int]]:
    numeric, categorical = shared_columns(base, cur, columns)
    notes = {n: why for n in numeric if (why := _clash(cur, n))}
    notes |= _unreadable(cur, [n for n in numeric if n not in notes])
    rows, sizes = _report_rows(base, cur, [n for n in numeric if n not in notes], categorical, listed, approx)
    rows += [(n, NUMERIC, 0.0, None, 0.0, 0.0, None, None, None, None, f"skipped: {why}") for n, why in notes.items()]
    report = base.sparkSession.createDataFrame(rows, REPORT_SCHEMA)
    return report.withColumn("status", status(F.col("psi"))).orderBy(F.col("psi").desc(), "column"), sizes


def drift_verdict(base: DataFrame, cur: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``drift_rollup`` of a fresh report, with the row counts that the report took anyway."""
    report, sizes = _measured(base, cur, columns, LISTED_CATEGORIES, False)
    return _rolled(report, *sizes)


def drift_rollup(report: DataFrame, base: DataFrame, cur: DataFrame) -> DataFrame:
    """One row: sizes of both tables, columns compared and the worst status."""
    return _rolled(report, base.count(), cur.count())


def _rolled(report: DataFrame, base_rows: int, cur_rows: int) -> DataFrame:
    severity = F.when(F.col("status") == "drift", 2).when(F.col("status") == "warn", 1).otherwise(0)
    return report.agg(
        F.lit(base_rows).cast("bigint").alias("base_rows"),
        F.lit(cur_rows).cast("bigint").alias("cur_rows"),
        F.count(F.lit(1)).alias("columns"),
        F.count_if(F.col("status") == "drift").alias("drifted_count"),
        F.max_by("status", severity).alias("overall"),
    )
