"""Drift queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import drift
from plumbline.workload.registry import query, rounded, sql_union

EARLY_EVENTS = "(SELECT * FROM events WHERE ts < TIMESTAMP '2024-01-16')"
LATE_EVENTS = "(SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-16')"
ENGLISH = "(SELECT * FROM documents WHERE lang = 'en')"
OTHER_LANGUAGES = "(SELECT * FROM documents WHERE lang <> 'en')"
# Some priorities and prices are blanked so that null rates differ.
ORDER_SOURCE = (
    "(SELECT o_orderkey, o_custkey, o_orderstatus, nullif(o_totalprice, 0) AS o_totalprice, o_orderdate,"
    " CASE WHEN o_orderkey % 7 = 0 AND o_orderdate >= TIMESTAMP '1998-01-01' THEN NULL ELSE o_orderpriority END"
    " AS o_orderpriority FROM orders)"
)
OLD_ORDERS = f"(SELECT * FROM {ORDER_SOURCE} WHERE o_orderdate < TIMESTAMP '1998-01-01')"
NEW_ORDERS = f"(SELECT * FROM {ORDER_SOURCE} WHERE o_orderdate >= TIMESTAMP '1998-01-01')"
RICH = "(SELECT * FROM customer WHERE c_acctbal >= 5000)"
POOR = "(SELECT * FROM customer WHERE c_acctbal < 5000)"

ORDER_NUMBERS = ["o_orderkey", "o_custkey", "o_totalprice"]
ORDER_OTHERS = ["o_orderstatus", "o_orderdate", "o_orderpriority"]


def event_sides(read):
    events = read("events").select("event_id", "user_id", "value", "ts")
    cut = F.lit("2024-01-16").cast("timestamp_ntz")
    return events.where(F.col("ts") < cut), events.where(F.col("ts") >= cut)


def document_sides(read):
    documents = read("documents")
    return documents.where("lang = 'en'"), documents.where("lang <> 'en'")


def order_sides(read):
    cut = F.lit("1998-01-01").cast("timestamp_ntz")
    late = F.col("o_orderdate") >= cut
    blank = (F.col("o_orderkey") % 7 == 0) & late
    orders = read("orders").withColumns(
        {
            "o_totalprice": F.nullif("o_totalprice", F.lit(0.0)),
            "o_orderpriority": F.when(~blank, F.col("o_orderpriority")),
        }
    )
    return orders.where(~late), orders.where(late)


def customer_sides(read):
    customers = read("customer")
    return customers.where("c_acctbal >= 5000"), customers.where("c_acctbal < 5000")


TERM = "(greatest(cp, 0.0001) - greatest(bp, 0.0001)) * ln(greatest(cp, 0.0001) / greatest(bp, 0.0001))"


def numeric_sql(base: str, cur: str, column: str) -> str:
    """(psi, ks) of one numeric column; one row, null without edges."""
    deciles = ", ".join(f"quantile_cont({column}::DOUBLE, 0.{d})" for d in range(1, 10))
    edges = f"(SELECT DISTINCT unnest([{deciles}]) AS e FROM {base} WHERE {column} IS NOT NULL)"
    # Rows at or above each edge; differences of neighbours are the bin counts.
    return f"""(WITH edge AS (SELECT e, row_number() OVER (ORDER BY e) AS k FROM {edges} WHERE isfinite(e)),
 reach AS (
 SELECT k, (SELECT count(*) FROM {base} WHERE {column} >= e) AS b, (SELECT count(*) FROM {cur} WHERE {column} >= e) AS c
 FROM edge
 UNION ALL SELECT 0, (SELECT count({column}) FROM {base}), (SELECT count({column}) FROM {cur})),
 bins AS (
 SELECT k, b - coalesce(lead(b) OVER (ORDER BY k), 0) AS b, c - coalesce(lead(c) OVER (ORDER BY k), 0) AS c FROM reach),
 shares AS (
 SELECT k, b / greatest(sum(b) OVER (), 1) AS bp, c / greatest(sum(c) OVER (), 1) AS cp FROM bins),
 gaps AS (SELECT *, abs(sum(bp) OVER (ORDER BY k) - sum(cp) OVER (ORDER BY k)) AS gap FROM shares)
 SELECT sum({TERM}) AS psi, max(gap) AS ks FROM gaps)"""


def matched_sql(base: str, cur: str, column: str) -> str:
    def top(side: str, count: str) -> str:
        return f"""(SELECT {column}::VARCHAR AS v, count(*) AS {count}n,
 row_number() OVER (ORDER BY count(*) DESC, {column}::VARCHAR) AS {count}r FROM {side} WHERE {column} IS NOT NULL
 GROUP BY 1, {column})"""

    return f"(SELECT * FROM {top(base, 'b')} FULL JOIN {top(cur, 'c')} USING (v))"


def categorical_sql(base: str, cur: str, column: str) -> str:
    """(psi, added, dropped) of one categorical column."""
    return f"""(SELECT sum({TERM}) AS psi,
 coalesce(string_agg(v, '|' ORDER BY cr) FILTER (WHERE br IS NULL AND cr IS NOT NULL AND nr <= 10), '') AS added,
 coalesce(string_agg(v, '|' ORDER BY br) FILTER (WHERE cr IS NULL AND br IS NOT NULL AND mr <= 10), '') AS dropped
 FROM (SELECT *, coalesce(bn, 0) / greatest(sum(bn) OVER (), 1) AS bp, coalesce(cn, 0) / greatest(sum(cn) OVER (), 1) AS cp,
 row_number() OVER (PARTITION BY br IS NULL ORDER BY cr) AS nr,
 row_number() OVER (PARTITION BY cr IS NULL ORDER BY br) AS mr FROM {matched_sql(base, cur, column)}))"""


def rates_sql(base: str, cur: str, column: str, numeric: bool) -> str:
    def rate(side: str) -> str:
        return f"(SELECT 100.0 * count(*) FILTER (WHERE {column} IS NULL) / count(*) FROM {side})"

    mean = [f"(SELECT avg({column}::DOUBLE) FROM {side})" for side in (base, cur)]
    shift = f"({mean[1]} - {mean[0]}) / nullif(abs({mean[0]}), 0)" if numeric else "NULL::DOUBLE"
    return f"""round({rate(base)}, 6) AS base_null_pct, round({rate(cur)}, 6) AS cur_null_pct,
 round({shift}, 6) AS mean_shift_pct"""


STATUS = "CASE WHEN psi > 0.25 THEN 'drift' WHEN psi >= 0.1 THEN 'warn' ELSE 'ok' END"


def report_sql(base: str, cur: str, numeric: list[str], categorical: list[str]) -> str:
    parts = [
        f"""SELECT '{c}' AS "column", 'numeric' AS kind, round(psi, 6) AS psi, {STATUS} AS status,
 {rates_sql(base, cur, c, True)}, round(ks, 6) AS ks, '' AS new_categories, '' AS missing_categories, '' AS note
 FROM {numeric_sql(base, cur, c)}"""
        for c in numeric
    ] + [
        f"""SELECT '{c}' AS "column", 'categorical' AS kind, round(psi, 6) AS psi, {STATUS} AS status,
 {rates_sql(base, cur, c, False)}, NULL::DOUBLE AS ks, added AS new_categories, dropped AS missing_categories,
 CASE WHEN added <> '' OR dropped <> '' THEN 'category set changed' ELSE '' END AS note
 FROM {categorical_sql(base, cur, c)}"""
        for c in categorical
    ]
    return sql_union(parts)


def flat_report(report):
    return rounded(report, 6, "psi", "base_null_pct", "cur_null_pct", "mean_shift_pct", "ks").withColumns(
        {
            "new_categories": F.coalesce(F.array_join("new_categories", "|"), F.lit("")),
            "missing_categories": F.coalesce(F.array_join("missing_categories", "|"), F.lit("")),
            "note": F.coalesce("note", F.lit("")),
        }
    )


def psi_ks(sides, numeric: list[str]):
    base, cur = sides
    edges = drift.decile_edges(base, numeric)
    return rounded(drift.numeric_index(drift.bin_counts(base, cur, edges)), 6, "psi", "ks")


EVENT_NUMBERS = ["event_id", "user_id", "value"]


@query(
    "drift_numeric_psi",
    sql_union(
        f"SELECT '{c}' AS \"column\", round(psi, 6) AS psi FROM {numeric_sql(EARLY_EVENTS, LATE_EVENTS, c)}"
        for c in EVENT_NUMBERS
    ),
)
def numeric_psi(read):
    return psi_ks(event_sides(read), EVENT_NUMBERS).select("column", "psi")


@query(
    "drift_numeric_ks",
    sql_union(
        [
            f"SELECT '{c}' AS \"column\", round(ks, 6) AS ks FROM {numeric_sql(EARLY_EVENTS, LATE_EVENTS, c)}"
            for c in EVENT_NUMBERS
        ]
        + [f"SELECT 'n_chars' AS \"column\", round(ks, 6) AS ks FROM {numeric_sql(ENGLISH, OTHER_LANGUAGES, 'n_chars')}"]
    ),
)
def numeric_ks(read):
    events = psi_ks(event_sides(read), EVENT_NUMBERS)
    return events.unionAll(psi_ks(document_sides(read), ["n_chars"])).select("column", "ks")


@query(
    "drift_categorical",
    sql_union(
        f"SELECT '{c}' AS \"column\", round(psi, 6) AS psi FROM {categorical_sql(base, cur, c)}"
        for base, cur, c in [
            (ENGLISH, OTHER_LANGUAGES, "source"),
            (OLD_ORDERS, NEW_ORDERS, "o_orderpriority"),
            (OLD_ORDERS, NEW_ORDERS, "o_orderdate"),
            (RICH, POOR, "c_name"),
            (RICH, POOR, "c_mktsegment"),
        ]
    ),
)
def categorical(read):
    parts = [
        (document_sides(read), ["source"]),
        (order_sides(read), ["o_orderpriority", "o_orderdate"]),
        (customer_sides(read), ["c_name", "c_mktsegment"]),
    ]
    result = None
    for (base, cur), names in parts:
        one = drift.categorical_index(drift.category_counts(base, cur, names)).select("column", "psi")
        result = one if result is None else result.unionAll(one)
    return rounded(result, 6, "psi")


@query(
    "drift_category_changes",
    sql_union(
        f"""SELECT '{c}' AS "column", CASE WHEN br IS NULL THEN 'new' ELSE 'missing' END AS change, v AS value
 FROM {matched_sql(RICH, POOR, c)} WHERE br IS NULL OR cr IS NULL"""
        for c in ("c_name", "c_mktsegment")
    ),
)
def changes(read):
    base, cur = customer_sides(read)
    return drift.category_changes(drift.category_counts(base, cur, ["c_name", "c_mktsegment"]))


@query(
    "drift_null_rates",
    sql_union(
        f'SELECT "column", base_null_pct, cur_null_pct FROM'
        f" (SELECT '{c}' AS \"column\", {rates_sql(OLD_ORDERS, NEW_ORDERS, c, False)})"
        for c in ORDER_NUMBERS + ORDER_OTHERS
    ),
)
def null_rates(read):
    found = drift.rates_and_shift(*order_sides(read))
    return rounded(found, 6, "base_null_pct", "cur_null_pct").drop("mean_shift_pct")


@query(
    "drift_mean_shift",
    sql_union(
        f'SELECT "column", mean_shift_pct FROM'
        f" (SELECT '{c}' AS \"column\", {rates_sql(EARLY_EVENTS, LATE_EVENTS, c, c != 'ts')})"
        for c in [*EVENT_NUMBERS, "ts"]
    ),
)
def mean_shift(read):
    found = drift.rates_and_shift(*event_sides(read))
    return rounded(found, 6, "mean_shift_pct").select("column", "mean_shift_pct")


@query("drift_report", report_sql(OLD_ORDERS, NEW_ORDERS, ORDER_NUMBERS, ORDER_OTHERS))
def report(read):
    return flat_report(drift.drift_report(*order_sides(read)))


ROLLUP_SQL = f"""SELECT (SELECT count(*) FROM {OLD_ORDERS}) AS base_rows, (SELECT count(*) FROM {NEW_ORDERS}) AS cur_rows,
 count(*) AS columns, count(*) FILTER (WHERE status = 'drift') AS drifted_count,
 CASE max(CASE status WHEN 'drift' THEN 2 WHEN 'warn' THEN 1 ELSE 0 END) WHEN 2 THEN 'drift' WHEN 1 THEN 'warn'
 ELSE 'ok' END AS overall FROM ({report_sql(OLD_ORDERS, NEW_ORDERS, ORDER_NUMBERS, ORDER_OTHERS)})"""


@query("drift_rollup", ROLLUP_SQL)
def rollup(read):
    base, cur = order_sides(read)
    return drift.drift_verdict(base, cur)
