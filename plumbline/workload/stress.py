"""Index, attack and stress harness queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import stress
from plumbline.operators.contracts import Rule
from plumbline.operators.indexing import dense_index
from plumbline.workload.registry import query, sql_union

LINE_ORDER = [
    "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    "l_returnflag", "l_linestatus", "l_shipdate",
]


@query(
    "dense_index",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice,
 row_number() OVER (ORDER BY {", ".join(LINE_ORDER)}) - 1 AS row_index FROM lineitem""",
)
def index(read):
    found = dense_index(read("lineitem"), ["l_orderkey", "l_linenumber"])
    return found.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "row_index")


CUSTOMER = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
TEXTS = ["c_name", "c_mktsegment"]
NUMBERS = ["c_custkey", "c_nationkey", "c_acctbal"]
INDEXED = f"(SELECT *, row_number() OVER (ORDER BY {', '.join(CUSTOMER)}) - 1 AS i FROM customer)"


def attack_sql(columns: list[str], expression: str) -> str:
    """``expression`` is SQL with ``{c}`` for the column, applied to ``columns``."""
    shown = [expression.format(c=c) + f" AS {c}" if c in columns else c for c in CUSTOMER]
    return f"SELECT {', '.join(shown)} FROM {INDEXED}"


# SQL of the mutated customer table per attack.
MUTATED = {
    "baseline": "SELECT * FROM customer",
    "empty": "SELECT * FROM customer WHERE false",
    "single_row": f"SELECT * FROM customer ORDER BY {', '.join(CUSTOMER)} LIMIT 1",
    "duplicates": "SELECT * FROM customer UNION ALL SELECT * FROM customer",
    "volume_x25": "SELECT customer.* FROM customer, range(25)",
    "null_bomb": attack_sql(CUSTOMER, "CASE WHEN i % 2 = 0 THEN {c} END"),
    "numeric_extremes": attack_sql(
        NUMBERS, "CASE i % 4 WHEN 0 THEN 1e15 WHEN 1 THEN -1e15 WHEN 2 THEN 0 ELSE {c}::DOUBLE END"
    ),
    "blank_strings": attack_sql(TEXTS, "CASE WHEN i % 2 = 0 THEN '' ELSE {c} END"),
    "whitespace": attack_sql(TEXTS, "'  ' || {c} || '  '"),
    "mixed_case": attack_sql(TEXTS, "CASE WHEN i % 2 = 0 THEN upper({c}) ELSE lower({c}) END"),
    "unicode": attack_sql(TEXTS, "{c} || ' 🦈—café—💥'"),
}


def attack_query(key: str) -> None:
    @query(f"attack_{key.removesuffix('_x25')}", MUTATED[key])
    def run(read):
        return stress.apply_attack(read("customer"), key)


for _key in MUTATED:
    if _key not in ("baseline", "empty"):
        attack_query(_key)

LABELS = {key: attack.label for key, attack in stress.ATTACKS.items()}
SHOWN = ["attack", "label", "status", "input_rows", "output_rows", "schema_changed", "contract_failures"]

SEGMENT_SUMMARY = "SELECT c_mktsegment AS segment, count(*) AS n, avg(c_acctbal) AS mean FROM input GROUP BY 1"
SEGMENT_RULES = [
    Rule("named", "not_null", "segment"),
    Rule("known", "regex", "segment", pattern="^[A-Z]+$"),
    Rule("one_row_each", "unique", "segment"),
    Rule("size", "row_count", min=5, max=5),
    Rule("mean", "range", "mean", min=-10000, max=10000),
]


def segment_report_sql() -> str:
    return sql_union(
        f"""SELECT '{key}' AS attack, '{LABELS[key]}' AS label, CASE WHEN f > 0 THEN 'warning' ELSE 'ok' END AS status,
 input_rows, output_rows, false AS schema_changed, f AS contract_failures FROM (
 SELECT any_value(input_rows) AS input_rows, count(n) AS output_rows,
 ((count(*) FILTER (WHERE segment IS NULL AND n IS NOT NULL) > 0)::INTEGER
 + (count(*) FILTER (WHERE NOT regexp_matches(segment, '^[A-Z]+$')) > 0)::INTEGER
 + (count(n) <> 5)::INTEGER + (count(*) FILTER (WHERE abs(mean) > 10000) > 0)::INTEGER)::INTEGER AS f FROM
 (SELECT count(*) AS input_rows FROM ({MUTATED[key]})) LEFT JOIN
 (SELECT c_mktsegment AS segment, count(*) AS n, avg(c_acctbal) AS mean FROM ({MUTATED[key]}) GROUP BY 1) ON true)"""
        for key in MUTATED
    )


@query("stress_report", segment_report_sql())
def report(read):
    return stress.stress_test(SEGMENT_SUMMARY, read("customer"), SEGMENT_RULES).select(*SHOWN)


# A transform that cannot take blank names, and renames a column for big inputs.
def fragile(df):
    number = F.regexp_extract("c_name", "#(.*)", 1).cast("bigint")
    crowded = df.count() > 20 * df.select("c_custkey").distinct().count()
    return df.select(number.alias("number"), F.col("c_acctbal").alias("much" if crowded else "balance"))


def fragile_report_sql() -> str:
    return sql_union(
        f"""SELECT '{key}' AS attack, '{LABELS[key]}' AS label,
 CASE WHEN broken > 0 THEN 'error' WHEN n > 20 * d THEN 'warning' ELSE 'ok' END AS status, n AS input_rows,
 CASE WHEN broken = 0 THEN n END AS output_rows, broken = 0 AND n > 20 * d AS schema_changed,
 NULL::INTEGER AS contract_failures FROM (SELECT count(*) AS n, count(DISTINCT c_custkey) AS d,
 count(*) FILTER (WHERE c_name IS NOT NULL AND try_cast(regexp_extract(c_name, '#(.*)', 1) AS BIGINT) IS NULL) AS broken
 FROM ({MUTATED[key]}))"""
        for key in MUTATED
    )


@query("stress_report_errors", fragile_report_sql())
def errors(read):
    return stress.stress_test(fragile, read("customer")).select(*SHOWN)


EVENT_COLUMNS = ["event_id", "ts", "user_id", "event_type", "value", "props"]
EVENTS_INDEXED = f"(SELECT *, row_number() OVER (ORDER BY {', '.join(EVENT_COLUMNS)}) - 1 AS i FROM events)"
EVENT_TYPES = {
    "baseline": "SELECT event_type FROM events",
    "empty": "SELECT event_type FROM events WHERE false",
    "single_row": f"SELECT event_type FROM events ORDER BY {', '.join(EVENT_COLUMNS)} LIMIT 1",
    "duplicates": "SELECT event_type FROM events UNION ALL SELECT event_type FROM events",
    "volume_x25": "SELECT event_type FROM events, range(25)",
    "null_bomb": f"SELECT CASE WHEN i % 2 = 0 THEN event_type END AS event_type FROM {EVENTS_INDEXED}",
    "numeric_extremes": "SELECT event_type FROM events",
    "blank_strings": f"SELECT CASE WHEN i % 2 = 0 THEN '' ELSE event_type END AS event_type FROM {EVENTS_INDEXED}",
    "whitespace": "SELECT '  ' || event_type || '  ' AS event_type FROM events",
    "mixed_case": f"SELECT CASE WHEN i % 2 = 0 THEN upper(event_type) ELSE lower(event_type) END AS event_type FROM {EVENTS_INDEXED}",
    "unicode": "SELECT event_type || ' 🦈—café—💥' AS event_type FROM events",
}
TYPE_RULES = [Rule("named", "not_null", "event_type"), Rule("plain", "regex", "event_type", pattern="^[a-z]+$"), Rule("seen", "row_count", min=1)]


def events_report_sql() -> str:
    return sql_union(
        f"""SELECT '{key}' AS attack, '{LABELS[key]}' AS label, CASE WHEN f > 0 THEN 'warning' ELSE 'ok' END AS status,
 (SELECT count(*) FROM ({sql})) AS input_rows, output_rows, false AS schema_changed, f AS contract_failures FROM (
 SELECT count(*) AS output_rows, ((count(*) FILTER (WHERE event_type IS NULL) > 0)::INTEGER
 + (count(*) FILTER (WHERE NOT regexp_matches(event_type, '^[a-z]+$')) > 0)::INTEGER
 + (count(*) = 0)::INTEGER)::INTEGER AS f FROM (SELECT event_type, count(*) AS n FROM ({sql}) GROUP BY event_type))"""
        for key, sql in EVENT_TYPES.items()
    )


@query("stress_events", events_report_sql())
def events_report(read):
    """All attacks on the events, through a summary by type."""
    return stress.stress_test(
        "SELECT event_type, count(*) AS n, avg(value) AS mean FROM input GROUP BY event_type", read("events"), TYPE_RULES
    ).select(*SHOWN)
