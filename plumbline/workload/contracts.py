"""Contract queries, in batch and on a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators.contracts import Rule, describe, evaluate, evaluate_all, summarize
from plumbline.plans.durable import scratch_path
from plumbline.streaming.contracts import contract_stream, read_results
from plumbline.workload.profiles import LINES, lines_with_nulls
from plumbline.workload.registry import query, sql_union

SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD")

# (rule, SQL for its violations); a None count stands for a rule in error.
CUSTOMER_RULES = [
    (Rule("key_present", "not_null", "c_custkey"), "count(*) FILTER (WHERE c_custkey IS NULL)"),
    (
        Rule("key_unique", "unique", "c_custkey"),
        "(SELECT coalesce(sum(n), 0) FROM (SELECT count(*) AS n FROM customer WHERE c_custkey IS NOT NULL"
        " GROUP BY c_custkey HAVING count(*) > 1))",
    ),
    (Rule("balance", "range", "c_acctbal", min=0), "count(*) FILTER (WHERE c_acctbal < 0)"),
    (
        Rule("segment", "allowed_values", "c_mktsegment", values=SEGMENTS),
        f"count(*) FILTER (WHERE c_mktsegment NOT IN {SEGMENTS})",
    ),
    (
        Rule("name", "regex", "c_name", pattern="^Customer#[0-9]{9}$"),
        "count(*) FILTER (WHERE NOT regexp_matches(c_name, '^Customer#[0-9]{9}$'))",
    ),
    (Rule("size", "row_count", min=1, max=1_000_000), "CASE WHEN count(*) BETWEEN 1 AND 1000000 THEN 0 ELSE 1 END"),
    (Rule("bad_pattern", "regex", "c_name", pattern="("), "-1"),
    (Rule("no_column", "not_null", "c_missing"), "-1"),
    (Rule("not_a_number", "range", "c_name", max=5), "-1"),
]
NATION_RULES = [
    (
        Rule("regions", "unique", "n_regionkey"),
        "(SELECT coalesce(sum(n), 0) FROM (SELECT count(*) AS n FROM nation GROUP BY n_regionkey HAVING count(*) > 1))",
    ),
    (Rule("named", "not_null", "n_name"), "count(*) FILTER (WHERE n_name IS NULL)"),
]


def rules_of(pairs) -> list[Rule]:
    return [rule for rule, _ in pairs]


def contract_sql(table: str, pairs, source: str | None = None) -> str:
    return sql_union(
        f"""SELECT '{table}' AS "table", '{r.id}' AS rule_id, '{r.type}' AS rule_type, failing = 0 AS passed,
 failing::BIGINT AS failing_rows, total, '{describe(r).replace("'", "''")}' AS description
 FROM (SELECT {count} AS failing, count(*) AS total FROM {source or table})"""
        for r, count in pairs
    )


RESULT = ["table", "rule_id", "rule_type", "passed", "failing_rows", "total", "description"]


@query("contract_evaluate", contract_sql("customer", CUSTOMER_RULES))
def contract_evaluate(read):
    return evaluate(read("customer"), "customer", rules_of(CUSTOMER_RULES)).select(*RESULT)


LINE_RULES = [
    (Rule("order", "not_null", "l_orderkey"), "count(*) FILTER (WHERE l_orderkey IS NULL)"),
    (
        Rule("order_once", "unique", "l_orderkey"),
        "(SELECT coalesce(sum(n), 0) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1))",
    ),
    (Rule("discount", "range", "l_discount", min=0.01, max=0.09), "count(*) FILTER (WHERE l_discount < 0.01 OR l_discount > 0.09)"),
    (Rule("flag", "allowed_values", "l_returnflag", values=("A", "N")), "count(*) FILTER (WHERE l_returnflag NOT IN ('A', 'N'))"),
    (Rule("status", "regex", "l_linestatus", pattern="^[OF]$"), "count(*) FILTER (WHERE NOT regexp_matches(l_linestatus, '^[OF]$'))"),
    (Rule("size", "row_count", min=1), "CASE WHEN count(*) >= 1 THEN 0 ELSE 1 END"),
    (Rule("text", "range", "l_returnflag", max=5), "-1"),
]


@query("contract_lineitem", contract_sql("lineitem", LINE_RULES))
def contract_lineitem(read):
    return evaluate(read("lineitem"), "lineitem", rules_of(LINE_RULES)).select(*RESULT)


def single(name: str, table: str, rule: Rule, count: str, source: str | None = None, load=None) -> None:
    @query(name, contract_sql(table, [(rule, count)], source))
    def run(read):
        return evaluate(load(read) if load else read(table), table, [rule]).select(*RESULT)


single(
    "contract_not_null",
    "lineitem",
    Rule("discount", "not_null", "l_discount"),
    "count(*) FILTER (WHERE l_discount IS NULL)",
    LINES,
    lines_with_nulls,
)
single(
    "contract_unique",
    "lineitem",
    Rule("order", "unique", "l_orderkey"),
    "(SELECT coalesce(sum(n), 0) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1))",
)
single(
    "contract_range",
    "lineitem",
    Rule("discount", "range", "l_discount", min=0.01, max=0.09),
    "count(*) FILTER (WHERE l_discount < 0.01 OR l_discount > 0.09)",
    LINES,
    lines_with_nulls,
)
single(
    "contract_allowed_values",
    "orders",
    Rule("status", "allowed_values", "o_orderstatus", values=("F", "O")),
    "count(*) FILTER (WHERE o_orderstatus NOT IN ('F', 'O'))",
)
single(
    "contract_regex",
    "pages",
    Rule("secure", "regex", "url", pattern="^https://[a-z.]+/"),
    "count(*) FILTER (WHERE NOT regexp_matches(url, '^https://[a-z.]+/'))",
)


@query(
    "contract_row_count",
    """SELECT 'lineitem' AS "table", 'size' AS rule_id, false AS passed, 1::BIGINT AS failing_rows,
 count(*)::VARCHAR || ' rows' AS detail FROM lineitem""",
)
def contract_row_count(read):
    result = evaluate(read("lineitem"), "lineitem", [Rule("size", "row_count", max=10)])
    return result.select("table", "rule_id", "passed", "failing_rows", "detail")


def summary_sql() -> str:
    both = sql_union([contract_sql("customer", CUSTOMER_RULES), contract_sql("nation", NATION_RULES)])
    return f"""SELECT "table", count(*) FILTER (WHERE failing_rows >= 0 AND passed) AS passed,
 count(*) FILTER (WHERE failing_rows >= 0 AND NOT passed) AS failed,
 count(*) FILTER (WHERE failing_rows < 0) AS errored FROM ({both}) GROUP BY 1"""


def all_results(read):
    tables = {t: read(t) for t in ("customer", "nation", "region")}
    wanted = {
        "customer": rules_of(CUSTOMER_RULES),
        "nation": rules_of(NATION_RULES),
        "dropped_table": [Rule("any", "not_null", "x")],
    }
    return evaluate_all(tables, wanted)


@query(
    "contract_all_tables",
    sql_union([contract_sql("customer", CUSTOMER_RULES), contract_sql("nation", NATION_RULES)]),
)
def contract_all_tables(read):
    return all_results(read).select(*RESULT)


@query("contract_summary", summary_sql())
def contract_summary(read):
    return summarize(all_results(read))


EVENT_RULES = [
    (Rule("value", "range", "value", min=1, max=200), "count(*) FILTER (WHERE value < 1 OR value > 200)"),
    (
        Rule("user", "unique", "user_id"),
        "(SELECT coalesce(sum(n), 0) FROM (SELECT count(*) AS n FROM events GROUP BY user_id HAVING count(*) > 1))",
    ),
    (Rule("kind", "not_null", "event_type"), "count(*) FILTER (WHERE event_type IS NULL)"),
]


def state_stores(df) -> int:
    """As many as the input has splits, and a few at least."""
    return max(8, df.rdd.getNumPartitions())


@query("contract_stream", f"SELECT *, 0::BIGINT AS batch_id FROM ({contract_sql('events', EVENT_RULES)})")
def stream_contract(read):
    spark = read.spark
    # As a pattern the path may be one file or a folder of files.
    stream = spark.readStream.schema(read("events").schema).parquet(read.path("events") + "*")
    results = scratch_path(spark, "stream-results")
    checkpoint = scratch_path(spark, "stream-checkpoint")
    running = contract_stream(stream, "events", rules_of(EVENT_RULES), results, checkpoint, True, state_stores(read("events")))
    running.awaitTermination()
    return read_results(spark, results).select(*RESULT, "batch_id")


PARTS_OF_STREAM = 3
STREAM_RULES = [Rule("user", "unique", "user_id"), Rule("value", "range", "value", max=100), Rule("size", "row_count", min=1)]


@query(
    "contract_stream_batches",
    sql_union(
        f"""SELECT 'events' AS "table", rule_id, failing_rows = 0 AS passed, failing_rows, total, {b}::BIGINT AS batch_id FROM (
 SELECT unnest(['user', 'value', 'size']) AS rule_id, unnest([repeated, large, 0]) AS failing_rows, total FROM (
 SELECT count(*) FILTER (WHERE event_id % {PARTS_OF_STREAM} = {b}) AS total,
 count(*) FILTER (WHERE event_id % {PARTS_OF_STREAM} = {b} AND value > 100) AS large,
 count(*) FILTER (WHERE event_id % {PARTS_OF_STREAM} = {b} AND user_id IN (SELECT user_id FROM events
 WHERE event_id % {PARTS_OF_STREAM} <= {b} GROUP BY user_id HAVING count(*) > 1)) AS repeated FROM events))"""
        for b in range(PARTS_OF_STREAM)
    ),
)
def stream_batches(read):
    """Three batches: keys of one are judged against those of all before."""
    spark, events = read.spark, read("events")
    source, results, checkpoint = (scratch_path(spark, f"stream-{n}") for n in ("source", "unique", "state"))
    for b in range(PARTS_OF_STREAM):
        events.where(F.col("event_id") % PARTS_OF_STREAM == b).write.mode("append").parquet(source)
        stream = spark.readStream.schema(events.schema).parquet(source)
        contract_stream(stream, "events", STREAM_RULES, results, checkpoint, True, state_stores(events)).awaitTermination()
    return read_results(spark, results).select("table", "rule_id", "passed", "failing_rows", "total", "batch_id")
