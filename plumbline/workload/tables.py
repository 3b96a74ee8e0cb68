"""Loading, saving, SQL and Python steps over named tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from plumbline.operators.groups import Apart
from plumbline.operators.temporal import asof_join, band_join
from plumbline.plans.durable import scratch_path
from plumbline.sources import io
from plumbline.sources.workspace import Workspace, run_python
from plumbline.workload.registry import ORACLES, query, rounded

PART = "SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part"


@query("load_csv_roundtrip", PART)
def csv_roundtrip(read):
    part = read("part")
    folder = scratch_path(read.spark, "csv") + ".csv"
    io.save_csv(part, folder)
    return io.load(read.spark, folder, "part_csv", schema=part.schema)


@query("load_csv_inferred", f"SELECT count(*) AS n, sum(p_partkey)::BIGINT AS keys, round(avg(p_retailprice), 4) AS price FROM ({PART})")
def csv_inferred(read):
    part = read("part")
    folder = scratch_path(read.spark, "tsv") + ".tsv"
    io.save_csv(part, folder, sep="\t")
    loaded = io.load(read.spark, folder, "part_tsv")
    return loaded.agg(
        F.count(F.lit(1)).alias("n"), F.sum("p_partkey").alias("keys"), F.round(F.avg("p_retailprice"), 4).alias("price")
    )


@query("load_csv_long_texts", "SELECT doc_id, md5(text) AS digest, lang, source, n_chars FROM documents")
def csv_long_texts(read):
    """Texts with newlines, quotes and separators survive a CSV round trip."""
    documents = read("documents")
    folder = scratch_path(read.spark, "texts") + ".csv"
    io.save_csv(documents, folder)
    loaded = io.load(read.spark, folder, "documents_csv", schema=documents.schema)
    return loaded.select("doc_id", F.md5("text").alias("digest"), "lang", "source", "n_chars")


@query("load_csv_pages", "SELECT page_id, url, md5(html) AS digest FROM pages")
def csv_pages(read):
    pages = read("pages")
    folder = scratch_path(read.spark, "pages") + ".csv"
    io.save_csv(pages, folder, compression="gzip")
    loaded = io.load(read.spark, folder, "pages_csv", schema=pages.schema)
    return loaded.select("page_id", "url", F.md5("html").alias("digest"))


@query("load_json_roundtrip", "SELECT event_id, ts, user_id, event_type, value, props FROM events")
def json_roundtrip(read):
    events = read("events")
    folder = scratch_path(read.spark, "json") + ".jsonl"
    io.save_json(events, folder)
    return io.load(read.spark, folder, "events_json", schema=events.schema)


@query(
    "load_all_sources",
    """SELECT 'nation' AS name, count(*) AS n FROM nation UNION ALL SELECT 'region', count(*) FROM region
 UNION ALL SELECT 'supplier', count(*) FROM supplier""",
)
def load_all(read):
    loaded = io.load_all(read.spark, {f"loaded_{t}": read.path(t) for t in ("nation", "region", "supplier")})
    result = None
    for name, df in loaded.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name.removeprefix("loaded_")).alias("name"), "n")
        result = one if result is None else result.unionAll(one)
    return result


@query(
    "python_transform",
    """SELECT user_id, count(*) AS n, round(sum(value), 4) AS total, round(max(value) - min(value), 4) AS spread
 FROM events GROUP BY 1""",
)
def python_transform(read):
    """A Python step that publishes a table, and a SQL step that reads it."""

    def step(ws: Workspace):
        per_user = ws.table("events").groupBy("user_id").agg(
            F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), (F.max("value") - F.min("value")).alias("spread")
        )
        ws.publish("per_user", per_user)
        return ws.sql("SELECT user_id, n, total, spread FROM per_user")

    read("events").createOrReplaceTempView("events")
    return rounded(run_python(read.spark, step), 4, "total", "spread")


@query(
    "python_groups",
    """SELECT user_id, n, round(CASE WHEN spread > 0 THEN slope END, 6) AS slope, round(middle, 4) AS middle FROM (
 SELECT user_id, count(*) AS n, regr_slope(value, event_id) AS slope, var_pop(event_id) AS spread, median(value) AS middle
 FROM events GROUP BY user_id)""",
)
def python_groups(read):
    """pandas code over all rows of each user."""

    def trend(rows):
        x, y = rows["event_id"].astype(float), rows["value"].astype(float)
        dx = x - x.mean()
        spread = float((dx * dx).sum())
        slope = float((dx * (y - y.mean())).sum()) / spread if spread > 0 else None
        return pd.DataFrame({"n": [len(rows)], "slope": pd.Series([slope], dtype="float64"), "middle": [float(y.median())]})

    def step(ws: Workspace):
        return ws.publish("trends", ws.apply("events", ["user_id"], trend, "n bigint, slope double, middle double"))

    read("events").select("user_id", "event_id", "value").createOrReplaceTempView("events")
    found = run_python(read.spark, step)
    found = found.withColumn("slope", F.when(~F.isnan("slope"), F.col("slope")))
    return rounded(found, 6, "slope").withColumn("middle", F.round("middle", 4))


@query(
    "python_groups_hot",
    """SELECT event_type, count(*) AS n, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS deviation,
 count(DISTINCT user_id) AS users FROM events GROUP BY event_type""",
)
def python_groups_hot(read):
    """pandas code over slices of a few huge groups: moments, and the set of users."""

    def partial(rows):
        per_user = rows.assign(square=rows["value"] * rows["value"]).groupby("user_id")
        return per_user.agg(n=("value", "count"), total=("value", "sum"), square=("square", "sum")).reset_index()

    def merge(rows):
        return rows.groupby("user_id", as_index=False)[["n", "total", "square"]].sum()

    def close(rows):
        return add(rows.assign(users=1))

    def add(rows):
        return pd.DataFrame({c: [rows[c].sum()] for c in ("n", "total", "square", "users")})

    def finish(rows):
        n, total, square = rows["n"].sum(), rows["total"].sum(), rows["square"].sum()
        deviation = np.sqrt(max(square - total * total / n, 0.0) / (n - 1)) if n > 1 else None
        return pd.DataFrame({"n": [n], "mean": [total / n], "deviation": [deviation], "users": [rows["users"].sum()]})

    read("events").select("event_type", "user_id", "value").createOrReplaceTempView("events")
    moments, out = "n bigint, total double, square double", "n bigint, mean double, deviation double, users bigint"
    parts, users = f"user_id bigint, {moments}", Apart(["user_id"], close, add, f"{moments}, users bigint")
    found = run_python(
        read.spark, lambda ws: ws.combine("events", ["event_type"], partial, merge, finish, parts, out, 20_000, users)
    )
    return rounded(found, 4, "mean", "deviation")


SHOWN = ["customer", "events", "nation", "orders"]


@query(
    "workspace_tables",
    "\nUNION ALL\n".join(
        f"""SELECT '{t}' AS "table", (SELECT count(*) FROM information_schema.columns WHERE table_name = '{t}') AS columns,
 (SELECT string_agg(column_name, ',' ORDER BY ordinal_position) FROM information_schema.columns WHERE table_name = '{t}')
 AS names, (SELECT count(*) FROM {t}) AS n"""
        for t in SHOWN
        if t != "nation"
    ),
)
def workspace_tables(read):
    """Publish tables, drop one, and list, describe and count those that are left."""
    ws = Workspace(read.spark)
    for table in SHOWN:
        ws.publish(f"shown_{table}", read(table))
    ws.drop("shown_nation")
    left = sorted(t for t in ws.tables() if t.startswith("shown_"))
    rows = []
    for name in left:
        described = ws.describe(name)
        rows.append((name.removeprefix("shown_"), len(described), ",".join(c for c, _ in described), ws.count(name)))
        ws.drop(name)
    return read.spark.createDataFrame(rows, '"table" string, columns bigint, names string, n bigint'.replace('"', "`"))


@query(
    "sanitize_names",
    r"""SELECT page_id, CASE WHEN base = '' THEN 'dataset' WHEN regexp_matches(base, '^[0-9]') THEN '_' || base ELSE base END AS name
 FROM (SELECT page_id, regexp_replace(regexp_replace(coalesce(url, ''), '\.[^.]+$', ''), '[^A-Za-z0-9_]', '_', 'g') AS base FROM pages)""",
)
def sanitize_names(read):
    """View names for the addresses of pages."""
    return read("pages").select("page_id", io.sanitized(F.coalesce("url", F.lit(""))).alias("name"))


# -- plain SQL: the text goes to Spark as it is --------------------------------


def sql_query(name: str, tables: str, spark_sql: str, duck_sql: str | None = None) -> None:
    @query(name, duck_sql or spark_sql)
    def run(read):
        for table in tables.split():
            read(table).createOrReplaceTempView(table)
        return io.run_sql(read.spark, spark_sql)


SUMMARY = """SELECT event_type, count(*) AS n, round(avg(value), 2) AS mean FROM events GROUP BY event_type ORDER BY n DESC"""
sql_query("sql_group_summary", "events", SUMMARY)


@query("sql_named_result", f"SELECT event_type, n FROM ({SUMMARY}) WHERE mean > 49")
def named_result(read):
    read("events").createOrReplaceTempView("events")
    io.run_sql(read.spark, SUMMARY + ";", "event_summary")
    return io.run_sql(read.spark, "SELECT event_type, n FROM event_summary WHERE mean > 49")


for _kind in ("inner", "left"):
    sql_query(
        f"sql_join_{_kind}",
        "customer orders",
        f"""SELECT c_mktsegment, count(o_orderkey) AS orders, count(DISTINCT c_custkey) AS customers,
 round(coalesce(sum(o_totalprice), 0), 2) AS total
 FROM customer {_kind} JOIN orders ON c_custkey = o_custkey GROUP BY c_mktsegment""",
    )
for _kind in ("full", "right"):
    sql_query(
        f"sql_join_{_kind}",
        "customer orders",
        f"""SELECT c_custkey, o_orderkey FROM (SELECT * FROM customer WHERE c_acctbal > 0) c
 {_kind} JOIN (SELECT * FROM orders WHERE o_orderstatus = 'F') o ON c_custkey = o_custkey""",
    )
sql_query(
    "sql_join_semi",
    "customer orders",
    "SELECT c_custkey, c_name FROM customer LEFT SEMI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 400000",
    "SELECT c_custkey, c_name FROM customer SEMI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 400000",
)
sql_query(
    "sql_join_anti",
    "customer orders",
    "SELECT c_custkey, c_name FROM customer LEFT ANTI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 400000",
    "SELECT c_custkey, c_name FROM customer ANTI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 400000",
)
# Matching on the hour as well keeps a busy user's events from meeting all of
# that user's sign-ups.
sql_query(
    "sql_join_range",
    "events",
    """WITH signup AS (SELECT user_id, event_id, ts, explode(array(date_trunc('hour', ts),
 date_trunc('hour', ts) + INTERVAL 1 HOUR)) AS hour FROM events WHERE event_type = 'signup'),
 seen AS (SELECT user_id, event_id, ts, date_trunc('hour', ts) AS hour FROM events)
 SELECT s.user_id, s.event_id AS signup, e.event_id FROM signup s JOIN seen e ON s.user_id = e.user_id
 AND s.hour = e.hour AND e.ts > s.ts AND e.ts <= s.ts + INTERVAL 1 HOUR""",
    """SELECT s.user_id, s.event_id AS signup, e.event_id FROM events s JOIN events e ON s.user_id = e.user_id
 AND e.ts > s.ts AND e.ts <= s.ts + INTERVAL 1 HOUR WHERE s.event_type = 'signup'""",
)
# The latest earlier view: first within the day, else carried over from the
# days before, so that no task sorts a busy user's whole history.
sql_query(
    "sql_asof_rewrite",
    "events",
    """WITH marked AS (SELECT user_id, event_id, event_type, ts, date_trunc('day', ts) AS day, CASE WHEN
 event_type = 'view' THEN named_struct('ts', ts, 'event_id', event_id) END AS seen FROM events
 WHERE event_type IN ('view', 'purchase')),
 daily AS (SELECT user_id, day, max(seen) AS latest FROM marked GROUP BY user_id, day),
 carried AS (SELECT user_id, day, max(latest) OVER (PARTITION BY user_id ORDER BY day
 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier FROM daily),
 today AS (SELECT *, max(seen) OVER (PARTITION BY user_id, day ORDER BY ts, event_id
 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS same_day FROM marked)
 SELECT today.user_id, event_id AS purchase, coalesce(same_day, earlier).event_id AS last_view
 FROM today JOIN carried ON today.user_id = carried.user_id AND today.day = carried.day
 WHERE event_type = 'purchase'""",
    """SELECT p.user_id, p.event_id AS purchase, (SELECT v.event_id FROM events v WHERE v.user_id = p.user_id
 AND v.event_type = 'view' AND (v.ts, v.event_id) < (p.ts, p.event_id) ORDER BY v.ts DESC, v.event_id DESC LIMIT 1)
 AS last_view FROM events p WHERE p.event_type = 'purchase'""",
)
for _kind in ("cube", "rollup"):
    sql_query(
        f"sql_{_kind}",
        "orders",
        f"""SELECT o_orderstatus, o_orderpriority, CAST(grouping_id(o_orderstatus, o_orderpriority) AS INT) AS level,
 count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY {_kind}(o_orderstatus, o_orderpriority)""",
        f"""SELECT o_orderstatus, o_orderpriority, CAST(grouping(o_orderstatus, o_orderpriority) AS INT) AS level,
 count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY {_kind}(o_orderstatus, o_orderpriority)""",
    )
sql_query(
    "sql_grouping_sets",
    "orders",
    """SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders
 GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())""",
)
sql_query(
    "sql_window_rank",
    "customer orders",
    """SELECT c_mktsegment, place, o_orderkey, o_totalprice FROM (SELECT c_mktsegment, o_orderkey, o_totalprice,
 row_number() OVER (PARTITION BY c_mktsegment ORDER BY o_totalprice DESC, o_orderkey) AS place
 FROM orders JOIN customer ON c_custkey = o_custkey) WHERE place <= 3""",
)
# Days are the slices of a user's history.  Each of the six rows before a day can
# only be among the last six of the days before it, so those are carried over.
SLICED = """WITH cut AS (SELECT user_id, event_id, ts, value, date_trunc('day', ts) AS day FROM events),
 placed AS (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY ts DESC, event_id DESC) AS back FROM cut),
 tails AS (SELECT user_id, day, array_sort(collect_list(struct(ts, event_id, value))) AS tail FROM placed
 WHERE back <= 6 GROUP BY user_id, day),
 carried AS (SELECT user_id, day, flatten(collect_list(tail) OVER (PARTITION BY user_id ORDER BY day
 ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)) AS before FROM tails),
 extended AS (SELECT user_id, day, event_id, ts, value, true AS own FROM cut UNION ALL
 SELECT user_id, day, x.event_id, x.ts, x.value, false FROM carried LATERAL VIEW explode(
 slice(array_sort(before), greatest(size(before) - 5, 1), 6)) t AS x)"""
sql_query(
    "sql_window_frame",
    "events",
    SLICED
    + """ SELECT event_id, moving FROM (SELECT event_id, own, round(avg(value) OVER (PARTITION BY user_id, day
 ORDER BY ts, event_id ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS moving FROM extended) WHERE own""",
    """SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id
 ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS moving FROM events""",
)
sql_query(
    "sql_window_neighbours",
    "orders",
    """SELECT o_orderkey, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before,
 lead(o_totalprice, 2, -1.0) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS after FROM orders""",
    """SELECT o_orderkey, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before,
 lead(o_totalprice, 2, -1.0) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS after FROM orders""",
)
sql_query(
    "sql_set_ops",
    "events",
    """SELECT 'both' AS kind, user_id FROM (SELECT user_id FROM events WHERE event_type = 'purchase'
 INTERSECT SELECT user_id FROM events WHERE event_type = 'error')
 UNION ALL SELECT 'purchase only', user_id FROM (SELECT user_id FROM events WHERE event_type = 'purchase'
 EXCEPT SELECT user_id FROM events WHERE event_type = 'error')""",
)
sql_query(
    "sql_set_ops_all",
    "orders lineitem",
    """SELECT 'both' AS kind, k FROM (SELECT l_orderkey AS k FROM lineitem INTERSECT ALL
 (SELECT o_orderkey FROM orders UNION ALL SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'))
 UNION ALL SELECT 'left over', k FROM (SELECT l_orderkey AS k FROM lineitem EXCEPT ALL SELECT o_orderkey FROM orders)""",
)
sql_query(
    "sql_topk",
    "lineitem",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem
 ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey LIMIT 10""",
)
sql_query(
    "sql_pivot",
    "orders",
    """SELECT year, F, O, P FROM (SELECT year(o_orderdate) AS year, o_orderstatus FROM orders)
 PIVOT (count(1) FOR o_orderstatus IN ('F' AS F, 'O' AS O, 'P' AS P))""",
    """SELECT year(o_orderdate) AS year, nullif(count(*) FILTER (WHERE o_orderstatus = 'F'), 0) AS F,
 nullif(count(*) FILTER (WHERE o_orderstatus = 'O'), 0) AS O,
 nullif(count(*) FILTER (WHERE o_orderstatus = 'P'), 0) AS P FROM orders GROUP BY 1""",
)
sql_query(
    "sql_unpivot",
    "part",
    "SELECT p_partkey, item, amount FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) AS size, p_retailprice AS price FROM part)"
    " UNPIVOT (amount FOR item IN (size, price))",
)
sql_query(
    "sql_recursive",
    "orders",
    """WITH RECURSIVE years AS (SELECT min(year(o_orderdate)) AS y, max(year(o_orderdate)) AS last FROM orders
 UNION ALL SELECT y + 1, last FROM years WHERE y < last),
 counts AS (SELECT year(o_orderdate) AS year, count(o_orderkey) AS n FROM orders GROUP BY year(o_orderdate))
 SELECT y, coalesce(n, 0) AS n FROM years LEFT JOIN counts ON year = y""",
)
sql_query(
    "sql_lateral",
    "nation customer",
    """SELECT n_name, best.c_custkey, best.c_acctbal FROM nation, LATERAL (SELECT c_custkey, c_acctbal FROM customer
 WHERE c_nationkey = n_nationkey ORDER BY c_acctbal DESC, c_custkey LIMIT 1) best""",
)
sql_query(
    "sql_scalar_string",
    "pages",
    r"SELECT lower(regexp_extract(url, '^https?://([^/]+)', 1)) AS host, count(*) AS n FROM pages GROUP BY 1",
    r"SELECT lower(regexp_extract(url, '^https?://([^/]+)', 1)) AS host, count(*) AS n FROM pages GROUP BY 1",
)
sql_query(
    "sql_scalar_date",
    "orders",
    """SELECT CAST(CAST(date_trunc('month', o_orderdate) AS DATE) AS STRING) AS month, count(*) AS n,
 round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1""",
)
sql_query(
    "sql_scalar_json",
    "events",
    """SELECT event_type, round(avg(CAST(get_json_object(props, '$.k') AS DOUBLE)), 6) AS mean FROM events
 GROUP BY event_type""",
    """SELECT event_type, round(avg(CAST(json_extract_string(props, '$.k') AS DOUBLE)), 6) AS mean FROM events
 GROUP BY event_type""",
)
sql_query(
    "sql_scalar_map",
    "events",
    """SELECT event_type, element_at(m, 'seen') AS seen, element_at(m, 'none') AS none, cardinality(m) AS size FROM (
 SELECT event_type, map('seen', count(*), 'users', count(DISTINCT user_id)) AS m FROM events GROUP BY event_type)""",
    """SELECT event_type, m['seen'] AS seen, m['none'] AS none, cardinality(m) AS size FROM (
 SELECT event_type, MAP {'seen': count(*), 'users': count(DISTINCT user_id)} AS m FROM events GROUP BY event_type)""",
)
sql_query(
    "sql_scalar_math",
    "lineitem",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, round(ln(l_extendedprice) + sqrt(l_quantity) + power(1 + l_discount, 2), 6) AS x,
 floor(l_extendedprice / 7) AS f, ceil(l_extendedprice / 7) AS c, l_orderkey % 7 AS m, sign(l_discount - 0.05) AS s,
 abs(l_tax - l_discount) < 0.03 AS near, greatest(l_tax, l_discount) AS top FROM lineitem""",
)
sql_query(
    "sql_scalar_array",
    "embeddings",
    """SELECT label, round(avg(sqrt(aggregate(embedding, CAST(0 AS DOUBLE),
 (a, x) -> a + CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 6) AS norm FROM embeddings GROUP BY label""",
    """SELECT label, round(avg(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)))), 6) AS norm
 FROM embeddings GROUP BY label""",
)


@query("asof_join", ORACLES["sql_asof_rewrite"])
def asof(read):
    """The latest earlier view of every purchase, without slices written by hand."""
    events = read("events")
    return asof_join(
        events.where("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("purchase")),
        events.where("event_type = 'view'").select("user_id", "ts", "event_id"),
        by=["user_id"],
        left_on="ts",
        right_on="ts",
        columns={"last_view": "event_id"},
        tie=["event_id"],
        left_tie=["purchase"],
    ).select("user_id", "purchase", "last_view")


@query("band_join", ORACLES["sql_join_range"])
def band(read):
    """The events in the hour after each sign-up."""
    events = read("events")
    return band_join(
        events.where("event_type = 'signup'"),
        events,
        by=["user_id"],
        left_on="ts",
        right_on="ts",
        lower=0,
        upper=3600,
        left_columns={"user_id": "user_id", "signup": "event_id"},
        right_columns={"event_id": "event_id"},
        closed="right",
    )
