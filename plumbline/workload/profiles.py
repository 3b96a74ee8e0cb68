"""Profile, dictionary and chart queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import charts, dictionary, profile, profile_store
from plumbline.plans.durable import scratch_path
from plumbline.workload.registry import query, rounded, sql_union

# The given tables hold no nulls, so one column gets some on both sides.
LINES = "(SELECT * REPLACE (nullif(l_discount, 0.05) AS l_discount) FROM lineitem)"
LINE_NUMBERS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
]
LINE_COLUMNS = [*LINE_NUMBERS, "l_returnflag", "l_linestatus", "l_shipdate"]
ORDER_NUMBERS = ["o_orderkey", "o_custkey", "o_totalprice"]
ORDER_OTHERS = ["o_orderstatus", "o_orderdate", "o_orderpriority"]


def lines_with_nulls(read) -> DataFrame:
    return read("lineitem").withColumn("l_discount", F.nullif("l_discount", F.lit(0.05)))


def _nulls_distinct_sql(table: str, columns: list[str]) -> str:
    return sql_union(
        f"""SELECT '{c}' AS "column", count(*) AS row_count, count(*) FILTER (WHERE {c} IS NULL) AS nulls,
 round(100.0 * count(*) FILTER (WHERE {c} IS NULL) / count(*), 6) AS null_pct, count(DISTINCT {c}) AS "distinct"
 FROM {table}"""
        for c in columns
    )


@query("profile_nulls_distinct", _nulls_distinct_sql(LINES, LINE_COLUMNS))
def nulls_distinct(read):
    return rounded(profile.nulls_and_distinct(lines_with_nulls(read)), 6, "null_pct")


def _moments_sql(table: str, columns: list[str]) -> str:
    return sql_union(
        f"""SELECT '{c}' AS "column", min({c})::DOUBLE AS "min", max({c})::DOUBLE AS "max",
 round(avg({c}::DOUBLE), 4) AS "mean", round(stddev_samp({c}::DOUBLE), 4) AS std,
 round(quantile_cont({c}::DOUBLE, 0.25), 4) AS p25, round(quantile_cont({c}::DOUBLE, 0.5), 4) AS p50,
 round(quantile_cont({c}::DOUBLE, 0.75), 4) AS p75 FROM {table}"""
        for c in columns
    )


@query("profile_numeric_stats", _moments_sql(LINES, LINE_NUMBERS))
def numeric_stats(read):
    stats = profile.column_stats(lines_with_nulls(read)).where(F.col("kind") == "numeric")
    stats = stats.select("column", "min", "max", "mean", "std", "p25", "p50", "p75")
    return rounded(stats, 4, "mean", "std", "p25", "p50", "p75")


def _histogram_sql(table: str, columns: list[str]) -> str:
    return sql_union(
        f"""SELECT '{c}' AS "column", bin, round(any_value(mn + bin * w), 4) AS lower_edge, count(*) AS "count" FROM (
 SELECT mn, w, least(19, floor(({c}::DOUBLE - mn) / w))::INTEGER AS bin FROM {table},
 (SELECT min({c})::DOUBLE AS mn, (max({c})::DOUBLE - min({c})::DOUBLE) / 20 AS w FROM {table})
 WHERE {c} IS NOT NULL) GROUP BY bin"""
        for c in columns
    )


@query("profile_histogram", _histogram_sql(LINES, LINE_NUMBERS))
def histogram(read):
    return rounded(profile.histogram(lines_with_nulls(read)), 4, "lower_edge")


def _top_sql(table: str, columns: list[str]) -> str:
    return sql_union(
        f"""SELECT '{c}' AS "column", rank, value, "count" FROM (
 SELECT {c}::VARCHAR AS value, count(*) AS "count",
 row_number() OVER (ORDER BY count(*) DESC, {c}::VARCHAR) AS rank FROM {table} WHERE {c} IS NOT NULL GROUP BY {c})
 WHERE rank <= 10"""
        for c in columns
    )


@query("profile_top_values", _top_sql("orders", ORDER_OTHERS))
def top_values(read):
    return profile.top_values(read("orders"))


def _correlation_sql(table: str, columns: list[str], digits: int = 6) -> str:
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    parts = [f"SELECT '{c}' AS a, '{c}' AS b, 1.0::DOUBLE AS r" for c in columns]
    for a, b in pairs:
        r = f"round(coalesce(corr({a}::DOUBLE, {b}::DOUBLE), 0), {digits})"
        for x, y in ((a, b), (b, a)):
            parts.append(f"SELECT '{x}' AS a, '{y}' AS b, CASE WHEN isnan({r}) THEN 0 ELSE {r} END AS r FROM {table}")
    return sql_union(parts)


@query("profile_correlation", _correlation_sql(LINES, LINE_NUMBERS))
def correlation(read):
    return rounded(profile.correlation(lines_with_nulls(read)), 6, "r")


def _whole_profile_sql(table: str, numbers: list[str], others: list[str]) -> str:
    def unpivot(body: str, metrics: list[str]) -> str:
        return sql_union(
            f"SELECT 'columns' AS section, \"column\", '{m}' AS item, round(\"{m}\"::DOUBLE, 4) AS value FROM ({body})"
            for m in metrics
        )

    return sql_union(
        [
            unpivot(_nulls_distinct_sql(table, numbers + others), ["row_count", "nulls", "null_pct", "distinct"]),
            unpivot(_moments_sql(table, numbers), ["min", "max", "mean", "std", "p25", "p50", "p75"]),
            'SELECT \'histogram\' AS section, "column", bin::VARCHAR AS item, "count"::DOUBLE AS value'
            f" FROM ({_histogram_sql(table, numbers)})",
            'SELECT \'top_values\' AS section, "column", value AS item, "count"::DOUBLE AS value'
            f" FROM ({_top_sql(table, others)})",
            f"SELECT 'correlation' AS section, a, b, r FROM ({_correlation_sql(table, numbers, 4)})",
        ]
    )


@query("profile_table", _whole_profile_sql("orders", ORDER_NUMBERS, ORDER_OTHERS))
def profile_table(read):
    return rounded(profile.profile_long(profile.profile_table(read("orders"))), 4, "value")


# -- dictionary --------------------------------------------------------------

DESCRIBED = {
    "customer": {
        "c_custkey": "n", "c_name": "s", "c_nationkey": "n", "c_acctbal": "n", "c_mktsegment": "s",
    },
    "orders": {
        "o_orderkey": "n", "o_custkey": "n", "o_orderstatus": "s", "o_totalprice": "n", "o_orderdate": "t",
        "o_orderpriority": "s",
    },
    "pages": {"page_id": "n", "url": "s", "html": "s"},
    "events": {"event_id": "n", "ts": "t", "user_id": "n", "event_type": "s", "value": "n", "props": "s"},
}


def _smallest_sql(table: str, column: str) -> str:
    return f"SELECT DISTINCT {column}::VARCHAR AS v FROM {table} WHERE {column} IS NOT NULL ORDER BY v LIMIT 8"


def _samples_sql() -> str:
    return sql_union(
        f"""SELECT '{t}' AS "table", '{c}' AS "column", row_number() OVER (ORDER BY v) AS rank, v AS value
 FROM ({_smallest_sql(t, c)})"""
        for t, columns in DESCRIBED.items()
        for c in columns
    )


@query("dictionary_samples", _samples_sql())
def dictionary_samples(read):
    parts = [dictionary.samples(read(t)).select(F.lit(t).alias("table"), "*") for t in DESCRIBED]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionAll(part)
    return result


def _semantic_case(column: str, kind: str) -> str:
    """The whole rule chain in SQL, from the same fixed values."""
    if kind in "tb":
        return "'datetime'" if kind == "t" else "'boolean'"
    called = lambda pattern: f"regexp_matches('{column.lower()}', '{pattern}')"
    number = "true" if kind == "n" else "false"
    unique = "n > 0 AND d >= 0.9 * n"
    return f"""CASE WHEN {called(dictionary.ID_NAME)} AND {unique} THEN 'id'
 WHEN {number} AND {called(dictionary.MONEY_NAME)} THEN 'currency'
 WHEN {number} AND n > 20 AND d <= least(20, 0.05 * n) THEN 'category' WHEN {number} THEN 'numeric'
 WHEN emails THEN 'email' WHEN urls THEN 'url' WHEN moneys THEN 'currency' WHEN words THEN 'boolean'
 WHEN {unique} AND {called(dictionary.CODE_NAME)} THEN 'id'
 WHEN n > 0 AND d <= least(50, 0.5 * n) THEN 'category' ELSE 'text' END"""


def _semantic_sql(tables: dict[str, dict[str, str]], sources: dict[str, str] | None = None) -> str:
    words = ", ".join(f"'{w}'" for w in dictionary.BOOLEAN_WORDS)
    return sql_union(
        f"""SELECT '{t}' AS "table", '{c}' AS "column", {_semantic_case(c, kind)} AS semantic_type,
 round(100.0 * nulls / n, 6) AS null_pct, d AS distinct_count FROM
 (SELECT count(*) AS n, count(DISTINCT {c}) AS d, count(*) FILTER (WHERE {c} IS NULL) AS nulls FROM {source}),
 (SELECT bool_and(regexp_matches(v, '{dictionary.EMAIL_VALUE}')) AS emails,
 bool_and(regexp_matches(v, '{dictionary.URL_VALUE}')) AS urls,
 bool_and(regexp_matches(v, '{dictionary.MONEY_VALUE}')) AS moneys, bool_and(lower(v) IN ({words})) AS words
 FROM (SELECT {c}::VARCHAR AS v FROM {source}) WHERE v <> '')"""
        for t, columns in tables.items()
        for c, kind in columns.items()
        for source in [(sources or {}).get(t, t)]
    )


# Columns whose values share a pattern, and twins in which one late value does not.
CODED = """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'Yes' ELSE 'no' END AS flag,
 concat('$', CAST(o_custkey AS STRING), '.50') AS paid, concat('S-', CAST(o_orderkey AS STRING)) AS sku,
 concat('h', CAST(o_orderkey AS STRING)) AS row_hash, concat('u', CAST(o_custkey AS STRING), '@example.org') AS mail,
 CASE WHEN o_orderkey = last THEN 'zz' WHEN o_orderkey % 3 = 0 THEN 'Yes' ELSE 'no' END AS late_flag,
 CASE WHEN o_orderkey = last THEN 'zz' ELSE concat('u', CAST(o_custkey AS STRING), '@example.org') END AS late_mail,
 CASE WHEN o_orderkey = last THEN '' ELSE concat('https://x.example/', CAST(o_custkey AS STRING)) END AS link
 FROM orders, (SELECT max(o_orderkey) AS last FROM orders)"""
CODED_COLUMNS = {
    "coded": {
        "o_orderkey": "n", "flag": "s", "paid": "s", "sku": "s", "row_hash": "s", "mail": "s", "late_flag": "s",
        "late_mail": "s", "link": "s",
    }
}


@query("semantic_types_by_value", _semantic_sql(CODED_COLUMNS, {"coded": f"({CODED})"}))
def semantic_types_by_value(read):
    read("orders").createOrReplaceTempView("orders")
    coded = dictionary.dictionary(read.spark.sql(CODED), "coded")
    return rounded(coded.select("table", "column", "semantic_type", "null_pct", "distinct_count"), 6, "null_pct")


@query("semantic_types", _semantic_sql(DESCRIBED))
def semantic_types(read):
    result = None
    for t in DESCRIBED:
        one = dictionary.dictionary(read(t), t).select(
            "table", "column", "semantic_type", "null_pct", "distinct_count"
        )
        result = one if result is None else result.unionAll(one)
    return rounded(result, 6, "null_pct")


@query(
    "dictionary_merge",
    f"""SELECT "table", "column", semantic_type, distinct_count,
 CASE WHEN "column" IN ('c_name', 'c_acctbal') THEN 'about ' || "column" ELSE '' END AS description,
 CASE WHEN "column" IN ('c_name', 'c_acctbal') THEN 'kept' ELSE '' END AS tags
 FROM ({_semantic_sql({"customer": DESCRIBED["customer"]})}) WHERE "column" <> 'c_nationkey'""",
)
def dictionary_merge(read):
    customer = read("customer")
    old = dictionary.dictionary(customer.select("c_name", "c_acctbal", "c_nationkey"), "customer")
    old = old.withColumn("description", F.concat(F.lit("about "), "column"))
    old = old.withColumn("tags", F.array(F.lit("kept")))
    new = dictionary.dictionary(customer.drop("c_nationkey"), "customer")
    merged = dictionary.merge_dictionary(old, new)
    return merged.select(
        "table", "column", "semantic_type", "distinct_count", "description", F.array_join("tags", ",").alias("tags")
    )


# -- charts ------------------------------------------------------------------


@query(
    "chart_data_mean",
    "SELECT role AS x, (turn % 2)::INTEGER AS color, round(avg(length(text)), 4) AS y FROM conversations GROUP BY 1, 2",
)
def chart_mean(read):
    talk = read("conversations").select(
        "role", (F.col("turn") % 2).cast("int").alias("side"), F.length("text").alias("size")
    )
    return rounded(charts.chart_data(talk, "role", "size", "side", "mean"), 4, "y")


@query(
    "chart_data_median",
    "SELECT l_returnflag AS x, l_linestatus AS color, round(median(l_extendedprice), 4) AS y"
    " FROM lineitem GROUP BY 1, 2",
)
def chart_median(read):
    return rounded(charts.chart_data(read("lineitem"), "l_returnflag", "l_extendedprice", "l_linestatus", "median"), 4, "y")


@query("chart_data_count", "SELECT event_type AS x, count(*) AS y FROM events GROUP BY 1")
def chart_count(read):
    return charts.chart_data(read("events"), "event_type", aggregate="count")


@query(
    "chart_data_totals",
    """SELECT o_orderpriority AS x, 'sum' AS aggregate, round(sum(o_totalprice), 2) AS y FROM orders GROUP BY 1
 UNION ALL SELECT o_orderpriority, 'min', min(o_totalprice) FROM orders GROUP BY 1
 UNION ALL SELECT o_orderpriority, 'max', max(o_totalprice) FROM orders GROUP BY 1""",
)
def chart_totals(read):
    orders = read("orders")
    result = None
    for kind in ("sum", "min", "max"):
        one = charts.chart_data(orders, "o_orderpriority", "o_totalprice", aggregate=kind)
        one = one.select("x", F.lit(kind).alias("aggregate"), F.round("y", 2).alias("y"))
        result = one if result is None else result.unionAll(one)
    return result


@query("chart_data_points", "SELECT p_size AS x, p_brand AS color, p_retailprice AS y FROM part")
def chart_points(read):
    return charts.chart_data(read("part"), "p_size", "p_retailprice", "p_brand")


# -- the wide, the long and the nested ------------------------------------------

LINE_OTHERS = ["l_returnflag", "l_linestatus", "l_shipdate"]


@query("profile_lineitem", _whole_profile_sql("lineitem", LINE_NUMBERS, LINE_OTHERS))
def profile_lineitem(read):
    return rounded(profile.profile_long(profile.profile_table(read("lineitem"))), 4, "value")


WIDE = "(SELECT *, l_extendedprice * (1 - l_discount) AS net, l_quantity * l_tax AS duty FROM lineitem)"


@query("profile_correlation_wide", _correlation_sql(WIDE, [*LINE_NUMBERS, "net", "duty"]))
def correlation_wide(read):
    """More numeric columns than a screen shows."""
    wide = read("lineitem").selectExpr("*", "l_extendedprice * (1 - l_discount) AS net", "l_quantity * l_tax AS duty")
    return rounded(profile.correlation(wide), 6, "r")


# Forty columns of a few sources: powers and mixtures, some with nulls, one constant.
MANY_BASES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]
MANY = {
    f"m{i:02d}": (
        f"CASE WHEN l_linenumber % {i % 7 + 2} <> 0 THEN {MANY_BASES[i % 5]} * {i + 1} + {MANY_BASES[(i * 3 + 1) % 5]} * (l_partkey % {i + 2}) END"
        if i % 4
        else f"{MANY_BASES[i % 5]} + {MANY_BASES[(i + 2) % 5]} * (l_suppkey % {i + 3})"
    )
    for i in range(39)
} | {"m39": "1"}
MANY_TABLE = "(SELECT " + ", ".join(f"({e})::DOUBLE AS {n}" for n, e in MANY.items()) + " FROM lineitem)"


def _many_sql() -> str:
    """All correlations in one aggregate, turned into rows."""
    names = list(MANY)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    sums = ", ".join(f"round(coalesce(nullif(corr({a}, {b}), 'nan'::DOUBLE), 0), 6) AS {a}_{b}" for a, b in pairs)
    listed = ", ".join(f"'{n}'" for n in names)
    return f"""WITH sums AS MATERIALIZED (SELECT {sums} FROM {MANY_TABLE}),
 long AS MATERIALIZED (SELECT pair[1:3] AS a, pair[5:7] AS b, r FROM (FROM sums) UNPIVOT (r FOR pair IN (COLUMNS(*))))
 SELECT a, b, r FROM long UNION ALL SELECT b, a, r FROM long UNION ALL SELECT c, c, 1.0 FROM (SELECT unnest([{listed}]) AS c)"""


@query("profile_correlation_many", _many_sql())
def correlation_many(read):
    """Forty columns in one scan."""
    many = read("lineitem").selectExpr(*[f"CAST({e} AS DOUBLE) AS {n}" for n, e in MANY.items()])
    return rounded(profile.correlation(many), 6, "r")


LONG_TEXTS = {"documents": ["doc_id", "text", "lang", "source", "n_chars"], "benchmark": ["item_id", "text"], "embeddings": ["vec_id", "embedding", "label"]}


@query(
    "profile_long_and_nested",
    sql_union(f"SELECT '{t}' AS \"table\", * FROM ({_nulls_distinct_sql(t, columns)})" for t, columns in LONG_TEXTS.items()),
)
def long_and_nested(read):
    """Whole texts and vectors, counted by digest."""
    parts = [profile.nulls_and_distinct(read(t)).select(F.lit(t).alias("table"), "*") for t in LONG_TEXTS]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionAll(part)
    return rounded(result, 6, "null_pct")


EVENT_NUMBERS = ["event_id", "user_id", "value"]


@query(
    "profile_incremental",
    sql_union(
        f"""SELECT '{c}' AS "column", count(*) AS row_count, count(*) - count({c}) AS nulls, round(min({c})::DOUBLE, 4) AS min,
 round(max({c})::DOUBLE, 4) AS max, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, true AS distinct_close,
 true AS quartiles_close FROM events"""
        for c in EVENT_NUMBERS
    ),
)
def incremental(read):
    """A table that is appended to twice: every file is sketched once, and the sketches come close to the exact figures."""
    spark, events = read.spark, read("events").select(*EVENT_NUMBERS)
    table, store = scratch_path(spark, "appended"), scratch_path(spark, "sketches")
    for b in range(3):
        events.where(F.col("event_id") % 3 == b).write.mode("append").parquet(table)
        profile_store.update(spark, store, table)
    exact = profile.column_stats(events).select("column", *[F.col(c).alias(f"x_{c}") for c in ("distinct", "p25", "p50", "p75")])
    found = profile_store.profile(spark, store).join(exact, "column")
    near = [F.abs(F.col(p) - F.col(f"x_{p}")) <= 0.05 * (F.col("max") - F.col("min")) for p in ("p25", "p50", "p75")]
    found = found.select(
        "column", "row_count", "nulls", "min", "max", "mean", "std",
        (F.abs(F.col("distinct") - F.col("x_distinct")) <= 0.1 * F.col("x_distinct")).alias("distinct_close"),
        (near[0] & near[1] & near[2]).alias("quartiles_close"),
    )
    return rounded(found, 4, "min", "max", "mean", "std")
