"""Compare registered queries with their SQL on DuckDB.

    python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import logging
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels"
    " conversations"
).split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    return con


def _plain(value):
    if value is None or isinstance(value, (str, bool)):
        return value
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    try:
        number = float(value)
    except (TypeError, ValueError):
        return str(value)
    if math.isnan(number):
        return "nan"
    return 0.0 if number == 0 else number


def normal(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name: str, sf_dir: str) -> str | None:
    """None if the query matches its SQL, otherwise what differs."""
    import __spark_entry__ as entry

    df = entry.queries()[name](spark, sf_dir)
    mine = df.collect()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return None if mine else "no rows"
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    theirs = cursor.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    left, right = normal(df.columns, mine), normal(names, theirs)
    if len(left) != len(right):
        return f"{len(left)} rows != {len(right)} rows"
    bad = [(a, b) for a, b in zip(left, right) if a != b]
    return f"{len(bad)} of {len(left)} rows differ, e.g. {bad[0][0]} != {bad[0][1]}" if bad else None


def main() -> int:
    import __spark_entry__ as entry

    from plumbline.session import get_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(entry.queries())
    spark = get_session(
        master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__driver__memory="8g"
    )
    spark.sparkContext.setLogLevel("OFF")
    logging.getLogger("DataFrameQueryContextLogger").disabled = True
    con = connect(sf_dir)
    failed = 0
    for name in names:
        start = time.monotonic()
        try:
            problem = compare(spark, con, name, sf_dir)
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        kind = "sql " if name in entry.oracle_sql() else "rows"
        print(f"{'ok  ' if problem is None else 'FAIL'} {kind} {time.monotonic() - start:6.2f}s {name} {problem or ''}", flush=True)
        failed += problem is not None
    print(f"{len(names) - failed} of {len(names)} match")
    return failed


if __name__ == "__main__":
    sys.exit(main())
