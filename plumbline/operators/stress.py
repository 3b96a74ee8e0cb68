"""Stress harness: run a transform on damaged or scaled copies of its input.

Mutations are lazy plans over the same input.  The dense row index that some
of them need is written once and shared.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.columns import NUMERIC, col, kind_of
from plumbline.operators.contracts import Rule, first_line, measure_safely
from plumbline.operators.indexing import dense_index, total_order
from plumbline.plans.aggregates import row_fingerprint


# Size of the volume attack, injected numbers, padding, suffix.
VOLUME = 25
HUGE = 1e15
PADDING = "  "
UNICODE_SUFFIX = " 🦈—café—💥"

# Attacks that run at a time.
JOBS = 4

REPORT_SCHEMA = (
    "attack string, label string, status string, input_rows bigint, output_rows bigint, schema_changed boolean,"
    " contract_failures int, duration_ms double, message string"
)


@dataclass(frozen=True)
class Attack:
    key: str
    label: str
    description: str
    uses_index: bool = False
    changes_cardinality: bool = False


ATTACKS = {
    a.key: a
    for a in [
        Attack("baseline", "unchanged", "the real input, unchanged"),
        Attack("empty", "no rows", "zero rows", changes_cardinality=True),
        Attack("single_row", "first row only", "exactly one row", changes_cardinality=True),
        Attack("duplicates", "all rows twice", "every row twice", changes_cardinality=True),
        Attack("volume_x25", "25-fold input", "every row 25 times", changes_cardinality=True),
        Attack("null_bomb", "half the rows null", "every second row entirely null", uses_index=True),
        Attack("numeric_extremes", "extreme numbers", "huge, negative and zero numbers", uses_index=True),
        Attack("blank_strings", "half the texts empty", "every second text empty", uses_index=True),
        Attack("whitespace", "padded texts", "spaces around every text"),
        Attack("mixed_case", "changed letter case", "texts alternately upper and lower case", uses_index=True),
        Attack("unicode", "non-ASCII texts", "non-ASCII suffix on every text"),
    ]
}


def apply_attack(
    df: DataFrame, key: str, order_by: list[str] | None = None, indexed: DataFrame | None = None
) -> DataFrame:
    """The mutated input, same columns in the same order.

    ``indexed`` may pass the result of ``dense_index`` to share it; the index is
    its last column, whatever it is called.
    """
    attack = ATTACKS[key]
    if key == "baseline":
        return df
    if key == "empty":
        return df.limit(0)
    if key == "single_row":
        return df.orderBy(*total_order(df, order_by)).limit(1)
    if key == "duplicates":
        return df.unionAll(df)
    if key == "volume_x25":
        copies = F.explode(F.sequence(F.lit(1), F.lit(VOLUME)))
        return df.select("*", copies.alias("__copy")).drop("__copy")
    source = (dense_index(df, order_by) if indexed is None else indexed) if attack.uses_index else df
    return source.select(*[_mutated(key, f, source.columns[-1]).alias(f.name) for f in df.schema.fields])


def _mutated(key: str, field: T.StructField, index_name: str) -> Column:
    value, index = col(field.name), col(index_name)
    even = index % 2 == 0
    if key == "null_bomb":
        return F.when(even, value)
    if key == "numeric_extremes" and kind_of(field.dataType) == NUMERIC:
        turn = index % 4
        return (
            F.when(turn == 0, F.lit(HUGE))
            .when(turn == 1, F.lit(-HUGE))
            .when(turn == 2, F.lit(0.0))
            .otherwise(value.cast("double"))
        )
    if not isinstance(field.dataType, T.StringType):
        return value
    texts = {
        "blank_strings": lambda: F.when(even, F.lit("")).otherwise(value),
        "whitespace": lambda: F.concat(F.lit(PADDING), value, F.lit(PADDING)),
        "mixed_case": lambda: F.when(even, F.upper(value)).otherwise(F.lower(value)),
        "unicode": lambda: F.concat(value, F.lit(UNICODE_SUFFIX)),
    }
    return texts[key]() if key in texts else value


def input_rows(key: str, rows: int) -> int:
    """Size of the mutated input; attacks change it by construction only."""
    sizes = {"empty": 0, "single_row": min(1, rows), "duplicates": 2 * rows, "volume_x25": VOLUME * rows}
    return sizes.get(key, rows)


def sql_transform(sql: str, reads: str = "input") -> Callable[[DataFrame], DataFrame]:
    """Make a transform of a SQL text that reads the view ``reads``.

    The view is swapped while the statement is analysed and put back at once;
    the resulting plan keeps reading the mutated rows.
    """

    def run(df: DataFrame) -> DataFrame:
        spark: SparkSession = df.sparkSession
        before = spark.table(reads) if spark.catalog.tableExists(reads) else None
        was_view = before is not None and spark.catalog.getTable(reads).isTemporary
        df.createOrReplaceTempView(reads)
        try:
            return spark.sql(sql.strip().rstrip(";"))
        finally:
            if was_view:
                before.createOrReplaceTempView(reads)
            else:
                spark.catalog.dropTempView(reads)

    return run


def _judge(out: DataFrame, rules: list[Rule]) -> tuple[int, int]:
    """Output rows and failed rules; every column of every row is computed."""
    found = measure_safely(out, rules, {"fingerprint": row_fingerprint(out)})
    return found.total, sum(1 for failing in found.failing if failing != 0)


def stress_test(
    transform: Callable[[DataFrame], DataFrame] | str,
    df: DataFrame,
    rules: list[Rule] | None = None,
    attacks: list[str] | None = None,
    order_by: list[str] | None = None,
    jobs: int = JOBS,
) -> DataFrame:
    """Run every attack and grade it: ok, warning or error.

    ``transform`` is a function of the input, or SQL text reading ``input``.  At most
    ``jobs`` attacks run at a time, each in a scheduler pool of its own, so that a short
    one need not wait for a long one (with ``spark.scheduler.mode`` FAIR, as
    ``get_session`` sets it).  The transform itself is called for one attack after another.
    """
    run = sql_transform(transform) if isinstance(transform, str) else transform
    spark = df.sparkSession
    chosen = [ATTACKS[k] for k in attacks or ATTACKS]
    rows = df.count()
    indexed = dense_index(df, order_by) if any(a.uses_index for a in chosen) else None
    one_at_a_time = threading.Lock()

    def measured(attack: Attack) -> Outcome:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"stress-{attack.key}")
        started = time.monotonic()
        found = Outcome()
        try:
            with one_at_a_time:
                out = run(apply_attack(df, attack.key, order_by, indexed))
                found.columns = out.columns
            found.rows, found.failed = _judge(out, rules or [])
        except Exception as error:  # a transform may raise anything
            found.error = first_line(error)
        found.duration_ms = 1000.0 * (time.monotonic() - started)
        return found

    with ThreadPoolExecutor(max(1, jobs)) as pool:
        started = [pool.submit(inheritable_thread_target(spark)(measured), attack) for attack in chosen]
        outcomes = [s.result() for s in started]
    expected = next((o.columns for a, o in zip(chosen, outcomes) if a.key == "baseline" and o.error is None), None)
    report = [_graded(a, o, rows, expected, bool(rules)) for a, o in zip(chosen, outcomes)]
    return spark.createDataFrame(report, REPORT_SCHEMA)


@dataclass
class Outcome:
    """What a transform made of one attack."""

    columns: list[str] | None = None
    rows: int | None = None
    failed: int = 0
    error: str | None = None
    duration_ms: float = 0.0


def _graded(attack: Attack, found: Outcome, rows: int, expected: list[str] | None, has_rules: bool) -> tuple:
    """A row of the report."""
    grade, message, changed = "ok", None, False
    if found.error is not None:
        grade, message = "error", found.error
    else:
        if attack.key != "baseline" and expected is not None and found.columns != expected:
            changed, grade, message = True, "warning", "output schema changed"
        if has_rules and found.failed:
            grade, message = "warning", f"{found.failed} contract rule(s) failed"
    failures = found.failed if has_rules and found.error is None else None
    size = input_rows(attack.key, rows)
    return (attack.key, attack.label, grade, size, found.rows, changed, failures, found.duration_ms, message)
