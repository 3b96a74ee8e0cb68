"""Data contracts: rules a table must satisfy, with exact violation counts.

Row-local rules of a contract share one aggregate over the table.  Each
``unique`` rule needs its own grouping; those run together as a second job.
What cannot work is found beforehand from types, and text that is no number is
counted in the same pass.  Should a shared job fail all the same, the rules are
evaluated one at a time so that only the faulty ones report an error.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.columns import as_text, col, groupable
from plumbline.plans.aggregates import one_row, union_all

RULE_TYPES = ("not_null", "unique", "range", "allowed_values", "regex", "row_count")

RESULT_SCHEMA = (
    "table string, rule_id string, rule_type string, column string, passed boolean, failing_rows bigint,"
    " total bigint, detail string, description string"
)


@dataclass(frozen=True)
class Rule:
    id: str
    type: str
    column: str | None = None
    min: float | None = None
    max: float | None = None
    values: tuple[str, ...] = ()
    pattern: str = ""


class RuleError(ValueError):
    """A rule that cannot be evaluated against its table."""


@dataclass
class Measured:
    """Raw outcome of one evaluation: the table's size and a count per rule."""

    total: int
    failing: list[int]
    details: list[str | None]
    extra: dict


def describe(rule: Rule) -> str:
    def bound(value: float | None, missing: str) -> str:
        if value is None:
            return missing
        return str(int(value)) if float(value).is_integer() else str(value)

    texts = {
        "not_null": f"every row has {rule.column}",
        "unique": f"no two rows share {rule.column}",
        "range": f"{rule.column} from {bound(rule.min, 'any')} to {bound(rule.max, 'any')}",
        "allowed_values": f"{rule.column} is one of: {', '.join(rule.values)}",
        "regex": f"{rule.column} fits the pattern {rule.pattern}",
        "row_count": f"rows from {bound(rule.min, '0')} to {bound(rule.max, 'any')}",
    }
    return texts.get(rule.type, rule.type)


def _checked(df: DataFrame, rule: Rule) -> Rule:
    if rule.type not in RULE_TYPES:
        raise RuleError(f"unknown rule type: {rule.type}")
    if rule.type != "row_count" and not rule.column:
        raise RuleError("rule has no column")
    if rule.type != "row_count" and rule.column not in df.columns:
        raise RuleError(f"column not found: {rule.column}")
    return rule


def static_error(df: DataFrame, rule: Rule) -> str | None:
    """Why a rule cannot work on this table, found without reading any row."""
    try:
        _checked(df, rule)
        if rule.type == "regex":
            # Folded on the driver: fails here if the pattern does not compile.
            df.sparkSession.sql("SELECT '' RLIKE :pattern", args={"pattern": rule.pattern}).collect()
        if is_local(rule):
            df.select(violation(df, rule))
    except (PySparkException, RuleError) as error:
        return first_line(error)
    return None


def violation(df: DataFrame, rule: Rule) -> Column:
    """True for rows that break a row-local rule; nulls break only ``not_null``."""
    value = col(_checked(df, rule).column)
    if rule.type == "not_null":
        return value.isNull()
    if rule.type == "range":
        # Text is compared as numbers; values that are none are counted apart.
        value = value.try_cast("double") if reads_text(df, rule) else value
        outside = F.lit(False)
        if rule.min is not None:
            outside = outside | (value < F.lit(rule.min))
        if rule.max is not None:
            outside = outside | (value > F.lit(rule.max))
        return value.isNotNull() & outside
    if rule.type == "allowed_values":
        return value.isNotNull() & ~as_text(df, rule.column).isin(list(rule.values) or [""])
    return value.isNotNull() & ~as_text(df, rule.column).rlike(rule.pattern)


def reads_text(df: DataFrame, rule: Rule) -> bool:
    """Does a range rule with numbers look at a text column?"""
    numbers = [b for b in (rule.min, rule.max) if isinstance(b, (int, float))]
    return rule.type == "range" and bool(numbers) and isinstance(df.schema[rule.column].dataType, T.StringType)


def duplicated_rows(df: DataFrame, rule: Rule) -> DataFrame:
    """One row: how many rows share their non-null key with another row."""
    key = groupable(df, _checked(df, rule).column).alias("key")
    groups = df.select(key).where(F.col("key").isNotNull()).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return groups.where(F.col("n") > 1).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("failing"))


def measure(df: DataFrame, rules: list[Rule], extra: Mapping[object, Column] | None = None) -> Measured:
    """Count violations; ``extra`` aggregates ride along in the same pass."""
    total = ("total",)
    local = {("rule", i): F.count_if(violation(df, r)) for i, r in enumerate(rules) if is_local(r)}
    texts = {i: col(r.column) for i, r in enumerate(rules) if is_local(r) and reads_text(df, r)}
    local |= {("unread", i): F.count_if(v.isNotNull() & v.try_cast("double").isNull()) for i, v in texts.items()}
    seen = one_row(df, {total: F.count(F.lit(1))} | local | dict(extra or {}))
    failing = {i: seen["rule", i] for i, r in enumerate(rules) if is_local(r)}
    unique = [(i, r) for i, r in enumerate(rules) if r.type == "unique"]
    if unique:
        counts = [duplicated_rows(df, r).select(F.lit(i).alias("i"), "failing") for i, r in unique]
        failing |= {row.i: row.failing for row in union_all(counts).collect()}
    details: list[str | None] = [None] * len(rules)
    for i in texts:
        if seen["unread", i]:
            failing[i], details[i] = -1, f"{seen['unread', i]} values of {rules[i].column} are not numbers"
    for i, rule in enumerate(rules):
        if rule.type == "row_count":
            low = rule.min is not None and seen[total] < rule.min
            high = rule.max is not None and seen[total] > rule.max
            failing[i] = int(low or high)
            details[i] = f"{seen[total]} rows"
    extras = {key: seen[key] for key in extra or {}}
    return Measured(seen[total], [failing[i] for i in range(len(rules))], details, extras)


def is_local(rule: Rule) -> bool:
    return rule.type not in ("row_count", "unique")


def measure_isolated(df: DataFrame, rules: list[Rule]) -> Measured:
    """Evaluate rule by rule; a rule that fails counts -1 and says why."""
    total = df.count()
    failing, details = [], []
    for rule in rules:
        try:
            one = measure(df, [rule])
            failing.append(one.failing[0])
            details.append(one.details[0])
        except PySparkException as error:
            failing.append(-1)
            details.append(first_line(error))
    return Measured(total, failing, details, {})


def first_line(error: Exception) -> str:
    text = str(error).strip()
    return text.splitlines()[0] if text else type(error).__name__


def evaluate(df: DataFrame, table: str, rules: list[Rule]) -> DataFrame:
    """Check every rule of a contract; one result row per rule."""
    return df.sparkSession.createDataFrame(_result_rows(df, table, rules), RESULT_SCHEMA)


def measure_safely(df: DataFrame, rules: list[Rule], extra: Mapping[object, Column] | None = None) -> Measured:
    """``measure``, with -1 and a message for every rule that cannot be evaluated.

    ``extra`` aggregates must work whatever becomes of the rules; their own
    failure is passed on.
    """
    errors = [static_error(df, r) for r in rules]
    sound = [r for r, error in zip(rules, errors) if error is None]
    try:
        found = measure(df, sound, extra)
    except PySparkException:
        extras = one_row(df, extra or {})
        found = measure_isolated(df, sound)
        found.extra = extras
    outcomes = iter(zip(found.failing, found.details))
    merged = [next(outcomes) if error is None else (-1, error) for error in errors]
    return Measured(found.total, [f for f, _ in merged], [d for _, d in merged], found.extra)


def _result_rows(df: DataFrame, table: str, rules: list[Rule]) -> list[tuple]:
    found = measure_safely(df, rules)
    return [
        (table, r.id, r.type, r.column, failing == 0, failing, found.total, detail, describe(r))
        for r, failing, detail in zip(rules, found.failing, found.details)
    ]


def evaluate_all(tables: Mapping[str, DataFrame], contracts: Mapping[str, list[Rule]]) -> DataFrame:
    """Check the contracts of all tables that exist; the others are skipped."""
    present = {t: rules for t, rules in contracts.items() if rules and t in tables}
    rows = [row for t, rules in present.items() for row in _result_rows(tables[t], t, rules)]
    return SparkSession.active().createDataFrame(rows, RESULT_SCHEMA)


def summarize(results: DataFrame) -> DataFrame:
    """Passed, failed and errored rules per table."""
    errored = F.col("failing_rows") < 0
    return results.groupBy("table").agg(
        F.count_if(~errored & F.col("passed")).alias("passed"),
        F.count_if(~errored & ~F.col("passed")).alias("failed"),
        F.count_if(errored).alias("errored"),
    )
