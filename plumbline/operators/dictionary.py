"""Data dictionary: what each column holds and what it probably means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import BOOLEAN, DATETIME, NUMERIC, STRING, as_text, kinds, name_lookup
from plumbline.operators.profile import nulls_and_distinct
from plumbline.plans.aggregates import melt, one_row
from plumbline.plans.ranking import smallest_values

SAMPLE_SIZE = 8

# The name hints, value patterns and word list of the classifier.
ID_NAME = r"(^|_)(id|uuid|guid|key)\z|_id\z"
CODE_NAME = r"(^|_)(id|code|sku|hash)"
MONEY_NAME = r"price|amount|cost|revenue|salary|fee|usd|eur|gbp|balance|total"
EMAIL_VALUE = r"^[^@\s]+@[^@\s]+\.[^@\s]+\z"
URL_VALUE = r"^(?i)(https?://|www\.)"
MONEY_VALUE = r"^[$€£¥]\s?-?[\d,]+(\.\d+)?\z"
BOOLEAN_WORDS = ["true", "false", "yes", "no", "t", "f", "0", "1", "y", "n"]

# Share of the rows that bounds the search for the smallest values.
BOUND_SHARE = 0.001


def samples(df: DataFrame, k: int = SAMPLE_SIZE) -> DataFrame:
    """(column, rank, value): the k smallest distinct values of every column.

    The k-th smallest value among any handful of rows is an upper bound for
    the k-th smallest of the table, so a first look at a sample of all
    partitions gives a filter that removes almost everything before the
    distinct shuffle.  The bound never decides the answer: every row is still compared with it, and
    a column without k values in that look is not filtered at all.
    """
    names = df.columns
    text = {n: as_text(df, n) for n in names}

    def distinct_values(rows: DataFrame, values: dict[str, Column]) -> DataFrame:
        found = melt(rows, values).distinct()
        return found.select(name_lookup(names, F.col("column_id")).alias("column"), "value")

    first_look = smallest_values(distinct_values(df.sample(BOUND_SHARE, seed=0), text), k)
    bound = {r.column: r.value for r in first_look.where(F.col("rank") == k).collect()}
    kept = {n: F.when(v <= F.lit(bound[n]), v) if n in bound else v for n, v in text.items()}
    return smallest_values(distinct_values(df, kept), k).select("column", "rank", "value")


def dictionary(df: DataFrame, table: str, approx: bool = False) -> DataFrame:
    """One row per column, with its inferred semantic type and sample values."""
    stats = nulls_and_distinct(df, approx)
    kind = kinds(df)
    pattern = matching_pattern(df)
    described = [
        (i, n, f.dataType.simpleString(), kind[n], pattern.get(n)) for i, (n, f) in enumerate(zip(df.columns, df.schema))
    ]
    types = df.sparkSession.createDataFrame(
        described, "position int, column string, physical_type string, kind string, pattern string"
    )
    ordered = F.array_sort(F.collect_list(F.struct("rank", "value")))
    sample = samples(df).groupBy("column").agg(F.transform(ordered, lambda s: s["value"]).alias("sample_values"))
    joined = types.join(stats, "column").join(sample, "column", "left")
    sample_values = F.coalesce("sample_values", F.array().cast("array<string>"))
    return joined.select(
        F.lit(table).alias("table"),
        "position",
        "column",
        "physical_type",
        semantic_type("column", "kind", "distinct", "row_count", "pattern").alias("semantic_type"),
        "null_pct",
        F.col("distinct").alias("distinct_count"),
        sample_values.alias("sample_values"),
        F.lit("").alias("description"),
        F.array().cast("array<string>").alias("tags"),
    )


def value_patterns(value: Column) -> dict[str, Column]:
    """The patterns that all values of a text column may share, in order of precedence."""
    return {
        "email": value.rlike(EMAIL_VALUE),
        "url": value.rlike(URL_VALUE),
        "currency": value.rlike(MONEY_VALUE),
        "boolean": F.lower(value).isin(BOOLEAN_WORDS),
    }


def matching_pattern(df: DataFrame) -> dict[str, str]:
    """The first pattern that every non-empty value of a text column has, counted over the whole table."""
    names = [n for n, kind in kinds(df).items() if kind == STRING]
    exprs: dict[object, Column] = {}
    for n in names:
        value = as_text(df, n)
        exprs[n, "filled"] = F.count_if(value != "")
        exprs |= {(n, p): F.count_if((value != "") & test) for p, test in value_patterns(value).items()}
    seen = one_row(df, exprs) if exprs else {}
    found: dict[str, str] = {}
    for (n, p), count in seen.items():
        if p != "filled" and count and count == seen[n, "filled"]:
            found.setdefault(n, p)
    return found


def semantic_type(column: str, kind: str, distinct: str, rows: str, pattern: str) -> Column:
    """Rule chain over one dictionary row; the first rule that fits decides."""
    name = F.lower(column)
    is_numeric = F.col(kind) == NUMERIC
    nearly_unique = (F.col(rows) > 0) & (F.col(distinct) >= F.col(rows) * 0.9)

    few_codes = (F.col(rows) > 20) & (F.col(distinct) <= F.least(F.lit(20.0), F.col(rows) * 0.05))
    few_words = (F.col(rows) > 0) & (F.col(distinct) <= F.least(F.lit(50.0), F.col(rows) * 0.5))
    return (
        F.when(F.col(kind) == BOOLEAN, "boolean")
        .when(F.col(kind) == DATETIME, "datetime")
        .when(name.rlike(ID_NAME) & nearly_unique, "id")
        .when(is_numeric & name.rlike(MONEY_NAME), "currency")
        .when(is_numeric & few_codes, "category")
        .when(is_numeric, "numeric")
        .when(F.col(pattern).isNotNull(), F.col(pattern))
        .when(nearly_unique & name.rlike(CODE_NAME), "id")
        .when(few_words, "category")
        .otherwise("text")
    )


def merge_dictionary(old: DataFrame, new: DataFrame) -> DataFrame:
    """Fresh statistics with the descriptions and tags written for the old ones.

    Columns that no longer exist disappear; new columns start blank.
    """
    notes = old.select("table", "column", F.col("description").alias("old_note"), F.col("tags").alias("old_tags"))
    merged = new.join(notes, ["table", "column"], "left")
    return merged.select(
        *[F.col(c) for c in new.columns if c not in ("description", "tags")],
        F.coalesce("old_note", "description").alias("description"),
        F.coalesce("old_tags", "tags").alias("tags"),
    )
