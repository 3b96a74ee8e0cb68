"""Python code over the rows of each group, with groups that fit and groups that do not.

``apply_groups`` hands a whole group to the code.  Group sizes are counted first, and a
group above the bound is an error that says so, never a lost executor.

``combine_groups`` takes groups of any size: large ones are cut into slices, the code
reduces each slice to a few rows, and these are merged, again in slices where there are
many, until a group's rows fit one call.  What never fits, such as the set of a group's
users, is dealt out by its values and closed piece by piece (``Apart``).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import col, groupable
from plumbline.operators.indexing import free_name
from plumbline.plans.durable import materialise

#: Rows that one call of group code may get, and rows that a slice aims at.
MAX_GROUP_ROWS = 1_000_000
SLICE_ROWS = 100_000
#: Large groups, or values of them, whose list is broadcast; longer lists are joined by a shuffle.
MAX_BROADCAST = 1_000_000

Frames = Callable[[pd.DataFrame], pd.DataFrame]


class GroupTooLarge(ValueError):
    """A group holds more rows than its code may get at once."""


@dataclass(frozen=True)
class Apart:
    """How merged rows of a group become few when ``merge`` cannot make them so.

    ``merge`` mixes no two values of ``columns`` of the partial schema and leaves one row of
    each, say.  ``close`` gets, merged, all rows that a group has of some of these values and
    turns them into rows of ``schema`` (DDL).  ``add`` turns any of those rows of a group,
    which come of different values, into fewer, and must be associative and commutative.
    """

    columns: list[str]
    close: Frames
    add: Frames
    schema: str


def apply_groups(df: DataFrame, by: list[str], fn: Frames, schema: str, max_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """The key columns and what ``fn`` returns for all rows of each group.

    ``fn`` gets a pandas frame with every column of ``df`` and returns one with the columns
    of ``schema`` (DDL), which names no key column.  Rows come in no particular order.
    Null keys are a group; an empty table gives an empty result.
    """
    n = F.col("n")
    sizes = _sizes(df, by).agg(F.max(n).alias("most"), F.count_if(n > max_rows).alias("large")).first()
    if sizes.large:
        raise GroupTooLarge(
            f"{sizes.large} groups of {', '.join(by)} hold more than {max_rows} rows, the largest {sizes.most};"
            " use combine_groups, or raise max_rows if a task's memory allows"
        )
    return _applied(df, by, [], fn, schema)


def combine_groups(
    df: DataFrame,
    by: list[str],
    partial: Frames,
    merge: Frames,
    finish: Frames,
    partial_schema: str,
    schema: str,
    slice_rows: int = SLICE_ROWS,
    apart: Apart | None = None,
) -> DataFrame:
    """The key columns and what ``finish`` returns for each group, in slices of about ``slice_rows``.

    ``partial`` turns rows of a group into rows of ``partial_schema``; ``merge`` turns any
    such rows of a group into fewer; ``finish`` gets the last of them.  All three may see
    rows in any order and grouping, so ``merge`` must be associative and commutative.

    A group that has more merged rows than ``slice_rows`` is an error unless ``apart`` says
    how to close them; ``finish`` then gets the last rows of its ``add``, for every group.
    """
    parts = _sliced(df, by, partial, partial_schema, slice_rows)
    if apart is None:
        return _finished(parts, by, merge, finish, partial_schema, schema, slice_rows)
    closed = _closed(parts, by, merge, partial_schema, slice_rows, apart)
    return _finished(closed, by, apart.add, finish, apart.schema, schema, slice_rows)


def _finished(
    parts: DataFrame, by: list[str], merge: Frames, finish: Frames, partial_schema: str, schema: str, slice_rows: int
) -> DataFrame:
    before = None
    while True:
        most = _sizes(parts, by).agg(F.max("n")).first()[0] or 0
        if most <= slice_rows:
            return _applied(parts, by, [], lambda rows: finish(merge(rows)), schema)
        if before is not None and most >= before:
            raise GroupTooLarge(
                f"merging leaves {most} rows of a group; merge has to return fewer rows than it gets,"
                " or apart to say how many rows are closed"
            )
        parts, before = _sliced(parts, by, merge, partial_schema, slice_rows), most


def _closed(parts: DataFrame, by: list[str], merge: Frames, schema: str, slice_rows: int, apart: Apart) -> DataFrame:
    """Closed rows: all rows of a value meet in one slice, once no value has more rows than that."""
    before, close = None, apart.close
    while True:
        place = free_name(parts, "__slice")
        groups, values = _large(parts, by, "of", slice_rows), _large(parts, [*by, *apart.columns], "in", slice_rows)
        most = values.agg(F.max("__in_n")).first()[0] or 0
        if before is not None and most >= before:
            raise GroupTooLarge(
                f"merging leaves {most} rows of one value of {', '.join(apart.columns)};"
                " merge has to return fewer rows than it gets"
            )
        slices, pieces = (F.coalesce(f"__{of}_slices", F.lit(1)) for of in ("of", "in"))
        # Rows are read as they were written, so a task that runs again numbers them alike.
        met = parts.withColumn(place, F.monotonically_increasing_id())
        met = _meet(_meet(met, by, "of", groups), [*by, *apart.columns], "in", values)
        home = F.pmod(F.xxhash64(*[groupable(parts, c) for c in apart.columns]), slices)
        dealt = met.withColumn(place, F.pmod(home + F.pmod(F.col(place), pieces), slices)).select(
            *[col(c) for c in parts.columns], place
        )
        if not most:
            closed = _applied(dealt, by, [place], lambda rows: close(merge(rows)), apart.schema)
            return materialise(closed, "group-parts")
        parts, before = materialise(_applied(dealt, by, [place], merge, schema), "group-parts"), most


def _sizes(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*[col(k) for k in by]).agg(F.count(F.lit(1)).alias("n"))


def _large(df: DataFrame, by: list[str], of: str, slice_rows: int) -> DataFrame:
    """Groups of more rows than a slice: keys, rows and slices, named after ``of``."""
    n = F.col(f"__{of}_n")
    keyed = df.select(*[col(k).alias(f"__{of}{i}") for i, k in enumerate(by)])
    large = keyed.groupBy(*keyed.columns).agg(F.count(F.lit(1)).alias(f"__{of}_n")).where(n > slice_rows)
    return materialise(large.withColumn(f"__{of}_slices", F.ceil(n / slice_rows)), "large-groups")


def _meet(df: DataFrame, by: list[str], of: str, large: DataFrame) -> DataFrame:
    """The rows, with the columns of their group's entry in ``large`` or nulls."""
    listed = large.drop(f"__{of}_n")
    if large.count() <= MAX_BROADCAST:
        listed = F.broadcast(listed)
    return df.join(listed, [col(k).eqNullSafe(F.col(f"__{of}{i}")) for i, k in enumerate(by)], "left")


def _sliced(df: DataFrame, by: list[str], fn: Frames, schema: str, slice_rows: int) -> DataFrame:
    """``fn`` over slices of each group; only the list of large groups meets the rows."""
    place = free_name(df, "__slice")
    met = _meet(df, by, "of", _large(df, by, "of", slice_rows))
    # The partition spreads rows that are equal in all columns.
    spread = F.xxhash64(*[groupable(df, c) for c in df.columns], F.spark_partition_id())
    sliced = met.withColumn(place, F.pmod(spread, F.coalesce("__of_slices", F.lit(1)))).select(
        *[col(c) for c in df.columns], place
    )
    return materialise(_applied(sliced, by, [place], fn, schema), "group-parts")


def _applied(df: DataFrame, by: list[str], more: list[str], fn: Frames, schema: str) -> DataFrame:
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    keys = ", ".join(f"`{k.replace('`', '``')}` {kinds[k]}" for k in by)

    shown = {f"c{i}": c for i, c in enumerate(df.columns) if c not in more}

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        found = fn(rows[list(shown)].rename(columns=shown))
        out = pd.DataFrame({k: pd.Series([key[i]] * len(found), dtype=object) for i, k in enumerate(by)})
        return pd.concat([out, found.reset_index(drop=True)], axis=1)

    # A name with a dot in it would not be found again.
    plain = df.select(*[col(c).alias(f"c{i}") for i, c in enumerate(df.columns)])
    place = {c: f"c{i}" for i, c in enumerate(df.columns)}
    return plain.groupBy(*[place[k] for k in by], *[place[m] for m in more]).applyInPandas(run, f"{keys}, {schema}")
