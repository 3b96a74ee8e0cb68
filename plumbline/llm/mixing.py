"""Mix sources to target weights with Sainte-Laguë apportionment.

The tokens that the mix takes are cut into equal blocks.  Blocks go to sources,
and within a source to its shards, by the highest quotients ``votes / (2j + 1)``.
A shard lays its documents on a circle in seeded order and hands out its quota of
blocks from a seeded origin: whole turns first, then one arc.  No token is taken
more than ``max_repeats`` times; what a shard cannot give for that goes to the other
shards of its source, and a source with shards smaller than a block counts in tokens.

All steps are DataFrame expressions.  Only two numbers reach the driver (tokens
and rows in all); windows over all rows exist only over the table of sources.

Null or empty text has size 0 and is never taken; very long texts are counted whole and
may be taken in part; a null source is a source and comes last; null ids share a place;
ties of quotients go to the first source, or shard, and rows at one place go by id and
size; repeated rows count each; an empty table gives an empty result.  Columns to keep
travel as ``k_<name>``, so they may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.text import WORD, n_words
from plumbline.plans.durable import materialise

#: Weights of the sources in code point order, repeated.
WEIGHTS = (5, 2, 1)
#: Blocks that the mix consists of: the resolution of the shares.
BLOCKS = 100_000
#: Tokens per shard that are aimed at, and the largest number of shards.
SHARD_TOKENS = 1 << 20
MAX_SHARDS = 4096
SEED = 42


def seeded(*parts: Column | str | int) -> Column:
    """A number below 2**60 that depends on the seed and the parts only."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def apportion(df: DataFrame, keys: list[str], row: list[str], votes: str, seats: Column) -> DataFrame:
    """Add ``quota``: the seats that ``votes`` win by highest quotients within ``keys``.

    Ties go to the first row in the order of ``row`` (nulls last).  A row surely
    wins the seats it has at the largest possible divisor and never more than at
    the smallest, so only the few quotients between are ranked.
    """
    group = Window.partitionBy(*[F.col(k) for k in keys]) if keys else Window.partitionBy(F.lit(0))
    n, total = F.count(F.lit(1)).over(group), F.sum(votes).over(group)
    df = df.withColumn("_seats", F.when(total > 0, seats).otherwise(0).cast("long")).withColumn(
        "_ideal", F.when(total > 0, F.col(votes) * F.col("_seats") / total).otherwise(0.0)
    )
    slack = F.when(F.col("_seats") > 0, n / (2 * F.col("_seats"))).otherwise(0.0)
    df = df.withColumn("_sure", F.greatest(F.lit(0), F.floor(F.col("_ideal") * (1 - slack) - 1.5)).cast("long"))
    df = df.withColumn("_most", F.when(F.col(votes) > 0, F.ceil(F.col("_ideal") * (1 + slack) + 1.5)).otherwise(0).cast("long"))
    df = df.withColumn("_open", F.col("_seats") - F.sum("_sure").over(group))
    order = [F.col("_quotient").desc(), *[F.col(r).asc_nulls_last() for r in row], F.col("_j")]
    quotients = (
        df.where("_most > _sure")
        .select(*keys, *row, votes, "_open", F.explode(F.sequence(F.col("_sure"), F.col("_most") - 1)).alias("_j"))
        .withColumn("_quotient", F.col(votes) / (2 * F.col("_j") + 1))
        .withColumn("_rank", F.row_number().over(group.orderBy(*order)))
        .where("_rank <= _open")
    )
    names = [*keys, *row]
    won = quotients.groupBy(*[F.col(c).alias(f"_w_{c}") for c in names]).agg(F.count(F.lit(1)).alias("_won"))
    same = [F.col(c).eqNullSafe(F.col(f"_w_{c}")) for c in names]
    return (
        df.join(won, same, "left")
        .withColumn("quota", F.col("_sure") + F.coalesce("_won", F.lit(0)))
        .drop("_seats", "_ideal", "_sure", "_most", "_open", "_won", *[f"_w_{c}" for c in names])
    )


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = 3) -> DataFrame:
    """``_source, source_size`` to ``_source, source_size, target``.

    A target stops at ``max_repeats`` times its source; the excess goes to the
    others by weight.  The common level is the largest of the levels reached
    when the sources are filled up in order of capacity per weight.
    """
    everything = Window.partitionBy(F.lit(0))
    by_name = everything.orderBy(F.col("_source").asc_nulls_last())
    df = (
        sizes.withColumn("_rank", F.row_number().over(by_name))
        .withColumn("_weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("_rank") - 1) % len(weights) + 1))
        .withColumn("_cap", max_repeats * F.col("source_size"))
    )
    filled = everything.orderBy(F.col("_cap") / F.col("_weight"), "_rank")
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    after = filled.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0))
    return (
        df.withColumn("_level", left / F.sum("_weight").over(after))
        .withColumn("_level", F.max("_level").over(everything))
        .withColumn("target", F.least(F.col("_cap").cast("double"), F.col("_weight") * F.col("_level")))
        .select("_source", "source_size", "target")
    )


def deal(lines: DataFrame, block: int, max_repeats: int) -> DataFrame:
    """``_source, _shard, _line, source_size, target, _blocks`` with ``_give``: the tokens that each shard hands out.

    A source with a shard smaller than a block is apportioned token by token.  What a
    quota has above ``max_repeats`` times its shard goes to the source's other shards
    in proportion to their room, so a source gives all that it is due.
    """
    source = Window.partitionBy("_source")
    fine = F.min(F.when(F.col("_line") > 0, F.col("_line"))).over(source) < block
    lines = lines.withColumn("_unit", F.when(fine, F.lit(1)).otherwise(F.lit(block)).cast("long"))
    due = F.when(F.col("_unit") < block, F.round("target")).otherwise(F.col("_blocks") * block).cast("long")
    lines = lines.withColumn("_due", F.least(due, max_repeats * F.col("source_size")))
    seats = F.when(F.col("_unit") < block, F.col("_due")).otherwise(F.col("_blocks"))
    lines = apportion(lines, ["_source"], ["_shard"], "_line", seats)
    most = max_repeats * F.col("_line")
    lines = lines.withColumn("_give", F.least(F.col("quota") * F.col("_unit"), most).cast("long"))
    lines = lines.withColumn("_room", most - F.col("_give"))
    upto = source.orderBy("_shard").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lines = lines.withColumns(
        {
            "_short": (F.col("_due") - F.sum("_give").over(source)).cast("decimal(19,0)"),
            "_rooms": F.sum("_room").over(source),
            "_upto": F.sum("_room").over(upto),
        }
    )
    more = F.expr("_short * _upto div _rooms - _short * (_upto - _room) div _rooms")
    return lines.withColumn("_give", F.col("_give") + F.when((F.col("_short") > 0) & (F.col("_rooms") > 0), more).otherwise(0))


def plan_mix(
    docs: DataFrame,
    keep: list[str],
    weights: tuple[int, ...] = WEIGHTS,
    max_repeats: int = 3,
    blocks: int = BLOCKS,
    seed: int = SEED,
) -> DataFrame:
    """``keep`` columns plus size, source_size, target, taken and where it was taken.

    A document is taken ``turns`` times in whole, and then its words
    ``first_from .. first_to`` and ``then_from .. then_to`` (from 0, end excluded).
    """
    id_part = seeded(seed, F.col("doc_id"))
    narrow = docs.select(
        *[F.col(c).alias(f"k_{c}") for c in keep],
        F.col("source").alias("_source"),
        n_words(F.col("text")).alias("size"),
        id_part.alias("_place"),
        F.col("doc_id").alias("_id"),
    )
    narrow = materialise(narrow, "mix-sizes")
    tokens = narrow.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"]
    shards = min(MAX_SHARDS, max(1, -(-tokens // SHARD_TOKENS)))
    block = max(1, tokens // blocks)
    placed = narrow.withColumn("_shard", F.pmod("_place", F.lit(shards)))

    lines = placed.groupBy("_source", "_shard").agg(F.sum("size").alias("_line"))
    per_source = targets(lines.groupBy("_source").agg(F.sum("_line").alias("source_size")), weights, max_repeats)
    seats = F.round(F.lit(tokens) / block)
    per_source = apportion(per_source, [], ["_source"], "target", seats).withColumnRenamed("quota", "_blocks")
    per_source = per_source.withColumnRenamed("_source", "_of")
    lines = lines.join(per_source, F.col("_source").eqNullSafe(F.col("_of"))).drop("_of")
    lines = deal(lines, block, max_repeats)
    lines = lines.select(
        F.col("_source").alias("_of"),
        F.col("_shard").alias("_in"),
        "source_size",
        "target",
        "_line",
        "_give",
        F.when(F.col("_line") > 0, F.pmod(seeded(seed, F.col("_source"), F.col("_shard")), F.col("_line"))).otherwise(0).alias("_origin"),
    )

    along = Window.partitionBy("_source", "_shard").orderBy("_place", "_id", "size")
    end = F.sum("size").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    df = placed.withColumn("_end", end).join(
        lines, F.col("_source").eqNullSafe(F.col("_of")) & (F.col("_shard") == F.col("_in"))
    )
    df = df.withColumn("_start", F.col("_end") - F.col("size"))
    df = df.withColumn("turns", F.expr("if(_line > 0, _give div _line, 0)")).withColumn(
        "_arc", F.col("_give") - F.col("turns") * F.col("_line")
    )
    stop = F.col("_origin") + F.col("_arc")
    inside = lambda at: F.least(F.greatest(at - F.col("_start"), F.lit(0)), F.col("size"))
    df = df.withColumns(
        {
            "first_from": inside(F.col("_origin")),
            "first_to": inside(F.least(stop, F.col("_line"))),
            "then_from": F.lit(0).cast("long"),
            "then_to": inside(stop - F.col("_line")),
        }
    )
    taken = F.col("turns") * F.col("size") + F.col("first_to") - F.col("first_from") + F.col("then_to")
    return df.select(
        *[F.col(f"k_{c}").alias(c) for c in keep],
        "size",
        "source_size",
        "target",
        taken.alias("taken"),
        "turns",
        "first_from",
        "first_to",
        "then_from",
        "then_to",
    )


def mix(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken and its pieces."""
    return plan_mix(docs, ["doc_id"], **options)


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: a row of ``docs`` for each time a document is taken.

    A document that is taken in part appears once more with the words taken,
    joined by single spaces; one that is taken in whole keeps its text as it is.
    """
    names = docs.columns
    row = F.struct(*[F.col(c) for c in names]).alias("row")
    planned = plan_mix(docs.select("doc_id", "source", "text", row), ["row"], **options)
    part = F.col("first_to") - F.col("first_from") + F.col("then_to")
    found = F.regexp_extract_all(F.col("row.text"), F.lit(f"({WORD})"))
    piece = lambda a, b: F.slice(found, (a + 1).cast("int"), (b - a).cast("int"))
    some = F.array_join(
        F.concat(piece(F.col("then_from"), F.col("then_to")), piece(F.col("first_from"), F.col("first_to"))), " "
    )
    rest = F.when(part == F.col("size"), F.array(F.col("row.text"))).when(part > 0, F.array(some))
    whole = F.array_repeat(F.col("row.text"), F.col("turns").cast("int"))
    texts = F.concat(whole, F.coalesce(rest, F.array().cast("array<string>")))
    return planned.where("size > 0").select("row", F.explode(texts).alias("_text")).select(
        *[F.col("_text").alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in names]
    )
