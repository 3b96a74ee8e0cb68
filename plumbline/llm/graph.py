"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.plans.durable import materialise


def components(edges: DataFrame) -> DataFrame:
    """``a, b`` (bigint) to ``node, root``: the smallest node reachable from each.

    Alternating star contraction: every node is tied to the smallest node it sees,
    first from its larger, then from its smaller neighbours, until all edges are
    stars.  Each round is two grouped minima and joins and is written to shared
    storage, so no lineage grows and no neighbourhood is ever collected.  Rounds
    grow with the logarithm of the number of nodes.  Null ends and loops are
    dropped, repeated edges count once; no edges give an empty result.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = materialise(now, "components")
    before = None
    while True:
        large = _large_star(now)
        small = materialise(_small_star(large), "components")
        after = small.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long"))).first()
        if after == before:
            return small.select(F.col("a").alias("node"), F.col("b").alias("root"))
        now, before = small, after


def _large_star(edges: DataFrame) -> DataFrame:
    """Tie the larger neighbours of each node to the smallest of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy(F.col("a").alias("u")).agg(F.least(F.min("b"), F.first("a")).alias("m"))
    joined = both.where("b > a").join(least, F.col("a") == F.col("u"))
    return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Tie the smaller neighbours of each node, and the node, to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
    tied = down.join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    own = least.select(F.col("u").alias("a"), F.col("m").alias("b"))
    return tied.unionByName(own).where("a <> b").distinct()
