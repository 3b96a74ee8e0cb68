"""URL filters: rules by host and path, and link-graph propagation for what no rule decides.

A rule ``host/path`` fits its host and all subdomains if the url's path starts with
its path; the longest rule wins, a block rule if two are equally long.

Pages that a rule allows make their host a trusted seed, pages that a rule blocks a
blocked seed, weighted by their number.  Trust flows along links from host to host
(personalised PageRank from the trusted seeds), distrust against them (from the
blocked seeds, to the hosts that link to them).  A host whose trust is less than
``THRESHOLD`` of trust and distrust together is blocked; one that neither reaches is
allowed.

Ranks are doubles, counted in pages, so a share of any fan-out counts; a message is
never 0, so every host that a seed reaches has a rank, at any distance.  Ranks only grow
from round to round, and what all later rounds can add is bounded by what the last one
did.  Rounds go on until no new host is reached and either that rest can change no
verdict or no rank changes by more than ``TOLERANCE`` of itself (so a draw is a draw).
The sums are then rounded to 7 digits, so that their order does not decide a verdict
when trust and distrust are equal.  Links are counted per pair of hosts before
they meet the ranks; ``ROUNDS_PER_JOB`` rounds, a join and a sum each, are one job whose
ranks are written to shared storage.

Null urls and urls without ``://`` have an empty host and path, null html has no
links, very long html is read whole, repeated rows count each and null ids are kept, an
empty table gives an empty result.  Other columns are ignored, whatever their name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.plans.durable import materialise

#: Target hosts of links with a host of their own.
LINK = r"""(?i)href[ \t\r\n]*=[ \t\r\n]*["']?(?:[a-z][a-z0-9+.\-]*:)?//([^"' \t\r\n>/?#]+)"""
DAMPING, THRESHOLD = 0.85, 0.5
#: Change of a rank, as a part of it, that no longer counts; the least rank of a host that is reached.
TOLERANCE, LEAST = 1e-8, 5e-324
#: Rounds that one job computes before it writes the ranks.
ROUNDS_PER_JOB = 4
#: Unit and rounds of the SQL, which works in whole numbers and stops early.
UNIT, ROUNDS = 1_000_000, 20


def lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host(url: Column) -> Column:
    return lower(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(of_host: Column, of_path: Column, rules: list[tuple[str, str]]) -> Column:
    """Struct of rule and verdict of the longest rule that fits; null if none does.

    ``rules``: ``(rule, verdict)`` pairs, a bounded list that becomes part of the plan.
    """
    ordered = sorted(rules, key=lambda r: (-len(r[0]), r[1] != "block", r[0]))
    fits = []
    for rule, verdict in ordered:
        name, _, rest = rule.partition("/")
        here = (of_host == name) | of_host.endswith("." + name)
        chosen = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        fits.append(F.when(here & of_path.startswith("/" + rest), chosen))
    return F.coalesce(*fits) if fits else F.lit(None).cast("struct<rule:string,verdict:string>")


def links(pages: DataFrame) -> DataFrame:
    """``src, dst, n``: links between different hosts."""
    found = pages.select(host(F.col("url")).alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK))).alias("dst"))
    found = found.select("src", lower(F.col("dst")).alias("dst")).where("src <> '' AND dst <> '' AND src <> dst")
    return found.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, tolerance: float = TOLERANCE, threshold: float | None = None) -> DataFrame:
    """``host, trust, distrust`` from ``src, dst, n`` and ``host, kind, pages`` (kind: allow or block).

    With a ``threshold`` the ranks only go as far as verdicts need: until the rank still
    under way could change none.
    """
    forward = edges.select(F.lit("allow").alias("kind"), F.col("src").alias("from"), F.col("dst").alias("to"), "n")
    back = edges.select(F.lit("block").alias("kind"), F.col("dst").alias("from"), F.col("src").alias("to"), "n")
    both = materialise(forward.unionByName(back), "url-links")
    whole = both.groupBy(F.col("kind").alias("k"), F.col("from").alias("f")).agg(F.sum("n").alias("all"))
    shares = both.join(whole, (F.col("kind") == F.col("k")) & (F.col("from") == F.col("f"))).select(
        "kind", "from", "to", (F.lit(DAMPING) * F.col("n") / F.col("all")).alias("share")
    )
    shares = materialise(shares, "url-shares")
    start = materialise(seeds.select("kind", "host", (F.col("pages") * F.lit(1 - DAMPING)).alias("rank")), "url-ranks")
    def passed_on(ranks: DataFrame) -> DataFrame:
        """Seeds and what the ranks send along the links, not yet summed."""
        now = ranks.select(F.col("kind").alias("k"), F.col("host").alias("h"), F.col("rank").alias("r"))
        moved = shares.join(now, (F.col("kind") == F.col("k")) & (F.col("from") == F.col("h")))
        sent = F.greatest(F.col("r") * F.col("share"), F.lit(LEAST)).alias("rank")
        return start.unionByName(moved.select("kind", F.col("to").alias("host"), sent))

    ranks = start
    while True:
        for _ in range(ROUNDS_PER_JOB - 1):
            ranks = passed_on(ranks).groupBy("kind", "host").agg(F.sum("rank").alias("rank"))
        # The old rank travels with the sum, so that the change needs no join of its own.
        news = passed_on(ranks).withColumn("old", F.lit(0.0))
        news = news.unionByName(ranks.select("kind", "host", F.lit(0.0).alias("rank"), F.col("rank").alias("old")))
        ranks = materialise(news.groupBy("kind", "host").agg(F.sum("rank").alias("rank"), F.sum("old").alias("old")), "url-ranks")
        gain = F.col("rank") - F.col("old")
        seen = ranks.agg(
            F.count_if(F.col("old") == 0).alias("fresh"),
            F.count_if(F.abs(gain) > tolerance * F.col("rank")).alias("moving"),
            *[F.coalesce(F.sum(F.when(F.col("kind") == kind, F.abs(gain))), F.lit(0.0)).alias(kind) for kind in ("allow", "block")],
        ).first()
        # All that later rounds can still add to any host, and what rounding may.
        still = {kind: seen[kind] * DAMPING / (1 - DAMPING) for kind in ("allow", "block")}
        if not seen.fresh and (not seen.moving or threshold is not None and _settled(ranks, still, threshold)):
            break
        ranks = ranks.drop("old")
    rounded = lambda rank: F.when(rank.isNotNull(), F.format_string("%.6e", rank).try_cast("double"))
    of = lambda kind: F.coalesce(rounded(F.sum(F.when(F.col("kind") == kind, F.col("rank")))), F.lit(0.0))
    return ranks.groupBy("host").agg(of("allow").alias("trust"), of("block").alias("distrust"))


def _settled(ranks: DataFrame, still: dict[str, float], threshold: float) -> bool:
    """Does every host that both sides reach keep its verdict, whatever of the rank under way it gets?"""
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("rank"))).alias(kind)
    trust, distrust, slack = F.col("allow"), F.col("block"), 1e-6
    most_trust, most_distrust = trust + F.lit(still["allow"]), distrust + F.lit(still["block"])
    blocked = most_trust < threshold * (1 - slack) * (most_trust + distrust)
    allowed = trust >= threshold * (1 + slack) * (trust + most_distrust)
    both = ranks.groupBy("host").agg(of("allow"), of("block")).where("allow IS NOT NULL AND block IS NOT NULL")
    return both.where(~(blocked | allowed)).isEmpty()


def judge(pages: DataFrame, rules: list[tuple[str, str]], threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule and verdict of every page."""
    rows = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    rows = rows.withColumn("decided", rule_of(F.col("host"), F.col("path"), rules))
    seeds = rows.where("decided IS NOT NULL").groupBy("host", F.col("decided.verdict").alias("kind"))
    scores = propagate(links(pages), seeds.agg(F.count(F.lit(1)).alias("pages")), threshold=threshold)
    blocked = scores.where(F.col("trust") < threshold * (F.col("trust") + F.col("distrust"))).select(F.col("host").alias("_host"))
    rows = rows.join(blocked, F.col("host") == F.col("_host"), "left")
    by_host = F.when(F.col("_host").isNotNull(), "block").otherwise("allow")
    return rows.select(
        "page_id", "host", "path", F.col("decided.rule").alias("rule"), F.coalesce("decided.verdict", by_host).alias("verdict")
    )

