"""A/B test queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import abtest
from plumbline.workload.registry import query, rounded

LABELLED = "(SELECT * FROM documents JOIN labels USING (doc_id))"
HALVES = "(SELECT (user_id % 2)::VARCHAR AS half, value FROM events)"


def labelled(read):
    return read("documents").join(read("labels"), "doc_id")


def halves(read):
    return read("events").select((F.col("user_id") % 2).cast("string").alias("half"), "value")


def variants_sql(source: str, variant: str, metric: str, control: str) -> str:
    return f"""(SELECT {variant} AS variant, count(*) AS n, count(*) / sum(count(*)) OVER () AS share,
 avg({metric}::DOUBLE) AS mean, sqrt(coalesce(var_samp({metric}::DOUBLE), 0)) AS std, {variant} = '{control}' AS is_control
 FROM {source} WHERE {variant} IS NOT NULL AND {metric} IS NOT NULL GROUP BY {variant})"""


@query(
    "ab_variants",
    f"""SELECT variant, n, round(share, 6) AS share, round(mean, 6) AS mean, round(std, 6) AS std, is_control
 FROM {variants_sql("events", "event_type", "value", "click")}""",
)
def variants(read):
    return rounded(abtest.ab_variants(read("events"), "event_type", "value"), 6, "share", "mean", "std")


def compare_sql(source: str, error: str, p_value: str) -> str:
    """Comparison rows given SQL for the interval's error and the p-value."""
    return f"""SELECT variant, round(d, 6) AS abs_diff, round(d / nullif(m1, 0), 6) AS lift,
 round(d - 1.96 * se, 6) AS ci_low, round(d + 1.96 * se, 6) AS ci_high, round({p_value}, 6) AS p_value,
 {p_value} < 0.05 AS significant FROM (SELECT *, {error} AS se FROM (
 SELECT v.variant, v.n AS n2, v.mean AS m2, v.std AS s2, c.n AS n1, c.mean AS m1, c.std AS s1, v.mean - c.mean AS d
 FROM {source} v, {source} c WHERE c.is_control AND NOT v.is_control))"""


Z = "abs(d) / sqrt((m1 * n1 + m2 * n2) / (n1 + n2) * (1 - (m1 * n1 + m2 * n2) / (n1 + n2)) * (1.0 / n1 + 1.0 / n2))"
ERF_T = f"(1 / (1 + 0.3275911 * {Z} / sqrt(2.0)))"
NORMAL_P = f"""((0.254829592 * {ERF_T} - 0.284496736 * {ERF_T} ** 2 + 1.421413741 * {ERF_T} ** 3
 - 1.453152027 * {ERF_T} ** 4 + 1.061405429 * {ERF_T} ** 5) * exp(0 - pow({Z}, 2) / 2))"""

V1, V2 = "(s1 * s1 / n1)", "(s2 * s2 / n2)"
DF = f"(({V1} + {V2}) ** 2 / ({V1} ** 2 / (n1 - 1) + {V2} ** 2 / (n2 - 1)))"
ANGLE = f"atan(abs(d) / se / sqrt({DF}))"
# Simpson's rule over the angle, 2000 steps.
T_P = f"""(1 - 2 * exp(lgamma(({DF} + 1) / 2) - lgamma({DF} / 2)) / sqrt(pi()) * ({ANGLE} / 6000)
 * list_sum(list_transform(range(2001), lambda i: (CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)
 * cos({ANGLE} * i / 2000) ** ({DF} - 1))))"""


@query(
    "ab_proportion",
    compare_sql(
        variants_sql(LABELLED, "lang", "quality", "en"), "sqrt(m1 * (1 - m1) / n1 + m2 * (1 - m2) / n2)", NORMAL_P
    ),
)
def proportion(read):
    found = abtest.ab_variants(labelled(read), "lang", "quality", control="en")
    return compared(abtest.ab_compare(found, "proportion"))


def compared(result):
    return rounded(result, 6, "abs_diff", "lift", "ci_low", "ci_high", "p_value")


@query("ab_welch", compare_sql(variants_sql(HALVES, "half", "value", "0"), f"sqrt({V1} + {V2})", T_P))
def welch(read):
    return compared(abtest.ab_compare(abtest.ab_variants(halves(read), "half", "value"), "mean"))


@query(
    "ab_welch_many",
    compare_sql(variants_sql("events", "event_type", "value", "purchase"), f"sqrt({V1} + {V2})", T_P),
)
def welch_many(read):
    found = abtest.ab_variants(read("events"), "event_type", "value", control="purchase")
    return compared(abtest.ab_compare(found, "mean"))


CHI2 = "sum((n - total / k) ** 2 / (total / k))"


def srm_sql(source: str, tail: str) -> str:
    return f"""SELECT round(x, 6) AS chi2, df, round({tail}, 6) AS p_value, {tail} < 0.001 AS mismatch,
 round(1.0 / (df + 1), 6) AS expected_share FROM (SELECT {CHI2} AS x, (max(k) - 1)::INTEGER AS df
 FROM (SELECT n, sum(n) OVER () AS total, count(*) OVER () AS k FROM {source}))"""


@query("ab_srm", srm_sql(variants_sql("events", "event_type", "value", "click"), "(exp(-x / 2) * (1 + x / 2))"))
def srm(read):
    found = abtest.ab_srm(abtest.ab_variants(read("events"), "event_type", "value"))
    return rounded(found, 6, "chi2", "p_value", "expected_share")


@query(
    "ab_srm_mismatch",
    srm_sql(
        variants_sql("(SELECT least(o_orderstatus, 'O') || (o_orderkey % 3 = 0)::INTEGER AS arm, 1 AS one FROM orders)",
                     "arm", "one", "F0"),
        "(exp(-x / 2) * (1 + x / 2))",
    ),
)
def srm_mismatch(read):
    arm = F.concat(F.least("o_orderstatus", F.lit("O")), (F.col("o_orderkey") % 3 == 0).cast("int").cast("string"))
    arms = read("orders").select(arm.alias("arm"), F.lit(1).alias("one"))
    found = abtest.ab_srm(abtest.ab_variants(arms, "arm", "one"))
    return rounded(found, 6, "chi2", "p_value", "expected_share")
