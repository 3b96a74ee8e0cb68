"""A/B tests: variant summaries, significance, and the sample-ratio check.

The metric table is read once, into one row per variant.  Everything after
that works on the written summary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import as_double, as_text, col
from plumbline.functions.significance import chi_square_p, normal_two_sided, student_t_p

# Normal quantile of the 95 % interval, and the level below
# which unequal group sizes count as a broken assignment.
INTERVAL_Z = 1.96
RATIO_ALPHA = 0.001
# Variants that a test may have: their summary goes through the driver.
MAX_VARIANTS = 10_000


def ab_variants(df: DataFrame, variant: str, metric: str, control: str | None = None) -> DataFrame:
    """(variant, n, share, mean, std, is_control) per variant.

    Rows without a variant or metric are ignored, and so are those whose metric is
    not a number: one of them would leave no figure of its variant, nor any comparison.
    The control is the named variant if it occurs, otherwise the first one by string
    order.  More than ``MAX_VARIANTS`` variants are an error.
    """
    value = as_double(metric)
    usable = df.where(col(variant).isNotNull() & value.isNotNull() & ~F.isnan(value))
    summary = usable.groupBy(as_text(df, variant).alias("variant")).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(value).alias("mean"),
        F.sqrt(F.greatest(F.coalesce(F.var_samp(value), F.lit(0.0)), F.lit(0.0))).alias("std"),
    )
    # One row per variant: few enough to come to the driver and back instead of being computed thrice.
    rows = summary.limit(MAX_VARIANTS + 1).collect()
    if len(rows) > MAX_VARIANTS:
        raise ValueError(f"{variant} has more than {MAX_VARIANTS} variants")
    summary = df.sparkSession.createDataFrame(rows, summary.schema)
    named = F.max(F.when(F.col("variant") == F.lit(control), F.col("variant")))
    chosen = summary.agg(F.coalesce(named, F.min("variant"))).scalar()
    total = summary.agg(F.sum("n")).scalar()
    return summary.select(
        "variant",
        "n",
        (F.col("n") / total).alias("share"),
        "mean",
        "std",
        (F.col("variant") == chosen).alias("is_control"),
    )


def ab_compare(variants: DataFrame, metric_type: str = "mean", alpha: float = 0.05) -> DataFrame:
    """(variant, abs_diff, lift, ci_low, ci_high, p_value, significant).

    ``proportion`` uses the two-proportion z-test (pooled error for the test,
    unpooled for the interval), ``mean`` uses Welch's t-test.
    """
    if metric_type not in ("mean", "proportion"):
        raise ValueError(f"unknown metric type: {metric_type}")
    control = variants.where("is_control").select(F.struct("n", "mean", "std")).scalar()
    pairs = variants.where(~F.col("is_control")).withColumn("control", control)
    diff = F.col("mean") - F.col("control.mean")
    pairs = pairs.withColumn("abs_diff", diff)
    scored = _proportion(pairs) if metric_type == "proportion" else _welch(pairs)
    margin = F.lit(INTERVAL_Z) * F.col("se")
    lift = F.col("abs_diff") / F.nullif(F.col("control.mean"), F.lit(0.0))
    return scored.select(
        "variant",
        "abs_diff",
        lift.alias("lift"),
        (F.col("abs_diff") - margin).alias("ci_low"),
        (F.col("abs_diff") + margin).alias("ci_high"),
        "p_value",
        F.coalesce(F.col("p_value") < F.lit(alpha), F.lit(False)).alias("significant"),
    )


def _ratio_or(top: Column, bottom: Column, otherwise: float) -> Column:
    return F.coalesce(top / F.when(bottom > 0, bottom), F.lit(otherwise))


def _proportion(pairs: DataFrame) -> DataFrame:
    n1, p1 = F.col("control.n"), F.col("control.mean")
    n2, p2 = F.col("n"), F.col("mean")
    pooled = (p1 * n1 + p2 * n2) / (n1 + n2)

    def root(square: Column) -> Column:
        # Rates outside [0, 1] have no standard error; treat them as 0.
        return F.sqrt(F.when(square > 0, square).otherwise(F.lit(0.0)))

    pooled_error = root(pooled * (1 - pooled) * (F.lit(1.0) / n1 + F.lit(1.0) / n2))
    z = _ratio_or(F.col("abs_diff"), pooled_error, 0.0)
    error = root(p1 * (1 - p1) / n1 + p2 * (1 - p2) / n2)
    return pairs.withColumn("p_value", normal_two_sided(z)).withColumn("se", error)


def _welch(pairs: DataFrame) -> DataFrame:
    """A variant with a single row has no variance of its own: p is unknown."""
    n1, n2 = F.col("control.n"), F.col("n")
    v1 = F.col("control.std") * F.col("control.std") / n1
    v2 = F.col("std") * F.col("std") / n2
    pairs = pairs.withColumn("v1", v1).withColumn("v2", v2).withColumn("se", F.sqrt(F.col("v1") + F.col("v2")))
    v1, v2, se = F.col("v1"), F.col("v2"), F.col("se")
    spread = v1 * v1 / F.nullif(n1 - 1, F.lit(0)) + v2 * v2 / F.nullif(n2 - 1, F.lit(0))
    pairs = pairs.withColumn("t", _ratio_or(F.col("abs_diff"), se, 0.0))
    pairs = pairs.withColumn("df", F.when(se > 0, (v1 + v2) * (v1 + v2) / F.nullif(spread, F.lit(0.0))).otherwise(1.0))
    p_value = student_t_p(F.col("t"), F.coalesce("df", F.lit(1.0)))
    return pairs.withColumn("p_value", F.when(F.col("df").isNotNull(), p_value))


def ab_srm(variants: DataFrame) -> DataFrame:
    """(chi2, df, p_value, mismatch, expected_share) against an equal split."""
    expected = variants.agg(F.sum("n") / F.count(F.lit(1))).scalar()
    gap = F.col("n") - F.col("expected")
    scored = variants.select("n", expected.alias("expected")).agg(
        F.sum(gap * gap / F.col("expected")).alias("chi2"),
        (F.count(F.lit(1)) - 1).cast("int").alias("df"),
        (F.lit(1.0) / F.count(F.lit(1))).alias("expected_share"),
    ).withColumn("p_value", chi_square_p(F.col("chi2"), F.col("df")))
    return scored.select(
        "chi2", "df", "p_value", (F.col("p_value") < RATIO_ALPHA).alias("mismatch"), "expected_share"
    )


def ab_test(
    df: DataFrame,
    variant: str,
    metric: str,
    metric_type: str = "mean",
    control: str | None = None,
    alpha: float = 0.05,
) -> dict:
    """The whole analysis: variants, comparisons, sample-ratio check, warnings."""
    variants = ab_variants(df, variant, metric, control)
    checks = variants.agg(
        F.count(F.lit(1)).alias("variants"),
        F.count_if((F.col("mean") < -1e-9) | (F.col("mean") > 1 + 1e-9)).alias("outside"),
    ).first()
    if checks.variants < 2:
        raise ValueError("need at least two variants with data to compare")
    warnings = []
    if metric_type == "proportion" and checks.outside:
        warnings.append(f'proportion metric "{metric}" has values outside [0, 1]; use a 0/1 or boolean column')
    return {
        "variants": variants.orderBy("variant"),
        "comparisons": ab_compare(variants, metric_type, alpha).orderBy("variant"),
        "srm": ab_srm(variants),
        "warnings": warnings,
    }
