"""p-values for the A/B comparison, as column expressions.

All of them run on the per-variant aggregate (a handful of rows) and stay in
the JVM, so nothing has to be shipped to Python workers.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Error-function approximation 7.1.26 of Abramowitz & Stegun,
# lowest power first, and the scale inside its substitution.
ERF_SCALE = 0.3275911
ERF_COEFFICIENTS = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)

# Tail integrals stop this far out, where the density has vanished.
REACH = 40.0

# Steps taken before the large-argument series of the gamma ratio applies.
GAMMA_STEPS = 50


def normal_two_sided(z: Column) -> Column:
    """P(|Z| > |z|): one minus erf(|z| / sqrt 2), absolute error below 1.5e-7."""
    x = F.abs(z) / F.lit(math.sqrt(2.0))
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(ERF_SCALE) * x)
    series = sum((F.lit(c) * F.pow(t, F.lit(k + 1)) for k, c in enumerate(ERF_COEFFICIENTS)), F.lit(0.0))
    return series * F.exp(-x * x)


def _integral(start: Column, end: Column, density) -> Column:
    """Tanh-sinh quadrature with nodes k / 32; beyond k = 115 weights vanish."""

    def add(total: Column, k: Column) -> Column:
        place = k / F.lit(32.0)
        inner = F.lit(math.pi / 2) * F.sinh(place)
        node = F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-2.0) * inner))
        weight = F.lit(math.pi / 128) * F.cosh(place) / (F.cosh(inner) * F.cosh(inner))
        return total + weight * density(start + (end - start) * node)

    return (end - start) * F.aggregate(F.sequence(F.lit(-115), F.lit(115)), F.lit(0.0), add)


def _gamma_half_ratio(x: Column) -> Column:
    """Gamma(x + 1/2) / Gamma(x) / sqrt(x): exact steps up, then its series."""
    steps = F.sequence(F.lit(0), F.lit(GAMMA_STEPS - 1))
    climbed = F.aggregate(steps, F.lit(1.0), lambda product, k: product * (x + k) / (x + k + F.lit(0.5)))
    y = x + F.lit(float(GAMMA_STEPS))
    series = 1 - 1 / (8 * y) + 1 / (128 * y * y) + 5 / (1024 * y * y * y) - 21 / (32768 * y * y * y * y)
    return climbed * F.sqrt(y / x) * series


def student_t_p(t: Column, df: Column) -> Column:
    """P(|T| > |t|) by integrating the density over the angle atan(t / sqrt df).

    With the angle u / sqrt(df) the integrand tends to exp(-u^2 / 2), so sample
    sizes in the billions stay well conditioned.
    """
    root = F.sqrt(df)
    start = root * F.atan(F.abs(t) / root)
    end = F.least(root * F.lit(math.pi / 2), start + F.lit(REACH))

    def density(u: Column) -> Column:
        sine = F.sin(u / root)
        squared = F.least(sine * sine, F.lit(1.0 - 2.0**-53))
        return F.exp((df - 1) * F.log1p(-squared) / 2)

    scale = _gamma_half_ratio(df / 2) * F.lit(math.sqrt(2.0 / math.pi))
    tail = F.least(F.lit(1.0), scale * _integral(start, end, density))
    undefined = (df <= 0) | (F.abs(t) == F.lit(float("inf")))
    return F.when(undefined, F.lit(1.0)).otherwise(tail)


def _normal_tail(z: Column) -> Column:
    """P(|Z| > z) to full precision."""
    area = _integral(z, z + F.lit(REACH), lambda u: F.exp(-u * u / 2))
    return F.least(F.lit(1.0), area * F.lit(math.sqrt(2.0 / math.pi)))


def chi_square_p(x: Column, df: Column) -> Column:
    """P(X > x) for whole degrees of freedom, from the finite sum of its terms."""
    half = x / 2
    odd = df % 2 == 1
    shift = F.when(odd, F.lit(0.5)).otherwise(F.lit(0.0))
    first = F.when(odd, F.lit(math.lgamma(1.5))).otherwise(F.lit(0.0))
    zero = F.struct((shift * F.ln(half) - half - first).alias("log_term"), F.lit(0.0).alias("total"))

    def add(state: Column, j: Column) -> Column:
        return F.struct(
            (state["log_term"] + F.ln(half) - F.ln(j + shift)).alias("log_term"),
            (state["total"] + F.exp(state["log_term"])).alias("total"),
        )

    count = F.floor(df / 2).cast("int")
    terms = F.aggregate(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), zero, add, lambda s: s["total"])
    lead = F.when(odd, _normal_tail(F.sqrt(x))).otherwise(F.lit(0.0))
    tail = F.least(F.lit(1.0), lead + F.when(count > 0, terms).otherwise(F.lit(0.0)))
    return F.when((x <= 0) | (df <= 0), F.lit(1.0)).otherwise(tail)
