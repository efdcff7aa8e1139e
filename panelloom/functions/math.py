"""Distribution functions and scalar math as Spark column expressions."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Error-function approximation 7.1.26 of Abramowitz and Stegun.
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)

# Acklam's rational approximation of the inverse normal
# distribution (relative error below 1.2e-9).
PPF_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02,
         1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
PPF_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02,
         6.680131188771972e01, -1.328068155288572e01)
PPF_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00,
         -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
PPF_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00,
         3.754408661907416e00)
PPF_LOW = 0.02425


def horner(x: Column, coefficients) -> Column:
    """Polynomial with the highest power first."""
    return reduce(lambda acc, c: acc * x + F.lit(float(c)), coefficients[1:],
                  F.lit(float(coefficients[0])))


def two_sided_p(z: Column) -> Column:
    """``2 * (1 - Phi(|z|))``."""
    x = F.abs(z) / math.sqrt(2.0)
    t = 1.0 / (1.0 + ERF_P * x)
    return horner(t, tuple(reversed(ERF_A)) + (0.0,)) * F.exp(-x * x)


def normal_cdf(z: Column) -> Column:
    tail = two_sided_p(z) / 2.0
    return F.when(z >= 0, 1.0 - tail).otherwise(tail)


def normal_ppf(p: Column) -> Column:
    """Inverse of the standard normal distribution for ``0 < p < 1``."""
    q = p - 0.5
    r = q * q
    centre = horner(r, PPF_A) * q / horner(r, PPF_B + (1.0,))
    low = F.sqrt(-2.0 * F.log(p))
    high = F.sqrt(-2.0 * F.log(1.0 - p))

    def tail(s):
        return horner(s, PPF_C) / horner(s, PPF_D + (1.0,))

    return (F.when(p < PPF_LOW, tail(low))
            .when(p > 1.0 - PPF_LOW, -tail(high))
            .otherwise(centre))


def chi2_sf(x: Column, df: int) -> Column:
    """Upper tail of chi-square with an even number of degrees of freedom (exact)."""
    if df % 2:
        raise ValueError("the closed form needs even degrees of freedom")
    half = x / 2.0
    terms = [F.pow(half, F.lit(float(k))) / float(math.factorial(k)) for k in range(df // 2)]
    return F.exp(-half) * reduce(lambda a, b: a + b, terms)


def f_sf(f: Column, d1: int, d2: Column) -> Column:
    """Upper tail of F with an even numerator: a finite negative-binomial sum."""
    if d1 % 2:
        raise ValueError("the finite sum needs an even numerator")
    x = d2 / (d2 + d1 * f)
    a = d2 / 2.0
    total, coefficient = F.lit(1.0), F.lit(1.0)
    for j in range(1, d1 // 2):
        coefficient = coefficient * (a + (j - 1.0)) / float(j) * (1.0 - x)
        total = total + coefficient
    return F.pow(x, a) * total


def finite(c: Column) -> Column:
    """True where the value is neither null, NaN nor infinite."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def scalar_math(df, column: str, floor: float = 1e-12):
    """abs, sqrt, log, sign, square and a floored copy of one column."""
    x = F.col(column)
    return (df.withColumn("abs_x", F.abs(x))
            .withColumn("sqrt_abs", F.sqrt(F.abs(x)))
            .withColumn("ln_abs", F.log(F.greatest(F.abs(x), F.lit(floor))))
            .withColumn("sign_x", F.signum(x))
            .withColumn("sq_x", F.pow(x, F.lit(2.0)))
            .withColumn("floored", F.greatest(x, F.lit(floor))))


def same_sign(a: Column, b: Column) -> Column:
    return F.signum(a) == F.signum(b)
