"""Descriptive statistics and correlations."""

from __future__ import annotations

from itertools import combinations, product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import panel_to_wide


def adjusted_skewness(column: str) -> Column:
    """Bias-adjusted skewness from the population one; null below three rows."""
    n = F.count(column).cast("double")
    return F.when(n > 2, F.skewness(column) * F.sqrt(n * (n - 1)) / (n - 2))


def adjusted_kurtosis(column: str) -> Column:
    """Bias-adjusted excess kurtosis; null below four rows."""
    n = F.count(column).cast("double")
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(column) + 6))


def _quantile(column: str, p: float) -> Column:
    return F.percentile(column, p)


def descriptive_stats(df: DataFrame, column: str, keys=("series",)) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count(column).alias("n_obs"), F.avg(column).alias("mean"),
        F.stddev_samp(column).alias("std"), F.min(column).alias("min"),
        _quantile(column, 0.25).alias("p25"), _quantile(column, 0.5).alias("median"),
        _quantile(column, 0.75).alias("p75"), F.max(column).alias("max"),
        adjusted_skewness(column).alias("skewness"), adjusted_kurtosis(column).alias("kurtosis"))


def describe(df: DataFrame, columns, keys=()) -> DataFrame:
    """count, mean, deviation, extremes and exact quartiles of several columns, one row each (per key)."""
    stats = {
        "n_obs": lambda c: F.count(c).cast("double"), "mean": F.avg, "std": F.stddev_samp,
        "min": F.min, "p25": lambda c: _quantile(c, 0.25), "median": lambda c: _quantile(c, 0.5),
        "p75": lambda c: _quantile(c, 0.75), "max": F.max,
    }
    row = df.groupBy(*keys).agg(*[F.struct(*[f(c).alias(name) for name, f in stats.items()]).alias(c) for c in columns])
    return (row.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).alias("s"))
                                                  for c in columns])).alias("r"))
            .select(*keys, "r.variable", "r.s.*"))


def corr_pairs(wide: DataFrame, pairs, keys=()) -> DataFrame:
    """Pearson correlation of named column pairs in one aggregate pass (per key)."""
    pairs = list(pairs)
    row = wide.groupBy(*keys).agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    return (row.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("corr"))
        for i, (a, b) in enumerate(pairs)])).alias("r")).select(*keys, "r.*"))


def corr_matrix(wide: DataFrame, columns) -> DataFrame:
    """Correlations of each unordered pair of named columns."""
    return corr_pairs(wide, combinations(columns, 2))


def corr_block(wide: DataFrame, targets, drivers, keys=()) -> DataFrame:
    """Cross block: every target against every driver."""
    return corr_pairs(wide, product(targets, drivers), keys)


def corr_panel(panel: DataFrame, names, value: str, ts: str) -> DataFrame:
    """Correlations of named series of a long panel."""
    return corr_matrix(panel_to_wide(panel, names, value, ts), names)
