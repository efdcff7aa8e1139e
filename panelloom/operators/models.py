"""Benchmarks and the model comparison table."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.math import finite, same_sign
from . import evaluation as E

WEEK = "week_end_date"


def zero_change_forecast(df: DataFrame, column: str) -> DataFrame:
    """No-change benchmark on changes: predict 0, so the residual is the value."""
    return (df.withColumn("actual", F.col(column)).withColumn("pred", F.lit(0.0))
            .withColumn("resid", F.col(column)))


def naive_last_level(windows: DataFrame, keys=("series",)) -> DataFrame:
    """RMSE of repeating the last level, and of zero slopes, over supervised windows."""
    level = windows.select(*keys, F.lit("level").alias("target"), F.col("outputs").alias("a"),
                           F.array_repeat(F.element_at("inputs", -1), F.size("outputs")).alias("p"))
    slope = windows.select(*keys, F.lit("slope").alias("target"), F.col("output_slopes").alias("a"),
                           F.array_repeat(F.lit(0.0), F.size("output_slopes")).alias("p"))
    pairs = (level.unionByName(slope)
             .select(*keys, "target", F.explode(F.arrays_zip("a", "p")).alias("z"))
             .select(*keys, "target", F.col("z.a").alias("actual"), F.col("z.p").alias("pred")))
    return pairs.groupBy(*keys, "target").agg(E.rmse().alias("rmse"))


def information_criteria(n, ssr, k, log=F.log):
    """AIC and BIC of a Gaussian fit with ``k`` parameters, the variance among them."""
    fit = n * (log(2 * math.pi * ssr / n) + 1)
    return fit + 2 * k, fit + log(n) * k


def ar1_fit(df: DataFrame, column: str, keys=("series",), ts: str = WEEK) -> DataFrame:
    """First-order autoregression with a constant by least squares, one row per key."""
    w = Window.partitionBy(*keys).orderBy(ts)
    pairs = (df.select(*keys, F.col(column).alias("_y"), F.lag(column).over(w).alias("_x"))
             .filter(F.col("_y").isNotNull() & F.col("_x").isNotNull()))
    fit = pairs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_obs"), F.regr_intercept("_y", "_x").alias("const"),
        F.regr_slope("_y", "_x").alias("phi"), F.regr_syy("_y", "_x").alias("_syy"),
        F.regr_sxy("_y", "_x").alias("_sxy"))
    ssr = F.col("_syy") - F.col("phi") * F.col("_sxy")
    n = F.col("n_obs").cast("double")
    aic, bic = information_criteria(n, ssr, 3)
    return (fit.withColumn("sigma2", ssr / n).withColumn("aic", aic).withColumn("bic", bic)
            .drop("_syy", "_sxy"))


def ar1_forecast(df: DataFrame, params: DataFrame, column: str, keys=("series",), ts: str = WEEK) -> DataFrame:
    """One-step forecasts with given parameters."""
    before = F.lag(column).over(Window.partitionBy(*keys).orderBy(ts))
    return (df.withColumn("_before", before).join(params.select(*keys, "const", "phi"), list(keys))
            .withColumn("actual", F.col(column)).withColumn("pred", F.col("const") + F.col("phi") * F.col("_before"))
            .drop("_before", "const", "phi"))


def model_comparison(fc: DataFrame, n_models: int, keys=("series", "horizon"), ts: str = WEEK,
                     baseline: str = "Random Walk") -> DataFrame:
    """Accuracy of every model on the dates all models cover, with gain and winner flag."""
    complete = E.complete_for_all(fc, n_models, keys, ts)
    both = finite(F.col("actual")) & finite(F.col("pred"))
    hit = F.when(both, same_sign(F.col("actual"), F.col("pred")).cast("double"))
    table = complete.groupBy(*keys, "model").agg(
        E.rmse().alias("rmse"), E.mae().alias("mae"), F.avg(hit).alias("directional_accuracy"),
        F.count(F.lit(1)).alias("n_test"))
    best = F.min(F.struct("rmse", "model")).over(Window.partitionBy(*keys))
    return (E.improvement_vs_baseline(table, baseline, keys)
            .withColumn("is_winner", F.col("model") == best["model"]))


def level_to_change(df: DataFrame, last_level: str, future_level: str, factor: str) -> DataFrame:
    """Scaled level forecasts to changes in original units."""
    change = (F.col(future_level) - F.col(last_level)) / F.col(factor)
    return df.withColumn("delta", change)
