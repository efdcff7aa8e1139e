"""Ordered per-series features: differences, lags, rolling moments, splits, smoothing.

Functions that add several columns use one window specification, so Catalyst
plans one sort for all of them.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WEEK = "week_end_date"


def ordered(ts: str = WEEK, keys=("series",)):
    return Window.partitionBy(*keys).orderBy(ts)


def diff(df: DataFrame, column: str, out: str, ts: str = WEEK, keys=("series",)) -> DataFrame:
    return df.withColumn(out, F.col(column) - F.lag(column).over(ordered(ts, keys)))


def add_lags(df: DataFrame, columns, lags=(1,), ts: str = WEEK, keys=("series",)) -> DataFrame:
    """``<column>_lag<k>`` for every present column and lag."""
    w = ordered(ts, keys)
    present = [c for c in columns if c in df.columns]
    return df.select("*", *[F.lag(c, k).over(w).alias(f"{c}_lag{k}") for c in present for k in lags])


def lead_target(df: DataFrame, horizon: int, level: str = "level", ts: str = WEEK,
                keys=("series",)) -> DataFrame:
    """``target`` = level in ``horizon`` rows minus level now, and the row it refers to."""
    w = ordered(ts, keys)
    return (df.withColumn("target", F.lead(level, horizon).over(w) - F.col(level))
            .withColumn("target_date", F.lead(ts, horizon).over(w)))


def _when_full(value: Column, column: str, w, n: int) -> Column:
    return F.when(F.count(column).over(w) == n, value)


def rolling(df: DataFrame, column: str, windows=(4, 13, 26), ts: str = WEEK,
            keys=("series",), mean: bool = True, std: bool = True) -> DataFrame:
    """Trailing mean and sample deviation, null until the window is full."""
    out = []
    for n in windows:
        w = ordered(ts, keys).rowsBetween(-(n - 1), 0)
        if mean:
            out.append(_when_full(F.avg(column).over(w), column, w, n).alias(f"{column}_mean_{n}"))
        if std:
            out.append(_when_full(F.stddev_samp(column).over(w), column, w, n).alias(f"{column}_std_{n}"))
    return df.select("*", *out)


def rolling_z(df: DataFrame, column: str, n: int = 26, out: str = "level_z", ts: str = WEEK,
              keys=("series",)) -> DataFrame:
    """Distance of a value from its trailing mean in trailing deviations."""
    w = ordered(ts, keys).rowsBetween(-(n - 1), 0)
    std = F.stddev_samp(column).over(w)
    z = (F.col(column) - F.avg(column).over(w)) / F.when(std != 0, std)
    return df.withColumn(out, _when_full(z, column, w, n))


def returns(df: DataFrame, column: str, ts: str = WEEK, keys=("series",)) -> DataFrame:
    """Simple return in percent and log return."""
    before = F.lag(column).over(ordered(ts, keys))
    return (df.withColumn("return_pct", (F.col(column) / before - 1) * 100)
            .withColumn("log_return", F.log(column) - F.log(before)))


def cumulative_advantage(df: DataFrame, keys=("series",), ts: str = WEEK, actual: str = "actual",
                         pred: str = "pred", base: str = "base_pred") -> DataFrame:
    """Running sum of the squared loss saved against a baseline forecast."""
    w = ordered(ts, keys).rowsBetween(Window.unboundedPreceding, 0)
    saved = F.pow(F.col(actual) - F.col(base), F.lit(2.0)) - F.pow(F.col(actual) - F.col(pred), F.lit(2.0))
    return df.withColumn("cum_advantage", F.sum(saved).over(w))


def chronological_split(df: DataFrame, ratio: float = 0.8, ts: str = WEEK, keys=("series",)) -> DataFrame:
    """``rn``, ``n`` and ``split``: the first ``floor(ratio * n)`` rows are train."""
    return (df.withColumn("rn", F.row_number().over(ordered(ts, keys)).cast("long"))
            .withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
            .withColumn("split", F.when(F.col("rn") <= F.floor(F.lit(ratio) * F.col("n")), "train")
                        .otherwise("test")))


def purged_split(df: DataFrame, horizon: int, ratio: float = 0.8, level: str = "level",
                 ts: str = WEEK, keys=("series",)) -> DataFrame:
    """Direct h-step rows split in time, train targets ending before the test start.

    Rows between the two, whose target date reaches into the test span, are purged.
    """
    rows = (lead_target(df, horizon, level, ts, keys)
            .filter(F.col("target").isNotNull() & F.col("target_date").isNotNull()))
    whole = Window.partitionBy(*keys)
    numbered = (rows.withColumn("_rn", F.row_number().over(ordered(ts, keys)))
                .withColumn("_n", F.count(F.lit(1)).over(whole)))
    start = F.max(F.when(F.col("_rn") == F.floor(F.lit(ratio) * F.col("_n")) + 1, F.col(ts))).over(whole)
    return (numbered.withColumn("split_start", start)
            .withColumn("split", F.when(F.col(ts) >= F.col("split_start"), "test")
                        .when(F.col("target_date") < F.col("split_start"), "train"))
            .filter(F.col("split").isNotNull()).drop("_rn", "_n"))


def sliding_windows(df: DataFrame, level: str = "scaled_original", slope: str = "scaled_derivative",
                    n_in_level: int = 5, n_in_slope: int = 4, n_out: int = 4, drop_first: int = 10,
                    ts: str = WEEK, keys=("series",)) -> DataFrame:
    """Supervised rows: arrays of recent levels and slopes, and of the next ones.

    Slope outputs start after the slope inputs, level outputs after the level
    inputs. The last ``max(inputs) + n_out`` starts are not used.
    """
    w = ordered(ts, keys)
    span = max(n_in_level, n_in_slope) + n_out

    def ahead(column, start, count):
        return F.array(*[F.lead(column, start + i).over(w) for i in range(count)])

    rows = df.select(
        *keys,
        F.row_number().over(w).cast("long").alias("row"),
        F.count(F.lit(1)).over(Window.partitionBy(*keys)).alias("_n"),
        ahead(level, 0, n_in_level).alias("inputs"),
        ahead(slope, 0, n_in_slope).alias("input_slopes"),
        ahead(level, n_in_level, n_out).alias("outputs"),
        ahead(slope, n_in_slope, n_out).alias("output_slopes"),
        F.lead(ts, n_in_level).over(w).alias("forecast_start_date"),
    )
    usable = F.col("_n") - span
    return (rows.filter((F.col("row") <= usable) & (F.col("row") > drop_first) & (usable > drop_first))
            .withColumn("row", F.col("row") - drop_first).drop("_n"))


def cumulate_horizon(df: DataFrame, path: str, horizons) -> DataFrame:
    """h-step change as the sum of the first h one-step forecasts of an array."""
    def first(h):
        return F.aggregate(F.slice(path, 1, h), F.lit(0.0), lambda acc, x: acc + x)

    return df.select("*", *[first(h).alias(f"delta_h{h}") for h in horizons])


def local_polynomial_weights(window: int, degree: int, derivative: int) -> np.ndarray:
    """Row r: weights giving the value (or slope) of the window's fit at its point r."""
    x = np.arange(window, dtype=float)
    out = []
    for at in range(window):
        powers = np.vander(x - at, degree + 1, increasing=True)
        out.append(np.linalg.pinv(powers)[derivative])
    return np.array(out)


def savgol(df: DataFrame, column: str, window: int = 5, degree: int = 3, ts: str = WEEK,
           keys=("series",), causal: bool = False) -> DataFrame:
    """Local polynomial smoothing and slope; edge rows read the end window's fit.

    A window is odd and shorter than its series: where the series is too short
    for the asked one, the longest allowed is used, and below four rows the
    result is null. ``causal`` uses the newest point of the trailing window, so
    no later row is read.
    """
    w = ordered(ts, keys)
    rn = F.row_number().over(w)
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))

    def at(offset):
        return F.col(column) if offset == 0 else (
            F.lead(column, offset).over(w) if offset > 0 else F.lag(column, -offset).over(w))

    def fitted(size, derivative):
        weights = local_polynomial_weights(size, min(degree, size - 1), derivative)
        half = size // 2

        def from_row(r):
            return sum((at(k - r) * float(weights[r][k]) for k in range(1, size)),
                       at(-r) * float(weights[r][0]))

        if causal:
            return F.when(rn >= size, from_row(size - 1))
        result = F.when((rn > half) & (rn <= n - half), from_row(half))
        for r in range(half):
            result = result.when(rn == r + 1, from_row(r)).when(n - rn == r, from_row(size - 1 - r))
        return result

    def best(derivative):
        sizes = [s for s in range(window - (window + 1) % 2, 2, -2)]
        return F.coalesce(*[F.when(n > s, fitted(s, derivative)) for s in sizes[:-1]],
                          F.when(n > sizes[-1], fitted(sizes[-1], derivative)))

    return df.withColumn("smoothed", best(0)).withColumn("slope", best(1))


def sign_disagreement(df: DataFrame, level: str, slope: str, ts: str = WEEK, keys=("series",)) -> DataFrame:
    """How often the level's move is against the slope of the row before."""
    w = ordered(ts, keys)
    moved = df.select(*keys, (F.col(level) - F.lag(level).over(w)).alias("_move"),
                      F.lag(slope).over(w).alias("_slope"))
    against = (F.col("_move") * F.signum("_slope")) < 0
    return (moved.groupBy(*keys)
            .agg(F.count(F.when(against, 1)).alias("n_discrepancies"),
                 (F.count(F.lit(1)) - 1).alias("n_comparisons"))
            .withColumn("discrepancy_rate", F.col("n_discrepancies")
                        / F.when(F.col("n_comparisons") > 0, F.col("n_comparisons"))))
