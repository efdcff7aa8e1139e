"""Vector autoregressions of small systems, many systems at once.

A system is a wide frame without nulls: one key, one date and a column per
series of the system. All fits are sub-matrix solves on one moment matrix per system; the
rolling fits read running moments, so no row is summed twice.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arma import test_offset, with_last_fit
from .moments import moment_matrix, regress, solve, unpack

WEEK = "week_end_date"
KEYS = ("system",)


def lag_names(names, lags: int):
    """Most recent lag first, the system's columns within a lag in order."""
    return [f"_{n}_lag{k}" for k in range(1, lags + 1) for n in names]


def with_lags(df: DataFrame, names, lags: int, keys=KEYS, ts: str = WEEK) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(ts)
    return df.select("*", F.lit(1.0).alias("_one"), F.row_number().over(w).alias("_rn"),
                     *[F.lag(n, k).over(w).alias(f"_{n}_lag{k}") for k in range(1, lags + 1) for n in names])


def _ints(values) -> Column:
    return F.array(*[F.lit(int(v)) for v in values])


def _pick_lag(names, max_lag: int):
    k = len(names)

    @F.pandas_udf(T.IntegerType())
    def pick(m: pd.Series, n: pd.Series) -> pd.Series:
        best = []
        for packed, rows in zip(m, n):
            full = unpack(np.asarray(packed, dtype=float))
            y = np.arange(len(full) - k, len(full))
            scores = []
            for p in range(1, max_lag + 1):
                if rows <= 1 + p * k:
                    break
                _, left = regress(full, np.arange(1 + p * k), y)
                sign, logdet = np.linalg.slogdet(left / rows)
                scores.append((logdet if sign > 0 else math.inf) + 2.0 * (p * k * k + k) / rows)
            best.append(int(np.argmin(scores)) + 1 if scores else 1)
        return pd.Series(best, dtype="int32")
    return pick


def var_lag_select(df: DataFrame, names, max_lag: int = 8, force: int | None = None, keys=KEYS, ts: str = WEEK) -> DataFrame:
    """Lag order per system by AIC on the sample complete for the longest lag, at least one."""
    if force is not None:
        return df.select(*keys).distinct().withColumn("lag_order", F.lit(int(force)))
    # Rows are complete, so the first rows of a system are the only ones without all lags.
    rows = (with_lags(df, names, max_lag, keys, ts).filter(F.col("_rn") > max_lag)
            .select(*keys, "_one", *lag_names(names, max_lag), *names))
    m = moment_matrix(rows, keys, ["_one", *lag_names(names, max_lag), *names])
    return m.select(*keys, _pick_lag(names, max_lag)("m", "n_rows").alias("lag_order"))


def _own_sample(lagged: DataFrame, names, max_lag: int, lag: Column, extra=()) -> DataFrame:
    """Rows complete for the system's own order; longer lags are zero columns."""
    kept = lagged.filter(F.col("_rn") > lag)
    return kept.select(*extra, "_one", *[
        F.when(F.lit(k) <= lag, F.col(f"_{n}_lag{k}")).otherwise(0.0).alias(f"_{n}_lag{k}")
        for k in range(1, max_lag + 1) for n in names], *names)


def _coefficients(moments: DataFrame, keys, names, max_lag: int) -> DataFrame:
    width = 1 + max_lag * len(names)
    fit = moments.withColumn("_s", solve("m", _ints(range(width)), _ints(range(width, width + len(names)))))
    return fit.select(*keys, F.col("_s.coef").alias("coef"), F.col("_s.sscp").alias("sscp"), F.col("n_rows").alias("n_obs"))


def var_fit(df: DataFrame, names, orders: DataFrame, max_lag: int = 8, keys=KEYS, ts: str = WEEK) -> DataFrame:
    """Coefficients ``coef`` per system: one array ``[const, lag 1.., lag 2..]`` per target."""
    lagged = with_lags(df, names, max_lag, keys, ts).join(orders, list(keys))
    rows = _own_sample(lagged, names, max_lag, F.col("lag_order"), (*keys, "lag_order"))
    moments = moment_matrix(rows, [*keys, "lag_order"], ["_one", *lag_names(names, max_lag), *names])
    return _coefficients(moments, [*keys, "lag_order"], names, max_lag)


def one_step(coef: Column, state: Column, k: int) -> Column:
    """Array of k forecasts from coefficient arrays and the stacked lag state."""
    return F.transform(coef, lambda c: c[0] + F.aggregate(
        F.zip_with(F.slice(c, 2, F.size(state)), state, lambda a, b: a * F.coalesce(b, F.lit(0.0))),
        F.lit(0.0), lambda s, v: s + v))


def long_forecasts(df: DataFrame, names, pred: str, keys=KEYS, ts: str = WEEK, carry=()) -> DataFrame:
    """Wide actual columns and a forecast array to long ``(series, actual, pred)``."""
    stacked = F.explode(F.array(*[F.struct(F.lit(n).alias("series"), F.col(n).alias("actual"),
                                           F.col(pred)[i].alias("pred")) for i, n in enumerate(names)]))
    return df.select(*keys, ts, *carry, stacked.alias("r")).select(*keys, ts, *carry, "r.*")


def iterate_system(state_rows: DataFrame, names, coef: str, keys=KEYS, ts: str = WEEK, max_lag: int = 8) -> DataFrame:
    """Iterated paths over the test rows; ``state_rows`` has ``split`` and the system columns."""
    k = len(names)
    packed = state_rows.groupBy(*keys).agg(
        F.first(coef).alias("coef"),
        F.sort_array(F.collect_list(F.when(F.col("split") == "train", F.struct(ts, *names))), asc=False).alias("_train"),
        F.array_sort(F.collect_list(F.when(F.col("split") == "test", F.struct(ts, *names)))).alias("_test"))
    state = F.flatten(F.transform(F.slice("_train", 1, max_lag), lambda r: F.array(*[r[n] for n in names])))
    start = F.struct(state.alias("s"), F.array().cast("array<array<double>>").alias("out"))

    def step(acc, _):
        pred = one_step(F.col("coef"), acc["s"], k)
        return F.struct(F.slice(F.concat(pred, acc["s"]), 1, max_lag * k).alias("s"),
                        F.concat(acc["out"], F.array(pred)).alias("out"))

    paths = packed.withColumn("_path", F.aggregate("_test", start, step, lambda acc: acc["out"]))
    rows = (paths.select(*keys, F.explode(F.arrays_zip(F.col("_test").alias("r"), F.coalesce("_path", F.array()).alias("p"))).alias("z"))
            .select(*keys, F.col(f"z.r.{ts}").alias(ts), *[F.col(f"z.r.{n}").alias(n) for n in names],
                    F.col("z.p").alias("_pred")))
    return long_forecasts(rows, names, "_pred", keys, ts)


def var_static(df: DataFrame, names, max_lag: int = 8, keys=KEYS, ts: str = WEEK, force: int | None = None) -> DataFrame:
    """Order selection, fit on the training rows and iterated path over the test rows."""
    train = df.filter(F.col("split") == "train")
    orders = var_lag_select(train, names, max_lag, force, keys, ts)
    fit = var_fit(train, names, orders, max_lag, keys, ts)
    joined = df.select(*keys, ts, "split", *names).join(fit.select(*keys, "coef"), list(keys), "left")
    return iterate_system(joined, names, "coef", keys, ts, max_lag)


def var_residuals(df: DataFrame, names, fit: DataFrame, max_lag: int = 8, keys=KEYS, ts: str = WEEK) -> DataFrame:
    """Long training residuals, for correlation and dependence checks."""
    lagged = with_lags(df, names, max_lag, keys, ts).join(fit.select(*keys, "lag_order", "coef"), list(keys))
    rows = (lagged.filter(F.col("_rn") > F.col("lag_order"))
            .withColumn("_pred", one_step(F.col("coef"), F.array(*[F.col(c) for c in lag_names(names, max_lag)]), len(names))))
    out = long_forecasts(rows, names, "_pred", keys, ts)
    return out.withColumn("resid", F.col("actual") - F.col("pred"))


def var_rolling(df: DataFrame, names, max_lag: int = 8, keys=KEYS, ts: str = WEEK, force: int | None = None) -> DataFrame:
    """One-step forecasts of the test rows, refitted on all rows before each one.

    Zero where a refit has too few rows. ``df`` carries ``split``.
    """
    k = len(names)
    width = 1 + max_lag * k
    orders = var_lag_select(df.filter(F.col("split") == "train"), names, max_lag, force, keys, ts)
    lagged = with_lags(df, names, max_lag, keys, ts).join(orders, list(keys), "left").na.fill(1, ["lag_order"])
    # Training rows share bucket 0; each test row is its own bucket, used by later rows only.
    lagged = lagged.withColumn("_bucket", test_offset(keys, ts).cast("int"))
    sample = _own_sample(lagged, names, max_lag, F.col("lag_order"), (*keys, "_bucket"))
    moments = moment_matrix(sample, keys, ["_one", *lag_names(names, max_lag), *names], running="_bucket")
    fits = _coefficients(moments, [*keys, "_bucket"], names, max_lag)
    state = F.array(*[F.when(F.lit(i // k + 1) <= F.col("lag_order"), F.col(c)).otherwise(0.0)
                      for i, c in enumerate(lag_names(names, max_lag))])
    enough = F.col("n_obs") > F.col("lag_order") * k + 1
    test = (lagged.filter(F.col("split") == "test").withColumn("_bucket", F.col("_bucket") - 1)
            .transform(lambda t: with_last_fit(t, fits, ["coef", "n_obs"], keys, "_bucket", ts))
            .withColumn("_pred", F.when(enough, one_step(F.col("coef"), state, k)))
            .withColumn("_pred", F.coalesce("_pred", F.array(*[F.lit(0.0)] * k))))
    return long_forecasts(test, names, "_pred", keys, ts)
