"""Two-regime models: a common factor, its switching fit and one vector
autoregression per regime."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import durable
from .cleaning import standardize
from .moments import DOUBLES, moment_matrix, unpack
from .vector import (KEYS, WEEK, _coefficients, _own_sample, iterate_system, lag_names, long_forecasts, one_step,
                     var_fit, var_lag_select, with_lags)

LOADINGS = T.StructType([T.StructField("loadings", DOUBLES), T.StructField("explained", T.DoubleType()),
                         T.StructField("flipped", T.BooleanType())])


@F.pandas_udf(LOADINGS)
def _leading_component(m: pd.Series) -> pd.DataFrame:
    """First eigenvector of ``[one, z.., mean]`` moments, signed along the mean."""
    out = []
    for packed in m:
        full = unpack(np.asarray(packed, dtype=float))
        n, z = full[0, 0], np.arange(1, len(full) - 1)
        centre = full[0, 1:] / n
        cov = full[1:, 1:] / n - np.outer(centre, centre)
        values, vectors = np.linalg.eigh(cov[np.ix_(z - 1, z - 1)])
        v = vectors[:, -1]
        first = v[np.argmax(np.abs(v))]
        v = v if first > 0 else -v
        flipped = bool(v @ cov[z - 1, -1] < 0)
        out.append(((-v if flipped else v).tolist(), float(values[-1] / values.sum()), flipped))
    return pd.DataFrame(out, columns=["loadings", "explained", "flipped"])


def first_factor(df: DataFrame, names, keys=KEYS, ts: str = WEEK) -> DataFrame:
    """Adds the first principal component of the standardised columns.

    Means, deviations and loadings come from the training rows; the factor
    rises with the average of the columns.
    """
    train = F.col("split") == "train"
    scaled = df
    for n in names:
        scaled = standardize(scaled, n, f"_z_{n}", train, keys)
    z = [f"_z_{n}" for n in names]
    mean = sum((F.col(n) for n in names[1:]), F.col(names[0])) / float(len(names))
    w = Window.partitionBy(*keys)
    seen = F.when(train, mean)
    scaled = scaled.withColumn("_one", F.lit(1.0)).withColumn(
        "_mean", (mean - F.avg(seen).over(w)) / F.nullif(F.stddev_pop(seen).over(w), F.lit(0.0)))
    columns = ["_one", *z, "_mean"]
    moments = moment_matrix(scaled.filter(train).select(*keys, *columns).na.drop(), keys, columns)
    parts = moments.select(*keys, _leading_component("m").alias("_c")).select(*keys, "_c.*")
    factor = sum((F.col("loadings")[i] * F.col(c) for i, c in enumerate(z)), F.lit(0.0))
    return (scaled.join(parts, list(keys)).withColumn("factor", factor)
            .drop(*z, "_one", "_mean"))


SWITCHING = T.StructType([
    T.StructField("mu", DOUBLES), T.StructField("sigma", DOUBLES), T.StructField("stay", DOUBLES),
    T.StructField("loglik", T.DoubleType()), T.StructField("p_high", DOUBLES), T.StructField("rounds", T.IntegerType())])


def switching_em(x: np.ndarray, known: np.ndarray, tolerance: float = 1e-6, most: int = 200):
    """Two Gaussian states with switching mean and variance, for a batch of series.

    ``x`` is (series, time), ``known`` marks real values of padded rows. Starts
    from a split at the median; state 1 ends as the one with the larger mean.
    """
    n_series, length = x.shape
    size = known.sum(axis=1)
    median = np.array([np.median(row[ok]) for row, ok in zip(x, known)])
    high = (x > median[:, None]) & known
    weight = np.stack([known & ~high, high], axis=2).astype(float)
    spread = np.array([np.std(row[ok]) for row, ok in zip(x, known)])
    spread[spread == 0] = 1.0
    floor = (1e-3 * spread)[:, None]

    def weighted_moments(w):
        total = np.maximum(w.sum(axis=1), 1e-9)
        mean = (w * x[:, :, None]).sum(axis=1) / total
        var = (w * (x[:, :, None] - mean[:, None, :]) ** 2).sum(axis=1) / total
        return mean, np.maximum(np.sqrt(var), floor)

    mu, sigma = weighted_moments(weight)
    move = np.tile(np.array([[0.9, 0.1], [0.1, 0.9]]), (n_series, 1, 1))
    start = np.full((n_series, 2), 0.5)
    before = np.full(n_series, -np.inf)
    open_series = np.ones(n_series, dtype=bool)
    rounds = np.zeros(n_series, dtype=int)
    smooth = weight
    loglik = before
    for _ in range(most):
        scaled = (x[:, :, None] - mu[:, None, :]) / sigma[:, None, :]
        log_density = -0.5 * scaled ** 2 - np.log(sigma)[:, None, :] - 0.5 * math.log(2 * math.pi)
        peak = log_density.max(axis=2)
        density = np.where(known[:, :, None], np.exp(log_density - peak[:, :, None]), 1.0)
        forward = np.empty((n_series, length, 2))
        norm = np.ones((n_series, length))
        state = start * density[:, 0]
        for t in range(length):
            if t:
                state = np.einsum("bi,bij->bj", forward[:, t - 1], move) * density[:, t]
            norm[:, t] = np.maximum(state.sum(axis=1), 1e-300)
            forward[:, t] = state / norm[:, t][:, None]
        loglik = (np.where(known, np.log(norm) + peak, 0.0)).sum(axis=1)
        smooth_new = np.empty_like(forward)
        smooth_new[:, -1] = forward[:, -1]
        pairs = np.zeros((n_series, 2, 2))
        for t in range(length - 2, -1, -1):
            ahead = np.einsum("bi,bij->bj", forward[:, t], move)
            ratio = smooth_new[:, t + 1] / np.maximum(ahead, 1e-300)
            joint = forward[:, t][:, :, None] * move * ratio[:, None, :]
            smooth_new[:, t] = joint.sum(axis=2)
            pairs += joint * known[:, t + 1][:, None, None]
        weights = smooth_new * known[:, :, None]
        new_mu, new_sigma = weighted_moments(weights)
        new_move = pairs / np.maximum(pairs.sum(axis=2, keepdims=True), 1e-12)
        o = open_series
        smooth = np.where(o[:, None, None], smooth_new, smooth)
        rounds[o] += 1
        done = np.abs(loglik - before) < tolerance
        before = np.where(o, loglik, before)
        go = o & ~done
        mu[go], sigma[go], move[go], start[go] = new_mu[go], new_sigma[go], new_move[go], smooth_new[go, 0]
        open_series = go
        if not go.any():
            break
    swap = mu[:, 0] > mu[:, 1]
    for a in (mu, sigma):
        a[swap] = a[swap][:, ::-1]
    move[swap] = move[swap][:, ::-1, ::-1]
    smooth = np.where(swap[:, None, None], smooth[:, :, ::-1], smooth)
    return mu, sigma, move, before, smooth, rounds, size


@F.pandas_udf(SWITCHING)
def _switching(x: pd.Series) -> pd.DataFrame:
    sizes = [len(v) for v in x]
    padded = np.zeros((len(sizes), max(sizes)))
    known = np.zeros_like(padded, dtype=bool)
    for i, v in enumerate(x):
        padded[i, :sizes[i]] = v
        known[i, :sizes[i]] = True
    mu, sigma, move, loglik, smooth, rounds, _ = switching_em(padded, known)
    return pd.DataFrame({
        "mu": [list(r) for r in mu], "sigma": [list(r) for r in sigma],
        "stay": [[float(m[0, 0]), float(m[1, 1])] for m in move], "loglik": loglik,
        "p_high": [smooth[i, :n, 1].tolist() for i, n in enumerate(sizes)], "rounds": rounds.astype("int32")})


_switching = _switching.asNondeterministic()


def two_regime_switching(df: DataFrame, column: str, keys=KEYS, ts: str = WEEK) -> tuple[DataFrame, DataFrame]:
    """Parameters per key, and smoothed probabilities with the likeliest regime per row.

    Regime 1 has the larger mean (stress). A series is at most one value per
    week, and a task iterates over a batch of whole series.
    """
    packed = (df.filter(F.col(column).isNotNull()).groupBy(*keys)
              .agg(F.array_sort(F.collect_list(F.struct(ts, column))).alias("_rows")))
    fitted = packed.withColumn("_f", _switching(F.transform("_rows", lambda r: r[column])))
    n = F.size("_rows").cast("double")
    # Two means, two variances and two transition probabilities.
    params = fitted.select(*keys, F.col("_f.mu").alias("mu"), F.col("_f.sigma").alias("sigma"), F.col("_f.stay").alias("stay"),
                           F.col("_f.loglik").alias("loglik"), (12.0 - 2 * F.col("_f.loglik")).alias("aic"),
                           (6.0 * F.log(n) - 2 * F.col("_f.loglik")).alias("bic"), F.col("_f.rounds").alias("rounds"))
    rows = (fitted.select(*keys, F.col("_f.mu").alias("_mu"), F.explode(F.arrays_zip(
        F.col("_rows").alias("r"), F.col("_f.p_high").alias("p"))).alias("z"))
        .select(*keys, F.col(f"z.r.{ts}").alias(ts), F.col(f"z.r.{column}").alias(column),
                F.array(1 - F.col("z.p"), F.col("z.p")).alias("p_regime"),
                F.when(F.col("z.p") > 0.5, 1).otherwise(0).alias("regime"),
                ((1 - F.col("z.p")) * F.col("_mu")[0] + F.col("z.p") * F.col("_mu")[1]).alias("fitted")))
    return params, rows


def regime_var(labelled: DataFrame, names, orders: DataFrame, max_lag: int = 8, keys=KEYS, ts: str = WEEK,
               respect_gaps: bool = False) -> DataFrame:
    """Coefficients per system and regime; regimes with too few rows get the global fit.

    Lags run over the rows of a regime as if adjacent. ``respect_gaps`` keeps
    only rows whose lags are true calendar neighbours.
    """
    k = len(names)
    global_fit = var_fit(labelled, names, orders, max_lag, keys, ts).select(*keys, "lag_order", F.col("coef").alias("_global"))
    regime_keys = (*keys, "regime")
    if respect_gaps:
        lagged = with_lags(labelled, names, max_lag, keys, ts)
    else:
        lagged = with_lags(labelled, names, max_lag, regime_keys, ts)
    lagged = lagged.join(orders, list(keys))
    sizes = labelled.groupBy(*regime_keys).agg(F.count(F.lit(1)).alias("n_rows_regime"))
    rows = _own_sample(lagged, names, max_lag, F.col("lag_order"), regime_keys)
    own = _coefficients(moment_matrix(rows, regime_keys, ["_one", *lag_names(names, max_lag), *names]),
                        regime_keys, names, max_lag).select(*regime_keys, F.col("coef").alias("_own"))
    both = (global_fit.withColumn("regime", F.explode(F.array(F.lit(0), F.lit(1))))
            .join(sizes, list(regime_keys), "left").join(own, list(regime_keys), "left"))
    enough = F.coalesce(F.col("n_rows_regime"), F.lit(0)) >= F.greatest(F.lit(30), F.col("lag_order") * k + 10)
    return both.select(*regime_keys, "lag_order", F.coalesce("n_rows_regime", F.lit(0)).alias("n_obs"),
                       (enough & F.col("_own").isNotNull()).alias("own_fit"),
                       F.when(enough, F.coalesce("_own", "_global")).otherwise(F.col("_global")).alias("coef"))


def fit_regimes(df: DataFrame, names, max_lag: int = 8, keys=KEYS, ts: str = WEEK):
    """Factor, labels of the training rows and one fit per regime: the parts of the forecasts below.

    Factor and labels are checkpointed, so the switching fit runs once however
    often its labels are read.
    """
    factored = durable(first_factor(df, names, keys, ts))
    train = factored.filter(F.col("split") == "train")
    _, labels = two_regime_switching(train, "factor", keys, ts)
    labelled = durable(train.drop("factor").join(labels.select(*keys, ts, "factor", "regime"), [*keys, ts]))
    orders = var_lag_select(train, names, max_lag, None, keys, ts)
    return factored, labelled, regime_var(labelled, names, orders, max_lag, keys, ts)


def regime_static(df: DataFrame, names, max_lag: int = 8, keys=KEYS, ts: str = WEEK) -> DataFrame:
    """Path over the test rows from the fit of the last training regime."""
    _, labelled, fits = fit_regimes(df, names, max_lag, keys, ts)
    last = labelled.groupBy(*keys).agg(F.max_by("regime", ts).alias("regime"))
    chosen = last.join(fits.select(*keys, "regime", "coef"), [*keys, "regime"]).select(*keys, "coef")
    joined = df.select(*keys, ts, "split", *names).join(chosen, list(keys))
    return iterate_system(joined, names, "coef", keys, ts, max_lag)


def nearest_regime(factor: Column, calm: Column, stress: Column) -> Column:
    return F.when(F.abs(factor - stress) < F.abs(factor - calm), 1).otherwise(0)


def regime_rolling(df: DataFrame, names, max_lag: int = 8, keys=KEYS, ts: str = WEEK) -> DataFrame:
    """One-step forecasts: the regime nearest to the factor of the row before picks the fit."""
    k = len(names)
    factored, labelled, fits = fit_regimes(df, names, max_lag, keys, ts)
    means = labelled.groupBy(*keys).agg(F.avg(F.when(F.col("regime") == 0, F.col("factor"))).alias("_calm"),
                                        F.avg(F.when(F.col("regime") == 1, F.col("factor"))).alias("_stress"))
    w = Window.partitionBy(*keys).orderBy(ts)
    lagged = (with_lags(factored.select(*keys, ts, "split", "factor", *names), names, max_lag, keys, ts)
              .withColumn("_before", F.lag("factor").over(w)))
    origin = (lagged.filter(F.col("split") == "test").join(means, list(keys))
              .withColumn("regime", nearest_regime(F.col("_before"), F.col("_calm"), F.col("_stress"))))
    state = F.array(*[F.col(c) for c in lag_names(names, max_lag)])
    scored = (origin.join(fits.select(*keys, "regime", "coef"), [*keys, "regime"])
              .withColumn("_pred", one_step(F.col("coef"), state, k)))
    return long_forecasts(scored, names, "_pred", keys, ts, carry=("regime",))
