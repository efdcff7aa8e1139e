"""Conditional volatility of residual series: estimation by likelihood grids,
variance recursions and variance paths."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import folds

WEEK = "week_end_date"
MODELS = ("garch", "egarch", "gjr")
N_PARAMS = {"garch": 3, "egarch": 4, "gjr": 4}
MEAN_ABS_Z = math.sqrt(2.0 / math.pi)

# First round of the likelihood grid; later ones close in on its best point.
BETAS = tuple(round(b, 3) for b in np.linspace(0.0, 0.98, 15))
ALPHAS = (0.0, 0.02, 0.04, 0.07, 0.1, 0.14, 0.19, 0.25, 0.32, 0.4, 0.5, 0.65, 0.8)
GAMMAS = {"garch": (0.0,), "gjr": (-0.1, -0.05, 0.0, 0.05, 0.1, 0.17, 0.25, 0.35),
          "egarch": (-0.3, -0.2, -0.1, -0.05, 0.0, 0.05, 0.1, 0.2, 0.3)}


def log_likelihoods(e: np.ndarray, variance: float, alpha, gamma, beta, model: str) -> np.ndarray:
    """Gaussian log-likelihood of many (alpha, gamma, beta) points, or of (alpha, gamma) pairs at one beta.

    The constant is targeted at the sample variance; inadmissible points are -inf.
    """
    alpha, gamma = np.asarray(alpha, dtype=float), np.asarray(gamma, dtype=float)
    beta = np.broadcast_to(np.asarray(beta, dtype=float), alpha.shape)
    total = np.zeros(len(alpha))
    if model == "egarch":
        admissible = np.abs(beta) < 1.0
        level = (1.0 - beta) * math.log(variance)
        log_h = np.full(len(alpha), math.log(variance))
        for x in e:
            scaled = x * np.exp(-0.5 * log_h)
            total += log_h + scaled * scaled
            log_h = np.clip(level + alpha * (np.abs(scaled) - MEAN_ABS_Z) + gamma * scaled + beta * log_h, -60, 60)
    else:
        persistence = alpha + gamma / 2 + beta
        admissible = (alpha >= 0) & (beta >= 0) & (alpha + gamma >= 0) & (persistence < 0.9995)
        omega = variance * np.maximum(1.0 - persistence, 1e-12)
        h = np.full(len(alpha), variance)
        for x in e:
            square = x * x
            total += np.log(h) + square / h
            h = np.maximum(omega + (alpha + (gamma if x < 0 else 0.0)) * square + beta * h, 1e-12 * variance)
    return np.where(admissible, -0.5 * (total + len(e) * math.log(2 * math.pi)), -np.inf)


FIT = T.StructType([*[T.StructField(c, T.DoubleType()) for c in ("loglik", "alpha", "gamma", "beta")], T.StructField("at_boundary", T.BooleanType())])
TOLERANCE = 1e-3
"""Step of the grid at which the search ends."""


def best_point(e: np.ndarray, variance: float, model: str):
    """``(loglik, alpha, gamma, beta, at_boundary)`` of the best point of a closing grid.

    Around the best point so far lies a grid of two steps each way. If its own best point is on the grid's edge the
    grid moves there, otherwise its steps are halved: the search follows the likelihood beyond the first grid. The
    flag tells a best point at the edge of what is admissible.
    """
    def score(a, g, b):
        points = [x.ravel() for x in np.meshgrid(a, g, b, indexing="ij")]
        ll = log_likelihoods(e, variance, *points, model)
        k = int(np.argmax(ll))
        return ll[k], [x[k] for x in points]

    best, at = score(ALPHAS, GAMMAS[model], BETAS)
    steps = [0.05, 0.0 if model == "garch" else 0.05, 0.04]
    for _ in range(60):
        grid = [np.array([c]) if not s else c + s * np.arange(-2, 3) for c, s in zip(at, steps)]
        found, there = score(*grid)
        edge = any(s and abs(t - c) > 1.5 * s for c, t, s in zip(at, there, steps)) and found > best
        if found > best:
            best, at = found, there
        if not edge:
            steps = [s / 2 for s in steps]
            if max(steps) < TOLERANCE:
                break
    alpha, gamma, beta = at
    if model == "egarch":
        edge = abs(beta) > 1 - 2 * TOLERANCE
    else:
        edge = min(alpha, beta, alpha + gamma + (model == "garch")) < TOLERANCE or alpha + gamma / 2 + beta > 0.9995 - 2 * TOLERANCE
    return float(best), float(alpha), float(gamma), float(beta), bool(edge)


def _search(model: str):
    @F.pandas_udf(FIT)
    def search(e: pd.Series, variance: pd.Series) -> pd.DataFrame:
        found = []
        for values, v in zip(e, variance):
            point = best_point(np.asarray(values, float), v, model) if v and v > 0 else (None,) * 5
            found.append(point if point[0] is not None and np.isfinite(point[0]) else (None,) * 5)
        return pd.DataFrame(found, columns=FIT.fieldNames()).astype({"at_boundary": object})
    # Non-deterministic only so that the optimizer never fits a series twice.
    return search.asNondeterministic()


def volatility_fit(resid: DataFrame, column: str = "resid", model: str = "gjr", keys=("series",), ts: str = WEEK) -> DataFrame:
    """Zero-mean Gaussian volatility model per key by a likelihood grid that closes in on its best point.

    Each series is fitted where its residuals were gathered. ``fit_status`` tells a series without variance, whose
    parameters are null; ``at_boundary`` a best point at the edge of the admissible ones.
    """
    if model not in MODELS:
        raise ValueError(f"unknown model {model}; expected one of {MODELS}")
    packed = (resid.groupBy(*keys)
              .agg(F.transform(F.array_sort(F.collect_list(F.when(F.col(column).isNotNull(), F.struct(ts, column)))), lambda r: r[column]).alias("_e"),
                   F.var_pop(column).alias("_v"), F.count(column).alias("n_obs")))
    best = packed.withColumn("_s", _search(model)("_e", "_v"))
    a, g, b, v = (F.col(f"_s.{c}") for c in ("alpha", "gamma", "beta", "loglik"))
    omega = ((1 - b) * F.log("_v")) if model == "egarch" else F.col("_v") * (1 - a - g / 2 - b)
    k = N_PARAMS[model]
    return best.select(*keys, F.lit(model).alias("vol_model"), omega.alias("omega"), a.alias("alpha"), g.alias("gamma"),
                       b.alias("beta"), F.col("_v").alias("h0"), v.alias("loglik"), (2 * k - 2 * v).alias("aic"),
                       (k * F.log(F.col("n_obs").cast("double")) - 2 * v).alias("bic"), "n_obs",
                       F.col("_s.at_boundary").alias("at_boundary"), F.when(v.isNull(), "no variance").otherwise("ok").alias("fit_status"))


def next_variance(e: Column, h: Column, omega: Column, alpha: Column, gamma: Column, beta: Column) -> Column:
    """One step of the asymmetric recursion; null where it is not positive and finite."""
    raw = omega + (alpha + F.when(e < 0, gamma).otherwise(0.0)) * e * e + beta * h
    return F.when((raw > 0) & ~F.isnan(raw) & (raw < F.lit(float("inf"))), raw)


def variances(model: str, floor: float | None):
    """Conditional variances along a series, as a fold of columns e, omega, alpha, gamma, beta and h0."""
    def after(e, h, omega, alpha, gamma, beta):
        if model == "egarch":
            z = e / math.sqrt(h)
            # Clipped as in the fit.
            return math.exp(max(-60.0, min(60.0, omega + alpha * (abs(z) - MEAN_ABS_Z) + gamma * z + beta * math.log(h))))
        raw = omega + (alpha + (gamma if e < 0 else 0.0)) * e * e + beta * h
        if floor is not None:
            return max(raw, floor)
        return raw if raw > 0 and math.isfinite(raw) else None

    def block(state, columns):
        last_e, last_h = state
        out = []
        for e, *given, h0 in zip(*[columns[f"_f_{c}"] for c in ("e", "omega", "alpha", "gamma", "beta", "h0")]):
            h = h0 if last_e is None else None if None in given else after(last_e, last_h, *given)
            out.append(h)
            if h is not None and e is not None:
                last_e, last_h = e, h
        return (last_e, last_h), [out]

    return block


def variance_recursion(df: DataFrame, params: DataFrame, column: str = "resid", keys=("series",), ts: str = WEEK,
                       model: str = "gjr", floor: float | None = None, carry=()) -> DataFrame:
    """Conditional variance ``h``, ``sigma`` and ``z`` along each series.

    ``params`` has ``omega, alpha, gamma, beta, h0`` per key. A step without a
    valid variance yields null and leaves the state as it was; a null residual
    does the same.
    """
    # A series without parameters keeps its rows, with null variances.
    names = ["omega", "alpha", "gamma", "beta", "h0"]
    given = params.select(*keys, *[F.col(c).cast("double").alias(f"_f_{c}") for c in names])
    rows = df.select(*keys, ts, F.col(column).cast("double").alias("_f_e"), *carry).join(given, list(keys), "left")
    out = folds.carried(rows, keys, [ts], ["_f_e", *[f"_f_{c}" for c in names]], "h double", lambda: (None, None), variances(model, floor))
    return out.select(*keys, ts, F.col("_f_e").alias(column), "h", F.sqrt("h").alias("sigma"), (F.col("_f_e") / F.sqrt("h")).alias("z"), *carry)


def variance_path(state: DataFrame, steps: Column, keys=("series",)) -> DataFrame:
    """Expected variance 1..h steps ahead in closed form.

    ``state`` has ``omega, alpha, gamma, beta`` and ``h1``, the variance of the
    first step. With k = alpha + gamma/2 + beta the path is ``v + k^(s-1) (h1 - v)``
    where k < 1, and the same geometric sum otherwise.
    """
    k = F.col("alpha") + F.col("gamma") / 2 + F.col("beta")
    s = F.col("step") - 1
    power = F.pow(k, s.cast("double"))
    grown = F.when(k == 1, s.cast("double")).otherwise((power - 1) / (k - 1))
    h = power * F.col("h1") + F.col("omega") * grown
    return (state.withColumn("step", F.explode(F.sequence(F.lit(1), steps)))
            .withColumn("h", h).withColumn("sigma", F.sqrt("h")).select(*keys, "step", "h", "sigma"))


def with_band(df: DataFrame, pred: str = "pred", sigma: str = "sigma", z: float = 1.96) -> DataFrame:
    return (df.withColumn("lower_95", F.col(pred) - z * F.col(sigma))
            .withColumn("upper_95", F.col(pred) + z * F.col(sigma)))
