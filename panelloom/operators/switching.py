"""Two-regime switching of series of any length: forward and backward passes as folds, likelihood steps as aggregates.

No series is gathered. The forward pass carries the regime probability along sorted rows; the backward pass reads the same
rows in falling order; a step of the fit is one aggregate by key over what both passes left.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable
from . import folds

WEEK = "week_end_date"
PARAMS = ("mu0", "mu1", "sd0", "sd1", "stay0", "stay1", "start1")
"""Means, deviations and chances of staying of both regimes, and the chance that the first row is in regime 1."""

LOG_ROOT = 0.5 * math.log(2 * math.pi)
TINY = 1e-300


def _forward(p, columns):
    """Predicted and filtered chance of regime 1, and the log-likelihood of each row; a null value moves the chance on."""
    predicted, filtered, logs = [], [], []
    for x, mu0, mu1, sd0, sd1, stay0, stay1, start1 in zip(columns["_x"], *[columns[f"_f_{c}"] for c in PARAMS]):
        if mu0 is None or sd0 is None:
            made = (None, None, None)
        else:
            prior = start1 if p is None else (1 - p) * (1 - stay0) + p * stay1
            if x is None:
                p, made = prior, (prior, prior, 0.0)
            else:
                a = -0.5 * ((x - mu0) / sd0) ** 2 - math.log(sd0)
                b = -0.5 * ((x - mu1) / sd1) ** 2 - math.log(sd1)
                peak = max(a, b)
                low, high = (1 - prior) * math.exp(a - peak), prior * math.exp(b - peak)
                norm = max(low + high, TINY)
                p = high / norm
                made = (prior, p, math.log(norm) + peak - LOG_ROOT)
        for out, v in zip((predicted, filtered, logs), made):
            out.append(v)
    return p, [predicted, filtered, logs]


def _backward(after, columns):
    """Smoothed chance of regime 1, and the chances of the four moves to the row after; null where there is none."""
    out: list[list] = [[] for _ in range(5)]
    for p, prior, x, stay0, stay1 in zip(columns["p_filtered"], columns["_prior"], columns["_x"], columns["_f_stay0"], columns["_f_stay1"]):
        if p is None:
            made = (None,) * 5
        elif after is None:
            made, after = (p, None, None, None, None), (p, prior, x is not None)
        else:
            smooth, ahead, known = after
            low, high = (1 - smooth) / max(1 - ahead, TINY), smooth / max(ahead, TINY)
            moves = ((1 - p) * stay0 * low, (1 - p) * (1 - stay0) * high, p * (1 - stay1) * low, p * stay1 * high)
            own = moves[2] + moves[3]
            made, after = (own, *(moves if known else (None,) * 4)), (own, prior, x is not None)
        for values, v in zip(out, made):
            values.append(v)
    return after, out


def regime_probabilities(df: DataFrame, params: DataFrame, column: str, keys=("series",), ts: str = WEEK, carry=(), moves: bool = False) -> DataFrame:
    """Filtered and smoothed chance of regime 1 of each row, from given ``PARAMS`` per key.

    Adds ``p_filtered``, ``p_smoothed``, ``loglik`` (the row's share) and, if asked, ``m00, m01, m10, m11``: the chances of the
    moves to the next row. Rows without a value keep the chance that the rows around them give; keys without
    parameters keep their rows, with nulls. Rows of one time are taken by value.
    """
    keys = list(keys)
    given = params.select(*keys, *[F.col(c).cast("double").alias(f"_f_{c}") for c in PARAMS])
    rows = df.select(*keys, ts, F.col(column).cast("double").alias("_x"), *carry).join(given, keys, "left")
    seen = folds.carried(rows, keys, [ts, "_x"], ["_x", *[f"_f_{c}" for c in PARAMS]], "_prior double, p_filtered double, loglik double", lambda: None, _forward)
    made = "p_smoothed double, m00 double, m01 double, m10 double, m11 double"
    out = folds.carried(seen, keys, [F.col(ts).desc(), F.col("_x").desc()], ["p_filtered", "_prior", "_x", "_f_stay0", "_f_stay1"], made, lambda: None, _backward)
    return out.select(*keys, ts, F.col("_x").alias(column), "p_filtered", "p_smoothed", "loglik", *(["m00", "m01", "m10", "m11"] if moves else []), *carry)


def start_params(df: DataFrame, column: str, keys=("series",)) -> DataFrame:
    """A first guess: the rows below and above the mean. A key of equal or no values has no parameters."""
    keys = list(keys)
    mean = df.groupBy(*keys).agg(F.avg(column).alias("_m"), F.stddev_pop(column).alias("_s"))
    above = F.col(column) > F.col("_m")
    halves = df.join(mean.filter("_s > 0"), keys).groupBy(*keys).agg(
        F.first("_s").alias("_s"), *[f(F.when(side, F.col(column))).alias(n) for side, k in ((~above, 0), (above, 1))
                                     for f, n in ((F.avg, f"mu{k}"), (F.stddev_pop, f"sd{k}"))])
    return halves.select(*keys, "mu0", "mu1", *[F.greatest(F.col(c), 1e-3 * F.col("_s")).alias(c) for c in ("sd0", "sd1")],
                         F.lit(0.9).alias("stay0"), F.lit(0.9).alias("stay1"), F.lit(0.5).alias("start1"))


def likelihood_step(df: DataFrame, params: DataFrame, column: str, keys=("series",), ts: str = WEEK) -> DataFrame:
    """The next parameters of each key, and ``loglik`` of the given ones, which never falls from step to step."""
    keys = list(keys)
    rows = regime_probabilities(df, params, column, keys, ts, moves=True).join(params.select(*keys, "mu0", "mu1"), keys)
    x = F.col(column)
    weight = {0: F.when(x.isNotNull(), 1 - F.col("p_smoothed")), 1: F.when(x.isNotNull(), F.col("p_smoothed"))}
    sums = [F.sum("loglik").alias("loglik"), F.stddev_pop(column).alias("_s"), F.count(column).alias("n_obs"),
            F.min_by("p_smoothed", ts).alias("start1"), *[F.sum(m).alias(m) for m in ("m00", "m01", "m10", "m11")]]
    for k, w in weight.items():
        # Around the last mean, so that a large level doesn't swallow the deviations.
        d = x - F.col(f"mu{k}")
        sums += [F.sum(w).alias(f"_w{k}"), F.sum(w * d).alias(f"_d{k}"), F.sum(w * d * d).alias(f"_q{k}"), F.first(f"mu{k}").alias(f"_mu{k}")]
    total = rows.groupBy(*keys).agg(*sums)
    # A regime that has lost its rows keeps its mean.
    shift = {k: F.col(f"_d{k}") / F.greatest(F.col(f"_w{k}"), F.lit(1e-9)) for k in (0, 1)}
    spread = {k: F.sqrt(F.greatest(F.col(f"_q{k}") / F.greatest(F.col(f"_w{k}"), F.lit(1e-9)) - shift[k] * shift[k], F.lit(0.0))) for k in (0, 1)}
    stay = {0: F.col("m00") / F.nullif(F.col("m00") + F.col("m01"), F.lit(0.0)), 1: F.col("m11") / F.nullif(F.col("m10") + F.col("m11"), F.lit(0.0))}
    return total.select(*keys, *[(F.col(f"_mu{k}") + shift[k]).alias(f"mu{k}") for k in (0, 1)],
                        *[F.greatest(spread[k], 1e-3 * F.col("_s")).alias(f"sd{k}") for k in (0, 1)],
                        *[F.coalesce(stay[k], F.lit(0.9)).alias(f"stay{k}") for k in (0, 1)], "start1", "loglik", "n_obs")


def fit_switching(df: DataFrame, column: str, keys=("series",), ts: str = WEEK, rounds: int = 50, tolerance: float = 1e-6) -> DataFrame:
    """``PARAMS``, ``loglik``, ``n_obs`` and criteria per key, by steps over all keys at once.

    Ends when no key's likelihood grows by more than ``tolerance``, or after ``rounds``. Regime 1 has the larger mean.
    """
    keys = list(keys)
    params, before = durable(start_params(df, column, keys)), None
    for _ in range(rounds):
        following = durable(likelihood_step(df, params, column, keys, ts))
        if before is not None:
            gain = following.select(*keys, "loglik").join(before.select(*keys, F.col("loglik").alias("_before")), keys)
            if gain.filter(F.col("loglik") - F.col("_before") > tolerance).isEmpty():
                break
        params = before = following
    if before is None:
        raise ValueError("rounds is at least 1")
    last = durable(likelihood_step(df, params, column, keys, ts)).select(*keys, "loglik", "n_obs")
    swap = F.col("mu0") > F.col("mu1")
    turned = [F.when(swap, F.col(c[:-1] + str(1 - int(c[-1])))).otherwise(F.col(c)).alias(c) for c in PARAMS[:-1]]
    out = params.select(*keys, *turned, F.when(swap, 1 - F.col("start1")).otherwise(F.col("start1")).alias("start1")).join(last, keys)
    return out.withColumn("aic", 12 - 2 * F.col("loglik")).withColumn("bic", 6 * F.log(F.col("n_obs").cast("double")) - 2 * F.col("loglik"))
