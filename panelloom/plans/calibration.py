"""In-sample calibration of the univariate model families on one panel."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import arma as A
from ..operators import diagnostics as D
from ..operators import evaluation as E
from ..operators import models as M
from ..operators import regimes as G
from ..operators import volatility as V
from ..session import durable

WEEK = "week_end_date"
VOLATILITY_NAMES = {"garch": "ARMA-GARCH", "egarch": "ARMA-EGARCH", "gjr": "ARMA-GJR-GARCH"}
SWITCHING_NAME = "Markov-Switching"


def _union(frames) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def mean_families(train: DataFrame, column: str = "diff") -> tuple[DataFrame, DataFrame]:
    """Residuals and criteria of no change, AR(1) and the ARMA model of the least AIC.

    ``train`` holds training rows alone. Residuals are ``(series, model, week_end_date, resid)``, without the rows whose
    lags a model lacks; criteria are ``(series, model, aic, bic)``. No change has no criteria.
    """
    first = M.ar1_fit(train, column)
    chosen = durable(A.arma_select(A.arma_candidates(train, column, F.lit(True))))
    frames = {
        "Random Walk": M.zero_change_forecast(train, column),
        "AR(1)": M.ar1_forecast(train, first, column).withColumn("resid", E.error()),
        "ARMA": A.arma_filter(train, chosen, column)}
    resid = _union([f.filter("resid IS NOT NULL").select("series", F.lit(name).alias("model"), WEEK, "resid") for name, f in frames.items()])
    criteria = _union([f.select("series", F.lit(name).alias("model"), "aic", "bic") for name, f in (("AR(1)", first), ("ARMA", chosen))])
    return resid, criteria


def volatility_families(shocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Standardised residuals and criteria of the volatility models of ``(series, week_end_date, resid)``.

    A series without variance has no fit, hence no rows.
    """
    resid, criteria = [], []
    for model, name in VOLATILITY_NAMES.items():
        fit = durable(V.volatility_fit(shocks, "resid", model))
        rows = V.variance_recursion(shocks, fit, "resid", model=model).filter("z IS NOT NULL")
        resid.append(rows.select("series", F.lit(name).alias("model"), WEEK, F.col("z").alias("resid")))
        criteria.append(fit.filter("fit_status = 'ok'").select("series", F.lit(name).alias("model"), "aic", "bic"))
    return _union(resid), _union(criteria)


def switching_family(train: DataFrame, column: str = "diff") -> tuple[DataFrame, DataFrame]:
    """Residuals from the regime means weighed by their smoothed probabilities, and the criteria of the fit."""
    params, rows = G.two_regime_switching(train, column, keys=("series",))
    resid = rows.select("series", F.lit(SWITCHING_NAME).alias("model"), WEEK, (F.col(column) - F.col("fitted")).alias("resid"))
    return resid, params.select("series", F.lit(SWITCHING_NAME).alias("model"), "aic", "bic")


def calibration_residuals(train: DataFrame, column: str = "diff") -> tuple[DataFrame, DataFrame]:
    """Residuals and criteria of all seven families."""
    means, criteria = mean_families(train, column)
    means = durable(means)
    volatile, more = volatility_families(means.filter("model = 'ARMA'").drop("model"))
    switching, last = switching_family(train, column)
    return _union([means, volatile, switching]), _union([criteria, more, last])


def calibration_diagnostics(train: DataFrame, column: str = "diff") -> DataFrame:
    """One row per series and family: criteria, residual moments and dependence tests."""
    resid, criteria = calibration_residuals(train, column)
    return D.residual_diagnostics(durable(resid), criteria)
