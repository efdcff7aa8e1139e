"""Autoregressive moving-average models with optional regressors, as panel jobs.

Estimation is two least-squares passes over moment matrices: a long
autoregression supplies shocks, then the value is regressed on its own lags,
the lagged shocks and the regressors. All candidate orders read the same
matrix. Filtering and forecasting fold the ordered weekly values of a series
(at most one per week) with JVM higher-order functions.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import folds
from .models import information_criteria
from .moments import moment_matrix, solve

WEEK = "week_end_date"
LONG_AR = 8
# Coefficient arrays are zero-padded to at least this length.
MIN_WIDTH = 3


def order_grid(max_p: int = 3, max_q: int = 3):
    return [(p, q) for p in range(max_p + 1) for q in range(max_q + 1) if p + q > 0]


def _ints(values) -> Column:
    return F.array(*[F.lit(int(v)) for v in values])


def dot(coefficients: Column, first: int, columns) -> Column:
    """``sum coefficients[first + i] * columns[i]`` as a flat expression."""
    return sum((coefficients[first + i] * F.col(c) for i, c in enumerate(columns)), F.lit(0.0))


def with_shocks(df: DataFrame, y: str, train: Column, keys=("series",), ts: str = WEEK,
                long_lags: int = LONG_AR, exog=()) -> DataFrame:
    """Add ``_e``: residuals of a long autoregression estimated on the training rows."""
    w = Window.partitionBy(*keys).orderBy(ts)
    lags = [f"_s{k}" for k in range(1, long_lags + 1)]
    rows = df.select("*", F.lit(1.0).alias("_one"), train.alias("_train"),
                     *[F.lag(y, k).over(w).alias(f"_s{k}") for k in range(1, long_lags + 1)])
    columns = ["_one", *lags, *exog]
    complete = rows.filter("_train").select(*keys, *columns, F.col(y).alias("_y")).na.drop()
    fit = (moment_matrix(complete, keys, [*columns, "_y"])
           .select(*keys, solve("m", _ints(range(len(columns))), _ints([len(columns)]))["coef"][0].alias("_long")))
    return (rows.join(fit, list(keys), "left")
            .withColumn("_e", F.col(y) - dot(F.col("_long"), 0, columns))
            .drop(*lags, "_long"))


def lagged_design(df: DataFrame, y: str, max_p: int, max_q: int, keys=("series",), ts: str = WEEK) -> DataFrame:
    """Add ``_y1.._yp`` and ``_e1.._eq`` to rows carrying ``_e``."""
    w = Window.partitionBy(*keys).orderBy(ts)
    return df.select("*", *[F.lag(y, i).over(w).alias(f"_y{i}") for i in range(1, max_p + 1)],
                     *[F.lag("_e", j).over(w).alias(f"_e{j}") for j in range(1, max_q + 1)])


def design_columns(max_p: int, max_q: int, exog=()):
    return ["_one", *[f"_y{i}" for i in range(1, max_p + 1)], *[f"_e{j}" for j in range(1, max_q + 1)], *exog]


def order_positions(p: int, q: int, max_p: int, max_q: int, n_exog: int):
    """Columns of the design an order uses."""
    return [0, *range(1, p + 1), *range(1 + max_p, 1 + max_p + q),
            *range(1 + max_p + max_q, 1 + max_p + max_q + n_exog)]


@F.pandas_udf(T.BooleanType())
def _stable(ar: pd.Series, ma: pd.Series) -> pd.Series:
    """All roots of both polynomials outside the unit circle."""
    def inside(c):
        c = np.trim_zeros(np.asarray(c, dtype=float), "b")
        if not len(c):
            return True
        companion = np.eye(len(c), k=-1)
        companion[0] = c
        return bool(np.all(np.isfinite(c)) and np.max(np.abs(np.linalg.eigvals(companion))) < 1.0)
    return pd.Series([inside(a) and inside(-np.asarray(m, dtype=float)) for a, m in zip(ar, ma)], dtype=bool)


_stable = _stable.asNondeterministic()


def stable_roots(ar: Column, ma: Column, width: int) -> Column:
    """``_stable`` of arrays of ``width`` coefficients: up to three by the triangle conditions, which take no Python worker."""
    if width > 3:
        return _stable(ar, ma)

    def inside(c: Column, sign: int) -> Column:
        x, y, z = [sign * F.coalesce(F.get(c, F.lit(i)), F.lit(0.0)) for i in range(3)]
        finite = F.abs(x) + F.abs(y) + F.abs(z) < float("inf")  # NaN is larger
        return finite & (1 - x - y - z > 0) & (1 + x - y + z > 0) & (F.abs(z) < 1) & (1 - z * z > F.abs(y + x * z))

    return inside(ar, 1) & inside(ma, -1)


def fit_orders(moments: DataFrame, keys, orders, n_exog: int = 0) -> DataFrame:
    """One row per key and order: coefficients, variance, criteria, stability."""
    max_p, max_q = max(p for p, _ in orders), max(q for _, q in orders)
    candidates = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(q).alias("q"),
                                    _ints(order_positions(p, q, max_p, max_q, n_exog)).alias("x")) for p, q in orders])
    tried = moments.select(*keys, "n_rows", "m", F.explode(candidates).alias("o")).select("*", "o.*").drop("o")
    return fitted(tried, keys, max_p, max_q, n_exog)


def fit_given_orders(moments: DataFrame, keys, by, orders: DataFrame, default, max_p: int, max_q: int, n_exog: int = 0) -> DataFrame:
    """One row per key with the order that the table ``orders`` (*by, p, q) gives it, or ``default``.

    All orders read one design of ``max_p`` and ``max_q`` lags; columns beyond an order are left out of its solve. Orders above
    these are cut to them, and a row without p or q counts as the default.
    """
    def cut(name, standard, most):
        return F.greatest(F.lit(0), F.least(F.lit(most), F.coalesce(F.col(f"_{name}").cast("int"), F.lit(standard)))).alias(name)

    def columns(first, count):
        return F.when(count > 0, F.sequence(F.lit(first), F.lit(first) + count - 1)).otherwise(F.array().cast("array<int>"))

    given = orders.select(*by, F.col("p").alias("_p"), F.col("q").alias("_q")).dropDuplicates(list(by))
    tried = moments.join(given, list(by), "left").select(*keys, "n_rows", "m", cut("p", default[0], max_p), cut("q", default[1], max_q))
    exog = F.array(*[F.lit(1 + max_p + max_q + i) for i in range(n_exog)]).cast("array<int>")
    x = F.concat(_ints([0]), columns(1, F.col("p")), columns(1 + max_p, F.col("q")), exog)
    return fitted(tried.withColumn("x", x), keys, max_p, max_q, n_exog)


def fitted(tried: DataFrame, keys, max_p: int, max_q: int, n_exog: int) -> DataFrame:
    """The fits of rows with moments ``m``, an order ``p, q`` and its columns ``x``."""
    width = 1 + max_p + max_q + n_exog
    n, k = F.col("n_rows").cast("double"), (F.col("p") + F.col("q") + 2).cast("double") + n_exog
    tried = (tried.filter(F.col("n_rows") > F.col("p") + F.col("q") + 1 + n_exog)
             .withColumn("_fit", solve("m", F.col("x"), _ints([width]))))
    coef = F.col("_fit.coef")[0]
    ssr = F.col("_fit.sscp")[0]
    zeros = F.array_repeat(F.lit(0.0), max(max_p, max_q, MIN_WIDTH))

    def padded(start, count, size):
        return F.slice(F.concat(F.slice(coef, start, count), zeros), 1, size)

    aic, bic = information_criteria(n, ssr, k)
    return (tried.filter(ssr > 0).select(
        *keys, "p", "q", coef[0].alias("const"), padded(F.lit(2), F.col("p"), max(max_p, MIN_WIDTH)).alias("ar"),
        padded(F.col("p") + 2, F.col("q"), max(max_q, MIN_WIDTH)).alias("ma"),
        F.slice(coef, F.col("p") + F.col("q") + 2, F.lit(max(n_exog, 1))).alias("beta"),
        (ssr / n).alias("sigma2"), F.col("n_rows").alias("n_obs"), aic.alias("aic"), bic.alias("bic"))
        .withColumn("stable", stable_roots(F.col("ar"), F.col("ma"), max(max_p, max_q, MIN_WIDTH))))


def arma_candidates(df: DataFrame, y: str, train: Column, keys=("series",), ts: str = WEEK, orders=None) -> DataFrame:
    """Every candidate order of every series, all on the same rows."""
    orders = orders or order_grid()
    max_p, max_q = max(p for p, _ in orders), max(q for _, q in orders)
    shocks = with_shocks(df.select(*keys, ts, y, train.alias("_is_train")), y, F.col("_is_train"), keys, ts)
    rows = lagged_design(shocks, y, max_p, max_q, keys, ts).filter("_train")
    columns = design_columns(max_p, max_q)
    complete = rows.select(*keys, *columns, F.col(y).alias("_y")).na.drop()
    fits = fit_orders(moment_matrix(complete, keys, [*columns, "_y"]), keys, orders)
    # A series too short for any order stays, with a row of nulls.
    return df.select(*keys).distinct().join(fits, list(keys), "left")


def arma_given(df: DataFrame, y: str, train: Column, orders: DataFrame, default=(1, 2), keys=("series",), ts: str = WEEK,
               max_p: int = 3, max_q: int = 3) -> DataFrame:
    """The fit of each series at the order the table ``orders`` (*keys, p, q) names for it: see ``fit_given_orders``.

    Same columns as ``arma_candidates``, one row per series; a series too short for its order stays, with nulls.
    """
    shocks = with_shocks(df.select(*keys, ts, y, train.alias("_is_train")), y, F.col("_is_train"), keys, ts)
    rows = lagged_design(shocks, y, max_p, max_q, keys, ts).filter("_train")
    columns = design_columns(max_p, max_q)
    complete = rows.select(*keys, *columns, F.col(y).alias("_y")).na.drop()
    fits = fit_given_orders(moment_matrix(complete, keys, [*columns, "_y"]), keys, keys, orders, default, max_p, max_q)
    return df.select(*keys).distinct().join(fits, list(keys), "left")


def arma_select(candidates: DataFrame, keys=("series",)) -> DataFrame:
    """Lowest AIC among the stable candidates; the smaller order wins a tie.

    Unstable estimates count as failed fits, as a constrained optimiser would
    never return them. ``fit_status`` tells a series without a usable candidate, whose other columns are null.
    """
    fields = [c for c in candidates.columns if c not in (*keys, "stable")]
    best = F.min_by(F.struct(*fields), F.when(F.col("stable"), F.struct("aic", "p", "q")))
    status = F.when(F.bool_or("stable"), "ok").when(F.count("stable") > 0, "no stable candidate").otherwise("too few rows")
    return candidates.groupBy(*keys).agg(best.alias("b"), status.alias("fit_status")).select(*keys, "b.*", "fit_status")


def fold_forecasts(rows: DataFrame, keys, ts: str, y: str, base: str, ma: str, max_q: int, carry=()) -> DataFrame:
    """One-step forecasts with a moving-average part.

    ``base`` is everything but the shocks (null where its lags are missing: no
    forecast, shock zero); ``ma`` may differ by row. The last ``max_q`` shocks
    are carried along the ordered rows of a key, in linear time.
    """
    given = rows.select(*keys, ts, F.col(y).cast("double").alias("_f_y"), F.col(base).alias("_f_base"), F.col(ma).alias("_f_ma"), *carry)
    out = folds.carried(given, keys, [ts], ["_f_y", "_f_base", "_f_ma"], "pred double", lambda: [0.0] * max_q, folds.one_step(max_q))
    return out.select(*keys, ts, F.col("_f_y").alias("actual"), "pred", (F.col("_f_y") - F.col("pred")).alias("resid"), *carry)


def arma_filter(df: DataFrame, params: DataFrame, y: str, keys=("series",), ts: str = WEEK,
                max_p: int = 3, max_q: int = 3, carry=()) -> DataFrame:
    """Rolling one-step forecasts: parameters fixed, state advanced with each actual value.

    Every row stays: a series without a fit has null forecasts.
    """
    w = Window.partitionBy(*keys).orderBy(ts)
    rows = (df.select(*keys, ts, y, *carry, F.row_number().over(w).alias("_rn"),
                      *[F.lag(y, i).over(w).alias(f"_y{i}") for i in range(1, max_p + 1)])
            .join(params.select(*keys, "p", "const", "ar", "ma"), list(keys), "left"))
    ar = sum((F.col("ar")[i - 1] * F.coalesce(F.col(f"_y{i}"), F.lit(0.0)) for i in range(1, max_p + 1)), F.col("const"))
    rows = rows.withColumn("_base", F.when(F.col("_rn") > F.col("p"), ar))
    return fold_forecasts(rows, keys, ts, y, "_base", "ma", max_q, carry)


def path(const: Column, ar: Column, ma: Column, values: Column, shocks: Column, steps: Column,
         max_p: int = 3, max_q: int = 3) -> Column:
    """Array of ``steps`` iterated forecasts; ``values`` and ``shocks`` hold the latest first."""
    start = F.struct(values.alias("y"), shocks.alias("e"), F.array().cast("array<double>").alias("out"))

    def step(s, _):
        pred = (const + sum((ar[i] * s["y"][i] for i in range(max_p)), F.lit(0.0))
                + sum((ma[j] * s["e"][j] for j in range(max_q)), F.lit(0.0)))
        return F.struct(F.slice(F.concat(F.array(pred), s["y"]), 1, max_p).alias("y"),
                        F.slice(F.concat(F.array(F.lit(0.0)), s["e"]), 1, max_q).alias("e"),
                        F.concat(s["out"], F.array(pred)).alias("out"))

    return F.aggregate(F.sequence(F.lit(1), steps), start, step, lambda s: s["out"])


def arma_static_path(df: DataFrame, params: DataFrame, y: str, keys=("series",), ts: str = WEEK,
                     max_p: int = 3, max_q: int = 3) -> DataFrame:
    """Forecasts of all test rows from the end of the training rows."""
    filtered = arma_filter(df, params, y, keys, ts, max_p, max_q, carry=("split",))
    rows = filtered.join(params.select(*keys, F.col("const").alias("_base"), "ar", "ma"), list(keys), "left").withColumn("_e", F.col("resid"))
    return iterated_forecasts(rows, keys, ts, "actual", max_p, max_q, with_step=True)


def iterated_forecasts(rows: DataFrame, keys, ts: str, y: str, n_ar: int, n_ma: int, with_step: bool = False) -> DataFrame:
    """Test rows forecast from the end of the training rows; ``rows`` carry ``_base``, ``ar``, ``ma``, ``_e`` and ``split``."""
    n_ar, n_ma = max(n_ar, 1), max(n_ma, 1)
    given = rows.select(*keys, ts, (F.col("split") == "train").alias("_f_train"), F.col(y).cast("double").alias("_f_y"), F.col("_e").alias("_f_e"),
                        F.col("_base").alias("_f_base"), F.col("ar").alias("_f_ar"), F.col("ma").alias("_f_ma"))
    reads = ["_f_train", "_f_y", "_f_e", "_f_base", "_f_ar", "_f_ma"]
    out = folds.carried(given, keys, [ts], reads, "pred double, step int", folds.iterated_start(n_ar, n_ma), folds.iterated(n_ar, n_ma))
    steps = ["step"] if with_step else []
    return out.filter(~F.col("_f_train")).select(*keys, ts, F.col("_f_y").alias("actual"), *steps, "pred")


def arma_horizon_recursive(df: DataFrame, params: DataFrame, y: str, horizons=(1, 4), keys=("series",), ts: str = WEEK,
                           inclusive: bool = True, min_train: int = 80, max_p: int = 3, max_q: int = 3) -> DataFrame:
    """Cumulative h-step change forecast at every origin, parameters fixed.

    ``inclusive`` conditions on the value of the origin row itself; otherwise
    the origin is the first forecast step. Null where the fit had too few rows.
    """
    w = Window.partitionBy(*keys).orderBy(ts)
    filtered = arma_filter(df, params, y, keys, ts, max_p, max_q, carry=("split",))
    shift = 0 if inclusive else 1

    def recent(column, size):
        return F.array(*[F.coalesce(F.lag(column, shift + i).over(w) if shift + i else F.col(column), F.lit(0.0))
                         for i in range(size)])

    state = (filtered.select(*keys, ts, "split", "actual", recent("actual", max_p).alias("_ys"),
                             recent("resid", max_q).alias("_es"))
             .join(params.select(*keys, "const", "ar", "ma", "n_obs"), list(keys), "left"))
    longest = max(horizons)
    steps = state.withColumn("_path", F.when(F.col("n_obs") >= min_train, path(
        F.col("const"), F.col("ar"), F.col("ma"), F.col("_ys"), F.col("_es"), F.lit(longest), max_p, max_q)))
    lead = shift  # steps already inside the origin row
    rows = []
    for h in horizons:
        ahead = [F.lead("actual", i - lead + 1).over(w) if i - lead + 1 else F.col("actual") for i in range(h)]
        rows.append(F.struct(F.lit(h).alias("horizon"), sum(ahead[1:], ahead[0]).alias("actual"),
                             F.aggregate(F.slice("_path", 1, h), F.lit(0.0), lambda a, x: a + x).alias("pred")))
    return (steps.select(*keys, ts, "split", *[r.alias(f"_r{i}") for i, r in enumerate(rows)])
            .select(*keys, ts, "split", F.explode(F.array(*[F.col(f"_r{i}") for i in range(len(rows))])).alias("r"))
            .select(*keys, ts, "split", "r.*").filter(F.col("actual").isNotNull()))


# -- models with regressors -------------------------------------------------

MOST = 3
"""Lags of the shared design when orders come as a table."""


def _lags_of(order) -> tuple[int, int]:
    return (MOST, MOST) if isinstance(order, DataFrame) else order


def _exog_fit(moments, keys, by, order, n_exog):
    if isinstance(order, DataFrame):
        return fit_given_orders(moments, keys, by, order, (1, 2), MOST, MOST, n_exog)
    return fit_orders(moments, keys, [order], n_exog)


def _exog_design(df, y, exog, order, keys, ts):
    p, q = _lags_of(order)
    train = F.col("split") == "train"
    shocks = with_shocks(df, y, train, keys, ts, exog=tuple(exog))
    return lagged_design(shocks, y, p, q, keys, ts), design_columns(p, q, exog)


def arx_fit(df: DataFrame, y: str, exog, order=(1, 2), keys=("series",), ts: str = WEEK) -> DataFrame:
    """Mean equation with regressors by minimum norm, one row per key. ``order`` is (p, q), or a table (*keys, p, q)."""
    rows, columns = _exog_design(df, y, list(exog), order, keys, ts)
    complete = rows.filter("_train").select(*keys, *columns, F.col(y).alias("_y")).na.drop()
    return _exog_fit(moment_matrix(complete, keys, [*columns, "_y"]), keys, keys, order, len(exog))


def arx_static_forecast(df: DataFrame, y: str, exog, order=(1, 2), keys=("series",), ts: str = WEEK) -> DataFrame:
    """Forecasts of the test rows from the training end, regressors of the test rows known. ``order`` as in ``arx_fit``."""
    p, q = _lags_of(order)
    exog = list(exog)
    rows, columns = _exog_design(df, y, exog, order, keys, ts)
    complete = rows.filter("_train").select(*keys, *columns, F.col(y).alias("_y")).na.drop()
    params = _exog_fit(moment_matrix(complete, keys, [*columns, "_y"]), keys, keys, order, len(exog))
    joined = rows.join(params.select(*keys, "const", "ar", "ma", "beta"), list(keys), "left")
    return iterated_forecasts(joined.withColumn("_base", F.col("const") + dot(F.col("beta"), 0, exog)), keys, ts, y, p, q)


def with_last_fit(rows: DataFrame, fits: DataFrame, columns, keys, bucket: str, ts: str) -> DataFrame:
    """The fit of each row's bucket, or the last one before it where the bucket has none of its own."""
    joined = rows.join(fits.select(*keys, bucket, F.struct(*columns).alias("_fit")), [*keys, bucket], "left")
    w = Window.partitionBy(*keys).orderBy(bucket, ts)
    return joined.withColumn("_fit", F.last("_fit", ignorenulls=True).over(w)).select("*", "_fit.*").drop("_fit")


def test_offset(keys, ts: str = WEEK) -> Column:
    """1 for the first test row of a key, whatever the split's ratio."""
    return F.sum((F.col("split") == "test").cast("int")).over(Window.partitionBy(*keys).orderBy(ts))


def refit_bucket(every: int) -> Column:
    """0 for training rows; a test row becomes usable with the next refit after it."""
    return F.when(F.col("_train"), F.lit(0)).otherwise(F.floor((F.col("_offset") - 1) / every) + 1).cast("int")


def arx_rolling_refit(df: DataFrame, y: str, exog, order=(1, 2), every: int = 12, keys=("series",),
                      ts: str = WEEK) -> DataFrame:
    """Expanding one-step forecasts of the test rows, coefficients renewed every ``every`` rows.

    ``order`` is as in ``arx_fit``. ``df`` carries ``split``, ``rn`` and ``n`` of the chronological split. The
    shocks regressed on stay those of the training fit.
    """
    p, q = _lags_of(order)
    exog = list(exog)
    rows, columns = _exog_design(df, y, exog, order, keys, ts)
    rows = rows.withColumn("_offset", test_offset(keys, ts)).withColumn("_bucket", refit_bucket(every)).drop("_offset")
    complete = rows.select(*keys, "_bucket", *columns, F.col(y).alias("_y")).na.drop()
    moments = moment_matrix(complete, keys, [*columns, "_y"], running="_bucket")
    params = _exog_fit(moments, [*keys, "_bucket"], keys, order, len(exog))
    # A test row at offset i uses the fit of bucket floor(i / every): all rows before that refit.
    use = F.when(F.col("_train"), F.lit(0)).otherwise(F.col("_bucket") - 1)
    joined = with_last_fit(rows.withColumn("_bucket", use), params, ["const", "ar", "ma", "beta"], keys, "_bucket", ts)
    base = (F.col("const") + sum((F.col("ar")[i - 1] * F.col(f"_y{i}") for i in range(1, p + 1)), F.lit(0.0))
            + dot(F.col("beta"), 0, exog))
    return fold_forecasts(joined.withColumn("_base", base), keys, ts, y, "_base", "ma", q, carry=("split",))
