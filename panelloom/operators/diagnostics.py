"""Distribution, serial-dependence and stationarity tests, one row per series.

Every test reads one ordered pass over the panel and returns plain aggregates;
p-values are closed forms or documented approximations.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.math import chi2_sf, f_sf, normal_cdf, normal_ppf
from .moments import DOUBLES, min_norm_solve, moment_matrix, positions, solve, unpack
from .statistics import adjusted_kurtosis, adjusted_skewness

WEEK = "week_end_date"


def jarque_bera(df: DataFrame, column: str, keys=("series",)) -> DataFrame:
    n = F.count(column).cast("double")
    stat = n / 6 * (F.pow(F.skewness(column), F.lit(2.0)) + F.pow(F.kurtosis(column), F.lit(2.0)) / 4)
    return (df.groupBy(*keys).agg(stat.alias("jb_stat"))
            .withColumn("jb_pvalue", F.exp(-F.col("jb_stat") / 2)))


def acf_arrays(df: DataFrame, column: str, nlags: int, keys=("series",), ts: str = WEEK) -> DataFrame:
    """``n_obs`` and the array of autocorrelations at lags 1..nlags (biased denominator).

    Lags of the demeaned series come from one sorted window; their products are
    summed in one aggregate. A lag the series is too short for is null.
    """
    whole = Window.partitionBy(*keys)
    w = whole.orderBy(ts)
    centred = (df.filter(F.col(column).isNotNull())
               .select(*keys, ts, (F.col(column) - F.avg(column).over(whole)).alias("_x")))
    lagged = centred.select(*keys, "_x", *[F.lag("_x", k).over(w).alias(f"_l{k}") for k in range(1, nlags + 1)])
    sums = lagged.groupBy(*keys).agg(
        F.count("_x").alias("n_obs"), F.sum(F.col("_x") * F.col("_x")).alias("_ss"),
        F.array(*[F.sum(F.col("_x") * F.col(f"_l{k}")) for k in range(1, nlags + 1)]).alias("_c"))
    ss = F.when(F.col("_ss") > 0, F.col("_ss"))
    return (sums.withColumn("_s", ss)
            .select(*keys, "n_obs", F.transform("_c", lambda c: c / F.col("_s")).alias("r")))


def acf(df: DataFrame, column: str, nlags: int = 20, keys=("series",), ts: str = WEEK) -> DataFrame:
    rows = acf_arrays(df, column, nlags, keys, ts)
    return (rows.select(*keys, F.posexplode("r").alias("pos", "acf"))
            .select(*keys, (F.col("pos") + 1).cast("long").alias("lag"), "acf"))


@F.pandas_udf(DOUBLES)
def _partial(r: pd.Series) -> pd.Series:
    """Durbin-Levinson recursion on autocorrelations (lags 1..k) to partial ones."""
    def one(values):
        values = [v for v in values if v is not None and v == v]
        out, phi, variance = [], np.zeros(0), 1.0
        for k, value in enumerate(values):
            last = np.array(values[:k][::-1])
            if variance <= 1e-14:
                break
            reflection = (value - phi @ last) / variance
            phi = np.append(phi - reflection * phi[::-1], reflection)
            variance *= 1.0 - reflection ** 2
            out.append(float(reflection))
        return out
    return r.map(one)


def pacf(df: DataFrame, column: str, nlags: int = 20, keys=("series",), ts: str = WEEK) -> DataFrame:
    """Partial autocorrelations by Yule-Walker without bias adjustment."""
    rows = acf_arrays(df, column, nlags, keys, ts)
    return (rows.select(*keys, F.posexplode(_partial("r")).alias("pos", "pacf"))
            .select(*keys, (F.col("pos") + 1).cast("long").alias("lag"), "pacf"))


def _box_stat(r: str, n: str, h: int) -> Column:
    size = F.col(n).cast("double")
    terms = [F.pow(F.element_at(r, k), F.lit(2.0)) / (size - k) for k in range(1, h + 1)]
    return size * (size + 2) * reduce(lambda a, b: a + b, terms)


def ljung_box(df: DataFrame, column: str, lags=(4, 8, 12), keys=("series",), ts: str = WEEK) -> DataFrame:
    """Portmanteau statistic and p-value at several (even) lag counts, on the series and its squares."""
    squared = df.withColumn("_sq", F.col(column) * F.col(column))
    out = []
    for name, source in (("change", column), ("squared", "_sq")):
        rows = acf_arrays(squared, source, max(lags), keys, ts)
        tests = F.array(*[F.struct(F.lit(h).cast("long").alias("lag"), _box_stat("r", "n_obs", h).alias("lb_stat"),
                                   chi2_sf(_box_stat("r", "n_obs", h), h).alias("lb_pvalue")) for h in lags])
        out.append(rows.select(*keys, F.lit(name).alias("variable"), F.explode(tests).alias("t"))
                   .select(*keys, "variable", "t.*"))
    return out[0].unionByName(out[1])


def arch_lm(df: DataFrame, column: str, nlags: int = 8, keys=("series",), ts: str = WEEK) -> DataFrame:
    """Regression of the squares on their own lags: LM, F and both p-values.

    A series whose squares don't vary has no row; where the lags explain everything, or the rows after them are all equal,
    the statistics that would divide by zero are null.
    """
    w = Window.partitionBy(*keys).orderBy(ts)
    whole = Window.partitionBy(*keys)
    raw = F.col(column) * F.col(column)
    # The statistics are free of scale and location of the squares; centring
    # and scaling keeps the products well conditioned.
    squares = (df.filter(F.col(column).isNotNull()).withColumn("_raw", raw)
               .withColumn("_q", (F.col("_raw") - F.avg("_raw").over(whole))
                           / F.nullif(F.stddev_pop("_raw").over(whole), F.lit(0.0))))
    names = [f"_q{k}" for k in range(1, nlags + 1)]
    rows = (squares.select(*keys, F.lit(1.0).alias("_one"),
                           *[F.lag("_q", k).over(w).alias(f"_q{k}") for k in range(1, nlags + 1)],
                           F.col("_q")).na.drop())
    m = moment_matrix(rows, keys, ["_one", *names, "_q"])
    y = nlags + 1
    solved = m.select(*keys, "n_rows", "m", solve("m", positions(*range(nlags + 1)), positions(y)).alias("s"))
    n = F.col("n_rows").cast("double")
    # Packed positions of sum(1 * y) and sum(y * y).
    sum_y, sum_yy = F.element_at("m", y + 1), F.element_at("m", -1)
    r2 = 1.0 - F.element_at("s.sscp", 1) / F.nullif(sum_yy - sum_y * sum_y / n, F.lit(0.0))
    rest = n - nlags - 1
    return (solved.filter(rest > 0).withColumn("_r2", r2)
            .withColumn("lm_stat", n * F.col("_r2"))
            .withColumn("f_stat", (F.col("_r2") / nlags) / F.nullif((1.0 - F.col("_r2")) / rest, F.lit(0.0)))
            .select(*keys, F.col("n_rows").alias("n_obs"), "lm_stat",
                    chi2_sf(F.col("lm_stat"), nlags).alias("lm_pvalue"), "f_stat",
                    f_sf(F.col("f_stat"), nlags, rest).alias("f_pvalue")))


def adf_pvalue(t: Column) -> Column:
    """MacKinnon (1994) response surface, constant, one variable."""
    # Published surface coefficients and their limits.
    low = F.lit(2.1659) + 1.4412 * t + 0.038269 * t * t
    high = F.lit(1.7339) + 0.93202 * t - 0.12745 * t * t - 0.010368 * t * t * t
    return (F.when(t > 2.74, 1.0).when(t < -18.83, 0.0)
            .when(t <= -1.61, normal_cdf(low)).otherwise(normal_cdf(high)))


PICKED = T.StructType([T.StructField("aic", T.DoubleType()), T.StructField("lags_used", T.IntegerType())])


@F.pandas_udf(PICKED)
def _adf_pick(m: pd.Series, maxlag: pd.Series, n: pd.Series) -> pd.DataFrame:
    """Lag of lowest AIC among nested sub-matrices ``[1, level, lag_1..lag_k]``."""
    picked = []
    for packed, most, rows in zip(m, maxlag, n):
        full = unpack(np.asarray(packed, dtype=float))
        best = (math.inf, 0)
        for k in range(int(most) + 1):
            x = list(range(2 + k))
            cross = full[np.ix_(x, [len(full) - 1])]
            ssr = full[-1, -1] - float((cross.T @ min_norm_solve(full[np.ix_(x, x)], cross))[0, 0])
            aic = rows * math.log(max(ssr, 1e-300) / rows) + 2 * len(x)
            best = min(best, (aic, k))
        picked.append((best[0], best[1]))
    return pd.DataFrame(picked, columns=["aic", "lags_used"])


@F.pandas_udf(T.DoubleType())
def _adf_stat(m: pd.Series, lags: pd.Series, n: pd.Series) -> pd.Series:
    """t-statistic of the level coefficient with the chosen number of lags."""
    out = []
    for packed, k, rows in zip(m, lags, n):
        full = unpack(np.asarray(packed, dtype=float))
        x = list(range(2 + int(k)))
        gram, cross = full[np.ix_(x, x)], full[np.ix_(x, [len(full) - 1])]
        beta = min_norm_solve(gram, cross)
        ssr = full[-1, -1] - float((cross.T @ beta)[0, 0])
        inverse = min_norm_solve(gram, np.eye(len(x)))
        spread = math.sqrt(max(ssr, 0.0) / (rows - len(x)) * inverse[1, 1]) if rows > len(x) else 0.0
        out.append(float(beta[1, 0]) / spread if spread > 0 else None)
    return pd.Series(out, dtype="float64")


def longest_series(df: DataFrame, column: str, keys=("series",)) -> int:
    """Rows of the longest series (one scalar; a job)."""
    sizes = df.groupBy(*keys).agg(F.count(column).alias("n")).agg(F.max("n"))
    return int(sizes.first()[0] or 0)


def adf_maxlag(n: int) -> int:
    return max(0, min(math.ceil(12 * (n / 100.0) ** 0.25), n // 2 - 2))


def adf(df: DataFrame, column: str, keys=("series",), ts: str = WEEK, longest: int | None = None) -> DataFrame:
    """Unit-root test with a constant, lag chosen by AIC.

    Orders are compared on the rows complete for the longest lag of the series;
    the chosen one is then fitted on all of its own rows. ``longest`` bounds the
    rows of a series; unset, one scalar is read to size the lag columns.
    """
    most = adf_maxlag(longest or longest_series(df, column, keys))
    whole = Window.partitionBy(*keys)
    w = whole.orderBy(ts)
    n = F.col("_n")
    known = (df.filter(F.col(column).isNotNull())
             .select(*keys, ts, F.col(column).alias("_v"), F.count(column).over(whole).alias("_n"),
                     F.avg(column).over(whole).alias("_mean"), F.stddev_pop(column).over(whole).alias("_sd")))
    maxlag = F.greatest(F.lit(0), F.least(F.ceil(12 * F.pow(n / 100.0, F.lit(0.25))),
                                          F.floor(n / 2.0) - 2)).cast("int")
    # The t-statistic is free of scale, and of location given the constant.
    scaled = (known.filter(F.col("_sd") > 0).withColumn("_y", (F.col("_v") - F.col("_mean")) / F.col("_sd"))
              .withColumn("_maxlag", maxlag).withColumn("_t", F.row_number().over(w))
              .withColumn("_prev", F.lag("_y").over(w)).withColumn("_d", F.col("_y") - F.col("_prev")))
    lags = [f"_d{k}" for k in range(1, most + 1)]
    rows = scaled.select("*", F.lit(1.0).alias("_one"),
                         *[F.lag("_d", k).over(w).alias(f"_d{k}") for k in range(1, most + 1)])
    columns = ["_one", "_prev", *lags, "_d"]

    def used(lag_limit):
        """Rows complete for ``lag_limit`` lags, longer lags zeroed out."""
        kept = rows.filter(F.col("_t") >= lag_limit + 2)
        return kept.select(*keys, "_maxlag", *[c for c in kept.columns if c == "_lag"], "_one", "_prev", "_d", *[
            F.when(F.lit(k) <= lag_limit, F.coalesce(F.col(f"_d{k}"), F.lit(0.0))).otherwise(0.0).alias(f"_d{k}")
            for k in range(1, most + 1)])

    common = moment_matrix(used(F.col("_maxlag")), [*keys, "_maxlag"], columns)
    picked = common.select(*keys, _adf_pick("m", "_maxlag", "n_rows")["lags_used"].alias("_lag"))
    rows = rows.join(picked, list(keys))
    final = moment_matrix(used(F.col("_lag")), [*keys, "_lag"], columns)
    return (final.withColumn("adf_stat", _adf_stat("m", "_lag", "n_rows"))
            .select(*keys, "adf_stat", adf_pvalue(F.col("adf_stat")).alias("adf_pvalue"),
                    F.col("_lag").cast("long").alias("lags_used"), F.col("n_rows").alias("n_used")))


def _lag_products(x: Column, n: Column, k: Column) -> Column:
    """``sum_t x[t] * x[t-k]`` of an ordered array."""
    pairs = F.zip_with(F.slice(x, k + 1, n - k), F.slice(x, F.lit(1), n - k), lambda a, b: a * b)
    return F.aggregate(pairs, F.lit(0.0), lambda s, v: s + v)


# Level-stationarity critical values and their p-values.
KPSS_POINTS = ((0.347, 0.10), (0.463, 0.05), (0.574, 0.025), (0.739, 0.01))


def kpss_pvalue(stat: Column) -> Column:
    """Linear between the published critical values, clipped at both ends."""
    first, last = KPSS_POINTS[0], KPSS_POINTS[-1]
    out = F.when(stat <= first[0], first[1]).when(stat >= last[0], last[1])
    for (x0, p0), (x1, p1) in zip(KPSS_POINTS, KPSS_POINTS[1:]):
        out = out.when(stat < x1, p0 + (stat - x0) * (p1 - p0) / (x1 - x0))
    return out


def kpss(df: DataFrame, column: str, keys=("series",), ts: str = WEEK) -> DataFrame:
    """Level-stationarity test with automatic bandwidth.

    The number of autocovariances depends on the data, so the demeaned weekly
    values of a series (at most one per week) are folded as an ordered array.
    """
    whole = Window.partitionBy(*keys)
    w = whole.orderBy(ts)
    centred = (df.filter(F.col(column).isNotNull())
               .select(*keys, ts, (F.col(column) - F.avg(column).over(whole)).alias("_e")))
    summed = centred.withColumn("_s", F.sum("_e").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    per = summed.groupBy(*keys).agg(
        F.count("_e").cast("int").alias("n_obs"), F.sum(F.col("_s") * F.col("_s")).alias("_ss"),
        F.sum(F.col("_e") * F.col("_e")).alias("_ee"),
        F.transform(F.array_sort(F.collect_list(F.struct(ts, "_e"))), lambda p: p["_e"]).alias("_x"))
    n, x = F.col("n_obs"), F.col("_x")
    short = F.pow(n.cast("double"), F.lit(2.0 / 9.0)).cast("int")
    staged = per.withColumn("_c", F.transform(F.sequence(F.lit(1), F.greatest(short, F.lit(1))),
                                              lambda k: _lag_products(x, n, k) / n))

    def folded(weight):
        return F.aggregate(F.sequence(F.lit(1), F.size("_c")), F.lit(0.0),
                           lambda s, k: s + weight(k) * F.element_at("_c", k))

    s0 = F.col("_ee") / n + 2 * folded(lambda k: F.lit(1.0))
    s1 = 2 * folded(lambda k: k.cast("double"))
    ratio = s1 / s0
    bandwidth = F.least(n - 1, F.floor(1.1447 * F.pow(ratio * ratio, F.lit(1.0 / 3.0))
                                       * F.pow(n.cast("double"), F.lit(1.0 / 3.0))).cast("int"))
    sized = staged.withColumn("_lags", bandwidth)
    weighted = F.when(F.col("_lags") >= 1, F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.col("_lags"), F.lit(1))), F.lit(0.0),
        lambda s, k: s + (1.0 - k / (F.col("_lags") + 1.0)) * _lag_products(x, n, k))).otherwise(0.0)
    long_run = (F.col("_ee") + 2 * weighted) / n
    eta = F.col("_ss") / (n.cast("double") * n)
    return (sized.withColumn("kpss_stat", eta / F.when(long_run > 0, long_run))
            .select(*keys, F.col("n_obs").cast("long").alias("n_obs"), "kpss_stat",
                    kpss_pvalue(F.col("kpss_stat")).alias("kpss_pvalue"),
                    F.col("_lags").cast("long").alias("bandwidth")))


def stationarity_label(n_obs: Column, adf_p: Column, kpss_p: Column) -> Column:
    """Four-way reading of both tests; null p-values count as no evidence."""
    a = F.coalesce(adf_p < 0.05, F.lit(False))
    k = F.coalesce(kpss_p > 0.05, F.lit(False))
    # Report labels.
    return (F.when(n_obs < 20, "Too few observations")
            .when(a & k, "Stationary by both ADF and KPSS")
            .when(a, "Mixed: ADF rejects unit root, KPSS rejects stationarity")
            .when(k, "Mixed: ADF does not reject unit root, KPSS does not reject stationarity")
            .otherwise("Likely non-stationary / weak evidence of stationarity"))


def stationarity_verdict(df: DataFrame, column: str, variable: str, keys=("series",), ts: str = WEEK,
                         longest: int | None = None) -> DataFrame:
    both = kpss(df, column, keys, ts).join(adf(df, column, keys, ts, longest), list(keys), "left")
    enough = F.col("n_obs") >= 20
    tests = ("adf_stat", "adf_pvalue", "kpss_stat", "kpss_pvalue")
    return both.select(
        *keys, F.lit(variable).alias("variable"), "n_obs",
        *[F.when(enough, F.col(c)).alias(c) for c in tests],
        stationarity_label(F.col("n_obs"), F.col("adf_pvalue"), F.col("kpss_pvalue")).alias("stationarity_reading"))


def _lag12(df: DataFrame, column: str, keys, ts: str, name: str) -> DataFrame:
    rows = acf_arrays(df, column, 12, keys, ts)
    return rows.select(*keys, chi2_sf(_box_stat("r", "n_obs", 12), 12).alias(name))


def _dependence_tests(df: DataFrame, column: str, keys, ts: str, label: str) -> DataFrame:
    """Normality, serial correlation of values and squares, and volatility clustering."""
    squared = df.withColumn("_sq", F.col(column) * F.col(column))
    return (jarque_bera(df, column, keys).select(*keys, "jb_pvalue")
            .join(_lag12(df, column, keys, ts, f"lb_{label}_pvalue_lag12"), list(keys))
            .join(_lag12(squared, "_sq", keys, ts, f"lb_sq_{label}_pvalue_lag12"), list(keys))
            .join(arch_lm(df, column, 8, keys, ts).select(*keys, F.col("lm_pvalue").alias("arch_lm_pvalue")),
                  list(keys), "left"))


def residual_diagnostics(resid: DataFrame, criteria: DataFrame, column: str = "resid",
                         keys=("series", "model"), ts: str = WEEK) -> DataFrame:
    """One row per fitted model: criteria, residual moments and dependence tests."""
    moments = resid.groupBy(*keys).agg(F.avg(column).alias("resid_mean"), F.stddev_samp(column).alias("resid_std"))
    return (moments.join(_dependence_tests(resid, column, keys, ts, "resid"), list(keys))
            .join(criteria, list(keys), "left"))


def eda_summary(df: DataFrame, column: str, keys=("series",), ts: str = WEEK) -> DataFrame:
    """One row per series: moments and all dependence tests."""
    moments = df.groupBy(*keys).agg(
        F.count(column).alias("n_obs"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"),
        adjusted_skewness(column).alias("skewness"), adjusted_kurtosis(column).alias("kurtosis"))
    return moments.join(_dependence_tests(df, column, keys, ts, "change"), list(keys))


def histogram_density(df: DataFrame, column: str, bins: int = 35, keys=("series",)) -> DataFrame:
    """Equal-width bins over each key's own range, heights integrating to one; empty bins included."""
    whole = Window.partitionBy(*keys)
    placed = df.filter(F.col(column).isNotNull()).select(
        *keys, F.col(column).alias("_v"), F.min(column).over(whole).alias("_lo"), F.max(column).over(whole).alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / float(bins)
    # The top edge belongs to the last bin.
    bin_of = F.least(F.floor((F.col("_v") - F.col("_lo")) / width), F.lit(bins - 1)).cast("int")
    counts = placed.groupBy(*keys, "_lo", "_hi", bin_of.alias("_bin")).agg(F.count(F.lit(1)).alias("_c"))
    per_key = counts.groupBy(*keys, "_lo", "_hi").agg(
        F.sum("_c").alias("_n"), F.map_from_entries(F.collect_list(F.struct("_bin", "_c"))).alias("_counts"))
    filled = per_key.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    held = F.coalesce(F.element_at("_counts", F.col("bin")), F.lit(0))
    return filled.select(*keys, F.col("bin").cast("long").alias("bin"),
                         (F.col("_lo") + F.col("bin") * width).alias("left_edge"),
                         (held / (F.col("_n") * width)).alias("density"))


def kde_grid(df: DataFrame, column: str, points: int = 300, keys=("series",)) -> DataFrame:
    """Gaussian kernel density at evenly spaced points of each key's range.

    Bandwidth ``std * n^(-1/5)``. Each value meets the fixed number of grid
    points of its own key, and the sums combine before the shuffle.
    """
    whole = Window.partitionBy(*keys)
    known = df.filter(F.col(column).isNotNull()).select(
        *keys, F.col(column).alias("_v"), F.min(column).over(whole).alias("_lo"),
        F.max(column).over(whole).alias("_hi"), F.count(column).over(whole).alias("_n"),
        F.stddev_samp(column).over(whole).alias("_sd"))
    h = F.col("_sd") * F.pow(F.col("_n").cast("double"), F.lit(-0.2))
    on_grid = (known.withColumn("_h", h)
               .withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
               .withColumn("_x", F.col("_lo") + F.col("point") * (F.col("_hi") - F.col("_lo")) / float(points - 1)))
    z = (F.col("_x") - F.col("_v")) / F.col("_h")
    scale = F.max("_n") * F.max("_h") * math.sqrt(2 * math.pi)
    return (on_grid.groupBy(*keys, F.col("point").cast("long").alias("point"))
            .agg(F.max("_x").alias("x"), (F.sum(F.exp(-0.5 * z * z)) / scale).alias("density")))


def qq_points(df: DataFrame, column: str, keys=("series",)) -> DataFrame:
    """Sample quantiles against normal ones, with the standardised reference line."""
    whole = Window.partitionBy(*keys)
    w = whole.orderBy(column)
    rn = F.row_number().over(w)
    known = df.filter(F.col(column).isNotNull()).select(
        *keys, F.col(column).alias("sample_q"), rn.cast("long").alias("rank"),
        (rn / (F.count(column).over(whole) + 1.0)).alias("_p"),
        F.avg(column).over(whole).alias("_mean"), F.stddev_pop(column).over(whole).alias("_sd"))
    return (known.withColumn("theoretical_q", normal_ppf(F.col("_p")))
            .withColumn("line", F.col("_mean") + F.col("_sd") * F.col("theoretical_q"))
            .drop("_p", "_mean", "_sd"))
