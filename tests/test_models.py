"""Fits and recursions against plain numpy, on simulated series."""

import datetime as dt
import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelloom.functions import math as M
from panelloom.operators import arma as A
from panelloom.operators import diagnostics as D
from panelloom.operators import evaluation as E
from panelloom.operators import regimes as G
from panelloom.operators import vector as Y
from panelloom.operators import volatility as V
from panelloom.operators.models import ar1_fit
from panelloom.operators.moments import min_norm_solve, regress
from panelloom.operators.windows import chronological_split

START = dt.date(2000, 1, 7)


def frame(spark, series: dict, column="diff"):
    rows = [(s, START + dt.timedelta(7 * i), float(v)) for s, x in series.items() for i, v in enumerate(x)]
    return chronological_split(spark.createDataFrame(rows, f"series string, week_end_date date, {column} double"))


def ar_series(n, phi, seed, sd=1.0):
    rng = np.random.default_rng(seed)
    x = np.zeros(n)
    for t in range(1, n):
        x[t] = phi * x[t - 1] + rng.normal(0, sd)
    return x


def train():
    return F.col("split") == "train"


def test_distribution_functions(spark):
    zs = [-3.0, -1.2, 0.0, 0.4, 2.5]
    df = spark.createDataFrame([(z, NormalDist().cdf(z)) for z in zs], "z double, p double")
    for r in df.select("p", "z", M.normal_cdf(F.col("z")).alias("c"), M.normal_ppf(F.col("p")).alias("q")).collect():
        assert r.c == pytest.approx(r.p, abs=2e-7)
        assert r.q == pytest.approx(r.z, abs=1e-6)
    row = spark.range(1).select(M.chi2_sf(F.lit(15.507313), 8).alias("c"),
                                M.f_sf(F.lit(2.0), 2, F.lit(10.0)).alias("f"), D.adf_pvalue(F.lit(-2.86)).alias("a")).first()
    assert row.c == pytest.approx(0.05, abs=1e-6)
    assert row.f == pytest.approx((1 + 2 * 2.0 / 10) ** -5, abs=1e-12)
    assert row.a == pytest.approx(0.05, abs=2e-3)


def test_collinear_solve_gives_unique_forecasts():
    rng = np.random.default_rng(0)
    a, b = rng.normal(5, 1, 200), rng.normal(-2, 3, 200)
    x = np.column_stack([np.ones(200), a, b, a - b])
    y = 1 + 2 * a - b + rng.normal(0, 0.1, 200)
    full = np.column_stack([x, y])
    beta, left = regress(full.T @ full, np.arange(4), np.array([4]))
    free = np.linalg.lstsq(x[:, :3], y, rcond=None)[0]
    assert x @ beta[:, 0] == pytest.approx(x[:, :3] @ free, abs=1e-6)
    assert left[0, 0] == pytest.approx(np.sum((y - x[:, :3] @ free) ** 2), rel=1e-6)
    assert min_norm_solve(np.zeros((2, 2)), np.zeros((2, 1))).tolist() == [[0.0], [0.0]]


def test_ar1_and_selection_recover_phi(spark):
    df = frame(spark, {"a": ar_series(1500, 0.6, 1), "b": ar_series(1500, -0.4, 2)})
    fit = {r.series: r.phi for r in ar1_fit(df, "diff").collect()}
    assert fit["a"] == pytest.approx(0.6, abs=0.06) and fit["b"] == pytest.approx(-0.4, abs=0.06)
    cand = A.arma_candidates(df, "diff", train())
    one = cand.filter("series = 'a' AND p = 1 AND q = 0").first()
    assert one.ar[0] == pytest.approx(0.6, abs=0.07)
    chosen = A.arma_select(cand).collect()
    best = {r.series: min(c.aic for c in cand.collect() if c.series == r.series and c.stable) for r in chosen}
    assert all(r.aic == best[r.series] for r in chosen)


def test_filter_equals_a_plain_loop_and_path_starts_where_it_ends(spark):
    x = ar_series(120, 0.5, 3)
    df = frame(spark, {"s": x})
    params = spark.createDataFrame([("s", 2, 0.1, [0.4, 0.2, 0.0], [0.3, -0.1, 0.0])],
                                   "series string, p int, const double, ar array<double>, ma array<double>")
    got = [r.pred for r in A.arma_filter(df, params, "diff").orderBy("week_end_date").collect()]
    e, want = [0.0, 0.0], []
    shocks = np.zeros(120)
    for t in range(120):
        if t < 2:
            want.append(None)
            continue
        pred = 0.1 + 0.4 * x[t - 1] + 0.2 * x[t - 2] + 0.3 * shocks[t - 1] - 0.1 * shocks[t - 2]
        shocks[t] = x[t] - pred
        want.append(pred)
    assert got[:2] == [None, None] and got[2:] == pytest.approx(want[2:])
    path = A.arma_static_path(df, params, "diff").orderBy("week_end_date").collect()
    n = int(0.8 * 120)
    assert len(path) == 120 - n and path[0].pred == pytest.approx(want[n])
    second = 0.1 + 0.4 * want[n] + 0.2 * x[n - 1] - 0.1 * shocks[n - 1]
    assert path[1].pred == pytest.approx(second)


def gjr_series(n, seed, omega=0.05, alpha=0.05, gamma=0.1, beta=0.85):
    rng = np.random.default_rng(seed)
    h, out = omega / (1 - alpha - gamma / 2 - beta), []
    for _ in range(n):
        e = math.sqrt(h) * rng.normal()
        out.append(e)
        h = omega + (alpha + (gamma if e < 0 else 0)) * e * e + beta * h
    return np.array(out)


def test_volatility_grid_beats_constant_variance_and_recursion_is_exact(spark):
    e = gjr_series(1500, 5)
    df = frame(spark, {"s": e}, "resid")
    fit = V.volatility_fit(df, "resid", "gjr").first()
    flat = -0.5 * len(e) * (math.log(2 * math.pi * e.var()) + 1)
    assert fit.loglik > flat + 5
    assert 0.85 < fit.alpha + fit.gamma / 2 + fit.beta < 1.0
    params = V.volatility_fit(df, "resid", "gjr")
    got = [r.h for r in V.variance_recursion(df, params, "resid").orderBy("week_end_date").collect()]
    h, want = fit.h0, []
    for x in e:
        want.append(h)
        h = fit.omega + (fit.alpha + (fit.gamma if x < 0 else 0)) * x * x + fit.beta * h
    assert got == pytest.approx(want, rel=1e-9)


def test_var_recovers_its_matrix_and_rolling_uses_only_the_past(spark):
    rng = np.random.default_rng(7)
    m = np.array([[0.5, 0.1], [-0.2, 0.3]])
    x = np.zeros((500, 2))
    for t in range(1, 500):
        x[t] = m @ x[t - 1] + rng.normal(0, 1, 2)
    rows = [("s", START + dt.timedelta(7 * i), float(a), float(b)) for i, (a, b) in enumerate(x)]
    df = chronological_split(spark.createDataFrame(rows, "system string, week_end_date date, u double, v double"), keys=("system",))
    fit = Y.var_fit(df, ("u", "v"), Y.var_lag_select(df, ("u", "v"), 2, force=1), 2).first()
    assert np.array([c[1:3] for c in fit.coef]) == pytest.approx(m, abs=0.12)
    got = Y.var_rolling(df, ("u", "v"), 2, force=1).filter("series = 'u'").orderBy("week_end_date").collect()
    for i in (0, 37, 99):
        t = 400 + i
        design = np.column_stack([np.ones(t - 1), x[:t - 1]])
        beta = np.linalg.lstsq(design, x[1:t, 0], rcond=None)[0]
        assert got[i].pred == pytest.approx(beta @ np.r_[1, x[t - 1]], abs=1e-6)


def test_switching_finds_the_shift():
    rng = np.random.default_rng(11)
    state = np.repeat([0, 1, 0, 1], 80)
    x = np.where(state == 1, rng.normal(4, 1, 320), rng.normal(0, 0.5, 320))
    short = x[:150]
    padded = np.zeros((2, 320))
    known = np.zeros((2, 320), dtype=bool)
    padded[0], known[0] = x, True
    padded[1, :150], known[1, :150] = short, True
    mu, sigma, move, ll, smooth, rounds, _ = G.switching_em(padded, known)
    assert mu[0] == pytest.approx([0, 4], abs=0.4) and np.mean((smooth[0, :, 1] > 0.5) == state) > 0.97
    alone = G.switching_em(short[None, :], np.ones((1, 150), dtype=bool))
    assert mu[1] == pytest.approx(alone[0][0], abs=1e-8)


def test_stationarity_of_noise_and_walk(spark):
    noise = np.random.default_rng(3).normal(size=400)
    df = frame(spark, {"noise": noise, "walk": np.cumsum(noise)})
    got = {r.series: r for r in D.stationarity_verdict(df, "diff", "x").collect()}
    assert got["noise"].adf_pvalue < 0.01 and got["walk"].adf_pvalue > 0.05
    assert got["noise"].stationarity_reading == "Stationary by both ADF and KPSS"


def test_arch_lm_equals_least_squares(spark):
    e = gjr_series(600, 9, alpha=0.3, beta=0.3)
    row = D.arch_lm(frame(spark, {"s": e}), "diff").first()
    q = e ** 2
    design = np.column_stack([np.ones(592), *[q[8 - k:600 - k] for k in range(1, 9)]])
    y = q[8:]
    resid = y - design @ np.linalg.lstsq(design, y, rcond=None)[0]
    r2 = 1 - resid @ resid / np.sum((y - y.mean()) ** 2)
    assert row.lm_stat == pytest.approx(592 * r2, rel=1e-8)


def test_direction_of_zero_and_null(spark):
    rows = [(1.0, -1.0), (0.0, 0.0), (0.0, 2.0), (None, 1.0), (3.0, 2.0)]
    df = spark.createDataFrame([("m", a, p) for a, p in rows], "model string, actual double, pred double")
    assert E.directional_accuracy(df, ("model",)).first().directional_accuracy == pytest.approx(0.5)


def test_loss_test_guards_and_ties(spark):
    rows = [("short", START + dt.timedelta(7 * i), float(i), 0.0, 0.1) for i in range(9)]
    rows += [("same", START + dt.timedelta(7 * i), float(i % 5), 1.0, 1.0) for i in range(30)]
    df = spark.createDataFrame(rows, "series string, week_end_date date, actual double, a double, b double")
    got = {r.series: r for r in E.diebold_mariano(df, "a", "b").collect()}
    assert got["short"].dm_stat is None and got["short"].mean_loss_diff is None
    assert got["same"].dm_stat is None and got["same"].mean_loss_diff == 0.0
    tied = spark.createDataFrame([("s", 1, "B", 1.0), ("s", 1, "A", 1.0), ("s", 1, "C", 2.0)],
                                 "series string, horizon int, model string, rmse double")
    assert E.winner_table(tied).first().model == "A"


def test_metrics_do_not_depend_on_partitioning(spark):
    rng = np.random.default_rng(1)
    rows = [("m", "s", f"x{i % 3}", float(a), float(p)) for i, (a, p) in enumerate(rng.normal(size=(300, 2)))]
    df = spark.createDataFrame(rows, "method string, series string, model string, actual double, pred double")
    one = {r.model: r.rmse for r in E.forecast_metrics(df.coalesce(1)).collect()}
    many = {r.model: r.rmse for r in E.forecast_metrics(df.repartition(13)).collect()}
    assert one == pytest.approx(many)


def test_stability_up_to_order_three_takes_no_python_worker(spark):
    rng = np.random.default_rng(3)
    rows = [(rng.normal(0, 0.7, 3).tolist(), rng.normal(0, 0.7, 3).tolist()) for _ in range(300)]
    rows += [([0.5, 0.0, 0.0], [0.0, 0.0, 0.0]), ([1.01, 0.0, 0.0], [0.0] * 3), ([float("nan"), 0.0, 0.0], [0.0] * 3), ([0.0] * 3, [float("-inf"), 0.0, 0.0])]
    df = spark.createDataFrame(rows, "ar array<double>, ma array<double>")
    got = df.select(A._stable("ar", "ma").alias("a"), A.stable_roots(F.col("ar"), F.col("ma"), 3).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in got) and {r["a"] for r in got} == {True, False}
    model = spark.range(200).select(F.lit("s").alias("series"), F.expr("date_add(date'2020-01-03', int(7 * id))").alias("week_end_date"), F.rand(1).alias("diff"))
    plan = A.arma_candidates(model, "diff", F.lit(True))._jdf.queryExecution().executedPlan().toString()
    # The solves of the shocks and of the orders, each after the sums of its moments.
    assert plan.count("ArrowEvalPython [") == 2


def test_python_workers_get_bounded_batches(spark):
    from panelloom.operators import folds
    from panelloom.session import BATCH_ROWS

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    rows = spark.range(5000).select(F.lit("s").alias("series"), "id")
    out = folds.carried(rows, ["series"], ["id"], ["id"], "n long", lambda: 0, lambda state, c: (state, [[len(c["id"])] * len(c["id"])]))
    assert out.agg(F.max("n"), F.count("*")).first() == (BATCH_ROWS, 5000)
