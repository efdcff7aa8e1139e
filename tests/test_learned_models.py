"""Factor, regime fits, elastic net, trees and importance against numpy on small frames; residuals of all seven families."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelloom.operators import diagnostics as D
from panelloom.operators import learners as L
from panelloom.operators import regimes as G
from panelloom.operators import vector as Y
from panelloom.operators import volatility as V
from panelloom.operators.windows import chronological_split
from panelloom.plans import calibration as C
from tests.test_models import START, ar_series, frame, gjr_series


def system_frame(spark, x, name="s"):
    rows = [(name, START + dt.timedelta(7 * i), *map(float, r)) for i, r in enumerate(x)]
    return chronological_split(spark.createDataFrame(rows, "system string, week_end_date date, u double, v double, w double"), keys=("system",))


def shifting(n=400, seed=5):
    """Three series that share a level which jumps between two states."""
    rng = np.random.default_rng(seed)
    state = (np.arange(n) // 50) % 2
    level = np.where(state == 1, 3.0, 0.0)
    x = np.zeros((n, 3))
    for t in range(1, n):
        x[t] = 0.3 * x[t - 1] + level[t] + rng.normal(0, 0.5, 3)
    return x, state


def test_first_factor_equals_numpy(spark):
    x, _ = shifting()
    n = int(0.8 * len(x))
    got = G.first_factor(system_frame(spark, x), ("u", "v", "w")).orderBy("week_end_date").collect()
    z = (x - x[:n].mean(0)) / x[:n].std(0)
    values, vectors = np.linalg.eigh(np.cov(z[:n].T, bias=True))
    want = z @ vectors[:, -1]
    want = want if np.corrcoef(want, x.mean(1))[0, 1] > 0 else -want
    assert [r.factor for r in got] == pytest.approx(want, abs=1e-8)
    assert got[0].explained == pytest.approx(values[-1] / values.sum(), abs=1e-10)


def lag_rows(x, k):
    """Rows, lags of consecutive rows of ``x``."""
    return x[k:], np.column_stack([np.ones(len(x) - k), *[x[k - j:len(x) - j] for j in range(1, k + 1)]])


def test_regime_fits_and_forecasts_equal_numpy(spark):
    x, _ = shifting()
    names, lags = ("u", "v", "w"), 2
    df = system_frame(spark, x)
    factored, labelled, fits = G.fit_regimes(df, names, lags)
    rows = labelled.orderBy("week_end_date").collect()
    label = np.array([r.regime for r in rows])
    train = x[:len(rows)]
    assert 0.3 < label.mean() < 0.7
    order = Y.var_lag_select(df.filter("split = 'train'"), names, lags).first().lag_order
    coef = {}
    for r in fits.collect():
        y, design = lag_rows(train[label == r.regime], order)
        want = np.linalg.lstsq(design, y, rcond=None)[0].T
        got = np.array(r.coef)
        assert r.own_fit and r.n_obs == (label == r.regime).sum()
        assert got[:, :want.shape[1]] == pytest.approx(want, abs=1e-6)
        coef[r.regime] = want
    state = lambda t, past: np.r_[1.0, *[past[t - j] for j in range(1, order + 1)]]

    path, start = list(train), len(train)
    static = {(r.series, r.week_end_date): r.pred for r in G.regime_static(df, names, lags).collect()}
    for t in range(start, len(x)):
        path.append(coef[label[-1]] @ state(t, path))
        day = START + dt.timedelta(7 * t)
        assert [static[s, day] for s in names] == pytest.approx(path[-1], abs=1e-5)

    f = np.array([r.factor for r in factored.orderBy("week_end_date").collect()])
    means = [f[:start][label == k].mean() for k in (0, 1)]
    rolling = {(r.series, r.week_end_date): r for r in G.regime_rolling(df, names, lags).collect()}
    for t in range(start, len(x)):
        k = int(abs(f[t - 1] - means[1]) < abs(f[t - 1] - means[0]))
        own = [rolling[s, START + dt.timedelta(7 * t)] for s in names]
        assert {r.regime for r in own} == {k}
        assert [r.pred for r in own] == pytest.approx(coef[k] @ state(t, x), abs=1e-6)


def learner_frame(spark, n=240, seed=3):
    """``lin`` depends on a alone and linearly; ``step`` on the sign of b."""
    rng = np.random.default_rng(seed)
    rows = []
    for name in ("lin", "step"):
        for i, (a, b, c, e) in enumerate(rng.normal(size=(n, 4))):
            y = 3 * a + 0.1 * e if name == "lin" else 2.0 * (b > 0) + 0.1 * e
            rows.append((name, 1, START + dt.timedelta(7 * i), "train" if i < 180 else "test", float(a), float(b), float(c), float(y)))
    return spark.createDataFrame(rows, "series string, horizon int, week_end_date date, split string, a double, b double, c double, target double")


def test_elastic_net_meets_its_optimality_conditions(spark):
    df = learner_frame(spark).filter("split = 'train'")
    for fit in L.elastic_net_cv(df, ["a", "b", "c"]).collect():
        rows = df.filter(F.col("series") == fit.series).toPandas()
        x, y = rows[["a", "b", "c"]].to_numpy(), rows["target"].to_numpy()
        z, w = (x - x.mean(0)) / x.std(0), np.array(fit.coef) * x.std(0)
        slope = z.T @ (y - fit.const - x @ np.array(fit.coef)) / len(y) - fit.alpha * (1 - fit.l1_ratio) * w
        bound = fit.alpha * fit.l1_ratio
        for s, v in zip(slope, w):
            assert s == pytest.approx(np.sign(v) * bound, abs=1e-4) if v else abs(s) <= bound + 1e-4
        assert fit.alpha in L.ALPHAS and fit.l1_ratio in L.L1_RATIOS


def test_learners_and_the_importance_of_each_winner(spark):
    df = learner_frame(spark)
    features = ["a", "b", "c"]
    assembled = L.pooled_rows(df, features).select("series", "horizon", "week_end_date", "split", "target", "features").cache()
    test = assembled.filter("split = 'test'")
    forest = L.fit_pooled(assembled, L.random_forest(trees=20))
    linear = L.LinearModel(L.elastic_net_cv(df.filter("split = 'train'"), features))
    models = {"Random Forest": forest, "Elastic Net": linear, "Gradient Boosting": L.fit_pooled(assembled, L.gradient_boosting(rounds=100, rate=0.1))}
    spread = df.filter("split = 'test'").groupBy("series").agg(F.var_pop("target").alias("v"))
    for name, model in models.items():
        left = {r.series: r.mse / r.v for r in model.transform(test).groupBy("series").agg(F.avg(F.pow(F.col("target") - F.col("pred"), F.lit(2.0))).alias("mse"))
                .join(spread, "series").collect()}
        assert left["step"] < (0.5 if name == "Elastic Net" else 0.25) and left["lin"] < (0.02 if name == "Elastic Net" else 0.5), (name, left)
    # The same forecasts as on the columns themselves.
    direct = {(r.series, r.week_end_date): r.pred for r in L.linear_forecast(df.filter("split = 'test'"), L.elastic_net_cv(df.filter("split = 'train'"), features), features).collect()}
    assert {(r.series, r.week_end_date): r.pred for r in linear.transform(test).collect()} == pytest.approx(direct)
    asked = test.withColumn("model", F.when(F.col("series") == "lin", "Elastic Net").otherwise("Random Forest"))
    rises = {(r.series, r.feature): r for r in L.permutation_importance(models, asked, features).collect()}
    assert len(rises) == 6
    # Shuffling a doubles its part of the variance: 2 * 3^2 for a linear model.
    assert rises["lin", "a"].importance == pytest.approx(18, rel=0.4) and abs(rises["lin", "c"].importance) < 0.1
    assert rises["step", "b"].importance > 10 * max(abs(rises["step", c].importance) for c in ("a", "c"))
    assert all(r.model == ("Elastic Net" if s == "lin" else "Random Forest") for (s, _), r in rises.items())


def test_seven_families(spark):
    df = frame(spark, {"a": ar_series(400, 0.5, 1) + 0.2, "g": gjr_series(400, 2), "flat": np.zeros(400)}).drop("split")
    resid, criteria = C.calibration_residuals(df)
    resid = resid.cache()
    names = {"Random Walk", "AR(1)", "ARMA", *C.VOLATILITY_NAMES.values(), C.SWITCHING_NAME}
    assert {r.model for r in resid.filter("series = 'a'").select("model").distinct().collect()} == names
    both = {(r.series, r.model): r for r in criteria.collect()}
    assert all(np.isfinite(both[s, m].aic) for s in "ag" for m in names - {"Random Walk"})
    own = {m: [r.resid for r in resid.filter((F.col("series") == "a") & (F.col("model") == m)).orderBy("week_end_date").collect()] for m in names}
    assert own["Random Walk"] == pytest.approx([r.diff for r in df.filter("series = 'a'").orderBy("week_end_date").collect()])
    # z is the shock over a deviation that a plain loop finds from the same fit.
    shocks = resid.filter("series = 'a' AND model = 'ARMA'").drop("model")
    fit, e = V.volatility_fit(shocks, "resid", "garch").first(), own["ARMA"]
    h, want = fit.h0, []
    for v in e:
        want.append(v / np.sqrt(h))
        h = fit.omega + fit.alpha * v * v + fit.beta * h
    assert own["ARMA-GARCH"] == pytest.approx(want, rel=1e-9)
    out = {(r.series, r.model): r for r in D.residual_diagnostics(resid, criteria).collect()}
    # A series that doesn't move keeps a row for each model that has residuals, with nulls for tests that are not defined.
    flat = out["flat", "Random Walk"]
    assert flat.resid_std == 0.0 and flat.arch_lm_pvalue is None and flat.lb_resid_pvalue_lag12 is None
    for m in names:
        x = np.array(own[m])
        c = x - x.mean()
        jb = len(x) / 6 * ((np.mean(c ** 3) / np.mean(c ** 2) ** 1.5) ** 2 + (np.mean(c ** 4) / np.mean(c ** 2) ** 2 - 3) ** 2 / 4)
        row = out["a", m]
        assert (row.resid_mean, row.resid_std) == pytest.approx((x.mean(), x.std(ddof=1)), abs=1e-10)
        assert row.jb_pvalue == pytest.approx(np.exp(-jb / 2), abs=1e-8)
        assert row.aic == (None if m == "Random Walk" else pytest.approx(both["a", m].aic))
