"""Passes and steps of the switching model against the batch fit, and brute-force sums over all regime paths."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelloom.operators import regimes as G
from panelloom.operators import switching as H
from tests.test_models import frame

P = dict(mu0=-0.5, mu1=1.5, sd0=0.7, sd1=1.2, stay0=0.85, stay1=0.7, start1=0.4)


def given(spark, *names):
    return spark.createDataFrame([(n, *P.values()) for n in names], "series string, " + ", ".join(f"{c} double" for c in P))


def enumerate_paths(x):
    """Chances of regime 1 and likelihood from all 2^n paths."""
    n, total, held = len(x), 0.0, np.zeros(len(x))
    for path in itertools.product((0, 1), repeat=n):
        w = P["start1"] if path[0] else 1 - P["start1"]
        for t, k in enumerate(path):
            if t:
                stay = P[f"stay{path[t - 1]}"]
                w *= stay if k == path[t - 1] else 1 - stay
            if x[t] is not None:
                sd = P[f"sd{k}"]
                w *= math.exp(-0.5 * ((x[t] - P[f"mu{k}"]) / sd) ** 2) / (sd * math.sqrt(2 * math.pi))
        total += w
        held += w * np.array(path)
    return held / total, math.log(total)


def test_passes_equal_sums_over_all_paths(spark):
    series = {"a": [0.1, 1.9, None, 2.5, -1.0, 0.3, 0.2, 3.0, None], "b": [5.0]}
    rows = [(s, i, v) for s, x in series.items() for i, v in enumerate(x)] + [("none", 0, 1.0)]
    df = spark.createDataFrame(rows, "series string, week_end_date int, v double").repartition(5)
    got = H.regime_probabilities(df, given(spark, "a", "b"), "v").collect()
    assert len(got) == len(rows)
    for name, x in series.items():
        own = sorted((r for r in got if r.series == name), key=lambda r: r.week_end_date)
        p, loglik = enumerate_paths(x)
        assert [r.p_smoothed for r in own] == pytest.approx(p, abs=1e-10)
        assert sum(r.loglik for r in own) == pytest.approx(loglik, abs=1e-10)
        assert own[-1].p_filtered == own[-1].p_smoothed
    assert [r.p_smoothed for r in got if r.series == "none"] == [None]


def test_a_step_equals_the_batch_fit_and_the_likelihood_grows(spark):
    rng = np.random.default_rng(2)
    state = np.repeat([0, 1, 0, 1, 0], 60)
    x = np.where(state == 1, rng.normal(4, 1, 300), rng.normal(0, 0.5, 300))
    df = frame(spark, {"s": x, "flat": np.ones(30)})
    params, logs = H.start_params(df, "diff"), []
    for _ in range(4):
        params = spark.createDataFrame(H.likelihood_step(df, params, "diff").collect())
        logs.append(params.first().loglik)
    assert logs == sorted(logs)
    fit = H.fit_switching(df, "diff", rounds=30, tolerance=1e-4).collect()
    mu, sigma, move, loglik, *_ = G.switching_em(x[None, :], np.ones((1, 300), dtype=bool))
    assert [r.series for r in fit] == ["s"]
    assert (fit[0].mu0, fit[0].mu1) == pytest.approx(tuple(mu[0]), abs=1e-3)
    assert (fit[0].sd0, fit[0].sd1) == pytest.approx(tuple(sigma[0]), abs=1e-3)
    assert fit[0].loglik == pytest.approx(loglik[0], abs=1e-2) and fit[0].n_obs == 300
    assert fit[0].aic == pytest.approx(12 - 2 * fit[0].loglik)


def test_no_rows(spark):
    df = spark.createDataFrame([], "series string, week_end_date date, v double")
    assert H.regime_probabilities(df, given(spark, "a"), "v").count() == 0
    assert H.fit_switching(df, "v", rounds=2).count() == 0
