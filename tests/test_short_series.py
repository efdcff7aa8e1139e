"""No series disappears: short and constant ones keep their rows, with null forecasts where nothing fits."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from panelloom.operators import arma as A
from panelloom.operators import evaluation as E
from panelloom.operators.moments import moment_matrix
from panelloom.operators.windows import chronological_split


@pytest.fixture(scope="module")
def model(spark):
    rng, rows = random.Random(1), []
    for name, n in (("long", 200), ("twelve", 12), ("nine", 9), ("one", 1), ("flat", 60)):
        value = 0.0
        for k in range(n):
            value = 0.5 * value + rng.gauss(0, 1)
            rows.append((name, dt.date(2020, 1, 3) + dt.timedelta(weeks=k), 5.0 if name == "flat" else value, rng.random()))
    return chronological_split(spark.createDataFrame(rows, "series string, week_end_date date, diff double, x double")).cache()


def sizes(df):
    return {r["series"]: r["count"] for r in df.groupBy("series").count().collect()}


def test_filter_and_paths_keep_every_row(model):
    params = A.arma_select(A.arma_candidates(model, "diff", F.col("split") == "train"))
    assert {r.series: r.fit_status for r in params.collect()}.keys() == sizes(model).keys()
    assert {r.series for r in params.where("fit_status = 'ok'").collect()} >= {"long"}
    assert sizes(A.arma_filter(model, params, "diff", carry=("split",))) == sizes(model)
    assert sizes(A.arma_static_path(model, params, "diff")) == sizes(model.where("split = 'test'"))
    ahead = A.arma_horizon_recursive(model, params, "diff", horizons=(1,))
    assert set(sizes(ahead)) >= {"long", "twelve", "nine", "flat"}
    assert ahead.where("series = 'twelve' and pred is not null").count() == 0


def test_regressor_models_keep_every_row(model):
    assert sizes(A.arx_static_forecast(model, "diff", ["x"])) == sizes(model.where("split = 'test'"))
    assert sizes(A.arx_rolling_refit(model, "diff", ["x"])) == sizes(model)


def test_running_moments_are_sums_up_to_each_step(spark):
    rng = random.Random(2)
    rows = [(s, k // 3, float(rng.randrange(9)), float(rng.randrange(9))) for s in "abc" for k in range(20)]
    df = spark.createDataFrame(rows, "s string, step int, x double, y double")
    want = lambda s, step: [sum(u * v for t, k, *z in rows if t == s and k <= step for u, v in [(z[i], z[j])]) for i, j in ((0, 0), (0, 1), (1, 1))]
    got = moment_matrix(df, ["s"], ["x", "y"], running="step").collect()
    assert len(got) == 21 and all(list(r.m) == want(r.s, r.step) and r.n_rows == sum(t == r.s and k <= r.step for t, k, *_ in rows) for r in got)
    assert {r.s: list(r.m) for r in moment_matrix(df, ["s"], ["x", "y"]).collect()} == {s: want(s, 6) for s in "abc"}


def test_pairwise_tests_cover_every_horizon(spark):
    rng = random.Random(3)
    rows = [("s", h, dt.date(2020, 1, 3) + dt.timedelta(weeks=k), m, rng.gauss(0, 1), rng.gauss(0, 1)) for h in (1, 4, 6) for k in range(30) for m in ("base", "other")]
    fc = spark.createDataFrame(rows, "series string, horizon int, week_end_date date, model string, actual double, pred double")
    assert sorted(r.horizon for r in E.pairwise_dm(fc, ["base"]).collect()) == [1, 4, 6]
