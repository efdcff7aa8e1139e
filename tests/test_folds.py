"""Moments that are summed where rows are, and recursions along rows: against plain loops, and at length."""

import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelloom.operators import arma as A
from panelloom.operators import volatility as V
from panelloom.operators.moments import moment_matrix, triangle, unpack


def frame(rng, rows, keys="ab"):
    return [(rng.choice(keys) if keys else None, rng.randrange(300), 1.0, rng.gauss(0, 1), rng.gauss(5, 2)) for _ in range(rows)]


def packed(rows):
    x = np.array([r[2:] for r in rows])
    return [float(x[:, i] @ x[:, j]) for i, j in triangle(3)]


def test_moments_by_key_wherever_the_rows_are(spark):
    rows = frame(random.Random(1), 4000, ["a", "b", None])
    df = spark.createDataFrame(rows, "k string, step int, one double, x double, y double").repartition(9)
    got = {r.k: (r.n_rows, r.m) for r in moment_matrix(df, ["k"], ["one", "x", "y"]).collect()}
    for k in ("a", "b", None):
        own = [r for r in rows if r[0] == k]
        assert got[k][0] == len(own) and got[k][1] == pytest.approx(packed(own), rel=1e-12)
    (whole,) = moment_matrix(df, [], ["one", "x", "y"]).collect()
    assert whole.n_rows == 4000 and whole.m == pytest.approx(packed(rows), rel=1e-12)
    assert unpack(whole.m)[0, 0] == 4000 and moment_matrix(df.where("false"), ["k"], ["one", "x"]).collect() == []


@pytest.mark.parametrize("keys", [["k"], ["k", "g"]])
def test_running_moments_cross_blocks_of_steps(spark, keys):
    rng = random.Random(2)
    rows = [(k, s * 7 - 50, o, x, y) for k, s, o, x, y in frame(rng, 1500, ["a", "b", None])]
    df = spark.createDataFrame(rows, "k string, step int, one double, x double, y double").withColumn("g", F.lit(1)).repartition(5)
    got = {(r.k, r.step): (r.n_rows, r.m) for r in moment_matrix(df, keys, ["one", "x", "y"], running="step").collect()}
    assert set(got) == {(r[0], r[1]) for r in rows}
    for (k, step), (n, m) in got.items():
        own = [r for r in rows if r[0] == k and r[1] <= step]
        assert n == len(own) and m == pytest.approx(packed(own), rel=1e-9)


def test_one_key_of_ten_million_rows_is_summed_in_all_tasks(spark):
    n = 10_000_000
    df = spark.range(0, n, 1, 8).select(F.lit("hot").alias("k"), F.lit(1.0).alias("one"), (F.col("id") % 1000).cast("double").alias("x"))
    start = time.time()
    (r,) = moment_matrix(df, ["k"], ["one", "x"]).collect()
    assert r.n_rows == n and r.m == pytest.approx([n, n * 499.5, n * 332833.5]) and time.time() - start < 90
    # What is shuffled: one row per task, not one per row.
    from panelloom.operators.moments import partial_moments

    assert partial_moments(df, ["k"], ["one", "x"]).count() == 8


def chain(y, base, ma):
    e, out = [0.0] * len(ma), []
    for v in y:
        pred = base + sum(m * s for m, s in zip(ma, e))
        out.append(pred)
        e = [v - pred, *e[:-1]]
    return out


def test_a_million_steps_take_linear_time(spark):
    n = 1_000_000
    rows = spark.range(0, n, 1, 4).select(F.lit("a").alias("series"), F.col("id").alias("t"), (F.col("id") % 7).cast("double").alias("y"), F.lit(0.5).alias("base"), F.array(F.lit(0.3), F.lit(-0.2)).alias("ma"))
    start = time.time()
    got = A.fold_forecasts(rows, ["series"], "t", "y", "base", "ma", 2)
    tail = got.where(F.col("t") >= n - 3).orderBy("t").collect()
    assert time.time() - start < 90
    want = chain([float(i % 7) for i in range(n)], 0.5, [0.3, -0.2])
    assert [r.pred for r in tail] == pytest.approx(want[-3:], rel=1e-12)


def test_variances_over_many_batches(spark):
    rng = np.random.default_rng(3)
    e = [None if i % 97 == 5 else float(x) for i, x in enumerate(rng.normal(size=30_000))]
    df = spark.createDataFrame([(s, i, x) for s in ("a", "b") for i, x in enumerate(e)], "series string, t int, resid double").repartition(6)
    params = spark.createDataFrame([("a", 0.1, 0.05, 0.1, 0.8, 1.0)], "series string, omega double, alpha double, gamma double, beta double, h0 double")
    got = V.variance_recursion(df, params, ts="t").orderBy("series", "t").collect()
    h, last, want = 1.0, None, []
    for x in e:
        now = 1.0 if last is None else 0.1 + (0.05 + (0.1 if last < 0 else 0.0)) * last**2 + 0.8 * h
        want.append(now)
        if x is not None:
            last, h = x, now
    assert [r.h for r in got if r.series == "a"] == pytest.approx(want, rel=1e-12)
    assert len(got) == 60_000 and all(r.h is None and r.z is None for r in got if r.series == "b")
    assert all(math.isclose(r.sigma, math.sqrt(r.h)) for r in got if r.series == "a")


@pytest.mark.parametrize("model", ["garch", "egarch"])
def test_a_step_without_variance_leaves_the_state(spark, model):
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate([1.0, -3.0, 0.5, 2.0])], "series string, t int, resid double")
    params = spark.createDataFrame([("a", -5.0, 0.1, 0.0, 0.5, 1.0)], "series string, omega double, alpha double, gamma double, beta double, h0 double")
    got = [r.h for r in V.variance_recursion(df, params, ts="t", model=model).orderBy("t").collect()]
    if model == "garch":
        assert got == [1.0, None, None, None]
        assert [r.h for r in V.variance_recursion(df, params, ts="t", floor=0.01).orderBy("t").collect()] == [1.0, 0.01, 0.01, 0.01]
    else:
        assert got[0] == 1.0 and all(h > 0 for h in got)


def test_iterated_forecasts_end_where_training_ends(spark):
    values = [1.0, 2.0, -1.0, 0.5, 3.0, 1.0, 1.0]
    df = spark.createDataFrame([("a", i, v, "train" if i < 4 else "test") for i, v in enumerate(values)] + [("b", 0, 1.0, "train"), ("b", 1, 1.0, "test")], "series string, t int, y double, split string")
    params = spark.createDataFrame([("a", 1, 0.1, [0.5, 0.0, 0.0], [0.2, 0.0, 0.0])], "series string, p int, const double, ar array<double>, ma array<double>")
    got = A.arma_static_path(df, params, "y", ts="t").orderBy("series", "t").collect()
    e, pred = 0.0, None
    for i, v in enumerate(values[:4]):
        pred = 0.1 + 0.5 * values[i - 1] + 0.2 * e if i else None
        e = v - pred if pred is not None else 0.0
    first = 0.1 + 0.5 * values[3] + 0.2 * e
    want = [first, 0.1 + 0.5 * first, 0.1 + 0.5 * (0.1 + 0.5 * first)]
    assert [r.pred for r in got if r.series == "a"] == pytest.approx(want) and [r.step for r in got if r.series == "a"] == [1, 2, 3]
    assert [(r.pred, r.actual) for r in got if r.series == "b"] == [(None, 1.0)]
