"""Orders as a table: each series is fitted at its own, from one shared design."""

import random

import pytest
from pyspark.sql import functions as F

from panelloom.operators import arma as A


@pytest.fixture(scope="module")
def panel(spark):
    rng, rows = random.Random(4), []
    for s in "abcd":
        y = 0.0
        for i in range(120 if s != "d" else 6):
            y = 0.4 * y + rng.gauss(0, 1)
            rows.append((s, i, y, rng.gauss(0, 1), "train" if i < 90 else "test"))
    return spark.createDataFrame(rows, "series string, t int, y double, x double, split string").cache()


def test_given_orders_are_candidates_of_that_order(spark, panel):
    train = F.col("split") == "train"
    orders = spark.createDataFrame([("a", 2, 1), ("b", 0, 3), ("b", 0, 3), ("d", 1, 1), ("z", 1, 1)], "series string, p int, q int")
    got = {r.series: r for r in A.arma_given(panel, "y", train, orders, ts="t").collect()}
    every = {(r.series, r.p, r.q): r for r in A.arma_candidates(panel, "y", train, ts="t").collect()}
    assert set(got) == set("abcd") and got["d"].p is None
    for s, p, q in (("a", 2, 1), ("b", 0, 3), ("c", 1, 2)):
        r, want = got[s], every[s, p, q]
        assert (r.p, r.q, r.n_obs, r.stable) == (p, q, want.n_obs, want.stable)
        assert r.const == pytest.approx(want.const) and r.ar == pytest.approx(want.ar) and r.ma == pytest.approx(want.ma)


def test_regressor_models_take_orders_from_a_table(spark, panel):
    """With every series at (3, 3) the table gives what the pair gives; another order changes its own series alone."""
    same = spark.createDataFrame([(s, 3, 3) for s in "abcd"], "series string, p int, q int")
    mixed = spark.createDataFrame([("a", 1, 0), *[(s, 3, 3) for s in "bcd"]], "series string, p int, q int")
    for run in (A.arx_static_forecast, A.arx_rolling_refit):
        pair, table, other = ({(r.series, r.t): r.pred for r in run(panel, "y", ["x"], o, ts="t").collect()} for o in ((3, 3), same, mixed))
        assert {k: v is None for k, v in pair.items()} == {k: v is None for k, v in table.items()}
        assert all(v is None or v == pytest.approx(table[k]) for k, v in pair.items())
        assert all(v is None or v == pytest.approx(other[k]) for k, v in pair.items() if k[0] != "a")
        assert any(abs(v - other[k]) > 1e-6 for k, v in pair.items() if k[0] == "a" and v is not None)
