"""Selected quantiles against numpy: hot keys, ties, wild magnitudes, empty and null input."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelloom.operators import selection as S

PS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]


def table(spark, series: dict):
    return spark.createDataFrame([(k, None if v is None else float(v)) for k, x in series.items() for v in x], "series string, v double")


def test_equal_to_numpy_whatever_is_left_to_order(spark):
    rng = np.random.default_rng(4)
    series = {
        "wild": np.sign(rng.normal(size=3000)) * 10.0 ** rng.uniform(-300, 300, 3000),
        "near": 1.0 + rng.normal(size=3000) * 1e-13, "ties": rng.integers(-2, 3, 3000), "zeros": np.zeros(50),
        "one": [7.5], "two": [-1.0, 2.0], None: rng.normal(size=40), "edge": [-1.7e308] * 20 + [1.7e308] * 20 + [5e-324] * 9 + [-0.0, 0.0],
    }
    df = table(spark, series).repartition(7)
    for few in (1, 50, 10_000):
        got = {(r.series, r.p): r for r in S.select_quantiles(df, ["v"], PS, few=few).collect()}
        assert len(got) == len(series) * len(PS)
        for k, x in series.items():
            x = np.sort(np.asarray(x, float))
            for p in PS:
                at = p * (len(x) - 1)
                lo, hi, share = x[int(np.floor(at))], x[int(np.ceil(at))], at - np.floor(at)
                assert got[k, p].value == pytest.approx(lo if lo == hi else (1 - share) * lo + share * hi, rel=1e-12), (k, p, few)
                assert got[k, p].n_obs == len(x)


def test_nulls_nan_empty_tables_and_clashing_names(spark):
    df = table(spark, {"a": [None, float("nan"), 1.0, 3.0], "b": [None]}).select(F.col("series").alias("_v"), F.col("v").alias("_rank"))
    assert [tuple(r) for r in S.select_quantiles(df, ["_rank"], [0.5], keys=["_v"]).collect()] == [("a", "_rank", 0.5, 2, 2.0)]
    assert S.select_quantiles(df.limit(0), ["_rank"], [0.5], keys=["_v"]).count() == 0
    with pytest.raises(ValueError):
        S.select_quantiles(df, ["_rank"], [1.5], keys=["_v"])


def test_a_hot_key_is_spread(spark):
    n = 2_000_000
    # One value has a third of the rows.
    df = spark.range(n).select(F.lit("hot").alias("series"), F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.sin("id") * 1000).alias("v"))
    x = np.where(np.arange(n) % 3 == 0, 5.0, np.sin(np.arange(n)) * 1000)
    got = {r.p: r.value for r in S.select_quantiles(df, ["v"], [0.25, 0.4, 0.5, 0.9], few=100).collect()}
    for p, v in got.items():
        assert v == pytest.approx(np.quantile(x, p), abs=1e-9)


def test_imputation_keeps_every_row(spark):
    df = spark.createDataFrame([("a", "train", 1.0), ("a", "train", 4.0), ("a", "test", None), ("a", "test", 99.0), ("b", "train", None),
                                (None, "train", 2.0), (None, "test", None)], "series string, split string, v double")
    got = sorted(map(str, S.impute_selected(df, ["v"], F.col("split") == "train").select("series", "v").collect()))
    want = [("a", 1.0), ("a", 4.0), ("a", 2.5), ("a", 99.0), ("b", None), (None, 2.0), (None, 2.0)]
    assert got == sorted(map(str, spark.createDataFrame(want, "series string, v double").collect()))
