"""Calendar edge cases on small hand-made series."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelloom.operators import calendar as R
from panelloom.operators import cleaning as K
from panelloom.operators import windows as W
from panelloom.sources import columns as C


def d(text):
    return dt.date.fromisoformat(text)


@pytest.fixture(scope="module")
def gappy(spark):
    rows = [("a", "2024-01-01", None), ("a", "2024-01-03", 10.0), ("a", "2024-01-04", 12.0), ("a", "2024-01-10", 24.0),
            ("a", "2024-01-30", 64.0), ("a", "2024-02-01", None), ("b", "2024-01-20", 5.0), ("b", "2024-01-22", 7.0),
            ("c", "2024-01-05", None), ("c", "2024-01-07", None)]
    return spark.createDataFrame([(s, d(t), v) for s, t, v in rows], "series string, ts date, value double")


def values(df, series):
    return {r.ts: r.value for r in df.filter(F.col("series") == series).collect()}


def test_interpolation_hits_known_points_and_is_flat_at_edges(gappy):
    a = values(R.interpolate_time(gappy), "a")
    assert len(a) == 32
    assert a[d("2024-01-01")] == a[d("2024-01-02")] == a[d("2024-01-03")] == 10.0
    assert a[d("2024-01-07")] == pytest.approx(18.0)
    assert a[d("2024-01-20")] == pytest.approx(44.0)
    assert a[d("2024-02-01")] == a[d("2024-01-30")] == 64.0


def test_all_null_series_keeps_its_grid(gappy):
    assert values(R.interpolate_time(gappy), "c") == {d(f"2024-01-0{k}"): None for k in (5, 6, 7)}


def test_shared_extent_starts_all_series_together(gappy):
    b = values(R.interpolate_time(gappy, "shared"), "b")
    assert min(b) == d("2024-01-01") and max(b) == d("2024-02-01")
    assert b[d("2024-01-01")] == 5.0 and b[d("2024-02-01")] == 7.0


def test_week_labels(spark):
    days = spark.createDataFrame([(d(x),) for x in ("2024-01-04", "2024-01-05", "2024-01-06")], "ts date")
    labels = [r[0] for r in days.select(R.week_ending("ts")).collect()]
    assert labels == [d("2024-01-05"), d("2024-01-05"), d("2024-01-12")]


def test_weekly_counts_are_distinct_fridays(gappy):
    weekly = R.resample_week(R.interpolate_time(gappy)).filter(F.col("series") == "a")
    assert weekly.count() == 5
    assert weekly.filter(F.dayofweek("week_end_date") != 6).count() == 0


def test_unknown_kind_is_an_error(gappy):
    with pytest.raises(ValueError):
        R.weekly_by_kind(gappy, {"a": "volume"})


@pytest.mark.parametrize("values_, expected", [
    ([50.0], (100, 1, 1, 100)), ([49.0], (100, 100, 100, 100)), ([-80.0], (1, 1, 100, 100)), ([60.0], (1, 1, 1, 100))])
def test_unit_rules_at_their_limits(spark, values_, expected):
    df = spark.createDataFrame([("s", v) for v in values_], "series string, level double")
    for rule, factor in zip(K.UNIT_RULES, expected):
        row = K.auto_unit_scale(df, "level", "out", rule).first()
        assert row.out == pytest.approx(row.level * factor)


def test_coercion_and_first_value(spark):
    raw = spark.createDataFrame([("s", "2024-01-01", "1.5", 2), ("s", "2024-01-01", "9", 1), ("s", "bad", ".", 3),
                                 ("s", "2024-01-02", "NaN", 4), ("s", "2024-01-03", "", 5)],
                                "k string, d string, v string, o int")
    clean = K.coerce_types(raw, "d", "v", "k")
    assert [r.value for r in clean.collect()] == [1.5, 9.0, None, None, None]
    first = K.dedupe_first(raw.withColumn("value", F.col("v")), ["k", "d"], "o")
    assert first.filter(F.col("d") == "2024-01-01").first().value == "9"


@pytest.mark.parametrize("n", [1, 3, 4, 5, 6, 9, 20])
def test_smoothing_keeps_cubics_and_clips_windows(spark, n):
    rows = [("s", d("2024-01-05") + dt.timedelta(7 * k), float(k ** 2)) for k in range(n)]
    df = spark.createDataFrame(rows, "series string, week_end_date date, level double")
    out = W.savgol(df, "level").orderBy("week_end_date").collect()
    if n < 4:
        assert all(r.smoothed is None for r in out)
    else:
        assert [r.smoothed for r in out] == pytest.approx([r.level for r in out], abs=1e-8)
        assert [r.slope for r in out] == pytest.approx([2.0 * k for k in range(n)], abs=1e-8)


def test_causal_smoothing_reads_no_later_row(spark):
    rows = [("s", d("2024-01-05") + dt.timedelta(7 * k), float(k % 3)) for k in range(12)]
    df = spark.createDataFrame(rows, "series string, week_end_date date, level double")
    part = df.filter(F.col("week_end_date") <= rows[8][1])
    full = {r.week_end_date: r.smoothed for r in W.savgol(df, "level", causal=True).collect()}
    assert all(full[r.week_end_date] == r.smoothed for r in W.savgol(part, "level", causal=True).collect())


@pytest.mark.parametrize("n", [5, 9, 10, 37])
def test_split_sizes_and_purge(spark, n):
    rows = [("s", d("2024-01-05") + dt.timedelta(7 * k), float(k)) for k in range(n)]
    df = spark.createDataFrame(rows, "series string, week_end_date date, level double")
    split = W.chronological_split(df)
    assert split.filter(F.col("split") == "train").count() == int(0.8 * n)
    purged = W.purged_split(df, 4)
    assert purged.filter((F.col("split") == "train") & (F.col("target_date") >= F.col("split_start"))).count() == 0


def test_column_discovery(spark):
    df = spark.createDataFrame([("x", "2024-01-01", "7", 1.0)], "junk string, Observation_Date string, txt string, BBB_OAS double")
    assert C.find_date_column(df) == "Observation_Date"
    assert C.find_value_column(df, ["bbb"], exclude=["Observation_Date"]) == "BBB_OAS"
    assert C.find_value_column(df, ["none"]) is None
    assert C.find_value_column(df, ["none"], numeric_fallback="only") == "BBB_OAS"
    assert C.first_numeric_column(df, exclude=["Observation_Date"]) == "txt"
    with pytest.raises(ValueError):
        C.find_date_column(df.select("txt"), fallback="contains")
