"""The online scorer equals its batch twin row for row, whatever the files; late rows are given back and counted."""

import datetime as dt

import pandas as pd

from panelloom.registry import load
from panelloom.registry.models import event_bins, scored_stream, stream_params
from panelloom.session import durable
from panelloom.streaming.scorer import late_rows, online_scorer, run_to_table, scorer

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted((r.series, r.hour, r.event_id, r.late, *(None if r[c] is None else round(r[c], 5) for c in ("actual", "pred", "sigma", "lower_95", "upper_95"))) for r in df.collect())


def test_stream_equals_batch(spark):
    queries, _ = load()
    a, b = rows_of(queries["online_scorer"](spark, SF)), rows_of(queries["online_scorer_batch_twin"](spark, SF))
    assert a == b and len(a) > 0


def test_one_file_a_trigger_loses_nothing(spark):
    """Forty files, read one after the other in whatever order they were written."""
    bins = durable(event_bins(spark, SF))
    params = durable(stream_params(bins))
    got = scored_stream(spark, bins, params, files=40, per_trigger=1, delay_hours=24 * 40)
    whole = scored_stream(spark, bins, params)
    order = lambda df: sorted(tuple(r) for r in df.collect())
    assert order(got) == order(whole) and got.count() == bins.count()


def write_rows(spark, folder, name, rows):
    spark.createDataFrame([(s, t, e, v) for s, t, e, v in rows], "series string, ts timestamp, event_id long, value double").coalesce(1).write.parquet(f"{folder}/{name}")


def minutes(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=n)


PARAMS = [("s", 0.0, [1.0], [0.0], 0.1, 0.1, 0.0, 0.8, 1.0)]


def test_late_rows_of_a_real_stream_are_counted(spark, tmp_path):
    """Two triggers: what comes after a later row was scored is given back late, whatever Spark's watermark would do."""
    params = spark.createDataFrame(PARAMS, "series string, const double, ar array<double>, ma array<double>, omega double, alpha double, gamma double, beta double, h0 double")
    staged, out = str(tmp_path / "in"), str(tmp_path / "out")

    def trigger():
        stream = spark.readStream.schema("series string, ts timestamp, event_id long, value double").parquet(f"{staged}/*")
        run_to_table(online_scorer(stream, params, delay_hours=2), out, str(tmp_path / "checkpoint"))
        return {(r.series, r.event_id): (r.late, r.n_late, r.pred) for r in spark.read.parquet(out).collect()}

    write_rows(spark, staged, "a", [("s", minutes(h), h, float(h)) for h in (9, 1, 5, 3)] + [("other", minutes(h), h, 1.0) for h in (4, 2, 30)])
    first = trigger()
    assert first == {("s", 1): (False, 0, None), ("s", 3): (False, 0, 1.0), ("s", 5): (False, 0, 3.0), ("other", 2): (False, 0, None), ("other", 4): (False, 0, None)}
    # 2 and 4 are older than 5, which is scored; 6 is old too, but nothing after it was scored, so it isn't late.
    write_rows(spark, staged, "b", [("s", minutes(h), h, float(h)) for h in (2, 4, 6, 20)] + [("other", minutes(1), 1, 7.0), ("other", minutes(40), None, None)])
    second = trigger()
    assert {k: v for k, v in second.items() if k not in first} == {
        ("s", 2): (True, 1, None), ("s", 4): (True, 2, None), ("s", 6): (False, 2, 5.0), ("s", 9): (False, 2, 6.0), ("other", 1): (True, 1, None), ("other", 30): (False, 1, None)}
    counts = {r.series: (r.n_scored, r.n_late) for r in late_rows(spark.read.parquet(out)).collect()}
    assert counts == {"s": (5, 2), "other": (3, 1)}


class Memory:
    exists = False

    def update(self, value):
        self.get, self.exists = value, True

    def remove(self):
        self.exists = False


def batch(*hours):
    return pd.DataFrame([{"series": "s", "ts": pd.Timestamp(minutes(h)), "event_id": h, "value": float(h), "model": [0.0, 0.1, 0.1, 0.0, 0.8, 1.0, 1.0, 0.0], "n_ar": 1} for h in hours])


def beat(hour):
    return pd.DataFrame([{"series": "s", "ts": pd.Timestamp(minutes(hour)), "event_id": None, "value": None, "model": None, "n_ar": None}])


def test_a_silent_series_is_scored_and_forgotten():
    hour = 3_600_000_000
    state, run = Memory(), scorer(2 * hour, 50 * hour)
    assert [list(x.actual) for x in run(("s",), iter([batch(5, 1, 9)]), state)] == [[1.0, 5.0]] and state.exists
    (last,) = run(("s",), iter([beat(12)]), state)
    assert list(last.actual) == [9.0] and list(last.pred) == [5.0] and state.exists
    assert list(run(("s",), iter([beat(62)]), state)) == [] and not state.exists
