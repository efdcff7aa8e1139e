"""Online one-step scorer: each new observation of a series is forecast first,
then moves the state on. The batch twin is ``arma_filter`` followed by
``variance_recursion``; both give the same rows.

Every series has an event-time clock of its own, kept in its state: the latest time seen less the delay allowed for. Rows wait in the
state until the clock has passed them and are scored in time order, so the order of files and triggers doesn't matter within the
delay. A row that comes after a later one was scored is late: it is given back without a forecast, marked ``late`` and counted
in ``n_late``. Spark's own watermark isn't used, as it removes late rows before the function sees them; no row is lost. A row
without a value is a heartbeat of its series: it only moves the clock on, which lets a finite stream score its last rows.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SCORED = T.StructType([
    T.StructField("series", T.StringType()), T.StructField("ts", T.TimestampType()),
    T.StructField("event_id", T.LongType()), T.StructField("actual", T.DoubleType()),
    T.StructField("pred", T.DoubleType()), T.StructField("sigma", T.DoubleType()),
    T.StructField("lower_95", T.DoubleType()), T.StructField("upper_95", T.DoubleType()),
    T.StructField("late", T.BooleanType()), T.StructField("n_late", T.LongType())])
MODEL = ["const", "omega", "alpha", "gamma", "beta", "h0"]
DOUBLES, LONGS = T.ArrayType(T.DoubleType()), T.ArrayType(T.LongType())
STATE = T.StructType([
    T.StructField("values", DOUBLES), T.StructField("shocks", DOUBLES), T.StructField("last_e", T.DoubleType()), T.StructField("last_h", T.DoubleType()),
    T.StructField("last_ts", T.LongType()), T.StructField("last_id", T.LongType()), T.StructField("n_seen", T.LongType()),
    T.StructField("n_late", T.LongType()), T.StructField("clock", T.LongType()), T.StructField("model", DOUBLES), T.StructField("n_ar", T.LongType()),
    T.StructField("wait_ts", LONGS), T.StructField("wait_id", LONGS), T.StructField("wait_value", DOUBLES)])
FRESH = ([], [], None, None, None, None, 0, 0, None, [], 0, [], [], [])


def packed_model(params: DataFrame) -> DataFrame:
    """``(series, model, n_ar)``: the parameters of a series in one array, then its ar and ma coefficients."""
    given = F.concat(F.array(*[F.col(c).cast("double") for c in MODEL]), F.col("ar").cast("array<double>"), F.col("ma").cast("array<double>"))
    return params.where("h0 is not null").select("series", given.alias("model"), F.size("ar").cast("long").alias("n_ar"))


def scorer(delay_us: int, ttl_us: int):
    def score_rows(key, batches, state: GroupState):
        """Keep the rows of one series; score those that its clock has passed, in time order."""
        (values, shocks, last_e, last_h, last_ts, last_id, seen, late, clock, model, n_ar, *waiting) = state.get if state.exists else FRESH
        values, shocks, model, waiting, out = list(values), list(shocks), list(model), list(zip(*waiting)), []
        for batch in batches:
            if not len(batch):
                continue
            times = batch["ts"].astype("datetime64[us]").astype("int64")
            clock = max(int(times.max()) - delay_us, clock if clock is not None else -(2**62))
            known = batch["value"].notna()
            if known.any():
                rows = batch[known]
                if rows["model"].iloc[0] is not None:
                    model, n_ar = [float(x) for x in rows["model"].iloc[0]], int(rows["n_ar"].iloc[0])
                waiting += zip(times[known].tolist(), rows["event_id"].tolist(), rows["value"].tolist())
        waiting.sort()
        ready = [r for r in waiting if r[0] <= clock]
        waiting = waiting[len(ready):]
        const, omega, alpha, gamma, beta, h0 = model[:6] or [None] * 6
        ar, ma = model[6 : 6 + n_ar], model[6 + n_ar :]
        for ts, event, value in ready:
            if last_ts is not None and (ts, event) <= (last_ts, last_id):
                late += 1
                out.append((key[0], ts, event, value, None, None, None, None, True, late))
                continue
            pred = h = None
            if model:
                if seen >= n_ar:
                    pred = const + sum(a * v for a, v in zip(ar, values)) + sum(b * e for b, e in zip(ma, shocks))
                if last_e is None:
                    h = h0
                else:
                    h = omega + (alpha + (gamma if last_e < 0 else 0.0)) * last_e * last_e + beta * last_h
                    h = h if h > 0 and math.isfinite(h) else None
            sigma = math.sqrt(h) if h is not None else None
            both = pred is not None and sigma is not None
            out.append((key[0], ts, event, value, pred, sigma, pred - 1.96 * sigma if both else None, pred + 1.96 * sigma if both else None, False, late))
            shock = value - pred if pred is not None else None
            if shock is not None and h is not None:
                last_e, last_h = shock, h
            values = [value, *values][:max(n_ar, 1)]
            shocks = [shock if shock is not None else 0.0, *shocks][:max(len(ma), 1)]
            seen, last_ts, last_id = seen + 1, ts, event
        if not waiting and (last_ts is None or clock - last_ts > ttl_us):
            if state.exists:
                state.remove()  # silent for the whole time to live, or nothing to remember
        else:
            state.update((values, shocks, last_e, last_h, last_ts, last_id, seen, late, clock, model, n_ar, *(map(list, zip(*waiting)) if waiting else ([], [], []))))
        if out:
            frame = pd.DataFrame(out, columns=[f.name for f in SCORED.fields])
            frame["ts"] = pd.to_datetime(frame["ts"] * 1000)
            for c in ("pred", "sigma", "lower_95", "upper_95"):
                frame[c] = frame[c].astype("float64")
            yield frame

    return score_rows


def online_scorer(stream: DataFrame, params: DataFrame, delay_hours: int = 1, ttl_hours: int = 24 * 90) -> DataFrame:
    """Forecast, sigma, 95 percent band and lateness per streamed ``(series, ts, event_id, value)``.

    ``params`` is a static table per series with ``const, ar, ma`` (arrays of
    the model's own order) and ``omega, alpha, gamma, beta, h0``. ``delay_hours`` is the disorder allowed for, in event time. A
    series whose heartbeat shows that it has been silent for ``ttl_hours`` is forgotten. Rows
    of a series without parameters come out in the same order, with null forecasts. ``n_late`` counts the late rows of the series
    so far; ``late_rows`` sums them up.
    """
    joined = stream.join(packed_model(params), "series", "left")
    return joined.groupBy("series").applyInPandasWithState(
        scorer(delay_hours * 3_600_000_000, ttl_hours * 3_600_000_000), SCORED, STATE, "append", GroupStateTimeout.NoTimeout)


def late_rows(scored: DataFrame) -> DataFrame:
    """How many rows of each series were scored, and how many came too late to be."""
    return scored.groupBy("series").agg(F.count_if(~F.col("late")).alias("n_scored"), F.count_if("late").alias("n_late"))


def run_to_table(scored: DataFrame, path: str, checkpoint: str) -> None:
    """Score everything available, to parquet files with exactly-once commits."""
    query = (scored.writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
             .option("path", path).option("checkpointLocation", checkpoint).start())
    query.awaitTermination()
