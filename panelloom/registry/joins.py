"""Alignment joins."""

from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..operators import joins as J
from ..operators.calendar import week_ending
from ..plans import panels as P
from ..session import durable
from .base import DRV_WEEKLY, FORECASTS, SEG_DAILY, SEG_MODEL, SEG_WEEKLY, query, rounded, week

NAMES = {"1-URGENT": "URGENT", "2-HIGH": "HIGH", "3-MEDIUM": "MEDIUM", "4-NOT SPECIFIED": "NOTSPEC", "5-LOW": "LOW"}
ROUNDED = ", ".join(f"round({n}, 4) AS {n}" for n in NAMES.values())


def _single(panel, series, out, ts="ts", value="value"):
    return panel.filter(F.col("series") == series).select(ts, F.col(value).alias(out))


def _chain(how: str, cte: str, d: str, v: str) -> str:
    parts = [f"(SELECT {d}, {v} AS {n} FROM {cte} WHERE series = '{s}') AS t_{n}" for s, n in NAMES.items()]
    return parts[0] + "".join(f"\n{how} {p} USING ({d})" for p in parts[1:])


@query("outer_merge_n", sql=f"""
WITH {SEG_DAILY}
SELECT d AS ts, {ROUNDED} FROM {_chain("FULL JOIN", "seg_daily", "d", "value")}""")
def outer_merge(spark, sf):
    # Several frames are cut from one panel, so the raw table is read once.
    daily = durable(P.segment_daily(spark, sf))
    return rounded(J.outer_merge_n([_single(daily, s, n) for s, n in NAMES.items()], "ts"))


@query("inner_merge_n", sql=f"""
WITH {SEG_WEEKLY}
SELECT week_end_date, {ROUNDED} FROM {_chain("JOIN", "seg_weekly", "week_end_date", "level")}""")
def inner_merge(spark, sf):
    weekly = durable(P.segment_weekly(spark, sf))
    frames = [_single(weekly, s, n, "week_end_date", "level") for s, n in NAMES.items()]
    return rounded(J.inner_merge_n(frames, "week_end_date"))


DRV_WIDE = """drv_cols AS (
  SELECT week_end_date, max(CASE WHEN series = 'DISCOUNT' THEN level END) AS DISCOUNT,
         max(CASE WHEN series = 'PRICE' THEN level END) AS PRICE, max(CASE WHEN series = 'TAX' THEN level END) AS TAX,
         max(CASE WHEN series = 'QUANTITY' THEN level END) AS QUANTITY
  FROM drv_weekly GROUP BY 1)"""


@query("left_enrich", sql=f"""
WITH {SEG_WEEKLY}, {DRV_WEEKLY}, {DRV_WIDE}
SELECT s.series, s.week_end_date, round(s.level, 4) AS level, round(DISCOUNT, 6) AS DISCOUNT, round(PRICE, 2) AS PRICE,
       round(TAX, 6) AS TAX, round(QUANTITY, 2) AS QUANTITY
FROM seg_weekly s LEFT JOIN drv_cols USING (week_end_date)""")
def left_enrich(spark, sf):
    wide = J.panel_to_wide(P.driver_weekly(spark, sf), P.DRIVERS, "level", "week_end_date")
    out = J.left_enrich(P.segment_weekly(spark, sf), wide, on="week_end_date")
    return rounded(out, 6, level=4, PRICE=2, QUANTITY=2)


ALIGNED = [*NAMES, *P.DRIVERS]


@query("outer_align_columns", sql=f"""
WITH {SEG_WEEKLY}, {DRV_WEEKLY},
a AS (SELECT * FROM seg_weekly UNION ALL SELECT * FROM drv_weekly)
SELECT week_end_date, {", ".join(f"""round(max(CASE WHEN series = '{s}' THEN level END), 4) AS "{s}" """ for s in ALIGNED)}
FROM a GROUP BY 1""")
def outer_align(spark, sf):
    panels = [P.segment_weekly(spark, sf), P.driver_weekly(spark, sf)]
    return rounded(J.outer_align_columns(panels, ALIGNED, "level", "week_end_date"))


@query("common_index", sql=f"""
WITH {SEG_WEEKLY}, {DRV_WEEKLY},
a AS (SELECT * FROM seg_weekly UNION ALL SELECT * FROM drv_weekly),
c AS (SELECT week_end_date FROM a GROUP BY 1 HAVING count(DISTINCT series) = (SELECT count(DISTINCT series) FROM a))
SELECT series, week_end_date, round(level, 4) AS level FROM a WHERE week_end_date IN (SELECT week_end_date FROM c)""")
def common_index(spark, sf):
    both = durable(P.segment_weekly(spark, sf).unionByName(P.driver_weekly(spark, sf)))
    return rounded(J.common_index(both).select("series", "week_end_date", "level"))


@query("align_predictions", sql=f"""
WITH {SEG_MODEL},
p AS (SELECT series, week_end_date, diff / 2 AS pred FROM seg_model WHERE dayofyear(week_end_date) % 3 = 0)
SELECT m.series, m.week_end_date, round(diff, 4) AS actual, round(pred, 4) AS pred
FROM seg_model m LEFT JOIN p ON p.series = m.series AND p.week_end_date = m.week_end_date WHERE split = 'test'""")
def align(spark, sf):
    m = P.segment_model(spark, sf)
    actual = m.filter(F.col("split") == "test").select("series", "week_end_date", F.col("diff").alias("actual"))
    preds = (m.filter(F.dayofyear("week_end_date") % 3 == 0)
             .select("series", "week_end_date", (F.col("diff") / 2).alias("pred")))
    return rounded(J.align_predictions(actual, preds))


def _history_sql(op: str) -> str:
    return f"""
WITH {SEG_DAILY},
o AS (SELECT DISTINCT series, {week()} AS ts FROM seg_daily),
h AS (SELECT o.series, o.ts, count(v.value) AS n_known, arg_max(v.value, v.d) AS last_value
      FROM o LEFT JOIN seg_daily v ON v.series = o.series AND v.d {op} o.ts GROUP BY 1, 2)
SELECT series, ts, n_known, CAST(n_known - coalesce(lag(n_known) OVER (PARTITION BY series ORDER BY ts), 0) AS BIGINT) AS n_new,
       round(last_value, 4) AS last_value FROM h"""


def _history(spark, sf, inclusive):
    daily = durable(P.segment_daily(spark, sf))
    origins = daily.select("series", week_ending("ts").alias("ts")).distinct()
    return rounded(J.origin_history(daily, origins, inclusive))


@query("origin_history", sql=_history_sql("<"))
def origin_history(spark, sf):
    return _history(spark, sf, False)


@query("origin_history_inclusive", sql=_history_sql("<="))
def origin_history_inclusive(spark, sf):
    return _history(spark, sf, True)


@query("lookup_metrics", sql=f"""
WITH {FORECASTS},
e AS (SELECT series, model, sqrt(avg((actual - pred) * (actual - pred))) AS rmse FROM fct GROUP BY 1, 2),
a AS (SELECT series, model, avg(CASE WHEN sign(actual) = sign(pred) THEN 1.0 ELSE 0.0 END) AS directional_accuracy
      FROM fct WHERE actual IS NOT NULL AND pred IS NOT NULL AND model <> 'Random Walk' GROUP BY 1, 2)
SELECT e.series, e.model, round(rmse, 4) AS rmse, round(directional_accuracy, 6) AS directional_accuracy,
  CASE e.model WHEN 'Random Walk' THEN 'benchmark' END AS note
FROM e LEFT JOIN a ON a.series = e.series AND a.model = e.model""")
def lookup(spark, sf):
    fc = durable(P.forecast_fixture(P.segment_model(spark, sf)).filter(F.col("split") == "test"))
    keys = ("series", "model")
    table = E.forecast_metrics(fc, keys).select(*keys, "rmse")
    direction = E.directional_accuracy(fc.filter(F.col("model") != "Random Walk"), keys)
    notes = (fc.filter(F.col("model") == "Random Walk").select(*keys).distinct()
             .withColumn("note", F.lit("benchmark")))
    return rounded(J.lookup_metrics(table, direction, notes), 6, rmse=4)
