"""Calendars, interpolation and weekly resampling."""

from pyspark.sql import functions as F

from ..operators import calendar as R
from ..plans import panels as P
from .base import DRV_DAILY, SEG_DAILY, SEG_WEEKLY, dense, query, rounded, week, weekly


@query("densify_daily", sql=f"""
WITH {SEG_DAILY},
e AS (SELECT series, min(d) AS lo, max(d) AS hi FROM seg_daily GROUP BY 1),
g AS (SELECT series, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS d FROM e)
SELECT g.series, g.d AS ts, round(s.value, 4) AS value FROM g LEFT JOIN seg_daily s ON s.series = g.series AND s.d = g.d""")
def densify(spark, sf):
    return rounded(R.densify_daily(P.segment_daily(spark, sf)))


@query("densify_daily_shared", sql=f"""
WITH {SEG_DAILY},
e AS (SELECT min(d) AS lo, max(d) AS hi FROM seg_daily),
g AS (SELECT series, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS d
      FROM e, (SELECT DISTINCT series FROM seg_daily))
SELECT g.series, g.d AS ts, round(s.value, 4) AS value FROM g LEFT JOIN seg_daily s ON s.series = g.series AND s.d = g.d""")
def densify_shared(spark, sf):
    return rounded(R.densify_daily(P.segment_daily(spark, sf), "shared"))


@query("interpolate_time", sql=f"""
WITH {SEG_DAILY}, {dense("seg_daily", "seg_dense")} SELECT series, d AS ts, round(value, 4) AS value FROM seg_dense""")
def interpolate(spark, sf):
    return rounded(R.interpolate_time(P.segment_daily(spark, sf)))


@query("resample_week_mean", sql=f"WITH {SEG_WEEKLY} SELECT series, week_end_date, round(level, 4) AS level FROM seg_weekly")
def week_mean(spark, sf):
    return rounded(R.resample_week(R.interpolate_time(P.segment_daily(spark, sf)), "mean"))


@query("resample_week_last", sql=f"""
WITH {SEG_DAILY}, {dense("seg_daily", "seg_dense")}, {weekly("seg_dense", "wk", "arg_max(value, d)")}
SELECT series, week_end_date, round(level, 4) AS level FROM wk""")
def week_last(spark, sf):
    return rounded(R.resample_week(R.interpolate_time(P.segment_daily(spark, sf)), "last"))


# Some weeks are emptied first, so that carrying forward has work to do.
@query("resample_week_last_ffill", sql=f"""
WITH {SEG_DAILY}, kept AS (SELECT * FROM seg_daily WHERE value > 250000),
{weekly("kept", "wk", "arg_max(value, d)")},
e AS (SELECT series, min(week_end_date) AS lo, max(week_end_date) AS hi FROM wk GROUP BY 1),
g AS (SELECT series, CAST(unnest(generate_series(lo, hi, INTERVAL 7 DAY)) AS DATE) AS week_end_date FROM e)
SELECT g.series, g.week_end_date,
       round(last_value(level IGNORE NULLS) OVER (PARTITION BY g.series ORDER BY g.week_end_date), 4) AS level
FROM g LEFT JOIN wk ON wk.series = g.series AND wk.week_end_date = g.week_end_date""")
def week_ffill(spark, sf):
    return rounded(R.resample_week_last_ffill(P.segment_daily(spark, sf).filter(F.col("value") > 250000)))


KINDS = {"DISCOUNT": "oas_pct", "TAX": "rate_pct", "PRICE": "price", "QUANTITY": "weekly_level",
         **dict.fromkeys(("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"), "level")}


@query("weekly_by_kind", sql=f"""
WITH {DRV_DAILY}, {SEG_DAILY}, all_daily AS (SELECT * FROM drv_daily UNION ALL SELECT * FROM seg_daily), {dense("all_daily", "all_dense")},
wk AS (
  SELECT series, {week()} AS week_end_date, avg(value) AS mean, arg_max(value, d) AS last
  FROM all_dense WHERE series <> 'QUANTITY' GROUP BY 1, 2),
q AS (SELECT {week()} AS week_end_date, arg_max(value, d) AS level FROM drv_daily WHERE series = 'QUANTITY' GROUP BY 1),
qg AS (SELECT CAST(unnest(generate_series(min(week_end_date), max(week_end_date), INTERVAL 7 DAY)) AS DATE) AS week_end_date FROM q),
l AS (
  SELECT series, week_end_date, CASE WHEN series = 'PRICE' THEN last ELSE mean END AS level FROM wk
  UNION ALL
  SELECT 'QUANTITY', qg.week_end_date, last_value(level IGNORE NULLS) OVER (ORDER BY qg.week_end_date)
  FROM qg LEFT JOIN q ON q.week_end_date = qg.week_end_date),
p AS (SELECT *, lag(level) OVER (PARTITION BY series ORDER BY week_end_date) AS b,
      CASE series WHEN 'DISCOUNT' THEN 'oas_pct' WHEN 'TAX' THEN 'rate_pct' WHEN 'PRICE' THEN 'price'
                  WHEN 'QUANTITY' THEN 'weekly_level' ELSE 'level' END AS kind FROM l),
c AS (SELECT *, CASE kind WHEN 'oas_pct' THEN level * 100 - b * 100 WHEN 'rate_pct' THEN (level - b) * 100
                WHEN 'price' THEN (level / b - 1) * 100 ELSE level - b END AS change FROM p)
SELECT series, kind, week_end_date, round(level, 4) AS level, round(change, 4) AS change,
       round(CASE kind WHEN 'oas_pct' THEN level * 100 WHEN 'price' THEN change ELSE level END, 4) AS value FROM c""")
def by_kind(spark, sf):
    daily = P.driver_daily(spark, sf).unionByName(P.segment_daily(spark, sf))
    return rounded(R.weekly_by_kind(daily, KINDS))


def panel_sql(daily: str, source: str) -> str:
    lag = ",\n".join(f"round(lag(level_bp, {k}) OVER w, 4) AS level_bp_lag{k}, round(lag(diff, {k}) OVER w, 4) AS diff_lag{k}"
                     for k in range(1, 5))
    return f"""
WITH {source}, {dense(daily, "dns")}, {weekly("dns", "wk")},
m AS (SELECT series, median(abs(level)) AS med FROM wk GROUP BY 1),
b AS (SELECT wk.series, week_end_date, level, level * CASE WHEN med > 50 THEN 1.0 ELSE 100.0 END AS level_bp
      FROM wk JOIN m ON m.series = wk.series),
f AS (SELECT *, level_bp - lag(level_bp) OVER (PARTITION BY series ORDER BY week_end_date) AS diff FROM b)
SELECT series, week_end_date, round(level, 4) AS level, round(level_bp, 4) AS level_bp, round(diff, 4) AS diff, {lag}
FROM f WINDOW w AS (PARTITION BY series ORDER BY week_end_date)"""


@query("weekly_panel", sql=panel_sql("seg_daily", SEG_DAILY))
def weekly_panel(spark, sf):
    return rounded(R.weekly_panel(P.segment_daily(spark, sf)))


SUP_DAILY = """sup_daily AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS series, CAST(l_shipdate AS DATE) AS d, avg(l_extendedprice) AS value
  FROM lineitem GROUP BY 1, 2)"""


@query("weekly_panel_suppliers", sql=panel_sql("sup_daily", SUP_DAILY))
def weekly_panel_suppliers(spark, sf):
    """The flagship on a panel whose number of series grows with the data."""
    return rounded(R.weekly_panel(P.supplier_daily(spark, sf)))


@query("regular_grid_check", sql=f"""
WITH {SEG_DAILY}, kept AS (SELECT * FROM seg_daily WHERE value > 250000), {weekly("kept", "wk")},
g AS (SELECT series, week_end_date, week_end_date - lag(week_end_date) OVER (PARTITION BY series ORDER BY week_end_date) AS gap_days FROM wk)
SELECT series, week_end_date, CAST(gap_days AS INTEGER) AS gap_days FROM g WHERE gap_days <> 7""")
def grid_check(spark, sf):
    kept = P.segment_daily(spark, sf).filter(F.col("value") > 250000)
    return R.regular_grid_check(R.resample_week(kept, "mean"))
