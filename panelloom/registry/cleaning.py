"""Cleaning, scaling and scalar functions."""

from pyspark.sql import functions as F

from ..functions.math import scalar_math
from ..operators import cleaning as K
from ..operators import evaluation as E
from ..operators.features import spread_gaps
from ..operators.windows import add_lags, savgol
from ..plans import panels as P
from .base import DRV_WEEKLY, FLAG_WIDE, FORECASTS, SEG_MODEL, SEG_WEEKLY, query, rounded


@query("coerce_types", sql="""
SELECT event_type AS series, TRY_CAST(CASE WHEN event_type = 'view' THEN 'soon' ELSE strftime(ts, '%Y-%m-%d') END AS DATE) AS ts,
       TRY_CAST(CASE WHEN event_type = 'error' THEN '.' ELSE CAST(value AS VARCHAR) END AS DOUBLE) AS value
FROM events""")
def coerce_types(spark, sf):
    raw = P.table(spark, sf, "events").select(
        "event_type", F.when(F.col("event_type") == "view", "soon").otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("d"),
        F.when(F.col("event_type") == "error", ".").otherwise(F.col("value").cast("string")).alias("v"))
    return K.coerce_types(raw, "d", "v", "event_type")


@query("dedupe_first", sql="""
SELECT o_orderpriority AS series, CAST(o_orderdate AS DATE) AS ts, arg_min(o_totalprice, o_orderkey) AS value
FROM orders GROUP BY 1, 2""")
def dedupe_first(spark, sf):
    raw = P.table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("series"), P.day("o_orderdate").alias("ts"),
        F.col("o_totalprice").alias("value"), "o_orderkey")
    return K.dedupe_first(raw, ["series", "ts"], "o_orderkey")


@query("drop_nulls", sql=f"""
WITH {FLAG_WIDE} SELECT observation_date, round(A_price, 4) AS A_price, round(N_price, 4) AS N_price,
  round(R_price, 4) AS R_price FROM flag_wide
WHERE A_price IS NOT NULL AND R_price IS NOT NULL""")
def drop_nulls(spark, sf):
    wide = K.drop_nulls(P.flag_daily_wide(spark, sf), how="all", subset=["A_price", "N_price", "R_price"])
    return rounded(K.drop_nulls(wide, subset=["A_price", "R_price"]))


@query("auto_unit_scale", sql=f"""
WITH {DRV_WEEKLY},
m AS (SELECT series, median(abs(level)) AS ma, median(level) AS ms FROM drv_weekly GROUP BY series)
SELECT w.series, w.week_end_date,
       round(level * CASE WHEN ma > 50 THEN 1 ELSE 100 END, 4) AS abs_above,
       round(level * CASE WHEN ma < 50 THEN 100 ELSE 1 END, 4) AS abs_below,
       round(level * CASE WHEN ms < 50 THEN 100 ELSE 1 END, 4) AS signed_below,
       round(level * 100, 4) AS always
FROM drv_weekly w JOIN m ON w.series = m.series""")
def auto_unit_scale(spark, sf):
    df = P.driver_weekly(spark, sf)
    for rule in K.UNIT_RULES:
        df = K.auto_unit_scale(df, "level", rule, rule)
    return rounded(df.drop("level"))


@query("spread_gaps", sql=f"""
WITH {SEG_WEEKLY},
pairs(a, b) AS (VALUES ('2-HIGH', '1-URGENT'), ('3-MEDIUM', '2-HIGH'), ('5-LOW', '3-MEDIUM')),
g AS (SELECT a.series || '-' || b.series AS gap, a.week_end_date, a.level - b.level AS gap_level
      FROM pairs p JOIN seg_weekly a ON a.series = p.a
      JOIN seg_weekly b ON b.series = p.b AND b.week_end_date = a.week_end_date)
SELECT gap, week_end_date, round(gap_level, 4) AS gap_level,
       round(gap_level - lag(gap_level) OVER (PARTITION BY gap ORDER BY week_end_date), 4) AS gap_diff FROM g""")
def gaps(spark, sf):
    pairs = [("2-HIGH", "1-URGENT"), ("3-MEDIUM", "2-HIGH"), ("5-LOW", "3-MEDIUM")]
    return rounded(spread_gaps(P.segment_weekly(spark, sf), pairs))


@query("relabel", sql=f"""
WITH {FORECASTS}
SELECT series, CASE model WHEN 'Random Walk' THEN 'No-change benchmark' WHEN 'Mean4' THEN 'Four-week mean'
       ELSE model END AS model, count(*) AS n FROM fct GROUP BY 1, 2""")
def relabel(spark, sf):
    fc = P.forecast_fixture(P.segment_model(spark, sf)).filter(F.col("split") == "test")
    named = K.relabel(fc, "model", {"Random Walk": "No-change benchmark", "Mean4": "Four-week mean"})
    return named.groupBy("series", "model").agg(F.count(F.lit(1)).alias("n"))


@query("classify_model_name", sql="""
WITH m AS (SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'Random Walk' WHEN '2-HIGH' THEN 'ARMA(1, 2)'
  WHEN '3-MEDIUM' THEN 'ARMA(1, 2)-GJR-GARCH(1,1)' WHEN '5-LOW' THEN 'Elastic Net' ELSE 'Random Forest' END AS model FROM orders)
SELECT model,
  CASE WHEN contains(lower(model), 'random walk') THEN 'RW_forecast'
       WHEN contains(lower(model), 'gjr') OR contains(lower(model), 'garch') THEN 'ARMA_GJR_forecast'
       WHEN contains(lower(model), 'arma') THEN 'ARMA_forecast' END AS forecast_col,
  NOT regexp_matches(lower(model), 'arma|arima|garch|random walk|rw') AS is_ml, count(*) AS n
FROM m GROUP BY 1, 2, 3""")
def classify(spark, sf):
    names = {"1-URGENT": "Random Walk", "2-HIGH": "ARMA(1, 2)", "3-MEDIUM": "ARMA(1, 2)-GJR-GARCH(1,1)",
             "5-LOW": "Elastic Net", "4-NOT SPECIFIED": "Random Forest"}
    named = K.relabel(P.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("model")), "model", names)
    return K.classify_model_name(named).groupBy("model", "forecast_col", "is_ml").agg(F.count(F.lit(1)).alias("n"))


@query("reorder_round", sql=f"""
WITH {FORECASTS}
SELECT series, model, method, ROUND(sqrt(avg((actual - pred) * (actual - pred))), 2) AS rmse,
       ROUND(avg(abs(actual - pred)), 2) AS mae FROM fct GROUP BY 1, 2, 3""")
def reorder_round(spark, sf):
    fc = P.forecast_fixture(P.segment_model(spark, sf)).filter(F.col("split") == "test")
    return K.reorder_round(E.forecast_metrics(fc), ["series", "model", "absent"], 2)


@query("scalar_math", sql=f"""
WITH {SEG_MODEL}
SELECT series, week_end_date, round(diff, 4) AS diff, round(abs(diff), 4) AS abs_x, round(sqrt(abs(diff)), 4) AS sqrt_abs,
       round(ln(greatest(abs(diff), 1e-12)), 6) AS ln_abs, CAST(sign(diff) AS DOUBLE) AS sign_x,
       round(diff * diff / 1e6, 4) AS sq_x, round(greatest(diff, 1e-12), 4) AS floored FROM seg_model""")
def scalars(spark, sf):
    df = scalar_math(P.segment_model(spark, sf).select("series", "week_end_date", "diff"), "diff")
    return rounded(df.withColumn("sq_x", F.col("sq_x") / 1e6), 4, ln_abs=6)


@query("max_abs_scale", sql=f"""
WITH {SEG_MODEL},
s AS (SELECT *, max(greatest(abs(level), abs(diff))) OVER (PARTITION BY series) AS peak FROM seg_model)
SELECT series, week_end_date, round(level * (0.9 / peak), 6) AS scaled_original,
       round(diff * (0.9 / peak), 6) AS scaled_derivative, round(level, 4) AS restored FROM s""")
def max_abs_scale(spark, sf):
    scaled = K.max_abs_scale(P.segment_model(spark, sf), "level", "diff")
    return rounded(scaled.select("series", "week_end_date", "scaled_original", "scaled_derivative",
                                 K.unscale("scaled_original").alias("restored")), 6, restored=4)


@query("standardize", sql=f"""
WITH {SEG_MODEL},
t AS (SELECT series, avg(diff) AS m, stddev_pop(diff) AS s FROM seg_model WHERE split = 'train' GROUP BY 1)
SELECT x.series, week_end_date, split, round((diff - m) / s, 6) AS z FROM seg_model x JOIN t ON x.series = t.series""")
def standardize(spark, sf):
    df = K.standardize(P.segment_model(spark, sf), "diff", "z", F.col("split") == "train")
    return rounded(df.select("series", "week_end_date", "split", "z"), 6)


@query("median_impute", sql=f"""
WITH {SEG_MODEL},
f AS (SELECT series, week_end_date, split, lag(diff, 1) OVER w AS diff_lag1, lag(diff, 3) OVER w AS diff_lag3 FROM seg_model
      WINDOW w AS (PARTITION BY series ORDER BY week_end_date)),
m AS (SELECT series, median(diff_lag1) AS m1, median(diff_lag3) AS m3 FROM f WHERE split = 'train' GROUP BY 1)
SELECT f.series, week_end_date, split, round(coalesce(diff_lag1, m1), 4) AS diff_lag1,
       round(coalesce(diff_lag3, m3), 4) AS diff_lag3 FROM f JOIN m ON f.series = m.series""")
def median_impute(spark, sf):
    df = add_lags(P.segment_model(spark, sf), ["diff"], (1, 3)).select(
        "series", "week_end_date", "split", "diff_lag1", "diff_lag3")
    return rounded(K.median_impute(df, ["diff_lag1", "diff_lag3"], F.col("split") == "train"))
