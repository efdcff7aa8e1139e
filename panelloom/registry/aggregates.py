"""Descriptive statistics, accuracy tables and reports."""

from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..operators import joins as J
from ..operators import selection as N
from ..operators import statistics as S
from ..operators import windows as W
from ..plans import panels as P
from .base import FORECASTS, SEG_MODEL, SEG_WEEKLY, query, rounded
from .features import SCALED, WIN, smoothed


def test_rows(spark, sf):
    return P.forecast_fixture(P.segment_model(spark, sf)).filter((F.col("split") == "test") & F.col("pred").isNotNull())


FCT = FORECASTS + ",\nft AS (SELECT * FROM fct WHERE pred IS NOT NULL)"
RMSE = "sqrt(avg((actual - pred) * (actual - pred)))"
MAE = "avg(abs(actual - pred))"


@query("descriptive_stats", sql=f"""
WITH {SEG_MODEL} SELECT series, count(diff) AS n_obs, round(avg(diff), 4) AS mean, round(stddev_samp(diff), 4) AS std, round(min(diff), 4) AS min,
  round(quantile_cont(diff, 0.25), 4) AS p25, round(median(diff), 4) AS median, round(quantile_cont(diff, 0.75), 4) AS p75, round(max(diff), 4) AS max,
  round(skewness(diff), 6) AS skewness, round(kurtosis(diff), 6) AS kurtosis FROM seg_model GROUP BY 1""")
def descriptive(spark, sf):
    return rounded(S.descriptive_stats(P.segment_model(spark, sf), "diff"), 4, skewness=6, kurtosis=6)


@query("describe", sql=f"""
WITH {SEG_MODEL} {" UNION ALL ".join(f'''SELECT '{c}' AS variable, CAST(count({c}) AS DOUBLE) AS n_obs, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std,
  round(min({c}), 4) AS min, round(quantile_cont({c}, 0.25), 4) AS p25, round(median({c}), 4) AS median, round(quantile_cont({c}, 0.75), 4) AS p75,
  round(max({c}), 4) AS max FROM seg_model''' for c in ("level", "diff"))}""")
def describe(spark, sf):
    return rounded(S.describe(P.segment_model(spark, sf), ["level", "diff"]), 4, n_obs=0)


LINE_KEYS = ["l_returnflag", "l_linestatus"]


@query("quartiles_selected", sql="""
WITH v AS (SELECT l_returnflag, l_linestatus, 'price' AS variable, CAST(l_extendedprice AS DOUBLE) AS v FROM lineitem
  UNION ALL SELECT l_returnflag, l_linestatus, 'net', l_extendedprice * (1 - l_discount) FROM lineitem
  UNION ALL SELECT l_returnflag, l_linestatus, 'quantity', l_quantity FROM lineitem)
SELECT l_returnflag, l_linestatus, variable, count(v) AS n_obs, round(min(v), 4) AS min, round(quantile_cont(v, 0.25), 4) AS p25,
  round(quantile_cont(v, 0.5), 4) AS median, round(quantile_cont(v, 0.75), 4) AS p75, round(max(v), 4) AS max FROM v GROUP BY 1, 2, 3""")
def quartiles_selected(spark, sf):
    """Exact quartiles of every line of an order, by the few keys that all lines share."""
    lines = P.table(spark, sf, "lineitem")
    named = {"price": F.col("l_extendedprice"), "net": F.col("l_extendedprice") * (1 - F.col("l_discount")), "quantity": F.col("l_quantity")}
    return rounded(N.quartiles(lines, named, LINE_KEYS))


@query("quantiles_without_key", sql=f"""
SELECT 'o_totalprice' AS variable, p, count(*) AS n_obs, round(any_value(v), 4) AS value FROM orders,
  (SELECT unnest([{", ".join(f"CAST({p} AS DOUBLE)" for p in (0.01, 0.1, 0.5, 0.9, 0.99))}]) AS p,
          unnest((SELECT quantile_cont(CAST(o_totalprice AS DOUBLE), [0.01, 0.1, 0.5, 0.9, 0.99]) FROM orders)) AS v) GROUP BY 1, 2""")
def quantiles_without_key(spark, sf):
    return rounded(N.select_quantiles(P.table(spark, sf, "orders"), ["o_totalprice"], [0.01, 0.1, 0.5, 0.9, 0.99], keys=[]))


@query("impute_selected", sql="""
WITH l AS (SELECT l_orderkey, l_linenumber, l_returnflag, CASE WHEN l_quantity > 40 THEN NULL ELSE CAST(l_extendedprice AS DOUBLE) END AS price FROM lineitem),
m AS (SELECT l_returnflag, median(price) AS m FROM l WHERE l_linenumber < 5 GROUP BY 1)
SELECT l_orderkey, l_linenumber, l_returnflag, round(coalesce(price, m), 4) AS price FROM l LEFT JOIN m USING (l_returnflag)""")
def impute_selected(spark, sf):
    """Prices of lines of over 40 pieces replaced by the median of the other lines of their return flag; the first four lines of an order are the training rows."""
    price = F.when(F.col("l_quantity") <= 40, F.col("l_extendedprice").cast("double"))
    lines = P.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", price.alias("price"))
    return rounded(N.impute_selected(lines, ["price"], F.col("l_linenumber") < 5, ["l_returnflag"]))


@query("corr_matrix", sql=f"""
WITH {SEG_MODEL}
SELECT a.series AS a, b.series AS b, round(corr(a.diff, b.diff), 6) AS corr
FROM seg_model a JOIN seg_model b ON a.week_end_date = b.week_end_date AND a.series < b.series GROUP BY 1, 2""")
def corr(spark, sf):
    return rounded(S.corr_panel(P.segment_model(spark, sf), P.SEGMENTS, "diff", "week_end_date"), 6)


@query("forecast_metrics", sql=f"WITH {FCT} SELECT method, series, model, round({RMSE}, 4) AS rmse, round({MAE}, 4) AS mae FROM ft GROUP BY 1, 2, 3")
def metrics(spark, sf):
    return rounded(E.forecast_metrics(test_rows(spark, sf)))


@query("pooled_metrics", sql=f"""
WITH {FCT} SELECT model, coalesce(series, 'average') AS series, round({RMSE}, 4) AS rmse, round({MAE}, 4) AS mae
FROM ft GROUP BY GROUPING SETS ((model, series), (model))""")
def pooled(spark, sf):
    return rounded(E.pooled_metrics(test_rows(spark, sf)))


@query("step_rmse", sql=f"""
WITH {SCALED},
t AS (SELECT series, row_number() OVER w AS rn, count(*) OVER (PARTITION BY series) AS n, lead(scaled_original, 4) OVER w AS last,
  {", ".join(f"lead(scaled_original, {5 + i}) OVER w AS o{i + 1}" for i in range(4))} FROM scaled {WIN}),
k AS (SELECT * FROM t WHERE rn <= n - 9 AND rn > 10),
u AS ({" UNION ALL ".join(f"SELECT series, {i} AS step, o{i} AS actual, last AS pred FROM k" for i in range(1, 5))})
SELECT series, CAST(coalesce(step, 0) AS BIGINT) AS step, round({RMSE}, 6) AS rmse FROM u GROUP BY GROUPING SETS ((series, step), (series))""")
def steps(spark, sf):
    win = W.sliding_windows(smoothed(spark, sf))
    naive = win.withColumn("pred", F.array_repeat(F.element_at("inputs", -1), 4))
    return rounded(E.step_rmse(naive, "outputs", "pred"), 6)


@query("directional_accuracy", sql=f"""
WITH {FCT} SELECT method, series, model, round(avg(CASE WHEN sign(actual) = sign(pred) THEN 1.0 ELSE 0.0 END), 6) AS directional_accuracy
FROM ft GROUP BY 1, 2, 3""")
def direction(spark, sf):
    return rounded(E.directional_accuracy(test_rows(spark, sf)), 6)


@query("improvement_vs_baseline", sql=f"""
WITH {FCT}, m AS (SELECT method, series, model, {RMSE} AS rmse, {MAE} AS mae FROM ft GROUP BY 1, 2, 3)
SELECT method, series, model, round(rmse, 4) AS rmse, round(mae, 4) AS mae,
  round(100 * (max(CASE WHEN model = 'Random Walk' THEN rmse END) OVER (PARTITION BY series) - rmse)
        / max(CASE WHEN model = 'Random Walk' THEN rmse END) OVER (PARTITION BY series), 6) AS improvement_pct FROM m""")
def improvement(spark, sf):
    return rounded(E.improvement_vs_baseline(E.forecast_metrics(test_rows(spark, sf))), 4, improvement_pct=6)


@query("interval_coverage", sql=f"""
WITH {FCT}, s AS (SELECT series, stddev_samp(diff) AS sigma FROM seg_model WHERE split = 'train' GROUP BY 1)
SELECT method, ft.series, model, round(avg(CASE WHEN actual BETWEEN pred - 1.96 * sigma AND pred + 1.96 * sigma THEN 1.0 ELSE 0.0 END), 6) AS coverage_95
FROM ft JOIN s ON s.series = ft.series GROUP BY 1, 2, 3""")
def coverage(spark, sf):
    model = P.segment_model(spark, sf)
    sigma = model.filter(F.col("split") == "train").groupBy("series").agg(F.stddev_samp("diff").alias("sigma"))
    return rounded(E.interval_coverage(test_rows(spark, sf).join(sigma, "series")), 6)


def _no_baseline(m):
    """Criterion columns as reports hold them: the benchmark has none."""
    return m.withColumn("aic", F.when(F.col("model") != "Random Walk", F.log("rmse")))


@query("pivot_report", sql=f"""
WITH {FCT}, m AS (SELECT method, series, model, CASE WHEN model <> 'Random Walk' THEN ln({RMSE}) END AS aic FROM ft GROUP BY method, series, model)
SELECT method, model, {", ".join(f"round(avg(CASE WHEN series = '{s}' THEN aic END), 6) AS \"{s}\"" for s in P.SEGMENTS)}
FROM m GROUP BY 1, 2 HAVING count(aic) > 0""")
def pivot(spark, sf):
    return rounded(E.pivot_report(_no_baseline(E.forecast_metrics(test_rows(spark, sf))), "aic", P.SEGMENTS), 6)


@query("winner_table", sql=f"""
WITH {FCT}, m AS (SELECT series, horizon, model, {RMSE} AS rmse, {MAE} AS mae FROM ft GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY series, horizon ORDER BY rmse, model) AS k FROM m)
SELECT series, horizon, model, round(rmse, 4) AS rmse, round(mae, 4) AS mae FROM r WHERE k = 1""")
def winners(spark, sf):
    return rounded(E.winner_table(E.forecast_metrics(test_rows(spark, sf), ("series", "horizon", "model"))))


@query("rank_nulls_last", sql=f"""
WITH {FCT}, m AS (SELECT series, model, CASE WHEN model <> 'Random Walk' THEN ln({RMSE}) END AS aic FROM ft GROUP BY series, model)
SELECT series, model, round(aic, 6) AS aic, row_number() OVER (PARTITION BY series ORDER BY aic NULLS LAST, model) AS rank FROM m""")
def rank(spark, sf):
    m = _no_baseline(E.forecast_metrics(test_rows(spark, sf), ("series", "model"))).select("series", "model", "aic")
    return rounded(E.rank_nulls_last(m), 6)


@query("top_k", sql="""
SELECT o_custkey, round(sum(o_totalprice), 2) AS importance FROM orders GROUP BY 1 ORDER BY sum(o_totalprice) DESC, o_custkey LIMIT 12""")
def top(spark, sf):
    spent = P.table(spark, sf, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("importance"))
    return rounded(E.top_k(spent, "importance", 12, "o_custkey"), 2)


RUNS = """r AS (SELECT series, model AS metric, dayofyear(week_end_date) % 5 AS run, sqrt(avg((actual - pred) * (actual - pred))) AS value
  FROM ft GROUP BY 1, 2, 3),
s AS (SELECT series, metric, avg(value) AS mean, CASE WHEN count(value) > 1 THEN stddev_samp(value) ELSE 0.0 END AS std,
  count(value) AS n, min(value) AS min, max(value) AS max FROM r GROUP BY 1, 2)"""


def runs(spark, sf):
    """Errors of five interleaved parts of the test rows, standing for repeated runs."""
    fc = test_rows(spark, sf).withColumn("run", F.dayofyear("week_end_date") % 5)
    return fc.groupBy("series", F.col("model").alias("metric"), "run").agg(E.rmse().alias("value"))


@query("repeat_stats", sql=f"""
WITH {FCT}, {RUNS} SELECT series, metric, round(mean, 4) AS mean, round(std, 4) AS std, round(mean - 1.96 * std / sqrt(n), 4) AS ci_lb,
  round(mean + 1.96 * std / sqrt(n), 4) AS ci_ub, round(min, 4) AS min, round(max, 4) AS max FROM s""")
def repeat(spark, sf):
    return rounded(E.repeat_stats(runs(spark, sf)))


@query("compact_summary", sql=f"""
WITH {FCT}, {RUNS} SELECT series, round(max(CASE WHEN metric = 'Random Walk' THEN mean END), 4) AS "Random Walk_mean",
  round(max(CASE WHEN metric = 'Mean4' THEN mean END), 4) AS "Mean4_mean" FROM s GROUP BY 1""")
def compact(spark, sf):
    return rounded(E.compact_summary(E.repeat_stats(runs(spark, sf)), ["Random Walk", "Mean4"]))


@query("union_reports", sql=f"""
WITH {FCT}
SELECT 'accuracy' AS report, series, model, round({RMSE}, 4) AS rmse, round({MAE}, 4) AS mae, CAST(NULL AS DOUBLE) AS directional_accuracy
FROM ft GROUP BY 1, 2, 3
UNION ALL SELECT 'direction', series, model, NULL, NULL, round(avg(CASE WHEN sign(actual) = sign(pred) THEN 1.0 ELSE 0.0 END), 6) FROM ft GROUP BY 1, 2, 3""")
def reports(spark, sf):
    fc, keys = test_rows(spark, sf), ("series", "model")
    both = E.union_reports(accuracy=E.forecast_metrics(fc, keys), direction=E.directional_accuracy(fc, keys))
    return rounded(both, 4, directional_accuracy=6)


@query("group_mean_by_label", sql=f"""
WITH {SEG_MODEL}, l AS (SELECT series, CAST(CASE WHEN abs(diff) > 30000 THEN 1 ELSE 0 END AS INTEGER) AS regime, avg(level) AS label_mean, count(level) AS n_obs
  FROM seg_model GROUP BY 1, 2)
SELECT series, regime, round(label_mean, 4) AS label_mean, n_obs,
  label_mean = max(label_mean) OVER (PARTITION BY series) AS is_stress FROM l""")
def by_label(spark, sf):
    labelled = P.segment_model(spark, sf).withColumn("regime", F.when(F.abs("diff") > 30000, 1).otherwise(0))
    return rounded(E.group_mean_by_label(labelled, "level"))


@query("error_table", sql=f"""
WITH {FCT} SELECT method, series, horizon, week_end_date, split, model, round(actual, 4) AS actual, round(pred, 4) AS pred,
  round(actual - pred, 4) AS residual, round(abs(actual - pred), 4) AS abs_error, sign(actual) = sign(pred) AS correct_direction FROM ft""")
def errors(spark, sf):
    return rounded(E.error_table(test_rows(spark, sf)))


@query("naive_last_level", sql=f"""
WITH {SCALED},
t AS (SELECT series, row_number() OVER w AS rn, count(*) OVER (PARTITION BY series) AS n, lead(scaled_original, 4) OVER w AS last,
  {", ".join(f"lead(scaled_original, {5 + i}) OVER w AS o{i}" for i in range(4))},
  {", ".join(f"lead(scaled_derivative, {4 + i}) OVER w AS d{i}" for i in range(4))} FROM scaled {WIN}),
k AS (SELECT *, rn - 10 AS row, n - 19 AS m FROM t WHERE rn <= n - 9 AND rn > 10),
h AS (SELECT * FROM k WHERE row > floor(CAST(0.8 AS DOUBLE) * m)),
u AS ({" UNION ALL ".join(f"SELECT series, 'level' AS target, o{i} AS actual, last AS pred FROM h UNION ALL SELECT series, 'slope', d{i}, 0 FROM h" for i in range(4))})
SELECT series, target, round({RMSE}, 6) AS rmse FROM u GROUP BY 1, 2""")
def naive_last_level(spark, sf):
    from ..operators.models import naive_last_level as naive

    win = W.chronological_split(W.sliding_windows(smoothed(spark, sf)), ts="row")
    return rounded(naive(win.filter(F.col("split") == "test")), 6)


@query("model_comparison", sql=f"""
WITH {FORECASTS},
c AS (SELECT *, count(CASE WHEN pred IS NOT NULL AND actual IS NOT NULL THEN 1 END) OVER (PARTITION BY series, horizon, week_end_date) AS have FROM fc),
ok AS (SELECT * FROM c WHERE have = 3 AND split = 'test'),
tr AS (SELECT series, count(*) AS n_train FROM seg_model WHERE split = 'train' GROUP BY 1),
m AS (SELECT series, horizon, model, {RMSE} AS rmse, {MAE} AS mae, avg(CASE WHEN sign(actual) = sign(pred) THEN 1.0 ELSE 0.0 END) AS da, count(*) AS n_test
      FROM ok GROUP BY 1, 2, 3),
b AS (SELECT series, horizon, rmse AS base FROM m WHERE model = 'Random Walk')
SELECT m.series, m.horizon, m.model, round(rmse, 4) AS rmse, round(mae, 4) AS mae, round(da, 6) AS directional_accuracy,
  round(100 * (base - rmse) / base, 6) AS improvement_pct, n_train, n_test,
  row_number() OVER (PARTITION BY m.series, m.horizon ORDER BY rmse, m.model) = 1 AS is_winner
FROM m JOIN b ON b.series = m.series AND b.horizon = m.horizon JOIN tr ON tr.series = m.series""")
def comparison(spark, sf):
    from ..operators.models import model_comparison

    model = P.segment_model(spark, sf)
    n_train = model.filter(F.col("split") == "train").groupBy("series").agg(F.count(F.lit(1)).alias("n_train"))
    fc = P.forecast_fixture(model)
    out = model_comparison(fc.filter(F.col("split") == "test"), 3).join(n_train, "series")
    return rounded(out, 6, rmse=4, mae=4)


@query("zero_change_forecast", sql=f"""
WITH {SEG_MODEL} SELECT series, week_end_date, split, round(diff, 4) AS actual, CAST(0 AS DOUBLE) AS pred, round(diff, 4) AS resid FROM seg_model""")
def zero_change(spark, sf):
    from ..operators.models import zero_change_forecast

    fc = zero_change_forecast(P.segment_model(spark, sf), "diff")
    return rounded(fc.select("series", "week_end_date", "split", "actual", "pred", "resid"))
