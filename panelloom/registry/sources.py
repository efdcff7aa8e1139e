"""Sources, sinks and column discovery."""

from pyspark.sql import functions as F

from ..operators.calendar import resample_week, interpolate_time
from ..plans import panels as P
from ..session import durable, fresh_path
from ..sources import columns as C
from ..sources import sinks, tables
from .base import DRV_WEEKLY, FLAG_WIDE, SEG_DAILY, SEG_MODEL, query, rounded


def _view(spark, sf, table, view):
    P.table(spark, sf, table).createOrReplaceTempView(view)
    return view


@query("read_table", sql="""
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS DATE) AS o_orderdate, o_orderpriority
FROM orders""")
def read_table(spark, sf):
    return tables.read_table(spark, _view(spark, sf, "orders", "src_orders")).withColumn("o_orderdate", P.day("o_orderdate"))


@query("read_csv_fallback", sql=f"WITH {SEG_DAILY} SELECT series, d AS ts, round(value, 4) AS value FROM seg_daily")
def read_csv_fallback(spark, sf):
    path = fresh_path(spark, "fallback")
    sinks.write_csv(P.segment_daily(spark, sf), path)
    raw = tables.read_table(spark, "no_such_table", csv_path=path)
    return rounded(raw.select("series", F.to_date("ts").alias("ts"), F.expr("try_cast(value AS DOUBLE)").alias("value")))


@query("read_csv_na_marker", sql=f"""
WITH {SEG_DAILY} SELECT series, d AS ts, CASE WHEN value <= 300000 THEN round(value, 4) END AS value FROM seg_daily""")
def read_csv_na_marker(spark, sf):
    """One file per series; each is read under its own column name."""
    from functools import reduce

    daily = durable(P.segment_daily(spark, sf))
    text = F.when(F.col("value") <= 300000, F.col("value").cast("string")).otherwise(".")
    read = []
    for name in sorted(r[0] for r in daily.select("series").distinct().collect()):
        path = fresh_path(spark, "marked")
        sinks.write_csv(daily.filter(F.col("series") == name).select(F.col("ts").alias("observation_date"), text.alias(name)), path)
        read.append(tables.read_csv_na_marker(spark, path, name))
    return rounded(reduce(lambda a, b: a.unionByName(b), read))


@query("read_projected", sql="""
SELECT CAST(l_shipdate AS DATE) AS ts, l_discount AS value FROM lineitem
WHERE l_shipdate IS NOT NULL AND l_discount IS NOT NULL""")
def read_projected(spark, sf):
    return tables.read_projected(spark, _view(spark, sf, "lineitem", "src_lineitem"), "l_shipdate", "l_discount")


@query("first_available_source", sql="""
SELECT CAST(o_orderdate AS DATE) AS ts, o_totalprice AS value FROM orders
WHERE o_orderdate IS NOT NULL AND o_totalprice IS NOT NULL""")
def first_available_source(spark, sf):
    _view(spark, sf, "nation", "src_nation")
    _view(spark, sf, "orders", "src_orders")
    return tables.first_available_source(spark, ["missing_table", "src_nation", "src_orders"],
                                         ["observation_date", "O_ORDERDATE"], ["value", "o_totalprice"])


@query("load_profile", sql=f"""
WITH {DRV_WEEKLY}
SELECT series, 'lineitem' AS source, count(level) AS n_obs, min(week_end_date) AS start_date,
       max(week_end_date) AS end_date,
       CASE WHEN median(abs(level)) < 50 THEN 'percent, multiplied by 100'
            ELSE 'already in basis points' END AS scale_note
FROM drv_weekly GROUP BY series""")
def load_profile(spark, sf):
    return tables.load_profile(P.driver_weekly(spark, sf), "lineitem")


@query("write_csv", sql=f"WITH {SEG_DAILY} SELECT series, d AS ts, round(value, 4) AS value FROM seg_daily")
def write_csv(spark, sf):
    path = fresh_path(spark, "report")
    sinks.write_csv(P.segment_daily(spark, sf), path)
    return rounded(spark.read.schema("series string, ts date, value double").csv(path, header=True))


@query("write_table", sql=f"WITH {SEG_DAILY} SELECT series, d AS ts, round(value, 4) AS value FROM seg_daily")
def write_table(spark, sf):
    """Written twice: the second write replaces rows and columns of the first."""
    path = fresh_path(spark, "table")
    name = "loom_" + path.rsplit("-", 1)[1]
    daily = P.segment_daily(spark, sf)
    sinks.write_table(daily.select("series", F.lit(1).alias("old")).distinct(), name, path)
    sinks.write_table(daily, name, path)
    out = spark.read.table(name)
    # The files stay until the scratch folder is released; the catalog keeps nothing.
    spark.sql(f"DROP TABLE {name}")
    return rounded(out)


@query("forecast_export", sql=f"""
WITH {SEG_MODEL},
t AS (SELECT series, week_end_date, diff, rn, n, split, lag(diff) OVER (PARTITION BY series ORDER BY week_end_date) AS pe
      FROM seg_model)
SELECT 'Static OOS' AS method, series, week_end_date, round(diff, 4) AS actual, CAST(0 AS DOUBLE) AS pred,
       CAST(NULL AS DOUBLE) AS sigma FROM t WHERE split = 'test'
UNION ALL
SELECT 'Rolling 1-step', series, week_end_date, round(diff, 4), round(pe, 4), round(abs(pe), 4) FROM t WHERE split = 'test'""")
def forecast_export(spark, sf):
    from ..operators.windows import add_lags

    m = add_lags(P.segment_model(spark, sf), ["diff"]).filter(F.col("split") == "test")
    base = m.select("series", "week_end_date", F.col("diff").alias("actual"), "diff_lag1")
    static = base.select("series", "week_end_date", "actual", F.lit(0.0).alias("pred"))
    rolling = base.select("series", "week_end_date", "actual", F.col("diff_lag1").alias("pred"),
                          F.abs("diff_lag1").alias("sigma"))
    return rounded(sinks.forecast_export(static, rolling))


@query("find_date_column", sql=f"""
WITH {FLAG_WIDE} SELECT observation_date AS date, round(A_price, 4) AS A_price, round(N_price, 4) AS N_price,
  round(R_price, 4) AS R_price FROM flag_wide""")
def find_date_column(spark, sf):
    wide = P.flag_daily_wide(spark, sf)
    return rounded(wide.withColumnRenamed(C.find_date_column(wide), "date"))


@query("find_value_column", sql=f"""
WITH {FLAG_WIDE} SELECT observation_date AS date, round(N_price, 4) AS value FROM flag_wide""")
def find_value_column(spark, sf):
    wide = P.flag_daily_wide(spark, sf)
    date = C.find_date_column(wide)
    value = C.find_value_column(wide, ["NFLAG", "n_pr"], exclude=[date])
    return rounded(wide.select(F.col(date).alias("date"), F.col(value).alias("value")))


@query("first_numeric_column", sql="SELECT o_orderkey, o_orderkey AS value FROM orders")
def first_numeric_column(spark, sf):
    orders = P.table(spark, sf, "orders").select("o_orderstatus", "o_orderpriority", "o_orderkey")
    return orders.select("o_orderkey", F.col(C.first_numeric_column(orders)).alias("value"))


@query("normalize_names", sql=f"""
WITH {FLAG_WIDE} SELECT observation_date AS observationdate, round(A_price, 4) AS aprice, round(N_price, 4) AS nprice,
  round(R_price, 4) AS rprice FROM flag_wide""")
def normalize_names(spark, sf):
    return rounded(C.normalize_columns(P.flag_daily_wide(spark, sf)))


@query("wide_to_panel", sql=f"""
WITH {FLAG_WIDE}
SELECT 'A' AS series, observation_date AS ts, round(A_price, 4) AS value FROM flag_wide
UNION ALL SELECT 'N', observation_date, round(N_price, 4) FROM flag_wide
UNION ALL SELECT 'R', observation_date, round(R_price, 4) FROM flag_wide""")
def wide_to_panel(spark, sf):
    wide = P.flag_daily_wide(spark, sf)
    date = C.find_date_column(wide)
    claimed = C.claim_columns(wide, {"A": ["A_price"], "N": ["n_price"], "R": ["_price"]}, exclude=[date])
    return rounded(C.wide_to_panel(wide, date, claimed))
