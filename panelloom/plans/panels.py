"""Panels drawn from the warehouse tables the registered queries run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.calendar import interpolate_time, resample_week
from ..operators.windows import chronological_split, diff

SEGMENTS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
DRIVERS = ("DISCOUNT", "PRICE", "TAX", "QUANTITY")
FLAGS = ("A", "N", "R")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def day(column: str):
    return F.col(column).cast("date")


def segment_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One series per order priority: mean order price per day."""
    return (table(spark, sf_dir, "orders")
            .groupBy(F.col("o_orderpriority").alias("series"), day("o_orderdate").alias("ts"))
            .agg(F.avg("o_totalprice").alias("value")))


def segment_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample_week(interpolate_time(segment_daily(spark, sf_dir)))


def segment_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly level and change of each segment with the chronological split."""
    changed = diff(segment_weekly(spark, sf_dir), "level", "diff").filter(F.col("diff").isNotNull())
    return chronological_split(changed)


def framed_segment_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The series of the order priorities of every market segment: ``segment|priority``."""
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    daily = (table(spark, sf_dir, "orders").join(customers, "o_custkey")
             .groupBy(F.concat_ws("|", "c_mktsegment", "o_orderpriority").alias("series"), day("o_orderdate").alias("ts"))
             .agg(F.avg("o_totalprice").alias("value")))
    return resample_week(interpolate_time(daily))


def framed_segment_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chronological_split(diff(framed_segment_weekly(spark, sf_dir), "level", "diff").filter(F.col("diff").isNotNull()))


def framed_driver_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The market series of the line items of every market segment: ``segment|name``."""
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("frame"))
    orders = table(spark, sf_dir, "orders").join(customers, "o_custkey").select(F.col("o_orderkey").alias("l_orderkey"), "frame")
    daily = (table(spark, sf_dir, "lineitem").join(orders, "l_orderkey").groupBy("frame", day("l_shipdate").alias("ts"))
             .agg(F.avg("l_discount").alias("DISCOUNT"), F.sum("l_extendedprice").alias("PRICE"),
                  F.avg("l_tax").alias("TAX"), F.sum("l_quantity").alias("QUANTITY")))
    long = daily.unpivot(["frame", "ts"], list(DRIVERS), "name", "value")
    return resample_week(interpolate_time(long.select(F.concat_ws("|", "frame", "name").alias("series"), "ts", "value")), "last")


def with_frame(panel: DataFrame) -> DataFrame:
    """``frame|name`` series as a frame and the series in it."""
    parts = F.split("series", r"\|")
    return panel.withColumn("frame", parts[0]).withColumn("series", parts[1])


def driver_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Market series of the line items by ship date: two means, two sums."""
    daily = (table(spark, sf_dir, "lineitem").groupBy(day("l_shipdate").alias("ts"))
             .agg(F.avg("l_discount").alias("DISCOUNT"), F.sum("l_extendedprice").alias("PRICE"),
                  F.avg("l_tax").alias("TAX"), F.sum("l_quantity").alias("QUANTITY")))
    return daily.unpivot(["ts"], list(DRIVERS), "series", "value").select("series", "ts", "value")


def driver_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last known value per week, as for market variables."""
    return resample_week(interpolate_time(driver_daily(spark, sf_dir)), "last")


def flag_daily_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide table: one date column and a price column per return flag."""
    return (table(spark, sf_dir, "lineitem").groupBy(day("l_shipdate").alias("observation_date"))
            .agg(*[F.avg(F.when(F.col("l_returnflag") == f, F.col("l_extendedprice"))).alias(f"{f}_price")
                   for f in FLAGS]))


def supplier_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Large panel: one series per supplier, mean line price per ship day."""
    return (table(spark, sf_dir, "lineitem")
            .groupBy(F.col("l_suppkey").cast("string").alias("series"), day("l_shipdate").alias("ts"))
            .agg(F.avg("l_extendedprice").alias("value")))


def supplier_flag_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A system of three series per supplier (one per return flag)."""
    return (table(spark, sf_dir, "lineitem")
            .groupBy(F.col("l_suppkey").cast("string").alias("system"),
                     F.col("l_returnflag").alias("flag"), day("l_shipdate").alias("ts"))
            .agg(F.avg("l_extendedprice").alias("value")))


def forecast_fixture(model: DataFrame) -> DataFrame:
    """Long forecast table on the changes that needs no fitted model.

    Random Walk predicts 0, Persistence the change before, Mean4 the mean of
    the four changes before.
    """
    w = Window.partitionBy("series").orderBy("week_end_date")
    before = w.rowsBetween(-4, -1)
    mean4 = F.when(F.count("diff").over(before) == 4, F.avg("diff").over(before))
    named = F.array(
        F.struct(F.lit("Random Walk").alias("model"), F.lit(0.0).alias("pred")),
        F.struct(F.lit("Persistence").alias("model"), F.col("_before").alias("pred")),
        F.struct(F.lit("Mean4").alias("model"), F.col("_mean4").alias("pred")))
    return (model.withColumn("_before", F.lag("diff").over(w)).withColumn("_mean4", mean4)
            .withColumn("_m", F.explode(named))
            .select(F.lit("Rolling 1-step").alias("method"), "series", F.lit(1).alias("horizon"),
                    "week_end_date", "split", "_m.model", F.col("diff").alias("actual"), "_m.pred"))
