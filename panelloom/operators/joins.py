"""Alignment of series on dates. All joins are equi-joins on keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def panel_to_wide(panel: DataFrame, names, value: str = "value", ts: str = "ts", keys=()) -> DataFrame:
    """One column per named series, every date of any of them (full outer alignment).

    A pivot with given names: one shuffle whatever the number of columns.
    """
    return (panel.filter(F.col("series").isin(list(names)))
            .groupBy(*keys, ts)
            .agg(*[F.max(F.when(F.col("series") == n, F.col(value))).alias(n) for n in names]))


def outer_merge_n(frames, on) -> DataFrame:
    return reduce(lambda left, right: left.join(right, on, "full"), frames)


def inner_merge_n(frames, on) -> DataFrame:
    return reduce(lambda left, right: left.join(right, on, "inner"), frames)


def left_enrich(df: DataFrame, *others: DataFrame, on) -> DataFrame:
    """Left join of regressor tables; sizes are measured at run time, nothing is forced."""
    return reduce(lambda left, right: left.join(right, on, "left"), others, df)


def outer_align_columns(panels, names, value: str = "value", ts: str = "ts") -> DataFrame:
    """Outer column alignment of several panels with the same schema."""
    stacked = reduce(lambda a, b: a.unionByName(b),
                     [p.select("series", ts, F.col(value).alias("value")) for p in panels])
    return panel_to_wide(stacked, names, "value", ts)


def common_index(panel: DataFrame, ts: str = "week_end_date") -> DataFrame:
    """Rows of dates present in every series.

    The list of shared dates has at most one row per calendar date, whatever
    the number of series.
    """
    n_series = panel.agg(F.countDistinct("series")).scalar()
    shared = panel.groupBy(ts).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") == n_series)
    return panel.join(shared.select(ts), ts, "left_semi")


def align_predictions(actual: DataFrame, predictions: DataFrame, on=("series", "week_end_date")) -> DataFrame:
    """Predictions on the index of the actual values, null where missing."""
    return actual.join(predictions, list(on), "left")


def origin_history(observations: DataFrame, origins: DataFrame, inclusive: bool, ts: str = "ts",
                   keys=("series",)) -> DataFrame:
    """Per forecast origin: observations known by then and new since the origin before.

    Observations and origins are merged into one ordered stream per series, so
    a running count replaces the range join. ``inclusive`` decides whether an
    observation on the origin date is already known.
    """
    order = 0 if inclusive else 2
    stream = (observations.select(*keys, ts, F.col("value"), F.lit(order).alias("_rank"))
              .unionByName(origins.select(*keys, ts, F.lit(None).cast("double").alias("value"),
                                          F.lit(1).alias("_rank"))))
    w = Window.partitionBy(*keys).orderBy(ts, "_rank").rowsBetween(Window.unboundedPreceding, 0)
    seen = stream.select("*", F.count("value").over(w).alias("n_known"),
                         F.last("value", ignorenulls=True).over(w).alias("last_value"))
    by_origin = Window.partitionBy(*keys).orderBy(ts)
    return (seen.filter(F.col("_rank") == 1)
            .withColumn("n_new", F.col("n_known") - F.coalesce(F.lag("n_known").over(by_origin), F.lit(0)))
            .select(*keys, ts, "n_known", "n_new", "last_value"))


def lookup_metrics(table: DataFrame, *lookups: DataFrame, on=("series", "model")) -> DataFrame:
    """Attach accuracy, information criteria or notes by key; unmatched rows stay."""
    return left_enrich(table, *lookups, on=list(on))
