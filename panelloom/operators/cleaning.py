"""Type coercion, de-duplication, unit scaling and imputation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.math import nan_to_null


def coerce_types(df: DataFrame, date: str, value: str, series: str | None = None) -> DataFrame:
    """``(series, ts, value)`` with unreadable dates and values null, NaN included."""
    keys = [F.col(series).cast("string").alias("series")] if series else []
    number = F.expr(f"try_cast(`{value}` AS DOUBLE)")
    return df.select(*keys, F.expr(f"try_cast(`{date}` AS DATE)").alias("ts"),
                     nan_to_null(number).alias("value"))


def dedupe_first(df: DataFrame, keys, ordinal: str, value: str = "value") -> DataFrame:
    """First value per key in ``ordinal`` order.

    A ``min_by`` aggregate, not a ranking window: it combines before the
    shuffle (in a hash aggregate, as value and ordinal are plain numbers), so a
    key holding a large share of the rows costs one partial row per task.
    """
    return df.groupBy(*keys).agg(F.min_by(value, ordinal).alias(value))


def drop_nulls(df: DataFrame, how: str = "any", subset=None) -> DataFrame:
    return df.na.drop(how=how, subset=subset)


# P4: the four rules differ at exactly 50, for negative series and for all-null input.
UNIT_RULES = ("abs_above", "abs_below", "signed_below", "always")


def scale_factor(median_abs: Column, median_signed: Column, rule: str) -> Column:
    """100 where values look like percent, else 1, under one of ``UNIT_RULES``."""
    keep = {
        "abs_above": median_abs > 50,
        "abs_below": ~(median_abs < 50) | median_abs.isNull(),
        "signed_below": ~(median_signed < 50) | median_signed.isNull(),
        "always": F.lit(False),
    }
    if rule not in keep:
        raise ValueError(f"unknown unit rule {rule}; expected one of {UNIT_RULES}")
    return F.when(keep[rule], 1.0).otherwise(100.0)


def auto_unit_scale(panel: DataFrame, column: str, out: str, rule: str = "abs_above",
                    key: str = "series") -> DataFrame:
    """Multiply a series by 100 where its median says percent.

    The median is taken over the series' own window, in the partitioning the
    panel already has, so nothing is broadcast.
    """
    w = Window.partitionBy(key)
    factor = scale_factor(F.median(F.abs(column)).over(w), F.median(column).over(w), rule)
    return panel.withColumn(out, F.col(column) * factor)


def max_abs_scale(df: DataFrame, level: str, slope: str, target: float = 0.9,
                  key: str = "series") -> DataFrame:
    """Scale level and slope by ``target / max(|level|, |slope|)`` of the series (1.0 at zero)."""
    w = Window.partitionBy(key)
    peak = F.max(F.greatest(F.abs(level), F.abs(slope))).over(w)
    return (df.withColumn("scale_factor", target / F.when(peak == 0, 1.0).otherwise(peak))
            .withColumn("scaled_original", F.col(level) * F.col("scale_factor"))
            .withColumn("scaled_derivative", F.col(slope) * F.col("scale_factor")))


def unscale(column: str | Column, factor: str = "scale_factor") -> Column:
    return (F.col(column) if isinstance(column, str) else column) / F.col(factor)


def standardize(df: DataFrame, column: str, out: str, train: Column, keys=("series",)) -> DataFrame:
    """z-score by the population moments of the training rows, applied to all rows."""
    w = Window.partitionBy(*keys)
    seen = F.when(train, F.col(column))
    mean, std = F.avg(seen).over(w), F.stddev_pop(seen).over(w)
    return df.withColumn(out, (F.col(column) - mean) / F.when(std == 0, 1.0).otherwise(std))


def median_impute(df: DataFrame, columns, train: Column, keys=("series",)) -> DataFrame:
    """Replace nulls by the exact training median of their column.

    One aggregate for all columns; its result has one row per key and is
    joined on that key, left to the optimizer's measured sizes.
    """
    medians = df.groupBy(*keys).agg(
        *[F.median(F.when(train, F.col(c))).alias(f"{c}__median") for c in columns])
    joined = df.join(medians, list(keys))
    filled = {c: F.coalesce(F.col(c), F.col(f"{c}__median")) for c in columns}
    return joined.select(*[filled[c].alias(c) if c in filled else F.col(c) for c in df.columns])


def _literal_map(mapping: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])


def relabel(df: DataFrame, column: str, mapping: dict[str, str]) -> DataFrame:
    """Display names; labels without an entry stay as they are."""
    return df.withColumn(column, F.coalesce(_literal_map(mapping)[F.col(column)], F.col(column)))


def forecast_column(model: str | Column) -> Column:
    """The forecast column behind a displayed model name (ordered substring rules)."""
    name = F.lower(F.col(model) if isinstance(model, str) else model)
    return (F.when(name.contains("random walk"), "RW_forecast")
            .when(name.rlike("gjr|garch"), "ARMA_GJR_forecast")
            .when(name.contains("arma"), "ARMA_forecast"))


# A model whose name holds one of these is not a learner.
NOT_LEARNERS = ("arma", "arima", "garch", "random walk", "rw", "selected arma")


def is_ml_model(model: str | Column) -> Column:
    name = F.lower(F.col(model) if isinstance(model, str) else model)
    return ~name.rlike("|".join(NOT_LEARNERS))


def classify_model_name(df: DataFrame, column: str = "model") -> DataFrame:
    return (df.withColumn("forecast_col", forecast_column(column))
            .withColumn("is_ml", is_ml_model(column)))


def reorder_round(df: DataFrame, preferred, digits: int) -> DataFrame:
    """Preferred columns first, then the rest; doubles rounded."""
    order = [c for c in preferred if c in df.columns]
    order += [c for c in df.columns if c not in order]
    doubles = {name for name, kind in df.dtypes if kind == "double"}
    return df.select(*[F.round(c, digits).alias(c) if c in doubles else F.col(c) for c in order])
