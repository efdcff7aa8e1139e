"""Catalog tables and delimited files as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .columns import pick_existing_column


def read_csv(spark: SparkSession, path: str, na_marker: str = "") -> DataFrame:
    """Headed CSV with every column as text; no inference pass."""
    return spark.read.csv(path, header=True, inferSchema=False, nullValue=na_marker)


def read_table(spark: SparkSession, name: str, csv_path: str | None = None) -> DataFrame:
    """A catalog table, or the CSV standing in for it where it does not exist."""
    if spark.catalog.tableExists(name):
        return spark.read.table(name)
    return read_csv(spark, csv_path or f"{name}.csv")


def read_csv_na_marker(spark: SparkSession, path: str, series: str, marker: str = ".") -> DataFrame:
    """Two-column CSV: first column the date, second the value, ``marker`` missing."""
    raw = read_csv(spark, path, marker)
    date, value = raw.columns[:2]
    return raw.select(
        F.lit(series).alias("series"),
        F.to_date(F.col(f"`{date}`")).alias("ts"),
        F.expr(f"try_cast(`{value}` AS DOUBLE)").alias("value"),
    )


def read_projected(spark: SparkSession, name: str, date_column: str, value_column: str) -> DataFrame:
    """Only date and value, null rows dropped; both reach the scan."""
    return _project(spark.read.table(name), date_column, value_column)


def _project(df: DataFrame, date_column: str, value_column: str) -> DataFrame:
    kept = df.select(F.col(f"`{date_column}`").alias("ts"), F.col(f"`{value_column}`").alias("value"))
    return (kept.na.drop()
            .select(F.to_date("ts").alias("ts"), F.expr("try_cast(value AS DOUBLE)").alias("value"))
            .na.drop())


def first_available_source(spark: SparkSession, tables, date_candidates, value_candidates,
                           csv_path: str | None = None) -> DataFrame | None:
    """First existing table with usable columns, else the file, else ``None``.

    Only the catalog is asked; no probe job runs.
    """
    for name in tables:
        if not spark.catalog.tableExists(name):
            continue
        df = spark.read.table(name)
        date = pick_existing_column(df.columns, date_candidates)
        value = pick_existing_column(df.columns, value_candidates)
        if date and value:
            return _project(df, date, value)
    if csv_path is None:
        return None
    return read_csv_na_marker(spark, csv_path, "value").drop("series").na.drop()


def load_profile(panel: DataFrame, source: str, unit_rule: str = "abs_below") -> DataFrame:
    """Per series: rows, first and last date, source column and a note on its scale."""
    from ..operators.cleaning import scale_factor

    return (panel.groupBy("series")
            .agg(F.count("level").alias("n_obs"), F.min("week_end_date").alias("start_date"),
                 F.max("week_end_date").alias("end_date"),
                 scale_factor(F.median(F.abs("level")), F.median("level"), unit_rule).alias("factor"))
            .select("series", F.lit(source).alias("source"), "n_obs", "start_date", "end_date",
                    F.when(F.col("factor") == 100.0, "percent, multiplied by 100")
                    .otherwise("already in basis points").alias("scale_note")))
