"""Writers for result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_table(df: DataFrame, name: str, path: str | None = None) -> None:
    """Overwrite a managed table, or an external one where ``path`` is given."""
    writer = df.write.mode("overwrite").format("parquet")
    if path is not None:
        writer = writer.option("path", path)
    writer.saveAsTable(name)


def forecast_export(static: DataFrame, rolling: DataFrame) -> DataFrame:
    """Static and rolling forecasts in one table, tagged; columns either lacks are null."""
    return (static.withColumn("method", F.lit("Static OOS"))
            .unionByName(rolling.withColumn("method", F.lit("Rolling 1-step")),
                         allowMissingColumns=True))
