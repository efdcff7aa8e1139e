"""Gapless numbers inside keys of any size, counted where the rows are."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import arrow_map, column, durable


def ranked(df: DataFrame, key: str, out: str, total: str | None = None, order: list[str] | None = None) -> DataFrame:
    """``out``: a number from 0 within each ``key``, without gaps; ``total``: the rows of the key.

    Each task numbers its own rows by key; the rows that earlier tasks have of a key are added from a table of counts (a row per
    task and key), so no task holds a key, however large. With ``order`` the rows are range-partitioned and sorted by key and order
    first, and numbers follow that order (nulls first); make its last column unique, so that equal rows can be dealt out too. Else numbers
    follow the tasks. ``key`` isn't null. The numbered rows are a table: lost tasks don't change numbers.
    """
    if order:
        places = [F.col(c).asc_nulls_first() for c in (key, *order)]
        df = df.repartitionByRange(*places).sortWithinPartitions(*places)

    def run(batches):
        task, seen = TaskContext.get().partitionId(), Counter()
        for batch in batches:
            numbers = []
            for k in column(batch, key):
                numbers.append(seen[k])
                seen[k] += 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([task] * len(numbers), pa.int64()), pa.array(numbers, pa.int64())], names=[*batch.schema.names, "__task", "__own"])

    fields = T.StructType([*df.schema.fields, T.StructField("__task", T.LongType()), T.StructField("__own", T.LongType())])
    table = durable(arrow_map(df, run, fields))
    counts = table.groupBy(key, "__task").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(key).orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(key, "__task", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"), F.sum("__n").over(Window.partitionBy(key)).alias("__total"))
    more = [F.col("__total").alias(total)] if total else []
    return table.join(counts, [key, "__task"]).select(*df.columns, (F.col("__before") + F.col("__own")).alias(out), *more)
