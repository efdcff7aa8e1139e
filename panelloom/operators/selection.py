"""Exact quantiles of keys of any size: ranks are selected by histograms, so no task holds a key's values.

A first pass counts the rows of each key by the magnitude of the value (sixteen buckets a power of two). The bucket of a
wanted rank is then cut evenly into ``CUTS`` parts, again and again, until it holds one value or at most ``few`` rows; only
the counts are shuffled. What is left of a bucket, at most ``few`` rows, is ordered by a window of its own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable

CUTS = 4096
FEW = 10_000
SALTS = 32
"""Tasks over which the rows of one bucket are spread while it is counted."""


def _magnitude(v: Column) -> Column:
    """A whole number that never falls as ``v`` rises; zero has a bucket of its own."""
    size = F.floor(F.log2(F.abs(v)) * 16) + 20_000
    return (F.when(v == 0, 0).when(v == float("inf"), 100_000).when(v == float("-inf"), -100_000)
            .when(v > 0, size).otherwise(-size)).cast("long")


def _histogram(rows: DataFrame, by, bucket: Column) -> DataFrame:
    return (rows.withColumn("_b", bucket).groupBy(*by, "_b")
            .agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")))


def _holding(histogram: DataFrame, by) -> DataFrame:
    """The bucket of each wanted rank: ``_r`` becomes the rank inside it."""
    w = Window.partitionBy(*by, "_r").orderBy("_b")
    counted = histogram.withColumn("_before", F.sum("_n").over(w) - F.col("_n"))
    inside = (F.col("_r") >= F.col("_before")) & (F.col("_r") < F.col("_before") + F.col("_n"))
    return counted.filter(inside).withColumn("_r", F.col("_r") - F.col("_before")).drop("_before")


def select_quantiles(df: DataFrame, columns, quantiles, keys=("series",), few: int = FEW) -> DataFrame:
    """``(*keys, variable, p, n_obs, value)``: interpolated exact quantiles of each column and key.

    Nulls and NaN aren't counted; a column of a key without values has no row, and nor has an empty table. Rows of a
    null key are a key of their own. ``columns`` are names, or a dict of names and expressions. ``df`` is read once for each
    round of narrowing, of which there are at most five after the first: make it a table if it is dear.
    """
    if not quantiles or any(not 0 <= p <= 1 for p in quantiles):
        raise ValueError("quantiles are numbers from 0 to 1")
    named = {c: F.col(c) for c in columns} if not isinstance(columns, dict) else columns
    keys = list(keys)
    # Keys get working names, so that a column of any name can be a key or a value.
    ids = [f"_k{i}" for i in range(len(keys))]
    stacked = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), x.cast("double").alias("v")) for c, x in named.items()]))
    values = (df.select(*[F.col(k).alias(i) for k, i in zip(keys, ids)], stacked.alias("_s"))
              .select(*ids, F.col("_s.c").alias("_c"), (F.col("_s.v") + 0.0).alias("_v")).filter("_v IS NOT NULL AND NOT isnan(_v)"))
    by = [*ids, "_c"]

    first = durable(_histogram(values, by, _magnitude(F.col("_v"))))
    sizes = first.groupBy(*by).agg(F.sum("_n").alias("n_obs"))
    # A quantile lies between two neighbouring ranks.
    place = F.col("p") * (F.col("n_obs") - 1)
    wanted = (sizes.withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in quantiles])))
              .withColumn("_share", place - F.floor(place)))
    ranks = durable(wanted.withColumn("_end", F.explode(F.array(F.floor(place), F.ceil(place))))
                    .withColumnRenamed("_end", "_rank").distinct())
    targets = ranks.select(*by, "_rank", F.col("_rank").alias("_r")).distinct()
    at = _holding(_joined(first, targets, by), [*by, "_rank"])
    found, narrow = [], durable(at)
    while True:
        done = (F.col("_lo") == F.col("_hi")) | (F.col("_r") == 0) | (F.col("_r") == F.col("_n") - 1)
        # The ends of a bucket are known without ordering it.
        found.append(narrow.filter(done).select(*by, "_rank", F.when(F.col("_r") == 0, F.col("_lo")).otherwise(F.col("_hi")).alias("_value")))
        small = F.col("_n") <= few
        found.append(_ordered(values, narrow.filter(~done & small), by))
        wide = narrow.filter(~done & ~small)
        if wide.isEmpty():
            break
        # Halves before they are subtracted: the width of a bucket may not be a double.
        part = (F.col("_v") / 2 - F.col("_lo0") / 2) / (F.col("_hi0") / 2 - F.col("_lo0") / 2)
        inside = _within(values, wide, by, salts=SALTS)
        counts = _histogram(inside, [*by, "_rank", "_r"], F.least(F.floor(part * CUTS), F.lit(CUTS - 1)).cast("long"))
        narrow = durable(_holding(counts, [*by, "_rank"]))
    ends = reduce(lambda a, b: a.unionByName(b), found)
    joined = _joined(ranks, ends, [*by, "_rank"])
    low, high = F.min_by("_value", "_rank"), F.max_by("_value", "_rank")
    out = joined.groupBy(*by, "p", "n_obs", "_share").agg(low.alias("_low"), high.alias("_high"))
    value = F.when(F.col("_low") == F.col("_high"), F.col("_low")).otherwise((1 - F.col("_share")) * F.col("_low") + F.col("_share") * F.col("_high"))
    return out.select(*[F.col(i).alias(k) for i, k in zip(ids, keys)], F.col("_c").alias("variable"), "p", "n_obs", value.alias("value"))


def _joined(left: DataFrame, right: DataFrame, by) -> DataFrame:
    """Inner join in which null keys are equal."""
    renamed = right.select(*[F.col(c).alias(f"_j{c}") if c in by else F.col(c) for c in right.columns])
    both = left.join(renamed, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_j{c}")) for c in by]))
    return both.drop(*[f"_j{c}" for c in by])


def _within(values: DataFrame, buckets: DataFrame, by, salts: int) -> DataFrame:
    """Values that lie in a bucket of their key, once for each rank that asks for it.

    The few buckets are repeated for each salt and a key's rows are salted by value and source partition, so a key, or one
    value of it, that has most rows is joined by many tasks.
    """
    # The magnitude is part of the key of the join: rows far from every wanted rank meet nothing.
    asked = (buckets.withColumnsRenamed({"_lo": "_lo0", "_hi": "_hi0"}).select(*by, "_rank", "_r", "_lo0", "_hi0")
             .withColumn("_m", _magnitude(F.col("_lo0"))).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))))
    salted = (values.withColumn("_m", _magnitude(F.col("_v")))
              .withColumn("_salt", F.pmod(F.xxhash64("_v", F.spark_partition_id()), F.lit(salts)).cast("int")))
    return _joined(salted, asked, [*by, "_m", "_salt"]).filter("_v BETWEEN _lo0 AND _hi0")


def _ordered(values: DataFrame, buckets: DataFrame, by) -> DataFrame:
    """The value at the wanted rank of buckets of few rows."""
    counted = _within(values, buckets, by, salts=1).groupBy(*by, "_rank", "_r", "_v").agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*by, "_rank").orderBy("_v"))
    hit = counted.withColumn("_upto", upto).filter("_r < _upto AND _r >= _upto - _n")
    return hit.select(*by, "_rank", F.col("_v").alias("_value"))


def quartiles(df: DataFrame, columns, keys=("series",), few: int = FEW) -> DataFrame:
    """Count, extremes and quartiles of each column and key, one row each; every value exact."""
    names = {0.0: "min", 0.25: "p25", 0.5: "median", 0.75: "p75", 1.0: "max"}
    long = select_quantiles(df, columns, list(names), keys, few)
    return long.groupBy(*keys, "variable").agg(F.max("n_obs").alias("n_obs"), *[F.max(F.when(F.col("p") == p, F.col("value"))).alias(n) for p, n in names.items()])


def impute_selected(df: DataFrame, columns, train: Column, keys=("series",), few: int = FEW) -> DataFrame:
    """Nulls replaced by the exact training median of their column, for keys of any size.

    A column of a key without training values stays null; every row is kept.
    """
    if not columns:
        return df
    medians = select_quantiles(df.filter(train), columns, [0.5], keys, few)
    wide = medians.groupBy(*keys).agg(*[F.max(F.when(F.col("variable") == c, F.col("value"))).alias(f"_median_{i}") for i, c in enumerate(columns)])
    renamed = wide.select(*[F.col(k).alias(f"_j{k}") for k in keys], *[f"_median_{i}" for i in range(len(columns))])
    # One row per key; a hot key's rows are split by adaptive execution.
    both = df.join(renamed, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_j{k}")) for k in keys]), "left")
    place = {c: i for i, c in enumerate(columns)}
    return both.select(*[F.coalesce(F.col(c), F.col(f"_median_{place[c]}")).alias(c) if c in place else F.col(c) for c in df.columns])
