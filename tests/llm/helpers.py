"""Rows that every operator must take: nulls everywhere, empty and long texts, ties, repeats, clashing column names."""

import random

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def messy(spark, extra=()):
    rng = random.Random(5)
    base = prose(rng, 90)
    rows = [
        (1, base, "en", "b", 1), (1, base, "en", "b", 1), (2, base + " end", "en", "a", 2), (3, base, None, None, None),
        (4, "", "en", "a", 0), (5, None, "en", "b", None), (6, " \n\t ", None, "c", 3), (None, base, "en", "a", 1), (None, None, None, None, None),
        (7, "One", "en", "", 3), (8, "ONE", "en", "", 3), (9, "é ü \\ < >  x", "fr", "é", 9), (10, prose(rng, 30_000), "en", "b", 1), (11, "a" * 5000, "en", "c", 1),
    ]
    df = spark.createDataFrame([*rows, *extra], SCHEMA)
    # Names that operators use for columns of their own.
    for name in ("size", "n", "key", "set", "sig", "kept", "spans", "hash", "score", "features", "bucket", "shard", "slot", "root", "_h", "turns", "__bin"):
        df = df.withColumn(name, F.lit(name))
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
