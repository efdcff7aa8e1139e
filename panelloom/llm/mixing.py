"""Mixing sources to target weights with hash-threshold histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, durable

BITS = (12, 24, 60)
"""Leading hash bits looked at by the three histograms."""


def word_count(text: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def hash60(*cols: str):
    """60 bits of the MD5 digest of the columns; null counts as empty."""
    joined = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols])
    return F.conv(F.substring(F.md5(joined), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """``(source, source_size, target)``: shares by weight, none above ``most`` times its source's size.

    ``sizes`` has a row per source. Weights repeat over the sources in code point order, null last.
    With sources sorted by limit per weight those that stop at their limit come first, so the common level
    of the others follows from running sums; this is the end point of resharing the excess until none is above.
    """
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = sizes.withColumn("_w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1))
    w = w.withColumn("_cap", F.lit(float(most)) * F.col("source_size")).withColumn("_all", F.lit(float(share)) * F.sum("source_size").over(everything))
    by_limit = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    w = w.withColumn("_rn", F.row_number().over(by_limit))
    before, onward = by_limit.rowsBetween(Window.unboundedPreceding, -1), by_limit.rowsBetween(0, Window.unboundedFollowing)
    w = w.withColumn("_level", (F.col("_all") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(onward))
    first_open = F.min(F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.struct("_rn", "_level"))).over(everything)
    w = w.withColumn("_level", first_open["_level"])
    return w.select("source", "source_size", F.least("_cap", F.coalesce(F.col("_level") * F.col("_w"), F.col("_cap"))).alias("target"))


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, source: str = "source", keep: list[str] = ("doc_id",), text: str = "text", told_by: tuple[str, ...] = ()) -> DataFrame:
    """How many words of each document the mix takes: whole documents, none, once or repeated.

    Every source gets ``floor(target / size)`` rounds of all its documents, and a last round of those whose hash
    lies under a threshold. The threshold comes from a histogram of words by source and leading hash
    bits (summed before the shuffle): the bucket where the running sum meets the budget is the only one looked at again, by
    more bits, until single hashes are left; then the sum nearest to the budget is kept. Nothing is sorted but histogram rows: at
    most 4096 a source, or the few hashes of one bucket in 2**24. A larger budget only raises the threshold, so mixes are nested.

    Returns ``keep``, size, source, source_size, target, taken and copies (times the document is taken). Documents are
    told apart by the columns ``told_by`` (default: ``keep`` and text); equal rows are taken alike. Null text has size 0; null source is
    a source; a document without words is taken 0 words, in as many copies as its hash says. An empty table gives no rows.
    """
    keep = list(keep)
    base = durable(docs.select(*keep, F.col(source).alias("source"), word_count(text).alias("size"), hash60(*(told_by or [*keep, text])).alias("_h")))
    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = durable(source_targets(sizes, weights, share, most))
    rounds = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    state = targets.select(F.col("source").alias("_s"), (F.col("target") - rounds * F.col("source_size")).alias("_need"), F.lit(0).cast("long").alias("_at"))
    width = 0
    for bits in BITS:
        inside = base.join(state, F.col("source").eqNullSafe(F.col("_s")) & (F.shiftright("_h", 60 - width) == F.col("_at")))
        counts = inside.groupBy("_s", "_need", F.shiftright("_h", 60 - bits).alias("_at")).agg(F.sum("size").alias("_n"))
        run = counts.withColumn("_sum", F.sum("_n").over(Window.partitionBy("_s").orderBy("_at")))
        met = run.where("_sum >= _need").withColumn("_rank", F.row_number().over(Window.partitionBy("_s").orderBy("_at"))).where("_rank = 1")
        last = bits == BITS[-1]
        over, short = F.col("_sum") - F.col("_need"), F.col("_need") - (F.col("_sum") - F.col("_n"))
        state = met.select("_s", "_at", over.alias("_over"), short.alias("_need")) if last else met.select("_s", short.alias("_need"), "_at")
        width = bits
    limits = durable(state.select("_s", (F.col("_at") - F.when(F.col("_over") < F.col("_need"), 0).otherwise(1)).alias("_limit")))
    budget = targets.join(limits, F.col("source").eqNullSafe(F.col("_s")), "left").select(F.col("source").alias("_s"), "source_size", "target", rounds.cast("long").alias("_rounds"), F.coalesce("_limit", F.lit(-1)).alias("_limit"))
    out = base.join(budget, F.col("source").eqNullSafe(F.col("_s")))
    copies = (F.col("_rounds") + (F.col("_h") <= F.col("_limit")).cast("long")).cast("long")
    return out.select(*keep, "source", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"))


def mixed_documents(docs: DataFrame, columns: list[str], **options) -> DataFrame:
    """The documents of the mix, each as often as it is taken; a source without words keeps its documents once."""
    keyed = docs.withColumn("_key", F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("doc_id", "text")])))
    plan = mix_sources(keyed, keep=["_key"], told_by=("doc_id", "text"), **options)
    times = plan.groupBy("_key", "source").agg(F.max(F.when(F.col("source_size") == 0, 1).otherwise(F.col("copies"))).alias("_copies")).where("_copies > 0")
    joined = keyed.withColumnRenamed("source", "_source").join(times.withColumnRenamed("source", "_s").withColumnRenamed("_key", "_k"), (F.col("_key") == F.col("_k")) & F.col("_source").eqNullSafe(F.col("_s")))
    repeated = joined.withColumnRenamed("_source", "source").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
    return repeated.select(*columns)
