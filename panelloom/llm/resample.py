"""Importance resampling towards a target: bucketed n-gram counts, learned line by line.

Newlines separate words, so an n-gram lies in one line or runs over line ends. Lines repeat across texts (notices, menus, copies): each
distinct line's features are worked out once and counted as often as the line occurs. N-grams over line ends are counted text by
text, from the words next to the line ends only. The same table of lines gives the weights of texts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable
from .ranks import ranked

APART, WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"
HOT_LINES = 1000
"""A line with more than this part of all occurrences is hot. There are fewer of them than this, whatever the input."""


def lowered(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"{WORD}+"), F.lit(0))


def bucket(feature: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(F.encode(feature, "UTF-8")), F.lit(buckets)).cast("int")


def grams(words: Column, n: int) -> Column:
    """Runs of ``n`` words, joined by a space."""
    if n == 1:
        return words
    last = F.size(words) - n
    some = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.array_join(F.slice(words, i + 1, n), " "))
    return F.when(last >= 0, some).otherwise(F.array().cast("array<string>"))


def over_line_ends(text: Column, n_max: int) -> Column:
    """The n-grams, 2 to ``n_max`` words, that run over line ends.

    Of a line with many words only the first and last ``n_max - 1`` are taken: no such n-gram reaches further into it.
    """
    m = n_max - 1
    middle = rf"(?s)^((?:{APART}*+{WORD}++){{{m}}}{APART}).*({APART}(?:{WORD}++{APART}*+){{{m}}})$"
    edges = F.transform(F.split(text, "\n"), lambda line: words_of(F.regexp_replace(line, middle, "$1$2")))
    placed = F.flatten(F.transform(edges, lambda line, i: F.transform(line, lambda w: F.struct(i.alias("line"), w.alias("word")))))

    def crossing(words: Column, n: int) -> Column:
        ends = F.sequence(F.lit(0), F.greatest(F.size(words) - n, F.lit(0)))
        runs = F.filter(ends, lambda i: (F.size(words) >= n) & (F.get(words, i)["line"] != F.get(words, i + n - 1)["line"]))
        return F.transform(runs, lambda i: F.array_join(F.transform(F.slice(words, i + 1, n), lambda w: w["word"]), " "))

    # The array of words is bound once: all lengths read it.
    return F.flatten(F.flatten(F.transform(F.array(placed), lambda words: F.array(*[crossing(words, n) for n in range(2, n_max + 1)]))))


class Counted:
    """The feature counts of a table of texts.

    ``texts``: number (of the row), the ``keep`` columns, keys (of its lines with words, repeats included) and crossing (buckets of the
    n-grams over line ends). ``lines``: key, times, n_words and features (buckets) of each distinct line. ``histogram``: bucket, n.
    """

    def __init__(self, docs: DataFrame, text: str, keep: list[str], n_max: int, buckets: int):
        whole = lowered(F.coalesce(F.col(text), F.lit("")))
        lines = F.filter(F.split(whole, "\n"), lambda line: line.rlike(WORD))
        crossing = F.transform(over_line_ends(whole, n_max), lambda g: bucket(g, buckets)) if n_max > 1 else F.array().cast("array<int>")
        self.texts = durable(docs.select(F.monotonically_increasing_id().alias("number"), F.struct(*keep).alias("kept"), F.transform(lines, lambda x: F.unhex(F.md5(x))).alias("keys"), crossing.alias("crossing")))
        # The hash aggregate is keyed by the line itself and counts before the shuffle, however hot a line.
        distinct = docs.select(F.explode(lines).alias("line")).groupBy("line").agg(F.count("*").alias("times"))
        parts = distinct.select("line", "times", words_of(F.col("line")).alias("words"))
        features = F.transform(F.concat(*[grams(F.col("words"), n) for n in range(1, n_max + 1)]), lambda g: bucket(g, buckets))
        self.lines = durable(parts.select(F.unhex(F.md5("line")).alias("key"), "times", F.size("words").cast("long").alias("n_words"), features.alias("features")))
        inside = self.lines.select(F.explode("features").alias("bucket"), "times")
        across = self.texts.select(F.explode("crossing").alias("bucket"), F.lit(1).cast("long").alias("times"))
        self.histogram = inside.unionByName(across).groupBy("bucket").agg(F.sum("times").alias("n"))

    def weighed(self, gains: Column) -> DataFrame:
        """number, kept, n_words, n_features and weight of each text: sums over its lines and over its line ends."""
        total = lambda of: F.aggregate(of, F.lit(0).cast("long"), lambda a, b: a + F.get(gains, b))
        lines = durable(self.lines.select("key", "times", "n_words", F.size("features").cast("long").alias("n_features"), total(F.col("features")).alias("weight")))
        values = ["n_words", "n_features", "weight"]
        uses = self.texts.select("number", F.explode("keys").alias("key"))
        # A hot line is in so many texts that its key can't be one partition; the few hot lines go to all tasks.
        least = (lines.agg(F.sum("times")).first()[0] or 0) // HOT_LINES
        hot = lines.where(F.col("times") > least).select("key", F.struct(*values).alias("hot"))
        marked = uses.join(F.broadcast(hot), "key", "left")
        shared = marked.where("hot is not null").select("number", "hot.*")
        usual = marked.where("hot is null").select("number", "key").join(lines.where(F.col("times") <= least).select("key", *values), "key").select("number", *values)
        own = self.texts.select("number", F.lit(0).cast("long").alias("n_words"), F.size("crossing").cast("long").alias("n_features"), total(F.col("crossing")).alias("weight"))
        sums = own.unionByName(shared).unionByName(usual).groupBy("number").agg(*[F.sum(v).alias(v) for v in values])
        return self.texts.select("number", "kept").join(sums, "number")


def log_gains(source: dict[int, int], target: dict[int, int], buckets: int) -> list[int]:
    """floor(1000 ln) of the smoothed share of each bucket in the target over that in the source."""
    S, T = float(sum(source.values())), float(sum(target.values()))
    return [math.floor(1000 * math.log((target.get(b, 0) + 1.0) * (S + buckets) / ((source.get(b, 0) + 1.0) * (T + buckets)))) for b in range(buckets)]


def resample(docs: DataFrame, target: DataFrame, n_max: int = 1, buckets: int = 10_000, seed: int = 2024, least_words: int = 20, percent: int = 10,
             id_column: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """(id, n_words, n_features, weight, score, rank) of every row of ``docs``; a rank means that the row is drawn.

    Features are the runs of 1 to ``n_max`` words, A-Z lower-cased, hashed into ``buckets``. A bucket's gain compares its share in all
    ``target`` texts with that in all ``docs``; a text's weight is the sum of its features' gains. Scores add Gumbel noise that the seed and
    the id give, so the highest ones are a draw without replacement by exp(weight / 1000). Of the texts with at least
    ``least_words`` words, ``percent`` in a hundred (rounded down) are drawn.

    The driver holds two histograms and the gains, at most ``buckets`` rows each. Null texts have no words, weight 0, and aren't drawn
    (nor are those without enough words). Rows of one id, or without one (which counts as an empty id), share their noise; in ties the smaller id
    goes first, null ids last. Repeated rows are rows of their own. An empty target or an empty table of texts is fine.
    """
    counted = Counted(docs.select(F.col(id_column).alias("id"), F.col(text).alias("text")), "text", ["id"], n_max, buckets)
    wanted = Counted(target.select(F.lit(None).alias("id"), F.col(target_text).alias("text")), "text", ["id"], n_max, buckets)
    source, goal = ({r["bucket"]: r["n"] for r in c.histogram.collect()} for c in (counted, wanted))
    gains = F.split(F.lit(",".join(map(str, log_gains(source, goal, buckets)))), ",").cast("array<long>")

    noise = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    gumbel = F.floor(F.lit(-1000.0) * F.log(-F.log((noise + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")
    scored = durable(counted.weighed(gains).select("number", F.col("kept.id").alias("id"), "n_words", "n_features", "weight").withColumn("score", F.col("weight") + gumbel))

    able = scored.where(F.col("n_words") >= least_words)
    drawn = percent * able.count() // 100
    order = able.select("number", F.lit(0).alias("all"), (-F.col("score")).alias("worse"), F.col("id").isNull().alias("unnamed"), "id")
    places = ranked(order, "all", "place", order=["worse", "unnamed", "id", "number"]).where(F.col("place") < drawn)
    out = scored.join(places.select("number", (F.col("place") + 1).alias("rank")), "number", "left")
    return out.select(F.col("id").alias(id_column), "n_words", "n_features", "weight", "score", "rank")
