"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

The lexicon is learned: beginnings of words (4 to 8 bytes) that labelled toxic texts hold far more often than others. Words are
lower-cased, letters hidden behind digits or signs are restored, and signs between letters are dropped, before they
are looked up.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, chunks, column, durable, map_texts, prefix_hashes, texts_of

SAMPLE_ROWS = 20_000
"""Most labelled rows that the lexicon, the trees and the calibration are fitted on."""
LEXICON = 400
PREFIXES = (4, 5, 6, 7, 8)
NEAR = 5
FEATURES = ["log_words", "hit_rate", "weight_rate", "log_hits", "top_weight", "log_distinct_hits", "near_you_rate", "you_rate", "capital_rate", "shouted_rate", "mark_rate", "loud_rate", "hidden_rate", "hidden_hit_rate"]

# Words that address the reader in English, German, French and Spanish.
YOU = "you your yours yourself u ur du dich dir dein deine ihr euch euer tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros".split()
# Signs that stand for letters.
HIDDEN = dict(zip("0134578@$", "oieastbas"))
# Signs that are dropped between two letters.
DROPPED = "*._-~"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SHOWN = _LOWER.copy()
for _sign, _letter in HIDDEN.items():
    _SHOWN[ord(_sign)] = ord(_letter)
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[65:91] = _LETTER[128:] = True
_SIGN = np.zeros(256, bool)
_SIGN[[ord(c) for c in HIDDEN]] = True
_DROP = np.zeros(256, bool)
_DROP[[ord(c) for c in DROPPED]] = True
_MARK = np.zeros(256, bool)
_MARK[[c for c in range(33, 127) if not chr(c).isalnum()]] = True


class Spoken:
    """The normalised words of some texts: ``starts`` and ``ends`` in ``shown``, the text of each, and hashes of any part."""

    def __init__(self, texts: list[bytes]):
        raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        ends = np.cumsum(sizes)
        self.raw, self.raw_starts, self.raw_ends = raw, ends - sizes, ends
        letter = _LETTER[raw]
        either = letter | _SIGN[raw]
        before, after = np.concatenate([[False], either[:-1]]), np.concatenate([either[1:], [False]])
        kept = ~(_DROP[raw] & before & after)
        at = np.concatenate([[0], np.cumsum(kept)])
        source = raw[kept]
        self.shown = _SHOWN[source]
        inside = either[kept]
        edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
        starts, stops = edge[::2], edge[1::2]
        letters = np.concatenate([[0], np.cumsum(letter[kept])])
        capitals = np.concatenate([[0], np.cumsum((source >= 65) & (source <= 90))])
        spoken = letters[stops] > letters[starts]  # not numbers alone
        self.starts, self.ends = starts[spoken], stops[spoken]
        self.doc = np.searchsorted(at[self.raw_ends], self.starts, side="right")
        self.letters = letters[self.ends] - letters[self.starts]
        self.capitals = capitals[self.ends] - capitals[self.starts]
        dropped = np.flatnonzero(~kept)
        hides = np.zeros(len(self.starts), bool)
        if len(dropped):
            where = np.searchsorted(self.starts, at[dropped], side="right") - 1
            hides[where[where >= 0]] = True
        self.hidden = hides | (self.letters < self.ends - self.starts)
        self.sums, self.down = prefix_hashes(self.shown)

    def hashes(self, size: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """``(rows, hashes)`` of the words' first ``size`` bytes, for words that have them; of whole words if None."""
        rows = np.arange(len(self.starts)) if size is None else np.flatnonzero(self.ends - self.starts >= size)
        a = self.starts[rows]
        b = self.ends[rows] if size is None else a + size
        return rows, ((self.sums[b] - self.sums[a]) * self.down[a]).view(np.int64)


def hash_of(word: str) -> int:
    sums, down = prefix_hashes(np.frombuffer(word.encode(), np.uint8))
    return int(((sums[-1:] - sums[:1]) * down[:1]).view(np.int64)[0])


def learn_lexicon(sample: DataFrame, text: str = "text", label: str = "toxic", size: int = LEXICON, least: int = 5) -> dict[int, float]:
    """Hash of a word beginning -> log odds, of the ``size`` beginnings that speak most for toxic texts.

    Texts with a beginning are counted inside each task, then summed. ``least``: toxic texts a beginning must occur in.
    """
    def count(batches):
        for batch in batches:
            texts, toxic = texts_of(batch, text), np.array(column(batch, label)) == 1
            for part in chunks(texts):
                spoken, own = Spoken(texts[part]), toxic[part]
                for k in PREFIXES:
                    rows, h = spoken.hashes(k)
                    order = np.lexsort((spoken.doc[rows], h))
                    h, doc = h[order], spoken.doc[rows][order]
                    new = np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]) if len(h) else np.zeros(0, bool)
                    h, doc = h[new], doc[new]
                    each, inverse = np.unique(h, return_inverse=True)
                    bad = np.bincount(inverse, weights=own[doc], minlength=len(each)).astype(np.int64)
                    every = np.bincount(inverse, minlength=len(each)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(each), pa.array(bad), pa.array(every - bad)], names=["h", "bad", "good"])

    counts = arrow_map(sample.select(text, label), count, "h long, bad long, good long").groupBy("h").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    totals = sample.agg(F.coalesce(F.sum(label), F.lit(0)), F.count("*")).first()
    odds = F.log((F.col("bad") + 0.5) / (totals[0] + 1)) - F.log((F.col("good") + 0.5) / (totals[1] - totals[0] + 1))
    best = counts.where(F.col("bad") >= least).withColumn("odds", odds).where("odds > 2").orderBy(F.desc(F.col("odds") * F.sqrt("bad")), "h").limit(size)
    return {r["h"]: float(r["odds"]) for r in best.collect()}


def features(texts: list[bytes], lexicon: dict[int, float]) -> np.ndarray:
    """A row of ``FEATURES`` per text."""
    n = len(texts)
    s = Spoken(texts)
    words = np.bincount(s.doc, minlength=n).astype(float)
    keys = np.array(sorted(lexicon), np.int64)
    weights = np.array([lexicon[k] for k in keys.tolist()])
    weight, entry = np.zeros(len(s.starts)), np.full(len(s.starts), -1)
    for k in PREFIXES if len(keys) else ():
        rows, h = s.hashes(k)
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        found = (keys[at] == h) & (weights[at] > weight[rows])
        weight[rows[found]], entry[rows[found]] = weights[at[found]], at[found]
    hit = entry >= 0
    _, whole = s.hashes()
    you = np.isin(whole, np.array([hash_of(w) for w in YOU]))
    # Words are numbered through all texts; a gap between texts keeps neighbours apart.
    place = np.arange(len(s.starts)) + s.doc * (NEAR + 1)
    yours, near = place[you], np.zeros(len(s.starts), bool)
    if len(yours):
        k = np.searchsorted(yours, place)
        left, right = yours[np.maximum(k - 1, 0)], yours[np.minimum(k, len(yours) - 1)]
        near = hit & (np.minimum(np.abs(place - left), np.abs(place - right)) <= NEAR)
    per = lambda x: np.bincount(s.doc, weights=x, minlength=n)
    top = np.zeros(n)
    np.maximum.at(top, s.doc, weight)
    kinds = np.unique(s.doc[hit].astype(np.int64) * (len(keys) + 1) + entry[hit])
    distinct = np.bincount(kinds // (len(keys) + 1), minlength=n)
    total = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[np.concatenate([[0], s.raw_ends])])
    size, some = np.maximum(s.raw_ends - s.raw_starts - 1, 1), np.maximum(words, 1)
    loud = np.zeros(256, bool)
    loud[[33, 63]] = True
    hits = per(hit)
    return np.column_stack([
        np.log1p(words), hits / some, per(weight) / some, np.log1p(hits), top, np.log1p(distinct), per(near) / some, per(you) / some,
        per(s.capitals) / np.maximum(per(s.letters), 1), per((s.capitals == s.letters) & (s.letters > 1)) / some,
        total(_MARK[s.raw]) / size, total(loud[s.raw]) / size, per(s.hidden) / some, per(s.hidden & hit) / some])


def with_features(df: DataFrame, keep: list[str], lexicon: dict[int, float], text: str = "text") -> DataFrame:
    def run(texts):
        rows = features(texts, lexicon)
        return {"features": pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * len(FEATURES)), pa.array(rows.ravel()))}

    return map_texts(df, run, "features array<double>", keep, text)


class ToxicityModel:
    """Fitted on labelled rows; ``score`` adds a calibrated score to any table of texts.

    ``fit`` takes the ``sample_rows`` labelled rows of least id hash (all, if fewer). Two thirds of them grow the trees;
    the rest, unseen by the trees, calibrate the trees' probability by isotonic regression. Without rows of both labels
    the score is the share of toxic rows (0 without any).
    """

    def __init__(self, lexicon: dict[int, float], trees, calibration, share: float):
        self.lexicon, self.trees, self.calibration, self.share = lexicon, trees, calibration, share

    @classmethod
    def fit(cls, docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, rounds: int = 20, depth: int = 4, seed: int = 7) -> ToxicityModel:
        """``docs`` (doc_id, text), ``labels`` (doc_id, toxic): rows with null ids or labels teach nothing."""
        chosen = labels.where("doc_id is not null and toxic is not null").select("doc_id", F.col("toxic").cast("double").alias("toxic"))
        chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(sample_rows)
        # At most sample_rows rows of two numbers: small enough to send to every task.
        sample = durable(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"))
        n, bad = sample.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0.0))).first()
        if not n or bad in (0, n):
            return cls({}, None, None, bad / n if n else 0.0)
        sample = sample.withColumn("grows", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(3)) > 0)
        lexicon = learn_lexicon(sample.where("grows"))
        rows = durable(with_features(sample, ["toxic", "grows"], lexicon)).withColumn("x", array_to_vector("features")).repartition(6)
        growing = rows.where("grows")
        if growing.agg(F.min("toxic") == F.max("toxic")).first()[0] is not False:
            return cls(lexicon, None, None, bad / n)
        trees = GBTClassifier(featuresCol="x", labelCol="toxic", maxIter=rounds, maxDepth=depth, stepSize=0.2, minInstancesPerNode=10, seed=seed).fit(growing.select("x", "toxic"))
        held = trees.transform(rows.where("not grows")).select(vector_to_array("probability")[1].alias("p"), "toxic")
        if held.isEmpty():
            return cls(lexicon, trees, None, bad / n)
        return cls(lexicon, trees, IsotonicRegression(featuresCol="p", labelCol="toxic", predictionCol="score").fit(held), bad / n)

    def score(self, docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
        """``keep`` and ``score`` (0 to 1) of every whole text, empty and null ones too; rows stay where they are."""
        if self.trees is None:
            return docs.select(*keep, F.lit(float(self.share)).alias("score"))
        found = with_features(docs, keep, self.lexicon, text).withColumn("x", array_to_vector("features"))
        found = self.trees.transform(found).withColumn("p", vector_to_array("probability")[1])
        if self.calibration is None:
            return found.select(*keep, F.col("p").alias("score"))
        return self.calibration.transform(found).select(*keep, F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0)).alias("score"))


def fold(id_column: str = "doc_id"):
    """crc32 of the id as text, modulo 3; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % 3
