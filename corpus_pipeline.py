"""The corpus pipeline: each stage's rows are a table that the next one reads.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last
return the columns of ``documents``. ``run`` applies them to ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelloom.llm import mixing, ngram_join, packing, suffix_dedup, toxicity
from panelloom.llm.common import DOCUMENT, durable, read

TOXIC = 0.7
"""Score from which a document is rejected."""


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model doesn't reject; it learns from the labels of the training folds."""
    model = toxicity.ToxicityModel.fit(docs, read(spark, sf_dir, "labels").where(toxicity.fold() != 1))
    return model.score(docs, DOCUMENT).where(F.col("score") < TOXIC).select(*DOCUMENT)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of linked texts: five-word shingles, similarity 0.8 or more; the smallest id stays.

    Rows of one id are one document, of which one row stays; rows without an id all stay.
    """
    classes = durable(ngram_join.jaccard_classes(docs, words=5, similarity="0.8"))
    twice = durable(classes.where("component_id = doc_id").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    gone = classes.where("component_id != doc_id").select("doc_id").unionByName(twice).distinct()
    single, several = docs.join(gone.hint("merge"), "doc_id", "left_anti"), docs.join(twice, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return single.select(*DOCUMENT).unionByName(several.select(*DOCUMENT))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 200 bytes or more that occur again anywhere; those with nothing else are dropped."""
    out = suffix_dedup.remove_repeats(docs, DOCUMENT, characters=True)
    out = out.where((F.octet_length("kept") > 0) | (F.col("n_bytes") == 0))
    text = F.when(F.size("spans") > 0, F.col("kept").cast("string")).otherwise(F.col("text"))
    return out.withColumn("text", text).withColumn("n_chars", F.when(F.size("spans") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*DOCUMENT)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: not at all, once or twice."""
    return mixing.mixed_documents(docs, DOCUMENT)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per document and copy: its source, length, bucket, batch and slot."""
    sized = durable(docs.select("doc_id", "source", mixing.word_count().alias("n_tokens"), F.xxhash64("text").alias("_text")))
    return packing.pack(sized, "n_tokens", ["doc_id", "_text"]).drop("_text")


STAGES = [("toxicity", drop_toxic), ("ngram_jaccard_join", drop_near_copies), ("suffix_dedup", cut_repeats), ("mixing", mix), ("packing", pack)]

# Toxicity scores come from a trained model, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir))
    return docs
