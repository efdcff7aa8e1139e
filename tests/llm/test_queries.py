"""Registered queries against their SQL, the toxicity model on held-out rows, and the pipeline stage by stage."""

import random
import zlib
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from panelloom.llm import queries, toxicity
from panelloom.llm.common import DOCUMENT, durable
from panelloom.llm.toxicity import Spoken, ToxicityModel
from tests.oracle import compare, connect

from .helpers import SCHEMA, empty, messy, prose
from .test_join import brute
from .test_text import brute as repeats

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    assert compare(queries.QUERIES[name](spark, SF), connect(SF), queries.ORACLES[name]) == ""


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def labelled(spark, n=1500):
    rng = random.Random(8)
    docs, labels = [], []
    for i in range(n):
        bad = rng.random() < 0.3
        words = prose(rng, rng.randrange(20, 60), 3000).split()
        for _ in range(rng.randrange(1, 4) if bad else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["Grobbel", "gr0bbel", "g-robbel", "vashtig", "VASHTIG!!"]))
        docs.append((i, " ".join(words), "en", "a", 0))
        labels.append((i, int(bad)))
    return spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_is_told_on_held_out_rows(spark):
    docs, labels = labelled(spark)
    fold = F.col("doc_id") % 3 == 1
    model = ToxicityModel.fit(docs, labels.where(~fold), rounds=5)
    got = model.score(docs, ["doc_id"]).join(labels, "doc_id").where(fold).collect()
    assert sum((r.score >= 0.7) == (r.toxic == 1) for r in got) >= 0.98 * len(got)
    assert all(0 <= r.score <= 1 for r in got)
    scored = model.score(messy(spark), ["doc_id", "size"]).collect()
    assert len(scored) == 14 and all(0 <= r.score <= 1 for r in scored)
    assert model.score(empty(spark), ["doc_id"]).collect() == []


def test_toxicity_without_both_labels(spark):
    docs, labels = labelled(spark, 30)
    for some, share in ((labels.where("false"), 0.0), (labels.where("toxic = 1"), 1.0), (labels.where("toxic = 0"), 0.0)):
        assert {r.score for r in ToxicityModel.fit(docs, some).score(docs, ["doc_id"]).collect()} == {share}


def test_hidden_words_are_restored():
    s = Spoken([b"1D10T st*pid 2024 a.b.c", "É ok".encode(), b""])
    words = [(int(d), s.shown[a:b].tobytes().decode()) for d, a, b in zip(s.doc, s.starts, s.ends)]
    assert words == [(0, "idiot"), (0, "stpid"), (0, "abc"), (1, "É"), (1, "ok")]
    assert s.hidden.tolist() == [True, True, True, False, False]


def test_labels_of_the_held_out_fold_are_not_read(spark, tmp_path):
    """Scores stay the same when every label of the held-out fold is turned round; those of the other folds do matter."""
    fold = {r.doc_id: r.fold for r in spark.range(300).select(F.col("id").alias("doc_id")).withColumn("fold", toxicity.fold()).collect()}
    assert all(f == zlib.crc32(str(d).encode()) % 3 for d, f in fold.items())
    docs, labels = labelled(spark, 600)
    for name, turned in (("as", F.lit(False)), ("held", toxicity.fold() == 1), ("others", toxicity.fold() != 1)):
        docs.coalesce(1).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.withColumn("toxic", F.when(turned, 1 - F.col("toxic")).otherwise(F.col("toxic"))).coalesce(1).write.parquet(f"{tmp_path}/{name}/labels.parquet")
    scores = {n: {r.doc_id: (r.held_out, r.score) for r in queries.op4_toxicity(spark, f"{tmp_path}/{n}").collect()} for n in ("as", "held", "others")}
    assert scores["as"] == scores["held"] != scores["others"]
    assert all(held == (fold.get(d, zlib.crc32(str(d).encode()) % 3) == 1) for d, (held, _) in scores["as"].items())


def test_near_copies_leave_one_of_each_class(spark):
    df = messy(spark)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    kept = corpus_pipeline.drop_near_copies(spark, df, SF)
    want = {d for _, _, _, d in brute(rows, 5, Fraction("0.8")) if d != -1}
    got = [r.doc_id for r in kept.collect()]
    assert sorted(d for d in got if d is not None) == sorted(want) and got.count(None) == 2 and kept.columns == DOCUMENT


def test_cut_repeats_keeps_valid_text(spark):
    rng = random.Random(3)
    passage = prose(rng, 80)
    rows = [(1, "alpha " + passage + " omega", "en", "a", 1), (2, "beta " + passage, "en", "a", 2), (3, passage, "en", "a", 3), (4, None, "en", "a", None), (5, "clean", "en", "a", 5)]
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.cut_repeats(spark, spark.createDataFrame(rows, SCHEMA), SF).collect()}
    assert set(got) == {1, 2, 4, 5} and got[5] == ("clean", 5) and got[4] == (None, None)
    want = repeats([r[1].encode() for r in rows[:2]] + [passage.encode()], 200)
    assert [len(got[d][0]) for d in (1, 2)] == [w[0] - w[1] for w in want[:2]] and got[1][1] == len(got[1][0])


def test_pipeline_runs_and_each_stage_takes_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, durable(stage(spark, docs, SF))
        if name != "packing":
            assert docs.columns == DOCUMENT
        if name in ("toxicity", "ngram_jaccard_join", "suffix_dedup"):
            assert 0 < docs.count() <= before.count()
    assert docs.count() == before.count() and {"batch", "slot"} <= set(docs.columns)


def test_pipeline_takes_an_empty_table(spark):
    docs = empty(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs = durable(stage(spark, docs, SF))
    assert docs.count() == 0
