"""Mixing, packing, sharding, token files and exact search against their definitions."""

import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from panelloom.llm import tokens
from panelloom.llm.common import DOCUMENT
from panelloom.llm.mixing import mix_sources, mixed_documents
from panelloom.llm.packing import best_bounds, pack
from panelloom.llm.sharding import shard, shard_bounds
from panelloom.llm.tokens import EliasFano, Encoder, Segment, WordIds, read_tokens, token_folder, write_tokens
from panelloom.llm.topk import top_k

from .helpers import SCHEMA, empty, messy

BPE = public_tokenizers.path("byte_bpe_50k.json")


def shares(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """Targets by resharing the excess until none is above its limit."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: float(weights[i % len(weights)]) for i, s in enumerate(names)}
    target, left = {}, share * sum(sizes.values())
    while names:
        part = {s: left * w[s] / sum(w[x] for x in names) for s in names}
        over = [s for s in names if part[s] > most * sizes[s]]
        if not over:
            return target | part
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
            names.remove(s)
    return target


def test_mix_comes_near_its_targets(spark):
    rng = random.Random(1)
    rows = [(i, " ".join("w" * rng.randrange(1, 5) for _ in range(rng.randrange(120))), "en", rng.choice([None, "a", "a", "a", "a", "é", "zz", "b"]), 0) for i in range(1500)]
    rows += rows[:20]
    got = mix_sources(spark.createDataFrame(rows, SCHEMA)).collect()
    size = Counter()
    for r in rows:
        size[r[3]] += len(r[1].split())
    want, taken, largest = shares(size), Counter(), Counter()
    assert len(got) == len(rows)
    for r in got:
        assert r.source_size == size[r.source] and r.target == pytest.approx(want[r.source]) and r.taken == r.size * r.copies <= 2 * r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], 2 * r.size)
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in size)


def test_mixes_are_nested_and_repeatable(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(i, "w " * rng.randrange(60), "en", rng.choice("abc"), 0) for i in range(400)], SCHEMA)
    small, again, large = ({r.doc_id: r.copies for r in mix_sources(df, share=s).collect()} for s in (0.5, 0.5, 1.2))
    assert small == again and all(large[d] >= n for d, n in small.items() if large[d] or n)


def test_mix_of_messy_rows(spark):
    df = messy(spark)
    got = mix_sources(df).collect()
    assert len(got) == df.count() and all(r.taken <= 2 * r.size for r in got)
    assert len({(r.doc_id, r.size, r.copies) for r in got if r.doc_id == 1}) == 1
    assert mix_sources(empty(spark)).collect() == [] and mixed_documents(empty(spark), DOCUMENT).collect() == []
    plan = Counter()
    for r in got:
        plan[r.doc_id, r.source] += 1 if r.source_size == 0 else r.copies
    assert Counter((r.doc_id, r.source) for r in mixed_documents(df, DOCUMENT).collect()) == +plan


def test_best_bounds_are_optimal():
    rng = random.Random(3)
    for _ in range(60):
        lengths = sorted(rng.sample(range(60), rng.randrange(1, 9)))
        counts = [rng.randrange(1, 20) for _ in lengths]
        buckets = rng.randrange(1, 5)
        cost = lambda b: sum(n * (next(t for t in b if t >= x) - x) for x, n in zip(lengths, counts))
        every = [(*c, lengths[-1]) for k in range(min(buckets, len(lengths))) for c in itertools.combinations(lengths[:-1], k)]
        got = best_bounds(lengths, counts, buckets)
        assert got == sorted(set(got)) and got[-1] == lengths[-1] and len(got) <= buckets
        assert cost(got) == min(map(cost, every))
    assert best_bounds([], [], 3) == []


def test_batches_keep_the_budget(spark):
    rng = random.Random(4)
    rows = [(i, None if i == 0 else int(rng.expovariate(0.02)), "old") for i in range(2000)]
    got = pack(spark.createDataFrame(rows, "id long, length long, slot string"), "length", ["id"], buckets=5, budget=600).collect()
    assert sorted(r.id for r in got) == list(range(2000))
    batches = defaultdict(list)
    for r in got:
        batches[r.batch].append(r)
    assert sorted(batches) == list(range(len(batches)))
    for own in batches.values():
        assert len({(r.bucket, r.bucket_length) for r in own}) == 1 and sorted(r.slot for r in own) == list(range(len(own)))
        assert all(r.length <= r.bucket_length for r in own) and (len(own) * own[0].bucket_length <= 600 or len(own) == 1)
    assert len({r.bucket for r in got}) == 5
    assert pack(spark.createDataFrame([], "id long, length long"), "length", ["id"]).collect() == []


def test_pack_takes_clashing_names(spark):
    df = messy(spark).withColumn("__rank", F.lit(1)).withColumn("__offset", F.lit(2)).withColumn("length", F.length("text").cast("long"))
    got = pack(df, "length", ["doc_id", "text"]).collect()
    assert len(got) == 14 and len({(r.batch, r.slot) for r in got}) == 14 and got[0].size == "size"


def least_largest(sizes, k):
    best = {0: 0}
    for _ in range(k):
        after = {}
        for i, m in best.items():
            total = 0
            for j in range(i, len(sizes) + 1):
                after[j] = min(after.get(j, 10**18), max(m, total))
                total += sizes[j] if j < len(sizes) else 0
        best = after
    return best[len(sizes)]


@pytest.mark.parametrize("hot", [0, 5000])
def test_shards_are_minimax(spark, monkeypatch, hot):
    rng = random.Random(hot + 1)
    keys = sorted({rng.randrange(-(2**63), 2**63) for _ in range(300)} | {7, 8, 9})
    sizes = [rng.randrange(1, 40) + hot * (k == 8) for k in keys]
    cuts = shard_bounds(spark.createDataFrame(list(zip(keys, sizes)), "key long, size long"), 8)
    loads = Counter()
    for k, n in zip(keys, sizes):
        loads[sum(k >= c for c in cuts)] += n
    assert len(cuts) < 8 and cuts == sorted(cuts) and max(loads.values()) == least_largest(sizes, 8)


def test_shards_keep_equal_texts_together(spark):
    rng = random.Random(9)
    rows = [(i, "same" if i % 3 == 0 else f"t{rng.randrange(150)} " * rng.randrange(9), "en", "a", 0) for i in range(900)]
    got = shard(spark.createDataFrame([*rows, (None, None, None, None, None)], SCHEMA)).collect()
    places = defaultdict(list)
    for r in got:
        places[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in places.values()) and len(got) == 901
    text = {r[0]: r[1] for r in rows} | {None: ""}
    assert all(r.size == len(text[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) for r in got)
    homes = defaultdict(set)
    for r in got:
        homes[text[r.doc_id]].add(r.shard)
    assert all(len(h) == 1 for h in homes.values())


def test_shards_of_messy_rows(spark):
    got = shard(messy(spark)).collect()
    assert len(got) == 14 and len({(r.shard, r.slot) for r in got}) == 14
    assert shard(empty(spark)).collect() == []


def test_elias_fano_round_trip():
    rng = np.random.default_rng(1)
    for values in ([], [0], [7], [0, 0, 0], [5] * 700, np.sort(rng.integers(0, 10**9, 3000)), np.arange(2000), np.sort(rng.integers(0, 500, 3000)), [0, 2**40]):
        values = np.array(values, np.uint64)
        data = EliasFano.encode(values)
        coded = EliasFano(data)
        assert coded.all().tolist() == values.tolist()
        assert [coded.get(i) for i in range(0, len(values), 37)] == values[::37].tolist()
        if len(values) > 1000:
            assert len(data) * 8 < len(values) * (3.2 + max(0, np.log2(values[-1] / len(values) + 1)))
    with pytest.raises(IndexError):
        EliasFano(EliasFano.encode(np.array([3], np.uint64))).get(1)


def test_encoder_gives_the_ids_of_the_tokenizer():
    encoder, rng = Encoder(BPE), random.Random(2)
    texts = ["", " ", "a  b", "x\t y", "naïve café's it's we'll 123 a1b2 <|endoftext|> foo<|endoftext|>bar", " lead trail ", "日本 語 ñandú õ, é. ß's", "tab\tsep x\t", "''s 's x's", "µm ªº x", "éte x̀.", "x  y  z"]
    texts += ["".join(rng.choice("ab 's.,!\n\té ñ1<|") for _ in range(rng.randrange(50))) for _ in range(800)]
    want = [e.ids for e in Tokenizer.from_file(BPE).encode_batch(texts, add_special_tokens=False)]
    for _ in range(2):  # the second time from memory
        assert [x.tolist() for x in encoder.encode(texts)] == want


def test_longer_words_and_their_marks_are_encoded_once():
    class Counted:
        calls = 0

        def __init__(self, model):
            self.model = model

        def tokenize(self, piece):
            Counted.calls += 1
            return self.model.tokenize(piece)

    words = WordIds(Tokenizer.from_file(BPE))
    words.model = Counted(words.model)
    whole = Tokenizer.from_file(BPE)
    for word in ["ontiontion", "ontiontion,", "CHEN!!", "CHEN", "abc'd", "a1", "x" * 30 + ";"] * 3:
        assert np.frombuffer(words[word], "<u2").tolist() == whole.encode(" " + word, add_special_tokens=False).ids
    # ontiontion, the comma, CHEN, two exclamation marks and the semicolon once; the long word each time.
    assert Counted.calls == 5 + 3


@pytest.mark.parametrize("change", ["prefix", "lower", "added", "words"])
def test_other_tokenizers_are_not_taken_word_by_word(tmp_path, change):
    """The same vocabulary with another pre-tokenizer, normalizer or added token, and one of another kind."""
    from tokenizers import AddedToken, normalizers, pre_tokenizers

    made = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json") if change == "words" else BPE)
    if change == "prefix":
        made.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=True)
    elif change == "lower":
        made.normalizer = normalizers.Lowercase()
    elif change == "added":
        made.add_tokens([AddedToken("big dog")])
    made.save(str(tmp_path / "t.json"))
    encoder = Encoder(str(tmp_path / "t.json"))
    texts = ["", "A big dog, a Big DOG", "one two  three", "big dogs\n1 2"]
    assert not encoder.word_wise and [x.tolist() for x in encoder.encode(texts)] == [e.ids for e in made.encode_batch(texts, add_special_tokens=False)]
    assert Encoder(BPE).word_wise


@pytest.mark.parametrize("segment", [1 << 21, 50])
def test_token_files_read_back(spark, monkeypatch, segment):
    monkeypatch.setattr(tokens, "SEGMENT_IDS", segment)
    df = messy(spark)
    folder = token_folder(df)
    manifest = write_tokens(df, BPE, folder)
    got = sorted(read_tokens(manifest, folder).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in df.collect()), key=lambda d: (d is not None, d or 0))
    encode, start, own = Tokenizer.from_file(BPE).encode, 0, defaultdict(list)
    for r in df.collect():
        ids = np.array([*encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        own[r.doc_id].append((len(ids), zlib.crc32(ids.tobytes())))
    for r in got:
        assert r.start == start
        start += r.n_tokens
    assert {d: sorted((r.n_tokens, r.ids_crc32) for r in got if r.doc_id == d) for d in own} == {d: sorted(x) for d, x in own.items()}
    assert manifest.agg(F.sum("n_docs")).first()[0] == 14
    nothing = token_folder(df)
    assert read_tokens(write_tokens(empty(spark), BPE, nothing), nothing).collect() == []


def test_segments_give_single_documents():
    documents = [np.arange(n, dtype="<u2") for n in (1, 5, 300, 2)]
    segment = Segment(Segment.encode([None, -4, 9, 9], documents, False))
    assert [segment.doc_id(i) for i in range(4)] == segment.doc_ids() == [None, -4, 9, 9]
    assert [segment.ids(i).tolist() for i in range(4)] == [d.tolist() for d in documents]
    with pytest.raises(ValueError):
        Segment(b"x" * 64)


def best(rows, k=5):
    """(query_id, rank, vec_id, score) by comparing everything; repeated equal query rows count once."""
    q = [(i, [int(np.floor(256 * x)) for x in np.array(v, float)]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, v in {(i, tuple(v)) for i, v in q if i % 50 == 0}:
        scores = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in q if j != i and len(w) == len(v))[:k]
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores)]
    return sorted(out)


@pytest.mark.parametrize("rows_per_shard,rows_per_block", [(8192, 2048), (60, 3)])
def test_search_is_exact(spark, rows_per_shard, rows_per_block):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in np.round(rng.normal(size=8) * rng.choice([0.05, 1]), 2)]) for i in range(400)]
    rows += [(1000 + i, rows[3][1]) for i in range(150)] + [(50, rows[3][1]), (50, rows[50][1]), (60, rows[60][1]), (60, rows[60][1])]
    rows += [(500, None), (501, [None] * 8), (550, [float("nan")] + [0.0] * 7), (551, [float("inf")] * 8), (600, [1.0, 2.0]), (601, [1.0, 1.0]), (650, []), (None, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", F.lit("x")).withColumn("shard", F.lit(1))
    got = top_k(df, lambda i: i % 50 == 0, shard_rows=rows_per_shard, block_rows=rows_per_block)
    as_floats = [(r.vec_id, r.embedding) for r in df.collect()]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect()) == best(as_floats)


def test_search_in_nothing(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert top_k(none, lambda i: i % 50 == 0).collect() == []
    one = spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<float>")
    assert top_k(one, lambda i: i % 50 == 0).collect() == []
