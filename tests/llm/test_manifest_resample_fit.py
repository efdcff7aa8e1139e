"""Resampling, the Merkle manifest and best-fit packing against plain loops."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from panelloom.llm import merkle, queries
from panelloom.llm.bestfit import pack_best_fit, plan_best_fit
from panelloom.llm.ranks import ranked
from panelloom.llm.resample import resample
from tests.oracle import compare, connect

from .helpers import SCHEMA, empty, messy

SF = "/root/testdata/sf0.001"
BPE = public_tokenizers.path("byte_bpe_50k.json")
COVERED = ["doc_id", "source", "lang", "n_chars", "text"]


def test_numbers_are_gapless_and_ordered(spark):
    rng = random.Random(1)
    rows = [(rng.choice("aaaab"), rng.randrange(50), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, x long, u long").repartition(7)
    got = ranked(df, "k", "at", "all", order=["x", "u"]).collect()
    for k in "ab":
        own = sorted((r.at, r.x, r.u) for r in got if r.k == k)
        assert [a for a, _, _ in own] == list(range(len(own))) and [r[1:] for r in own] == sorted((x, u) for kk, x, u in rows if kk == k)
        assert {r.all for r in got if r.k == k} == {len(own)}
    plain = Counter((r.k, r.at) for r in ranked(df, "k", "at").collect())
    assert max(plain.values()) == 1 and len(plain) == 3000 and all(0 <= at < sum(r[0] == k for r in rows) for k, at in plain)


def features(text, n_max):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
    return w, [" ".join(w[i : i + n]) for n in range(1, n_max + 1) for i in range(len(w) - n + 1)]


def drawn(docs, target, n_max, buckets=10_000, least=20, percent=10):
    """(id, n_words, n_features, weight, score, rank) with plain loops over whole texts."""
    h = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = (Counter(h(g) for text in texts for g in features(text, n_max)[1]) for texts in ([x for _, x in docs], target))
    S, T = float(s.total()), float(t.total())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (S + buckets) / ((s[b] + 1.0) * (T + buckets))))
    rows = []
    for d, text in docs:
        w, f = features(text, n_max)
        weight = sum(gain(h(g)) for g in f)
        noise = int(sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append((d, len(w), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((noise + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    taken = Counter()
    for place, r in enumerate(able[: percent * len(able) // 100], 1):
        taken[r, place] += 1
    return rows, taken


@pytest.mark.parametrize("n_max", [1, 2, 4])
def test_resampling_equals_plain_loops(spark, n_max):
    rng = random.Random(n_max)
    word = lambda: rng.choice(["w%d" % rng.randrange(60), "É", "日本", "a1"])
    line = lambda: rng.choice([" ", ", ", "  "]).join(word() for _ in range(rng.choice([0, 1, 1, 2, 3, 7, 12])))
    stock = [line() for _ in range(30)]
    text = lambda: "\n".join(rng.choice(stock) if rng.random() < 0.6 else line().upper() for _ in range(rng.randrange(1, 9)))
    rows = [(i, text(), "en", "a", 0) for i in range(250)]
    df = messy(spark, [(i + 100, *r[1:]) for i, r in enumerate(rows)])
    target = [text() for _ in range(20)] + [None, ""]
    docs = [(r.doc_id, r.text) for r in df.collect()]
    got = resample(df, spark.createDataFrame([(t, 1) for t in target], "text string, id int"), n_max=n_max).collect()
    want, taken = drawn(docs, target, n_max)
    assert Counter(tuple(r)[:5] for r in got) == Counter(want)
    assert Counter((tuple(r)[:5], r["rank"]) for r in got if r["rank"]) == taken


def test_resampling_of_and_towards_nothing(spark):
    df, none = messy(spark), spark.createDataFrame([], "text string")
    docs = [(r.doc_id, r.text) for r in df.collect()]
    assert Counter(tuple(r)[:5] for r in resample(df, none).collect()) == Counter(drawn(docs, [], 1)[0])
    assert resample(empty(spark), none).collect() == []


def tree(nodes, arity):
    """All levels of a tree, from its leaves."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha256("".join(levels[-1][i : i + arity]).encode()).hexdigest() for i in range(0, len(levels[-1]), arity)])
    return levels


def path(levels, i, arity):
    out = []
    for level in levels[:-1]:
        a = i // arity * arity
        out.append((level[a:i], level[i + 1 : a + arity]))
        i //= arity
    return out


def leaf(values):
    return sha256("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values).encode()).hexdigest()


def brute_manifest(rows, arity):
    """rows: (doc_id, source, lang, n_chars, text); the whole trees at once."""
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append((r[0] is not None, r[0] or 0, leaf(r), r))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(groups[s], key=lambda x: x[:3])], arity) for s in order}
    top = tree([trees[s][-1][0] for s in order], arity)
    out = []
    for k, s in enumerate(order):
        for i, (_, _, own, r) in enumerate(sorted(groups[s], key=lambda x: x[:3])):
            way = path(trees[s], i, arity) + path(top, k, arity)
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None
            node = leaf((*r[:4], "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[4]))) if bad else own
            for left, right in way:
                node = sha256("".join([*left, node, *right]).encode()).hexdigest()
            proof = sha256("".join(d for left, right in way for d in left + right).encode()).hexdigest()
            out.append((r[0], own, trees[s][-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return out


@pytest.mark.parametrize("arity,depth", [(16, 3), (2, 2), (3, 1)])
def test_manifest_equals_whole_trees(spark, arity, depth):
    rng = random.Random(arity)
    more = [(100 + i if i % 9 else 100, f"T{i % 40} x", "en", rng.choice(["hot"] * 20 + [f"s{j}" for j in range(12)] + ["Ä", "-", "="]), i) for i in range(130)]
    df = messy(spark, more)
    tampered = F.when(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 5 == 0, F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.col("text"))
    got = merkle.manifest(df, COVERED, seen={"text": tampered}, proofs=True, shape=merkle.Shape(arity, depth)).collect()
    want = brute_manifest([tuple(r[c] for c in COVERED) for r in df.collect()], arity)
    assert Counter(tuple(r)[:7] for r in got) == Counter(want)
    assert {r.verified for r in got} == {True, False}
    for r in got:
        assert merkle.folded(r.leaf, list(zip(r.lefts, r.rights))) == r.root


def test_manifest_of_nothing_and_of_one(spark):
    assert merkle.manifest(empty(spark), COVERED).collect() == []
    one = spark.createDataFrame([(1, None, None, None, None)], SCHEMA)
    (r,) = merkle.manifest(one, COVERED).collect()
    assert r.leaf == r.subroot == r.root == leaf((1, None, None, None, None)) and r.proof_sha256 == sha256(b"").hexdigest() and r.verified


def test_manifest_keeps_large_ids(spark):
    rows = [(2**60 + 1, "a", "en", "s", 1), (None, "b", "en", "s", 1)]
    assert {r.doc_id for r in merkle.manifest(spark.createDataFrame(rows, SCHEMA), COVERED).collect()} == {2**60 + 1, None}


def best_fit_one_by_one(lengths, capacity):
    free = []
    for x in sorted(lengths, reverse=True):
        fits = [f for f in free if f >= x]
        if fits:
            free[free.index(min(fits))] -= x
        else:
            free.append(capacity - x)
    return sorted(free)


def test_plan_is_best_fit_over_counts():
    rng = random.Random(2)
    for _ in range(200):
        capacity = rng.randrange(1, 40)
        lengths = [rng.randrange(1, capacity + 1) for _ in range(rng.randrange(120))]
        if rng.random() < 0.3:
            lengths += [rng.randrange(1, capacity + 1)] * 50
        plan = plan_best_fit(dict(Counter(lengths)), capacity)
        ranks, places = defaultdict(list), defaultdict(list)
        for length, low, high, first, per, offset in plan:
            for r in range(low, high):
                ranks[length].append(r)
                places[first + (r - low) // per].append((offset + (r - low) % per * length, length))
        assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in Counter(lengths).items()}
        ends = []
        for own in places.values():
            at = 0
            for offset, length in sorted(own):
                assert offset == at
                at += length
            ends.append(capacity - at)
        assert sorted(places) == list(range(len(places))) and sorted(ends) == best_fit_one_by_one(lengths, capacity)


def test_plan_does_not_grow_with_counts():
    rng = random.Random(3)
    few = {x: rng.randrange(1, 50) for x in range(1, 1025)}
    many = plan_best_fit({x: n * 10**9 for x, n in few.items()}, 1024)
    assert len(many) < 20_000 and sum((b - a) * x for x, a, b, *_ in many) == 10**9 * sum(x * n for x, n in few.items())


@pytest.mark.parametrize("capacity", [1024, 7])
def test_pieces_fill_sequences(spark, capacity):
    rows = [(50 + i, "word " * (i % 23), "en", "a", 0) for i in range(300)]
    df = messy(spark, rows)
    got = pack_best_fit(df, BPE, ["doc_id", "size", "slot"], capacity).collect()
    encode, whole, pieces = Tokenizer.from_file(BPE).encode, defaultdict(Counter), defaultdict(Counter)
    for r in df.collect():
        ids = tuple([*encode(r.text or "", add_special_tokens=False).ids, 2])
        first = (len(ids) - 1) % capacity + 1
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            whole[r.doc_id][k, a, b - a, ids[a:b]] += 1
    sequences = defaultdict(list)
    for r in got:
        pieces[r.doc_id][r.piece, r.start, r.length, tuple(np.frombuffer(r.ids, f"<u{r.width}").tolist())] += 1
        sequences[r.sequence_id].append((r.offset, r.length))
    assert pieces == whole
    for own in sequences.values():
        ends = np.cumsum([n for _, n in sorted(own)])
        assert [o for o, _ in sorted(own)] == [0, *ends[:-1]] and ends[-1] <= capacity
    assert len(sequences) == len(best_fit_one_by_one([r.length for r in got], capacity))


def test_nothing_to_pack_and_clashing_names(spark):
    assert pack_best_fit(empty(spark), BPE).collect() == []
    with pytest.raises(ValueError):
        pack_best_fit(empty(spark).withColumn("ids", F.lit(1)), BPE, ["ids"])


@pytest.mark.parametrize("name", ["op11_resample", "op12_merkle_manifest"])
def test_sql_takes_awkward_rows(spark, tmp_path, name):
    rows = [(i, t, "en", s, 1) for i, (t, s) in enumerate([(None, None), ("", ""), ("ÀB c\n" * 30, "é"), ("Word " * 40, "a"), ("Word " * 40, "a"), ("x", "-")] * 5)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "word b"), (2, None)], "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    con = connect(SF)
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    assert compare(queries.QUERIES[name](spark, str(tmp_path)), con, queries.ORACLES[name]) == ""
