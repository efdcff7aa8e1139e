"""The n-gram join equals a comparison of all pairs."""

import random
import time
from fractions import Fraction

import numpy as np
import pytest

from panelloom.llm import ngram_join
from panelloom.llm.common import Words, components, numbered
from panelloom.llm.ngram_join import Bands, Lists, jaccard_classes, links_among, signatures, signed

from .helpers import empty, messy, prose


def grams(text, n):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) or frozenset([tuple(words)])


def brute(rows, n, s):
    """(doc_id, size, smallest id reachable) per row; rows without an id or words stay alone."""
    sets = [(d, grams(t, n)) for d, t in rows]
    root = {d: d for d, _ in sets if d is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a is not None and b is not None and x and y and len(x & y) >= s * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return sorted((d is None, d or 0, len(x), -1 if d is None else find(d)) for d, x in sets)


def result(df):
    return sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in df.collect())


def edited(rng, text, edits):
    words = text.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
    return " ".join(words)


def corpus(seed):
    rng = random.Random(seed)
    rows, passage = [], prose(rng, 70, 5000)
    for _ in range(12):
        base = prose(rng, rng.choice([1, 2, 4, 9, 20, 60, 150, 300]), 5000)
        rows.append(base)
        for _ in range(rng.randrange(6)):
            base = edited(rng, base, rng.choice([0, 1, 1, 2, 3, 5])) if rng.random() < 0.7 else base + " " + prose(rng, 2)
            rows.append(base.upper() if rng.random() < 0.2 else base)
    rows += [passage + " " + prose(rng, k, 5000) for k in (3, 5, 8, 12, 20, 30, 40, 400)]
    ids = rng.sample(range(10_000), len(rows))
    return list(zip(ids, rows))


@pytest.mark.parametrize("words,similarity", [(3, "0.9"), (5, "0.8"), (2, "0.5")])
def test_classes_equal_all_pairs(spark, words, similarity):
    rows = corpus(words)
    got = jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"), words, similarity)
    assert result(got) == brute(rows, words, Fraction(similarity))


def test_small_blocks_give_the_same_classes(spark, monkeypatch):
    rows = corpus(17)
    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", 300)
    got = jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"), 3, "0.9")
    assert result(got) == brute(rows, 3, Fraction("0.9"))


def test_messy_rows_and_empty_table(spark):
    df = messy(spark)
    assert result(jaccard_classes(df, 3, "0.9")) == brute([(r.doc_id, r.text) for r in df.collect()], 3, Fraction("0.9"))
    assert jaccard_classes(empty(spark)).collect() == []


def renewed(words, a, b):
    """``words`` with those at a..b replaced."""
    return words[:a] + [f"{w}r" for w in words[a:b]] + words[b:]


@pytest.mark.parametrize("size,longer,changed", [(400, 0, 20), (415, 4, 19)])
def test_a_follower_is_compared_with_each_of_its_leaders(spark, size, longer, changed):
    """The smallest id is linked to the largest alone, which shares most signatures with the other; in one band and across two."""
    x = [f"w{k}" for k in range(size + longer)]
    rows = [(1, " ".join(renewed(x, 0, changed)[:size])), (2, " ".join(renewed(x, 100, 102))), (3, " ".join(x))]
    bands, sets = Bands(Fraction("0.9")), [grams(t, 1) for _, t in rows]
    assert (bands.band(len(sets[0])) == bands.band(len(sets[2]))) == (not longer)
    near = lambda a, b: len(a & b) >= Fraction("0.9") * len(a | b)
    assert near(sets[0], sets[2]) and near(sets[1], sets[2]) and not near(sets[0], sets[1])
    assert result(jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"), 1, "0.9")) == brute(rows, 1, Fraction("0.9"))


def changes():
    """400 words in the order of their hashes, and a function that replaces those at some ranks by words of hashes next to theirs."""
    place = {w: int(Words([w.encode()]).shingles(1)[0][0]) for w in (f"w{k}" for k in range(4000))}
    order = sorted(place, key=place.get)
    return order[::10], lambda x, ranks: [order[10 * r + 1] if r in ranks else w for r, w in enumerate(x)]


def marks(words):
    return set(signatures(Words([" ".join(words).encode()]).shingles(1)[0], Bands(Fraction("0.9"))).tolist())


SOME, OTHERS = [r for r in range(25) if r % 3], [r for r in range(25) if r % 3 == 0]
"""Ranks of words that stand in the same parts."""


def test_what_is_outside_the_wider_ball_may_be_linked_to_what_is_inside(spark):
    """1-2, 2-3 and 3-4 link; 3 is at 0.15 from 1 and 4 at 0.23, and 1 leads all that 3 and 4 share."""
    first, change = changes()
    second = change(first, SOME)
    third = change(second, [399 - r for r in SOME])
    fourth = change(third, OTHERS + [399 - r for r in OTHERS] + [200, 201])
    assert marks(third) & marks(fourth) <= marks(first) and marks(second) & marks(third) - marks(first)
    rows = [(k + 1, " ".join(x)) for k, x in enumerate((first, second, third, fourth))]
    want = brute(rows, 1, Fraction("0.9"))
    assert [r[3] for r in want] == [1] * 4
    assert result(jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"), 1, "0.9")) == want


def test_an_id_of_several_texts_is_as_far_as_its_farthest(spark):
    """2 has a text next to that of 1, and one that alone links to 3; 1 leads all that 2 and 3 share."""
    first, change = changes()
    far = change(first, SOME)
    third = change(far, [*OTHERS, *range(200, 208)])
    assert marks(far) & marks(third) <= marks(first)
    rows = list(zip((1, 2, 2, 3), map(" ".join, (first, change(first, [0]), far, third))))
    want = brute(rows, 1, Fraction("0.9"))
    assert [r[3] for r in want] == [1] * 4
    assert result(jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"), 1, "0.9")) == want


def test_a_search_finds_what_counting_finds():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50)).astype(np.uint64)) for _ in range(80)]
    index = Lists(sets)
    for query in sets[:30]:
        for least in (1, 3, 8, 15, 40):
            docs, overlaps = index.search(query, least)
            want = {i: len(np.intersect1d(query, s)) for i, s in enumerate(sets)}
            assert dict(zip(docs.tolist(), overlaps.tolist())) == {i: n for i, n in want.items() if n >= least}


@pytest.mark.parametrize("similarity", ["0.9", "0.8", "0.6", "0.4"])
def test_links_connect_what_all_pairs_connect(similarity):
    rng, s = np.random.default_rng(2), Fraction(similarity)
    sets = [np.unique(rng.integers(0, 2**63, 40).astype(np.uint64))]
    for _ in range(150):
        x = sets[rng.integers(len(sets))].copy()
        x[rng.integers(0, len(x), rng.integers(0, 4))] = rng.integers(0, 2**63, 1)
        sets.append(np.unique(x))

    def classes(links):
        root = list(range(len(sets)))
        for _ in range(len(sets)):
            for a, b in links:
                root[a] = root[b] = min(root[a], root[b])
        return root

    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if (o := len(np.intersect1d(sets[i], sets[j]))) >= s * (len(sets[i]) + len(sets[j]) - o)]
    assert classes(links_among(list(range(len(sets))), sets, s)) == classes(pairs)


@pytest.mark.parametrize("similarity", ["0.9", "0.8", "0.5"])
def test_similar_sets_share_a_signature(similarity):
    rng, s = np.random.default_rng(3), Fraction(similarity)
    bands = Bands(s)
    for size in (1, 2, 5, 9, 10, 19, 40, 200, 900):
        for _ in range(15):
            x = rng.integers(0, 2**63, size).astype(np.uint64) * np.uint64(2)
            gone, new = rng.integers(0, size // 4 + 1), rng.integers(0, size // 3 + 1)
            y = np.concatenate([x[gone:], rng.integers(0, 2**63, new).astype(np.uint64)])
            x, y = np.unique(x), np.unique(y)
            same = len(np.intersect1d(x, y))
            if len(y) and same >= s * (len(x) + len(y) - same):
                assert set(signatures(x, bands)) & set(signatures(y, bands))


@pytest.mark.parametrize("similarity", ["0.9", "0.8"])
def test_sets_with_too_many_weak_parts_are_cut_again(similarity):
    """Hashes that leave most parts empty: similar sets still meet, and others don't meet in an empty part."""
    rng, s = np.random.default_rng(8), Fraction(similarity)
    bands = Bands(s)
    for size in (19, 40, 200, 900):
        sets = [np.unique(rng.integers(0, 2**40, size).astype(np.uint64)) for _ in range(20)]
        signed = [set(signatures(x, bands)) for x in sets]
        assert not any(signed[i] & signed[j] for i in range(20) for j in range(i))
        for x, own in zip(sets, signed):
            changed = int(len(x) * (1 - s) / (1 + s))
            for y in (np.unique(np.concatenate([x[changed:], x[:changed] + np.uint64(2**63)])), x[: len(x) - changed]):
                same = len(np.intersect1d(x, y))
                if same >= s * (len(x) + len(y) - same):
                    assert own & set(signatures(y, bands))


@pytest.mark.parametrize("similarity", ["0.8", "0.6", "0.9"])
def test_similar_sets_share_as_many_signatures_as_both_need(similarity):
    """The bound by which documents are left out: of the band of the smaller set, partners share at least what either needs."""
    s, rng = Fraction(similarity), np.random.default_rng(5)
    bands, useful = Bands(s), 0
    for size in [*range(1, 30), *range(30, 400, 7)]:
        x = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
        gone = int(rng.integers(0, size - -(-size * s.numerator // s.denominator) + 1))
        y = np.sort(rng.permutation(x)[gone:])
        room = int(len(y) / s) - len(x)
        if room > 0:
            y = np.union1d(y, rng.integers(0, 2**63, int(rng.integers(0, room + 1)), dtype=np.uint64))
        both = len(np.intersect1d(x, y))
        assert Fraction(both, len(x) + len(y) - both) >= s
        parity = bands.band(min(len(x), len(y))) % 2
        (a, needs), (b, wants) = signed(x, bands), signed(y, bands)
        shared = [k for k in set(a.tolist()) & set(b.tolist()) if k % 2 == parity]
        assert len(shared) >= max(needs[parity], wants[parity])
        useful += needs[parity] > 3
    assert useful > 5


def test_documents_that_share_one_passage_are_not_searched(spark, monkeypatch):
    """A chain of documents, each with a passage of the one before: few signatures in common, so no sets are compared."""
    rng, held, searches = random.Random(8), "", []
    rows = []
    for i in range(60):
        fresh = [f"u{rng.randrange(10**9)}" for _ in range(300)]
        rows.append((i, " ".join([held, *fresh]).strip()))
        held = " ".join(fresh[-40:])
    rows.append((100, rows[7][1] + " more"))
    made = ngram_join.durable

    def counted(df):
        out = made(df)
        if df.columns == ["doc", "set", "band"]:
            searches.append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "durable", counted)
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i for i in range(60)} | {100: 7}
    assert searches == [2]


def test_components_of_chains_and_stars(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)] + [(5, 5)]
    root = {x: x for e in edges for x in e}
    for _ in range(300):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    want = {x: r for x, r in root.items() if any(x in e and e[0] != e[1] for e in edges)}
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.root for r in got} == want and len(got) == len(want)
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_numbers_are_gapless_within_a_hot_key(spark):
    rows = [(None if i % 7 == 0 else "hot" if i % 3 else "cold", i % 50) for i in range(3000)]
    got = numbered(spark.createDataFrame(rows, "key string, id long"), "key", ["id"], "at", per_bin=100).collect()
    for key in (None, "hot", "cold"):
        assert sorted(r["at"] for r in got if r["key"] == key) == list(range(sum(k == key for k, _ in rows)))


def test_many_rows_of_one_id_are_searched_once(spark):
    rng = random.Random(21)
    text = prose(rng, 100, 5000)
    rows = [(1, text)] * 2500 + [(2, edited(rng, text, 1))] * 2500 + [(3, prose(rng, 50, 5000))]
    start = time.time()
    got = jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"), 3, "0.9").groupBy("doc_id", "component_id").count().collect()
    assert sorted(tuple(r) for r in got) == [(1, 1, 2500), (2, 1, 2500), (3, 3, 1)] and time.time() - start < 120


@pytest.mark.parametrize("step", [1 << 21, 200])
def test_classes_do_not_depend_on_the_step(spark, monkeypatch, step):
    monkeypatch.setattr(ngram_join, "STEP_BYTES", step)
    rows = corpus(9)
    got = jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"), 3, "0.9")
    assert result(got) == brute(rows, 3, Fraction("0.9"))
