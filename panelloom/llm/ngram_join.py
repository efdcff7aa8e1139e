"""N-gram Jaccard join: T-occurrence search (DivideSkip) over word shingles, and the classes of linked documents.

How partners meet without a list per shingle. Two sets of a and b shingles with Jaccard similarity s or more differ in at most
D = (a + b)(1 - s)/(1 + s) shingles. Cut the range of shingle hashes into D + 1 + m parts: at least 1 + m parts hold the
same shingles in both sets. The hash of a part's content is a signature; documents that share one are candidates. Parts with few
shingles say little and are left out: if one of two partners has at most m such parts, another part is still among those
they share. A document with more of them cuts a second time, by other hashes, and so on: partners that both have too many
meet there. The chance falls by the same factor each time, so that hardly any document gets to the last cut, where all parts
count. D depends on sizes, so a document uses the cuts of its own size band and of the one below. No pair is lost.

How chance meetings are told apart without comparing. The same count bounds from below how many signatures partners share: all
parts, but those that their own sizes let differ, and those that are left out. A document that has fewer signatures in common with
all others together has no partner; without it others have fewer too, and so on.

How links are found without all pairs. Jaccard distance obeys the triangle inequality. A search from a leader finds all within
twice the allowed distance; what is linked to the leader, and too near to it to reach anything outside its ball, is done.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable
from fractions import Fraction
from hashlib import blake2b
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, arrow_map, chunks, column, components, discard, durable, lists, mix64, texts_of

PROBE = 0.05
"""Cost of a binary probe (made in bulk) against that of a step of the heap merge: what decides how many lists are set apart."""
BLOCK_SHINGLES = 1 << 19
"""Shingles of the documents that one search looks at together."""
STEP_BYTES = 1 << 18
"""Text bytes whose shingles are formed together."""
ROUNDS = 4
"""Times that documents with too few shared signatures are taken out: each time, signatures only they shared go too."""
CUTS = 6
"""Times that a document with too many weak parts is cut by other hashes before its weak parts count."""
EPS = 1e-9


class Bands:
    """Size bands and the cuts of each: what follows from the similarity alone."""

    def __init__(self, similarity: Fraction):
        self.s = similarity
        self.edges = [1]
        self.known: dict[int, tuple[np.ndarray, int, int, int]] = {}

    def band(self, size: int) -> int:
        while self.edges[-1] <= size:
            self.edges.append(math.floor(self.edges[-1] / self.s) + 1)
        return next(i for i in range(len(self.edges) - 1, -1, -1) if self.edges[i] <= size)

    def cuts(self, band: int) -> tuple[np.ndarray, int, int, int]:
        """``(bounds, weak, slack, times)``: hash bounds of the parts, the count under which a part is weak, m, and how often a set is cut.

        At similarities so low that a set of the band can't fill enough parts, one cut with all its parts is made.
        """
        if band in self.known:
            return self.known[band]
        low, high = self.edges[band], math.floor(self.edges[band] / self.s)
        differ = math.floor((high + math.floor(high / self.s)) * (1 - self.s) / (1 + self.s))
        weak = 3 if differ >= 20 and low >= 6 * (differ + 1) else 1
        slack = 0
        for _ in range(4):
            mean = low / (differ + 1 + slack)
            share = sum(math.exp(-mean) * mean**k / math.factorial(k) for k in range(weak))
            expected = share * (differ + 1 + slack)
            slack = min(differ + 1, math.ceil(expected + 3 * math.sqrt(expected)))
        parts = differ + 1 + slack
        self.known[band] = np.array([k * 2**64 // parts for k in range(1, parts)], np.uint64), weak, slack, 1 if parts - low > slack else CUTS
        return self.known[band]


def signed(shingles: np.ndarray, bands: Bands) -> tuple[np.ndarray, list[int]]:
    """Signatures of one set (sorted hashes), under the cuts of its band and of the band below; and how many partners share at least.

    A signature's last bit is that of its band. The second value is indexed by it: two sets of the similarity whose smaller one is of
    that band share so many signatures of that band.
    """
    if not len(shingles):
        return np.zeros(0, np.int64), [1, 1]
    n, own = len(shingles), bands.band(len(shingles))
    out, least = [], [1, 1]
    for band in (own, own - 1) if own else (own,):
        bounds, weak, slack, times = bands.cuts(band)
        # The largest partner: as large as the similarity allows, or the last one of the band below.
        largest = math.floor(n / bands.s) if band == own else bands.edges[own] - 1
        sure = len(bounds) + 1 - math.floor((n + largest) * (1 - bands.s) / (1 + bands.s))
        for cut in range(times):
            hashes = np.sort(mix64(shingles + np.uint64(cut))) if cut else shingles
            sums = np.zeros(len(hashes) + 1, np.uint64)
            np.cumsum(mix64(hashes ^ np.uint64(0xA0761D6478BD642F)), out=sums[1:])
            at = np.concatenate([[0], np.searchsorted(hashes, bounds), [len(hashes)]])
            counts = np.diff(at)
            place = np.arange(len(counts), dtype=np.uint64) * np.uint64(2**20) + np.uint64(cut * 2**50 + band)
            made = mix64(sums[at[1:]] - sums[at[:-1]] + mix64(place) + counts.astype(np.uint64))
            made = made & ~np.uint64(1) | np.uint64(band % 2)
            faint = counts < weak
            few = faint.sum() <= slack
            out.append(made if cut == times - 1 and not few else made[~faint])
            if not cut:
                # All partners have made the first cut too; later ones only if their own parts are too weak before.
                least[band % 2] = max(1, sure - (int(faint.sum()) if few else slack))
            if few:
                break
    return np.concatenate(out).view(np.int64), least


def signatures(shingles: np.ndarray, bands: Bands) -> np.ndarray:
    return signed(shingles, bands)[0]


class Lists:
    """Inverted lists of some sets: for each shingle the ascending indices of the sets that have it."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(flat, kind="stable")
        flat, self.docs = flat[order], owner[order]
        self.keys, self.starts, self.lengths = np.unique(flat, return_index=True, return_counts=True)
        # List number and document in one integer: a binary probe of any list is a search in this array.
        self.places = np.repeat(np.arange(len(self.keys)), self.lengths) * len(sets) + self.docs

    def search(self, query: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """``(docs, overlaps)`` of the sets that share at least ``least`` shingles with the query.

        DivideSkip: the L longest lists are set apart; the others are merged with a heap, and a set that occurs in ``least - L`` of
        them is looked up in the long ones by binary search. L is the one of least estimated cost.
        """
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.keys, query), len(self.keys) - 1)
        own = at[self.keys[at] == query]
        least = max(least, 1)
        if len(own) < least:
            return none
        own = own[np.argsort(self.lengths[own], kind="stable")]
        # Merging the k shortest lists takes as many steps as they have entries, and leaves at most steps / need sets to probe.
        k = np.arange(len(own) - least + 1, len(own) + 1)
        steps, need = np.cumsum(self.lengths[own])[k - 1], least - len(own) + k
        apart = len(own) - int(k[np.argmin(steps * (1 + PROBE * (len(own) - k) / need))])
        short, long = own[: len(own) - apart], own[len(own) - apart :]
        runs = [self.docs[a : a + n].tolist() for a, n in zip(self.starts[short].tolist(), self.lengths[short].tolist())]
        found = [(d, k) for d, k in ((d, sum(1 for _ in g)) for d, g in groupby(heapq.merge(*runs))) if k >= least - apart]
        if not found:
            return none
        docs, counts = map(np.array, zip(*found))
        if len(long):
            for some in range(0, len(docs), 4096):
                wanted = long[:, None] * len(self.sizes) + docs[None, some : some + 4096]
                place = np.minimum(np.searchsorted(self.places, wanted), len(self.places) - 1)
                counts[some : some + 4096] += (self.places[place] == wanted).sum(axis=0)
        enough = counts >= least
        return docs[enough], counts[enough]


def distances(index: Lists, query: np.ndarray, similarity: Fraction) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(docs, overlaps, distance)`` of the sets of at least this similarity to the query."""
    # The overlap that a partner of the least possible size needs.
    smallest = max(math.ceil(similarity * len(query)), int(index.sizes.min()))
    docs, overlap = index.search(query, math.ceil(similarity * (len(query) + smallest) / (1 + similarity)))
    union = len(query) + index.sizes[docs] - overlap
    near = overlap * similarity.denominator >= union * similarity.numerator
    docs, overlap, union = docs[near], overlap[near], union[near]
    return docs, overlap, 1 - overlap / np.maximum(union, 1)


def links_among(ids: list[int], sets: list[np.ndarray], similarity: Fraction, classes: list[int] | None = None) -> list[tuple[int, int]]:
    """Links that join all sets which chains of similar sets join: a spanning forest, so fewer links than sets.

    ``classes``: sets of one class are known to be joined already.

    Sets that share most with all others search first. Two things spare searches. Links between classes are found from
    either side, so members of the largest class need none once all others have searched. And what is so
    near to a leader that nothing outside the leader's ball is in its reach is done.
    """
    wider = max(2 * similarity - 1, Fraction(1, 10**6))
    reach = float(1 - similarity)
    n, out = len(ids), []
    index, members = Lists(sets), np.arange(n)
    shared = np.bincount(np.repeat(np.arange(n), index.sizes), weights=index.lengths[np.searchsorted(index.keys, np.concatenate(sets))], minlength=n)
    gone, root, size = np.zeros(n, bool), np.arange(n), np.ones(n, np.int64)
    if classes is not None:
        _, first, inverse = np.unique(np.array(classes), return_index=True, return_inverse=True)
        root = first[inverse]
        size = np.bincount(root, minlength=n)
    waiting = np.argsort(-shared, kind="stable")
    while len(waiting):
        largest = int(np.argmax(size))
        outside = root[waiting] != largest
        if not outside.any():
            # Whatever is outside the largest class has searched: no link into it is left to find.
            break
        leader = int(waiting[np.argmax(outside)]) if size[largest] > 1 else int(waiting[0])
        waiting = waiting[waiting != leader]
        # Most sets have no partner: the wider search is for those that have, to know what lies just outside their ball.
        docs, _, far = distances(index, sets[leader], similarity)
        if len(docs) > 1:
            docs, _, far = distances(index, sets[leader], wider)
        docs = members[docs]
        other = (docs != leader) & ~gone[docs]
        docs, far = docs[other], far[other]
        ball = far <= reach + EPS
        for d in docs[ball].tolist():
            a, b = root[leader], root[d]
            if a != b:
                out.append((ids[leader], ids[d]))
                root[root == b] = a
                size[a], size[b] = size[a] + size[b], 0
        shell = far[~ball].min() if (~ball).any() else (2.0 if wider > Fraction(1, 10**6) else reach)
        gone[docs[ball & (far < shell - reach - EPS)]] = True
        gone[leader] = True
        waiting = waiting[~gone[waiting]]
        if 2 * (~gone[members]).sum() < len(members) > 64 and not gone.all():
            members = np.flatnonzero(~gone)
            index = Lists([sets[m] for m in members])
    return out


def shingle_table(docs: DataFrame, words: int, id_column: str, text: str, bands: Bands) -> DataFrame:
    """``(doc_id, set, band)`` of each document, words lower-cased (A-Z)."""
    def run(batches):
        for batch in batches:
            texts, ids = texts_of(batch, text), batch.column(batch.schema.get_field_index("doc_id"))
            for part in chunks(texts, STEP_BYTES):
                sets = Words(texts[part], lower=True).shingles(words)
                yield pa.RecordBatch.from_arrays([ids.slice(part.start, part.stop - part.start), lists([s.view(np.int64) for s in sets], pa.int64()), pa.array([bands.band(len(s)) if len(s) else -1 for s in sets], pa.int32())], names=["doc_id", "set", "band"])

    return arrow_map(docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias(text)), run, "doc_id long, set array<long>, band int")


def grouped_rows(batches, keys: list[str], more: list[str] = ()):
    """Rows (doc, *more, set) of consecutive equal keys, repeated ones once; sets come as sorted unsigned arrays."""
    def rows():
        for batch in batches:
            sets = batch.column(batch.schema.get_field_index("set"))
            offsets, flat = sets.offsets.to_numpy(), sets.values.to_numpy(zero_copy_only=False).view(np.uint64)
            others = [column(batch, c) for c in [*keys, "doc", *more]]
            for k, row in enumerate(zip(*others)):
                yield row[: len(keys)], (*row[len(keys) :], flat[offsets[k] : offsets[k + 1]].copy())

    for key, group in groupby(rows(), key=lambda r: r[0]):
        known, own = set(), []
        for _, r in group:
            mark = (r[0], blake2b(r[-1].tobytes(), digest_size=16).digest())
            if mark not in known:
                known.add(mark)
                own.append(r)
        yield key, own
        del own
        pa.default_memory_pool().release_unused()


def jaccard_classes(docs: DataFrame, words: int = 5, similarity: str = "0.8", id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for every row of ``docs``: its set size and the class of linked documents.

    Two documents link when the Jaccard similarity of their sets of ``words``-word shingles is at least ``similarity`` (exactly: a
    rational comparison of counts). A text of fewer words is one shingle; null and wordless texts have none and link with nothing.
    ``component_id`` is the smallest id reachable by links.

    1. Equal sets are one: the smallest id stands for them. 2. Signatures, aggregated before the shuffle, give each shared
    one a leader, its smallest id. 3. Leaders search their followers in blocks of bounded size, each follower with its leader of most
    signatures, and with every other leader that isn't of its class by then. 4. Signatures whose followers aren't
    all connected by then are searched again among those that the distances to the leader leave open, in one
    block or in pairs of blocks. Tables and columns only hold ids, counts and sets; every task holds one block.

    Rows of one id are one document (linked by any of its texts). Null ids give a null component and take no part. Repeated rows
    are returned each. An empty table gives no rows.
    """
    s = Fraction(similarity)
    bands = Bands(s)

    def sketch(sign: bool):
        def run(batches):
            for batch in batches:
                texts, ids = texts_of(batch, text), batch.column(batch.schema.get_field_index("doc_id"))
                for part in chunks(texts, STEP_BYTES):
                    sets = Words(texts[part], lower=True).shingles(words)
                    first = [int(mix64(x ^ np.uint64(0xE7037ED1A0B428DB)).sum(dtype=np.uint64)) for x in sets]
                    second = [int(mix64(x * np.uint64(0x8EBC6AF09C88C6E3)).sum(dtype=np.uint64)) for x in sets]
                    cols = [ids.slice(part.start, part.stop - part.start), pa.array([len(x) for x in sets], pa.int64()),
                            pa.array(np.array(first, np.uint64).view(np.int64)), pa.array(np.array(second, np.uint64).view(np.int64))]
                    if sign:
                        made = [signed(x, bands) for x in sets]
                        cols += [lists([m for m, _ in made], pa.int64()), *[pa.array([least[k] for _, least in made], pa.int64()) for k in (0, 1)]]
                    yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n", "k1", "k2", "signatures", "least0", "least1"][: len(cols)])
        return run

    # Texts are hashed twice, so that no table holds the signatures of copies.
    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text))
    fields = "doc_id long, n long, k1 long, k2 long"
    table = durable(arrow_map(texts, sketch(False), fields))
    marked = arrow_map(texts, sketch(True), f"{fields}, signatures array<long>, least0 long, least1 long").where("n > 0 and doc_id is not null")
    distinct = durable(marked.groupBy("n", "k1", "k2").agg(F.min("doc_id").alias("rep"), F.first("signatures").alias("signatures"), F.first("least0").alias("least0"), F.first("least1").alias("least1")))
    known = table.where("n > 0 and doc_id is not null")
    copies = durable(known.join(distinct.select("n", "k1", "k2", "rep"), ["n", "k1", "k2"]).where("doc_id != rep").select("doc_id", "rep").distinct())

    # 2. Shared signatures, their leaders and followers. Documents that share fewer than any partner would are taken out.
    def leaders(rows: DataFrame) -> DataFrame:
        return durable(rows.groupBy("sig").agg(F.min("doc").alias("leader"), F.max("doc").alias("last")).where("leader < last").select("sig", "leader"))

    emitted = distinct.select(F.explode("signatures").alias("sig"), F.col("rep").alias("doc"))
    shared = leaders(emitted)
    meet = durable(emitted.join(shared, "sig").select("sig", "doc"))
    # An id of several texts counts as many as all of them share, and needs as many as the least of them.
    needs = durable(distinct.groupBy(F.col("rep").alias("doc")).agg(F.min("least0").alias("least0"), F.min("least1").alias("least1")))
    discard(distinct)
    even = F.col("sig") % 2 == 0
    for _ in range(ROUNDS):
        counts = meet.groupBy("doc").agg(F.count_if(even).alias("n0"), F.count_if(~even).alias("n1")).join(needs, "doc")
        few = durable(counts.select("doc", F.expr("n0 < least0").alias("few0"), F.expr("n1 < least1").alias("few1"), F.expr("n0 between 1 and least0 - 1 or n1 between 1 and least1 - 1").alias("out")))
        done = not few.where("out").limit(1).count()
        if not done:
            left = durable(meet.join(few, "doc").where(~F.when(even, F.col("few0")).otherwise(F.col("few1"))).select("sig", "doc"))
            fewer = leaders(left)
            discard(meet)
            discard(shared)
            meet, shared = durable(left.join(fewer.select("sig"), "sig")), fewer
            discard(left)
        discard(few)
        if done:
            break
    follow = durable(meet.join(shared, "sig").where("doc != leader").select("sig", "leader", "doc"))
    for used in (meet, shared, needs):
        discard(used)
    votes = durable(follow.groupBy("leader", "doc").agg(F.count("*").alias("votes")))
    involved = votes.select(F.explode(F.array("leader", "doc")).alias("doc_id")).distinct()
    sets = durable(shingle_table(texts.join(involved.hint("merge"), "doc_id", "left_semi"), words, "doc_id", text, bands).withColumnRenamed("doc_id", "doc").where(F.size("set") > 0))
    sizes = durable(sets.select("doc", F.size("set").alias("n"), "band").distinct())

    # 3. Leaders search their followers: each follower with the leader it shares most signatures with, then with each of its other
    # leaders that this hasn't put into its class.
    wider = max(2 * s - 1, Fraction(1, 10**6))
    outside = float(1 - wider)

    def lead(batches):
        names, out = ("leader", "doc", "low", "high", "linked"), []
        for (leader, _), rows in grouped_rows(batches, ["leader", "block"]):
            found = [(d, x) for d, x in rows if d != leader]
            if not found:
                continue
            index = Lists([x for _, x in found])
            low, high, linked = np.full(len(found), outside), np.zeros(len(found)), np.zeros(len(found), bool)
            for query in [x for d, x in rows if d == leader]:
                near, overlap, far = distances(index, query, wider)
                most = np.full(len(found), 2.0)
                most[near] = far
                low, high = np.minimum(low, most), np.maximum(high, most)
                linked[near] |= overlap * s.denominator >= (len(query) + index.sizes[near] - overlap) * s.numerator
            out += [(leader, d, *row) for (d, _), row in zip(found, zip(low.tolist(), high.tolist(), linked.tolist()))]
            if len(out) > 4096:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out])
                out = []
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out])

    def searched(pairs: DataFrame) -> DataFrame:
        load = pairs.join(sizes, "doc").groupBy("leader").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).alias("blocks"))
        dealt = durable(pairs.join(load, "leader").select("leader", "doc", F.pmod(F.xxhash64("doc"), F.col("blocks")).alias("block")))
        heads = dealt.select("leader", "block", F.col("leader").alias("doc")).distinct()
        blocks = dealt.unionByName(heads).join(sets.select("doc", "set"), "doc").repartition("leader", "block").sortWithinPartitions("leader", "block")
        found = durable(arrow_map(blocks.select("leader", "block", "doc", "set"), lead, "leader long, doc long, low double, high double, linked boolean"))
        discard(dealt)
        return found

    def rooted(links: DataFrame) -> tuple[DataFrame, Callable[[str], DataFrame]]:
        roots = durable(components(links))
        return roots, lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))

    pairs = durable(votes.groupBy("doc").agg(F.max_by("leader", F.struct("votes", -F.col("leader"))).alias("leader")).select("leader", "doc"))
    near = searched(pairs)
    linked = lambda x: x.where("linked").select(F.col("leader").alias("a"), F.col("doc").alias("b"))
    trees, of = rooted(linked(near))
    rest = votes.select("leader", "doc").join(of("doc"), "doc", "left").join(of("leader"), "leader", "left")
    rest = rest.where(F.coalesce("doc_root", "doc") != F.coalesce("leader_root", "leader")).select("leader", "doc")
    rest = durable(rest.join(pairs, ["leader", "doc"], "left_anti"))
    late = searched(rest)
    links = linked(near).unionByName(linked(late))

    # 4. Signatures that still join documents of different classes. Distances to the leader are bounded from both sides: outside the
    # wider ball, and over the texts of one id. One that isn't known can be any: it keeps its follower, and all that it may be near to.
    roots, of = rooted(links)
    placed = follow.join(of("doc"), "doc", "left").join(of("leader"), "leader", "left")
    placed = placed.join(near.unionByName(late).groupBy("leader", "doc").agg(F.min("low").alias("low"), F.max("high").alias("high")), ["leader", "doc"], "left")
    placed = durable(placed.select("sig", "doc", F.coalesce("doc_root", "doc").alias("root"), F.coalesce("leader_root", "leader").alias("leader_root"), F.coalesce("low", F.lit(0.0)).alias("low"), F.coalesce("high", F.lit(2.0)).alias("high")))
    apart = placed.where("root != leader_root").groupBy("sig").agg(F.min("low").alias("nearest"))
    active = placed.join(apart, "sig").where(F.col("high") >= F.col("nearest") - float(1 - s) - EPS)
    first = active.groupBy("sig").agg(F.min("doc").alias("first"), F.min("root").alias("a"), F.max("root").alias("b")).where("a != b").select("sig", "first")
    open_pairs = durable(active.join(first, "sig").where("doc != first").select(F.col("first").alias("a"), F.col("doc").alias("b")).distinct())
    crowd = durable(components(open_pairs))
    # Partners are of one size band or of neighbouring ones, so each band of a crowd is searched by itself, in pairs of blocks if it is large.
    placed_crowd = crowd.select(F.col("node").alias("doc"), F.col("root").alias("crowd")).join(sizes, "doc").join(of("doc"), "doc", "left")
    members = placed_crowd.select("crowd", "doc", F.coalesce("doc_root", "doc").alias("class"), "n", F.posexplode(F.array("band", F.col("band") - 1)).alias("larger", "band"))
    members = durable(members)
    weight = members.groupBy("crowd", "band").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("long").alias("parts"), F.count("*").alias("size"), F.min("larger").alias("larger")).where("size > 1 and larger = 0").drop("larger")
    spread = members.drop("larger").join(weight, ["crowd", "band"]).withColumn("part", F.pmod(F.xxhash64("doc"), F.col("parts")))
    spread = spread.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    group = ["crowd", "band", "i", "j"]
    spread = spread.where("parts = 1 or part != with").select("crowd", "band", F.least("part", "with").alias("i"), F.greatest("part", "with").alias("j"), "doc", "class")

    def search(batches):
        for _, rows in grouped_rows(batches, group, ["class"]):
            docs, known, own = zip(*rows)
            got = links_among(docs, own, s, known)
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*got)], names=["a", "b"])

    crowded = spread.join(sets.select("doc", "set"), "doc").repartition(*group).sortWithinPartitions(*group)
    more = durable(arrow_map(crowded.select(*group, "doc", "class", "set"), search, "a long, b long"))

    every = links.unionByName(more).unionByName(copies.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    classes = durable(components(every))
    for used in (follow, votes, sets, sizes, pairs, near, trees, rest, late, roots, placed, open_pairs, crowd, members, more, copies):
        discard(used)
    out = table.select("doc_id", F.col("n").alias("n_shingles")).join(classes.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"))
