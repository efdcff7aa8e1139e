"""Suffix-array dedup: bytes covered by long strings that start anywhere else.

Which suffixes are sorted. Of the hashes of the ``GRAM``-byte strings in a window of ``length`` bytes, the least (leftmost on
ties) names an anchor. It depends on the window's bytes alone, so two equal windows have equal anchors at equal
offsets, and only suffixes that begin at anchors, about one in 85 bytes, need sorting: grouped by their gram, by what
follows and by what precedes them. Two occurrences of a gram that agree on ``l`` bytes to the left and ``r`` from it on
share a string of ``l + r`` bytes.
"""

from __future__ import annotations

from bisect import bisect_left
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, chunks, column, discard, durable, mix64, prefix_hashes, texts_of

GRAM = 32
SHALLOW, PIECE = 64, 8
"""Depth in bytes to which suffixes are sorted by multikey quicksort, and the bytes it compares at a time."""
MOST = 8_192
"""Distinct contexts that one task sorts together; more are split on the bytes around them."""
WAYS = 6
"""Ways in which such a set is split at a time."""
PART = 1 << 24


def step_anchors(texts: list[bytes], length: int):
    """``(doc, at, gram, context)`` of the anchors of some texts of under 2**26 bytes in all.

    ``context`` is a hash of all that a window around the gram can hold: ``length - GRAM`` bytes before it and ``length`` from it on,
    cut at the ends of the text.
    """
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    buf = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    begins = np.cumsum(sizes) - sizes
    n, span = len(buf), length - GRAM + 1
    if n < length:
        return none
    sums, down = prefix_hashes(buf)
    grams = mix64((sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1])
    keys = (grams >> np.uint64(26) << np.uint64(26)) | np.arange(len(grams), dtype=np.uint64)
    padded = np.full(-(-len(keys) // span) * span, np.uint64(2**64 - 1))
    padded[: len(keys)] = keys
    table = padded.reshape(-1, span)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    back = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = n - length + 1
    least = np.minimum(back[:starts], ahead[span - 1 : span - 1 + starts]) & np.uint64((1 << 26) - 1)
    ends = np.repeat(begins + sizes, sizes)[:starts]
    least = least[np.arange(starts) + length <= ends].astype(np.int64)
    if not len(least):
        return none
    at = least[np.concatenate([[True], least[1:] != least[:-1]])]
    doc = np.searchsorted(begins + sizes, at, side="right")
    a, b = np.maximum(at - (length - GRAM), begins[doc]), np.minimum(at + length, begins[doc] + sizes[doc])
    sides = (at - a).astype(np.uint64) << np.uint64(32) | (b - at).astype(np.uint64)
    return doc, at - begins[doc], grams[at], mix64(mix64((sums[b] - sums[a]) * down[a]) + sides)


def anchors(texts: list[bytes], length: int):
    """As ``step_anchors``; one very long text is looked at in overlapping parts."""
    if len(texts) > 1 or len(texts[0]) <= 2 * PART:
        return step_anchors(texts, length)
    found = []
    for begin in range(0, len(texts[0]), PART):
        lead = min(begin, length)
        _, at, gram, context = step_anchors([texts[0][begin - lead : begin + PART + 2 * length]], length)
        own = (at >= lead) & (at < lead + PART + length - GRAM + 1)
        found.append((at[own] + begin - lead, gram[own], context[own]))
    at, gram, context = map(np.concatenate, zip(*found))
    _, first = np.unique(at, return_index=True)
    return np.zeros(len(first), np.int64), at[first], gram[first], context[first]


def blind_trie_order(rows: list[int], values: list[int]) -> list[int]:
    """``rows`` in order of their ``values``, equal ones together, by a blind trie.

    A node keeps only the bit at which it branches. An insertion walks down by single bits, blind to what they skip, to
    some leaf; the first bit in which the value differs from that leaf's tells where the new node goes.
    """
    root: list = [rows[0]]  # a leaf is a list of rows, a node a tuple (bit, [kid, kid])
    for row in rows[1:]:
        value, node = values[row], root
        while type(node) is tuple:
            node = node[1][value >> node[0] & 1]
        differ = value ^ values[node[0]]
        if not differ:
            node.append(row)
            continue
        bit, holder, node = differ.bit_length() - 1, None, root
        while type(node) is tuple and node[0] > bit:
            holder, side = node[1], value >> node[0] & 1
            node = holder[side]
        new = (bit, [node, [row]] if value >> bit & 1 else [[row], node])
        if holder is None:
            root = new
        else:
            holder[side] = new
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        if type(node) is tuple:
            todo += node[1][::-1]
        else:
            out += node
    return out


def deep_shallow_order(strings: list[bytes], values: list[int]) -> list[int]:
    """Suffix order of ``strings`` (all of one width; ``values`` are the same as integers)."""
    out, todo = [], [(list(range(len(strings))), 0)]
    while todo:
        rows, depth = todo.pop()
        if len(rows) < 2:
            out += rows
        elif depth >= SHALLOW:
            out += blind_trie_order(rows, values)
        else:
            pieces = [strings[r][depth : depth + PIECE] for r in rows]
            pivot = sorted((pieces[0], pieces[len(pieces) // 2], pieces[-1]))[1]
            less, same, more = [], [], []
            for r, p in zip(rows, pieces):
                (same if p == pivot else less if p < pivot else more).append(r)
            todo += [x for x in ((more, depth), (same, depth + PIECE), (less, depth)) if x[0]]
    return out


def extents(lefts: list[bytes], rights: list[bytes], counts: list[int], length: int) -> list[tuple[int, int]]:
    """For each context of a gram, how far repeats of ``length`` bytes or more reach to the left of it and from it on.

    All such repeats hold the gram, so their union is one interval; (0, 0) if there are none. Contexts are in suffix order of
    their right sides, and merged in falling order of the common prefix of their (reversed) left sides: for two
    sets that share l bytes to the left, the best partner of a context is next to it in right order. The smaller set goes into
    the larger one, so n contexts take O(n log n) comparisons, also if all of them match.
    """
    n = len(lefts)
    best = [(len(a), len(b)) if c > 1 else (0, 0) for a, b, c in zip(lefts, rights, counts)]
    if n < 2:
        return best
    wide = length - GRAM
    # Padding is a byte that UTF-8 never has.
    right_strings, left_strings = [x.ljust(length, b"\xff") for x in rights], [x[::-1].ljust(wide, b"\xff") for x in lefts]
    right_values, left_values = [int.from_bytes(x, "big") for x in right_strings], [int.from_bytes(x, "big") for x in left_strings]
    by_right, by_left = deep_shallow_order(right_strings, right_values), deep_shallow_order(left_strings, left_values)
    rank = [0] * n
    for k, row in enumerate(by_right):
        rank[row] = k
    near = []
    for k in range(1, n):
        i, j = by_left[k - 1], by_left[k]
        same = wide - ((left_values[i] ^ left_values[j]).bit_length() + 7) // 8
        near.append((min(same, len(lefts[i]), len(lefts[j])), k))
    sets = [[rank[row]] for row in by_left]
    owner = list(range(n))

    def find(k: int) -> int:
        while owner[k] != k:
            owner[k] = owner[owner[k]]
            k = owner[k]
        return k

    for left, k in sorted(near, reverse=True):
        a, b = find(k - 1), find(k)
        if len(sets[a]) < len(sets[b]):
            a, b = b, a
        large, small = sets[a], sets[b]
        for r in small:
            i, x = bisect_left(large, r), by_right[r]
            for other in large[max(0, i - 1) : i + 1]:
                y = by_right[other]
                right = min(length - ((right_values[x] ^ right_values[y]).bit_length() + 7) // 8, len(rights[x]), len(rights[y]))
                if left + right >= length:
                    best[x] = (max(best[x][0], left), max(best[x][1], right))
                    best[y] = (max(best[y][0], left), max(best[y][1], right))
            large.insert(i, r)
        sets[b], owner[b] = [], a
    return best


def repeated_spans(docs: DataFrame, keys: list[str], text: str, length: int) -> DataFrame:
    """``(*keys, spans)``: of texts with repeats, the maximal byte runs that repeats cover, ascending."""
    key_fields = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys)

    def find(batches):
        for batch in batches:
            texts = texts_of(batch, text)
            for part in chunks(texts):
                doc, at, gram, context = anchors(texts[part], length)
                own = [batch.column(batch.schema.get_field_index(k)).take(pa.array(doc + part.start)) for k in keys]
                yield pa.RecordBatch.from_arrays([*own, pa.array(at), pa.array(gram.view(np.int64)), pa.array(context.view(np.int64))], names=[*keys, "at", "gram", "context"])

    long_enough = docs.where(F.octet_length(text) >= length).select(*keys, text)
    every = durable(arrow_map(long_enough, find, f"{key_fields}, at long, gram long, context long"))
    twice = durable(every.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram"))
    shared = durable(every.join(twice, "gram"))
    discard(every)
    # One occurrence of each distinct context brings its bytes; the number of its occurrences goes along.
    distinct = shared.groupBy("gram", "context").agg(F.count("*").alias("n"), F.min(F.struct(*keys, "at")).alias("first"))
    wanted = distinct.select("first.*", "gram", "context", "n").groupBy(*keys).agg(F.collect_list(F.struct("at", "gram", "context", "n")).alias("cuts"))

    def cut(batches):
        for batch in batches:
            texts, cuts = texts_of(batch, text), column(batch, "cuts")
            for t, own in zip(texts, cuts):
                for some in range(0, len(own), 4096):
                    rows = own[some : some + 4096]
                    at = [c["at"] for c in rows]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([c["gram"] for c in rows]), pa.array([c["context"] for c in rows]), pa.array([c["n"] for c in rows]),
                        pa.array([t[max(0, p - length + GRAM) : p] for p in at], pa.binary()), pa.array([t[p : p + length] for p in at], pa.binary())], names=["gram", "context", "n", "left", "right"])

    contexts = durable(arrow_map(long_enough.join(wanted, keys).select(text, "cuts"), cut, "gram long, context long, n long, left binary, right binary"))

    reach = reaches(contexts, length)
    ranges = shared.join(reach, ["gram", "context"]).select(*keys, F.struct((F.col("at") - F.col("before")).alias("start"), (F.col("at") + F.col("after")).alias("end")).alias("range"))
    out = durable(ranges.groupBy(*keys).agg(F.array_sort(F.collect_set("range")).alias("ranges")))
    for used in (twice, shared, contexts, reach):
        discard(used)
    return out


def reaches(contexts: DataFrame, length: int) -> DataFrame:
    """``(gram, context, before, after)``: how far repeats reach to both sides of a gram, for contexts that have any.

    A part is a set of contexts of one gram that agree on ``a`` bytes before it and ``b`` from it on, at first on the gram alone. A part of
    at most ``MOST`` contexts is sorted by one task. A larger one is split in ``WAYS`` ways, by so many more of the bytes that precede and
    so many of those that follow: two contexts that share ``length`` bytes or more around the gram agree in one of the ways, so they
    meet again. Where ``a + b`` reaches ``length`` all contexts of a part match, and none needs sorting. A round leaves a
    ``WAYS``-th open, so there are at most three for 200 bytes, and only parts that are too large go on.
    """
    def rows_of(batches):
        for batch in batches:
            yield from zip(*[column(batch, c) for c in ("gram", "part", "context", "n", "left", "right")])

    def compare(batches):
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["gram", "context", "before", "after"])
        out = []
        for (gram, _), rows in groupby(rows_of(batches), key=lambda r: r[:2]):
            # Rows of one key bring their contexts more than once; equal ones stand next to each other.
            _, _, context, n, left, right = zip(*[next(same) for _, same in groupby(rows, key=lambda r: r[2])])
            out += [(gram, c, *e) for c, e in zip(context, extents(left, right, n, length)) if e[1]]
            if len(out) > 8192:
                yield made(out)
                out = []
        if out:
            yield made(out)

    own = ["gram", "part"]
    parts = contexts.select("*", F.lit(0).cast("long").alias("part"), F.lit(0).alias("a"), F.lit(GRAM).alias("b"))
    found, done = [], []
    while True:
        crowded = durable(parts.groupBy(*own).agg(F.countDistinct("context").alias("many")).where(F.col("many") > MOST).select(*own))
        none = crowded.isEmpty()
        usual = parts if none else parts.join(crowded, own, "left_anti")
        sorted_parts = usual.select("gram", "part", "context", "n", "left", "right").repartition(*own).sortWithinPartitions(*own, "context")
        compared = arrow_map(sorted_parts, compare, "gram long, context long, before long, after long")
        if none and not found:
            discard(crowded)
            return compared
        found.append(durable(compared))
        done.append(crowded)
        if none:
            break
        # Contexts that share ``l`` more bytes before the gram share all but ``l`` of the open ones after it: each range of ``l`` is a way.
        split = parts.join(crowded, own, "left_semi").withColumn("open", F.lit(length) - F.col("a") - F.col("b"))
        cut = lambda way: F.floor(way * (F.col("open") + 1) / WAYS).cast("int")
        ways = F.transform(F.sequence(F.lit(0), F.lit(WAYS - 1)), lambda way: F.struct((F.col("a") + cut(way)).alias("a"), (F.col("b") + F.col("open") + 1 - cut(way + 1)).alias("b"), (cut(way) < cut(way + 1)).alias("any")))
        split = split.withColumn("sides", F.explode(ways)).where("sides.any")
        split = split.select("gram", "context", "n", "left", "right", "sides.a", "sides.b").where((F.octet_length("left") >= F.col("a")) & (F.octet_length("right") >= F.col("b")))
        split = split.withColumn("part", F.xxhash64("a", "b", F.substr("left", F.octet_length("left") - F.col("a") + 1, F.col("a")), F.substr("right", F.lit(1), F.col("b"))))
        split = durable(split.dropDuplicates(["gram", "part", "context"]))
        matching = split.where(F.col("a") + F.col("b") >= length)
        met = matching.groupBy(*own).agg(F.count("*").alias("many")).where("many > 1").select(*own)
        found.append(durable(matching.join(met, own, "left_semi").select("gram", "context", F.col("a").cast("long").alias("before"), F.col("b").cast("long").alias("after"))))
        done.append(split)
        parts = split.where(F.col("a") + F.col("b") < length)
    own_copies = contexts.where("n > 1").select("gram", "context", F.octet_length("left").cast("long").alias("before"), F.octet_length("right").cast("long").alias("after"))
    every = own_copies.where(F.col("before") + F.col("after") >= length)
    for f in found:
        every = every.unionByName(f)
    out = durable(every.groupBy("gram", "context").agg(F.max("before").alias("before"), F.max("after").alias("after")))
    for used in (*found, *done):
        discard(used)
    return out


def merged(ranges: list[dict]) -> list[tuple[int, int]]:
    """The union of ascending ranges; ranges that touch are one run of removed bytes."""
    out: list[tuple[int, int]] = []
    for r in ranges:
        if out and r["start"] <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], r["end"]))
        else:
            out.append((r["start"], r["end"]))
    return out


def inside_characters(t: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs shrunk to whole UTF-8 characters."""
    out = []
    for start, end in runs:
        while start < end and t[start] & 0xC0 == 0x80:
            start += 1
        while end > start and end < len(t) and t[end] & 0xC0 == 0x80:
            end -= 1
        if start < end:
            out.append((start, end))
    return out


def remove_repeats(docs: DataFrame, keep: list[str], length: int = 200, id_column: str = "doc_id", text: str = "text", characters: bool = False) -> DataFrame:
    """``keep`` columns, n_bytes, spans (removed byte runs) and kept (the remaining bytes) of every document.

    Removed is each byte covered by a ``length``-byte string that also starts anywhere else, in the same text or another;
    matches never cross texts, and all are judged on the input. Anchors (see the module) are counted by gram before the
    shuffle; of those that occur twice, distinct contexts are gathered by gram and compared by deep-shallow sorting: multikey
    quicksort to a shallow depth, then blind tries. Equal contexts are one row with a count, so copies cost nothing; more than
    ``MOST`` distinct contexts of a gram are split on the bytes around it and each part is sorted (see ``reaches``). ``characters``: only
    whole characters are cut, so that the rest stays valid UTF-8. Null text counts as empty and
    repeated rows are occurrences of their own; texts shorter than ``length`` bytes lose nothing; an empty table gives no rows.
    """
    base = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("__text"), F.xxhash64(id_column, text).alias("__k1"), F.xxhash64(F.lit(1), text).alias("__k2"))
    spans = repeated_spans(base, ["__k1", "__k2"], "__text", length)

    def cut(batches):
        for batch in batches:
            texts, ranges = texts_of(batch, "__text"), column(batch, "ranges")
            for part in chunks(texts):
                runs = [merged(r or []) for r in ranges[part]]
                runs = [inside_characters(t, r) for t, r in zip(texts[part], runs)] if characters else runs
                left = []
                for t, own in zip(texts[part], runs):
                    ends = [0, *[e for _, e in own]]
                    left.append(b"".join(t[a:b] for a, b in zip(ends, [*[s for s, _ in own], len(t)])))
                cols = [batch.column(batch.schema.get_field_index(k)).slice(part.start, part.stop - part.start) for k in keep]
                yield pa.RecordBatch.from_arrays([*cols, pa.array([len(t) for t in texts[part]], pa.int64()), pa.array([[{"start": s, "end": e} for s, e in own] for own in runs], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(left, pa.binary())], names=[*keep, "n_bytes", "spans", "kept"])

    fields = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep)
    joined = base.join(spans, ["__k1", "__k2"], "left").select(*keep, "__text", "ranges")
    return arrow_map(joined, cut, f"{fields}, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
