"""Sharding by a minimax contiguous partition of ordered atomic groups."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, numbered

LEVELS = (12, 24, 36, 48, 60, 64)
"""Leading bits of the group key that one refinement after the other tells apart."""


def least_capacity(feasible, low: int, high: int) -> int:
    """The least capacity in ``[low, high]`` that is feasible; ``high`` is."""
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if feasible(mid) else (mid + 1, high)
    return low


class Runs:
    """Ordered runs of groups: ``sizes``, and whether each run is known to be a single group."""

    def __init__(self, sizes: np.ndarray, single: np.ndarray, shards: int):
        self.sizes, self.single, self.shards = sizes, single, shards
        self.sums = np.concatenate([[0], np.cumsum(sizes)])
        self.total = int(self.sums[-1])

    def cuts(self, capacity: int) -> list[int] | None:
        """Greedy ends when no run may be cut; None if the shards don't suffice."""
        ends, at = [], 0
        for _ in range(self.shards):
            at = int(np.searchsorted(self.sums, self.sums[at] + capacity, side="right")) - 1
            ends.append(at)
            if at == len(self.sizes):
                return ends
        return None

    def fluid(self, capacity: int) -> list[int] | None:
        """Greedy end positions when runs of several groups may be cut anywhere: never before the true ones."""
        ends, at = [], 0
        for _ in range(self.shards):
            at = min(at + capacity, self.total)
            i = int(np.searchsorted(self.sums, at, side="right")) - 1
            if i < len(self.sizes) and at > self.sums[i] and self.single[i]:
                at = int(self.sums[i])
            ends.append(at)
            if at == self.total:
                return ends
        return None

    def open_runs(self, low: int, high: int) -> np.ndarray:
        """Runs of several groups in which a cut may lie for some capacity from ``low`` to ``high``."""
        early, at, stuck = [], 0, False
        for _ in range(self.shards):
            nxt = int(np.searchsorted(self.sums, self.sums[at] + low, side="right")) - 1
            stuck |= nxt == at < len(self.sizes)
            at = nxt
            early.append(at)
        if stuck:
            return np.flatnonzero(~self.single & (self.sizes > low // 16))
        late = self.fluid(high)
        late += [self.total] * (self.shards - len(late))
        out = np.zeros(len(self.sizes), bool)
        for a, b in zip(early, late):
            out[a : int(np.searchsorted(self.sums, b, side="left"))] = True
        return np.flatnonzero(out & ~self.single)


def shard_bounds(groups: DataFrame, shards: int) -> list[int]:
    """Least keys of shards 1, 2, ... in the minimax contiguous partition of ``groups`` (key long, size long, n long).

    The driver never sees all groups: it holds runs of groups that share leading key bits. Runs taken as atomic give
    a feasible capacity, runs that can be cut anywhere give a lower bound; only runs in which a cut may
    lie are split by more bits, until both capacities meet. That is a few thousand rows a
    round whatever the number of groups.
    """
    def summed(df: DataFrame, bits: int):
        key = F.shiftright("key", 64 - bits)
        return [tuple(r) for r in df.groupBy(key.alias("run")).agg(F.min("key"), F.max("key"), F.sum("size")).collect()]

    runs = [(r[0], r[1], r[2], r[3], LEVELS[0]) for r in summed(groups, LEVELS[0])]
    while runs:
        runs.sort(key=lambda r: r[1])
        state = Runs(np.array([r[3] for r in runs], np.int64), np.array([r[1] == r[2] for r in runs]), shards)
        high = least_capacity(lambda c: state.cuts(c) is not None, -(-state.total // shards), state.total)
        low = least_capacity(lambda c: state.fluid(c) is not None, -(-state.total // shards), high)
        if low == high:
            ends = [e for e in state.cuts(high) if e < len(runs)]
            return [runs[e][1] for e in ends]
        chosen = state.open_runs(low, high).tolist()
        level = min(runs[i][4] for i in chosen)
        split = [i for i in chosen if runs[i][4] == level]
        bits = LEVELS[LEVELS.index(level) + 1]
        inside = groups.where(F.shiftright("key", 64 - level).isin([runs[i][0] for i in split]))
        finer = [(r[0], r[1], r[2], r[3], bits) for r in summed(inside, bits)]
        gone = set(split)
        runs = [r for i, r in enumerate(runs) if i not in gone] + finer
    return []


def shard(docs: DataFrame, shards: int = 8, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """Puts every row into a shard so that the largest shard is as small as contiguous cuts allow.

    Atomic groups are the rows of equal text, ordered by the text's 64-bit hash (two texts of one hash would merely stay
    together); a group's size is the sum of UTF-8 bytes plus 1 of its rows. The least capacity is found by
    binary search with a greedy check. Groups are summed before the shuffle, so a group with a third of all rows is
    one row of sums; it can't be split and then sets the capacity. Slots are gapless from 0 in each shard.

    Returns the id, size, text_crc32, group_key, shard and slot. Null text counts as empty (crc32 0, size 1, one group
    with empty texts); repeated rows are rows of their own; an empty table gives no rows.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    base = durable(docs.select(F.col(id_column), (F.octet_length(whole) + 1).cast("long").alias("size"), F.crc32(F.encode(whole, "UTF-8")).alias("text_crc32"), F.xxhash64(whole).alias("group_key")))
    groups = durable(base.groupBy(F.col("group_key").alias("key")).agg(F.sum("size").alias("size")))
    number = F.lit(0)
    for k, least in enumerate(shard_bounds(groups, shards), 1):
        number = F.when(F.col("group_key") >= least, k).otherwise(number)
    return numbered(base.withColumn("shard", number.cast("int")), "shard", [id_column, "group_key"], "slot")
