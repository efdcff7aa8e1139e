"""Packing documents of like length: optimal bucket boundaries, then batches of a token budget."""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered

WORKING = ("__bin", "__rank", "__key", "__b", "__offset", "__n")
"""Columns that numbering makes for itself."""


def best_bounds(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """Upper bucket bounds, out of ascending distinct ``lengths``, of least total padding.

    Dynamic programming over the histogram. Padding of lengths i+1..j under bound L[j] is
    L[j] * (C[j] - C[i]) - (S[j] - S[i]) with running counts C and sums S, so each step is a lower envelope of lines with slopes
    -C[i], read at growing L[j]: linear in the number of distinct lengths.
    """
    n = len(lengths)
    if not n:
        return []
    C, S = [0], [0]
    for length, c in zip(lengths, counts):
        C.append(C[-1] + c)
        S.append(S[-1] + length * c)
    best = [0] + [None] * n
    choice = []
    for _ in range(min(buckets, n)):
        hull, after, chosen = deque(), [None] * (n + 1), [0] * (n + 1)
        for j in range(1, n + 1):
            if best[j - 1] is not None:
                m, b = -C[j - 1], best[j - 1] + S[j - 1]
                while len(hull) > 1:
                    (m1, b1, _), (m2, b2, _) = hull[-2], hull[-1]
                    if (b - b1) * (m1 - m2) <= (b2 - b1) * (m1 - m):
                        hull.pop()
                    else:
                        break
                hull.append((m, b, j - 1))
            if not hull:
                continue
            x = lengths[j - 1]
            while len(hull) > 1 and hull[1][0] * x + hull[1][1] <= hull[0][0] * x + hull[0][1]:
                hull.popleft()
            m, b, i = hull[0]
            after[j], chosen[j] = m * x + b + x * C[j] - S[j], i
        choice.append(chosen)
        best = [None, *after[1:]]
    bounds, j = [], n
    for chosen in reversed(choice):
        bounds.append(lengths[j - 1])
        j = chosen[j]
        if j == 0:
            break
    return bounds[::-1]


def pack(items: DataFrame, length: str, order: list[str], buckets: int = 8, budget: int = 16_384) -> DataFrame:
    """Adds bucket, bucket_length, batch and slot to each row of ``items``.

    The histogram of lengths (one row per distinct length, counted before the shuffle) goes to
    the driver: its size is bounded by the longest text, not by the number of rows. Bounds are the optimum for
    ``buckets`` buckets. Inside a bucket, rows get gapless numbers and every ``max(1, budget // bucket_length)`` of
    them are a batch, so a batch padded to its bucket's length keeps the budget unless one row alone exceeds
    it. ``batch`` numbers are gapless over all buckets. Null length counts as 0; no rows give no rows; columns of ``items`` that
    have the name of a new one are replaced, and those with the name of a working column are dropped.
    """
    items = items.drop("bucket", "bucket_length", "batch", "slot", "__at", *WORKING).withColumn(length, F.coalesce(F.col(length), F.lit(0)))
    rows = items.groupBy(length).agg(F.count("*").alias("n")).collect()
    histogram = sorted((r[0], r[1]) for r in rows)
    bounds = best_bounds([x for x, _ in histogram], [n for _, n in histogram], buckets) or [0]
    start, plan = 0, []
    for k, top in enumerate(bounds):
        low = bounds[k - 1] if k else -1
        capacity = max(1, budget // max(1, top))
        plan.append((k, top, capacity, start))
        start += -(-sum(n for x, n in histogram if low < x <= top) // capacity)

    def choose(i: int):
        out = F.lit(plan[-1][i])
        for row in reversed(plan[:-1]):
            out = F.when(F.col(length) <= row[1], row[i]).otherwise(out)
        return out

    pick, size, per, first = choose(0), choose(1), choose(2), choose(3)
    at = numbered(items.withColumn("bucket", pick.cast("int")), "bucket", order, "__at")
    return at.select(*items.columns, "bucket", size.cast("long").alias("bucket_length"), (first + F.floor(F.col("__at") / per)).cast("long").alias("batch"), (F.col("__at") % per).cast("long").alias("slot"))
