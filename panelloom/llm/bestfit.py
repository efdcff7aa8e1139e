"""Best-fit packing planned on the histogram of lengths: pieces then take their slots by rank within length."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, chunks, column
from .ranks import ranked
from .tokens import Encoder

PLAN = "length long, first_rank long, next_rank long, first_sequence long, per_sequence long, first_offset long"


def plan_best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[int, ...]]:
    """Rows of ``PLAN`` by which best fit, longest lengths first, packs ``histogram`` (length: count) into sequences.

    Sequences of one free space are interchangeable, so they are kept as ranges of numbers by free space. The least space that
    takes a length is filled until it takes no more, as best fit would piece by piece; a range is split at most once per
    length. The work and the plan depend on the capacity (at most that many lengths) and not on the counts.
    """
    free: dict[int, list[tuple[int, int]]] = defaultdict(list)
    rows, sequences = [], 0
    for length in sorted(histogram, reverse=True):
        total = left = histogram[length]

        def fill(first: int, many: int, space: int) -> int:
            """Puts pieces into the sequences first, ..., first + many - 1, each with this space; returns how many got some."""
            nonlocal left
            fit, used = space // length, 0
            for per, want in ((fit, left // fit), (left % fit, 1)):
                take = min(want, many - used)
                if per and take and left >= per:
                    rows.append((length, total - left, total - left + take * per, first + used, per, capacity - space))
                    free[space - per * length].append((first + used, take))
                    used, left = used + take, left - take * per
            return used

        for space in sorted(s for s in free if s >= length):
            ranges = free.pop(space)
            while ranges and left:
                first, many = ranges.pop()
                used = fill(first, many, space)
                if used < many:
                    ranges.append((first + used, many - used))
            if ranges:
                free[space] = ranges + free.get(space, [])
            if not left:
                break
        if left:
            sequences += fill(sequences, -(-left // (capacity // length)), capacity)
    return rows


def token_pieces(docs: DataFrame, tokenizer: str, keep: list[str], capacity: int, end_id: int, text: str = "text") -> DataFrame:
    """``keep`` columns, piece, start, length, width and ids: the texts' ids with ``end_id`` behind, in pieces of at most ``capacity``.

    ``ids`` are little-endian unsigned integers of ``width`` bytes each. Only a text of more ids is cut; its first piece may be
    shorter, the others are full.
    """
    names = [*keep, "piece", "start", "length", "width", "ids"]

    def run(batches):
        encoder = Encoder(tokenizer)
        width, end = encoder.kind.itemsize, np.array([end_id], encoder.kind).tobytes()
        for batch in batches:
            texts = [t or "" for t in column(batch, text)]
            for some in chunks(texts):
                owner, number, start, length, ids = [], [], [], [], []
                for i, t in enumerate(texts[some], some.start):
                    data = encoder.ids(t) + end
                    n = len(data) // width
                    cuts = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        owner.append(i)
                        number.append(k)
                        start.append(a)
                        length.append(b - a)
                        ids.append(data[a * width : b * width])
                own = pa.array(owner, pa.int64())
                cols = [batch.column(batch.schema.get_field_index(k)).take(own) for k in keep]
                made = [pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array([width] * len(ids), pa.int32()), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays([*cols, *made], names=names)

    fields = "".join(f"`{k}` {docs.schema[k].dataType.simpleString()}, " for k in keep)
    return arrow_map(docs.select(*dict.fromkeys([*keep, text])), run, f"{fields}piece int, start long, length long, width int, ids binary")


def pack_best_fit(docs: DataFrame, tokenizer: str, keep: list[str] = ("doc_id",), capacity: int = 1024, end_id: int = 2, text: str = "text") -> DataFrame:
    """Packs all texts into sequences of at most ``capacity`` ids: keep, piece, start, length, width, ids, sequence_id and offset per piece.

    Texts are encoded once, in a table of pieces; every task numbers its own pieces by length. The histogram (at most ``capacity``
    rows) goes to the driver, which plans with counts alone. The plan's rows are ranges of ranks; a piece joins the one of its
    length that its rank lies in. The plan is bounded by the capacity, not by the documents: it alone is
    broadcast. Sequences are numbered from 0 without gaps, and pieces stand next to each other in them.

    A null or empty text is ``end_id`` alone. Repeated rows, rows of one id and null ids are documents of their own. No rows
    give no rows. ``keep`` can't name the new columns.
    """
    keep = list(keep)
    if taken := {"piece", "start", "length", "width", "ids", "rank", "sequence_id", "offset"} & set(keep):
        raise ValueError(f"columns with names of new ones: {sorted(taken)}")
    pieces = ranked(token_pieces(docs, tokenizer, keep, capacity, end_id, text), "length", "rank")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = docs.sparkSession.createDataFrame(plan_best_fit(histogram, capacity), PLAN).withColumnRenamed("length", "planned")
    inside = (F.col("length") == F.col("planned")) & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("next_rank"))
    placed = pieces.join(F.broadcast(plan), inside)
    turn = F.col("rank") - F.col("first_rank")
    sequence = F.col("first_sequence") + F.floor(turn / F.col("per_sequence"))
    offset = F.col("first_offset") + turn % F.col("per_sequence") * F.col("length")
    return placed.select(*keep, "piece", "start", "length", "width", "ids", sequence.cast("long").alias("sequence_id"), offset.cast("long").alias("offset"))
