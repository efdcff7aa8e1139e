"""Recursions along ordered rows: a state carried over a key-sorted stream of Arrow batches.

A recursion whose next value needs the last one (a moving average's shocks, a conditional variance, an iterated forecast) has no
window expression, and gathering a series into an array copies it at each step. Here a task reads its sorted rows once: time is linear in
the rows, and it holds one batch and one small state, whatever a series' length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..session import bounded_batches

Block = Callable[[object, dict[str, list]], tuple[object, list[list]]]
"""``block(state, columns)`` of consecutive rows of one key; returns the state after them and the new columns."""


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def key_runs(batch: pa.RecordBatch, keys) -> Iterator[tuple[tuple, int, int]]:
    """``(key, start, stop)`` of each run of equal keys in a batch."""
    if not batch.num_rows:
        return
    rows = list(zip(*[column(batch, k).to_pylist() for k in keys])) if keys else [()] * batch.num_rows
    start = 0
    for i in range(1, len(rows) + 1):
        if i == len(rows) or rows[i] != rows[start]:
            yield rows[start], start, i
            start = i


def carried(rows: DataFrame, keys, order, reads, fields: str, start: Callable[[], object], block: Block) -> DataFrame:
    """``rows`` with the columns ``fields`` that ``block`` makes along each key, in ``order``.

    Rows are shuffled by key and sorted once. ``block`` sees the columns ``reads`` as lists, a stretch of one key at a time, with the state
    that the stretch before it left (``start()`` for the first). Rows of a null key are one series.
    """
    keys, order, reads = list(keys), list(order), list(reads)
    made = T._parse_datatype_string(fields)

    def run(batches):
        key, state = None, None
        for batch in batches:
            columns = {c: column(batch, c).to_pylist() for c in reads}
            out: list[list] = [[] for _ in made.fields]
            for own, a, b in key_runs(batch, keys):
                if own != key or state is None:
                    key, state = own, start()
                state, new = block(state, {c: v[a:b] for c, v in columns.items()})
                for all_values, values in zip(out, new):
                    all_values += values
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(v, t) for v, t in zip(out, kinds)]], names=[*batch.schema.names, *names])

    from pyspark.sql.pandas.types import to_arrow_type

    kinds, names = [to_arrow_type(f.dataType) for f in made.fields], made.fieldNames()
    dealt = rows.repartition(*keys) if keys else rows.coalesce(1)
    return bounded_batches(dealt).sortWithinPartitions(*keys, *order).mapInArrow(run, T.StructType([*rows.schema.fields, *made.fields]))


def one_step(width: int) -> Block:
    """One-step forecasts ``pred = base + sum ma[j] e[j]`` from columns y, base and ma.

    The state holds the last ``width`` shocks, latest first. A row without ``base`` has no forecast and shock 0; so has one without y.
    """
    def block(e, columns):
        preds = []
        for y, base, ma in zip(columns["_f_y"], columns["_f_base"], columns["_f_ma"]):
            if base is None or ma is None:
                pred = None
            else:
                pred = base
                for j in range(min(width, len(ma))):
                    pred += (ma[j] or 0.0) * e[j]
            preds.append(pred)
            e = [0.0 if pred is None or y is None else y - pred, *e[: width - 1]] if width else e
        return e, [preds]

    return block


def iterated(n_ar: int, n_ma: int) -> Block:
    """Forecasts of the test rows from the end of the training rows: ``base + sum ar[i] y[i] + sum ma[j] e[j]``.

    Training rows (column train) put y and e into the state, latest first; a test row puts its forecast there, and shock 0. The
    second new column counts the test rows from 1.
    """
    def block(state, columns):
        ys, es, step = state
        preds, steps = [], []
        for train, y, e, base, ar, ma in zip(*[columns[f"_f_{c}"] for c in ("train", "y", "e", "base", "ar", "ma")]):
            if train:
                ys, es = [y, *ys][:n_ar], [e or 0.0, *es][:n_ma]
                preds.append(None)
                steps.append(None)
                continue
            pred = base
            if pred is not None and ar is not None and ma is not None:
                for i in range(n_ar):
                    pred = None if pred is None or ys[i] is None else pred + ar[i] * ys[i]
                for j in range(n_ma):
                    pred = None if pred is None else pred + ma[j] * es[j]
            else:
                pred = None
            step += 1
            ys, es = [pred, *ys][:n_ar], [0.0, *es][:n_ma]
            preds.append(pred)
            steps.append(step)
        return (ys, es, step), [preds, steps]

    return block


def iterated_start(n_ar: int, n_ma: int):
    return lambda: ([0.0] * n_ar, [0.0] * n_ma, 0)
