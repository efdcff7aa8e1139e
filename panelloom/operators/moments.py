"""Regression moments: one Spark aggregate that every linear model below reads.

``moment_matrix`` sums products of columns per key. A regression is then a
small sub-matrix solve on one row, whatever the number of rows summed. Moments add up:
tasks sum their own rows, and partial matrices are what is shuffled.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import bounded_batches

ROWS = 2048
"""Rows whose products are formed together."""
HELD = 4096
"""Partial matrices a task holds before it hands them on."""
STEPS = 64
"""Steps of running sums that one task adds up."""


def triangle(k: int):
    return [(i, j) for i in range(k) for j in range(i, k)]


def products(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Packed upper triangles of the summed outer products of each group of rows; groups begin at ``starts``."""
    first, second = np.triu_indices(x.shape[1])
    out = np.zeros((len(starts), len(first)))
    ends = np.append(starts[1:], len(x))
    if 16 * len(starts) <= len(x):
        for g, (a, b) in enumerate(zip(starts.tolist(), ends.tolist())):
            out[g] = (x[a:b].T @ x[a:b])[first, second]
        return out
    for some in range(0, len(starts), ROWS):
        own = starts[some : some + ROWS]
        part = x[own[0] : ends[some + len(own) - 1]]
        out[some : some + len(own)] = np.add.reduceat(part[:, first] * part[:, second], own - own[0])
    return out


def partial_moments(df: DataFrame, by, columns) -> DataFrame:
    """``by``, n_rows and m: summed products of the rows that a task has of a group, before any shuffle."""
    by, columns = list(by), list(columns)
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by)

    def run(batches):
        held: dict[tuple, list] = {}
        types = None

        def emit():
            groups = list(held)
            cols = [pa.array([g[i] for g in groups], type=t) for i, t in enumerate(types)]
            flat = np.concatenate([held[g][1] for g in groups])
            width = len(flat) // len(groups)
            matrices = pa.ListArray.from_arrays(pa.array(np.arange(len(groups) + 1) * width, pa.int32()), pa.array(flat))
            return pa.RecordBatch.from_arrays([*cols, pa.array([held[g][0] for g in groups], pa.int64()), matrices], names=[*by, "n_rows", "m"])

        for batch in batches:
            if not batch.num_rows:
                continue
            types = types or [batch.schema.field(c).type for c in by]
            groups: dict[tuple, int] = {}
            keys = zip(*[batch.column(batch.schema.get_field_index(c)).to_pylist() for c in by]) if by else [()] * batch.num_rows
            code = np.fromiter((groups.setdefault(k, len(groups)) for k in keys), np.int64, batch.num_rows)
            order = np.argsort(code, kind="stable")
            x = np.column_stack([batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in columns]).astype(float)[order]
            counts = np.bincount(code, minlength=len(groups))
            for group, n, m in zip(groups, counts.tolist(), products(x, np.cumsum(counts) - counts)):
                if group in held:
                    held[group][0] += n
                    held[group][1] += m
                else:
                    held[group] = [n, m]
            if len(held) >= HELD:
                yield emit()
                held = {}
        if held:
            yield emit()

    rows = df.select(*by, *[F.col(c).cast("double").alias(c) for c in columns])
    return bounded_batches(rows).mapInArrow(run, f"{kinds}{', ' if by else ''}n_rows long, m array<double>")


def merged(parts: DataFrame, group, by, running: bool = False) -> DataFrame:
    """Vector sums of partial moments by ``by``; with ``running`` summed along each ``group``, which leads ``by``.

    A group's parts are a stream in one task, which holds one matrix.
    """
    group, by = list(group), list(by)

    def run(batches):
        types = step = total = None
        n, out = 0, []

        def emit():
            return pa.RecordBatch.from_arrays([pa.array([r[0][i] for r in out], type=t) for i, t in enumerate(types)] + [pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.list_(pa.float64()))], names=[*by, "n_rows", "m"])

        for batch in batches:
            types = types or [batch.schema.field(c).type for c in by]
            if not batch.num_rows:
                continue
            keys = list(zip(*[batch.column(batch.schema.get_field_index(c)).to_pylist() for c in by])) if by else [()] * batch.num_rows
            counts = batch.column(batch.schema.get_field_index("n_rows")).to_pylist()
            packed = batch.column(batch.schema.get_field_index("m"))
            matrices = packed.flatten().to_numpy().reshape(len(keys), -1)
            for key, k, m in zip(keys, counts, matrices):
                if key != step:
                    if step is not None:
                        out.append((step, n, total))
                        if len(out) >= 256:
                            yield emit()
                            out = []
                    if step is None or not running or key[: len(group)] != step[: len(group)]:
                        n, total = 0, np.zeros(len(m))
                    step = key
                n, total = n + k, total + m
        if step is not None:
            out.append((step, n, total))
            yield emit()

    dealt = parts.repartition(*group) if group else parts.coalesce(1)
    dealt = dealt.sortWithinPartitions(*by) if by else dealt
    return bounded_batches(dealt).mapInArrow(run, T.StructType([*[parts.schema[c] for c in by], parts.schema["n_rows"], parts.schema["m"]]))


def moment_matrix(df: DataFrame, keys, columns, running: str | None = None) -> DataFrame:
    """Per key: ``n_rows`` and the upper triangle ``m`` of the summed products.

    ``columns`` must be complete (no nulls); a constant is a column of ones. Rows stay where they are: each task sums the outer
    products of its own rows by key, and only these partial matrices are shuffled and added up. What moves grows with keys times
    tasks, not with rows, and a key may lie in all tasks.

    With ``running`` (an integer column of steps) there is a row for each step of a key that has rows, summed over all rows up to
    it. Blocks of ``STEPS`` steps are summed apart; a block then starts from the total of those before it, so a long
    key is spread over tasks too.
    """
    keys = list(keys)
    if running is None:
        return merged(partial_moments(df, keys, columns), keys, keys)
    block = "__block"
    parts = partial_moments(df, [*keys, running], columns).withColumn(block, F.floor(F.col(running) / STEPS).cast("long"))
    own = merged(parts, [*keys, block], [*keys, block, running], running=True)
    last = own.groupBy(*keys, block).agg(F.max_by(F.struct("n_rows", "m"), running).alias("__s")).select(*keys, block, "__s.*")
    # The total up to a block is what the next one starts from.
    order = Window.partitionBy(*keys).orderBy(block)
    sums = merged(last, keys, [*keys, block], running=True).select(*[F.col(k).alias(f"__{k}") for k in keys], F.lead(block).over(order).alias("__next"), F.col("n_rows").alias("__n"), F.col("m").alias("__m"))
    before = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys] + [F.col(block) == F.col("__next")]
    started = own.join(sums.where("__next is not null"), before, "left")
    total = F.when(F.col("__m").isNull(), F.col("m")).otherwise(F.zip_with("m", "__m", lambda a, b: a + b))
    return started.select(*keys, running, (F.col("n_rows") + F.coalesce("__n", F.lit(0))).alias("n_rows"), total.alias("m"))


def unpack(m) -> np.ndarray:
    """Full symmetric matrix of a packed upper triangle."""
    k = int((np.sqrt(8 * len(m) + 1) - 1) / 2 + 0.5)
    full = np.zeros((k, k))
    full[np.triu_indices(k)] = m
    return full + np.triu(full, 1).T


def min_norm_solve(gram: np.ndarray, cross: np.ndarray, tolerance: float = 1e-11) -> np.ndarray:
    """Minimum-norm coefficients (one column per target), each regressor in its own size.

    Exactly collinear regressors are allowed: forecasts are unique then,
    coefficients are not.
    """
    size = np.sqrt(np.maximum(np.diag(gram), 0.0))
    size[size == 0] = 1.0
    inverse = np.linalg.pinv(gram / np.outer(size, size), rcond=tolerance, hermitian=True)
    return (inverse @ (cross / size[:, None])) / size[:, None]


DOUBLES = T.ArrayType(T.DoubleType())
SOLVED = T.StructType([T.StructField("coef", T.ArrayType(DOUBLES)), T.StructField("sscp", DOUBLES)])


def regress(full: np.ndarray, x: np.ndarray, y: np.ndarray):
    """Coefficients and residual cross products of targets ``y`` on regressors ``x``.

    The first regressor is the constant: the others are centred on the matrix
    itself, so their own location and scale do not hurt the solve.
    """
    n, rest = full[x[0], x[0]], x[1:]
    mean_x, mean_y = full[x[0], rest] / n, full[x[0], y] / n
    gram = full[np.ix_(rest, rest)] - n * np.outer(mean_x, mean_x)
    cross = full[np.ix_(rest, y)] - n * np.outer(mean_x, mean_y)
    flat = np.diag(gram) <= 1e-12 * np.diag(full)[rest]
    gram[flat], gram[:, flat], cross[flat] = 0.0, 0.0, 0.0
    slopes = min_norm_solve(gram, cross)
    left = full[np.ix_(y, y)] - n * np.outer(mean_y, mean_y) - cross.T @ slopes
    return np.vstack([mean_y - mean_x @ slopes, slopes]), (left + left.T) / 2


@F.pandas_udf(SOLVED)
def _solve(m: pd.Series, x: pd.Series, y: pd.Series) -> pd.DataFrame:
    coefs, residuals = [], []
    for packed, xi, yi in zip(m, x, y):
        full = unpack(np.asarray(packed, dtype=float))
        beta, left = regress(full, np.asarray(xi, dtype=int), np.asarray(yi, dtype=int))
        coefs.append([list(b) for b in beta.T])
        residuals.append(left.ravel().tolist())
    return pd.DataFrame({"coef": coefs, "sscp": residuals})


# Declared non-deterministic only so that the optimizer never evaluates a fit twice.
_solve = _solve.asNondeterministic()


def solve(m: Column | str, x: Column, y: Column) -> Column:
    """``coef`` (one array per target) and the residual cross products ``sscp``.

    ``x`` and ``y`` are arrays of column positions in the moment matrix, the
    constant first in ``x``.
    """
    return _solve(F.col(m) if isinstance(m, str) else m, x, y)


def positions(*index: int) -> Column:
    return F.array(*[F.lit(int(i)) for i in index])


def dot(coefficients: Column, terms) -> Column:
    """Sum of ``coefficients[i] * terms[i]`` as a flat expression."""
    return sum((coefficients[i] * t for i, t in enumerate(terms[1:], 1)), coefficients[0] * terms[0])
