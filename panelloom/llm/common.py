"""Helpers shared by the operators: Arrow batches, word hashes, gapless numbering, connected components."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .. import session

CHUNK_BYTES = 1 << 21
"""Text bytes that one vectorised step inside a task looks at together (a longer text is a step of its own)."""

WORD = r"[^\x20\x09-\x0D]+"
DOCUMENT = ["doc_id", "text", "lang", "source", "n_chars"]

_RNG = np.random.default_rng(20240229)
_BYTE_VALUE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def durable(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder; the shuffle files it took are given back as soon as it is written."""
    df.sparkSession.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    return session.durable(df)


def discard(df: DataFrame) -> None:
    """Delete the table of a ``durable`` frame that nothing reads any more."""
    spark, files = df.sparkSession, df.inputFiles()
    if files:
        folder = spark._jvm.org.apache.hadoop.fs.Path(files[0].rsplit("/", 1)[0])
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit values."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def worker_cache(name: str) -> dict:
    """A dict that the tasks of one Python worker share; functions sent by value have no lasting globals."""
    module = sys.modules.setdefault("panelloom_worker_cache", types.ModuleType("panelloom_worker_cache"))
    return module.__dict__.setdefault(name, {})


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``B**i`` and ``B**-i`` modulo 2**64 for ``i < n``."""
    known = worker_cache("powers")
    if len(known.get("up", ())) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p, step = np.ones(1, np.uint64), base
            while len(p) < size:
                p = np.concatenate([p, p * np.uint64(step)])
                step = step * step % (1 << 64)
            known[name] = p
    return known["up"], known["down"]


def prefix_hashes(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(sums, down)``: ``(sums[b] - sums[a]) * down[a]`` is a hash of the bytes a..b, wherever they stand."""
    up, down = powers(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE_VALUE[buf] * up[: len(buf)], out=sums[1:])
    return sums, down


class Words:
    """The words of some texts, as 64-bit hashes in text order.

    ``hashes``, ``starts``, ``ends`` (byte offsets in ``buffer``), ``doc`` (index of
    the text of each word) and ``counts`` (words per text).
    """

    def __init__(self, texts: list[bytes], lower: bool = False):
        joined = b"\n".join(texts)
        if lower:
            joined = joined.lower()  # of bytes: A-Z alone
        buf = self.buffer = np.frombuffer(joined, np.uint8)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.text_starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]]).astype(np.int64) if len(texts) else np.zeros(0, np.int64)
        blank = self.blank = _BLANK[buf]
        edge = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8)))
        self.starts, self.ends = edge[::2], edge[1::2]
        sums, down = prefix_hashes(buf)
        self.hashes = mix64((sums[self.ends] - sums[self.starts]) * down[self.starts])
        self.doc = np.searchsorted(self.text_starts, self.starts, side="right") - 1
        self.counts = np.bincount(self.doc, minlength=len(texts)).astype(np.int64)

    def shingles(self, n: int) -> list[np.ndarray]:
        """Sorted distinct hashes of the ``n``-word windows of each text; a shorter text is one window."""
        h, total = self.hashes, len(self.hashes)
        acc = np.full(max(total - n + 1, 0), np.uint64(n), np.uint64)
        for k in range(n):
            acc = mix64(acc * np.uint64(0xD6E8FEB86659FD93) + h[k : total - n + 1 + k]) if len(acc) else acc
        offsets = np.concatenate([[0], np.cumsum(self.counts)])
        out = []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            if b - a >= n:
                s = np.sort(acc[a : b - n + 1])
                out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
            elif b > a:
                one = np.full(1, np.uint64(b - a), np.uint64)
                for k in range(a, b):
                    one = mix64(one * np.uint64(0xD6E8FEB86659FD93) + h[k : k + 1])
                out.append(one)
            else:
                out.append(np.zeros(0, np.uint64))
        return out


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """UTF-8 bytes of a text column; null counts as empty."""
    col = batch.column(batch.schema.get_field_index(name))
    kind = pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()
    return [x or b"" for x in col.cast(kind).to_pylist()]


def arrow_map(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """``df.mapInArrow`` with batches of a thousand rows, so that very long texts don't add up."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return df.mapInArrow(fn, schema)


def chunks(texts: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[slice]:
    """Slices of at most ``limit`` bytes, or of one text."""
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > limit:
            yield slice(start, i)
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield slice(start, len(texts))


def map_texts(df: DataFrame, fn: Callable[[list[bytes]], dict[str, list | np.ndarray | pa.Array]], schema: str, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns of ``df`` and the columns that ``fn(texts)`` makes, in bounded steps of whole texts."""
    kept = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keep)
    kind = f"{kept}, {schema}" if kept else schema
    names = T._parse_datatype_string(schema).fieldNames()

    def run(batches):
        for batch in batches:
            texts = texts_of(batch, text)
            for part in chunks(texts):
                made = fn(texts[part])
                cols = [batch.column(batch.schema.get_field_index(k)).slice(part.start, part.stop - part.start) for k in keep]
                yield pa.RecordBatch.from_arrays(cols + [made[n] if isinstance(made[n], pa.Array) else pa.array(made[n]) for n in names], names=[*keep, *names])

    return arrow_map(df.select(*[f"`{k}`" for k in dict.fromkeys([*keep, text])]), run, kind)


def lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """One Arrow list per array."""
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(kind.to_pandas_dtype(), copy=False), kind))


def numbered(df: DataFrame, key: str, order: list[str], out: str, per_bin: int = 20_000) -> DataFrame:
    """``out``: a gapless number from 0 within each ``key``, however large the key.

    The rows of a key are dealt to hashed bins of about ``per_bin`` rows in all; counts
    of the bins are summed up within the key, and each bin is numbered by itself, so that no
    task holds a key. Equal rows are interchangeable. ``df`` must be cheap to read twice.
    """
    bins = max(1, df.count() // per_bin)
    df = df.withColumn("__bin", F.pmod(F.xxhash64(*order), F.lit(bins)))
    sizes = df.groupBy(key, "__bin").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(key).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col(key).alias("__key"), F.col("__bin").alias("__b"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    own = Window.partitionBy(key, "__bin").orderBy(*[F.col(c).asc_nulls_first() for c in order])
    numbers = df.withColumn("__rank", F.row_number().over(own) - 1)
    joined = numbers.join(offsets, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__bin") == F.col("__b")))
    return joined.withColumn(out, F.col("__offset") + F.col("__rank")).drop("__bin", "__rank", "__key", "__b", "__offset")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` for each node of the undirected ``edges``: root is the smallest node it reaches.

    Alternating large and small stars: each round only needs the least neighbour of each node
    (combined before the shuffle) and joins it back, so no neighbourhood is gathered. Rounds grow with the
    logarithm of the longest path; each one is a table in the shared folder.
    """
    def stars(e: DataFrame, small: bool) -> DataFrame:
        if small:
            least = e.groupBy("u").agg(F.min("v").alias("m"))
            joined = e.join(least, "u")
            return joined.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))

    def settle(e: DataFrame) -> tuple[DataFrame, tuple]:
        e = durable(e.where("u > v").distinct())
        mark = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return e, tuple(mark)

    e, mark = settle(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")))
    while mark[0]:
        before = e
        e, new = settle(stars(stars(e, False).where("u > v").distinct(), True))
        discard(before)
        if new == mark:
            break
        mark = new
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
