"""Token ids in binary files whose document boundaries are Elias-Fano coded.

A file is a segment: a run of documents in ascending id order. Its parts are a header, the concatenated ids (2 or 4
bytes each), the running ends of the documents, and the document ids; the latter two are Elias-Fano sequences.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import fresh_path
from .common import arrow_map, chunks, column, durable, worker_cache

SEGMENT_IDS = 1 << 21
"""Ids after which a segment is closed (a longer document is a segment of its own)."""
MEMO_WORDS, MEMO_CHARS = 1_000_000, 12
"""Words whose ids a Python worker remembers, and how long they can be; all others are encoded each time."""
MAGIC = b"EFTOKEN1"
HEADER = "<8sQQQQqQQ"
SAMPLE = 256


class EliasFano:
    """A non-decreasing sequence of integers from 0 on in about 2 + log2(last / n) bits each.

    Of each value the low bits are stored as they are; the rest is in a bit vector with a one at position
    (value >> low) + index. ``get(i)`` needs the i-th one: 32-bit samples of every 256th one's position lead to the
    bytes in which to count on.
    """

    def __init__(self, data: bytes):
        self.n, self.low, lows, highs, self.base = struct.unpack_from("<QQQQQ", data)
        at = 40
        self.lows = np.frombuffer(data, np.uint8, lows, at)
        self.highs = np.frombuffer(data, np.uint8, highs, at + lows)
        self.samples = np.frombuffer(data, "<u4", -(-self.n // SAMPLE), at + lows + highs)

    @staticmethod
    def encode(values: np.ndarray) -> bytes:
        values = np.asarray(values, np.uint64)
        n = len(values)
        base = int(values[0]) if n else 0
        values = values - np.uint64(base)
        low = max(0, (int(values[-1]) // n).bit_length() - 1) if n else 0
        bits = (values[:, None] >> np.arange(low, dtype=np.uint64)).astype(np.uint8) & 1
        ones = ((values >> np.uint64(low)) + np.arange(n, dtype=np.uint64)).astype(np.int64)
        vector = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        vector[ones] = 1
        lows, highs = np.packbits(bits, bitorder="little").tobytes(), np.packbits(vector, bitorder="little").tobytes()
        return struct.pack("<QQQQQ", n, low, len(lows), len(highs), base) + lows + highs + ones[::SAMPLE].astype("<u4").tobytes()

    def select(self, i: int) -> int:
        """Position of the i-th one of the bit vector."""
        at = int(self.samples[i // SAMPLE])
        left, byte = i % SAMPLE, at // 8
        first = True
        while True:
            part = np.unpackbits(self.highs[byte : byte + 64], bitorder="little")
            if first:
                part[: at % 8] = 0
                first = False
            ones = np.flatnonzero(part)
            if left < len(ones):
                return byte * 8 + int(ones[left])
            left, byte = left - len(ones), byte + 64

    def get(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, low = i * self.low, 0
        if self.low:
            own = np.unpackbits(self.lows[at // 8 : (at + self.low + 7) // 8], bitorder="little")[at % 8 : at % 8 + self.low]
            low = sum(int(b) << k for k, b in enumerate(own))
        return self.base + ((self.select(i) - i) << self.low | low)

    def all(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.highs, bitorder="little"))[: self.n].astype(np.uint64)
        out = (ones - np.arange(self.n, dtype=np.uint64)) << np.uint64(self.low)
        if self.low:
            bits = np.unpackbits(self.lows, bitorder="little")[: self.n * self.low].reshape(-1, self.low)
            out |= bits.astype(np.uint64) @ (np.uint64(1) << np.arange(self.low, dtype=np.uint64))
        return out + np.uint64(self.base)


class Segment:
    """One file: ``ids(i)`` and ``doc_id(i)`` of its i-th document, read through the select structures."""

    def __init__(self, data: bytes):
        magic, self.n_docs, n_ids, width, self.n_null, self.least, ends, docs = struct.unpack_from(HEADER, data)
        if magic != MAGIC:
            raise ValueError("not a token file")
        at = struct.calcsize(HEADER)
        self.values = np.frombuffer(data, f"<u{width}", n_ids, at)
        at += n_ids * width
        self.ends = EliasFano(data[at : at + ends])
        self.docs = EliasFano(data[at + ends : at + ends + docs])

    @staticmethod
    def encode(doc_ids: list[int | None], documents: list[np.ndarray], wide: bool) -> bytes:
        """``doc_ids`` ascend, nulls first."""
        kind = "<u4" if wide else "<u2"
        known = [d for d in doc_ids if d is not None]
        least = known[0] if known else 0
        ends = EliasFano.encode(np.cumsum([len(d) for d in documents]))
        docs = EliasFano.encode(np.array([d - least for d in known], np.uint64))
        ids = np.concatenate(documents).astype(kind)
        return struct.pack(HEADER, MAGIC, len(documents), len(ids), 4 if wide else 2, len(doc_ids) - len(known), least, len(ends), len(docs)) + ids.tobytes() + ends + docs

    def ids(self, i: int) -> np.ndarray:
        return self.values[self.ends.get(i - 1) if i else 0 : self.ends.get(i)]

    def doc_id(self, i: int) -> int | None:
        return None if i < self.n_null else self.least + self.docs.get(i - self.n_null)

    def doc_ids(self) -> list[int | None]:
        return [None] * self.n_null + [self.least + d for d in self.docs.all().tolist()]


def byte_characters() -> dict[int, str]:
    """How the byte level writes each byte: printable ones of Latin-1 as they are, the others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class WordIds(dict):
    """Ids of " word" by word, worked out when asked for the first time; short words are remembered.

    A word of Latin letters, the punctuation at its end, a line feed after that and the like again are single pieces for
    the tokenizer's model. Anything else goes to the tokenizer as it is.
    """

    LETTERS, MARKS = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+", "[!-/:-@\\[-`{-~]*"
    SIGNS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())
    PLAIN = re.compile(f"({LETTERS})({MARKS})(?:\n({LETTERS})({MARKS}))?")

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer, self.model, self.characters = tokenizer, tokenizer.model, byte_characters()
        self.code, self.blank = "I" if tokenizer.get_vocab_size() > 1 << 16 else "H", self.characters[32]
        self.marks: dict[str, bytes] = {}

    def direct(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def shown(self, text: str) -> bytes:
        """Ids of one piece, given as the byte level writes it."""
        return array(self.code, [t.id for t in self.model.tokenize(text)]).tobytes()

    def piece(self, text: str) -> bytes:
        """Ids of a string that the pattern takes as one piece."""
        return self.shown(text.encode().decode("latin-1").translate(self.characters))

    def ending(self, marks: str) -> bytes:
        if marks not in self.marks:
            ids = self.piece(marks)
            if len(self.marks) >= 1000:
                return ids
            self.marks[marks] = ids
        return self.marks[marks]

    def __missing__(self, word: str) -> bytes:
        letters = word.rstrip(self.SIGNS) if word.isascii() else ""
        if letters.isalpha():
            # The byte level leaves these letters as they are.
            marks = word[len(letters) :]
            ids = self[letters] + self.ending(marks) if marks else self.shown(self.blank + word)
        elif not (plain := self.PLAIN.fullmatch(word)):
            ids = self.direct(" " + word)
        else:
            letters, marks, after, more = plain.groups()
            if not marks and after is None:
                ids = self.piece(" " + letters)
            else:
                ids = self[letters]
                if marks:
                    ids += self.ending(marks)
                if after is not None:
                    ids += self.ending("\n") + self.piece(after) + (self.ending(more) if more else b"")
        if len(word) <= MEMO_CHARS and len(self) < MEMO_WORDS:
            self[word] = ids
        return ids


def word_wise(tokenizer) -> bool:
    """If the tokenizer's own configuration lets a text be encoded word by word: byte-level BPE with the usual pattern and nothing before it.

    No normalizer, no blank put in front, no added token with white space in it (or that takes the blanks around it).
    """
    made = json.loads(tokenizer.to_str())
    pre, model = made.get("pre_tokenizer") or {}, made.get("model") or {}
    plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and made.get("normalizer") is None
    bare = model.get("type") == "BPE" and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix") and not model.get("ignore_merges") and not model.get("dropout")
    return bool(plain and bare) and not any(re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] or t["single_word"] for t in made.get("added_tokens") or []) and not made.get("truncation") and not made.get("padding")


class Encoder:
    """Ids of whole texts, the same as the tokenizer gives: word by word where its configuration allows that, else as they are.

    The byte-level pattern never joins what stands before a single space between two other characters with what follows, so
    a text without neighbouring white space is the ids of its first word and of " word" for all others.
    """

    BLANKS = re.compile(r"\s\s")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        cache = worker_cache(f"tokenizer {path}")
        if not cache:
            tokenizer = Tokenizer.from_file(path)
            cache["words"], cache["word_wise"] = WordIds(tokenizer), word_wise(tokenizer)
        self.words: WordIds = cache["words"]
        self.word_wise: bool = cache["word_wise"]
        self.wide = self.words.code == "I"
        self.kind = np.dtype("<u4" if self.wide else "<u2")

    def ids(self, text: str) -> bytes:
        if not self.word_wise or self.BLANKS.search(text):
            return self.words.direct(text)
        head, *rest = text.split(" ")
        return self.words.direct(head) + b"".join(map(self.words.__getitem__, rest))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(self.ids(t), self.kind) for t in texts]


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, id_column: str = "doc_id", text: str = "text", end_id: int = 0) -> DataFrame:
    """Writes ``docs`` as token files into ``folder``; returns their manifest (part, seq, path, n_docs, n_ids).

    Rows are range-partitioned by id (and the text's hash, so that one id may fill several parts) and sorted; a part closes a file
    at about ``SEGMENT_IDS`` ids, so a task holds one segment. File names are new for every attempt and the
    manifest, a table of the shared folder, lists those of successful tasks only. Null text counts as empty
    (just ``end_id``), null ids come first, repeated rows are documents of their own; an empty table gives an empty
    manifest.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("hash", F.xxhash64("text")).repartitionByRange(F.col("doc_id").asc_nulls_first(), "hash").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "hash")

    def run(batches):
        encoder, part, seq = Encoder(tokenizer), TaskContext.get().partitionId(), 0
        files, root = FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        ids, held, size = [], [], 0

        def close():
            name = f"{root}/{part:06d}-{seq:05d}-{uuid.uuid4().hex}.eft"
            with files.open_output_stream(name) as out:
                out.write(Segment.encode(ids, held, encoder.wide))
            return pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "path": name[len(root) + 1 :], "n_docs": len(ids), "n_ids": size}])

        for batch in batches:
            texts, keys = column(batch, "text"), column(batch, "doc_id")
            for some in chunks(texts):
                for key, own in zip(keys[some], encoder.encode(texts[some])):
                    if held and size + len(own) + 1 > SEGMENT_IDS:
                        yield close()
                        ids, held, size, seq = [], [], 0, seq + 1
                    ids.append(key)
                    held.append(np.append(own, encoder.kind.type(end_id)))
                    size += len(own) + 1
        if held:
            yield close()

    return durable(arrow_map(rows.select("doc_id", "text"), run, "part long, seq long, path string, n_docs long, n_ids long"))


def read_tokens(manifest: DataFrame, folder: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document in the files: offsets come from the boundary sequences."""
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("part").alias("_part"), F.coalesce(F.sum("n").over(before(Window.orderBy("part"))), F.lit(0)).alias("_start"))
    inner = F.coalesce(F.sum("n_ids").over(before(Window.partitionBy("part").orderBy("seq"))), F.lit(0))
    placed = manifest.withColumn("_inner", inner).join(parts, F.col("part") == F.col("_part"))
    placed = placed.select("path", (F.col("_start") + F.col("_inner")).alias("start"))

    def run(batches):
        files, root = FileSystem.from_uri(folder)
        for batch in batches:
            for path, start in zip(column(batch, "path"), column(batch, "start")):
                with files.open_input_stream(f"{root}/{path}") as data:
                    segment = Segment(data.read())
                ends = segment.ends.all().astype(np.int64)
                begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                whole = segment.values.astype("<u4")
                crc = [zlib.crc32(whole[a:b].tobytes()) for a, b in zip(begins.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(segment.doc_ids(), pa.int64()), pa.array(begins + start), pa.array(ends - begins), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    many = max(1, manifest.sparkSession.sparkContext.defaultParallelism * 4)
    return placed.repartition(many, "path").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_folder(df: DataFrame) -> str:
    """A new folder of the shared one, as an address that executors can open."""
    path = fresh_path(df.sparkSession, "tokens")
    return re.sub(r"^file:/+", "file:///", path) if path.startswith("file:") else path if "://" in path else f"file://{path}"
