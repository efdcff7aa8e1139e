"""Quality rules: repetition inside a text, found with a suffix array over its words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, lists, map_texts

SYMBOLS = b"#*$%&|<>"


class RepeatedWords:
    """Suffix array of many texts at once, by prefix doubling, and the longest earlier or later repeat of each suffix.

    ``symbols`` are word identities, ``doc`` the text of each word (ascending). Suffixes end with their text, and
    the text is part of the first symbol, so only suffixes of one text share a prefix. A suffix whose
    rank is unique needs no further round: rounds touch what still ties.
    """

    def __init__(self, symbols: np.ndarray, doc: np.ndarray, ends: np.ndarray):
        n = len(symbols)
        _, first = np.unique(symbols, return_inverse=True)
        self.n, self.ends = n, ends
        self.ranks = [self._rank(doc.astype(np.int64) * (int(first.max()) + 1 if n else 1) + first)]
        open_rows = self._tied(self.ranks[0])
        step = 1
        while len(open_rows):
            rank = self.ranks[-1]
            second = np.where(open_rows + step < ends[open_rows], rank[np.minimum(open_rows + step, n - 1)] + 1, 0)
            order = np.lexsort((second, rank[open_rows]))
            rows, a, b = open_rows[order], rank[open_rows][order], second[order]
            new_group = np.concatenate([[True], a[1:] != a[:-1]])
            new_pair = new_group | np.concatenate([[True], b[1:] != b[:-1]])
            # Ranks are positions in the suffix array at which a group of ties begins, so a group's finer ranks stay inside it.
            at = np.arange(len(rows))
            group_at = np.maximum.accumulate(np.where(new_group, at, 0))
            pair_at = np.maximum.accumulate(np.where(new_pair, at, 0))
            finer = rank.copy()
            finer[rows] = a + (pair_at - group_at)
            self.ranks.append(finer)
            open_rows = np.sort(open_rows[self._is_tied(finer, open_rows)])
            step *= 2
        self.order = np.empty(n, np.int64)
        self.order[self.ranks[-1]] = np.arange(n)

    @staticmethod
    def _rank(keys: np.ndarray) -> np.ndarray:
        _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
        return (np.cumsum(counts) - counts)[inverse]

    def _tied(self, rank: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.bincount(rank, minlength=self.n)[rank] > 1)

    def _is_tied(self, rank: np.ndarray, rows: np.ndarray) -> np.ndarray:
        counts = np.bincount(rank[rows], minlength=self.n)
        return counts[rank[rows]] > 1

    def neighbour_prefixes(self) -> np.ndarray:
        """LCP of each suffix array position with the one before it (0 for the first)."""
        n = self.n
        out = np.zeros(n, np.int64)
        if n < 2:
            return out
        i, j = self.order[:-1].copy(), self.order[1:].copy()
        same = np.flatnonzero(self.ranks[0][i] == self.ranks[0][j])
        i, j = i[same], j[same]
        lcp = np.zeros(len(same), np.int64)
        for level in range(len(self.ranks) - 1, -1, -1):
            rank, a, b = self.ranks[level], i + lcp, j + lcp
            inside = (a < self.ends[i]) & (b < self.ends[j])
            equal = inside & (rank[np.minimum(a, n - 1)] == rank[np.minimum(b, n - 1)])
            lcp += equal * (1 << level)
        out[same + 1] = lcp
        return out

    def longest(self) -> np.ndarray:
        """For each word position, the longest prefix of its suffix that its text has elsewhere too.

        This is the value of the deepest LCP interval that holds the suffix: that of its closer neighbour.
        """
        lcp = self.neighbour_prefixes()
        out = np.zeros(self.n, np.int64)
        out[self.order] = np.maximum(lcp, np.concatenate([lcp[1:], [0]])) if self.n else 0
        return out


def covered(longest: np.ndarray, least: int) -> np.ndarray:
    """Word positions inside the union of the repeats of at least ``least`` words."""
    n = len(longest)
    reach = np.where(longest >= least, np.arange(n) + longest, 0)
    return np.maximum.accumulate(reach) > np.arange(n) if n else np.zeros(0, bool)


def measure(texts: list[bytes], min_repeat: int, window: int) -> dict:
    """The columns of ``repetition`` for some texts."""
    w = Words(texts)
    k = len(texts)
    offsets = np.concatenate([[0], np.cumsum(w.counts)])
    ends = np.repeat(offsets[1:], w.counts)
    longest = RepeatedWords(w.hashes, w.doc, ends).longest()
    inside = covered(longest, min_repeat)
    per_doc = lambda x: np.bincount(w.doc, weights=x, minlength=k).astype(np.int64)
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    # Runs of two texts can touch: cut them where a text begins.
    run_starts = np.union1d(edges[::2], offsets[:-1][(w.counts > 0) & inside[np.minimum(offsets[:-1], max(len(inside) - 1, 0))]] if len(inside) else [])
    run_starts = run_starts.astype(np.int64)
    run_ends = np.minimum(edges[1::2][np.searchsorted(edges[1::2], run_starts, side="right")], ends[run_starts]) if len(run_starts) else run_starts
    run_doc = w.doc[run_starts] if len(run_starts) else run_starts
    parts = np.searchsorted(run_doc, np.arange(k + 1))
    rel = offsets[:-1][run_doc] if len(run_doc) else run_doc
    starts, stops = run_starts - rel, run_ends - rel
    spans = pa.ListArray.from_arrays(pa.array(parts.astype(np.int32)), pa.StructArray.from_arrays([pa.array(starts.astype(np.int32)), pa.array(stops.astype(np.int32))], ["start", "end"]))
    characters = (w.buffer & 0xC0) != 0x80
    chars = np.concatenate([[0], np.cumsum(characters & ~w.blank)])
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    symbols = np.concatenate([[0], np.cumsum(symbol[w.buffer])])
    text_ends = w.text_starts + np.fromiter(map(len, texts), np.int64, k)
    lines = []
    for t in texts:
        full = [x for x in t.split(b"\n") if x.strip()] if b"\n" in t else []
        lines.append(len(full) - len(set(full)))
    best = np.zeros(k, np.int64)
    np.maximum.at(best, w.doc, longest)
    return {"n_words": w.counts, "word_chars": chars[text_ends] - chars[w.text_starts], "n_symbols": symbols[text_ends] - symbols[w.text_starts], "n_dup_lines": np.array(lines, np.int64),
            "n_repeat_words": per_doc(covered(longest, window)), "covered_words": per_doc(inside), "longest_repeat": best, "repeat_spans": spans}


def repetition(docs: DataFrame, keep: list[str], min_repeat: int = 8, window: int = 3, most_covered: float = 0.3, longest: int = 60, least_words: int = 50, most_repeat: float = 0.5, text: str = "text") -> DataFrame:
    """Repetition figures of every whole text, and the verdict of the rules.

    A suffix array over the words of each text gives, by its longest-common-prefix intervals, the maximal repeated
    word strings. ``repeat_spans`` is the union of those of ``min_repeat`` words or more, as word offsets;
    ``n_repeat_words`` counts words in repeated ``window``-word strings. ``base_failed``: under ``least_words`` words, or more than
    ``most_repeat`` of the words so repeated. ``kept``: not base_failed, spans cover at most ``most_covered`` of the words, and no
    repeat is longer than ``longest`` words. Overlapping repeats count. Words are compared by 64-bit hashes.

    Texts are measured in their own partition, a few at a time: there is no shuffle. Null counts as a text
    without words, which fails; repeated rows are measured each; an empty table gives no rows.
    """
    figures = map_texts(docs, lambda texts: measure(texts, min_repeat, window), "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, covered_words long, longest_repeat long, repeat_spans array<struct<start:int,end:int>>", keep, text)
    # Shares of whole counts: a millionth of a word keeps products like 0.3 * 10 on their side.
    failed = (F.col("n_words") < least_words) | (F.col("n_repeat_words") > most_repeat * F.col("n_words") + 1e-6)
    fine = (F.col("covered_words") <= most_covered * F.col("n_words") + 1e-6) & (F.col("longest_repeat") <= longest)
    return figures.withColumn("base_failed", failed).withColumn("kept", ~failed & fine)
