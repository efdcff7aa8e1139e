"""Chat formatting, repetition rules and suffix dedup against their definitions."""

import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from panelloom.llm import suffix_dedup
from panelloom.llm.chat import format_chats, read_chats
from panelloom.llm.quality import measure, repetition
from panelloom.llm.suffix_dedup import anchors, deep_shallow_order, remove_repeats

from .helpers import empty, messy

TURNS = "conv_id long, turn long, role string, text string"
NASTY = ["\\### Assistant: </turn> ok", "<|user|>", "<|end|>\n<|assistant|>", "\\l \\b \\\\ <<", "a<|next|>b", "", None, "日本 😀 <", "\n\n", "\\", "<", "\\lx"]


def test_chats_read_back_as_written(spark):
    rng = random.Random(1)
    rows = [(c, t, rng.choice(["user", "assistant", "assistant", "sys>tem<", None, ""]), rng.choice(NASTY)) for c in range(60) for t in range(rng.randrange(1, 9))]
    rows += [(None, 1, "user", "x"), (99, None, "user", "first"), (99, 0, "assistant", "b"), (99, 0, "assistant", "a"), (99, 0, "assistant", "a")]
    got = read_chats(format_chats(spark.createDataFrame(rows, TURNS).withColumn("turns", F.lit(1)))).collect()
    order = lambda r: (r[1] is not None, r[1] or 0, (r[2] or "").encode(), (r[3] or "").encode())
    assert len(got) == len({r[0] for r in rows})
    for r in got:
        own = [(x[2] or "", x[3] or "") for x in sorted((x for x in rows if x[0] == r.conv_id), key=order)]
        assert [(t.role, t.text) for t in r.turns] == own
        assert r.loss_text == "".join(t for role, t in own if role == "assistant")
        assert len(r.loss_spans) == sum(role == "assistant" for role, _ in own)
        assert r.formatted.count("<|end|>\n") == sum(i == 0 or own[i - 1][0] != x[0] for i, x in enumerate(own))


def test_no_turns_give_no_chats(spark):
    assert read_chats(format_chats(spark.createDataFrame([], TURNS))).collect() == []


def naive(text, least, window):
    words = text.encode().split()
    n = len(words)

    def covered(k):
        seen = {}
        for i in range(n - k + 1):
            seen.setdefault(tuple(words[i : i + k]), []).append(i)
        return {j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + k)}

    longest = next((k for k in range(n, 0, -1) if covered(k)), 0)
    lines = [x for x in text.encode().split(b"\n") if x.strip()]
    return {"n_words": n, "word_chars": sum(map(len, re.findall(r"[^\x20\x09-\x0D]+", text))), "n_symbols": sum(text.count(c) for c in "#*$%&|<>"),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered(window)), "covered_words": len(covered(least)), "longest_repeat": longest}, covered(least)


def test_repetition_equals_counting_windows():
    rng = random.Random(2)
    texts = ["", " ", "a", "a a", "a a a a a a a", "x\ny\nx\n\n x\n", "é é é #*$ %&|<>"]
    for _ in range(60):
        words = [rng.choice("abcdeé#") + str(rng.randrange(rng.choice([1, 3, 30]))) for _ in range(rng.randrange(60))]
        if rng.random() < 0.5 and len(words) > 6:
            words += words[2 : rng.randrange(4, len(words))]
        texts.append("".join(w + rng.choice([" ", "  ", "\n", "\t"]) for w in words))
    got = measure([t.encode() for t in texts], 4, 3)
    for k, t in enumerate(texts):
        want, inside = naive(t, 4, 3)
        assert {c: int(got[c][k]) for c in want} == want, t
        spans = got["repeat_spans"][k].as_py()
        assert {i for s in spans for i in range(s["start"], s["end"])} == inside


def test_repetition_keeps_clean_texts_only(spark):
    rng = random.Random(3)
    clean = " ".join(f"w{rng.randrange(10**6)}" for _ in range(300))
    block = " ".join(f"v{rng.randrange(10**6)}" for _ in range(70))
    rows = [(1, clean), (2, "buy now " * 100), (3, "short"), (4, clean + " " + block + " x " + block), (5, clean[:150] + "\n" + clean)]
    got = {r.doc_id: (r.base_failed, r.kept) for r in repetition(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"]).collect()}
    assert got == {1: (False, True), 2: (True, False), 3: (True, False), 4: (False, False), 5: (False, True)}


def test_repetition_of_messy_rows(spark):
    df = messy(spark)
    got = repetition(df, ["doc_id"]).collect()
    assert len(got) == df.count() and sum(r.n_words == 0 for r in got) == 4
    assert repetition(empty(spark), ["doc_id"]).collect() == []


def brute(texts, length):
    seen = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] = seen.get(t[i : i + length], 0) + 1
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        runs = sum(1 for i in range(len(t)) if gone[i] and not (i and gone[i - 1]))
        out.append((len(t), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()))
    return out


def shared_passages(seed):
    rng = random.Random(seed)
    make = lambda n: "".join(rng.choice("abcdefgh é\n") for _ in range(n))
    passages = [make(n) for n in (199, 200, 201, 260, 700)]
    texts = []
    for _ in range(60):
        t = make(rng.randrange(400))
        for _ in range(rng.randrange(4)):
            p = rng.choice(passages)
            a = rng.randrange(len(p) // 2)
            t += p[a:] + make(rng.randrange(60)) if rng.random() < 0.5 else p[: len(p) - a] + make(3)
        texts.append(t)
    return texts + [texts[3], texts[3], "ab" * 300, "a" * 250, make(150) * 4, "", None, "x"]


def figures(df):
    got = remove_repeats(df, ["doc_id"]).collect()
    return sorted((r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in got)


@pytest.mark.parametrize("most", [8_192, 20, 1])
def test_removed_bytes_equal_the_definition(spark, monkeypatch, most):
    monkeypatch.setattr(suffix_dedup, "MOST", most)
    texts = shared_passages(most)
    got = figures(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert got == sorted((i, *x) for i, x in enumerate(brute([(t or "").encode() for t in texts], 200)))


def test_characters_stay_whole(spark):
    text = "é" * 40 + "".join(chr(0x4E00 + i) for i in range(120)) + "ü"
    rows = [(1, "x" + text + "a"), (2, "yé" + text + "b"), (3, "short")]
    for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"], characters=True).collect():
        bytes(r.kept).decode()
        assert len(r.kept) < 10


def test_repeats_in_messy_rows(spark):
    df = messy(spark)
    rows = [(r.doc_id, (r.text or "").encode()) for r in df.collect()]
    small = df.where(F.coalesce(F.length("text"), F.lit(0)) < 10_000)
    got = remove_repeats(small, ["doc_id"]).collect()
    want = brute([t for _, t in rows if len(t) < 10_000], 200)
    assert sorted((r.n_bytes, sum(s.end - s.start for s in r.spans)) for r in got) == sorted(w[:2] for w in want)
    assert remove_repeats(empty(spark), ["doc_id"]).collect() == []


def test_a_long_text_has_the_same_anchors_in_parts(monkeypatch):
    rng = random.Random(6)
    text = bytes(rng.choice(b"abcdefgh") for _ in range(30_000))
    whole = anchors([text], 200)
    monkeypatch.setattr(suffix_dedup, "PART", 1000)
    parts = anchors([text], 200)
    assert all((a == b).all() for a, b in zip(whole, parts))


def test_deep_shallow_order_is_the_sorted_order():
    rng = random.Random(7)
    deep = bytes(rng.choice(b"ab") for _ in range(100))
    strings = [(deep[: rng.randrange(100)] + bytes(rng.choice(b"ab") for _ in range(30))).ljust(140, b"\xff") for _ in range(300)]
    strings += strings[:20]
    order = deep_shallow_order(strings, [int.from_bytes(s, "big") for s in strings])
    assert sorted(order) == list(range(len(strings))) and [strings[i] for i in order] == sorted(strings)


def test_many_rows_of_one_id_take_no_longer_than_many_ids(spark):
    """5,000 equal rows: matches are joined once per distinct context, not once per pair of rows."""
    text = " ".join(f"w{i * 7919 % 1000}" for i in range(120))
    seconds = []
    for one in (False, True):
        df = spark.createDataFrame([(1 if one else i, text) for i in range(5000)], "doc_id long, text string")
        start = time.time()
        got = remove_repeats(df, ["doc_id"]).collect()
        seconds.append(time.time() - start)
        assert len(got) == 5000 and all(r.kept == b"" and [(s.start, s.end) for s in r.spans] == [(0, len(text))] for r in got)
    assert seconds[1] < 3 * seconds[0] + 20
