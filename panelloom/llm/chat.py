r"""Chat formatting with Spark expressions only.

The template. A run of adjacent turns of one role is a block::

    <|role|>first text<|next|>second text<|end|>\n

Texts and roles can't contain a marker: ``\`` is written ``\b`` and ``<`` is written ``\l`` (in roles also ``>`` as
``\g``), so no ``<`` is left outside markers. Undoing ``\g`` and ``\l`` first and ``\b`` last gives the text back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, SHUT, NEXT, END = "<|", "|>", "<|next|>", "<|end|>\n"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit(">"), F.lit("\\g"))


def unescaped_role(role: Column) -> Column:
    return unescaped(F.replace(role, F.lit("\\g"), F.lit(">")))


def format_chats(turns: DataFrame, learn: str = "assistant", conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(conv_id, formatted, loss_spans)``: one string per conversation and where its loss applies.

    Turn structs of a conversation are collected and sorted by turn (null first; ties by role, then text), adjacent turns
    of one role become a block, and blocks are concatenated. ``loss_spans`` are the code point offsets (start, end) of
    the texts of role ``learn``, one per turn, in order; they hold escaped text. Null text or role counts as
    empty; repeated rows are turns of their own; rows without a conversation id form one conversation of id null; an
    empty table gives no rows. A conversation is one output value, so it is gathered whole; other columns are ignored.
    """
    piece = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    gathered = turns.groupBy(F.col(conv).alias("conv_id")).agg(F.array_sort(F.collect_list(piece)).alias("turns"))
    # Positions at which a block begins, then one slice of turns per block.
    begins = F.filter(F.sequence(F.lit(0), F.size("turns") - 1), lambda i: (i == 0) | (F.col("turns")[i]["role"] != F.col("turns")[F.greatest(i - 1, F.lit(0))]["role"]))
    marked = gathered.withColumn("begins", begins)
    blocks = F.transform("begins", lambda b, k: F.slice("turns", b + 1, F.coalesce(F.get("begins", k + 1), F.size("turns")) - b))
    blocked = marked.withColumn("blocks", F.transform(blocks, lambda x: F.struct(escaped_role(x[0]["role"]).alias("role"), F.transform(x, lambda t: escaped(t["text"])).alias("texts"))))
    merged = F.transform("blocks", lambda x: F.concat(F.lit(OPEN), x["role"], F.lit(SHUT), F.array_join(x["texts"], NEXT), F.lit(END)))
    # Running offset over the turns: each turn has its text and the marker before it; a block's last turn also has the end.
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def block_step(s: Column, b: Column) -> Column:
        first = s["at"] + len(OPEN) + F.char_length(b["role"]) + len(SHUT)
        inner = F.aggregate(b["texts"], F.struct(first.alias("at"), s["spans"].alias("spans")), lambda q, t: F.struct(
            (q["at"] + F.char_length(t) + len(NEXT)).alias("at"),
            F.when(b["role"] == escaped_role(F.lit(learn)), F.concat(q["spans"], F.array(F.struct(q["at"].alias("start"), (q["at"] + F.char_length(t)).alias("end"))))).otherwise(q["spans"]).alias("spans")))
        return F.struct((inner["at"] - len(NEXT) + len(END)).alias("at"), inner["spans"].alias("spans"))

    spans = F.aggregate("blocks", state, block_step, lambda s: s["spans"])
    return blocked.select("conv_id", F.array_join(merged, "").alias("formatted"), spans.alias("loss_spans"))


def read_chats(formatted: DataFrame) -> DataFrame:
    """Adds to formatted chats what can be read back: ``turns`` (role, text) and ``loss_text``, both unescaped."""
    body = F.filter(F.split("formatted", F.lit("<\\|end\\|>\n")), lambda b: b != "")
    def turns_of(b: Column) -> Column:
        shut = F.instr(b, SHUT)
        role = unescaped_role(F.substring(b, F.lit(len(OPEN) + 1), shut - len(OPEN) - 1))
        texts = F.split(F.substring(b, shut + len(SHUT), F.char_length(b)), F.lit("<\\|next\\|>"))
        return F.transform(texts, lambda t: F.struct(role.alias("role"), unescaped(t).alias("text")))
    loss = F.array_join(F.transform("loss_spans", lambda s: unescaped(F.substring("formatted", s["start"] + 1, s["end"] - s["start"]))), "")
    return formatted.withColumn("turns", F.flatten(F.transform(body, turns_of))).withColumn("loss_text", loss)
