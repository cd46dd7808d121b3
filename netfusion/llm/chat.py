"""Chat formatting as relational expressions.

A conversation's turns are collected into structs and sorted; adjacent turns of one role are merged into blocks by aggregating the
array, and the blocks are joined into one string. Control strings mark a block's role, its texts and its end:

    <|role|>user<|text|>first<|next|>second<|end|><|role|>assistant<|text|>answer<|end|>

Inside roles and texts every ``<|`` becomes ``<||``. No control string begins with ``<||``, so the text can be read back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROLE, TEXT, NEXT, END = "<|role|>", "<|text|>", "<|next|>", "<|end|>"
LOSS_ROLE = "assistant"
#: Turns whose blocks one aggregation finds.
CHUNK = 1024


def escape(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit("<||"))


def unescape(text: Column) -> Column:
    return F.replace(text, F.lit("<||"), F.lit("<|"))


def merge_turns(turns: Column) -> Column:
    """Array of role and texts: sorted turns (role, text) with adjacent ones of one role as one block. An aggregation over the array
    tells where blocks begin, CHUNK turns at a time so that its state stays small, and a block is a slice: each text is copied once."""

    def begins_of(c: Column) -> Column:
        state = F.struct((c * CHUNK).alias("at"), F.get(turns, c * CHUNK - 1)["role"].alias("role"), F.array().cast("array<int>").alias("begins"))
        return F.aggregate(
            F.slice(turns, c * CHUNK + 1, F.lit(CHUNK)),
            state,
            lambda s, t: F.struct(
                (s["at"] + 1).alias("at"), t["role"].alias("role"), F.when(t["role"].eqNullSafe(s["role"]), s["begins"]).otherwise(F.array_append(s["begins"], s["at"])).alias("begins")
            ),
            lambda s: s["begins"],
        )

    begins = F.flatten(F.transform(F.sequence(F.lit(0), F.floor((F.size(turns) - 1) / CHUNK).cast("int")), begins_of))
    spans = F.arrays_zip(begins.alias("first"), F.array_append(F.slice(begins, F.lit(2), F.size(begins)), F.size(turns)).alias("next"))
    return F.transform(
        spans,
        lambda b: F.struct(F.get(turns, b["first"])["role"].alias("role"), F.transform(F.slice(turns, b["first"] + 1, b["next"] - b["first"]), lambda t: t["text"]).alias("texts")),
    )


def segments(formatted: Column, loss_role: str = LOSS_ROLE) -> Column:
    """Array of text and loss: the formatted string cut at its control strings. What isn't a control string is a turn's text."""
    blocks = F.filter(F.split(formatted, r"(?<=<\|end\|>)"), lambda b: b != "")
    opening = ROLE + loss_role.replace("<|", "<||") + TEXT
    control = lambda x: x.startswith("<|") & ~x.startswith("<||")
    pieces = lambda b: F.split(b, r"(?<=<\|text\|>)|(?=<\|next\|>)|(?<=<\|next\|>)|(?=<\|end\|>)")
    return F.flatten(F.transform(blocks, lambda b: F.transform(pieces(b), lambda x: F.struct(x.alias("text"), (b.startswith(opening) & ~control(x)).alias("loss")))))


def format_conversations(rows: DataFrame, loss_role: str = LOSS_ROLE) -> DataFrame:
    """One row per conversation: conv_id, formatted, segments (array of text and loss; joined they are ``formatted``).

    rows: conv_id, turn, role, text; more columns are ignored. Turns go by turn (null first), then role, then text; repeated
    rows are turns of their own. A null role or text is empty; rows with a null conv_id form one conversation. An empty table
    gives no rows. Adjacent turns of one role share a block; the loss covers the texts of ``loss_role`` and nothing else.
    """
    turns = rows.select(
        "conv_id",
        F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"),
    )
    sorted_turns = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    blocks = sorted_turns.select("conv_id", merge_turns(F.col("ts")).alias("blocks"))

    def block(b: Column) -> Column:
        return F.concat(F.lit(ROLE), escape(b["role"]), F.lit(TEXT), F.array_join(F.transform(b["texts"], escape), NEXT), F.lit(END))

    formatted = blocks.select("conv_id", F.array_join(F.transform("blocks", block), "").alias("formatted"))
    return formatted.select("conv_id", "formatted", segments(F.col("formatted"), loss_role).alias("segments"))


def parse_formatted(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of role and text, unescaped, one for each input row."""
    blocks = F.filter(F.split(formatted, r"<\|end\|>"), lambda b: b != "")
    body = lambda b: F.substring_index(b, TEXT, -1)  # noqa: E731  TEXT stands once in a block
    role = lambda b: F.replace(F.substring_index(b, TEXT, 1), F.lit(ROLE), F.lit(""))
    return F.flatten(
        F.transform(
            blocks,
            lambda b: F.transform(F.split(body(b), r"<\|next\|>"), lambda x: F.struct(unescape(role(b)).alias("role"), unescape(x).alias("text"))),
        )
    )


def loss_text(formatted: Column, loss_role: str = LOSS_ROLE) -> Column:
    """All text under the loss mask, unescaped, read from the formatted string alone."""
    return F.array_join(F.transform(F.filter(segments(formatted, loss_role), lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def digest(formatted: DataFrame) -> DataFrame:
    """What op9 returns, read back from formatted conversations."""
    read = formatted.select("conv_id", "formatted", parse_formatted(F.col("formatted")).alias("turns"), loss_text(F.col("formatted")).alias("loss"))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
