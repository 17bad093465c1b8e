"""Chat formatting by prefix-target expansion, in DataFrame functions alone.

A turn becomes ``### role: text</turn>`` and a line feed. Texts and roles are escaped, so that no
control string can arise inside them and every text comes back exactly. Each assistant turn gives
an example of its own: all turns up to it as context, and only its text trainable. Turns after the
last assistant turn, or a conversation without one, give one more example that trains nothing, so
that the output holds every turn.

A conversation is put together once; its examples are prefixes of it, taken when they are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, SEPARATOR, CLOSE = "### ", ": ", "</turn>\n"
#: Fixed escapes; the backslash goes first and comes back last.
ESCAPES = (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"), (":", "\\c"))


def escape(text: Column, role: bool = False) -> Column:
    for plain, code in ESCAPES if role else ESCAPES[:-1]:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def _whole(conversations: DataFrame) -> DataFrame:
    """One row per conversation: its formatted text, and its replies with their place in it."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    turns = conversations.select(
        "conv_id", "turn", role.alias("role"), text.alias("text")
    ).select(
        "conv_id", "turn", "role", "text",
        F.concat(F.lit(OPEN), escape(F.col("role"), role=True), F.lit(SEPARATOR)).alias("head"),
        escape(F.col("text")).alias("body"),
    )
    # Running sums over the same order that the texts are joined in; equal rows are equal in both.
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    size = F.length("head") + F.length("body") + len(CLOSE)
    placed = turns.withColumn("place", F.row_number().over(order)).withColumn(
        "start",
        F.sum(size.cast("bigint")).over(order.rowsBetween(Window.unboundedPreceding, -1)),
    )
    reply = F.struct(
        F.col("place").alias("target"),
        (F.coalesce("start", F.lit(0)) + F.length("head")).cast("int").alias("loss_start"),
        F.length("body").alias("loss_length"),
        (F.coalesce("start", F.lit(0)) + size).cast("int").alias("end"),
    )
    piece = F.concat("head", "body", F.lit(CLOSE))
    return placed.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("place", piece.alias("piece")))).alias("pieces"),
        F.array_sort(F.collect_list(F.when(F.col("role") == "assistant", reply))).alias("replies"),
        F.max("place").alias("n"),
    ).select(
        "conv_id", F.array_join("pieces.piece", "").alias("whole"), "replies", "n",
    )


def examples(conversations: DataFrame) -> DataFrame:
    """One row per example: ``conv_id, target, text, loss_start, loss_length, complete``.

    ``text[loss_start : loss_start + loss_length]`` (code points) is the trainable reply, nothing
    of an example whose ``target`` is null; ``target`` counts turns from 1 and ``complete`` marks
    the example with all turns. Null texts and roles are empty, a null ``conv_id`` is a
    conversation, equal turns are ordered by role and text and all stay; columns beyond
    ``conv_id, turn, role, text`` are not looked at. An empty table gives no example.
    """
    whole = _whole(conversations)
    last = F.coalesce(F.element_at("replies", -1)["target"], F.lit(0))
    tail = F.struct(
        F.lit(None).cast("int").alias("target"), F.lit(0).alias("loss_start"),
        F.lit(0).alias("loss_length"), F.length("whole").alias("end"),
    )
    every = F.when(
        F.size("replies") == 0, F.array(tail)
    ).when(last < F.col("n"), F.concat("replies", F.array(tail))).otherwise(F.col("replies"))
    return whole.select(
        "conv_id", "whole", F.explode(every).alias("e"), F.col("n"),
    ).select(
        "conv_id", "e.target", F.expr("substring(whole, 1, e.end)").alias("text"),
        "e.loss_start", "e.loss_length",
        (F.col("e.end") == F.length("whole")).alias("complete"),
    )


def loss_text(text: str = "text") -> Column:
    """The trainable reply of an example as it was before formatting."""
    return unescape(F.expr(f"substring({text}, loss_start + 1, loss_length)"))


def turns(text: Column) -> Column:
    """Role and text of each turn, read back from a formatted text."""
    parts = F.filter(F.split(text, CLOSE), lambda p: p != "")
    return F.transform(
        parts,
        lambda p: F.struct(
            unescape(F.substr(
                F.substring_index(p, SEPARATOR, 1), F.lit(len(OPEN) + 1)
            )).alias("role"),
            unescape(F.substr(
                p, F.length(F.substring_index(p, SEPARATOR, 1)) + len(SEPARATOR) + 1
            )).alias("text"),
        ),
    )
