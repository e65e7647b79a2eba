"""Chat formatting with Spark expressions only: collected turn structs, sorted, merged and concatenated.

A formatted conversation is a sequence of blocks
``<|im_start|>ROLE\\nTEXT[<|im_sep|>TEXT...]<|im_end|>\\n``; adjacent turns of one role share a block.
Each ``<|`` in a role or text is written ``<||``, so that no control string can appear inside one, and
reading back turns ``<||`` into ``<|``.  A line feed in a role is written ``<|nl|>``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END, NL = "<|im_start|>", "<|im_sep|>", "<|im_end|>", "<|nl|>"


def _escape(c: Column) -> Column:
    return F.replace(c, F.lit("<|"), F.lit("<||"))


def _unescape(c: Column) -> Column:
    return F.replace(c, F.lit("<||"), F.lit("<|"))


def format_chats(turns: DataFrame, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text", *, loss_role: str = "assistant") -> DataFrame:
    """(conv_col, formatted, mask): one row per conversation.

    ``mask`` is run-length coded over the code points of ``formatted``: (length, loss) runs, loss being
    true over the texts of ``loss_role`` only.  Turns are sorted by turn, ties by role and text; repeated
    rows are repeated turns.  Null roles and texts are empty; null turn numbers come first; a null
    conversation id is a conversation of its own.  Empty input: no rows.  Other columns are not read.
    A conversation becomes one string, so one row holds all its turns.
    """
    src = turns.select(
        F.col(conv_col).alias("conv"),
        F.struct(
            F.col(turn_col).alias("turn"),
            F.coalesce(F.col(role_col), F.lit("")).alias("role"),
            F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        ).alias("t"),
    )
    got = src.groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    role_at = lambda i: F.get("turns", i)["role"]
    got = got.withColumn(
        "starts", F.filter(F.sequence(F.lit(0), F.size("turns") - 1), lambda i: (i == 0) | ~role_at(i).eqNullSafe(role_at(i - 1)))
    )

    def block(s: Column, j: Column) -> Column:
        to = F.coalesce(F.get("starts", j + 1), F.size("turns"))
        return F.struct(role_at(s).alias("role"), F.transform(F.slice("turns", s + 1, to - s), lambda t: _escape(t["text"])).alias("texts"))

    got = got.withColumn("blocks", F.transform("starts", block))
    head = lambda b: F.concat(F.lit(START), F.replace(_escape(b["role"]), F.lit("\n"), F.lit(NL)), F.lit("\n"))
    formatted = F.array_join(F.transform("blocks", lambda b: F.concat(head(b), F.array_join(b["texts"], SEP), F.lit(END + "\n"))), "")

    def run(length: Column, loss: Column) -> Column:
        return F.struct(length.cast("int").alias("length"), loss.alias("loss"))

    def runs(b: Column) -> Column:
        texts = F.flatten(
            F.transform(
                b["texts"],
                lambda t, i: F.array(
                    run(F.when(i == 0, F.length(head(b))).otherwise(len(SEP)), F.lit(False)), run(F.length(t), b["role"] == loss_role)
                ),
            )
        )
        return F.concat(texts, F.array(run(F.lit(len(END) + 1), F.lit(False))))

    return got.select(F.col("conv").alias(conv_col), formatted.alias("formatted"), F.flatten(F.transform("blocks", runs)).alias("mask"))


def read_chats(formatted: DataFrame, conv_col="conv_id") -> DataFrame:
    """(conv_col, turns, loss_texts) read back from ``formatted`` and ``mask``.

    ``turns`` are (role, text) structs, one for each input turn.  ``loss_texts``: the unescaped texts whose
    run in the mask has loss, in order.  The text runs of the mask are those at odd places of a block, which
    is how they meet the texts split from ``formatted``.
    """
    blocks = F.transform(
        F.slice(F.split("formatted", r"<\|im_start\|>", -1), 2, 1 << 30),
        lambda b: F.struct(
            _unescape(F.replace(F.substring_index(b, "\n", 1), F.lit(NL), F.lit("\n"))).alias("role"),
            F.split(
                F.regexp_replace(F.regexp_replace(b, r"\A[^\n]*\n", ""), r"<\|im_end\|>\n\z", ""),
                r"<\|im_sep\|>",
                -1,
            ).alias("texts"),
        ),
    )
    got = formatted.select(F.col(conv_col).alias("conv"), "mask", blocks.alias("blocks"))
    turns = F.flatten(F.transform("blocks", lambda b: F.transform(b["texts"], lambda t: F.struct(b["role"].alias("role"), _unescape(t).alias("text")))))
    # Runs that follow a block's head or separator: all runs but heads, separators and ends.
    sizes = F.flatten(F.transform("blocks", lambda b: F.concat(F.flatten(F.transform(b["texts"], lambda _: F.array(F.lit(False), F.lit(True)))), F.array(F.lit(False)))))
    slots = F.filter(F.zip_with("mask", sizes, lambda m, s: F.when(s, m)), lambda m: m.isNotNull())
    got = got.select("conv", turns.alias("turns"), slots.alias("slots"))
    loss = F.transform(F.filter(F.zip_with("turns", "slots", lambda t, m: F.struct(t["text"].alias("text"), m["loss"].alias("loss"))), lambda x: x["loss"]), lambda x: x["text"])
    return got.select(F.col("conv").alias(conv_col), "turns", loss.alias("loss_texts"))
