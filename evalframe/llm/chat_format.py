"""Chat formatting by prefix-target expansion.

Every assistant turn becomes one example: all turns before it as context and that reply,
alone, under the loss mask. Turns after the last reply form one more example without a
target, so no turn is lost. The output of a conversation is quadratic in its turns, which is
what the method makes; an example is a prefix of the rendered conversation, cut in its own
row, so no group ever holds more than one conversation.

A turn renders as ``<|turn|>role<|text|>text<|end|>`` and a line break. Inside roles and
texts every control string gets a ``~`` after its first character, and one more where
tildes are already there; taking one away again restores the text exactly. The control
strings of other templates (``<s>``, ``</s>``, ``[INST]``, ``[/INST]``, ``<|...``) are escaped
too, so text cannot end or start a turn after a later change of template.

Nulls and odd input: null roles and texts are empty, rows with a null conversation id form
one conversation, turns with equal numbers go by role, then text. Repeated rows are separate
turns. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalframe.llm.quality import let

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>\n"
_CONTROL = r"([<\[])(~*)(\||/?s>|/?INST\])"
_ESCAPED = r"([<\[])~(~*)(\||/?s>|/?INST\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, "$1~$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def format_conversations(
    rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    trainable: str = "assistant",
) -> DataFrame:
    """``conv_id, example, n_turns, final, text, loss_start, loss_chars``, one row per example.

    ``loss_start`` (0-based) and ``loss_chars`` count code points of ``text``; an example
    without target has null ``loss_start`` and 0 ``loss_chars``. ``final`` marks the one
    example of a conversation that holds all its turns.
    """
    turns = rows.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"),
        F.coalesce(text, F.lit("")).alias("text"),
    ).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("_turns"))
    head = lambda t: F.concat(F.lit(TURN), escape(t["role"]), F.lit(TEXT))
    rendered = turns.withColumn("_parts", F.transform("_turns", lambda t: F.struct(
        head(t).alias("head"), escape(t["text"]).alias("body"), (t["role"] == trainable).alias("target"),
    )))
    # Where each turn ends and its text begins, by running totals.
    ends = F.aggregate(
        "_parts",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,chars:int,stop:int>>").alias("spans")),
        lambda a, p: let(
            a["at"] + F.length(p["head"]),
            lambda start: F.struct(
                (start + F.length(p["body"]) + len(END)).alias("at"),
                F.concat(a["spans"], F.array(F.struct(
                    start.alias("start"), F.length(p["body"]).alias("chars"),
                    (start + F.length(p["body"]) + len(END)).alias("stop"),
                ))).alias("spans"),
            ),
        ),
        lambda a: a["spans"],
    )
    whole = F.array_join(F.transform("_parts", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "")
    laid = rendered.select("conv_id", "_parts", whole.alias("_whole"), ends.alias("_spans"))
    last = F.size("_parts") - 1
    spread = laid.select(
        "conv_id", "_whole", last.alias("_last"),
        F.posexplode(F.arrays_zip(F.transform("_parts", lambda p: p["target"]).alias("target"), F.col("_spans").alias("span"))),
    )
    target = F.col("col.target")
    return spread.where(target | (F.col("pos") == F.col("_last"))).select(
        "conv_id", F.col("pos").cast("bigint").alias("example"), (F.col("pos") + 1).cast("bigint").alias("n_turns"),
        (F.col("pos") == F.col("_last")).alias("final"),
        F.col("_whole").substr(F.lit(1), F.col("col.span.stop")).alias("text"),
        F.when(target, F.col("col.span.start")).cast("bigint").alias("loss_start"),
        F.when(target, F.col("col.span.chars")).otherwise(0).cast("bigint").alias("loss_chars"),
    )


def read_turns(text: Column) -> Column:
    """The turns of an example as ``array<struct<role, text>>``, unescaped."""
    blocks = F.filter(F.split(text, r"<\|turn\|>"), lambda _, i: i > 0)
    return F.transform(blocks, lambda b: let(F.split(b, r"<\|text\|>"), lambda p: F.struct(
        unescape(F.get(p, 0)).alias("role"),
        unescape(F.get(p, 1).substr(F.lit(1), F.length(F.get(p, 1)) - len(END))).alias("text"),
    )))


def digests(examples: DataFrame) -> DataFrame:
    """What the examples hold, read back from their texts and masks, one row per conversation.

    Only the final example of a conversation is parsed for its turns, in its own row; the
    grouping gets digests and masked texts, never whole prefixes.
    """
    joined = lambda turns: F.array_join(
        F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
    )
    told = let(read_turns(F.col("text")), lambda turns: F.struct(
        F.size(turns).cast("bigint").alias("n"), F.sha2(joined(turns), 256).alias("sha"),
    ))
    masked = unescape(F.col("text").substr(F.col("loss_start").cast("int") + 1, F.col("loss_chars").cast("int")))
    per = examples.select(
        "conv_id", F.when(F.col("final"), told).alias("_told"), F.length("text").alias("_chars"),
        F.when(F.col("loss_start").isNotNull(), F.struct(F.col("example"), masked.alias("text"))).alias("_loss"),
    ).groupBy("conv_id").agg(
        F.max("_told").alias("_told"), F.array_sort(F.collect_list("_loss")).alias("_losses"),
        F.sum("_chars").cast("bigint").alias("formatted_chars"),
    ).withColumn("_text", F.array_join(F.transform("_losses", lambda x: x["text"]), ""))
    return per.select(
        "conv_id", F.col("_told.n").alias("n_turns"), F.col("_told.sha").alias("turns_sha256"),
        F.length("_text").cast("bigint").alias("loss_chars"), F.sha2("_text", 256).alias("loss_sha256"),
        "formatted_chars",
    )
