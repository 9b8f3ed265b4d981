"""Chat formatting by prefix-target expansion: every assistant turn becomes an example of its own.

The example's text is all preceding turns in template form, then the reply; only the reply is trainable. Turns after the last
reply stand in one more example without a trainable part, so the output holds every turn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.session import Scratch

START, END = "<|im_start|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    """Reversible, and without ``<|`` in the result: a backslash doubles, and one goes between ``<`` and ``|``."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def examples(turns: DataFrame) -> DataFrame:
    """(conv_id, example, formatted, loss_start, loss_chars) from rows (conv_id, turn, role, text).

    Turns are ordered by turn, then role and text; null roles and texts are empty; repeated rows are turns of their own; a
    null conv_id is a conversation of its own; an empty table gives no examples; other columns are ignored. An example holds its whole
    conversation so far, which is why a conversation's turns stand in one row, and why examples grow with the square of a conversation's
    replies: one of n replies of m characters gives about n * n * m / 2 characters. A row holds 2 GB at most, an example that is larger fails."""
    rows = turns.select("conv_id", F.struct(F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    held = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    held = held.withColumn("ts", F.transform("ts", lambda t: F.struct(F.concat(F.lit(START), _role(t.role), F.lit("\n")).alias("head"), escape(t.text).alias("body"), (t.role == "assistant").alias("reply"))))
    held = held.withColumn("whole", F.transform("ts", lambda t: F.concat(t.head, t.body, F.lit(END))))
    last = F.size("ts") - 1
    picked = F.filter(F.sequence(F.lit(0), last), lambda i: F.get(F.col("ts")["reply"], i) | (i == last))
    out = held.select("conv_id", "ts", "whole", F.explode(picked).alias("example")).withColumn("t", F.get("ts", F.col("example")))
    context = F.array_join(F.slice("whole", 1, F.col("example")), "")
    return out.select(
        "conv_id", "example", F.concat(context, F.get("whole", F.col("example"))).alias("formatted"),
        F.when(F.col("t.reply"), F.length(context) + F.length("t.head")).alias("loss_start"), F.when(F.col("t.reply"), F.length("t.body")).otherwise(0).alias("loss_chars"),
    )


def parsed_turns(formatted: Column) -> Column:
    """The (role, text) turns of a formatted text."""
    pieces = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda x: x != "")

    def turn(piece: Column) -> Column:
        inner = F.substring(piece, F.lit(len(START) + 1), F.length(piece))
        cut = F.instr(inner, "\n")
        role = unescape(F.replace(F.substring(inner, F.lit(1), cut - 1), F.lit("\\n"), F.lit("\n")))
        return F.struct(role.alias("role"), unescape(F.substring(inner, cut + 1, F.length(inner))).alias("text"))

    return F.transform(pieces, turn)


def digests(written: DataFrame) -> DataFrame:
    """Per conversation what the examples hold, read back from their text and their loss masks."""
    loss = unescape(F.when(F.col("loss_start").isNotNull(), F.substring("formatted", F.col("loss_start") + 1, F.col("loss_chars"))).otherwise(""))
    held = written.withColumn("loss", loss).groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("longest"), F.array_sort(F.collect_list(F.struct("example", "loss"))).alias("replies"), F.sum(F.length("formatted")).cast("long").alias("formatted_chars"),
    )
    held = held.withColumns({"ts": parsed_turns(F.col("longest")), "loss": F.array_join(F.transform("replies", lambda x: x.loss), "")})
    joined = F.array_join(F.transform("ts", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return held.select(
        "conv_id", F.size("ts").cast("long").alias("n_turns"), F.sha2(joined, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
    )


def format_and_read(turns: DataFrame) -> DataFrame:
    """Write the examples to the shared folder and digest them as read back."""
    return digests(Scratch(turns.sparkSession, "chat").save("examples", examples(turns)))
