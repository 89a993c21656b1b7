"""Chat formatting from an event log, with DataFrame functions only.

A log row is (conv_id, seq, message, kind, role, text). Kinds:
  message     opens the message with role and text
  delta       appends text (a streamed piece)
  edit        replaces the text so far
  regenerate  discards the text so far and starts again; later messages opened before it answered the old
              text and go too
An unknown kind is taken as delta. Null text is empty, null role is empty. Equal seq: by kind, role, text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def escape(x: Column) -> Column:
    """After it no marker can be read in x: backslash doubles, a bar after < gets a backslash, a line end in a role is \\-."""
    return F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(x: Column) -> Column:
    plain = lambda p: F.replace(F.replace(p, F.lit("\\|"), F.lit("|")), F.lit("\\-"), F.lit("\n"))
    return F.array_join(F.transform(F.split(x, r"\\\\", -1), plain), "\\")


def fold_events(log: DataFrame) -> DataFrame:
    """(conv_id, message, role, text): the messages that stand when the log ends, by conversation and message.

    Events gather per message, not per conversation, so a long conversation spreads over tasks.
    """
    order = F.struct(F.col("seq"), F.col("kind"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = log.groupBy("conv_id", "message").agg(
        F.sort_array(F.collect_list(order)).alias("events"),
        F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).alias("regen"),
        F.min("seq").alias("opened"),
    )
    text = F.aggregate(
        "events",
        F.lit(""),
        lambda acc, e: F.when(e["kind"].isin("message", "edit", "regenerate"), e["text"]).otherwise(F.concat(acc, e["text"])),
    )
    role = F.aggregate("events", F.lit(""), lambda acc, e: F.when(e["role"] != "", e["role"]).otherwise(acc))
    earlier = Window.partitionBy("conv_id").orderBy("message").rowsBetween(Window.unboundedPreceding, -1)
    folded = grouped.select("conv_id", "message", "opened", role.alias("role"), text.alias("text"), F.max("regen").over(earlier).alias("cut"))
    return folded.where("cut is null or opened > cut").select("conv_id", "message", "role", "text")


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans): ChatML per conversation; spans (start from 0, length) in code points cover the
    escaped text of each assistant message."""
    head = F.concat(F.lit(START), F.replace(escape(F.col("role")), F.lit("\n"), F.lit("\\-")), F.lit("\n"))
    turn = messages.select("conv_id", "message", (F.col("role") == "assistant").alias("loss"), head.alias("head"), escape(F.col("text")).alias("body"))
    turn = turn.withColumn("out", F.concat("head", "body", F.lit(END + "\n")))
    before = Window.partitionBy("conv_id").orderBy("message").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.char_length("out")).over(before), F.lit(0)) + F.char_length("head")
    turn = turn.select("conv_id", F.struct("message", "out", "loss", start.cast("int").alias("start"), F.char_length("body").alias("len")).alias("t"))
    whole = turn.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    spans = F.transform(F.filter("ts", lambda t: t["loss"]), lambda t: F.struct(t["start"].alias("start"), t["len"].alias("len")))
    return whole.select("conv_id", F.array_join(F.transform("ts", lambda t: t["out"]), "").alias("formatted"), spans.alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns, loss_text): what the formatted text says, parsed from it alone with its loss spans."""
    marks = F.split("formatted", r"<\|im_end\|>\n", -1)
    turns = F.transform(
        F.slice(marks, 1, F.greatest(F.size(marks) - 1, F.lit(0))),
        lambda x: F.struct(
            unescape(F.substr(F.substring_index(x, "\n", 1), F.lit(len(START) + 1))).alias("role"),
            unescape(F.substr(x, F.char_length(F.substring_index(x, "\n", 1)) + 2)).alias("text"),
        ),
    )
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substr("formatted", s["start"] + 1, s["len"]))), "")
    return formatted.select("conv_id", "formatted", turns.alias("turns"), loss.alias("loss_text"))


def rows_as_log(conversations: DataFrame) -> DataFrame:
    """A table of finished turns as a log: one message event per row, in order of turn, role, text."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return conversations.select("conv_id", F.row_number().over(order).alias("message"), "role", "text").select(
        "conv_id", F.col("message").alias("seq"), "message", F.lit("message").alias("kind"), "role", "text"
    )
