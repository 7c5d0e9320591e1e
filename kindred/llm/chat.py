"""Dialogues of several parties, rendered once for each participant's point of view.

For a participant, their own turns become assistant turns, which a loss mask selects; all others are user turns that begin
with the speaker's name; system turns stay. Each rotation is one row with its messages, its text in a template of role
marks, and the spans of the text that the loss covers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed marks of a message.
OPEN, SEPARATOR, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"
SYSTEM = "system"


def rotations(turns: DataFrame, conversation: str, order: str, speaker: str, text: str) -> DataFrame:
    """turns -> conversation, perspective, n_turns, n_own, messages, rendered, mask_spans.

    One row per conversation and distinct speaker other than system. messages: array of role, name, content, masked
    (true: the loss leaves it out), by order, then speaker and text for equal orders. mask_spans: start and end (code
    points, end exclusive) of each own turn's content and closing mark in rendered. A null text is an empty one. A null
    speaker is a user named unknown, who has a perspective as well. Rows with a null conversation are not part of any;
    null orders come first. Repeated rows are turns of their own. A conversation of system turns alone gives no row,
    an empty table none. Other columns are not read.

    Turns meet by conversation alone, and a conversation is one row from then on: its participants multiply the row, and
    no join is needed.
    """
    name = F.coalesce(F.col(f"`{speaker}`").cast("string"), F.lit("unknown"))
    turn = F.struct(F.col(f"`{order}`").alias("at"), name.alias("speaker"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("content"))
    whole = turns.where(F.col(f"`{conversation}`").isNotNull()).select(F.col(f"`{conversation}`").alias("conversation_"), turn.alias("turn")).groupBy("conversation_").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    people = F.array_sort(F.array_distinct(F.filter(F.transform("turns", lambda t: t["speaker"]), lambda s: s != SYSTEM)))
    each = whole.withColumn("perspective", F.explode(people))
    own = lambda t: t["speaker"] == F.col("perspective")
    role = lambda t: F.when(t["speaker"] == SYSTEM, SYSTEM).when(own(t), "assistant").otherwise("user")
    shown = lambda t: F.when((t["speaker"] == SYSTEM) | own(t), t["content"]).otherwise(F.concat(t["speaker"], F.lit(": "), t["content"]))
    message = lambda t: F.struct(role(t).alias("role"), t["speaker"].alias("name"), shown(t).alias("content"), (~own(t)).alias("masked"))
    rows = each.withColumn("messages", F.transform("turns", message))
    pieces = F.transform("messages", lambda m: F.concat(F.lit(OPEN), m["role"], F.lit(SEPARATOR), m["content"], F.lit(CLOSE)))
    rows = rows.withColumn("rendered", F.array_join(pieces, ""))
    return rows.select(
        F.col("conversation_").alias(conversation), "perspective", F.size("messages").cast("long").alias("n_turns"),
        F.size(F.filter("messages", lambda m: ~m["masked"])).cast("long").alias("n_own"), "messages", "rendered", _spans(F.col("messages")).alias("mask_spans"),
    )


def _spans(messages: Column) -> Column:
    """Where the loss applies: content and closing mark of messages that aren't masked, without the closing line end."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    fixed = len(OPEN) + len(SEPARATOR)

    def step(acc: Column, m: Column) -> Column:
        first = acc["at"] + fixed + F.length(m["role"])
        end = first + F.length(m["content"]) + len(CLOSE)
        span = F.array(F.struct(first.cast("int").alias("start"), (end - 1).cast("int").alias("end")))
        return F.struct(end.cast("int").alias("at"), F.when(m["masked"], acc["spans"]).otherwise(F.concat(acc["spans"], span)).alias("spans"))

    return F.aggregate(messages, start, step, lambda acc: acc["spans"])
