"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes an example of its own: all turns before it as context, and its
text as the one trainable span. A conversation that does not end in an assistant turn gets a
last example without a trainable span, so that the output holds every turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks of the template: OPEN role CLOSE text END.
OPEN, CLOSE, END = "<s>[", "]\n", "</s>\n"
#: What stands for the characters that marks are made of, in the order of escaping.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&lsqb;"), ("]", "&rsqb;"))


def escape(text: Column) -> Column:
    for raw, safe in ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    for raw, safe in reversed(ESCAPES):
        text = F.replace(text, F.lit(safe), F.lit(raw))
    return text


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id and its turns in order: an array of (turn, role, text).

    Null roles and texts are empty; turns that repeat a number stand in the order of role and
    text; null turn numbers come first. Turns without a conv_id make one conversation.
    """
    row = F.struct(F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")])
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), row.alias("row")).groupBy("conv_id").agg(F.array_sort(F.collect_list("row")).alias("turns"))


def expand(conversations: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """conv_id, example (from 1), target_turn (place of the reply, null without one), text,
    loss_start and loss_end (code points of text, end exclusive; equal when nothing is trained).

    The contexts of a conversation of t turns take t*t/2 turns in all, as the method asks;
    conversations are rows, so one has to fit a row. No shuffle beyond the one by conv_id. An
    empty table gives no examples; repeated rows are repeated turns; other columns, whatever
    their names, are ignored.
    """
    rows = turns_of(conversations)
    marked = F.transform("turns", lambda x: F.concat(F.lit(OPEN), escape(x["role"]), F.lit(CLOSE), escape(x["text"]), F.lit(END)))
    n = F.size("turns")
    replies = F.filter(F.transform("turns", lambda x, i: F.when(x["role"] == trained_role, i + 1)), lambda i: i.isNotNull())
    rest = F.when(F.element_at("turns", -1)["role"] == trained_role, F.array().cast("array<int>")).otherwise(F.array(-n))
    rows = rows.select("conv_id", "turns", marked.alias("marked"), F.concat(replies, rest).alias("ends"))
    rows = rows.select("conv_id", "turns", "marked", F.posexplode("ends").alias("example", "end"))
    last = F.abs("end")
    text = F.array_join(F.slice("marked", 1, last), "")
    rows = rows.select("conv_id", (F.col("example") + 1).alias("example"), F.when(F.col("end") > 0, F.col("end")).alias("target_turn"), text.alias("text"), F.when(F.col("end") > 0, F.length(escape(F.element_at("turns", last)["text"]))).otherwise(0).alias("trained"))
    stop = F.when(F.col("target_turn").isNotNull(), F.length("text") - len(END)).otherwise(0)
    return rows.select("conv_id", "example", "target_turn", "text", (stop - F.col("trained")).alias("loss_start"), stop.alias("loss_end"))


def read_back(examples: DataFrame) -> DataFrame:
    """conv_id, turns (array of role, text), losses (array of trained texts in order), formatted_chars.

    Everything comes from the formatted text and its spans: the last example of a conversation
    holds all its turns. A null conv_id is a conversation as any other; an empty table gives none.
    """
    trained = unescape(F.substring(F.col("text"), F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start")))
    rows = examples.groupBy("conv_id").agg(
        F.max_by("text", "example").alias("whole"),
        F.array_sort(F.collect_list(F.when(F.col("target_turn").isNotNull(), F.struct("example", trained.alias("text"))))).alias("losses"),
        F.sum(F.length("text").cast("long")).alias("formatted_chars"),
    )
    parts = F.filter(F.split("whole", END, -1), lambda x: x != "")
    turn = lambda x: F.struct(unescape(F.substring(x, F.lit(len(OPEN) + 1), F.instr(x, F.lit(CLOSE)) - len(OPEN) - 1)).alias("role"), unescape(F.substr(x, F.instr(x, F.lit(CLOSE)) + len(CLOSE))).alias("text"))
    return rows.select("conv_id", F.transform(parts, turn).alias("turns"), F.transform("losses", lambda x: x["text"]).alias("losses"), "formatted_chars")
