"""Chat formatting: one string and a loss mask per conversation, by Spark expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Code points of a formatted conversation that are looked through for a span's start.
BLOCK = 1 << 15
START, TURN, END = "<|im_start|>", "<|turn|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    """No control string is left: a backslash goes between < and |, one more where some are there already."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def _unrole(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def format_chats(rows: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conv_id, formatted, loss_spans of every conversation; rows have conv_id, turn, role and text.

    Turns are sorted by turn (null first; ties by role, then text). Adjacent turns of one role become one message whose
    texts are parted by <|turn|>, so reading gives back every turn. loss_spans: start (from 0) and length, in code
    points, of each text of a loss role. Null roles and texts are empty ones; null ids are one conversation; rows that
    repeat are turns of their own; an empty table gives no rows; other columns are ignored. A conversation is one row of
    the result and so is built by one task; conversations themselves spread over all tasks.
    """
    blank = F.lit("")
    turns = rows.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = F.lag("role").over(order)
    head = F.concat(F.lit(START), _role(F.col("role")), F.lit("\n"))
    head = F.when(before.isNull(), head).when(before == F.col("role"), F.lit(TURN)).otherwise(F.concat(F.lit(END), head))
    parts = turns.select("conv_id", F.row_number().over(order).alias("i"), head.alias("head"), escape(F.col("text")).alias("body"), F.col("role").isin(*loss_roles).alias("loss"))
    # where a text ends is a running sum, so that a conversation of any number of turns takes one pass
    size = F.length("body").cast("long")
    end = F.sum(F.length("head").cast("long") + size).over(Window.partitionBy("conv_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    part = F.struct("i", F.concat("head", "body").alias("text"), "loss", (end - size).alias("start"), size.alias("length"))
    parts = parts.select("conv_id", part.alias("p")).groupBy("conv_id").agg(F.sort_array(F.collect_list("p")).alias("parts"))
    text = F.concat(F.array_join(F.transform("parts", lambda p: p["text"]), ""), F.lit(END))
    spans = F.transform(F.filter("parts", lambda p: p["loss"]), lambda p: F.struct(p["start"].alias("start"), p["length"].alias("length")))
    return parts.select("conv_id", text.alias("formatted"), spans.alias("loss_spans"))


def read_chats(chats: DataFrame) -> DataFrame:
    """chats (conv_id, formatted, loss_spans as format_chats gives them) with turns (array of role and text, as they were; nulls as empty) and loss_texts, read back from formatted and loss_spans alone. An empty table gives no rows; rows that repeat are read each."""
    messages = F.slice(F.split("formatted", r"<\|im_end\|>\n"), F.lit(1), F.size(F.split("formatted", r"<\|im_end\|>\n")) - 1)

    def of(message: Column) -> Column:
        role = F.substring_index(F.substring(message, F.lit(len(START) + 1), F.length(message)), "\n", 1)
        body = F.substring(message, F.length(role) + F.lit(len(START) + 2), F.length(message))
        return F.transform(F.split(body, r"<\|turn\|>"), lambda t: F.struct(_unrole(role).alias("role"), unescape(t).alias("text")))

    # substring() counts from the start of its string: blocks keep that short however long a conversation is
    count = F.greatest(F.lit(1), F.ceil(F.length("formatted") / BLOCK)).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(F.col("formatted"), i * BLOCK + 1, F.lit(BLOCK)))

    def cut(own: Column, s: Column) -> Column:
        first, last = F.floor(s["start"] / BLOCK).cast("int"), F.floor((s["start"] + s["length"]) / BLOCK).cast("int")
        near = F.array_join(F.slice(own, first + 1, last - first + 1), "")
        return unescape(F.substring(near, (s["start"] % BLOCK + 1).cast("int"), s["length"].cast("int")))

    # as a variable of the outer function, the blocks are made once and not for every span
    loss = F.flatten(F.transform(F.array(blocks), lambda own: F.transform("loss_spans", lambda s: cut(own, s))))
    return chats.select("*", F.flatten(F.transform(messages, of)).alias("turns"), loss.alias("loss_texts"))
