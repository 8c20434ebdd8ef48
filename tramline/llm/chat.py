"""Chat formatting of event-sourced conversations.

A log holds, for each conversation, events in sequence: whole messages, streamed
deltas, edits and regenerations.  They are folded into final messages and
rendered with a template that marks turns.  Control strings inside texts are
escaped so that the rendering can be read back without loss.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The template's control strings.
START, END = "<|im_start|>", "<|im_end|>"
_BACK = "\\"


def escape(c: Column) -> Column:
    """Backslashes doubled, one put between each < and |."""
    return F.replace(F.replace(c, F.lit(_BACK), F.lit(_BACK * 2)), F.lit("<|"), F.lit(f"<{_BACK}|"))


def unescape(c: Column) -> Column:
    parts = F.split(c, r"\\\\", -1)
    return F.array_join(F.transform(parts, lambda x: F.replace(F.replace(x, F.lit(f"<{_BACK}|"), F.lit("<|")), F.lit(f"{_BACK}n"), F.lit("\n"))), _BACK)


def reconstruct(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, msg, role, text) of a log with conv_id, seq, msg, op, role and text.

    op is message (a whole text), delta (appended), edit (replaces the text) or
    regenerate (starts the text anew and drops what came before of all later
    messages).  msg orders the messages of a conversation.  Events with the same
    sequence number are ordered by text; null texts count as empty, null ops as
    message, and a message's role is the last that isn't null, or empty.  A
    message that a regeneration dropped and that has no later event is gone.
    All steps share one shuffle by conversation; windows spill, and only one
    message's own text is ever put together.
    """
    e = events.select(
        "conv_id", F.col("seq").cast("long").alias("seq"), F.col("msg").cast("long").alias("msg"),
        F.coalesce("op", F.lit("message")).alias("op"), "role", F.coalesce("text", F.lit("")).alias("text"),
    ).repartition("conv_id")
    own = Window.partitionBy("conv_id", "msg")
    earlier = Window.partitionBy("conv_id").orderBy("msg").rangeBetween(Window.unboundedPreceding, -1)
    marked = e.withColumns(
        {
            "reset": F.max(F.when(F.col("op") != "delta", F.col("seq"))).over(own),
            "said": F.max(F.when(F.col("role").isNotNull(), F.struct("seq", "role"))).over(own),
            "void": F.max(F.when(F.col("op") == "regenerate", F.col("seq"))).over(earlier),
        }
    )
    kept = marked.where((F.col("reset").isNull() | (F.col("seq") >= F.col("reset"))) & (F.col("void").isNull() | (F.col("seq") > F.col("void"))))
    return kept.groupBy("conv_id", "msg").agg(
        F.coalesce(F.max("said")["role"], F.lit("")).alias("role"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "").alias("text"),
    )


def render(messages: DataFrame, learn: str = "assistant") -> DataFrame:
    """(conv_id, n_turns, formatted, loss_spans), one row per conversation.

    A turn is START, role, newline, text, END, newline, with role and text
    escaped and line breaks in roles written as \\\\n.  loss_spans are [start,
    end) in code points of formatted: the texts of the role to learn.
    """
    role = F.replace(escape(F.col("role")), F.lit("\n"), F.lit(f"{_BACK}n"))
    m = messages.select("conv_id", "msg", "role", role.alias("head"), escape(F.col("text")).alias("body"))
    m = m.withColumn("turn", F.concat(F.lit(START), "head", F.lit("\n"), "body", F.lit(END), F.lit("\n")))
    before = Window.partitionBy("conv_id").orderBy("msg").rowsBetween(Window.unboundedPreceding, -1)
    m = m.withColumn("at", F.coalesce(F.sum(F.char_length("turn")).over(before), F.lit(0)) + len(START) + F.char_length("head") + 1)
    turns = F.array_sort(F.collect_list(F.struct("msg", "turn", "at", F.char_length("body").alias("size"), (F.col("role") == learn).alias("learn"))))
    folded = m.groupBy("conv_id").agg(turns.alias("turns"))
    return folded.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: t["turn"]), "").alias("formatted"),
        F.transform(F.filter("turns", lambda t: t["learn"]), lambda t: F.struct(t["at"].alias("start"), (t["at"] + t["size"]).alias("end"))).alias("loss_spans"),
    )


def parse(formatted: Column) -> Column:
    """The turns (role, text) of a rendering."""
    turns = F.split(formatted, r"<\|im_end\|>\n", -1)
    turns = F.slice(turns, F.lit(1), F.size(turns) - 1)
    return F.transform(
        turns,
        lambda t: F.struct(
            unescape(F.substring_index(F.substr(t, F.lit(len(START) + 1)), "\n", 1)).alias("role"),
            _unescape_text(F.substr(t, F.instr(t, F.lit("\n")) + 1)).alias("text"),
        ),
    )


def _unescape_text(c: Column) -> Column:
    parts = F.split(c, r"\\\\", -1)
    return F.array_join(F.transform(parts, lambda x: F.replace(x, F.lit(f"<{_BACK}|"), F.lit("<|"))), _BACK)


def under_mask(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    return F.array_join(
        F.transform(spans, lambda s: _unescape_text(F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), ""
    )
