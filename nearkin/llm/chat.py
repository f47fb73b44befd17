"""Chat formatting by prefix targets: every reply becomes an example of its own.

A turn is written as ``### role: text</turn>`` and a line feed. In role and text, backslash, ``#`` and ``<`` (in a role also
the colon) are replaced by a backslash and a letter, so no control string can come from a text, and putting the signs
back gives the text back. An example is the turns up to one assistant turn; only that reply's text is trainable. Turns
after the last reply are kept in one more example without a trainable part.

Everything is built from DataFrame functions. A conversation is one row while it is formatted; examples
are written one by one from its turns, not held together.

Turns go by number; equal numbers by role, then text. Null numbers come first, null texts and roles are empty, and rows
without a conversation id form a conversation of their own. Repeated rows stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSISTANT = "assistant"
START, MIDDLE, END = "### ", ": ", "</turn>\n"


# The backslash comes first when escaping and last when putting back.
ESCAPES = (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"))
ROLE_ESCAPES = (*ESCAPES, (":", "\\c"))


def _replace_all(text: Column, pairs) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def escape(text: Column, signs=ESCAPES) -> Column:
    return _replace_all(text, signs)


def unescape(text: Column, signs=ESCAPES) -> Column:
    return _replace_all(text, [(new, old) for old, new in reversed(signs)])


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), escape(role, ROLE_ESCAPES), F.lit(MIDDLE), escape(text), F.lit(END))


def expand(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(conv, example, n_turns, formatted, loss_start, loss_end)``, one row per assistant turn.

    ``example`` counts from 1, ``n_turns`` is the number of turns the example shows. The mask covers the characters from
    ``loss_start`` up to, not including, ``loss_end``, from 0; both are equal where nothing is trainable.
    """
    turns = df.select(
        F.col(conv).alias("conv"),
        F.struct(
            F.col(turn).alias("at"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text")
        ).alias("entry"),
    )
    grouped = turns.groupBy("conv").agg(F.sort_array(F.collect_list("entry")).alias("turns"))
    replies = F.filter(
        F.sequence(F.lit(1), F.size("turns")), lambda i: F.element_at("turns", i)["role"] == ASSISTANT
    )
    tail = F.when(F.element_at("turns", -1)["role"] == ASSISTANT, F.array().cast("array<int>")).otherwise(
        F.array(F.size("turns"))
    )
    rendered = F.transform("turns", lambda t: render(t["role"], t["text"]))
    shown = grouped.select(
        "conv", "turns", rendered.alias("rendered"), F.posexplode(F.concat(replies, tail)).alias("example", "n")
    )
    last = F.element_at("turns", F.col("n"))
    loss = F.when(last["role"] == ASSISTANT, F.char_length(escape(last["text"]))).otherwise(0)
    end = F.char_length("formatted") - len(END)
    return shown.select(
        "conv",
        (F.col("example") + 1).cast("long").alias("example"),
        F.col("n").cast("long").alias("n_turns"),
        F.array_join(F.slice("rendered", F.lit(1), F.col("n")), "").alias("formatted"),
        loss.alias("loss"),
    ).select(
        F.col("conv").alias(conv),
        "example",
        "n_turns",
        "formatted",
        (end - F.col("loss")).cast("long").alias("loss_start"),
        end.cast("long").alias("loss_end"),
    )


def trainable() -> Column:
    """The text under the mask of an example row, as it was before formatting."""
    start, end = F.col("loss_start"), F.col("loss_end")
    return unescape(F.substring("formatted", (start + 1).cast("int"), (end - start).cast("int")))


def parse(formatted: Column) -> Column:
    """The turns of an example, ``array<struct<role, text>>``."""
    pieces = F.split(formatted, END)
    # Nothing follows the last turn's end.
    bodies = F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda p: F.substr(p, F.lit(len(START) + 1)))
    return F.transform(
        bodies,
        lambda b: F.struct(
            unescape(F.substring_index(b, MIDDLE, 1), ROLE_ESCAPES).alias("role"),
            unescape(F.substr(b, F.position(F.lit(MIDDLE), b) + len(MIDDLE))).alias("text"),
        ),
    )
