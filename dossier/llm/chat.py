"""Operator 3: chat formatting with a grammar that reads its own output back.

All steps are DataFrame functions.  A turn is rendered as

    <|im_start|>role LF text<|im_end|> LF

and a conversation is its turns in order.  The parser cuts at the end marks,
then at the first line feed, allows no other control string, and takes one
backslash out of every escaped one.  Escaping puts one backslash behind the ``<`` of a control
string and of one that is escaped already, so that it can be undone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Fixed control strings of the template.
START, END = "<|im_start|>", "<|im_end|>"

_CONTROL = r"<(\\*)\|(im_start|im_end)\|>"
_ESCAPED = r"<\\(\\*)\|(im_start|im_end)\|>"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"<$1\\|$2|>")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, r"<$1|$2|>")


def escaped_role(role: Column) -> Column:
    """A role holds no line feed in the output."""
    return escaped(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescaped_role(role: Column) -> Column:
    return F.replace(F.replace(unescaped(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(END + "\n"))


def parsed(output: Column) -> Column:
    """The turns of a rendered conversation: array of (role, text).

    A piece between end marks that does not begin with the start mark, or holds
    a second one, is no turn and gives a null element.
    """
    pieces = F.filter(F.split(output, r"<\|im_end\|>"), lambda piece: piece != "\n")

    def turn(piece: Column) -> Column:
        piece = F.when(piece.startswith("\n"), F.substr(piece, F.lit(2))).otherwise(piece)
        body = F.substr(piece, F.lit(len(START) + 1))
        cut = F.instr(body, "\n")
        read = F.struct(unescaped_role(F.substr(body, F.lit(1), cut - 1)).alias("role"),
                        unescaped(F.substr(body, cut + 1)).alias("text"))
        return F.when(piece.startswith(START) & (cut > 0) & ~F.contains(body, F.lit(START)), read)

    return F.transform(pieces, turn)


def format_turns(turns: DataFrame, role: str = "role", text: str = "text") -> DataFrame:
    """Add ``turn_text``, the rendered turn; raw content that the parser would misread is escaped.

    Every turn is rendered as it is and read back.  If that gives another role,
    text or number of turns, the conflicting field is escaped and the turn is
    read back again; ``identical`` tells whether the last reading gave the
    source, and ``was_escaped`` whether it was needed.  A null role or text is
    empty.  Narrow: no shuffle.
    """
    said_role, said = F.coalesce(F.col(f"`{role}`"), F.lit("")), F.coalesce(F.col(f"`{text}`"), F.lit(""))
    source = F.array(F.struct(said_role.alias("role"), said.alias("text")))
    raw = rendered(said_role, said)
    safe = rendered(escaped_role(said_role), escaped(said))
    plain = F.coalesce(parsed(raw) == source, F.lit(False))
    return turns.withColumn("was_escaped", ~plain).withColumn(
        "turn_text", F.when(F.col("was_escaped"), safe).otherwise(raw)
    ).withColumn("identical", parsed(F.col("turn_text")) == source)


def format_conversations(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role",
                         text: str = "text") -> DataFrame:
    """(key, formatted): a conversation's turns in the order of ``turn``, then role and text.

    Rows that tie or repeat are turns of their own; a null turn comes first; null
    keys are one conversation; an empty table gives none.  Other columns are not
    read.  A conversation is one string in the end, so its turns meet in one
    row; what meets is bounded by the longest conversation, not by the input.
    """
    formatted = format_turns(turns.select(
        F.col(f"`{key}`").alias("key"), F.col(f"`{turn}`").alias("turn"), F.col(f"`{role}`").alias("role"),
        F.col(f"`{text}`").alias("text")))
    rows = formatted.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "turn_text"))).alias("turns"))
    return rows.select(F.col("key").alias(key), F.array_join(F.col("turns.turn_text"), "").alias("formatted"))


def read_conversations(formatted: DataFrame, key: str = "conv_id", column: str = "formatted", learned: str = "assistant") -> DataFrame:
    """Turns and loss mask read from the formatted text.

    ``turns`` holds (role, text); ``loss_text`` is all text under the mask: each
    text of the role ``learned`` once, in order, with nothing between.
    """
    said = formatted.withColumn("turns", parsed(F.col(column)))
    under = F.filter("turns", lambda x: x["role"] == learned)
    return said.withColumn("loss_text", F.array_join(F.transform(under, lambda x: x["text"]), ""))
