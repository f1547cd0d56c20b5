"""Chat templates that a deterministic parser reads back to the same turns. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import pick

#: Open and close marks of the known roles; any other role is named in its open mark.
MARKS = {"user": ("[INST] ", " [/INST]"), "assistant": ("<s> ", " </s>"), "system": ("<<SYS>>\n", "\n<</SYS>>")}
OTHER = ("[ROLE ", "] ", " [/ROLE]")
CONTROL = r"\\|</?s>|\[/?INST\]|<</?SYS>>|\[/?ROLE"
TURN = r"(?s)\[INST\] .*? \[/INST\]|<s> .*? </s>|<<SYS>>\n.*?\n<</SYS>>|\[ROLE [^\]]*\] .*? \[/ROLE\]"
#: Every control string begins with < or [, so a text in which they are coded holds none.
CODES = (("\\", "\\e"), ("<", "\\l"), ("[", "\\b"), ("]", "\\r"))


def escape(text: Column) -> Column:
    for sign, code in CODES:
        text = F.replace(text, F.lit(sign), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    """The inverse of ``escape``: in an escaped text a backslash only begins a code, so one by one is safe, the backslash's own last."""
    for sign, code in reversed(CODES):
        text = F.replace(text, F.lit(code), F.lit(sign))
    return text


def _segments(role: Column, body: Column) -> Column:
    """A turn as (text, loss) pieces: open mark, body, close mark."""
    opened, closed = F.concat(F.lit(OTHER[0]), escape(role), F.lit(OTHER[1])), F.lit(OTHER[2])
    for name, (a, b) in MARKS.items():
        opened, closed = F.when(role == name, F.lit(a)).otherwise(opened), F.when(role == name, F.lit(b)).otherwise(closed)
    piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    return F.array(piece(opened, F.lit(False)), piece(body, role == "assistant"), piece(F.concat(closed, F.lit("\n")), F.lit(False)))


def render(turns: Column, level: int) -> Column:
    """Segments of all turns. Level 1 escapes the texts with a control string or a backslash, 2 all."""
    body = {1: lambda t: F.when(t.rlike(CONTROL), escape(t)).otherwise(t), 2: escape}[level]
    return F.flatten(F.transform(turns, lambda t: _segments(t["role"], body(t["text"]))))


def joined(segments: Column) -> Column:
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def parse(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""

    def turn(part: Column) -> Column:
        inner = lambda a, b: unescape(F.substring(part, F.lit(len(a) + 1), F.length(part) - len(a) - len(b)))
        named = F.substring_index(part, "]", 1)  # an escaped role has no ]
        role, text = unescape(F.substring(named, F.lit(len(OTHER[0]) + 1), F.length(named))), unescape(
            F.substring(part, F.length(named) + 1 + len(OTHER[1]), F.length(part) - F.length(named) - len(OTHER[1]) - len(OTHER[2]))
        )
        for name, (a, b) in MARKS.items():
            here = part.startswith(a)
            role, text = F.when(here, F.lit(name)).otherwise(role), F.when(here, inner(a, b)).otherwise(text)
        return F.struct(role.alias("role"), text.alias("text"))

    return F.transform(F.regexp_extract_all(formatted, F.lit(TURN), F.lit(0)), turn)


def format_conversations(
    df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """A row for each conversation: its id, ``formatted``, ``segments`` and ``turns``.

    Every text with a control string or a backslash is escaped, others are rendered as they are; if the
    parser doesn't give back the very turns, all are escaped, which always reads back. So no text holds
    a raw control string, and ``parse(formatted)`` equals the source for every conversation.
    ``segments`` is an array of (text, loss) whose texts join to ``formatted``; loss is true for the
    bodies of assistant turns, of which ``unescape`` gives the source. ``turns`` is what the parser
    reads back from ``formatted``.

    Rows are taken in order of turn, then role, then text; a null turn number comes first, a null role
    or text is the empty string, repeated rows are turns of their own, and a row of null id, whose
    conversation is not known, is one of a single turn. Empty tables give no rows; other columns are
    ignored. A conversation is one row of the result, so its turns must fit in a task.
    """
    rows = pick(df, id=conv_col, turn=turn_col, role=role_col, text=text_col)
    turn = F.struct(
        "turn",
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    rows = rows.withColumn("lone", F.when(F.col("id").isNull(), F.monotonically_increasing_id()))  # only tells rows apart
    grouped = rows.groupBy("id", "lone").agg(F.sort_array(F.collect_list(turn)).alias("rows"))
    grouped = grouped.select(
        "id", F.transform("rows", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("source")
    )
    grouped = grouped.withColumn("s1", render(F.col("source"), 1)).withColumn("same1", parse(joined(F.col("s1"))) == F.col("source"))
    segments = F.when(F.col("same1"), F.col("s1")).otherwise(render(F.col("source"), 2))
    out = grouped.select("id", segments.alias("segments")).withColumn("formatted", joined(F.col("segments")))
    return out.select(F.col("id").alias(conv_col), "formatted", "segments", parse(F.col("formatted")).alias("turns"))
