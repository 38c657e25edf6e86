"""Chat formatting with a grammar round trip, in DataFrame functions alone.

A conversation is rendered as ``<|im_start|>role\\ntext<|im_end|>\\n`` for each turn. Each rendered turn is
parsed again by a deterministic grammar; where the parse isn't the source turn, the conflicting content is
escaped and parsed again. Escaping a text puts one more backslash into every ``<``, backslashes, ``|``, and
unescaping takes one away. In a role every backslash is doubled, a line end becomes backslash n, and ``<|``
becomes ``<``, backslash, ``|``; it is read from left to right, a backslash and what follows it at a time.
The last form is parsed like the others, and a turn that none brings back stops the job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
CONTROL = r"<\|"


def escape_text(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape_text(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def escape_role(role: Column) -> Column:
    doubled = F.replace(role, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(doubled, F.lit("\n"), F.lit("\\n")), F.lit("<|"), F.lit("<\\|"))


def unescape_role(role: Column) -> Column:
    """Split at doubled backslashes, from left to right, single ones are left with what they stand before."""
    single = lambda p: F.replace(F.replace(p, F.lit("\\n"), F.lit("\n")), F.lit("<\\|"), F.lit("<|"))
    return F.array_join(F.transform(F.split(role, r"\\\\"), single), "\\")


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(END))


def parse(rendered: Column) -> Column:
    """array<struct<role, text, at, chars>> of a rendered string, null if it isn't of the grammar.

    The grammar: START, a role up to the first line end, a text, END; neither role nor text has a control
    string. ``at`` and ``chars`` are the still escaped text's place in code points, from 1 in its turn.
    """
    pieces = F.split(rendered, r"<\|im_end\|>\n")
    turns = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))

    def turn(piece: Column) -> Column:
        body = F.substring(piece, F.lit(len(START) + 1), F.length(piece))
        role = F.substring_index(body, "\n", 1)
        text = F.substring(body, F.length(role) + 2, F.length(body))
        return F.struct(
            unescape_role(role).alias("role"),
            unescape_text(text).alias("text"),
            (F.length(role) + len(START) + 2).alias("at"),
            F.length(text).alias("chars"),
        )

    def follows(piece: Column) -> Column:
        body = F.substring(piece, F.lit(len(START) + 1), F.length(piece))
        return F.startswith(piece, F.lit(START)) & F.contains(body, F.lit("\n")) & ~F.contains(body, F.lit("<|"))

    whole = (F.element_at(pieces, -1) == "") & F.forall(turns, follows)
    return F.when(whole, F.transform(turns, turn))


def _same(rendered: Column, role: Column, text: Column) -> Column:
    found = parse(rendered)
    one = F.element_at(found, 1)
    return F.coalesce((F.size(found) == 1) & (one["role"] == role) & (one["text"] == text), F.lit(False))


def format_turns(conversations: DataFrame) -> DataFrame:
    """One row per turn: conv_id, place (from 1), role, text, piece (rendered so that it parses back)."""
    turns = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    ordered = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    forms = [
        render(F.col("role"), F.col("text")),
        render(F.col("role"), escape_text(F.col("text"))),
        render(escape_role(F.col("role")), escape_text(F.col("text"))),
    ]
    piece = F.raise_error(F.concat(F.lit("turn doesn't come back from its rendering: "), F.col("role"))).cast("string")
    for form in reversed(forms):
        piece = F.when(_same(form, F.col("role"), F.col("text")), form).otherwise(piece)
    return turns.select("conv_id", "role", "text", F.row_number().over(ordered).alias("place"), piece.alias("piece"))


def format_conversations(conversations: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted, turns, loss_spans, round_trip.

    formatted: the rendered turns in the order of ``turn`` (ties by role, then text; a null turn first).
    turns: the turns parsed back. loss_spans: array<struct<start, chars>>, code points from 1, of the
    assistant texts within ``formatted``. round_trip: that the turns parsed back are the source's; a
    conversation of which they aren't stops the job instead of giving a row.

    Null roles and texts are empty; rows with a null conv_id are one conversation; repeated rows are turns
    of their own; other columns are ignored. A conversation is one string, so its turns meet in one task.
    """
    turns = format_turns(conversations)
    grouped = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("place", "piece", "role", "text"))).alias("_t"))
    formatted = grouped.select("conv_id", "_t", F.array_join(F.col("_t.piece"), "").alias("formatted"))
    parsed = formatted.withColumn("turns", parse(F.col("formatted")))
    source = F.transform("_t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    back = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    ends = F.aggregate(
        F.arrays_zip(F.col("turns"), F.transform("_t", lambda t: F.length(t["piece"])).alias("n")),
        F.struct(F.lit(0).alias("upto"), F.array().cast("array<struct<start:int,chars:int>>").alias("spans")),
        lambda acc, x: F.struct(
            (acc["upto"] + x["n"]).alias("upto"),
            F.when(
                x["turns"]["role"] == "assistant",
                F.concat(
                    acc["spans"], F.array(F.struct((acc["upto"] + x["turns"]["at"] - 1 + 1).alias("start"), x["turns"]["chars"].alias("chars")))
                ),
            ).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    same = F.when(F.coalesce(source == back, F.lit(False)), F.lit(True)).otherwise(
        F.raise_error(F.lit("conversation doesn't come back from its rendering")).cast("boolean")
    )
    # The check stands before all columns, so that no selection of them leaves it out.
    checked = parsed.withColumn("round_trip", same).where("round_trip")
    return checked.select("conv_id", "formatted", "turns", ends.alias("loss_spans"), "round_trip")


def digest(formatted: DataFrame) -> DataFrame:
    """What can be read back from ``format_conversations``: counts and SHA-256 digests of turns and loss text."""
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    under = F.transform("loss_spans", lambda s: unescape_text(F.substring(F.col("formatted"), s["start"], s["chars"])))
    loss = formatted.withColumn("_loss", F.array_join(under, "")).withColumn("_lines", lines)
    return loss.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2("_lines", 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2("_loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
