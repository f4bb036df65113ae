"""Prefix-target examples from conversations.

Every assistant turn is an example of its own: all turns before it are its context and only its text
is under the loss. The formatted text of a conversation is a segment per turn with its place in characters;
``examples`` says how far the context of each target reaches and where its reply starts and ends, and
``written`` writes every example out, context and all. A text is written in pieces of bounded length, made
by many tasks however long a conversation is; what is written grows with the square of its length.

    <|im_start|>role\\n text <|im_end|>\\n        (no blanks around the text)

Inside roles and texts a backslash is doubled and the ``<|`` of a control string becomes ``<\\|``; in
roles a line break becomes ``\\n``. So texts can hold control strings, and everything can be read back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

START, END = "<|im_start|>", "<|im_end|>"
ASSISTANT = "assistant"
CHUNK_TURNS = 1024
PIECE_CHARS = 1 << 16

_SEGMENT = r"(?s)^<\|im_start\|>([^\n]*)\n(.*)<\|im_end\|>\n$"


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(doubled, F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column, line_breaks: bool = False) -> Column:
    """The inverse of ``escape``. Double backslashes split the text; between them are only single ones."""

    def part(x: Column) -> Column:
        x = F.replace(x, F.lit("<\\|"), F.lit("<|"))
        return F.replace(x, F.lit("\\n"), F.lit("\n")) if line_breaks else x

    return F.array_join(F.transform(F.split(text, r"\\\\", -1), part), "\\")


def segments(
    turns: DataFrame,
    *,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """One row per turn: ``conv_id``, ``position`` from 0, ``segment`` and ``start`` in the conversation.

    Turns follow their number (nulls first, then equal numbers by role and text); repeated rows are
    turns of their own, rows without a conv_id are one conversation. Null roles and texts are empty.
    ``loss_start`` and ``loss_end`` bound an assistant's text in the conversation's formatted text; they
    are null for other roles. Positions and places are summed in two levels, within and over chunks of
    turn numbers, so one long conversation is many groups.
    """
    name = F.coalesce(F.col(role).cast("string"), F.lit(""))
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    header = F.concat(F.lit(START), F.replace(escape(name), F.lit("\n"), F.lit("\\n")), F.lit("\n"))
    # Rows travel unescaped: their order is that of the texts themselves.
    rows = turns.select(
        F.col(conv_id).alias("conv_id"),
        F.col(turn).cast("bigint").alias("turn"),
        F.shiftright(F.col(turn).cast("bigint"), CHUNK_TURNS.bit_length() - 1).alias("chunk"),
        name.alias("role"),
        body.alias("text"),
        F.length(header).alias("_head"),
        (F.length(header) + F.length(escape(body)) + len(END) + 1).alias("_size"),
    )
    chunks = rows.groupBy("conv_id", "chunk").agg(
        F.count(F.lit(1)).alias("_turns"), F.sum("_size").alias("_chars")
    )
    earlier = Window.partitionBy("conv_id").orderBy(F.col("chunk").asc_nulls_first())
    earlier = earlier.rowsBetween(Window.unboundedPreceding, -1)
    bases = chunks.select(
        F.col("conv_id").alias("_conv"),
        F.col("chunk").alias("_chunk"),
        F.coalesce(F.sum("_turns").over(earlier), F.lit(0)).alias("_turns"),
        F.coalesce(F.sum("_chars").over(earlier), F.lit(0)).alias("_chars"),
    )
    inside = Window.partitionBy("conv_id", "chunk").orderBy(
        F.col("turn").asc_nulls_first(), "role", "text"
    )
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumns({
        "_place": F.row_number().over(inside) - 1,
        "_before": F.coalesce(F.sum("_size").over(before), F.lit(0)),
    }).join(
        bases,
        F.col("conv_id").eqNullSafe(F.col("_conv")) & F.col("chunk").eqNullSafe(F.col("_chunk")),
    )
    start = F.col("_chars") + F.col("_before")
    replies = F.col("role") == ASSISTANT
    head = F.concat(F.lit(START), F.replace(escape(F.col("role")), F.lit("\n"), F.lit("\\n")), F.lit("\n"))
    return placed.select(
        "conv_id",
        (F.col("_turns") + F.col("_place")).cast("bigint").alias("position"),
        F.concat(head, escape(F.col("text")), F.lit(END), F.lit("\n")).alias("segment"),
        start.cast("bigint").alias("start"),
        F.when(replies, start + F.col("_head")).alias("loss_start"),
        F.when(replies, start + F.col("_size") - len(END) - 1).alias("loss_end"),
    )


def examples(formatted: DataFrame) -> DataFrame:
    """One row per assistant turn: the prefix of the conversation that is its context, and its reply.

    ``context_chars`` characters of the formatted conversation (``position`` turns) come before the
    target's segment; only ``loss_start`` to ``loss_end`` is trainable, which unescaped is the ``reply``.
    ``example_chars`` is the length of the whole example. A conversation without assistant turns has no example.
    """
    return formatted.filter(F.col("loss_start").isNotNull()).select(
        "conv_id",
        F.col("position").alias("target"),
        F.col("start").alias("context_chars"),
        "loss_start",
        "loss_end",
        (F.col("start") + F.length("segment")).alias("example_chars"),
        unescape(_masked()).alias("reply"),
    )


def _masked() -> Column:
    """The part of a segment that is trainable."""
    return F.substring(
        F.col("segment"), F.col("loss_start") - F.col("start") + 1, F.col("loss_end") - F.col("loss_start")
    )


def written(wanted: DataFrame, formatted: DataFrame, *, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """``wanted`` examples written out whole: the rows of ``wanted``, once for each piece of their text.

    ``piece`` orders the pieces of an example, ``piece_start`` is the place of ``piece_text`` in it; the
    ``last`` one holds the target and so all of the loss. Pieces end with a segment, have about
    ``piece_chars`` characters, and are longer only by a segment that is longer. Targets meet the pieces
    before them by conversation, piece and the piece they are in themselves: so no key gives more than the
    targets of one piece times the text of one.
    """
    place = lambda c: F.floor(F.col(c) / piece_chars).cast("bigint")
    placed = formatted.select(F.col("conv_id").alias("_conv"), place("start").alias("_piece"), "position", "start", "segment")
    ends = placed.groupBy(F.col("_conv").alias("_of")).agg(F.max("_piece").alias("_end"))
    pieces = (
        placed.groupBy("_conv", "_piece")
        .agg(F.array_sort(F.collect_list(F.struct("position", "segment"))).alias("_segments"), F.min("start").alias("_start"))
        .select("_conv", "_piece", "_start", F.array_join("_segments.segment", "").alias("_text"))
        .join(ends, F.col("_conv").eqNullSafe(F.col("_of")))
        .select("_conv", "_piece", "_start", "_text", F.explode(F.sequence("_piece", "_end")).alias("_reader"))
    )
    targets = wanted.withColumn("_own", place("context_chars")).withColumn(
        "piece", F.explode(F.sequence(F.lit(0).cast("bigint"), "_own"))
    )
    met = targets.join(
        pieces,
        F.col("conv_id").eqNullSafe(F.col("_conv"))
        & (F.col("piece") == F.col("_piece"))
        & (F.col("_own") == F.col("_reader")),
    )
    last = F.col("piece") == F.col("_own")
    up_to = F.substring(F.col("_text"), F.lit(1), (F.col("example_chars") - F.col("_start")).cast("int"))
    return met.select(
        *wanted.columns,
        "piece",
        F.col("_start").alias("piece_start"),
        F.when(last, up_to).otherwise(F.col("_text")).alias("piece_text"),
        last.alias("last"),
    )


def trained(pieces: DataFrame) -> DataFrame:
    """What a trainer reads in ``written`` pieces: characters before the target, all characters, and the ``reply``.

    The target begins where the text says so, with the last start mark; the reply is what the mask covers,
    null for pieces that are context only.
    """
    text = F.col("piece_text")
    target = len(START) + F.length(F.substring_index(text, START, -1))
    inside = F.col("loss_start") - F.col("piece_start") + 1
    covered = F.substring(text, inside.cast("int"), (F.col("loss_end") - F.col("loss_start")).cast("int"))
    return pieces.select(
        "conv_id",
        "target",
        "last",
        F.when(F.col("last"), F.length(text) - target).otherwise(F.length(text)).alias("context_chars"),
        F.length(text).alias("chars"),
        F.when(F.col("last"), unescape(covered)).alias("reply"),
    )


def example_texts(wanted: DataFrame, formatted: DataFrame) -> DataFrame:
    """``wanted`` examples with their whole ``text`` in one row; ``written`` has it in pieces."""
    in_order = F.array_sort(F.collect_list(F.struct("piece", "piece_text")))
    joined = written(wanted, formatted)
    return joined.groupBy(*wanted.columns).agg(F.array_join(in_order["piece_text"], "").alias("text"))


def parsed(formatted: DataFrame) -> DataFrame:
    """``role``, ``text`` and ``loss`` (what the mask of an example covers) read back from the segments."""
    return formatted.select(
        "conv_id",
        "position",
        unescape(F.regexp_extract("segment", _SEGMENT, 1), line_breaks=True).alias("role"),
        unescape(F.regexp_extract("segment", _SEGMENT, 2)).alias("text"),
        unescape(_masked()).alias("loss"),
        F.length("segment").alias("chars"),
    )

