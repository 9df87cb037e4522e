"""Chat formatting with typed content parts.

A turn's content is a list of parts: text, image, audio or document. One pass over
the parts (a fold with one branch per type) writes text escaped and every other
part as an ordered placeholder, and records for each placeholder its attachment's
reference and the number of tokens it stands for.

The layout of a turn is ``<|turn|>role<|says|>content<|end|>``. Escaping turns
``\\`` into ``\\\\`` and ``<|`` into ``<\\|``, so an unescaped ``<|`` never comes from a
text, and taking one backslash off every pair gives the text back.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firstdue.llm.text import fenced

TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"
#: Tokens that one unit of a part stands for: an image tile, a second of audio,
#: a page of a document.
TOKENS_PER_UNIT = {"image": 256, "audio": 25, "document": 1024}
PART_TYPE = "array<struct<type: string, text: string, ref: string, units: int>>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def text_part(text: Column) -> Column:
    """Plain text as a list of one part."""
    return F.array(
        F.struct(
            F.lit("text").alias("type"), text.alias("text"),
            F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("units"),
        )
    ).cast(PART_TYPE)


def _visit(parts: Column, tokens: Mapping[str, int]) -> Column:
    """Content and attachments of a list of parts, in one walk."""

    def placeholder(part: Column, number: Column) -> Column:
        return F.concat(F.lit("<|"), part["type"], F.lit(":"), number.cast("string"), F.lit("|>"))

    def step(state: Column, part: Column) -> Column:
        kind = part["type"]
        attached = kind.isin(*tokens)
        number = F.size(state["attachments"])
        each = F.lit(0)
        for name, count in tokens.items():
            each = F.when(kind == name, F.lit(count)).otherwise(each)
        entry = F.struct(
            number.alias("number"), kind.alias("type"), part["ref"].alias("ref"),
            (each * F.coalesce(part["units"], F.lit(1))).cast("long").alias("tokens"),
        )
        written = F.when(attached, placeholder(part, number)).otherwise(
            escape(F.coalesce(part["text"], F.lit("")))
        )
        return F.struct(
            F.concat(state["content"], written).alias("content"),
            F.when(attached, F.concat(state["attachments"], F.array(entry)))
            .otherwise(state["attachments"]).alias("attachments"),
        )

    none = "array<struct<number: int, type: string, ref: string, tokens: bigint>>"
    start = F.struct(
        F.lit("").alias("content"), F.expr(f"cast(array() as {none})").alias("attachments")
    )
    return F.aggregate(F.coalesce(parts, F.expr(f"cast(array() as {PART_TYPE})")), start, step)


def format_turns(
    turns: DataFrame,
    parts: str = "parts",
    learn: str = "assistant",
    tokens: Mapping[str, int] = TOKENS_PER_UNIT,
) -> DataFrame:
    """One row per turn: ``conv_id, turn, segment, loss_start, loss_length, attachments,
    attachment_tokens``.

    ``turns`` has conv_id, turn, role and a column of typed parts; ``segment`` is the turn's
    piece of the conversation and the loss span (within the segment, in characters)
    covers the content of turns by ``learn``, and is empty elsewhere. A missing role or part
    list counts as empty, a part of an unknown type as text, missing units as one. Rows
    are handled one by one, so repeated rows repeat and an empty table stays empty;
    columns other than these are ignored.
    """
    role = F.coalesce(F.col("role"), F.lit(""))
    visited = turns.select("conv_id", "turn", role.alias("role"), _visit(F.col(parts), tokens).alias("__v"))
    head = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(SAYS))
    learned = F.col("role") == learn
    return visited.select(
        "conv_id", "turn",
        F.concat(head, F.col("__v.content"), F.lit(END)).alias("segment"),
        F.length(head).alias("loss_start"),
        F.when(learned, F.length("__v.content")).otherwise(0).alias("loss_length"),
        F.col("__v.attachments").alias("attachments"),
        F.aggregate(
            "__v.attachments", F.lit(0).cast("long"), lambda n, a: n + a["tokens"]
        ).alias("attachment_tokens"),
    )


def assemble(segments: DataFrame) -> DataFrame:
    """One row per conversation: ``conv_id, formatted, loss_spans, attachments,
    attachment_tokens``.

    Turns stand in the order of ``turn``, equal turns in that of their segments; spans
    are offsets and lengths in characters of ``formatted``. A missing conv_id is one
    conversation. A conversation is one string, so it has to fit one row; the offsets
    are running sums of a sort that spills.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "segment")
    before = F.coalesce(
        F.sum(F.length("segment").cast("long")).over(
            order.rowsBetween(Window.unboundedPreceding, -1)
        ),
        F.lit(0),
    )
    rows = segments.select(
        "conv_id",
        F.struct(
            F.row_number().over(order).alias("at"), F.col("segment"),
            (before + F.col("loss_start")).alias("start"), F.col("loss_length").alias("length"),
            F.col("attachments"), F.col("attachment_tokens"),
        ).alias("s"),
    )
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("s")).alias("s"))
    spans = F.transform(
        F.filter("s", lambda x: x["length"] > 0),
        lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length")),
    )
    return whole.select(
        "conv_id",
        fenced(F.array_join(F.transform("s", lambda x: x["segment"]), "")).alias("formatted"),
        spans.alias("loss_spans"),
        F.flatten(F.transform("s", lambda x: x["attachments"])).alias("attachments"),
        F.aggregate("s", F.lit(0).cast("long"), lambda n, x: n + x["attachment_tokens"]).alias(
            "attachment_tokens"
        ),
    )


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation: structs of role and text, unescaped."""
    pieces = F.split(formatted, r"<\|turn\|>")
    pieces = F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0)))

    def read(piece: Column) -> Column:
        role = F.substring_index(piece, SAYS, 1)
        content = F.substring_index(F.substring_index(piece, SAYS, -1), END, 1)
        return F.struct(unescape(role).alias("role"), unescape(content).alias("text"))

    return F.transform(pieces, read)


def masked_texts(formatted: Column, spans: Column) -> Column:
    """The texts under the loss mask, unescaped."""
    return F.transform(
        spans,
        lambda s: unescape(
            F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int"))
        ),
    )
