"""Chat formatting of typed content parts, with DataFrame functions only.

A conversation is rows of (conv_id, turn, role, parts).  A part is text, or an image, audio or document
attachment.  Text is escaped; an attachment becomes a placeholder, and the attachment list has its
reference and the tokens it expands to, in the order of the placeholders.

Defined results: a null part list is an empty turn; null text, role and reference are empty; a null kind
is text, an unknown one an attachment without tokens; missing measures count as zero; turns are ordered by
(turn, role, parts), so ties and repeated rows are all kept in a fixed order; a null conv_id is one
conversation.  One conversation is one row of output.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, MESSAGE, END = "<|start|>", "<|message|>", "<|end|>"
#: What a placeholder begins with; no kind of attachment can make it one of the three above.
PART = "<|part:"
#: Strings that act as controls in this or other chat templates.
CONTROLS = ("<|", "<s>", "</s>", "[INST]", "[/INST]")
PATCH = 14
AUDIO_TOKENS_PER_SECOND = 25
TOKENS_PER_PAGE = 256

PARTS = ("array<struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>")


def escape(text: Column) -> Column:
    """No control string is left; :func:`unescape` gives the text back exactly."""
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for control in CONTROLS:
        text = F.replace(text, F.lit(control), F.lit(control[0] + "\\" + control[1:]))
    return text


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def text_parts(text: Column) -> Column:
    """The part list of a plain text."""
    return F.array(F.struct(
        F.lit("text").alias("kind"), text.cast("string").alias("text"), F.lit(None).cast("string").alias("ref"),
        F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"),
        F.lit(None).cast("double").alias("seconds"), F.lit(None).cast("int").alias("pages")))


def part_tokens(p: Column) -> Column:
    """Tokens an attachment expands to: image patches, audio frames, document pages."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    return (F.when(p["kind"] == "image", F.ceil(zero(p["width"]) / PATCH) * F.ceil(zero(p["height"]) / PATCH))
            .when(p["kind"] == "audio", F.ceil(zero(p["seconds"]) * AUDIO_TOKENS_PER_SECOND))
            .when(p["kind"] == "document", zero(p["pages"]) * TOKENS_PER_PAGE).otherwise(0).cast("long"))


def is_text(p: Column) -> Column:
    return F.coalesce(p["kind"], F.lit("text")) == "text"


def flatten_parts(parts: Column) -> tuple[Column, Column]:
    """The flat text of a part list, and its attachments in order."""
    parts = F.coalesce(parts.cast(PARTS), F.array().cast(PARTS))
    visit = lambda p: F.when(is_text(p), escape(F.coalesce(p["text"], F.lit("")))).otherwise(
        F.concat(F.lit(PART), escape(p["kind"]), F.lit("|>")))
    attached = F.transform(F.filter(parts, lambda p: ~is_text(p)), lambda p: F.struct(
        p["kind"].alias("kind"), F.coalesce(p["ref"], F.lit("")).alias("ref"), part_tokens(p).alias("tokens")))
    return F.array_join(F.transform(parts, visit), ""), attached


def format_chats(rows: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss, attachments, expanded_tokens) of every conversation.

    ``loss`` has per turn the place inside the turn, from 0, and the number of code points the loss covers.
    """
    body, attached = flatten_parts(F.col("parts"))
    turns = rows.select("conv_id", F.struct(
        F.col("turn").alias("turn"), escape(F.coalesce(F.col("role").cast("string"), F.lit(""))).alias("role"),
        body.alias("body"), attached.alias("attached")).alias("t"))
    chats = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    piece = lambda t: F.concat(F.lit(START), t["role"], F.lit(MESSAGE), t["body"], F.lit(END))
    covered = lambda t: F.struct(
        (F.length(t["role"]) + len(START) + len(MESSAGE)).cast("long").alias("start"),
        F.when(t["role"] == "assistant", F.length(t["body"])).otherwise(0).cast("long").alias("size"))
    return chats.select(
        "conv_id", F.array_join(F.transform("turns", piece), "").alias("formatted"),
        F.transform("turns", covered).alias("loss"),
        F.flatten(F.transform("turns", lambda t: t["attached"])).alias("attachments")).withColumn(
        "expanded_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda n, a: n + a["tokens"]))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation as (role, text), unescaped; placeholders stay."""
    def turn(piece: Column) -> Column:
        role = F.substring_index(piece, MESSAGE, 1)
        body = F.substring_index(F.substring_index(piece, MESSAGE, -1), END, 1)
        return F.struct(unescape(role).alias("role"), unescape(body).alias("text"))

    return F.transform(_pieces(formatted), turn)


def read_loss(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, put together."""
    under = F.zip_with(_pieces(formatted), loss, lambda piece, m: F.substring(
        piece, (m["start"] - len(START) + 1).cast("int"), m["size"].cast("int")))
    return F.array_join(F.transform(under, unescape), "")


def _pieces(formatted: Column) -> Column:
    pieces = F.split(formatted, re.escape(START), -1)
    return F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0)))
