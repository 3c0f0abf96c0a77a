"""Chat formatting of typed content parts, in DataFrame functions only.

A message's content is an array of typed parts. The visitor flattens it in
order: text as it is, any other part as a placeholder of its kind, whose number
in that order, reference and expanded token count go to the attachments. The template marks turns as
``<|im_start|>role\\ntext<|im_end|>\\n``; inside roles and texts ``&``, ``<`` and
``[`` are written as entities, so no control string can occur there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PART = "struct<type:string,text:string,ref:string,units:bigint>"
#: tokens that one unit of a part stands for: an image tile, a second of audio, a page
TOKENS_PER_UNIT = {"image": 256, "audio": 25, "document": 512}
BEGIN, END = "<|im_start|>", "<|im_end|>\n"
_ENTITIES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&lsqb;"))


def escape(text: Column) -> Column:
    for raw, entity in _ENTITIES:
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return text


def unescape(text: Column) -> Column:
    for raw, entity in reversed(_ENTITIES):
        text = F.replace(text, F.lit(entity), F.lit(raw))
    return text


def text_part(text: Column) -> Column:
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(0).cast("long").alias("units")))


def flatten_parts(parts: Column) -> Column:
    """``struct<body, attachments>`` of an array of PART; unknown kinds are kept as ``<|kind|>`` placeholders of 0 tokens.

    Text is escaped; placeholders are control strings of the template. A null
    array, part or text is empty.
    """
    parts = F.filter(F.coalesce(parts, F.array().cast(f"array<{PART}>")), lambda p: p.isNotNull())
    cost = F.create_map(*(x for k, v in TOKENS_PER_UNIT.items() for x in (F.lit(k), F.lit(v))))
    is_text = lambda p: F.coalesce(p["type"], F.lit("text")) == "text"
    body = F.transform(parts, lambda p: F.when(is_text(p), escape(F.coalesce(p["text"], F.lit("")))).otherwise(F.concat(F.lit("<|"), escape(p["type"]), F.lit("|>"))))
    media = F.transform(
        F.filter(parts, lambda p: ~is_text(p)),
        lambda p, i: F.struct((i + 1).alias("number"), p["type"].alias("type"), p["ref"].alias("ref"), (F.coalesce(p["units"], F.lit(1).cast("long")) * F.coalesce(F.try_element_at(cost, p["type"]), F.lit(0))).alias("tokens")),
    )
    return F.struct(F.array_join(body, "").alias("body"), media.alias("attachments"))


def format_chats(messages: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: ``conv_id, formatted, loss_spans array<struct<start,end>>, attachments, expanded_tokens``.

    ``messages`` has ``conv_id, turn, role`` and ``parts`` (array of PART) or
    ``text``. Rows go by turn (null last), then role and content, so repeated
    turns have one order. Null roles, texts and parts are empty; a null
    ``conv_id`` is one conversation. Spans are code points, end exclusive. An
    empty table gives an empty table; other columns are ignored. A conversation
    is one row of the result, so one task holds it whole.
    """
    parts = F.col("parts") if "parts" in messages.columns else text_part(F.col("text"))
    role = F.coalesce(F.col("role"), F.lit(""))
    rows = messages.select("conv_id", "turn", role.alias("role"), parts.alias("content"), flatten_parts(parts).alias("flat"))
    head = F.concat(F.lit(BEGIN), F.replace(escape(F.col("role")), F.lit("\n"), F.lit("&#10;")), F.lit("\n"))
    rows = rows.select(
        "conv_id", "turn", "role", "content", F.col("flat.body").alias("body"), F.col("flat.attachments").alias("attachments"),
        F.length(head).alias("head"), F.concat(head, F.col("flat.body"), F.lit(END)).alias("piece"),
    )
    order = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), "role", "content")
    size = F.length("piece").cast("long")
    begin = F.sum(size).over(order.rowsBetween(W.unboundedPreceding, 0)) - size + F.col("head")
    rows = rows.select("conv_id", F.row_number().over(order).alias("at"), "piece", "attachments", F.when(F.col("role").isin(*loss_roles), F.struct(begin.alias("start"), (begin + F.length("body")).alias("end"))).alias("span"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("at", "piece", "span", "attachments"))).alias("x"))
    return whole.select(
        "conv_id",
        F.array_join(F.transform("x", lambda r: r["piece"]), "").alias("formatted"),
        F.filter(F.transform("x", lambda r: r["span"]), lambda s: s.isNotNull()).alias("loss_spans"),
        F.flatten(F.transform("x", lambda r: r["attachments"])).alias("attachments"),
        F.aggregate(F.flatten(F.transform("x", lambda r: r["attachments"])), F.lit(0).cast("long"), lambda a, m: a + m["tokens"]).alias("expanded_tokens"),
    )


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of ``struct<role, text>``."""
    pieces = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda p: p != "")
    return F.transform(
        F.transform(pieces, lambda p: F.substring(p, len(BEGIN) + 1, F.length(p))),
        lambda p: F.struct(unescape(F.replace(F.substring_index(p, "\n", 1), F.lit("&#10;"), F.lit("\n"))).alias("role"), unescape(F.substring(p, F.length(F.substring_index(p, "\n", 1)) + 2, F.length(p))).alias("text")),
    )


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return unescape(F.array_join(F.transform(spans, lambda s: F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))), ""))
