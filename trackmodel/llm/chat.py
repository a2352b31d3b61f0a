"""Operator 8: chat formatting with typed content parts, in DataFrame functions only.

A turn's ``parts`` are an ordered array of ``struct<type, text, ref, units>``. The visitor goes over them once:
text is escaped and kept, an image, audio or document part becomes a placeholder ``<image 0>`` whose number
counts the turn's attachments, and its reference and expanded token count (units x tokens per unit) are
recorded. Any other type, or none, is a placeholder ``<other n>`` with no tokens; a null part is skipped.

Template: ``<turn ROLE>`` content ``</turn>`` and a line end. In texts and roles the characters that could
form a control string are written ``\\b`` (backslash), ``\\l`` (<) and ``\\g`` (>), so no text can end a turn,
open one or look like a placeholder, and reading back is exact.

Turns are formatted row by row; a conversation, the unit a model is trained on, then gathers its formatted
turns in one row ordered by turn, role and content (nulls first), the ties' defined order. Null text is
empty, a null role an empty role; repeated rows are repeated turns; a null id is a conversation of its own.
The loss mask holds, for each turn of role ``LOSS_ROLE``, the place of the turn in the conversation, the
start of its content after the turn's opening mark and the length, in code points. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, SHUT = "<turn ", "</turn>\n"
LOSS_ROLE = "assistant"
#: Tokens a unit (image tile, second of audio, document page) takes when it is expanded.
TOKENS_PER_UNIT = {"image": 256, "audio": 25, "document": 600}
PART = "struct<type:string,text:string,ref:string,units:bigint>"


def escape(text: Column) -> Column:
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\b"))
    return F.replace(F.replace(out, F.lit("<"), F.lit("\\l")), F.lit(">"), F.lit("\\g"))


def unescape(text: Column) -> Column:
    out = F.replace(F.replace(text, F.lit("\\g"), F.lit(">")), F.lit("\\l"), F.lit("<"))
    return F.replace(out, F.lit("\\b"), F.lit("\\"))


def text_parts(text: Column) -> Column:
    """A plain text as the one part of its turn."""
    return F.array(F.struct(F.lit("text").alias("type"), text.cast("string").alias("text"),
                            F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("units")))


def format_turns(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, parts: Column,
                 tokens_per_unit: dict[str, int] = TOKENS_PER_UNIT) -> DataFrame:
    """A row per turn: ``conv, turn, role, content`` (escaped, with placeholders) and ``attached``."""
    df = rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"),
                     F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), parts.alias("parts"))
    df = df.withColumn("parts", F.filter("parts", lambda p: p.isNotNull()))
    df = df.withColumn("media", F.filter("parts", lambda p: F.coalesce(p["type"], F.lit("")) != "text"))

    def kind(p):
        return F.when(p["type"].isin(*tokens_per_unit), p["type"]).otherwise("other")

    cost = F.create_map(*[F.lit(x) for kv in tokens_per_unit.items() for x in kv])
    attached = F.transform("media", lambda p, i: F.struct(
        i.alias("number"), kind(p).alias("type"), p["ref"].alias("ref"),
        (F.coalesce(p["units"], F.lit(1)) * F.coalesce(F.try_element_at(cost, kind(p)), F.lit(0))).cast("long").alias("n_tokens")))
    marks = F.transform("attached", lambda a: F.concat(F.lit("<"), a["type"], F.lit(" "), a["number"].cast("string"), F.lit(">")))
    df = df.withColumn("attached", attached).withColumn("marks", marks)
    df = df.withColumn("place", F.transform("parts", lambda p, i: F.size(F.filter(
        F.slice(F.col("parts"), F.lit(1), i), lambda q: F.coalesce(q["type"], F.lit("")) != "text"))))
    content = F.array_join(F.transform("parts", lambda p, i: F.when(
        F.coalesce(p["type"], F.lit("")) == "text", escape(p["text"])).otherwise(
        F.get(F.col("marks"), F.get(F.col("place"), i)))), "")
    return df.select("conv", "turn", "role", content.alias("content"), "attached")


def format_conversations(rows: DataFrame, parts: Column | None = None, conv_col: str = "conv_id", turn_col: str = "turn",
                         role_col: str = "role", text_col: str = "text",
                         tokens_per_unit: dict[str, int] = TOKENS_PER_UNIT) -> DataFrame:
    """``conv_col, formatted, loss`` (place, start, length) ``, attachments`` (place, number, type, ref, n_tokens)."""
    parts = text_parts(F.col(text_col)) if parts is None else parts
    turns = format_turns(rows, conv_col, turn_col, role_col, parts, tokens_per_unit)
    df = turns.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct(
        F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"), "role", "content", "attached",
    ))).alias("turns"))
    formatted = F.array_join(F.transform("turns", lambda t: F.concat(
        F.lit(OPEN), escape(t["role"]), F.lit(">"), t["content"], F.lit(SHUT))), "")
    loss = F.filter(F.transform("turns", lambda t, i: F.struct(
        i.alias("place"), F.lit(0).alias("start"), F.length(t["content"]).alias("length"), t["role"].alias("role"))),
        lambda s: s["role"] == LOSS_ROLE)
    attachments = F.flatten(F.transform("turns", lambda t, i: F.transform(t["attached"], lambda a: F.struct(
        i.alias("place"), a["number"].alias("number"), a["type"].alias("type"), a["ref"].alias("ref"),
        a["n_tokens"].alias("n_tokens")))))
    return df.select(F.col("conv").alias(conv_col), formatted.alias("formatted"), F.transform(
        loss, lambda s: F.struct(s["place"].alias("place"), s["start"].alias("start"), s["length"].alias("length"))).alias("loss"),
        attachments.alias("attachments"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds what the output itself says: ``turns`` (role, text; placeholders left out) and ``loss_texts``."""
    pieces = F.filter(F.split("formatted", OPEN), lambda p: p != "")
    df = formatted.withColumn("pieces", F.transform(pieces, lambda p: F.struct(
        F.substring_index(p, ">", 1).alias("role"), p.alias("piece"))))
    df = df.withColumn("pieces", F.transform("pieces", lambda p: F.struct(
        p["role"].alias("role"), F.substring(p["piece"], F.length(p["role"]) + 2, F.length(p["piece"]) - F.length(
            p["role"]) - (1 + len(SHUT))).alias("content"))))
    plain = lambda c: unescape(F.regexp_replace(c, "<[a-z]+ [0-9]+>", ""))
    return df.withColumn("turns", F.transform("pieces", lambda p: F.struct(
        unescape(p["role"]).alias("role"), plain(p["content"]).alias("text")))).withColumn(
        "loss_texts", F.transform("loss", lambda s: plain(F.substring(
            F.get(F.col("pieces"), s["place"])["content"], s["start"] + 1, s["length"])))).drop("pieces")
