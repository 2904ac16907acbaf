"""Chat formatting with typed content parts, in DataFrame functions only.

A message's content is a list of parts (text, image, audio, document). Visiting the parts in order flattens
them to text and placeholders, records one attachment reference for each placeholder and adds up expanded
token counts. Messages are rendered before they are gathered, gathered in two steps (runs of turns, then
conversations), so a conversation that holds many rows is spread over tasks until only its text is joined.

Template: ``<|im_start|>role<|im_sep|>content<|im_end|>\\n``. Inside roles and texts each ``<``, k backslashes,
``|`` gets one more backslash, so ``<|`` occurs in control strings only and the escape can be undone.

Defined cases: null role or text is empty; a null conv_id is a conversation of its own; null turns come first; rows
that share a turn are ordered by role, then text; repeated rows are kept; a long text is one part like any other; an
unknown part type is rendered as text; an attachment without a token count has one token; an empty table gives no
conversations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Placeholder of each part type that is not text.
PLACEHOLDERS = {"image": "<|image_pad|>", "audio": "<|audio_pad|>", "document": "<|document_pad|>"}
START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
#: Turns that are gathered together in the first step.
RUN = 64


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def text_parts(text: Column) -> Column:
    """A plain text as a list of one content part."""
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("tokens")))


def _part_text(p: Column) -> Column:
    out = escape(F.coalesce(p["text"], F.lit("")))
    for kind, mark in PLACEHOLDERS.items():
        out = F.when(p["type"] == kind, F.lit(mark)).otherwise(out)
    return out


def flatten_parts(parts: Column) -> Column:
    """struct(content, attachments, tokens) of a list of struct(type, text, ref, tokens).

    attachments: struct(position among the parts, type, ref, tokens), in order. tokens: attachments by their
    stated counts, text by its white-space words."""
    parts = F.coalesce(parts, F.array().cast("array<struct<type:string,text:string,ref:string,tokens:int>>"))
    media = list(PLACEHOLDERS)
    numbered = F.transform(parts, lambda p, i: F.struct(i.alias("position"), p["type"].alias("type"), p["ref"].alias("ref"), F.coalesce(p["tokens"], F.lit(1)).alias("tokens")))
    words = lambda t: F.size(F.regexp_extract_all(F.coalesce(t, F.lit("")), F.lit(r"(\S+)")))
    tokens = F.aggregate(parts, F.lit(0), lambda n, p: n + F.when(p["type"].isin(media), F.coalesce(p["tokens"], F.lit(1))).otherwise(words(p["text"])))
    return F.struct(F.array_join(F.transform(parts, _part_text), "").alias("content"), F.filter(numbered, lambda a: a["type"].isin(media)).alias("attachments"), tokens.alias("tokens"))


def format_messages(messages: DataFrame, parts: str = "parts") -> DataFrame:
    """One row per conv_id of messages(conv_id, turn, role, ``parts``): formatted text, the loss mask as one
    (skip, take) pair of character counts per turn, attachments and token count."""
    role = F.coalesce(F.col("role"), F.lit(""))
    head = F.concat(F.lit(START), escape(role), F.lit(SEP))
    rendered = messages.select("conv_id", "turn", role.alias("role"), flatten_parts(F.col(parts)).alias("flat")).select(
        "conv_id", "turn", "role", F.col("flat.content").alias("content"), F.col("flat.attachments").alias("attachments"), F.col("flat.tokens").alias("tokens"), head.alias("head"))
    item = F.struct(
        "turn", "role", "content", F.concat("head", "content", F.lit(END)).alias("rendered"), F.length("head").alias("skip"),
        F.when(F.col("role") == "assistant", F.length("content")).otherwise(0).alias("take"), "attachments", "tokens")
    runs = rendered.groupBy("conv_id", F.floor(F.col("turn") / RUN).alias("run")).agg(F.array_sort(F.collect_list(item)).alias("m"))
    runs = runs.select(
        "conv_id", F.struct(
            "run", F.array_join(F.transform("m", lambda x: x["rendered"]), "").alias("formatted"),
            F.transform("m", lambda x: F.struct(x["skip"].alias("skip"), x["take"].alias("take"))).alias("mask"),
            F.flatten(F.transform("m", lambda x: F.transform(x["attachments"], lambda a: F.struct(x["turn"].alias("turn"), a["position"].alias("position"), a["type"].alias("type"), a["ref"].alias("ref"), a["tokens"].alias("tokens"))))).alias("attachments"),
            F.aggregate("m", F.lit(0).cast("long"), lambda n, x: n + x["tokens"]).alias("tokens")).alias("r"))
    whole = runs.groupBy("conv_id").agg(F.array_sort(F.collect_list("r")).alias("r"))
    return whole.select(
        "conv_id", F.array_join(F.transform("r", lambda x: x["formatted"]), "").alias("formatted"),
        F.flatten(F.transform("r", lambda x: x["mask"])).alias("loss_mask"),
        F.flatten(F.transform("r", lambda x: x["attachments"])).alias("attachments"),
        F.aggregate("r", F.lit(0).cast("long"), lambda n, x: n + x["tokens"]).alias("expanded_tokens"))


def read_formatted(formatted: DataFrame) -> DataFrame:
    """Turns read back from the formatted text: adds turns (struct(role, text)) and masked, the texts under the
    loss mask, unescaped."""
    pieces = F.slice(F.split("formatted", r"<\|im_start\|>"), 2, F.lit(2**31 - 1))
    turns = F.transform("pieces", lambda p: F.struct(
        unescape(F.substring_index(p, SEP, 1)).alias("role"),
        unescape(F.regexp_extract(p, r"(?s)^.*?<\|im_sep\|>(.*)<\|im_end\|>\n$", 1)).alias("text")))
    masked = F.zip_with("pieces", "loss_mask", lambda p, m: unescape(F.substring(p, m["skip"] - len(START) + 1, m["take"])))
    return formatted.withColumn("pieces", pieces).withColumn("turns", turns).withColumn("masked", masked).drop("pieces")
