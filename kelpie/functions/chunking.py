"""Overlapping chunks of long texts, broken at paragraphs, sentences or blanks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf, udtf
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from kelpie.functions.text import strip, text_or_empty

CHUNK, OVERLAP, CONTENT_CAP = 512 * 4, 128 * 4, 50_000
_BREAKS = (("\n\n", 0), (". ", 1), (" ", 0))


def chunk_text(text: str | None, size: int = CHUNK, overlap: int = OVERLAP) -> list[str]:
    """Windows of ``size`` characters that end at the last break inside them and begin ``overlap`` before the
    last end. Always moves on: where stepping back would not, the next window begins at the last end."""
    text = text or ""
    out, begin = [], 0 if text.strip() else len(text)
    while begin < len(text):
        end = begin + size
        if end < len(text):
            for mark, keep in _BREAKS:
                at = text.rfind(mark, begin, end)
                if at > begin:
                    end = at + keep
                    break
        if piece := text[begin:end].strip():
            out.append(piece)
        back = end - overlap
        begin = back if back > begin else max(end, begin + 1)
    return out


@pandas_udf(ArrayType(StringType()))
def chunk_column(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield batch.map(chunk_text)


@udtf(returnType=StructType().add("chunk_index", IntegerType()).add("total_chunks", IntegerType()).add("text", StringType()))
class ChunkText:
    """SELECT * FROM chunk_text(text): one row per chunk."""

    def eval(self, text: str):
        pieces = chunk_text(text)
        for i, piece in enumerate(pieces):
            yield i, len(pieces), piece


def chunk_documents(docs: DataFrame, done: DataFrame | None = None, id: str = "document_id", title: str = "title", content: str = "content", cap: int | None = None) -> DataFrame:
    """One row per chunk of title and content: chunk_id, parent_document_id, chunk_index,
    total_chunks, text, token_count and the columns of the document. ``done`` holds ids to leave out;
    ``cap`` keeps that many first characters of the content only (the reference's default: CONTENT_CAP)."""
    if done is not None:
        docs = docs.join(done.select(id), id, "left_anti")
    head = F.coalesce(strip(F.col(title)), F.lit("")) if title in docs.columns else F.lit("")
    body = text_or_empty(F.col(content))
    body = body if cap is None else F.substring(body, 1, cap)
    whole = F.when(head == "", body).otherwise(F.concat(head, F.lit("\n\n"), body))
    rest = [c for c in docs.columns if c not in (id, content)]
    pieces = docs.select(id, *rest, chunk_column(whole).alias("pieces"))
    flat = pieces.select(id, *rest, F.size("pieces").alias("total_chunks"), F.posexplode("pieces").alias("chunk_index", "text"))
    return flat.select(
        F.concat(F.col(id).cast("string"), F.lit("_chunk_"), F.col("chunk_index")).alias("chunk_id"), F.col(id).alias("parent_document_id"), "chunk_index", "total_chunks", "text",
        F.floor(F.length("text") / 4).cast("int").alias("token_count"), *rest)


def split_large(docs: DataFrame, id: str = "document_id", content: str = "content", size: int = 80_000) -> DataFrame:
    """Documents longer than ``size`` characters as numbered parts; others unchanged, as their only part."""
    from kelpie.functions.text import parts

    rest = [c for c in docs.columns if c not in (id, content)]
    large = F.length(content) > size
    cut: Column = F.when(large, parts(F.col(content), size)).otherwise(F.array(F.col(content)))
    flat = docs.select(F.col(id).cast("string").alias("original_document_id"), *rest, large.alias("is_partial"), F.size(cut).alias("total_parts"), F.posexplode(cut).alias("i", content))
    part = F.col("i") + 1
    return flat.select(F.when(F.col("is_partial"), F.concat("original_document_id", F.lit("_part_"), part)).otherwise(F.col("original_document_id")).alias(id), content, *rest, "original_document_id", "is_partial", part.alias("part_number"), "total_parts")


def chunk_stats(chunks: DataFrame, documents: DataFrame, sample: int = 10) -> DataFrame:
    """(name, value): documents, chunks, chunks a document (none without documents), chunks by source, and least, most and
    mean tokens of the first ``sample`` chunks by id."""
    n = chunks.agg(F.count("*").cast("double").alias("chunks")).crossJoin(documents.agg(F.count("*").cast("double").alias("documents")))  # one row each
    total = n.select(F.explode(F.create_map(F.lit("documents"), F.col("documents"), F.lit("chunks"), F.col("chunks"), F.lit("chunks_per_document"), F.try_divide("chunks", "documents"))).alias("name", "value"))
    by_source = chunks.groupBy("source").agg(F.count("*").cast("double").alias("value")).select(F.concat(F.lit("source:"), F.coalesce("source", F.lit(""))).alias("name"), "value")
    first = chunks.orderBy("chunk_id").limit(sample).agg(F.min("token_count").cast("double").alias("a"), F.max("token_count").cast("double").alias("b"), F.avg("token_count").alias("c"))
    sizes = first.select(F.explode(F.create_map(F.lit("sample_min"), F.col("a"), F.lit("sample_max"), F.col("b"), F.lit("sample_avg"), F.col("c"))).alias("name", "value"))
    return total.unionByName(by_source).unionByName(sizes).where("value is not null")


def preview(chunks: DataFrame, n: int = 3, chars: int = 100) -> DataFrame:
    """The first ``n`` chunks by id that wait for an embedding, with the head of their texts."""
    head = F.concat(F.substring(F.coalesce("text", F.lit("")), 1, chars), F.lit("..."))
    return chunks.orderBy("chunk_id").limit(n).select("chunk_id", "source", "source_type", "token_count", head.alias("preview"))
