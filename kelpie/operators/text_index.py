"""Substring search by a trigram index: postings of byte trigrams narrow the rows, texts of what is left are verified.

``build`` writes two tables: the texts in blocks of ``BLOCK`` rows, and for each trigram and block the rows that hold it (a
list of numbers, or a bit for each row where that is shorter), in ranges of trigrams so that a scan for a few of them skips
the other row groups by their statistics. Letters are compared without case, as ``lower`` has it.

``search`` takes up to ``GRAMS`` trigrams of each needle, reads their postings, intersects them block by block, reads the
blocks that are left (a filter on the block number, pushed into the scan), and keeps rows that do contain the needle. The
trigrams are only a filter, so results are those of a scan of all texts. Needles go in passes of ``NEEDLES``; what moves is
each wanted posting once a pass, and the candidates. A needle of fewer than three bytes is searched in all texts.

Defined cases: null texts contain nothing; an empty needle is in every text that isn't null; a null needle is in none; long
texts are indexed whole; repeated rows are found each; an empty table finds nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpie.sources.sinks import staged

BLOCK = 4_096
GRAMS, NEEDLES = 32, 20_000
#: Rows of a text file's row group, so that a filter on blocks skips groups.
PARQUET_BLOCK = 1 << 20


@dataclass
class TextIndex:
    path: str

    def texts(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/texts")

    def postings(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/postings")


def trigrams(data: bytes) -> np.ndarray:
    """Different byte trigrams as numbers."""
    b = np.frombuffer(data, np.uint8).astype(np.int32)
    return np.unique((b[:-2] << 16) | (b[1:-1] << 8) | b[2:]) if len(b) > 2 else np.zeros(0, np.int32)


def packed(rows: np.ndarray) -> bytes:
    """A list of two bytes a row, or the bits of a block."""
    if 16 * len(rows) < BLOCK:
        return rows.astype("<u2").tobytes()
    return np.packbits(np.isin(np.arange(BLOCK), rows)).tobytes()


def bits(rows: bytes) -> np.ndarray:
    """The bits of a block."""
    if 8 * len(rows) == BLOCK:
        return np.frombuffer(rows, np.uint8)
    out = np.zeros(BLOCK, bool)
    out[np.frombuffer(rows, "<u2")] = True
    return np.packbits(out)


def build(rows: DataFrame, path: str, id: str, text: str) -> TextIndex:
    kind = rows.schema[id].dataType.simpleString()

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, part = 0, TaskContext.get().partitionId() << 32
        for b in batches:
            at = done + np.arange(b.num_rows)
            done += b.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(part + at // BLOCK), pa.array((at % BLOCK).astype(np.int32)), b.column(0), b.column(1)], ["block", "row", id, "lowered"])

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            block, row, texts = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(3)
            for one in np.unique(block):
                where = np.flatnonzero(block == one)
                found = [(trigrams(texts[i].as_buffer().to_pybytes()), row[i]) for i in where.tolist() if texts[i].is_valid]
                if not found:
                    continue
                grams = np.concatenate([g for g, _ in found])
                rows_ = np.repeat(np.array([r for _, r in found], np.uint16), [len(g) for g, _ in found])
                order = np.lexsort((rows_, grams))
                grams, rows_ = grams[order], rows_[order]
                if not len(grams):
                    continue
                start = np.concatenate([[0], 1 + np.flatnonzero(np.diff(grams))])
                lists = [packed(x) for x in np.split(rows_, start[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(grams[start]), pa.array(np.full(len(start), one)), pa.array(lists, pa.binary())], ["gram", "block", "rows"])

    placed = rows.select(id, F.lower(F.col(text).cast("string")).alias("lowered")).mapInArrow(numbered, f"block long, row int, `{id}` {kind}, lowered string")
    placed.write.mode("overwrite").option("parquet.block.size", PARQUET_BLOCK).parquet(f"{path}/texts")
    texts = rows.sparkSession.read.parquet(f"{path}/texts")
    # a block cut over two reads is two lists of it, which searching joins again
    postings = texts.mapInArrow(listed, "gram int, block long, rows binary")
    postings.repartitionByRange("gram", "block").sortWithinPartitions("gram", "block").write.mode("overwrite").option("parquet.block.size", PARQUET_BLOCK).parquet(f"{path}/postings")
    return TextIndex(path)


def _grams(needles: DataFrame) -> DataFrame:
    """number and grams: different trigrams of the needle, ``GRAMS`` at most."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [trigrams(x.as_buffer().to_pybytes()) for x in b.column(1)]
            found = [g if len(g) <= GRAMS else g[np.linspace(0, len(g) - 1, GRAMS).astype(int)] for g in found]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int32()))], ["number", "grams"])

    return needles.select("number", "lowered").mapInArrow(cut, "number long, grams array<int>").where(F.size("grams") > 0)


def _meeting(numbers: np.ndarray, sets: list[np.ndarray]):
    """Rows of a block that have all trigrams of a needle, for each needle."""
    def meet(table: pa.Table) -> pa.Table:
        have: dict[int, np.ndarray] = {}
        for g, rows_ in zip(table["gram"].to_pylist(), table["rows"].to_pylist(), strict=True):
            have[g] = have[g] | bits(rows_) if g in have else bits(rows_)
        found, at = [], []
        for n, grams in zip(numbers.tolist(), sets, strict=True):
            left = None
            for g in grams.tolist():
                left = None if g not in have else have[g] if left is None else left & have[g]
                if left is None or not left.any():
                    left = None
                    break
            if left is not None:
                hits = np.flatnonzero(np.unpackbits(left))
                found.append(np.full(len(hits), n))
                at.append(hits)
        row = np.concatenate(at) if at else np.zeros(0, np.int64)
        return pa.table({"number": pa.array(np.concatenate(found) if found else np.zeros(0, np.int64), pa.int64()), "block": pa.array(np.full(len(row), table["block"][0].as_py()), pa.int64()), "row": pa.array(row, pa.int32())})

    return meet


def candidates(index: TextIndex, needles: DataFrame) -> DataFrame:
    """number, block and row of each text that has the trigrams of the needle."""
    spark = needles.sparkSession
    asked = staged(_grams(needles), "grams")
    passes = -(-asked.count() // NEEDLES)
    out = spark.createDataFrame([], "number long, block long, row int")
    for i in range(passes):
        held = asked.where(F.pmod(F.xxhash64("number"), F.lit(passes)) == i).toArrow()
        numbers, sets = held["number"].to_numpy(), [np.array(g) for g in held["grams"].to_pylist()]
        wanted = np.unique(np.concatenate(sets)) if sets else np.zeros(0, np.int32)

        postings = index.postings(spark)
        if len(wanted) <= 4_096:  # few enough for a filter that the scan can use
            postings = postings.where(F.col("gram").isin(wanted.tolist()))
        out = out.unionByName(postings.groupBy("block").applyInArrow(_meeting(numbers, sets), "number long, block long, row int"))
    return out


def search(index: TextIndex, needles: DataFrame, needle_id: str, needle: str, id: str) -> DataFrame:
    """(``needle_id``, ``id``) of each text that contains the needle, case aside."""
    spark = needles.sparkSession
    asked = staged(needles.where(F.col(needle).isNotNull()).select(F.col(needle_id).alias("needle_id"), F.lower(F.col(needle)).alias("lowered")).withColumn("number", F.monotonically_increasing_id()), "needles")
    found = staged(candidates(index, asked), "candidates")
    texts = index.texts(spark).select(F.col(id).alias("text_id"), "block", "row", F.col("lowered").alias("text"))
    near = texts.where(F.col("block").isin([r["block"] for r in found.select("block").distinct().collect()])) if found.select("block").distinct().count() <= 4_096 else texts
    kept = near.join(found, ["block", "row"]).join(asked, "number").where(F.contains("text", F.col("lowered"))).select("needle_id", "text_id")
    # texts of fewer than three bytes: 65,793 at most
    short = [r["lowered"] for r in asked.where(F.octet_length("lowered") < 3).select("lowered").distinct().collect()]
    if short:
        def holding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                at, which = [], []
                for i, t in enumerate(b.column(1).to_pylist()):
                    have = [s for s in short if t is not None and s in t]
                    at += [i] * len(have)
                    which += have
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(which, pa.string())], ["text_id", "lowered"])

        held = texts.select("text_id", "text").mapInArrow(holding, f"text_id {texts.schema['text_id'].dataType.simpleString()}, lowered string")
        kept = kept.unionByName(held.join(asked, "lowered").select("needle_id", "text_id"))
    return kept.select(F.col("needle_id").alias(needle_id), F.col("text_id").alias(id))


def read_share(index: TextIndex, needles: DataFrame, needle: str) -> DataFrame:
    """One row: texts of the table, those in blocks that a search reads, and those that it verifies."""
    spark = needles.sparkSession
    asked = needles.where(F.col(needle).isNotNull()).select(F.lower(F.col(needle)).alias("lowered")).withColumn("number", F.monotonically_increasing_id())
    found = staged(candidates(index, asked), "candidates")
    texts = index.texts(spark)
    read = texts.join(found.select("block").distinct(), "block", "left_semi").count()
    return found.select("block", "row").distinct().agg(F.count("*").alias("verified")).select(F.lit(texts.count()).alias("texts"), F.lit(read).alias("read"), "verified")
