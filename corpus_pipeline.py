"""From raw documents to packed sequences: five stages, each written as Parquet and read again by the next.

Every stage works on all documents that its predecessor kept, on whole texts however long. No stage's
decision depends on the order of rows; where texts tie, the stage says which stays. All but the last return the columns of
``documents``; the last returns one row per piece of a packed document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpie.llm import decontamination, jaccard, packing, repeats, toxicity
from kelpie.llm._common import discard, scratch, staged, text_id, unused
from kelpie.llm.queries import tokenizer

TOXIC_FROM = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier, fitted on the labelled ones, scores as toxic. A null or empty text scores
    as the intercept says and stays; rows of equal text go or stay together; without labels all stay."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    name = unused(docs, "score")
    return toxicity.score(docs, model, out=name).where(F.col(name) < TOXIC_FROM).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component of the join on five-word shingles at a similarity of 0.8: that of the
    least id (null last), of repeated rows one. Texts without words (null, empty, blank) all stay."""
    return jaccard.one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages of 200 bytes and more that start in more than one place; n_chars, where there is one, follows
    the text. All rows stay, those of repeated texts with what is left of them; a null text stays null."""
    out = repeats.remove_repeats(docs)
    return (out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out).select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which a twentieth of the words or more lies in benchmark windows. Documents are judged by
    text: rows of equal text go or stay together, whatever their ids; a null or empty text stays."""
    name = unused(docs, "row_text")
    keyed = docs.withColumn(name, text_id("text"))
    found = decontamination.contamination(keyed.select(name, "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), key=name)
    return keyed.join(found.where("contaminated").select(name).distinct(), name, "left_anti").select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences of 2048 tokens at balanced cost; a null or empty text is its end id."""
    return packing.pack(docs, tokenizer("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("repeats", cut_repeats), ("decontamination", drop_contaminated), ("packing", pack)]
#: SQL has neither the classifier nor the tokenizer; tests hold each stage against its rule.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; what a stage staged, and its input, go once its output is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with scratch(name):
            written = staged(stage(spark, docs, sf_dir), name)
        discard(docs)
        docs = written
    return docs
