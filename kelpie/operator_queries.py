"""Queries of single operators over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from kelpie.functions import text
from kelpie.queries import _t, query
from kelpie.sources import sinks


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(datepart('millisecond', ts) % 1000 AS VARCHAR), 3, '0') || 'Z' AS stamp FROM events")
def n18_stamps(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", text.iso_millis(F.col("ts")).alias("stamp"))


@query("SELECT CAST(vec_id AS BIGINT) AS chunk_id, CASE WHEN vec_id % 2 = 0 THEN label * 10 ELSE label END AS label FROM embeddings")
def k4_written_back(spark, sf_dir):
    """Values computed for every second chunk written back to it."""
    chunks = _t(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("chunk_id"), "label")
    made = chunks.where("chunk_id % 2 = 0").withColumn("label", (F.col("label") * 10).cast(chunks.schema["label"].dataType))
    return sinks.set_columns(chunks, made, "chunk_id", ["label"])
