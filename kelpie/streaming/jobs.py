"""Incremental jobs: scoring of new turns, event-time windows, sessions, first events."""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from kelpie.operators import evaluate
from kelpie.streaming import stateful


def files(spark: SparkSession, schema, path: str, per_trigger: int = 100, format: str = "parquet") -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).format(format).load(path)


def drain(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Appends what the stream gives for all files that are there, as Parquet. Batches without data are switched off, since
    a timeout of a state by the clock calls for them without end. State is kept by RocksDB, as stateful processors ask."""
    with _settings(stream.sparkSession):
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()


def drain_whole(stream: DataFrame, out: str, checkpoint: str) -> None:
    """As ``drain``, for results that change until the stream ends: each batch writes the whole result anew."""
    with _settings(stream.sparkSession):
        q = stream.writeStream.foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(out)).option("checkpointLocation", checkpoint).outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()


@contextlib.contextmanager
def _settings(spark: SparkSession) -> Iterator[None]:
    ours = {"spark.sql.streaming.noDataMicroBatches.enabled": "false", "spark.sql.streaming.stateStore.providerClass": stateful.ROCKSDB}
    before = {k: spark.conf.get(k, None) for k in ours}
    for k, v in ours.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def score_turns(turns: DataFrame, out: str, checkpoint: str, once: bool = True, score: Callable[[DataFrame], DataFrame] = evaluate.evaluate, written: Callable[[int], None] = lambda number: None) -> StreamingQuery:
    """Scores each new turn once. A batch writes its rows to a folder of its own, overwriting what an attempt that was cut
    off has left there, and then enters itself in the ledger; ``scored_turns`` reads only what the ledger names. So a stream
    that is killed at any point and started again from its checkpoint gives each turn once. ``written`` is called between
    the two."""

    def write(batch: DataFrame, number: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{out}/rows/batch={number}")
        written(number)
        batch.sparkSession.range(1).select(F.lit(number).cast("long").alias("number")).coalesce(1).write.mode("overwrite").parquet(f"{out}/ledger/batch={number}")

    w = turns.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime="5 minutes")).start()


def scored_turns(spark: SparkSession, out: str) -> DataFrame:
    """The rows of the batches that are in the ledger."""
    done = [r["number"] for r in spark.read.parquet(f"{out}/ledger").select("number").distinct().collect()]  # a number a batch
    return spark.read.parquet(f"{out}/rows").where(F.col("batch").isin(done))


def event_windows(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums by event type in tumbling or sliding windows; later events are dropped."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def first_seen(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)
