"""Queries of the streams, drained over the test tables, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from kelpie.operators import evaluate
from kelpie.queries import _PAIRS, _t, _turns, query
from kelpie.sources import sinks
from kelpie.streaming import jobs, stateful


def _files(spark, sf_dir, name, per_trigger=100):
    """A table's files as a stream."""
    return jobs.files(spark, _t(spark, sf_dir, name).schema, f"{sf_dir}/{name[:-1]}[{name[-1]}].parquet", per_trigger)


def _by_time(spark, sf_dir, parts):
    """Events landed in order of time, in parts of four files each, a part a trigger."""
    path = sinks.scratch(spark, "landed")
    events = _t(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    cuts = events.agg(F.percentile_approx("ts", [i / parts for i in range(1, parts)]).alias("cuts")).first()["cuts"] or []
    for after, until in zip([None, *cuts], [*cuts, None], strict=True):  # the files of one write have no order
        part = events.where(F.col("ts") > after) if after else events
        (part.where(F.col("ts") <= until) if until else part).repartition(4).write.mode("append").parquet(path)
    return jobs.files(spark, events.schema, path, 4)


def _appended(spark, stream):
    """The rows that a stream appends, as a table in the shared folder."""
    out = sinks.scratch(spark, "appended")
    spark.createDataFrame([], stream.schema).write.parquet(out)
    jobs.drain(stream, out, sinks.scratch(spark, "stream"))
    return spark.read.schema(stream.schema).parquet(out)


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s FROM events),
n AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS session_start, count(*) AS n FROM n GROUP BY user_id, k""")
def st2_sessions(spark, sf_dir):
    """Sessions of users, by a stream that writes its whole result at each batch."""
    stream = jobs.sessions(_by_time(spark, sf_dir, 3))
    out = sinks.scratch(spark, "sessions")
    jobs.drain_whole(stream, out, sinks.scratch(spark, "stream"))
    return spark.read.schema(stream.schema).parquet(out).select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), "n")


@query("""SELECT CAST(user_id AS VARCHAR) AS conversation_id, CAST(event_id AS BIGINT) AS turn,
 last_value(CASE WHEN event_id % 3 = 0 THEN event_type END IGNORE NULLS) OVER w AS project, last_value(CASE WHEN event_id % 5 = 0 THEN 'T-' || event_id END IGNORE NULLS) OVER w AS ticket
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""")
def st3_carried_context(spark, sf_dir):
    """Users as conversations: every third event names a project, every fifth a ticket."""
    turns = _files(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("conversation_id"), F.col("event_id").cast("long").alias("turn"),
        F.when(F.col("event_id") % 3 == 0, F.col("event_type")).alias("project"), F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("T-"), F.col("event_id").cast("string"))).alias("ticket"))
    return _appended(spark, stateful.carry_context(turns))


@query("SELECT DISTINCT user_id, event_type FROM events")
def st4_first_seen(spark, sf_dir):
    """The first event of each user and type, seen within a watermark longer than the table."""
    events = _files(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return _appended(spark, jobs.first_seen(events, ["user_id", "event_type"], "3650 days")).select("user_id", "event_type")


@query(f"WITH {_PAIRS} SELECT concat_ws('-', conv_id, turn) AS turn_id, 1 AS times, true AS as_in_one_batch FROM pairs")
def st5_scored_turns(spark, sf_dir):
    """Turns scored batch by batch by a stream that is cut off between writing a batch and entering it, started again from
    its checkpoint, and then held against scores of all turns at once."""
    landed, out, checkpoint = (sinks.scratch(spark, x) for x in ("landed", "scored", "stream"))
    turns = _turns(spark, sf_dir)
    half = max(2, spark.sparkContext.defaultParallelism)  # two batches, each of as many files as there are cores
    turns.repartition(2 * half).write.parquet(landed)
    source = jobs.files(spark, turns.schema, landed, half)
    score = lambda rows: evaluate.evaluate(rows, year=2025).select("turn_id", "faithfulness", "weighted_score", "failure_tags", "quality_grade")

    def cut_off(number: int) -> None:
        if number == 1:
            raise RuntimeError("cut off")

    try:
        jobs.score_turns(source, out, checkpoint, score=score, written=cut_off).awaitTermination()
    except StreamingQueryException:  # as meant
        jobs.score_turns(source, out, checkpoint, score=score).awaitTermination()
    found = jobs.scored_turns(spark, out).drop("batch")
    both = found.join(score(spark.read.schema(turns.schema).parquet(landed)).select("turn_id", F.struct("faithfulness", "weighted_score", "failure_tags", "quality_grade").alias("want")), "turn_id", "full")
    same = F.struct("faithfulness", "weighted_score", "failure_tags", "quality_grade").eqNullSafe(F.col("want"))
    return both.groupBy("turn_id").agg(F.count("*").cast("int").alias("times"), F.bool_and(same).alias("as_in_one_batch"))


@query("SELECT event_type, event_id, round(avg(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 6) AS rolling FROM events")
def x17_rolling_stream(spark, sf_dir):
    """Means of the last 50 values of each type, over four micro-batches."""
    stream = stateful.rolling_mean(_by_time(spark, sf_dir, 4), "event_type", "ts", "value", "event_id")
    return _appended(spark, stream).select("event_type", "event_id", F.round("rolling", 6).alias("rolling"))
