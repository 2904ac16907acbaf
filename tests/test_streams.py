"""Streams with state: order within a micro-batch, restarts, state that is carried over."""

import pandas as pd
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from kelpie.streaming import jobs, stateful


def landed(spark, path, *parts):
    """One file a part, in order."""
    for rows in parts:
        rows.coalesce(1).write.mode("append").parquet(str(path))
    return jobs.files(spark, parts[0].schema, str(path), 1)


def test_many_turns_of_one_conversation_in_one_batch(spark, tmp_path):
    turns = spark.range(25_000).select(F.lit("c").alias("conversation_id"), F.col("id").alias("turn"), F.when(F.col("id") == 5, "P").alias("project"), F.when(F.col("id") == 24_000, "T").alias("ticket"))
    jobs.drain(stateful.carry_context(landed(spark, tmp_path / "in", turns.orderBy(F.rand(3)))), str(tmp_path / "out"), str(tmp_path / "cp"))
    out = spark.read.parquet(str(tmp_path / "out"))
    assert (out.count(), out.where("project = 'P'").count(), out.where("ticket = 'T'").count()) == (25_000, 24_995, 1_000)


def test_context_goes_on_over_batches(spark, tmp_path):
    frame = lambda rows: spark.createDataFrame(rows, "conversation_id string, turn long, project string, ticket string")
    stream = landed(spark, tmp_path / "in", frame([("a", 2, None, "T"), ("a", 1, "P", None), (None, 1, "N", None)]), frame([("a", 3, None, None), ("b", 1, None, None), (None, 2, None, None)]), frame([("a", 4, "Q", None), ("a", 4, "Q", None)]))
    jobs.drain(stateful.carry_context(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()), key=str)
    assert got == sorted([("a", 1, "P", None), ("a", 2, "P", "T"), ("a", 3, "P", "T"), ("a", 4, "Q", "T"), ("a", 4, "Q", "T"), ("b", 1, None, None), (None, 1, "N", None), (None, 2, "N", None)], key=str)


def test_rolling_mean_over_batches(spark, tmp_path):
    rows = [("x", i // 2, float((i * 7919) % 101) if i % 13 else None, i) for i in range(15_000)] + [("y", 1, None, 1), ("y", 2, 3.0, 2)]
    frame = lambda rows: spark.createDataFrame(rows, "k string, at long, v double, i long")
    stream = landed(spark, tmp_path / "in", frame(rows[:12_000][::-1]), frame(rows[12_000:12_010]), frame(rows[12_010:]))
    jobs.drain(stateful.rolling_mean(stream, "k", "at", "v", "i", 50), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = spark.read.parquet(str(tmp_path / "out")).toPandas().sort_values(["k", "i"])
    want = pd.DataFrame(rows, columns=["k", "at", "v", "i"])
    want = want.assign(rolling=want.groupby("k")["v"].transform(lambda v: v.rolling(50, min_periods=1).mean())).sort_values(["k", "i"])
    pd.testing.assert_series_equal(got["rolling"].reset_index(drop=True), want["rolling"].reset_index(drop=True))


@pytest.mark.parametrize("at", [0, 1])
def test_scoring_cut_off_and_started_again(spark, tmp_path, at):
    frame = lambda a, b: spark.range(a, b).select(F.col("id").alias("turn_id"))
    stream = landed(spark, tmp_path / "in", frame(0, 10), frame(10, 30), frame(30, 31))
    out, cp, seen = str(tmp_path / "out"), str(tmp_path / "cp"), []

    def score(rows):
        return rows.withColumn("score", F.col("turn_id") * 2)

    def cut_off(number):
        seen.append(number)
        if number == at:
            raise RuntimeError("cut off")

    with pytest.raises(StreamingQueryException):
        jobs.score_turns(stream, out, cp, score=score, written=cut_off).awaitTermination()
    if at:
        assert jobs.scored_turns(spark, out).count() == 10  # what was written but not entered isn't read
    jobs.score_turns(stream, out, cp, score=score, written=seen.append).awaitTermination()
    assert sorted((r.turn_id, r.score) for r in jobs.scored_turns(spark, out).collect()) == [(i, 2 * i) for i in range(31)]
    assert seen == [*range(at + 1), *range(at, 3)]
    jobs.score_turns(stream, out, cp, score=score, written=seen.append).awaitTermination()
    assert len(seen) == at + 1 + 3 - at and jobs.scored_turns(spark, out).count() == 31


def test_scored_turns_take_all_cores(spark, sf_dir, monkeypatch):
    """However many cores: two batches, each with a file a core."""
    from kelpie import stream_queries

    seen = []
    files = stream_queries.jobs.files
    monkeypatch.setattr(stream_queries.jobs, "files", lambda spark, schema, path, n: seen.append((path, n)) or files(spark, schema, path, n))
    found = stream_queries.st5_scored_turns(spark, sf_dir)
    assert found.where("times = 1 and as_in_one_batch").count() == found.count() > 0
    (path, n), cores = seen[0], spark.sparkContext.defaultParallelism
    landed = spark.read.parquet(path)
    assert n == max(2, cores) and n < len(landed.inputFiles()) <= 2 * n
