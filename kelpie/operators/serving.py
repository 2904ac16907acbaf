"""Queries behind the screens: conversations, review queues, balance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpie.sources.sinks import delete_keys, upsert


def conversations(turns: DataFrame, limit: int = 50, conversation: str = "conversation_id", time: str = "timestamp", query: str = "query") -> DataFrame:
    """The newest conversations: title (60 characters of the first question), last question, last time, turns."""
    out = turns.groupBy(conversation).agg(F.min_by(query, time).alias("first_query"), F.max_by(query, time).alias("last_query"), F.max(time).alias("last_time"), F.count("*").alias("turns"))
    return out.withColumn("title", F.left("first_query", F.lit(60))).orderBy(F.desc("last_time"), conversation).limit(limit)


def conversation(turns: DataFrame, id: str, time: str = "timestamp") -> DataFrame:
    return turns.where(F.col("conversation_id") == id).orderBy(time)


def key_from_url(key: Column, url: Column) -> Column:
    return F.coalesce(F.nullif(key, F.lit("")), F.nullif(F.regexp_extract(F.coalesce(url, F.lit("")), r"/browse/([A-Z]{2,9}-\d+)", 1), F.lit("")))


def review_queue(scored: DataFrame, chosen: DataFrame, fallback: int = 200) -> DataFrame:
    """Rejected turns, or, if there are none, the newest that were not scored, with the chosen half if written."""
    rejected = scored.where("training_signal = 'dpo_rejected'")
    none = rejected.agg(F.count("*").alias("_n")).where("_n = 0")
    fresh = scored.where("weighted_score is null").orderBy(F.desc("timestamp"), "turn_id").limit(fallback).crossJoin(F.broadcast(none)).drop("_n")  # one row, or none
    return rejected.unionByName(fresh).join(chosen.select("turn_id", "chosen"), "turn_id", "left")


def save_chosen(chosen: DataFrame, new: DataFrame, turns: DataFrame, least: int = 50) -> DataFrame:
    """The better answers with new(turn_id, chosen, saved_at) merged in: those of ``least`` characters and more, of turns
    that exist; the last saved wins."""
    good = new.where(F.length(F.trim("chosen")) >= least).join(turns.select("turn_id"), "turn_id", "left_semi")
    return upsert(chosen, good, ["turn_id"], F.col("saved_at"))


def exclude(excluded: DataFrame, new: DataFrame, turns: DataFrame) -> DataFrame:
    """The manual exclusions with new(turn_id, reason, excluded_at) of turns that exist; the last reason wins."""
    return upsert(excluded, new.join(turns.select("turn_id"), "turn_id", "left_semi"), ["turn_id"], F.col("excluded_at"))


def restore(excluded: DataFrame, again: DataFrame) -> DataFrame:
    return delete_keys(excluded, again, ["turn_id"])


def training_queue(reasoned: DataFrame, excluded: DataFrame) -> DataFrame:
    """Adds status: excluded by hand, by a rule, or ready."""
    mark = excluded.select("turn_id").distinct().withColumn("_x", F.lit(True))
    return reasoned.join(mark, "turn_id", "left").withColumn("status", F.when(F.col("_x"), "excluded").when(F.size("reasons") > 0, "filtered").otherwise("ready")).drop("_x")


def balance(rows: DataFrame, shares: dict[str, float] | None = None) -> DataFrame:
    """Share of each intent and whether it reaches its part."""
    shares = shares or {"sentries": 0.35, "rag": 0.25, "both": 0.25}
    wanted = F.element_at(F.create_map(*[F.lit(x) for kv in shares.items() for x in kv]), F.col("intent"))
    n = rows.groupBy("intent").agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    return n.crossJoin(F.broadcast(total)).withColumn("share", F.round(F.col("n") / F.col("total"), 4)).withColumn("enough", F.coalesce(F.col("n") / F.col("total") >= wanted, F.lit(True)))  # one row


def turn_summary(results: Column) -> Column:
    """Of live results: source, operation, count and the first five titles."""
    return F.transform(results, lambda r: F.struct(r["source"].alias("source"), r["operation"].alias("operation"), r["count"].alias("count"), F.slice(r["titles"], 1, 5).alias("titles")))


def runs(metrics: DataFrame, active: DataFrame, limit: int = 50) -> DataFrame:
    """The newest training runs, the active version marked."""
    return metrics.join(active.select("version").withColumn("production", F.lit(True)), "version", "left").withColumn("production", F.coalesce("production", F.lit(False))).orderBy(F.desc("started_at"), "version").limit(limit)
