"""Queries of joins by time, orders against events, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from kelpie.operators import temporal
from kelpie.queries import _t, query

_TIMED = "o AS (SELECT o_orderkey, o_custkey % 40 AS user_id, TIMESTAMP '2024-01-01' + to_microseconds((o_orderkey * 7919 % 2592000) * 1000000) AS ts FROM orders)"


def _sides(spark, sf_dir):
    """Orders placed in the month of the events, by the users of these."""
    orders, events = _t(spark, sf_dir, "orders"), _t(spark, sf_dir, "events")
    placed = F.timestamp_micros(F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp")) + (F.col("o_orderkey") * 7919 % 2_592_000) * 1_000_000)
    return orders.select("o_orderkey", (F.col("o_custkey") % 40).alias("user_id"), placed.alias("ts")), events.select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", "event_type")


@query(f"WITH {_TIMED} SELECT o_orderkey, event_id, event_type FROM o ASOF LEFT JOIN events e ON o.user_id = e.user_id AND o.ts >= e.ts")
def t1_asof_events(spark, sf_dir):
    """Each order with the last event of its user before it."""
    orders, events = _sides(spark, sf_dir)
    return temporal.asof(orders, events, ["user_id"], "ts", ["event_id", "event_type"]).select("o_orderkey", "event_id", "event_type")


@query(f"WITH {_TIMED} SELECT o_orderkey, count(*) AS n, min(event_id) AS first_event FROM o JOIN events e ON o.user_id = e.user_id AND e.ts <= o.ts AND e.ts >= o.ts - INTERVAL 6 HOUR GROUP BY o_orderkey")
def t2_events_within(spark, sf_dir):
    """Events of the user in the six hours before each order."""
    orders, events = _sides(spark, sf_dir)
    return temporal.within(orders, events, ["user_id"], "ts", 6 * 3600, ["event_id"]).groupBy("o_orderkey").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))
