"""As-of and interval joins by time, for keys of any size.

``asof``: rows of both sides are cut into ranges of (key, time); within a range each row takes the last right row before it,
and what a range begins without is handed over: per key, the last right row of the ranges before. So a key that holds a
large share of all rows is spread over ranges, and what is handed over is one row for each key and range.

``within``: both sides are dealt into time buckets as wide as the window, a left row into the two that its window meets,
so a join on (key, bucket) finds every pair once.

Defined cases: rows without key or time match nothing (the left ones of ``asof`` stay, with nulls); at equal times a right
row counts as before; of several right rows of one time the one with the largest carried values counts; repeated rows
are rows of their own; an empty side leaves the left rows with nulls, or no pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kelpie.sources.sinks import staged


def asof(left: DataFrame, right: DataFrame, by: list[str], time: str, carry: list[str], right_time: str | None = None) -> DataFrame:
    """Each row of ``left`` with ``carry`` of the last row of ``right`` of its key at or before its time. ``right_time``: the
    name under which that row's time is given too."""
    bad = left.where(" or ".join(f"`{c}` is null" for c in (*by, time)))
    good = left.where(" and ".join(f"`{c}` is not null" for c in (*by, time)))
    keys = [F.col(c).alias(f"_k{i}") for i, c in enumerate(by)]
    k = [f"_k{i}" for i in range(len(by))]
    hit = F.struct(F.col(time).alias("_at"), *carry)
    rows = good.select(*keys, F.col(time).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row")).unionByName(
        right.where(" and ".join(f"`{c}` is not null" for c in (*by, time))).select(*keys, F.col(time).alias("_t"), F.lit(0).alias("_side"), hit.alias("_hit")), allowMissingColumns=True)
    ranged = staged(rows.repartitionByRange(*k, "_t", "_side", "_hit").withColumn("_part", F.spark_partition_id()), "ranges")
    own = F.last("_hit", ignorenulls=True).over(Window.partitionBy("_part", *k).orderBy("_t", "_side", "_hit").rowsBetween(Window.unboundedPreceding, 0))
    before = F.last("_end", ignorenulls=True).over(Window.partitionBy(*k).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    handed = ranged.groupBy("_part", *k).agg(F.max("_hit").alias("_end")).withColumn("_before", before).where("_before is not null").drop("_end")
    found = ranged.withColumn("_own", own).where("_side = 1").join(handed, ["_part", *k], "left").withColumn("_found", F.coalesce("_own", "_before"))
    more = [F.col(f"_found.{c}").alias(c) for c in carry] + ([F.col("_found._at").alias(right_time)] if right_time else [])
    types = {f.name: f.dataType for f in right.schema.fields}
    none = [F.lit(None).cast(types[c]).alias(c) for c in carry] + ([F.lit(None).cast(types[time]).alias(right_time)] if right_time else [])
    return found.select("_row.*", *more).unionByName(bad.select(*left.columns, *none))


def within(left: DataFrame, right: DataFrame, by: list[str], time: str, seconds: int, carry: list[str]) -> DataFrame:
    """All pairs of a row of ``left`` and ``carry`` of a row of ``right`` of its key that is at most ``seconds`` before it."""
    at = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    width = F.lit(seconds * 1_000_000)
    bucket = lambda micros: F.call_function("div", micros - F.pmod(micros, width), width)
    l = left.where(F.col(time).isNotNull()).withColumn("_l", at(time)).withColumn("_b", F.explode(F.array(bucket(F.col("_l")), bucket(F.col("_l")) - 1)))
    r = right.where(F.col(time).isNotNull()).select(*by, at(time).alias("_r"), bucket(at(time)).alias("_b"), *carry)
    return l.join(r, [*by, "_b"]).where((F.col("_r") <= F.col("_l")) & (F.col("_r") >= F.col("_l") - seconds * 1_000_000)).select(*left.columns, *carry)
