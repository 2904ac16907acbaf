"""Keyed merges as plans, and writers. Each merge returns the table's new content."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_SCRATCH: list[tuple[SparkSession, str]] = []


def _drop_scratch() -> None:
    for spark, path in _SCRATCH:
        try:
            hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
        except Exception:  # the session may be gone already; the folder is a scratch folder
            return


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share, dropped when the driver's process ends. A folder of this machine
    serves in local mode only; on a cluster it would lose data, so a missing setting is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file:///tmp/checkpoints/kelpie"
    folder = folder.rstrip("/")
    if not _SCRATCH:
        atexit.register(_drop_scratch)
    _SCRATCH.append((spark, f"{folder}/{name}-{uuid.uuid4().hex[:12]}"))
    return _SCRATCH[-1][1]


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read again: computed once."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The last row of each key by ``order``; a new row wins a tie."""
    rows = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(order.desc(), F.desc("_new"))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_new")


def insert_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` whose key is absent, added."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(keys), keys, "left_anti"), allowMissingColumns=True)


def replace_split(old: DataFrame, new: DataFrame, id: str = "document_id") -> DataFrame:
    """New documents take the place of all old rows with their base id, split or not."""
    from kelpie.functions.text import base_id

    fresh = new.select(base_id(F.col(id)).alias("_base")).distinct()
    return old.withColumn("_base", base_id(F.col(id))).join(fresh, "_base", "left_anti").drop("_base").unionByName(new, allowMissingColumns=True)


def delete_keys(old: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return old.join(gone.select(keys).distinct(), keys, "left_anti")


def set_columns(old: DataFrame, values: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``old`` with columns taken from ``values`` where its key is there."""
    v = values.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    out = old.join(v, key, "left")
    for c in columns:
        out = out.withColumn(c, F.coalesce(f"_{c}", c) if c in old.columns else F.col(f"_{c}")).drop(f"_{c}")
    return out


def vector_points(chunks: DataFrame) -> DataFrame:
    """Points keyed by hashed chunk id; rows without id or vector are left out, one row per point."""
    from kelpie.functions.text import point_id

    rows = chunks.where((F.coalesce("chunk_id", F.lit("")) != "") & (F.size("embedding") > 0))
    return rows.withColumn("point_id", point_id(F.col("chunk_id"))).dropDuplicates(["point_id"])


def write_jsonl(rows: DataFrame, path: str, files: int | None = None) -> None:
    (rows.coalesce(files) if files else rows).write.mode("overwrite").json(path)


def write_snapshot(rows: DataFrame, path: str, version: str) -> None:
    """A version of a data set in a partition of its own."""
    rows.withColumn("snapshot", F.lit(version)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot").parquet(path)


def current(snapshots: DataFrame) -> DataFrame:
    top = snapshots.agg(F.max("snapshot").alias("snapshot"))
    return snapshots.join(F.broadcast(top), "snapshot")  # one row
