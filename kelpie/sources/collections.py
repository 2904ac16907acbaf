"""Collections: keyed tables in buckets with versions, whose merges rewrite only the buckets that they touch.

A collection is a folder: ``data/version=n/bucket=b`` has the rows of a bucket as written by version n, and
``versions/n.json`` says for each bucket which version holds its rows. A merge finds the buckets of the new rows, reads and
writes just those, and then commits by putting its version file in place with one rename; readers list the version files and
take the newest. So a merge that dies leaves nothing that is read, readers never see half a merge, and of two merges at
once the second finds its number taken and is told so. Old versions stay readable until ``vacuum``.

Buckets are by hash of the keys, or of a coarser expression of them (``bucket_by``), which keeps keys that change together
in few buckets. A bucket is split over tasks by a hash of its rows when it is written, so a hot bucket is many files.

Defined cases: a null key is a key; of new rows with equal keys the last by ``order`` stays, and wins against an old row
that ties; a column that the new rows lack is null in them; an empty merge is a version without rewritten buckets.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpie.sources.sinks import staged, upsert


@dataclass
class Merge:
    """What a merge did: its version and the buckets that it rewrote."""

    version: int
    rewritten: list[int]


class Collection:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._io = jvm.org.apache.commons.io.IOUtils

    def _get(self, name: str) -> dict:
        stream = self._fs.open(self._path(f"{self.path}/{name}"))
        try:
            return json.loads(self._io.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _put(self, name: str, value: dict) -> None:
        """Put a small file in place at once, or fail if there is one."""
        to, temp = self._path(f"{self.path}/{name}"), self._path(f"{self.path}/.{name.replace('/', '-')}.new")
        out = self._fs.create(temp, True)
        out.write(bytearray(json.dumps(value).encode()))
        out.close()
        self._fs.mkdirs(to.getParent())
        if self._fs.exists(to) or not self._fs.rename(temp, to):
            self._fs.delete(temp, False)
            raise ValueError(f"{name} is taken: another merge came first")

    @classmethod
    def create(cls, spark: SparkSession, path: str, keys: list[str], buckets: int = 64, bucket_by: str | None = None, recreate: bool = False) -> Collection:
        """A new empty collection. One that exists is an error, unless it is to be dropped and made anew."""
        c = cls(spark, path)
        if c.exists():
            if not recreate:
                raise ValueError(f"{path} exists")
            c._fs.delete(c._path(c.path), True)
        c._put("collection.json", {"keys": keys, "buckets": buckets, "bucket_by": bucket_by})
        return c

    def exists(self) -> bool:
        return self._fs.exists(self._path(f"{self.path}/collection.json"))

    def versions(self) -> list[int]:
        folder = self._path(f"{self.path}/versions")
        return sorted(int(f.getPath().getName().removesuffix(".json")) for f in self._fs.listStatus(folder)) if self._fs.exists(folder) else []

    def current(self) -> int:
        """The newest version, 0 for none."""
        return max(self.versions(), default=0)

    def _bucket(self) -> Column:
        made = self._get("collection.json")
        by = [F.expr(made["bucket_by"])] if made["bucket_by"] else [F.col(k) for k in made["keys"]]
        return F.pmod(F.xxhash64(*by), F.lit(made["buckets"])).cast("int")

    def _rows(self, holders: dict[str, int], schema: str | None) -> DataFrame | None:
        """The rows of buckets; the scan lists only their folders."""
        if not holders:
            return None
        paths = [f"{self.path}/data/version={v}/bucket={b}" for b, v in holders.items()]
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/data").parquet(*paths).drop("version", "bucket")

    def read(self, version: int | None = None) -> DataFrame:
        version = self.current() if version is None else version
        if not version:
            raise ValueError(f"{self.path} has no version")
        found = self._get(f"versions/{version}.json")
        rows = self._rows(found["buckets"], found["schema"])
        return self.spark.createDataFrame([], found["schema"]) if rows is None else rows.select(*[n for n in self._names(found["schema"])])

    @staticmethod
    def _names(schema: str) -> list[str]:
        from pyspark.sql.types import StructType

        return [f"`{n}`" for n in StructType.fromDDL(schema).names]

    def _commit(self, before: int, holders: dict[str, int], schema: str) -> None:
        self._put(f"versions/{before + 1}.json", {"buckets": holders, "schema": schema})

    @staticmethod
    def _ddl(df: DataFrame) -> str:
        return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def merge(self, new: DataFrame, order: Column | None = None, gone: DataFrame | None = None) -> Merge:
        """Upsert ``new`` by key (the last by ``order`` stays; without one the new row) and drop the keys of ``gone``."""
        keys, before = self._get("collection.json")["keys"], self.current()
        old = self._get(f"versions/{before}.json") if before else {"buckets": {}, "schema": self._ddl(new)}
        bucketed = staged(new.withColumn("bucket", self._bucket()), "merge")
        leaving = staged(gone.select(*keys).distinct().withColumn("bucket", self._bucket()), "gone") if gone is not None else None
        touched = {r["bucket"] for df in (bucketed, leaving) if df is not None for r in df.select("bucket").distinct().collect()}  # as many as there are buckets
        held = {b: v for b, v in old["buckets"].items() if int(b) in touched}
        rows = self._rows(held, old["schema"])
        fresh = bucketed.drop("bucket")
        rows = rows if rows is not None else self.spark.createDataFrame([], old["schema"])
        merged = upsert(rows, fresh, keys, order if order is not None else F.lit(0))
        if leaving is not None:
            same = [merged[k].eqNullSafe(F.col(f"_gone_{k}")) for k in keys]
            merged = merged.join(leaving.select(*[F.col(k).alias(f"_gone_{k}") for k in keys]), same, "left_anti")
        version, schema = before + 1, self._ddl(merged)
        if touched:
            spread = merged.withColumn("bucket", self._bucket()).repartition("bucket", F.pmod(F.xxhash64(*keys), F.lit(4)))
            spread.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/version={version}")
        there = self._path(f"{self.path}/data/version={version}")
        written = {int(f.getPath().getName().split("=")[1]) for f in self._fs.listStatus(there) if f.getPath().getName().startswith("bucket=")} if touched else set()
        kept = {b: v for b, v in old["buckets"].items() if int(b) not in touched}
        self._commit(before, kept | {str(b): version for b in written}, schema)
        return Merge(version, sorted(written))

    def append(self, new: DataFrame) -> Merge:
        """Rows whose key is absent are added."""
        keys = self._get("collection.json")["keys"]
        if not self.current():
            return self.merge(new.dropDuplicates(keys))
        return self.merge(new.dropDuplicates(keys).join(self.read().select(*keys), keys, "left_anti"))

    def restore(self, version: int) -> int:
        """Make an old version the current one again; gives the new version's number."""
        found, before = self._get(f"versions/{version}.json"), self.current()
        self._commit(before, found["buckets"], found["schema"])
        return before + 1

    def vacuum(self, keep: int = 1) -> None:
        """Drop all but the newest ``keep`` versions, and the buckets that only they hold."""
        versions = self.versions()
        stay, drop = versions[-keep:], versions[:-keep]
        used = {(v, b) for n in stay for b, v in self._get(f"versions/{n}.json")["buckets"].items()}
        held = {(v, b) for n in drop for b, v in self._get(f"versions/{n}.json")["buckets"].items()}
        for n in drop:
            self._fs.delete(self._path(f"{self.path}/versions/{n}.json"), False)
        for v, b in held - used:
            self._fs.delete(self._path(f"{self.path}/data/version={v}/bucket={b}"), True)
