"""A source that is read page by page: partitions by space (project, group), cursor pages within each.

``spark.read.format("kelpie_paged")`` asks a client for its spaces and, in one task each, for a space's pages until no
cursor follows or ``max_items`` records are read. A client that knows cursors within a space beforehand (``starts``) has
large spaces read by several tasks, if no ``max_items`` is asked for. A filter on the space column (equal, in) is taken over by the source, so
spaces that it rules out are never asked. ``page_size`` and ``max_items`` are per space, as trackers and wikis have them.

A client has ``spaces() -> list[str]``, ``page(space, cursor, size) -> (records, next cursor or None)`` and, if it can,
``starts(space) -> list of cursors``; all run in Python workers. ``FolderClient`` serves pages that were landed as JSON lines in a folder that all executors share, a
sub-folder for each space, as ``land`` writes them. Another one is named by the option ``client`` (module:class), and is
made from the source's options.

Defined cases: records lack or have fields freely, a missing one is null; an unknown space has no pages; a space of a null
key is read back as null; ``max_items`` of 0 reads nothing.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

#: The folder name of Spark's partitioned writers for a null.
NULL_SPACE = "__HIVE_DEFAULT_PARTITION__"


class FolderClient:
    """Pages of landed files: a cursor is the number of a record."""

    #: Files of a space that one task reads.
    FILES = 16

    def __init__(self, options: dict[str, str]):
        from pyarrow import fs

        self.fs, root = fs.FileSystem.from_uri(options["path"])
        named = [f for f in self._under(root) if f.base_name.startswith("space=")]
        self.folders = {unquote(f.base_name.split("=", 1)[1]): f.path for f in named}
        self.names: dict[str, list[str]] = {}

    def _under(self, path: str) -> list:
        from pyarrow import fs

        return sorted(self.fs.get_file_info(fs.FileSelector(path, allow_not_found=True)), key=lambda f: f.path)

    def _files(self, space: str) -> list[str]:
        if space not in self.names:
            self.names[space] = [f.path for f in self._under(self.folders[space]) if f.base_name.endswith(".json")] if space in self.folders else []
        return self.names[space]

    def spaces(self) -> list[str]:
        return list(self.folders)

    def starts(self, space: str) -> list[str]:
        return [f"{at},0" for at in range(0, len(self._files(space)), self.FILES)]

    def page(self, space: str, cursor: str | None, size: int) -> tuple[list[dict], str | None]:
        """A cursor is a file and a record in it; a page ends with its file, so that cursors of ``starts`` are met."""
        names = self._files(space)
        at, row = map(int, (cursor or "0,0").split(","))
        if at >= len(names):
            return [], None
        with self.fs.open_input_stream(names[at]) as f:
            lines = f.read().decode().split("\n")
        lines = lines[:-1] if lines[-1] == "" else lines
        take = lines[row : row + size]
        at, row = (at, row + len(take)) if row + len(take) < len(lines) else (at + 1, 0)
        return [json.loads(x) for x in take], f"{at},{row}" if at < len(names) else None


@dataclass
class Space(InputPartition):
    """A space, or its pages from a cursor to another."""

    name: str
    start: str | None = None
    stop: str | None = None


class PagedReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.schema, self.options = schema, dict(options)
        self.by = self.options.get("by", "space")
        self.only: set | None = None

    def client(self):
        name = self.options.get("client")
        if not name:
            return FolderClient(self.options)
        module, kind = name.split(":")
        return getattr(importlib.import_module(module), kind)(self.options)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == (self.by,):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.only = values if self.only is None else self.only & values
            else:
                yield f

    def partitions(self) -> list[Space]:
        client = self.client()
        names = [s for s in client.spaces() if self.only is None or s in self.only and s != NULL_SPACE]
        if "max_items" in self.options or not hasattr(client, "starts"):
            return [Space(s) for s in names]
        return [Space(s, a, b) for s in names for starts in [client.starts(s)] for a, b in zip(starts, [*starts[1:], None], strict=True)]

    def read(self, partition: Space) -> Iterator[tuple]:
        client, size = self.client(), int(self.options.get("page_size", 50))
        left = int(self.options["max_items"]) if "max_items" in self.options else None
        space, cursor, names = None if partition.name == NULL_SPACE else partition.name, partition.start, [f.name for f in self.schema.fields]
        while left is None or left > 0:
            records, cursor = client.page(partition.name, cursor, size if left is None else min(size, left))
            for r in records:
                yield tuple(space if n == self.by else r.get(n) for n in names)
            left = None if left is None else left - len(records)
            if cursor is None or cursor == partition.stop:
                return


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "kelpie_paged"

    def reader(self, schema: StructType) -> PagedReader:
        return PagedReader(schema, self.options)


def land(rows: DataFrame, by: str, path: str, per_file: int = 1_000) -> None:
    """Write rows as JSON lines, a folder for each value of ``by``, files of ``per_file`` records."""
    rows.withColumn("space", F.col(by)).drop(*({by} - {"space"})).write.mode("overwrite").option("maxRecordsPerFile", per_file).partitionBy("space").json(path)


def paged(spark: SparkSession, schema: str, path: str, **options: str | int) -> DataFrame:
    """The records under ``path``; ``schema`` has the space column (``space``, or as the option ``by`` says)."""
    spark.dataSource.register(PagedSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("kelpie_paged").schema(schema).options(path=path, **{k: str(v) for k, v in options.items()}).load()
