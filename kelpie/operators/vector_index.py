"""A vector index in tables: inverted lists under learned centres, searched by int8 codes, scored exactly.

``build`` learns centres from a bounded sample, gives every row to its nearest centre and writes two tables that are
partitioned by list: int8 codes with the error that coding made, and the vectors. Columns to filter by go with the codes.

``search`` takes the lists nearest to each query (a scan prunes the others away), applies filters inside the lists, and
compares blocks of codes with blocks of queries of the same list by a matrix product. Since a code is off by a known
length, each score has a lower and an upper bound, and every row whose upper bound reaches the k-th best lower bound is
read again and scored exactly: coding never changes a result. What is missed is only what lies in lists that were not
probed. ``exact=True`` then also probes the lists that could still hold a better row, by the bound q.c + |q| * radius;
``probes=0`` probes all. Both are exact.

Rows and queries meet as blocks, never as pairs of rows; a list that a large share of rows has is many blocks, dealt
over files when it is written.

Defined cases: null and empty vectors are in no list and are never found; as a query they find nothing; a vector with a
null has no place either; vectors must have one length otherwise (an error says so); repeated ids are rows of their own
and come once each; equal scores (to nine digits) are ranked by id; an empty table gives an index without lists.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kelpie.operators.vectors import dot
from kelpie.sources.sinks import staged

#: Rows that centres are learned from, at most.
SAMPLE = 20_000
MOST_LISTS = 4_096
#: Rows and queries of a block.
ROWS, QUERIES = 2_048, 512
#: Pairs of a row and a centre that are held at once, about.
PAIRS = 65_536
#: What rounding of scores to nine digits, and sums in another order, may change.
SLACK = 1e-8


@dataclass
class Index:
    """Paths of the tables; centres (list by row), radii and sizes of the lists."""

    path: str
    centres: np.ndarray
    radii: np.ndarray
    sizes: np.ndarray

    def codes(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/codes")

    def vectors(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/vectors")


def whole(vector: str) -> Column:
    """The vector is there, not empty and has no null."""
    return (F.size(vector) > 0) & ~F.exists(vector, lambda x: x.isNull())


def _matrix(col: pa.Array) -> np.ndarray:
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = set(pc.list_value_length(col).to_pylist())
    if len(sizes) > 1:
        raise ValueError(f"vectors of lengths {sorted(sizes)[:5]} in one table")
    return flat.reshape(len(col), -1)


def _nearest(m: np.ndarray, centres: np.ndarray) -> np.ndarray:
    length = (centres * centres).sum(axis=1)
    return np.concatenate([(2 * m[x] @ centres.T - length).argmax(axis=1) for x in _slices(len(m), len(centres))])


def _slices(rows: int, lists: int) -> Iterator[slice]:
    """Runs of rows with ``PAIRS`` pairs with the lists at most, or a row each: memory follows neither batches nor lists."""
    step = max(1, PAIRS // max(1, lists))
    for lo in range(0, rows, step):
        yield slice(lo, min(rows, lo + step))


def _asked(b: pa.RecordBatch, lists: int, take) -> Iterator[pa.RecordBatch]:
    """What ``take`` of each run of rows gives: rows of the run (by number) and lists, as columns of the id, the vector, the list."""
    for x in _slices(b.num_rows, lists):
        run = b.slice(x.start, x.stop - x.start)
        at, which = take(run)
        yield pa.RecordBatch.from_arrays([run.column(0).take(pa.array(at)), run.column(1).take(pa.array(at)), pa.array(which.astype(np.int32))], [b.schema.names[0], "q", "list"])


def learned(sample: np.ndarray, lists: int, rounds: int = 10) -> np.ndarray:
    """Centres by k-means, from rows spread evenly over the sample; a centre that loses all its rows stays."""
    centres = sample[np.linspace(0, len(sample) - 1, lists).astype(int)].copy()
    for _ in range(rounds):
        own = _nearest(sample, centres)
        sums, n = np.zeros_like(centres), np.bincount(own, minlength=lists)
        np.add.at(sums, own, sample)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def _list_column(b: pa.RecordBatch, name: str) -> pa.Array:
    return b.column(b.schema.get_field_index(name))


def build(rows: DataFrame, path: str, id: str = "vec_id", vector: str = "embedding", keep: Sequence[str] = (), lists: int | None = None) -> Index:
    """Write the index of ``rows`` under ``path``; ``lists``: about the root of the number of rows by default."""
    have = rows.where(whole(vector)).select(id, vector, *keep)
    n = have.count()
    if not n:
        return Index(path, np.zeros((0, 0)), np.zeros(0), np.zeros(0, np.int64))
    lists = min(MOST_LISTS, lists or max(1, round(n**0.5)))
    held = have.select(F.xxhash64(id).alias("_h"), vector).orderBy("_h").limit(SAMPLE).select(vector).toArrow()
    sample = _matrix(pa.concat_arrays(held[vector].chunks))
    lists = min(lists, len(sample))
    centres = learned(sample, lists)

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            m = _matrix(_list_column(b, vector))
            if m.shape[1] != centres.shape[1]:
                raise ValueError(f"vectors of lengths {sorted({m.shape[1], centres.shape[1]})} in one table")
            own = _nearest(m, centres)
            scale = np.maximum(np.abs(m).max(axis=1), 1e-30) / 127
            codes = np.rint(m / scale[:, None]).astype(np.int8)
            error = np.linalg.norm(m - codes * scale[:, None], axis=1) * (1 + 1e-9)
            packed = pa.Array.from_buffers(pa.binary(), len(m), [None, pa.py_buffer((np.arange(len(m) + 1) * m.shape[1]).astype(np.int32)), pa.py_buffer(codes.tobytes())])
            more = [pa.array(own.astype(np.int32)), packed, pa.array(scale), pa.array(error), pa.array(np.linalg.norm(m - centres[own], axis=1))]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], [*b.schema.names, "list", "codes", "scale", "error", "distance"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in have.schema.fields)
    placed = staged(have.mapInArrow(assigned, f"{fields}, list int, codes binary, scale double, error double, distance double"), "placed")
    spread = placed.repartitionByRange("list", F.xxhash64(id))  # a large list is cut as well
    spread.select(id, *keep, "codes", "scale", "error", "list").write.mode("overwrite").partitionBy("list").parquet(f"{path}/codes")
    spread.select(id, vector, "list").write.mode("overwrite").partitionBy("list").parquet(f"{path}/vectors")
    radii, sizes = np.zeros(lists), np.zeros(lists, np.int64)
    for r in placed.groupBy("list").agg(F.max("distance").alias("radius"), F.count("*").alias("n")).collect():  # a row a list
        radii[r["list"]], sizes[r["list"]] = r["radius"] * (1 + 1e-9), r["n"]
    return Index(path, centres, radii, sizes)


def probed(index: Index, queries: DataFrame, probes: int, query_id: str, vector: str) -> DataFrame:
    """query_id, q (its vector) and list: the ``probes`` lists (0: all) whose centres have the largest dot products."""
    centres, kind = index.centres, queries.schema[query_id].dataType.simpleString()

    def best(run: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        near = np.argsort(-(_matrix(_list_column(run, vector)) @ centres.T), axis=1, kind="stable")[:, : probes or None]
        return np.repeat(np.arange(run.num_rows), near.shape[1]), near.ravel()

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from _asked(b, len(centres), best)

    return queries.where(whole(vector)).select(query_id, vector).mapInArrow(take, f"`{query_id}` {kind}, q {queries.schema[vector].dataType.simpleString()}, list int")


def _beyond(index: Index, queries: DataFrame, found: DataFrame, done: DataFrame, k: int, query_id: str, vector: str) -> DataFrame:
    """As ``probed``: the lists not in ``done`` that could hold a row better than the k-th of ``found``."""
    centres, radii, sizes = index.centres, index.radii, index.sizes
    kth = found.where(F.col("rank") == k).select(query_id, F.col("score").alias("kth"))
    asked = queries.where(whole(vector)).select(query_id, vector).join(kth, query_id, "left").select(query_id, vector, F.coalesce("kth", F.lit(float("-inf"))).alias("kth"))

    def beyond(run: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        m = _matrix(_list_column(run, vector))
        most = m @ centres.T + np.linalg.norm(m, axis=1)[:, None] * radii
        return np.nonzero((most >= _list_column(run, "kth").to_numpy()[:, None] - SLACK) & (sizes > 0))

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from _asked(b, len(centres), beyond)

    return asked.mapInArrow(take, done.schema).join(done.select(query_id, "list"), [query_id, "list"], "left_anti").select(query_id, "q", "list")


def _blocks(batches: Iterator[pa.RecordBatch], size: int, names: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """Rows of one list as rows of lists, ``size`` at most: list, then each of ``names`` as an array."""
    for b in batches:
        which = _list_column(b, "list").to_numpy()
        order = np.argsort(which, kind="stable")
        start = np.concatenate([[0], 1 + np.flatnonzero(np.diff(which[order]))]) if len(order) else np.zeros(0, np.int64)
        ends = np.append(start[1:], len(order))
        cuts = np.array([c for s, e in zip(start, ends, strict=True) for c in range(s, e, size)], np.int64)
        if len(cuts):
            sorted_ = b.take(pa.array(order))
            offsets = pa.array(np.append(cuts, len(order)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(which[order][cuts]), *[pa.ListArray.from_arrays(offsets, _list_column(sorted_, c)) for c in names]], ["list", *names])


def candidates(index: Index, asked: DataFrame, k: int, id: str, query_id: str, where: Column | None) -> DataFrame:
    """query_id, list and id of every row of the probed lists whose score could be among the k best of them."""
    spark = asked.sparkSession
    asked = staged(asked, "asked")
    lists = [r["list"] for r in asked.select("list").distinct().collect()]  # MOST_LISTS at most
    codes = index.codes(spark).where(F.col("list").isin(lists))
    codes = codes.where(where) if where is not None else codes
    types = {id: codes.schema[id].dataType.simpleString(), query_id: asked.schema[query_id].dataType.simpleString(), "q": asked.schema["q"].dataType.simpleString()}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _blocks(batches, ROWS, (id, "codes", "scale", "error"))

    def questions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _blocks(batches, QUERIES, (query_id, "q"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                ids, qids = _list_column(b, id)[i].values, _list_column(b, query_id)[i].values
                q = _matrix(_list_column(b, "q")[i].values)
                coded = np.frombuffer(b"".join(_list_column(b, "codes")[i].values.to_pylist()), np.int8).reshape(len(ids), -1)
                scale, error = (_list_column(b, c)[i].values.to_numpy() for c in ("scale", "error"))
                about = (q @ coded.T.astype(np.float64)) * scale
                off = np.linalg.norm(q, axis=1)[:, None] * error + SLACK
                least = about - off
                kth = np.partition(least, -k, axis=1)[:, -k] if k < len(ids) else np.full(len(q), -np.inf)
                x, y = np.nonzero(about + off >= kth[:, None])
                yield pa.RecordBatch.from_arrays([qids.take(pa.array(x)), ids.take(pa.array(y)), pa.array(np.full(len(x), _list_column(b, "list")[i].as_py(), np.int32)), pa.array(least[x, y]), pa.array((about + off)[x, y])], [query_id, id, "list", "least", "most"])

    row_blocks = codes.select("list", id, "codes", "scale", "error").mapInArrow(rows, f"list int, `{id}` array<{types[id]}>, codes array<binary>, scale array<double>, error array<double>")
    query_blocks = asked.repartition("list").mapInArrow(questions, f"list int, `{query_id}` array<{types[query_id]}>, q array<{types['q']}>")
    found = row_blocks.join(query_blocks, "list").mapInArrow(compare, f"`{query_id}` {types[query_id]}, `{id}` {types[id]}, list int, least double, most double")
    w = Window.partitionBy(query_id).orderBy(F.desc("least")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return found.withColumn("kth", F.nth_value("least", k).over(w)).where(F.col("kth").isNull() | (F.col("most") >= F.col("kth"))).select(query_id, "list", id)


def search(index: Index, queries: DataFrame, k: int, probes: int | None = None, where: Column | None = None, at_least: float | None = None, exact: bool = False,
           id: str = "vec_id", vector: str = "embedding", query_id: str = "query_id", exclude_self: bool = True) -> DataFrame:
    """(query_id, id, score, rank) of the k rows of largest dot product that the probed lists hold, of those that ``where``
    (on kept columns) lets through. ``probes``: lists per query, three quarters by default, 0 for all."""
    spark = queries.sparkSession
    schema = f"`{query_id}` {queries.schema[query_id].dataType.simpleString()}, `{id}` {index.vectors(spark).schema[id].dataType.simpleString() if len(index.sizes) else 'long'}, score double, rank int"
    if not len(index.sizes):
        return spark.createDataFrame([], schema)
    probes = -(-3 * len(index.sizes) // 4) if probes is None else probes
    more = k + 1 if exclude_self else k
    order = Window.partitionBy(query_id).orderBy(F.desc(F.round("score", 9)), id)

    def scored(asked: DataFrame) -> DataFrame:
        kept = staged(candidates(index, asked, more, id, query_id, where), "candidates")
        lists = [r["list"] for r in kept.select("list").distinct().collect()]
        again = index.vectors(spark).where(F.col("list").isin(lists)).select(F.col(id), "list", F.col(vector).alias("_x"))
        hits = kept.distinct().join(again, ["list", id]).join(queries.select(query_id, F.col(vector).alias("_q")), query_id)
        hits = hits.where(F.col(id) != F.col(query_id)) if exclude_self else hits
        return hits.select(query_id, id, dot(F.col("_q"), F.col("_x")).alias("score"))

    first = probed(index, queries, probes, query_id, vector)
    found = scored(first)
    if exact and 0 < probes < len(index.sizes):
        first, found = staged(first, "first"), staged(found, "found")
        ranked = found.withColumn("rank", F.row_number().over(order))
        found = found.unionByName(scored(_beyond(index, queries, ranked, first, k, query_id, vector)))
    found = found.where(F.round("score", 9) >= at_least) if at_least is not None else found
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def reread(index: Index, queries: DataFrame, k: int, id: str = "vec_id", vector: str = "embedding", query_id: str = "query_id") -> DataFrame:
    """One row: pairs of query and row that the codes were compared for, and those that had to be read again."""
    kept = candidates(index, probed(index, queries, 0, query_id, vector), k, id, query_id, None)
    return kept.agg(F.count("*").alias("reread")).select(F.lit(int(index.sizes.sum()) * queries.where(whole(vector)).count()).alias("compared"), "reread")
