"""Exact vector retrieval: filter first, score in blocks, keep the best k of each partition, then of each query."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Query vectors multiplied at once; more are taken in blocks of this many.
BLOCK = 4_096
#: Of these, so many are compared with a batch of rows at a time.
TILE = 64


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalized(a: Column) -> Column:
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: (x / n).cast("float"))).otherwise(a)


def cosine(a: Column, b: Column) -> Column:
    """0 where either norm is zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def relevance(score: Column, high: float = 0.7, medium: float = 0.5) -> Column:
    return F.when(score > high, "high").when(score > medium, "medium").otherwise("low")


def dimension(rows: DataFrame, vector: str = "embedding", default: int = 768) -> DataFrame:
    """One row: the length of a vector, or the default."""
    return rows.agg(F.coalesce(F.max(F.when(F.size(vector) > 0, F.size(vector))), F.lit(default)).alias("dimension"))


def search(rows: DataFrame, query: list[float], k: int = 10, vector: str = "embedding", at_least: float | None = None, where: Column | None = None) -> DataFrame:
    """The k rows nearest to one query vector (dot product), with score and rank; filters apply before."""
    hits = rows.where(F.size(vector) > 0)
    hits = hits.where(where) if where is not None else hits
    hits = hits.withColumn("score", dot(F.col(vector), F.array(*[F.lit(float(x)) for x in query])))
    hits = hits.where(F.col("score") >= at_least) if at_least is not None else hits
    tie = [c for c in rows.columns if c != vector][:1]
    best = hits.orderBy(F.desc("score"), *tie).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), *tie)))  # k rows


def first_of_ties(i: np.ndarray, j: np.ndarray, score: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    """Which pairs (query i, row j) of equal score are the first k of their query by ``place`` of the row."""
    order = np.lexsort((place[j], score, i))
    new = np.ones(len(order), bool)
    new[1:] = (i[order][1:] != i[order][:-1]) | (score[order][1:] != score[order][:-1])
    start = np.flatnonzero(new)
    return order[np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order)))) < k]


def search_many(rows: DataFrame, queries: DataFrame, k: int, id: str = "vec_id", vector: str = "embedding", query_id: str = "query_id", exclude_self: bool = True) -> DataFrame:
    """(query_id, id, score, rank) of the k nearest rows for each query: exact.

    The queries are a stated set, taken in blocks of bounded size; each block is multiplied with every batch of
    rows, and each batch hands on k rows a query, so what is shuffled is bounded by batches, not by rows. A
    vector that is null, empty or has a null finds nothing and is not found; other lengths than the queries' are an error."""
    spark = rows.sparkSession
    there = (F.size(vector) > 0) & ~F.exists(vector, lambda x: x.isNull())
    queries = queries.where(there)
    n = queries.count()
    blocks = [queries.where(F.pmod(F.xxhash64(query_id), F.lit(-(-n // BLOCK))) == i) for i in range(-(-n // BLOCK))] if n > BLOCK else [queries]
    schema = f"{query_id} {queries.schema[query_id].dataType.simpleString()}, {id} {rows.schema[id].dataType.simpleString()}, score double"
    out = spark.createDataFrame([], schema)
    for block in blocks:
        held = block.select(query_id, vector).toArrow()
        ids = held[query_id].to_pylist()
        if not ids:
            continue
        q = np.array(held[vector].to_pylist(), np.float64)

        def near(batches: Iterator[pa.RecordBatch], q=q, ids=ids) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                keys = b.column(0)
                sizes = set(np.diff(b.column(1).offsets.to_numpy()).tolist()) | {q.shape[1]}
                if len(sizes) > 1:
                    raise ValueError(f"vectors of lengths {sorted(sizes)}")
                m = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)
                by_id = None
                place = {x: i for i, x in enumerate(keys.to_pylist())} if exclude_self else {}
                for at in range(0, len(ids), TILE):
                    s = q[at : at + TILE] @ m.T
                    for i, x in enumerate(ids[at : at + TILE]):
                        if x in place:
                            s[i, place[x]] = -np.inf
                    top = min(k, s.shape[1])
                    # rounded as ranked below, ties kept by id: take all that reach the k-th score
                    kth = np.partition(s, s.shape[1] - top, axis=1)[:, s.shape[1] - top]
                    i, j = np.nonzero((s >= kth[:, None] - 1e-9) & np.isfinite(s))
                    if len(i) > 2 * top * len(s):  # copies of a vector: of each score the first k ids are enough
                        if by_id is None:
                            by_id = np.empty(len(keys), np.int64)
                            by_id[pc.sort_indices(keys, null_placement="at_start").to_numpy()] = np.arange(len(keys))
                        first = first_of_ties(i, j, s[i, j], by_id, top)
                        i, j = i[first], j[first]
                    yield pa.RecordBatch.from_arrays([pa.array([ids[at + x] for x in i.tolist()], held.schema.field(0).type), keys.take(pa.array(j)), pa.array(s[i, j])], [query_id, id, "score"])

        out = out.unionByName(rows.where(there).select(id, vector).mapInArrow(near, schema))
    w = Window.partitionBy(query_id).orderBy(F.desc(F.round("score", 9)), id)
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def quantized(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """int8 codes and their scale in place of a float vector: a quarter of the bytes."""
    top = F.array_max(F.transform(vector, F.abs))
    return rows.withColumn("scale", F.when(top > 0, top / 127).otherwise(F.lit(1.0))).withColumn("codes", F.transform(vector, lambda x: F.round(x / F.col("scale")).cast("tinyint"))).drop(vector)


def missing(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows that still need a vector."""
    return rows.where(F.col(vector).isNull() | (F.size(vector) == 0))


def coverage(rows: DataFrame, by: str, vector: str = "embedding") -> DataFrame:
    return rows.groupBy(by).agg(F.count("*").alias("total"), F.count_if(F.size(vector) > 0).alias("embedded")).withColumn("share", F.round(F.col("embedded") / F.col("total"), 4))


def hash_embed(text: Column, size: int = 64) -> Column:
    """A deterministic stand-in for an embedding model: signed counts of hashed words, unit length."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\W+"), lambda w: w != "")
    slots = F.transform(words, lambda w: F.struct(F.pmod(F.xxhash64(w), F.lit(size)).cast("int").alias("slot"), F.when(F.pmod(F.hash(w), F.lit(2)) == 0, 1.0).otherwise(-1.0).alias("sign")))
    raw = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.aggregate(F.filter(slots, lambda s: s["slot"] == i), F.lit(0.0), lambda a, s: a + s["sign"]))
    return normalized(raw)


def search_enriched(chunks: DataFrame, query: list[float], tickets: DataFrame, pages: DataFrame, k: int = 40, source: str | None = None, project: str | None = None) -> DataFrame:
    """The k nearest chunks under filters, with the facts of their ticket or page where there is one."""
    where = F.lit(True)
    where = where & (F.col("source") == source) if source else where
    where = where & F.contains(F.lower("project_name"), F.lit(project.lower())) if project else where
    hits = search(chunks, query, k, where=where)
    facts = tickets.select("issue_key", "priority", "assignee", F.col("status").alias("ticket_status"))
    return hits.join(facts, "issue_key", "left").join(pages.select("page_id", "breadcrumb"), "page_id", "left")
