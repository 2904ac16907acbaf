"""Queries of the indexes, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from kelpie.operators import text_index, vector_index, vectors
from kelpie.queries import _DOT, _t, query
from kelpie.sources import sinks

# ---- vectors ----------------------------------------------------------------------------------------------------


def _top(where: str) -> str:
    return f"""s AS (SELECT q.vec_id AS query_id, e.vec_id, {_DOT} AS score FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE q.vec_id % 20 = 0 AND {where}),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM s)"""


def _index(spark, sf_dir):
    rows = _t(spark, sf_dir, "embeddings")
    return vector_index.build(rows, sinks.scratch(spark, "index"), keep=["label"]), rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


@query(f"WITH {_top('e.label <> 3')} SELECT query_id, vec_id, round(score, 6) AS score, rank, CASE WHEN score > 0.7 THEN 'high' WHEN score > 0.5 THEN 'medium' ELSE 'low' END AS relevance FROM t WHERE rank <= 10 AND round(score, 9) >= 0.2")
def e7_index_search(spark, sf_dir):
    """Filtered search of the lists near each query, then of those that could still hold a better row."""
    index, asked = _index(spark, sf_dir)
    found = vector_index.search(index, asked, 10, probes=8, where=F.col("label") != 3, at_least=0.2, exact=True)
    return found.select("query_id", "vec_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"), vectors.relevance(F.col("score")).alias("relevance"))


@query(f"WITH {_top('true')} SELECT query_id, vec_id, round(score, 6) AS score, rank FROM t WHERE rank <= 10")
def e7_quantized_search(spark, sf_dir):
    """All rows by their codes, then what could be among the best by its vector."""
    index, asked = _index(spark, sf_dir)
    return vector_index.search(index, asked, 10, probes=0).select("query_id", "vec_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


# ---- texts ------------------------------------------------------------------------------------------------------


@query("SELECT q.item_id AS needle_id, d.doc_id FROM benchmark q JOIN documents d ON contains(lower(d.text), lower(substr(q.text, 11, 24)))")
def q25_substring_index(spark, sf_dir):
    """A stretch of every benchmark item, looked up in all documents."""
    index = text_index.build(_t(spark, sf_dir, "documents"), sinks.scratch(spark, "texts"), "doc_id", "text")
    needles = _t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("needle_id"), F.substring("text", 11, 24).alias("needle"))
    return text_index.search(index, needles, "needle_id", "needle", "doc_id")
