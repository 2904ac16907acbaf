"""Retrieval composed of vector hits, named tickets and graph neighbours, for many queries at once.

Tables: queries(query_id, query); hits(query_id, chunk_id, score, ...), the vector hits of each query; chunks(chunk_id,
parent_document_id, chunk_index, text, title, source, ...); tickets(issue_key, ...); edges as ``graph.edges`` makes them.
Everything is an equi-join or a window by query or ticket; limits by rank are taken before anything is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpie.functions.text import issue_key_of, keyword_score, page_id_of, text_or_empty
from kelpie.operators import graph

# ---- Fixed values ---------------------------------------------------------------------------------------------

#: Relations between tickets that retrieval follows.
RELATIONS = [
    "BLOCKS", "BLOCKED_BY", "RELATES_TO", "DUPLICATES", "DUPLICATED_BY", "CHILD_OF", "IS_TESTED_BY", "TESTS", "CAUSES", "CAUSED_BY", "CLONES", "CLONED_BY", "IS_AUTOMATED_BY", "AUTOMATES", "SPLIT_FROM",
    "SPLIT_TO", "IMPLEMENTS", "IMPLEMENTED_BY", "REVIEWED_BY",
]
#: A ticket key as questions name it.
NAMED_KEY = r"\b([A-Z][A-Z0-9]+-\d+)\b"
GRAPH_SCORE = 0.6

# ---------------------------------------------------------------------------------------------------------------


def _first(rows: DataFrame, by: list[str], order: list[str | Column], n: int) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= n)


def _between(edges: DataFrame, kind: str, rels: list[str]) -> DataFrame:
    return edges.where((F.col("src_type") == kind) & (F.col("dst_type") == kind) & F.col("rel").isin(rels))


def direct_hits(queries: DataFrame, tickets: DataFrame, chunks: DataFrame, edges: DataFrame, texts: int = 2, links: int = 5) -> DataFrame:
    """The tickets that a question names, one row for each of their first ``texts`` different texts, with up to ``links``
    outgoing relations and score 1. A key named twice gives its rows twice; an unknown one, or one without chunks, none."""
    named = queries.select("query_id", F.posexplode(F.regexp_extract_all("query", F.lit(NAMED_KEY), F.lit(1))).alias("nth", "issue_key"))
    keys = named.select("issue_key").distinct()
    own = chunks.select(issue_key_of(F.col("parent_document_id")).alias("issue_key"), "text", "chunk_index", "chunk_id").where("text is not null").join(keys, "issue_key", "left_semi")
    once = own.groupBy("issue_key", "text").agg(F.min(F.struct("chunk_index", "chunk_id")).alias("at"))
    first = _first(once, ["issue_key"], ["at", "text"], texts).select("issue_key", "text", F.col("_n").alias("part"))
    out = _between(edges, "ticket", [r for r in RELATIONS if r != "CHILD_OF"]).select(F.col("src").alias("issue_key"), "rel", F.col("dst").alias("target")).distinct().join(keys, "issue_key", "left_semi")
    linked = _first(out, ["issue_key"], ["rel", "target"], links).groupBy("issue_key").agg(F.array_sort(F.collect_list(F.struct("rel", "target"))).alias("linked"))
    return named.join(tickets, "issue_key").join(first, "issue_key").join(linked, "issue_key", "left").select(
        "query_id", "nth", "part", F.concat(F.lit("direct_"), F.col("issue_key")).alias("chunk_id"), "text", "title", F.lit("jira").alias("source"), F.lit(1.0).alias("score"), "issue_key", "linked")


def _near(seeds: DataFrame, edges: DataFrame, owned: DataFrame, hops: int, most: int) -> DataFrame:
    """Nearest ``most`` nodes with chunks around the seeds(query_id, seed) of each query, each by its first chunk."""
    near = graph.expand(edges, seeds.select(F.col("seed").alias("key")), hops)
    best = seeds.join(near, "seed").groupBy("query_id", "neighbor").agg(F.min(F.struct("distance", "rel")).alias("at"))
    with_chunk = best.join(owned.select(F.col("owner").alias("neighbor")).distinct(), "neighbor", "left_semi")
    chosen = _first(with_chunk, ["query_id"], ["at.distance", "neighbor"], most).select("query_id", "neighbor", "at.distance", "at.rel")
    first = _first(owned.join(chosen.select(F.col("neighbor").alias("owner")).distinct(), "owner", "left_semi"), ["owner"], ["chunk_index", "chunk_id"], 1).drop("_n", "chunk_index")
    return chosen.join(first.withColumnRenamed("owner", "neighbor"), "neighbor").select("query_id", "chunk_id", "text", "title", "source", F.lit(GRAPH_SCORE).alias("score"), "neighbor", F.col("rel").alias("relationship"), F.col("distance").alias("graph_distance"))


def retrieve(queries: DataFrame, hits: DataFrame, tickets: DataFrame, chunks: DataFrame, edges: DataFrame, hops: int = 2, most: int = 20) -> DataFrame:
    """Named tickets, then vector hits, then up to ``most`` neighbours of the hits' tickets and as many of their pages; no
    re-ranking and no cut. A neighbour's chunk that an earlier part has is left out. Adds from_direct, from_graph and
    position."""
    body = ["chunk_id", "text", "title", "source"]
    owned = lambda owner: chunks.select(owner(F.col("parent_document_id")).alias("owner"), "chunk_index", *body).where("owner <> ''")
    seeds = lambda owner: hits.select("query_id", owner(F.col("parent_document_id")).alias("seed")).where("seed <> ''").distinct()
    direct = direct_hits(queries, tickets, chunks, edges).withColumn("_part", F.lit(0)).withColumn("_at", F.col("nth") * 1000 + F.col("part")).drop("nth", "part")
    found = hits.select("query_id", *body, "score", issue_key_of(F.col("parent_document_id")).alias("issue_key")).withColumn("_part", F.lit(1)).withColumn("_at", F.lit(0))
    near = _near(seeds(issue_key_of), _between(edges, "ticket", RELATIONS), owned(issue_key_of), hops, most).withColumnRenamed("neighbor", "issue_key").withColumn("_part", F.lit(2))
    pages = _near(seeds(page_id_of), _between(edges, "page", ["CHILD_OF"]), owned(page_id_of), hops, most).drop("neighbor", "relationship").withColumn("_part", F.lit(3))
    fresh = near.unionByName(pages, allowMissingColumns=True).withColumn("_at", F.col("graph_distance"))
    fresh = _first(fresh, ["query_id", "chunk_id"], ["_part", "_at"], 1).drop("_n").join(hits.select("query_id", "chunk_id").distinct(), ["query_id", "chunk_id"], "left_anti")
    every = direct.unionByName(found, allowMissingColumns=True).unionByName(fresh, allowMissingColumns=True)
    order = Window.partitionBy("query_id").orderBy("_part", "_at", F.desc("score"), "chunk_id")
    return every.withColumn("position", F.row_number().over(order)).withColumn("from_direct", F.col("_part") == 0).withColumn("from_graph", F.col("_part") >= 2).drop("_part", "_at")


def directed_hop(seeds: DataFrame, tickets: DataFrame, chunks: DataFrame, edges: DataFrame, most: int = 60) -> DataFrame:
    """Chunks of tickets that the seeds(query_id, issue_key) of a query point at: ``most`` rows a query, in which a ticket
    without chunks takes one and is then dropped; all score alike."""
    step = _between(edges, "ticket", RELATIONS).select(F.col("src").alias("issue_key"), F.col("rel").alias("relationship"), F.col("dst").alias("related"))
    owned = chunks.select(issue_key_of(F.col("parent_document_id")).alias("related"), "chunk_id", "text")
    known = tickets.select(F.col("issue_key").alias("related"), "title")
    rows = seeds.join(step, "issue_key").join(known, "related").join(owned, "related", "left")
    kept = _first(rows, ["query_id"], ["issue_key", "relationship", "related", "chunk_id"], most).where("chunk_id is not null")
    return kept.select("query_id", F.col("related").alias("issue_key"), "title", "relationship", "text", "chunk_id", F.lit(GRAPH_SCORE).alias("score"))


def flat_hybrid(queries: DataFrame, hits: DataFrame, tickets: DataFrame, chunks: DataFrame, edges: DataFrame, k: int = 10) -> DataFrame:
    """The best k of vector hits and directed neighbours by 0.7 of the score and 0.3 of the query's words contained in
    text and title. A neighbour that is a vector hit too keeps both rows; from_graph says that no vector hit has the chunk."""
    seeds = hits.select("query_id", issue_key_of(F.col("parent_document_id")).alias("issue_key")).where("issue_key <> ''").distinct()
    found = hits.select("query_id", "chunk_id", "text", "title", "score").withColumn("_g", F.lit(False))
    near = directed_hop(seeds, tickets, chunks, edges).join(hits.select("query_id", "chunk_id", F.lit(True).alias("_hit")).distinct(), ["query_id", "chunk_id"], "left")
    every = found.withColumn("from_graph", F.lit(False)).unionByName(near.withColumn("_g", F.lit(True)).withColumn("from_graph", F.col("_hit").isNull()).drop("_hit"), allowMissingColumns=True)
    words = F.array_distinct(F.filter(F.split(F.lower(text_or_empty(F.col("query"))), r"\s+"), lambda w: w != ""))
    blended = every.join(queries.select("query_id", words.alias("_words")), "query_id").withColumn("rerank_score", 0.7 * F.coalesce("score", F.lit(0.0)) + 0.3 * keyword_score(F.col("_words"), F.col("text"), F.col("title")))
    return _first(blended, ["query_id"], [F.desc("rerank_score"), "_g", F.desc("score"), "chunk_id", "relationship"], k).withColumnRenamed("_n", "rank").drop("_g", "_words")


def normalized(hits: DataFrame) -> DataFrame:
    """Hits of any of these forms with one set of columns and defaults; an absent column counts as null, and a score of
    0 as none."""
    col = lambda name, type: F.col(name).cast(type) if name in hits.columns else F.lit(None).cast(type)

    def text(*names: str, default: str = "") -> Column:
        return F.coalesce(*(F.nullif(col(n, "string"), F.lit("")) for n in names), F.lit(default))

    number = lambda *names: F.coalesce(*(F.nullif(col(n, "double"), F.lit(0.0)) for n in names), F.lit(0.0))
    flag = lambda name: F.coalesce(col(name, "boolean"), F.lit(False)).alias(name)
    keys = [c for c in ("query_id", "chunk_id") if c in hits.columns]
    return hits.select(
        *keys, text("text").alias("text"), number("score").alias("score"), number("rerank_score", "score").alias("rerank_score"), text("source").alias("source"), text("source_type").alias("source_type"),
        text("title").alias("title"), text("url", default="N/A").alias("url"), text("project_name", "project", default="N/A").alias("project"), text("status", "ticket_status").alias("status"), text("priority").alias("priority"),
        text("assignee").alias("assignee"), text("issue_key").alias("issue_key"), flag("from_graph"), flag("from_direct"), text("relationship").alias("relationship"), col("graph_distance", "long").alias("graph_distance"))


def hit_counts(hits: DataFrame) -> DataFrame:
    """Per query: how many hits came by name, by vector and by graph."""
    return hits.groupBy("query_id").agg(F.count_if("from_direct").alias("n_direct"), F.count_if(~F.col("from_direct") & ~F.col("from_graph")).alias("n_vector"), F.count_if("from_graph").alias("n_graph"))
