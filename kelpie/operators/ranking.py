"""Hybrid ranking: vector candidates, graph neighbours, diversity cap, re-ranking and quota, all as one plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpie.functions.text import text_or_empty

POOL, CANDIDATES, PARENT_CAP, DECAY = 50, 40, 3, 0.85


def graph_prior(distance: Column, decay: float = DECAY) -> Column:
    return F.round(F.lit(0.6) * F.pow(F.lit(decay), distance - 1), 4)


def parent_key() -> Column:
    part = lambda c: F.nullif(F.col(c).cast("string"), F.lit(""))
    return F.coalesce(part("issue_key"), part("page_id"), part("parent_document_id"), part("chunk_id"))


def passage(title: Column, text: Column, chars: int = 800) -> Column:
    head = F.trim(text_or_empty(title))
    body = F.substring(text_or_empty(text), 1, chars)
    return F.when(head != "", F.concat(head, F.lit("\n"), body)).otherwise(body)


def merge(vector_hits: DataFrame, graph_hits: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Vector hits in their order, then graph hits that are not among them; adds from_graph and position."""
    by = by or []
    v = vector_hits.withColumn("from_graph", F.lit(False))
    g = graph_hits.join(vector_hits.select(*by, "chunk_id").distinct(), [*by, "chunk_id"], "left_anti").withColumn("from_graph", F.lit(True))
    order = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    return v.unionByName(g, allowMissingColumns=True).withColumn("position", F.row_number().over(order.orderBy("from_graph", F.desc("score"), "chunk_id")))


def diversify(hits: DataFrame, by: list[str] | None = None, cap: int = PARENT_CAP) -> DataFrame:
    """Each chunk once, and at most ``cap`` chunks of one parent, by position."""
    by = by or []
    once = hits.withColumn("_c", F.row_number().over(Window.partitionBy(*by, "chunk_id").orderBy("position"))).where("_c = 1")
    return once.withColumn("_p", F.row_number().over(Window.partitionBy(*by, "parent").orderBy("position"))).where(F.col("_p") <= cap).drop("_c", "_p")


def rerank(hits: DataFrame, score: Callable[[], Column], by: list[str] | None = None, pool: int = POOL) -> DataFrame:
    """rerank_score from ``score`` for the first ``pool`` hits, a tenth of the prior beyond."""
    by = by or []
    w = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy("position")
    return hits.withColumn("_n", F.row_number().over(w)).withColumn("rerank_score", F.when(F.col("_n") <= pool, score()).otherwise(F.col("score") * 0.10)).drop("_n")


def select_quota(hits: DataFrame, k: int, by: list[str] | None = None, min_slots: int = 0, min_score: float = 0.0) -> DataFrame:
    """The best k by rerank_score, of which max(1, k // 4) places (or ``min_slots``) go to graph hits that reach
    ``min_score``, as far as there are any; score becomes rerank_score, with rank."""
    by = by or []
    quota = min_slots if min_slots > 0 else max(1, k // 4)
    fit = ~F.col("from_graph") | (F.col("rerank_score") >= min_score)
    each = lambda *c: Window.partitionBy(*by, *c) if by or c else Window.partitionBy(F.lit(0))
    ranked = hits.withColumn("_fit", fit).withColumn("_g", F.count_if(F.col("from_graph") & F.col("_fit")).over(each()))
    ranked = ranked.withColumn("_all", F.row_number().over(each().orderBy(F.desc("rerank_score"), "position")))
    ranked = ranked.withColumn("_n", F.row_number().over(each("from_graph", "_fit").orderBy(F.desc("rerank_score"), "position")))
    n_graph = F.least(F.col("_g"), F.lit(quota), F.lit(k))
    mixed = (F.col("from_graph") & F.col("_fit") & (F.col("_n") <= n_graph)) | (~F.col("from_graph") & (F.col("_n") <= F.lit(k) - n_graph))
    chosen = ranked.where(F.when(F.col("_g") > 0, mixed).otherwise(F.col("_all") <= k))
    return chosen.withColumn("rank", F.row_number().over(each().orderBy(F.desc("rerank_score"), "position"))).withColumn("score", F.col("rerank_score")).drop("_fit", "_g", "_all", "_n")


def with_direct(direct: DataFrame, hybrid: DataFrame, k: int) -> DataFrame:
    """Directly named tickets first, then hybrid hits on other tickets and chunks, to max(k, named) rows."""
    rest = hybrid.join(direct.select("issue_key").where("issue_key is not null").distinct(), "issue_key", "left_anti").join(direct.select("chunk_id").distinct(), "chunk_id", "left_anti")
    all_ = direct.withColumn("_d", F.lit(0)).unionByName(rest.withColumn("_d", F.lit(1)), allowMissingColumns=True)
    n = F.count_if(F.col("_d") == 0).over(Window.partitionBy(F.lit(0)))
    return all_.withColumn("_n", n).withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("_d", F.desc("score"), "chunk_id"))).where(F.col("rank") <= F.greatest(F.lit(k), F.col("_n"))).drop("_d", "_n")


def shown(hits: DataFrame, at_least: float = 0.20, most: int = 6) -> DataFrame:
    """For display: one hit per title (else URL), score of 0.20 and more, the best six."""
    name = F.coalesce(F.nullif(F.trim(F.lower(text_or_empty(F.col("title")))), F.lit("")), F.col("url"), F.col("chunk_id").cast("string"))
    once = hits.withColumn("_n", F.row_number().over(Window.partitionBy(name).orderBy(F.desc("score"), "chunk_id"))).where("_n = 1").drop("_n")
    return once.where(F.col("score") >= at_least).orderBy(F.desc("score"), "chunk_id").limit(most)


def weighted_hybrid(semantic: Column, keyword: Column, weight: float = 0.7) -> Column:
    return weight * semantic + (1 - weight) * keyword
