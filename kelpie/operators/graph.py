"""Property graph as tables: nodes(label, key, ...) and edges(src_type, src, rel, dst_type, dst)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpie.functions.text import issue_key_of, link_relation, page_id_of
from kelpie.sources.sinks import staged

#: Steps of a level that one task takes, about, and rows of a table that is sent to all tasks, at most.
LEVEL, SENT = 500_000, 300_000
#: Rows at one node that go on as one, at least, and tasks of a shuffle, at most.
MANY, TASKS = 16, 20_000
EDGE = ["src_type", "src", "rel", "dst_type", "dst"]


def edges(rows: DataFrame, src_type: str, src: str | Column, rel: str | Column, dst_type: str, dst: str | Column) -> DataFrame:
    """Distinct edges from columns of a table; rows without an end give none."""
    rel = F.lit(rel) if isinstance(rel, str) else rel
    s, d = (F.col(x) if isinstance(x, str) else x for x in (src, dst))
    return rows.select(F.lit(src_type).alias("src_type"), s.cast("string").alias("src"), rel.alias("rel"), F.lit(dst_type).alias("dst_type"), d.cast("string").alias("dst")).where("src is not null and dst is not null and src <> '' and dst <> ''").distinct()


def issue_edges(issues: DataFrame) -> DataFrame:
    """Hierarchy, versions, components, labels and typed links of issues(issue_key, parent_key, fix_versions,
    components, labels, issue_links, project_id, assignee)."""
    out = edges(issues, "ticket", "issue_key", "IN_PROJECT", "project", "project_id")
    for e in (
        edges(issues, "ticket", "issue_key", "ASSIGNED_TO", "user", "assignee"),
        edges(issues, "ticket", "issue_key", "CHILD_OF", "ticket", "parent_key"),
        edges(issues.select("issue_key", F.explode("fix_versions").alias("v")), "ticket", "issue_key", "FIX_IN", "version", "v"),
        edges(issues.select("issue_key", F.explode("components").alias("v")), "ticket", "issue_key", "HAS_COMPONENT", "component", "v"),
        edges(issues.select("issue_key", F.explode("labels").alias("v")), "ticket", "issue_key", "HAS_LABEL", "label", "v"),
        edges(issues.select("issue_key", F.explode("issue_links").alias("l")), "ticket", "issue_key", link_relation(F.col("l.type")), "ticket", F.col("l.target")),
    ):
        out = out.unionByName(e)
    return out


def page_edges(pages: DataFrame) -> DataFrame:
    """Space membership, and CHILD_OF to every ancestor, of pages(page_id, space_id, ancestors)."""
    ancestors = pages.select("page_id", F.explode("ancestors").alias("a"))
    return edges(pages, "page", "page_id", "IN_SPACE", "space", "space_id").unionByName(edges(ancestors, "page", "page_id", "CHILD_OF", "page", F.col("a.id")))


def import_rows(chunks: DataFrame, source: str) -> DataFrame:
    """Chunks ready for the graph: those with an embedding, absent values as empty ones. 'jira' adds the ticket's fields and
    typed links (without a target: dropped), 'confluence' page, space and ancestors (without an id: dropped); both read a
    struct ``metadata``. 'gitlab' adds nothing."""
    text = lambda c, to="": F.coalesce(c.cast("string") if isinstance(c, Column) else F.col(c).cast("string"), F.lit(to))
    names = ["chunk_id", "parent_document_id", "text", "source", "source_type", "title", "url", "status", "author", "project_id", "project_name", "group_name", "created_at"]
    base = [text(c).alias(c) for c in names] + ["embedding"] + [F.coalesce(c, F.lit(n)).alias(c) for c, n in (("token_count", 0), ("chunk_index", 0), ("total_chunks", 1))]
    base += [text("embedding_model", "snowflake-arctic-embed-m").alias("embedding_model"), F.coalesce("labels", F.array().cast("array<string>")).alias("labels")]
    meta, id = (lambda c: F.col(f"metadata.{c}")), F.coalesce("parent_document_id", F.lit(""))
    rows = chunks.where(F.size("embedding") > 0)
    if source == "jira":
        fields = [text(meta(c)).alias(c) for c in ("issue_type", "priority", "assignee", "resolution", "parent_key")]
        lists = [F.coalesce(meta(c), F.array().cast("array<string>")).alias(c) for c in ("fix_versions", "components")]
        made = F.transform(F.coalesce(meta("issue_links"), F.array()), lambda l: F.struct(F.regexp_replace(F.coalesce(l["target"], F.lit("")), r"^\s+|\s+$", "").alias("target"), F.coalesce(l["type"], F.lit("relates to")).alias("type"), link_relation(F.coalesce(l["type"], F.lit("relates to"))).alias("rel_type")))
        return rows.select(*base, issue_key_of(id).alias("issue_key"), *fields, *lists, F.filter(made, lambda l: l["target"] != "").alias("issue_links"))
    if source == "confluence":
        some = lambda c: F.nullif(c.cast("string"), F.lit(""))
        up = F.transform(F.filter(F.coalesce(meta("ancestors"), F.array()), lambda a: F.coalesce(a["id"], F.lit("")) != ""), lambda a: F.struct(a["id"].alias("id"), F.coalesce(a["title"], F.lit("")).alias("title")))
        return rows.select(*base, F.coalesce(F.nullif(page_id_of(id), F.lit("")), meta("page_id"), F.lit("")).alias("page_id"), F.coalesce(some(meta("space_id")), some(F.col("project_id")), F.lit("")).alias("space_id"), text(meta("breadcrumb")).alias("breadcrumb"), up.alias("ancestors"))
    if source == "gitlab":
        return rows.select(*base)
    raise ValueError(f"no source {source}")


def merge_nodes(rows: DataFrame, key: str, order: Column, first_wins: bool = False) -> DataFrame:
    """One row per key: the last by ``order``, or the first."""
    w = Window.partitionBy(key).orderBy(order.asc() if first_wins else order.desc())
    return rows.where(F.col(key).isNotNull()).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def with_stubs(nodes: DataFrame, edges_: DataFrame) -> DataFrame:
    """nodes(label, key) and a stub for each end of an edge that has none."""
    ends = edges_.select(F.col("src_type").alias("label"), F.col("src").alias("key")).unionByName(edges_.select(F.col("dst_type").alias("label"), F.col("dst").alias("key"))).distinct()
    stubs = ends.join(nodes, ["label", "key"], "left_anti").withColumn("stub", F.lit(True))
    return nodes.select("label", "key").withColumn("stub", F.lit(False)).unionByName(stubs)


def stats(nodes: DataFrame, edges_: DataFrame) -> DataFrame:
    """(kind, name, n): counts of nodes by label and of edges by relationship."""
    n = nodes.groupBy("label").agg(F.count("*").alias("n")).select(F.lit("node").alias("kind"), F.col("label").alias("name"), "n")
    return n.unionByName(edges_.groupBy("rel").agg(F.count("*").alias("n")).select(F.lit("edge").alias("kind"), F.col("rel").alias("name"), "n"))


def both_ways(edges_: DataFrame) -> DataFrame:
    e = edges_.select("src", "rel", "dst", F.xxhash64("src", "rel", "dst").alias("edge")).distinct()
    back = F.when(F.col("src") != F.col("dst"), F.struct(F.col("dst").alias("src"), "rel", F.col("src").alias("dst"), "edge"))  # a loop is one step
    return e.select(F.explode(F.array(F.struct("src", "rel", "dst", "edge"), back)).alias("s")).where("s is not null").select("s.*")


def _parts(front: DataFrame, step: DataFrame, rows: Column | None = None) -> int:
    """How many tasks a level takes, by the number of steps that it makes."""
    degree = step.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("steps"))
    steps = front.groupBy("node").agg((F.count("*") if rows is None else rows).alias("rows")).join(degree, "node").agg(F.sum(F.col("rows") * F.col("steps"))).first()[0] or 0
    return max(int(front.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-steps // LEVEL))


def _sent(rows: DataFrame) -> DataFrame:
    """Staged rows, sent to all tasks if they are few."""
    return F.broadcast(rows) if rows.count() <= SENT else rows


def _shared(tip: DataFrame, step: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes that ``MANY`` rows of tip(seed, first, node) or more stand at (y, n: their number), and the steps (y, mid, n, as_one)
    from them. ``as_one`` tells that the rows at y go on as one, as y: at a mid where more such nodes meet than any of them has
    rows, the same few seeds may come by all of them, and rows of their own are fewer."""
    many = staged(tip.groupBy(F.col("node").alias("y")).agg(F.count("*").alias("n")).where(F.col("n") >= MANY), "many")
    steps = step.select(F.col("src").alias("y"), F.col("dst").alias("mid")).join(_sent(many), "y").distinct()
    meet = steps.groupBy("mid").agg((F.max("n") >= F.count("*")).alias("as_one"))
    return many, staged(steps.join(meet, "mid").select("y", "mid", "n", "as_one"), "shared")


def expand(edges_: DataFrame, seeds: DataFrame, hops: int = 2, rels: list[str] | None = None) -> DataFrame:
    """(seed, neighbor, rel, distance): nodes within ``hops`` undirected steps of each seed(key), by paths that use no edge
    twice; rel is the first step's type, distance the least for that seed, neighbor and rel.

    Searched breadth first, level by level, with a table of what is visited for each (seed, rel, node): a node goes on once
    for each of at most two neighbors of the seed (``via``) that paths to it begin with, so a level has at most
    2 x seeds x rels x nodes rows, whatever the number of paths. Paths that come back to the seed are not walked: the
    shortest way round, which two different first neighbors of one node tell, plus the distance by any first step, is all
    they can add. A repeated edge is one edge; equal distances make one row; a null end matches nothing.

    The last two levels, which may hold nearly seeds x nodes rows, are not stored: where many rows stand at one node, its
    two steps are taken once for all of them, dealt to tasks by the node they reach, and meet the rows only there."""
    e = edges_.where(F.col("rel").isin(rels)) if rels else edges_
    step = staged(both_ways(e.where("src is not null and dst is not null")), "steps")
    start = seeds.select(F.col("key").cast("string").alias("seed")).distinct().join(step, F.col("seed") == F.col("src")).where("dst <> seed")
    start = staged(start.select("seed", F.col("rel").alias("first"), F.col("dst").alias("node"), "edge"), "start")
    id = ["seed", "first", "node"]
    seen = staged(start.select(*id, F.col("node").alias("via"), F.lit(None).cast("string").alias("other"), F.lit(1).alias("near"), F.lit(None).cast("int").alias("second")).distinct(), "seen")
    known = max(1, hops - 2)
    front, parts = seen.select(*id, F.col("via").alias("label")), 1
    for h in range(2, known + 1):
        parts = max(parts, _parts(front, step))
        to = front.join(step.select(F.col("src").alias("node"), "dst"), "node").where("dst <> seed").select("seed", "first", F.col("dst").alias("node"), "label")
        found = to.repartition(parts, *id).groupBy(*id).agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
        both = found.join(seen, id, "full")
        a, b = F.col("via"), F.col("other")
        fresh = F.when(F.col("lo") != a, F.col("lo")).when(F.col("hi") != a, F.col("hi"))
        new_via = F.coalesce(a, F.col("lo"))
        new_other = F.when(b.isNotNull(), b).when(a.isNull(), F.when(F.col("hi") != F.col("lo"), F.col("hi"))).otherwise(fresh)
        after = staged(both.select(
            *id, new_via.alias("via"), new_other.alias("other"), F.coalesce("near", F.lit(h)).alias("near"),
            F.coalesce("second", F.when(new_other.isNotNull(), F.lit(h))).alias("second")), "seen")
        seen = after
        front = seen.select(*id, F.explode(F.array(F.when(F.col("near") == h, F.col("via")), F.when(F.col("second") == h, F.col("other")))).alias("label")).where("label is not null")
    # the shortest way round: to a neighbor of the seed by another neighbor, or back by a second edge of the first one
    ends = start.select("seed", "node").distinct()
    around = seen.join(ends, ["seed", "node"]).select("seed", "first", (F.when(F.col("via") != F.col("node"), F.col("near")).otherwise(F.col("second")) + 1).alias("around"))
    double = start.join(start.groupBy("seed", "node").agg(F.count_distinct("edge").alias("n")).where("n > 1").select("seed", "node"), ["seed", "node"]).select("seed", "first", F.lit(2).alias("around"))
    loops = start.select("seed").distinct().join(step.where("src = dst"), F.col("seed") == F.col("src")).select("seed", F.col("rel").alias("first"), F.lit(1).alias("around"))
    around = around.unionByName(double).unionByName(loops).groupBy("seed", "first").agg(F.min("around").alias("around"))
    around = _sent(staged(around, "around"))  # else all that a seed reaches is one task's
    parts = max(parts, int(start.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-seen.count() // LEVEL))
    seen = seen.repartition(parts, "seed", "node")
    straight = seen.groupBy("seed", "node").agg(F.min("near").alias("near"))
    again = around.join(straight, "seed").select(*id, (F.col("around") + F.col("near")).alias("distance")).where(F.col("distance") <= hops)
    reach = seen.select(*id, F.col("near").alias("distance")).unionByName(again)
    if hops == known:
        return reach.groupBy("seed", F.col("node").alias("neighbor"), F.col("first").alias("rel")).agg(F.min("distance").alias("distance"))
    return _last(reach, step, known, hops)


def _last(reach: DataFrame, step: DataFrame, known: int, hops: int) -> DataFrame:
    """The result, from rows (seed, first, node, distance) that are whole up to ``known``, one or two steps before ``hops``."""
    none = lambda *names: [F.lit(None).cast("string").alias(c) for c in names]
    edge = staged(reach.groupBy("seed", "first", "node").agg(F.min("distance").alias("distance")).where(F.col("distance").between(known, hops - 1)), "edge")
    tip = edge.where(F.col("distance") == known).select("seed", "first", "node")
    many, shared = _shared(tip, step)
    sent, rows = many.agg(F.count("*"), F.sum("n")).first()
    tasks = max(int(step.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-step.count() // LEVEL))
    # one step: rows of their own, and those that go on as one
    hub = _sent(many.select("y"))
    own = tip.join(hub, F.col("node") == F.col("y"), "left_anti").repartition(tasks, "node").join(step.select("src", "dst").repartition(tasks, "src"), F.col("node") == F.col("src")).select("seed", "first", F.col("dst").alias("node"))
    if sent:
        apart = shared.where("not as_one")
        own = own.unionByName(tip.join(apart, F.col("node") == F.col("y")).select("seed", "first", F.col("mid").alias("node")))
    one = own.where("node <> seed").unionByName(edge.where(F.col("distance") > known).select("seed", "first", "node")).distinct().select("node", *none("y"), "seed", "first", F.lit(1).cast("long").alias("n"))
    if sent:
        one = one.unionByName(shared.where("as_one").select(F.col("mid").alias("node"), "y", *none("seed", "first"), "n"))
    one = staged(one, "one")
    parts, to = tasks, reach.select("node", *none("y"), "seed", "first", *none("mid"), "distance").unionByName(one.select("node", "y", "seed", "first", *none("mid"), F.lit(known + 1).alias("distance")))
    if known + 1 < hops:
        parts = min(max(tasks, _parts(one, step, F.sum("n"))), TASKS)
        two = one.repartition(tasks, "node").join(step.select("src", "dst").repartition(tasks, "src"), F.col("node") == F.col("src")).where("seed is null or dst <> seed")
        to = to.unionByName(two.select(F.col("dst").alias("node"), "y", "seed", "first", F.col("node").alias("mid"), F.lit(hops).alias("distance")))
    to = to.repartition(parts, "node")
    least = lambda rows: rows.groupBy("seed", F.col("node").alias("neighbor"), F.col("first").alias("rel")).agg(F.min("distance").alias("distance"))
    if not sent:
        return least(to)
    to = to.groupBy("node", "y", "seed", "first", "distance").agg(F.min("mid").alias("lo"), F.max("mid").alias("hi"))
    at = tip.join(hub, F.col("node") == F.col("y")).select("y", F.col("seed").alias("s"), F.col("first").alias("f"))
    blocks, out = -(-rows // SENT), None
    for k in range(blocks):
        here = lambda *by: F.pmod(F.hash(*by), F.lit(blocks)) == k if blocks > 1 else F.lit(True)
        met = to.join(F.broadcast(at.where(here("s", "f"))), "y", "left").where("s is null or (node <> s and (lo is null or lo <> s or hi <> s))")
        met = met.select("node", F.coalesce("seed", "s").alias("seed"), F.coalesce("first", "f").alias("first"), "distance").where(F.col("seed").isNotNull() & here("seed", "first"))
        out = least(met) if out is None else out.unionByName(least(met))
    return out


def expand_chunks(edges_: DataFrame, seeds: DataFrame, chunks: DataFrame, hops: int = 2, max_expand: int = 20, rels: list[str] | None = None) -> DataFrame:
    """Of the nodes near each seed that own a chunk (chunks: owner, chunk_id, chunk_index): seed, neighbor, rel, distance
    and the first chunk; the nearest ``max_expand`` of each seed."""
    first = chunks.groupBy(F.col("owner").cast("string").alias("neighbor")).agg(F.min_by("chunk_id", F.struct("chunk_index", "chunk_id")).alias("chunk_id"))
    w = Window.partitionBy("seed").orderBy("distance", "neighbor", "rel")
    return expand(edges_, seeds, hops, rels).join(first, "neighbor").withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= max_expand).drop("_n")


def ticket_context(tickets: DataFrame, chunks: DataFrame, edges_: DataFrame, keys: list[str], n_chunks: int = 3, n_links: int = 8) -> DataFrame:
    """Named tickets with their first chunk texts and outgoing links, each aggregated before it is joined."""
    chosen = tickets.where(F.upper("issue_key").isin([k.upper() for k in keys]))
    texts = chunks.groupBy(F.col("owner").alias("issue_key")).agg(F.slice(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))), 1, n_chunks).alias("c")).select("issue_key", F.transform("c", lambda x: x["text"]).alias("texts"))
    links = edges_.where("src_type = 'ticket' and dst_type = 'ticket'").groupBy(F.col("src").alias("issue_key")).agg(F.slice(F.array_sort(F.collect_set(F.struct("rel", F.col("dst").alias("target")))), 1, n_links).alias("links"))
    return chosen.join(texts, "issue_key", "left").join(links, "issue_key", "left")


def check_unique(nodes: DataFrame, key: str) -> DataFrame:
    """Keys that break uniqueness, with their counts."""
    return nodes.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def ticket_links(tickets: DataFrame, edges_: DataFrame, keys: list[str]) -> DataFrame:
    """Named tickets with all their outgoing relations as map(rel -> sorted targets): relations are gathered before
    the join, so optional ones don't multiply."""
    chosen = tickets.where(F.upper("issue_key").isin([k.upper() for k in keys]))
    by_rel = edges_.where("src_type = 'ticket'").groupBy(F.col("src").alias("issue_key"), "rel").agg(F.array_sort(F.collect_set("dst")).alias("targets"))
    all_ = by_rel.groupBy("issue_key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("rel", "targets")))).alias("relations"))
    return chosen.join(all_, "issue_key", "left")


def pending(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not loaded yet."""
    return rows.join(done.select(key).distinct(), key, "left_anti")
