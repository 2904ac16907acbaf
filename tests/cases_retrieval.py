"""The composed retrieval forms and the graph's import rows on literal rows that reach each branch, with the results written
out in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cases import case
from kelpie.functions import chunking
from kelpie.operators import graph, retrieval


def _tables(spark):
    """queries, hits, tickets, chunks and edges."""
    asked = [(1, "status of AB-1 and login flow"), (2, "AB-1 AB-1 nothing ZZ-9"), (3, ""), (4, None)]
    tickets = [("AB-1", "Login flow"), ("AB-2", "Token"), ("AB-3", "Rate"), ("AB-4", "No chunks"), ("AB-5", "Far")]
    chunks = [
        ("j1a", "jira_issue_AB-1_part_1", 0, "login text", "Login flow", "jira"), ("j1b", "jira_issue_AB-1_part_2", 1, "more", "Login flow", "jira"), ("j1c", "jira_issue_AB-1", 2, "login text", "Login flow", "jira"),
        ("j2", "jira_issue_AB-2", 0, "token login", "Token", "jira"), ("j3a", "jira_issue_AB-3", 1, "rate late", "Rate", "jira"), ("j3b", "jira_issue_AB-3", 0, "rate first", "Rate", "jira"), ("j5", "jira_issue_AB-5", 0, "far", "Far", "jira"),
        ("p10", "confluence_page_10", 0, "page", "Guide", "confluence"), ("p11", "confluence_page_11_part_1", 0, "child page", "Child", "confluence"), ("c1", "gitlab_code_1", 0, "code", "Code", "gitlab"), ("n", None, 0, None, None, None)]
    edges = [
        ("ticket", "AB-1", "BLOCKS", "ticket", "AB-2"), ("ticket", "AB-3", "CAUSES", "ticket", "AB-2"), ("ticket", "AB-2", "TESTS", "ticket", "AB-3"), ("ticket", "AB-1", "RELATES_TO", "ticket", "AB-4"), ("ticket", "AB-3", "TESTS", "ticket", "AB-5"),
        ("ticket", "AB-1", "HAS_LABEL", "label", "AB-5"), ("page", "11", "CHILD_OF", "page", "10")]
    scored = [(1, "j2", 0.9), (1, "p10", 0.5), (2, "j1a", 0.8), (2, "j2", 0.7), (3, "p11", 0.4)]
    c = spark.createDataFrame(chunks, "chunk_id string, parent_document_id string, chunk_index int, text string, title string, source string")
    return (
        spark.createDataFrame(asked, "query_id int, query string"), spark.createDataFrame(scored, "query_id int, chunk_id string, score double").join(c, "chunk_id"), spark.createDataFrame(tickets, "issue_key string, title string"), c,
        spark.createDataFrame(edges, "src_type string, src string, rel string, dst_type string, dst string"))


@case("""SELECT * FROM (VALUES
 (1, 1, 'direct_AB-1', 'login text', 'AB-1', true, false, NULL, NULL), (1, 2, 'direct_AB-1', 'more', 'AB-1', true, false, NULL, NULL), (1, 3, 'j2', 'token login', 'AB-2', false, false, NULL, NULL), (1, 4, 'p10', 'page', '', false, false, NULL, NULL),
 (1, 5, 'j1a', 'login text', 'AB-1', false, true, 'BLOCKS', 1), (1, 6, 'j3b', 'rate first', 'AB-3', false, true, 'CAUSES', 1), (1, 7, 'j5', 'far', 'AB-5', false, true, 'CAUSES', 2), (1, 8, 'p11', 'child page', NULL, false, true, NULL, 1),
 (2, 1, 'direct_AB-1', 'login text', 'AB-1', true, false, NULL, NULL), (2, 2, 'direct_AB-1', 'more', 'AB-1', true, false, NULL, NULL), (2, 3, 'direct_AB-1', 'login text', 'AB-1', true, false, NULL, NULL), (2, 4, 'direct_AB-1', 'more', 'AB-1', true, false, NULL, NULL),
 (2, 5, 'j1a', 'login text', 'AB-1', false, false, NULL, NULL), (2, 6, 'j2', 'token login', 'AB-2', false, false, NULL, NULL), (2, 7, 'j3b', 'rate first', 'AB-3', false, true, 'CAUSES', 1), (2, 8, 'j5', 'far', 'AB-5', false, true, 'CAUSES', 2),
 (3, 1, 'p11', 'child page', '', false, false, NULL, NULL), (3, 2, 'p10', 'page', NULL, false, true, NULL, 1)
) AS t(query_id, position, chunk_id, text, issue_key, from_direct, from_graph, relationship, graph_distance)""")
def h11_retrieve(spark):
    asked, hits, tickets, chunks, edges = _tables(spark)
    return retrieval.retrieve(asked, hits, tickets, chunks, edges).select("query_id", "position", "chunk_id", "text", "issue_key", "from_direct", "from_graph", "relationship", "graph_distance")


@case("SELECT * FROM (VALUES (1, 'BLOCKS>AB-2|RELATES_TO>AB-4'), (2, 'BLOCKS>AB-2|RELATES_TO>AB-4')) AS t(query_id, linked)")
def g8_direct_links(spark):
    asked, _, tickets, chunks, edges = _tables(spark)
    found = retrieval.direct_hits(asked, tickets, chunks, edges)
    return found.select("query_id", F.array_join(F.transform("linked", lambda l: F.concat(l["rel"], F.lit(">"), l["target"])), "|").alias("linked")).distinct()


@case("""SELECT * FROM (VALUES (1, 'AB-3', 'TESTS', 'j3a', 0.6), (1, 'AB-3', 'TESTS', 'j3b', 0.6), (2, 'AB-2', 'BLOCKS', 'j2', 0.6), (2, 'AB-3', 'TESTS', 'j3a', 0.6)) AS t(query_id, issue_key, relationship, chunk_id, score)""")
def g9_directed_hop(spark):
    """Three rows a query: of the second one's, that of a ticket without chunks takes a place and is dropped."""
    _, _, tickets, chunks, edges = _tables(spark)
    seeds = spark.createDataFrame([(1, "AB-2"), (2, "AB-1"), (2, "AB-2"), (3, "AB-4")], "query_id int, issue_key string")
    return retrieval.directed_hop(seeds, tickets, chunks, edges, most=3).select("query_id", "issue_key", "relationship", "chunk_id", F.col("score").cast("decimal(2,1)").alias("score"))


@case("""SELECT * FROM (VALUES (1, 1, 'j2', false, 0.646667::DOUBLE), (1, 2, 'j3a', true, 0.42), (1, 3, 'j3b', true, 0.42), (2, 1, 'j1a', false, 0.56), (2, 2, 'j2', false, 0.49), (2, 3, 'j2', false, 0.42), (3, 1, 'p11', false, 0.28)
) AS t(query_id, rank, chunk_id, from_graph, rerank_score)""")
def h9_flat_hybrid(spark):
    return retrieval.flat_hybrid(*_tables(spark), k=3).select("query_id", "rank", "chunk_id", "from_graph", F.round("rerank_score", 6).alias("rerank_score"))


@case("""SELECT * FROM (VALUES ('a', '', 0.5::DOUBLE, 0.9::DOUBLE, 'N/A', 'P', 'Open', false), ('b', 't', 0.5, 0.5, 'http://x', 'N/A', 'Done', true), ('c', '', 0.0, 0.0, 'N/A', 'Q', '', false)) AS t(chunk_id, text, score, rerank_score, url, project, status, from_graph)""")
def h14_normalized(spark):
    rows = [("a", None, 0.5, 0.9, "", "P", "Q", None, "Open", None), ("b", "t", 0.5, 0.0, "http://x", "", "", "Done", "Open", True), ("c", "", None, None, None, None, "Q", "", None, False)]
    hits = spark.createDataFrame(rows, "chunk_id string, text string, score double, rerank_score double, url string, project_name string, project string, status string, ticket_status string, from_graph boolean")
    return retrieval.normalized(hits).select("chunk_id", "text", "score", "rerank_score", "url", "project", "status", "from_graph")


@case("SELECT CAST(query_id AS INT) AS query_id, n_direct, n_vector, n_graph FROM (VALUES (1, 2::BIGINT, 2::BIGINT, 4::BIGINT), (2, 4, 2, 2), (3, 0, 1, 1)) AS t(query_id, n_direct, n_vector, n_graph)")
def z9_hit_counts(spark):
    return retrieval.hit_counts(retrieval.retrieve(*_tables(spark)))


_CHUNK = (
    "chunk_id string, parent_document_id string, text string, embedding array<float>, token_count int, chunk_index int, total_chunks int, source string, source_type string, title string, url string, status string, author string, project_id string, "
    "project_name string, group_name string, created_at string, embedding_model string, labels array<string>, metadata ")


def _raw(id, parent, embedding, project, meta):
    return (id, parent, None, embedding, None, None, None, None, None, None, None, None, None, project, None, None, None, None, None, meta)


@case("""SELECT * FROM (VALUES ('a', 'AB-1', 'Bug', '', 'AB-0', 'CD-2:BLOCKED_BY|CD-3:RELATES_TO', 'v1', 0, 1, ''), ('b', '', '', '', '', '', '', 0, 1, '7'), ('e', '', '', '', '', '', '', 0, 1, '')) AS t(chunk_id, issue_key, issue_type, priority, parent_key, links, versions, chunk_index, total_chunks, project_id)""")
def g1_ticket_rows(spark):
    """Chunks of tickets: links without a target go, chunks without an embedding too."""
    meta = "struct<issue_type:string,priority:string,assignee:string,resolution:string,parent_key:string,fix_versions:array<string>,components:array<string>,issue_links:array<struct<type:string,target:string>>>"
    rows = [
        _raw("a", "jira_issue_AB-1_part_2", [0.5], None, ("Bug", None, None, None, "AB-0", ["v1"], None, [("is blocked by", " CD-2 "), (None, "CD-3"), ("blocks", "  "), ("blocks", None)])), _raw("b", "gitlab_issue_1", [0.5], "7", None),
        _raw("c", "jira_issue_AB-3", [], None, None), _raw("d", "jira_issue_AB-4", None, None, None), _raw("e", None, [0.5], None, (None,) * 8)]
    out = graph.import_rows(spark.createDataFrame(rows, _CHUNK + meta), "jira")
    links = F.array_join(F.transform("issue_links", lambda l: F.concat(l["target"], F.lit(":"), l["rel_type"])), "|")
    return out.select("chunk_id", "issue_key", "issue_type", "priority", "parent_key", links.alias("links"), F.array_join("fix_versions", ",").alias("versions"), "chunk_index", "total_chunks", "project_id")


@case("""SELECT * FROM (VALUES ('a', '10', 'S', '1:Home|2:', 'Home > x'), ('b', '77', 'P', '', ''), ('d', '', '', '', '')) AS t(chunk_id, page_id, space_id, ancestors, breadcrumb)""")
def g1_page_rows(spark):
    meta = "struct<page_id:string,space_id:string,breadcrumb:string,ancestors:array<struct<id:string,title:string>>>"
    rows = [
        _raw("a", "confluence_page_10_part_1", [0.5], "P", ("9", "S", "Home > x", [("1", "Home"), ("2", None), ("", "x"), (None, "y")])), _raw("b", "other", [0.5], "P", ("77", "", None, None)), _raw("c", "confluence_page_1", None, "P", None), _raw("d", None, [0.5], None, None)]
    out = graph.import_rows(spark.createDataFrame(rows, _CHUNK + meta), "confluence")
    up = F.array_join(F.transform("ancestors", lambda a: F.concat(a["id"], F.lit(":"), a["title"])), "|")
    return out.select("chunk_id", "page_id", "space_id", up.alias("ancestors"), "breadcrumb")


@case("""SELECT * FROM (VALUES ('ticket', 'AB-1', 'BLOCKED_BY', 'ticket', 'CD-2'), ('ticket', 'AB-1', 'CHILD_OF', 'ticket', 'AB-0'), ('ticket', 'AB-1', 'FIX_IN', 'version', 'v1'), ('ticket', 'AB-1', 'HAS_LABEL', 'label', 'x'), ('ticket', 'AB-1', 'IN_PROJECT', 'project', '7'),
 ('ticket', 'AB-1', 'ASSIGNED_TO', 'user', 'Jo'), ('ticket', 'AB-1', 'HAS_COMPONENT', 'component', 'ui')) AS t(src_type, src, rel, dst_type, dst)""")
def g4_ticket_edges(spark):
    """From chunks to edges: the import rows of two chunks of one ticket give each edge once."""
    meta = "struct<issue_type:string,priority:string,assignee:string,resolution:string,parent_key:string,fix_versions:array<string>,components:array<string>,issue_links:array<struct<type:string,target:string>>>"
    one = ("Bug", None, "Jo", None, "AB-0", ["v1"], ["ui"], [("is blocked by", "CD-2")])
    rows = [_raw(id, f"jira_issue_AB-1_part_{n}", [0.5], "7", one)[:18] + (["x"], one) for id, n in (("a", 1), ("b", 2))]
    return graph.issue_edges(graph.import_rows(spark.createDataFrame(rows, _CHUNK + meta), "jira"))


def _counted(spark):
    rows = [(f"c{i:02}", "jira" if i % 3 else "gitlab", "issue", 10 + i, "x" * (98 + i)) for i in range(12)]
    return spark.createDataFrame(rows, "chunk_id string, source string, source_type string, token_count int, text string")


@case("""SELECT name, CAST(value AS DOUBLE) AS value FROM (VALUES ('documents', 5), ('chunks', 12), ('chunks_per_document', 2.4), ('source:jira', 8), ('source:gitlab', 4), ('sample_min', 10), ('sample_max', 19), ('sample_avg', 14.5)) AS t(name, value)""")
def z4_chunk_stats(spark):
    return chunking.chunk_stats(_counted(spark), spark.range(5))


@case("""SELECT chunk_id, source, source_type, token_count, repeat('x', n) || '...' AS preview FROM (VALUES ('c00', 'gitlab', 'issue', 10, 98), ('c01', 'jira', 'issue', 11, 99), ('c02', 'jira', 'issue', 12, 100)) AS t(chunk_id, source, source_type, token_count, n)""")
def z5_preview(spark):
    return chunking.preview(_counted(spark))
