"""Operations of the catalogue and the normal form of records, over tables made of the test tables, and the same in SQL.

Suppliers stand for projects, orders for issues, merge requests and pipelines, events for commits, documents for files and
pages, customers for boards and tracker projects, nations for branches and spaces."""

from __future__ import annotations

from pyspark.sql import functions as F

from kelpie.operators import normalize, serving, vectors
from kelpie.plans import catalogue
from kelpie.queries import _t, _tickets, query


def _run(name, tables, **params):
    source, operation = name.split(".")
    return catalogue.run(catalogue.build(source, operation, **params), tables)


def _key(prefix, c):
    return F.concat(F.lit(prefix), F.col(c).cast("string"))


def _projects(spark, sf_dir):
    return _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), _key("g/", "s_suppkey").alias("project_path"), (F.col("s_suppkey") % 2 == 0).alias("owned"), F.col("s_acctbal").alias("last_activity_at"))


@query("SELECT s_suppkey AS id, s_name AS name FROM supplier WHERE contains(s_name, '1') AND s_suppkey % 2 = 0 ORDER BY s_acctbal DESC, s_suppkey LIMIT 20")
def q1_list_projects(spark, sf_dir):
    return _run("gitlab.list_projects", {"projects": _projects(spark, sf_dir)}, search="1", owned="true", limit="20").select("id", "name")


_REQUESTS = "m AS (SELECT o_orderkey AS id, 'g/' || (o_custkey % 10) AS project_path, CASE o_orderstatus WHEN 'O' THEN 'opened' WHEN 'F' THEN 'merged' ELSE 'closed' END AS state, lower(o_orderpriority) AS target_branch, 'u' || (o_custkey % 7) AS author, o_orderdate AS placed FROM orders)"


def _requests(spark, sf_dir):
    state = F.when(F.col("o_orderstatus") == "O", "opened").when(F.col("o_orderstatus") == "F", "merged").otherwise("closed")
    return _t(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("g/"), F.col("o_custkey") % 10).alias("project_path"), state.alias("state"), F.lower("o_orderpriority").alias("target_branch"), F.concat(F.lit("u"), F.col("o_custkey") % 7).alias("author"),
        F.col("o_orderpriority").alias("title"), F.lower("o_orderpriority").alias("ref"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("updated_at"), F.repeat(F.lit("d"), (F.col("o_orderkey") % 1000).cast("int")).alias("description"))


@query(f"WITH {_REQUESTS} SELECT id, CAST(least(800, id % 1000) AS INTEGER) AS chars FROM m WHERE project_path = 'g/3' AND state = 'merged' AND target_branch = '2-high' AND author = 'u3' ORDER BY placed DESC, id LIMIT 50")
def q3_merge_requests(spark, sf_dir):
    rows = _run("gitlab.get_merge_requests", {"merge_requests": _requests(spark, sf_dir)}, project="G/3", state="merged", target_branch="2-high", author="U3")
    return rows.select("id", F.length("description").alias("chars"))


@query("SELECT l_linenumber AS position, least(3000, 400 * l_linenumber) AS chars FROM lineitem WHERE l_orderkey = 7")
def q4_mr_diff(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem").select(F.lit("g/a").alias("project_path"), F.col("l_orderkey").alias("mr_iid"), F.col("l_linenumber").alias("position"), F.repeat(F.lit("+"), F.col("l_linenumber") * 400 + F.when(F.col("l_linenumber") > 7, 1).otherwise(0)).alias("diff"))
    return _run("gitlab.get_mr_diff", {"mr_changes": rows}, project="G/A", mr_iid="7").select("position", F.length("diff").alias("chars"))


@query(f"WITH {_REQUESTS} SELECT o_orderkey AS id FROM orders JOIN m ON m.id = o_orderkey WHERE project_path = 'g/2' AND target_branch = '5-low' AND o_orderstatus = 'P' ORDER BY id DESC LIMIT 30")
def q5_pipelines(spark, sf_dir):
    return _run("gitlab.get_pipelines", {"pipelines": _requests(spark, sf_dir)}, project="g/2", ref="5-low", status="P").select("id")


@query("SELECT event_id AS id FROM events WHERE user_id % 5 = 1 AND event_type = 'click' AND user_id % 3 = 0 AND strftime(ts, '%Y-%m-%d') >= '2024-01-10' ORDER BY strftime(ts, '%Y-%m-%d %H:%M:%S') DESC, event_id LIMIT 40")
def q6_commits(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.concat(F.lit("g/"), F.col("user_id") % 5).alias("project_path"), F.col("event_type").alias("branch"), F.array(F.concat(F.lit("f"), F.col("user_id") % 3)).alias("files"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("created_at"))
    return _run("gitlab.get_commits", {"commits": rows}, project="g/1", branch="click", file_path="f0", since="2024-01-10", limit="40").select("id")


@query("SELECT s_suppkey AS id, s_name AS name FROM supplier WHERE s_suppkey = 7")
def q8_project_info(spark, sf_dir):
    return _run("gitlab.get_project_info", {"projects": _projects(spark, sf_dir)}, project="G/7").select("id", "name")


def _files(spark, sf_dir):
    path = F.concat_ws("/", "lang", "source", F.concat("doc_id", F.lit(".zsh")))
    return _t(spark, sf_dir, "documents").select(
        F.lit("g/a").alias("project_path"), F.lit("main").alias("ref"), path.alias("path"), path.alias("file_path"), F.concat_ws("/", "lang", "source").alias("parent"), F.lit("blob").alias("type"), F.col("text").alias("content"), "doc_id",
        F.lit(1).alias("project_id"), F.lit("a").alias("project_name"), F.lit("g").alias("group_name"), F.lit(".zsh").alias("extension"), F.length("text").alias("size_bytes"), F.lit("").alias("web_url"))


@query("SELECT 'en/' || source || '/' || doc_id || '.zsh' AS path FROM documents WHERE lang = 'en' AND source LIKE 'src1%' ORDER BY path LIMIT 60")
def q10_tree_below(spark, sf_dir):
    return _run("gitlab.get_repository_tree", {"tree": _files(spark, sf_dir)}, project="g/a", path="en/src1", recursive="true", limit="60").select("path")


@query("SELECT 'de/src2/' || doc_id || '.zsh' AS path FROM documents WHERE lang = 'de' AND source = 'src2' ORDER BY path LIMIT 100")
def q10_tree(spark, sf_dir):
    return _run("gitlab.get_repository_tree", {"tree": _files(spark, sf_dir)}, project="g/a", path="de/src2").select("path")


@query("SELECT lang || '/' || source || '/' || doc_id || '.zsh' AS file_path FROM documents WHERE contains(lower(text), 'license') ORDER BY file_path LIMIT 20")
def q11_code_search(spark, sf_dir):
    return _run("gitlab.search_code", {"files": _files(spark, sf_dir)}, query="License", project="G/a").select("file_path")


@query("SELECT n_name AS name FROM nation WHERE contains(lower(n_name), '1') ORDER BY n_name LIMIT 50")
def q12_branches(spark, sf_dir):
    return _run("gitlab.get_branches", {"branches": _t(spark, sf_dir, "nation").select(F.lit("g/a").alias("project_path"), F.col("n_name").alias("name"))}, project="g/a", search="1").select("name")


@query("SELECT c_custkey AS key, c_name AS name FROM customer ORDER BY c_name LIMIT 500")
def q13_tracker_projects(spark, sf_dir):
    return _run("jira.list_projects", {"jira_projects": _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))}).select("key", "name")


@query("SELECT c_custkey AS board_id FROM customer WHERE c_mktsegment = 'MACHINERY' ORDER BY c_custkey LIMIT 20")
def q18_boards(spark, sf_dir):
    return _run("jira.get_boards", {"boards": _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("board_id"), F.col("c_mktsegment").alias("project_key"))}, project_key="MACHINERY").select("board_id")


@query("SELECT 'ORD-' || o_orderkey AS issue_key FROM orders WHERE o_custkey = 10 AND o_orderstatus = 'F' ORDER BY strftime(o_orderdate, '%Y-%m-%d') DESC, issue_key LIMIT 100")
def q20_user_issues(spark, sf_dir):
    return _run("jira.get_user_issues", {"tickets": _tickets(spark, sf_dir)}, assignee="customer#10", project_key="ORD", status="DONE").select("issue_key")


@query("SELECT n_name AS space_key FROM nation ORDER BY n_name LIMIT 12")
def q22_spaces(spark, sf_dir):
    return _run("confluence.get_spaces", {"spaces": _t(spark, sf_dir, "nation").select(F.col("n_name").alias("space_key"))}, limit="12").select("space_key")


def _wiki(spark, sf_dir):
    """Documents as pages; each tenth page is the parent of the nine after it."""
    parent = F.when(F.col("doc_id") % 10 != 0, F.col("doc_id") - F.col("doc_id") % 10)
    return _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), F.concat_ws(" ", F.lit("Page of"), "source").alias("title"), F.col("text").alias("content"), F.upper("lang").alias("space_key"), parent.alias("parent_id"))


@query("SELECT doc_id AS page_id FROM documents WHERE lang = 'fr' AND contains(lower('Page of ' || source), 'of src1') ORDER BY doc_id LIMIT 50")
def q23_pages(spark, sf_dir):
    return _run("confluence.get_pages", {"pages": _wiki(spark, sf_dir)}, space_key="FR", title_contains="OF src1").select("page_id")


@query("SELECT doc_id AS page_id, md5(text) AS body FROM documents WHERE doc_id = 42")
def q24_page(spark, sf_dir):
    return _run("confluence.get_page", {"pages": _wiki(spark, sf_dir)}, page_id=42).select("page_id", F.md5("content").alias("body"))


@query("SELECT turn AS created_at, md5(text) AS body FROM conversations WHERE conv_id = 12 ORDER BY turn LIMIT 3")
def q24_page_comments(spark, sf_dir):
    rows = _t(spark, sf_dir, "conversations").select(F.col("conv_id").alias("page_id"), F.col("turn").alias("created_at"), "text")
    return _run("confluence.get_page_comments", {"page_comments": rows}, page_id=12, limit="3").select("created_at", F.md5("text").alias("body"))


@query("SELECT doc_id AS page_id FROM documents WHERE doc_id BETWEEN 31 AND 39")
def q27_child_pages(spark, sf_dir):
    return _run("confluence.get_child_pages", {"pages": _wiki(spark, sf_dir)}, parent_page_id=30).select("page_id")


@query("""SELECT o_orderkey AS id FROM orders WHERE o_orderstatus <> 'F' AND (o_orderpriority = '1-URGENT' OR o_totalprice >= 400000) AND CASE WHEN o_custkey % 3 = 0 THEN o_custkey END IS NULL""")
def n24_conditions(spark, sf_dir):
    """Filters that differ, that hold in one of several ways, and on fields that are not there."""
    rows = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("state"), F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("price"), F.when(F.col("o_custkey") % 3 == 0, F.col("o_custkey")).alias("owner"))
    spec = catalogue.QuerySpec("orders", (("state", "!=", "F"), ("", "or", (("priority", "=", "1-URGENT"), ("price", ">=", 400_000.0))), ("owner", "exists", False)), columns=("id",))
    return catalogue.run(spec, {"orders": rows})


# ---- records in normal form ----------------------------------------------------------------------------------------

_COMMENTS = "c AS (SELECT l_orderkey, string_agg('Comment by L' || l_linenumber || ': ' || l_returnflag || l_linestatus, chr(10) || chr(10) ORDER BY l_linenumber, l_partkey, l_returnflag, l_linestatus) AS comments, count(*) AS n FROM lineitem WHERE l_linenumber % 3 <> 0 GROUP BY l_orderkey)"


def _records(spark, sf_dir):
    """Orders with their line items as comments; those without a body are no comments, but count."""
    body = F.when(F.col("l_linenumber") % 3 != 0, F.concat("l_returnflag", "l_linestatus"))
    item = F.struct("l_linenumber", "l_partkey", F.concat(F.lit("L"), F.col("l_linenumber")).alias("author"), body.alias("body"))
    held = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(item)).alias("comments"))
    return _t(spark, sf_dir, "orders").join(held, "o_orderkey", "left").select(
        F.col("o_custkey").alias("project_id"), F.col("o_orderkey").alias("issue_id"), F.col("o_orderkey").alias("mr_id"), F.when(F.col("o_orderkey") % 4 != 0, F.concat(F.lit("about   "), "o_orderpriority")).alias("description"), F.col("o_orderpriority").alias("title"),
        F.col("o_orderstatus").alias("state"), F.lit("from").alias("source_branch"), F.lower("o_orderpriority").alias("target_branch"), F.lit(None).cast("string").alias("merged_at"), F.lit(None).cast("string").alias("milestone"), "comments")


@query(f"""WITH {_COMMENTS} SELECT 'gitlab_issue_' || o_custkey || '_' || o_orderkey AS document_id,
concat_ws(chr(10) || chr(10), CASE WHEN o_orderkey % 4 <> 0 THEN 'about ' || o_orderpriority END, comments) AS content, (SELECT count(*) FROM lineitem l WHERE l.l_orderkey = o_orderkey) AS n_comments FROM orders LEFT JOIN c ON l_orderkey = o_orderkey""")
def n1_issues(spark, sf_dir):
    return normalize.issues(_records(spark, sf_dir)).select("document_id", "content", F.get_json_object("metadata", "$.comment_count").cast("long").alias("n_comments"))


@query(f"""WITH {_COMMENTS} SELECT 'gitlab_mr_' || o_custkey || '_' || o_orderkey AS document_id,
concat_ws(chr(10) || chr(10), 'Branch: from → ' || lower(o_orderpriority), CASE WHEN o_orderkey % 4 <> 0 THEN 'about ' || o_orderpriority END, comments) AS content, o_orderstatus AS status FROM orders LEFT JOIN c ON l_orderkey = o_orderkey""")
def n2_merge_requests(spark, sf_dir):
    return normalize.merge_requests(_records(spark, sf_dir)).select("document_id", "content", "status")


@query("""SELECT 'gitlab_milestone_' || c_nationkey || '_' || c_custkey AS document_id, concat_ws(chr(10), 'Milestone: ' || c_name, 'State: ' || CASE WHEN c_custkey % 5 = 0 THEN 'unknown' ELSE c_mktsegment END,
CASE WHEN c_custkey % 3 = 0 THEN 'about it' END, CASE WHEN c_custkey % 2 = 0 THEN 'Due date: 2024-05-' || lpad(CAST(c_custkey % 28 + 1 AS VARCHAR), 2, '0') END) AS content FROM customer""")
def n3_milestones(spark, sf_dir):
    k = F.col("c_custkey")
    rows = _t(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("project_id"), k.alias("milestone_id"), k.alias("milestone_iid"), F.col("c_name").alias("title"), F.when(k % 5 != 0, F.col("c_mktsegment")).alias("state"), F.when(k % 3 == 0, "about it").alias("description"),
        F.when(k % 2 == 0, F.concat(F.lit("2024-05-"), F.lpad((k % 28 + 1).cast("string"), 2, "0"))).alias("due_date"), F.lit("").alias("start_date"))
    return normalize.milestones(rows).select("document_id", "content")


@query("""SELECT 'gitlab_code_1_' || lang || '_' || source || '_' || doc_id || '.zsh' AS document_id, lang || '/' || source || '/' || doc_id || '.zsh  [a]' AS title,
md5('File: ' || lang || '/' || source || '/' || doc_id || '.zsh  (zsh)' || chr(10) || 'Project: a  |  Branch: main' || chr(10) || repeat('─', 60) || chr(10) || text) AS content FROM documents""")
def n4_code_files(spark, sf_dir):
    return normalize.code_files(_files(spark, sf_dir)).select("document_id", "title", F.md5("content").alias("content"))


# ---- serving and search --------------------------------------------------------------------------------------------


@query("SELECT turn AS timestamp, md5(text) AS body FROM conversations WHERE conv_id = 5")
def a2_conversation(spark, sf_dir):
    rows = _t(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("conversation_id"), F.col("turn").alias("timestamp"), "text")
    return serving.conversation(rows, "5").select("timestamp", F.md5("text").alias("body"))


@query("""SELECT o_custkey, n, titles FROM (SELECT o_custkey, count(*) AS n, list(o_orderkey ORDER BY o_orderkey) AS k FROM orders GROUP BY o_custkey), LATERAL (SELECT array_to_string(list_transform(k[1:5], lambda x: 'T' || x), ',') AS titles)""")
def a8_turn_summary(spark, sf_dir):
    """What is kept of live results: a customer's orders as the items of a call."""
    held = _t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("k"))
    result = F.struct(F.lit("jira").alias("source"), F.lit("get_issues").alias("operation"), F.size("k").cast("long").alias("count"), F.transform("k", lambda x: F.concat(F.lit("T"), x)).alias("titles"))
    one = held.select("o_custkey", serving.turn_summary(F.array(result))[0].alias("s"))
    return one.select("o_custkey", F.col("s.count").alias("n"), F.array_join("s.titles", ",").alias("titles"))


@query("""SELECT vec_id, round(list_sum(embedding[1:8]), 6) AS score, row_number() OVER (ORDER BY list_sum(list_transform(embedding[1:8], lambda x: CAST(x AS DOUBLE))) DESC, vec_id) AS rank FROM embeddings
WHERE label IN (1, 2, 3) AND list_sum(list_transform(embedding[1:8], lambda x: CAST(x AS DOUBLE))) >= 0.1 ORDER BY rank LIMIT 15""")
def e4_search_one(spark, sf_dir):
    """The rows nearest to one vector, under a filter and a threshold."""
    found = vectors.search(_t(spark, sf_dir, "embeddings"), [1.0] * 8 + [0.0] * 56, 15, at_least=0.1, where=F.col("label").isin(1, 2, 3))
    return found.select("vec_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))
