"""Queries of the catalogue, of questions and of answered questions over the test tables."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import functions as F

from kelpie.functions import intent
from kelpie.plans import answering, catalogue, routing
from kelpie.queries import _t, _tickets, query


def _pages(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), F.concat(F.lit("T"), F.col("doc_id")).alias("title"), F.col("text").alias("content"), F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 28).cast("int")), "yyyy-MM-dd").alias("last_modified"), F.upper("lang").alias("space_key"))


@query("""SELECT doc_id AS page_id, strftime(DATE '2024-01-01' + CAST(doc_id % 28 AS INTEGER), '%Y-%m-%d') AS last_modified FROM documents WHERE doc_id % 28 >= 20 AND lang = 'en' ORDER BY last_modified DESC, page_id LIMIT 20""")
def q26_recent_pages(spark, sf_dir):
    spec = catalogue.build("confluence", "get_recent_pages", days="7", limit="20", space_key="EN", now=datetime(2024, 1, 28, tzinfo=UTC))
    return catalogue.run(spec, {"pages": _pages(spark, sf_dir)}).select("page_id", "last_modified")


@query("""SELECT id FROM (SELECT o_orderkey AS id, o_orderdate FROM orders WHERE o_orderstatus = 'O' AND o_custkey % 2 = 0 ORDER BY o_orderdate DESC, o_orderkey LIMIT 50)""")
def q2_open_by_default(spark, sf_dir):
    rows = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_custkey") % 2 == 0, "g/a").otherwise("g/b").alias("project_path"), F.when(F.col("o_orderstatus") == "O", "opened").otherwise("closed").alias("state"), F.col("o_orderdate").alias("updated_at"), F.lit("d").alias("description"))
    return catalogue.run(catalogue.build("gitlab", "get_issues", project="G/A"), {"issues": rows}).select("id")


@query("""WITH h AS (SELECT least(10, count(*)) AS n FROM orders WHERE o_orderpriority = '2-HIGH'), o AS (SELECT least(100, count(*)) AS n FROM orders WHERE o_orderstatus = 'F')
SELECT '1' AS question_id, 'issues' AS rule, true AS counts, 'Total: ' || h.n || CASE WHEN h.n = 10 THEN '+' ELSE '' END || chr(10) || chr(10) || '  * JIRA [ORD] -- get_project_issues: ' || h.n || CASE WHEN h.n = 10 THEN '+' ELSE '' END
  || chr(10) || chr(10) || '  (filtered by: priority=High)' || CASE WHEN h.n = 10 THEN chr(10) || '  (+ = fetch limit reached; actual count may be higher)' ELSE '' END AS text FROM h
UNION ALL SELECT '2', 'keys', false, NULL
UNION ALL SELECT '3', 'merge_requests', true, '0 results found (errors from: gitlab).'
UNION ALL SELECT '4', NULL, true, 'No data was retrieved -- could not count.'
UNION ALL SELECT '5', 'issues', true, 'Total: ' || o.n || CASE WHEN o.n = 100 THEN '+' ELSE '' END || chr(10) || chr(10) || '  * JIRA [ORD] -- get_project_issues: ' || o.n || CASE WHEN o.n = 100 THEN '+' ELSE '' END
  || chr(10) || chr(10) || '  (filtered by: status=Done)' || CASE WHEN o.n = 100 THEN chr(10) || '  (+ = fetch limit reached; actual count may be higher)' ELSE '' END FROM o""")
def z10_answers(spark, sf_dir):
    """Route, run and count, over tickets made of orders; merge requests have no table here."""
    asked = [("1", "how many high priority jira tickets", None), ("2", "status of ORD-1", "ORD"), ("3", "how many merge requests", None), ("4", "how many zzz", None), ("5", "number of closed tickets", "ORD")]
    rows = spark.createDataFrame([(i, q, None, j, None) for i, q, j in asked], "question_id string, question string, gitlab_project string, jira_project string, last_key string")
    tickets = _tickets(spark, sf_dir).withColumn("priority", F.initcap(F.regexp_extract("priority", r"\d-(\w+)", 1)))
    alone = answering.answer(rows.where("question_id in ('1', '2', '4')"), {"tickets": tickets}, [], ["ORD"])
    return alone.unionByName(answering.answer(rows.where("question_id = '3'"), {"tickets": tickets}, ["g/a"], [])).unionByName(answering.answer(rows.where("question_id = '5'"), {"tickets": tickets}, [], []))


# ---- questions ----------------------------------------------------------------------------------------------------

#: Questions that reach each rule, and what the rules make of them; turns of conversations ask one of them each.
_QUESTIONS = [
    ("a", "issues fixed last week"), ("b", "completed issues since 2024-03-05"), ("c", "pending tickets"), ("d", "tickets in review"), ("e", "bloqué tickets"), ("f", "blocked"), ("g", "open tickets before April 30, 2026"),
    ("h", "minor bugs"), ("i", "all merged MRs"), ("j", "how many high priority bugs are there"), ("k", "how many bugs, list them"), ("l", "tickets reported by Jane Doe"), ("m", "tickets where Dorian You is the author"),
    ("n", "Find me the page about the login flow"), ("o", "Tous les bugs en cours de test"), ("p", "wiki page"), ("q", "critical WIP"), ("r", "Dorian You is the reporter"), ("s", "total of trivial items, and why"), ("t", None)]
_VALUES = """('a', 'Done', NULL, 'closed', NULL, NULL, NULL, 'issues fixed last week', false), ('b', 'Done', NULL, 'closed', NULL, '2024-03-05', NULL, 'completed issues since 2024-03-05', false),
 ('c', 'To Do', NULL, 'opened', NULL, NULL, NULL, 'pending tickets', false), ('d', 'In Review', NULL, 'opened', NULL, NULL, NULL, 'tickets review', false), ('e', 'Blocked', NULL, 'opened', NULL, NULL, NULL, 'bloqué tickets', false),
 ('f', 'Blocked', NULL, 'opened', NULL, NULL, NULL, 'blocked', false), ('g', 'Open', NULL, 'opened', NULL, NULL, '2026-04-30', 'open tickets before april 30, 2026', false), ('h', NULL, 'Low', 'opened', NULL, NULL, NULL, 'minor bugs', false),
 ('i', NULL, NULL, 'closed', NULL, NULL, NULL, 'all merged mrs', false), ('j', NULL, 'High', 'opened', NULL, NULL, NULL, 'many high priority bugs there', true), ('k', NULL, NULL, 'opened', NULL, NULL, NULL, 'many bugs, them', false),
 ('l', NULL, NULL, 'opened', 'Jane Doe', NULL, NULL, 'tickets reported by jane doe', false), ('m', NULL, NULL, 'opened', 'Dorian You', NULL, NULL, 'tickets where dorian author', false), ('n', NULL, NULL, 'opened', NULL, NULL, NULL, 'login flow', false),
 ('o', 'In Progress', NULL, 'opened', NULL, NULL, NULL, 'tous les bugs en cours de test', false), ('p', NULL, NULL, 'opened', NULL, NULL, NULL, 'wiki page', false), ('q', 'In Progress', 'Highest', 'opened', NULL, NULL, NULL, 'critical wip', false),
 ('r', NULL, NULL, 'opened', 'Dorian You', NULL, NULL, 'dorian reporter', false), ('s', NULL, 'Lowest', 'opened', NULL, NULL, NULL, 'total of trivial items, and why', false), ('t', NULL, NULL, 'opened', NULL, NULL, NULL, '', false)"""
_ASKED = [  # id, question, code project, tracker project, tracker project before, code project before
    (1, "what is the url of AB-7", None, None, None, None), (2, "are you sure?", None, None, "AB", "g/a"), (3, "any security problem in g/a", "g/a", "AB", None, None), (4, "security report", None, None, None, None),
    (5, "all merged merge requests", None, None, None, None), (6, "latest commits", None, None, None, None), (7, "commits and merge requests of g/a", "g/a", None, None, None), (8, "issues of the team, list projects", "g/a", "AB", None, None),
    (9, "gitlab issues, list projects", "g/a", "AB", None, None), (10, "show milestones", None, None, None, None), (11, "list all projects", None, None, None, None), (12, "read the Dockerfile", None, None, None, "g/a"),
    (13, "which env vars are needed", "g/a", None, None, None), (14, "explain main.py", "g/a", None, None, None), (15, "is there a project named zeta", None, None, None, None), (16, "branches of g/a", "g/a", None, None, None),
    (17, "directory structure", "g/a", None, None, None), (18, "did the build pass", "g/a", None, None, None), (19, "recent changes", "g/a", None, None, None), (20, "open merge requests", None, None, None, None),
    (21, "where is the auth middleware", "g/a", None, None, None), (22, "visibility of it", None, None, None, "g/b"), (23, "tickets where Dorian You is the author", None, None, None, None), (24, "what are we working on", None, "AB", None, None),
    (25, "diff of !12 and #7", "g/a", None, None, None), (26, "status of AB-1 and CD-2 and AB-1", None, "AB", None, None), (27, "urgent jira tickets since 2024-03-05", None, None, None, None), (28, "bug tickets", "g/a", None, None, None),
    (29, "bug tickets", None, "AB", None, None), (30, "list confluence spaces", None, None, None, None), (31, "recently updated wiki pages in the DEV space", None, None, None, None), (32, "documentation of the login flow", None, None, None, None),
    (33, "zzz", None, "AB", None, None), (34, "zzz", None, None, None, None), (35, "are you sure?", None, None, None, None), (36, "Done stories by newest in jira", "g/a", "AB", None, None)]
_ROUTED = """(1, 'link', 'jira.get_issue(issue_key=AB-7)'),
 (2, 'again', 'jira.get_project_issues(limit=100,project_key=AB) gitlab.get_issues(limit=100,project=g/a,state=all) gitlab.get_commits(limit=50,project=g/a)'),
 (3, 'security', 'gitlab.get_issues(limit=30,project=g/a,state=all) jira.get_issues(limit=10,project_key=AB,text=security)'),
 (4, 'security', 'gitlab.get_issues(limit=15,project=g/a,state=all) gitlab.get_issues(limit=15,project=g/b,state=all)'),
 (5, 'all_merge_requests', 'gitlab.get_merge_requests(project=g/a,state=closed) gitlab.get_merge_requests(project=g/b,state=closed)'),
 (6, 'all_commits', 'gitlab.get_commits(limit=5,project=g/a) gitlab.get_commits(limit=5,project=g/b)'),
 (7, 'merge_requests_and_commits', 'gitlab.get_merge_requests(project=g/a,state=opened) gitlab.get_commits(limit=15,project=g/a)'),
 (8, 'issues_of_projects', 'jira.get_project_issues(project_key=AB)'),
 (9, 'issues_of_projects', 'jira.get_project_issues(project_key=AB) gitlab.get_issues(project=g/a,state=opened)'),
 (10, 'milestones', 'gitlab.get_milestones()'), (11, 'projects', 'gitlab.list_projects()'), (12, 'file', 'gitlab.get_file(file_path=Dockerfile,project=g/a)'),
 (13, 'environment', 'gitlab.get_file(file_path=.env.example,project=g/a) gitlab.get_file(file_path=README.md,project=g/a)'),
 (14, 'code_file', 'gitlab.get_file(file_path=main.py,project=g/a)'), (15, 'project_exists', 'gitlab.list_projects()'), (16, 'branches', 'gitlab.get_branches(project=g/a)'),
 (17, 'tree', 'gitlab.get_repository_tree(project=g/a)'), (18, 'pipelines', 'gitlab.get_pipelines(limit=10,project=g/a)'), (19, 'commits', 'gitlab.get_commits(limit=15,project=g/a)'),
 (20, 'merge_requests', 'gitlab.get_merge_requests(project=g/a,state=opened) gitlab.get_merge_requests(project=g/b,state=opened)'),
 (21, 'code_search', 'gitlab.search_code(limit=10,project=g/a,query=middleware) gitlab.get_repository_tree(limit=50,project=g/a,recursive=true)'),
 (22, 'project_info', 'gitlab.get_project_info(project=g/b)'), (23, 'reporter', 'jira.get_issues(limit=100,reporter=Dorian You,sort_by=updated)'),
 (24, 'work_in_progress', 'gitlab.get_merge_requests(project=g/a,state=opened) gitlab.get_merge_requests(project=g/b,state=opened) jira.get_project_issues(limit=10,project_key=AB,status=In Progress)'),
 (25, 'reference', 'gitlab.get_mr_diff(mr_iid=12,project=g/a) gitlab.get_merge_requests(limit=50,project=g/a,state=all) gitlab.get_issues(limit=10,project=g/a,search=7)'),
 (26, 'keys', 'jira.get_issue(issue_key=AB-1) jira.get_issue(issue_key=CD-2)'),
 (27, 'issues', 'jira.get_project_issues(created_after=2024-03-05,limit=10,priority=Highest,project_key=AB) jira.get_project_issues(created_after=2024-03-05,limit=10,priority=Highest,project_key=CD)'),
 (28, 'issues', 'gitlab.get_issues(labels=bug,project=g/a,state=opened)'),
 (29, 'issues', 'gitlab.get_issues(limit=10,project=g/a,state=opened) gitlab.get_issues(limit=10,project=g/b,state=opened) jira.get_project_issues(issue_type=Bug,project_key=AB)'),
 (30, 'spaces', 'confluence.get_spaces()'), (31, 'recent_pages', 'confluence.get_recent_pages(days=7,limit=20,space_key=DEV)'), (32, 'pages', 'confluence.search_pages(limit=10,query=of login flow)'),
 (33, 'project', 'jira.get_project_issues(project_key=AB)'), (34, NULL, ''), (35, NULL, ''),
 (36, 'issues', 'gitlab.get_issues(project=g/a,state=closed) jira.get_project_issues(project_key=AB,sort_by=created,status=Done)')"""


def _asking(spark, sf_dir, n):
    """User turns with the number of their question."""
    rows = _t(spark, sf_dir, "conversations").where("role = 'user'")
    return rows.select(F.concat_ws("-", "conv_id", "turn").alias("turn_id"), ((F.col("conv_id") * 5 + F.col("turn")) % n).cast("int").alias("k"))


@query(f"""WITH v AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS k FROM (VALUES {_VALUES}) AS t(id, status, priority, state, reporter, after, before, terms, counts))
SELECT concat_ws('-', c.conv_id, c.turn) AS turn_id, status, priority, state, reporter, after, before, terms, counts FROM conversations c JOIN v ON v.k = (c.conv_id * 5 + c.turn) % {len(_QUESTIONS)} WHERE c.role = 'user'""")
def r4_question_values(spark, sf_dir):
    """Values named in questions: status, priority, state, reporter, dates, search terms, and whether only a count is asked."""
    q = F.get(F.array(*[F.lit(text) for _, text in _QUESTIONS]), F.col("k"))
    rows = _asking(spark, sf_dir, len(_QUESTIONS)).select("turn_id", q.alias("q"))
    q, d = F.col("q"), intent.date_bounds(F.col("q"))
    return rows.select(
        "turn_id", intent.status_of(q).alias("status"), intent.priority_of(q).alias("priority"), intent.state_of(q).alias("state"), intent.reporter_name(q).alias("reporter"), d["after"].alias("after"), d["before"].alias("before"),
        intent.search_terms(q).alias("terms"), intent.only_counts(q).alias("counts"))


@query(f"""WITH v AS (SELECT *, id - 1 AS k FROM (VALUES {_ROUTED}) AS t(id, rule, calls))
SELECT concat_ws('-', c.conv_id, c.turn) AS turn_id, rule, calls FROM conversations c JOIN v ON v.k = (c.conv_id * 5 + c.turn) % {len(_ASKED)} WHERE c.role = 'user'""")
def r3_route(spark, sf_dir):
    """Questions to calls, by all rules in their order."""
    names = ["question", "gitlab_project", "jira_project", "last_key", "last_project"]
    held = F.get(F.array(*[F.struct(*[F.lit(v).cast("string").alias(n) for n, v in zip(names, row[1:], strict=True)]) for row in _ASKED]), F.col("k"))
    rows = _asking(spark, sf_dir, len(_ASKED)).select(F.col("turn_id").alias("question_id"), held.alias("h")).select("question_id", "h.*")
    shown = F.transform("calls", lambda c: F.concat(c["source"], F.lit("."), c["operation"], F.lit("("), F.array_join(F.transform(F.array_sort(F.map_entries(c["params"])), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ","), F.lit(")")))
    return routing.route(rows, ["g/a", "g/b", "test/x"], ["AB", "CD"]).select(F.col("question_id").alias("turn_id"), "rule", F.array_join(shown, " ").alias("calls"))
