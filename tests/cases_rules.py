"""Rules on literal rows that reach each branch, with the results that the rules call for written out in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cases import case
from kelpie.functions import text
from kelpie.operators import context, datasets, serving
from kelpie.plans import catalogue, routing
from kelpie.sources import landed


@case("""SELECT * FROM (VALUES ('1', 'g/billing-core', 'BIL'), ('2', 'x/shop', 'SHOP'), ('3', NULL, 'PAY'), ('4', 'g/billing', 'BIL'), ('5', NULL, 'PAY'), ('6', NULL, NULL)) AS t(id, gitlab_project, jira_project)""")
def r9_registry(spark):
    q = spark.createDataFrame([("1", "issues of billing core please"), ("2", "AUTH-7 in shop"), ("3", "what about PAY-12?"), ("4", "pipelines of G/Billing"), ("5", "paymentservice bugs"), ("6", "nothing named")], "question_id string, question string")
    projects = spark.createDataFrame([("g/billing", "billing", False), ("g/billing-core", "billing core", False), ("x/shop", "shop", True), ("y/shop", "shop", False)], "path string, name string, preferred boolean")
    trackers = spark.createDataFrame([("BIL", "Billing Platform", 0), ("SHOP", "Shop", 1), ("PAY", "Payment Service", 2)], "key string, name string, position int")
    return routing.resolve_projects(q, projects, routing.jira_aliases(trackers)).select(F.col("question_id").alias("id"), "gitlab_project", "jira_project")


@case("""SELECT * FROM (VALUES ('package-lock.json', false), ('env/a.py', false), ('Makefile', false), ('pom.xml', false), ('Gemfile', true), ('a/target/x.py', true), ('.idea/a.json', true), ('src/a.PY', true), ('node_modules/a.js', false),
 ('Dockerfile', true), ('.env.example', true), ('a/.env', false), ('Cargo.lock', false), ('README.md', true), ('yarn.lock', false), ('docker-compose.yaml', true), ('a.b/c', false), ('.nyc_output/x.json', false), ('a/.bashrc', false),
 ('x/.py', true), ('dist\\a.py', false)) AS t(path, wanted)""")
def s7_code_files(spark):
    paths = [
        "package-lock.json", "env/a.py", "Makefile", "pom.xml", "Gemfile", "a/target/x.py", ".idea/a.json", "src/a.PY", "node_modules/a.js", "Dockerfile", ".env.example", "a/.env", "Cargo.lock", "README.md", "yarn.lock",
        "docker-compose.yaml", "a.b/c", ".nyc_output/x.json", "a/.bashrc", "x/.py", "dist\\a.py"]
    return spark.createDataFrame([(p,) for p in paths], "path string").select("path", text.is_code_file(F.col("path")).alias("wanted"))


@case("SELECT * FROM (VALUES ('a.py', 153600), ('c.md', 2)) AS t(file_path, size_bytes)")
def s6_code_contents(spark):
    """Files up to 150 * 1024 bytes; a larger one, a binary one and one of another kind are left out."""
    content = lambda n: F.base64(F.repeat(F.lit("x"), F.lit(n)).cast("binary"))
    rows = [("a.py", content(153_600)), ("b.py", content(153_601)), ("c.md", content(2)), ("d.bin", content(2)), ("e.py", F.base64(F.repeat(F.lit("\x01"), F.lit(60)).cast("binary")))]
    made = [spark.range(1).select(F.lit(1).cast("long").alias("project_id"), F.lit("p").alias("project_name"), F.lit("g").alias("group_name"), F.lit(p).alias("path"), F.lit("blob").alias("type"), F.lit("main").alias("ref"), c.alias("content_base64"), F.lit("").alias("web_url")) for p, c in rows]
    tree = made[0]
    for more in made[1:]:
        tree = tree.unionByName(more)
    return landed.code_files(tree).select("file_path", "size_bytes")


@case("""SELECT * FROM (VALUES ('AB-1', 'is blocked by', 'CD-2', 'inward'), ('AB-1', 'clones', 'CD-3', 'outward'), ('AB-1', 'relates to', 'CD-4', 'outward')) AS t(issue_key, type, target, direction)""")
def s9_ticket_links(spark):
    issue = "struct<key:string,summary:string,status:string>"
    rows = [("AB-1", [(("x", "is blocked by", "blocks"), ("CD-2", "s", "Open"), ("CD-9", "s", "Open")), (("x", "is cloned by", "clones"), None, ("CD-3", "s", "Open")), ((None, None, None), None, ("CD-4", None, None)), (("x", "i", "o"), None, None)], [("AB-5", "t", "Done")])]
    raw = spark.createDataFrame(rows, f"issue_key string, links array<struct<type:struct<name:string,inward:string,outward:string>,inwardIssue:{issue},outwardIssue:{issue}>>, subtasks array<{issue}>")
    return landed.linked_tickets(raw).select("issue_key", F.explode("issue_links").alias("l")).select("issue_key", "l.type", "l.target", "l.direction")


_TURN = "id int, intent string, summary array<string>, scoring_method string, scoring_context_source string, answer string, sources array<struct<source:string>>"


@case("""SELECT * FROM (VALUES (1, 'no_live_sentries|no_keys_cited_despite_jira_sources'), (2, ''), (3, 'no_real_context'), (4, ''), (5, 'no_real_context|short_answer(5c)'), (6, 'short_answer(100c)|no_keys_cited_despite_jira_sources'),
 (7, 'short_answer(0c)'), (8, 'no_real_context')) AS t(id, reasons)""")
def d12_rules(spark):
    jira, plain = [("jira",)], "some words that go on and on, " * 5
    rows = [
        (1, "sentries", None, "validator", None, plain, jira), (2, "sentries", [], "validator", None, plain + "ab-12", jira), (3, "rag", None, "ragas_no_context", None, plain, []), (4, "rag", None, "no_context", "stored_snippets", plain, jira),
        (5, "rag", None, "ragas", "empty", "short", None), (6, "both", [], "validator", None, plain[:100], jira), (7, "rag", None, None, None, None, None), (8, "both", ["x"], "x", "empty", plain, [("confluence",)])]
    return datasets.exclusion_reasons(spark.createDataFrame(rows, _TURN)).select("id", F.array_join("reasons", "|").alias("reasons"))


@case("""SELECT * FROM (VALUES (1, 'api_refusal'), (2, 'low_faithfulness'), (3, 'temporal_inconsistency'), (4, 'off_topic'), (5, 'code_syntax_error'), (6, 'low_overall_score'), (7, 'low_overall_score'), (8, 'api_refusal')) AS t(id, reason)""")
def x18_failure_reason(spark):
    rows = [(1, "I don't have access", 0.1, 1.0, 1.0, None), (2, "x", 0.39, 0.1, 0.1, None), (3, "x", 0.4, 0.49, 0.1, None), (4, "x", 0.4, 0.5, 0.39, 0.1), (5, "x", 0.4, 0.5, 0.4, 0.49), (6, "x", 0.4, 0.5, 0.4, 0.5), (7, None, None, None, None, None), (8, "sorry, I CAN'T query it", 1.0, 1.0, 1.0, 1.0)]
    scored = spark.createDataFrame(rows, "id int, answer string, faithfulness double, temporal_consistency double, answer_relevance double, code_correctness double")
    return scored.select("id", datasets.failure_reason().alias("reason"))


@case("SELECT * FROM (VALUES (1, 'b: ' || repeat('n', 80) || ' | c:  | d: x'), (2, ''), (3, '')) AS t(id, reasons)")
def x18_check_reasons(spark):
    rows = [(1, [("a", 0.0, "ok"), ("b", 0.2, "n" * 90), ("c", 0.1, None), ("d", 0.3, "x"), ("e", 0.3, "y")]), (2, [("a", -0.1, "bonus"), ("b", None, "z")]), (3, None)]
    return spark.createDataFrame(rows, "id int, checks array<struct<name:string,penalty:double,note:string>>").select("id", datasets.check_reasons(F.col("checks")).alias("reasons"))


@case("""SELECT * FROM (VALUES (1, 'family 2.5 for 3; size 3B for 8B'), (2, ''), (3, ''), (4, 'unclear name'), (5, 'family 2.5 for 3'), (6, 'unclear name'), (7, 'size 1.5B for 8B')) AS t(id, issues)""")
def d13_compatible(spark):
    rows = [(1, "Qwen/Qwen2.5-3B-Instruct", "qwen3:8b"), (2, "qwen2.5-7b", "Qwen2.5 7B"), (3, "llama-7b", "qwen2.5-7b"), (4, "llama", "qwen2.5-7b"), (5, "qwen 2.5", "qwen-3 4b"), (6, None, "qwen3"), (7, "Phi 1.5b", "llama 8B")]
    return spark.createDataFrame(rows, "id int, a string, b string").select("id", F.array_join(datasets.mismatches(F.col("a"), F.col("b")), "; ").alias("issues"))


@case("SELECT turn_id, CAST(reward_hint AS DOUBLE) AS reward_hint, newest FROM (VALUES (1, 0.9, 1), (2, 0.5, 2), (3, 0.4, 3), (4, NULL, 4)) AS t(turn_id, reward_hint, newest)")
def d3_rewards(spark):
    rows = [(4, "sentries", "x", "ragas", 0.9, None, 1), (3, "both", "x", "ragas", 0.9, 0.4, 2), (2, "both", "x", "validator", None, 0.4, 3), (1, "sentries", "x", "validator", 0.9, 0.4, 4), (5, "rag", "x", "validator", 0.9, 0.4, 5), (6, "both", None, "validator", 0.9, 0.4, 6)]
    scored = spark.createDataFrame(rows, "turn_id int, intent string, answer string, scoring_method string, faithfulness double, weighted_score double, timestamp int").withColumn("sources", F.array().cast("array<string>"))
    out = datasets.rollouts(scored)
    return out.select("turn_id", "reward_hint", (F.lit(5) - F.col("timestamp")).alias("newest"))


@case("""SELECT id, scoring_method, CAST(faithfulness AS DOUBLE) AS faithfulness, CAST(answer_relevance AS DOUBLE) AS answer_relevance, CAST(token_f1 AS DOUBLE) AS token_f1
FROM (VALUES (1, 'given', 0.9, 0.8, NULL), (2, 'validator', 0.85, 1.0, 0.75), (3, 'unknown_intent', 0.5, 0.5, NULL)) AS t(id, scoring_method, faithfulness, answer_relevance, token_f1)""")
def d7_score_samples(spark):
    rows = [(1, "q", "cat dog", None, None, 0.9, 0.8), (2, "what about AB-1", "AB-1 fixed", "AB-1 fixed today now", "sentries", None, None), (3, "q", "", "something", "chat", None, None)]
    source = "array<struct<source:string,title:string,url:string,issue_key:string,from_graph:boolean,score:double>>"
    samples = spark.createDataFrame(rows, "id int, query string, expected_answer string, generated_answer string, intent string, rag_faith double, rag_relevance double")
    summary = F.array(F.struct(F.lit("jira").alias("source"), F.lit("get_issue").alias("operation"), F.lit(1).cast("long").alias("count"), F.array(F.lit("AB-1: fixed")).alias("titles")))
    samples = samples.withColumn("sources", F.array(F.struct(F.lit("jira").alias("source"), F.lit("AB-1: fixed").alias("title"), F.lit("").alias("url"), F.lit("AB-1").alias("issue_key"), F.lit(False).alias("from_graph"), F.lit(0.9).alias("score"))).cast(source)).withColumn("summary", summary)
    return datasets.score_samples(samples, year=2025).select("id", "scoring_method", "faithfulness", "answer_relevance", "token_f1")


@case("""SELECT * FROM (VALUES ('strict', 'no_gain'), ('equal', NULL)) AS t(mode, reason)""")
def d9_allow_equal(spark):
    averages = spark.createDataFrame([("overall", 0.9, 0.8), ("sentries", 0.8, 0.8)], "intent string, faithfulness double, score double")
    base = spark.createDataFrame([("v", 0.8)], "version string, score double")
    one = lambda mode, equal: datasets.gates(averages, base, equal).select(F.lit(mode).alias("mode"), "reason")
    return one("strict", False).unionByName(one("equal", True))


@case("""SELECT * FROM (VALUES ('v3', 'benchmarked', NULL, 1), ('v2', 'deployed', '2024-02-01', 2), ('v1', 'benchmarked', NULL, 3)) AS t(version, status, deployed_at, place)""")
def d10_registry(spark):
    rows = spark.createDataFrame([("v1", "benchmarked", None, 1), ("v2", "benchmarked", None, 2), ("v3", "benchmarked", None, 3)], "version string, status string, deployed_at string, registered_at int")
    listed = datasets.list_versions(datasets.mark_deployed(rows, "v2", F.lit("2024-02-01")))
    return listed.select("version", "status", "deployed_at", (F.lit(4) - F.col("registered_at")).alias("place"))


@case("""SELECT * FROM (VALUES ('1', 'new ' || repeat('x', 60)), ('2', 'old')) AS t(turn_id, chosen)""")
def a6_save_chosen(spark):
    chosen = spark.createDataFrame([("1", "old", 1), ("2", "old", 1)], "turn_id string, chosen string, saved_at int")
    new = spark.createDataFrame([("1", "new " + "x" * 60, 2), ("2", "too short", 2), ("9", "no such turn " + "y" * 60, 2)], "turn_id string, chosen string, saved_at int")
    return serving.save_chosen(chosen, new, spark.createDataFrame([("1",), ("2",)], "turn_id string")).select("turn_id", "chosen")


@case("SELECT * FROM (VALUES ('1'), ('3')) AS t(turn_id)")
def a6_exclude_restore(spark):
    turns = spark.createDataFrame([("1",), ("2",), ("3",)], "turn_id string")
    excluded = serving.exclude(spark.createDataFrame([("1", "by hand", 1), ("2", "by hand", 1)], "turn_id string, reason string, excluded_at int"), spark.createDataFrame([("3", "weak", 2), ("8", "gone", 2)], "turn_id string, reason string, excluded_at int"), turns)
    return serving.restore(excluded, turns.where("turn_id = '2'")).select("turn_id")


@case("""SELECT * FROM (VALUES ('1', 12, 'T-1'), ('1', 12, 'T-2'), ('3', 31, 'T-4')) AS t(board_id, sprint_id, issue_key)""")
def q19_sprint_tickets(spark):
    boards = spark.createDataFrame([("1", "scrum"), ("2", "kanban"), ("3", "scrum"), ("4", "scrum")], "board_id string, type string")
    sprints = spark.createDataFrame([("1", 10, "S10", "closed", "a"), ("1", 11, "S11", "future", "b"), ("1", 12, "S12", "active", "c"), ("2", 20, "K", "active", "a"), ("3", 31, "F", "future", "a")], "board_id string, sprint_id int, name string, state string, start_date string")
    tickets = spark.createDataFrame([(12, "T-1", "2"), (12, "T-2", "1"), (11, "T-3", "1"), (31, "T-4", "1"), (20, "T-5", "1")], "sprint_id int, issue_key string, updated string")
    table = catalogue.sprint_tickets(boards, sprints, tickets)
    out = [catalogue.run(catalogue.build("jira", "get_sprint_issues", board_id=b), {"sprint_tickets": table.withColumn("board_id", F.col("board_id").cast("int"))}) for b in ("1", "3")]
    return out[0].unionByName(out[1]).select(F.col("board_id").cast("string").alias("board_id"), "sprint_id", "issue_key")


@case("""SELECT * FROM (VALUES ('AB-1', 'jo', 'status', 'Open', 'Done'), ('AB-1', 'jo', 'priority', NULL, 'High'), ('AB-1', 'al', 'status', 'Done', 'Open')) AS t(issue_key, author, field, old, new)""")
def q17_changelog(spark):
    rows = [("AB-1", [("jo", "2024-01-01", [("status", "Open", "Done"), ("priority", None, "High")]), ("al", "2024-01-02", [("status", "Done", "Open")])]), ("AB-2", [])]
    histories = spark.createDataFrame(rows, "issue_key string, values array<struct<author:string,created:string,items array<struct<field:string,fromString:string,toString:string>>>>".replace("items array", "items:array"))
    spec = catalogue.build("jira", "get_issue_changelog", issue_key="ab-1")
    return catalogue.run(spec, {"ticket_changes": catalogue.changelog(histories)}).select("issue_key", "author", "field", F.col("from").alias("old"), F.col("to").alias("new"))


@case("""SELECT * FROM (VALUES ('AB-1', 'status:Done, priority:High'), ('AB-2', '')) AS t(issue_key, changes)""")
def q16_issue_with_changes(spark):
    changes = spark.createDataFrame([("AB-1", "jo", "2024-01-02", "priority", None, "High"), ("AB-1", "jo", "2024-01-01", "status", "Open", "Done")], "issue_key string, author string, changed_at string, field string, from string, to string")
    table = catalogue.with_changes(spark.createDataFrame([("AB-1",), ("AB-2",)], "issue_key string"), changes)
    one = lambda k: catalogue.run(catalogue.build("jira", "get_issue", issue_key=k, include_changelog="true"), {"tickets_with_changes": table})
    return one("AB-1").unionByName(one("AB-2")).select("issue_key", F.array_join(F.transform("changes", lambda c: F.concat(c["field"], F.lit(":"), c["to"])), ", ").alias("changes"))


@case("""SELECT * FROM (VALUES ('g/a', 'dev', 'A'), ('g/b', 'main', 'B')) AS t(project_path, ref, content)""")
def q7_file_at_default(spark):
    files = spark.createDataFrame([("g/a", "x.py", "main", "old"), ("g/a", "x.py", "dev", "A"), ("g/b", "x.py", "main", "B"), ("g/b", "x.py", "dev", "no")], "project_path string, file_path string, ref string, content string")
    projects = spark.createDataFrame([("g/a", "dev"), ("g/b", None)], "project_path string, default_branch string")
    table = catalogue.files_at_refs(files, projects)
    one = lambda p: catalogue.run(catalogue.build("gitlab", "get_file", project=p, file_path="x.py"), {"files_at_ref": table})
    return one("g/a").unionByName(one("g/b")).select("project_path", "ref", "content")


@case("""SELECT * FROM (VALUES ('Jane', 'u1'), ('Bob Roe', 'u2'), ('Zed', 'Zed'), ('Ann Lee Jr', 'u3')) AS t(name, account)""")
def q21_account_of(spark):
    users = spark.createDataFrame([("u1", "Jane Doe"), ("u2", "bob roe"), ("u0", "Old Bob Roe"), ("u3", "Ann Lee"), ("u9", None)], "account_id string, display_name string")
    return catalogue.account_of(spark.createDataFrame([("Jane",), ("Bob Roe",), ("Zed",), ("Ann Lee Jr",)], "name string"), users)


_SOURCE = "array<struct<source:string,title:string,url:string,issue_key:string,from_graph:boolean,score:double>>"


@case("""SELECT id, CAST(penalty AS DOUBLE) AS penalty FROM (VALUES (1, 0.0), (2, 0.0), (3, -0.05), (4, 0.15), (5, 0.0), (6, 0.2), (7, 0.0), (8, 0.2), (9, 0.0), (10, 0.1), (11, 0.0)) AS t(id, penalty)""")
def x13_summary_coverage(spark):
    """The penalty of an answer against the live summary: not kept, kept empty, and kept with titles."""
    from kelpie.operators import evaluate

    mine, none, kept = [("jira", "AB-1: x", "http://j/AB-1", "AB-1", False, 0.9)], [], lambda *titles: [("jira", "get_issues", 1, list(titles))]
    rows = [
        (1, "q", "AB-9 is open", none, None), (2, "q", "AB-9 is open", mine, []), (3, "q", "there are no results", none, []), (4, "q", "AB-9 is open", none, []), (5, "what of AB-9", "AB-9 is open", none, []),
        (6, "q", "AB-8, AB-9 and AB-1", none, kept("AB-1: x")), (7, "q", "AB-1 and AB-9", none, kept("AB-1: x")), (8, "q", "merged in !14", none, kept("!12 fix")), (9, "and !14?", "merged in !14", none, kept("!12 fix")),
        (10, "q", "no issues were found", none, kept("AB-1: x")), (11, "q", "all is well", none, kept("AB-1: x"))]
    turns = spark.createDataFrame(rows, f"id int, query string, answer string, sources {_SOURCE}, summary array<struct<source:string,operation:string,count:long,titles:array<string>>>")
    checks = evaluate.validator_checks(F.col("query"), F.col("answer"), F.col("sources"), F.col("summary"))
    return turns.select("id", F.element_at(F.filter(checks, lambda c: c["name"] == "sentries_summary_coverage"), 1)["penalty"].alias("penalty"))


_RESULTS = "id int, r array<struct<source:string,operation:string,success:boolean,error:string,items:array<array<struct<name:string,value:string>>>>>"


@case(r"""SELECT * FROM (VALUES
 (1, '[JIRA → get_issues]' || chr(10) || '  title: ' || repeat('t', 300) || '…' || chr(10) || '  description: ' || repeat('d', 400) || '…' || chr(10) || '---' || chr(10) || '  title: b'),
 (2, '[GITLAB → get_file]' || chr(10) || '  content:' || chr(10) || '   1  x = 1' || chr(10) || '   2  y' || chr(10) || chr(10) || '[JIRA → get_issue]' || chr(10) || 'Error: no' || chr(10) || chr(10) || '[JIRA → get_boards]' || chr(10) || 'No results found.'),
 (3, '[A → o]' || chr(10) || '  title: ' || repeat('t', 120) || '…' || chr(10) || '---' || chr(10) || '  title: b' || chr(10) || '---' || chr(10) || '  title: b' || chr(10) || chr(10) || '  … and 2 more items'),
 (4, '(no live API results)'), (5, '(live APIs returned no usable data)'), (6, '(no live API results)')) AS t(id, text)""")
def w4_live_results(spark):
    title = lambda n: [("title", "t" * n)]
    rows = [
        (1, [("jira", "get_issues", True, None, [[*title(301), ("description", "d" * 401), ("content", "hidden"), ("empty", ""), ("comments", "c")], [("title", "b")]])]),
        (2, [("gitlab", "get_file", True, None, [[("content", "x = 1\ny")]]), ("jira", "get_issue", False, "no", []), ("jira", "get_boards", True, None, [])]),
        (3, [("a", "o", True, None, [title(130), *[[("title", "b")]] * 4]), ("b", "o", False, "e", []), ("c", "o", True, None, []), ("d", "o", True, None, [[("text", "left out")]])]),
        (4, []), (5, [("a", "o", True, None, [[("text", "left out")]])]), (6, None)]
    return spark.createDataFrame(rows, _RESULTS).select("id", context.live_results(F.col("r")).alias("text"))


@case(r"""SELECT * FROM (VALUES (1, '[1] [JIRA] issue — Login' || chr(10) || '    Score: 0.912' || chr(10) || '    Key: AB-1  |  Priority: High' || chr(10) || '    ' || repeat('x', 600) || chr(10) || chr(10) || '[2] [?]  — Untitled' || chr(10) || '    Score: 0.000' || chr(10) || '    '),
 (2, '(knowledge base returned no relevant documents)'), (3, '(no knowledge-base results)')) AS t(id, text)""")
def w3_knowledge_results(spark):
    s = "struct<source:string,source_type:string,title:string,score:double,issue_key:string,status:string,priority:string,assignee:string,project:string,url:string,text:string>"
    rows = [(1, [("jira", "issue", "Login", 0.9123, "AB-1", None, "High", "", None, None, "x" * 700), (None,) * 11]), (2, []), (3, None)]
    return spark.createDataFrame(rows, f"id int, s array<{s}>").select("id", context.knowledge_results(F.col("s")).alias("text"))
