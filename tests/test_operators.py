import json
import math
import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from kelpie.operators import context, datasets, evaluate, graph, normalize, ranking, serving, vectors
from kelpie.plans import catalogue, routing
from kelpie.sources import landed, sinks

SOURCE = "source string, title string, url string, issue_key string, from_graph boolean, score double"
TURN = f"turn_id string, query string, answer string, intent string, sources array<struct<{SOURCE.replace(' ', ':', 1) if False else ','.join(x.strip().replace(' ', ':') for x in SOURCE.split(','))}>>, summary array<struct<source:string,operation:string,count:bigint,titles:array<string>>>, total_time_s double, error string, timestamp timestamp"


def turn(**over):
    base = {"turn_id": "t", "query": "what about the thing", "answer": "", "intent": "sentries", "sources": [], "summary": None, "total_time_s": 1.0, "error": None, "timestamp": None}
    return tuple((base | over).values())


def ticket(key, graph_=False, score=0.9):
    return ("jira", f"{key}: Login", f"https://x.atlassian.net/browse/{key}", key, graph_, score)


def evaluated(spark, *turns):
    return evaluate.evaluate(spark.createDataFrame(list(turns), TURN), year=2025).collect()


def test_grades_and_tags(spark):
    good, fake, ignored, slow = evaluated(
        spark, turn(query="status of AUTH-12?", answer="AUTH-12 is open and assigned to Jane.", sources=[ticket("AUTH-12")]),
        turn(query="status?", answer="See ZZZ-99 and ZZZ-98 which are open.", sources=[ticket("AUTH-12")]),
        turn(query="tell me of it", answer="Lots of prose. " * 12, sources=[ticket("AUTH-12")]),
        turn(query="how many bugs", answer="15", total_time_s=99.0))
    assert good.failure_tags == [] and good.quality_grade == "GOLD" and good.training_signal == "qlora_positive" and good.validator_faith == 0.85
    assert "hallucination" in fake.failure_tags and "tool_misuse" in fake.failure_tags and fake.training_signal == "dpo_rejected"
    assert ignored.failure_tags == ["tool_misuse"] and ignored.quality_grade == "FAILED"
    assert slow.failure_tags == ["latency_breach"] and slow.answer_relevance == 0.85


def test_summary_states_differ(spark):
    none, empty, some = evaluated(
        spark, turn(answer="there are no results for this"), turn(answer="there are no results for this", summary=[]),
        turn(answer="there are no results for this", summary=[("jira", "get_issues", 1, ["AUTH-1: x"])]))
    penalty = lambda r: {c.name: c.penalty for c in r.checks}
    assert (penalty(none)["honest_empty"], penalty(none)["sentries_summary_coverage"]) == (-0.10, 0.0)
    assert penalty(empty)["sentries_summary_coverage"] == -0.05
    assert (penalty(some)["honest_empty"], penalty(some)["sentries_summary_coverage"]) == (0.0, 0.10)


@pytest.mark.parametrize(("answer", "want"), [
    ("short", 1.0), ("x" * 50, 1.0), ("In 2099 we will release this feature, surely so.", 0.0), ("Finally we ship it. But first we must test everything.", 0.0),
    ("after 2020 the work went on, and before 2025 it ended.", 1.0), ("before 2020 the work went on, and after 2025 it ended in 2026.", 0.5), ("step 1 do this, step 3 do that, step 2 do the other thing", 0.0)])
def test_temporal(spark, answer, want):
    assert spark.createDataFrame([(answer,)], "a string").select(evaluate.temporal_consistency(F.col("a"), 2025).alias("r")).first().r == want


def test_code_and_weights(spark):
    assert evaluate.parsed_share("```python\nimport os\n```\n```\ndef f(:\n```\n```\nls -l\n```") == 0.5 and evaluate.parsed_share("no code") is None
    rows = spark.createDataFrame([(1.0, 0.5, 1.0, None), (1.0, 0.5, 1.0, 0.0), (float("nan"), None, 1.0, float("nan"))], "f double, r double, t double, c double")
    assert [x.w for x in rows.select(evaluate.weighted_score(F.col("f"), F.col("r"), F.col("t"), F.col("c")).alias("w")).collect()] == [0.825, 0.625, 0.37]


@pytest.mark.parametrize(("q", "a", "want"), [("how many issues", "Answer: 15", 0.85), ("status of AUTH-1", "AUTH-1 is open", 1.0), ("status of AUTH-1", "it is open", 0.2), ("see !12", "it is !12", 1.0), ("see #12", "none", 0.3), ("", "x", 0.5), ("payment service outage", "the payment team", 0.5333)])
def test_relevance(spark, q, a, want):
    assert spark.createDataFrame([(q, a)], "q string, a string").select(evaluate.answer_relevance(F.col("q"), F.col("a")).alias("r")).first().r == want


def test_approximate_faithfulness(spark):
    rows = spark.createDataFrame([(1, "The cache is cleared every night. Bananas are yellow fruit indeed.", ["The cache is cleared every night at two."]), (2, "", [])], "id long, answer string, contexts array<string>")
    got = {r.id: r.faithfulness for r in evaluate.approximate_faithfulness(rows, "id", vectors.hash_embed).collect()}
    assert got == {1: 0.5, 2: 0.5}


def test_graph_paths_use_an_edge_once(spark):
    e = spark.createDataFrame([("t", "a", "BLOCKS", "t", "b"), ("t", "b", "RELATES_TO", "t", "c"), ("t", "a", "CLONES", "t", "c"), ("t", "c", "BLOCKS", "t", "d")], graph.EDGE)
    got = {(r.seed, r.neighbor, r.rel): r.distance for r in graph.expand(e, spark.createDataFrame([("a",)], "key string"), 3).collect()}
    assert got == {("a", "b", "BLOCKS"): 1, ("a", "c", "CLONES"): 1, ("a", "c", "BLOCKS"): 2, ("a", "b", "CLONES"): 2, ("a", "d", "CLONES"): 2, ("a", "d", "BLOCKS"): 3}
    chunks = spark.createDataFrame([("c", "c_chunk_1", 1), ("c", "c_chunk_0", 0), ("d", "d_chunk_0", 0)], "owner string, chunk_id string, chunk_index int")
    assert [(r.neighbor, r.rel, r.chunk_id) for r in graph.expand_chunks(e, spark.createDataFrame([("a",)], "key string"), chunks, 2, 2).collect()] == [("c", "CLONES", "c_chunk_0"), ("c", "BLOCKS", "c_chunk_0")]


def test_issue_edges_are_idempotent(spark):
    kind = "issue_key string, project_id string, assignee string, parent_key string, fix_versions array<string>, components array<string>, labels array<string>, issue_links array<struct<type:string,target:string>>"
    row = ("A-1", "A", "jane", "A-0", ["v1"], [], ["x", "x"], [("blocks", "A-2"), ("odd", "A-3")])
    once, twice = (graph.issue_edges(spark.createDataFrame([row] * n, kind)) for n in (1, 2))
    assert once.count() == twice.count() == 7
    assert {(r.rel, r.dst) for r in once.collect()} >= {("BLOCKS", "A-2"), ("RELATES_TO", "A-3"), ("CHILD_OF", "A-0"), ("HAS_LABEL", "x")}
    pages = spark.createDataFrame([("p", "s", [("r", "Root"), ("q", "Mid")])], "page_id string, space_id string, ancestors array<struct<id:string,title:string>>")
    assert graph.page_edges(pages).count() == 3


def test_ranking_quota(spark):
    hits = spark.createDataFrame([(i, f"c{i}", f"p{i % 4}", 1 - i / 20, False, i + 1) for i in range(12)] + [(20 + i, f"g{i}", f"q{i}", 0.1, True, 13 + i) for i in range(3)], "n long, chunk_id string, parent string, score double, from_graph boolean, position int")
    ranked = ranking.select_quota(ranking.rerank(ranking.diversify(hits, cap=2), lambda: F.col("score")), 8).orderBy("rank").collect()
    assert [r.chunk_id for r in ranked] == ["c0", "c1", "c2", "c3", "c4", "c5", "g0", "g1"]
    only = ranking.select_quota(ranking.rerank(hits.where("not from_graph"), lambda: F.col("score")), 3).count()
    assert only == 3


def test_vectors(spark):
    rows = spark.createDataFrame([(i, [math.cos(i / 10), math.sin(i / 10)], i % 2) for i in range(40)] + [(99, None, 0), (98, [], 1)], "vec_id long, embedding array<float>, label int")
    asked = rows.where("vec_id < 4").select(F.col("vec_id").alias("query_id"), "embedding")
    got = vectors.search_many(rows, asked, 2).collect()
    assert {r.query_id: 0 for r in got}.keys() == {0, 1, 2, 3} and all(abs(r.query_id - r.vec_id) <= 2 for r in got)
    assert [r.vec_id for r in vectors.search(rows, [1.0, 0.0], 3, where=F.col("label") == 1).collect()] == [1, 3, 5]
    q = vectors.quantized(rows.where("vec_id < 40")).first()
    assert max(abs(c * q.scale - x) for c, x in zip(q.codes, [1.0, 0.0])) < 0.01
    assert vectors.missing(rows).count() == 2 and vectors.dimension(rows).first().dimension == 2


def test_normalizers(spark):
    issue = "project_id long, project_name string, issue_id long, title string, description string, state string, author string, labels array<string>, web_url string, comments array<struct<author:string,body:string>>, milestone string"
    d = normalize.issues(spark.createDataFrame([(1, "P", 7, "T", "desc", "opened", None, None, "u", [("bob", "hi"), ("eve", None)], None)], issue)).first()
    assert d.document_id == "gitlab_issue_1_7" and d.content == "desc\n\nComment by bob: hi" and d.author == "unknown" and d.labels == [] and json.loads(d.metadata)["comment_count"] == 2
    page = spark.createDataFrame([("s", "SP", "9", "T", "<p>Hello&nbsp;you</p>", "current", "a", "", ["x", "y"], "A > B")], "space_id string, space_name string, page_id string, title string, content string, status string, author string, web_url string, labels array<string>, breadcrumb string")
    p = normalize.pages(page, "https://d").first()
    assert p.content == "Location: A > B\n\nHello you\n\nTags: x, y" and p.url == "https://d/wiki/spaces/SP/pages/9"
    code = spark.createDataFrame([(1, "P", "a/b.py", ".py", "main", "print()", 7)], "project_id long, project_name string, file_path string, extension string, ref string, content string, size_bytes int")
    assert normalize.code_files(code).first().document_id == "gitlab_code_1_a_b.py"


def test_sources(spark):
    with tempfile.TemporaryDirectory() as d:
        with open(os.path.join(d, "x.jsonl"), "w") as f:
            f.write('{"chunk_id":"a","embedding":[1.0],"source":"jira"}\nnot json\n{"chunk_id":"","embedding":[1.0]}\n{"chunk_id":"b"}\n')
        rows = landed.read(spark, "chunks", d).cache()
        assert landed.corrupt_count(rows).first().malformed == 1
        assert [r.chunk_id for r in landed.embedded(landed.good(rows)).collect()] == ["a"]
    tree = spark.createDataFrame([(1, "P", "g", "src/a.py", "blob", "main", "cHJpbnQoMSk="), (1, "P", "g", "src/b.py", "blob", "main", "AAECAwQF" * 40), (1, "P", "g", "src", "tree", "main", None)], "project_id long, project_name string, group_name string, path string, type string, ref string, content_base64 string").withColumn("web_url", F.lit("u"))
    got = landed.code_files(tree).collect()
    assert [(r.file_name, r.content, r.size_bytes) for r in got] == [("a.py", "print(1)", 8)]


def test_merges(spark):
    old = spark.createDataFrame([("a", 1, "old"), ("b", 5, "old")], "k string, t int, v string")
    new = spark.createDataFrame([("a", 1, "new"), ("b", 2, "new"), ("c", 1, "new")], "k string, t int, v string")
    first = sinks.upsert(old, new, ["k"], F.col("t"))
    assert {(r.k, r.v) for r in first.collect()} == {("a", "new"), ("b", "old"), ("c", "new")}
    assert {(r.k, r.v) for r in sinks.upsert(first, new, ["k"], F.col("t")).collect()} == {("a", "new"), ("b", "old"), ("c", "new")}
    docs = spark.createDataFrame([("d1",), ("d1_part_1",), ("d2",)], "document_id string")
    assert {r.document_id for r in sinks.replace_split(docs, spark.createDataFrame([("d1_part_1",), ("d1_part_2",)], "document_id string")).collect()} == {"d1_part_1", "d1_part_2", "d2"}


def test_catalogue(spark):
    assert len(catalogue.OPERATIONS) == 27
    with pytest.raises(KeyError):
        catalogue.build("jira", "nothing")
    with pytest.raises(TypeError):
        catalogue.build("jira", "get_issue", nope=1)
    assert catalogue.build("jira", "get_issues", project_key="AB", limit="7").limit == 7
    pages = spark.createDataFrame([("1", "Deploy guide", "x", "2024-01-01", "S"), ("2", "Other", "how to deploy", "2024-02-01", "S")], "page_id string, title string, content string, last_modified string, space_key string")
    assert [r.page_id for r in catalogue.search_with_fallback(pages, "deploy").collect()] == ["2", "1"]
    assert [r.page_id for r in catalogue.search_with_fallback(pages, "guide to deploy").collect()] == ["1"]
    sprints = spark.createDataFrame([(1, 10, "closed", "a"), (1, 11, "future", "b"), (1, 12, "active", "c"), (2, 13, "future", "e"), (2, 14, "future", "d")], "board_id int, sprint_id int, state string, start_date string")
    assert {r.board_id: r.sprint_id for r in catalogue.sprint_of(sprints).collect()} == {1: 12, 2: 14}
    names = catalogue.account_of(spark.createDataFrame([("Jane",), ("Bob Roe",), ("Zed",)], "name string"), spark.createDataFrame([("u1", "Jane Doe"), ("u2", "bob roe")], "account_id string, display_name string"))
    assert {r["name"]: r.account for r in names.collect()} == {"Jane": "u1", "Bob Roe": "u2", "Zed": "Zed"}


@pytest.mark.parametrize(("question", "rule", "operations"), [
    ("status of AUTH-1 and AUTH-2", "keys", ["get_issue", "get_issue"]), ("show pipelines", "pipelines", ["get_pipelines"]), ("commits of the app", "commits", ["get_commits"]), ("diff of !12", "reference", ["get_mr_diff", "get_merge_requests"]),
    ("which branches are there", "branches", ["get_branches"]), ("recent wiki pages", "recent_pages", ["get_recent_pages"]), ("zzz", None, [])])
def test_routes(spark, question, rule, operations):
    q = spark.createDataFrame([("1", question, "g/app", None, None)], "question_id string, question string, gitlab_project string, jira_project string, last_key string")
    r = routing.route(q).first()
    assert (r.rule, [c.operation for c in r.calls]) == (rule, operations)


def test_registry_resolution(spark):
    q = spark.createDataFrame([("1", "issues of billing core please"), ("2", "AUTH-7 in shop")], "question_id string, question string")
    projects = spark.createDataFrame([("g/billing", "billing", False), ("g/billing-core", "billing core", False), ("x/shop", "shop", True), ("y/shop", "shop", False)], "path string, name string, preferred boolean")
    aliases = spark.createDataFrame([("BIL", "billing", "alias"), ("SHOP", "shop", "name")], "project_key string, alias string, kind string")
    got = {r.question_id: (r.gitlab_project, r.jira_project) for r in routing.resolve_projects(q, projects, aliases).collect()}
    assert got == {"1": ("g/billing-core", "BIL"), "2": ("x/shop", "SHOP")}


def test_context(spark):
    assert spark.range(1).select(context.source_budget(F.lit(1)).alias("a"), context.source_budget(F.lit(60)).alias("b")).first() == Row(a=2000, b=442)
    long = spark.createDataFrame([("x" * 20_000,)], "c string").select(context.cap(F.col("c"), 12_000).alias("r")).first().r
    assert len(long) == 12_000 + len(context.MARK)


def test_datasets(spark):
    turns = spark.createDataFrame([("1", "Hi", "a" * 90, 0.9, "GOLD", "qlora_positive", []), ("2", " hi ", "b" * 90, 0.95, "GOLD", "qlora_positive", []), ("3", "q", "c", 0.2, "FAILED", "dpo_rejected", ["hallucination"]), ("4", "r", "d" * 99, 0.2, "FAILED", "neutral", ["retrieval_miss"])], "turn_id string, query string, answer string, weighted_score double, quality_grade string, training_signal string, failure_tags array<string>")
    assert [r.turn_id for r in datasets.positives(turns).collect()] == ["2", "1"] and [r.turn_id for r in datasets.preference_candidates(turns).collect()] == ["3"]
    rows = datasets.training_rows(datasets.positives(turns), F.lit("s"), [F.desc("weighted_score")])
    assert [r.turn_id for r in rows.collect()] == ["2"]
    assert datasets.split(rows, "turn_id").first().split == datasets.split(rows, "turn_id").first().split
    averages = spark.createDataFrame([("overall", 0.9, 0.8), ("sentries", 0.7, 0.8)], "intent string, faithfulness double, score double")
    base = spark.createDataFrame([("v", 0.79, 0.9)], "version string, score double, faithfulness double")
    assert datasets.gates(averages, base).first().reason == "live_faithfulness"
    assert datasets.gates(averages.where("intent = 'overall'"), base).first().deploy
    assert datasets.gates(averages.where("intent = 'overall'"), base.limit(0)).first().deploy
    f1 = spark.createDataFrame([("cat cat dog", "cat dog dog"), ("", "x"), ("the", "the")], "a string, b string").select(datasets.token_f1(F.col("a"), F.col("b")).alias("r")).collect()
    assert [r.r for r in f1] == [0.6667, 0.0, 0.0]


def test_serving(spark):
    assert spark.createDataFrame([("", "https://x/browse/AB-1")], "k string, u string").select(serving.key_from_url(F.col("k"), F.col("u")).alias("r")).first().r == "AB-1"
    scored = spark.createDataFrame([("1", None, None, 1), ("2", None, None, 2)], "turn_id string, training_signal string, weighted_score double, timestamp int")
    chosen = spark.createDataFrame([("2", "better")], "turn_id string, chosen string")
    assert [(r.turn_id, r.chosen) for r in serving.review_queue(scored, chosen).orderBy("turn_id").collect()] == [("1", None), ("2", "better")]


def test_every_link_is_checked(spark):
    good = " ".join(f"https://tracker.example.com/browse/{i}" for i in range(20))
    rows = [(1, good), (2, good + " http://bad http://worse"), (3, "http://bad " + good)]
    no_sources = "array<struct<source:string,title:string,url:string,issue_key:string,from_graph:boolean,score:double>>"
    df = spark.createDataFrame(rows, "id long, answer string").select("id", F.explode(evaluate.validator_checks(F.lit("links?"), F.col("answer"), F.lit(None).cast(no_sources), F.lit(None).cast("array<struct<source:string,operation:string,count:bigint,titles:array<string>>>"))).alias("c"))
    got = {r.id: (round(r.c.penalty, 6), r.c.note) for r in df.where("c.name = 'url_validity'").collect()}
    assert got == {1: (0.0, "ok"), 2: (round(0.3 * 2 / 22, 6), "suspicious_urls"), 3: (round(0.3 / 21, 6), "suspicious_urls")}


def test_approximate_faithfulness_reads_whole_contexts(spark):
    filler = " ".join(f"word{i}" for i in range(1500))
    rows = spark.createDataFrame([(1, "The cache is cleared every night.", [filler + " " * 200 + "The cache is cleared every night."])], "id long, answer string, contexts array<string>")
    assert evaluate.approximate_faithfulness(rows, "id", vectors.hash_embed).first().faithfulness == 1.0


@pytest.mark.parametrize("last", [1, 3, 50])
def test_rolling_series_spreads_a_group(spark, last):
    import random

    rng = random.Random(last)
    kinds = ["big"] * 40 + ["small", None]
    rows = [(rng.choice(kinds), rng.choice([None, *range(300)]), i, float(rng.randint(0, 99))) for i in range(1500)]
    df = spark.createDataFrame(rows, "kind string, ts int, id long, value double")
    got = evaluate.rolling_series(df, "kind", "ts", "value", "id", last, large=100)
    plain = evaluate.rolling_series(df, "kind", "ts", "value", "id", last)
    assert sorted(map(tuple, plain.select("id", "rolling").collect())) == sorted(map(tuple, got.select("id", "rolling").collect()))
    want = {}
    for kind in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == kind), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        for i, r in enumerate(mine):
            seen = [x[3] for x in mine[max(0, i - last + 1) : i + 1]]
            want[r[2]] = round(sum(seen) / len(seen), 6)
    assert got.columns == [*df.columns, "rolling"] and {r.id: round(r.rolling, 6) for r in got.collect()} == want and got.count() == len(rows)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        spread = got.where("kind = 'big'").groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.sum("rolling").alias("read")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(r.n for r in spread) < 1200 < sum(r.n for r in spread), spread


def test_drained_streams_stay_out_of_the_driver(spark, sf_dir):
    from kelpie import queries

    out = queries.st1_event_windows(spark, sf_dir)
    assert out.inputFiles() and out.count() == queries.st1_event_windows(spark, sf_dir).count() > 0


def test_copies_of_a_vector_hand_on_k_rows():
    """Of rows of equal score a batch hands on the first k by id for each query, however many there are."""
    n = 1_000
    i, j = np.repeat(np.arange(3), n), np.tile(np.arange(n), 3)
    score = np.where(i == 1, (j % 2) / 8, 0.5)
    kept = vectors.first_of_ties(i, j, score, n - 1 - np.arange(n), 4)
    assert len(kept) == 4 + 8 + 4
    assert sorted(j[kept][i[kept] == 0].tolist()) == [996, 997, 998, 999] and sorted(j[kept][i[kept] == 1].tolist()) == [992, 993, 994, 995, 996, 997, 998, 999]
