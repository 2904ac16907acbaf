import json

from pyspark.sql import functions as F

from kelpie.functions import text
from kelpie.operators import datasets, evaluate, graph, vectors
from kelpie.plans import catalogue

TREE = {"type": "doc", "content": [{"type": "paragraph", "content": [{"type": "text", "text": "see"}, {"type": "mention", "attrs": {"text": "@jane"}}, {"type": "text", "text": "docs", "marks": [{"type": "link", "attrs": {"href": "http://d"}}]}]}]}


def test_rich_text(spark):
    rows = spark.createDataFrame([(json.dumps(TREE),), (" plain ",), (None,), ("{broken",)], "c string")
    assert [r.r for r in rows.select(text.adf_text(F.col("c")).alias("r")).collect()] == ["see @jane docs [http://d]\n", "plain", "", "{broken"]
    assert [r.r for r in rows.select(text.adf_shallow(F.col("c")).alias("r")).collect()][:2] == ["see docs", ""]
    ids = spark.createDataFrame([("jira_issue_AB-1_part_2",), ("confluence_page_77",)], "p string").select(text.issue_key_of(F.col("p")).alias("k"), text.page_id_of(F.col("p")).alias("g")).collect()
    assert [(r.k, r.g) for r in ids] == [("AB-1", ""), ("", "77")]


def test_enriched_search_and_links(spark):
    chunks = spark.createDataFrame([("c1", [1.0, 0.0], "jira", "Shop", "AB-1", None), ("c2", [0.9, 0.1], "confluence", "Shop", None, "77"), ("c3", [1.0, 0.0], "jira", "Other", "AB-2", None)], "chunk_id string, embedding array<float>, source string, project_name string, issue_key string, page_id string")
    tickets = spark.createDataFrame([("AB-1", "High", "jane", "open")], "issue_key string, priority string, assignee string, status string")
    pages = spark.createDataFrame([("77", "A > B")], "page_id string, breadcrumb string")
    got = {r.chunk_id: (r.priority, r.breadcrumb) for r in vectors.search_enriched(chunks, [1.0, 0.0], tickets, pages, 5, project="shop").collect()}
    assert got == {"c1": ("High", None), "c2": (None, "A > B")}
    e = spark.createDataFrame([("ticket", "AB-1", "BLOCKS", "ticket", "AB-9"), ("ticket", "AB-1", "BLOCKS", "ticket", "AB-8"), ("ticket", "AB-1", "HAS_LABEL", "label", "x")], graph.EDGE)
    assert graph.ticket_links(tickets, e, ["ab-1"]).first().relations == {"BLOCKS": ["AB-8", "AB-9"], "HAS_LABEL": ["x"]}
    assert graph.pending(tickets, tickets, "issue_key").count() == 0


def test_scores_and_gates(spark):
    row = spark.createDataFrame([("qwen2.5-7b", "adapter of Qwen2.5 7B", "llama 8b", float("nan"), 0.4)], "b string, a string, x string, j double, p double")
    r = row.select(datasets.compatible(F.col("b"), F.col("a")).alias("yes"), datasets.compatible(F.col("b"), F.col("x")).alias("no"), evaluate.ladder(F.col("j"), F.col("p"), F.lit(2)).alias("l"), evaluate.ladder(F.col("j"), F.col("p"), F.lit(0)).alias("z")).first()
    assert (r.yes, r.no, r.l, r.z) == (True, False, 0.4, 0.3)
    same = spark.createDataFrame([("the cache is full", "the cache is full")], "q string, a string").select(evaluate.approximate_relevance(F.col("q"), F.col("a"), vectors.hash_embed).alias("r")).first().r
    assert same == 1.0
    scored = spark.createDataFrame([("1", "GOLD", 1, 0.8, 1.0, None), ("2", "FAILED", 2, 0.2, 1.0, None)], "turn_id string, quality_grade string, timestamp int, answer_relevance double, temporal_consistency double, code_correctness double")
    assert datasets.post_promotion(scored).first().samples == 2
    assert {x.quality_grade: x.percent for x in datasets.grade_shares(scored).collect()} == {"GOLD": 50.0, "FAILED": 50.0}
    assert datasets.reference_eval_set(spark).count() == 5


def test_catalogue_status(spark):
    ops = spark.createDataFrame([tuple(k.split(".")) for k in catalogue.OPERATIONS], "source string, operation string")
    calls = spark.createDataFrame([("jira", "get_issue", True), ("jira", "get_issue", False)], "source string, operation string, success boolean")
    assert catalogue.status(ops, calls).where("failures = 1").count() == 1
    s = spark.createDataFrame([([("s1",), ("s2",)],), ([],)], "s array<struct<name:string>>").select(catalogue.sprint_name(F.col("s")).alias("r")).collect()
    assert [x.r for x in s] == ["s2", None]


def test_token_f1_both_ways(spark):
    rows = [(1, "red red blue", "red blue green"), (2, "", "x"), (3, None, None), (4, "the of", "red"), (5, "b a b a", "a b b b"), (6, "same", "same"), (7, "x" * 300, "y")]
    df = spark.createDataFrame(rows, "id long, a string, b string")
    short = {r.id: r.f for r in df.select("id", datasets.token_f1(F.col("a"), F.col("b")).alias("f")).collect()}
    assert short == {r.id: r.f1 for r in datasets.token_f1_rows(df, ["id"], "a", "b").collect()} == {1: 0.6667, 2: 0.0, 3: 0.0, 4: 0.0, 5: 0.8, 6: 1.0, 7: 0.0}


def test_closest_on_the_threshold(spark):
    """A cosine that is 0.97 in whole numbers is 0.97, not the next double, however the letters are dealt."""
    import itertools

    a, b = (9, 4, 1, 1, 1, 0, 0), (9, 3, 2, 1, 1, 2, 0)  # both of squared length 100, product 97
    rows = [(i, 0, [float(k * a[x]) for x in p], [float(b[x]) for x in p]) for i, (k, p) in enumerate((k, p) for k in (1, 3) for p in itertools.islice(itertools.permutations(range(7)), 0, None, 97))]
    table = spark.createDataFrame(rows, "id long, n int, a array<double>, b array<double>")
    found = evaluate.closest(table.select("id", F.col("n").alias("s"), "a"), table.select("id", F.col("n").alias("w"), "b"), "id").collect()
    assert len(found) == len(rows) and {r.best for r in found} == {0.97}
