"""Single operators on literal rows, with the results written out in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cases import case
from kelpie.functions import text
from kelpie.operators import datasets, evaluate, graph, ranking, serving
from kelpie.sources import landed, sinks


_TREES = [
    (1, '{"type":"doc","content":[{"type":"paragraph","content":[{"type":"text","text":"Hello"},{"type":"mention","attrs":{"text":"@jo"}}]},{"type":"rule"},{"type":"paragraph","content":[{"type":"text","text":"see","marks":[{"type":"link","attrs":{"href":"http://x"}}]}]}]}'),
    (2, '{"type":"doc","content":[]}'), (3, "  plain "), (4, "{broken"), (5, None)]


@case("SELECT * FROM (VALUES (1, 'Hello @jo' || chr(10) || ' ' || chr(10) || ' see [http://x]' || chr(10)), (2, ''), (3, 'plain'), (4, '{broken'), (5, '')) AS t(id, text)")
def n8_rich_text(spark):
    return spark.createDataFrame(_TREES, "id int, j string").select("id", text.adf_text(F.col("j")).alias("text"))


@case("SELECT * FROM (VALUES (1, 'Hello see'), (2, ''), (3, ''), (4, ''), (5, ''), (6, repeat('x', 500))) AS t(id, text)")
def n9_shallow_text(spark):
    rows = [*_TREES, (6, '{"content":[{"content":[{"type":"text","text":"' + "x" * 501 + '"}]}]}')]
    return spark.createDataFrame(rows, "id int, j string").select("id", text.adf_shallow(F.col("j")).alias("text"))


@case("""SELECT * FROM (VALUES (1, 'one  two'), (2, '"version" 1'), (3, ''), (4, repeat('y', 400))) AS t(id, text)""")
def n10_atlas_comment(spark):
    rows = [(1, '[{"type":"text","text":"one"},{"type":"text","text":"two"}]'), (2, '{"type":"doc","version":1}'), (3, None), (4, '{"type":"text","text":"' + "y" * 450 + '"}')]
    return spark.createDataFrame(rows, "id int, j string").select("id", text.atlas_comment(F.col("j")).alias("text"))


@case("""SELECT * FROM (VALUES ('a/b.py', 'python'), ('a/B.TSX', 'typescript'), ('Dockerfile', 'dockerfile'), ('x/Makefile', 'makefile'), ('x/.gitlab-ci.yml', 'yaml'), ('docker-compose.override', 'yaml'),
 ('api.dockerfile', 'api.dockerfile'), ('a/b.unknown', 'text'), ('LICENSE', 'text')) AS t(path, language)""")
def n12_languages(spark):
    paths = ["a/b.py", "a/B.TSX", "Dockerfile", "x/Makefile", "x/.gitlab-ci.yml", "docker-compose.override", "api.dockerfile", "a/b.unknown", "LICENSE"]
    name = F.element_at(F.split("path", "/"), -1)
    return spark.createDataFrame([(p,) for p in paths], "path string").select("path", text.language_of(F.col("path"), text.extension_of(name)).alias("language"))


@case("""SELECT * FROM (VALUES ('jira_issue_AB-1_part_12', 'jira_issue_AB-1', 'AB-1', ''), ('jira_issue_AB-1', 'jira_issue_AB-1', 'AB-1', ''), ('confluence_page_77_part_0', 'confluence_page_77', '', '77'),
 ('x_part_1_part_2', 'x_part_1', '', ''), ('a_part_b', 'a_part_b', '', ''), ('', '', '', '')) AS t(id, base, issue_key, page_id)""")
def n13_ids(spark):
    ids = ["jira_issue_AB-1_part_12", "jira_issue_AB-1", "confluence_page_77_part_0", "x_part_1_part_2", "a_part_b", ""]
    c = F.col("id")
    return spark.createDataFrame([(i,) for i in ids], "id string").select("id", text.base_id(c).alias("base"), text.issue_key_of(c).alias("issue_key"), text.page_id_of(c).alias("page_id"))


@case("SELECT * FROM (VALUES (1, 'Not set'), (2, 'Not set'), (3, '***'), (4, '1234...5678'), (5, 'abcd...wxyz')) AS t(id, masked)")
def n19_masked(spark):
    return spark.createDataFrame([(1, None), (2, ""), (3, "1234567"), (4, "12345678"), (5, "abcdefghwxyz")], "id int, s string").select("id", text.mask(F.col("s")).alias("masked"))


@case("SELECT * FROM (VALUES (1, 'ab'), (2, 'a  b'), (3, '<think>open'), (4, '')) AS t(id, said)")
def n22_without_thoughts(spark):
    rows = [(1, "a<think>x\ny</think>b"), (2, " a <think>1</think><think>2</think> b "), (3, "<think>open"), (4, None)]
    return spark.createDataFrame(rows, "id int, s string").select("id", text.strip_think(F.col("s")).alias("said"))


@case("SELECT * FROM (VALUES ('AB-1', 'AB-9'), ('AB-2', 'AB-8'), ('AB-4', NULL)) AS t(issue_key, epic_link)")
def s8_active_tickets(spark):
    rows = [("AB-1", "AB-9", "AB-8", None), ("AB-2", None, "AB-8", False), ("AB-3", "AB-9", None, True), ("AB-4", None, None, False)]
    return landed.flat_tickets(spark.createDataFrame(rows, "issue_key string, epic_link string, epic_parent string, archived boolean")).select("issue_key", "epic_link")


@case("SELECT * FROM (VALUES (1, 'a,b', 2), (2, '', 0), (3, '', 0)) AS t(id, authors, n)")
def s5_user_comments(spark):
    rows = [(1, [("a", "x", None, False), ("bot", "y", None, True), ("b", "z", None, None)]), (2, [("bot", "y", None, True)]), (3, [])]
    kept = landed.user_comments(spark.createDataFrame(rows, "id int, " + landed.COMMENTS))
    return kept.select("id", F.array_join(F.transform("comments", lambda c: c["author"]), ",").alias("authors"), F.size("comments").alias("n"))


@case("SELECT * FROM (VALUES ('1', 'Home > Guide'), ('2', ''), ('3', '')) AS t(page_id, breadcrumb)")
def s11_breadcrumbs(spark):
    rows = [("1", [("a", "Home"), ("b", "Guide")]), ("2", []), ("3", None)]
    return landed.with_breadcrumb(spark.createDataFrame(rows, "page_id string, ancestors array<struct<id:string,title:string>>")).select("page_id", "breadcrumb")


@case("SELECT * FROM (VALUES ('a_part_0', 'new'), ('a_part_1', 'new'), ('b', 'new'), ('c', 'old')) AS t(document_id, text)")
def k2_split_replaced(spark):
    """A whole document gives way to its parts, and parts to the whole."""
    old = spark.createDataFrame([("a", "old"), ("b_part_0", "old"), ("b_part_1", "old"), ("c", "old")], "document_id string, text string")
    return sinks.replace_split(old, spark.createDataFrame([("a_part_0", "new"), ("a_part_1", "new"), ("b", "new")], "document_id string, text string"))


@case("""SELECT * FROM (VALUES ('3', 'IN_SPACE', 'space', 'S'), ('3', 'CHILD_OF', 'page', '1'), ('3', 'CHILD_OF', 'page', '2'), ('2', 'IN_SPACE', 'space', 'S'), ('2', 'CHILD_OF', 'page', '1')) AS t(src, rel, dst_type, dst)""")
def g5_page_edges(spark):
    rows = [("3", "S", [("1", "a"), ("2", "b"), ("2", "b")]), ("2", "S", [("1", "a"), ("", "none")]), ("1", None, None)]
    return graph.page_edges(spark.createDataFrame(rows, "page_id string, space_id string, ancestors array<struct<id:string,title:string>>")).select("src", "rel", "dst_type", "dst")


@case("SELECT * FROM (VALUES ('1', 'CHILD_OF', 1, 'c10'), ('4', 'CHILD_OF', 2, 'c41')) AS t(neighbor, rel, distance, chunk_id)")
def g8_page_chunks(spark):
    """Two steps either way from page 2: its parent 1 and, through it, 4; 5 has no chunk, 6 is three steps away, 7 is not under a page."""
    pairs = [("2", "CHILD_OF", "1"), ("4", "CHILD_OF", "1"), ("5", "CHILD_OF", "1"), ("6", "CHILD_OF", "4"), ("2", "IN_SPACE", "7")]
    e = spark.createDataFrame([("page", s, r, "page", d) for s, r, d in pairs], "src_type string, src string, rel string, dst_type string, dst string")
    chunks = spark.createDataFrame([("1", "c11", 1), ("1", "c10", 0), ("4", "c41", 3), ("6", "c60", 0), ("7", "c70", 0)], "owner string, chunk_id string, chunk_index int")
    return graph.expand_chunks(e, spark.createDataFrame([("2",)], "key string"), chunks, rels=["CHILD_OF"]).drop("seed")


@case("SELECT * FROM (VALUES (1, 'd1'), (2, 'd2'), (3, 'h3')) AS t(rank, chunk_id)")
def h10_direct_first(spark):
    """Named tickets first; hits on the same ticket or chunk fall; the rest up to k."""
    schema = "issue_key string, chunk_id string, score double"
    direct = spark.createDataFrame([("AB-1", "d1", 1.0), ("AB-2", "d2", 0.5)], schema)
    hybrid = spark.createDataFrame([("AB-1", "h1", 0.99), ("AB-5", "d2", 0.98), ("AB-3", "h3", 0.9), ("AB-4", "h4", 0.8)], schema)
    return ranking.with_direct(direct, hybrid, 3).select("rank", "chunk_id")


@case("SELECT * FROM (VALUES (1, 'long enough a snippet'), (2, 'found again'), (3, '')) AS t(id, contexts)")
def x1_contexts(spark):
    turns = spark.createDataFrame([(1, [("long enough a snippet",), ("short",)]), (2, [("fifteen letters",)]), (3, [])], "id int, context_snippets array<struct<text:string>>")
    again = spark.createDataFrame([(1, ["unused"]), (2, ["found again"])], "id int, snippets array<string>")
    return evaluate.context_of(turns, again, "id").select("id", F.array_join("contexts", "|").alias("contexts"))


_SCORED = [  # turn, score, grade, signal, tags, error, answer, second
    ("a", 0.95, "GOLD", "qlora_positive", ["ok"], None, "x", 1), ("b", 0.80, None, "qlora_positive", [], "", "x", 2), ("c", 0.79, "GOLD", "qlora_positive", [], None, "x", 3), ("d", 0.90, "SILVER", "qlora_positive", [], None, "x", 4),
    ("e", 0.10, "FAILED", "dpo_rejected", ["hallucination", "slow"], None, "x", 5), ("f", 0.20, "FAILED", "dpo_rejected", ["slow"], None, "x", 6), ("g", 0.05, None, "dpo_rejected", None, None, "x", 7), ("h", 0.30, "FAILED", None, ["tool_misuse"], None, "x", 8),
    ("i", None, None, None, None, None, "x", 9), ("j", None, None, None, None, "down", "x", 10), ("k", None, None, None, None, "", "", 11), ("l", None, None, None, None, "", "x", 12)]


def _scored(spark):
    rows = spark.createDataFrame(_SCORED, "turn_id string, weighted_score double, quality_grade string, training_signal string, failure_tags array<string>, error string, answer string, s int")
    return rows.withColumn("timestamp", F.timestamp_seconds(F.col("s") + 1_700_000_000)).withColumn("total_time_s", F.col("s").cast("double")).withColumn("faithfulness", F.col("weighted_score"))


@case("SELECT * FROM (VALUES ('a'), ('b')) AS t(turn_id)")
def d1_positives(spark):
    return datasets.positives(_scored(spark)).select("turn_id")


@case("SELECT * FROM (VALUES ('g'), ('e'), ('h')) AS t(turn_id)")
def d2_preferences(spark):
    return datasets.preference_candidates(_scored(spark)).select("turn_id")


@case("SELECT * FROM (VALUES ('i'), ('h'), ('g'), ('f')) AS t(turn_id)")
def d4_seeds(spark):
    return datasets.seeds(_scored(spark), limit=4).select("turn_id")


@case("SELECT CAST(12 AS BIGINT) AS total, CAST(8 AS BIGINT) AS evaluated, CAST(4 AS BIGINT) AS positive, CAST(3 AS BIGINT) AS rejected, CAST(2 AS BIGINT) AS gold, CAST(3 AS BIGINT) AS failed, CAST(0.5113 AS DOUBLE) AS mean_score")
def d5_stats(spark):
    return datasets.stats(_scored(spark))


@case("SELECT tag, CAST(n AS BIGINT) AS n FROM (VALUES ('ok', 1), ('hallucination', 1), ('slow', 2), ('tool_misuse', 1)) AS t(tag, n)")
def d5_tags(spark):
    return datasets.tag_counts(_scored(spark))


_VERSIONS = [("v1", "deployed", 0.7, 0.8, 1), ("v2", "deployed", 0.6, 0.9, 3), ("v3", "rejected", 0.9, 0.9, 4)]


@case("SELECT 'v2' AS version, CAST(0.6 AS DOUBLE) AS score, CAST(0.9 AS DOUBLE) AS faithfulness")
def d8_baseline(spark):
    return datasets.baseline(spark.createDataFrame(_VERSIONS, "version string, status string, score double, faithfulness double, deployed_at int"))


@case("SELECT * FROM (VALUES ('v3', false), ('v2', true)) AS t(version, production)")
def d15_runs(spark):
    metrics = spark.createDataFrame([("v1", 1), ("v2", 2), ("v3", 3)], "version string, started_at int")
    return serving.runs(metrics, spark.createDataFrame([("v2",)], "version string"), limit=2).select("version", "production")


@case("SELECT * FROM (VALUES ('l'), ('i')) AS t(turn_id)")
def x16_unscored(spark):
    return evaluate.unscored(_scored(spark)).select("turn_id")


@case("SELECT CAST(n AS INTEGER) AS n, version, CAST(score AS DOUBLE) AS score FROM (VALUES (1, 'v0', 0.4), (1, 'baseline', 0.5113), (2, 'baseline', 0.4)) AS t(n, version, score)")
def x16_first_baseline(spark):
    """Added to a registry without one; left alone where there is one."""
    one = lambda n, name: evaluate.baseline_if_absent(spark.createDataFrame([(name, 0.4, 0.4)], "version string, score double, faithfulness double"), _scored(spark)).select(F.lit(n).alias("n"), "version", "score")
    return one(1, "v0").unionByName(one(2, "baseline"))


@case("SELECT * FROM (VALUES (1, 'AB-1'), (2, 'CD-22'), (3, NULL), (4, NULL), (5, 'EF-3')) AS t(id, key)")
def a3_keys_from_urls(spark):
    rows = [(1, "AB-1", "http://j/browse/CD-2"), (2, "", "http://j/browse/CD-22?x=1"), (3, None, "http://j/CD-2"), (4, None, None), (5, None, "http://j/browse/EF-3/x")]
    return spark.createDataFrame(rows, "id int, key string, url string").select("id", serving.key_from_url(F.col("key"), F.col("url")).alias("key"))


@case("SELECT CAST(n AS INTEGER) AS n, turn_id, chosen FROM (VALUES (1, 'e', 'better'), (1, 'f', NULL), (1, 'g', NULL), (2, 'l', NULL), (2, 'k', NULL)) AS t(n, turn_id, chosen)")
def a4_review_queue(spark):
    """The rejected; where there are none, the newest that were not scored."""
    scored, chosen = _scored(spark), spark.createDataFrame([("e", "better"), ("a", "unused")], "turn_id string, chosen string")
    one = lambda n, rows, most: serving.review_queue(rows, chosen, most).select(F.lit(n).alias("n"), "turn_id", "chosen")
    return one(1, scored, 200).unionByName(one(2, scored.where("coalesce(training_signal, '') <> 'dpo_rejected'"), 2))


@case("SELECT * FROM (VALUES ('a', 'excluded'), ('b', 'filtered'), ('c', 'ready')) AS t(turn_id, status)")
def a5_training_queue(spark):
    rows = spark.createDataFrame([("a", ["short_answer"]), ("b", ["short_answer"]), ("c", [])], "turn_id string, reasons array<string>")
    return serving.training_queue(rows, spark.createDataFrame([("a",), ("a",), ("z",)], "turn_id string")).select("turn_id", "status")
