import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from kelpie.functions import chunking, intent, text


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(f(F.col("c")).alias("r")).first().r


def test_html_orders(spark):
    assert one(spark, "&lt;b&gt;x&lt;/b&gt; <i>y</i>&#160;&foo; z", text.strip_html) == "x y z"
    assert one(spark, "&lt;b&gt;x <i>y</i>", text.storage_text) == "<b>x y"
    assert one(spark, None, text.strip_html) == ""


def test_clean_and_ids(spark):
    assert one(spark, "  a\n\n\n\nb   c \n", text.clean_text) == "a\n\nb c"
    assert one(spark, "jira_issue_A-1_part_12", text.base_id) == "jira_issue_A-1"
    assert one(spark, "abc", text.point_id) == int(hashlib.md5(b"abc").hexdigest()[:15], 16)
    assert one(spark, "  Hi There ", text.query_hash) == hashlib.md5(b"hi there").hexdigest()
    assert one(spark, "a<think>x\ny</think>b", text.strip_think) == "ab"
    assert one(spark, "Is Blocked By", text.link_relation) == "BLOCKED_BY" and one(spark, "odd", text.link_relation) == "RELATES_TO"
    assert one(spark, '{"a":{"text":"one"},"b":[{"text":"two"}]}', text.atlas_text) == "one two"


def test_scores(spark):
    assert one(spark, float("nan"), text.safe_score, "double") == 0.3 and one(spark, None, text.safe_score, "double") == 0.3
    assert one(spark, -800.0, text.sigmoid, "double") == 0.0


def test_languages(spark):
    rows = [("a/b.py", ".py", "python"), ("Dockerfile", "", "dockerfile"), ("x/.gitlab-ci.yml", ".yml", "yaml"), ("a.unknown", ".unknown", "text"), ("docker-compose.prod.yml", ".yml", "yaml")]
    got = spark.createDataFrame(rows, "p string, e string, want string").select(text.language_of(F.col("p"), F.col("e")).alias("r"), "want").collect()
    assert all(r.r == r.want for r in got)
    files = spark.createDataFrame([("src/a.py", True), ("node_modules/a.py", False), ("a.bin", False), ("Makefile", False), ("Gemfile", True), ("package-lock.json", False)], "p string, want boolean").select(text.is_code_file(F.col("p")).alias("r"), "want").collect()
    assert all(r.r == r.want for r in files)


def reference_chunks(t, size, overlap):
    """The rule as stated: ends at the last break inside the window; steps back by the overlap."""
    out, start = [], 0
    while start < len(t):
        end = start + size
        if end < len(t):
            for needle in ("\n\n", ". ", " "):
                pos = t.rfind(needle, start, end)
                if pos > start:
                    end = pos + (needle == ". ")
                    break
        if t[start:end].strip():
            out.append(t[start:end].strip())
        nxt = end - overlap if end - overlap > 0 else end
        assert nxt > start, "the rule does not move on"
        start = nxt
    return out


def test_chunks_follow_the_rule_and_always_end():
    rng = random.Random(1)
    same = 0
    for _ in range(300):
        t = "".join(rng.choices(["word ", "a. ", "\n\n", "longerword", "x"], k=rng.randint(0, 400)))
        try:
            want = reference_chunks(t, 120, 30)
        except AssertionError:
            chunking.chunk_text(t, 120, 30)
            continue
        if t.strip():
            assert chunking.chunk_text(t, 120, 30) == want
            same += 1
    assert same > 100
    assert chunking.chunk_text("x " + "y" * 5000, 120, 30)[-1]
    assert chunking.chunk_text(None) == [] and chunking.chunk_text(" \n ") == []


def test_chunk_documents_and_resume(spark):
    docs = spark.createDataFrame([("d1", "T", "word " * 3000), ("d2", None, ""), ("d3", "only", None)], "document_id string, title string, content string")
    rows = chunking.chunk_documents(docs).collect()
    mine = [r for r in rows if r.parent_document_id == "d1"]
    assert [r.chunk_index for r in mine] == list(range(mine[0].total_chunks)) and mine[0].text == "T" and mine[1].text.startswith("word")
    assert [r.text for r in rows if r.parent_document_id == "d3"] == ["only"]
    assert chunking.chunk_documents(docs, done=docs.where("document_id = 'd1'")).where("parent_document_id = 'd1'").count() == 0
    spark.udtf.register("chunk_text", chunking.ChunkText)
    assert spark.sql("SELECT count(*) AS n FROM chunk_text(repeat('word ', 3000))").first().n == len(chunking.chunk_text("word " * 3000))
    big = chunking.split_large(docs, size=1000)
    assert "".join(r.content for r in big.where("original_document_id = 'd1'").orderBy("part_number").collect()) == "word " * 3000


def test_sentences(spark):
    got = one(spark, "Short. This one is long enough! And this is another one? No", text.sentences)
    assert got == [s for s in re.split(r"(?<=[.!?])\s+", "Short. This one is long enough! And this is another one? No") if len(s) > 15]


@pytest.mark.parametrize(("q", "want"), [
    ("show open issues for the app", "sentries"), ("how to configure oauth", "rag"), ("explain AUTH-12", "both"), ("AUTH-12", "sentries"), ("what does main.py do", "sentries"), ("hello", "both"),
    ("montre les tâches ouvertes", "sentries"), ("explique le tutoriel", "rag"), ("give me a summary of the design and open bugs", "both"),
])
def test_intents(spark, q, want):
    assert one(spark, q, intent.route_of) == want


def test_values_in_questions(spark):
    assert one(spark, "tickets In Progress, urgent", intent.status_of) == "In Progress"
    assert one(spark, "highest priority", intent.priority_of) == "Highest"
    assert one(spark, "bugs reported by Jane Doe", intent.reporter_name) == "Jane Doe"
    assert one(spark, "on March 5, 2024 we", intent.iso_date) == "2024-03-05" and one(spark, "5 march 2024", intent.iso_date) is None and one(spark, "Sep 7 2024", intent.iso_date) == "2024-09-07"
    b = one(spark, "created after 2024-01-02 before 2024-02-03", intent.date_bounds)
    assert (b.after, b.before) == ("2024-01-02", None)
    assert one(spark, "how many bugs", intent.only_counts) and not one(spark, "how many bugs, list them", intent.only_counts)
    assert one(spark, "AUTH-1", intent.without_keys) == "AUTH-1" and one(spark, "explain AUTH-1 please", intent.without_keys) == "explain please"
    assert one(spark, "x --hops 3", lambda c: intent.flag(c, "hops")) == "3"


def test_chunk_documents_keeps_whole_texts(spark):
    rng = random.Random(4)
    long = "".join(rng.choices(["word ", "a. ", "\n\n", "longerword"], k=30_000)) + "the end"
    docs = spark.createDataFrame([("d1", "T", long), ("d2", "", long)], "document_id string, title string, content string")
    rows = chunking.chunk_documents(docs).orderBy("parent_document_id", "chunk_index").collect()
    for id, whole in (("d1", "T\n\n" + long), ("d2", long)):
        want = reference_chunks(whole, chunking.CHUNK, chunking.OVERLAP)
        got = [r for r in rows if r.parent_document_id == id]
        assert len(long) > 100_000 and [r.text for r in got] == want and got[-1].text.endswith("the end")
        assert {r.total_chunks for r in got} == {len(want)}
    capped = chunking.chunk_documents(docs, cap=chunking.CONTENT_CAP).where("parent_document_id = 'd2'")
    assert capped.count() == len(reference_chunks(long[:50_000], chunking.CHUNK, chunking.OVERLAP))


@pytest.mark.parametrize("n", [0, 1, 160, 161, 4840, 4841, 9001])
def test_windows_cover_whole_texts(spark, n):
    t = "".join(random.Random(n).choices("abc ", k=n))
    want = [t[i : i + 200] for i in range(0, n, 160)]
    assert one(spark, t, text.windows) == want and one(spark, t, lambda c: text.windows(c, most=30)) == want[:30]
