"""Substring search against a scan."""

import random

from pyspark.sql import functions as F

from kelpie.operators import text_index


def test_equals_a_scan(spark, tmp_path):
    rng = random.Random(3)
    words = ["alpha", "Beta", "été", "ÉTÉ", "x", "zz", "日本語", "naïve", "abcabc"]
    texts = [(i, " ".join(rng.choices(words, k=rng.choice([0, 1, 3, 30]))), "kept") for i in range(1_300)] + [(5, None, "kept"), (6, "long " * 20_000 + "needle", "kept"), (7, "", "kept"), (7, "", "kept")]
    df = spark.createDataFrame(texts, "id long, body string, block string")
    needles = [(0, "alpha b"), (1, "BETA"), (2, "été x"), (3, "本語 "), (4, "needle"), (5, "absent!"), (6, ""), (7, "z"), (8, "é"), (9, None), (10, "abcabc abc"), (10, "Beta"), (11, "%_"), (12, "日")]
    asked = spark.createDataFrame(needles, "n long, needle string")
    index = text_index.build(df, str(tmp_path), "id", "body")
    got = sorted(map(tuple, text_index.search(index, asked, "n", "needle", "id").collect()))
    assert got == sorted((n, i) for n, s in needles if s is not None for i, t, _ in texts if t is not None and s.lower() in t.lower())
    assert text_index.search(index, asked.limit(0), "n", "needle", "id").count() == 0
    empty = text_index.build(df.limit(0), str(tmp_path / "none"), "id", "body")
    assert text_index.search(empty, asked, "n", "needle", "id").count() == 0


def test_few_texts_are_read(spark, sf_dir, tmp_path):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    index = text_index.build(df, str(tmp_path), "doc_id", "text")
    one = df.where("doc_id = 20").select(F.substring("text", 11, 30).alias("needle"))
    share = text_index.read_share(index, one, "needle").first()
    assert share.texts == df.count() and 1 <= share.verified <= 0.2 * share.texts
    assert "In(gram" in index.postings(spark).where(F.col("gram").isin([1, 2]))._jdf.queryExecution().toString()
