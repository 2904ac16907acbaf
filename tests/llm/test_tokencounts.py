import random

from pyspark.sql import functions as F

from kelpie.llm import tokencounts as tc
from kelpie.llm.queries import op1_token_counts, tokenizer

RANKS = tokenizer("byte_bpe_50k.tiktoken")


def whole(text):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=tc.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda t: len(enc.encode_ordinary(t))


COUNT = whole(RANKS)


def test_random_edits_equal_whole_encoding():
    rng = random.Random(5)
    alphabet = ["a", "b", "re", " ", "  ", "\n", "'", "'s", "'ll", "1", "23", "é", "，", ".", "!!", "\t \n", "word "]
    for _ in range(150):
        text = "".join(rng.choices(alphabet, k=rng.choice([0, 3, 40, 900])))
        doc = tc.CountedText(text, tc.counter(RANKS))
        for _ in range(6):
            at, n, new = rng.randint(0, len(text) + 2), rng.choice([0, 1, 5, 200]), "".join(rng.choices(alphabet, k=rng.choice([0, 1, 4, 700])))
            doc.edit(at, n, new)
            text = text[:at] + new + text[at + n :]
            assert doc.text == text and doc.total == COUNT(text)
            assert doc.tree[1][0] == len(text)


def test_only_the_edited_region_is_encoded():
    doc = tc.CountedText("some words, " * 5000, tc.counter(RANKS))
    doc.edit(30_000, 4, "other")
    assert doc.reencoded < 60 and doc.total == COUNT(doc.text)


def test_query_against_whole_encoding(spark, sf_dir):
    rows = {r.doc_id: r for r in op1_token_counts(spark, sf_dir).collect()}
    for d in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        t, n = d.text, len(d.text)
        for at, cut, new in ((n // 4, 3, "Edited, "), (n // 2, 0, " it's new\n\n"), (3 * n // 4, 10, "")):
            t = t[: min(at, len(t))] + new + t[min(at, len(t)) + cut :]
        r = rows[d.doc_id]
        assert (r.n_tokens, r.n_tokens_edited, r.edited_chars) == (COUNT(d.text), COUNT(t), len(t))


def test_defined_cases(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "x" * 50_000), (2, "a b")], "doc_id long, text string")
    rows = tc.edited_counts(docs, F.lit(None), RANKS).collect()
    assert sorted(r.n_tokens for r in rows)[:3] == [0, 0, 2] and all(r.n_edits == 0 and r.n_tokens == r.n_tokens_edited for r in rows)
    assert tc.edited_counts(docs.limit(0), F.lit(None), RANKS).count() == 0
    odd = F.array(F.struct(F.lit(-5).alias("start"), F.lit(10**6).alias("remove"), F.lit(None).cast("string").alias("insert")), F.struct(F.lit(99).alias("start"), F.lit(-1).alias("remove"), F.lit("end").alias("insert")))
    assert {r.n_tokens_edited for r in tc.edited_counts(docs, odd, RANKS).collect()} == {1}
