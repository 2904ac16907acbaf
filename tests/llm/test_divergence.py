"""Source divergence against a brute-force version, on odd tables."""

import collections
import random
import re

import pytest

from kelpie.llm import divergence

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_docs, top):
    rows = [tuple(x or "" for x in r) for r in rows]
    count, docs = collections.Counter(), collections.defaultdict(set)
    for i, (text, lang, source) in enumerate(rows):
        for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text):
            count[lang, source, t.translate(LOWER)] += 1
            docs[lang, t.translate(LOWER)].add(i)
    groups = sorted({(lang, source) for _, lang, source in rows})
    out = []
    for lang in {x for x, _ in groups}:
        kept = [t for (x, t), d in docs.items() if x == lang and len(d) >= min_docs]
        names = [s for x, s in groups if x == lang]
        counts = {s: [count[lang, s, t] for t in kept] for s in names}
        whole = [sum(counts[s][i] for s in names) for i in range(len(kept))]
        share = lambda c: [1 + divergence.SCALE * (n + 1) // (sum(c) + len(kept)) for n in c]
        f = lambda p, q: (p - q) ** 2 // q
        for s in names:
            p, q = share(counts[s]), share(whole)
            pairs = [(o, sum(map(f, p, share(counts[o])))) for o in names if o != s]
            terms = [(t, f(p[i], q[i])) for i, t in enumerate(kept) if counts[s][i] and p[i] > q[i]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, v, i + 1) for i, (item, v) in enumerate(found[:most])]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "kept", 1) for r in rows], "text string, lang string, source string, code string, total int")


@pytest.mark.parametrize("slice_bytes", [16_000_000, 1])
def test_equals_brute_force(spark, monkeypatch, slice_bytes):
    monkeypatch.setattr(divergence, "SLICE_BYTES", slice_bytes)
    rng = random.Random(4)
    words = ["".join(rng.choices("abÉéZ", k=rng.randint(1, 3))) + rng.choice(["", ",", "-a", "1b", "'", "***"]) for _ in range(80)]
    rows = [(" ".join(rng.choices(words, k=rng.choice([0, 1, 9, 200]))), rng.choice(["x", "y", None]), rng.choice(["s", "s", "s", "t", "u", None, ""])) for _ in range(300)]
    rows += [rows[0]] * 5 + [(None, "x", "s"), ("", "empty", "s"), (" \t\n ", "empty", "t"), ("one", "few", "s"), ("12 --", "x", "only"), ("word " * 60_000 + "z" * 100_000, "x", "t")]
    for min_docs, top in ((3, 200), (1, 4)):
        assert sorted(map(tuple, divergence.audit(frame(spark, rows), min_docs, top).collect())) == brute(rows, min_docs, top)


def test_many_shards_and_tiles_change_nothing(spark, monkeypatch):
    rows = [(f"common w{chr(97 + i % 26)} w{chr(97 + i % 7)}x", "l", f"s{i % 5}") for i in range(120)]
    monkeypatch.setattr(divergence, "SHARD", 3)  # at least 25, the number of pairs
    monkeypatch.setattr(divergence, "CELLS", 4)
    assert sorted(map(tuple, divergence.audit(frame(spark, rows)).collect())) == brute(rows, 3, 200)


def test_empty_table(spark):
    assert divergence.audit(frame(spark, [("a", "b", "c")]).limit(0)).count() == 0


def test_large_counts_stay_exact(spark):
    import numpy as np
    from pyspark.sql import functions as F

    counts, total = [0, 7, 10**12, 3 * 10**14], 5 * 10**14 + 7
    want = [1 + divergence.SCALE * (n + 1) // total for n in counts]
    assert divergence._shares(np.array(counts), np.array([total] * 4)).tolist() == want
    got = spark.createDataFrame([(n,) for n in counts], "n long").select(divergence._share(F.col("n"), F.lit(total)).alias("p"))
    assert sorted(r.p for r in got.collect()) == sorted(want)
