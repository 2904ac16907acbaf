"""Joins by time against brute force."""

import datetime
import random

from kelpie.operators import temporal

T0 = datetime.datetime(2024, 1, 1)


def sides(spark, seed=0, n=400):
    rng = random.Random(seed)
    at = lambda: T0 + datetime.timedelta(seconds=rng.randrange(300)) if rng.random() > 0.02 else None
    key = lambda: rng.choice(["hot"] * 6 + ["b", "c", None])
    left = [(i, key(), at(), "kept") for i in range(n)] + [(0, "hot", T0, "kept")] * 2
    right = [(key(), at(), rng.randrange(50)) for _ in range(n)]
    return left, right, spark.createDataFrame(left, "i long, k string, t timestamp, _row string"), spark.createDataFrame(right, "k string, t timestamp, v long")


def test_asof(spark):
    left, right, ldf, rdf = sides(spark)
    want = []
    for i, k, t, x in left:
        hits = [(rt, v) for rk, rt, v in right if k is not None and t is not None and rk == k and rt is not None and rt <= t]
        want.append((i, k, t, x, max(hits)[1] if hits else None, max(hits)[0] if hits else None))
    got = temporal.asof(ldf, rdf, ["k"], "t", ["v"], right_time="rt")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert [r.v for r in temporal.asof(ldf, rdf.limit(0), ["k"], "t", ["v"]).collect()] == [None] * len(left)
    assert temporal.asof(ldf.limit(0), rdf, ["k"], "t", ["v"]).count() == 0


def test_within(spark):
    left, right, ldf, rdf = sides(spark, 1)
    old = [(1, "old", T0 - datetime.timedelta(days=30_000), "kept")]
    for seconds in (1, 7, 1000):
        want = [(i, k, t, x, v) for i, k, t, x in left + old for rk, rt, v in right + [("old", old[0][2], 3)] if k is not None and rk == k and t and rt and 0 <= (t - rt).total_seconds() <= seconds]
        got = temporal.within(ldf.unionByName(spark.createDataFrame(old, ldf.schema)), rdf.unionByName(spark.createDataFrame([("old", old[0][2], 3)], rdf.schema)), ["k"], "t", seconds, ["v"])
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
