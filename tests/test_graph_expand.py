"""Frontier search against all paths without a repeated edge."""

import random

import pytest
from pyspark.sql import functions as F

from kelpie.operators import graph


def brute(edges, seeds, hops):
    edges, found = set(edges), {}
    steps = [(s, r, d, (s, r, d)) for s, r, d in edges] + [(d, r, s, (s, r, d)) for s, r, d in edges if s != d]

    def walk(seed, at, first, used):
        for s, r, d, e in steps:
            if s == at and e not in used:
                key = (seed, d, first or r)
                if d != seed:
                    found[key] = min(found.get(key, 99), len(used) + 1)
                if len(used) + 1 < hops:
                    walk(seed, d, first or r, used | {e})

    for seed in set(seeds):
        walk(seed, seed, None, frozenset())
    return found


@pytest.mark.parametrize("seed", range(6))
def test_equals_paths(spark, seed):
    rng = random.Random(seed)
    n, m = rng.choice([(5, 6), (7, 9), (9, 11)])
    edges = [(f"{rng.randrange(n)}", rng.choice("RST"), f"{rng.randrange(n)}") for _ in range(m)]
    edges += edges[:1]
    seeds = ["0", "1", "1", "nobody"]
    rows = spark.createDataFrame([("t", s, r, "t", d) for s, r, d in edges] + [("t", None, "R", "t", "0")], "src_type string, src string, rel string, dst_type string, dst string")
    hops = 4 + seed % 2
    got = {(r.seed, r.neighbor, r.rel): r.distance for r in graph.expand(rows, spark.createDataFrame([(s,) for s in seeds], "key string"), hops).collect()}
    assert got == brute(edges, seeds, hops)


def test_hubs_do_not_multiply(spark):
    """A hub of 3,000 between two hubs: as many rows as nodes, not as paths."""
    from pyspark.sql import functions as F

    spokes = spark.range(3_000).select(F.lit("t").alias("src_type"), F.lit("hub").alias("src"), F.lit("R").alias("rel"), F.lit("t").alias("dst_type"), F.concat(F.lit("x"), "id").alias("dst"))
    far = spokes.withColumn("src", F.lit("far"))
    out = graph.expand(spokes.unionByName(far), spark.createDataFrame([("hub",)], "key string"), 4)
    assert (out.count(), out.where("distance = 1").count(), out.where("neighbor = 'far' and distance = 2").count()) == (3_001, 3_000, 1)


def test_limit_is_per_seed(spark):
    rows = spark.createDataFrame([("t", s, "R", "t", f"{s}{i}") for s in "ab" for i in range(5)], "src_type string, src string, rel string, dst_type string, dst string")
    chunks = spark.createDataFrame([(f"{s}{i}", f"c{s}{i}", 0) for s in "ab" for i in range(5)], "owner string, chunk_id string, chunk_index int")
    out = graph.expand_chunks(rows, spark.createDataFrame([("a",), ("b",)], "key string"), chunks, 2, 2).collect()
    assert sorted((r.seed, r.neighbor) for r in out) == [("a", "a0"), ("a", "a1"), ("b", "b0"), ("b", "b1")]


def test_levels_take_tasks_by_their_steps(spark, monkeypatch):
    """A level's rows are dealt to tasks by their number, and what one seed reaches is not sent to one task."""
    monkeypatch.setattr(graph, "LEVEL", 50)
    rows = [("a", f"s{i}", "R", "b", f"p{(i * 7 + k) % 60}") for i in range(40) for k in range(5)]
    e = spark.createDataFrame(rows, graph.EDGE)
    seeds = spark.createDataFrame([("s0",), ("s1",)], "key string")
    step = graph.both_ways(e)
    front = seeds.select(F.col("key").alias("node"))
    assert graph._parts(front, step) == 8 and graph._parts(front.crossJoin(spark.range(200)), step) == 40
    out = graph.expand(e, seeds, hops=3)
    assert out.rdd.getNumPartitions() >= 8
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning(seed" in plan and not [x for x in plan.splitlines() if "hashpartitioning(seed" in x and "node" not in x]


@pytest.mark.parametrize("hops", [1, 2, 3, 4, 5])
@pytest.mark.parametrize("many, sent", [(1, 300_000), (2, 4)])
def test_rows_that_go_on_as_one_equal_paths(spark, monkeypatch, hops, many, sent):
    """Also where rows at a node go on as one from the first, in blocks of seeds, with loops and double edges."""
    monkeypatch.setattr(graph, "MANY", many)
    monkeypatch.setattr(graph, "SENT", sent)
    rng = random.Random(10 * hops + many)
    n, m = (9, 11) if hops < 5 else (7, 9)
    edges = [(f"{rng.randrange(n)}", rng.choice("RS"), f"{rng.randrange(n)}") for _ in range(m)] + [("0", "R", "0"), ("0", "R", "1"), ("1", "S", "0")]
    seeds = [f"{i}" for i in range(n)]
    rows = spark.createDataFrame([("t", s, r, "t", d) for s, r, d in edges], graph.EDGE)
    found = [((r.seed, r.neighbor, r.rel), r.distance) for r in graph.expand(rows, spark.createDataFrame([(s,) for s in seeds], "key string"), hops).collect()]
    assert len(found) == len(dict(found)) and dict(found) == brute(edges, seeds, hops)


def test_last_level_is_not_stored(spark, monkeypatch, tmp_path):
    """40 seeds at a hub of 30 with 50 leaves each: 60,000 rows of the last level, and no table or shuffle of as many."""
    stored, staged = [], graph.staged
    monkeypatch.setattr(graph, "staged", lambda df, name: (stored.append(out := staged(df, name)), out)[1])
    edges = [("t", f"s{i}", "R", "t", "hub") for i in range(40)] + [("t", "hub", "R", "t", f"m{i}") for i in range(30)]
    edges += [("t", f"m{i}", "R", "t", f"x{i}_{k}") for i in range(30) for k in range(50)]
    out = graph.expand(spark.createDataFrame(edges, graph.EDGE), spark.createDataFrame([(f"s{i}",) for i in range(40)], "key string"), 3)
    store, jvm = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jvm
    sent = lambda: sum(s.shuffleWriteRecords() for s in jvm.scala.jdk.javaapi.CollectionConverters.asJava(store.stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), None)))
    before = sent()
    out.write.parquet(str(tmp_path / "out"))
    rows = spark.read.parquet(str(tmp_path / "out"))
    assert rows.where("distance = 3").count() == 60_000 and rows.count() == 40 * (1 + 39 + 30 + 1_500)
    assert max(t.count() for t in stored) < 10_000 and sent() - before < 10_000
