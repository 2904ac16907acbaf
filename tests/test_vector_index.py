"""The vector index against brute force."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kelpie.operators import vector_index


def brute(rows, queries, k, where=lambda r: True, self_too=False):
    out = {}
    for q, v in queries:
        if not v or None in v:
            continue
        hits = [(-round(float(np.dot(np.float64(v), np.float64(x))), 9), i) for i, x, g in rows if x and None not in x and where(g) and (self_too or i != q)]
        out[q] = [i for _, i in sorted(hits)[:k]]
    return {q: v for q, v in out.items() if v}


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append(r.vec_id)
    return out


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    """A hot vector, clusters, random rows, rows without a vector, ties."""
    rng = np.random.default_rng(5)
    hot = rng.normal(size=8)
    vectors = [hot] * 200 + [hot * 3 + rng.normal(size=8) * 0.01 for _ in range(100)] + list(rng.normal(size=(300, 8)))
    rows = [(i, [float(np.float32(x)) for x in v], i % 4) for i, v in enumerate(vectors)] + [(900, None, 0), (901, [], 1), (902, [1.0] * 7 + [None], 2), (903, [0.0] * 8, 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, grp int")
    queries = [(r[0], r[1]) for r in rows if r[0] % 20 == 0] + [(902, rows[-2][1]), (903, [0.0] * 8), (904, [])]
    asked = spark.createDataFrame(queries, "query_id long, embedding array<float>")
    return rows, queries, asked, vector_index.build(df, str(tmp_path_factory.mktemp("index")), keep=["grp"])


@pytest.mark.parametrize("options", [{"probes": 0}, {"probes": 1, "exact": True}, {"probes": 3, "exact": True}])
def test_exact_ways(made, options):
    rows, queries, asked, index = made
    assert found(vector_index.search(index, asked, 5, **options)) == brute(rows, queries, 5)
    assert found(vector_index.search(index, asked, 5, where=F.col("grp") == 1, **options)) == brute(rows, queries, 5, lambda g: g == 1)
    assert found(vector_index.search(index, asked, 1000, exclude_self=False, **options)) == brute(rows, queries, 1000, self_too=True)


def test_threshold_and_no_rows(spark, made, tmp_path):
    rows, queries, asked, index = made
    got = vector_index.search(index, asked, 5, probes=0, at_least=2.0).collect()
    assert got and all(r.score >= 2.0 for r in got)
    assert vector_index.search(index, asked.limit(0), 5).count() == 0
    empty = vector_index.build(spark.createDataFrame([], "vec_id long, embedding array<float>"), str(tmp_path))
    assert vector_index.search(empty, asked, 5).count() == 0


def test_vectors_of_different_lengths_are_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="vectors of lengths"):
        vector_index.build(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>"), str(tmp_path))


def test_blocks_change_nothing(spark, made):
    """A list of more rows and queries than a block holds."""
    rows, queries, asked, index = made
    many = spark.createDataFrame([(10_000 + i, q[1]) for i, q in enumerate(queries[:3] * 300)], "query_id long, embedding array<float>")
    got = found(vector_index.search(index, many, 3, probes=0))
    want = brute(rows, [(10_000 + i, q[1]) for i, q in enumerate(queries[:3])], 3)
    assert len(got) == 900 and all(got[10_000 + i] == want[10_000 + i % 3] for i in range(900))


def test_recall_and_pruning_on_the_table(spark, sf_dir, tmp_path):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    index = vector_index.build(df, str(tmp_path), keep=["label"])
    asked = df.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    exact, near = found(vector_index.search(index, asked, 10, probes=0)), found(vector_index.search(index, asked, 10))
    assert sum(len(set(near.get(q, [])) & set(v)) for q, v in exact.items()) >= 0.9 * sum(map(len, exact.values()))
    one = asked.limit(1)
    lists = [r["list"] for r in vector_index.probed(index, one, 2, "query_id", "embedding").collect()]
    scan = index.codes(spark).where(F.col("list").isin(lists))
    assert "PartitionFilters: [" in scan._jdf.queryExecution().toString() and scan.count() == index.sizes[lists].sum() < 0.5 * index.sizes.sum()
    r = vector_index.reread(index, asked, 10).first()
    assert r.compared == asked.count() * df.count() and r.reread < 0.2 * r.compared


def test_search_many_passes_over_vectors_with_nulls(spark):
    from kelpie.operators import vectors

    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.5, 0.5]), (3, [None, 1.0]), (4, None), (5, [])], "vec_id long, embedding array<double>")
    got = vectors.search_many(df, df.withColumnRenamed("vec_id", "query_id"), 3).collect()
    assert sorted((r.query_id, r.vec_id) for r in got) == [(1, 2), (2, 1)]
    with pytest.raises(Exception, match="lengths"):
        vectors.search_many(df.unionByName(spark.createDataFrame([(9, [1.0])], df.schema)), df.where("vec_id = 1").withColumnRenamed("vec_id", "query_id"), 3).collect()


def test_rows_and_lists_are_taken_in_runs():
    """10,000 queries by 4,096 lists never make more than PAIRS rows of a vector at once; nearest centres are as in one product."""
    rng = np.random.default_rng(8)
    rows, centres = rng.normal(size=(3_000, 4)), rng.normal(size=(900, 4))
    assert (vector_index._nearest(rows, centres) == (2 * rows @ centres.T - (centres * centres).sum(axis=1)).argmax(axis=1)).all()
    batch = pa.RecordBatch.from_arrays([pa.array(range(3_000)), pa.array(rows.tolist())], ["query_id", "v"])
    every = lambda run: (np.repeat(np.arange(run.num_rows), 900), np.tile(np.arange(900), run.num_rows))
    seen = 0
    for out in vector_index._asked(batch, 900, every):
        assert out.num_rows <= vector_index.PAIRS
        at = seen // 900
        assert out["query_id"][0].as_py() == at and out["q"][0].as_py() == rows[at].tolist()
        seen += out.num_rows
    assert seen == 3_000 * 900
