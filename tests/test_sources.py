"""The paged source and collections."""

import pytest
from pyspark.sql import functions as F

from kelpie.session import make_importable
from kelpie.sources import paged
from kelpie.sources.collections import Collection

SCHEMA = "space string, id long, body string"


@pytest.fixture(scope="module")
def landed(spark, tmp_path_factory):
    make_importable(spark)
    path = f"file://{tmp_path_factory.mktemp('landed')}"
    rows = [(i, ["hot", "hot", "a b/c=é", None, "x"][i % 5] if i < 200 else "hot", f"line {i}" if i % 3 else None) for i in range(900)]
    paged.land(spark.createDataFrame(rows, "id long, host string, body string"), "host", path, 10)
    return path, rows


def read(df):
    return sorted(((r.space, r.id, r.body) for r in df.collect()), key=str)


@pytest.mark.parametrize("page_size", [1, 7, 50])
def test_all_pages(spark, landed, page_size):
    path, rows = landed
    df = paged.paged(spark, SCHEMA, path, page_size=page_size)
    assert read(df) == sorted(((h, i, b) for i, h, b in rows), key=str)
    assert df.rdd.getNumPartitions() > 4  # a large space is several


def test_filters_are_pushed(spark, landed):
    path, rows = landed
    df = paged.paged(spark, SCHEMA, path).where("space in ('x', 'a b/c=é', 'nobody') and id > 50")
    assert read(df) == sorted(((h, i, b) for i, h, b in rows if h in ("x", "a b/c=é") and i > 50), key=str)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert df.rdd.getNumPartitions() == 2 and "space" not in plan.split("Filter", 1)[1].split("\n")[0]
    assert read(paged.paged(spark, SCHEMA, path).where("space = 'x'").where("space = 'hot'")) == []


def test_most_items_of_a_space(spark, landed):
    path, _ = landed
    got = paged.paged(spark, SCHEMA, path, page_size=4, max_items=10).groupBy("space").count().collect()
    assert len(got) == 4 and all(r["count"] == 10 for r in got)
    assert paged.paged(spark, SCHEMA, path, max_items=0).count() == 0
    assert paged.paged(spark, "space string, other string", path).where("space = 'x' and other is null").count() == 40


@pytest.fixture
def made(spark, tmp_path):
    return Collection.create(spark, str(tmp_path / "c"), ["k"], 8)


def rows(c, version=None):
    return sorted(map(tuple, c.read(version).collect()), key=str)


def test_merge_rewrites_only_what_it_touches(spark, made):
    made.merge(spark.range(1000).select(F.col("id").alias("k"), F.lit("old").alias("v")))
    done = made.merge(spark.createDataFrame([(7, "new")], "k long, v string"))
    assert len(done.rewritten) == 1 and done.version == 2 == made.current()
    assert [r for r in rows(made) if r[1] == "new"] == [(7, "new")] and made.read().count() == 1000
    changed = made.read().select("k", F.input_file_name().alias("f")).where("f like '%version=2%'").select("f").distinct().count()
    assert 1 <= changed <= 4 and (7, "old") in rows(made, 1)


def test_order_ties_nulls_and_new_columns(spark, made):
    made.merge(spark.createDataFrame([(1, "a", 5), (None, "n", 1), (1, "b", 9), (2, "c", 3)], "k long, v string, at int"), F.col("at"))
    assert rows(made) == sorted([(1, "b", 9), (None, "n", 1), (2, "c", 3)], key=str)
    made.merge(spark.createDataFrame([(1, "late", 8), (2, "tie", 3), (None, "m", 2)], "k long, v string, at int"), F.col("at"))
    assert rows(made) == sorted([(1, "b", 9), (2, "tie", 3), (None, "m", 2)], key=str)
    made.merge(spark.createDataFrame([(3,)], "k long"))
    assert (3, None, None) in rows(made)


def test_gone_append_restore_vacuum(spark, made):
    frame = lambda x: spark.createDataFrame(x, "k long, v string")
    made.append(frame([(1, "a"), (2, "b"), (2, "b2")]))
    assert made.append(frame([(2, "c"), (3, "d")])).version == 2
    assert [k for k, _ in rows(made)] == [1, 2, 3] and (2, "c") not in rows(made)
    made.merge(frame([]), gone=frame([(1, ""), (9, "")]))
    assert [k for k, _ in rows(made)] == [2, 3]
    assert made.restore(1) == 4 and [k for k, _ in rows(made)] == [1, 2]
    made.merge(frame([]), gone=frame([(1, ""), (2, "")]))
    assert rows(made) == [] and made.read().columns == ["k", "v"]
    made.restore(2)
    made.vacuum()
    assert made.versions() == [6] and [k for k, _ in rows(made)] == [1, 2, 3]


def test_conflicts_and_creation(spark, made, tmp_path):
    one = spark.createDataFrame([(1, "a")], "k long, v string")
    made.merge(one)
    with pytest.raises(ValueError, match="taken"):
        made._commit(0, {}, "k long")
    with pytest.raises(ValueError, match="exists"):
        Collection.create(spark, made.path, ["k"])
    again = Collection.create(spark, made.path, ["k"], recreate=True)
    assert again.current() == 0
    with pytest.raises(ValueError, match="no version"):
        again.read()
    # what a merge that died has left is not read, and is written over
    one.withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(f"{made.path}/data/version=1")
    again.merge(spark.createDataFrame([(5, "x")], "k long, v string"))
    assert rows(again) == [(5, "x")]
