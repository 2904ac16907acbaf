"""Queries of the paged source and of collections, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from kelpie.queries import _t, query
from kelpie.sources import paged, sinks
from kelpie.sources.collections import Collection


@query("""SELECT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS space, page_id, url, md5(html) AS body FROM pages
WHERE regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) LIKE 'www.%'""")
def s10_paged_pages(spark, sf_dir):
    """Pages landed by host, read page by page in a partition for each host."""
    rows = _t(spark, sf_dir, "pages").select("page_id", "url", F.md5(F.col("html").cast("binary")).alias("body"), F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1).alias("host"))
    path = sinks.scratch(spark, "pages")
    paged.land(rows, "host", path, 100)
    return paged.paged(spark, "space string, page_id long, url string, body string", path, page_size=50).where(F.col("space").startswith("www.")).select("space", "page_id", "url", "body")


@query("""SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderkey >= 0.99 * (SELECT max(o_orderkey) FROM orders) THEN 2 * o_totalprice ELSE o_totalprice END AS o_totalprice, o_orderdate, o_orderpriority FROM orders
UNION ALL SELECT o_orderkey + 1000000000, o_custkey, 'N', o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_orderkey % 1000 = 3""")
def k1_bucketed_merge(spark, sf_dir):
    """Orders as a collection; then the newest hundredth changes, and some are new."""
    orders = _t(spark, sf_dir, "orders")
    c = Collection.create(spark, sinks.scratch(spark, "orders"), ["o_orderkey"], 64, "o_orderkey div 1024")
    c.merge(orders)
    top = orders.agg(F.max("o_orderkey").alias("k")).first()["k"]
    changed = orders.where(F.col("o_orderkey") >= 0.99 * top).withColumn("o_totalprice", F.col("o_totalprice") * 2)
    added = orders.where("o_orderkey % 1000 = 3").withColumn("o_orderkey", F.col("o_orderkey") + 1_000_000_000).withColumn("o_orderstatus", F.lit("N"))
    c.merge(changed.unionByName(added))
    return c.read()


@query("""SELECT 2 AS version, p_partkey, p_retailprice * 2 AS p_retailprice FROM part WHERE p_size < 10
UNION ALL SELECT 2, p_partkey, p_retailprice FROM part WHERE p_size BETWEEN 10 AND 39 UNION ALL SELECT 1, p_partkey, p_retailprice FROM part
UNION ALL SELECT 3, p_partkey, p_retailprice FROM part""")
def k6_collection_versions(spark, sf_dir):
    """Parts as a collection of three versions: all; small ones dearer and large ones gone; the first restored."""
    part = _t(spark, sf_dir, "part").select("p_partkey", "p_retailprice", "p_size")
    path = sinks.scratch(spark, "parts")
    Collection.create(spark, path, ["p_partkey"], 16)
    c = Collection.create(spark, path, ["p_partkey"], 16, recreate=True)
    c.merge(part)
    c.merge(part.where("p_size < 10").withColumn("p_retailprice", F.col("p_retailprice") * 2), gone=part.where("p_size >= 40"))
    c.restore(1)
    each = [c.read(v).select(F.lit(v).alias("version"), "p_partkey", "p_retailprice") for v in c.versions()]
    return each[0].unionByName(each[1]).unionByName(each[2])
