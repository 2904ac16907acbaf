"""Queries of the frontier search over a graph of nations, suppliers and parts, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from kelpie.operators import graph
from kelpie.queries import _t, query

_TRADE = """e AS (SELECT 's' || s_suppkey AS src, 'IN_NATION' AS rel, 'n' || s_nationkey AS dst FROM supplier
UNION SELECT 's' || l_suppkey, CASE WHEN l_returnflag = 'R' THEN 'HAD_BACK' ELSE 'SUPPLIES' END, 'p' || l_partkey FROM lineitem WHERE l_quantity >= 45),
u AS (SELECT src AS a, rel, dst AS b, src || rel || dst AS id FROM e UNION ALL SELECT dst, rel, src, src || rel || dst FROM e)"""
_PATHS = """one AS (SELECT seed, u.b AS here, rel AS first, [id] AS used FROM seeds JOIN u ON a = seed),
two AS (SELECT seed, u.b AS here, first, list_append(used, id) AS used FROM one JOIN u ON u.a = one.here WHERE NOT list_contains(used, id)),
three AS (SELECT DISTINCT seed, u.b AS here, first FROM two JOIN u ON u.a = two.here WHERE NOT list_contains(used, id)),
near AS (SELECT seed, here AS neighbor, first AS rel, min(d) AS distance FROM (SELECT seed, here, first, 1 AS d FROM one UNION ALL SELECT seed, here, first, 2 FROM two UNION ALL SELECT seed, here, first, 3 FROM three) WHERE here <> seed GROUP BY ALL)"""


def _trade(spark, sf_dir):
    supplier, item = _t(spark, sf_dir, "supplier"), _t(spark, sf_dir, "lineitem").where("l_quantity >= 45")
    key = lambda p, c: F.concat(F.lit(p), F.col(c))
    e = graph.edges(supplier, "supplier", key("s", "s_suppkey"), "IN_NATION", "nation", key("n", "s_nationkey"))
    sold = item.withColumn("rel", F.when(F.col("l_returnflag") == "R", "HAD_BACK").otherwise("SUPPLIES"))
    return e.unionByName(graph.edges(sold, "supplier", key("s", "l_suppkey"), F.col("rel"), "part", key("p", "l_partkey")))


@query(f"WITH {_TRADE}, seeds AS (SELECT 'n' || n_nationkey AS seed FROM nation WHERE n_nationkey % 5 = 0 UNION SELECT 's' || s_suppkey FROM supplier WHERE s_suppkey % 50 = 0), {_PATHS} SELECT * FROM near")
def g7_three_hops(spark, sf_dir):
    """From nations to their suppliers, the parts of these, and the other suppliers of those parts."""
    nations = _t(spark, sf_dir, "nation").where("n_nationkey % 5 = 0").select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("key"))
    suppliers = _t(spark, sf_dir, "supplier").where("s_suppkey % 50 = 0").select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("key"))
    return graph.expand(_trade(spark, sf_dir), nations.unionByName(suppliers), hops=3).withColumn("distance", F.col("distance").cast("int"))


@query(f"""WITH {_TRADE}, seeds AS (SELECT 'n' || n_nationkey AS seed FROM nation), {_PATHS},
c AS (SELECT 'p' || l_partkey AS neighbor, arg_min(l_orderkey || '-' || l_linenumber, [l_linenumber, l_orderkey]) AS chunk_id FROM lineitem GROUP BY l_partkey)
SELECT seed, neighbor, rel, distance, chunk_id FROM near JOIN c USING (neighbor) QUALIFY row_number() OVER (PARTITION BY seed ORDER BY distance, neighbor, rel) <= 20""")
def g8_near_chunks(spark, sf_dir):
    """The twenty nearest parts of each nation, each with its first line item as its chunk."""
    item = _t(spark, sf_dir, "lineitem")
    first = item.groupBy("l_partkey").agg(F.min(F.struct("l_linenumber", "l_orderkey")).alias("f"))
    chunks = first.select(F.concat(F.lit("p"), F.col("l_partkey")).alias("owner"), F.concat_ws("-", "f.l_orderkey", "f.l_linenumber").alias("chunk_id"), F.lit(0).alias("chunk_index"))
    seeds = _t(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("key"))
    return graph.expand_chunks(_trade(spark, sf_dir), seeds, chunks, hops=3).withColumn("distance", F.col("distance").cast("int"))
