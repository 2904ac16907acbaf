"""Queries over the test tables, one or more per operator family, and the same in DuckDB SQL.

The tables stand in for the library's own: pages for wiki pages, documents for normalized documents, embeddings
for chunks (label: parent), conversations for turns, events for a log, orders and customers for tickets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kelpie.functions import chunking, intent, text
from kelpie.operators import context, datasets, evaluate, graph, normalize, ranking, serving, vectors
from kelpie.plans import catalogue, routing
from kelpie.sources import sinks

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sql_table(c: str, table: dict[str, str]) -> str:
    for k, v in table.items():
        k, v = k.replace("'", "''"), v.replace("'", "''")
        c = f"replace({c}, '{k}', '{v}')"
    return c


def _strip_sql(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def _re(c: str, pattern: str, to: str) -> str:
    return f"regexp_replace({c}, '{pattern}', '{to}', 'g')"


# ---- text -----------------------------------------------------------------------------------------------------

# Constants of the SQL are written out here, apart from those of the library.
_ENTITIES = {
    "&nbsp;": " ", "&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&eacute;": "é", "&egrave;": "è", "&agrave;": "à", "&ecirc;": "ê", "&ocirc;": "ô", "&ucirc;": "û",
    "&ccedil;": "ç", "&ugrave;": "ù", "&iuml;": "ï", "&rsquo;": "'", "&lsquo;": "'", "&rdquo;": '"', "&ldquo;": '"', "&mdash;": "—", "&ndash;": "–", "&rarr;": "→", "&larr;": "←", "&hellip;": "...",
    "&copy;": "©", "&reg;": "®",
}
_STORAGE_ENTITIES = {"&nbsp;": " ", "&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'"}
_HTML = _strip_sql(_re(_re(_re(_re(_sql_table("coalesce(html, '')", _ENTITIES), r"&#\d+;", ""), "&[a-zA-Z]+;", ""), "<[^>]+>", " "), r"\s+", " "))
_STORAGE = _strip_sql(_re(_sql_table(_re("coalesce(html, '')", "<[^>]+>", " "), _STORAGE_ENTITIES), r"\s+", " "))


@query(f"SELECT page_id, {_HTML} AS plain FROM pages")
def n6_strip_html(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", text.strip_html(F.col("html")).alias("plain"))


@query(f"SELECT page_id, {_STORAGE} AS plain FROM pages")
def n7_storage_text(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", text.storage_text(F.col("html")).alias("plain"))


@query(r"SELECT doc_id, md5(" + _strip_sql(_re(_re("text", r"\n{3,}", "\n\n"), " {2,}", " ")) + ") AS clean_md5, length(text) // 4 AS tokens FROM documents")
def n11_clean_text(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", F.md5(text.clean_text(F.col("text"))).alias("clean_md5"), text.token_estimate(F.col("text")).alias("tokens"))


@query("SELECT doc_id, substr(md5(text), 1, 12) AS short_hash, CAST('0x' || substr(md5(text), 1, 15) AS BIGINT) AS point_id FROM documents")
def n17_hashes(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", text.short_hash(F.col("text")).alias("short_hash"), text.point_id(F.col("text")).alias("point_id"))


@query(r"""SELECT page_id, len(u) AS n_urls, array_to_string(list_transform(u, lambda x: lower(regexp_extract(x, '^https?://([^/\s?#]+)', 1))), ',') AS hosts
FROM (SELECT page_id, regexp_extract_all(html, 'https?://[^\s\)"''<>]+') AS u FROM pages)""")
def n23_urls(spark, sf_dir):
    u = text.urls(F.col("html"))
    return _t(spark, sf_dir, "pages").select("page_id", F.size(u).cast("long").alias("n_urls"), F.array_join(F.transform(u, lambda x: F.lower(F.regexp_extract(x, r"^https?://([^/\s?#]+)", 1))), ",").alias("hosts"))


@query("SELECT event_id, 1 / (1 + exp(-value)) AS sigmoid, coalesce(CASE WHEN isnan(value) THEN 0.3 ELSE value END, 0.3) AS safe FROM events")
def n20_scores(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", text.sigmoid(F.col("value")).alias("sigmoid"), text.safe_score(F.col("value")).alias("safe"))


@query("""WITH p AS (SELECT event_id, CASE event_id % 24 WHEN 0 THEN 'relates to' WHEN 1 THEN 'Is Tested By ' WHEN 2 THEN 'tests' WHEN 3 THEN 'created by' WHEN 4 THEN 'created' WHEN 5 THEN 'BLOCKS' WHEN 6 THEN 'is blocked by'
  WHEN 7 THEN 'causes' WHEN 8 THEN 'is caused by' WHEN 9 THEN 'clones' WHEN 10 THEN 'is cloned by' WHEN 11 THEN 'is automated by' WHEN 12 THEN 'automates' WHEN 13 THEN 'is duplicated by' WHEN 14 THEN 'duplicates'
  WHEN 15 THEN 'split from' WHEN 16 THEN 'split to' WHEN 17 THEN 'implements' WHEN 18 THEN 'is implemented by' WHEN 19 THEN 'is reviewed by' WHEN 20 THEN 'depends on' WHEN 21 THEN 'is dependency of' WHEN 22 THEN 'is a friend of'
  END AS phrase FROM events)
SELECT event_id, CASE event_id % 24 WHEN 1 THEN 'IS_TESTED_BY' WHEN 2 THEN 'TESTS' WHEN 3 THEN 'CREATED_BY' WHEN 4 THEN 'CREATED_LINK' WHEN 5 THEN 'BLOCKS' WHEN 6 THEN 'BLOCKED_BY' WHEN 7 THEN 'CAUSES' WHEN 8 THEN 'CAUSED_BY'
  WHEN 9 THEN 'CLONES' WHEN 10 THEN 'CLONED_BY' WHEN 11 THEN 'IS_AUTOMATED_BY' WHEN 12 THEN 'AUTOMATES' WHEN 13 THEN 'DUPLICATED_BY' WHEN 14 THEN 'DUPLICATES' WHEN 15 THEN 'SPLIT_FROM' WHEN 16 THEN 'SPLIT_TO'
  WHEN 17 THEN 'IMPLEMENTS' WHEN 18 THEN 'IMPLEMENTED_BY' WHEN 19 THEN 'REVIEWED_BY' WHEN 20 THEN 'DEPENDS_ON' WHEN 21 THEN 'IS_DEPENDENCY_OF' ELSE 'RELATES_TO' END AS rel FROM p""")
def n14_link_relation(spark, sf_dir):
    phrases = [
        "relates to", "Is Tested By ", "tests", "created by", "created", "BLOCKS", "is blocked by", "causes", "is caused by", "clones", "is cloned by", "is automated by", "automates", "is duplicated by",
        "duplicates", "split from", "split to", "implements", "is implemented by", "is reviewed by", "depends on", "is dependency of", "is a friend of"]
    said = F.get(F.array(*[F.lit(p) for p in phrases]), (F.col("event_id") % 24).cast("int"))
    return _t(spark, sf_dir, "events").select("event_id", text.link_relation(said).alias("rel"))


def _wiki(spark, sf_dir):
    none = F.array().cast("array<string>")
    return _t(spark, sf_dir, "pages").select(
        F.lit("1").alias("space_id"), F.lit("WIKI").alias("space_name"), F.col("page_id").cast("string").alias("page_id"), F.lit("").alias("title"), F.col("html").alias("content"), F.lit("current").alias("status"),
        F.lit("crawler").alias("author"), F.col("url").alias("web_url"), none.alias("labels"), F.concat(F.lit("Web > "), F.regexp_extract("url", r"^https?://([^/]+)", 1)).alias("breadcrumb"))


_BODY = _strip_sql(_re("p", " {2,}", " "))
_PAGE_SQL = f"""SELECT 'confluence_page_' || page_id AS document_id, 'WIKI' AS project_name, url,
  'Location: Web > ' || regexp_extract(url, '^https?://([^/]+)', 1) || CASE WHEN {_BODY} = '' THEN '' ELSE chr(10) || chr(10) || {_BODY} END AS content
FROM (SELECT *, {_HTML} AS p FROM pages)"""


@query(f"SELECT * FROM ({_PAGE_SQL}) WHERE length(content) >= 30")
def n5_normalize_pages(spark, sf_dir):
    return normalize.long_enough(normalize.pages(_wiki(spark, sf_dir))).select("document_id", "project_name", "url", "content")


@query(f"SELECT 'page' AS source_type, count(*) AS documents, CAST(sum(length(content)) AS BIGINT) AS characters FROM ({_PAGE_SQL})")
def z3_documents_by_type(spark, sf_dir):
    return normalize.by_type(normalize.pages(_wiki(spark, sf_dir)))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 0)")
def g6_pending(spark, sf_dir):
    return graph.pending(_t(spark, sf_dir, "documents").select("doc_id"), _t(spark, sf_dir, "labels").where("toxic = 0"), "doc_id")


# ---- chunks ---------------------------------------------------------------------------------------------------


def _chunks(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select(F.concat(F.lit("doc_"), F.col("doc_id")).alias("document_id"), F.col("source").alias("title"), F.col("text").alias("content"))
    return chunking.chunk_documents(docs)


@query("""WITH RECURSIVE d AS (SELECT doc_id, source || chr(10) || chr(10) || text AS t FROM documents),
w AS (
  SELECT doc_id, t, CAST(length(t) AS BIGINT) AS n, CAST(0 AS BIGINT) AS b, CAST(0 AS BIGINT) AS k, CAST('' AS VARCHAR) AS piece FROM d
  UNION ALL
  SELECT doc_id, t, n, CASE WHEN e - OVERLAP > b THEN e - OVERLAP ELSE greatest(e, b + 1) END, k + 1, regexp_replace(substr(t, b + 1, e - b), '^\\s+|\\s+$', '', 'g') FROM (
    SELECT *, b + CASE WHEN b + SIZE >= n THEN SIZE WHEN p > 0 THEN p WHEN q > 0 THEN q + 1 WHEN r > 0 THEN r ELSE SIZE END AS e FROM (
      SELECT *, length(x) - 2 - length(list_last(string_split(x, chr(10) || chr(10)))) AS p, length(x) - 2 - length(list_last(string_split(x, '. '))) AS q, length(x) - 1 - length(list_last(string_split(x, ' '))) AS r
      FROM (SELECT *, substr(t, b + 1, SIZE) AS x FROM w WHERE b < n)))),
c AS (SELECT doc_id, piece, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS i, count(*) OVER (PARTITION BY doc_id) AS total FROM w WHERE k > 0 AND piece <> '')
SELECT 'doc_' || doc_id || '_chunk_' || i AS chunk_id, 'doc_' || doc_id AS parent_document_id, i AS chunk_index, total AS total_chunks, length(piece) // 4 AS token_count, md5(piece) AS text_md5 FROM c""".replace("OVERLAP", str(chunking.OVERLAP)).replace("SIZE", str(chunking.CHUNK)))
def c2_chunk_documents(spark, sf_dir):
    return _chunks(spark, sf_dir).select("chunk_id", "parent_document_id", "chunk_index", "total_chunks", "token_count", F.md5("text").alias("text_md5"))


@query("""SELECT CASE WHEN length(text) > 2000 THEN doc_id || '_part_' || (i + 1) ELSE CAST(doc_id AS VARCHAR) END AS document_id, substr(text, i * 2000 + 1, 2000) AS content, i + 1 AS part_number
FROM (SELECT *, unnest(range(greatest(1, CAST(ceil(length(text) / 2000) AS BIGINT)))) AS i FROM documents)""")
def c3_split_large(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.col("text").alias("content"))
    return chunking.split_large(docs, size=2000).select("document_id", "content", F.col("part_number").cast("long").alias("part_number"))


@query("""SELECT doc_id, CAST(CASE WHEN length(text) = 0 THEN 0 ELSE (length(text) - 1) // 160 + 1 END AS BIGINT) AS n_windows,
  md5(array_to_string(list_transform(range(0, (length(text) - 1) // 160 + 1), lambda i: substr(text, CAST(i * 160 + 1 AS BIGINT), 200)), '|')) AS windows_md5 FROM documents""")
def c4_windows(spark, sf_dir):
    w = text.windows(F.col("text"))
    return _t(spark, sf_dir, "documents").select("doc_id", F.size(w).cast("long").alias("n_windows"), F.md5(F.array_join(w, "|")).alias("windows_md5"))


@query(r"""SELECT doc_id, count_if(length(regexp_replace(s, '^\s+|\s+$', '', 'g')) >= 16) AS n_sentences FROM (
  SELECT doc_id, unnest(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) AS s FROM documents) GROUP BY doc_id""")
def c5_sentences(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", F.size(text.sentences(F.col("text"))).cast("long").alias("n_sentences"))


@query("SELECT source, count(*) AS documents, round(avg(length(text)), 4) AS mean_chars, max(length(text)) AS max_chars FROM documents GROUP BY source")
def z4_text_stats(spark, sf_dir):
    return _t(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("documents"), F.round(F.avg(F.length("text")), 4).alias("mean_chars"), F.max(F.length("text")).cast("long").alias("max_chars"))


# ---- vectors --------------------------------------------------------------------------------------------------


def _nearest(spark, sf_dir, k=10):
    rows = _t(spark, sf_dir, "embeddings")
    asked = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return rows, vectors.search_many(rows, asked, k)


_DOT = "list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))"
_TOP = f"""s AS (SELECT q.vec_id AS query_id, e.vec_id, e.label, {_DOT} AS score FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE q.vec_id % 20 = 0),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM s)"""


@query(f"WITH {_TOP} SELECT query_id, vec_id, round(score, 6) AS score, rank FROM t WHERE rank <= 10")
def e3_vector_topk(spark, sf_dir):
    return _nearest(spark, sf_dir)[1].select("query_id", "vec_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_TOP} SELECT query_id, vec_id, CASE WHEN score > 0.7 THEN 'high' WHEN score > 0.5 THEN 'medium' ELSE 'low' END AS relevance FROM t WHERE rank <= 10 AND round(score, 9) >= 0.2")
def e7_threshold_search(spark, sf_dir):
    return _nearest(spark, sf_dir)[1].where(F.round("score", 9) >= 0.2).select("query_id", "vec_id", vectors.relevance(F.col("score")).alias("relevance"))


@query("SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def e10_cosine(spark, sf_dir):
    a = _t(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("a"))
    b = _t(spark, sf_dir, "embeddings").select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return a.join(b, "vec_id").select("vec_id", F.round(vectors.cosine(F.col("a"), F.col("b")), 6).alias("cosine"))


@query("SELECT label, count(*) AS total, count_if(len(embedding) > 0) AS embedded, round(count_if(len(embedding) > 0) / count(*), 4) AS share FROM embeddings GROUP BY label")
def e11_coverage(spark, sf_dir):
    return vectors.coverage(_t(spark, sf_dir, "embeddings"), "label")


@query("SELECT max(len(embedding)) AS dimension FROM embeddings")
def s18_dimension(spark, sf_dir):
    return vectors.dimension(_t(spark, sf_dir, "embeddings")).select(F.col("dimension").cast("long").alias("dimension"))


_TERMS = ["the", "licensed", "tion"]


@query(f"""SELECT doc_id, round(0.7 * (doc_id % 10) / 10 + 0.3 * ({' + '.join(f"CAST(contains(lower(text), '{t}') AS INT)" for t in _TERMS)} + 2 * ({' + '.join(f"CAST(contains(lower(source), '{t}') AS INT)" for t in _TERMS)})) / 9.0, 6) AS score
FROM documents""")
def e8_keyword_blend(spark, sf_dir):
    terms = F.array(*[F.lit(t) for t in _TERMS])
    return _t(spark, sf_dir, "documents").select("doc_id", F.round(ranking.weighted_hybrid((F.col("doc_id") % 10) / 10, text.keyword_score(terms, F.col("text"), F.col("source"))), 6).alias("score"))


# ---- graph ----------------------------------------------------------------------------------------------------


def _places(spark, sf_dir):
    nation, supplier, customer = (_t(spark, sf_dir, t) for t in ("nation", "supplier", "customer"))
    key = lambda p, c: F.concat(F.lit(p), F.col(c))
    e = graph.edges(nation, "nation", key("n", "n_nationkey"), "IN_REGION", "region", key("r", "n_regionkey"))
    e = e.unionByName(graph.edges(supplier, "supplier", key("s", "s_suppkey"), "IN_NATION", "nation", key("n", "s_nationkey")))
    return e.unionByName(graph.edges(customer, "customer", key("c", "c_custkey"), "IN_NATION", "nation", key("n", "c_nationkey")))


_EDGES = """e AS (SELECT 'nation' AS src_type, 'n' || n_nationkey AS src, 'IN_REGION' AS rel, 'region' AS dst_type, 'r' || n_regionkey AS dst FROM nation
UNION SELECT 'supplier', 's' || s_suppkey, 'IN_NATION', 'nation', 'n' || s_nationkey FROM supplier UNION SELECT 'customer', 'c' || c_custkey, 'IN_NATION', 'nation', 'n' || c_nationkey FROM customer)"""


@query(f"WITH {_EDGES} SELECT rel, src_type, dst_type, count(*) AS n FROM e GROUP BY ALL")
def g2_edges(spark, sf_dir):
    return _places(spark, sf_dir).groupBy("rel", "src_type", "dst_type").agg(F.count("*").alias("n"))


@query(f"""WITH {_EDGES}, u AS (SELECT src AS a, rel, dst AS b, src || rel || dst AS id FROM e UNION ALL SELECT dst, rel, src, src || rel || dst FROM e),
p AS (SELECT DISTINCT dst AS seed FROM e WHERE dst_type = 'region'),
one AS (SELECT seed, b AS here, rel, id FROM p JOIN u ON a = seed), two AS (SELECT seed, u.b AS here, one.rel FROM one JOIN u ON u.a = one.here AND u.id <> one.id)
SELECT seed, here AS neighbor, rel, min(d) AS distance FROM (SELECT seed, here, rel, 1 AS d FROM one UNION ALL SELECT seed, here, rel, 2 FROM two) WHERE here <> seed GROUP BY ALL""")
def g7_expand(spark, sf_dir):
    seeds = _t(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey")).alias("key"))
    return graph.expand(_places(spark, sf_dir), seeds, hops=2).withColumn("distance", F.col("distance").cast("int"))


@query(f"WITH {_EDGES}, k AS (SELECT src_type AS label, src AS key FROM e UNION SELECT dst_type, dst FROM e) SELECT label, count(*) AS n, count_if(label = 'region') AS stubs FROM k GROUP BY label")
def g3_stub_nodes(spark, sf_dir):
    e = _places(spark, sf_dir)
    own = e.select(F.col("src_type").alias("label"), F.col("src").alias("key")).distinct()
    return graph.with_stubs(own, e).groupBy("label").agg(F.count("*").alias("n"), F.count_if("stub").alias("stubs"))


@query(f"WITH {_EDGES} SELECT 'node' AS kind, src_type AS name, count(DISTINCT src) AS n FROM e GROUP BY 2 UNION ALL SELECT 'edge', rel, count(*) FROM e GROUP BY rel")
def g13_stats(spark, sf_dir):
    e = _places(spark, sf_dir)
    return graph.stats(e.select(F.col("src_type").alias("label"), F.col("src").alias("key")).distinct(), e)


@query("SELECT o_custkey, o_orderkey, o_orderdate FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def k10_merge_nodes(spark, sf_dir):
    return graph.merge_nodes(_t(spark, sf_dir, "orders"), "o_custkey", F.struct("o_orderdate", "o_orderkey")).select("o_custkey", "o_orderkey", "o_orderdate")


@query("SELECT l_orderkey || '-' || l_partkey AS line, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def g14_uniqueness(spark, sf_dir):
    return graph.check_unique(_t(spark, sf_dir, "lineitem").withColumn("line", F.concat_ws("-", "l_orderkey", "l_partkey")), "line")


# ---- ranking --------------------------------------------------------------------------------------------------


def _hits(spark, sf_dir):
    rows, near = _nearest(spark, sf_dir, ranking.CANDIDATES)
    return rows, near.join(rows.select("vec_id", "label"), "vec_id").select("query_id", F.col("vec_id").alias("chunk_id"), F.col("label").alias("parent"), "score", F.col("rank").alias("position"))


@query(f"""WITH {_TOP}, c AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY rank) AS n FROM t WHERE rank <= 40)
SELECT query_id, vec_id AS chunk_id, label AS parent, rank AS position FROM c WHERE n <= 3""")
def h5_diversity_cap(spark, sf_dir):
    return ranking.diversify(_hits(spark, sf_dir)[1], ["query_id"]).select("query_id", "chunk_id", "parent", F.col("position").cast("long").alias("position"))


@query(f"""WITH {_TOP},
v AS (SELECT query_id, vec_id, label, score, rank FROM t WHERE rank <= 40),
labels AS (SELECT label, min(vec_id) AS first, dense_rank() OVER (ORDER BY label) - 1 AS i, count(*) OVER () AS n FROM embeddings GROUP BY label),
ring AS (SELECT a.label AS src, b.label AS dst FROM labels a JOIN labels b ON b.i = (a.i + 1) % a.n),
u AS (SELECT src AS a, dst AS b, src || '>' || dst AS id FROM ring UNION ALL SELECT dst, src, src || '>' || dst FROM ring),
one AS (SELECT a AS seed, b AS here, id FROM u), two AS (SELECT seed, u.b AS here FROM one JOIN u ON u.a = one.here AND u.id <> one.id),
near AS (SELECT seed, here, min(d) AS d FROM (SELECT seed, here, 1 AS d FROM one UNION ALL SELECT seed, here, 2 FROM two) WHERE here <> seed GROUP BY ALL),
g AS (SELECT query_id, here AS label, min(d) AS d FROM (SELECT DISTINCT query_id, label FROM v) JOIN near ON seed = label GROUP BY query_id, here),
gh AS (SELECT query_id, first AS vec_id, g.label, round(0.6 * pow(0.85, d - 1), 4) AS score FROM g JOIN labels USING (label)),
m AS (SELECT query_id, vec_id, label, score, false AS from_graph FROM v UNION ALL SELECT *, true FROM gh WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.query_id = gh.query_id AND v.vec_id = gh.vec_id)),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY from_graph, score DESC, vec_id) AS position FROM m),
c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY position) AS k FROM p) WHERE k <= 3),
r AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY query_id ORDER BY position) <= 50 THEN score ELSE score * 0.1 END AS rerank FROM c),
w AS (SELECT *, count_if(from_graph) OVER (PARTITION BY query_id) AS n_graph, row_number() OVER (PARTITION BY query_id ORDER BY rerank DESC, position) AS overall,
  row_number() OVER (PARTITION BY query_id, from_graph ORDER BY rerank DESC, position) AS own FROM r)
SELECT query_id, vec_id AS chunk_id, from_graph, round(rerank, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY rerank DESC, position) AS rank FROM w
WHERE CASE WHEN n_graph > 0 THEN CASE WHEN from_graph THEN own <= least(n_graph, 2) ELSE own <= 10 - least(n_graph, 2) END ELSE overall <= 10 END""")
def h1_hybrid_search(spark, sf_dir):
    """Ten hits for each query: vector candidates, neighbours of their parents in a ring of parents, cap, quota."""
    rows, hits = _hits(spark, sf_dir)
    hits = sinks.staged(hits, "hits")  # three plans read them
    parents = rows.groupBy("label").agg(F.min("vec_id").alias("first")).withColumn("i", F.row_number().over(Window.orderBy("label")) - 1)
    n = parents.agg(F.count("*").alias("n"))
    following = parents.crossJoin(F.broadcast(n)).select(F.col("label").alias("src"), F.pmod(F.col("i") + 1, F.col("n")).alias("i"))  # one row
    ring = following.join(parents.select("i", F.col("label").alias("dst")), "i")
    near = graph.expand(graph.edges(ring, "parent", "src", "NEXT", "parent", "dst"), parents.select(F.col("label").alias("key")), hops=2)
    first = parents.select(F.col("label").cast("string").alias("neighbor"), F.col("label").alias("parent"), F.col("first").alias("chunk_id"))
    seeds = hits.select("query_id", F.col("parent").cast("string").alias("seed")).distinct()
    found = seeds.join(near, "seed").groupBy("query_id", "neighbor").agg(F.min("distance").alias("distance")).join(first, "neighbor").select("query_id", "chunk_id", "parent", ranking.graph_prior(F.col("distance")).alias("score"))
    by = ["query_id"]
    merged = ranking.diversify(ranking.merge(hits.drop("position"), found, by), by)
    top = ranking.select_quota(ranking.rerank(merged, lambda: F.col("score"), by), 10, by)
    return top.select("query_id", "chunk_id", "from_graph", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


# ---- turns ----------------------------------------------------------------------------------------------------


def _pairs(spark, sf_dir):
    """User turns with the answer that follows, if one does."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = _t(spark, sf_dir, "conversations").withColumn("next_role", F.lead("role").over(w)).withColumn("next_text", F.lead("text").over(w))
    return rows.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("query"), F.when(F.col("next_role") == "assistant", F.col("next_text")).alias("answer"))


_PAIRS = """pairs AS (SELECT conv_id, turn, text AS query, CASE WHEN nr = 'assistant' THEN nt END AS answer FROM (
  SELECT *, lead(role) OVER w AS nr, lead(text) OVER w AS nt FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user')"""
_F1_STOP = "'the', 'a', 'an', 'is', 'are', 'was', 'were', 'it', 'its', 'this', 'that', 'to', 'of', 'in', 'for', 'on', 'and', 'or', 'be', 'been', 'being', 'have', 'has', 'had', 'do', 'does', 'did'"


@query(rf"""WITH {_PAIRS},
tok AS (SELECT conv_id, turn, s, w, count(*) AS n FROM (SELECT conv_id, turn, 'q' AS s, unnest(regexp_extract_all(lower(query), '[\p{{L}}\p{{N}}_]+')) AS w FROM pairs
  UNION ALL SELECT conv_id, turn, 'a', unnest(regexp_extract_all(lower(coalesce(answer, '')), '[\p{{L}}\p{{N}}_]+')) FROM pairs) WHERE w NOT IN ({_F1_STOP}) GROUP BY ALL),
size AS (SELECT conv_id, turn, sum(n) FILTER (s = 'q') AS q, sum(n) FILTER (s = 'a') AS a FROM tok GROUP BY ALL),
both_ AS (SELECT x.conv_id, x.turn, sum(least(x.n, y.n)) AS b FROM tok x JOIN tok y ON x.conv_id = y.conv_id AND x.turn = y.turn AND x.w = y.w AND x.s = 'q' AND y.s = 'a' GROUP BY ALL)
SELECT conv_id, turn, coalesce(round_even(2 * b / (q + a), 4), 0) AS f1 FROM pairs LEFT JOIN size USING (conv_id, turn) LEFT JOIN both_ USING (conv_id, turn)""")
def d6_token_f1(spark, sf_dir):
    return datasets.token_f1_rows(_pairs(spark, sf_dir), ["conv_id", "turn"], "query", "answer").select("conv_id", "turn", "f1")


@query("""SELECT conv_id, turn, role, last_value(CASE WHEN role = 'user' THEN left(text, 12) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS topic FROM conversations""")
def r11_carry_over(spark, sf_dir):
    rows = _t(spark, sf_dir, "conversations").withColumn("topic", F.when(F.col("role") == "user", F.left("text", F.lit(12))))
    return routing.carry_over(rows, ["topic"], "conv_id").select("conv_id", "turn", "role", F.col("topic_in_force").alias("topic"))


@query("""SELECT conv_id, left(arg_min(text, turn), 60) AS title, arg_max(text, turn) AS last_query, max(turn) AS last_time, count(*) AS turns
FROM conversations GROUP BY conv_id ORDER BY last_time DESC, conv_id LIMIT 50""")
def a1_conversations(spark, sf_dir):
    rows = serving.conversations(_t(spark, sf_dir, "conversations"), conversation="conv_id", time="turn", query="text")
    return rows.select("conv_id", "title", "last_query", "last_time", "turns")


@query(rf"""WITH {_PAIRS} SELECT conv_id, turn, coalesce(string_agg('User: ' || left(query, 300) || chr(10) || 'Assistant: ' || left(coalesce(answer, ''), 300), chr(10))
  OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), '') AS history FROM pairs""")
def w5_history(spark, sf_dir):
    return context.history(_pairs(spark, sf_dir), "conv_id", "turn").select("conv_id", "turn", "history")


@query(f"""WITH {_TOP} SELECT query_id, count(*) AS n_sources,
  string_agg('[' || rank || '] (label ' || label || ') chunk ' || vec_id || chr(10) || repeat('x', CAST(greatest(400, least(2000, floor(26572.0 / 5))) AS INT)), chr(10) || chr(10) ORDER BY rank) AS context
FROM t WHERE rank <= 5 GROUP BY query_id""")
def w2_context_blocks(spark, sf_dir):
    rows, near = _nearest(spark, sf_dir, 5)
    hits = near.join(rows.select("vec_id", "label"), "vec_id").select("query_id", "rank", F.concat(F.lit("label "), F.col("label")).alias("source"), F.concat(F.lit("chunk "), F.col("vec_id")).alias("title"), F.repeat(F.lit("x"), F.lit(3000)).alias("text"), F.lit("").alias("url"))
    return context.blocks(hits, "query_id")


@query(rf"""WITH {_PAIRS} SELECT conv_id, turn, query, md5(lower(regexp_replace(query, '^\s+|\s+$', '', 'g'))) AS query_hash FROM pairs WHERE length(answer) >= 80
QUALIFY row_number() OVER (PARTITION BY query_hash ORDER BY conv_id, turn) = 1""")
def d11_training_rows(spark, sf_dir):
    return datasets.training_rows(_pairs(spark, sf_dir), F.lit("You answer from the given sources."), [F.col("conv_id"), F.col("turn")]).select("conv_id", "turn", "query", "query_hash")


def _turns(spark, sf_dir):
    """Pairs as turns: intent by rule, tickets and latency from the turn's numbers."""
    p = _pairs(spark, sf_dir)
    key = F.concat(F.lit("DOC-"), F.col("conv_id").cast("string"))
    source = F.struct(F.lit("jira").alias("source"), F.concat(key, F.lit(": "), F.left("query", F.lit(40))).alias("title"), F.lit("https://tracker.example.com/browse/x").alias("url"), key.alias("issue_key"), (F.col("turn") % 2 == 1).alias("from_graph"), (F.pmod(F.crc32("query"), F.lit(100)) / 100).alias("score"))
    return p.select(
        F.concat_ws("-", "conv_id", "turn").alias("turn_id"), "query", F.coalesce(F.concat("answer", F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit(" See "), key)).otherwise("")), F.lit("")).alias("answer"), intent.route_of(F.col("query")).alias("intent"),
        F.array(source).alias("sources"), F.lit(None).cast("array<struct<source:string,operation:string,count:bigint,titles:array<string>>>").alias("summary"), (F.pmod(F.crc32("answer"), F.lit(90)) / 10).alias("total_time_s"), F.lit(None).cast("string").alias("error"))


@query()
def x12_evaluate_turns(spark, sf_dir):
    return evaluate.evaluate(_turns(spark, sf_dir), year=2025).select("turn_id", "intent", "faithfulness", "answer_relevance", "temporal_consistency", "weighted_score", "failure_tags", "quality_grade", "training_signal")


_LETTERS = "aeinrst"
_SUPPORT = """a AS (SELECT p.conv_id, p.turn, p.answer, d.text FROM pairs p JOIN documents d ON d.doc_id = p.conv_id WHERE p.answer IS NOT NULL),
said AS (SELECT conv_id, turn, s, pos FROM (SELECT conv_id, turn, unnest(x) AS s, unnest(range(len(x))) AS pos FROM (
  SELECT conv_id, turn, list_filter(list_transform(string_split(regexp_replace(answer, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: length(s) >= 16) AS x FROM a))),
seen AS (SELECT conv_id, turn, substr(text, CAST(i * 160 + 1 AS BIGINT), 200) AS w FROM (SELECT conv_id, turn, text, unnest(range(0, CASE WHEN length(text) = 0 THEN 0 ELSE (length(text) - 1) // 160 + 1 END)) AS i FROM a)),
best AS (SELECT said.conv_id, said.turn, pos, max(CASE WHEN list_sum(VS) = 0 OR list_sum(VW) = 0 THEN 0 ELSE list_dot_product(VS, VW) / sqrt(list_dot_product(VS, VS) * list_dot_product(VW, VW)) END) AS best FROM said JOIN seen USING (conv_id, turn) GROUP BY ALL)
SELECT a.conv_id, a.turn, coalesce(round(avg(CASE WHEN best > 0.97 THEN 1.0 WHEN best IS NOT NULL THEN 0.0 END), 4), 0.5) AS faithfulness FROM a LEFT JOIN best USING (conv_id, turn) GROUP BY a.conv_id, a.turn"""
for _n, _c in (("VS", "s"), ("VW", "w")):
    _SUPPORT = _SUPPORT.replace(_n, "[" + ", ".join(f"CAST(length({_c}) - length(replace({_c}, '{x}', '')) AS DOUBLE)" for x in _LETTERS) + "]")


@query(f"WITH {_PAIRS}, {_SUPPORT}")
def x2_sentence_support(spark, sf_dir):
    """Answers against the document of their conversation's number, by counts of letters as vectors."""
    embed = lambda c: F.array(*[(F.length(c) - F.length(F.replace(c, F.lit(x), F.lit("")))).cast("double") for x in _LETTERS])
    rows = _pairs(spark, sf_dir).where("answer is not null").join(_t(spark, sf_dir, "documents").select(F.col("doc_id").alias("conv_id"), "text"), "conv_id")
    rows = rows.select(F.concat_ws("-", "conv_id", "turn").alias("turn_id"), "conv_id", "turn", "answer", F.array("text").alias("contexts"))
    found = evaluate.approximate_faithfulness(rows, "turn_id", embed, 0.97)
    return rows.select("turn_id", "conv_id", "turn").join(found, "turn_id").select("conv_id", "turn", "faithfulness")


def _found(words: str) -> str:
    """The matches as words; letters beyond ASCII are no word boundary, which the SQL engine has to be told by a letter."""
    return f"len(regexp_extract_all(regexp_replace(text, '[\\x{{C0}}-\\x{{24F}}]', 'z', 'g'), '(?i)\\b(?:{words})\\b'))".replace("'t", "''t")


@query(f"""WITH m AS (SELECT conv_id, turn, regexp_matches(text, '{intent.KEY}') AS key, regexp_matches(text, '(?i){intent.FILE_NAME}') AS named, {_found(intent.LIVE)} AS l, {_found(intent.KNOWLEDGE)} AS docs, {_found(intent.BOTH)} AS wide
  FROM conversations WHERE role = 'user'), n AS (SELECT *, l + CASE WHEN key THEN 2 ELSE 0 END + CASE WHEN named THEN 2 ELSE 0 END AS live FROM m)
SELECT conv_id, turn, CASE WHEN key AND docs > 0 THEN 'both' WHEN live > 0 AND docs = 0 THEN 'sentries' WHEN docs > 0 AND live = 0 THEN 'rag' WHEN live > 0 AND wide > 0 THEN 'both'
  WHEN docs > 0 AND live > docs + 1 THEN 'sentries' WHEN live > 0 AND docs > live + 1 THEN 'rag' ELSE 'both' END AS intent FROM n""")
def r1_intents(spark, sf_dir):
    return _t(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", intent.route_of(F.col("text")).alias("intent"))


@query("SELECT event_type, event_id, round(avg(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 6) AS rolling FROM events")
def x17_rolling_series(spark, sf_dir):
    return evaluate.rolling_series(_t(spark, sf_dir, "events"), "event_type", "ts", "value", "event_id").select("event_type", "event_id", F.round("rolling", 6).alias("rolling"))


@query("WITH t AS (SELECT value FROM events ORDER BY ts DESC, value DESC LIMIT 50) SELECT count(*) AS n, round(avg(value), 4) AS rolling, round(60 - avg(value), 4) AS regression, 60 - avg(value) > 0.05 AS alert FROM t")
def x17_rolling_alarm(spark, sf_dir):
    return evaluate.rolling_quality(_t(spark, sf_dir, "events"), "ts", "value", 60.0)


@query("SELECT coalesce(event_type, 'overall') AS intent, count(*) AS samples, round(avg(value), 4) AS value FROM events GROUP BY ROLLUP (event_type)")
def d7_benchmark_averages(spark, sf_dir):
    return datasets.benchmark_averages(_t(spark, sf_dir, "events").withColumnRenamed("event_type", "intent"), ["value"])


@query("""WITH b AS (SELECT avg(value) / 100 AS m FROM events), l AS (SELECT avg(value) / 100 AS m FROM events WHERE event_type = 'click')
SELECT round(b.m, 4) AS all_faith, round(l.m, 4) AS live_faith, b.m < 0.80 OR l.m < 0.75 AS blocked FROM b, l""")
def d9_gates(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select(F.when(F.col("event_type") == "click", "sentries").otherwise("rag").alias("intent"), (F.col("value") / 100).alias("faithfulness"), (F.col("value") / 100).alias("score"))
    averages = datasets.benchmark_averages(e, ["faithfulness", "score"])
    base = spark.range(1).select(F.lit("v0").alias("version"), F.lit(0.0).alias("score"))
    return datasets.gates(averages, base).select("all_faith", "live_faith", F.coalesce(F.col("reason").isin("faithfulness", "live_faithfulness"), F.lit(False)).alias("blocked"))


@query("SELECT role AS intent, count(*) AS n, round(count(*) / (SELECT count(*) FROM conversations), 4) AS share FROM conversations GROUP BY role")
def a7_balance(spark, sf_dir):
    return serving.balance(_t(spark, sf_dir, "conversations").withColumnRenamed("role", "intent")).select("intent", "n", "share")


# ---- upserts and catalogue ------------------------------------------------------------------------------------


@query("""SELECT user_id, event_id, ts, value FROM (SELECT *, 0 AS f FROM events UNION ALL SELECT event_id, ts, user_id, event_type, value + 1, props, 1 FROM events)
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC, f DESC) = 1""")
def k1_upsert(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    return sinks.upsert(e, e.withColumn("value", F.col("value") + 1), ["user_id"], F.struct("ts", "event_id")).select("user_id", "event_id", "ts", "value")


@query("SELECT doc_id FROM documents UNION SELECT doc_id FROM labels")
def k9_insert_missing(spark, sf_dir):
    return sinks.insert_missing(_t(spark, sf_dir, "labels").select("doc_id"), _t(spark, sf_dir, "documents").select("doc_id"), ["doc_id"])


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def k12_delete_keys(spark, sf_dir):
    return sinks.delete_keys(_t(spark, sf_dir, "documents").select("doc_id"), _t(spark, sf_dir, "labels"), ["doc_id"])


@query("SELECT vec_id, CAST('0x' || substr(md5('chunk_' || vec_id), 1, 15) AS BIGINT) AS point_id FROM embeddings")
def k5_vector_points(spark, sf_dir):
    rows = _t(spark, sf_dir, "embeddings").withColumn("chunk_id", F.concat(F.lit("chunk_"), F.col("vec_id")))
    return sinks.vector_points(rows).select("vec_id", "point_id")


def _tickets(spark, sf_dir):
    status = F.element_at(F.create_map(F.lit("F"), F.lit("Done"), F.lit("O"), F.lit("To Do"), F.lit("P"), F.lit("In Progress")), F.col("o_orderstatus"))
    return _t(spark, sf_dir, "orders").select(
        F.concat(F.lit("ORD-"), F.col("o_orderkey")).alias("issue_key"), F.lit("ORD").alias("project_key"), status.alias("status_category"), F.lower(status).alias("status"), F.concat(F.lit("Customer#"), F.col("o_custkey")).alias("assignee"),
        F.lit(None).cast("string").alias("reporter"), F.lit("order").alias("issue_type"), F.col("o_orderpriority").alias("priority"), F.col("o_orderpriority").alias("summary"), F.lit("").alias("description"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("created"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("updated"))


@query("""SELECT 'ORD-' || o_orderkey AS issue_key, strftime(o_orderdate, '%Y-%m-%d') AS created FROM orders WHERE o_orderstatus = 'F' AND contains(lower(o_orderpriority), 'urgent') AND strftime(o_orderdate, '%Y-%m-%d') >= '1995-01-01'
ORDER BY created DESC, issue_key LIMIT 20""")
def q15_project_issues(spark, sf_dir):
    spec = catalogue.build("jira", "get_project_issues", project_key="ORD", status="done", search="urgent", created_after="1995-01-01", sort_by="created", limit=20)
    return catalogue.run(spec, {"tickets": _tickets(spark, sf_dir)}).select("issue_key", "created")


@query("""SELECT 'ORD-' || o_orderkey AS issue_key, strftime(o_orderdate, '%Y-%m-%d') AS created FROM orders WHERE o_orderstatus = 'O' AND contains(lower(o_orderpriority), 'high') ORDER BY created DESC, issue_key LIMIT 30""")
def q14_jql(spark, sf_dir):
    spec = catalogue.build("jira", "get_issues", project_key="ORD", status_category="To Do", summary="high", sort_by="created", limit=30)
    return catalogue.run(spec, {"tickets": _tickets(spark, sf_dir)}).select("issue_key", "created")


@query("""SELECT CAST(c_nationkey AS VARCHAR) AS project_path, c_custkey AS milestone_id FROM customer WHERE c_mktsegment = 'BUILDING'
QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) <= 3""")
def q9_limit_per_project(spark, sf_dir):
    rows = _t(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("project_path"), F.col("c_custkey").alias("milestone_id"), F.col("c_acctbal").alias("due_date"), F.col("c_mktsegment").alias("state"), F.col("c_name").alias("title"))
    return catalogue.run(catalogue.build("gitlab", "get_milestones", state="BUILDING", limit="3"), {"milestones": rows}).select("project_path", "milestone_id")


@query("""SELECT doc_id, strftime(make_date(2024, 1, 1), '%Y-%m-%d') AS day FROM documents WHERE contains(lower(text), 'licensed under') OR contains(lower(source), 'licensed under') ORDER BY doc_id LIMIT 50""")
def q25_search_pages(spark, sf_dir):
    pages = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), F.col("source").alias("title"), F.col("text").alias("content"), F.lit("2024-01-01").alias("last_modified"), F.lit("DOC").alias("space_key"))
    return catalogue.search_with_fallback(pages, "Licensed under", limit=50).select(F.col("page_id").alias("doc_id"), F.col("last_modified").alias("day"))


@query("""WITH r AS (SELECT DISTINCT c_nationkey AS call, c_mktsegment AS project, count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) AS n FROM customer)
SELECT call, CAST(sum(n) AS BIGINT) AS total, bool_or(n >= 15) AS more FROM r GROUP BY call""")
def q28_count_results(spark, sf_dir):
    w = Window.partitionBy("c_nationkey", "c_mktsegment")
    r = _t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("call"), F.lit("jira").alias("source"), F.lit("get").alias("operation"), F.col("c_mktsegment").alias("project"), F.lit(True).alias("success"), F.count("*").over(w).alias("n"), F.lit(15).alias("limit"))
    return catalogue.count_results(r).select("call", "total", "more")


# ---- streams --------------------------------------------------------------------------------------------------


def _drained(spark, stream):
    """The whole result of an aggregated stream, as a table in the shared folder; each batch replaces it."""
    out = sinks.scratch(spark, "drained")
    spark.createDataFrame([], stream.schema).write.parquet(out)
    q = stream.writeStream.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out)).outputMode("complete").option("checkpointLocation", sinks.scratch(spark, "stream")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def st1_event_windows(spark, sf_dir):
    from kelpie.streaming import jobs

    schema = _t(spark, sf_dir, "events").schema
    stream = jobs.files(spark, schema, f"{sf_dir}/event[s].parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    out = _drained(spark, jobs.event_windows(stream))
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


from kelpie import catalogue_queries, graph_queries, index_queries, operator_queries, rule_queries, source_queries, stream_queries, temporal_queries, turn_queries  # noqa: E402, F401  (add their queries)
