"""Readers of landed source records (JSON lines), each with its schema; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpie.functions.text import extension_of, is_code_file, printable

COMMENTS = "comments array<struct<author:string,body:string,created_at:string,system:boolean>>"
_GITLAB = f"source string, type string, group_name string, project_id long, project_name string, title string, description string, state string, author string, created_at string, updated_at string, labels array<string>, web_url string, {COMMENTS}, ingested_at timestamp"
SCHEMAS = {
    "issues": f"{_GITLAB}, issue_id long, milestone string",
    "merge_requests": f"{_GITLAB}, mr_id long, source_branch string, target_branch string, merged_at string",
    "milestones": "project_id long, project_name string, group_name string, milestone_id long, milestone_iid long, title string, description string, state string, due_date string, start_date string, created_at string, updated_at string, web_url string, ingested_at timestamp",
    "tree": "project_id long, project_name string, group_name string, path string, name string, type string, ref string, content_base64 string, web_url string",
    "tickets": "project_key string, project_name string, issue_key string, issue_id string, summary string, description string, status string, issue_type string, priority string, assignee string, reporter string, created string, updated string, labels array<string>, comments array<struct<author:string,body:string,created:string>>, parent_key string, issue_links array<struct<type:string,target:string,target_summary:string,target_status:string,direction:string>>, fix_versions array<string>, components array<string>, resolution string, epic_link string, epic_parent string, story_points double, due_date string, subtasks array<struct<key:string,summary:string,status:string>>, archived boolean, ingested_at timestamp",
    "pages": "space_id string, space_name string, page_id string, title string, content string, status string, author string, created_at string, web_url string, version int, ancestors array<struct<id:string,title:string>>, breadcrumb string, labels array<string>, ingested_at timestamp",
    "chunks": "chunk_id string, parent_document_id string, text string, embedding array<float>, token_count int, chunk_index int, total_chunks int, source string, source_type string, title string, url string, status string, author string, project_id string, project_name string, group_name string, created_at string, embedding_model string, labels array<string>",
    "projects": "id long, name string, path_with_namespace string, description string, last_activity_at string, archived boolean, default_branch string, web_url string",
    "turns": "turn_id string, conversation_id string, query string, answer string, intent string, timing map<string,double>, sources array<struct<source:string,title:string,url:string,project:string,issue_key:string,content:string,from_graph:boolean,relationship:string,graph_distance:int,score:double>>, context_snippets array<struct<title:string,source:string,text:string,from_graph:boolean,relationship:string>>, summary array<struct<source:string,operation:string,count:long,titles:array<string>>>, error string, timestamp timestamp, total_time_s double, pipeline string",
    "eval_set": "query string, expected_answer string, generated_answer string, contexts array<string>, intent string",
}


def read(spark: SparkSession, kind: str, path: str) -> DataFrame:
    """Records of a kind; a malformed line becomes a row with only ``_corrupt`` set."""
    return spark.read.schema(SCHEMAS[kind] + ", _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def good(rows: DataFrame) -> DataFrame:
    return rows.where("_corrupt is null").drop("_corrupt")


def corrupt_count(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("lines"), F.count_if(F.col("_corrupt").isNotNull()).alias("malformed"))


def user_comments(rows: DataFrame) -> DataFrame:
    """Without the comments that the system wrote."""
    return rows.withColumn("comments", F.filter("comments", lambda c: ~F.coalesce(c["system"], F.lit(False))))


def distinct_projects(rows: DataFrame) -> DataFrame:
    return rows.where(~F.coalesce(F.col("archived"), F.lit(False))).dropDuplicates(["id"])


def code_files(tree: DataFrame, most_bytes: int = 150 * 1024) -> DataFrame:
    """Blobs that are code by path, of at most 150 KB and printable: content decoded, sizes in UTF-8 bytes."""
    raw = F.unbase64(F.regexp_replace("content_base64", r"\s", ""))
    rows = tree.where((F.col("type") == "blob") & is_code_file(F.col("path"))).withColumn("_raw", raw).where(F.octet_length("_raw") <= most_bytes)
    rows = rows.withColumn("content", F.try_validate_utf8(F.col("_raw").cast("string"))).where(F.col("content").isNotNull() & printable(F.col("content")))
    name = F.element_at(F.split("path", "/"), -1)
    return rows.select("project_id", "project_name", "group_name", F.col("path").alias("file_path"), name.alias("file_name"), extension_of(name).alias("extension"), "ref", "content", F.octet_length("content").alias("size_bytes"), "web_url")


def flat_tickets(rows: DataFrame) -> DataFrame:
    """Active tickets; the epic is the link field, else an epic parent."""
    return rows.where(~F.coalesce(F.col("archived"), F.lit(False))).withColumn("epic_link", F.coalesce("epic_link", "epic_parent")).drop("epic_parent")


def linked_tickets(raw: DataFrame) -> DataFrame:
    """issue_links and subtasks from the tracker's own form: links(type struct<name,inward,outward>, inwardIssue,
    outwardIssue struct<key,summary,status>) -> struct(type, target, target_summary, target_status, direction), the inward
    issue where a link has both; subtasks: null is empty."""
    def one(link, side: str, phrase: str):
        issue = link[f"{side}Issue"]
        made = F.struct(F.coalesce(link["type"][phrase], F.lit("relates to")).alias("type"), issue["key"].alias("target"), issue["summary"].alias("target_summary"), issue["status"].alias("target_status"), F.lit(side).alias("direction"))
        return F.when(issue["key"].isNotNull(), made)

    links = F.transform(F.coalesce("links", F.array()), lambda x: F.coalesce(one(x, "inward", "inward"), one(x, "outward", "outward")))
    tasks = F.filter("subtasks", lambda t: t.isNotNull())
    return raw.withColumn("issue_links", F.filter(links, lambda x: x.isNotNull())).withColumn("subtasks", tasks).drop("links")


def chunks_from(spark: SparkSession, source: str, path: str) -> DataFrame:
    """Chunks of either store: 'jsonl' lines, the malformed left out, or 'table' (Parquet)."""
    if source == "jsonl":
        return good(read(spark, "chunks", path))
    if source == "table":
        return spark.read.parquet(path)
    raise ValueError(f"no store {source}")


def with_breadcrumb(rows: DataFrame) -> DataFrame:
    return rows.withColumn("breadcrumb", F.array_join(F.transform(F.coalesce("ancestors", F.array()), lambda a: a["title"]), " > "))


def scored_pairs(rows: DataFrame) -> DataFrame:
    """Evaluation lines with a question and an answer to judge by."""
    has = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) != ""
    return rows.where(has("query") & (has("expected_answer") | has("generated_answer")))


def embedded(chunks: DataFrame, source: str | None = None) -> DataFrame:
    rows = chunks.where((F.size("embedding") > 0) & (F.coalesce("chunk_id", F.lit("")) != ""))
    return rows.where(F.col("source") == source) if source else rows
