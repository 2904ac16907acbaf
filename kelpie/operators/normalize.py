"""Raw records of each source -> one schema of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpie.functions.text import clean_text, language_of, strip_html, text_or_empty

COLUMNS = "source source_type document_id project_id project_name group_name title content author created_at updated_at status labels url metadata normalized_at".split()


def _filled(c: str | Column, default: str = "") -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(default))


def _document(raw: DataFrame, source: str, kind: str, id: Column, content: Column, metadata: list[str], **over: Column) -> DataFrame:
    have = lambda c: _filled(c) if c in raw.columns else F.lit("")
    values = {
        "source": F.lit(source), "source_type": F.lit(kind), "document_id": id, "project_id": F.col("project_id").cast("string") if "project_id" in raw.columns else F.lit(""),
        "project_name": have("project_name"), "group_name": have("group_name"), "title": have("title"), "content": content, "author": _filled("author", "unknown") if "author" in raw.columns else F.lit("unknown"),
        "created_at": have("created_at"), "updated_at": have("updated_at"), "status": have("state"),
        "labels": F.coalesce("labels", F.array().cast("array<string>")) if "labels" in raw.columns else F.array().cast("array<string>"), "url": have("web_url"),
        "metadata": F.to_json(F.struct(*[F.col(m) for m in metadata if m in raw.columns])), "normalized_at": F.current_timestamp(),
    } | over
    return raw.select(*[values[c].alias(c) for c in COLUMNS])


def _with_comments(first: list[Column]) -> Column:
    comments = F.transform(F.filter(F.coalesce("comments", F.array()), lambda c: text_or_empty(c["body"]) != ""), lambda c: F.concat(F.lit("Comment by "), text_or_empty(c["author"]), F.lit(": "), c["body"]))
    return clean_text(F.array_join(F.concat(F.array_compact(F.array(*[F.nullif(text_or_empty(x), F.lit("")) for x in first])), comments), "\n\n"))


def _id(kind: str, *cols: str | Column) -> Column:
    return F.concat_ws("_", F.lit(kind), *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols])


def issues(raw: DataFrame) -> DataFrame:
    raw = raw.withColumn("comment_count", F.size(F.coalesce("comments", F.array())))
    return _document(raw, "gitlab", "issue", _id("gitlab_issue", "project_id", "issue_id"), _with_comments([F.col("description")]), ["issue_id", "milestone", "comment_count"])


def merge_requests(raw: DataFrame) -> DataFrame:
    branches = F.concat(F.lit("Branch: "), text_or_empty(F.col("source_branch")), F.lit(" → "), text_or_empty(F.col("target_branch")))
    return _document(raw, "gitlab", "merge_request", _id("gitlab_mr", "project_id", "mr_id"), _with_comments([branches, F.col("description")]), ["mr_id", "source_branch", "target_branch", "merged_at"])


def milestones(raw: DataFrame) -> DataFrame:
    line = lambda label, c: F.when(text_or_empty(F.col(c)) != "", F.concat(F.lit(label), F.col(c)))
    lines = F.concat_ws("\n", F.concat(F.lit("Milestone: "), text_or_empty(F.col("title"))), F.concat(F.lit("State: "), _filled("state", "unknown")), F.nullif(F.col("description"), F.lit("")), line("Due date: ", "due_date"), line("Start date: ", "start_date"))
    return _document(raw, "gitlab", "milestone", _id("gitlab_milestone", "project_id", "milestone_id"), clean_text(lines), ["milestone_id", "milestone_iid", "state", "due_date", "start_date"], author=F.lit("unknown"))


def code_files(raw: DataFrame) -> DataFrame:
    raw = raw.withColumn("language", language_of(F.col("file_path"), F.col("extension")))
    head = F.concat(F.lit("File: "), F.col("file_path"), F.lit("  ("), F.col("language"), F.lit(")\nProject: "), _filled("project_name"), F.lit("  |  Branch: "), _filled("ref", "main"), F.lit("\n" + "─" * 60 + "\n"))
    title = F.concat(F.col("file_path"), F.lit("  ["), _filled("project_name"), F.lit("]"))
    return _document(raw, "gitlab", "code_file", _id("gitlab_code", "project_id", F.replace("file_path", F.lit("/"), F.lit("_"))), F.concat(head, _filled("content")), ["file_path", "language", "ref", "size_bytes"], title=title)


def tickets(raw: DataFrame) -> DataFrame:
    return _document(
        raw, "jira", "issue", _id("jira_issue", "issue_key"), _with_comments([F.col("summary"), F.col("description")]), ["issue_type", "priority", "assignee", "resolution", "parent_key", "fix_versions", "components", "issue_links"],
        title=F.concat(F.lit("["), F.col("issue_key"), F.lit("] "), _filled("summary")), project_id=_filled("project_key"), author=_filled("reporter", "unknown"), created_at=_filled("created"), updated_at=_filled("updated"))


def pages(raw: DataFrame, domain: str = "") -> DataFrame:
    location = F.when(text_or_empty(F.col("breadcrumb")) != "", F.concat(F.lit("Location: "), F.col("breadcrumb")))
    tags = F.when(F.size(F.coalesce("labels", F.array())) > 0, F.concat(F.lit("Tags: "), F.array_join("labels", ", ")))
    body = clean_text(F.concat_ws("\n\n", location, F.nullif(clean_text(strip_html(F.col("content"))), F.lit("")), tags))
    url = F.coalesce(F.nullif(F.col("web_url"), F.lit("")), F.concat(F.lit(domain.rstrip("/") + "/wiki/spaces/"), _filled("space_name"), F.lit("/pages/"), F.col("page_id").cast("string")) if domain else F.lit(""))
    return _document(raw, "confluence", "page", _id("confluence_page", "page_id"), body, ["space_id", "page_id", "version", "ancestors", "breadcrumb"], project_id=F.col("space_id").cast("string"), project_name=_filled("space_name"), url=url, status=_filled("status"))


def long_enough(docs: DataFrame, least: int = 30) -> DataFrame:
    return docs.where(F.length("content") >= least)


def by_type(docs: DataFrame) -> DataFrame:
    return docs.groupBy("source_type").agg(F.count("*").alias("documents"), F.sum(F.length("content")).alias("characters"))
