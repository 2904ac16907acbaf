"""The fixed catalogue of parameterised queries over landed tables.

A ``QuerySpec`` names a table, conjunctive filters, an order, a projection and a limit; ``run`` compiles it to one
DataFrame, so filters and columns reach the scan. ``OPERATIONS`` maps source.operation to a spec builder.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field
from datetime import UTC, datetime, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpie.functions import intent
from kelpie.functions.intent import STATUS_CATEGORIES


@dataclass(frozen=True)
class QuerySpec:
    table: str
    where: tuple[tuple[str, str, object], ...] = ()
    order: tuple[tuple[str, bool], ...] = ()  # column, descending
    columns: tuple[str, ...] = ()
    limit: int | None = None
    per: str | None = None  # limit within each value of this column
    left: Mapping[str, int] = field(default_factory=dict)  # column -> characters kept


def condition(name: str, op: str, value: object) -> Column:
    c = F.col(name)
    match op:
        case "=":
            return c == value
        case "~=":
            return F.lower(c) == str(value).lower()
        case ">=":
            return c >= value
        case "<=":
            return c <= value
        case ">":
            return c > value
        case "<":
            return c < value
        case "in":
            return c.isin(list(value))
        case "contains":
            return F.contains(F.lower(c), F.lit(str(value).lower()))
        case "prefix":
            return c.startswith(str(value))
        case "has":
            return F.array_contains(c, value)
        case "any contains":
            names, = (str(value[0]).split("|"),)
            return _any_contains(names, str(value[1]))
        case "not empty":
            return c.isNotNull() & (c.cast("string") != "")
        case "!=":  # a row without a value differs too
            return ~c.eqNullSafe(F.lit(value))
        case "exists":
            return c.isNotNull() if value else c.isNull()
        case "or":  # any of several conditions
            return functools.reduce(lambda a, b: a | b, [F.coalesce(condition(*one), F.lit(False)) for one in value], F.lit(False))
    raise ValueError(f"unknown operator {op}")


def _any_contains(names: list[str], text: str) -> Column:
    out = F.lit(False)
    for n in names:
        out = out | F.coalesce(F.contains(F.lower(F.col(n)), F.lit(text.lower())), F.lit(False))
    return out


def run(spec: QuerySpec, tables: Mapping[str, DataFrame]) -> DataFrame:
    rows = tables[spec.table]
    for name, op, value in spec.where:
        rows = rows.where(condition(name, op, value))
    order = [F.desc_nulls_last(c) if d else F.asc_nulls_last(c) for c, d in spec.order]
    if order and "id" in rows.columns and not any(c == "id" for c, _ in spec.order):
        order.append(F.asc_nulls_last("id"))
    if spec.limit is not None and spec.per:
        w = Window.partitionBy(spec.per).orderBy(*(order or [F.col(spec.per)]))
        rows = rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= spec.limit).drop("_n")
    elif order and spec.limit is not None:
        rows = rows.orderBy(*order).limit(spec.limit)
    elif order:
        rows = rows.orderBy(*order)
    elif spec.limit is not None:
        rows = rows.limit(spec.limit)
    for c, n in spec.left.items():
        rows = rows.withColumn(c, F.left(c, F.lit(n)))
    return rows.select(*spec.columns) if spec.columns else rows


def _given(*conditions: tuple[str, str, object]) -> tuple[tuple[str, str, object], ...]:
    """Those conditions whose value is given."""
    return tuple(c for c in conditions if c[2] not in (None, "", "all", ()))


_CATEGORIES = {k.lower(): v for k, v in STATUS_CATEGORIES.items()}
#: Parameters that are not text; routed calls state all of theirs as text.
_KINDS: dict[str, Callable[[str], object]] = {
    **dict.fromkeys(("limit", "days", "mr_iid", "board_id"), int), **dict.fromkeys(("owned", "membership", "recursive", "include_changelog"), lambda x: x.lower() == "true")}


def _gitlab(table: str, order: tuple = (("updated_at", True),), state: str | None = None, limit: int = 50, **left: int) -> Callable[..., QuerySpec]:
    default, most = state, limit

    def build(project: str | None = None, state: str | None = default, labels: str | None = None, assignee: str | None = None, author: str | None = None, target_branch: str | None = None, ref: str | None = None, status: str | None = None, search: str | None = None, limit: int = most) -> QuerySpec:
        return QuerySpec(table, _given(("project_path", "~=", project), ("state", "=", state), ("labels", "has", labels), ("assignee", "~=", assignee), ("author", "~=", author), ("target_branch", "=", target_branch), ("ref", "=", ref), ("status", "=", status), ("title", "contains", search)), order, limit=limit, left=left)

    return build


def _commits(project: str, branch: str | None = None, file_path: str | None = None, since: str | None = None, limit: int = 50) -> QuerySpec:
    return QuerySpec("commits", _given(("project_path", "~=", project), ("branch", "=", branch), ("files", "has", file_path), ("created_at", ">=", since)), (("created_at", True), ("id", False)), limit=limit)


def _issues(project_key: str | None = None, status: str | None = None, status_category: str | None = None, assignee: str | None = None, reporter: str | None = None, issue_type: str | None = None, priority: str | None = None, search: str | None = None, text: str | None = None, summary: str | None = None, created_after: str | None = None, created_before: str | None = None, sort_by: str | None = None, limit: int = 100) -> QuerySpec:
    """Tickets by any of the fields; a known status means its category. The newest created come first if asked for or
    if a date is given, else the last updated. Query strings are not parsed: callers give the fields."""
    category = status_category or _CATEGORIES.get((status or "").lower())
    where = _given(
        ("project_key", "=", project_key), ("status_category", "=", category), ("status", "~=", None if category else status), ("assignee", "~=", assignee), ("reporter", "~=", reporter), ("issue_type", "~=", issue_type), ("priority", "~=", priority),
        ("summary", "any contains", ("summary|description", search or text) if search or text else None), ("summary", "contains", summary), ("created", ">=", created_after), ("created", "<=", created_before))
    newest = sort_by == "created" or created_after or created_before
    return QuerySpec("tickets", where, (("created" if newest else "updated", True), ("issue_key", False)), limit=limit, left={"description": 800})


def _project_issues(project_key: str, **fields: object) -> QuerySpec:
    return _issues(project_key, **fields)


def _recent_pages(space_key: str | None = None, days: int = 7, limit: int = 30, now: datetime | None = None) -> QuerySpec:
    since = ((now or datetime.now(UTC)) - timedelta(days=days)).strftime("%Y-%m-%d")
    return QuerySpec("pages", _given(("space_key", "=", space_key), ("last_modified", ">=", since)), (("last_modified", True), ("page_id", False)), limit=min(limit, 50))


_NEWEST = (("updated", True), ("issue_key", False))
OPERATIONS: dict[str, Callable[..., QuerySpec]] = {
    "gitlab.list_projects": lambda search=None, owned=None, membership=None, limit=100: QuerySpec("projects", _given(("name", "contains", search), ("owned", "=", owned), ("membership", "=", membership)), (("last_activity_at", True), ("id", False)), limit=limit),
    "gitlab.get_issues": _gitlab("issues", state="opened", description=800),
    "gitlab.get_merge_requests": _gitlab("merge_requests", state="opened", description=800),
    "gitlab.get_mr_diff": lambda project, mr_iid: QuerySpec("mr_changes", _given(("project_path", "~=", project), ("mr_iid", "=", mr_iid)), (("position", False),), left={"diff": 3000}),
    "gitlab.get_pipelines": _gitlab("pipelines", (("id", True),), limit=30),
    "gitlab.get_commits": _commits,
    "gitlab.get_file": lambda project, file_path, ref=None: QuerySpec("files_at_ref", _given(("project_path", "~=", project), ("file_path", "=", file_path), ("ref", "=", ref)) + (() if ref else (("is_default", "=", True),)), limit=1),
    "gitlab.get_project_info": lambda project: QuerySpec("projects", (("project_path", "~=", project),), limit=1),
    "gitlab.get_milestones": lambda project=None, state=None, search=None, limit=50: QuerySpec("milestones", _given(("project_path", "~=", project), ("state", "=", state), ("title", "contains", search)), (("due_date", False), ("milestone_id", False)), limit=limit, per=None if project else "project_path"),
    "gitlab.get_repository_tree": lambda project, path="", ref=None, recursive=False, limit=100: QuerySpec("tree", _given(("project_path", "~=", project), ("ref", "=", ref), ("path", "prefix", path), ("parent", "=", None if recursive else path or None)), (("type", True), ("path", False)), limit=limit),
    "gitlab.search_code": lambda query, project=None, limit=20: QuerySpec("files", _given(("project_path", "~=", project), ("content", "contains", query)), (("project_path", False), ("file_path", False)), limit=limit),
    "gitlab.get_branches": lambda project, search=None, limit=50: QuerySpec("branches", _given(("project_path", "~=", project), ("name", "contains", search)), (("name", False),), limit=limit),
    "jira.list_projects": lambda limit=500: QuerySpec("jira_projects", (), (("name", False),), limit=limit),
    "jira.get_issues": _issues,
    "jira.get_project_issues": _project_issues,
    "jira.get_issue": lambda issue_key, include_changelog=False: QuerySpec("tickets_with_changes" if include_changelog else "tickets", (("issue_key", "=", issue_key.upper()),), limit=1),
    "jira.get_issue_changelog": lambda issue_key, limit=None: QuerySpec("ticket_changes", (("issue_key", "=", issue_key.upper()),), (("changed_at", False), ("field", False)), limit=limit),
    "jira.get_boards": lambda project_key=None, limit=20: QuerySpec("boards", _given(("project_key", "=", project_key)), (("board_id", False),), limit=limit),
    "jira.get_sprint_issues": lambda board_id, sprint_name=None, limit=100: QuerySpec("sprint_tickets", (("board_id", "=", board_id),) + ((("sprint_name", "contains", sprint_name),) if sprint_name else (("current", "=", True),)), _NEWEST, limit=limit),
    "jira.get_user_issues": lambda assignee, project_key=None, status=None, limit=100: QuerySpec("tickets", _given(("assignee", "~=", assignee), ("project_key", "=", project_key), ("status", "~=", status)), _NEWEST, limit=limit),
    "confluence.get_spaces": lambda limit=50: QuerySpec("spaces", (), (("space_key", False),), limit=limit),
    "confluence.get_pages": lambda space_key, title_contains=None, limit=50: QuerySpec("pages", _given(("space_key", "=", space_key), ("title", "contains", title_contains)), (("page_id", False),), limit=limit),
    "confluence.get_page": lambda page_id: QuerySpec("pages", (("page_id", "=", page_id),), limit=1),
    "confluence.get_page_comments": lambda page_id, limit=25: QuerySpec("page_comments", (("page_id", "=", page_id),), (("created_at", False),), limit=limit),
    "confluence.search_pages": lambda query, space_key=None, limit=20: QuerySpec("pages", _given(("space_key", "=", space_key), ("title", "any contains", ("title|content", query))), (("last_modified", True), ("page_id", False)), limit=min(limit, 50)),
    "confluence.get_recent_pages": _recent_pages,
    "confluence.get_child_pages": lambda parent_page_id, limit=50: QuerySpec("pages", (("parent_id", "=", parent_page_id),), (("page_id", False),), limit=limit),
}


def build(source: str, operation: str, **params: object) -> QuerySpec:
    """The spec of an operation; raises for an unknown one or wrong parameters. Text takes the parameter's type."""
    if f"{source}.{operation}" not in OPERATIONS:
        raise KeyError(f"no operation {source}.{operation}")
    return OPERATIONS[f"{source}.{operation}"](**{k: _KINDS[k](v) if k in _KINDS and isinstance(v, str) else v for k, v in params.items()})


def files_at_refs(files: DataFrame, projects: DataFrame) -> DataFrame:
    """files(project_path, ref, ...) with is_default: at the project's default branch (main if it states none)."""
    own = projects.select("project_path", F.coalesce(F.nullif("default_branch", F.lit("")), F.lit("main")).alias("default_branch"))
    return files.join(own, "project_path", "left").withColumn("is_default", F.col("ref") == F.coalesce("default_branch", F.lit("main"))).drop("default_branch")


def changelog(histories: DataFrame) -> DataFrame:
    """One row per changed field of histories(issue_key, values array<struct<author,created,items array<struct<field,
    fromString,toString>>>>)."""
    entries = histories.select("issue_key", F.explode("values").alias("e"))
    changes = entries.select("issue_key", "e.author", F.col("e.created").alias("changed_at"), F.explode("e.items").alias("i"))
    return changes.select("issue_key", "author", "changed_at", "i.field", F.col("i.fromString").alias("from"), F.col("i.toString").alias("to"))


def with_changes(tickets: DataFrame, changes: DataFrame) -> DataFrame:
    """Tickets with all their changes, oldest first; none is an empty list."""
    one = F.struct("changed_at", "field", "from", "to", "author")
    held = changes.groupBy("issue_key").agg(F.array_sort(F.collect_list(one)).alias("changes"))  # a ticket's own
    none = F.from_json(F.lit("[]"), held.schema["changes"].dataType.simpleString())
    return tickets.join(held, "issue_key", "left").withColumn("changes", F.coalesce("changes", none))


def search_with_fallback(pages: DataFrame, query: str, space_key: str | None = None, limit: int = 20) -> DataFrame:
    """Pages that hold the query; where there are none, pages whose title holds the first four words of more than
    three letters."""
    tables = {"pages": pages}
    first = run(build("confluence", "search_pages", query=query, space_key=space_key, limit=limit), tables)
    words = [w for w in re.findall(r"\w+", query) if len(w) > 3][:4]
    if not words:
        return first
    second = run(QuerySpec("pages", _given(("space_key", "=", space_key)) + tuple(("title", "contains", w) for w in words), (("last_modified", True), ("page_id", False)), limit=limit), tables)
    none = first.agg(F.count("*").alias("_n")).where("_n = 0")
    return first.unionByName(second.crossJoin(F.broadcast(none)).drop("_n"))  # one row, or none


def sprint_of(sprints: DataFrame) -> DataFrame:
    """For each board the active sprint, else the first future one."""
    rank = F.when(F.col("state") == "active", 0).when(F.col("state") == "future", 1)
    return sprints.withColumn("_r", rank).where("_r is not null").groupBy("board_id").agg(F.min_by("sprint_id", F.struct("_r", "start_date", "sprint_id")).alias("sprint_id"))


def sprint_tickets(boards: DataFrame, sprints: DataFrame, tickets: DataFrame) -> DataFrame:
    """The table behind get_sprint_issues: boards(board_id, type), sprints(board_id, sprint_id, name, state, start_date),
    tickets(sprint_id, ...) -> tickets with board_id, sprint_name, current (of the sprint that ``sprint_of`` picks) and
    error; a kanban board, and one without sprints, has one row with an error and no ticket."""
    picked = sprint_of(sprints).select("board_id", F.col("sprint_id").alias("picked"))
    all_sprints = sprints.select("board_id", "sprint_id", F.col("name").alias("sprint_name")).join(picked, "board_id", "left")
    kanban = F.col("type") == "kanban"
    known = boards.join(all_sprints, "board_id", "left")
    error = F.when(kanban, "kanban boards have no sprints").when(F.col("sprint_id").isNull(), "no sprints")
    known = known.withColumn("error", error).withColumn("current", kanban | F.col("sprint_id").isNull() | F.coalesce(F.col("sprint_id") == F.col("picked"), F.lit(False))).drop("picked", "type")
    bad = known.where("error is not null").dropDuplicates(["board_id"]).withColumn("sprint_id", F.lit(None).cast(sprints.schema["sprint_id"].dataType))
    return known.where("error is null").join(tickets, "sprint_id").unionByName(bad, allowMissingColumns=True)


def account_of(names: DataFrame, users: DataFrame, most: int = 100_000) -> DataFrame:
    """(name, account): users(account_id, display_name) by equal name, else by a part either way, else the name. Users are
    a dimension table of at most ``most`` rows, which is checked; only names without an equal one are compared."""
    d = F.lower("display_name")
    equal = users.select(d.alias("low"), "account_id").groupBy("low").agg(F.min("account_id").alias("account_id"))
    asked = names.select("name").distinct().withColumn("low", F.lower("name")).join(equal, "low", "left")
    held = [(r["low"], r["account_id"]) for r in users.where("display_name is not null").select(d.alias("low"), "account_id").limit(most + 1).collect()]
    if len(held) > most:
        raise ValueError(f"more than {most} users")

    def partly(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [min((a for low, a in held if x and low and (x in low or low in x)), default=None) for x in b["low"]]
            yield pd.DataFrame({"name": b["name"], "account_id": found})

    parts = asked.where("account_id is null").select("name", "low").mapInPandas(partly, "name string, account_id string")
    best = asked.where("account_id is not null").select("name", "account_id").unionByName(parts)
    return names.join(best, "name", "left").select("name", F.coalesce("account_id", "name").alias("account"))


def count_results(results: DataFrame) -> DataFrame:
    """results(call, source, operation, project, success, n, limit), call being the question: of each question distinct
    results by (source, operation, project), their sum, and whether any reached its limit, as text with '+'."""
    once = results.where("success").dropDuplicates(["call", "source", "operation", "project"])
    out = once.groupBy("call").agg(F.sum("n").alias("total"), F.coalesce(F.bool_or(F.col("n") >= F.col("limit")), F.lit(False)).alias("more"))
    return out.withColumn("shown", F.concat(F.col("total").cast("string"), F.when(F.col("more"), "+").otherwise("")))


def count_text(results: DataFrame, questions: DataFrame) -> DataFrame:
    """(call, text): the count of each of questions(call, question) in words: the total, a line per distinct result with
    rows, the status and priority that the question names, and what '+' means; or that nothing was found, and which
    sources failed."""
    upper, more = F.upper("source"), F.coalesce(F.col("n") >= F.col("limit"), F.lit(False))
    once = results.where("success and n > 0").dropDuplicates(["call", "source", "operation", "project"])
    named = F.when(F.coalesce("project", F.lit("")) != "", F.concat(F.lit(" ["), "project", F.lit("]"))).otherwise("")
    line = F.concat(F.lit("  * "), upper, named, F.lit(" -- "), "operation", F.lit(": "), F.col("n").cast("string"), F.when(more, "+").otherwise(""))
    order = F.col("position") if "position" in results.columns else F.lit(0)
    lines = once.groupBy("call").agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), line.alias("t")))).alias("lines"))
    every = results.groupBy("call").agg(F.count_if("success").alias("good"), F.array_join(F.array_sort(F.collect_set(F.when(~F.col("success"), F.col("source")))), ", ").alias("failed"))
    q = F.col("question")
    status, priority = intent.status_of(q), intent.priority_of(q)
    filters = F.concat_ws(", ", F.concat(F.lit("status="), status), F.concat(F.lit("priority="), priority))
    found = F.concat_ws(
        "\n", F.concat(F.lit("Total: "), "shown", F.lit("\n")), F.array_join(F.transform("lines", lambda x: x["t"]), "\n"), F.when(filters != "", F.concat(F.lit("\n  (filtered by: "), filters, F.lit(")"))),
        F.when(F.col("more"), "  (+ = fetch limit reached; actual count may be higher)"))
    none = F.when(F.col("good").isNull(), "No data was retrieved -- could not count.").when(F.col("good") == 0, F.concat(F.lit("0 results found"), F.when(F.col("failed") != "", F.concat(F.lit(" (errors from: "), "failed", F.lit(")"))).otherwise(""), F.lit("."))).otherwise("0 results found.")
    rows = questions.join(every, "call", "left").join(count_results(results), "call", "left").join(lines, "call", "left")
    return rows.select("call", F.when(F.col("total") > 0, found).otherwise(none).alias("text"))


def envelope(rows: DataFrame, source: str, operation: str, most: int = 500) -> DataFrame:
    """The result of an operation as one row: success, data as JSON, count. Operations have limits; of a result without
    one the first ``most`` rows."""
    return rows.limit(most).agg(F.to_json(F.collect_list(F.struct("*"))).alias("data"), F.count("*").alias("count")).select(F.lit(True).alias("success"), F.lit(source).alias("source"), F.lit(operation).alias("operation"), "data", "count", F.current_timestamp().alias("fetched_at"))


def sprint_name(sprints: Column) -> Column:
    """The name of the last sprint of a list of structs; null for none."""
    return F.when(F.size(sprints) > 0, F.element_at(sprints, -1)["name"])


def status(operations: DataFrame, calls: DataFrame) -> DataFrame:
    """Each operation(source, operation) with its calls and failures from calls(source, operation, success)."""
    n = calls.groupBy("source", "operation").agg(F.count("*").alias("calls"), F.count_if(~F.col("success")).alias("failures"))
    return operations.join(n, ["source", "operation"], "left").fillna(0, ["calls", "failures"])
