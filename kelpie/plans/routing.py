"""Questions -> calls of catalogue operations, in bulk: the first rule that fits gives an array of calls."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpie.functions import intent
from kelpie.functions.text import all_matches, text_or_empty

CALL = "array<struct<source:string,operation:string,params:map<string,string>>>"
#: Projects asked in a query over all of them.
FAN_GITLAB, FAN_JIRA = 12, 10
#: Rows of a registry of projects at most.
REGISTRY = 100_000

# ---- Fixed values: patterns of the rules; results depend on them ----------------------------------------------

NAME_FILLERS = ["service", "platform", "system", "project", "app", "the", "a"]
ISSUES = (
    "issue|issues|bug|bugs|ticket|tickets|task|tasks|backlog|defect|defects|problem|problems|feature|story|stories|user.?stor(?:y|ies)|epic|epics|sub.?tasks?|request|requests|item|items|"
    "incident|incidents|blocker|blockers"
)
MERGE_REQUESTS = "merge.?request|merge.?requests|mr|mrs|pull.?request|pr|prs|review|reviews|code.?review"
PIPELINES = "pipeline|pipelines|ci|cd|build|builds|deploy|deployment|workflow|action|job|jobs"
COMMITS = "commit|commits|history|changes|changelog|recent.?change|push"
TREE = "files|file.?list|tree|directory|structure|folder|what.?files|list.?files|show.?files|repo.?content"
BRANCHES = "branch|branches|branche|git.?branch|liste.?les.?branches?|show.?branches?|all.?branches?|how.?many.?branches?|list.?branches?"
AGAIN = (
    "are.?you.?sure|check.?again|re.?check|double.?check|verify|confirm|v[eé]rifie|v[eé]rifier|t.?es.?s[uû]r|c.?est.?s[uû]r|look.?again|try.?again|fetch.?again|get.?again"
)
SPECIFIC_FILE = (
    r"\.gitlab-ci\.yml|dockerfile|docker-compose|readme|requirements\.txt|package\.json|pyproject\.toml|gemfile|\.env\.example|makefile|\.gitignore"
)
FILE_NAMES = {
    "dockerfile": "Dockerfile", "readme": "README.md", "requirements.txt": "requirements.txt", "package.json": "package.json", "pyproject.toml": "pyproject.toml", "gemfile": "Gemfile",
    ".env.example": ".env.example", ".gitignore": ".gitignore", "makefile": "Makefile",
}
INFO = r"info|information|about|description|created|when.?was|details|exist|exists|visibility|public|private|language|stats"
LIST_PROJECTS = (
    r"(list|show|get|find|all|available|my|how.?many|count|number.?of|total)\s.{0,20}(project|repo)s?\b(?!.*(issue|bug|ticket|mr|merge|commit|pipeline|milestone))"
)
SECURITY = "security|vulnerability|vulnerabilities|injection|exploit|cve|breach|attack|xss|csrf|sqli|owasp"
WORK_IN_PROGRESS = "in.?progress|wip|work.?in.?progress|active|current|ongoing|doing|working.?on"
WIKI = "confluence|docs?|documentation|wiki|knowledge.?base"
RECENT_PAGES = (
    r"\b(recent|latest|new|updated|modified|changed)\b.{0,30}\b(page|pages|doc|docs|confluence|wiki|content)\b|"
    r"\b(page|pages|doc|docs|confluence|wiki|content)\b.{0,30}\b(recent|latest|new|updated|modified|changed)\b"
)
LIST_SPACES = r"\b(list|show|get|all|available)\b.{0,20}\bspaces?\b|\bconfluence\s+space\b"
SPACE_KEY = r"\b(?:in|for|within|from|search)\s+(?:the\s+)?([A-Z]{2,6})\s+space\b|\bspace[:\s]+([A-Z]{2,6})\b"
CODE_SEARCH = (
    r"middleware|router\b|controller|handler|decorator|auth\s+router|auth\s+handler|login\s+function|auth\s+module|webhook\s+handler|payment\s+handler|rate\s+limit\s+middleware"
)
ENVIRONMENT = r"env(?:ironment)?.?var(?:iable)?s?|\.env|config|configuration|secret|secrets|api.?key|env.?file|dotenv"
ALL_MERGE_REQUESTS = "(all|every|across).{0,30}(merge.?request|mr|pull.?request)|(merge.?request|mr|pull.?request).{0,30}(all|every|across)"
ALL_COMMITS = "(all|every|across|latest).{0,30}commit|commit.{0,30}(all|every|across|latest|personal)"
COMMITS_AND_MERGE_REQUESTS = (
    r"\b(commit|commits).{0,25}\band\b.{0,25}(merge.?request|mr|mrs|pull.?request)s?\b|\b(merge.?request|mr|mrs|pull.?request)s?.{0,25}\band\b.{0,25}(commit|commits)\b"
)
PROJECT_EXISTS = (
    "is there a project|project called|project named|project.{0,15}exist|find a project|project.{0,10}called|called.{0,10}project"
)

# ---------------------------------------------------------------------------------------------------------------


def _call(source: str, operation: str, **params: Column | str) -> Column:
    pairs = [x for k, v in params.items() for x in (F.lit(k), (F.lit(v) if isinstance(v, str) else v).cast("string"))]
    made = F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull() & (v != "")) if pairs else F.create_map().cast("map<string,string>")
    return F.struct(F.lit(source).alias("source"), F.lit(operation).alias("operation"), made.alias("params"))


def _each(values: Column, source: str, operation: str, key: str, **params: Column) -> Column:
    return F.transform(values, lambda v: _call(source, operation, **{key: v}, **params))


def jira_aliases(projects: DataFrame) -> DataFrame:
    """(project_key, alias, kind, position) of projects(key, name, position): the key, the name, and as aliases both of
    them, the name with hyphens and without blanks, and its longer words; the first project keeps an alias."""
    low = F.lower(F.trim("name"))
    words = F.filter(F.split(low, r"\s+"), lambda w: (F.length(w) > 2) & ~w.isin(NAME_FILLERS))
    given = F.concat(F.array(F.lower("key"), low, F.replace(low, F.lit(" "), F.lit("-")), F.replace(low, F.lit(" "), F.lit(""))), words)
    made = projects.select("key", "position", F.posexplode(given).alias("n", "alias")).where("alias <> ''").groupBy("alias").agg(F.min_by("key", F.struct("position", "n", "key")).alias("project_key"))
    first = projects.groupBy("key").agg(F.min("position").alias("position"), F.min_by("name", "position").alias("name"))
    own = [first.select(F.col("key").alias("project_key"), F.col(c).alias("alias"), F.lit(c).alias("kind"), "position") for c in ("key", "name")]
    return own[0].unionByName(own[1]).unionByName(made.join(first.select(F.col("key").alias("project_key"), "position"), "project_key").select("project_key", "alias", F.lit("alias").alias("kind"), "position"))


def resolve_projects(questions: DataFrame, projects: DataFrame, aliases: DataFrame) -> DataFrame:
    """Adds gitlab_project and jira_project to questions(question_id, question).

    projects(path, name, preferred): the longest path that the question contains, else the longest name that it has as
    words, preferred ones first. aliases(project_key, alias, kind[, position]): the project of a ticket key in the
    question, else a key that it has as a word, else a name that it contains, else the longest alias that it contains.

    Registries are dimension tables of at most ``REGISTRY`` rows, which is checked; each task looks all their entries up
    in one pass over a question, so no pairs are compared."""
    named = [r.asDict() for r in projects.select("path", F.lower("name").alias("name"), F.coalesce("preferred", F.lit(False)).alias("preferred")).limit(REGISTRY + 1).collect()]
    position = F.col("position") if "position" in aliases.columns else F.lit(0)
    known = [r.asDict() for r in aliases.select("project_key", "alias", "kind", position.alias("position")).limit(REGISTRY + 1).collect()]
    if max(len(named), len(known)) > REGISTRY:
        raise ValueError(f"a registry of more than {REGISTRY} rows")
    order = sorted(known, key=lambda r: (r["position"], r["project_key"]))
    keys = [r["project_key"] for r in order if r["kind"] == "key"] or sorted({r["project_key"] for r in order})

    def resolve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        found = ahocorasick.Automaton()
        for text in {x for r in named for x in (r["path"].lower(), r["name"])} | {r["alias"].lower() for r in order}:
            if text:
                found.add_word(text, text)
        found.make_automaton()
        listed = set(keys)
        for batch in batches:
            gitlab, jira = [], []
            for q in batch["question"].fillna(""):
                low, up = q.lower(), q.upper()
                held: dict[str, bool] = {}  # entry: whether it stands as words
                for end, x in found.iter(low) if len(found) else ():
                    lone = not re.search(r"\w", low[max(0, end - len(x)) : end - len(x) + 1]) and not re.match(r"\w", low[end + 1 : end + 2])
                    held[x] = held.get(x, False) or lone
                paths = [r["path"] for r in named if r["path"].lower() in held]
                names = [(r["preferred"], len(r["name"]), r["path"]) for r in named if held.get(r["name"])]
                gitlab.append(max(paths, key=lambda p: (len(p), p)) if paths else max(names)[2] if names else None)
                explicit = m[1] if (m := re.search(r"\b([A-Z]{2,8})-\d+\b", up)) and m[1] in listed else None
                by_key = next((k for k in keys if held.get(k.lower())), None)
                by_name = next((r["project_key"] for r in order if r["kind"] == "name" and r["alias"].lower() in held), None)
                by_alias = max((r for r in reversed(order) if r["kind"] == "alias" and r["alias"].lower() in held), key=lambda r: len(r["alias"]), default={"project_key": None})["project_key"]
                jira.append(explicit or by_key or by_name or by_alias)
            yield batch.assign(gitlab_project=gitlab, jira_project=jira)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in questions.schema.fields)
    return questions.mapInPandas(resolve, f"{schema}, gitlab_project string, jira_project string")


def carry_over(turns: DataFrame, values: list[str], conversation: str = "conversation_id", turn: str = "turn") -> DataFrame:
    """Each value or, where a turn has none, the last before it in the conversation."""
    w = Window.partitionBy(conversation).orderBy(turn).rowsBetween(Window.unboundedPreceding, 0)
    return turns.withColumns({f"{v}_in_force": F.last(v, ignorenulls=True).over(w) for v in values})


def route(questions: DataFrame, all_gitlab: list[str] | None = None, all_jira: list[str] | None = None) -> DataFrame:
    """Adds rule and calls to questions(question_id, question, gitlab_project, jira_project, last_key[, last_project]):
    the projects that the question names, and the tracker and code projects of the turn before. Parameters are text;
    ``catalogue.build`` gives them their types. The first rule that fits and has the projects it needs decides.

    ``all_gitlab`` and ``all_jira`` are the projects of queries over all of them, of which the first 12 and 10 are
    asked, those of test namespaces aside."""
    q = text_or_empty(F.col("question"))
    low = F.lower(q)
    says = lambda words: intent.says(q, words)
    nothing = F.array().cast(CALL)
    gp, jp = F.col("gitlab_project"), F.col("jira_project")
    last = F.col("last_project") if "last_project" in questions.columns else F.lit(None).cast("string")
    own = F.coalesce(gp, last)
    fan_gitlab = F.array(*[F.lit(n) for n in [n for n in all_gitlab or [] if not n.lower().startswith("test")][:FAN_GITLAB]]).cast("array<string>")
    fan_jira = F.array(*[F.lit(n) for n in (all_jira or [])[:FAN_JIRA]]).cast("array<string>")
    calls = lambda *made: F.array(*made).cast(CALL)
    if_ = lambda when, made: F.when(F.coalesce(when, F.lit(False)), made).otherwise(nothing)
    keys = F.array_distinct(all_matches(q, r"\b([A-Z]{2,8}-\d+)\b", 1))
    group = lambda pattern: F.nullif(F.regexp_extract(q, pattern, 1), F.lit(""))
    state, status, priority = intent.state_of(q), intent.status_of(q), intent.priority_of(q)
    reporter, dates = F.when(says(intent.REPORTER_WORDS), intent.reporter_name(q)), intent.date_bounds(q)
    in_jira, in_gitlab, issues = says("jira"), says("gitlab"), says(ISSUES)
    list_projects = q.rlike(rf"(?iU){LIST_PROJECTS}")
    sort = F.when(says(intent.NEWEST), "created")
    filters = {"status": status, "priority": priority, "reporter": reporter, "created_after": dates["after"], "created_before": dates["before"], "sort_by": sort}
    anywhere = {k: v for k, v in filters.items() if k != "status"} | {"status_category": intent.category_of(status), "sort_by": F.when(sort.isNotNull() | dates["after"].isNotNull() | dates["before"].isNotNull(), "created").otherwise("updated")}
    mrs = lambda project, state=state: _call("gitlab", "get_merge_requests", project=project, state=state)
    commits = lambda project, limit: _call("gitlab", "get_commits", project=project, limit=limit)
    code = F.element_at(F.split(F.nullif(F.regexp_extract(q, rf"(?iU)\b({CODE_SEARCH})\b", 1), F.lit("")), r"\s+"), -1)
    named_file = group(rf"(?i)({SPECIFIC_FILE})")
    known_file = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in FILE_NAMES.items() for x in kv]), F.lower(named_file)), named_file)
    code_file = group(rf"(?iU)({intent.FILE_NAME})")
    mr, issue = group(r"!(\d{1,6})"), group(r"#(\d{1,6})")
    label = F.when(low.contains("blocked"), "blocked").when(low.contains("urgent"), "urgent").when(low.contains("critical"), "critical").when(low.contains("bug"), "bug")
    kind = F.when(low.contains("story"), "Story").when(low.contains("epic"), "Epic").when(low.contains("bug"), "Bug")
    one_issue = lambda **more: _call("jira", "get_project_issues", project_key=jp, **(more | filters))
    found = F.when(
        in_jira & jp.isNull(),
        F.when(F.size(fan_jira) > 0, _each(fan_jira, "jira", "get_project_issues", "project_key", limit=F.lit("10"), **filters).cast(CALL)).otherwise(calls(_call("jira", "get_issues", limit="100", **anywhere)))
    ).when(
        gp.isNotNull(), F.concat(calls(_call("gitlab", "get_issues", project=gp, state=state, labels=label)), if_(in_jira & jp.isNotNull(), calls(one_issue())))
    ).otherwise(F.concat(
        if_(~in_jira, _each(fan_gitlab, "gitlab", "get_issues", "project", state=state, limit=F.lit("10")).cast(CALL)), if_(jp.isNotNull(), calls(one_issue(issue_type=kind)))))
    space = F.coalesce(*[F.nullif(F.regexp_extract(q, SPACE_KEY, i), F.lit("")) for i in (1, 2)])  # of the leftmost match
    wiki = says(WIKI)
    working = F.concat(
        _each(fan_gitlab, "gitlab", "get_merge_requests", "project", state=F.lit("opened")).cast(CALL),
        F.when(jp.isNotNull() | (F.size(fan_jira) > 0), _each(F.when(jp.isNotNull(), F.array(jp)).otherwise(fan_jira), "jira", "get_project_issues", "project_key", status=F.lit("In Progress"), limit=F.lit("10")).cast(CALL))
        .otherwise(calls(_call("jira", "get_issues", status_category="In Progress", sort_by="updated", limit="25"))))
    rules: list[tuple[str, Column, Column]] = [
        ("link", says("web.?url|url|link|browse.?link") & (F.size(keys) > 0), calls(_call("jira", "get_issue", issue_key=F.get(keys, F.lit(0))))),
        ("again", says(AGAIN) & (F.col("last_key").isNotNull() | last.isNotNull()), F.concat(
            if_(F.col("last_key").isNotNull(), calls(_call("jira", "get_project_issues", project_key=F.col("last_key"), limit="100"))),
            if_(last.isNotNull(), calls(_call("gitlab", "get_issues", project=last, state="all", limit="100"), commits(last, "50"))))),
        ("security", says(SECURITY), F.concat(
            F.when(gp.isNotNull(), calls(_call("gitlab", "get_issues", project=gp, state="all", limit="30"))).otherwise(_each(fan_gitlab, "gitlab", "get_issues", "project", state=F.lit("all"), limit=F.lit("15")).cast(CALL)),
            if_(jp.isNotNull(), calls(_call("jira", "get_issues", project_key=jp, text="security", limit="10"))))),
        ("all_merge_requests", q.rlike(rf"(?i){ALL_MERGE_REQUESTS}"), F.transform(fan_gitlab, lambda p: mrs(p)).cast(CALL)),
        ("all_commits", q.rlike(rf"(?i){ALL_COMMITS}"), F.transform(fan_gitlab, lambda p: commits(p, "5")).cast(CALL)),
        ("merge_requests_and_commits", q.rlike(rf"(?iU){COMMITS_AND_MERGE_REQUESTS}") & (own.isNotNull() | (F.size(fan_gitlab) > 0)), F.when(own.isNotNull(), calls(mrs(own), commits(own, "15"))).otherwise(
            F.flatten(F.transform(fan_gitlab, lambda p: F.array(mrs(p), commits(p, "5")))).cast(CALL))),
        ("issues_of_projects", issues & list_projects & (jp.isNotNull() | gp.isNotNull()), F.concat(
            if_(jp.isNotNull(), calls(_call("jira", "get_project_issues", project_key=jp))), if_(gp.isNotNull() & (in_gitlab | jp.isNull()), calls(_call("gitlab", "get_issues", project=gp, state=state))))),
        ("milestones", says(r"mile?s?t?o?r?n?e?s?"), calls(_call("gitlab", "get_milestones", project=gp))),
        ("projects", list_projects, calls(_call("gitlab", "list_projects"))),
        ("file", named_file.isNotNull() & own.isNotNull(), calls(_call("gitlab", "get_file", project=own, file_path=known_file))),
        ("environment", says(ENVIRONMENT) & own.isNotNull(), calls(_call("gitlab", "get_file", project=own, file_path=".env.example"), _call("gitlab", "get_file", project=own, file_path="README.md"))),
        ("code_file", code_file.isNotNull() & own.isNotNull(), calls(_call("gitlab", "get_file", project=own, file_path=code_file))),
        ("project_exists", says(PROJECT_EXISTS), F.when(gp.isNotNull(), calls(_call("gitlab", "get_project_info", project=gp))).otherwise(calls(_call("gitlab", "list_projects")))),
        ("branches", says(BRANCHES), F.when(own.isNotNull(), calls(_call("gitlab", "get_branches", project=own))).otherwise(_each(fan_gitlab, "gitlab", "get_branches", "project").cast(CALL))),
        ("tree", says(TREE) & own.isNotNull(), calls(_call("gitlab", "get_repository_tree", project=own))),
        ("pipelines", says(PIPELINES) & own.isNotNull(), calls(_call("gitlab", "get_pipelines", project=own, limit="10"))),
        ("commits", says(COMMITS) & own.isNotNull(), calls(commits(own, "15"))),
        ("merge_requests", says(MERGE_REQUESTS), F.when(own.isNotNull(), calls(mrs(own))).otherwise(F.transform(fan_gitlab, lambda p: mrs(p)).cast(CALL))),
        ("code_search", code.isNotNull(), F.when(own.isNotNull(), calls(_call("gitlab", "search_code", query=code, project=own, limit="10"), _call("gitlab", "get_repository_tree", project=own, recursive="true", limit="50"))).otherwise(
            calls(_call("gitlab", "search_code", query=code, limit="10")))),
        ("project_info", says(INFO) & own.isNotNull(), calls(_call("gitlab", "get_project_info", project=own))),
        ("reporter", reporter.isNotNull(), F.when(jp.isNotNull(), calls(_call("jira", "get_project_issues", project_key=jp, reporter=reporter, limit="100"))).otherwise(
            calls(_call("jira", "get_issues", reporter=reporter, sort_by="updated", limit="100")))),
        ("work_in_progress", says(WORK_IN_PROGRESS), working),
        ("reference", (mr.isNotNull() | issue.isNotNull()) & own.isNotNull(), F.concat(
            if_(mr.isNotNull(), calls(_call("gitlab", "get_mr_diff", project=own, mr_iid=mr), _call("gitlab", "get_merge_requests", project=own, state="all", limit="50"))),
            if_(issue.isNotNull(), calls(_call("gitlab", "get_issues", project=own, search=issue, limit="10"))))),
        ("keys", F.size(keys) > 0, _each(keys, "jira", "get_issue", "issue_key").cast(CALL)),
        ("issues", issues & (F.size(found) > 0), found),
        ("spaces", wiki & q.rlike(rf"(?iU){LIST_SPACES}"), calls(_call("confluence", "get_spaces"))),
        ("recent_pages", wiki & q.rlike(rf"(?iU){RECENT_PAGES}"), calls(_call("confluence", "get_recent_pages", days="7", limit="20", space_key=space))),
        ("pages", wiki, calls(_call("confluence", "search_pages", query=intent.search_terms(q), limit="10", space_key=space))),
        ("project", jp.isNotNull(), calls(_call("jira", "get_project_issues", project_key=jp))),
    ]
    rule, out = F.lit(None).cast("string"), nothing
    for name, when, made in reversed(rules):
        when = F.coalesce(when, F.lit(False))
        rule, out = F.when(when, name).otherwise(rule), F.when(when, made).otherwise(out)
    return questions.withColumn("rule", rule).withColumn("calls", out)


def calls_of(routed: DataFrame) -> DataFrame:
    """One row per call, in order."""
    return routed.select("question_id", F.posexplode("calls").alias("position", "call")).select("question_id", "position", "call.source", "call.operation", "call.params")


def has_live_data(results: Column) -> Column:
    return F.exists(F.coalesce(results, F.array()), lambda r: r["success"] & (r["count"] > 0))


def inject_tickets(calls: Column, keys: Column) -> Column:
    """Calls for named tickets before the others, unless they are there already."""
    there = F.transform(F.filter(calls, lambda c: c["operation"] == "get_issue"), lambda c: F.element_at(c["params"], "issue_key"))
    return F.concat(_each(F.array_except(keys, there), "jira", "get_issue", "issue_key").cast(CALL), calls)
