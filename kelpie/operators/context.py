"""Prompt context: budgets, numbered blocks, history, live results and hard caps, built as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpie.functions.text import text_or_empty

LIVE_CAP, PROMPT_CAP, MARK = 6_000, 12_000, "\n… [truncated]"


def source_budget(n: Column, window: int = 10_240, answer: int = 2_048) -> Column:
    """Characters for each of n sources: (window - answer - 600, 1200 at least) tokens at 3.5 characters, shared,
    within 400 and 2000."""
    chars = max(window - answer - 600, 1200) * 3.5
    return F.greatest(F.lit(400), F.least(F.lit(2000), F.floor(F.lit(chars) / F.greatest(n, F.lit(1))))).cast("int")


def cap(c: Column, most: int, mark: str = MARK) -> Column:
    return F.when(F.length(c) > most, F.concat(F.left(c, F.lit(most)), F.lit(mark))).otherwise(c)


def blocks(hits: DataFrame, by: str, order: str = "rank", chars: Column | None = None) -> DataFrame:
    """(by, n_sources, context): numbered blocks [i] (source) title, a line of facts, and the text cut to budget.
    Hits are the few that retrieval selected."""
    n = F.count("*").over(Window.partitionBy(by))
    have = lambda c: F.nullif(F.col(c).cast("string"), F.lit("")) if c in hits.columns else F.lit(None).cast("string")
    facts = F.concat_ws(" | ", *[F.concat(F.lit(f"{c}: "), have(c)) for c in ("project", "status", "priority", "assignee", "relationship") if c in hits.columns])
    text = F.substring(text_or_empty(F.col("text")), F.lit(1), chars if chars is not None else source_budget(n))
    block = F.concat_ws("\n", F.concat(F.lit("["), F.col(order).cast("string"), F.lit("] ("), F.coalesce(have("source"), F.lit("unknown")), F.lit(") "), F.coalesce(have("title"), F.lit("Untitled"))), F.nullif(facts, F.lit("")), have("url"), text)
    made = hits.withColumn("_b", block).groupBy(by).agg(F.count("*").alias("n_sources"), F.array_sort(F.collect_list(F.struct(order, F.col("_b").alias("b")))).alias("s"))
    return made.select(by, "n_sources", F.array_join(F.transform("s", lambda x: x["b"]), "\n\n").alias("context"))


def knowledge_results(sources: Column, chars: int = 600) -> Column:
    """Sources struct(source, source_type, title, score, issue_key, status, priority, assignee, project, url, text) as
    numbered blocks: a head, the score to three digits, a line of what is known, and the text's beginning."""
    known = [("issue_key", "Key"), ("status", "Status"), ("priority", "Priority"), ("assignee", "Assignee"), ("project", "Project"), ("url", "URL")]

    def one(s: Column, i: Column) -> Column:
        facts = F.concat_ws("  |  ", *[F.concat(F.lit(f"{name}: "), F.nullif(s[c], F.lit(""))) for c, name in known])
        head = F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] ["), F.upper(F.coalesce(s["source"], F.lit("?"))), F.lit("] "), text_or_empty(s["source_type"]), F.lit(" — "), F.coalesce(s["title"], F.lit("Untitled")))
        score = F.concat(F.lit("    Score: "), F.format_string("%.3f", F.coalesce(s["score"].cast("double"), F.lit(0.0))))
        return F.concat_ws("\n", head, score, F.when(facts != "", F.concat(F.lit("    "), facts)), F.concat(F.lit("    "), F.left(text_or_empty(s["text"]), F.lit(chars))))

    return F.when(sources.isNull(), "(no knowledge-base results)").when(F.size(sources) == 0, "(knowledge base returned no relevant documents)").otherwise(F.array_join(F.transform(sources, one), "\n\n"))


#: Characters of a field's value, in a query over few and over many results; a diff and a file have their own; and fields left out.
FIELD_CAPS = {"description": (400, 120), "body": (400, 120), "diff": (4000, 4000), "content": (2000, 2000)}
OTHER_CAP = (300, 120)
#: What ends a line.
LINE_END = r"(?:\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029])"
SKIPPED_FIELDS = ["text", "message", "snippet", "comments", "changelog", "embedding"]


def live_results(results: Column, fanned: Column | None = None, few: int = 3, many: int = 30) -> Column:
    """Results struct(source, operation, success, error, items array<array<struct<name,value>>>) in words: a head and the
    fields of 30 items each, or of 3 with shorter values and without failed and empty results when the question went to
    many (by default more than 3 results). Empty values are left out, and a file's content but for get_file, where lines
    are numbered, the end of the last line aside. A rest is told as '… and n more items'."""
    wide = F.size(results) > 3 if fanned is None else fanned
    shown = F.when(wide, few).otherwise(many)

    def value(name: Column, text: Column, caps: tuple[int, int]) -> Column:
        most = F.when(wide, caps[1]).otherwise(caps[0])
        return F.when(F.length(text) > most, F.concat(F.left(text, most), F.lit("…"))).otherwise(text)

    def field(f: Column) -> Column:
        lines = F.split(F.regexp_replace(value(f["name"], f["value"], FIELD_CAPS["content"]), LINE_END + r"\z", ""), LINE_END)
        numbered = F.array_join(F.transform(lines, lambda x, i: F.concat(F.lpad((i + 1).cast("string"), 4, " "), F.lit("  "), x)), "\n")
        line = value(f["name"], f["value"], OTHER_CAP)
        for name in ("description", "body", "diff"):
            line = F.when(f["name"] == name, value(f["name"], f["value"], FIELD_CAPS[name])).otherwise(line)
        return F.when(f["name"] == "content", F.concat(F.lit("  content:\n"), numbered)).otherwise(F.concat(F.lit("  "), f["name"], F.lit(": "), line))

    def one(r: Column) -> Column:
        head = F.concat(F.lit("["), F.upper(F.coalesce(r["source"], F.lit("?"))), F.lit(" → "), r["operation"], F.lit("]"))
        kept = lambda fields: F.filter(fields, lambda f: (text_or_empty(f["value"]) != "") & ~f["name"].isin(SKIPPED_FIELDS) & ((f["name"] != "content") | (r["operation"] == "get_file")))
        rows = F.filter(F.transform(F.slice(r["items"], F.lit(1), shown), lambda fields: F.array_join(F.transform(kept(fields), field), "\n")), lambda x: x != "")
        rest = F.size(r["items"]) - shown
        body = F.concat(head, F.lit("\n"), F.array_join(rows, "\n---\n"), F.when(rest > 0, F.concat(F.lit("\n\n  … and "), rest.cast("string"), F.lit(" more items"))).otherwise(""))
        failed, empty = ~F.coalesce(r["success"], F.lit(False)), F.coalesce(F.size(r["items"]) < 1, F.lit(True))
        return F.when(failed, F.when(~wide, F.concat(head, F.lit("\nError: "), F.coalesce(r["error"], F.lit("None"))))).when(empty, F.when(~wide, F.concat(head, F.lit("\nNo results found.")))).when(F.size(rows) > 0, body)

    told = F.array_compact(F.transform(results, one))
    return F.when(F.coalesce(F.size(results) < 1, F.lit(True)), "(no live API results)").when(F.size(told) == 0, "(live APIs returned no usable data)").otherwise(F.array_join(told, "\n\n"))


def history(turns: DataFrame, by: str, order: str, last: int = 3, chars: int = 300) -> DataFrame:
    """Adds history: the three turns before each, 300 characters of question and answer."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(-last, -1)
    part = F.concat(F.lit("User: "), F.left(text_or_empty(F.col("query")), F.lit(chars)), F.lit("\nAssistant: "), F.left(text_or_empty(F.col("answer")), F.lit(chars)))
    return turns.withColumn("_t", part).withColumn("history", F.array_join(F.collect_list("_t").over(w), "\n")).drop("_t")


def prompt(query: Column, context: Column, live: Column, past: Column) -> Column:
    part = lambda head, c: F.when(text_or_empty(c) != "", F.concat(F.lit(f"### {head}\n"), c))
    return cap(F.concat_ws("\n\n", part("History", past), part("Context", context), part("Live data", live), F.concat(F.lit("### Question\n"), query)), PROMPT_CAP)
