"""Scores, checks, tags and grades of answered turns: one wide chain of columns, without a shuffle.

turns: query, answer, intent, sources (array of struct: source, title, url, issue_key, from_graph, score, ...),
summary (array of struct: source, operation, count, titles; null: not kept, empty: nothing found), total_time_s.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from kelpie.functions.text import MERGE_REF, URL, all_matches, half_even, safe_score, sentences, text_or_empty, ticket_keys, windows
from kelpie.operators.vectors import cosine
from kelpie.sources.sinks import insert_missing, staged

# ---- Fixed values ---------------------------------------------------------------------------------------------

W_FAITH, W_RELEVANCE, W_TEMPORAL, W_CODE = 0.35, 0.35, 0.10, 0.20
HALLUCINATION = ["fabricated_keys_on_empty_sentries", "jira_prefix_mismatch"]
CRITICAL = ["hallucination", "tool_misuse", "retrieval_miss"]
P95 = {"sentries": 3.5, "rag": 5.0, "both": 7.0}
HONEST_EMPTY = r"(?iU)\b(no\s+results?|no\s+data|not\s+found|could\s+not\s+find|no\s+issues?|no\s+open|empty|unavailable|pas\s+de\s+r[eé]sultat|rien\s+trouv[eé]|aucun[e]?)\b"
HONEST_EMPTY_TAG = (
    r"(?iU)\b(no\s+(results?|data|tickets?|issues?|matches?|pages?|matching)\s+(found|available|returned)|could\s+not\s+find|aucun(e)?\s+(résultat|donnée|ticket|page)|empty\s+result|"
    r"i\s+(don[’']?t|do\s+not)\s+have\s+(any\s+)?data)\b")
REFUSAL = r"(?i)\b(i\s+don.t\s+have\s+access\s+to\s+the\s+(api|gitlab|jira|confluence)|i\s+can.t\s+(access|call|query|retrieve)|no\s+api\s+access|cannot\s+access\s+the\s+(live|real.?time))\b"
ROUND_STAT = r"(?i)\b(exactly|precisely|total\s+of|there\s+are)\s+(\d+)\s+(issues?|bugs?|tickets?|mr|merge\s+requests?|pipelines?)\b"
ANALYTICAL = r"(?i)\b(where|which|compare|trace|find\s+all|most\s+referenced|cross.?reference|appear|conflict|risk|subsystem|summarize|summarise)\b"
COUNT_QUERY = r"(?i)\b(how\s+many|count|total\s+(number\s+of|tickets?|issues?)|number\s+of|approximately|give\s+me\s+a\s+number|just\s+a\s+number|combien|nombre\s+de)\b"
NUMERIC_ANSWER = r"(?i)^\s*(?:answer\s*:\s*|~|about\s+|environ\s+|approximately\s+)?(\d{1,6})\s*$"
RELEVANCE_STOP = [
    "show", "list", "get", "open", "closed", "issues", "for", "in", "the", "a", "an", "of", "and", "or", "with", "recent", "latest", "pipelines", "mrs", "merge", "requests", "bugs", "tickets",
]

# ---------------------------------------------------------------------------------------------------------------

#: Vectors of a block that are compared at once.
CLOSEST_BLOCK = 512


def _clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def temporal_consistency(answer: Column, year: int | None = None) -> Column:
    """1 - failed / applicable of four checks: years beyond the next, before and after in contradiction, 'finally'
    before 'first', three steps and more out of order; 1 for short answers and where none applies."""
    a = text_or_empty(answer)
    now = F.lit(year) if year else F.year(F.current_date())
    ints = lambda pattern: F.transform(F.regexp_extract_all(a, F.lit(pattern), F.lit(1)), lambda x: x.cast("int"))
    years, before, after, steps = ints(r"\b((?:19|20|21)\d{2})\b"), ints(r"(?i)\bbefore\s+((?:19|20)\d{2})\b"), ints(r"(?i)\bafter\s+((?:19|20)\d{2})\b"), ints(r"(?i)\bstep\s+(\d{1,9})\b")
    final, first = F.locate("finally", F.lower(a)), F.locate("first", F.lower(a))
    checks = [
        (F.size(years) > 0, F.coalesce(F.array_max(years) > now + 1, F.lit(False))),
        ((F.size(before) > 0) & (F.size(after) > 0), F.coalesce(F.array_min(before) <= F.array_min(after), F.lit(False))),
        ((final > 0) & (first > 0), final < first),
        (F.size(steps) >= 3, steps != F.array_sort(steps)),
    ]
    applies = sum((F.when(c, 1).otherwise(0) for c, _ in checks), F.lit(0))
    failed = sum((F.when(c & bad, 1).otherwise(0) for c, bad in checks), F.lit(0))
    return F.when((F.length(a) < 40) | (applies == 0), F.lit(1.0)).otherwise(half_even(1 - failed / applies))


_BLOCK = re.compile(r"```(?:python)?\s*(.*?)```", re.DOTALL | re.I)
_PYTHON = re.compile(r"\b(def |import |class |print\(|from \w+ import)\b")


def parsed_share(answer: str | None) -> float | None:
    """Share of the fenced blocks that look like Python which parse; None if there are none."""
    blocks = [b.strip() for b in _BLOCK.findall(answer or "")]
    python = [b for b in blocks if b and _PYTHON.search(b)]
    good = 0
    for b in python:
        try:
            ast.parse(b)
            good += 1
        except (SyntaxError, ValueError, RecursionError, MemoryError):  # the last two: nested too deeply to parse
            continue
    return round(good / len(python), 4) if python else None


@pandas_udf(DoubleType())
def code_correctness(answers: pd.Series) -> pd.Series:
    return answers.map(parsed_share).astype("float64")


def weighted_score(faith: Column, relevance: Column, temporal: Column, code: Column) -> Column:
    """Weighted mean, to four digits; without code its weight goes to faithfulness; missing metrics count 0.30."""
    f, r, t = safe_score(faith), safe_score(relevance), safe_score(temporal)
    c = F.nullif(code, F.lit(float("nan")))
    with_code = f * W_FAITH + r * W_RELEVANCE + t * W_TEMPORAL + c * W_CODE
    return half_even(_clamp(F.when(c.isNotNull(), with_code).otherwise(f * (W_FAITH + W_CODE) + r * W_RELEVANCE + t * W_TEMPORAL)))


def source_keys(sources: Column, from_graph: bool | None = None) -> Column:
    """Ticket keys in issue_key, URL and title of the ticket sources."""
    mine = F.filter(F.coalesce(sources, F.array()), lambda s: (s["source"] == "jira") & (F.lit(True) if from_graph is None else F.coalesce(s["from_graph"], F.lit(False)) == from_graph))
    texts = F.transform(mine, lambda s: F.concat_ws(" ", F.upper(s["issue_key"]), F.upper(s["url"]), F.upper(s["title"])))
    return ticket_keys(F.array_join(texts, " "))


def mean_source_score(sources: Column) -> Column:
    scores = F.filter(F.transform(F.coalesce(sources, F.array()), lambda s: s["score"].cast("double")), lambda x: x.isNotNull())
    return F.when(F.size(scores) > 0, F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / F.size(scores)).otherwise(0.0)


def _check(name: str, cases: list[tuple[Column, Column | float, str]]) -> Column:
    """struct(name, penalty, note): the first case that holds, else no penalty."""
    penalty, note = F.lit(0.0), F.lit("ok")
    for when, p, text in reversed(cases):
        penalty = F.when(when, p if isinstance(p, Column) else F.lit(float(p))).otherwise(penalty)
        note = F.when(when, F.lit(text)).otherwise(note)
    return F.struct(F.lit(name).alias("name"), penalty.cast("double").alias("penalty"), note.alias("note"))


def _share(c: Column) -> Column:
    return F.transform(c, lambda k: F.element_at(F.split(k, "-"), 1))


def validator_checks(query: Column, answer: Column, sources: Column, summary: Column) -> Column:
    """The seven checks of an answer against its sources, each struct(name, penalty, note)."""
    a, sources = text_or_empty(answer), F.coalesce(sources, F.array())
    cited, asked = ticket_keys(F.upper(a)), ticket_keys(F.upper(text_or_empty(query)))
    own = F.array_except(cited, asked)
    known = source_keys(sources)
    corpus = F.upper(F.array_join(F.transform(sources, lambda s: F.concat_ws(" ", s["title"], s["url"])), " "))
    corpus_keys = ticket_keys(corpus)
    links = all_matches(a, URL)
    bad = F.filter(links, lambda u: ~F.coalesce(F.lower(F.regexp_extract(u, r"^https?://([^/\s?#]+)", 1)).rlike(r"^.*\..*$") & (F.length(F.regexp_extract(u, r"^https?://([^/\s?#]+)", 1)) > 4), F.lit(False)))
    titles = F.concat(*[F.regexp_extract_all(a, F.lit(p), F.lit(1)) for p in (r'"([^"]{5,80})"', r"\*\*([^*]{5,80})\*\*", r"`([^`]{5,80})`")])
    titles = F.filter(titles, lambda t: t.rlike(r"(?i)(\b[A-Z]{2,5}-\d+\b|\[|https?://)") & ~((F.size(ticket_keys(F.upper(t))) > 0) & (F.size(F.array_except(ticket_keys(F.upper(t)), asked)) == 0)))
    orphan = F.filter(titles, lambda t: ~F.contains(corpus, F.left(F.upper(t), F.lit(20))))
    listed = ticket_keys(F.upper(F.array_join(F.flatten(F.transform(F.coalesce(summary, F.array()), lambda s: s["titles"])), " ")))
    empty_said = a.rlike(HONEST_EMPTY)
    nothing = summary.isNotNull() & (F.size(summary) == 0)
    something = summary.isNotNull() & (F.size(summary) > 0)
    strays = F.array_except(cited, listed)
    plain = text_or_empty(query)
    invented = F.array_except(F.array_except(ticket_keys(a), ticket_keys(F.array_join(F.transform(sources, lambda s: text_or_empty(s["url"])), " "))), ticket_keys(plain))
    told = F.array_join(F.flatten(F.transform(F.coalesce(summary, F.array()), lambda s: s["titles"])), " ")
    refs = lambda c: F.array_distinct(all_matches(c, MERGE_REF, 1))
    new_refs, told_refs = F.array_except(refs(a), refs(plain)), refs(told)
    return F.array(
        _check("api_refusal", [(a.rlike(REFUSAL), 0.30, "model_claimed_no_api_access")]),
        _check("jira_key_format", [((F.size(own) > 0) & (F.size(known) > 0) & ~F.arrays_overlap(_share(own), _share(known)), 0.25, "jira_prefix_mismatch")]),
        _check("url_validity", [(F.size(bad) > 0, F.least(F.lit(0.30), 0.30 * F.size(bad) / F.greatest(F.lit(1), F.size(links))), "suspicious_urls")]),
        _check("honest_empty", [(something, 0.0, "summary_non_empty_bonus_suppressed"), (empty_said, -0.10, "correctly_reported_empty")]),
        _check("round_stat_fabrication", [(F.regexp_count(a, F.lit(ROUND_STAT)) >= 3, 0.05, "suspicious_round_stats")]),
        _check("source_coverage", [
            ((F.size(sources) > 0) & (F.size(corpus_keys) > 0) & (F.size(own) > 0) & (F.size(F.array_except(own, corpus_keys)) > F.floor(F.size(own) / 2)), 0.20, "jira_keys_not_in_sources"),
            ((F.size(sources) > 0) & (F.size(titles) > 0) & (F.size(orphan) > F.floor(F.size(titles) / 2)), half_even(F.least(F.lit(0.25), 0.25 * F.size(orphan) / F.greatest(F.lit(1), F.size(titles))), 3), "unsupported_titles")]),
        _check("sentries_summary_coverage", [
            (nothing & (F.size(source_keys(sources, False)) > 0), 0.0, "summary_empty_but_sources_present"), (nothing & empty_said, -0.05, "correctly_reported_empty_from_summary"),
            (nothing & (F.size(invented) > 0), 0.15, "fabricated_keys_on_empty_sentries"),
            (something & (F.size(cited) > 0) & (F.size(listed) > 0), F.when(F.size(strays) > F.floor(F.size(cited) / 2), 0.20).otherwise(0.0), "keys_not_in_sentries_summary"),
            (something & (F.size(new_refs) > 0) & (F.size(told_refs) > 0), F.when(F.size(F.array_except(new_refs, told_refs)) > F.floor(F.size(new_refs) / 2), 0.20).otherwise(0.0), "gitlab_refs_not_in_sentries_summary"),
            (something & empty_said & ((F.size(listed) > 0) | (F.size(refs(a)) > 0)), 0.10, "falsely_reported_empty_when_summary_has_data")]),
    )


def validator_score(answer: Column, summary: Column, checks: Column) -> Column:
    """Base 0.85, or 0.75 if nothing in the answer can be checked, less all penalties; 0.10 for no answer."""
    a = text_or_empty(answer)
    checkable = summary.isNotNull() | (F.size(ticket_keys(F.upper(a))) > 0) | a.rlike(URL)
    total = F.aggregate(checks, F.lit(0.0), lambda s, c: s + c["penalty"])
    return F.when(a == "", 0.10).otherwise(half_even(_clamp(F.when(checkable, 0.85).otherwise(0.75) - total)))


def answer_relevance(query: Column, answer: Column) -> Column:
    """0.85 for a number to a count question; by keys 1.0 or 0.2; by references 1.0 or 0.3; else 0.3 + 0.7 times the
    share of the question's words in the answer; 0.5 if there is nothing to compare."""
    q, a = text_or_empty(query), text_or_empty(answer)
    qk, ak = ticket_keys(F.upper(q)), ticket_keys(F.upper(a))
    qr, ar = (F.array_distinct(all_matches(c, r"[!#](\d{1,6})\b", 1)) for c in (q, a))
    tokens = lambda c: F.filter(F.array_distinct(F.transform(all_matches(c, r"\b[a-zA-Z][\w\-]{2,}\b"), F.lower)), lambda t: ~t.isin(RELEVANCE_STOP))
    qt, at = tokens(q), tokens(a)
    hit = lambda x, y, miss: F.when(F.arrays_overlap(x, y), 1.0).otherwise(miss)
    return (
        F.when((q == "") | (a == ""), 0.5).when(q.rlike(COUNT_QUERY) & a.rlike(NUMERIC_ANSWER), 0.85).when(F.size(qk) > 0, hit(qk, ak, 0.2)).when(F.size(qr) > 0, hit(qr, ar, 0.3))
        .when(F.size(qt) == 0, 0.5).otherwise(half_even(F.least(F.lit(1.0), 0.3 + 0.7 * F.size(F.array_intersect(qt, at)) / F.greatest(F.lit(1), F.size(qt))))))


def failure_tags(faith: Column, checks: Column) -> Column:
    """Sorted tags of a turn (columns of ``turns``): each by one rule."""
    a, q, sources, intent = text_or_empty(F.col("answer")), text_or_empty(F.col("query")), F.coalesce(F.col("sources"), F.array()), F.coalesce(F.col("intent"), F.lit("both"))
    fired = F.filter(checks, lambda c: c["penalty"] > 0)
    reachable, cited, asked = source_keys(sources), ticket_keys(F.upper(a)), ticket_keys(F.upper(q))
    own = F.array_except(cited, asked)
    live = intent.isin("sentries", "both")
    said_empty = a.rlike(HONEST_EMPTY_TAG)
    has_sources = F.size(sources) > 0
    invented = (F.size(reachable) > 0) & (F.size(own) > 0) & ~F.arrays_overlap(reachable, own)
    ignored = (F.size(reachable) > 0) & live & (F.size(cited) == 0) & (F.length(a) > 100) & ~q.rlike(ANALYTICAL) & ~said_empty
    mean = mean_source_score(sources)
    late = F.coalesce(F.col("total_time_s"), F.lit(0.0)) > F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in P95.items() for x in kv]), intent), F.lit(10.0))
    no_summary = F.col("summary").isNull() | (F.size("summary") == 0)
    named = [
        ("format_violation", F.exists(fired, lambda c: ~c["note"].isin(HALLUCINATION))),
        ("hallucination", F.exists(fired, lambda c: c["note"].isin(HALLUCINATION))),
        ("incomplete", live & no_summary & ~has_sources & (F.size(cited) == 0) & (F.length(a) > 200) & ~said_empty),
        ("latency_breach", late),
        ("retrieval_miss", (faith < 0.50) & (mean > 0) & (mean < 0.65)),
        ("tool_misuse", has_sources & (invented | ignored | said_empty)),
    ]
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in named]))


def quality_grade(score: Column, faith: Column, tags: Column) -> Column:
    bad = F.arrays_overlap(tags, F.array(*[F.lit(t) for t in CRITICAL]))
    return F.when(bad | (score < 0.50), "FAILED").when((score >= 0.85) & (faith >= 0.70) & (F.size(tags) == 0), "GOLD").when(score >= 0.70, "SILVER").otherwise("BRONZE")


def training_signal(grade: Column, tags: Column, score: Column) -> Column:
    actionable = F.array_contains(tags, "hallucination") | F.array_contains(tags, "tool_misuse") | (score < 0.5)
    return F.when(grade == "GOLD", "qlora_positive").when((grade == "FAILED") & actionable, "dpo_rejected").otherwise("neutral")


def evaluate(turns: DataFrame, judged_faith: Column | None = None, year: int | None = None) -> DataFrame:
    """All scores of turns. ``judged_faith`` is a judge's faithfulness where there is one; the higher of it and
    the checks' score counts, with a floor of 0.30 for answers above 0.15 that are relevant."""
    out = turns.withColumn("temporal_consistency", temporal_consistency(F.col("answer"), year)).withColumn("code_correctness", code_correctness(F.col("answer")))
    out = out.withColumn("checks", validator_checks(F.col("query"), F.col("answer"), F.col("sources"), F.col("summary")))
    out = out.withColumn("validator_faith", validator_score(F.col("answer"), F.col("summary"), F.col("checks"))).withColumn("answer_relevance", answer_relevance(F.col("query"), F.col("answer")))
    faith = F.col("validator_faith") if judged_faith is None else F.greatest("validator_faith", safe_score(judged_faith, 0.0))
    out = out.withColumn("faithfulness", F.when((faith >= 0.15) & (faith < 0.30) & (F.col("answer_relevance") > 0.60), 0.30).otherwise(faith))
    out = out.withColumn("scoring_method", F.lit("validator") if judged_faith is None else F.when(judged_faith.isNull(), "validator").otherwise("validator+judge"))
    snippets = F.size("context_snippets") > 0 if "context_snippets" in turns.columns else F.lit(None).cast("boolean")
    out = out.withColumn("scoring_context_source", F.when(snippets, "stored_snippets").when(~snippets, "empty").otherwise("unknown"))
    out = out.withColumn("weighted_score", weighted_score(F.col("faithfulness"), F.col("answer_relevance"), F.col("temporal_consistency"), F.col("code_correctness")))
    graph, cited = source_keys(F.col("sources"), True), ticket_keys(F.upper(text_or_empty(F.col("answer"))))
    out = out.withColumn("graph_coverage", F.when(F.size(graph) > 0, half_even(F.size(F.array_intersect(graph, cited)) / F.greatest(F.lit(1), F.size(graph)))))
    out = out.withColumn("failure_tags", failure_tags(F.col("faithfulness"), F.col("checks")))
    out = out.withColumn("quality_grade", quality_grade(F.col("weighted_score"), F.col("faithfulness"), F.col("failure_tags")))
    return out.withColumn("training_signal", training_signal(F.col("quality_grade"), F.col("failure_tags"), F.col("weighted_score")))


def unscored(turns: DataFrame, limit: int | None = None) -> DataFrame:
    """Turns without a score and without an error, newest first."""
    rows = turns.where(F.col("weighted_score").isNull() & (text_or_empty(F.col("error")) == "") & (text_or_empty(F.col("answer")) != "")).orderBy(F.desc("timestamp"), "turn_id")
    return rows.limit(limit) if limit else rows


def baseline_if_absent(versions: DataFrame, scored: DataFrame, version: str = "baseline") -> DataFrame:
    """The registry with a first version of the mean scores, unless it has one of that name."""
    made = scored.agg(F.lit(version).alias("version"), F.round(F.avg("weighted_score"), 4).alias("score"), F.round(F.avg("faithfulness"), 4).alias("faithfulness"), F.count("*").alias("samples"))
    return insert_missing(versions, made.where("samples > 0").drop("samples"), ["version"])


def context_of(turns: DataFrame, retrieved: DataFrame, id: str) -> DataFrame:
    """contexts: stored snippets of more than 15 characters, else those retrieved again(id, snippets)."""
    kept = F.filter(F.col("context_snippets"), lambda s: F.length(s["text"]) > 15)
    return turns.join(retrieved, id, "left").withColumn("contexts", F.when(F.size(kept) > 0, F.transform(kept, lambda s: s["text"])).otherwise(F.coalesce("snippets", F.array().cast("array<string>")))).drop("snippets")


def closest(said: DataFrame, seen: DataFrame, id: str) -> DataFrame:
    """(id, s, best): for each vector ``a`` of said(id, s, a) the largest cosine with a vector ``b`` of seen(id, w, b) of its
    id, 0 with a vector without length; s and w number the vectors of an id. Vectors meet in blocks of one id, by a matrix
    product each, so neither pairs nor all vectors of an id are ever rows of one task; a block adds one number a vector."""
    blocks = lambda df, c, n: df.groupBy(id, F.floor(F.col(n) / CLOSEST_BLOCK).alias(f"_{n}")).agg(*[F.collect_list(x).alias(x) for x in c])
    kind = said.schema[id].dataType.simpleString()

    def cosines(x: pa.Array, y: pa.Array) -> np.ndarray:
        m, n = (v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(v), -1) for v in (x, y))
        length = np.sqrt((m * m).sum(axis=1)[:, None] * (n * n).sum(axis=1))  # one root, so whole numbers give the nearest double
        return np.divide(m @ n.T, length, out=np.zeros_like(length), where=length > 0)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            s, a, b = (batch.column(names.index(c)) for c in ("s", "a", "b"))
            each = [cosines(a[i].values, b[i].values).max(axis=1) for i in range(batch.num_rows)]
            if each:
                sizes = np.array([len(x) for x in each])
                yield pa.RecordBatch.from_arrays([batch.column(names.index(id)).take(pa.array(np.repeat(np.arange(len(each)), sizes))), s.flatten().cast(pa.int64()), pa.array(np.concatenate(each))], [id, "s", "best"])

    met = blocks(said, ["s", "a"], "s").select(id, "s", "a").join(blocks(seen, ["b"], "w").select(id, "b"), id)
    return met.mapInArrow(compare, f"`{id}` {kind}, s long, best double").groupBy(id, "s").agg(F.max("best").alias("best"))


def approximate_faithfulness(rows: DataFrame, id: str, embed, threshold: float = 0.45) -> DataFrame:
    """(id, faithfulness): share of the answer's sentences whose closest context window has a cosine above the
    threshold; 0.5 where there is nothing to compare. rows: id, answer, contexts. ``embed`` maps a text column to
    a vector column."""
    said = rows.select(id, F.posexplode(sentences(F.col("answer"))).alias("s", "sentence")).select(id, "s", embed(F.col("sentence")).alias("a"))
    seen = rows.select(id, F.posexplode(F.flatten(F.transform("contexts", lambda c: windows(c)))).alias("w", "window")).select(id, "w", embed(F.col("window")).alias("b"))
    share = closest(said, seen, id).groupBy(id).agg(F.round(F.avg(F.when(F.col("best") > threshold, 1.0).otherwise(0.0)), 4).alias("faithfulness"))
    return rows.select(id).join(share, id, "left").select(id, F.coalesce("faithfulness", F.lit(0.5)).alias("faithfulness"))


def summary(scored: DataFrame) -> DataFrame:
    """(kind, name, n, score): all, by signal, by grade and by tag."""
    one = lambda kind, rows, name: rows.groupBy(name.alias("name")).agg(F.count("*").alias("n"), F.round(F.avg("weighted_score"), 4).alias("score")).select(F.lit(kind).alias("kind"), "name", "n", "score")
    tags = scored.select("weighted_score", F.explode("failure_tags").alias("tag"))
    return one("all", scored, F.lit("all")).unionByName(one("signal", scored, F.col("training_signal"))).unionByName(one("grade", scored, F.col("quality_grade"))).unionByName(one("tag", tags, F.col("tag")))


def rolling_quality(scored: DataFrame, time: str, score: str, baseline: float, last: int = 50, alarm: float = 0.05) -> DataFrame:
    """The mean of the newest ``last`` scores against the baseline."""
    newest = scored.orderBy(F.desc(time), F.desc(score)).limit(last)
    out = newest.agg(F.count("*").alias("n"), F.avg(score).alias("mean"))
    return out.select("n", F.round("mean", 4).alias("rolling"), F.round(F.lit(baseline) - F.col("mean"), 4).alias("regression"), (F.lit(baseline) - F.col("mean") > alarm).alias("alert"))


def rolling_series(scored: DataFrame, by: str, time: str, score: str, tie: str, last: int = 50, large: int = 1_000_000) -> DataFrame:
    """For each row the mean of its and the preceding scores of its group, ``last`` at most. Groups of over ``large`` rows
    are cut into ranges, so that one group is not one task's work; the others take one window."""
    hot = [r[by] for r in scored.groupBy(by).count().where(F.col("count") > large).select(by).collect()]  # one of ``large`` rows at most
    is_hot = F.coalesce(F.col(by).isin([x for x in hot if x is not None]), F.lit(None in hot)) if hot else F.lit(False)
    w = Window.partitionBy(by).orderBy(time, tie).rowsBetween(-(last - 1), 0)
    small = scored.where(~is_hot).withColumn("rolling", F.avg(score).over(w))
    return small.unionByName(_ranged_series(scored.where(is_hot), by, time, score, tie, last)) if hot else small


def _ranged_series(scored: DataFrame, by: str, time: str, score: str, tie: str, last: int) -> DataFrame:
    """As ``rolling_series``: groups are cut into ranges of (time, tie), and each range is handed the rows of its group just
    before it."""
    ranged = staged(scored.repartitionByRange(max(2, int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))), by, time, tie).withColumn("__part", F.spark_partition_id()), "ranges")
    before = Window.partitionBy(by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy(by, "__part").agg(F.count("*").alias("__n")).withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    starts = starts.select(F.col(by).alias("__by"), F.col("__part").alias("__to"), "__start", (F.col("__start") + F.col("__n")).alias("__end"))
    back = F.row_number().over(Window.partitionBy(by, "__part").orderBy(F.desc(time), F.desc(tie)))
    tails = ranged.select(*dict.fromkeys((by, time, tie, score)), "__part", back.alias("__back")).where(F.col("__back") < last)
    same = F.col(by).eqNullSafe(F.col("__by"))
    tails = tails.join(starts, same & (F.col("__part") == F.col("__to"))).withColumn("__at", F.col("__end") - F.col("__back")).drop("__by", "__to", "__start", "__end", "__back", "__part")
    handed = tails.join(starts, same & (F.col("__start") > F.col("__at")) & (F.col("__start") - F.col("__at") < last)).withColumn("__part", F.col("__to")).drop("__by", "__to", "__start", "__end", "__at")
    rows = ranged.withColumn("__own", F.lit(True)).unionByName(handed.withColumn("__own", F.lit(False)), allowMissingColumns=True)
    w = Window.partitionBy(by, "__part").orderBy(time, tie).rowsBetween(-(last - 1), 0)
    return rows.withColumn("rolling", F.avg(score).over(w)).where("__own").drop("__part", "__own")


def approximate_relevance(query: Column, answer: Column, embed) -> Column:
    """Cosine of the question and the first 800 characters of the answer, within 0 and 1."""
    return half_even(_clamp(cosine(embed(query), embed(F.left(text_or_empty(answer), F.lit(800))))))


def ladder(judged: Column, approximate: Column, n_contexts: Column) -> Column:
    """The judge's score, else the approximate one; 0.30 without any context."""
    return F.when(n_contexts == 0, 0.30).otherwise(F.coalesce(F.nanvl(judged, F.lit(None).cast("double")), F.nanvl(approximate, F.lit(None).cast("double")), F.lit(0.30)))
