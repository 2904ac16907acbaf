"""Data sets from scored turns: exports, splits, token F1, benchmark averages, release gates, registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpie.functions.text import half_even, query_hash, text_or_empty
from kelpie.sources.sinks import upsert

#: Gates of a release.
MIN_FAITH, MIN_LIVE_FAITH, MIN_GAIN = 0.80, 0.75, 0.005
#: Words that token F1 passes over.
F1_STOP = [
    "the", "a", "an", "is", "are", "was", "were", "it", "its", "this", "that", "to", "of", "in", "for", "on", "and", "or", "be", "been", "being", "have", "has", "had", "do", "does", "did",
]
#: Fixed value: ticket keys that an answer cites.
CITED_KEY = r"(?<![A-Z])(?<![a-z])(?<!-)\b([A-Z]{2,5}-\d{1,6})\b"


def positives(scored: DataFrame, at_least: float = 0.80, limit: int | None = None) -> DataFrame:
    """GOLD turns, or those marked positive before there were grades, best first."""
    good = (F.col("quality_grade") == "GOLD") | (F.col("quality_grade").isNull() & (F.col("training_signal") == "qlora_positive"))
    rows = scored.where((F.col("weighted_score") >= at_least) & good)
    rows = rows.orderBy(F.desc("weighted_score"), "turn_id")
    return rows.limit(limit) if limit else rows


def preference_candidates(scored: DataFrame, limit: int | None = None) -> DataFrame:
    """FAILED for a reason that the model can learn from, or rejected before there were grades, worst first."""
    tags = F.arrays_overlap("failure_tags", F.array(F.lit("hallucination"), F.lit("tool_misuse")))
    rows = scored.where(((F.col("quality_grade") == "FAILED") & tags) | (F.col("quality_grade").isNull() & (F.col("training_signal") == "dpo_rejected"))).orderBy("weighted_score", "turn_id")
    return rows.limit(limit) if limit else rows


def rollouts(scored: DataFrame, limit: int | None = None) -> DataFrame:
    """Live turns, newest first, with their first ten sources and a reward hint: the faithfulness (0.5 if missing) where
    the checks scored, else the weighted score; null means that it is left to training."""
    hint = F.when(F.col("scoring_method") == "validator", F.coalesce("faithfulness", F.lit(0.5))).otherwise(F.col("weighted_score"))
    rows = scored.where(F.col("intent").isin("sentries", "both") & F.col("answer").isNotNull()).withColumn("reward_hint", hint).withColumn("sources", F.slice("sources", 1, 10))
    return rows.orderBy(F.desc("timestamp"), "turn_id").limit(limit) if limit else rows


def seeds(turns: DataFrame, under_s: float = 10.0, limit: int = 30) -> DataFrame:
    """The newest quick turns that have an answer and no error."""
    return turns.where((F.col("total_time_s") < under_s) & F.col("answer").isNotNull() & (text_or_empty(F.col("error")) == "")).orderBy(F.desc("timestamp"), "turn_id").limit(limit)


def stats(scored: DataFrame) -> DataFrame:
    c = F.count_if
    return scored.agg(
        F.count("*").alias("total"), c(F.col("weighted_score").isNotNull()).alias("evaluated"), c(F.col("training_signal") == "qlora_positive").alias("positive"), c(F.col("training_signal") == "dpo_rejected").alias("rejected"),
        c(F.col("quality_grade") == "GOLD").alias("gold"), c(F.col("quality_grade") == "FAILED").alias("failed"), F.round(F.avg("weighted_score"), 4).alias("mean_score"))


def tag_counts(scored: DataFrame) -> DataFrame:
    return scored.select(F.explode("failure_tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def tokens(c: Column) -> Column:
    words = F.regexp_extract_all(F.lower(text_or_empty(c)), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(F1_STOP))


def token_f1(a: Column, b: Column) -> Column:
    """F1 of the overlap of two bags of words, to four digits; 0 if either is empty. Each word is numbered by its place in
    the sorted bag less that of the first of its equals, so that the overlap of the bags is one of sets. For short texts:
    each word looks for its first equal; ``token_f1_rows`` takes texts of any length."""
    x, y = tokens(a), tokens(b)
    both = F.size(F.array_intersect(_numbered(x), _numbered(y)))
    return F.when((F.size(x) == 0) | (F.size(y) == 0) | (both == 0), 0.0).otherwise(half_even(2 * both / (F.size(x) + F.size(y))))


def _numbered(bag: Column) -> Column:
    ordered = F.array_sort(bag)
    return F.transform(ordered, lambda w, i: F.struct(w.alias("word"), (i + 1 - F.array_position(ordered, w)).alias("n")))


def token_f1_rows(rows: DataFrame, id: list[str], a: str, b: str) -> DataFrame:
    """``rows`` (of unique, filled ``id``) with f1, as ``token_f1`` gives it, by counts of words: work grows with the texts."""
    of = lambda c, x, y: rows.select(*id, F.explode(tokens(F.col(c))).alias("_w"), F.lit(x).alias("_x"), F.lit(y).alias("_y"))
    counts = of(a, 1, 0).unionByName(of(b, 0, 1)).groupBy(*id, "_w").agg(F.sum("_x").alias("_x"), F.sum("_y").alias("_y"))
    sums = counts.groupBy(*id).agg(F.sum(F.least("_x", "_y")).alias("_both"), F.sum("_x").alias("_x"), F.sum("_y").alias("_y"))
    f1 = F.when(F.col("_both") > 0, half_even(2 * F.col("_both") / (F.col("_x") + F.col("_y")))).otherwise(0.0)
    return rows.join(sums, id, "left").withColumn("f1", f1).drop("_both", "_x", "_y")


def benchmark_averages(scored: DataFrame, metrics: list[str]) -> DataFrame:
    """Means by intent and over all (intent 'overall'), NULL left out."""
    out = scored.rollup("intent").agg(F.grouping("intent").alias("_g"), F.count("*").alias("samples"), *[F.round(F.avg(m), 4).alias(m) for m in metrics])
    return out.withColumn("intent", F.when(F.col("_g") == 1, "overall").otherwise(F.col("intent"))).drop("_g")


def baseline(versions: DataFrame) -> DataFrame:
    """The deployed version deployed last."""
    return versions.where("status = 'deployed'").agg(F.max_by(F.struct("version", "score", "faithfulness"), F.struct("deployed_at", "version")).alias("b")).select("b.*")


def gates(averages: DataFrame, base: DataFrame, allow_equal: bool = False) -> DataFrame:
    """One row: whether a release may go, and why not, by the gates in order. The gain must reach the least gain, or 0
    if equal scores are allowed."""
    one = lambda intent, name: averages.where(F.col("intent") == intent).agg(F.max("faithfulness").alias(f"{name}_faith"), F.max("score").alias(f"{name}_score"))
    row = one("overall", "all").crossJoin(F.broadcast(one("sentries", "live"))).crossJoin(F.broadcast(base.agg(F.max("score").alias("base_score"))))  # each is one row
    gain = F.col("all_score") - F.col("base_score")
    reason = (
        F.when(F.coalesce("all_faith", F.lit(0.0)) < MIN_FAITH, "faithfulness").when(F.col("live_faith").isNotNull() & (F.col("live_faith") < MIN_LIVE_FAITH), "live_faithfulness")
        .when(F.col("base_score").isNotNull() & (F.round(gain, 6) < (0.0 if allow_equal else MIN_GAIN)), "no_gain"))
    return row.withColumn("gain", F.round(gain, 4)).withColumn("reason", reason).withColumn("deploy", reason.isNull())


def register(versions: DataFrame, new: DataFrame) -> DataFrame:
    return upsert(versions, new, ["version"], F.col("registered_at"))


def mark_deployed(versions: DataFrame, version: str, at: Column) -> DataFrame:
    """The registry with the version, if it is there, as deployed."""
    mine = F.col("version") == version
    return versions.withColumn("status", F.when(mine, "deployed").otherwise(F.col("status"))).withColumn("deployed_at", F.when(mine, at).otherwise(F.col("deployed_at")))


def list_versions(versions: DataFrame) -> DataFrame:
    """Newest benchmark first."""
    return versions.orderBy(F.desc_nulls_last("registered_at"), "version")


def exclusion_reasons(scored: DataFrame, least: int = 120) -> DataFrame:
    """Adds reasons: why a GOLD turn may not be used for training. Live turns whose live summary was not kept (null; an
    empty one was kept); turns scored without context, but for knowledge turns with stored or retrieved snippets; short
    answers, with their length; long live answers from tickets that cite no key."""
    answer, live = text_or_empty(F.col("answer")), F.coalesce(F.col("intent").isin("sentries", "both"), F.lit(False))
    method, source = text_or_empty(F.col("scoring_method")), text_or_empty(F.col("scoring_context_source"))
    empty = F.contains(method, F.lit("no_context")) | (source == "empty")
    exempt = (text_or_empty(F.col("intent")) == "rag") & source.isin("stored_snippets", "neo4j_tier2_fallback")
    tickets = F.exists(F.coalesce("sources", F.array()), lambda s: F.coalesce(s["source"] == "jira", F.lit(False)))
    rules = [
        (live & F.col("summary").isNull(), F.lit("no_live_sentries")), (empty & ~exempt, F.lit("no_real_context")),
        (F.length(answer) < least, F.concat(F.lit("short_answer("), F.length(answer).cast("string"), F.lit("c)"))),
        (live & tickets & ~F.upper(answer).rlike(CITED_KEY) & (F.length(answer) > 80), F.lit("no_keys_cited_despite_jira_sources"))]
    return scored.withColumn("reasons", F.array_compact(F.array(*[F.when(c, n) for c, n in rules])))


def first_of_query(rows: DataFrame, order: list[Column], query: str = "query") -> DataFrame:
    """One row per normalised query: the first."""
    w = Window.partitionBy("query_hash").orderBy(*order)
    return rows.withColumn("query_hash", query_hash(F.col(query))).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def training_rows(scored: DataFrame, system: Column, order: list[Column], least: int = 80) -> DataFrame:
    """Distinct questions with answers of 80 characters and more, as messages."""
    rows = first_of_query(scored.where(F.length("answer") >= least), order)
    say = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return rows.withColumn("messages", F.array(say("system", system), say("user", F.col("query")), say("assistant", F.col("answer"))))


def preference_pairs(rejected: DataFrame, chosen: DataFrame) -> DataFrame:
    """Rejected turns with their curated better answer (50 characters and more)."""
    good = chosen.where(F.length("chosen") >= 50).select("turn_id", "chosen")
    return rejected.join(good, "turn_id").select("turn_id", F.col("query").alias("prompt"), "chosen", F.col("answer").alias("rejected"))


def split(rows: DataFrame, id: str, eval_percent: int = 15) -> DataFrame:
    """Adds split by a hash of the id: stable under re-runs and new rows."""
    return rows.withColumn("split", F.when(F.pmod(F.crc32(F.col(id).cast("string")), F.lit(100)) < eval_percent, "eval").otherwise("train"))


def failure_reason() -> Column:
    """Why a turn scored low, for reviewers: the first of a refusal and the low metrics (a missing one is not low)."""
    low = lambda c, x: F.coalesce(F.col(c) < x, F.lit(False))
    return (
        F.when(text_or_empty(F.col("answer")).rlike(r"(?i)i\s+don.t\s+have\s+access|i\s+can.t\s+(access|call|query)"), "api_refusal").when(low("faithfulness", 0.40), "low_faithfulness")
        .when(low("temporal_consistency", 0.50), "temporal_inconsistency").when(low("answer_relevance", 0.40), "off_topic").when(low("code_correctness", 0.50), "code_syntax_error").otherwise("low_overall_score"))


def check_reasons(checks: Column) -> Column:
    """The first three checks with a penalty, 'name: note' (80 characters), joined by ' | '."""
    failed = F.filter(F.coalesce(checks, F.array()), lambda c: F.coalesce(c["penalty"], F.lit(0.0)) > 0)
    return F.array_join(F.slice(F.transform(failed, lambda c: F.concat(c["name"], F.lit(": "), F.left(text_or_empty(c["note"]), F.lit(80)))), 1, 3), " | ")


def mismatches(trained: Column, served: Column) -> Column:
    """What speaks against serving an adapter trained on one model with another: version and size of the model family
    that both names state, or a name that states neither."""
    part = lambda c, pattern: F.nullif(F.regexp_extract(text_or_empty(c), pattern, 1), F.lit(""))
    family, size = [part(c, r"(?i)qwen[\s_-]?(\d+(?:\.\d+)?)") for c in (trained, served)], [part(c, r"(?i)(\d+(?:\.\d+)?)\s*b\b") for c in (trained, served)]
    unclear = (family[0].isNull() & size[0].isNull()) | (family[1].isNull() & size[1].isNull())
    said = [
        F.when(family[0] != family[1], F.concat(F.lit("family "), family[0], F.lit(" for "), family[1])), F.when(size[0] != size[1], F.concat(F.lit("size "), size[0], F.lit("B for "), size[1], F.lit("B"))), F.when(unclear, F.lit("unclear name"))]
    return F.array_compact(F.array(*said))


def compatible(trained: Column, served: Column) -> Column:
    return F.size(mismatches(trained, served)) == 0


def score_samples(samples: DataFrame, year: int | None = None) -> DataFrame:
    """Scores of evaluation samples(query, expected_answer, generated_answer, intent, sources, summary, rag_faith,
    rag_relevance): a generated answer is judged, else the expected one. Knowledge and mixed samples take the given
    faithfulness and relevance, live ones those of the checks, others 0.5; token_f1 only where a generated answer differs
    from an expected one."""
    from kelpie.operators import evaluate as e

    answer = F.coalesce(F.nullif("generated_answer", F.lit("")), F.col("expected_answer"), F.lit(""))
    out = samples.withColumn("answer", answer).withColumn("intent", F.coalesce("intent", F.lit("rag")))
    out = out.withColumn("temporal_consistency", e.temporal_consistency(F.col("answer"), year)).withColumn("code_correctness", e.code_correctness(F.col("answer")))
    out = out.withColumn("checks", e.validator_checks(F.col("query"), F.col("answer"), F.col("sources"), F.col("summary")))
    live, known = F.col("intent") == "sentries", F.col("intent").isin("rag", "both")
    pick = lambda rag, checked: F.when(known, F.col(rag)).when(live, checked).otherwise(F.lit(0.5))
    out = out.withColumn("faithfulness", pick("rag_faith", e.validator_score(F.col("answer"), F.col("summary"), F.col("checks")))).withColumn("answer_relevance", pick("rag_relevance", e.answer_relevance(F.col("query"), F.col("answer"))))
    out = out.withColumn("scoring_method", F.when(known, "given").when(live, "validator").otherwise("unknown_intent"))
    out = out.withColumn("weighted_score", e.weighted_score(F.col("faithfulness"), F.col("answer_relevance"), F.col("temporal_consistency"), F.col("code_correctness")))
    both = (text_or_empty(F.col("expected_answer")) != "") & (F.col("answer") != "") & (F.col("expected_answer") != F.col("answer"))
    return out.withColumn("token_f1", F.when(both, token_f1(F.col("expected_answer"), F.col("answer"))))


def post_promotion(scored: DataFrame, most: int = 30, faith: float = 0.7) -> DataFrame:
    """Mean score of the newest samples at a fixed faithfulness."""
    from kelpie.operators.evaluate import weighted_score

    rows = scored.orderBy(F.desc("timestamp"), "turn_id").limit(most)
    w = weighted_score(F.lit(faith), F.col("answer_relevance"), F.col("temporal_consistency"), F.col("code_correctness"))
    return rows.agg(F.count("*").alias("samples"), F.round(F.avg(w), 4).alias("score"))


def grade_shares(scored: DataFrame) -> DataFrame:
    """Count and percentage of each grade."""
    n = scored.groupBy("quality_grade").agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(scored.agg(F.count("*").alias("_t")))).select("quality_grade", "n", F.round(100 * F.col("n") / F.col("_t"), 1).alias("percent"))  # one row


def reference_eval_set(spark) -> DataFrame:
    """An empty evaluation set to fill in: a question for each intent."""
    rows = [("Show the open issues of the platform project", "", "sentries"), ("Which merge requests are waiting for review?", "", "sentries"), ("How is authentication configured?", "", "rag"), ("Explain the deployment architecture", "", "rag"), ("What do we know about the login bug and its fix?", "", "both")]
    return spark.createDataFrame(rows, "query string, expected_answer string, intent string")
