"""Queries of data sets, review and scores over turns made of ``conversations``, and the same in DuckDB SQL.

Scores, tags and methods are set by a number of each turn, so that every branch is reached by many turns."""

from __future__ import annotations

from pyspark.sql import functions as F

from kelpie.operators import datasets, evaluate, serving
from kelpie.queries import _PAIRS, _pairs, query


def _share(c, k):
    return ((c * k) % 100) / 100


def _scored(spark, sf_dir):
    m = F.col("m")
    pick = lambda n, *values: F.get(F.array(*[F.lit(v) for v in values]), (m % n).cast("int"))
    none = F.array().cast("array<string>")
    rows = _pairs(spark, sf_dir).select("conv_id", F.concat_ws("-", "conv_id", "turn").alias("turn_id"), (F.col("conv_id") * 7 + F.col("turn") * 3).alias("m"), "query", "answer")
    rows = rows.select(
        "conv_id", "turn_id", "m", "query", F.when(m % 6 == 0, F.concat("answer", F.lit(" See ABC-12"))).when(m % 17 == 1, "I can't access it").otherwise(F.col("answer")).alias("answer"),
        F.when(m % 11 != 0, _share(m, 13)).alias("weighted_score"), F.when(m % 13 != 0, _share(m, 17)).alias("faithfulness"), _share(m, 19).alias("temporal_consistency"), _share(m, 23).alias("answer_relevance"),
        F.when(m % 5 == 0, _share(m, 29)).alias("code_correctness"),
        F.when(m % 7 == 0, F.array(F.lit("hallucination"))).when(m % 7 == 1, F.array(F.lit("latency_breach"))).when(m % 7 == 2, F.array(F.lit("incomplete"), F.lit("tool_misuse"))).otherwise(none).alias("failure_tags"),
        pick(4, "sentries", "rag", "both", None).alias("intent"), pick(3, "validator", "validator+judge", "no_context").alias("scoring_method"), pick(5, "stored_snippets", "empty", "unknown", "neo4j_tier2_fallback", None).alias("scoring_context_source"),
        F.when(m % 2 == 1, F.array().cast("array<struct<source:string,titles:array<string>>>")).alias("summary"), F.when(m % 3 != 0, F.array(F.struct(F.lit("jira").alias("source")), F.struct(F.lit("gitlab").alias("source")))).alias("sources"),
        F.timestamp_seconds(m + 1_700_000_000).alias("timestamp"), (m % 15).cast("double").alias("total_time_s"), F.when(m % 9 == 0, "boom").alias("error"))
    graded = rows.withColumn("quality_grade", F.when(m % 10 != 3, evaluate.quality_grade(F.col("weighted_score"), F.col("faithfulness"), F.col("failure_tags"))))
    return graded.withColumn("training_signal", evaluate.training_signal(evaluate.quality_grade(F.col("weighted_score"), F.col("faithfulness"), F.col("failure_tags")), F.col("failure_tags"), F.col("weighted_score")))


_SCORED = f"""{_PAIRS},
s0 AS (SELECT conv_id, concat_ws('-', conv_id, turn) AS turn_id, conv_id * 7 + turn * 3 AS m, query, answer FROM pairs),
s1 AS (
  SELECT conv_id, turn_id, m, query, CASE WHEN m % 6 = 0 THEN answer || ' See ABC-12' WHEN m % 17 = 1 THEN 'I can''t access it' ELSE answer END AS answer,
    CASE WHEN m % 11 <> 0 THEN (m * 13 % 100) / 100 END AS weighted_score, CASE WHEN m % 13 <> 0 THEN (m * 17 % 100) / 100 END AS faithfulness, (m * 19 % 100) / 100 AS temporal_consistency,
    (m * 23 % 100) / 100 AS answer_relevance, CASE WHEN m % 5 = 0 THEN (m * 29 % 100) / 100 END AS code_correctness,
    CASE m % 7 WHEN 0 THEN ['hallucination'] WHEN 1 THEN ['latency_breach'] WHEN 2 THEN ['incomplete', 'tool_misuse'] ELSE [] END AS failure_tags,
    ['sentries', 'rag', 'both', NULL][m % 4 + 1] AS intent, ['validator', 'validator+judge', 'no_context'][m % 3 + 1] AS scoring_method,
    ['stored_snippets', 'empty', 'unknown', 'neo4j_tier2_fallback', NULL][m % 5 + 1] AS scoring_context_source, m % 2 = 1 AS has_summary, m % 3 <> 0 AS has_tickets, m % 15 AS total_time_s, m % 9 = 0 AS failed FROM s0),
s2 AS (SELECT *, CASE WHEN len(list_intersect(failure_tags, ['hallucination', 'tool_misuse', 'retrieval_miss'])) > 0 OR weighted_score < 0.5 THEN 'FAILED'
  WHEN weighted_score >= 0.85 AND faithfulness >= 0.7 AND len(failure_tags) = 0 THEN 'GOLD' WHEN weighted_score >= 0.7 THEN 'SILVER' ELSE 'BRONZE' END AS g FROM s1),
s AS (SELECT *, CASE WHEN m % 10 <> 3 THEN g END AS quality_grade, CASE WHEN g = 'GOLD' THEN 'qlora_positive'
  WHEN g = 'FAILED' AND (len(list_intersect(failure_tags, ['hallucination', 'tool_misuse'])) > 0 OR weighted_score < 0.5) THEN 'dpo_rejected' ELSE 'neutral' END AS training_signal FROM s2)"""


@query(f"WITH {_SCORED} SELECT turn_id, weighted_score FROM s WHERE weighted_score >= 0.8 AND (quality_grade = 'GOLD' OR (quality_grade IS NULL AND training_signal = 'qlora_positive'))")
def d1_positive_turns(spark, sf_dir):
    return datasets.positives(_scored(spark, sf_dir)).select("turn_id", "weighted_score")


@query(f"""WITH {_SCORED} SELECT turn_id, weighted_score FROM s WHERE (quality_grade = 'FAILED' AND len(list_intersect(failure_tags, ['hallucination', 'tool_misuse'])) > 0)
OR (quality_grade IS NULL AND training_signal = 'dpo_rejected')""")
def d2_rejected_turns(spark, sf_dir):
    return datasets.preference_candidates(_scored(spark, sf_dir)).select("turn_id", "weighted_score")


@query(f"""WITH {_SCORED} SELECT turn_id, intent, CASE WHEN scoring_method = 'validator' THEN coalesce(faithfulness, 0.5) ELSE weighted_score END AS reward_hint, CASE WHEN has_tickets THEN 2 END AS n_sources
FROM s WHERE intent IN ('sentries', 'both') AND answer IS NOT NULL""")
def d3_rollouts(spark, sf_dir):
    return datasets.rollouts(_scored(spark, sf_dir)).select("turn_id", "intent", "reward_hint", F.when(F.col("sources").isNotNull(), F.size("sources")).alias("n_sources"))


@query(f"WITH {_SCORED} SELECT turn_id FROM s WHERE total_time_s < 10 AND answer IS NOT NULL AND NOT failed ORDER BY m DESC, turn_id LIMIT 30")
def d4_seed_turns(spark, sf_dir):
    return datasets.seeds(_scored(spark, sf_dir)).select("turn_id")


@query(f"""WITH {_SCORED} SELECT count(*) AS total, count(weighted_score) AS evaluated, count_if(training_signal = 'qlora_positive') AS positive, count_if(training_signal = 'dpo_rejected') AS rejected,
count_if(quality_grade = 'GOLD') AS gold, count_if(quality_grade = 'FAILED') AS failed, round(avg(weighted_score), 4) AS mean_score FROM s""")
def d5_turn_stats(spark, sf_dir):
    return datasets.stats(_scored(spark, sf_dir))


@query(f"WITH {_SCORED} SELECT tag, count(*) AS n FROM (SELECT unnest(failure_tags) AS tag FROM s) GROUP BY tag")
def d5_turn_tags(spark, sf_dir):
    return datasets.tag_counts(_scored(spark, sf_dir))


_REASONS = rf"""{_SCORED}, x AS (SELECT *, coalesce(intent IN ('sentries', 'both'), false) AS live, coalesce(answer, '') AS a FROM s),
reasoned AS (SELECT *, list_filter([
  CASE WHEN live AND NOT has_summary THEN 'no_live_sentries' END,
  CASE WHEN (contains(scoring_method, 'no_context') OR coalesce(scoring_context_source, '') = 'empty') AND NOT (coalesce(intent, '') = 'rag' AND coalesce(scoring_context_source, '') IN ('stored_snippets', 'neo4j_tier2_fallback')) THEN 'no_real_context' END,
  CASE WHEN length(a) < 120 THEN 'short_answer(' || length(a) || 'c)' END,
  CASE WHEN live AND has_tickets AND NOT contains(a, 'ABC-12') AND length(a) > 80 THEN 'no_keys_cited_despite_jira_sources' END], lambda r: r IS NOT NULL) AS reasons FROM x)"""


@query(f"WITH {_REASONS} SELECT turn_id, array_to_string(reasons, '|') AS reasons FROM reasoned")
def d12_exclusion_reasons(spark, sf_dir):
    return datasets.exclusion_reasons(_scored(spark, sf_dir)).select("turn_id", F.array_join("reasons", "|").alias("reasons"))


@query(f"""WITH {_SCORED} SELECT turn_id, CASE WHEN contains(coalesce(answer, ''), 'I can''t access') THEN 'api_refusal' WHEN faithfulness < 0.4 THEN 'low_faithfulness' WHEN temporal_consistency < 0.5 THEN 'temporal_inconsistency'
WHEN answer_relevance < 0.4 THEN 'off_topic' WHEN code_correctness < 0.5 THEN 'code_syntax_error' ELSE 'low_overall_score' END AS reason FROM s""")
def x18_failure_reasons(spark, sf_dir):
    return _scored(spark, sf_dir).select("turn_id", datasets.failure_reason().alias("reason"))


@query(f"WITH {_SCORED} SELECT turn_id FROM s WHERE weighted_score IS NULL AND NOT failed AND coalesce(answer, '') <> ''")
def x16_unscored_turns(spark, sf_dir):
    return evaluate.unscored(_scored(spark, sf_dir)).select("turn_id")


@query(f"""WITH {_SCORED}, each AS (SELECT 'all' AS kind, 'all' AS name, weighted_score FROM s UNION ALL SELECT 'signal', training_signal, weighted_score FROM s UNION ALL SELECT 'grade', quality_grade, weighted_score FROM s
UNION ALL SELECT 'tag', unnest(failure_tags), weighted_score FROM s) SELECT kind, name, count(*) AS n, round(avg(weighted_score), 4) AS score FROM each GROUP BY kind, name""")
def x16_summary(spark, sf_dir):
    return evaluate.summary(_scored(spark, sf_dir))


@query(f"""WITH {_SCORED} SELECT 'v0' AS version, 0.5 AS score, 0.5 AS faithfulness UNION ALL SELECT 'baseline', round(avg(weighted_score), 4), round(avg(faithfulness), 4) FROM s HAVING count(*) > 0""")
def x16_first_baseline(spark, sf_dir):
    versions = spark.range(1).select(F.lit("v0").alias("version"), F.lit(0.5).alias("score"), F.lit(0.5).alias("faithfulness"))
    return evaluate.baseline_if_absent(versions, _scored(spark, sf_dir)).select("version", "score", "faithfulness")


def _chosen(rows):
    return rows.where("m % 7 = 0").select("turn_id", F.concat(F.lit("better "), F.repeat(F.lit("x"), (F.col("m") % 80).cast("int"))).alias("chosen"), F.timestamp_seconds("m").alias("saved_at"))


@query(f"""WITH {_SCORED} SELECT turn_id, CASE WHEN m % 7 = 0 AND 7 + m % 80 >= 50 THEN 'better ' || repeat('x', CAST(m % 80 AS INT)) END AS chosen FROM s WHERE training_signal = 'dpo_rejected'""")
def a4_review_turns(spark, sf_dir):
    """Rejected turns with the better answers that were saved for them, those of 50 characters and more."""
    rows = _scored(spark, sf_dir)
    made = _chosen(rows)
    return serving.review_queue(rows, serving.save_chosen(made.limit(0), made, rows)).select("turn_id", "chosen")


@query(f"""WITH {_REASONS} SELECT turn_id, CASE WHEN conv_id % 10 = 0 AND m % 4 <> 1 THEN 'excluded' WHEN len(reasons) > 0 THEN 'filtered' ELSE 'ready' END AS status FROM reasoned""")
def a5_training_turns(spark, sf_dir):
    """The queue of training, with turns taken out by hand, some of them put back."""
    rows = _scored(spark, sf_dir)
    out = rows.where("conv_id % 10 = 0").select("turn_id", F.lit("by hand").alias("reason"), F.timestamp_seconds("m").alias("excluded_at"))
    excluded = serving.restore(serving.exclude(out.limit(0), out, rows), rows.where("m % 4 = 1").select("turn_id"))
    return serving.training_queue(datasets.exclusion_reasons(rows), excluded).select("turn_id", "status")


_CHECKED = f"""{_PAIRS}, c AS (SELECT concat_ws('-', conv_id, turn) AS turn_id, conv_id, (conv_id * 7 + turn * 3) % 14 AS k FROM pairs)"""
#: Per case: answer ({n}: the conversation's number), whether there is a source, the summary's titles (none: not kept), and the checks that give a penalty, with their sum.
_CASES = [
    ("plain words", True, None, "", 0.0), ("I can't access the API for that", True, None, "api_refusal", 0.30), ("see ZZ-{n} for it", True, None, "jira_key_format,source_coverage", 0.45), ("see http://localhost/a and https://x.example.com", True, None, "url_validity", 0.15),
    ("no results for it", True, None, "honest_empty", -0.10), ("exactly 3 bugs, exactly 4 tickets, there are 5 issues", True, None, "round_stat_fabrication", 0.05), ("see DOC-{n}0, DOC-{n}1", True, None, "source_coverage", 0.20),
    ('the title "[made up here]"', True, None, "source_coverage", 0.25), ("AB-{n} is new", False, [], "sentries_summary_coverage", 0.15), ("nothing was not found", False, [], "honest_empty,sentries_summary_coverage", -0.15),
    ("QQ-{n} and QQ-7", False, ["RR-1 told"], "sentries_summary_coverage", 0.20), ("merge !{n} and !77", False, ["!8888 told"], "sentries_summary_coverage", 0.20), ("no results here", False, ["DOC-{n} told"], "sentries_summary_coverage", 0.10),
    ("DOC-{n} is told", True, None, "", 0.0)]
_CASE_ROWS = ", ".join("({}, '{}', {})".format(i, c[3], c[4]) for i, c in enumerate(_CASES))


@query(f"""WITH {_CHECKED}, cases AS (SELECT * FROM (VALUES {_CASE_ROWS}) AS t(k, fired, penalty))
SELECT turn_id, fired, CAST(penalty AS DOUBLE) AS penalty FROM c JOIN cases USING (k)""")
def x13_seven_checks(spark, sf_dir):
    """The seven checks of answers against sources and summaries, over turns that reach each of their branches."""
    k, n = F.col("k"), F.col("conv_id").cast("string")
    told = lambda t: F.replace(F.lit(t), F.lit("{n}"), n)
    kind = "array<struct<source:string,operation:string,count:bigint,titles:array<string>>>"
    answer, summary, sourced = F.lit(None).cast("string"), F.lit(None).cast(kind), F.lit(False)
    for i, (a, s, titles, _, _) in enumerate(_CASES):
        answer, sourced = F.when(k == i, told(a)).otherwise(answer), F.when(k == i, F.lit(s)).otherwise(sourced)
        if titles is not None:
            made = F.array(*[F.struct(F.lit("jira").alias("source"), F.lit("get").alias("operation"), F.lit(1).cast("long").alias("count"), F.array(told(t)).alias("titles")) for t in titles]).cast(kind)
            summary = F.when(k == i, made).otherwise(summary)
    source = F.struct(F.lit("jira").alias("source"), F.concat(F.lit("DOC-"), n).alias("title"), F.lit("https://tracker.example.com/browse/x").alias("url"), F.concat(F.lit("DOC-"), n).alias("issue_key"), F.lit(False).alias("from_graph"), F.lit(0.5).alias("score"))
    rows = _pairs(spark, sf_dir).select(F.concat_ws("-", "conv_id", "turn").alias("turn_id"), "conv_id", ((F.col("conv_id") * 7 + F.col("turn") * 3) % 14).alias("k"))
    rows = rows.select("turn_id", answer.alias("answer"), F.when(sourced, F.array(source)).otherwise(F.array().cast("array<struct<source:string,title:string,url:string,issue_key:string,from_graph:boolean,score:double>>")).alias("sources"), summary.alias("summary"))
    checks = rows.select("turn_id", evaluate.validator_checks(F.lit("what is it"), F.col("answer"), F.col("sources"), F.col("summary")).alias("c"))
    fired = F.filter("c", lambda x: x["penalty"] != 0)
    return checks.select("turn_id", F.array_join(F.transform(fired, lambda x: x["name"]), ",").alias("fired"), F.round(F.aggregate(fired, F.lit(0.0), lambda s, x: s + x["penalty"]), 6).alias("penalty"))
