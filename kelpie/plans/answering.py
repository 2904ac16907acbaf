"""Questions end to end: route them, run their calls over landed tables, and count."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import replace

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from kelpie.functions import intent
from kelpie.plans import catalogue, routing

#: Calls that one question may make: its rule asks at most 12 projects for two things, or 12 and 10.
MOST_CALLS = 2 * routing.FAN_GITLAB
RESULTS = "call string, position int, source string, operation string, project string, success boolean, n long, limit long, error string"


def run_calls(spark: SparkSession, calls: list[Row], tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per call(question_id, position, source, operation, params) with its number of rows, to its limit. A call
    that is unknown, has wrong parameters or no table is a row with an error. Calls are few: plans are built in the driver,
    as one union, and run as one job."""
    out = spark.createDataFrame([], RESULTS)
    for c in calls:
        params = dict(c["params"] or {})
        project = params.get("project") or params.get("project_key") or ""
        told = [F.lit(c["question_id"]).alias("call"), F.lit(c["position"]).alias("position"), F.lit(c["source"]).alias("source"), F.lit(c["operation"]).alias("operation"), F.lit(project).alias("project")]
        try:
            spec = catalogue.build(c["source"], c["operation"], **params)
            rows = catalogue.run(replace(spec, columns=(), left={}), tables)
        except (KeyError, TypeError, ValueError) as e:
            one = spark.range(1).select(*told, F.lit(False).alias("success"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("limit"), F.lit(str(e)).alias("error"))
        else:
            one = rows.agg(F.count("*").alias("n")).select(*told, F.lit(True).alias("success"), "n", F.lit(spec.limit).cast("long").alias("limit"), F.lit(None).cast("string").alias("error"))
        out = out.unionByName(one)
    return out


def answer(questions: DataFrame, tables: Mapping[str, DataFrame], all_gitlab: list[str] | None = None, all_jira: list[str] | None = None, most: int = 100) -> DataFrame:
    """(question_id, rule, counts, text): for questions as ``routing.route`` takes them, ``most`` at a time (checked), the
    rule that fits, whether only a count is asked, and the count in words; text is null where a model has to write."""
    spark = questions.sparkSession
    routed = routing.route(questions, all_gitlab, all_jira).withColumn("counts", intent.only_counts(F.col("question")))
    asked = routed.select("question_id", "question", "rule", "counts", "calls").limit(most + 1).collect()
    if len(asked) > most:
        raise ValueError(f"more than {most} questions at a time")
    calls = [Row(question_id=str(r["question_id"]), position=i, source=c["source"], operation=c["operation"], params=c["params"]) for r in asked if r["counts"] for i, c in enumerate(r["calls"][:MOST_CALLS])]
    named = spark.createDataFrame([(str(r["question_id"]), r["question"], r["rule"], r["counts"]) for r in asked], "call string, question string, rule string, counts boolean")
    text = catalogue.count_text(run_calls(spark, calls, tables), named.where("counts").select("call", "question"))
    return named.join(text, "call", "left").select(F.col("call").alias("question_id"), "rule", "counts", "text")
