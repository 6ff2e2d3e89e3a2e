"""Judge answers: parsing, scores per report, summaries per arm."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kpiscope.functions.exprs import col

ID = ("station_id", "arm")
AXES = ("kpi_mention", "time_mention", "mechanism", "mitigation")


def json_body(text: str | Column) -> Column:
    """Outermost object of an answer, fences or chatter around it dropped; NULL if there is none."""
    return F.nullif(F.regexp_extract(col(text), r"(?s)(\{.*\})", 1), F.lit(""))


def likert(value: Column) -> Column:
    """Score 1..5 as a number in [0, 1]; anything else is NULL. Fractions are cut like int() does."""
    n = F.trim(value)
    whole = F.when(n.rlike(r"^[+-]?\d+$"), n.try_cast("int")).when(n.rlike(r"^[+-]?\d+\.\d+$"), n.try_cast("double").cast("int"))
    return F.when(whole.between(1, 5), (whole - 1) / 4.0)


def parse_score(text: str | Column, field: str = "score") -> Column:
    """Score of a field; a fraction counts only as a number, not as a string."""
    body = json_body(text)
    value = F.get_json_object(body, f"$.{field}")
    quoted = body.rlike(rf'"{field}"\s*:\s*"')
    return likert(F.when(~quoted | F.trim(value).rlike(r"^[+-]?\d+$"), value))


def parse_answers(answers: DataFrame, text: str = "answer") -> DataFrame:
    score = parse_score(text)
    body = json_body(text)
    why = F.coalesce(F.get_json_object(body, "$.rationale"), F.get_json_object(body, "$.reasoning"))
    return answers.withColumn("score", score).withColumn("parsed", score.isNotNull()).withColumn("rationale", F.trim(why))


def parse_axes(answers: DataFrame, text: str = "answer") -> DataFrame:
    """Four axis scores per event; an axis that cannot be read counts as 0."""
    out = answers
    for a in AXES:
        out = out.withColumn(a, F.coalesce(parse_score(text, a), F.lit(0.0)))
    return out.withColumn("alignment", sum((F.col(a) for a in AXES), F.lit(0.0)) / len(AXES))


def faithfulness(parsed: DataFrame) -> DataFrame:
    """Mean score over readable claims; NULL when none is readable."""
    return parsed.groupBy(*ID).agg(
        F.avg("score").alias("faithfulness"), F.count("*").alias("n_claims"), F.count("score").alias("n_scored")
    )


def answer_relevancy(reports: DataFrame, aligned: DataFrame) -> DataFrame:
    """Mean alignment over events; NULL for reports without events."""
    per = aligned.groupBy(*ID).agg(F.avg("alignment").alias("answer_relevancy"), F.count("*").alias("n_events"))
    return reports.select(*ID).distinct().join(per, list(ID), "left").na.fill(0, ["n_events"])


def harmonic(a: str | Column, b: str | Column) -> Column:
    """Harmonic mean, 0 when either side is not positive."""
    x, y = col(a), col(b)
    return F.when((x <= 0) | (y <= 0), F.lit(0.0)).otherwise(2 / (1 / x + 1 / y))


def arm_summary(scores: DataFrame, first: str, second: str, metrics: tuple[str, ...] = ("faithfulness", "answer_relevancy")) -> DataFrame:
    """n, mean, deviation and range per arm and metric, and of the paired difference of two arms."""
    long = scores.unpivot(["station_id", "arm"], list(metrics), "metric", "value").filter("value IS NOT NULL")
    side = long.filter(F.col("arm").isin(first, second)).groupBy("station_id", "metric").agg(
        (F.max(F.when(F.col("arm") == first, F.col("value"))) - F.max(F.when(F.col("arm") == second, F.col("value")))).alias("value")
    )
    diff = side.filter("value IS NOT NULL").withColumn("arm", F.lit(f"{first} - {second} (paired)"))
    both = long.unionByName(diff.select(*long.columns))
    return both.groupBy("arm", "metric").agg(
        F.count("*").alias("n"),
        F.avg("value").alias("mean"),
        F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("stdev"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )


def arm_wide(scores: DataFrame, arms: list[str], metrics: tuple[str, ...]) -> DataFrame:
    """One row per station, one column per metric and arm."""
    cells = [F.max(F.when(F.col("arm") == a, F.col(m))).alias(f"{m}_{a}") for m in metrics for a in arms]
    return scores.groupBy("station_id").agg(*cells)
