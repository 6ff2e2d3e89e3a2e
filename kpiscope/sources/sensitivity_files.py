"""Sensitivity files: global and local rows as CSV, a table of each station as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiscope.operators.sensitivity import grid

# Columns of the two files, in their order.
GLOBAL_COLUMNS = ("scope", "source", "target", "perturbation_type", "S_raw", "S_norm", "magnitude")
LOCAL_COLUMNS = ("scope", "event_idx", "source", "target", "S_raw", "S_norm", "magnitude")
NAMES = {"src": "source", "tgt": "target", "ptype": "perturbation_type", "s_raw": "S_raw", "s_norm": "S_norm"}


def write_sensitivity(flat: DataFrame, kpis: list[str], path: str) -> None:
    """Rows of sensitivity.flatten below a folder: global and local ones as CSV in rows/file=..., a table per station in sensitivity_summary.

    The flat table is evaluated once; the summaries are made from the written rows. Local rows keep their
    target, as one event can act on several channels.
    """
    named = flat.withColumnsRenamed(NAMES)
    named.select("station_id", "scope", "source", "target", "perturbation_type", "S_raw", "S_norm", "magnitude", "event_idx").withColumn("file", F.concat(F.lit("sensitivity_"), "scope")).write.mode(
        "overwrite"
    ).partitionBy("file").csv(f"{path}/rows", header=True)
    rows = read_sensitivity(flat.sparkSession, path)["global"]
    summary_lines(rows, kpis).write.mode("overwrite").partitionBy("station_id").text(f"{path}/sensitivity_summary")


def summary_lines(global_rows: DataFrame, kpis: list[str]) -> DataFrame:
    """(station_id, value): the lines of a station's table in one text, sources down and targets across."""
    cells = grid(global_rows.withColumnsRenamed({v: k for k, v in NAMES.items()}), kpis)
    head = f"| Source | {' | '.join(kpis)} |\n|---{'|---' * len(kpis)}|"
    line = F.concat(F.lit("| "), F.concat_ws(" | ", "src", *[F.format_string("%.4f", k) for k in kpis]), F.lit(" |"))
    lines = F.array_sort(F.collect_list(F.struct("src", line.alias("line"))))  # one line per channel
    text = F.concat_ws("\n", F.lit("## Global Sensitivity\n\n" + head), F.transform(lines, lambda x: x["line"]))
    return cells.groupBy("station_id").agg(text.alias("value"))


def read_sensitivity(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Global and local rows, each with the columns of its file."""
    schema = "station_id string, scope string, source string, target string, perturbation_type string, S_raw double, S_norm double, magnitude string, event_idx int"
    rows = spark.read.schema(f"{schema}, file string").option("header", True).csv(f"{path}/rows")
    columns = {"global": GLOBAL_COLUMNS, "local": LOCAL_COLUMNS}
    return {scope: rows.filter(F.col("file") == f"sensitivity_{scope}").select("station_id", *names) for scope, names in columns.items()}
