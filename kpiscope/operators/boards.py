"""Leaderboards, run tables and station selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kpiscope.functions.exprs import settle


def leaderboard(completed: DataFrame, skipped: DataFrame, metric: str = "metric") -> DataFrame:
    """Finished and skipped runs in one table, best first, missing metrics last."""
    both = completed.withColumn("status", F.lit("completed")).unionByName(
        skipped.withColumn("status", F.lit("skipped")), allowMissingColumns=True
    )
    return both.orderBy("status", F.col(metric).asc_nulls_last())


def top_runs(board: DataFrame, metric: str, k: int = 30, tie: str = "run_id") -> DataFrame:
    """Best k finished runs (sort and limit stay a per-partition top-k until the final merge)."""
    return board.filter("status = 'completed'").orderBy(F.col(metric).asc_nulls_last(), tie).limit(k)


def model_pivot(per_kpi: DataFrame, models: list[str], kpis: list[str], value: str) -> DataFrame:
    """Model rows, KPI columns, mean of one metric; the KPI list is known, so one aggregation does it."""
    cells = [F.avg(F.when(F.col("kpi") == k, F.col(value))).alias(k) for k in kpis]
    return per_kpi.groupBy(*models).agg(*cells)


def weeks_order(weeks: str | Column) -> Column:
    """Sort key: zero-shot, ascending weeks, then "full"."""
    w = F.col(weeks) if isinstance(weeks, str) else weeks
    n = w.try_cast("int")
    cls = F.when(w == "full", 2).when(n == 0, 0).otherwise(1)
    return F.struct(cls, F.when(cls == 1, n).otherwise(0))


def regime_table(per_kpi: DataFrame, kpis: list[str], metrics: list[str]) -> DataFrame:
    """One wide row per fine-tune point, in sweep order."""
    cells = [
        F.max(F.when(F.col("kpi") == k, F.col(m))).alias(f"{m}_{k}") for m in metrics for k in kpis
    ]
    wide = per_kpi.groupBy("finetune_weeks", "regime").agg(*cells)
    order = F.row_number().over(Window.orderBy(weeks_order("finetune_weeks")))
    return wide.withColumn("position", order)  # one row per swept point


def spatial_table(per_kpi: DataFrame, kpis: list[str], metrics: list[str]) -> DataFrame:
    """One wide row per number of training groups."""
    cells = [F.max(F.when(F.col("kpi") == k, F.col(m))).alias(f"{m}_{k}") for m in metrics for k in kpis]
    return per_kpi.groupBy("n_train_groups").agg(*cells).orderBy("n_train_groups")


def station_select(stations: DataFrame, events: DataFrame, n: int) -> DataFrame:
    """Stations with most events first, topped up from those without events.

    Counts come from a partial aggregate; the cut is one sorted limit.
    """
    counts = events.groupBy("station_id").agg(F.count("*").alias("n_events"))
    all_counts = stations.select("station_id").distinct().join(counts, "station_id", "left").withColumn(
        "n_events", F.coalesce("n_events", F.lit(0)).cast("long")
    )
    return all_counts.orderBy(F.col("n_events").desc(), "station_id").limit(n)


def selection_overlap(selected: DataFrame, reference: DataFrame) -> DataFrame:
    """Which stations of a reference list the selection kept or dropped."""
    a = selected.select("station_id").distinct()
    b = reference.select("station_id").distinct()
    return b.intersect(a).withColumn("overlap", F.lit("kept")).unionByName(
        b.exceptAll(a).withColumn("overlap", F.lit("dropped"))
    )


def run_sigma(run1: DataFrame, run2: DataFrame) -> DataFrame:
    """Mean and deviation of repeated judgements for rows present in both runs.

    A mean or deviation of exactly 0 is reported as missing.
    """
    a = run1.select("station_id", "arm", F.col("faithfulness").alias("f1"))
    b = run2.select("station_id", "arm", F.col("faithfulness").alias("f2"))
    mean = (F.col("f1") + F.col("f2")) / 2
    sigma = F.abs(F.col("f1") - F.col("f2")) / F.sqrt(F.lit(2.0))
    return a.join(b, ["station_id", "arm"]).select(
        "station_id",
        "arm",
        "f1",
        "f2",
        F.when(mean != 0, settle(mean, 4)).alias("mean_faithfulness"),
        F.when(sigma != 0, settle(sigma, 4)).alias("sigma_faithfulness"),
    )


def axis_rollup(axes: dict[str, DataFrame], costs: DataFrame) -> DataFrame:
    """Tables of several ablation axes below each other, each row with its axis cost totals."""
    out = None
    for name, df in axes.items():
        tagged = df.withColumn("axis", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out.join(costs, "axis", "left")  # one cost row per axis
