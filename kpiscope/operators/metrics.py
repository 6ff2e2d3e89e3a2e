"""Accuracy metrics of forecasts and their aggregation over stations, contexts and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kpiscope.functions.exprs import SERIES, safe_ratio, settle

METRICS = ("smape", "mase", "nrmse", "mae", "rmse")


def abs_error() -> Column:
    return F.abs(F.col("pred") - F.col("truth"))


def smape() -> Column:
    """Symmetric percentage error; hours where both sides are zero are left out."""
    total = F.abs("pred") + F.abs("truth")
    return F.coalesce(F.avg(F.when(total > 1e-8, 2 * abs_error() / total)) * 100, F.lit(0.0))


def rmse() -> Column:
    return F.sqrt(F.avg(F.pow(F.col("pred") - F.col("truth"), 2)))


def nrmse() -> Column:
    return safe_ratio(rmse(), F.max("truth") - F.min("truth"), 1e-8)


def season_scale(panel: DataFrame, season: int = 24, value: str = "value", order: str = "t", keys: tuple[str, ...] = SERIES) -> DataFrame:
    """Mean absolute seasonal step per series; short series use single steps, single points 1."""
    w = Window.partitionBy(*keys).orderBy(order)
    n = F.count("*").over(Window.partitionBy(*keys))
    step = F.when(n > season, F.lag(value, season).over(w)).otherwise(F.lag(value, 1).over(w))
    diffs = panel.select(*keys, F.abs(F.col(value) - step).alias("_d"))
    return diffs.groupBy(*keys).agg(F.coalesce(F.avg("_d"), F.lit(1.0)).alias("scale"))


def score(scored: DataFrame, scale: DataFrame, keys: tuple[str, ...] = SERIES) -> DataFrame:
    """All per-series metrics in one aggregation.

    scored is (keys, h, pred, truth); scale comes from the window that defines the MASE denominator.
    """
    errors = scored.groupBy(*keys).agg(
        smape().alias("smape"),
        F.avg(abs_error()).alias("mae"),
        rmse().alias("rmse"),
        F.avg(F.pow(F.col("pred") - F.col("truth"), 2)).alias("mse"),
        nrmse().alias("nrmse"),
        F.count("*").alias("n_hours"),
    )
    shared = [k for k in keys if k in scale.columns]
    return errors.join(scale, shared).withColumn("mase", safe_ratio(F.col("mae"), F.col("scale"), 1e-8))


def score_truth_scale(scored: DataFrame) -> DataFrame:
    """Variant whose MASE denominator comes from the truth window."""
    return score(scored, season_scale(scored, value="truth", order="h"))


def score_eps(scored: DataFrame, eps: float = 1e-8) -> DataFrame:
    """Variant that adds a small constant to denominators instead of masking."""
    scale = season_scale(scored, value="truth", order="h").withColumn("scale", F.col("scale") + eps)
    errors = scored.groupBy(*SERIES).agg(
        F.avg(abs_error()).alias("mae"),
        rmse().alias("rmse"),
        F.avg(200 * abs_error() / (F.abs("pred") + F.abs("truth") + eps)).alias("smape"),
    )
    return errors.join(scale, list(SERIES)).withColumn("mase", F.col("mae") / F.col("scale"))


def error_rollup(scored: DataFrame) -> DataFrame:
    """MAE, RMSE, MSE per (station, kpi) and over all cells of a station (kpi NULL)."""
    return scored.groupingSets([["station_id", "kpi"], ["station_id"]], "station_id", "kpi").agg(
        F.avg(abs_error()).alias("mae"), rmse().alias("rmse"), F.avg(F.pow(F.col("pred") - F.col("truth"), 2)).alias("mse")
    )


def rounded(metrics: DataFrame) -> DataFrame:
    """Station metrics as they are stored: sMAPE to 2 digits, the others to 4."""
    out = metrics
    for name in METRICS:
        if name in metrics.columns:
            out = out.withColumn(name, settle(name, 2 if name == "smape" else 4))
    return out


def batch_aggregate(station_metrics: DataFrame, keys: tuple[str, ...] = ("kpi",)) -> DataFrame:
    """Mean over stations of the stored (rounded) station metrics."""
    return (
        rounded(station_metrics)
        .groupBy(*keys)
        .agg(
            settle(F.avg("smape"), 2).alias("avg_smape"),
            settle(F.avg("mase"), 4).alias("avg_mase"),
            settle(F.avg("nrmse"), 4).alias("avg_nrmse"),
            F.count("*").alias("n_stations"),
        )
    )


def batch_status(results: DataFrame) -> DataFrame:
    """Counts of finished and failed stations and the mean time of the finished ones."""
    ok = F.col("status") == "success"
    return results.agg(
        F.count("*").alias("total"),
        F.sum(ok.cast("int")).alias("successful"),
        F.sum((F.col("status") == "error").cast("int")).alias("failed"),
        F.avg(F.when(ok, F.col("elapsed_sec"))).alias("avg_sec"),
    )


def sweep_summary(station_metrics: DataFrame) -> DataFrame:
    """(context, kpi) means with the spread over stations."""
    return station_metrics.groupBy("context_h", "kpi").agg(
        F.avg("smape").alias("avg_smape"),
        F.avg("mase").alias("avg_mase"),
        F.avg("nrmse").alias("avg_nrmse"),
        F.stddev_samp("mase").alias("std_mase"),
        F.count_distinct("station_id").alias("n_stations"),
    )


def best_context(summary: DataFrame, metric: str, higher: bool = False) -> DataFrame:
    """Best context per KPI and for the mean over KPIs (kpi = ALL); the shorter context wins ties."""
    overall = summary.groupBy("context_h").agg(F.avg(metric).alias(metric)).withColumn("kpi", F.lit("ALL"))
    both = summary.select("context_h", "kpi", metric).unionByName(overall.select("context_h", "kpi", metric))
    rank = F.struct(-F.col(metric) if higher else F.col(metric), F.col("context_h"))
    return both.groupBy("kpi").agg(
        F.min_by("context_h", rank).alias("best_context_h"), F.min_by(metric, rank).alias("best_value")
    )


def nmae_nrmse_mean(station_metrics: DataFrame, scored: DataFrame) -> DataFrame:
    """MAE and RMSE over stations relative to the mean level of the truth."""
    level = (
        scored.groupBy(*SERIES)
        .agg(F.avg(F.abs("truth")).alias("_m"))
        .groupBy("kpi")
        .agg(F.avg("_m").alias("truth_mean"))
    )
    keys = [k for k in ("context_h", "kpi") if k in station_metrics.columns]
    mean = station_metrics.groupBy(*keys).agg(F.avg("mae").alias("avg_mae"), F.avg("rmse").alias("avg_rmse"))
    return (
        mean.join(level, "kpi")  # one row per KPI
        .withColumn("nmae", F.col("avg_mae") / F.col("truth_mean"))
        .withColumn("nrmse", F.col("avg_rmse") / F.col("truth_mean"))
    )


def sem(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, count and standard error; NULL and NaN are dropped, a single value has error 0."""
    v = F.col(value)
    clean = df.filter(v.isNotNull() & ~F.isnan(v))
    n = F.count("*")
    return clean.groupBy(*keys).agg(
        F.avg(v).alias("mean"), n.alias("n"), F.when(n > 1, F.stddev_samp(v) / F.sqrt(n)).otherwise(0.0).alias("sem")
    )


def compare_runs(runs: DataFrame, first: str, second: str, key: str = "kpi", value: str = "value") -> DataFrame:
    """Two runs side by side with relative change, improvement mark and the mean change."""
    side = runs.groupBy(key).agg(
        F.max(F.when(F.col("run") == first, F.col(value))).alias("first"),
        F.max(F.when(F.col("run") == second, F.col(value))).alias("second"),
    )
    delta = F.when(F.col("first") > 0, (F.col("second") - F.col("first")) / F.col("first") * 100)
    side = side.withColumn("delta_pct", delta).withColumn("improved", F.coalesce(F.col("delta_pct") < -1, F.lit(False)))
    everything = Window.partitionBy(F.lit(0))  # one row per KPI
    return side.withColumn("mean_delta_pct", F.avg("delta_pct").over(everything))


def drift_check(new: DataFrame, old: DataFrame, metric: str, tol: float, keys: tuple[str, ...] = ("kpi",)) -> DataFrame:
    """Per-key drift of one metric between two runs, with the verdict of the station."""
    both = new.select(*keys, F.col(metric).alias("new")).join(old.select(*keys, F.col(metric).alias("old")), list(keys))
    group = [k for k in keys if k != "kpi"]
    both = both.withColumn("delta", F.abs(F.col("new") - F.col("old")))
    w = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    worst = F.max("delta").over(w)
    missing = F.max(F.col("delta").isNull().cast("int")).over(w) == 1
    return both.withColumn("max_delta", worst).withColumn(
        "verdict", F.when(missing | (worst > tol), "FAIL").otherwise("PASS")
    )


def ab_aggregate(rows: DataFrame) -> DataFrame:
    """mode x kpi means and the mode totals (kpi NULL); incomplete rows are dropped."""
    clean = rows.filter(
        F.col("smape").isNotNull() & ~F.isnan("smape") & F.col("mase").isNotNull() & ~F.isnan("mase")
    )
    return clean.groupingSets([["mode", "kpi"], ["mode"]], "mode", "kpi").agg(
        F.avg("smape").alias("avg_smape"), F.avg("mase").alias("avg_mase"), F.count_distinct("station_id").alias("n_stations")
    )


def predictor_compare(metrics: DataFrame) -> DataFrame:
    """forecaster x metric spread over stations of the per-station means over KPIs."""
    per = rounded(metrics).groupBy("forecaster", "station_id").agg(
        settle(F.avg("nrmse"), 6).alias("mean_nrmse"), settle(F.avg("mase"), 6).alias("mean_mase")
    )
    long = per.unpivot(["forecaster", "station_id"], ["mean_nrmse", "mean_mase"], "metric", "value")
    return long.groupBy("forecaster", "metric").agg(
        F.count("*").alias("n"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("stdev"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
