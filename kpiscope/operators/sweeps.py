"""Context sweep: forecasts from every trailing context of a history, scored against the truth, without copies of the history.

A forecast that averages its whole context needs one number per context: the sum of the trailing hours. Hours are added up by steps
of their age, the steps are added up from the end (suffix sums), and each border between steps is a context. Forecasts that look at a
fixed number of last hours are the same for every context that holds these hours; they are scored once and their scores
stand for each context. Panel, history, truth and scale are read in one pass: everything is a window or an aggregate of one
partitioning by series.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kpiscope.functions.exprs import SERIES, safe_ratio, series_window

HISTORY_MEAN = "historic_average"


def context_levels(inputs: DataFrame, step_h: int = 24) -> DataFrame:
    """(series, context_h, pred, n_hours): mean of the trailing hours for every context of whole steps that the series has."""
    last = F.max("t").over(Window.partitionBy(*SERIES))
    steps = (
        inputs.withColumn("_age", F.floor((last - F.col("t")) / step_h).cast("int"))
        .groupBy(*SERIES, "_age")
        .agg(F.sum("value").alias("_sum"), F.count("value").alias("_n"))
    )
    upto = Window.partitionBy(*SERIES).orderBy("_age").rowsBetween(Window.unboundedPreceding, 0)
    added = steps.withColumns({"_sum": F.sum("_sum").over(upto), "n_hours": F.sum("_n").over(upto)})
    context = ((F.col("_age") + 1) * step_h).cast("int")
    whole = F.col("n_hours") == context  # a step that the series only begins is no context
    return added.filter(whole).select(*SERIES, context.alias("context_h"), (F.col("_sum") / F.col("n_hours")).alias("pred"), "n_hours")


def _series(panel: DataFrame, split: int, step_h: int, season: int, contexts: Sequence[int] | None) -> DataFrame:
    """One row per series: contexts and the history mean of each, last season, mean of the last season, scale, truth."""
    past = F.col("t") < split
    ordered, whole = series_window(), Window.partitionBy(*SERIES)
    step = F.abs(F.col("value") - F.lag("value", season).over(ordered))
    trailing = Window.partitionBy(*SERIES).orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, 0)
    start = F.min("t").over(whole)
    marked = panel.withColumns({"_step": step, "_start": start}).withColumn("_suffix", F.sum(F.when(past, F.col("value"))).over(trailing))
    context = F.lit(split) - F.col("t")
    border = past & (context % step_h == 0)
    if contexts is not None:
        border = border & context.isin([int(c) for c in contexts])
    level = F.struct(F.lit(0).alias("model"), context.cast("int").alias("context_h"), (F.col("_suffix") / context).alias("pred"))
    recent = past & (F.col("t") >= split - season)
    return marked.groupBy(*SERIES).agg(
        F.collect_list(F.when(border, level)).alias("levels"),
        F.max(F.when(border, context)).cast("int").alias("longest"),
        F.avg(F.when(past, F.col("_step"))).alias("scale"),
        F.transform(F.array_sort(F.collect_list(F.when(recent, F.struct("t", "value")))), lambda x: x["value"]).alias("season"),
        F.avg(F.when(recent, F.col("value"))).alias("recent"),
        F.collect_list(F.when(~past, F.struct((F.col("t") - split).cast("int").alias("h"), F.col("value").alias("truth")))).alias("truth"),
    )


def sweep_scores(panel: DataFrame, split: int, step_h: int = 24, season: int = 24, contexts: Sequence[int] | None = None, models: Sequence[str] = (HISTORY_MEAN, "window_average", "seasonal_naive")) -> DataFrame:
    """Scores (model, context_h, series, smape, mae, rmse, mase, nrmse) of every context of whole steps before `split`.

    contexts picks some of them, None takes all that the history has. Hours from split on are the truth.
    """
    if step_h % season:
        raise ValueError("a context must hold whole seasons")
    fixed = {"window_average": F.col("recent"), "seasonal_naive": F.get("season", F.col("h") % season)}
    names = [HISTORY_MEAN, *fixed]  # models are numbers until the end, so that sums are kept in plain fields
    rows = _series(panel, split, step_h, season, contexts)
    hours = rows.select(*SERIES, "scale", "levels", "longest", "season", "recent", F.inline("truth"))
    once = [F.struct(F.lit(names.index(m)).alias("model"), F.lit(None).cast("int").alias("context_h"), fixed[m].alias("pred")) for m in models if m != HISTORY_MEAN]
    forecasts = F.concat(F.col("levels"), F.array(*once)) if HISTORY_MEAN in models and once else F.array(*once) if once else F.col("levels")
    fan = hours.select(*SERIES, "scale", "truth", "longest", F.inline(forecasts))
    error = F.col("pred") - F.col("truth")
    total = F.abs("pred") + F.abs("truth")
    scored = fan.groupBy(*SERIES, "model", "context_h").agg(
        F.avg(F.abs(error)).alias("mae"),
        F.avg(error * error).alias("mse"),
        F.coalesce(F.avg(F.when(total > 1e-8, 2 * F.abs(error) / total)) * 100, F.lit(0.0)).alias("smape"),
        (F.max("truth") - F.min("truth")).alias("_range"),
        F.max("scale").alias("scale"),
        F.max("longest").alias("_longest"),
    )
    every = F.sequence(F.lit(step_h), F.col("_longest"), F.lit(step_h))
    if contexts is not None:
        every = F.filter(F.array(*[F.lit(int(c)) for c in sorted(contexts) if c % step_h == 0]), lambda c: c <= F.col("_longest"))
    asked: Column = F.when(F.col("context_h").isNull(), every).otherwise(F.array("context_h"))
    return scored.withColumn("rmse", F.sqrt("mse")).select(
        F.get(F.array(*[F.lit(m) for m in names]), F.col("model")).alias("model"), F.explode(asked).alias("context_h"), *SERIES, "smape", "mae", "rmse",
        safe_ratio(F.col("mae"), F.col("scale"), 1e-8).alias("mase"), safe_ratio(F.col("rmse"), F.col("_range"), 1e-8).alias("nrmse"),
    )
