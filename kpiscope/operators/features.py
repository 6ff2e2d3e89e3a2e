"""Window features of long series: differences, moving averages, islands, supervised windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kpiscope.functions.catalog import SEASON_HOURS
from kpiscope.functions.exprs import SERIES, col, series_window


def seasonal_diff(panel: DataFrame, season: int = SEASON_HOURS) -> DataFrame:
    """x[t] - x[t - season]; series no longer than a season fall back to one step."""
    w = series_window()
    n = F.count("*").over(Window.partitionBy(*SERIES))
    long_enough = n > season
    step = F.when(long_enough, F.lag("value", season).over(w)).otherwise(F.lag("value", 1).over(w))
    return panel.withColumn("diff", F.col("value") - step).filter(F.col("diff").isNotNull())


def moving_average(df: DataFrame, width: int, value: str = "value", order: str = "t", keys: tuple[str, ...] = SERIES) -> DataFrame:
    """Mean of `width` consecutive rows, placed at the last of them; partial frames are dropped."""
    frame = series_window(order, keys).rowsBetween(-(width - 1), 0)
    return (
        df.withColumn("_n", F.count(value).over(frame))
        .withColumn("moving_avg", F.avg(value).over(frame))
        .filter(F.col("_n") == width)
        .drop("_n")
    )


def rolling_mean_slope(df: DataFrame, width: int = 12, value: str = "pred", order: str = "h", keys: tuple[str, ...] = SERIES) -> DataFrame:
    """Change of the moving mean. Row i describes the step from frame i to frame i + 1."""
    smooth = moving_average(df, width, value, order, keys)
    slope = F.col("moving_avg") - F.lag("moving_avg").over(series_window(order, keys))
    return (
        smooth.withColumn("slope", slope)
        .filter(F.col("slope").isNotNull())
        .withColumn("i", F.col(order) - width)
    )


def deseasonalize(panel: DataFrame, season: int = SEASON_HOURS) -> DataFrame:
    """Moving average over one season, indexed from 0."""
    smooth = moving_average(panel, season)
    return smooth.withColumn("i", F.row_number().over(series_window()) - 1)


def islands(
    flags: DataFrame,
    mask: str | Column,
    keys: tuple[str, ...],
    order: str,
    min_duration: int = 1,
    extra: tuple[Column, ...] = (),
) -> DataFrame:
    """Runs of consecutive flagged hours as (keys, t_start, t_end), both ends included.

    Only flagged rows enter the window, so the shuffle carries the islands and nothing else.
    `extra` holds further aggregates to take over each run.
    """
    on = flags.filter(col(mask)).withColumn("_t", F.col(order))
    run = F.col("_t") - F.row_number().over(Window.partitionBy(*keys).orderBy("_t"))
    return (
        on.withColumn("_run", run)
        .groupBy(*keys, "_run")
        .agg(F.min("_t").alias("t_start"), F.max("_t").alias("t_end"), F.count("*").alias("duration"), *extra)
        .filter(F.col("duration") >= min_duration)
        .drop("_run")
    )


def supervised_windows(panel: DataFrame, context_h: int, horizon_h: int, stride_h: int, last: bool = False) -> DataFrame:
    """Sliding (x, y) pairs per series; series too short for one window give none.

    With last also the last context of each series, if none of its hours is missing: there y is null.

    Each series becomes one array (bounded by its length in hours) and windows are slices of it,
    so the only shuffle is the one that gathers a series.
    """
    series = panel.groupBy(*SERIES).agg(F.array_sort(F.collect_list(F.struct("t", "value"))).alias("_s"))
    last_start = F.size("s") - (context_h + horizon_h)
    starts = F.when(last_start >= 0, F.sequence(F.lit(0), last_start, F.lit(stride_h))).otherwise(F.array().cast("array<int>"))
    y = F.slice("s", F.col("start") + 1 + context_h, F.lit(horizon_h))
    if last:
        edge = F.size("s") - context_h
        whole = (edge >= 0) & (F.element_at("_s", -1)["t"] - F.get("_s", edge)["t"] == context_h - 1)
        starts = F.concat(starts, F.when(whole, F.array(edge)).otherwise(F.array().cast("array<int>")))
        y = F.when(F.col("start") <= last_start, y)
    placed = series.withColumn("s", F.transform("_s", lambda s: s["value"])).withColumn("start", F.explode(starts))
    return placed.select(*SERIES, "start", F.slice("s", F.col("start") + 1, F.lit(context_h)).alias("x"), y.alias("y"))


def array_mean(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v) / F.size(a)


def lag_features(windows: DataFrame, x: str = "x") -> DataFrame:
    """Window context with its mean, deviation and last value appended."""
    mean = array_mean(F.col(x))
    with_mean = windows.withColumn("x_mean", mean)
    spread = F.aggregate(
        x, F.lit(0.0), lambda acc, v: acc + (v - F.col("x_mean")) * (v - F.col("x_mean"))
    )
    return with_mean.withColumn("x_std", F.sqrt(spread / F.size(x))).withColumn("x_last", F.element_at(x, -1))


def mda_steps(forecast: DataFrame) -> DataFrame:
    """Share of steps whose forecast moves in the same direction as the truth."""
    w = series_window("h")
    moves = forecast.select(
        *SERIES,
        F.signum(F.col("pred") - F.lag("pred").over(w)).alias("a"),
        F.signum(F.col("truth") - F.lag("truth").over(w)).alias("b"),
    ).filter(F.col("a").isNotNull())
    return moves.groupBy(*SERIES).agg(F.avg((F.col("a") == F.col("b")).cast("double")).alias("mda"))
