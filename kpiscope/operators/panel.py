"""Splits, slices, scaling, clamping and validation of long KPI panels.

A panel is (station_id, kpi, t, value); a forecast is (station_id, kpi, h, pred[, truth]).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kpiscope.functions.catalog import HORIZON_HOURS, TRAIN_END, VAL_END
from kpiscope.functions.exprs import SERIES, col, global_position, require, series_window, small_table


def select_stations(panel: DataFrame, wanted: DataFrame, prefix: str = "station_") -> DataFrame:
    """Keep the wanted stations; ids may come with or without their prefix."""
    bare = F.regexp_replace(F.col("station_id").cast("string"), f"^{prefix}", "")
    ids = wanted.select(bare.alias("wanted_id")).distinct()
    return panel.join(ids, bare == F.col("wanted_id"), "left_semi")


def split_holdout(panel: DataFrame, horizon: int = HORIZON_HOURS) -> DataFrame:
    """Mark the last hours of every station as target and the rest as input."""
    last = F.max("t").over(Window.partitionBy(*SERIES))
    return panel.withColumn("split", F.when(F.col("t") > last - horizon, "target").otherwise("input"))


def split_train_val_test(panel: DataFrame, train_end: int = TRAIN_END, val_end: int = VAL_END) -> DataFrame:
    t = F.col("t")
    return panel.withColumn(
        "split", F.when(t < train_end, "train").when(t < val_end, "val").otherwise("test")
    )


def context_slice(inputs: DataFrame, context_h: int, strict: bool = False) -> DataFrame:
    """Trailing context of each series; a short series is an error in strict mode, else taken whole."""
    w = Window.partitionBy(*SERIES)
    sized = inputs.withColumn("_last", F.max("t").over(w)).withColumn("_n", F.count("*").over(w))
    if strict:
        sized = require(sized, F.col("_n") >= context_h, f"series shorter than {context_h} h")
    return sized.filter(F.col("t") > F.col("_last") - context_h).drop("_last", "_n")


def context_horizon_grid(
    spark: SparkSession, total_days: int, horizons: Iterable[int], context_days: Iterable[int] | None = None
) -> DataFrame:
    """Feasible (horizon, context) pairs; explicitly asked contexts outside the range are an error."""
    asked = sorted(set(context_days)) if context_days is not None else None
    rows = small_table(spark, [(int(h),) for h in sorted(set(horizons))], "horizon_days int")
    rows = require(rows, F.col("horizon_days") < total_days, "horizon leaves no room for input")
    room = F.lit(total_days) - F.col("horizon_days")
    days = F.array(*[F.lit(d) for d in asked]) if asked is not None else F.sequence(F.lit(1), room)
    grid = rows.select("horizon_days", F.explode(days).alias("context_days"))
    if asked is not None:
        inside = (F.col("context_days") >= 1) & (F.col("context_days") <= F.lit(total_days) - F.col("horizon_days"))
        grid = require(grid, inside, "context days out of range")
    return grid.withColumn("context_h", F.col("context_days") * 24).withColumn("horizon_h", F.col("horizon_days") * 24)


def feasible_contexts(panel: DataFrame, horizons: Iterable[int], step_days: int = 1) -> DataFrame:
    """Per station, every (horizon, context) pair its own length allows."""
    wanted = F.array(*[F.lit(int(h)) for h in horizons])
    days = panel.groupBy("station_id").agg(F.floor((F.max("t") + 1) / 24).cast("int").alias("days"))
    fan = days.select("station_id", "days", F.explode(wanted).alias("horizon_days"))
    fan = fan.filter(F.col("horizon_days") < F.col("days"))
    steps = F.sequence(F.lit(1), F.col("days") - F.col("horizon_days"), F.lit(step_days))
    return fan.select("station_id", "horizon_days", F.explode(steps).alias("context_days"))


def window_count(length: str | Column, context_h: int, horizon_h: int, stride_h: int) -> Column:
    """Number of sliding context+horizon windows in a slice."""
    spare = col(length) - (context_h + horizon_h)
    return F.greatest(F.lit(0), F.floor(spare / stride_h) + 1).cast("int")


def finetune_slices(
    panel: DataFrame,
    weeks: int | str,
    end: int = VAL_END,
    context_h: int = 168,
    horizon_h: int = 168,
    stride_h: int = 24,
) -> DataFrame:
    """Trailing weeks that end where the test period starts, with their window counts per series."""
    if weeks != "full" and int(weeks) < 2:
        raise ValueError("fine-tune slices need at least 2 weeks")
    start = 0 if weeks == "full" else end - int(weeks) * 168
    if start < 0:
        raise ValueError("more weeks than history")
    cut = panel.filter((F.col("t") >= start) & (F.col("t") < end))
    return (
        cut.groupBy("station_id")
        .agg(F.countDistinct("t").alias("hours"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))
        .withColumn("n_windows", window_count("hours", context_h, horizon_h, stride_h))
    )


def seeded_order(key: str | Column, seed: int) -> Column:
    """Reproducible shuffle key, the same on every engine that knows md5."""
    return F.md5(F.concat_ws(":", col(key).cast("string"), F.lit(str(seed))))


def slice_train_val(slices: DataFrame, val_fraction: float = 0.15, seed: int = 42) -> DataFrame:
    """Shuffle slices by a seeded hash; the last ceil(fraction * n) become validation.

    The first two hex digits of the hash are the buckets of the global rank.
    """
    hashed = slices.withColumn("_hash", seeded_order("station_id", seed))
    ranked = global_position(hashed, F.substring("_hash", 1, 2), ["_hash", "station_id"], "_pos")
    n_val = F.ceil(F.lit(val_fraction) * F.col("total"))
    ranked = require(ranked, (n_val >= 1) & (F.col("total") - n_val >= 1), "too few slices to split")
    part = F.when(F.col("_pos") > F.col("total") - n_val, "val").otherwise("train")
    return ranked.withColumn("part", part).drop("_hash", "_pos", "total")


def regime_label(weeks: str | Column) -> Column:
    """Fine-tune regime from the swept number of weeks (0, N or "full")."""
    w = col(weeks).cast("string")
    n = w.try_cast("int")
    return F.when(w == "full", "full").when(n == 0, "zero").when(n > 0, "few").otherwise(
        F.raise_error(F.lit("weeks must be >= 0 or 'full'"))
    )


def site_group(station_id: str | Column, prefix: str = "station_") -> Column:
    """Leading token of a station id once its prefix is gone."""
    bare = F.regexp_replace(col(station_id).cast("string"), f"^{prefix}", "")
    return F.split_part(bare, F.lit("_"), F.lit(1))


def cumulative_group_split(stations: DataFrame, train_groups: Iterable[int], seed: int = 42) -> DataFrame:
    """Nested, disjoint, covering splits by site group.

    stations is (station_id, site_group). Groups get one seeded rank; with G training groups the
    first G ranks train and the rest test. Asking for every group leaves nothing to test: an error.
    """
    wanted = sorted(set(int(g) for g in train_groups))
    if any(g < 0 for g in wanted):
        raise ValueError("number of training groups must be >= 0")
    groups = stations.select("site_group").distinct().withColumn("_key", seeded_order("site_group", seed))
    ranked = global_position(groups, F.substring("_key", 1, 2), ["_key", "site_group"], "group_rank")
    ranked = require(ranked, F.col("total") > max(wanted), "no groups left to test")
    fan = stations.join(ranked, "site_group").select(
        "station_id", "site_group", "group_rank", F.explode(F.array(*[F.lit(g) for g in wanted])).alias("n_train_groups")
    )
    return fan.withColumn("part", F.when(F.col("group_rank") <= F.col("n_train_groups"), "train").otherwise("test"))


def leaked_stations(split: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Stations that occur on both sides of a split; an empty result means no leak."""
    return (
        split.groupBy(*keys, "station_id")
        .agg(F.max((F.col("part") == "train").cast("int")).alias("a"), F.max((F.col("part") == "test").cast("int")).alias("b"))
        .filter((F.col("a") == 1) & (F.col("b") == 1))
        .select(*keys, "station_id")
    )


def assert_no_leak(split: DataFrame) -> None:
    if not leaked_stations(split).isEmpty():
        raise ValueError("train and test stations overlap")


def revin(panel: DataFrame, min_std: float = 1e-5) -> DataFrame:
    """Standardise every series by its own mean and deviation; flat series keep scale 1."""
    w = Window.partitionBy(*SERIES)
    std = F.stddev_pop("value").over(w)
    return (
        panel.withColumn("mean", F.avg("value").over(w))
        .withColumn("std", F.when(std < min_std, F.lit(1.0)).otherwise(std))
        .withColumn("normalized", (F.col("value") - F.col("mean")) / F.col("std"))
    )


def revert_revin(scaled: DataFrame, value: str = "normalized") -> DataFrame:
    return scaled.withColumn("restored", F.col(value) * F.col("std") + F.col("mean"))


def series_scales(panel: DataFrame) -> DataFrame:
    """Location and scale per series for each supported scaler."""
    return panel.groupBy(*SERIES).agg(
        F.min("value").alias("lo"),
        F.max("value").alias("hi"),
        F.median("value").alias("center"),
        (F.percentile("value", F.lit(0.75)) - F.percentile("value", F.lit(0.25))).alias("spread"),
    )


def scaler_inverse(result: str | Column, scaler: str) -> Column:
    """Undo a scaler, given the columns of series_scales beside the scaled result."""
    r = col(result)
    if scaler == "custom_robust":
        return r * F.col("spread") + F.col("center")
    if scaler == "min_max":
        return r * (F.col("hi") - F.col("lo")) + F.col("lo")
    if scaler == "identity":
        return r
    raise ValueError(f"unknown scaler: {scaler}")


def physical_clamp(df: DataFrame, dim: DataFrame, value: str = "pred", round_integers: bool = False) -> DataFrame:
    """Clip to [0, cap] of the KPI and optionally round integer KPIs half to even.

    dim is the KPI contract, one row per KPI. An unknown KPI is an error. NULL and NaN stay what they are, so a broken
    forecast is not repaired unnoticed; infinities are clipped.
    """
    small = dim.select("kpi", F.col("cap").alias("_cap"), F.col("is_integer").alias("_int"))
    joined = require(df.join(small, "kpi", "left"), F.col("_cap").isNotNull(), "unknown KPI")
    v = F.col(value)
    clipped = F.when(v.isNull() | F.isnan(v), v).when(v < 0, F.lit(0.0)).when(v > F.col("_cap"), F.col("_cap")).otherwise(v)
    if round_integers:
        clipped = F.when(F.col("_int"), F.bround(clipped, 0)).otherwise(clipped)
    return joined.withColumn(value, clipped).drop("_cap", "_int")


def usable_factors(factors: DataFrame, dim: DataFrame, low: float = 0.85, high: float = 1.15) -> DataFrame:
    """Keep finite factors of known KPIs, clipped to the allowed band, that actually change anything."""
    f = F.col("factor").try_cast("double")
    finite = f.isNotNull() & ~F.isnan(f) & (F.abs(f) < float("inf"))
    return (
        factors.join(dim.select("kpi"), "kpi", "left_semi")
        .filter(finite)
        .withColumn("factor", F.least(F.greatest(f, F.lit(low)), F.lit(high)))
        .filter(F.abs(F.col("factor") - 1) >= 1e-6)
    )


def gate_factors(factors: DataFrame, min_strong: int = 3, declared: bool = False) -> DataFrame:
    """Drop a station's factors unless enough of them carry a strong signal.

    Strong means a deviation of 5 % or, when the writer declared it, high confidence with a
    direction (columns confidence and direction).
    """
    if declared:
        strong = (F.col("confidence") == "high") & F.col("direction").isin("UP", "DOWN")
    else:
        strong = F.abs(F.col("factor") - 1) >= 0.05
    votes = F.sum(F.when(strong, 1).otherwise(0)).over(Window.partitionBy("station_id"))
    return factors.withColumn("strong_signals", votes).filter(F.col("strong_signals") >= min_strong)


def apply_factors(forecast: DataFrame, factors: DataFrame) -> DataFrame:
    """Multiply forecasts by their station and KPI factor, 1 where there is none."""
    few = factors.select("station_id", "kpi", "factor")
    return forecast.join(few, ["station_id", "kpi"], "left").withColumn(
        "pred", F.col("pred") * F.coalesce("factor", F.lit(1.0))
    ).drop("factor")


def edge_pad(panel: DataFrame, length: int) -> DataFrame:
    """Exactly `length` trailing points per series, positions 0..length-1, first value repeated in front."""
    w = Window.partitionBy(*SERIES)
    placed = panel.withColumn("pos", F.col("t") - F.max("t").over(w) + (length - 1)).filter("pos >= 0")
    first = F.min("pos").over(w)
    at = F.when(
        (F.col("pos") == first) & (F.col("pos") > 0), F.sequence(F.lit(0), F.col("pos"))
    ).otherwise(F.array("pos"))
    return placed.withColumn("_at", at).select(*SERIES, F.explode("_at").alias("pos"), "value")


def extend_forecast(forecast: DataFrame, horizon: int) -> DataFrame:
    """Cut a long forecast at the horizon; repeat the last value of a short one."""
    w = Window.partitionBy(*SERIES)
    cut = forecast.filter(F.col("h") < horizon).withColumn("_last", F.max("h").over(w))
    at = F.when(F.col("h") == F.col("_last"), F.sequence(F.col("h"), F.lit(horizon - 1))).otherwise(F.array("h"))
    return cut.withColumn("_at", at).select(*SERIES, F.explode("_at").alias("h"), "pred")


def calendar_features(ts: str | Column) -> list[Column]:
    """year, month, day, dow (Monday = 1), doy, hour, minute."""
    c = col(ts)
    return [
        F.year(c).alias("year"),
        F.month(c).alias("month"),
        F.dayofmonth(c).alias("day"),
        (F.weekday(c) + 1).alias("dow"),
        F.dayofyear(c).alias("doy"),
        F.hour(c).alias("hour"),
        F.minute(c).alias("minute"),
    ]


def panel_violations(panel: DataFrame, dim: DataFrame, hours: int) -> DataFrame:
    """Counts of everything that makes a station unusable, one row per station."""
    v = F.col("value")
    bad = v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    known = panel.join(dim.select("kpi", F.lit(True).alias("_known")), "kpi", "left")
    per_series = known.groupBy("station_id", "kpi").agg(
        F.sum(bad.cast("int")).alias("bad"),
        F.count("*").alias("rows"),
        F.countDistinct("t").alias("distinct_hours"),
        F.max(F.col("_known").isNull().cast("int")).alias("unknown"),
    )
    return per_series.groupBy("station_id").agg(
        F.sum("bad").alias("non_finite"),
        F.sum((F.col("distinct_hours") != hours).cast("int")).alias("wrong_length"),
        F.sum(F.col("rows") - F.col("distinct_hours")).alias("duplicate_hours"),
        F.sum("unknown").alias("unknown_kpis"),
    )


def assert_valid_panel(panel: DataFrame, dim: DataFrame, hours: int) -> None:
    """Raise on the driver when any station breaks the contract; only one row of counts is fetched."""
    names = ["non_finite", "wrong_length", "duplicate_hours", "unknown_kpis"]
    counts = panel_violations(panel, dim, hours).agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names]).first()
    broken = {n: counts[n] for n in names if counts[n]}
    if broken:
        raise ValueError(f"invalid panel: {broken}")


def flat_forecasts(forecast: DataFrame, threshold: float = 1e-3) -> DataFrame:
    """Series whose forecast hardly varies over the horizon."""
    return (
        forecast.groupBy(*SERIES)
        .agg(F.stddev_pop("pred").alias("std"))
        .filter(F.col("std") < threshold)
    )


def step_diff(inputs: DataFrame, forecast: DataFrame) -> DataFrame:
    """Hour-to-hour change of a forecast; the first hour is measured from the last input value."""
    tail = inputs.groupBy(*SERIES).agg(F.max_by("value", "t").alias("pred")).withColumn("h", F.lit(-1))
    both = forecast.select(*SERIES, "h", "pred").unionByName(tail)
    return both.withColumn("diff", F.col("pred") - F.lag("pred").over(series_window("h"))).filter("h >= 0")


