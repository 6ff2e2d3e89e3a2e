"""Statistical profiles of input series and summaries of forecasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kpiscope.functions import labels
from kpiscope.functions.exprs import SERIES, earliest_argmax, earliest_argmin, labelled, settle


def _aged(df: DataFrame) -> DataFrame:
    """Add hours since the series start (`at`), hours to its end (`age`) and its length (`n`)."""
    w = Window.partitionBy(*SERIES)
    return (
        df.withColumn("n", F.count("*").over(w))
        .withColumn("at", F.col("t") - F.min("t").over(w))
        .withColumn("age", F.max("t").over(w) - F.col("t"))
    )


def _mean_if(cond: Column, value: str = "value") -> Column:
    return F.avg(F.when(cond, F.col(value)))


def input_stats(inputs: DataFrame) -> DataFrame:
    """Mean, deviation, range, trend and the value band a forecast is expected to stay in."""
    week = F.col("n") >= 168
    late = F.when(week, F.col("age") < 168).otherwise(F.col("at") >= F.floor(F.col("n") / 2))
    early = F.when(week, F.col("at") < 168).otherwise(F.col("at") < F.floor(F.col("n") / 2))
    s = (
        _aged(inputs)
        .groupBy(*SERIES)
        .agg(
            F.avg("value").alias("mean"),
            F.stddev_pop("value").alias("std"),
            F.min("value").alias("min"),
            F.max("value").alias("max"),
            (_mean_if(late) - _mean_if(early)).alias("trend"),
        )
    )
    low = F.col("mean") - 3 * F.col("std") + F.least(F.lit(0.0), F.col("trend") * 2)
    high = F.col("mean") + 3 * F.col("std") + F.greatest(F.lit(0.0), F.col("trend") * 2)
    return (
        s.withColumn("pred_min", F.greatest(F.lit(0.0), low))
        .withColumn("pred_max", high)
        .withColumn("pred_mean_expected", F.col("mean") + F.col("trend"))
    )


def kpi_summary(inputs: DataFrame) -> DataFrame:
    """Amplitude and half-against-half trend."""
    half = F.floor(F.col("n") / 2)
    s = (
        _aged(inputs)
        .groupBy(*SERIES)
        .agg(
            (F.max("value") - F.min("value")).alias("amplitude"),
            _mean_if(F.col("at") < half).alias("first_half"),
            _mean_if(F.col("at") >= half).alias("second_half"),
        )
    )
    pct = (F.col("second_half") - F.col("first_half")) / (F.col("first_half") + 1e-8) * 100
    trend = labelled(F.col("trend_pct"), [(F.col("trend_pct") > 5, "UP"), (F.col("trend_pct") < -5, "DOWN")], "STABLE")
    return s.withColumn("trend_pct", pct).withColumn("trend", trend)


def daily_means(df: DataFrame, value: str = "value", order: str = "t", max_days: int | None = None) -> DataFrame:
    """Mean of every complete day, counted from hour 0 of the frame; max_days cuts to a horizon."""
    days = (
        df.groupBy(*SERIES, F.floor(F.col(order) / 24).cast("int").alias("day"))
        .agg(F.avg(value).alias("day_mean"), F.count("*").alias("_n"))
        .filter("_n = 24")
        .drop("_n")
    )
    return days if max_days is None else days.filter(F.col("day") < max_days)


def diurnal_profile(inputs: DataFrame) -> DataFrame:
    """Average day of each series with its peak and trough hour (earliest on ties; means that agree to 6 digits tie)."""
    hours = inputs.groupBy(*SERIES, (F.col("t") % 24).alias("hour")).agg(F.avg("value").alias("hour_mean"))
    w, mean = Window.partitionBy(*SERIES), settle("hour_mean", 6)
    return hours.withColumn("peak_hour", earliest_argmax("hour", mean).over(w)).withColumn(
        "trough_hour", earliest_argmin("hour", mean).over(w)
    )


def hour_of_week_baseline(inputs: DataFrame, week: int = 168) -> DataFrame:
    """Median per hour of week over the full weeks of each series."""
    aged = _aged(inputs)
    full = aged.filter(F.col("at") < F.floor(F.col("n") / week) * week)
    return full.groupBy(*SERIES, (F.col("at") % week).alias("h")).agg(F.median("value").alias("baseline"))


def cv_uncertainty(inputs: DataFrame, hours: int = 336) -> DataFrame:
    """Recent coefficient of variation as an uncertainty class."""
    s = (
        _aged(inputs)
        .filter(F.col("age") < hours)
        .groupBy(*SERIES)
        .agg((F.stddev_pop("value") / (F.avg(F.abs("value")) + 1e-8)).alias("cv"))
    )
    cls = labelled(F.col("cv"), [(F.col("cv") > 0.3, "HIGH"), (F.col("cv") > 0.1, "moderate")], "LOW")
    return s.withColumn("uncertainty", cls)


def drift_ratio(inputs: DataFrame, forecast: DataFrame, hours: int = 168) -> DataFrame:
    """Forecast mean over the mean of the last input week."""
    recent = _aged(inputs).filter(F.col("age") < hours).groupBy(*SERIES).agg(F.avg("value").alias("recent_mean"))
    ahead = forecast.groupBy(*SERIES).agg(F.avg("pred").alias("forecast_mean"))
    r = F.col("ratio")
    steps = [(r < 0.85, "much lower"), (r < 0.95, "lower"), (r <= 1.05, "consistent"), (r <= 1.15, "higher")]
    return (
        recent.join(ahead, list(SERIES))
        .withColumn("ratio", F.col("forecast_mean") / F.greatest(F.col("recent_mean"), F.lit(1e-6)))
        .withColumn("label", labelled(r, steps, "much higher"))
    )


def history_summary(inputs: DataFrame, hours: int = 168) -> DataFrame:
    """Mean and deviation of the last week and of its outer days."""
    return (
        _aged(inputs)
        .filter(F.col("age") < hours)
        .groupBy(*SERIES)
        .agg(
            F.avg("value").alias("mean"),
            F.stddev_pop("value").alias("std"),
            _mean_if(F.col("age") >= hours - 24).alias("first24h_mean"),
            _mean_if(F.col("age") < 24).alias("last24h_mean"),
        )
    )


def forecast_summary(forecast: DataFrame, baseline: DataFrame) -> DataFrame:
    """Range, slope of the daily means, baseline mean and change per series.

    baseline holds the last observed week. A baseline mean of zero counts as no baseline.
    """
    f = forecast.groupBy(*SERIES).agg(
        F.min("pred").alias("forecast_min"), F.avg("pred").alias("forecast_mean"), F.max("pred").alias("forecast_max")
    )
    days = daily_means(forecast, "pred", "h")
    slope = days.groupBy(*SERIES).agg(F.regr_slope("day_mean", F.col("day").cast("double")).alias("slope"))
    base = baseline.groupBy(*SERIES).agg(F.avg("value").alias("baseline_mean"))
    b, s = F.col("baseline_mean"), F.col("slope")
    change = F.when(F.abs(b) > 1e-8, (F.col("forecast_mean") - b) / F.abs(b) * 100).otherwise(0.0)
    return (
        f.join(slope, list(SERIES), "left")
        .join(base, list(SERIES), "left")
        .withColumn("slope", F.coalesce("slope", F.lit(0.0)))
        .withColumn("increase_pct", F.coalesce(change, F.lit(0.0)))
        .withColumn("trend", labelled(s, [(s > 0.01, "UP"), (s < -0.01, "DOWN")], "STABLE"))
    )


def largest_change(summary: DataFrame, dim: DataFrame) -> DataFrame:
    """KPI with the largest and smallest absolute change per station; catalogue order breaks ties."""
    s = (
        summary.filter(F.abs("baseline_mean") > 1e-8)
        .withColumn("pct", settle("increase_pct", 2))
        .join(dim.select("kpi", "ord"), "kpi")
    )
    row = F.struct("kpi", "pct")
    return s.groupBy("station_id").agg(
        F.max_by(row, F.struct(F.abs("pct"), -F.col("ord"))).alias("hi"),
        F.min_by(row, F.struct(F.abs("pct"), F.col("ord"))).alias("lo"),
    ).select(
        "station_id",
        F.col("hi.kpi").alias("largest_kpi"),
        F.col("hi.pct").alias("largest_pct"),
        F.col("lo.kpi").alias("smallest_kpi"),
        F.col("lo.pct").alias("smallest_pct"),
    )


def day_over_day(days: DataFrame, notable_pct: float = 10.0) -> DataFrame:
    """Change of the rounded daily means; a day is notable from 10 % on."""
    w = Window.partitionBy(*SERIES).orderBy("day")
    prev = F.lag("mean").over(w)
    pct = F.when(F.abs(prev) > 1e-8, (F.col("mean") - prev) / F.abs(prev) * 100)
    return (
        days.withColumn("_pct", pct)
        .withColumn("dod_pct", settle("_pct", 2))
        .withColumn("notable", F.coalesce(F.abs("_pct") >= notable_pct, F.lit(False)))
        .drop("_pct")
    )


def daily_summary(forecast: DataFrame, baseline: DataFrame | None = None, start_weekday: int = 0) -> DataFrame:
    """One row per forecast day: statistics, peak and trough, weekday, change to the day before
    and to the same day of the baseline week."""
    days = (
        forecast.withColumn("hour", F.col("h") % 24)
        .groupBy(*SERIES, F.floor(F.col("h") / 24).cast("int").alias("d"))
        .agg(
            settle(F.avg("pred"), 2).alias("mean"),
            settle(F.min("pred"), 2).alias("min"),
            settle(F.max("pred"), 2).alias("max"),
            settle(F.stddev_pop("pred"), 2).alias("std"),
            earliest_argmax("hour", "pred").alias("peak_hour"),
            earliest_argmin("hour", "pred").alias("trough_hour"),
            F.count("*").alias("_n"),
        )
        .filter("_n = 24")
        .drop("_n")
        .withColumn("day", F.col("d") + 1)
        .withColumn("weekday", labels.weekday_name("d", start_weekday))
        .withColumn("is_weekend", (F.lit(start_weekday) + F.col("d")) % 7 >= 5)
        .withColumn("peak_period", labels.hour_period("peak_hour"))
        .withColumn("trough_period", labels.hour_period("trough_hour"))
    )
    out = day_over_day(days)
    if baseline is not None:
        base = daily_means(baseline).select(*SERIES, F.col("day").alias("d"), F.col("day_mean").alias("_b"))
        vs = F.when(F.abs("_b") > 1e-8, (F.col("mean") - F.col("_b")) / F.abs("_b") * 100)
        out = (
            out.join(base, [*SERIES, "d"], "left")
            .withColumn("vs_baseline_pct", settle(vs, 2))
            .withColumn("baseline_day_mean", settle(F.when(F.abs("_b") > 1e-8, F.col("_b")), 2))
            .drop("_b")
        )
    return out.drop("d")


def co_occurrence_days(days: DataFrame, min_pct: float = 5.0, min_kpis: int = 2) -> DataFrame:
    """Days on which several KPIs of a station move together."""
    moved = days.filter((F.col("day") > 1) & (F.abs(F.coalesce("dod_pct", F.lit(0.0))) >= min_pct))
    change = F.struct(
        "kpi", F.col("dod_pct").alias("pct"), F.when(F.col("dod_pct") > 0, "up").otherwise("down").alias("direction")
    )
    return (
        moved.groupBy("station_id", "day", "weekday")
        .agg(F.array_sort(F.collect_list(change)).alias("changes"))
        .filter(F.size("changes") >= min_kpis)
    )


def weekday_weekend(days: DataFrame, min_diff_pct: float = 3.0) -> DataFrame:
    """Weekday against weekend mean of the daily means, where they clearly differ."""
    s = days.groupBy(*SERIES).agg(
        F.avg(F.when(~F.col("is_weekend"), F.col("mean"))).alias("weekday_avg"),
        F.avg(F.when(F.col("is_weekend"), F.col("mean"))).alias("weekend_avg"),
    )
    diff = (F.col("weekend_avg") - F.col("weekday_avg")) / F.abs("weekday_avg") * 100
    return (
        s.filter(F.col("weekend_avg").isNotNull() & (F.abs("weekday_avg") > 1e-8))
        .withColumn("diff_pct", diff)
        .filter(F.abs("diff_pct") >= min_diff_pct)
    )


def volatile_day(days: DataFrame) -> DataFrame:
    """Most volatile day (earliest on ties) and number of notable days per series."""
    size = F.abs("dod_pct")
    return days.groupBy(*SERIES).agg(
        F.max_by("day", F.when(size.isNotNull(), F.struct(size, -F.col("day")))).alias("most_volatile_day"),
        F.max_by("dod_pct", F.when(size.isNotNull(), F.struct(size, -F.col("day")))).alias("most_volatile_pct"),
        F.sum(F.col("notable").cast("int")).alias("notable_days"),
    )


def kpi_coverage(days: DataFrame) -> DataFrame:
    """KPIs a report has to cover, with the reasons in a fixed order."""
    v = volatile_day(days)
    notable = v.filter("notable_days > 0").select(*SERIES, F.lit(0).alias("o"), F.lit("notable day-over-day change").alias("reason"))
    volatile = v.filter(F.abs("most_volatile_pct") >= 5).select(
        *SERIES, F.lit(1).alias("o"), F.lit("most volatile change").alias("reason")
    )
    together = co_occurrence_days(days).select(
        "station_id",
        F.explode("changes.kpi").alias("kpi"),
        (F.col("day") + 1).alias("o"),
        F.format_string("co-occurrence on Day %d", "day").alias("reason"),
    )
    all_reasons = notable.unionByName(volatile).unionByName(together)
    return all_reasons.groupBy(*SERIES).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("o", "reason"))), lambda s: s["reason"]).alias("reasons")
    )


def forecast_window_days(stations: DataFrame, start_weekday: str = "start_weekday") -> DataFrame:
    """Labelled days of the forecast week with weekday and weekend counts per station."""
    fan = stations.select("station_id", start_weekday, F.explode(F.sequence(F.lit(0), F.lit(6))).alias("d"))
    idx = (F.col(start_weekday) + F.col("d")) % 7
    names = F.array(*[F.lit(n) for n in labels.WEEKDAYS])
    weekend = idx >= 5
    label = F.concat(
        F.format_string("Day %d: %s", F.col("d") + 1, F.element_at(names, (idx + 1).cast("int"))),
        F.when(weekend, " (weekend)").otherwise(""),
    )
    w = Window.partitionBy("station_id")
    return fan.select(
        "station_id",
        (F.col("d") + 1).alias("day"),
        label.alias("label"),
        F.sum((~weekend).cast("int")).over(w).alias("weekday_count"),
        F.sum(weekend.cast("int")).over(w).alias("weekend_count"),
    )


def report_flags(summary: DataFrame, metrics: DataFrame, ranges: DataFrame) -> DataFrame:
    """Warnings a report must print: weak accuracy and values outside the valid range of the KPI."""
    joined = summary.join(metrics.select(*SERIES, "mase"), list(SERIES), "left").join(
        ranges.select("kpi", "lo", "hi"), "kpi", "left"
    )
    no = F.lit(False)
    return (
        joined.withColumn("low_accuracy", F.coalesce(F.col("mase") >= 0.9, no))
        .withColumn("above_max", F.coalesce(F.col("forecast_max") > F.col("hi"), no))
        .withColumn("below_min", F.coalesce(F.col("forecast_min") < F.col("lo"), no))
        .select(*SERIES, "low_accuracy", "above_max", "below_min")
    )
