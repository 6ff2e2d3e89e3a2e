"""Anomaly events of a forecast against the last observed week.

Detection works on a timeline (station_id, kpi, h, pred), see `timeline`. An event is
(station_id, event_idx, kpi, type, t_start, t_end, magnitude, z_score, direction, co_occurring_kpis).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kpiscope.functions import labels
from kpiscope.functions.exprs import SERIES, series_window, settle

# Emission order of the event types inside one KPI.
TYPE_ORDER = {"level_shift": 0, "spike": 1, "trend_break": 2, "multi_kpi": 3}

EVENT_COLUMNS = ("station_id", "kpi", "type", "t_start", "t_end", "magnitude", "z_score", "direction", "co_occurring_kpis")


def baseline_moments(baseline: DataFrame, floor: float = 1e-8) -> DataFrame:
    """Mean, deviation, deviation of single steps and last value of the observed week."""
    step = F.col("value") - F.lag("value").over(series_window())

    def positive(c: Column) -> Column:
        return F.when(c == 0, F.lit(floor)).otherwise(c)

    return (
        baseline.withColumn("_d", step)
        .groupBy(*SERIES)
        .agg(
            F.avg("value").alias("mu"),
            positive(F.stddev_pop("value")).alias("sigma"),
            positive(F.stddev_pop("_d")).alias("dsigma"),
            F.max_by("value", "t").alias("last_value"),
        )
    )


def timeline(forecast: DataFrame, baseline: DataFrame) -> DataFrame:
    """One frame (station_id, kpi, h, pred): the observed week at h < 0, the forecast from h = 0 on.

    With both parts in one series, moments, steps and slopes are windows and nothing is joined. Baseline hours t count up to the hour before the forecast.
    """
    last = F.max("t").over(Window.partitionBy(*SERIES))
    past = baseline.select(*SERIES, (F.col("t") - last - 1).alias("h"), F.col("value").alias("pred"))
    return forecast.select(*SERIES, "h", "pred").unionByName(past)


def hour_marks(
    line: DataFrame, z_threshold: float = 2.5, delta_threshold: float = 3.0, width: int = 12, floor: float = 1e-8
) -> DataFrame:
    """Per forecast hour: z-score, step, slope swing and the level and spike flags.

    Every window is partitioned by the series. The first forecast step is measured from the last
    observed value.
    """
    whole, ordered = Window.partitionBy(*SERIES), series_window("h")
    past = F.col("h") < 0

    def positive(c: Column) -> Column:
        return F.when(c == 0, F.lit(floor)).otherwise(c)

    # one select per window specification keeps them in one Window node each
    moving = F.when(F.col("h") >= width - 1, F.avg("pred").over(ordered.rowsBetween(-(width - 1), 0)))
    marks = (
        line.withColumns({"diff": F.col("pred") - F.lag("pred").over(ordered), "moving": moving})
        .withColumn("slope", F.col("moving") - F.lag("moving").over(ordered))
        .withColumns(
            {
                "before": F.lag("slope").over(ordered),
                "mu": F.avg(F.when(past, F.col("pred"))).over(whole),
                "sd": F.stddev_pop(F.when(past, F.col("pred"))).over(whole),
                "dsigma": positive(F.stddev_pop(F.when(past, F.col("diff"))).over(whole)),
            }
        )
        .filter(~past)
    )
    return (
        marks.withColumn("z", (F.col("pred") - F.col("mu")) / positive(F.col("sd")))
        .withColumns(
            {"is_level": F.abs("z") > z_threshold, "is_spike": F.abs("diff") > delta_threshold * F.col("dsigma")}
        )
        .drop("moving")
    )


_EVENT = (
    "struct<kpi:string,type:string,t_start:int,t_end:int,magnitude:double,z_score:double,direction:string,"
    "co_occurring_kpis:array<string>>"
)


def _record(kind: str, start: Column, end: Column, magnitude: Column, z: Column, direction: Column, kpis: Column | None = None) -> Column:
    joint = kpis is not None
    return F.struct(
        F.lit("MULTI") if joint else F.col("kpi"),
        F.lit(kind),
        start.cast("int"),
        end.cast("int"),
        magnitude.cast("double"),
        z.cast("double"),
        direction,
        kpis if joint else F.array().cast("array<string>"),
    ).cast(_EVENT)


def _up(c: Column) -> Column:
    return F.when(c > 0, "up").otherwise("down")


def _runs(flag: str, keys: tuple[str, ...], run: str, opens: str):
    """Running number of the current run of flagged hours, as two steps over one window."""
    ordered = Window.partitionBy(*keys).orderBy("h")
    first = F.col(flag) & ~F.coalesce(F.lag(flag).over(ordered), F.lit(False))
    return (opens, first.cast("int")), (run, F.sum(opens).over(ordered))


def _channel_records(marks: DataFrame, horizon: int, min_duration: int, width: int, multiple: float) -> tuple[DataFrame, list[Column]]:
    """Marks with run aggregates, and the records of single-KPI events read off each hour."""
    h = F.col("h")
    step1, step2 = _runs("is_level", SERIES, "_run", "_opens")
    run = Window.partitionBy(*SERIES, "_run")
    inside = F.col("is_level")
    # hours after a run carry its number too, so every aggregate looks at flagged hours only
    seen = (
        marks.withColumn(*step1)
        .withColumn(*step2)
        .withColumns(
            {
                "_start": F.min(F.when(inside, h)).over(run),
                "_end": F.max(F.when(inside, h)).over(run),
                "_size": F.max(F.when(inside, F.abs(F.col("pred") - F.col("mu")))).over(run),
                "_peak": F.max_by("z", F.when(inside, F.struct(F.abs("z"), -h))).over(run),
            }
        )
        .drop("_opens", "_run")
    )
    whole = inside & (h == F.col("_end")) & (F.col("_end") - F.col("_start") + 1 >= min_duration)
    level = F.when(
        whole, _record("level_shift", F.col("_start"), F.col("_end"), F.col("_size"), F.col("_peak"), _up(F.col("_peak")))
    )
    spike = F.when(
        F.col("is_spike"), _record("spike", h, h, F.abs("diff"), F.col("diff") / F.col("dsigma"), _up(F.col("diff")))
    )
    swing = F.col("slope") - F.col("before")
    center = h - width + width // 2
    broken = (
        F.col("before").isNotNull()
        & (F.signum("slope") != F.signum("before"))
        & (F.abs(swing) > multiple * F.col("dsigma"))
        & F.lit(horizon >= 2 * width)
    )
    trend = F.when(
        broken,
        _record(
            "trend_break",
            F.greatest(F.lit(0), center - 2),
            F.least(F.lit(horizon - 1), center + 2),
            F.abs(swing),
            swing / F.col("dsigma"),
            _up(F.col("slope")),
        ),
    )
    return seen, [level, spike, trend]


def _joint_records(marks: DataFrame, dim: DataFrame, min_kpis: int) -> tuple[DataFrame, list[Column]]:
    """Marks with the runs of hours in which several KPIs are off, carried by one row per hour."""
    h = F.col("h")
    hour = Window.partitionBy("station_id", "h")
    off = F.col("is_level") | F.col("is_spike")
    named = marks.join(dim.select("kpi", "ord"), "kpi", "left")
    covered = named.withColumns(
        {
            "_cover": F.sum(off.cast("int")).over(hour),
            "_kpis": F.collect_set(F.when(off, F.struct("ord", "kpi"))).over(hour),
            "_lead": F.col("kpi") == F.min("kpi").over(hour),
        }
    ).withColumn("_hot", F.col("_lead") & (F.col("_cover") >= min_kpis))
    step1, step2 = _runs("_hot", ("station_id", "_lead"), "_jrun", "_jopens")
    run = Window.partitionBy("station_id", "_lead", "_jrun")
    hot = F.col("_hot")
    seen = (
        covered.withColumn(*step1)
        .withColumn(*step2)
        .withColumns(
            {
                "_jstart": F.min(F.when(hot, h)).over(run),
                "_jend": F.max(F.when(hot, h)).over(run),
                "_jcover": F.max(F.when(hot, F.col("_cover"))).over(run),
                "_jkpis": F.collect_set(F.when(hot, F.col("_kpis"))).over(run),
            }
        )
        .drop("_jopens", "_jrun", "_lead", "_kpis", "_cover", "ord")
    )
    names = F.transform(F.array_sort(F.array_distinct(F.flatten("_jkpis"))), lambda s: s["kpi"])
    record = F.when(
        hot & (h == F.col("_jend")),
        _record("multi_kpi", F.col("_jstart"), F.col("_jend"), F.col("_jcover"), F.col("_jcover"), F.lit("mixed"), names),
    )
    return seen, [record]


def detect(line: DataFrame, dim: DataFrame, horizon: int = 168, min_duration: int = 2, min_kpis: int = 3, width: int = 12, multiple: float = 2.0) -> DataFrame:
    """All events of all stations from a timeline, not yet ranked.

    * level shift: run of far-off hours, emitted at its last hour, signed z at the first peak;
    * spike: one hour whose step is large against the usual step;
    * trend break: sign change of the rolling slope that swings by more than the usual step;
    * multi_kpi: run of hours in which at least min_kpis KPIs are off, whatever their runs.

    A station's hours meet in one task, which its catalogue and horizon bound. Every window below
    is partitioned by the station or finer, so this is the only shuffle, ranking included.
    """
    marks = hour_marks(line.repartition("station_id"), width=width)
    seen, single = _channel_records(marks, horizon, min_duration, width, multiple)
    seen, joint = _joint_records(seen, dim, min_kpis)
    return seen.select("station_id", F.inline(F.array_compact(F.array(*single, *joint))))


def of_type(line: DataFrame, dim: DataFrame, kind: str) -> DataFrame:
    return detect(line, dim).filter(F.col("type") == kind)


def rank_topn(events: DataFrame, dim: DataFrame, top_n: int | None = 10, boost: float = 1.5) -> DataFrame:
    """Strongest events per station, or all of them by rank (top_n None); events over several KPIs count 1.5 fold.

    Ties keep emission order: catalogue order of the KPI, type, start. The rank filter lets Spark
    cut each partition to top_n per station before the shuffle.
    """
    order = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in TYPE_ORDER.items() for x in kv]), F.col("type")), F.lit(9))
    score = F.abs("z_score") * F.when(F.col("type") == "multi_kpi", boost).otherwise(1.0)
    w = Window.partitionBy("station_id").orderBy(
        F.round(score, 9).desc(), F.coalesce(F.col("_ord"), F.lit(1 << 30)), order, "t_start"
    )
    ranked = events.join(dim.select("kpi", F.col("ord").alias("_ord")), "kpi", "left")
    ranked = ranked.withColumn("event_idx", F.row_number().over(w) - 1)
    if top_n is not None:
        ranked = ranked.filter(F.col("event_idx") < top_n)
    return ranked.select("station_id", "event_idx", *EVENT_COLUMNS[1:])


def serialize(events: DataFrame) -> DataFrame:
    """Events as they are written: duration added, numbers rounded."""
    return (
        events.withColumn("duration_h", F.col("t_end") - F.col("t_start") + 1)
        .withColumn("magnitude", settle("magnitude", 4))
        .withColumn("z_score", settle("z_score", 3))
    )


def with_time_labels(events: DataFrame, start_weekday: int = 0) -> DataFrame:
    day = F.floor(F.col("t_start") / 24)
    return (
        events.withColumn("forecast_day", (day + 1).cast("int"))
        .withColumn("weekday_label", labels.weekday_name(day, start_weekday, 3))
        .withColumn("hour_window_label", labels.hour_window_label("t_start", "t_end", start_weekday))
    )


def filter_type(events: DataFrame, kind: str | None = None, start_weekday: int = 0) -> DataFrame:
    """Events of one type (or all) with clock labels and the station's count of that selection."""
    chosen = events if kind is None else events.filter(F.col("type") == kind)
    count = F.count("*").over(Window.partitionBy("station_id"))
    return with_time_labels(chosen, start_weekday).withColumn("n_selected", count)


def for_kpi(events: DataFrame, kpi: str) -> DataFrame:
    """Events of a KPI, including joint events it takes part in."""
    return events.filter((F.col("kpi") == kpi) | F.array_contains("co_occurring_kpis", kpi))


def strength_rank(strength: str = "strength") -> Column:
    """Numeric order of an edge strength; unknown strengths rank 0."""
    s = F.col(strength)
    return F.when(s == "critical", 4).when(s == "strong", 3).when(s == "moderate", 2).when(
        s.isin("weak", "extracted"), 1
    ).otherwise(0)


