"""The given tables, and the KPI panel and graph tables that Spark derives from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kpiscope.functions.exprs import small_table

#: Geometry of the panel derived from the event log: 30 days, the last week held out.
PANEL_HOURS = 720
SPLIT_HOUR = 552
PANEL_KPIS = ("click", "error", "purchase", "signup", "view")
PANEL_CAP = 500.0
PANEL_INTEGER_KPI = "signup"
USERS_PER_STATION = 5
#: Events behind one task of the panel; each hour of a gap becomes a row, so a task's rows are many times its events.
EVENTS_PER_TASK = 50_000


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def panel_dim(spark: SparkSession) -> DataFrame:
    """Catalogue of the panel's channels, in the shape of the KPI contract."""
    rows = [(k, i, PANEL_CAP, k == PANEL_INTEGER_KPI) for i, k in enumerate(PANEL_KPIS)]
    return small_table(spark, rows, "kpi string, ord int, cap double, is_integer boolean")


def hourly_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean value per (station, kpi, hour); map-side partial sums absorb hot stations."""
    t = F.expr("timestampdiff(HOUR, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)").cast("int")
    exact = F.col("value").cast("decimal(18,2)")
    return (
        load(spark, sf_dir, "events")
        .select(
            F.floor(F.col("user_id") / USERS_PER_STATION).alias("station_id"),
            F.col("event_type").alias("kpi"),
            t.alias("t"),
            exact.alias("v"),
        )
        .groupBy("station_id", "kpi", "t")
        .agg((F.sum("v").cast("double") / F.count("v")).alias("value"))
    )


def panel_tasks(spark: SparkSession, sf_dir: str) -> int:
    """Tasks of the panel, growing with the event log; its rows are counted from the footers."""
    wanted = -(-load(spark, sf_dir, "events").count() // EVENTS_PER_TASK)
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), wanted)


def event_panel(spark: SparkSession, sf_dir: str, hours: int = PANEL_HOURS, by: tuple[str, ...] = ("station_id", "kpi")) -> DataFrame:
    """Gap-free hourly panel (station_id, kpi, t, value) of so many hours at least; any type of event is a channel.

    A gap carries the last known value, hours before the first observation carry 0. Each
    observation is stretched to the hour before the next one, so no grid is joined: one shuffle
    on `by` serves the stretch and every later window of that key. The number of its tasks is fixed by the
    size of the log: adaptive execution would merge them by what they read, which the stretch multiplies.
    """
    w = Window.partitionBy("station_id", "kpi").orderBy("t")
    spans = hourly_observations(spark, sf_dir).repartition(panel_tasks(spark, sf_dir), *by).select(
        "station_id",
        "kpi",
        "value",
        "t",
        F.lag("t").over(w).alias("before"),
        # an hour past the panel's end stays, stretched to itself alone
        F.greatest("t", F.coalesce(F.lead("t").over(w), F.lit(hours)) - 1).alias("until"),
    )
    lead_in = F.when(
        F.col("before").isNull() & (F.col("t") > 0),
        F.transform(F.sequence(F.lit(0), F.col("t") - 1), lambda x: F.struct(x.alias("t"), F.lit(0.0).alias("value"))),
    ).otherwise(F.array().cast("array<struct<t:int,value:double>>"))
    body = F.transform(
        F.sequence("t", "until"), lambda x: F.struct(x.alias("t"), F.col("value").alias("value"))
    )
    return spans.select("station_id", "kpi", F.inline(F.concat(lead_in, body)))
