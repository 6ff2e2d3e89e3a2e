"""Inputs the registered queries share, all derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiscope.operators import forecast as fc
from kpiscope.sources.tables import SPLIT_HOUR, event_panel, load, panel_dim

BASE_START = SPLIT_HOUR - 168


def panel(spark: SparkSession, sf: str) -> DataFrame:
    return event_panel(spark, sf)


def inputs(spark: SparkSession, sf: str, by: tuple[str, ...] = ("station_id", "kpi")) -> DataFrame:
    return event_panel(spark, sf, by=by).filter(F.col("t") < SPLIT_HOUR)


def target(spark: SparkSession, sf: str) -> DataFrame:
    return (
        event_panel(spark, sf)
        .filter(F.col("t") >= SPLIT_HOUR)
        .select("station_id", "kpi", (F.col("t") - SPLIT_HOUR).alias("h"), F.col("value").alias("truth"))
    )


def baseline(spark: SparkSession, sf: str) -> DataFrame:
    """Last observed week, hours 0..167."""
    return (
        event_panel(spark, sf)
        .filter((F.col("t") >= BASE_START) & (F.col("t") < SPLIT_HOUR))
        .withColumn("t", F.col("t") - BASE_START)
    )


def timeline(spark: SparkSession, sf: str) -> DataFrame:
    """Observed week (h < 0) and held-out week (h >= 0) in one frame, from one read of the panel, the channels of a station together."""
    return (
        event_panel(spark, sf, by=("station_id",))
        .filter(F.col("t") >= BASE_START)
        .select("station_id", "kpi", (F.col("t") - SPLIT_HOUR).alias("h"), F.col("value").alias("pred"))
    )


def forecast(spark: SparkSession, sf: str) -> DataFrame:
    """Daily seasonal-naive forecast of the held-out week."""
    return fc.seasonal_naive(inputs(spark, sf), horizon=168, season=24)


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Forecast beside its truth."""
    return forecast(spark, sf).join(target(spark, sf), ["station_id", "kpi", "h"])


def dim(spark: SparkSession) -> DataFrame:
    return panel_dim(spark)


def stations(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("station_id"), F.col("s_nationkey").alias("site_group")
    )
