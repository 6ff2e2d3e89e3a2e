"""Forecast files: wide rows per station hour, one prediction and truth column per KPI."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiscope.functions.exprs import require, settle


def wide_forecast(scored: DataFrame, kpis: list[str], extra: tuple[str, ...] = ()) -> DataFrame:
    """(station, day, hour) rows with <kpi>_pred and <kpi>_true to 4 digits.

    The KPI list is known, so one aggregation with conditional cells replaces a pivot and its
    extra pass over the distinct values.
    """
    cells = []
    for k in kpis:
        here = F.col("kpi") == k
        cells.append(settle(F.max(F.when(here, F.col("pred"))), 4).alias(f"{k}_pred"))
        cells.append(settle(F.max(F.when(here, F.col("truth"))), 4).alias(f"{k}_true"))
    return (
        scored.groupBy(*extra, "station_id", "h")
        .agg(*cells)
        .withColumn("day", (F.floor(F.col("h") / 24) + 1).cast("int"))
        .withColumn("hour", (F.col("h") % 24).cast("int"))
        .drop("h")
    )


def write_forecast(scored: DataFrame, kpis: list[str], path: str) -> None:
    """Parquet, one folder per context when the forecast has one."""
    extra = ("context_h",) if "context_h" in scored.columns else ()
    wide_forecast(scored, kpis, extra).write.mode("overwrite").partitionBy(*extra).parquet(path)


def write_forecast_csv(scored: DataFrame, kpis: list[str], path: str) -> None:
    """CSV, one folder per station, so a station can be read back alone."""
    wide = wide_forecast(scored, kpis).withColumn("station", F.col("station_id"))
    wide.repartition("station").write.mode("overwrite").partitionBy("station").csv(path, header=True)


def read_forecast(spark: SparkSession, path: str, kpis: list[str], fmt: str = "csv", horizon: int = 168) -> DataFrame:
    """Long forecast (station_id, kpi, h, pred, truth); every station must have the whole horizon."""
    if fmt == "csv":
        cols = ", ".join(f"`{k}_pred` double, `{k}_true` double" for k in kpis)
        # columns are matched by header name, so their order in the file does not matter
        head = spark.read.option("header", True).option("recursiveFileLookup", True).csv(path)
        wanted = [c.split(" ")[0].strip("`") for c in cols.split(", ")]
        wide = head.select(
            "station_id", F.col("day").cast("int"), F.col("hour").cast("int"), *[F.col(c).cast("double") for c in wanted]
        )
    else:
        wide = spark.read.format(fmt).load(path)
    pairs = ", ".join(f"'{k}', `{k}_pred`, `{k}_true`" for k in kpis)
    long = wide.select(
        "station_id",
        ((F.col("day") - 1) * 24 + F.col("hour")).alias("h"),
        F.expr(f"stack({len(kpis)}, {pairs}) AS (kpi, pred, truth)"),
    )
    counts = long.groupBy("station_id", "kpi").agg(F.count_distinct("h").alias("_hours"))
    return require(
        long.join(counts, ["station_id", "kpi"]), F.col("_hours") == horizon, f"forecast does not have {horizon} hours"
    ).drop("_hours")
