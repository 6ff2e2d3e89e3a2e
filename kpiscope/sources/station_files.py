"""Raw station files: one wide CSV per station, hourly rows, one column per KPI."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kpiscope.functions.catalog import KPIS, SERIES_HOURS
from kpiscope.functions.exprs import require

RAW_COLUMNS = {raw: kpi for kpi, _, raw, _ in KPIS}
PLACE_COLUMNS = ("latitude", "longitude", "eNB ID", "CELL No")


#: Ways a day is written, tried in this order.
DATE_FORMATS = ("yyyy-M-d", "yyyy/M/d", "yyyyMMdd", "d.M.yyyy")


def read_wide(spark: SparkSession, path: str, columns: dict[str, str] | None = None, hours: int = SERIES_HOURS, formats: tuple[str, ...] = DATE_FORMATS) -> DataFrame:
    """Station rows with their hour index t, at most `hours` of them.

    Missing columns, days in another format, hours that occur twice and stations with fewer hours are errors. Headers are checked against each
    file, so files with another column order do not slip through.
    """
    columns = columns or RAW_COLUMNS
    raw = spark.read.option("header", True).option("enforceSchema", False).option("recursiveFileLookup", True).csv(path)
    missing = [c for c in ("DATE", "HOUR", *columns) if c not in raw.columns]
    if missing:
        raise ValueError(f"station files lack columns {missing}")
    # files are <station>.csv, or part files in a station=<station> folder
    folder = F.regexp_extract("_metadata.file_path", r"/station=([^/]+)/", 1)
    station = F.when(folder != "", folder).otherwise(F.regexp_extract("_metadata.file_name", r"^(.+?)\.csv$", 1))
    place = [F.col(f"`{c}`") for c in PLACE_COLUMNS if c in raw.columns]
    named = raw.select(
        station.alias("station_id"),
        F.coalesce(*(F.try_to_timestamp(F.trim("DATE"), F.lit(f)) for f in formats)).alias("_d"),
        F.col("HOUR").cast("int").alias("_h"),
        *place,
        *[F.col(f"`{c}`").cast("double").alias(k) for c, k in columns.items()],
    )
    w = Window.partitionBy("station_id")
    dated = require(named, F.col("_d").isNotNull() & F.col("_h").between(0, 23), "station file has a date or hour that cannot be read")
    ordered, now = w.orderBy("_d", "_h"), F.struct("_d", "_h")
    placed = dated.withColumns({"t": F.row_number().over(ordered) - 1, "_before": F.lag(now).over(ordered)}).withColumn("_n", F.count("*").over(w))
    once = require(placed, F.col("_before").isNull() | (F.col("_before") != now), "station has an hour twice")
    full = require(once, F.col("_n") >= hours, f"station has fewer than {hours} hours")
    return full.filter(F.col("t") < hours).drop("_n", "_d", "_h", "_before")


def to_panel(wide: DataFrame, kpis: list[str] | None = None) -> DataFrame:
    """Long panel (station_id, kpi, t, value)."""
    kpis = kpis or [k for k, *_ in KPIS]
    return wide.unpivot(["station_id", "t"], kpis, "kpi", "value").select("station_id", "kpi", "t", "value")


def station_dim(wide: DataFrame) -> DataFrame:
    """Place and cell of each station, told by its first hour."""
    names = {"latitude": "lat", "longitude": "lon", "eNB ID": "enb", "CELL No": "cell"}
    cells = [F.min_by(F.col(f"`{c}`"), "t").alias(n) for c, n in names.items() if c in wide.columns]
    return wide.groupBy("station_id").agg(*cells)


def write_stations(panel: DataFrame, columns: dict[str, str], path: str) -> None:
    """Panel as station files, one folder with one CSV file per station."""
    cells = [F.max(F.when(F.col("kpi") == k, F.col("value"))).alias(raw) for raw, k in columns.items()]
    wide = panel.groupBy("station_id", "t").agg(*cells)
    rows = wide.select(
        F.col("station_id").alias("station"),
        F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), F.floor(F.col("t") / 24).cast("int")), "yyyy-MM-dd").alias("DATE"),
        (F.col("t") % 24).alias("HOUR"),
        *[F.col(f"`{raw}`") for raw in columns],
    )
    rows.repartition("station").write.mode("overwrite").partitionBy("station").csv(path, header=True)
