"""Result documents of stations and runs: writing, reading back, and skipping finished work."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiscope.functions.exprs import require, settle
from kpiscope.operators.metrics import METRICS, rounded
from kpiscope.operators.profiles import daily_means
from kpiscope.sources.paths import folder

METRIC_STRUCT = "smape double, mase double, nrmse double, mae double, rmse double"
STATION_SCHEMA = (
    "station_id string, model string, elapsed_sec double, "
    f"metrics struct<per_kpi: map<string, struct<{METRIC_STRUCT.replace(' double', ': double')}>>>, "
    "prediction_daily map<string, array<double>>, ground_truth_daily map<string, array<double>>"
)


def _daily_map(scored: DataFrame, value: str, name: str) -> DataFrame:
    days = daily_means(scored, value, "h")
    ordered = F.array_sort(F.collect_list(F.struct("day", settle("day_mean", 4).alias("m"))))
    per = days.groupBy("station_id", "kpi").agg(F.transform(ordered, lambda s: s["m"]).alias("d"))
    return per.groupBy("station_id").agg(F.map_from_entries(F.collect_list(F.struct("kpi", "d"))).alias(name))


def station_documents(metrics: DataFrame, scored: DataFrame) -> DataFrame:
    """One nested record per station: metrics per KPI and daily means of forecast and truth.

    The collected lists are bounded by the number of KPIs and the seven days of the horizon.
    """
    per = rounded(metrics).select("station_id", "kpi", F.struct(*METRICS).alias("m"))
    nested = per.groupBy("station_id").agg(
        F.struct(F.map_from_entries(F.collect_list(F.struct("kpi", "m"))).alias("per_kpi")).alias("metrics")
    )
    pred = _daily_map(scored, "pred", "prediction_daily")
    truth = _daily_map(scored, "truth", "ground_truth_daily")
    return nested.join(pred, "station_id").join(truth, "station_id")


def write_station_documents(docs: DataFrame, path: str) -> None:
    docs.write.mode("overwrite").json(path)


def read_metric_files(spark: SparkSession, path: str) -> DataFrame:
    """(context_h, station_id, kpi, metric, value) from result files below ctx_<n>h folders."""
    docs = spark.read.schema(STATION_SCHEMA).option("recursiveFileLookup", True).json(path)
    ctx = F.regexp_extract("_metadata.file_path", r"/ctx_(\d+)h/", 1).try_cast("int")
    rows = docs.select(ctx.alias("context_h"), "station_id", F.explode("metrics.per_kpi").alias("kpi", "m"))
    cells = ", ".join(f"'{m}', m.{m}" for m in METRICS)
    return rows.select(
        "context_h", "station_id", "kpi", F.expr(f"stack({len(METRICS)}, {cells}) AS (metric, value)")
    ).filter(F.col("context_h").isNotNull() & F.col("value").isNotNull())


RUN_SCHEMA = (
    "run_dir string, model struct<model_family: string, model_name: string, forecast_mode: string, finetune_weeks: string, "
    "regime: string, n_train_windows: bigint, n_train_groups: int>, "
    "test struct<per_kpi: map<string, struct<sMAPE: double, MASE: double, nRMSE: double, MAE: double>>, "
    "mean_sMAPE: double, mean_MASE: double, mean_nRMSE: double, mean_MAE: double>, "
    "runtime struct<sec_per_station: double>"
)


def write_run_documents(docs: DataFrame, path: str) -> None:
    """A folder for each run_name with its result document; read_run_results(..., files="part-*") reads it."""
    docs.write.mode("overwrite").partitionBy("run_name").json(path)


def read_run_results(spark: SparkSession, path: str, family: str | None = None, prefix: str | None = None, files: str = "result.json") -> DataFrame:
    """(run, kpi) rows of every result.json below a folder; a selected run without test block is an error."""
    docs = (
        spark.read.schema(RUN_SCHEMA)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", files)
        .option("multiLine", files == "result.json")
        .json(path)
        .withColumn("run_name", folder(1))
    )
    return run_rows(docs, family, prefix)


def run_rows(docs: DataFrame, family: str | None = None, prefix: str | None = None) -> DataFrame:
    """(run, kpi) rows of run documents, chosen by model family and run name."""
    if family is not None:
        docs = docs.filter(F.col("model.model_family") == family)
    if prefix is not None:
        docs = docs.filter(F.col("run_name").startswith(prefix))
    docs = require(docs, F.col("test.per_kpi").isNotNull(), "result has no test per-KPI block")
    return docs.select(
        "run_name",
        "model.*",
        F.col("test.mean_MAE").alias("test_mean_mae"),
        # a plain explode would let the optimizer drop documents without the block before the check
        F.explode_outer("test.per_kpi").alias("kpi", "m"),
    ).select("*", "m.*").drop("m")


def read_skipped_runs(spark: SparkSession, path: str) -> DataFrame:
    schema = "model_family string, model_name string, forecast_mode string, reason string"
    return (
        spark.read.schema(schema)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "skipped.json")
        .option("multiLine", True)
        .json(path)
        .withColumn("run_name", folder(1))
    )


def pending(keys: DataFrame, done: DataFrame, on: list[str]) -> DataFrame:
    """Work that has no finished row yet."""
    return keys.join(done.select(*on), on, "left_anti")


def resume(keys: DataFrame, out_path: str, on: list[str]) -> DataFrame:
    """Work missing from an output table; a table that does not exist yet leaves everything to do."""
    from pyspark.errors import AnalysisException

    try:
        done = keys.sparkSession.read.parquet(out_path)
        return pending(keys, done, on)
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return keys
