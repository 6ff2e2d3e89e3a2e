"""Report, judge and event files written by explanation runs."""

from __future__ import annotations

import itertools
import os
import shutil
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from kpiscope.sources.paths import folder, folder_name, folder_value, mounted_path

REPORT_FILE = "explanation.md"
#: Folders that one task reads.
STATIONS_PER_TASK = 1000


def read_reports(spark: SparkSession, path: str, files: str = REPORT_FILE) -> DataFrame:
    """(station_id, arm, report) from <station>/<arm>/explanation.md files, each text whole."""
    return (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", files)
        .text(path, wholetext=True)
        .select(folder(2).alias("station_id"), folder(1).alias("arm"), F.col("value").alias("report"))
    )


def write_reports(reports: DataFrame, path: str) -> None:
    """A folder for each station and arm with one file, as explanation runs leave them; read_written_reports reads it.

    A report ends with a line break; a missing one is empty. A task that runs twice leaves one file of each name. On a
    file system that all tasks mount they write the files themselves, as Spark's commit moves each file on the driver; elsewhere Spark writes them.
    """
    spark, keys = reports.sparkSession, ["station_id", "arm"]
    rows = reports.select(*[F.col(k).cast("string").alias(k) for k in keys], F.coalesce("report", F.lit("")).alias("value"))
    mounted = mounted_path(spark, path)
    if mounted is None:
        rows.repartition("station_id").write.mode("overwrite").partitionBy(*keys).text(path)
        return
    shutil.rmtree(mounted, ignore_errors=True)
    os.makedirs(mounted)
    spark.dataSource.register(ReportFolders)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # a fixed number: by their bytes all files would fall to few tasks
    ordered = rows.repartition(tasks, "station_id").sortWithinPartitions(*keys)
    ordered.select(*keys, F.col("value").cast("binary").alias("report")).write.format(ReportFolders.name()).mode("append").save(mounted)


def read_written_reports(spark: SparkSession, path: str) -> DataFrame:
    """(station_id, arm, report) of write_reports, without the closing line break."""
    mounted = mounted_path(spark, path)
    if mounted is None:
        back = read_reports(spark, path, "part-*")
    else:
        spark.dataSource.register(ReportFolders)
        back = spark.read.format(ReportFolders.name()).load(mounted).withColumn("report", F.col("report").cast("string"))
    return back.withColumn("report", F.regexp_replace("report", r"\n\z", ""))


class ReportFolders(DataSource):
    """`station_id=<name>/arm=<name>/explanation.md` files that tasks write and read by themselves; reports are bytes."""

    @classmethod
    def name(cls) -> str:
        return "report_folders"

    def schema(self) -> str:
        return "station_id string, arm string, report binary"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _FolderWriter(self.options["path"])

    def reader(self, schema) -> DataSourceReader:
        return _FolderReader(self.options["path"])


class _FolderWriter(DataSourceWriter):
    def __init__(self, path: str) -> None:
        self.path = path

    def write(self, iterator) -> WriterCommitMessage:
        """Rows arrive in order of the folders; rows of one folder make one text."""
        for (station, arm), rows in itertools.groupby(iterator, key=lambda r: (r["station_id"], r["arm"])):
            at = os.path.join(self.path, folder_name("station_id", station), folder_name("arm", arm))
            os.makedirs(at, exist_ok=True)
            draft = os.path.join(at, f".{uuid.uuid4().hex}")
            with open(draft, "wb") as out:
                out.writelines(bytes(r["report"]) + b"\n" for r in rows)
            os.replace(draft, os.path.join(at, REPORT_FILE))
        return WriterCommitMessage()


class _FolderReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[InputPartition]:
        names = sorted(e.name for e in os.scandir(self.path) if e.is_dir())
        return [InputPartition(names[i : i + STATIONS_PER_TASK]) for i in range(0, len(names), STATIONS_PER_TASK)] or [InputPartition([])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for station in partition.value:
            for arm in sorted(os.listdir(os.path.join(self.path, station))):
                file = os.path.join(self.path, station, arm, REPORT_FILE)
                if os.path.exists(file):  # not so in a folder that a lost task began
                    with open(file, "rb") as text:
                        yield folder_value(station), folder_value(arm), text.read()


def _score(c: str) -> Column:
    """Number, with the usual spellings of a missing one."""
    return F.when(~F.col(c).isin("", "nan", "None", "null"), F.col(c)).try_cast("double")


def read_judge_scores(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("header", True).option("recursiveFileLookup", True).csv(path)
    return raw.select(
        F.regexp_replace("station_id", "^station_", "").alias("station_id"),
        "arm",
        *[_score(c).alias(c) for c in ("faithfulness", "answer_relevancy", "n_events") if c in raw.columns],
    )


CAUSE = "struct<source_kpi: string, relation_type: string, strength: string, direction_consistency: boolean, shared_mechanism: boolean>"
EVENT_COLUMNS = ("kpi", "type", "t_start", "t_end", "magnitude", "z_score", "direction", "co_occurring_kpis")


def literal_to_json(c: str) -> Column:
    """Printed Python literals as JSON: None, True and False outside of words."""
    t = F.regexp_replace(F.col(c), r"\bNone\b", "null")
    return F.regexp_replace(F.regexp_replace(t, r"\bTrue\b", "true"), r"\bFalse\b", "false")


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Event files with their list and nested columns restored."""
    raw = spark.read.option("header", True).option("escape", '"').option("recursiveFileLookup", True).csv(path)
    names = F.transform(F.split(F.coalesce("co_occurring_kpis", F.lit("")), "[,;]"), lambda s: F.trim(s))
    out = raw.select(
        *[c for c in ("station_id", "event_idx") if c in raw.columns],
        "kpi",
        "type",
        F.col("t_start").cast("int"),
        F.col("t_end").cast("int"),
        F.col("magnitude").cast("double"),
        F.col("z_score").cast("double"),
        "direction",
        F.filter(names, lambda s: s != "").alias("co_occurring_kpis"),
        *[c for c in ("candidate_causes",) if c in raw.columns],
    )
    if "candidate_causes" in raw.columns:
        out = out.withColumn(
            "candidate_causes", F.from_json(literal_to_json("candidate_causes"), f"array<{CAUSE}>", {"allowSingleQuotes": "true"})
        )
    return out


def write_events(events: DataFrame, path: str) -> None:
    """Flat CSV: the KPI list as a comma list."""
    events.withColumn("co_occurring_kpis", F.array_join("co_occurring_kpis", ",")).write.mode("overwrite").csv(path, header=True)
