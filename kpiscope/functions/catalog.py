"""KPI catalogue and other fixed domain values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kpiscope.functions.exprs import small_table

# KPI contract in canonical order.
# (name, physical cap, column header in the raw station files, integer valued)
KPIS = (
    ("RRC_Conn", 500.0, "RRC_Conn_Count_Avg", True),
    ("DL_CQI", 15.0, "DL_CQI", True),
    ("DL_iBler", 100.0, "DL_iBler", False),
    ("DL_rBler", 100.0, "DL_rBler", False),
    ("MAC_DL_Eff", 250000.0, "MAC DL Eff TP", False),
    ("PRB_Util", 100.0, "DL PRB Utilization", False),
    ("Throughput", 250000.0, "DL_IP_Throughput", False),
)

# Spellings accepted for each KPI in free text.
KPI_ALIASES = {
    "RRC_Conn": ["RRC_Conn", "RRC Conn", "rrc_conn"],
    "DL_CQI": ["DL_CQI", "DL CQI", "dl_cqi", "CQI"],
    "DL_iBler": ["DL_iBler", "DL iBler", "dl_ibler", "iBLER"],
    "DL_rBler": ["DL_rBler", "DL rBler", "dl_rbler", "rBLER"],
    "MAC_DL_Eff": ["MAC_DL_Eff", "MAC DL Eff", "mac_dl_eff"],
    "PRB_Util": ["PRB_Util", "PRB Util", "prb_util"],
    "Throughput": ["Throughput", "throughput", "DL_Throughput"],
}

# Series geometry in hours.
SERIES_HOURS = 2112
HORIZON_HOURS = 168
CONTEXT_HOURS = 1944
SEASON_HOURS = 24

# First hour after training and after validation.
TRAIN_END = 67 * 24
VAL_END = 81 * 24

# Week, Monday first.
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")

KPI_SCHEMA = "kpi string, ord int, cap double, is_integer boolean, aliases array<string>"


def kpi_dim(spark: SparkSession) -> DataFrame:
    """The seven-KPI contract as a table."""
    rows = [(k, i, cap, is_int, KPI_ALIASES[k]) for i, (k, cap, _, is_int) in enumerate(KPIS)]
    return small_table(spark, rows, KPI_SCHEMA)
