"""kpiscope: cell-KPI analytics over all stations at once, on Spark DataFrames."""

__version__ = "0.1.0"
