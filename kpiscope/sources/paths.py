"""Names that folders of a file carry."""

from __future__ import annotations

from urllib.parse import quote, unquote, urlparse

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Name that a partitioned write gives to a missing value.
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


def folder(level: int) -> Column:
    """Name of the folder `level` steps above a file, as it was written.

    A folder of a partitioned write (`arm=on`) gives its value. Paths arrive with escapes, partition values with a second layer of them.
    """
    name = F.element_at(F.split("_metadata.file_path", "/"), -1 - level)
    plain = _decoded(name)
    value = F.regexp_extract(plain, "^[A-Za-z_]+=(.*)$", 1)
    return F.when(plain.rlike("^[A-Za-z_]+="), _decoded(value)).otherwise(plain)


def _decoded(c: Column) -> Column:
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


def folder_name(column: str, value: str | None) -> str:
    """Folder of a value, named as by a partitioned write; `folder` and `folder_value` read it."""
    return f"{column}={quote(value, safe='') if value else NO_VALUE}"


def folder_value(name: str) -> str:
    return unquote(name.split("=", 1)[1])


def mounted_path(spark: SparkSession, path: str) -> str | None:
    """Path for plain file access if driver and tasks see it as a folder, else nothing."""
    at = urlparse(path if "://" in path else path.replace("file:", "file://", 1) if path.startswith("file:") else f"//{path}")
    store = at.scheme or urlparse(spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///")).scheme
    if store != "file":
        return None
    return unquote(at.path) if at.scheme else path
