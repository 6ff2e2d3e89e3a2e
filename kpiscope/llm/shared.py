"""What the operators of this subpackage have in common."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiscope.session import scratch_folder

#: Fixed by the queries' contracts: what separates words, and what words are.
BLANK, WORD = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: An Arrow batch is cut at this size, so that a few very long texts cannot fill a Python worker.
BATCH_BYTES = 4 << 20


def sheltered(*helpers: str) -> Callable:
    """Decorator: input columns named like an operator's helper columns bear other names while it works."""

    def decorate(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        @wraps(operator)
        def run(docs: DataFrame, *args, **more) -> DataFrame:
            taken = [c for c in docs.columns if c.lower() in helpers]
            if not taken:
                return operator(docs, *args, **more)
            away = {c: f"input column {k}: {c}" for k, c in enumerate(taken)}
            out = operator(docs.withColumnsRenamed(away), *args, **more)
            return out.withColumnsRenamed({new: old for old, new in away.items()})

        return run

    return decorate


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's limit of an Arrow batch to BATCH_BYTES, unless the user has set a lower one."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    try:
        now = int(spark.conf.get(key, str(2**31 - 1)))
    except ValueError:  # a size with a unit was chosen by the user
        return
    if now > BATCH_BYTES or now < 0:
        spark.conf.set(key, str(BATCH_BYTES))


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared folder and read it again.

    Cuts lineage and forgets partitioning, so that a join after it gets exchanges of its own on both sides, whose skewed
    partitions adaptive execution can split; and its size is then known, so that Spark broadcasts it only if it is small.
    """
    spark = df.sparkSession
    path = scratch_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def words(text: Column) -> Column:
    """All words of a text; none for null."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)), F.array().cast("array<string>"))


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased and nothing else. Texts of ASCII alone take lower(), which is much faster and does the same there."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def hash64(*cols: Column | int) -> Column:
    return F.xxhash64(*(F.lit(c) if isinstance(c, int) else c for c in cols))
