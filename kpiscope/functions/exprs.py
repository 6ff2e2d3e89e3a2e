"""Small column expressions shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kpiscope.session import cut_lineage

SERIES = ("station_id", "kpi")


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def settle(c: str | Column, digits: int) -> Column:
    """Round half up after absorbing summation noise.

    Means of two-decimal measurements land exactly on rounding ties quite often, and the last
    bit of a distributed sum depends on the order partial sums arrive. The small offset decides
    such ties the same way on every run.
    """
    return F.round(col(c) + F.lit(1e-9), digits)


def settle_wide(c: str | Column, digits: int) -> Column:
    """settle for ratios without a bound: from a million on, digits count from the millions."""
    return F.when(F.abs(col(c)) >= 1e6, settle(col(c) / 1e6, digits) * 1e6).otherwise(settle(c, digits))


def series_window(order: str = "t", keys: tuple[str, ...] = SERIES):
    return Window.partitionBy(*keys).orderBy(order)


def earliest_argmax(position: str | Column, value: str | Column) -> Column:
    """Position of the largest value; the smallest position wins ties (one partial aggregate)."""
    return F.max_by(col(position), F.struct(col(value), -col(position)))


def earliest_argmin(position: str | Column, value: str | Column) -> Column:
    return F.min_by(col(position), F.struct(col(value), col(position)))


def safe_ratio(num: Column, den: Column, floor: float, otherwise: float | None = 0.0) -> Column:
    """num / den where den exceeds floor, else the fallback."""
    return F.when(den > floor, num / den).otherwise(F.lit(otherwise))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def has_any(text: Column, words: tuple[str, ...] | list[str]) -> Column:
    """True when the text contains at least one of the words."""
    return any_of([text.contains(w) for w in words])


def labelled(c: Column, steps: list[tuple[Column, str]], otherwise: str) -> Column:
    out = F
    for cond, name in steps:
        out = out.when(cond, F.lit(name))
    return out.otherwise(F.lit(otherwise))


def horizon_steps(df: DataFrame, horizon: int, name: str = "h") -> DataFrame:
    """Repeat every row for each hour of the horizon (a generator, no join)."""
    return df.select("*", F.explode(F.sequence(F.lit(0), F.lit(horizon - 1))).alias(name))


def require(df: DataFrame, condition: Column, message: str) -> DataFrame:
    """Fail the job on the first row that breaks the condition; otherwise pass rows through."""
    checked = F.when(condition, F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean"))
    return df.filter(checked)


def first_per(df: DataFrame, keys: list[str], order: str | Column, last: bool = False) -> DataFrame:
    """First (or last) row of each key by an order column.

    A min_by over the row struct combines on the map side, so a key that holds a third of all rows
    still sends one row per task; a ranked window would move the whole group to one task.
    """
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*rest)
    pick = F.max_by(row, col(order)) if last else F.min_by(row, col(order))
    return df.groupBy(*keys).agg(pick.alias("_row")).select(*keys, "_row.*").select(*df.columns)


def global_position(df: DataFrame, bucket: Column, order: list, name: str = "position") -> DataFrame:
    """Exact rank over the whole table (1-based) and the table size as `total`.

    `bucket` is a coarse key of bounded cardinality that agrees with `order`. Ranks are taken inside
    buckets and shifted by the sizes of the buckets before, so no task sees the whole table.
    """
    keyed = df.withColumn("_bucket", bucket)
    sizes = keyed.groupBy("_bucket").agg(F.count("*").alias("_size"))
    running = Window.partitionBy(F.lit(0)).orderBy("_bucket")
    sizes = sizes.select(
        "_bucket",
        (F.sum("_size").over(running) - F.col("_size")).alias("_before"),
        F.sum("_size").over(Window.partitionBy(F.lit(0))).alias("total"),
    )  # one row per bucket
    within = F.row_number().over(Window.partitionBy("_bucket").orderBy(*order))
    return (
        keyed.withColumn("_within", within)
        .join(sizes, "_bucket")
        .withColumn(name, F.col("_before") + F.col("_within"))
        .drop("_bucket", "_before", "_within")
    )


def range_position(df: DataFrame, order: list[str], name: str = "position") -> DataFrame:
    """Exact rank over the whole table (1-based) and the table size as `total`, for an order without ties.

    Rows are sorted by ranges of all order columns, so rows that are equal in the first ones still spread over tasks. The sorted rows are
    kept once, each with its partition and its place there; afterwards only one count per partition is added up.
    """
    kept = cut_lineage(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    part, within = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = kept.groupBy(part.alias("_part")).agg(F.count("*").alias("_size"))
    everything = Window.partitionBy(F.lit(0))
    sizes = sizes.select(
        "_part",
        (F.sum("_size").over(everything.orderBy("_part")) - F.col("_size")).alias("_before"),
        F.sum("_size").over(everything).alias("total"),
    )  # one row per partition
    return (
        kept.withColumn("_part", part)
        .withColumn("_within", within)
        .join(sizes, "_part")
        .withColumn(name, F.col("_before") + F.col("_within") + 1)
        .drop("_at", "_part", "_before", "_within")
    )


def _literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, (list, tuple)):
        return f"array({', '.join(_literal(x) for x in v)})"
    if isinstance(v, str):
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return str(v)


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Fixed rows as a VALUES relation, which the optimizer folds and broadcasts without a job."""
    fields = T.StructType.fromDDL(schema).fields
    values = ", ".join("(" + ", ".join(_literal(v) for v in r) + ")" for r in rows)
    names = [f"c{i}" for i in range(len(fields))]
    casts = [f"CAST({n} AS {f.dataType.simpleString()}) AS {f.name}" for n, f in zip(names, fields)]
    return spark.sql(f"SELECT {', '.join(casts)} FROM VALUES {values} AS v({', '.join(names)})")
