"""Graph files: node-link JSON in, node and edge tables out, staged results in between."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NODE = (
    "struct<id: string, node_type: string, aligned_name: string, original_names: array<string>, confidence: double, "
    "mapped_to: string, formula: string, description: string, unit: string, name: string, steps: array<string>, trigger_condition: string>"
)
EDGE = (
    "struct<source: string, target: string, relation_type: string, triple_type: string, strength: string, confidence: double, "
    "quality_score: double, condition: string, reason: string, spec_reference: string, spec_clause: string, mechanism: string, "
    "min_pct_source: double, min_pct_target: double, raw_text: string>"
)
CHAIN = "struct<name: string, description: string, steps: array<string>, trigger_condition: string>"
SCHEMA = f"nodes array<{NODE}>, edges array<{EDGE}>, links array<{EDGE}>, causal_chains array<{CHAIN}>"


def read_graph(spark: SparkSession, path: str, multiline: bool = True) -> dict[str, DataFrame]:
    """Nodes, edges, chains and steps of node-link files; edges may be called `edges` or `links`.

    `ord` is (file, place of the document in it, place in the document), so first-wins rules hold across files and across the lines of one.
    """
    doc = spark.read.schema(SCHEMA).option("multiLine", multiline).json(path)
    line = F.lit(0).cast("long") if multiline else F.monotonically_increasing_id()
    at = F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), line.alias("line")
    )
    doc = doc.withColumn("_at", at)

    def place(pos: str) -> Column:
        return F.struct("_at.file", "_at.block", "_at.line", F.col(pos).alias("place"))

    nodes = doc.select("_at", F.posexplode("nodes").alias("p", "n")).select(place("p").alias("ord"), "n.*")
    links = F.when(F.size(F.coalesce("edges", F.array().cast(f"array<{EDGE}>"))) > 0, F.col("edges")).otherwise(F.col("links"))
    edges = doc.select("_at", F.posexplode(links).alias("p", "e")).select(place("p").alias("ord"), "e.*")
    top = doc.select("_at", F.posexplode("causal_chains").alias("p", "c")).select(place("p").alias("ord"), "c.*", F.lit(1).alias("population"))
    own = nodes.filter("node_type = 'CausalChain'").select(
        "ord", "name", "description", "steps", "trigger_condition", F.lit(0).alias("population")
    )
    both = own.unionByName(top).withColumn("chain_id", F.concat_ws("-", "population", "ord.place", "ord.line", "ord.block", "ord.file"))
    chains = both.select("chain_id", "name", "description", F.col("trigger_condition").alias("trigger"), "population", "ord")
    steps = both.select("chain_id", F.posexplode("steps").alias("step_no", "step"))
    return {"nodes": nodes, "edges": edges, "chains": chains, "steps": steps}


def graph_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row with the size of the graph; both sides are plain counts."""
    parts = nodes.select(F.lit(1).alias("n"), F.lit(0).alias("e")).unionByName(edges.select(F.lit(0).alias("n"), F.lit(1).alias("e")))
    return parts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(name) for c, name in (("n", "n_nodes"), ("e", "n_edges"))])


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Tables of nodes and edges, and their sizes as metadata; sizes are those of the written tables, so nothing is built twice."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")
    kept = [nodes.sparkSession.read.parquet(f"{path}/{t}") for t in ("nodes", "edges")]
    counted = graph_counts(*kept).withColumnsRenamed({"n_nodes": "num_nodes", "n_edges": "num_edges"})
    counted.withColumn("created_at", F.current_timestamp()).write.mode("overwrite").json(f"{path}/metadata")


def read_written_graph(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """What write_graph left: nodes, edges and metadata."""
    metadata = spark.read.schema("num_nodes long, num_edges long, created_at timestamp").json(f"{path}/metadata")
    return {"nodes": spark.read.parquet(f"{path}/nodes"), "edges": spark.read.parquet(f"{path}/edges"), "metadata": metadata}


def staged(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Result of a stage from its table, built and written on first use.

    Keep thresholds out of staged tables: apply them to what this returns.
    """
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path)
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
    build().write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)
