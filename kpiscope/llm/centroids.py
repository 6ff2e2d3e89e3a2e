"""k-means over whole-number vectors with a vector-approximation file.

Every vector is written once, beside its approximation: each dimension is cut into sixteen cells, and two cells share a byte. Marks
between cells are quantiles of a bounded sample; a cell's limits are its marks, those of the outer cells the least and
greatest value of all vectors. In a round, tables made from the centroids give, for each byte and centroid, the least and the
greatest squared distance that any vector with this byte can add; looked up and added over the bytes they bound a vector's
distance to every centroid. Only centroids whose least distance is not above the smallest greatest one can be nearest. A
vector with one such centroid is assigned by its approximation; for the others the full vector is fetched, and exact distances
are worked out to the centroids that are left. Marks decide how much is fetched, never the result.

A round is one job: tasks add up their vectors by cluster (a task holds k x dims sums), Spark adds these, and k x dims totals reach the
driver, which sets the centroids for the next round; a task's tables have 2,048 k x dims bytes. Nothing but the written file is carried over, so a lost task is
simply run again. Sums need every vector once a round, so approximation and vector share a row: bounds save
arithmetic, not reading.

Component x of a vector becomes floor(SCALE * x), held to +-widest(dims) so that squared distances fit a long (with 64 dimensions |x| up to 524,288 is exact).
Vectors with another number of components, or with null, NaN or infinite ones, are left out. Ties go to the smaller cluster number. Centroids
start as the k vectors with the smallest hash of their id (a null id hashes as an empty one; equal hashes by the vector),
fewer than k vectors give fewer centroids, an empty table gives an empty table. Repeated rows count each. Extra columns pass
through; input columns named like the results are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kpiscope.llm.shared import bounded_batches, stash

SCALE = 256
CELLS = 16
#: Marks are fitted on so many vectors, those with the smallest hashes.
SAMPLE = 4096
#: Vectors are compared so many at a time.
STEP = 2048
RESULT = ["cluster", "distance", "n_fetched", "cluster_inertia", "inertia", "centroid_sha256"]


def widest(dims: int) -> int:
    """A power of two; the squared distance of two vectors of components up to it is at most 2^62."""
    return 1 << (62 - (dims - 1).bit_length()) // 2 - 1


def points(vectors: DataFrame, dims: int, vec_id: str, vector: str, seed: int) -> DataFrame:
    """(row, hash, point): whole-number vectors of the right length, with the row they come from."""
    values, most = F.col("values"), widest(dims)
    good = (F.size(values) == dims) & F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    whole = F.transform(values, lambda x: F.floor(F.greatest(F.least(SCALE * x, F.lit(float(most))), F.lit(float(-most)))).cast("int"))
    kept = [F.col(f"`{c}`") for c in vectors.columns if c not in RESULT]
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{vec_id}`").cast("string"), F.lit(""))), 256)
    rows = vectors.select(F.struct(*kept).alias("row"), key.alias("hash"), F.col(f"`{vector}`").cast("array<double>").alias("values"))
    return rows.filter(F.coalesce(good, F.lit(False))).select("row", "hash", whole.alias("point"))


def matrix(column: pa.ListArray, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


class Cells:
    """Marks between the cells of each dimension, and the least and greatest value of each cell."""

    def __init__(self, sample: np.ndarray, least: np.ndarray, most: np.ndarray):
        cuts = np.quantile(sample, np.arange(1, CELLS) / CELLS, axis=0, method="lower").astype(np.int64).T
        self.marks = cuts  # a value above cuts[i] lies in a cell after i
        self.low = np.concatenate([least[:, None], np.maximum(cuts + 1, least[:, None])], axis=1)
        self.high = np.concatenate([np.minimum(cuts, most[:, None]), most[:, None]], axis=1)

    def pack(self, values: np.ndarray) -> np.ndarray:
        """Two cells a byte; an odd dimension has a byte of its own."""
        cells = np.zeros((len(values), (values.shape[1] + 1) // 2 * 2), dtype=np.uint8)
        for d in range(values.shape[1]):
            cells[:, d] = np.searchsorted(self.marks[d], values[:, d], side="left")
        return cells[:, ::2] << 4 | cells[:, 1::2]

    def tables(self, centroids: np.ndarray) -> np.ndarray:
        """[byte, value of the byte, bound, centroid]: the least and the greatest squared distance it adds."""
        c = centroids.T[:, None, :]
        under, over = self.low[:, :, None] - c, c - self.high[:, :, None]
        far = np.maximum(np.abs(under), np.abs(over)) ** 2
        near = np.maximum(np.maximum(under, over), 0) ** 2
        both = np.stack([near, far], axis=2)  # [dim, cell, bound, centroid]
        if len(both) % 2:
            both = np.concatenate([both, np.zeros_like(both[:1])])
        return (both[::2, :, None] + both[1::2, None, :]).reshape(len(both) // 2, CELLS * CELLS, 2, -1)


def nearest(packed: np.ndarray, full: np.ndarray, tables: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cluster of each vector, and to how many centroids its full vector was compared (0: told by its approximation)."""
    bounds = tables[0][packed[:, 0]]
    for byte in range(1, len(tables)):
        bounds += tables[byte][packed[:, byte]]
    open_ = bounds[:, 0] <= bounds[:, 1].min(axis=1)[:, None]
    cluster, n = open_.argmax(axis=1), open_.sum(axis=1)
    fetch = np.flatnonzero(n > 1)
    at, which = np.nonzero(open_[fetch])
    exact = np.full((len(fetch), len(centroids)), np.iinfo(np.int64).max)
    for start in range(0, len(at), 8 * STEP):
        a, w = at[start : start + 8 * STEP], which[start : start + 8 * STEP]
        gap = full[fetch[a]] - centroids[w]
        exact[a, w] = np.einsum("ij,ij->i", gap, gap)
    cluster[fetch] = exact.argmin(axis=1)
    return cluster, np.where(n > 1, n, 0)


def assigned(batch: pa.RecordBatch, cells: Cells, tables: np.ndarray, centroids: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of a batch with their full vectors, clusters and comparisons."""
    dims = centroids.shape[1]
    full = matrix(batch.column("point"), dims).astype(np.int64)
    width = (dims + 1) // 2
    approximation = batch.column("cells")
    packed = np.frombuffer(b"".join(approximation.to_pylist()), dtype=np.uint8).reshape(-1, width)
    for start in range(0, len(full), STEP):
        part = slice(start, start + STEP)
        yield part, full[part], *nearest(packed[part], full[part], tables, centroids)


def built(rows: DataFrame, cells: Cells, dims: int) -> DataFrame:
    """The vector-approximation file: rows with the packed cells of their point."""
    schema = T.StructType([*rows.schema.fields, T.StructField("cells", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = cells.pack(matrix(batch.column("point"), dims).astype(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([p.tobytes() for p in packed], pa.binary())], names=[*batch.schema.names, "cells"])

    return rows.mapInArrow(run, schema)


def totals(file: DataFrame, cells: Cells, centroids: np.ndarray) -> DataFrame:
    """(cluster, dim, total) over all vectors; dim -1 holds their number."""
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = cells.tables(centroids)
        sums = np.zeros((k, dims + 1), dtype=np.int64)
        for batch in batches:
            for _, full, cluster, _ in assigned(batch, cells, tables, centroids):
                member = np.zeros((k, len(full)))
                member[cluster, np.arange(len(full))] = 1
                sums[:, :dims] += (member @ full).astype(np.int64)  # whole numbers under 2^53
                sums[:, dims] += np.bincount(cluster, minlength=k)
        which, dim = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(which, pa.int32()), pa.array(np.where(dim < dims, dim, -1), pa.int32()), pa.array(sums[which, dim], pa.int64())], names=["cluster", "dim", "total"])

    parts = file.select("point", "cells").mapInArrow(run, "cluster int, dim int, total long")
    return parts.groupBy("cluster", "dim").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))


def moved(centroids: np.ndarray, sums: list) -> np.ndarray:
    """Every centroid with vectors set to the floor of their mean."""
    out, size = centroids.copy(), {r["cluster"]: int(r["total"]) for r in sums if r["dim"] < 0}
    for cluster in size:
        out[cluster] = 0
    for r in sums:
        if r["dim"] >= 0:
            out[r["cluster"], r["dim"]] = int(r["total"]) // size[r["cluster"]]
    return out


def labelled(file: DataFrame, cells: Cells, centroids: np.ndarray) -> DataFrame:
    """Rows with cluster, distance and n_fetched."""
    schema = T.StructType([file.schema["row"], *(T.StructField(n, t) for n, t in (("cluster", T.IntegerType()), ("distance", T.LongType()), ("n_fetched", T.IntegerType())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = cells.tables(centroids)
        for batch in batches:
            for part, full, cluster, n in assigned(batch, cells, tables, centroids):
                gap = full - centroids[cluster]
                results = [pa.array(cluster, pa.int32()), pa.array(np.einsum("ij,ij->i", gap, gap), pa.int64()), pa.array(n, pa.int32())]
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(part.start, len(full)), *results], names=["row", "cluster", "distance", "n_fetched"])

    return file.select("row", "point", "cells").mapInArrow(run, schema)


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, vec_id: str = "vec_id", vector: str = "embedding", seed: int = 2) -> DataFrame:
    """Add RESULT to every vector of the right form."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = points(vectors, dims, vec_id, vector, seed)
    first = rows.select("hash", "point").orderBy("hash", "point").limit(max(k, SAMPLE)).collect()
    if not first:
        none = {"cluster": "int", "distance": "long", "n_fetched": "int", "cluster_inertia": "long", "inertia": "long", "centroid_sha256": "string"}
        return rows.select("row.*", *(F.lit(None).cast(t).alias(c) for c, t in none.items()))
    sample = np.array([r["point"] for r in first], dtype=np.int64)
    centroids = sample[:k]
    limits = {r["pos"]: r for r in rows.select(F.posexplode("point")).groupBy("pos").agg(F.min("col").alias("least"), F.max("col").alias("most")).collect()}
    cells = Cells(sample, *(np.array([limits[d][side] for d in range(dims)], dtype=np.int64) for side in ("least", "most")))
    file = stash(built(rows.select("row", "point"), cells, dims), "vector-cells")
    for _ in range(rounds):
        centroids = moved(centroids, totals(file, cells, centroids).collect())

    out = stash(labelled(file, cells, centroids), "vector-clusters")
    inertia = out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()
    overall = sum(int(r["total"]) for r in inertia)
    most = (1 << 63) - 1
    found = [(r["cluster"], min(int(r["total"]), most), min(overall, most), digest(centroids[r["cluster"]])) for r in inertia]
    by_cluster = spark.createDataFrame(found, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(by_cluster, "cluster").select("row.*", *RESULT)
