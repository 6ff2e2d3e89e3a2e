"""k-means with approximations against a straight loop."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from kpiscope.llm import centroids


def loop(rows, k, rounds, dims):
    """(id, cluster, distance, inertia of the cluster, inertia, digest) of every vector of the right form."""
    most = centroids.widest(dims)
    kept = [(i, [max(-most, min(most, math.floor(max(-1e30, min(1e30, 256 * x))))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    centres = [p for *_, p in sorted((hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest(), p) for i, p in kept)[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(p, c, strict=True)), j) for j, c in enumerate(centres)) for _, p in kept]

    for _ in range(rounds):
        told = assign()
        for j in range(len(centres)):
            own = [p for (_, p), (_, w) in zip(kept, told, strict=True) if w == j]
            if own:
                centres[j] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    told = assign()
    inertia = [sum(d for d, w in told if w == j) for j in range(len(centres))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return [(i, w, d, inertia[w], sum(inertia), digest[w]) for (i, _), (d, w) in zip(kept, told, strict=True)]


def vectors(dims, n, seed):
    rng = random.Random(seed)
    centres = [[rng.uniform(-0.4, 0.4) for _ in range(dims)] for _ in range(6)]
    rows = [(i, [x + rng.gauss(0, 0.05) for x in rng.choice(centres)]) for i in range(n)]
    rows += [(1000 + i, [round(x, 1) for x in rng.choice(centres)]) for i in range(40)]  # copies and ties
    rows += [(2000, None), (2001, []), (2002, [0.0] * (dims - 1)), (2003, [0.0] * (dims + 1)), (2004, [float("nan")] + [0.0] * (dims - 1)), (2005, [math.inf] * dims), (2006, [None] + [0.0] * (dims - 1))]
    return [*rows, rows[3], rows[3], (None, [0.01] * dims), (3000, [300.0] + [0.0] * (dims - 1))]


@pytest.mark.parametrize(("dims", "k", "n"), [(8, 12, 300), (7, 3, 60), (1, 5, 80), (64, 9, 120)])
def test_clusters(spark, dims, k, n):
    rows = vectors(dims, n, dims)
    df = spark.createDataFrame([(*r, "mine", "r", b"c") for r in rows], "vec_id long, embedding array<double>, cluster string, row string, cells binary").repartition(4)
    out = centroids.cluster(df, k=k, rounds=3, dims=dims)
    assert len(set(out.columns)) == len(out.columns) and {"row", "cells"} < set(out.columns)
    got = sorted((tuple(r) for r in out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=repr)
    assert got == sorted(loop(rows, k, 3, dims), key=repr)


def test_few_vectors_equal_vectors_and_huge_ones(spark):
    kind = "vec_id long, embedding array<float>"
    for rows in ([(1, [0.5, 0.25])], [(i, [0.5, 0.25]) for i in range(9)], [(1, [3e38, -3e38]), (2, [-3e38, 1.0]), (3, [0.0, 0.0])]):
        got = centroids.cluster(spark.createDataFrame(rows, kind), k=4, dims=2).collect()
        want = {i: (w, d) for i, w, d, *_ in loop(rows, 4, 5, 2)}
        assert {r["vec_id"]: (r["cluster"], r["distance"]) for r in got} == want
    empty = centroids.cluster(spark.createDataFrame(rows, kind).limit(0), dims=2)
    assert empty.count() == 0 and empty.columns == ["vec_id", "embedding", *centroids.RESULT]


def test_bounds_hold_and_spare_full_vectors():
    rng = np.random.default_rng(1)
    middle = rng.integers(-100, 100, (12, 64))
    full = middle[rng.integers(0, 12, 4000)] + rng.integers(-8, 9, (4000, 64))
    cells = centroids.Cells(full[:500], full.min(axis=0), full.max(axis=0))
    packed, tables = cells.pack(full), cells.tables(middle)
    bounds = sum(tables[b][packed[:, b]] for b in range(32))
    exact = ((full[:, None] - middle[None]) ** 2).sum(axis=2)
    assert (bounds[:, 0] <= exact).all() and (exact <= bounds[:, 1]).all()
    cluster, fetched = centroids.nearest(packed, full, tables, middle)
    assert (cluster == exact.argmin(axis=1)).all() and (fetched == 0).mean() > 0.5
