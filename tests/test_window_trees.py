"""Trees on pooled windows: against the ML library, plain loops, and other ways of dealing windows to tasks."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from kpiscope.operators import features, forecast, window_trees


def panel(spark, stations=3, days=9, seed=3):
    """Whole numbers; the last day of each series repeats its third, so that its features are those of a training window."""
    rng = np.random.default_rng(seed)
    rows = []
    for s in range(stations):
        x = rng.integers(0, 40, size=days * 24)
        x[-24:] = x[48:72]
        rows += [(f"s{s}", "k", t, float(v)) for t, v in enumerate(x)]
    return spark.createDataFrame(rows, "station_id string, kpi string, t int, value double")


def by_hour(df):
    return {(r["station_id"], r["h"]): r["pred"] for r in df.collect()}


def test_boosted_trees_are_those_of_the_ml_library(spark):
    """Up to 32 values of a feature are all bins in both, so splits and leaves agree."""
    df = panel(spark)
    want = by_hour(forecast.pooled_regression(df, "gbt", horizon=30, maxIter=4, maxDepth=3))
    got = by_hour(forecast.pooled_trees(df, "boosted", horizon=30, rounds=4, depth=3))
    assert len(set(want.values())) > 10
    assert got == {k: pytest.approx(v, abs=1e-6) for k, v in want.items()}
    assert spark.sparkContext._jsc.getPersistentRDDs().isEmpty()


def test_sums_of_parts_match_a_loop_over_rows():
    rng = np.random.default_rng(1)
    n, horizon, width = 40, 10, 4
    bins = rng.integers(0, width, size=(3, n)).astype(np.int16)
    hours = np.stack([np.arange(horizon) % width, np.arange(horizon) // 3])
    cells = window_trees.Grid([np.arange(width - 1.0)] * 3, hours, width)
    weights, y = rng.poisson(1.0, (n, horizon)).astype(float), rng.normal(size=(n, horizon))
    parts = [
        window_trees.Part(0, ((0, 1, True), (2, 0, False)), hours[1] <= 1, np.array([0, 2, 4])),
        window_trees.Part(0, (), np.ones(horizon, dtype=bool), np.arange(5)),
    ]
    want = np.zeros((2, 2, 5, width))
    for w in range(n):
        for h in range(horizon):
            row = [*bins[:, w], *hours[:, h]]
            holds = [row[0] <= 1 and row[2] > 0 and row[4] <= 1, True]
            for k, part in enumerate(parts):
                for f in part.features if holds[k] else ():
                    want[:, k, f, row[f]] += weights[w, h], weights[w, h] * y[w, h]
    assert np.allclose(window_trees.part_sums(parts, cells, bins, weights, y), want)


def test_last_contexts_come_with_the_windows(spark):
    df = panel(spark, stations=2).filter("NOT (station_id = 's1' AND t = 210)")  # its last day misses an hour
    rows = features.supervised_windows(df, 24, 6, 24, last=True).collect()
    own = {(r["station_id"], r["start"]): (list(r["x"]), None if r["y"] is None else list(r["y"])) for r in features.supervised_windows(df, 24, 6, 24).collect()}
    assert {k for k in own if k[0] == "s0"} == {("s0", 24 * d) for d in range(8)}
    assert {(r["station_id"], r["start"]): (list(r["x"]), r["y"] and list(r["y"])) for r in rows if r["y"] is not None} == own
    last = [(r["station_id"], r["start"]) for r in rows if r["y"] is None]
    assert last == [("s0", 192)]


def test_forest_is_the_same_however_windows_are_dealt(spark):
    """Draws belong to the window, not to the task; the rows of a resample are of mean and variance 1."""
    df = panel(spark, days=8)
    one, many = (by_hour(forecast.pooled_trees(x, "forest", horizon=30, trees=5, depth=3)) for x in (df.coalesce(1), df.repartition(7, "station_id")))
    assert one == {k: pytest.approx(v, abs=1e-9) for k, v in many.items()}
    counts = window_trees.draws(np.arange(-20, 20), 42, 20, 168)
    assert counts.shape == (20, 40, 168)
    assert counts.mean() == pytest.approx(1, abs=0.02) and counts.var() == pytest.approx(1, abs=0.03)


def test_forest_without_resampling_is_a_tree_of_the_ml_library(spark):
    df = panel(spark)
    want = by_hour(forecast.pooled_regression(df, "random_forest", horizon=30, numTrees=1, maxDepth=4, bootstrap=False))
    got = by_hour(forecast.pooled_trees(df, "boosted", horizon=30, rounds=1, depth=4))
    assert len(set(want.values())) > 5
    assert got == {k: pytest.approx(v, abs=1e-6) for k, v in want.items()}


def test_forest_query_makes_no_row_per_hour(spark, sf, monkeypatch):
    """The ML library keeps a copy of every row with its draws, on disk where memory ends."""
    from pyspark.ml.regression import RandomForestRegressor

    from kpiscope.plans import on_sources

    def refused(self, *_):
        raise AssertionError("rows made")

    monkeypatch.setattr(RandomForestRegressor, "fit", refused)
    out = on_sources.fc_pooled_forest(spark, sf)
    assert out.agg(F.count("pred"), F.countDistinct("station_id", "kpi")).first()[0] % 168 == 0
