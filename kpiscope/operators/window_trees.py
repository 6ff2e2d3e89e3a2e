"""Regression trees on pooled windows of all series: boosted trees and random forests.

A row of training data is a window and an hour ahead. The hours of a window share all features but two, the hour and the hour of
the day, so a node of a tree is a set of windows times a set of hours (a Part) and a model is a list of parts with values. What a
split needs, the sums of a node by feature and bin, follows from sums over the node's hours for each window and over its windows for
each hour: no row is made, and a pass costs a few products of matrices for each batch of windows. Every level of a tree, of all trees for a forest,
is one pass of Spark over the windows; it adds up the sums of all tasks, whose size the parameters fix, and the driver picks the splits.

Method and defaults are those of the ML library's GBTRegressor and RandomForestRegressor (squared error, at most `max_bins` bins a
feature, Poisson weights of rows, a third of the features for each node of a forest). Bins end at quantiles of all windows, where the library takes
10,000 rows. Draws are seeded by window and node, so a repeated task draws the same.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiscope.functions.exprs import SERIES

#: Windows that a task works on at a time.
CHUNK = 2048
#: A gain under this share of the node's own term is rounding; so is a difference between two gains under this share.
ROUNDING = 1e-12
#: Chances of at most 0, 1, ... draws of a row.
POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(11)]).astype(np.float32)


@dataclass(frozen=True)
class Part:
    """A node: the windows that meet all conditions (feature, bin, whether at most this bin), times hours (a mask)."""

    tree: int
    conditions: tuple[tuple[int, int, bool], ...]
    hours: np.ndarray
    features: np.ndarray
    value: float = 0.0

    def windows(self, bins: np.ndarray) -> np.ndarray:
        inside = np.ones(bins.shape[1], dtype=bool)
        for feature, last, low in self.conditions:
            inside &= bins[feature] <= last if low else bins[feature] > last
        return inside


@dataclass(frozen=True)
class Grid:
    """Upper ends of the bins of each window feature, and the bins of each hour in the two hour features."""

    ends: list[np.ndarray]
    hours: np.ndarray
    width: int

    def bins(self, known: np.ndarray) -> np.ndarray:
        """(features, windows)"""
        return np.stack([np.searchsorted(e, known[:, k]).astype(np.int16) for k, e in enumerate(self.ends)])


def grid(windows: DataFrame, features: int, horizon: int, max_bins: int) -> Grid:
    """Bins that end at quantiles of all windows and of the hours."""
    shares = [k / max_bins for k in range(1, max_bins)]
    ends = windows.select(*(F.percentile_approx(F.get("known", F.lit(k)), shares, 10_000) for k in range(features))).first()
    if ends[0] is None:
        raise ValueError("history too short for one training window")
    hours = [np.arange(horizon) % 24, np.arange(horizon)]
    cut = [np.unique(np.quantile(x, shares, method="inverted_cdf")) for x in hours]
    return Grid([np.unique(e) for e in ends], np.stack([np.searchsorted(c, x) for c, x in zip(cut, hours)]), max_bins)


def _matrix(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def predicted(model: list[Part], bins: np.ndarray, horizon: int) -> np.ndarray:
    """(windows, hours): the sum of the values of the parts that hold each."""
    if not model:
        return np.zeros((bins.shape[1], horizon))
    inside = np.stack([p.windows(bins) for p in model]).astype(float)
    return inside.T @ np.stack([p.value * p.hours for p in model])


def draws(ids: np.ndarray, seed: int, trees: int, horizon: int) -> np.ndarray:
    """(trees, windows, hours): how often each tree's resample has each row."""
    by_window = (np.random.default_rng((seed, i % 2**64)).random((trees, horizon), dtype=np.float32) for i in ids.tolist())
    return np.stack([np.searchsorted(POISSON, x).astype(np.int8) for x in by_window], axis=1)


def part_sums(parts: list[Part], cells: Grid, bins: np.ndarray, weights: np.ndarray, target: np.ndarray) -> np.ndarray:
    """(2, parts, features, bins): sums of weights and of weighted targets over the rows of each part, by its own features."""
    known, width = len(bins), cells.width
    out = np.zeros((2, len(parts), known + 2, width))
    inside = np.stack([p.windows(bins) for p in parts])
    hours = np.stack([p.hours for p in parts]).astype(float)
    both = np.stack([weights, weights * target])
    by_window, by_hour = both @ hours.T, inside.astype(float) @ both
    for k, part in enumerate(parts):
        own = part.features[part.features < known]
        at = (bins[own][:, inside[k]] + width * np.arange(len(own))[:, None]).reshape(-1)
        for q in range(2):
            sums = np.bincount(at, np.tile(by_window[q, inside[k], k], len(own)), width * len(own))
            out[q, k, own] = sums.reshape(len(own), width)
            for f in part.features[part.features >= known]:
                out[q, k, f] = np.bincount(cells.hours[f - known], by_hour[q, k] * part.hours, width)
    return out


def all_sums(windows: DataFrame, cells: Grid, parts: list[Part], model: list[Part], slope: float, trees: int, seed: int | None) -> np.ndarray:
    """part_sums over all windows, in one pass. The target is slope times what the model leaves; seed is given where trees resample rows."""
    horizon, shape = cells.hours.shape[1], (2, len(parts), len(cells.ends) + 2, cells.width)
    of_tree = [[k for k, p in enumerate(parts) if p.tree == t] for t in range(trees)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            for start in range(0, batch.num_rows, CHUNK):
                some = batch.slice(start, CHUNK)
                bins = cells.bins(_matrix(some.column("known")))
                target = slope * (_matrix(some.column("y")) - predicted(model, bins, horizon))
                weights = np.ones((trees, *target.shape)) if seed is None else draws(some.column("id").to_numpy(), seed, trees, horizon)
                for own, weight in zip(of_tree, weights):
                    if own:
                        total[:, own] += part_sums([parts[k] for k in own], cells, bins, weight, target)
        place = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_pydict({"place": place, "n": total[0].reshape(-1)[place], "total": total[1].reshape(-1)[place]})

    parts_of_tasks = windows.mapInArrow(run, "place long, n double, total double")
    summed = parts_of_tasks.groupBy("place").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).toArrow()
    out = np.zeros((2, int(np.prod(shape[1:]))))
    out[:, summed["place"].to_numpy()] = summed["n"].to_numpy(), summed["total"].to_numpy()
    return out.reshape(shape)


def split(part: Part, n: np.ndarray, total: np.ndarray, cells: Grid, pick: Callable[[], np.ndarray]) -> list[Part]:
    """The two halves of a part whose squared error falls most, the earliest of equals; only the part itself if none falls."""
    all_n, all_total = (x[part.features[0]].sum() for x in (n, total))
    if not all_n:
        return [part]
    left_n, left = n[part.features].cumsum(axis=1), total[part.features].cumsum(axis=1)
    right_n, right = all_n - left_n, all_total - left
    some = (left_n > 0.5) & (right_n > 0.5)
    gain = np.where(some, left**2 / np.where(some, left_n, 1) + right**2 / np.where(some, right_n, 1) - all_total**2 / all_n, -np.inf)
    best = gain.max()
    if best <= ROUNDING * all_total**2 / all_n:
        return [replace(part, value=all_total / all_n)]
    f, b = np.unravel_index(np.flatnonzero(gain >= best * (1 - 1e-9))[0], gain.shape)
    feature, halves = int(part.features[f]), []
    for low, value in ((True, left[f, b] / left_n[f, b]), (False, right[f, b] / right_n[f, b])):
        half = replace(part, features=pick(), value=value)
        if feature < len(cells.ends):
            half = replace(half, conditions=(*part.conditions, (feature, int(b), low)))
        else:
            half = replace(half, hours=part.hours & ((cells.hours[feature - len(cells.ends)] <= b) == low))
        halves.append(half)
    return halves


def grow(windows: DataFrame, cells: Grid, depth: int, model: list[Part], slope: float = 1.0, trees: int = 1, seed: int | None = None, pick: Callable[[], np.ndarray] | None = None) -> list[Part]:
    """Leaves of trees that are fitted to slope times what the model leaves, level by level."""
    pick = pick or (lambda: np.arange(len(cells.ends) + 2))
    open_ = [Part(t, (), np.ones(cells.hours.shape[1], dtype=bool), pick()) for t in range(trees)]
    leaves = []
    for _ in range(depth):
        sums = all_sums(windows, cells, open_, model, slope, trees, seed)
        found = [split(p, sums[0, k], sums[1, k], cells, pick) for k, p in enumerate(open_)]
        leaves += [x[0] for x in found if len(x) == 1]
        open_ = [half for x in found if len(x) == 2 for half in x]
        if not open_:
            break
    return leaves + open_


def boosted(windows: DataFrame, cells: Grid, rounds: int = 10, depth: int = 4, step: float = 0.1) -> list[Part]:
    """Gradient-boosted trees: the first fits the targets, each further one twice the rest, of which a step is taken."""
    model = grow(windows, cells, depth, [])
    for _ in range(1, rounds):
        model = model + [replace(p, value=step * p.value) for p in grow(windows, cells, depth, model, slope=2.0)]
    return model


def forest(windows: DataFrame, cells: Grid, trees: int = 20, depth: int = 6, seed: int = 42) -> list[Part]:
    """The mean of trees on resampled rows, each node with a third of the features."""
    rng, size = np.random.default_rng(seed), len(cells.ends) + 2
    pick = lambda: np.sort(rng.choice(size, -(-size // 3), replace=False))
    leaves = grow(windows, cells, depth, [], trees=trees, seed=seed, pick=pick)
    return [replace(p, value=p.value / trees) for p in leaves]


LEARNERS: dict[str, Callable[..., list[Part]]] = {"boosted": boosted, "forest": forest}


def fit(windows: DataFrame, kind: str, features: int, horizon: int, max_bins: int = 32, **params) -> tuple[Grid, list[Part]]:
    """Bins and model from windows (id, known, y), a table that the caller keeps while the passes last.

    A pass takes a task for each core: more would cost more in starting Python than in sums.
    """
    if kind not in LEARNERS:
        raise ValueError(f"unknown learner: {kind}")
    cells = grid(windows, features, horizon, max_bins)
    return cells, LEARNERS[kind](windows.coalesce(windows.sparkSession.sparkContext.defaultParallelism), cells, **params)


def predict(now: DataFrame, cells: Grid, model: list[Part]) -> DataFrame:
    """(station_id, kpi, h, pred) from the features of each series' last context (known)."""
    horizon = cells.hours.shape[1]
    kinds = {f.name: f.dataType.simpleString() for f in now.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pred = predicted(model, cells.bins(_matrix(batch.column("known"))), horizon)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(pred.reshape(-1)), horizon).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in SERIES), lists], names=[*SERIES, "pred"])

    schema = ", ".join(f"{k} {kinds[k]}" for k in SERIES) + ", pred array<double>"
    return now.select(*SERIES, "known").mapInArrow(run, schema).select(*SERIES, F.posexplode("pred").alias("h", "pred"))
