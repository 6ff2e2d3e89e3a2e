"""Forecasters that Spark computes for all series at once, and the hook for supplied models.

Every forecaster takes the input panel (station_id, kpi, t, value) and returns
(station_id, kpi, h, pred). Extra key columns (run, context, perturbation) pass through `keys`.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kpiscope.functions.exprs import SERIES, col, horizon_steps, require
from kpiscope.operators.features import lag_features, supervised_windows
from kpiscope.session import cut_lineage


def _level(values: DataFrame, horizon: int, keys: tuple[str, ...]) -> DataFrame:
    return horizon_steps(values, horizon).select(*keys, "h", "pred")


def naive(inputs: DataFrame, horizon: int = 168, keys: tuple[str, ...] = SERIES) -> DataFrame:
    """Repeat the last value."""
    return _level(inputs.groupBy(*keys).agg(F.max_by("value", "t").alias("pred")), horizon, keys)


def historic_average(inputs: DataFrame, horizon: int = 168, keys: tuple[str, ...] = SERIES) -> DataFrame:
    """Mean of the whole history."""
    return _level(inputs.groupBy(*keys).agg(F.avg("value").alias("pred")), horizon, keys)


def window_average(inputs: DataFrame, window: int = 24, horizon: int = 168, keys: tuple[str, ...] = SERIES) -> DataFrame:
    """Mean of the last hours."""
    last = F.max("t").over(Window.partitionBy(*keys))
    recent = inputs.withColumn("_last", last).filter(F.col("t") > F.col("_last") - window)
    return historic_average(recent, horizon, keys)


def seasonal_naive(inputs: DataFrame, horizon: int = 168, season: int = 24, keys: tuple[str, ...] = SERIES) -> DataFrame:
    """Tile the last season over the horizon.

    Each hour of that season generates its own repeats, so no join is needed and the rows stay
    where the window over the series put them.
    """
    last = F.max("t").over(Window.partitionBy(*keys))
    phase = F.col("t") - F.col("_last") + (season - 1)
    recent = inputs.withColumn("_last", last).withColumn("_phase", phase)
    recent = recent.filter((F.col("_phase") >= 0) & (F.col("_phase") < horizon))
    return recent.select(
        *keys,
        F.explode(F.sequence("_phase", F.lit(horizon - 1), F.lit(season))).alias("h"),
        F.col("value").alias("pred"),
    )


FORECASTERS: dict[str, Callable[..., DataFrame]] = {
    "naive": naive,
    "historic_average": historic_average,
    "window_average": window_average,
    "seasonal_naive": seasonal_naive,
}


def sample_median(samples: DataFrame, style: str = "lower", keys: tuple[str, ...] = (*SERIES, "h")) -> DataFrame:
    """Reduce sampled forecasts (keys, sample, pred) to one value per hour.

    "lower" takes the lower middle sample, "mean" averages the two middle ones.
    """
    if style == "lower":
        agg: Column = F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY pred)")
    elif style == "mean":
        agg = F.median("pred")
    else:
        raise ValueError(f"unknown median style: {style}")
    return samples.groupBy(*keys).agg(agg.alias("pred"))


def external(inputs: DataFrame, model: Callable, horizon: int = 168, keys: tuple[str, ...] = SERIES, check: bool = True) -> DataFrame:
    """Score every series with a supplied function of one numpy history -> numpy forecast.

    Spark groups the series; each call sees one series. Wrong length or non-finite output fails
    the job, as a silent gap would corrupt every metric downstream.
    """
    names = list(keys)

    def score(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        history = pdf.sort_values("t")["value"].to_numpy()
        pred = np.asarray(model(history, horizon), dtype=float)
        if check and pred.shape != (horizon,):
            raise ValueError(f"model returned shape {pred.shape}, expected ({horizon},)")
        if check and not np.isfinite(pred).all():
            raise ValueError("model returned non-finite values")
        out = pd.DataFrame({n: [k] * len(pred) for n, k in zip(names, key)})
        out["h"] = np.arange(len(pred), dtype="int32")
        out["pred"] = pred
        return out

    types = {f.name: f.dataType.simpleString() for f in inputs.schema.fields}
    schema = ", ".join(f"{n} {types[n]}" for n in names) + ", h int, pred double"
    return inputs.select(*names, "t", "value").groupBy(*names).applyInPandas(score, schema)


def evaluation_histories(panel: DataFrame, train_end: int, val_end: int) -> DataFrame:
    """Histories of both evaluations: val sees train, test sees train + val."""
    both = F.when(F.col("t") < train_end, F.array(F.lit("val"), F.lit("test"))).when(
        F.col("t") < val_end, F.array(F.lit("test"))
    )
    return panel.withColumn("_s", both).select(F.explode("_s").alias("split"), *SERIES, "t", "value")


def evaluation_truth(panel: DataFrame, train_end: int, val_end: int, horizon: int) -> DataFrame:
    """First `horizon` hours after each history."""
    split = F.when((F.col("t") >= train_end) & (F.col("t") < val_end), "val").when(F.col("t") >= val_end, "test")
    start = F.when(split == "val", F.lit(train_end)).otherwise(F.lit(val_end))
    return (
        panel.withColumn("split", split)
        .withColumn("h", F.col("t") - start)
        .filter(F.col("split").isNotNull() & (F.col("h") < horizon))
        .select("split", *SERIES, "h", F.col("value").alias("truth"))
    )


def _known(windows: DataFrame) -> DataFrame:
    """Windows with the features that all hours ahead share as one array."""
    whole = require(lag_features(windows), ~F.isnan("x_mean"), "window with a missing value")
    return whole.withColumn("known", F.concat("x", F.array("x_mean", "x_std", "x_last"))).drop("x", "x_mean", "x_std", "x_last")


def pooled_regression(
    inputs: DataFrame,
    kind: str = "random_forest",
    horizon: int = 168,
    context_h: int = 24,
    stride_h: int = 24,
    **params,
) -> DataFrame:
    """Learners of the ML library on pooled windows of all series, horizon hour as a feature.

    kinds: ridge, lasso, elasticnet, random_forest, gbt. Every window yields one training row per
    hour ahead; the learners aggregate their statistics over partitions. Learners pass over the rows several times: what
    the hours of a window share is one array, made once and kept while the model is fitted; the rows are made anew in each pass.
    """
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor

    makers = {
        "ridge": lambda **p: LinearRegression(elasticNetParam=0.0, **{"regParam": 1.0, **p}),
        "lasso": lambda **p: LinearRegression(elasticNetParam=1.0, **{"regParam": 0.1, **p}),
        "elasticnet": lambda **p: LinearRegression(elasticNetParam=0.5, **{"regParam": 0.1, **p}),
        "random_forest": lambda **p: RandomForestRegressor(**{"numTrees": 20, "maxDepth": 6, "seed": 42, **p}),
        "gbt": lambda **p: GBTRegressor(**{"maxIter": 10, "maxDepth": 4, "seed": 42, **p}),
    }
    if kind not in makers:
        raise ValueError(f"unknown learner: {kind}")

    def assembled(rows: DataFrame) -> DataFrame:
        hour = F.array((F.col("h") % 24).cast("double"), F.col("h").cast("double"))
        return rows.withColumn("features", array_to_vector(F.concat("known", hour)))

    train = _known(supervised_windows(inputs, context_h, horizon, stride_h)).select("known", "y").persist(StorageLevel.MEMORY_AND_DISK)
    rows = train.select("known", F.posexplode("y").alias("h", "label"))
    try:
        model = makers[kind](featuresCol="features", labelCol="label", predictionCol="pred", **params).fit(assembled(rows))
    finally:
        train.unpersist()
    last = F.max("t").over(Window.partitionBy(*SERIES))
    tail = inputs.withColumn("_last", last).filter(F.col("t") > F.col("_last") - context_h).drop("_last")
    now = _known(supervised_windows(tail, context_h, 0, 1))
    return model.transform(assembled(horizon_steps(now, horizon))).select(*SERIES, "h", "pred")


def pooled_trees(inputs: DataFrame, kind: str = "forest", horizon: int = 168, context_h: int = 24, stride_h: int = 24, **params) -> DataFrame:
    """Trees on the rows of pooled_regression, fitted without making them: see window_trees. kinds: forest, boosted.

    Windows and last contexts come from one pass over the panel; they are kept until the model is fitted, and the contexts are
    written then.
    """
    from kpiscope.operators import window_trees

    windows = _known(supervised_windows(inputs, context_h, horizon, stride_h, last=True))
    kept = windows.select(*SERIES, F.xxhash64(*SERIES, "start").alias("id"), "known", "y").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        cells, model = window_trees.fit(kept.filter("y is not null").select("id", "known", "y"), kind, context_h + 3, horizon, **params)
        now = cut_lineage(kept.filter("y is null").select(*SERIES, "known"))
    finally:
        kept.unpersist()
    return window_trees.predict(now, cells, model)
