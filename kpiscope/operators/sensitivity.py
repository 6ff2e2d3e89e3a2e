"""Cross-KPI sensitivity: perturb one input channel, forecast again, compare forecast means.

Three kinds of forecasters:

* a linear response (`level_response`, `seasonal_response`, or any table of that form): weights (src, tgt, lag, phase, weight) that
  say how far an input hour of one channel moves the forecast of another. Perturbations are sparse deltas or moments of a
  series, and their effect on every channel is a join with the weights and a sum; nothing is forecast twice;
* an array expression over one channel (`expr_window_average` and the like), evaluated inside Spark on whole series;
* a supplied matrix function over all channels, called once per station (`matrix_sensitivity`, a hook for outside models).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kpiscope.functions import labels
from kpiscope.functions.exprs import SERIES, series_window
from kpiscope.operators.features import array_mean

# Perturbation strengths, shape of the local window, lower bound of variance scaling.
SCALES = (-0.10, -0.05, -0.01, 0.01, 0.05, 0.10)
LOCAL_WIDTH = 2
LOCAL_SOFTNESS = 1.0
VARIANCE_FLOOR = -0.95
AMPLITUDE_EPS = 1e-8
PTYPES = ("mean", "variance", "trend")

ExprModel = Callable[[Column], Column]


def series_arrays(inputs: DataFrame) -> DataFrame:
    """(station_id, kpi, x): one ordered array per series."""
    ordered = F.array_sort(F.collect_list(F.struct("t", "value")))
    return inputs.groupBy(*SERIES).agg(F.transform(ordered, lambda s: s["value"]).alias("x"))


def trend_slopes(inputs: DataFrame, window: int | None = None, season: int = 24) -> DataFrame:
    """OLS slope of the moving average per series, over the perturbation window."""
    if window is not None and window < 2 * season:
        raise ValueError("trend perturbation needs a window of two seasons")
    cut = inputs
    if window is not None:
        last = F.max("t").over(Window.partitionBy(*SERIES))
        cut = inputs.withColumn("_last", last).filter(F.col("t") > F.col("_last") - window)
    # a running sum and its value one season ago give every moving mean in one pass over the series
    w = series_window()
    total = cut.withColumn("_sum", F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    moving = total.select(
        *SERIES, "t", ((F.col("_sum") - F.coalesce(F.lag("_sum", season).over(w), F.lit(0.0))) / season).alias("m"),
        F.row_number().over(w).alias("_i"),
    )
    full = moving.filter(F.col("_i") >= season)
    return full.groupBy(*SERIES).agg(F.regr_slope("m", F.col("_i").cast("double")).alias("slope"))


def _scales(scales: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(a)) for a in scales])


def event_centers(events: DataFrame, dim: DataFrame, input_length: int, horizon: int = 168) -> DataFrame:
    """Single-KPI events with the input hour one horizon before their middle."""
    center = F.lit(input_length - horizon) + F.floor((F.col("t_start") + F.col("t_end")) / 2).cast("int")
    return (
        events.filter((F.col("t_start") >= 0) & (F.col("t_end") >= F.col("t_start")))
        .join(dim.select("kpi"), "kpi", "left_semi")
        .withColumn("t_center", center)
        .filter((F.col("t_center") >= 0) & (F.col("t_center") < input_length))
        .select("station_id", "event_idx", "kpi", "t_start", "t_end", "t_center")
    )


def local_envelopes(centers: DataFrame, series: DataFrame, width: int = LOCAL_WIDTH, softness: float = LOCAL_SOFTNESS) -> DataFrame:
    """The few hours around an event centre that a local perturbation changes, on every channel: (.., src, t, lag, envelope).

    Weight = gaussian in time x amplitude ratio to the centre value. lag counts back from the end of the input (1 is its last hour).
    """
    src = series.select("station_id", F.col("kpi").alias("src"), "x")
    fan = centers.join(src, "station_id")
    near = F.filter(
        F.sequence(F.col("t_center") - width, F.col("t_center") + width), lambda i: (i >= 0) & (i < F.size("x"))
    )
    at = fan.select("station_id", "event_idx", F.col("kpi").alias("tgt"), "t_start", "t_end", "src", "t_center", "x", F.explode(near).alias("t"))
    v = F.element_at("x", F.col("t") + 1)
    c = F.element_at("x", F.col("t_center") + 1)
    gauss = F.exp(-softness * F.pow((F.col("t") - F.col("t_center")) / width, 2))
    ratio = F.least(F.abs(v), F.abs(c)) / (F.greatest(F.abs(v), F.abs(c)) + AMPLITUDE_EPS)
    return at.select(
        "station_id", "event_idx", "tgt", "t_start", "t_end", "src", "t", (F.size("x") - F.col("t")).alias("lag"), (gauss * ratio * v).alias("envelope")
    )


def local_deltas(envelopes: DataFrame, scales: Sequence[float] = SCALES) -> DataFrame:
    """Sparse local perturbations of every strength."""
    fan = envelopes.select("station_id", "event_idx", "src", F.explode(_scales(scales)).alias("alpha"), "t", "envelope")
    return fan.withColumn("delta", F.col("alpha") * F.col("envelope")).drop("envelope")


def _tail(x: Column, window: int | None) -> Column:
    """First array index that belongs to the perturbation window."""
    return F.lit(0) if window is None else F.size(x) - window


def mean_shift(x: Column, alpha: Column, mu: Column, window: int | None = None) -> Column:
    start = _tail(x, window)
    return F.transform(x, lambda v, i: F.when(i >= start, v + alpha * mu).otherwise(v))


def variance_scale(x: Column, alpha: Column, mu: Column, window: int | None = None) -> Column:
    start = _tail(x, window)
    return F.transform(x, lambda v, i: F.when(i >= start, (v - mu) * F.sqrt(alpha + 1) + mu).otherwise(v))


def trend_tilt(x: Column, alpha: Column, slope: Column, window: int | None = None) -> Column:
    """Tilt by alpha times the size of the slope, so positive alpha always pushes upward."""
    start = _tail(x, window)
    return F.transform(x, lambda v, i: F.when(i >= start, v + alpha * F.abs(slope) * (i - start)).otherwise(v))


def variants(series: DataFrame, slopes: DataFrame, scales: Sequence[float] = SCALES, window: int | None = None) -> DataFrame:
    """Channel-wide perturbed copies: (station_id, kpi, ptype, alpha, x, y)."""
    if min(scales) <= VARIANCE_FLOOR:
        raise ValueError("variance scale would fold through zero")
    x, alpha = F.col("x"), F.col("alpha")
    recent = x if window is None else F.slice(x, -window, window)
    y = (
        F.when(F.col("ptype") == "mean", mean_shift(x, alpha, F.col("mu"), window))
        .when(F.col("ptype") == "variance", variance_scale(x, alpha, F.col("mu"), window))
        .otherwise(trend_tilt(x, alpha, F.col("slope"), window))
    )
    return (
        series.join(slopes, list(SERIES))
        .withColumn("mu", array_mean(recent))
        .withColumn("ptype", F.explode(F.array(*[F.lit(p) for p in PTYPES])))
        .withColumn("alpha", F.explode(_scales(scales)))
        .withColumn("y", y)
        .select(*SERIES, "ptype", "alpha", "mu", "slope", "x", "y")
    )


# Array-expression forecasters of one channel.


def expr_window_average(window: int, horizon: int = 168) -> ExprModel:
    def model(x: Column) -> Column:
        return F.array_repeat(array_mean(F.slice(x, F.greatest(F.size(x) - window, F.lit(0)) + 1, F.lit(window))), horizon)

    return model


def expr_historic_average(horizon: int = 168) -> ExprModel:
    return lambda x: F.array_repeat(array_mean(x), horizon)


def expr_seasonal_naive(season: int = 24, horizon: int = 168) -> ExprModel:
    def model(x: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.lit(horizon - 1)), lambda h: F.element_at(x, F.size(x) - season + 1 + h % season)
        )

    return model


def fanout_forecast(perturbed: DataFrame, model: ExprModel) -> DataFrame:
    """Forecast of every perturbed channel beside the forecast of the untouched one."""
    return perturbed.withColumn("base", model(F.col("x"))).withColumn("pred", model(F.col("y"))).drop("x", "y")


# Linear responses.


def level_response(weights: DataFrame, window: int) -> DataFrame:
    """Response of a model whose forecast is level: weights (src, tgt, weight) of the mean of the last `window` hours."""
    lags = F.explode(F.sequence(F.lit(1), F.lit(window))).alias("lag")
    return weights.select("src", "tgt", lags, F.lit(0).alias("phase"), (F.col("weight") / window).alias("weight"))


def seasonal_response(weights: DataFrame, season: int = 24) -> DataFrame:
    """Response of a model that repeats the last season: hour h takes the hour of the same phase."""
    phases = weights.select("src", "tgt", "weight", F.explode(F.sequence(F.lit(0), F.lit(season - 1))).alias("phase"))
    return phases.select("src", "tgt", (season - F.col("phase")).alias("lag"), "phase", "weight")


def phase_share(t_start: Column, t_end: Column, phase: Column, period: int) -> Column:
    """Share of the forecast hours t_start..t_end that have a phase."""
    upto = lambda t: F.floor((t - phase) / period)
    return (upto(t_end) - upto(t_start - 1)) / (t_end - t_start + 1)


def push_size(scales: Sequence[float]) -> float:
    """Mean over the scales of the change per unit, signed by the direction of the push, of what grows with the scale."""
    return sum(abs(a) for a in scales) / len(scales)


def stretch_size(scales: Sequence[float]) -> float:
    """The same of a deviation stretched by sqrt(1 + scale)."""
    if min(scales) <= VARIANCE_FLOOR:
        raise ValueError("variance scale would fold through zero")
    return sum((1 if a > 0 else -1 if a < 0 else 0) * ((1 + a) ** 0.5 - 1) for a in scales) / len(scales)


def response_moments(inputs: DataFrame, slopes: DataFrame, response: DataFrame, horizon: int = 168, period: int = 1, window: int | None = None) -> DataFrame:
    """(station_id, src, tgt, w_level, w_time, w_value, mu, slope): the response's weights over a series, summed plainly, times the
    hour and times the value; with mean and slope of the perturbation window.

    Hours of the window meet the weights on (source, lag): a response reaches back a fixed number of hours, so a series of any
    length brings only these, and partial sums leave the tasks.
    """
    last = F.max("t").over(Window.partitionBy(*SERIES))
    aged = inputs.withColumn("lag", last - F.col("t") + 1)
    recent = aged if window is None else aged.filter(F.col("lag") <= window)
    whole = Window.partitionBy(*SERIES)
    hours = recent.select("station_id", F.col("kpi").alias("src"), "lag", "value", F.avg("value").over(whole).alias("mu"), F.row_number().over(series_window()).alias("i"))
    share = phase_share(F.lit(0), F.lit(horizon - 1), F.col("phase"), period)
    met = hours.join(response.select("src", "tgt", "lag", (F.col("weight") * share).alias("w")), ["src", "lag"])
    sums = met.groupBy("station_id", "src", "tgt").agg(
        F.sum("w").alias("w_level"), F.sum(F.col("w") * (F.col("i") - 1)).alias("w_time"), F.sum(F.col("w") * F.col("value")).alias("w_value"), F.first("mu").alias("mu")
    )
    return sums.join(slopes.withColumnRenamed("kpi", "src"), ["station_id", "src"])


def _units() -> dict[str, Column]:
    """Change of the forecast mean per unit of each perturbation."""
    return {
        "mean": F.col("mu") * F.col("w_level"),
        "variance": F.col("w_value") - F.col("mu") * F.col("w_level"),
        "trend": F.abs("slope") * F.col("w_time"),
    }


def fanout_response(moments: DataFrame, scales: Sequence[float] = SCALES) -> DataFrame:
    """(station_id, src, tgt, ptype, alpha, base_mean, pred_mean): forecast mean of every channel under every perturbation."""
    base = moments.groupBy("station_id", "tgt").agg(F.sum("w_value").alias("base_mean"))
    units = _units()
    kinds = F.array(*[F.struct(F.lit(p).alias("ptype"), units[p].alias("unit")) for p in PTYPES])
    fan = moments.select("station_id", "src", "tgt", F.inline(kinds)).withColumn("alpha", F.explode(_scales(scales)))
    step = F.when(F.col("ptype") == "variance", F.sqrt(1 + F.col("alpha")) - 1).otherwise(F.col("alpha"))
    moved = fan.withColumn("change", step * F.col("unit")).join(base, ["station_id", "tgt"])
    return moved.select("station_id", "src", "tgt", "ptype", "alpha", "base_mean", (F.col("base_mean") + F.col("change")).alias("pred_mean"))


def global_sensitivity(moments: DataFrame, scales: Sequence[float] = SCALES) -> DataFrame:
    """(station_id, src, tgt, ptype, s_raw): effect of every channel on every one it reaches, in closed form."""
    size = {p: stretch_size(scales) if p == "variance" else push_size(scales) for p in PTYPES}
    units = _units()
    cells = F.array(*[F.struct(F.lit(p).alias("ptype"), (size[p] * units[p]).alias("s_raw")) for p in PTYPES])
    return moments.select("station_id", "src", "tgt", F.inline(cells))


def local_sensitivity(envelopes: DataFrame, response: DataFrame, period: int = 1, scales: Sequence[float] = SCALES) -> DataFrame:
    """(station_id, event_idx, tgt, src, s_raw): effect of every channel on the event's KPI inside the event window.

    A delta meets the weights that lead from its channel to the event's KPI on (source, target, lag). The response is linear, so
    the scales only multiply the sum.
    """
    share = phase_share(F.col("t_start"), F.col("t_end"), F.col("phase"), period)
    met = envelopes.join(response, ["src", "tgt", "lag"], "left")
    effect = F.coalesce(F.sum(F.col("envelope") * F.col("weight") * share), F.lit(0.0))  # no delta in reach, no effect
    return met.groupBy("station_id", "event_idx", "tgt", "src").agg((push_size(scales) * effect).alias("s_raw"))


def matrix_sensitivity(
    inputs: DataFrame, kpis: Sequence[str], model: Callable, scales: Sequence[float] = SCALES, window: int | None = None
) -> DataFrame:
    """Global sensitivity of a supplied model over all channels: matrix (L, C) -> matrix (H, C).

    A hook for models outside of Spark: it groups one station per call; the perturbed copies are those of `variants`, written for a
    matrix. Output (station_id, src, tgt, ptype, s_raw).
    """
    names = list(kpis)
    station_type = inputs.schema["station_id"].dataType.simpleString()

    def station(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot(index="t", columns="kpi", values="value").sort_index()
        x = wide.reindex(columns=names).to_numpy()
        if not np.isfinite(x).all():
            raise ValueError("station has missing hours or KPIs")
        n = len(x) if window is None else window
        base = model(x).mean(axis=0)
        part = x[-n:]
        smooth = np.stack([np.convolve(c, np.ones(24) / 24, mode="valid") for c in part.T], axis=1)
        slope = np.polyfit(np.arange(len(smooth)), smooth, 1)[0]
        out = []
        for s, name in enumerate(names):
            col, mu = part[:, s], part[:, s].mean()
            pushed = {
                "mean": lambda a: col + a * mu,
                "variance": lambda a: (col - mu) * np.sqrt(a + 1) + mu,
                "trend": lambda a: col + a * abs(slope[s]) * np.arange(n),
            }
            for ptype in PTYPES:
                total = np.zeros(len(names))
                for a in scales:
                    y = x.copy()
                    y[-n:, s] = pushed[ptype](a)
                    total += np.sign(a) * (model(y).mean(axis=0) - base)
                out += [(pdf["station_id"].iloc[0], name, t, ptype, v) for t, v in zip(names, total / len(scales))]
        return pd.DataFrame(out, columns=["station_id", "src", "tgt", "ptype", "s_raw"])

    schema = f"station_id {station_type}, src string, tgt string, ptype string, s_raw double"
    return inputs.select("station_id", "kpi", "t", "value").groupBy("station_id").applyInPandas(station, schema)


def normalize(sens: DataFrame, dim: DataFrame) -> DataFrame:
    """Scale by cap of source over cap of target and name the size."""
    caps = dim.select("kpi", "cap")
    src = caps.select(F.col("kpi").alias("src"), F.col("cap").alias("_cs"))
    tgt = caps.select(F.col("kpi").alias("tgt"), F.col("cap").alias("_ct"))
    return (
        sens.join(src, "src")
        .join(tgt, "tgt")
        .withColumn("s_norm", F.col("s_raw") * F.col("_cs") / F.col("_ct"))
        .drop("_cs", "_ct")
        .withColumn("magnitude", labels.sensitivity_magnitude("s_norm"))
    )


def topk_pairs(sens: DataFrame, dim: DataFrame, k: int = 5, target: str | None = None, ptype: str | None = None) -> DataFrame:
    """Strongest off-diagonal cells per station; catalogue order breaks ties (ten digits: beyond is summation noise)."""
    rows = sens.filter("src <> tgt")
    if target is not None:
        rows = rows.filter(F.col("tgt") == target)
    if ptype is not None:
        rows = rows.filter(F.col("ptype") == ptype)
    ords = dim.select("kpi", "ord")
    rows = rows.join(ords.select(F.col("kpi").alias("src"), F.col("ord").alias("_so")), "src").join(
        ords.select(F.col("kpi").alias("tgt"), F.col("ord").alias("_to")), "tgt"
    )
    place = F.array_position(F.array(*[F.lit(p) for p in PTYPES]), F.col("ptype"))
    w = Window.partitionBy("station_id").orderBy(F.round(F.abs("s_norm"), 10).desc(), "_so", "_to", place)
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).drop("_so", "_to")


def grid(sens: DataFrame, kpis: Sequence[str], value: str = "s_norm") -> DataFrame:
    """Source rows, target columns: largest absolute cell over the perturbation types, zero diagonal."""
    size = F.when(F.col("src") == F.col("tgt"), 0.0).otherwise(F.abs(value))
    return sens.groupBy("station_id", "src").agg(
        *[F.coalesce(F.max(F.when(F.col("tgt") == k, size)), F.lit(0.0)).alias(k) for k in kpis]
    )


def local_topk(local: DataFrame, dim: DataFrame, k: int = 3) -> DataFrame:
    """Strongest sources per event; events without any effect are left out."""
    ords = dim.select(F.col("kpi").alias("src"), F.col("ord").alias("_so"))
    any_effect = F.max(F.abs("s_norm")).over(Window.partitionBy("station_id", "event_idx")) > 0
    w = Window.partitionBy("station_id", "event_idx").orderBy(F.round(F.abs("s_norm"), 10).desc(), "_so")
    return (
        local.join(ords, "src")
        .withColumn("_any", any_effect)
        .filter("_any")
        .withColumn("rank", F.row_number().over(w))
        .filter(F.col("rank") <= k)
        .drop("_any", "_so")
    )


def summary(events: DataFrame, centers: DataFrame, dim: DataFrame, n_scales: int = len(SCALES)) -> DataFrame:
    """Per station: events, centres inside the input, and number of perturbed forecasts."""
    channels = dim.count()  # catalogue size
    n = events.groupBy("station_id").agg(F.count("*").alias("n_events"))
    c = centers.groupBy("station_id").agg(F.count("*").alias("n_centers"))
    out = n.join(c, "station_id", "left").withColumn("n_centers", F.coalesce("n_centers", F.lit(0)).cast("long"))
    wide = channels * n_scales * len(PTYPES)
    return out.withColumn("n_perturbations", F.lit(wide) + F.col("n_centers") * channels * n_scales)


def flatten(global_sens: DataFrame, local_sens: DataFrame) -> DataFrame:
    """Both tables below each other; diagonal cells of the global one are left out."""
    g = global_sens.filter("src <> tgt").withColumn("scope", F.lit("global"))
    return g.unionByName(local_sens.withColumn("scope", F.lit("local")), allowMissingColumns=True)
