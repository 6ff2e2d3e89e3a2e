"""Linear lag models per station from sufficient statistics.

A model forecasts every hour of the horizon and every channel from the flattened context over all channels with mean, deviation
and last value of each. A window of training data is never a row and a station's windows never meet: hours are dealt to
pieces of a station's time axis (a piece also holds the hours that its last windows reach into), each piece is reduced in its task to sums of
features, targets and their products, and these sums, a size that the features fix, are added by station. A piece of few windows sends its
hours, which are less than its sums. The coefficients
come from the sums: a linear system for ridge, a search over sets of coefficients for lasso, Newton steps on the residuals for elastic net.

A station with any missing hour or channel, or too short for one window, fails the job with a message, as a silent gap
would corrupt every metric downstream.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KINDS = ("ridge", "lasso", "elasticnet")
SUMS = ("sx", "sy", "sxx", "sxy")
#: Hours of a piece; longer histories are spread over more tasks.
PIECE_HOURS = 1344
#: A coefficient joins a model if its slope would move its feature by more than this share of the targets' mean level.
TOLERANCE, MOST_STEPS, MOST_HALVINGS = 1e-7, 100_000, 30
#: Share of the largest sum that counts as rounding.
ROUNDING = 1e-9


def features(windows: np.ndarray) -> np.ndarray:
    """(n, hours, channels) -> (n, features): all lags, then mean, deviation and last value of each channel."""
    return np.concatenate([windows.reshape(len(windows), -1), windows.mean(axis=1), windows.std(axis=1), windows[:, -1]], axis=1)


def pieces(inputs: DataFrame, reach: int, piece_h: int = PIECE_HOURS) -> DataFrame:
    """(station_id, piece, kpi, t, value, last): every hour in each piece that has a window over it."""
    first = F.greatest(F.lit(0), F.floor((F.col("t") - reach + 1) / piece_h)).cast("int")
    last = F.max("t").over(Window.partitionBy("station_id"))
    aged = inputs.select("station_id", "kpi", "t", "value", last.alias("last"))
    return aged.select("station_id", F.explode(F.sequence(first, F.floor(F.col("t") / piece_h).cast("int"))).alias("piece"), "kpi", "t", "value", "last")


def _sums(x: np.ndarray, at: np.ndarray, context_h: int, reach: int) -> tuple[np.ndarray, ...]:
    """Sums over the windows that begin at these hours: features, targets, products of features, of features and targets."""
    a = features(np.stack([x[s : s + context_h] for s in at]))
    y = np.stack([x[s + context_h : s + reach].reshape(-1) for s in at])
    return a.sum(axis=0), y.sum(axis=0), a.T @ a, a.T @ y


def statistics(inputs: DataFrame, kpis: Sequence[str], horizon: int, context_h: int, stride_h: int, piece_h: int = PIECE_HOURS) -> DataFrame:
    """What each piece adds to its station: n windows, and as packed doubles sx, sy, sxx, sxy; now holds the features of the station's last context.

    Sums of fewer windows than features are larger than the hours behind them: such a piece sends its hours instead, with the first window's place.
    t counts from 0 without gaps.
    """
    names, reach = list(kpis), context_h + horizon
    station_type = inputs.schema["station_id"].dataType.simpleString()

    def reduced(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot(index="t", columns="kpi", values="value").sort_index().reindex(columns=names)
        x, start, last = wide.to_numpy(), int(wide.index[0]), int(pdf["last"].iloc[0])
        if not np.isfinite(x).all() or len(x) != wide.index[-1] - start + 1:
            raise ValueError("station has missing hours or KPIs")
        begin = int(pdf["piece"].iloc[0]) * piece_h
        own = range(-(-begin // stride_h) * stride_h, min(begin + piece_h, last - reach + 2), stride_h)
        edge = last + 1 - context_h
        now = features(x[None, edge - start : edge - start + context_h])[0].tobytes() if begin <= edge < begin + piece_h else None
        row = {"station_id": pdf["station_id"].iloc[0], "n": len(own), "now": now, "hours": None, "first": 0} | dict.fromkeys(SUMS)
        if len(own) >= len(names) * (context_h + 3):
            sums = _sums(x, np.array(own, dtype=int) - start, context_h, reach)
            row |= {k: v.tobytes() for k, v in zip(SUMS, sums)}
        elif len(own):
            row |= {"hours": np.ascontiguousarray(x).tobytes(), "first": own[0] - start}
        return pd.DataFrame([row])

    schema = f"station_id {station_type}, n long, now binary, hours binary, first long, " + ", ".join(f"{k} binary" for k in SUMS)
    return pieces(inputs, reach, piece_h).groupBy("station_id", "piece").applyInPandas(reduced, schema)


def coefficients(sxx: np.ndarray, sxy: np.ndarray, n: int, level: np.ndarray, kind: str, alpha: float, l1_ratio: float) -> np.ndarray:
    """Coefficients (features x targets) from centred sums of products; level is the mean size of each target.

    ridge: least squares plus alpha times their squares. lasso and elasticnet: half the mean squared error plus alpha times
    (l1_ratio times their absolute values plus half of 1 - l1_ratio times their squares).
    """
    if kind == "ridge":
        return np.linalg.solve(sxx + alpha * np.eye(len(sxx)), sxy)
    return _penalised(sxx / n, sxy / n, alpha * l1_ratio, alpha * (1 - l1_ratio), level)


def _penalised(gram: np.ndarray, rhs: np.ndarray, l1: float, l2: float, level: np.ndarray) -> np.ndarray:
    """The minimum with penalties, for all targets at once: _with_squares if l2 is more than rounding, else by feature-sign search.

    Each target has a set of coefficients with signs. A step goes to the minimum over that set, or as far as the first
    coefficient that would change its sign, which leaves the set. At the minimum of its set, a target takes in the coefficient that
    improves it most (the earliest of equals); it is done when there is none. Every step lowers the target's loss.
    """
    features, targets = rhs.shape
    size = np.diag(gram)
    if not size.any():
        return np.zeros_like(rhs)
    squares, l2 = l2 > ROUNDING * size.max(), l2 + ROUNDING * size.max() / 10  # more features than windows: keeps a set of dependent features solvable
    values, axes = np.linalg.eigh(gram)
    some = values > ROUNDING / 1000 * values[-1]
    roots = axes[:, some] * np.sqrt(values[some])  # gram = roots @ roots.T
    if squares:
        return _with_squares(roots, values[some], rhs.T @ axes[:, some] / np.sqrt(values[some]), l1, l2)
    noise = ROUNDING * np.abs(rhs).max()
    least = np.maximum(noise, TOLERANCE * level[:, None] * np.sqrt(size))
    out, signs = np.zeros((targets, features)), np.zeros((targets, features))
    at_minimum, todo = np.ones(targets, dtype=bool), np.arange(targets)
    for _ in range(MOST_STEPS):
        b, sign = out[todo], signs[todo]
        slope = rhs.T[todo] - b @ gram - l2 * b
        gain = np.where((sign == 0) & (size > 0), np.abs(slope) - l1, -np.inf)
        ready = at_minimum[todo]
        done = ready & (gain <= least[todo]).all(axis=1)
        joins = np.flatnonzero(ready & ~done)
        gain = np.where(gain > least[todo], gain, -np.inf)
        j = (gain >= gain.max(axis=1, keepdims=True) - noise).argmax(axis=1)[joins]
        sign[joins, j] = np.sign(slope[joins, j])
        todo, b, sign, slope = todo[~done], b[~done], sign[~done], slope[~done]
        if not len(todo):
            return out.T
        step = _face_step(gram, roots, l2, sign != 0, slope - l1 * sign)
        cross = (sign != 0) & ((b + step) * sign < 0)
        share = np.where(cross, -b / np.where(cross, step, 1.0), 1.0)
        most = np.clip(share.min(axis=1, keepdims=True), 0.0, 1.0)
        leaves = cross & (share <= most)
        out[todo] = np.where(leaves, 0.0, b + most * step)
        signs[todo] = np.where(leaves, 0.0, sign)
        at_minimum[todo] = ~leaves.any(axis=1)
    raise ValueError("no minimum found")


def _with_squares(roots: np.ndarray, values: np.ndarray, aim: np.ndarray, l1: float, l2: float) -> np.ndarray:
    """The minimum if the penalty has squares, by Newton steps on each target's residuals (targets x rank, in the space of the roots).

    At the minimum b is what pull = roots @ residuals has beyond l1, divided by l2, and residuals = aim - roots.T @ b. These are the only zero
    of the gradient of |residuals|^2 / 2 + |beyond|^2 / (2 * l2) - aim @ residuals, which is quadratic as long as the same pulls are beyond l1. A step
    goes to the minimum of the quadratic, which is the end if it keeps that set, or is halved until the function falls. The first residuals are those of ridge.
    """
    targets, rank = aim.shape
    products = (roots[:, :, None] * roots[:, None, :]).reshape(len(roots), -1) / l2
    held, todo = aim / (1 + values / l2), np.arange(targets)

    def beyond(residuals: np.ndarray) -> np.ndarray:
        pull = residuals @ roots.T
        return pull - np.clip(pull, -l1, l1)

    def size(residuals: np.ndarray, own: np.ndarray) -> np.ndarray:
        return (residuals**2 / 2 - aim[own] * residuals).sum(axis=1) + (beyond(residuals) ** 2).sum(axis=1) / (2 * l2)

    for _ in range(MOST_STEPS):
        now = held[todo]
        out = beyond(now)
        sign = np.sign(out)
        inner = (np.abs(sign) @ products).reshape(-1, rank, rank) + np.eye(rank)
        step = np.linalg.solve(inner, (aim[todo] + l1 / l2 * sign @ roots)[:, :, None])[:, :, 0] - now
        fall = ((now + out @ roots / l2 - aim[todo]) * step).sum(axis=1)
        same = (np.sign(beyond(now + step)) == sign).all(axis=1)
        before, share, open_ = size(now, todo), np.ones(len(todo)), np.flatnonzero(~same)
        for _ in range(MOST_HALVINGS):
            after = size(now[open_] + share[open_, None] * step[open_], todo[open_])
            open_ = open_[after > before[open_] + 1e-4 * share[open_] * fall[open_]]
            if not len(open_):
                break
            share[open_] /= 2
        share[open_] = 1.0  # what the function falls by is rounding
        held[todo] = now + share[:, None] * step
        todo = todo[~same & (fall < -ROUNDING / 1000 * np.abs(before))]
        if not len(todo):
            return (beyond(held) / l2).T
    raise ValueError("no minimum found")


def _face_step(gram: np.ndarray, roots: np.ndarray, l2: float, on: np.ndarray, pull: np.ndarray) -> np.ndarray:
    """Steps (targets x features) to the minimum over each target's own features, zero elsewhere; the smaller system of features or rank is solved."""
    most, rank = int(on.sum(axis=1).max()), roots.shape[1]
    pull = np.where(on, pull, 0.0)
    if most > rank:
        products = (roots[:, :, None] * roots[:, None, :]).reshape(len(gram), -1)
        inner = (on @ products).reshape(-1, rank, rank) + l2 * np.eye(rank)
        return np.where(on, pull - np.linalg.solve(inner, (pull @ roots)[:, :, None])[:, :, 0] @ roots.T, 0.0) / l2
    own = np.argsort(~on, axis=1, kind="stable")[:, :most]
    used = np.take_along_axis(on, own, axis=1)
    system = gram[own[:, :, None], own[:, None, :]] * (used[:, :, None] & used[:, None, :])
    system[:, np.arange(most), np.arange(most)] += np.where(used, l2, 1.0)
    step = np.zeros_like(pull)
    np.put_along_axis(step, own, np.linalg.solve(system, np.take_along_axis(pull, own, axis=1)[:, :, None])[:, :, 0], axis=1)
    return step


def lag_regression(
    inputs: DataFrame,
    kpis: Sequence[str],
    kind: str = "ridge",
    horizon: int = 168,
    context_h: int = 24,
    stride_h: int = 24,
    alpha: float = 1.0,
    l1_ratio: float = 0.5,
    piece_h: int = PIECE_HOURS,
) -> DataFrame:
    """Direct forecasts (station_id, kpi, h, pred) of one linear model per station, hour and channel."""
    if kind not in KINDS:
        raise ValueError(f"unknown learner: {kind}")
    if context_h > 72:
        raise ValueError("linear lag models take 72 hours of context at most: their sums grow with its square")
    names = list(kpis)
    share = {"lasso": 1.0}.get(kind, l1_ratio)
    station_type = inputs.schema["station_id"].dataType.simpleString()

    def solved(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["n"].sum())
        if not n:
            raise ValueError("history too short for one training window")
        width, height = len(names) * (context_h + 3), len(names) * horizon
        sx, sy, sxx, sxy = (np.zeros(s) for s in (width, height, (width, width), (width, height)))
        for piece in pdf[pdf["n"] > 0].itertuples():
            if piece.hours is None:
                adds = [np.frombuffer(getattr(piece, k)).reshape(total.shape) for k, total in zip(SUMS, (sx, sy, sxx, sxy))]
            else:
                at = piece.first + stride_h * np.arange(piece.n)
                adds = _sums(np.frombuffer(piece.hours).reshape(-1, len(names)), at, context_h, context_h + horizon)
            for total, more in zip((sx, sy, sxx, sxy), adds):
                total += more
        mean_x, mean_y = sx / n, sy / n
        level = np.maximum(np.abs(mean_y), 1e-9)
        b = coefficients(sxx - n * np.outer(mean_x, mean_x), sxy - n * np.outer(mean_x, mean_y), n, level, kind, alpha, share)
        now = np.frombuffer(next(x for x in pdf["now"] if x is not None))
        pred = (now - mean_x) @ b + mean_y
        return pd.DataFrame(
            {"station_id": pdf["station_id"].iloc[0], "kpi": np.tile(names, horizon), "h": np.repeat(np.arange(horizon, dtype="int32"), len(names)), "pred": pred}
        )

    sums = statistics(inputs, names, horizon, context_h, stride_h, piece_h)
    # a fixed number of tasks: merged by the little they read, few would do all the solving
    dealt = sums.repartition(int(sums.sparkSession.conf.get("spark.sql.shuffle.partitions")), "station_id")
    return dealt.groupBy("station_id").applyInPandas(solved, f"station_id {station_type}, kpi string, h int, pred double")
