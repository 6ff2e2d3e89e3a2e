"""Hand-computed answers for panel, feature, metric and forecast operators."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from kpiscope.functions import catalog, labels
from kpiscope.operators import features, forecast, lag_models, metrics, panel, profiles, sweeps


def series(spark, values, station="s", kpi="k", start=0):
    return spark.createDataFrame(
        [(station, kpi, start + i, float(v)) for i, v in enumerate(values)], "station_id string, kpi string, t int, value double"
    )


def scored(spark, pred, truth):
    rows = [("s", "k", h, float(p), float(t)) for h, (p, t) in enumerate(zip(pred, truth))]
    return spark.createDataFrame(rows, "station_id string, kpi string, h int, pred double, truth double")


def test_metrics(spark):
    scale = metrics.season_scale(series(spark, range(48)))
    m = metrics.score(scored(spark, [1, 2, 4, 6], [1, 2, 3, 4]), scale).first()
    assert m["mae"] == pytest.approx(0.75)
    assert m["mse"] == pytest.approx(1.25)
    assert m["rmse"] == pytest.approx(1.118034, abs=1e-6)
    assert m["nrmse"] == pytest.approx(0.372678, abs=1e-6)
    assert m["smape"] == pytest.approx(17.142857, abs=1e-6)
    assert m["mase"] == pytest.approx(0.03125)
    zero = metrics.score(scored(spark, [0, 0], [0, 0]), scale).first()
    assert zero["smape"] == 0 and zero["nrmse"] == 0


def test_short_series_scale(spark):
    assert metrics.season_scale(series(spark, [1, 3, 7])).first()["scale"] == pytest.approx(3.0)
    assert metrics.season_scale(series(spark, [5])).first()["scale"] == 1.0


def test_clamp(spark):
    rows = [("DL_CQI", 15.7), ("RRC_Conn", 2.5), ("RRC_Conn", 3.5), ("RRC_Conn", -1.0), ("RRC_Conn", 501.0)]
    df = spark.createDataFrame(rows, "kpi string, pred double")
    out = sorted(r["pred"] for r in panel.physical_clamp(df, catalog.kpi_dim(spark), round_integers=True).collect())
    assert out == [0.0, 2.0, 4.0, 15.0, 500.0]
    unknown = spark.createDataFrame([("nope", 1.0)], "kpi string, pred double")
    with pytest.raises(Exception, match="unknown KPI"):
        panel.physical_clamp(unknown, catalog.kpi_dim(spark)).collect()


def test_islands_cover_mask(spark):
    mask = [0, 1, 1, 0, 1, 1, 1]
    df = spark.createDataFrame([("a", i, bool(m)) for i, m in enumerate(mask)], "k string, t int, m boolean")
    got = sorted((r["t_start"], r["t_end"]) for r in features.islands(df, "m", ("k",), "t", 2).collect())
    assert got == [(1, 2), (4, 6)]
    ones = features.islands(df, "m", ("k",), "t", 1).agg(F.sum("duration")).first()[0]
    assert ones == sum(mask)


def test_time_labels(spark):
    df = spark.createDataFrame([(39, 39), (22, 25), (20, 23)], "a int, b int")
    got = [r[0] for r in df.select(labels.hour_window_label("a", "b", 0)).collect()]
    assert got == ["Day 2 (Tue) 15:00–16:00", "Day 1 (Mon) 22:00 → Day 2 (Tue) 02:00", "Day 1 (Mon) 20:00–24:00"]


def test_window_counts(spark):
    df = spark.createDataFrame([(336,), (840,), (1944,), (100,)], "n int")
    got = [r[0] for r in df.select(panel.window_count("n", 168, 168, 24)).collect()]
    assert got == [1, 22, 68, 0]
    w = features.supervised_windows(series(spark, range(10)), 4, 2, 2)
    rows = {r["start"]: (list(r["x"]), list(r["y"])) for r in w.collect()}
    assert rows == {0: ([0, 1, 2, 3], [4, 5]), 2: ([2, 3, 4, 5], [6, 7]), 4: ([4, 5, 6, 7], [8, 9])}


def test_lower_median(spark):
    rows = [("s", "k", 0, i, float(v)) for i, v in enumerate([1, 2, 3, 4])]
    df = spark.createDataFrame(rows, "station_id string, kpi string, h int, sample int, pred double")
    assert forecast.sample_median(df, "lower").first()["pred"] == 2
    assert forecast.sample_median(df, "mean").first()["pred"] == 2.5


def test_group_split_nested(spark):
    st = spark.createDataFrame([(f"{chr(65 + g)}_{i}", chr(65 + g)) for g in range(13) for i in range(3)], "station_id string, site_group string")
    split = panel.cumulative_group_split(st, range(13), seed=42)
    train = {}
    for r in split.collect():
        train.setdefault((r["n_train_groups"], r["part"]), set()).add(r["station_id"])
    everything = {r[0] for r in st.select("station_id").collect()}
    assert (0, "train") not in train
    for g in range(13):
        a, b = train.get((g, "train"), set()), train[(g, "test")]
        assert not a & b and a | b == everything
        if g:
            assert train.get((g - 1, "train"), set()) <= a
    with pytest.raises(Exception, match="no groups left"):
        panel.cumulative_group_split(st, [13]).collect()


def test_slice_split_matches_direct_ranking(spark):
    st = spark.createDataFrame([(i,) for i in range(500)], "station_id int")
    parts = {r["station_id"]: r["part"] for r in panel.slice_train_val(st).collect()}
    assert sum(p == "val" for p in parts.values()) == 75 and len(parts) == 500
    with pytest.raises(Exception, match="too few slices"):
        panel.slice_train_val(spark.createDataFrame([(1,)], "station_id int")).collect()


def test_context_and_padding(spark):
    s = series(spark, range(10))
    assert {r["t"] for r in panel.context_slice(s, 3).collect()} == {7, 8, 9}
    with pytest.raises(Exception, match="shorter than"):
        panel.context_slice(s, 11, strict=True).collect()
    padded = [r["value"] for r in panel.edge_pad(series(spark, [5, 6]), 4).orderBy("pos").collect()]
    assert padded == [5, 5, 5, 6]
    longer = panel.edge_pad(s, 4).orderBy("pos").collect()
    assert [r["value"] for r in longer] == [6, 7, 8, 9]


def test_factors(spark):
    dim = catalog.kpi_dim(spark)
    rows = [("s", "DL_CQI", "1.5"), ("s", "PRB_Util", "1.0"), ("s", "nope", "1.1"), ("s", "DL_iBler", "nan"), ("s", "RRC_Conn", "0.9")]
    df = spark.createDataFrame(rows, "station_id string, kpi string, factor string")
    use = panel.usable_factors(df, dim)
    assert {(r["kpi"], r["factor"]) for r in use.collect()} == {("DL_CQI", 1.15), ("RRC_Conn", 0.9)}
    assert panel.gate_factors(use, 3).count() == 0
    assert panel.gate_factors(use, 2).count() == 2


def test_diurnal_ties_take_first_hour(spark):
    rows = profiles.diurnal_profile(series(spark, [1, 5, 5, 1] * 12)).select("peak_hour", "trough_hour").first()
    assert (rows["peak_hour"], rows["trough_hour"]) == (1, 0)


def test_diurnal_ties_ignore_summation_noise(spark):
    assert 0.1 + 0.2 + 0.3 > 0.3 + 0.2 + 0.1
    days = [{0: a, 1: b, 2: 2 + b, 3: 2 + a} for a, b in ((0.1, 0.3), (0.2, 0.2), (0.3, 0.1))]
    df = series(spark, [d.get(h, 1.0) for d in days for h in range(24)]).coalesce(1).sortWithinPartitions("t")
    got = profiles.diurnal_profile(df).select("peak_hour", "trough_hour").distinct().collect()
    assert [tuple(r) for r in got] == [(2, 0)]


def test_settle_is_independent_of_summation_noise(spark):
    from kpiscope.functions.exprs import settle

    df = spark.createDataFrame([(2.675,), (2.675 - 4e-16,), (2.675 + 4e-16,)], "v double")
    assert {r[0] for r in df.select(settle("v", 2)).collect()} == {2.68}


def test_every_context_from_suffix_sums(spark):
    rng = np.random.default_rng(1)
    values = {("s", "a"): rng.normal(5, 1, 24 * 6 + 30), ("s", "b"): rng.normal(9, 2, 24 * 6 + 30), ("u", "a"): np.zeros(24 * 6 + 30)}
    df = spark.createDataFrame([(*k, t, float(x)) for k, v in values.items() for t, x in enumerate(v)], "station_id string, kpi string, t int, value double")
    split = 24 * 5
    got = {(r["station_id"], r["kpi"], r["model"], r["context_h"]): r for r in sweeps.sweep_scores(df, split).collect()}
    assert len(got) == 3 * 3 * 5
    for (station, kpi), v in values.items():
        truth, scale = v[split:], np.abs(v[24:split] - v[: split - 24]).mean()
        for context in range(24, split + 1, 24):
            preds = {"historic_average": np.full(len(truth), v[split - context : split].mean()), "window_average": np.full(len(truth), v[split - 24 : split].mean()), "seasonal_naive": np.array([v[split - 24 + h % 24] for h in range(len(truth))])}
            for model, pred in preds.items():
                r, mae = got[station, kpi, model, context], np.abs(pred - truth).mean()
                assert r["mae"] == pytest.approx(mae) and r["rmse"] == pytest.approx(np.sqrt(((pred - truth) ** 2).mean()))
                assert r["mase"] == pytest.approx(mae / scale if scale > 1e-8 else 0.0)
    some = sweeps.sweep_scores(df, split, contexts=[48, 96], models=["historic_average"]).collect()
    assert {(r["context_h"], r["mae"]) for r in some if r["kpi"] == "b"} == {(c, got["s", "b", "historic_average", c]["mae"]) for c in (48, 96)}
    levels = {(r["kpi"], r["context_h"]): r["pred"] for r in sweeps.context_levels(df.filter(f"t < {split} AND station_id = 's'")).collect()}
    assert levels == {(k, c): pytest.approx(values["s", k][split - c : split].mean()) for k in "ab" for c in range(24, split + 1, 24)}


def test_external_model_is_checked(spark):
    s = series(spark, range(10))
    ok = forecast.external(s, lambda h, n: np.full(n, h.mean()), horizon=3).collect()
    assert [r["pred"] for r in ok] == [4.5] * 3
    with pytest.raises(Exception, match="expected"):
        forecast.external(s, lambda h, n: h, horizon=3).collect()
    with pytest.raises(Exception, match="non-finite"):
        forecast.external(s, lambda h, n: np.full(n, np.nan), horizon=3).collect()


def lag_windows(x, context, horizon, stride):
    """All training windows and the last context, by plain loops."""

    def feats(w):
        return np.concatenate([w.reshape(-1), w.mean(0), w.std(0), w[-1]])

    starts = range(0, len(x) - context - horizon + 1, stride)
    a = np.stack([feats(x[s : s + context]) for s in starts])
    return a, np.stack([x[s + context : s + context + horizon].reshape(-1) for s in starts]), feats(x[-context:])


@pytest.mark.parametrize("piece_h", [1344, 20, 7])
@pytest.mark.parametrize(("kind", "alpha"), [("ridge", 1.0), ("lasso", 0.05), ("elasticnet", 0.1)])
def test_lag_models_from_sums_match_a_plain_loop(spark, kind, alpha, piece_h):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(120, 2)) + 5
    rows = [("s", k, t, float(x[t, i])) for t in range(120) for i, k in enumerate(("a", "b"))]
    df = spark.createDataFrame(rows, "station_id string, kpi string, t int, value double")
    out = lag_models.lag_regression(df, ["a", "b"], kind, horizon=4, context_h=3, stride_h=2, alpha=alpha, piece_h=piece_h)
    got = {(r["kpi"], r["h"]): r["pred"] for r in out.collect()}
    a, y, now = lag_windows(x, 3, 4, 2)
    am, ym = a.mean(0), y.mean(0)
    ac, yc = a - am, y - ym
    if kind == "ridge":
        w = np.linalg.solve(ac.T @ ac + alpha * np.eye(a.shape[1]), ac.T @ yc)
    else:
        l1, l2 = (alpha, 0.0) if kind == "lasso" else (alpha / 2, alpha / 2)
        w = np.zeros((a.shape[1], y.shape[1]))
        for target in range(y.shape[1]):
            for _ in range(3000):
                for j in range(a.shape[1]):
                    rest = yc[:, target] - ac @ w[:, target] + ac[:, j] * w[j, target]
                    pull = ac[:, j] @ rest / len(a)
                    w[j, target] = np.sign(pull) * max(abs(pull) - l1, 0) / (ac[:, j] @ ac[:, j] / len(a) + l2)
                if kind == "elasticnet" and _ > 300:
                    break
        assert (w == 0).any() and (w != 0).any()
    want = ((now - am) @ w + ym).reshape(4, 2)
    assert got == {(k, h): pytest.approx(want[h, i], abs=1e-8 if kind == "ridge" else 0.01) for h in range(4) for i, k in enumerate(("a", "b"))}


def test_one_feature_without_penalty_is_the_regression_slope(spark):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=50), rng.normal(size=50)
    df = spark.createDataFrame([(float(p), float(q)) for p, q in zip(x, y)], "x double, y double")
    slope = df.select(F.regr_slope("y", "x")).first()[0]
    xc, yc = x - x.mean(), y - y.mean()
    for kind in lag_models.KINDS:
        b = lag_models.coefficients(np.array([[xc @ xc]]), np.array([[xc @ yc]]), 50, np.ones(1), kind, 0.0, 1.0)
        assert b[0, 0] == pytest.approx(slope)


def test_coefficients_meet_the_conditions_of_a_minimum():
    rng = np.random.default_rng(5)
    a, y = rng.normal(size=(80, 12)), rng.normal(size=(80, 3))
    a[:, 11] = a[:, 10]  # equal features
    a, y = a - a.mean(0), y - y.mean(0)
    for kind, ratio in (("lasso", 1.0), ("elasticnet", 0.3)):
        b = lag_models.coefficients(a.T @ a, a.T @ y, 80, np.full(3, 1e-6), kind, 0.08, ratio)
        pull = a.T @ (y - a @ b) / 80 - 0.08 * (1 - ratio) * b
        assert np.abs(pull).max() <= 0.08 * ratio + 1e-6
        assert np.allclose(pull[b != 0], 0.08 * ratio * np.sign(b[b != 0]), atol=1e-6)


def test_coefficients_are_a_minimum_with_fewer_windows_than_features():
    """Sixteen windows of carried values: 1,000 sweeps of coordinate descent ended far from the minimum."""
    rng = np.random.default_rng(7)
    x = np.repeat(rng.uniform(0, 300, size=(100, 3)), 6, axis=0)[:552] + np.repeat(rng.uniform(0, 50, size=(300, 3)), 2, axis=0)[:552]
    a, y, _ = lag_windows(x, 6, 168, 24)
    n, level = len(a), np.abs(y.mean(0))
    a, y = a - a.mean(0), y - y.mean(0)
    for kind, ratio in (("lasso", 1.0), ("elasticnet", 0.5)):
        b = lag_models.coefficients(a.T @ a, a.T @ y, n, level, kind, 1.0, ratio)
        pull = a.T @ (y - a @ b) / n - (1 - ratio) * b
        assert np.abs(pull).max() <= ratio + 0.01
        assert np.allclose(pull[b != 0], ratio * np.sign(b[b != 0]), atol=0.01)


def test_elastic_net_takes_few_systems_and_ends_at_the_minimum(monkeypatch):
    """Features came and went one at a time: about 50 systems for each target here."""
    rng = np.random.default_rng(11)
    x = np.repeat(rng.uniform(0, 500, size=(70, 5)), 8, axis=0)[:552] + np.repeat(rng.uniform(0, 20, size=(276, 5)), 2, axis=0)
    a, y, _ = lag_windows(x, 6, 168, 24)
    n, level = len(a), np.abs(y.mean(0))
    a, y = a - a.mean(0), y - y.mean(0)
    solve, systems = np.linalg.solve, []
    monkeypatch.setattr(np.linalg, "solve", lambda left, right: systems.append(len(left)) or solve(left, right))
    b = lag_models.coefficients(a.T @ a, a.T @ y, n, level, "elasticnet", 1.0, 0.5)
    assert sum(systems) < 20 * y.shape[1]
    pull = a.T @ (y - a @ b) / n - 0.5 * b
    assert (b == 0).any() and np.abs(pull).max() <= 0.5 + 5e-4
    assert np.allclose(pull[b != 0], 0.5 * np.sign(b[b != 0]), atol=5e-4)


def test_pieces_of_few_windows_send_hours(spark):
    """Sums of products, a megabyte a station with a day of context, were moved whatever the number of windows."""
    df = series(spark, [float(t % 7) for t in range(120)])
    few = lag_models.statistics(df, ["k"], horizon=4, context_h=3, stride_h=30).collect()
    many = lag_models.statistics(df, ["k"], horizon=4, context_h=3, stride_h=2).collect()
    assert [(r["n"], len(r["hours"]), r["sxx"]) for r in few] == [(4, 120 * 8, None)]
    assert [(r["n"], r["hours"], len(r["sxx"])) for r in many] == [(57, None, 6 * 6 * 8)]


def test_lag_models_refuse_gaps_and_short_histories(spark):
    for values, message in (([1.0] * 6, "too short"), ([1.0, 2.0, float("nan")] * 20, "missing")):
        with pytest.raises(Exception, match=message):
            lag_models.lag_regression(series(spark, values), ["k"], horizon=4, context_h=3).collect()


@pytest.mark.parametrize("kind", ["lasso", "elasticnet", "random_forest", "gbt"])
def test_pooled_learners(spark, kind):
    s = series(spark, [10 + (t % 24) for t in range(24 * 6)])
    extra = {"maxIter": 2} if kind == "gbt" else {}
    out = forecast.pooled_regression(s, kind, horizon=6, context_h=24, stride_h=24, **extra)
    got = [r["pred"] for r in out.orderBy("h").collect()]
    assert len(got) == 6 and all(5 < p < 40 for p in got)


def test_pooled_learners_keep_their_windows_for_all_passes(spark, monkeypatch):
    """A learner passes over its rows several times; the windows behind them are made once and let go afterwards."""
    from pyspark.ml.regression import RandomForestRegressor

    fit, kept = RandomForestRegressor.fit, []

    def watched(self, df, *more):
        plan = df._jdf.queryExecution().withCachedData().toString()
        kept.append("InMemoryRelation" in plan and "collect_list" not in plan.split("InMemoryRelation")[0])
        return fit(self, df, *more)

    monkeypatch.setattr(RandomForestRegressor, "fit", watched)
    s = series(spark, [10 + (t % 24) for t in range(24 * 6)])
    out = forecast.pooled_regression(s, "random_forest", horizon=6, context_h=24, stride_h=24, numTrees=2)
    assert kept == [True] and out.count() == 6
    assert spark.sparkContext._jsc.getPersistentRDDs().isEmpty()


def test_hours_past_the_panel_and_other_event_types_stay(spark, tmp_path):
    import datetime

    from kpiscope.sources.tables import event_panel

    start = datetime.datetime(2024, 1, 1)
    rows = [(1, kind, start + datetime.timedelta(hours=h), float(h)) for kind in ("view", "sixth") for h in (3, 700, 719, 725, 760)]
    spark.createDataFrame(rows, "user_id long, event_type string, ts timestamp_ntz, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = {k: {} for k in ("view", "sixth")}
    for r in event_panel(spark, str(tmp_path)).collect():
        assert r["t"] not in got[r["kpi"]]
        got[r["kpi"]][r["t"]] = r["value"]
    want = {t: 0.0 if t < 3 else 3.0 if t < 700 else 700.0 if t < 719 else 719.0 for t in range(725)} | {t: 725.0 for t in range(725, 760)} | {760: 760.0}
    assert got == {"view": want, "sixth": want}


def test_panel_adapter_fills_gaps(spark, sf):
    from kpiscope.sources.tables import PANEL_HOURS, event_panel

    counts = event_panel(spark, sf).groupBy("station_id", "kpi").agg(F.count("*").alias("n"), F.count_distinct("t").alias("d"))
    assert {(r["n"], r["d"]) for r in counts.collect()} == {(PANEL_HOURS, PANEL_HOURS)}


def test_validation_raises(spark):
    dim = catalog.kpi_dim(spark)
    good = series(spark, range(5), kpi="DL_CQI")
    panel.assert_valid_panel(good, dim, 5)
    with pytest.raises(ValueError, match="wrong_length"):
        panel.assert_valid_panel(good, dim, 6)
    with pytest.raises(ValueError, match="unknown_kpis"):
        panel.assert_valid_panel(series(spark, range(5), kpi="x"), dim, 5)


def test_clamp_keeps_what_is_no_number(spark):
    from kpiscope.operators import panel

    rows = [("k", None), ("k", float("nan")), ("k", float("inf")), ("k", float("-inf")), ("k", -1.0), ("k", 20.0), ("k", 7.5)]
    dim = spark.createDataFrame([("k", 15.0, False)], "kpi string, cap double, is_integer boolean")
    got = [r["pred"] for r in panel.physical_clamp(spark.createDataFrame(rows, "kpi string, pred double").coalesce(1), dim).collect()]
    assert sorted(map(str, got)) == sorted(["None", "nan", "15.0", "0.0", "0.0", "15.0", "7.5"])
