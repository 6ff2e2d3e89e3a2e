"""Hand-computed answers for events, causes, surroundings and sensitivity."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from kpiscope.functions import catalog, labels
from kpiscope.operators import causes, environment, events, sensitivity

FC = "station_id string, kpi string, h int, pred double"
BASE = "station_id string, kpi string, t int, value double"
EV = (
    "station_id string, event_idx int, kpi string, type string, t_start int, t_end int, magnitude double, z_score double, "
    "direction string, co_occurring_kpis array<string>"
)


def alternating(spark, kpis):
    return spark.createDataFrame([("s", k, t, 8.0 if t % 2 == 0 else 12.0) for k in kpis for t in range(168)], BASE)


def test_level_shift(spark):
    fc = spark.createDataFrame([("s", "DL_CQI", h, float(v)) for h, v in enumerate([10, 16, 16, 10, 4, 10])], FC)
    line = events.timeline(fc, alternating(spark, ["DL_CQI"]))
    rows = events.detect(line, catalog.kpi_dim(spark), horizon=6).collect()
    assert len(rows) == 1
    e = rows[0]
    assert (e["type"], e["t_start"], e["t_end"], e["direction"]) == ("level_shift", 1, 2, "up")
    assert e["z_score"] == pytest.approx(3.0) and e["magnitude"] == pytest.approx(6.0)


def test_run_to_the_end_closes(spark):
    fc = spark.createDataFrame([("s", "DL_CQI", h, float(v)) for h, v in enumerate([10, 10, 16, 16])], FC)
    line = events.timeline(fc, alternating(spark, ["DL_CQI"]))
    rows = events.detect(line, catalog.kpi_dim(spark), horizon=4).filter("type = 'level_shift'").collect()
    assert [(r["t_start"], r["t_end"]) for r in rows] == [(2, 3)]


def test_multi_kpi_in_catalogue_order(spark):
    kpis = ["Throughput", "DL_CQI", "RRC_Conn"]
    values = {"Throughput": [10, 10, 10, 10, 10, 30], "DL_CQI": [10, 10, 10, 10, 10, 30], "RRC_Conn": [10, 10, 10, 10, 10, 30]}
    rows = [("s", k, h, float(v)) for k in kpis for h, v in enumerate(values[k] + [30.0])]
    line = events.timeline(spark.createDataFrame(rows, FC), alternating(spark, kpis))
    multi = events.detect(line, catalog.kpi_dim(spark), horizon=7).filter("type = 'multi_kpi'").collect()
    assert len(multi) == 1
    assert multi[0]["co_occurring_kpis"] == ["RRC_Conn", "DL_CQI", "Throughput"]
    assert (multi[0]["t_start"], multi[0]["t_end"], multi[0]["z_score"]) == (5, 6, 3.0)


def brute_events(fc, base, kpis, horizon):
    """Straight loop over one station, for comparison."""
    out, masks = [], []
    for k in kpis:
        b, f = base[k], fc[k]
        mu, sd, ds = b.mean(), b.std() or 1e-8, np.diff(b).std() or 1e-8
        z = (f - mu) / sd
        level = np.abs(z) > 2.5
        d = np.diff(f, prepend=b[-1])
        spike = np.abs(d) > 3 * ds
        t = 0
        while t < len(f):
            if level[t]:
                e = t
                while e + 1 < len(f) and level[e + 1]:
                    e += 1
                if e > t:
                    p = t + int(np.argmax(np.abs(z[t : e + 1])))
                    out.append((k, "level_shift", t, e, round(float(z[p]), 6)))
                t = e
            t += 1
        out += [(k, "spike", int(i), int(i), round(float(d[i] / ds), 6)) for i in np.where(spike)[0]]
        r = np.array([f[i : i + 12].mean() for i in range(len(f) - 11)])
        s = np.diff(r)
        for i in range(1, len(s)):
            if np.sign(s[i]) != np.sign(s[i - 1]) and abs(s[i] - s[i - 1]) > 2 * ds:
                c = i + 6
                out.append((k, "trend_break", max(0, c - 2), min(horizon - 1, c + 2), round(float((s[i] - s[i - 1]) / ds), 6)))
        masks.append(level | spike)
    cover = np.sum(masks, axis=0)
    t = 0
    while t < len(cover):
        if cover[t] >= 3:
            e = t
            while e + 1 < len(cover) and cover[e + 1] >= 3:
                e += 1
            out.append(("MULTI", "multi_kpi", t, e, float(cover[t : e + 1].max())))
            t = e
        t += 1
    return sorted(out)


def test_detection_against_brute_force(spark):
    rng = np.random.default_rng(7)
    kpis = [k for k, *_ in catalog.KPIS]
    base = {k: rng.normal(50, 5, 168) for k in kpis}
    fc = {k: rng.normal(50, 5, 168) + np.where(rng.random(168) < 0.08, 30, 0) + 12 * np.sin(np.arange(168) / 9) for k in kpis}
    for k in kpis:
        fc[k][60:64] += 40
    f = spark.createDataFrame([("s", k, h, float(fc[k][h])) for k in kpis for h in range(168)], FC)
    b = spark.createDataFrame([("s", k, t, float(base[k][t])) for k in kpis for t in range(168)], BASE)
    got = events.detect(events.timeline(f, b), catalog.kpi_dim(spark)).collect()
    mine = sorted((r["kpi"], r["type"], r["t_start"], r["t_end"], round(r["z_score"], 6)) for r in got)
    want = brute_events(fc, base, kpis, 168)
    assert [m[:4] for m in mine] == [w[:4] for w in want]
    assert [m[4] for m in mine] == pytest.approx([w[4] for w in want], abs=1e-5)
    assert {m[1] for m in mine} >= {"level_shift", "spike", "multi_kpi"}


def cause_setup(spark, start, end, relation="INCREASES", src_dir="up"):
    rows = [
        ("s", 0, "PRB_Util", "level_shift", 20, 22, 1.0, 3.0, "up", []),
        ("s", 1, "RRC_Conn", "level_shift", start, end, 1.0, 4.0, src_dir, []),
        ("s", 2, "MULTI", "multi_kpi", 18, 22, 3.0, 3.0, "mixed", ["RRC_Conn", "PRB_Util"]),
    ]
    edges = spark.createDataFrame(
        [("RRC_Conn", "PRB_Util", relation, "strong", 0)], "source_kpi string, target_kpi string, relation_type string, strength string, edge_ord int"
    )
    return spark.createDataFrame(rows, EV), edges


def test_concurrent_cause(spark):
    ev, edges = cause_setup(spark, 10, 14)
    r = causes.concurrent(ev, edges).collect()
    assert len(r) == 1 and r[0]["lag_hours"] == -10 and r[0]["consistent"] is True
    ev, edges = cause_setup(spark, 10, 14, "DECREASES")
    assert causes.concurrent(ev, edges).first()["consistent"] is False


def test_background_cause(spark):
    ev, edges = cause_setup(spark, 8, 13)
    found = causes.concurrent(ev, edges)
    assert found.count() == 0
    line = events.timeline(
        spark.createDataFrame([("s", "RRC_Conn", h, 14.0 if 20 <= h <= 22 else 10.0) for h in range(168)], FC), alternating(spark, ["RRC_Conn"])
    )
    r = causes.background(ev, edges, events.hour_marks(line)).first()
    assert r["z_deviation"] == pytest.approx(2.0)
    multi = causes.multi_causes(ev, edges).collect()
    assert [(m["source_kpi"], m["target_kpi"]) for m in multi] == [("RRC_Conn", "PRB_Util")]


@pytest.mark.parametrize("bucket_h", [1, 5, 12, 500])
def test_intervals_meet_once_by_buckets(spark, bucket_h):
    rng = np.random.default_rng(4)
    sides = []
    for n in (60, 80):
        start = rng.integers(-20, 160, n)
        sides.append([(int(k), int(s), int(s + d), i) for i, (k, s, d) in enumerate(zip(rng.integers(0, 3, n), start, rng.integers(0, 30, n)))])
    left = spark.createDataFrame(sides[0], "k int, a int, b int, l int")
    right = spark.createDataFrame(sides[1], "k int, c int, d int, r int")
    met = causes.overlapping(left, right, ["k"], bucket_h).collect()
    got = [(r["l"], r["r"]) for r in met if r["meets"]]
    assert {r["l"] for r in met} == set(range(60))
    want = {(i, j) for k, a, b, i in sides[0] for m, c, d, j in sides[1] if k == m and c <= b and a <= d}
    assert len(got) == len(want) and set(got) == want


def test_attached_causes_are_ordered_and_empty_without_any(spark):
    kind = "station_id string, event_idx int, kpi string, type string, t_start int, t_end int, magnitude double, z_score double, direction string, co_occurring_kpis array<string>"
    rows = [("s", 0, "PRB_Util", "spike", 10, 10, 5.0, 4.0, "up", []), ("s", 1, "RRC_Conn", "spike", 14, 14, 5.0, 3.0, "up", []), ("s", 2, "DL_CQI", "spike", 90, 90, 1.0, 2.0, "up", [])]
    ev = spark.createDataFrame(rows, kind)
    edges = spark.createDataFrame([("RRC_Conn", "PRB_Util", "INCREASES", "strong", 0, "TS 1"), ("DL_CQI", "PRB_Util", "LIMITS", "weak", 1, "TS 2")], "source_kpi string, target_kpi string, relation_type string, strength string, edge_ord int, spec_reference string")
    marks = spark.createDataFrame([("s", "DL_CQI", 10, 9.0, 5.0, 1.0)], "station_id string, kpi string, h int, pred double, mu double, sd double")
    env = spark.createDataFrame([("s", "dense")], "station_id string, environment_hint string")
    got = {r["event_idx"]: r for r in causes.attach(ev, causes.infer(ev, edges, marks), edges, env).collect()}
    assert [(c["source_kpi"], c["spec_reference"], c["has_concurrent"], c["lag_hours"], c["z_deviation"]) for c in got[0]["candidate_causes"]] == [("RRC_Conn", "TS 1", 1, 4, None), ("DL_CQI", "TS 2", 0, None, 4.0)]
    assert got[1]["candidate_causes"] == [] and got[2]["candidate_causes"] == []
    assert got[2]["environmental_context"]["environment_hint"] == "dense"


def test_magnitude(spark):
    df = spark.createDataFrame([(0.0009,), (0.001,), (-0.01,), (1.0,)], "s double")
    assert [r[0] for r in df.select(labels.sensitivity_magnitude("s")).collect()] == ["negligible", "weak", "meaningful", "strong"]


def inputs(spark, n=120):
    rng = np.random.default_rng(3)
    x = {"RRC_Conn": rng.normal(100, 10, n), "DL_CQI": rng.normal(8, 1, n)}
    rows = [("s", k, t, float(v[t])) for k, v in x.items() for t in range(n)]
    return spark.createDataFrame(rows, BASE), x


def moments_of(spark, df, response, **more):
    window = more.get("window")
    return sensitivity.response_moments(df, sensitivity.trend_slopes(df, window), response, **more)


def test_mean_sensitivity_of_a_level_response(spark):
    df, x = inputs(spark)
    weights = spark.createDataFrame([(k, k, 1.0) for k in x], "src string, tgt string, weight double")
    g = sensitivity.global_sensitivity(moments_of(spark, df, sensitivity.level_response(weights, 120)))
    got = {(r["src"], r["tgt"]): r["s_raw"] for r in g.filter("ptype = 'mean'").collect()}
    assert got == {(k, k): pytest.approx(0.16 / 3 * x[k].mean()) for k in x}
    norm = sensitivity.normalize(g, catalog.kpi_dim(spark)).filter("src = 'RRC_Conn' AND tgt = 'RRC_Conn' AND ptype = 'mean'").first()
    assert norm["s_norm"] == pytest.approx(norm["s_raw"])


COUPLING = {("RRC_Conn", "RRC_Conn"): 0.9, ("RRC_Conn", "DL_CQI"): -0.2, ("DL_CQI", "RRC_Conn"): 1.7}


def coupled_model(level):
    """The same two models as plain matrix functions."""
    names = ["RRC_Conn", "DL_CQI"]
    w = np.array([[COUPLING.get((s, t), 0.0) for t in names] for s in names])
    return lambda x: np.tile(x[-30:].mean(axis=0) @ w, (168, 1)) if level else np.stack([x[len(x) - 24 + h % 24] @ w for h in range(168)])


@pytest.mark.parametrize("level", [True, False])
@pytest.mark.parametrize("window", [None, 60])
def test_responses_agree_with_perturbed_forecasts(spark, level, window):
    df, _ = inputs(spark)
    weights = spark.createDataFrame([(*k, w) for k, w in COUPLING.items()], "src string, tgt string, weight double")
    response, period = (sensitivity.level_response(weights, 30), 1) if level else (sensitivity.seasonal_response(weights), 24)
    m = sensitivity.matrix_sensitivity(df, ["RRC_Conn", "DL_CQI"], coupled_model(level), window=window)
    moments = moments_of(spark, df, response, period=period, window=window)
    a = {(r["src"], r["tgt"], r["ptype"]): r["s_raw"] for r in m.collect()}
    b = {(r["src"], r["tgt"], r["ptype"]): r["s_raw"] for r in sensitivity.global_sensitivity(moments).collect()}
    assert all(a[k] == pytest.approx(b.get(k, 0.0), abs=1e-9) for k in a) and len(b) == 9
    f = sensitivity.fanout_response(moments).groupBy("src", "tgt", "ptype").agg(F.avg(F.signum("alpha") * (F.col("pred_mean") - F.col("base_mean"))).alias("s"))
    assert {(r["src"], r["tgt"], r["ptype"]): r["s"] for r in f.collect()} == {k: pytest.approx(v, abs=1e-9) for k, v in b.items()}


def test_positive_trend_pushes_upward_whatever_the_slope(spark):
    rows = [("s", k, t, 500.0 + sign * t) for k, sign in (("up", 1.0), ("down", -1.0)) for t in range(120)]
    df = spark.createDataFrame(rows, BASE)
    weights = spark.createDataFrame([("up", "up", 1.0), ("down", "down", 1.0)], "src string, tgt string, weight double")
    fan = sensitivity.fanout_response(moments_of(spark, df, sensitivity.level_response(weights, 24)), scales=(-0.1, 0.1))
    for r in fan.filter("ptype = 'trend'").collect():
        assert r["pred_mean"] - r["base_mean"] == pytest.approx(r["alpha"] * 107.5)


@pytest.mark.parametrize("level", [True, False])
def test_local_effects_reach_other_channels(spark, level):
    """Every channel perturbed and forecast again by a plain loop."""
    df, x = inputs(spark, 200)
    names = ["RRC_Conn", "DL_CQI"]
    weights = spark.createDataFrame([(*k, w) for k, w in COUPLING.items()], "src string, tgt string, weight double")
    response, period = (sensitivity.level_response(weights, 30), 1) if level else (sensitivity.seasonal_response(weights), 24)
    rows = [("s", 0, "DL_CQI", 160, 163), ("s", 1, "RRC_Conn", 150, 167), ("s", 2, "RRC_Conn", 166, 167), ("s", 3, "DL_CQI", 10, 12)]
    ev = spark.createDataFrame(rows, "station_id string, event_idx int, kpi string, t_start int, t_end int")
    centers = sensitivity.event_centers(ev, catalog.kpi_dim(spark), 200)
    env = sensitivity.local_envelopes(centers, sensitivity.series_arrays(df))
    got = {(r["event_idx"], r["tgt"], r["src"]): r["s_raw"] for r in sensitivity.local_sensitivity(env, response, period).collect()}
    model, matrix, want = coupled_model(level), np.stack([x[k] for k in names], axis=1), {}
    for _, idx, kpi, first, last in rows:
        c, part = 32 + (first + last) // 2, slice(first, last + 1)
        base = model(matrix)
        for s, name in enumerate(names):
            total = 0.0
            for a in sensitivity.SCALES:
                y = matrix.copy()
                for t in range(max(0, c - 2), min(200, c + 3)):
                    near, mid = abs(matrix[t, s]), abs(matrix[c, s])
                    y[t, s] += a * np.exp(-(((t - c) / 2) ** 2)) * min(near, mid) / (max(near, mid) + 1e-8) * matrix[t, s]
                k = names.index(kpi)
                total += np.sign(a) * (model(y)[part, k].mean() - base[part, k].mean())
            want[idx, kpi, name] = total / len(sensitivity.SCALES)
    assert got == {k: pytest.approx(v, abs=1e-9) for k, v in want.items()}
    assert any(v for (_, t, s), v in got.items() if s != t)


def test_osm(spark):
    def pois(n):
        return [("s%d" % n, i, {"amenity": "cafe"}) for i in range(n)] or [("s0", 0, {"landuse": "forest"})]

    rows = pois(31) + pois(11) + pois(1) + pois(0) + [("b", 0, {"building": "yes", "building:levels": "4"})]
    df = spark.createDataFrame(rows, "station_id string, elem_id int, tags map<string,string>")
    got = {r["station_id"]: r for r in environment.osm_aggregate(df).collect()}
    assert [got[s]["poi_density_band"] for s in ("s31", "s11", "s1", "s0")] == ["High", "Medium", "Low", "Very Low"]
    assert got["b"]["avg_building_height_m"] == 12.0
    cls = spark.createDataFrame([(25.0,), (10.0,), (9.9,)], "avg_building_height_m double")
    cls = cls.select("*", F.lit(0).alias("transit_hubs"), F.lit(0).alias("telecom_masts"), F.lit(None).cast("string").alias("poi_density_band"), F.lit(0).alias("poi_count"))
    assert [r["building_height_class"] for r in environment.factor_classes(cls).collect()] == ["high_rise", "mid_rise", "low_rise"]


@pytest.mark.parametrize(
    ("line", "column", "want"),
    [("Telecom infrastructure: 4 cabinets", "telecom_masts", 0), ("telecom infrastructure: 4 Masts", "telecom_masts", 4), ("Buildings: unknown, 3 sheds", "building_count", 0), ("Buildings: 7 within 500m, Avg  Height = 14.5 m", "avg_building_height_m", 14.5),
     ("Buildings: 7 WITHIN 500m, max height=20m", "max_building_height_m", 20.0), ("Transit hubs: 2\nTransit hubs: 5", "transit_hubs", 5), ("POI density: High (31 POIs within 500m)", "poi_count", 31), ("POI density: High (31 things)", "poi_count", 0)],
)
def test_summary_numbers_need_their_units(spark, line, column, want):
    assert environment.parse_summaries(spark.createDataFrame([("s", line)], "station_id string, text string")).first()[column] == want


def test_parse_summary_defaults(spark):
    text = "Location: Frisco, Texas\nPOI density: Very Low (no POIs within 500m)\nLand use: retail, forest/ park\nBuildings: 3 within 500m, avg height=9.5m, max height=12.0m"
    r = environment.parse_summaries(spark.createDataFrame([("s", text)], "station_id string, text string")).first()
    assert r["location"] == "Frisco, Texas" and r["poi_density_band"] is None and r["poi_count"] == 0
    assert r["land_use"] == ["retail", "forest", "park"]
    assert (r["building_count"], r["avg_building_height_m"], r["max_building_height_m"]) == (3, 9.5, 12.0)
