"""Queries on perturbation sensitivity."""

from __future__ import annotations

from pyspark.sql import functions as F

from kpiscope.functions.exprs import settle, small_table
from kpiscope.operators import sensitivity as sn
from kpiscope.operators.features import array_mean
from kpiscope.plans import inputs as src
from kpiscope.plans.on_events import EVENTS, all_ranked
from kpiscope.plans.on_profiles import tidy
from kpiscope.plans.registry import PANEL, query, rnd
from kpiscope.session import scratch_folder
from kpiscope.sources import sensitivity_files
from kpiscope.sources.tables import PANEL_KPIS, SPLIT_HOUR

def response(spark):
    """Every channel follows the mean of its last week, and a share of every other channel's."""
    place = {k: i + 1 for i, k in enumerate(PANEL_KPIS)}
    rows = [(s, t, 1.0 if s == t else place[t] / (10.0 * place[s])) for s in PANEL_KPIS for t in PANEL_KPIS]
    return sn.level_response(small_table(spark, rows, "src string, tgt string, weight double"), 168)


def caps(spark):
    """Channel catalogue with unequal caps, so that normalisation shows."""
    return src.dim(spark).withColumn("cap", 500.0 * (F.col("ord") + 1))


SC = "(VALUES (-0.10), (-0.05), (-0.01), (0.01), (0.05), (0.10)) sc(a)"
ORD = "CASE {k} WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 ELSE 5 END"
KPI_ROWS = "(VALUES ('click'), ('error'), ('purchase'), ('signup'), ('view'))"

VARIANTS = PANEL + f""", inp AS (SELECT * FROM panel WHERE t < 552),
  mom0 AS (SELECT station_id, kpi, avg(value) AS mu FROM inp GROUP BY 1, 2),
  sm AS (SELECT station_id, kpi, t - 23 AS i, avg(value) OVER w AS m, count(*) OVER w AS n FROM inp WINDOW w AS (PARTITION BY station_id, kpi ORDER BY t ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)),
  slp AS (SELECT station_id, kpi, regr_slope(m, i) AS slope FROM sm WHERE n = 24 GROUP BY 1, 2),
  var AS (SELECT i.station_id, i.kpi, i.t, i.value, CAST(sc.a AS DOUBLE) AS alpha, p.ptype,
    CASE p.ptype WHEN 'mean' THEN value + sc.a * mu WHEN 'variance' THEN (value - mu) * sqrt(1 + sc.a) + mu ELSE value + sc.a * abs(slope) * t END AS y
    FROM inp i JOIN mom0 m ON i.station_id = m.station_id AND i.kpi = m.kpi JOIN slp s ON i.station_id = s.station_id AND i.kpi = s.kpi, {SC},
    (VALUES ('mean'), ('variance'), ('trend')) p(ptype)),
  vf AS (SELECT station_id, kpi, ptype, alpha, avg(y) FILTER (t >= 384) AS pred, avg(value) FILTER (t >= 384) AS base, avg(y) AS y_mean, stddev_pop(y) AS y_std FROM var GROUP BY 1, 2, 3, 4),
  own AS (SELECT station_id, kpi, ptype, avg(sign(alpha) * (pred - base)) AS s_own FROM vf GROUP BY 1, 2, 3),
  cpl AS (SELECT o.station_id, o.kpi AS src, k.k AS tgt, o.ptype, s_own * CASE WHEN o.kpi = k.k THEN 1.0 ELSE {ORD.format(k='k.k')} / (10.0 * {ORD.format(k='o.kpi')}) END AS s_raw FROM own o, {KPI_ROWS} k(k)),
  nrm AS (SELECT *, s_raw * {ORD.format(k='src')} / {ORD.format(k='tgt')} AS s_norm FROM cpl)
"""

MAG = "CASE WHEN abs({s}) < 0.001 THEN 'negligible' WHEN abs({s}) < 0.01 THEN 'weak' WHEN abs({s}) < 1 THEN 'meaningful' ELSE 'strong' END"


def series(spark, sf):
    return sn.series_arrays(src.inputs(spark, sf))


def perturbed(spark, sf):
    inputs = src.inputs(spark, sf)
    return sn.variants(sn.series_arrays(inputs), sn.trend_slopes(inputs))


def coupled_week_mean(x):
    """Stand-in for a cross-channel model: own last-week mean plus a share of every other channel's."""
    import numpy as np

    week = x[-168:].mean(axis=0)
    place = np.arange(1, x.shape[1] + 1, dtype=float)
    share = place[None, :] / (10.0 * place[:, None])
    np.fill_diagonal(share, 1.0)
    return np.tile(week @ share, (168, 1))


def moments(spark, sf):
    inputs = src.inputs(spark, sf)
    return sn.response_moments(inputs, sn.trend_slopes(inputs), response(spark))


def coupled(spark, sf):
    return sn.global_sensitivity(moments(spark, sf))


def _perturbation_query(name, ptype):
    sql = VARIANTS + f"SELECT station_id, kpi, alpha, {rnd('y_mean', 4)} AS y_mean, {rnd('y_std', 4)} AS y_std FROM vf WHERE ptype = '{ptype}'"

    @query(name, sql)
    def run(spark, sf):
        v = perturbed(spark, sf).filter(F.col("ptype") == ptype).withColumn("y_mean", array_mean(F.col("y")))
        spread = F.aggregate("y", F.lit(0.0), lambda acc, x: acc + (x - F.col("y_mean")) * (x - F.col("y_mean")))
        v = v.withColumn("y_std", F.sqrt(spread / F.size("y")))
        return tidy(v.select("station_id", "kpi", "alpha", "y_mean", "y_std"), "y_mean", "y_std")

    return run


pt_mean = _perturbation_query("pt_mean", "mean")
pt_variance = _perturbation_query("pt_variance", "variance")
pt_trend = _perturbation_query("pt_trend", "trend")


SHARE = f"CASE WHEN v.kpi = k.k THEN 1.0 ELSE {ORD.format(k='k.k')} / (10.0 * {ORD.format(k='v.kpi')}) END"


@query(
    "pt_fanout_forecast",
    VARIANTS + f""", bs AS (SELECT v.station_id, k.k AS tgt, sum(v.base * {SHARE}) AS base_mean FROM (SELECT station_id, kpi, avg(value) AS base FROM inp WHERE t >= 384 GROUP BY 1, 2) v, {KPI_ROWS} k(k) GROUP BY 1, 2)
    SELECT v.station_id, v.kpi AS src, k.k AS tgt, ptype, alpha, {rnd('base_mean + (pred - base) * ' + SHARE, 4)} AS pred_mean, {rnd('base_mean', 4)} AS base_mean
    FROM vf v, {KPI_ROWS} k(k) JOIN bs ON bs.tgt = k.k WHERE bs.station_id = v.station_id""",
)
def pt_fanout_forecast(spark, sf):
    return tidy(sn.fanout_response(moments(spark, sf)), "pred_mean", "base_mean")


@query("pt_global", VARIANTS + f"SELECT station_id, src, tgt, ptype, {rnd('s_raw', 5)} AS s_raw FROM cpl")
def pt_global(spark, sf):
    return tidy(coupled(spark, sf), "s_raw", digits=5)


@query("pt_global_matrix", VARIANTS + f"SELECT station_id, src, tgt, ptype, {rnd('s_raw', 5)} AS s_raw FROM cpl")
def pt_global_matrix(spark, sf):
    """The hook for outside models, with the same model as a matrix function."""
    return tidy(sn.matrix_sensitivity(src.inputs(spark, sf), PANEL_KPIS, coupled_week_mean), "s_raw", digits=5)


@query("pt_norm", VARIANTS + f"SELECT station_id, src, tgt, ptype, {rnd('s_norm', 5)} AS s_norm FROM nrm")
def pt_norm(spark, sf):
    out = sn.normalize(coupled(spark, sf), caps(spark)).select("station_id", "src", "tgt", "ptype", "s_norm")
    return tidy(out, "s_norm", digits=5)


@query("pt_magnitude", VARIANTS + f"SELECT station_id, {MAG.format(s='s_norm')} AS magnitude, count(*) AS n FROM nrm GROUP BY 1, 2")
def pt_magnitude(spark, sf):
    return sn.normalize(coupled(spark, sf), caps(spark)).groupBy("station_id", "magnitude").agg(F.count("*").alias("n"))


PT_ORDER = "CASE ptype WHEN 'mean' THEN 0 WHEN 'variance' THEN 1 ELSE 2 END"


@query(
    "pt_topk",
    VARIANTS + f""", r AS (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY round(abs(s_norm), 10) DESC, src, tgt, {PT_ORDER}) AS rank FROM nrm WHERE src <> tgt)
    SELECT station_id, CAST(rank AS INTEGER) AS rank, src, tgt, ptype, {rnd('s_norm', 5)} AS s_norm FROM r WHERE rank <= 5""",
)
def pt_topk(spark, sf):
    out = sn.topk_pairs(sn.normalize(coupled(spark, sf), caps(spark)), src.dim(spark), 5)
    return tidy(out.select("station_id", "rank", "src", "tgt", "ptype", "s_norm"), "s_norm", digits=5)


@query(
    "pt_grid",
    VARIANTS + "SELECT station_id, src, "
    + ", ".join(f"{rnd(f'max(CASE WHEN tgt = $${k}$$ AND src <> tgt THEN abs(s_norm) ELSE 0 END)', 4)} AS {k}" for k in PANEL_KPIS)
    + " FROM nrm GROUP BY 1, 2",
)
def pt_grid(spark, sf):
    return tidy(sn.grid(sn.normalize(coupled(spark, sf), caps(spark)), PANEL_KPIS), *PANEL_KPIS)


LOCAL = EVENTS + f""", ctr AS (SELECT station_id, event_idx, kpi, t_start, t_end, 552 - 168 + (t_start + t_end) // 2 AS t_center FROM rk WHERE kpi <> 'MULTI'),
  inp AS (SELECT * FROM panel WHERE t < 552),
  env0 AS (SELECT c.station_id, c.event_idx, p.kpi AS src, p.t, exp(-1.0 * pow((p.t - c.t_center) / 2.0, 2)) * (least(abs(p.value), abs(q.value)) / (greatest(abs(p.value), abs(q.value)) + 1e-8)) * p.value AS envelope
    FROM ctr c JOIN inp p ON p.station_id = c.station_id AND p.t BETWEEN c.t_center - 2 AND c.t_center + 2
    JOIN inp q ON q.station_id = p.station_id AND q.kpi = p.kpi AND q.t = c.t_center),
  dl AS (SELECT *, CAST(sc.a AS DOUBLE) AS alpha, CAST(sc.a AS DOUBLE) * envelope AS delta FROM env0, {SC}),
  lc0 AS (SELECT station_id, event_idx, src, alpha, sum(delta) FILTER (t >= 384) / 168 AS d FROM dl GROUP BY 1, 2, 3, 4),
  lc1 AS (SELECT station_id, event_idx, src, avg(sign(alpha) * coalesce(d, 0)) AS s_own FROM lc0 GROUP BY 1, 2, 3),
  lc AS (SELECT l.station_id, l.event_idx, c.kpi AS tgt, l.src, s_own * CASE WHEN l.src = c.kpi THEN 1.0 ELSE {ORD.format(k='c.kpi')} / (10.0 * {ORD.format(k='l.src')}) END AS s_raw
    FROM lc1 l JOIN ctr c ON c.station_id = l.station_id AND c.event_idx = l.event_idx),
  lcn AS (SELECT *, s_raw * {ORD.format(k='src')} / {ORD.format(k='tgt')} AS s_norm FROM lc)
"""


def centers(spark, events):
    return sn.event_centers(events, src.dim(spark), SPLIT_HOUR)


@query(
    "pt_event_centers",
    LOCAL + "SELECT station_id, CAST(event_idx AS INTEGER) AS event_idx, kpi, t_start, t_end, t_center FROM ctr",
)
def pt_event_centers(spark, sf):
    return centers(spark, all_ranked(spark, sf))


@query(
    "pt_type1_local",
    LOCAL + f"SELECT station_id, CAST(event_idx AS INTEGER) AS event_idx, src, t, alpha, {rnd('delta', 5)} AS delta FROM dl",
)
def pt_type1_local(spark, sf):
    return tidy(sn.local_deltas(envelopes(spark, sf)), "delta", digits=5)


def envelopes(spark, sf):
    return sn.local_envelopes(centers(spark, all_ranked(spark, sf)), series(spark, sf))


def local_of(spark, sf):
    return sn.local_sensitivity(envelopes(spark, sf), response(spark))


@query("pt_local", LOCAL + f"SELECT station_id, CAST(event_idx AS INTEGER) AS event_idx, tgt, src, {rnd('s_raw', 6)} AS s_raw FROM lc")
def pt_local(spark, sf):
    return tidy(local_of(spark, sf), "s_raw", digits=6)


@query(
    "pt_local_topk",
    LOCAL + f""", a AS (SELECT *, max(abs(s_norm)) OVER (PARTITION BY station_id, event_idx) AS mx FROM lcn),
    r AS (SELECT *, row_number() OVER (PARTITION BY station_id, event_idx ORDER BY round(abs(s_norm), 10) DESC, src) AS rank FROM a WHERE mx > 0)
    SELECT station_id, CAST(event_idx AS INTEGER) AS event_idx, CAST(rank AS INTEGER) AS rank, src, tgt, {rnd('s_norm', 6)} AS s_norm FROM r WHERE rank <= 3""",
)
def pt_local_topk(spark, sf):
    out = sn.local_topk(sn.normalize(local_of(spark, sf), caps(spark)), src.dim(spark))
    return tidy(out.select("station_id", "event_idx", "rank", "src", "tgt", "s_norm"), "s_norm", digits=6)


@query(
    "pt_summary",
    LOCAL + """, n AS (SELECT station_id, count(*) AS n_events FROM rk GROUP BY 1), c AS (SELECT station_id, count(*) AS n_centers FROM ctr GROUP BY 1)
    SELECT n.station_id, n_events, coalesce(n_centers, 0) AS n_centers, 90 + coalesce(n_centers, 0) * 30 AS n_perturbations FROM n LEFT JOIN c ON n.station_id = c.station_id""",
)
def pt_summary(spark, sf):
    events = all_ranked(spark, sf)
    return sn.summary(events, centers(spark, events), src.dim(spark))


FLAT = LOCAL + VARIANTS[len(PANEL):].replace(", inp AS (SELECT * FROM panel WHERE t < 552)", "", 1)

FLAT_SELECT = f"""SELECT 'global' AS scope, station_id, src AS source, tgt AS target, ptype AS perturbation_type, NULL::INTEGER AS event_idx, {rnd('s_raw', 5)} AS s_raw, {rnd('s_norm', 5)} AS s_norm, {MAG.format(s='s_norm')} AS magnitude FROM nrm WHERE src <> tgt
    UNION ALL SELECT 'local', station_id, src, tgt, NULL, CAST(event_idx AS INTEGER), {rnd('s_raw', 5)}, {rnd('s_norm', 5)}, {MAG.format(s='s_norm')} FROM lcn"""


def flat_rows(spark, sf):
    g = sn.normalize(coupled(spark, sf), caps(spark))
    return sn.flatten(g, sn.normalize(local_of(spark, sf), caps(spark)))


def flat_table(spark, sf):
    out = flat_rows(spark, sf).select(
        "scope",
        "station_id",
        F.col("src").alias("source"),
        F.col("tgt").alias("target"),
        F.col("ptype").alias("perturbation_type"),
        "event_idx",
        "s_raw",
        "s_norm",
        "magnitude",
    )
    return tidy(out, "s_raw", "s_norm", digits=5)


query("pt_flatten", FLAT + FLAT_SELECT)(flat_table)


@query(
    "sink_sensitivity",
    FLAT + f", f AS ({FLAT_SELECT}) SELECT scope, magnitude, count(*) AS n_rows, count(DISTINCT station_id) AS n_stations, {rnd('max(abs(s_norm))', 4)} AS largest FROM f GROUP BY 1, 2"
    " UNION ALL SELECT 'summary', 'table', count(DISTINCT src), count(DISTINCT station_id), NULL FROM nrm",
)
def sink_sensitivity(spark, sf):
    """The three files written, and what they hold: rows by magnitude, and one table per station."""
    path = scratch_folder(spark, "sensitivity")
    sensitivity_files.write_sensitivity(flat_rows(spark, sf), list(PANEL_KPIS), path)
    back = sensitivity_files.read_sensitivity(spark, path)
    wanted = ["scope", "station_id", "magnitude", settle("S_norm", 5).alias("S_norm")]
    rows = back["global"].select(*wanted).unionByName(back["local"].select(*wanted))
    counts = rows.groupBy("scope", "magnitude").agg(
        F.count("*").alias("n_rows"), F.count_distinct("station_id").alias("n_stations"), settle(F.max(F.abs("S_norm")), 4).alias("largest")
    )
    text = spark.read.text(f"{path}/sensitivity_summary")
    lines = text.filter("value LIKE '| %' AND value NOT LIKE '| Source |%'").select("station_id", F.split("value", " ")[1].alias("src"))
    tables = lines.agg(F.lit("summary").alias("scope"), F.lit("table").alias("magnitude"), F.count_distinct("src").alias("n_rows"), F.count_distinct("station_id").alias("n_stations"))
    return counts.unionByName(tables, allowMissingColumns=True)
