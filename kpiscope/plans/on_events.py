"""Queries on anomaly events, their causes and station surroundings."""

from __future__ import annotations

from pyspark.sql import functions as F

from kpiscope.functions.exprs import settle, small_table
from kpiscope.operators import causes as cz
from kpiscope.operators import environment as env
from kpiscope.operators import events as ev
from kpiscope.plans import inputs as src
from kpiscope.plans.on_profiles import tidy
from kpiscope.plans.registry import MOMENTS, query, rnd
from kpiscope.sources.tables import load

# KPI-level relationship graph over the panel's channels.
KPI_EDGES = (
    ("click", "purchase", "INCREASES", "strong"),
    ("view", "click", "DETERMINES", "moderate"),
    ("error", "purchase", "DECREASES", "critical"),
    ("error", "view", "LIMITS", "weak"),
    ("signup", "purchase", "CAUSES", "extracted"),
    ("view", "signup", "INCREASES", "moderate"),
    ("purchase", "error", "RELATED_TO", "weak"),
    ("click", "error", "INCREASES", "moderate"),
)


def edges(spark):
    """The graph, each edge with the specification it is said to come from."""
    rows = [(*e, i, f"TS 28.55{i % 4} §5.{i}") for i, e in enumerate(KPI_EDGES)]
    return small_table(spark, rows, "source_kpi string, target_kpi string, relation_type string, strength string, edge_ord int, spec_reference string")


def line(spark, sf):
    """Observed week and held-out week as one timeline; the latter is looked at as the forecast."""
    return src.timeline(spark, sf)


def all_events(spark, sf):
    return ev.detect(line(spark, sf), src.dim(spark))


def top_events(spark, sf):
    return ev.rank_topn(all_events(spark, sf), src.dim(spark))


def all_ranked(spark, sf):
    """All events by rank. Joins that read them twice share the exchange, or detect again where it differs."""
    return ev.rank_topn(all_events(spark, sf), src.dim(spark), top_n=None)


MARKS = MOMENTS + """, wk AS (SELECT station_id, kpi, h, truth AS pred FROM fc),
  marks AS (SELECT w.station_id, w.kpi, w.h, w.pred, m.mu, m.dsigma, (w.pred - m.mu) / m.sigma AS z,
      w.pred - coalesce(lag(w.pred) OVER (PARTITION BY w.station_id, w.kpi ORDER BY w.h), m.last_value) AS diff
    FROM wk w JOIN mom m ON w.station_id = m.station_id AND w.kpi = m.kpi)
"""

EVENTS = MARKS + """, lv AS (SELECT *, h - row_number() OVER (PARTITION BY station_id, kpi ORDER BY h) AS run FROM marks WHERE abs(z) > 2.5),
  lvr AS (SELECT *, row_number() OVER (PARTITION BY station_id, kpi, run ORDER BY abs(z) DESC, h) AS rk FROM lv),
  level_ev AS (SELECT station_id, kpi, 'level_shift' AS type, min(h) AS t_start, max(h) AS t_end, max(abs(pred - mu)) AS magnitude,
      max(CASE WHEN rk = 1 THEN z END) AS z_score FROM lvr GROUP BY station_id, kpi, run HAVING count(*) >= 2),
  spike_ev AS (SELECT station_id, kpi, 'spike' AS type, h AS t_start, h AS t_end, abs(diff) AS magnitude, diff / dsigma AS z_score FROM marks WHERE abs(diff) > 3 * dsigma),
  ma AS (SELECT station_id, kpi, h, avg(pred) OVER w AS m, count(*) OVER w AS n FROM wk WINDOW w AS (PARTITION BY station_id, kpi ORDER BY h ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)),
  sl AS (SELECT station_id, kpi, h - 12 AS i, m - lag(m) OVER (PARTITION BY station_id, kpi ORDER BY h) AS slope FROM ma WHERE n = 12),
  sb AS (SELECT station_id, kpi, i, slope, lag(slope) OVER (PARTITION BY station_id, kpi ORDER BY i) AS before FROM sl WHERE slope IS NOT NULL),
  trend_ev AS (SELECT s.station_id, s.kpi, 'trend_break' AS type, greatest(0, i + 6 - 2) AS t_start, least(167, i + 6 + 2) AS t_end, abs(slope - before) AS magnitude,
      (slope - before) / dsigma AS z_score, CASE WHEN slope > 0 THEN 'up' ELSE 'down' END AS direction FROM sb s JOIN mom m ON s.station_id = m.station_id AND s.kpi = m.kpi
      WHERE before IS NOT NULL AND sign(slope) <> sign(before) AND abs(slope - before) > 2 * dsigma),
  cov AS (SELECT station_id, h, count(*) AS c, list(kpi) AS kpis FROM marks WHERE abs(z) > 2.5 OR abs(diff) > 3 * dsigma GROUP BY 1, 2),
  cr AS (SELECT *, h - row_number() OVER (PARTITION BY station_id ORDER BY h) AS run FROM cov WHERE c >= 3),
  multi_ev AS (SELECT station_id, min(h) AS t_start, max(h) AS t_end, CAST(max(c) AS DOUBLE) AS z_score,
      array_to_string(list_sort(list_distinct(flatten(list(kpis)))), ',') AS co FROM cr GROUP BY station_id, run),
  allev AS (SELECT station_id, kpi, type, t_start, t_end, magnitude, z_score, CASE WHEN z_score > 0 THEN 'up' ELSE 'down' END AS direction, '' AS co FROM level_ev
    UNION ALL SELECT station_id, kpi, type, t_start, t_end, magnitude, z_score, CASE WHEN z_score > 0 THEN 'up' ELSE 'down' END, '' FROM spike_ev
    UNION ALL SELECT station_id, kpi, type, t_start, t_end, magnitude, z_score, direction, '' FROM trend_ev
    UNION ALL SELECT station_id, 'MULTI', 'multi_kpi', t_start, t_end, z_score, z_score, 'mixed', co FROM multi_ev),
  rk AS (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY round(abs(z_score) * CASE WHEN type = 'multi_kpi' THEN 1.5 ELSE 1.0 END, 9) DESC,
      CASE WHEN kpi = 'MULTI' THEN 'zzz' ELSE kpi END, CASE type WHEN 'level_shift' THEN 0 WHEN 'spike' THEN 1 WHEN 'trend_break' THEN 2 ELSE 3 END, t_start) - 1 AS event_idx FROM allev),
  topev AS (SELECT * FROM rk WHERE event_idx < 10)
"""


def flat(df):
    return df.withColumn("co_occurring_kpis", F.array_join("co_occurring_kpis", ","))


def show(df):
    return tidy(flat(df), "magnitude", "z_score", digits=3)


COLS = f"station_id, kpi, type, t_start, t_end, {rnd('magnitude', 3)} AS magnitude, {rnd('z_score', 3)} AS z_score, direction, co AS co_occurring_kpis"


@query("baseline_moments", MOMENTS + f"SELECT station_id, kpi, {rnd('mu', 4)} AS mu, {rnd('sigma', 4)} AS sigma, {rnd('dsigma', 4)} AS dsigma, {rnd('last_value', 4)} AS last_value FROM mom")
def baseline_moments(spark, sf):
    return tidy(ev.baseline_moments(src.baseline(spark, sf)), "mu", "sigma", "dsigma", "last_value")


def _marks(spark, sf):
    return ev.hour_marks(line(spark, sf))


@query("ev_level_shift", EVENTS + f"SELECT {COLS} FROM allev WHERE type = 'level_shift'")
def ev_level_shift(spark, sf):
    return show(ev.of_type(line(spark, sf), src.dim(spark), "level_shift"))


@query("ev_spike", EVENTS + f"SELECT {COLS} FROM allev WHERE type = 'spike'")
def ev_spike(spark, sf):
    return show(ev.of_type(line(spark, sf), src.dim(spark), "spike"))


@query("ev_trend_break", EVENTS + f"SELECT {COLS} FROM allev WHERE type = 'trend_break'")
def ev_trend_break(spark, sf):
    return show(ev.of_type(line(spark, sf), src.dim(spark), "trend_break"))


@query("ev_multi_kpi", EVENTS + f"SELECT {COLS} FROM allev WHERE type = 'multi_kpi'")
def ev_multi_kpi(spark, sf):
    return show(ev.of_type(line(spark, sf), src.dim(spark), "multi_kpi"))


@query("ev_rank_topn", EVENTS + f"SELECT CAST(event_idx AS INTEGER) AS event_idx, {COLS} FROM topev")
def ev_rank_topn(spark, sf):
    return show(top_events(spark, sf))


@query(
    "ev_serialize",
    EVENTS + f"SELECT CAST(event_idx AS INTEGER) AS event_idx, station_id, kpi, type, t_start, t_end, t_end - t_start + 1 AS duration_h, {rnd('magnitude', 4)} AS magnitude, {rnd('z_score', 3)} AS z_score, direction, co AS co_occurring_kpis FROM topev",
)
def ev_serialize(spark, sf):
    return flat(ev.serialize(top_events(spark, sf)))


WKD = "CASE ({d}) % 7 WHEN 0 THEN 'Mon' WHEN 1 THEN 'Tue' WHEN 2 THEN 'Wed' WHEN 3 THEN 'Thu' WHEN 4 THEN 'Fri' WHEN 5 THEN 'Sat' ELSE 'Sun' END"
START_DAY = "('Day ' || (t_start // 24 + 1) || ' (' || " + WKD.format(d="t_start // 24") + " || ') ' || printf('%02d', t_start % 24) || ':00')"
END_DAY = "(CASE WHEN (t_end + 1) % 24 = 0 THEN (t_end + 1) // 24 - 1 ELSE (t_end + 1) // 24 END)"
END_HOUR = "printf('%02d', CASE WHEN (t_end + 1) % 24 = 0 THEN 24 ELSE (t_end + 1) % 24 END)"
LABEL = f"CASE WHEN t_start // 24 = {END_DAY} THEN {START_DAY} || '–' || {END_HOUR} || ':00' ELSE {START_DAY} || ' → Day ' || ({END_DAY} + 1) || ' (' || {WKD.format(d=END_DAY)} || ') ' || {END_HOUR} || ':00' END"


@query("event_time_label", EVENTS + f"SELECT station_id, kpi, type, t_start, t_end, {LABEL} AS hour_window_label FROM allev")
def event_time_label(spark, sf):
    labelled = ev.with_time_labels(all_events(spark, sf))
    return labelled.select("station_id", "kpi", "type", "t_start", "t_end", "hour_window_label")


@query(
    "ev_filter_type",
    EVENTS + f"SELECT station_id, CAST(event_idx AS INTEGER) AS event_idx, kpi, t_start // 24 + 1 AS forecast_day, {WKD.format(d='t_start // 24')} AS weekday_label, {LABEL} AS hour_window_label, count(*) OVER (PARTITION BY station_id) AS n_selected FROM topev WHERE type = 'level_shift'",
)
def ev_filter_type(spark, sf):
    out = ev.filter_type(top_events(spark, sf), "level_shift")
    return out.select("station_id", "event_idx", "kpi", "forecast_day", "weekday_label", "hour_window_label", "n_selected")


@query("ev_for_kpi", EVENTS + f"SELECT CAST(event_idx AS INTEGER) AS event_idx, {COLS} FROM topev WHERE kpi = 'click' OR list_contains(string_split(co, ','), 'click')")
def ev_for_kpi(spark, sf):
    return show(ev.for_kpi(top_events(spark, sf), "click"))


def _edge_values():
    return ", ".join(f"('{s}', '{t}', '{r}', '{g}', {i})" for i, (s, t, r, g) in enumerate(KPI_EDGES))


RANK = "CASE strength WHEN 'critical' THEN 4 WHEN 'strong' THEN 3 WHEN 'moderate' THEN 2 WHEN 'weak' THEN 1 WHEN 'extracted' THEN 1 ELSE 0 END"

CAUSES = EVENTS + f""", edge AS (SELECT * FROM (VALUES {_edge_values()}) e(source_kpi, target_kpi, relation_type, strength, edge_ord)),
  te AS (SELECT t.station_id, t.event_idx, t.t_start, t.t_end, t.direction AS target_direction, e.* FROM rk t JOIN edge e ON t.kpi = e.target_kpi WHERE t.kpi <> 'MULTI'),
  cp AS (SELECT te.*, s.type AS src_type, s.t_start AS src_t_start, s.t_end AS src_t_end, {rnd('s.magnitude', 4)} AS src_magnitude, {rnd('s.z_score', 3)} AS src_z_score, s.direction AS src_direction,
      s.t_start - te.t_start AS lag_hours, row_number() OVER (PARTITION BY te.station_id, te.event_idx, te.edge_ord ORDER BY abs(s.z_score) DESC, s.event_idx) AS r
    FROM te JOIN rk s ON s.station_id = te.station_id AND s.kpi = te.source_kpi AND s.t_end + 6 >= te.t_start AND s.t_start - 6 <= te.t_end),
  conc AS (SELECT *, CASE WHEN src_direction = 'mixed' OR target_direction = 'mixed' THEN NULL WHEN relation_type IN ('DECREASES', 'LIMITS') THEN src_direction <> target_direction
      WHEN relation_type IN ('INCREASES', 'DETERMINES', 'CAUSES') THEN src_direction = target_direction END AS consistent FROM cp WHERE r = 1),
  bg0 AS (SELECT te.station_id, te.event_idx, te.edge_ord, te.source_kpi, te.relation_type, te.strength, avg(w.pred) AS mean_during_event FROM te
      ANTI JOIN conc ON conc.station_id = te.station_id AND conc.event_idx = te.event_idx AND conc.edge_ord = te.edge_ord
      JOIN wk w ON w.station_id = te.station_id AND w.kpi = te.source_kpi AND w.h BETWEEN te.t_start AND te.t_end GROUP BY ALL),
  bm AS (SELECT station_id, kpi, avg(value) AS baseline_mean, CASE WHEN stddev_pop(value) = 0 THEN 1.0 ELSE stddev_pop(value) END AS sd FROM base GROUP BY 1, 2),
  bg AS (SELECT b.*, m.baseline_mean, (mean_during_event - m.baseline_mean) / m.sd AS z_deviation FROM bg0 b JOIN bm m ON m.station_id = b.station_id AND m.kpi = b.source_kpi
      WHERE abs((mean_during_event - m.baseline_mean) / m.sd) >= 1.5),
  cu AS (SELECT station_id, event_idx, edge_ord, source_kpi, relation_type, strength, 1 AS has_concurrent, src_z_score, lag_hours, consistent, NULL::DOUBLE AS z_deviation FROM conc
    UNION ALL SELECT station_id, event_idx, edge_ord, source_kpi, relation_type, strength, 0, NULL, NULL, NULL, z_deviation FROM bg),
  cr2 AS (SELECT *, row_number() OVER (PARTITION BY station_id, event_idx ORDER BY has_concurrent DESC, {RANK} DESC, abs(coalesce(src_z_score, 0)) DESC,
      abs(coalesce(lag_hours, 0)), CASE WHEN consistent THEN 1 ELSE 0 END DESC, edge_ord) AS rnk FROM cu)
"""


@query(
    "cause_concurrent",
    CAUSES + "SELECT station_id, CAST(event_idx AS INTEGER) AS event_idx, source_kpi, src_type, src_t_start, src_t_end, src_magnitude, src_z_score, src_direction, lag_hours FROM conc",
)
def cause_concurrent(spark, sf):
    return cz.concurrent(all_ranked(spark, sf), edges(spark)).select(
        "station_id", "event_idx", "source_kpi", "src_type", "src_t_start", "src_t_end", "src_magnitude", "src_z_score", "src_direction", "lag_hours"
    )


@query("cause_direction", CAUSES + "SELECT station_id, CAST(event_idx AS INTEGER) AS event_idx, source_kpi, relation_type, src_direction, target_direction, consistent FROM conc")
def cause_direction(spark, sf):
    return cz.concurrent(all_ranked(spark, sf), edges(spark)).select(
        "station_id", "event_idx", "source_kpi", "relation_type", "src_direction", "target_direction", "consistent"
    )


@query(
    "cause_background",
    CAUSES + f"SELECT station_id, CAST(event_idx AS INTEGER) AS event_idx, source_kpi, {rnd('mean_during_event', 4)} AS mean_during_event, {rnd('baseline_mean', 4)} AS baseline_mean, {rnd('z_deviation', 3)} AS z_deviation FROM bg",
)
def cause_background(spark, sf):
    events, e = all_ranked(spark, sf), edges(spark)
    out = cz.background(events, e, _marks(spark, sf))
    out = tidy(tidy(out, "mean_during_event", "baseline_mean"), "z_deviation", digits=3)
    return out.select("station_id", "event_idx", "source_kpi", "mean_during_event", "baseline_mean", "z_deviation")


def _single(spark, sf):
    return cz.rank_causes(cz.weighed(cz.edge_evidence(all_ranked(spark, sf), edges(spark)), _marks(spark, sf)))


@query(
    "cause_rank",
    CAUSES + f"SELECT station_id, CAST(event_idx AS INTEGER) AS event_idx, source_kpi, strength, has_concurrent, {rnd('src_z_score', 3)} AS src_z_score, lag_hours, consistent, {rnd('z_deviation', 3)} AS z_deviation, CAST(rnk AS INTEGER) AS rank FROM cr2 WHERE rnk <= 5",
)
def cause_rank(spark, sf):
    out = _single(spark, sf).select(
        "station_id", "event_idx", "source_kpi", "strength", "has_concurrent", "src_z_score", "lag_hours", "consistent", "z_deviation", "rank"
    )
    return tidy(out, "src_z_score", "z_deviation", digits=3)


@query(
    "cause_multi",
    CAUSES + f""", mc AS (SELECT t.station_id, t.event_idx, e.*, row_number() OVER (PARTITION BY t.station_id, t.event_idx ORDER BY {RANK} DESC, source_kpi, target_kpi) AS rnk
      FROM rk t JOIN edge e ON list_contains(string_split(t.co, ','), e.source_kpi) AND list_contains(string_split(t.co, ','), e.target_kpi) WHERE t.type = 'multi_kpi')
    SELECT station_id, CAST(event_idx AS INTEGER) AS event_idx, CAST(rnk AS INTEGER) AS rank, source_kpi, target_kpi, relation_type, strength FROM mc WHERE rnk <= 5""",
)
def cause_multi(spark, sf):
    every = ev.rank_topn(all_events(spark, sf), src.dim(spark), top_n=None)
    return cz.multi_causes(every, edges(spark)).drop("edge_ord")


JOINT = f"""SELECT t.station_id, t.event_idx, e.*, row_number() OVER (PARTITION BY t.station_id, t.event_idx ORDER BY {RANK} DESC, source_kpi, target_kpi) AS rnk
      FROM rk t JOIN edge e ON list_contains(string_split(t.co, ','), e.source_kpi) AND list_contains(string_split(t.co, ','), e.target_kpi) WHERE t.type = 'multi_kpi'"""


def all_causes(spark, sf, events):
    return cz.infer(events, edges(spark), _marks(spark, sf))


@query(
    "pairs_from_causes",
    CAUSES + f""", mc AS ({JOINT})
    SELECT c.station_id, c.source_kpi, t.kpi AS target_kpi FROM cr2 c JOIN rk t ON t.station_id = c.station_id AND t.event_idx = c.event_idx WHERE rnk <= 5
    UNION SELECT station_id, source_kpi, 'MULTI' FROM mc WHERE rnk <= 5""",
)
def pairs_from_causes(spark, sf):
    events = all_ranked(spark, sf)
    return cz.pairs_from_causes(events, all_causes(spark, sf, events))


# Map elements: the parts a supplier ships, tagged from their size and type.


def elements(spark, sf):
    shipped = load(spark, sf, "lineitem").select(F.col("l_suppkey").alias("station_id"), F.col("l_partkey").alias("p_partkey")).distinct()
    parts = load(spark, sf, "part").select("p_partkey", "p_size", F.lower("p_type").alias("kind"))
    size, kind = F.col("p_size"), F.col("kind")

    def tag(cond, key, value):
        return F.when(cond, F.struct(F.lit(key).alias("key"), value.cast("string").alias("value")))

    land = F.when(size > 40, "commercial").when(size > 20, "residential").when(size > 10, "forest").otherwise("retail")
    tags = [
        tag(size % 5 == 0, "amenity", kind),
        tag(size % 5 == 1, "shop", kind),
        tag(size % 5 == 2, "landuse", land),
        tag(size % 5 == 3, "building", F.lit("yes")),
        tag((size % 5 == 3) & (size > 25), "height", F.concat(size, F.lit(" m"))),
        tag((size % 5 == 3) & (size <= 25), "building:levels", size),
        tag((size % 5 == 4) & (size < 25), "highway", F.lit("bus_stop")),
        tag((size % 5 == 4) & (size >= 45), "man_made", F.lit("mast")),
    ]
    return shipped.join(parts, "p_partkey").select(
        "station_id", F.col("p_partkey").alias("elem_id"), F.map_from_entries(F.array_compact(F.array(*tags))).alias("tags")
    )


ELEMENTS = """WITH el AS (SELECT DISTINCT l_suppkey AS station_id, l_partkey FROM lineitem),
  el2 AS (SELECT station_id, p_size AS s, lower(p_type) AS kind, CASE WHEN p_size > 40 THEN 'commercial' WHEN p_size > 20 THEN 'residential' WHEN p_size > 10 THEN 'forest' ELSE 'retail' END AS land,
    CASE WHEN p_size > 25 THEN p_size * 1.0 ELSE p_size * 3.0 END::DOUBLE AS hgt FROM el JOIN part ON p_partkey = l_partkey),
  a0 AS (SELECT station_id, count(*) FILTER (s % 5 <= 1) AS poi_count, coalesce(array_to_string(list_sort(list(DISTINCT land) FILTER (s % 5 = 2)), ','), '') AS land_use,
    count(*) FILTER (s % 5 = 3) AS building_count, avg(hgt) FILTER (s % 5 = 3) AS avg_h, max(hgt) FILTER (s % 5 = 3) AS max_h,
    count(*) FILTER (s % 5 = 4 AND s < 25) AS transit_hubs, count(*) FILTER (s % 5 = 4 AND s >= 45) AS telecom_masts FROM el2 GROUP BY 1),
  a1 AS (SELECT *, CASE WHEN poi_count > 30 THEN 'High' WHEN poi_count > 10 THEN 'Medium' WHEN poi_count > 0 THEN 'Low' ELSE 'Very Low' END AS band,
    CASE WHEN land_use LIKE '%forest%' AND poi_count < 5 AND coalesce(avg_h, 0) < 10 THEN 'rural / low building density'
      WHEN coalesce(avg_h, 0) > 20 AND poi_count > 15 THEN 'dense urban with high buildings'
      WHEN poi_count > 10 OR transit_hubs > 2 THEN 'moderate urban street-level deployment'
      WHEN (land_use LIKE '%retail%' OR land_use LIKE '%commercial%') AND poi_count > 5 THEN 'indoor commercial/retail environment'
      WHEN poi_count < 5 AND coalesce(avg_h, 0) < 15 THEN 'sparse / low building density' ELSE 'default street-level deployment' END AS hint FROM a0)
"""


@query(
    "osm_aggregate",
    ELEMENTS + f"SELECT station_id, poi_count, land_use, building_count, {rnd('avg_h', 4)} AS avg_building_height_m, max_h AS max_building_height_m, transit_hubs, telecom_masts, band AS poi_density_band FROM a1",
)
def osm_aggregate(spark, sf):
    out = env.osm_aggregate(elements(spark, sf)).drop("environment_hint")
    return tidy(out, "avg_building_height_m").withColumn("land_use", F.array_join("land_use", ","))


@query("osm_env_class", ELEMENTS + "SELECT station_id, hint AS environment_hint FROM a1")
def osm_env_class(spark, sf):
    return env.osm_aggregate(elements(spark, sf)).select("station_id", "environment_hint")


@query(
    "osm_top_pois",
    ELEMENTS + """, p AS (SELECT station_id, CASE WHEN s % 5 = 0 THEN kind ELSE 'shop:' || kind END AS poi, count(*) AS n FROM el2 WHERE s % 5 <= 1 GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY n DESC, poi) AS rank FROM p) SELECT station_id, poi, n, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 8""",
)
def osm_top_pois(spark, sf):
    return env.top_pois(elements(spark, sf))


def parsed_env(spark, sf):
    agg = env.osm_aggregate(elements(spark, sf)).withColumn("avg_building_height_m", settle("avg_building_height_m", 1))
    return env.parse_summaries(agg.select("station_id", env.summary_text(agg).alias("text")))


@query(
    "osm_parse_text",
    ELEMENTS + f"""SELECT station_id, CASE WHEN poi_count > 0 THEN band END AS poi_density_band, poi_count, land_use, building_count, coalesce({rnd('avg_h', 1)}, 0) AS avg_building_height_m,
      coalesce(max_h, 0) AS max_building_height_m, transit_hubs, telecom_masts, hint AS environment_hint FROM a1""",
)
def osm_parse_text(spark, sf):
    out = parsed_env(spark, sf).drop("location", "area_type")
    return out.withColumn("land_use", F.array_join("land_use", ","))


@query(
    "env_factors",
    ELEMENTS + f""", b AS (SELECT *, coalesce({rnd('avg_h', 1)}, 0) AS h FROM a1),
    c AS (SELECT *, CASE WHEN h >= 25 THEN 'high_rise' WHEN h >= 10 THEN 'mid_rise' ELSE 'low_rise' END AS building_height_class FROM b)
    SELECT station_id, building_height_class, CASE WHEN transit_hubs >= 2 THEN 'near' WHEN transit_hubs = 1 THEN 'moderate' ELSE 'none' END AS transit_proximity,
      CASE WHEN telecom_masts >= 1 THEN 'present' ELSE 'none' END AS telecom_infra,
      concat_ws(', ', CASE WHEN poi_count > 0 THEN band || ' POI density (' || poi_count || ' POIs/500m)' END,
        replace(building_height_class, '_', '-') || CASE WHEN h > 0 THEN ' (avg ' || printf('%.1f', h) || 'm)' ELSE '' END,
        CASE WHEN transit_hubs > 0 THEN transit_hubs || ' transit ' || CASE WHEN transit_hubs = 1 THEN 'hub' ELSE 'hubs' END END,
        CASE WHEN telecom_masts > 0 THEN telecom_masts || ' telecom ' || CASE WHEN telecom_masts = 1 THEN 'mast' ELSE 'masts' END END) AS osm_summary FROM c""",
)
def env_factors(spark, sf):
    out = env.factor_classes(parsed_env(spark, sf))
    return out.select("station_id", "building_height_class", "transit_proximity", "telecom_infra", "osm_summary")


ATTACHED = CAUSES + f""", mc AS ({JOINT}),
  allc AS (SELECT station_id, event_idx, edge_ord, rnk, source_kpi, relation_type, strength, has_concurrent, lag_hours, consistent, false AS shared FROM cr2 WHERE rnk <= 5
    UNION ALL SELECT station_id, event_idx, edge_ord, rnk, source_kpi, relation_type, strength, NULL, NULL, NULL, true FROM mc WHERE rnk <= 5),
  said AS (SELECT station_id, event_idx, count(*) AS n_causes, string_agg(concat_ws(' ', source_kpi, relation_type, strength, 'TS 28.55' || (edge_ord % 4) || ' §5.' || edge_ord,
      CASE WHEN shared THEN 'shared' WHEN has_concurrent = 1 THEN 'lag ' || lag_hours ELSE 'background' END, CASE WHEN consistent THEN 'consistent' WHEN NOT consistent THEN 'inconsistent' END), '; ' ORDER BY rnk) AS causes
    FROM allc GROUP BY 1, 2)"""
ENVIRONMENT = ELEMENTS[5:].replace("a0 AS", "oa0 AS").replace("a1 AS", "oa1 AS").replace("FROM a0", "FROM oa0")


@query(
    "cause_attach",
    ATTACHED + ", " + ENVIRONMENT + f"""SELECT t.station_id, CAST(t.event_idx AS INTEGER) AS event_idx, t.kpi, t.type, coalesce(n_causes, 0)::INTEGER AS n_causes, coalesce(causes, '') AS causes,
      CASE WHEN o.station_id IS NOT NULL THEN CASE WHEN coalesce({rnd('avg_h', 1)}, 0) >= 25 THEN 'high_rise' WHEN coalesce({rnd('avg_h', 1)}, 0) >= 10 THEN 'mid_rise' ELSE 'low_rise' END END AS building_height_class, o.hint AS environment_hint
    FROM rk t LEFT JOIN said s ON s.station_id = t.station_id AND s.event_idx = t.event_idx LEFT JOIN oa1 o ON o.station_id = t.station_id""",
)
def cause_attach(spark, sf):
    """Enriched events as text: causes with reference and evidence, and the surroundings."""
    events = all_ranked(spark, sf)
    out = cz.attach(events, all_causes(spark, sf, events), edges(spark), env.factor_classes(parsed_env(spark, sf)))
    evidence = lambda c: F.when(c["shared_mechanism"], F.lit("shared")).when(c["has_concurrent"] == 1, F.concat(F.lit("lag "), c["lag_hours"].cast("string"))).otherwise("background")
    fits = lambda c: F.when(c["consistent"], "consistent").when(~c["consistent"], "inconsistent")
    told = F.transform("candidate_causes", lambda c: F.concat_ws(" ", c["source_kpi"], c["relation_type"], c["strength"], c["spec_reference"], evidence(c), fits(c)))
    context = F.col("environmental_context")
    return out.select(
        "station_id", "event_idx", "kpi", "type", F.size("candidate_causes").alias("n_causes"), F.array_join(told, "; ").alias("causes"),
        context["building_height_class"].alias("building_height_class"), context["environment_hint"].alias("environment_hint"),
    )


@query(
    "env_type",
    """WITH t AS (SELECT doc_id, lower(text) AS x FROM documents)
    SELECT doc_id, CASE WHEN x LIKE '%rural%' OR x LIKE '%rma%' THEN 'RMa' WHEN x LIKE '%indoor%' OR x LIKE '%inh%' THEN 'InH'
      WHEN x LIKE '%micro%' OR x LIKE '%umi%' OR x LIKE '%dense urban%' THEN 'UMi'
      WHEN x LIKE '%urban%' OR x LIKE '%uma%' OR x LIKE '%commercial%' OR x LIKE '%residential%' THEN 'UMa' ELSE 'UMa' END AS environment_type FROM t""",
)
def env_type(spark, sf):
    return load(spark, sf, "documents").select("doc_id", env.env_type("text").alias("environment_type"))


@query(
    "env_assessment_ingest",
    """WITH l AS (SELECT doc_id // 8 AS station_id, doc_id % 8 AS event_idx, quality, toxic FROM labels),
    e AS (SELECT DISTINCT doc_id // 8 AS station_id, i.i AS event_idx FROM labels, range(6) i(i))
    SELECT e.station_id, CAST(e.event_idx AS INTEGER) AS event_idx, CASE WHEN l.event_idx IS NOT NULL AND quality = 1 THEN 'quality ' || quality || ' seen' END AS assessment,
      CASE WHEN l.event_idx IS NOT NULL AND quality = 1 THEN CASE WHEN toxic = 1 THEN 'osm' ELSE 'none' END END AS primary_layer,
      CASE WHEN l.event_idx IS NOT NULL AND quality = 1 THEN 'poi_count' END AS cited
    FROM e LEFT JOIN l ON l.station_id = e.station_id AND l.event_idx = e.event_idx""",
)
def env_assessment_ingest(spark, sf):
    raw = load(spark, sf, "labels").withColumn("station_id", F.floor(F.col("doc_id") / 8))
    rec = F.struct(
        (F.col("doc_id") % 8).alias("event_id"),
        F.when(F.col("quality") == 1, F.format_string("quality %d seen", "quality")).otherwise(" ").alias("assessment"),
        F.when(F.col("toxic") == 1, "OSM").otherwise("weather").alias("primary_layer"),
        F.array(F.lit("poi_count"), F.lit("rainfall")).alias("cited_factors"),
    )
    answers = raw.groupBy("station_id").agg(
        F.format_string("```json\n%s\n```", F.to_json(F.struct(F.collect_list(rec).alias("events")))).alias("answer")
    )  # eight judged rows per station by construction
    events = raw.select("station_id").distinct().select("station_id", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("event_idx"))
    out = env.ingest_assessments(events, answers)
    return out.select(
        "station_id", "event_idx", "assessed.assessment", "assessed.primary_layer", F.array_join("assessed.cited_factors", ",").alias("cited")
    )
