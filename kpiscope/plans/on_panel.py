"""Queries on splits, slices, scaling, clamping and window features of the panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from kpiscope.functions import labels
from kpiscope.functions.exprs import settle
from kpiscope.operators import features, panel as ops
from kpiscope.plans import inputs as src
from kpiscope.plans.registry import FORECAST, PANEL, query, rnd
from kpiscope.sources.tables import SPLIT_HOUR, load


@query(
    "station_filter",
    PANEL + """SELECT station_id, kpi, count(*) AS hours FROM panel
    WHERE station_id IN (SELECT DISTINCT CAST(substr(p_brand, 7) AS BIGINT) FROM part) GROUP BY 1, 2""",
)
def station_filter(spark, sf):
    wanted = load(spark, sf, "part").select(F.regexp_replace("p_brand", "^Brand#", "station_").alias("station_id"))
    return ops.select_stations(src.panel(spark, sf), wanted).groupBy("station_id", "kpi").agg(F.count("*").alias("hours"))


@query(
    "split_holdout",
    PANEL + f"""SELECT station_id, kpi, CASE WHEN t > 719 - 168 THEN 'target' ELSE 'input' END AS split,
    count(*) AS hours, {rnd('avg(value)', 4)} AS mean_value, min(t) AS first_t, max(t) AS last_t
    FROM panel GROUP BY 1, 2, 3""",
)
def split_holdout(spark, sf):
    return (
        ops.split_holdout(src.panel(spark, sf))
        .groupBy("station_id", "kpi", "split")
        .agg(
            F.count("*").alias("hours"),
            settle(F.avg("value"), 4).alias("mean_value"),
            F.min("t").alias("first_t"),
            F.max("t").alias("last_t"),
        )
    )


@query(
    "split_train_val_test",
    PANEL + f"""SELECT station_id, CASE WHEN t < 480 THEN 'train' WHEN t < 552 THEN 'val' ELSE 'test' END AS split,
    count(*) AS cells, {rnd('avg(value)', 4)} AS mean_value FROM panel GROUP BY 1, 2""",
)
def split_train_val_test(spark, sf):
    return (
        ops.split_train_val_test(src.panel(spark, sf), 480, SPLIT_HOUR)
        .groupBy("station_id", "split")
        .agg(F.count("*").alias("cells"), settle(F.avg("value"), 4).alias("mean_value"))
    )


@query(
    "context_slice",
    PANEL + f"""SELECT station_id, kpi, count(*) AS hours, min(t) AS first_t, {rnd('avg(value)', 4)} AS mean_value
    FROM panel WHERE t < 552 AND t >= 552 - 336 GROUP BY 1, 2""",
)
def context_slice(spark, sf):
    return (
        ops.context_slice(src.inputs(spark, sf), 336, strict=True)
        .groupBy("station_id", "kpi")
        .agg(F.count("*").alias("hours"), F.min("t").alias("first_t"), settle(F.avg("value"), 4).alias("mean_value"))
    )


@query(
    "context_horizon_grid",
    PANEL + """SELECT d.station_id, h.h AS horizon_days, c.c AS context_days, c.c * 24 AS context_h
    FROM (SELECT station_id, (max(t) + 1) // 24 AS days FROM panel GROUP BY 1) d,
         (VALUES (1), (3), (7)) h(h), range(1, 31) c(c) WHERE c.c <= d.days - h.h""",
)
def context_horizon_grid(spark, sf):
    grid = ops.feasible_contexts(src.panel(spark, sf), [1, 3, 7])
    return grid.withColumn("context_h", F.col("context_days") * 24)


@query(
    "finetune_slices",
    PANEL + """, cut AS (SELECT station_id, '2' AS weeks, t FROM panel WHERE t >= 216 AND t < 552
      UNION ALL SELECT station_id, '3', t FROM panel WHERE t >= 48 AND t < 552
      UNION ALL SELECT station_id, 'full', t FROM panel WHERE t < 552),
    per AS (SELECT weeks, station_id, count(DISTINCT t) AS hours FROM cut GROUP BY 1, 2)
    SELECT weeks, station_id, hours, CAST(greatest(0, (hours - 336) // 24 + 1) AS INTEGER) AS n_windows,
      sum(CAST(greatest(0, (hours - 336) // 24 + 1) AS INTEGER)) OVER (PARTITION BY weeks)::BIGINT AS total_windows
    FROM per""",
)
def finetune_slices(spark, sf):
    panel = src.panel(spark, sf)
    parts = None
    for weeks in (2, 3, "full"):
        one = ops.finetune_slices(panel, weeks, end=SPLIT_HOUR).withColumn("weeks", F.lit(str(weeks)))
        parts = one if parts is None else parts.unionByName(one)
    totals = parts.groupBy("weeks").agg(F.sum("n_windows").alias("total_windows"))
    return parts.join(totals, "weeks").select("weeks", "station_id", "hours", "n_windows", "total_windows")


@query(
    "slice_train_val",
    """WITH r AS (SELECT s_suppkey, row_number() OVER (ORDER BY md5(CAST(s_suppkey AS VARCHAR) || ':42'), s_suppkey) AS pos,
      count(*) OVER () AS n FROM supplier)
    SELECT s_suppkey AS station_id, CASE WHEN pos > n - ceil(0.15 * n) THEN 'val' ELSE 'train' END AS part FROM r""",
)
def slice_train_val(spark, sf):
    return ops.slice_train_val(src.stations(spark, sf).select("station_id"))


@query(
    "regime_label",
    """SELECT c_custkey, c_nationkey AS weeks, CASE WHEN c_nationkey = 0 THEN 'zero' WHEN c_nationkey = 24 THEN 'full'
    ELSE 'few' END AS regime FROM customer""",
)
def regime_label(spark, sf):
    weeks = F.when(F.col("c_nationkey") == 24, F.lit("full")).otherwise(F.col("c_nationkey").cast("string"))
    return load(spark, sf, "customer").select(
        "c_custkey", F.col("c_nationkey").alias("weeks"), ops.regime_label(weeks).alias("regime")
    )


@query(
    "site_group",
    """SELECT s_nationkey::VARCHAR AS site_group, count(*) AS stations FROM supplier GROUP BY 1""",
)
def site_group(spark, sf):
    ids = load(spark, sf, "supplier").select(
        F.concat_ws("_", F.lit("station"), "s_nationkey", "s_suppkey").alias("station_id")
    )
    return ids.groupBy(ops.site_group("station_id").alias("site_group")).agg(F.count("*").alias("stations"))


@query(
    "cumulative_group_split",
    """WITH g AS (SELECT s_nationkey, row_number() OVER (ORDER BY md5(CAST(s_nationkey AS VARCHAR) || ':42'), s_nationkey) AS rk
      FROM (SELECT DISTINCT s_nationkey FROM supplier))
    SELECT s.s_suppkey AS station_id, s.s_nationkey AS site_group, n.n AS n_train_groups,
      CASE WHEN g.rk <= n.n THEN 'train' ELSE 'test' END AS part
    FROM supplier s JOIN g USING (s_nationkey), (VALUES (0), (1), (2), (4)) n(n)""",
)
def cumulative_group_split(spark, sf):
    return ops.cumulative_group_split(src.stations(spark, sf), [0, 1, 2, 4]).drop("group_rank")


@query(
    "leak_check",
    """SELECT s_nationkey AS station_id FROM supplier GROUP BY 1
    HAVING max(CASE WHEN s_acctbal > 0 THEN 1 ELSE 0 END) = 1 AND max(CASE WHEN s_acctbal <= 0 THEN 1 ELSE 0 END) = 1""",
)
def leak_check(spark, sf):
    part = F.when(F.col("s_acctbal") > 0, "train").otherwise("test")
    return ops.leaked_stations(
        load(spark, sf, "supplier").select(F.col("s_nationkey").alias("station_id"), part.alias("part"))
    )


@query(
    "revin",
    PANEL + f""", m AS (SELECT station_id, kpi, t, value, avg(value) OVER w AS mean,
      CASE WHEN stddev_pop(value) OVER w < 1e-5 THEN 1.0 ELSE stddev_pop(value) OVER w END AS std
      FROM panel WHERE t < 552 WINDOW w AS (PARTITION BY station_id, kpi))
    SELECT station_id, kpi, t, {rnd('(value - mean) / std', 4)} AS normalized,
      {rnd('value', 4)} AS restored FROM m""",
)
def revin(spark, sf):
    out = ops.revert_revin(ops.revin(src.inputs(spark, sf)))
    return out.select(
        "station_id", "kpi", "t", settle("normalized", 4).alias("normalized"), settle("restored", 4).alias("restored")
    )


@query(
    "scaler_inverse",
    PANEL + f""", s AS (SELECT station_id, kpi, min(value) AS lo, max(value) AS hi, median(value) AS center,
      quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS spread FROM panel WHERE t < 552 GROUP BY 1, 2)
    SELECT station_id, kpi, {rnd('0.5 * (hi - lo) + lo', 4)} AS min_max, {rnd('0.5 * spread + center', 4)} AS robust,
      0.5::DOUBLE AS identity FROM s""",
)
def scaler_inverse(spark, sf):
    scales = ops.series_scales(src.inputs(spark, sf)).withColumn("r", F.lit(0.5))
    return scales.select(
        "station_id",
        "kpi",
        settle(ops.scaler_inverse("r", "min_max"), 4).alias("min_max"),
        settle(ops.scaler_inverse("r", "custom_robust"), 4).alias("robust"),
        ops.scaler_inverse("r", "identity").alias("identity"),
    )


@query(
    "physical_clamp",
    FORECAST + f"""SELECT station_id, kpi, h, CASE WHEN kpi = 'signup' THEN round_even(least(greatest(pred * 4 - 100, 0), 500), 0)
      ELSE {rnd('least(greatest(pred * 4 - 100, 0), 500)', 4)} END AS pred FROM fc""",
)
def physical_clamp(spark, sf):
    stretched = src.forecast(spark, sf).withColumn("pred", F.col("pred") * 4 - 100)
    out = ops.physical_clamp(stretched, src.dim(spark), round_integers=True)
    return out.select("station_id", "kpi", "h", settle("pred", 4).alias("pred"))


def _ratio_factors(spark, sf):
    """Target mean over input mean as a proposed factor."""
    mean = ops.split_holdout(src.panel(spark, sf)).groupBy("station_id", "kpi").agg(
        F.avg(F.when(F.col("split") == "target", F.col("value"))).alias("a"),
        F.avg(F.when(F.col("split") == "input", F.col("value"))).alias("b"),
    )
    return mean.select("station_id", "kpi", (F.when(F.col("b") > 0, F.col("a") / F.col("b"))).alias("factor"))


FACTORS = FORECAST + """, raw AS (SELECT station_id, kpi, avg(value) FILTER (t >= 552) AS a, avg(value) FILTER (t < 552) AS b
    FROM panel GROUP BY 1, 2),
  fac AS (SELECT station_id, kpi, least(greatest(a / b, 0.85), 1.15) AS factor FROM raw WHERE b > 0
    AND abs(least(greatest(a / b, 0.85), 1.15) - 1) >= 1e-6)"""


@query(
    "adjust_factors",
    FACTORS + f"""SELECT f.station_id, f.kpi, f.h, {rnd('f.pred * coalesce(a.factor, 1)', 4)} AS pred
    FROM fc f LEFT JOIN fac a ON a.station_id = f.station_id AND a.kpi = f.kpi""",
)
def adjust_factors(spark, sf):
    factors = ops.usable_factors(_ratio_factors(spark, sf), src.dim(spark))
    out = ops.apply_factors(src.forecast(spark, sf), factors)
    return out.select("station_id", "kpi", "h", settle("pred", 4).alias("pred"))


@query(
    "adjust_gate",
    FACTORS + f""", v AS (SELECT *, sum(CASE WHEN abs(factor - 1) >= 0.05 THEN 1 ELSE 0 END) OVER (PARTITION BY station_id) AS n FROM fac)
    SELECT station_id, kpi, {rnd('factor', 4)} AS factor, CAST(n AS BIGINT) AS strong_signals FROM v WHERE n >= 3""",
)
def adjust_gate(spark, sf):
    gated = ops.gate_factors(ops.usable_factors(_ratio_factors(spark, sf), src.dim(spark)))
    return gated.select("station_id", "kpi", settle("factor", 4).alias("factor"), "strong_signals")


@query(
    "edge_pad",
    PANEL + f""", long AS (SELECT station_id, kpi, t - 208 AS pos, value FROM panel WHERE t >= 208),
    pad AS (SELECT g.station_id, g.kpi, p.p AS pos, g.value FROM (SELECT * FROM panel WHERE t = 552) g, range(344) p(p)
      UNION ALL SELECT station_id, kpi, t - 552 + 344, value FROM panel WHERE t >= 552),
    tail AS (SELECT station_id, kpi, t AS h, value FROM panel WHERE t < 100
      UNION ALL SELECT g.station_id, g.kpi, p.p, g.value FROM (SELECT * FROM panel WHERE t = 99) g, range(100, 168) p(p))
    SELECT 'cut' AS side, station_id, kpi, count(*) AS n, {rnd('sum(pos * value) / 512', 3)} AS weighted FROM long GROUP BY 2, 3
    UNION ALL SELECT 'left', station_id, kpi, count(*), {rnd('sum(pos * value) / 512', 3)} FROM pad GROUP BY 2, 3
    UNION ALL SELECT 'right', station_id, kpi, count(*), {rnd('sum(h * value) / 512', 3)} FROM tail GROUP BY 2, 3""",
)
def edge_pad(spark, sf):
    def total(df, side, pos):
        return df.groupBy(F.lit(side).alias("side"), "station_id", "kpi").agg(
            F.count("*").alias("n"), settle(F.sum(F.col(pos) * F.col("value")) / 512, 3).alias("weighted")
        )

    panel = src.panel(spark, sf)
    short = panel.filter(F.col("t") >= SPLIT_HOUR)
    first = panel.filter("t < 100").select("station_id", "kpi", F.col("t").alias("h"), F.col("value").alias("pred"))
    right = ops.extend_forecast(first, 168).withColumnRenamed("pred", "value")
    return (
        total(ops.edge_pad(panel, 512), "cut", "pos")
        .unionByName(total(ops.edge_pad(short, 512), "left", "pos"))
        .unionByName(total(right, "right", "h"))
    )


@query(
    "calendar_features",
    """SELECT event_id, year(ts) AS year, month(ts) AS month, day(ts) AS day, isodow(ts) AS dow, dayofyear(ts) AS doy,
    hour(ts) AS hour, minute(ts) AS minute FROM events""",
)
def calendar_features(spark, sf):
    return load(spark, sf, "events").select("event_id", *ops.calendar_features("ts"))


@query(
    "hour_period",
    """SELECT CASE WHEN h >= 6 AND h < 10 THEN 'morning-rush' WHEN h >= 10 AND h < 16 THEN 'midday'
      WHEN h >= 16 AND h < 20 THEN 'evening-rush' ELSE 'night' END AS period, count(*) AS n
    FROM (SELECT hour(ts) AS h FROM events) GROUP BY 1""",
)
def hour_period(spark, sf):
    return load(spark, sf, "events").groupBy(labels.hour_period(F.hour("ts")).alias("period")).agg(F.count("*").alias("n"))


@query(
    "validate_panel",
    """WITH o AS (SELECT user_id // 5 AS station_id, event_type AS kpi, date_diff('hour', TIMESTAMP '2024-01-01', ts) AS t
      FROM events GROUP BY 1, 2, 3)
    SELECT station_id, CAST(0 AS BIGINT) AS non_finite, sum(CASE WHEN n <> 720 THEN 1 ELSE 0 END)::BIGINT AS wrong_length,
      CAST(0 AS BIGINT) AS duplicate_hours, sum(CASE WHEN kpi = 'error' THEN 1 ELSE 0 END)::BIGINT AS unknown_kpis
    FROM (SELECT station_id, kpi, count(*) AS n FROM o GROUP BY 1, 2) GROUP BY 1""",
)
def validate_panel(spark, sf):
    from kpiscope.sources.tables import hourly_observations

    known = src.dim(spark).filter("kpi <> 'error'")
    return ops.panel_violations(hourly_observations(spark, sf), known, 720)


@query(
    "nonflat_check",
    PANEL + f"""SELECT station_id, kpi, {rnd('stddev_pop(value)', 4)} AS std FROM panel WHERE t >= 552
    GROUP BY 1, 2 HAVING stddev_pop(value) < 1e-3""",
)
def nonflat_check(spark, sf):
    week = src.target(spark, sf).withColumnRenamed("truth", "pred")
    return ops.flat_forecasts(week).select("station_id", "kpi", settle("std", 4).alias("std"))


@query(
    "step_diff",
    FORECAST + f""", s AS (SELECT station_id, kpi, h, pred FROM fc UNION ALL SELECT station_id, kpi, -1, value FROM panel WHERE t = 551),
    d AS (SELECT station_id, kpi, h, pred - lag(pred) OVER (PARTITION BY station_id, kpi ORDER BY h) AS diff FROM s)
    SELECT station_id, kpi, h, {rnd('diff', 4)} AS diff FROM d WHERE h >= 0""",
)
def step_diff(spark, sf):
    out = ops.step_diff(src.inputs(spark, sf), src.forecast(spark, sf))
    return out.select("station_id", "kpi", "h", settle("diff", 4).alias("diff"))


@query(
    "seasonal_diff",
    PANEL + f""", d AS (SELECT station_id, kpi, t, value - lag(value, 24) OVER (PARTITION BY station_id, kpi ORDER BY t) AS diff FROM panel)
    SELECT station_id, kpi, t, {rnd('diff', 4)} AS diff FROM d WHERE diff IS NOT NULL""",
)
def seasonal_diff(spark, sf):
    return features.seasonal_diff(src.panel(spark, sf)).select("station_id", "kpi", "t", settle("diff", 4).alias("diff"))


SLOPES = FORECAST + """, ma AS (SELECT station_id, kpi, h, avg(pred) OVER w AS m, count(*) OVER w AS n FROM fc
    WINDOW w AS (PARTITION BY station_id, kpi ORDER BY h ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)),
  slopes AS (SELECT station_id, kpi, h - 12 AS i, m - lag(m) OVER (PARTITION BY station_id, kpi ORDER BY h) AS slope
    FROM ma WHERE n = 12)"""


@query(
    "rolling_mean_slope",
    SLOPES + f"""SELECT station_id, kpi, i, {rnd('slope', 4)} AS slope FROM slopes WHERE slope IS NOT NULL""",
)
def rolling_mean_slope(spark, sf):
    out = features.rolling_mean_slope(src.forecast(spark, sf))
    return out.select("station_id", "kpi", "i", settle("slope", 4).alias("slope"))


@query(
    "deseasonalize",
    PANEL + f""", m AS (SELECT station_id, kpi, t, avg(value) OVER w AS a, count(*) OVER w AS n FROM panel WHERE t < 552
      WINDOW w AS (PARTITION BY station_id, kpi ORDER BY t ROWS BETWEEN 23 PRECEDING AND CURRENT ROW))
    SELECT station_id, kpi, t - 23 AS i, {rnd('a', 4)} AS moving_avg FROM m WHERE n = 24""",
)
def deseasonalize(spark, sf):
    out = features.deseasonalize(src.inputs(spark, sf))
    return out.select("station_id", "kpi", "i", settle("moving_avg", 4).alias("moving_avg"))


@query(
    "gaps_islands",
    PANEL + """, o AS (SELECT station_id, kpi, t, t - row_number() OVER (PARTITION BY station_id, kpi ORDER BY t) AS run
      FROM panel WHERE value > 60)
    SELECT station_id, kpi, min(t) AS t_start, max(t) AS t_end, count(*) AS duration FROM o GROUP BY station_id, kpi, run
    HAVING count(*) >= 2""",
)
def gaps_islands(spark, sf):
    return features.islands(src.panel(spark, sf), F.col("value") > 60, ("station_id", "kpi"), "t", 2)


@query(
    "supervised_windows",
    PANEL + f"""SELECT p.station_id, p.kpi, s.s AS "start", {rnd('avg(value) FILTER (t < s.s + 168)', 4)} AS x_mean,
      {rnd('avg(value) FILTER (t >= s.s + 168)', 4)} AS y_mean, max(CASE WHEN t = s.s + 168 THEN {rnd('value', 4)} END) AS y_first
    FROM panel p JOIN range(0, 720 - 336 + 1, 24) s(s) ON p.t >= s.s AND p.t < s.s + 336 GROUP BY 1, 2, 3""",
)
def supervised_windows(spark, sf):
    w = features.supervised_windows(src.panel(spark, sf), 168, 168, 24)
    return w.select(
        "station_id",
        "kpi",
        "start",
        settle(features.array_mean(F.col("x")), 4).alias("x_mean"),
        settle(features.array_mean(F.col("y")), 4).alias("y_mean"),
        settle(F.element_at("y", 1), 4).alias("y_first"),
    )


@query(
    "lag_features",
    PANEL + f"""SELECT p.station_id, p.kpi, s.s AS "start", {rnd('avg(value)', 4)} AS x_mean, {rnd('stddev_pop(value)', 4)} AS x_std,
      {rnd('max(CASE WHEN t = s.s + 71 THEN value END)', 4)} AS x_last, {rnd('max(CASE WHEN t = s.s THEN value END)', 4)} AS x_first, count(*) AS n_lags
    FROM panel p JOIN range(0, 552 - 240 + 1, 24) s(s) ON p.t >= s.s AND p.t < s.s + 72 GROUP BY 1, 2, 3""",
)
def lag_features(spark, sf):
    w = features.lag_features(features.supervised_windows(src.inputs(spark, sf), 72, 168, 24))
    return w.select(
        "station_id",
        "kpi",
        "start",
        settle("x_mean", 4).alias("x_mean"),
        settle("x_std", 4).alias("x_std"),
        settle("x_last", 4).alias("x_last"),
        settle(F.element_at("x", 1), 4).alias("x_first"),
        F.size("x").cast("long").alias("n_lags"),
    )


@query(
    "mda_steps",
    FORECAST + f""", d AS (SELECT station_id, kpi, sign(pred - lag(pred) OVER w) AS a, sign(truth - lag(truth) OVER w) AS b FROM fc
      WINDOW w AS (PARTITION BY station_id, kpi ORDER BY h))
    SELECT station_id, kpi, {rnd('avg(CASE WHEN a = b THEN 1.0 ELSE 0.0 END)', 6)} AS mda FROM d WHERE a IS NOT NULL GROUP BY 1, 2""",
)
def mda_steps(spark, sf):
    return features.mda_steps(src.scored(spark, sf)).select("station_id", "kpi", settle("mda", 6).alias("mda"))
