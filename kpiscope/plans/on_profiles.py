"""Queries on series profiles and forecast summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from kpiscope.functions.exprs import settle
from kpiscope.operators import metrics as acc
from kpiscope.operators import profiles as ops
from kpiscope.plans import inputs as src
from kpiscope.plans.registry import FORECAST, PANEL, query, rnd
from kpiscope.sources.tables import load


def tidy(df, *names, digits=4):
    for n in names:
        df = df.withColumn(n, settle(n, digits))
    return df


@query(
    "input_stats",
    PANEL + f""", s AS (SELECT station_id, kpi, avg(value) AS mean, stddev_pop(value) AS std, min(value) AS mn, max(value) AS mx,
      avg(value) FILTER (t >= 384) - avg(value) FILTER (t < 168) AS trend FROM panel WHERE t < 552 GROUP BY 1, 2)
    SELECT station_id, kpi, {rnd('mean', 4)} AS mean, {rnd('std', 4)} AS std, {rnd('mn', 4)} AS min, {rnd('mx', 4)} AS max, {rnd('trend', 4)} AS trend,
      {rnd('greatest(0, mean - 3 * std + least(0, trend * 2))', 4)} AS pred_min,
      {rnd('mean + 3 * std + greatest(0, trend * 2)', 4)} AS pred_max, {rnd('mean + trend', 4)} AS pred_mean_expected FROM s""",
)
def input_stats(spark, sf):
    out = ops.input_stats(src.inputs(spark, sf))
    return tidy(out, "mean", "std", "min", "max", "trend", "pred_min", "pred_max", "pred_mean_expected")


@query(
    "kpi_summary",
    PANEL + f""", s AS (SELECT station_id, kpi, max(value) - min(value) AS amplitude, avg(value) FILTER (t < 276) AS a,
      avg(value) FILTER (t >= 276) AS b FROM panel WHERE t < 552 GROUP BY 1, 2),
    p AS (SELECT *, (b - a) / (a + 1e-8) * 100 AS pct FROM s)
    SELECT station_id, kpi, {rnd('amplitude', 4)} AS amplitude, {rnd('a', 4)} AS first_half, {rnd('b', 4)} AS second_half,
      {rnd('pct', 3)} AS trend_pct, CASE WHEN pct > 5 THEN 'UP' WHEN pct < -5 THEN 'DOWN' ELSE 'STABLE' END AS trend FROM p""",
)
def kpi_summary(spark, sf):
    out = ops.kpi_summary(src.inputs(spark, sf))
    return tidy(tidy(out, "amplitude", "first_half", "second_half"), "trend_pct", digits=3)


@query(
    "daily_means",
    PANEL + f"""SELECT station_id, kpi, t // 24 AS day, {rnd('avg(value)', 4)} AS day_mean FROM panel WHERE t < 552 GROUP BY 1, 2, 3""",
)
def daily_means(spark, sf):
    return tidy(ops.daily_means(src.inputs(spark, sf)), "day_mean")


@query(
    "diurnal_profile",
    PANEL + f""", h AS (SELECT station_id, kpi, t % 24 AS hour, avg(value) AS mean, {rnd('avg(value)', 6)} AS m FROM panel WHERE t < 552 GROUP BY 1, 2, 3)
    SELECT station_id, kpi, hour, {rnd('mean', 4)} AS hour_mean,
      first_value(hour) OVER (PARTITION BY station_id, kpi ORDER BY m DESC, hour) AS peak_hour,
      first_value(hour) OVER (PARTITION BY station_id, kpi ORDER BY m, hour) AS trough_hour FROM h""",
)
def diurnal_profile(spark, sf):
    return tidy(ops.diurnal_profile(src.inputs(spark, sf)), "hour_mean")


@query(
    "hour_of_week_baseline",
    PANEL + f"""SELECT station_id, kpi, t % 168 AS h, {rnd('median(value)', 4)} AS baseline FROM panel WHERE t < 504 GROUP BY 1, 2, 3""",
)
def hour_of_week_baseline(spark, sf):
    return tidy(ops.hour_of_week_baseline(src.inputs(spark, sf)), "baseline")


@query(
    "cv_uncertainty",
    PANEL + f""", c AS (SELECT station_id, kpi, stddev_pop(value) / (avg(abs(value)) + 1e-8) AS cv FROM panel WHERE t >= 216 AND t < 552 GROUP BY 1, 2)
    SELECT station_id, kpi, {rnd('cv', 4)} AS cv, CASE WHEN cv > 0.3 THEN 'HIGH' WHEN cv > 0.1 THEN 'moderate' ELSE 'LOW' END AS uncertainty FROM c""",
)
def cv_uncertainty(spark, sf):
    return tidy(ops.cv_uncertainty(src.inputs(spark, sf)), "cv")


@query(
    "drift_ratio",
    FORECAST + f""", r AS (SELECT station_id, kpi, avg(value) AS recent_mean FROM panel WHERE t >= 384 AND t < 552 GROUP BY 1, 2),
    f AS (SELECT station_id, kpi, avg(pred) AS forecast_mean FROM fc GROUP BY 1, 2),
    j AS (SELECT r.station_id, r.kpi, recent_mean, forecast_mean, forecast_mean / greatest(recent_mean, 1e-6) AS ratio
      FROM r JOIN f ON r.station_id = f.station_id AND r.kpi = f.kpi)
    SELECT station_id, kpi, {rnd('recent_mean', 4)} AS recent_mean, {rnd('forecast_mean', 4)} AS forecast_mean, {rnd('ratio', 4)} AS ratio,
      CASE WHEN ratio < 0.85 THEN 'much lower' WHEN ratio < 0.95 THEN 'lower' WHEN ratio <= 1.05 THEN 'consistent'
        WHEN ratio <= 1.15 THEN 'higher' ELSE 'much higher' END AS label FROM j""",
)
def drift_ratio(spark, sf):
    out = ops.drift_ratio(src.inputs(spark, sf), src.forecast(spark, sf))
    return tidy(out, "recent_mean", "forecast_mean", "ratio")


@query(
    "history_summary",
    PANEL + f"""SELECT station_id, kpi, {rnd('avg(value)', 4)} AS mean, {rnd('stddev_pop(value)', 4)} AS std,
      {rnd('avg(value) FILTER (t < 408)', 4)} AS first24h_mean, {rnd('avg(value) FILTER (t >= 528)', 4)} AS last24h_mean
    FROM panel WHERE t >= 384 AND t < 552 GROUP BY 1, 2""",
)
def history_summary(spark, sf):
    return tidy(ops.history_summary(src.inputs(spark, sf)), "mean", "std", "first24h_mean", "last24h_mean")


SUMMARY = FORECAST.replace(", fc AS (", ", fc0 AS (") + f""", fc AS (SELECT station_id, kpi, h, pred * (1 + h / 1000.0) AS pred, truth FROM fc0),
  summ AS (SELECT station_id, kpi, min(pred) AS mn, avg(pred) AS mean, max(pred) AS mx FROM fc GROUP BY 1, 2),
  slope AS (SELECT station_id, kpi, regr_slope(m, day) AS slope FROM (SELECT station_id, kpi, h // 24 AS day, avg(pred) AS m FROM fc GROUP BY 1, 2, 3) GROUP BY 1, 2),
  bm AS (SELECT station_id, kpi, avg(value) AS b FROM panel WHERE t >= 384 AND t < 552 GROUP BY 1, 2),
  fsum AS (SELECT s.station_id, s.kpi, s.mn, s.mean, s.mx, l.slope, bm.b,
     CASE WHEN abs(bm.b) > 1e-8 THEN (s.mean - bm.b) / abs(bm.b) * 100 ELSE 0 END AS inc
   FROM summ s JOIN slope l ON s.station_id = l.station_id AND s.kpi = l.kpi JOIN bm ON s.station_id = bm.station_id AND s.kpi = bm.kpi)
"""


def rising(spark, sf):
    """Forecast with a mild upward drift, so that slopes and day changes are not all zero."""
    return src.forecast(spark, sf).withColumn("pred", F.col("pred") * (1 + F.col("h") / 1000))


@query(
    "forecast_summary",
    SUMMARY + f"""SELECT station_id, kpi, {rnd('mn', 4)} AS forecast_min, {rnd('mean', 4)} AS forecast_mean, {rnd('mx', 4)} AS forecast_max,
      {rnd('slope', 4)} AS slope, {rnd('b', 4)} AS baseline_mean, {rnd('inc', 3)} AS increase_pct,
      CASE WHEN slope > 0.01 THEN 'UP' WHEN slope < -0.01 THEN 'DOWN' ELSE 'STABLE' END AS trend FROM fsum""",
)
def forecast_summary(spark, sf):
    out = ops.forecast_summary(rising(spark, sf), src.baseline(spark, sf))
    out = tidy(out, "forecast_min", "forecast_mean", "forecast_max", "slope", "baseline_mean")
    return tidy(out, "increase_pct", digits=3)


@query(
    "largest_change",
    SUMMARY + f""", p AS (SELECT station_id, kpi, {rnd('inc', 2)} AS pct FROM fsum WHERE abs(b) > 1e-8),
    r AS (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY abs(pct) DESC, kpi) AS a,
      row_number() OVER (PARTITION BY station_id ORDER BY abs(pct), kpi) AS z FROM p)
    SELECT station_id, max(CASE WHEN a = 1 THEN kpi END) AS largest_kpi, max(CASE WHEN a = 1 THEN pct END) AS largest_pct,
      max(CASE WHEN z = 1 THEN kpi END) AS smallest_kpi, max(CASE WHEN z = 1 THEN pct END) AS smallest_pct FROM r GROUP BY 1""",
)
def largest_change(spark, sf):
    summary = ops.forecast_summary(rising(spark, sf), src.baseline(spark, sf))
    return ops.largest_change(summary, src.dim(spark))


PERIOD = "CASE WHEN {h} >= 6 AND {h} < 10 THEN 'morning-rush' WHEN {h} >= 10 AND {h} < 16 THEN 'midday' WHEN {h} >= 16 AND {h} < 20 THEN 'evening-rush' ELSE 'night' END"

DAYS = FORECAST + f""", tgt AS (SELECT station_id, kpi, h, truth AS pred FROM fc),
  d0 AS (SELECT station_id, kpi, h // 24 AS d, {rnd('avg(pred)', 2)} AS mean, {rnd('min(pred)', 2)} AS mn, {rnd('max(pred)', 2)} AS mx,
    {rnd('stddev_pop(pred)', 2)} AS std, arg_max(h % 24, pred * 1000000 - h % 24) AS peak_hour, arg_min(h % 24, pred * 1000000 + h % 24) AS trough_hour
    FROM tgt GROUP BY 1, 2, 3),
  bday AS (SELECT station_id, kpi, (t - 384) // 24 AS d, avg(value) AS b FROM panel WHERE t >= 384 AND t < 552 GROUP BY 1, 2, 3),
  d1 AS (SELECT d0.*, bday.b, lag(mean) OVER (PARTITION BY d0.station_id, d0.kpi ORDER BY d0.d) AS prev
    FROM d0 JOIN bday ON d0.station_id = bday.station_id AND d0.kpi = bday.kpi AND d0.d = bday.d),
  days AS (SELECT *, d + 1 AS day, CASE d WHEN 0 THEN 'Monday' WHEN 1 THEN 'Tuesday' WHEN 2 THEN 'Wednesday' WHEN 3 THEN 'Thursday'
      WHEN 4 THEN 'Friday' WHEN 5 THEN 'Saturday' ELSE 'Sunday' END AS weekday, d >= 5 AS is_weekend,
    CASE WHEN abs(prev) > 1e-8 THEN (mean - prev) / abs(prev) * 100 END AS rawpct FROM d1),
  dod AS (SELECT *, {rnd('rawpct', 2)} AS pct, coalesce(abs(rawpct) >= 10, false) AS notable FROM days)
"""


def days_of(spark, sf):
    """Days of the held-out week itself, which change more than a tiled forecast does."""
    week = src.target(spark, sf).withColumnRenamed("truth", "pred")
    return ops.daily_summary(week, src.baseline(spark, sf))


@query("day_over_day", DAYS + "SELECT station_id, kpi, day, mean, pct AS dod_pct, notable FROM dod")
def day_over_day(spark, sf):
    return days_of(spark, sf).select("station_id", "kpi", "day", "mean", "dod_pct", "notable")


@query(
    "daily_summary",
    DAYS + f"""SELECT station_id, kpi, mean, mn AS min, mx AS max, std, peak_hour, trough_hour, day, weekday, is_weekend,
      {PERIOD.format(h='peak_hour')} AS peak_period, {PERIOD.format(h='trough_hour')} AS trough_period, pct AS dod_pct, notable,
      {rnd('CASE WHEN abs(b) > 1e-8 THEN (mean - b) / abs(b) * 100 END', 2)} AS vs_baseline_pct,
      {rnd('CASE WHEN abs(b) > 1e-8 THEN b END', 2)} AS baseline_day_mean FROM dod""",
)
def daily_summary(spark, sf):
    return days_of(spark, sf)


@query(
    "co_occurrence_days",
    DAYS + """SELECT station_id, day, weekday, count(*) AS n_kpis,
      string_agg(kpi || ':' || CASE WHEN pct > 0 THEN 'up' ELSE 'down' END, ',' ORDER BY kpi) AS moves
    FROM dod WHERE day > 1 AND abs(coalesce(pct, 0)) >= 5 GROUP BY 1, 2, 3 HAVING count(*) >= 2""",
)
def co_occurrence_days(spark, sf):
    moves = F.transform("changes", lambda c: F.concat_ws(":", c["kpi"], c["direction"]))
    return ops.co_occurrence_days(days_of(spark, sf)).select(
        "station_id", "day", "weekday", F.size("changes").cast("long").alias("n_kpis"), F.array_join(moves, ",").alias("moves")
    )


@query(
    "weekday_weekend",
    DAYS + f""", w AS (SELECT station_id, kpi, avg(mean) FILTER (NOT is_weekend) AS wd, avg(mean) FILTER (is_weekend) AS we FROM dod GROUP BY 1, 2)
    SELECT station_id, kpi, {rnd('wd', 2)} AS weekday_avg, {rnd('we', 2)} AS weekend_avg, {rnd('(we - wd) / abs(wd) * 100', 2)} AS diff_pct
    FROM w WHERE abs(wd) > 1e-8 AND abs((we - wd) / abs(wd) * 100) >= 3""",
)
def weekday_weekend(spark, sf):
    return tidy(ops.weekday_weekend(days_of(spark, sf)), "weekday_avg", "weekend_avg", "diff_pct", digits=2)


VOLATILE = DAYS + """, vr AS (SELECT *, row_number() OVER (PARTITION BY station_id, kpi ORDER BY abs(pct) DESC NULLS LAST, day) AS r FROM dod),
  vol AS (SELECT station_id, kpi, max(CASE WHEN r = 1 AND pct IS NOT NULL THEN day END) AS most_volatile_day,
    max(CASE WHEN r = 1 THEN pct END) AS most_volatile_pct, sum(CASE WHEN notable THEN 1 ELSE 0 END)::BIGINT AS notable_days FROM vr GROUP BY 1, 2),
  cooc AS (SELECT station_id, day FROM dod WHERE day > 1 AND abs(coalesce(pct, 0)) >= 5 GROUP BY 1, 2 HAVING count(*) >= 2)
"""


@query("volatile_day", VOLATILE + "SELECT * FROM vol")
def volatile_day(spark, sf):
    return ops.volatile_day(days_of(spark, sf))


@query(
    "kpi_coverage",
    VOLATILE + """, rs AS (SELECT station_id, kpi, 0 AS o, 'notable day-over-day change' AS reason FROM vol WHERE notable_days > 0
      UNION ALL SELECT station_id, kpi, 1, 'most volatile change' FROM vol WHERE abs(most_volatile_pct) >= 5
      UNION ALL SELECT d.station_id, d.kpi, d.day + 1, 'co-occurrence on Day ' || d.day FROM dod d JOIN cooc c ON d.station_id = c.station_id AND d.day = c.day
        WHERE d.day > 1 AND abs(coalesce(d.pct, 0)) >= 5)
    SELECT station_id, kpi, string_agg(reason, '; ' ORDER BY o) AS reasons FROM rs GROUP BY 1, 2""",
)
def kpi_coverage(spark, sf):
    return ops.kpi_coverage(days_of(spark, sf)).withColumn("reasons", F.array_join("reasons", "; "))


@query(
    "forecast_window_days",
    """WITH f AS (SELECT s_suppkey AS station_id, d.d, (s_nationkey % 7 + d.d) % 7 AS wd FROM supplier, range(7) d(d))
    SELECT station_id, d + 1 AS day, 'Day ' || (d + 1) || ': ' || CASE wd WHEN 0 THEN 'Monday' WHEN 1 THEN 'Tuesday' WHEN 2 THEN 'Wednesday'
      WHEN 3 THEN 'Thursday' WHEN 4 THEN 'Friday' WHEN 5 THEN 'Saturday (weekend)' ELSE 'Sunday (weekend)' END AS label,
      sum(CASE WHEN wd < 5 THEN 1 ELSE 0 END) OVER (PARTITION BY station_id)::BIGINT AS weekday_count,
      sum(CASE WHEN wd >= 5 THEN 1 ELSE 0 END) OVER (PARTITION BY station_id)::BIGINT AS weekend_count FROM f""",
)
def forecast_window_days(spark, sf):
    start = load(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("station_id"), (F.col("s_nationkey") % 7).alias("start_weekday")
    )
    return ops.forecast_window_days(start)


@query(
    "report_flags",
    FORECAST + """, e AS (SELECT station_id, kpi, avg(abs(pred - truth)) AS mae, min(pred) AS mn, max(pred) AS mx FROM fc GROUP BY 1, 2),
    d AS (SELECT station_id, kpi, abs(value - lag(value, 24) OVER (PARTITION BY station_id, kpi ORDER BY t)) AS d FROM panel WHERE t < 552),
    s AS (SELECT station_id, kpi, avg(d) AS scale FROM d GROUP BY 1, 2)
    SELECT e.station_id, e.kpi, CASE WHEN scale > 1e-8 THEN mae / scale ELSE 0 END >= 0.9 AS low_accuracy,
      mx > 60 + 5 * (length(e.kpi) % 4) AS above_max, mn < 2 AS below_min FROM e JOIN s ON e.station_id = s.station_id AND e.kpi = s.kpi""",
)
def report_flags(spark, sf):
    ranges = src.dim(spark).select("kpi", F.lit(2.0).alias("lo"), (60 + 5 * (F.length("kpi") % 4)).cast("double").alias("hi"))
    metrics = acc.score(src.scored(spark, sf), acc.season_scale(src.inputs(spark, sf)))
    summary = ops.forecast_summary(src.forecast(spark, sf), src.baseline(spark, sf))
    return ops.report_flags(summary, metrics, ranges)
