"""Queries on accuracy metrics, sweeps, run comparisons and leaderboards."""

from __future__ import annotations

from pyspark.sql import functions as F

from kpiscope.functions.exprs import settle, settle_wide
from kpiscope.operators import boards
from kpiscope.operators import forecast as fc
from kpiscope.operators import metrics as ops
from kpiscope.operators import panel as shape
from kpiscope.operators import sweeps
from kpiscope.plans import inputs as src
from kpiscope.plans.on_profiles import tidy
from kpiscope.plans.registry import FORECAST, PANEL, query, rnd, rnd_wide
from kpiscope.sources.tables import PANEL_KPIS, SPLIT_HOUR, load

SCORES = FORECAST + """, sd AS (SELECT station_id, kpi, abs(value - lag(value, 24) OVER (PARTITION BY station_id, kpi ORDER BY t)) AS d FROM panel WHERE t < 552),
  scale AS (SELECT station_id, kpi, avg(d) AS scale FROM sd GROUP BY 1, 2),
  err AS (SELECT station_id, kpi, avg(abs(pred - truth)) AS mae, avg((pred - truth) * (pred - truth)) AS mse, sqrt(avg((pred - truth) * (pred - truth))) AS rmse,
    coalesce(avg(CASE WHEN abs(pred) + abs(truth) > 1e-8 THEN 2 * abs(pred - truth) / (abs(pred) + abs(truth)) END) * 100, 0) AS smape,
    max(truth) - min(truth) AS rng FROM fc GROUP BY 1, 2),
  met AS (SELECT err.station_id, err.kpi, smape, CASE WHEN scale > 1e-8 THEN mae / scale ELSE 0 END AS mase,
    CASE WHEN rng > 1e-8 THEN rmse / rng ELSE 0 END AS nrmse, mae, rmse, mse, scale
    FROM err JOIN scale ON err.station_id = scale.station_id AND err.kpi = scale.kpi)
"""



def station_metrics(spark, sf):
    return ops.score(src.scored(spark, sf), ops.season_scale(src.inputs(spark, sf)))


@query("metric_smape", SCORES + f"SELECT station_id, kpi, {rnd('smape', 3)} AS smape FROM met")
def metric_smape(spark, sf):
    return tidy(src.scored(spark, sf).groupBy("station_id", "kpi").agg(ops.smape().alias("smape")), "smape", digits=3)


@query("metric_mase", SCORES + f"SELECT station_id, kpi, {rnd('scale', 4)} AS scale, {rnd('mase', 4)} AS mase FROM met")
def metric_mase(spark, sf):
    return tidy(station_metrics(spark, sf).select("station_id", "kpi", "scale", "mase"), "scale", "mase")


@query("metric_nrmse", SCORES + f"SELECT station_id, kpi, {rnd('nrmse', 4)} AS nrmse FROM met")
def metric_nrmse(spark, sf):
    return tidy(src.scored(spark, sf).groupBy("station_id", "kpi").agg(ops.nrmse().alias("nrmse")), "nrmse")


@query(
    "metric_mae_rmse_mse",
    FORECAST + f"""SELECT station_id, kpi, {rnd('avg(abs(pred - truth))', 4)} AS mae, {rnd('sqrt(avg((pred - truth) * (pred - truth)))', 4)} AS rmse,
    {rnd('avg((pred - truth) * (pred - truth))', 3)} AS mse FROM fc GROUP BY GROUPING SETS ((station_id, kpi), (station_id))""",
)
def metric_mae_rmse_mse(spark, sf):
    return tidy(tidy(ops.error_rollup(src.scored(spark, sf)), "mae", "rmse"), "mse", digits=3)


TRUTH_SCALE = FORECAST + """, sd AS (SELECT station_id, kpi, abs(truth - lag(truth, 24) OVER (PARTITION BY station_id, kpi ORDER BY h)) AS d FROM fc),
  scale AS (SELECT station_id, kpi, avg(d) AS scale FROM sd GROUP BY 1, 2)
"""


@query(
    "metric_truth_mase",
    TRUTH_SCALE + f"""SELECT f.station_id, f.kpi, {rnd('CASE WHEN max(scale) > 1e-8 THEN avg(abs(pred - truth)) / max(scale) ELSE 0 END', 4)} AS mase
    FROM fc f JOIN scale s ON f.station_id = s.station_id AND f.kpi = s.kpi GROUP BY 1, 2""",
)
def metric_truth_mase(spark, sf):
    return tidy(ops.score_truth_scale(src.scored(spark, sf)).select("station_id", "kpi", "mase"), "mase")


@query(
    "metric_eps",
    TRUTH_SCALE + f"""SELECT f.station_id, f.kpi, {rnd_wide('avg(abs(pred - truth)) / (max(scale) + 1e-8)', 4)} AS mase,
      {rnd('avg(200 * abs(pred - truth) / (abs(pred) + abs(truth) + 1e-8))', 3)} AS smape
    FROM fc f JOIN scale s ON f.station_id = s.station_id AND f.kpi = s.kpi GROUP BY 1, 2""",
)
def metric_eps(spark, sf):
    out = ops.score_eps(src.scored(spark, sf))
    return out.select("station_id", "kpi", settle_wide("mase", 4).alias("mase"), settle("smape", 3).alias("smape"))


@query(
    "naive_reference",
    SCORES + f"SELECT station_id, kpi, {rnd('smape', 2)} AS smape, {rnd('mase', 4)} AS mase, {rnd('nrmse', 4)} AS nrmse, {rnd('mae', 4)} AS mae, {rnd('rmse', 4)} AS rmse FROM met",
)
def naive_reference(spark, sf):
    return ops.rounded(station_metrics(spark, sf)).select("station_id", "kpi", "smape", "mase", "nrmse", "mae", "rmse")


BATCH = SCORES + f""", r AS (SELECT station_id, kpi, {rnd('smape', 2)} AS smape, {rnd('mase', 4)} AS mase, {rnd('nrmse', 4)} AS nrmse FROM met)
"""


@query(
    "batch_aggregate",
    BATCH + f"SELECT kpi, {rnd('avg(smape)', 2)} AS avg_smape, {rnd('avg(mase)', 4)} AS avg_mase, {rnd('avg(nrmse)', 4)} AS avg_nrmse, count(*) AS n_stations FROM r GROUP BY 1",
)
def batch_aggregate(spark, sf):
    return ops.batch_aggregate(station_metrics(spark, sf))


@query(
    "batch_status",
    f"""SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS successful, count(*) FILTER (o_orderstatus = 'O') AS failed,
    {rnd('CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (o_orderstatus = $$F$$) AS DOUBLE) / count(*) FILTER (o_orderstatus = $$F$$)', 2)} AS avg_sec FROM orders""",
)
def batch_status(spark, sf):
    status = F.when(F.col("o_orderstatus") == "F", "success").when(F.col("o_orderstatus") == "O", "error").otherwise("other")
    results = load(spark, sf, "orders").select(status.alias("status"), F.col("o_totalprice").cast("decimal(18,2)").alias("elapsed_sec"))
    return ops.batch_status(results).withColumn("avg_sec", settle(F.col("avg_sec").cast("double"), 2))


def sweep_scores(spark, sf, contexts=None):
    """Scores of three forecasters over every context the history has, one more day each."""
    return sweeps.sweep_scores(src.panel(spark, sf), SPLIT_HOUR, contexts=contexts)


def average_scores(spark, sf, contexts=None):
    """Context sweep of the history mean, the one model here whose result depends on the context."""
    return sweeps.sweep_scores(src.panel(spark, sf), SPLIT_HOUR, contexts=contexts, models=(sweeps.HISTORY_MEAN,))


SWEEP = SCORES + """, ctx AS (SELECT CAST(24 * d AS INTEGER) AS context_h FROM range(1, 24) r(d)),
  ha AS (SELECT c.context_h, p.station_id, p.kpi, avg(p.value) AS pred FROM ctx c JOIN panel p ON p.t < 552 AND p.t >= 552 - c.context_h GROUP BY 1, 2, 3),
  wa AS (SELECT station_id, kpi, avg(value) AS pred FROM panel WHERE t >= 528 AND t < 552 GROUP BY 1, 2),
  swp AS (SELECT 'historic_average' AS model, context_h, f.station_id, f.kpi, h, ha.pred, truth FROM fc f JOIN ha ON f.station_id = ha.station_id AND f.kpi = ha.kpi
    UNION ALL SELECT 'window_average', context_h, f.station_id, f.kpi, h, wa.pred, truth FROM fc f JOIN wa ON f.station_id = wa.station_id AND f.kpi = wa.kpi, ctx
    UNION ALL SELECT 'seasonal_naive', context_h, station_id, kpi, h, pred, truth FROM fc, ctx),
  swe AS (SELECT model, context_h, s.station_id, s.kpi, avg(abs(pred - truth)) AS mae, sqrt(avg((pred - truth) * (pred - truth))) AS rmse,
    coalesce(avg(CASE WHEN abs(pred) + abs(truth) > 1e-8 THEN 2 * abs(pred - truth) / (abs(pred) + abs(truth)) END) * 100, 0) AS smape,
    max(truth) - min(truth) AS rng, max(c.scale) AS scale FROM swp s JOIN scale c ON s.station_id = c.station_id AND s.kpi = c.kpi GROUP BY 1, 2, 3, 4),
  swm AS (SELECT *, CASE WHEN scale > 1e-8 THEN mae / scale ELSE 0 END AS mase, CASE WHEN rng > 1e-8 THEN rmse / rng ELSE 0 END AS nrmse FROM swe),
  hav AS (SELECT * FROM swm WHERE model = 'historic_average'),
  ssum AS (SELECT context_h, kpi, avg(smape) AS avg_smape, avg(mase) AS avg_mase, avg(nrmse) AS avg_nrmse, stddev_samp(mase) AS std_mase,
    count(DISTINCT station_id) AS n_stations FROM hav GROUP BY 1, 2)
"""


@query(
    "fc_sweep",
    SWEEP + f"SELECT model, context_h, station_id, kpi, {rnd('smape', 3)} AS smape, {rnd('mase', 4)} AS mase, {rnd('nrmse', 4)} AS nrmse FROM swm",
)
def fc_sweep(spark, sf):
    out = sweep_scores(spark, sf).select("model", "context_h", "station_id", "kpi", "smape", "mase", "nrmse")
    return tidy(tidy(out, "smape", digits=3), "mase", "nrmse")


@query(
    "sweep_summary",
    SWEEP + f"""SELECT context_h, kpi, {rnd('avg_smape', 3)} AS avg_smape, {rnd('avg_mase', 4)} AS avg_mase, {rnd('avg_nrmse', 4)} AS avg_nrmse,
    {rnd('std_mase', 4)} AS std_mase, n_stations FROM ssum""",
)
def sweep_summary(spark, sf):
    out = ops.sweep_summary(average_scores(spark, sf))
    return tidy(tidy(out, "avg_smape", digits=3), "avg_mase", "avg_nrmse", "std_mase")


@query(
    "best_context",
    SWEEP + f""", pool AS (SELECT context_h, kpi, avg_mase AS v FROM ssum UNION ALL SELECT context_h, 'ALL', avg(avg_mase) FROM ssum GROUP BY 1),
    r AS (SELECT *, row_number() OVER (PARTITION BY kpi ORDER BY v, context_h) AS r FROM pool)
    SELECT kpi, context_h AS best_context_h, {rnd('v', 4)} AS best_value FROM r WHERE r = 1""",
)
def best_context(spark, sf):
    return tidy(ops.best_context(ops.sweep_summary(average_scores(spark, sf)), "avg_mase"), "best_value")


@query(
    "nmae_nrmse_mean",
    SWEEP + f""", lv AS (SELECT kpi, avg(m) AS truth_mean FROM (SELECT station_id, kpi, avg(abs(truth)) AS m FROM fc GROUP BY 1, 2) GROUP BY 1)
    SELECT h.context_h, h.kpi, {rnd('avg(mae)', 4)} AS avg_mae, {rnd('avg(rmse)', 4)} AS avg_rmse, {rnd('max(truth_mean)', 4)} AS truth_mean,
      {rnd('avg(mae) / max(truth_mean)', 4)} AS nmae, {rnd('avg(rmse) / max(truth_mean)', 4)} AS nrmse FROM hav h JOIN lv ON h.kpi = lv.kpi GROUP BY 1, 2""",
)
def nmae_nrmse_mean(spark, sf):
    out = ops.nmae_nrmse_mean(average_scores(spark, sf), src.target(spark, sf))
    return tidy(out, "avg_mae", "avg_rmse", "truth_mean", "nmae", "nrmse")


@query(
    "sem_by_context",
    SWEEP + f"""SELECT context_h, kpi, {rnd('avg(mase)', 4)} AS mean, count(*) AS n, {rnd('CASE WHEN count(*) > 1 THEN stddev_samp(mase) / sqrt(count(*)) ELSE 0 END', 4)} AS sem
    FROM hav GROUP BY 1, 2""",
)
def sem_by_context(spark, sf):
    return tidy(ops.sem(average_scores(spark, sf), ["context_h", "kpi"], "mase"), "mean", "sem")


TWO_RUNS = SWEEP + f""", runs AS (SELECT kpi, avg(smape) FILTER (model = 'seasonal_naive' AND context_h = 552) AS a, avg(smape) FILTER (model = 'historic_average' AND context_h = 552) AS b FROM swm GROUP BY 1)
"""


def two_runs(spark, sf):
    s = sweep_scores(spark, sf, [552]).filter("model IN ('seasonal_naive', 'historic_average')")
    return s.groupBy(F.col("model").alias("run"), "kpi").agg(F.avg("smape").alias("value"))


@query(
    "compare_runs",
    TWO_RUNS + f"""SELECT kpi, {rnd('a', 3)} AS first, {rnd('b', 3)} AS second, {rnd('(b - a) / a * 100', 3)} AS delta_pct, (b - a) / a * 100 < -1 AS improved,
      {rnd('avg((b - a) / a * 100) OVER ()', 3)} AS mean_delta_pct FROM runs""",
)
def compare_runs(spark, sf):
    out = ops.compare_runs(two_runs(spark, sf), "seasonal_naive", "historic_average")
    return tidy(out, "first", "second", "delta_pct", "mean_delta_pct", digits=3)


@query(
    "drift_check",
    SWEEP + f""", j AS (SELECT n.station_id, n.kpi, n.mase AS new, o.mase AS old, abs(n.mase - o.mase) AS delta FROM hav n
      JOIN hav o ON n.station_id = o.station_id AND n.kpi = o.kpi AND o.context_h = 336 WHERE n.context_h = 552)
    SELECT station_id, kpi, {rnd('new', 4)} AS new, {rnd('old', 4)} AS old, {rnd('delta', 4)} AS delta, {rnd('max(delta) OVER (PARTITION BY station_id)', 4)} AS max_delta,
      CASE WHEN max(delta) OVER (PARTITION BY station_id) > 0.05 THEN 'FAIL' ELSE 'PASS' END AS verdict FROM j""",
)
def drift_check(spark, sf):
    scores = average_scores(spark, sf, [336, 552])
    new, old = scores.filter("context_h = 552"), scores.filter("context_h = 336")
    return tidy(ops.drift_check(new, old, "mase", 0.05, ("station_id", "kpi")), "new", "old", "delta", "max_delta")


@query(
    "ab_aggregate",
    SWEEP + f"""SELECT model AS mode, kpi, {rnd('avg(smape)', 3)} AS avg_smape, {rnd('avg(mase)', 4)} AS avg_mase, count(DISTINCT station_id) AS n_stations
    FROM swm WHERE context_h = 168 GROUP BY GROUPING SETS ((model, kpi), (model))""",
)
def ab_aggregate(spark, sf):
    rows = sweep_scores(spark, sf, [168]).withColumnRenamed("model", "mode")
    return tidy(tidy(ops.ab_aggregate(rows), "avg_smape", digits=3), "avg_mase")


@query(
    "predictor_compare",
    SWEEP + f""", p AS (SELECT model AS forecaster, station_id, {rnd('avg(n)', 6)} AS mean_nrmse, {rnd('avg(m)', 6)} AS mean_mase
      FROM (SELECT model, station_id, {rnd('nrmse', 4)} AS n, {rnd('mase', 4)} AS m FROM swm WHERE context_h = 168) GROUP BY 1, 2),
    l AS (SELECT forecaster, 'mean_nrmse' AS metric, mean_nrmse AS value FROM p UNION ALL SELECT forecaster, 'mean_mase', mean_mase FROM p)
    SELECT forecaster, metric, count(*) AS n, {rnd('avg(value)', 4)} AS mean, {rnd('stddev_samp(value)', 4)} AS stdev, {rnd('min(value)', 4)} AS min, {rnd('max(value)', 4)} AS max
    FROM l GROUP BY 1, 2""",
)
def predictor_compare(spark, sf):
    rows = sweep_scores(spark, sf, [168]).withColumnRenamed("model", "forecaster")
    return tidy(ops.predictor_compare(rows), "mean", "stdev", "min", "max")


def _runs(spark, sf):
    return load(spark, sf, "orders").select(
        F.col("o_orderkey").alias("run_id"),
        F.col("o_orderstatus").alias("family"),
        F.col("o_orderpriority").alias("model"),
        F.col("o_totalprice").alias("metric"),
    )


@query(
    "leaderboard",
    """SELECT o_orderkey AS run_id, o_orderstatus AS family, o_orderpriority AS model,
      CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS metric, CASE WHEN o_orderstatus <> 'P' THEN 'completed' ELSE 'skipped' END AS status FROM orders""",
)
def leaderboard(spark, sf):
    runs = _runs(spark, sf)
    return boards.leaderboard(runs.filter("family <> 'P'"), runs.filter("family = 'P'").drop("metric"))


@query(
    "leaderboard_topk_pivot",
    f"""SELECT family, model, {", ".join(f"{rnd(f'max(CASE WHEN rk = {i} THEN metric END)', 2)} AS rank_{i}" for i in (1, 2, 3))}, count(*) AS in_top
    FROM (SELECT o_orderstatus AS family, o_orderpriority AS model, o_totalprice AS metric,
      row_number() OVER (PARTITION BY o_orderstatus, o_orderpriority ORDER BY o_totalprice, o_orderkey) AS rk FROM
      (SELECT * FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 30)) GROUP BY 1, 2""",
)
def leaderboard_topk_pivot(spark, sf):
    from pyspark.sql import Window

    board = _runs(spark, sf).withColumn("status", F.lit("completed"))
    top = boards.top_runs(board, "metric", 30)
    rank = F.row_number().over(Window.partitionBy("family", "model").orderBy("metric", "run_id"))
    ranked = top.withColumn("kpi", F.concat(F.lit("rank_"), rank))
    wide = boards.model_pivot(ranked, ["family", "model"], ["rank_1", "rank_2", "rank_3"], "metric")
    counts = ranked.groupBy("family", "model").agg(F.count("*").alias("in_top"))
    return tidy(wide, "rank_1", "rank_2", "rank_3", digits=2).join(counts, ["family", "model"])


WIDE = ", ".join(f"{rnd(f'max(CASE WHEN kpi = $${k}$$ THEN mase END)', 4)} AS mase_{k}" for k in PANEL_KPIS)


@query(
    "regime_table",
    SWEEP + f""", pts AS (SELECT CASE context_h WHEN 552 THEN 'full' ELSE CAST(context_h // 168 AS VARCHAR) END AS finetune_weeks, kpi, avg(mase) AS mase
      FROM hav GROUP BY 1, 2)
    SELECT finetune_weeks, CASE finetune_weeks WHEN '0' THEN 'zero' WHEN 'full' THEN 'full' ELSE 'few' END AS regime, {WIDE},
      row_number() OVER (ORDER BY finetune_weeks) AS "position" FROM pts GROUP BY 1""",
)
def regime_table(spark, sf):
    c = F.col("context_h")
    weeks = F.when(c == SPLIT_HOUR, "full").otherwise(F.floor(c / 168).cast("string"))
    pts = (
        average_scores(spark, sf)
        .groupBy(weeks.alias("finetune_weeks"), "kpi")
        .agg(F.avg("mase").alias("mase"))
        .withColumn("regime", shape.regime_label("finetune_weeks"))
    )
    return tidy(boards.regime_table(pts, list(PANEL_KPIS), ["mase"]), *[f"mase_{k}" for k in PANEL_KPIS])


@query(
    "spatial_table",
    SCORES + f""", g AS (SELECT station_id, row_number() OVER (ORDER BY md5(CAST(station_id AS VARCHAR) || ':42'), station_id) AS rk FROM (SELECT DISTINCT station_id FROM panel)),
    pts AS (SELECT n.n AS n_train_groups, kpi, avg(mase) AS mase FROM met m JOIN g ON g.station_id = m.station_id, (VALUES (0), (1), (2)) n(n) WHERE g.rk > n.n GROUP BY 1, 2)
    SELECT n_train_groups, {WIDE} FROM pts GROUP BY 1""",
)
def spatial_table(spark, sf):
    metrics = station_metrics(spark, sf).select("station_id", "kpi", "mase")
    stations = metrics.select("station_id").distinct().withColumn("site_group", F.col("station_id"))
    test = shape.cumulative_group_split(stations, [0, 1, 2]).filter("part = 'test'").select("station_id", "n_train_groups")
    pts = metrics.join(test, "station_id").groupBy("n_train_groups", "kpi").agg(F.avg("mase").alias("mase"))
    return tidy(boards.spatial_table(pts, list(PANEL_KPIS), ["mase"]), *[f"mase_{k}" for k in PANEL_KPIS])


@query(
    "station_select",
    """WITH c AS (SELECT s.s_suppkey AS station_id, count(l.l_orderkey) AS n_events FROM supplier s
      LEFT JOIN lineitem l ON l.l_suppkey = s.s_suppkey AND l.l_quantity >= 49 GROUP BY 1)
    SELECT * FROM c ORDER BY n_events DESC, station_id LIMIT 30""",
)
def station_select(spark, sf):
    events = load(spark, sf, "lineitem").filter("l_quantity >= 49").select(F.col("l_suppkey").alias("station_id"))
    return boards.station_select(src.stations(spark, sf), events, 30)


@query(
    "station_overlap",
    """WITH sel AS (SELECT DISTINCT l_suppkey AS s FROM lineitem WHERE l_quantity >= 50 AND l_discount >= 0.1),
      ref AS (SELECT DISTINCT s_suppkey AS s FROM supplier WHERE s_acctbal > 0)
    SELECT s AS station_id, CASE WHEN s IN (SELECT s FROM sel) THEN 'kept' ELSE 'dropped' END AS overlap FROM ref""",
)
def station_overlap(spark, sf):
    selected = load(spark, sf, "lineitem").filter("l_quantity >= 50 AND l_discount >= 0.1").select(F.col("l_suppkey").alias("station_id"))
    reference = load(spark, sf, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("station_id"))
    return boards.selection_overlap(selected, reference)


@query(
    "run_sigma",
    f"""WITH a AS (SELECT doc_id // 2 AS station_id, doc_id % 2 AS arm, (2.0 * quality + 2.0 * (1 - toxic)) / 4 AS f1, quality * 1.0 AS f2 FROM labels)
    SELECT station_id, arm, CAST(f1 AS DOUBLE) AS f1, CAST(f2 AS DOUBLE) AS f2, CASE WHEN f1 + f2 <> 0 THEN {rnd('(f1 + f2) / 2', 4)} END AS mean_faithfulness,
      CASE WHEN f1 <> f2 THEN {rnd('abs(f1 - f2) / sqrt(2)', 4)} END AS sigma_faithfulness FROM a""",
)
def run_sigma(spark, sf):
    labels = load(spark, sf, "labels").withColumn("station_id", F.floor(F.col("doc_id") / 2)).withColumn("arm", F.col("doc_id") % 2)
    likert = (2 * F.col("quality") + 2 * (1 - F.col("toxic"))) / 4
    return boards.run_sigma(
        labels.select("station_id", "arm", likert.alias("faithfulness")),
        labels.select("station_id", "arm", F.col("quality").cast("double").alias("faithfulness")),
    )


@query(
    "axis_rollup",
    """WITH a AS (SELECT 'priority' AS axis, o_orderpriority AS arm, count(*) AS n, NULL::BIGINT AS open_orders FROM orders GROUP BY 2
      UNION ALL SELECT 'status', o_orderstatus, count(*), count(*) FILTER (o_totalprice > 250000) FROM orders GROUP BY 2),
    c AS (SELECT 'priority' AS axis, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS cost FROM orders)
    SELECT a.axis, a.arm, a.n, a.open_orders, c.cost FROM a LEFT JOIN c ON a.axis = c.axis""",
)
def axis_rollup(spark, sf):
    orders = load(spark, sf, "orders")
    by_priority = orders.groupBy(F.col("o_orderpriority").alias("arm")).agg(F.count("*").alias("n"))
    by_status = orders.groupBy(F.col("o_orderstatus").alias("arm")).agg(
        F.count("*").alias("n"), F.count_if(F.col("o_totalprice") > 250000).alias("open_orders")
    )
    cost = orders.groupBy(F.lit("priority").alias("axis")).agg(
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("cost")
    )
    return boards.axis_rollup({"priority": by_priority, "status": by_status}, cost)


@query(
    "resume_skip",
    """SELECT o_orderkey AS run_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""",
)
def resume_skip(spark, sf):
    from kpiscope.sources.results import pending

    done = load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("run_id"))
    return pending(_runs(spark, sf).select("run_id"), done, ["run_id"])


@query(
    "sink_forecast",
    FORECAST + "SELECT station_id, h // 24 + 1 AS day, h % 24 AS hour, "
    + ", ".join(
        f"{rnd(f'max(CASE WHEN kpi = $${k}$$ THEN pred END)', 4)} AS {k}_pred, {rnd(f'max(CASE WHEN kpi = $${k}$$ THEN truth END)', 4)} AS {k}_true"
        for k in PANEL_KPIS
    )
    + " FROM fc GROUP BY 1, 2, 3",
)
def sink_forecast(spark, sf):
    from kpiscope.sources.forecast_files import wide_forecast

    return wide_forecast(src.scored(spark, sf), list(PANEL_KPIS))


@query(
    "sink_station_result",
    SCORES + f""", pd AS (SELECT station_id, kpi, string_agg(CAST({rnd('m', 2)} AS DECIMAL(18,2))::VARCHAR, ',' ORDER BY d) AS days FROM
      (SELECT station_id, kpi, h // 24 AS d, avg(pred) AS m FROM fc GROUP BY 1, 2, 3) GROUP BY 1, 2)
    SELECT met.station_id, met.kpi, {rnd('smape', 2)} AS smape, {rnd('mase', 4)} AS mase, days AS prediction_daily FROM met JOIN pd ON met.station_id = pd.station_id AND met.kpi = pd.kpi""",
)
def sink_station_result(spark, sf):
    from kpiscope.sources.results import station_documents

    docs = station_documents(station_metrics(spark, sf), src.scored(spark, sf))
    long = docs.select("station_id", F.explode("metrics.per_kpi").alias("kpi", "m"), "prediction_daily")
    days = F.transform(F.col("prediction_daily")[F.col("kpi")], lambda v: settle(v, 2).cast("decimal(18,2)").cast("string"))
    return long.select("station_id", "kpi", "m.smape", "m.mase", F.array_join(days, ",").alias("prediction_daily"))


@query(
    "fc_evaluate_split",
    PANEL + f""", s AS (SELECT 'val' AS split, 384 AS start UNION ALL SELECT 'test', 552),
    ev AS (SELECT s.split, a.station_id, a.kpi, least(greatest(b.value, 0), 500) AS pred, a.value AS truth FROM s JOIN panel a ON a.t >= s.start AND a.t < s.start + 168
      JOIN panel b ON a.station_id = b.station_id AND a.kpi = b.kpi AND b.t = s.start - 24 + (a.t - s.start) % 24),
    sd AS (SELECT s.split, station_id, kpi, abs(value - lag(value, 24) OVER (PARTITION BY s.split, station_id, kpi ORDER BY t)) AS d FROM panel JOIN s ON t < s.start),
    sc AS (SELECT split, station_id, kpi, avg(d) AS scale FROM sd GROUP BY 1, 2, 3)
    SELECT e.split, e.station_id, e.kpi, {rnd('avg(abs(pred - truth))', 4)} AS mae, {rnd('CASE WHEN max(scale) > 1e-8 THEN avg(abs(pred - truth)) / max(scale) ELSE 0 END', 4)} AS mase
    FROM ev e JOIN sc ON e.split = sc.split AND e.station_id = sc.station_id AND e.kpi = sc.kpi GROUP BY 1, 2, 3""",
)
def fc_evaluate_split(spark, sf):
    keys = ("split", "station_id", "kpi")
    panel = src.panel(spark, sf)
    history = fc.evaluation_histories(panel, 384, 552)
    pred = shape.physical_clamp(fc.seasonal_naive(history, keys=keys), src.dim(spark))
    truth = fc.evaluation_truth(panel, 384, 552, 168)
    scored = pred.join(truth, [*keys, "h"])
    out = ops.score(scored, ops.season_scale(history, keys=keys), keys)
    return tidy(out.select(*keys, "mae", "mase"), "mae", "mase")


def _level_query(name, build, expr):
    sql = PANEL + f"SELECT station_id, kpi, h.h AS h, {rnd('v', 4)} AS pred FROM (SELECT station_id, kpi, {expr} AS v FROM panel WHERE t < 552 GROUP BY 1, 2), range(168) h(h)"
    query(name, sql)(lambda spark, sf: tidy(build(src.inputs(spark, sf)), "pred"))


_level_query("fc_naive", fc.naive, "arg_max(value, t)")
_level_query("fc_historic_average", fc.historic_average, "avg(value)")
_level_query("fc_window_average", lambda d: fc.window_average(d, 168), "avg(value) FILTER (t >= 384)")


@query(
    "fc_seasonal_naive",
    PANEL + f"""SELECT station_id, kpi, h.h AS h, {rnd('value', 4)} AS pred FROM panel JOIN range(336) h(h) ON t = 384 + h.h % 168""",
)
def fc_seasonal_naive(spark, sf):
    return tidy(fc.seasonal_naive(src.inputs(spark, sf), horizon=336, season=168), "pred")


@query(
    "fc_sample_median",
    PANEL + f"""SELECT station_id, kpi, t % 12 AS h, {rnd('quantile_disc(value, 0.5)', 4)} AS lower_median, {rnd('median(value)', 4)} AS mean_median
    FROM panel WHERE t < 552 GROUP BY 1, 2, 3""",
)
def fc_sample_median(spark, sf):
    """Every half day of the input is a sample of the next one; their even number tells the two medians apart."""
    samples = src.inputs(spark, sf).select(
        "station_id", "kpi", (F.col("t") % 12).alias("h"), F.floor(F.col("t") / 12).alias("sample"), F.col("value").alias("pred")
    )
    lower = fc.sample_median(samples, "lower").withColumnRenamed("pred", "lower_median")
    mean = fc.sample_median(samples, "mean").withColumnRenamed("pred", "mean_median")
    return tidy(lower.join(mean, ["station_id", "kpi", "h"]), "lower_median", "mean_median")


@query(
    "fc_external",
    PANEL + f"""SELECT station_id, kpi, h.h AS h, {rnd('m', 4)} AS pred FROM (SELECT station_id, kpi, t % 24 AS ph, avg(value) AS m FROM panel WHERE t < 552 GROUP BY 1, 2, 3)
      JOIN range(168) h(h) ON h.h % 24 = ph""",
)
def fc_external(spark, sf):
    def mean_day(history, horizon):
        import numpy as np

        day = history[: len(history) // 24 * 24].reshape(-1, 24).mean(axis=0)
        return np.resize(day, horizon)

    return tidy(fc.external(src.inputs(spark, sf), mean_day), "pred")


