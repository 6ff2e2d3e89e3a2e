"""Queries that write derived data in the file formats of the pipelines and read it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from kpiscope.functions.exprs import settle
from kpiscope.operators import forecast as fc
from kpiscope.operators import graph_build as gb
from kpiscope.operators import graph_load as gl
from kpiscope.operators import lag_models
from kpiscope.plans import inputs as src
from kpiscope.plans.on_events import COLS, EVENTS, show, top_events
from kpiscope.plans.on_graph import CH, GRAPH, T, chain_tables, deduped_once, validated
from kpiscope.plans.on_metrics import SCORES, station_metrics
from kpiscope.plans.on_profiles import tidy
from kpiscope.plans.registry import FORECAST, PANEL, query, rnd
from kpiscope.session import scratch_folder
from kpiscope.sources import forecast_files, graph_files, report_files, results, station_files
from kpiscope.sources.tables import PANEL_HOURS, PANEL_KPIS, load

KPIS = list(PANEL_KPIS)
RAW = {f"{k} raw": k for k in KPIS}


def _station_files(spark, sf):
    path = scratch_folder(spark, "stations")
    station_files.write_stations(src.panel(spark, sf), RAW, path)
    return station_files.read_wide(spark, path, RAW, PANEL_HOURS)


@query("scan_station_csv", PANEL + f"SELECT station_id::VARCHAR AS station_id, kpi, count(*) AS hours, {rnd('avg(value)', 4)} AS mean_value, {rnd('sum(t * value) / 1000', 3)} AS weighted FROM panel GROUP BY 1, 2")
def scan_station_csv(spark, sf):
    panel = station_files.to_panel(_station_files(spark, sf), KPIS)
    return panel.groupBy("station_id", "kpi").agg(
        F.count("*").alias("hours"), settle(F.avg("value"), 4).alias("mean_value"), settle(F.sum(F.col("t") * F.col("value")) / 1000, 3).alias("weighted")
    )


@query("station_dim", "SELECT user_id AS station_id, arg_min(event_type, event_id) AS enb, arg_min(props, event_id) AS cell FROM events GROUP BY 1")
def station_dim(spark, sf):
    wide = load(spark, sf, "events").select(
        F.col("user_id").alias("station_id"), F.col("event_id").alias("t"), F.col("event_type").alias("eNB ID"), F.col("props").alias("CELL No")
    )
    return station_files.station_dim(wide)


@query("scan_forecast", FORECAST + f"SELECT station_id::VARCHAR AS station_id, kpi, count(*) AS hours, {rnd('avg(pred)', 3)} AS mean_pred, {rnd('avg(truth)', 3)} AS mean_truth FROM fc GROUP BY 1, 2")
def scan_forecast(spark, sf):
    path = scratch_folder(spark, "forecast")
    forecast_files.write_forecast_csv(src.scored(spark, sf), KPIS, path)
    back = forecast_files.read_forecast(spark, path, KPIS)
    return back.groupBy("station_id", "kpi").agg(
        F.count("*").alias("hours"), settle(F.avg("pred"), 3).alias("mean_pred"), settle(F.avg("truth"), 3).alias("mean_truth")
    )


@query(
    "scan_metric_json",
    SCORES + " UNION ALL ".join(f"SELECT 552 AS context_h, station_id::VARCHAR AS station_id, kpi, '{m}' AS metric, {rnd(m, 2 if m == 'smape' else 4)} AS value FROM met" for m in ("smape", "mase", "nrmse", "mae", "rmse")),
)
def scan_metric_json(spark, sf):
    path = scratch_folder(spark, "results")
    docs = results.station_documents(station_metrics(spark, sf), src.scored(spark, sf))
    results.write_station_documents(docs.withColumn("station_id", F.col("station_id").cast("string")), f"{path}/ctx_552h")
    return results.read_metric_files(spark, path)


@query(
    "scan_kg_json",
    GRAPH + ", " + CH.removeprefix("WITH ") + """SELECT 'edge' AS what, relation_type AS name, count(*) AS n FROM edges GROUP BY 2 UNION ALL SELECT 'node', node_type, count(*) FROM ntype GROUP BY 2
    UNION ALL SELECT 'node', 'Chain', count(*) FROM ch WHERE population = 0 HAVING count(*) > 0
    UNION ALL SELECT 'chain', name, n_steps FROM cs JOIN (SELECT name, min(population) AS p FROM cs GROUP BY 1) f USING (name) WHERE population = p
      QUALIFY row_number() OVER (PARTITION BY name ORDER BY chain_id) = 1""",
)
def scan_kg_json(spark, sf):
    """Graph and chains written as node-link lines and read back.

    The edges of a pair of nodes share a document, under `edges` or `links`. Chains are nodes or stand at the top level, one to a document;
    of equal names the node comes first, then the earlier one.
    """
    path = scratch_folder(spark, "graph")
    d = deduped_once(spark, sf, scratch_folder(spark, "stage"))
    pair = gb.graph_edges(d).groupBy("source", "target").agg(F.collect_list(F.struct("source", "target", "relation_type", "triple_type")).alias("all"))
    new = F.xxhash64("source", "target") % 2 == 0
    pair.select(F.when(new, F.col("all")).alias("edges"), F.when(~new, F.col("all")).alias("links")).write.json(f"{path}/edges")
    gb.node_types(d).select(F.array(F.struct(F.col("node_id").alias("id"), "node_type")).alias("nodes")).write.json(f"{path}/nodes")
    chains, steps = chain_tables(spark, sf)
    listed = steps.groupBy("chain_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("step_no", "step"))), lambda s: s["step"]).alias("steps"))
    full = chains.join(listed, "chain_id", "left")
    told = F.struct("name", "description", "steps", F.col("trigger").alias("trigger_condition"))
    node = F.struct(F.col("chain_id").cast("string").alias("id"), F.lit("CausalChain").alias("node_type"), "name", "description", "steps", F.col("trigger").alias("trigger_condition"))
    own = F.col("population") == 0
    lines = full.select("chain_id", F.when(own, F.array(node)).alias("nodes"), F.when(~own, F.array(told)).alias("causal_chains"))
    lines.orderBy("chain_id").drop("chain_id").write.json(f"{path}/chains")
    g = graph_files.read_graph(spark, f"{path}/*", multiline=False)
    e = g["edges"].groupBy(F.col("relation_type").alias("name")).agg(F.count("*").alias("n")).withColumn("what", F.lit("edge"))
    kind = F.when(F.col("_c"), "Chain").otherwise(F.col("node_type"))
    n = g["nodes"].withColumn("_c", F.col("name").isNotNull()).groupBy(kind.alias("name")).agg(F.count("*").alias("n")).withColumn("what", F.lit("node"))
    c = gl.causal_chains(g["chains"], g["steps"]).select("name", F.col("n_steps").alias("n"), F.lit("chain").alias("what"))
    return e.unionByName(n).unionByName(c)


@query(
    "scan_judge_csv",
    """SELECT CAST(doc_id // 10 AS VARCHAR) AS station_id, CAST(doc_id % 2 AS VARCHAR) AS arm, CASE WHEN doc_id % 4 <> 0 THEN quality / 2.0 END::DOUBLE AS faithfulness, CASE WHEN doc_id % 3 <> 0 THEN toxic / 4.0 END::DOUBLE AS answer_relevancy, 3.0::DOUBLE AS n_events FROM labels""",
)
def scan_judge_csv(spark, sf):
    path = scratch_folder(spark, "judge")
    d = F.col("doc_id")
    rows = load(spark, sf, "labels").select(
        F.concat(F.lit("station_"), F.floor(d / 10).cast("string")).alias("station_id"),
        (d % 2).cast("string").alias("arm"),
        F.when(d % 8 == 0, "nan").when(d % 8 == 4, "").otherwise((F.col("quality") / 2).cast("string")).alias("faithfulness"),
        F.when(d % 3 == 0, "None").otherwise((F.col("toxic") / 4).cast("string")).alias("answer_relevancy"),
        F.lit("3").alias("n_events"),
    )
    rows.write.option("emptyValue", "").csv(path, header=True)
    return report_files.read_judge_scores(spark, path)


@query("scan_event_csv", EVENTS + f"SELECT station_id::VARCHAR AS station_id, event_idx::VARCHAR AS event_idx, {COLS.replace('station_id, ', '', 1)} FROM topev")
def scan_event_csv(spark, sf):
    path = scratch_folder(spark, "events")
    report_files.write_events(top_events(spark, sf), path)
    return show(report_files.read_events(spark, path))


@query(
    "scan_run_results",
    """WITH r AS (SELECT 'run_' || o_orderstatus || '_' || o_orderpriority AS run_name, o_orderstatus AS model_family, count(*) AS c FROM orders GROUP BY ALL)
    SELECT run_name, model_family, kpi, (c / 100.0)::DOUBLE AS mae, (c / d)::DOUBLE AS smape FROM r, (VALUES ('a', 2.0), ('b', 4.0)) k(kpi, d)""",
)
def scan_run_results(spark, sf):
    """A result document per order status and priority, in the folder of its run, and all runs of the prefix read back."""
    path = scratch_folder(spark, "runs")
    runs = load(spark, sf, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").cast("double").alias("c"))

    def cell(divisor: float):
        return F.struct((F.col("c") / divisor).alias("sMAPE"), (F.col("c") / 100).alias("MAE"))

    docs = runs.select(
        F.concat_ws("_", F.lit("run"), "o_orderstatus", "o_orderpriority").alias("run_name"),
        F.struct(F.col("o_orderstatus").alias("model_family")).alias("model"),
        F.struct(F.create_map(F.lit("a"), cell(2.0), F.lit("b"), cell(4.0)).alias("per_kpi")).alias("test"),
    )
    results.write_run_documents(docs, path)
    back = results.read_run_results(spark, path, prefix="run_", files="part-*")
    return back.select("run_name", "model_family", "kpi", F.col("MAE").alias("mae"), F.col("sMAPE").alias("smape"))


@query(
    "scan_reports",
    "SELECT CAST(doc_id // 2 AS VARCHAR) AS station_id, CASE doc_id % 2 WHEN 0 THEN 'arm off' ELSE 'arm/on' END AS arm, length(coalesce(text, '')) AS n_chars, md5(coalesce(text, '')) AS report_md5 FROM documents",
)
def scan_reports(spark, sf):
    """Texts as reports in a folder per station and arm, read back whole."""
    path = scratch_folder(spark, "reports")
    d = F.col("doc_id")
    report_files.write_reports(
        load(spark, sf, "documents").select(
            F.floor(d / 2).alias("station_id"), F.when(d % 2 == 0, "arm off").otherwise("arm/on").alias("arm"), F.col("text").alias("report")
        ),
        path,
    )
    back = report_files.read_written_reports(spark, path)
    return back.select("station_id", "arm", F.length("report").cast("long").alias("n_chars"), F.md5(F.col("report").cast("binary")).alias("report_md5"))


@query(
    "stage_cache",
    T + "SELECT th::DOUBLE AS theta, count(*) FILTER (score + 1e-9 >= th) AS approved, count(*) AS validated FROM v, (VALUES (0.7), (0.8), (0.9)) t(th) GROUP BY 1",
)
def stage_cache(spark, sf):
    """Scores staged once, thresholds applied to the stage afterwards."""
    path = scratch_folder(spark, "stage")
    stage = graph_files.staged(spark, path, lambda: validated(spark, sf).select("subject", "integrate_score"))
    again = graph_files.staged(spark, path, lambda: stage)
    thetas = F.array(*[F.lit(t) for t in (0.7, 0.8, 0.9)])
    return (
        again.select("integrate_score", F.explode(thetas).alias("theta"))
        .groupBy("theta")
        .agg(F.count_if(F.col("integrate_score") + 1e-9 >= F.col("theta")).alias("approved"), F.count("*").alias("validated"))
    )


# Learners have no SQL counterpart; tests compare them with plain loops.


def _lag_query(name, kind, **more):
    @query(name)
    def run(spark, sf):
        return tidy(lag_models.lag_regression(src.inputs(spark, sf, by=("station_id",)), KPIS, kind, **more), "pred", digits=3)

    return run


fc_lag_regression = _lag_query("fc_lag_regression", "ridge")
# the sums of products grow with the square of the context
fc_lag_lasso = _lag_query("fc_lag_lasso", "lasso", context_h=6)
fc_lag_elasticnet = _lag_query("fc_lag_elasticnet", "elasticnet", context_h=6)


def _pooled_query(name, kind):
    """A learner of the ML library on the windows of all series, one a day."""

    @query(name)
    def run(spark, sf):
        return tidy(fc.pooled_regression(src.inputs(spark, sf), kind, context_h=24, stride_h=24), "pred", digits=3)

    return run


fc_pooled_regression = _pooled_query("fc_pooled_regression", "ridge")
fc_pooled_lasso = _pooled_query("fc_pooled_lasso", "lasso")
fc_pooled_elasticnet = _pooled_query("fc_pooled_elasticnet", "elasticnet")


def _tree_query(name, kind):
    """Trees on the same windows."""

    @query(name)
    def run(spark, sf):
        return tidy(fc.pooled_trees(src.inputs(spark, sf), kind, context_h=24, stride_h=24), "pred", digits=3)

    return run


fc_pooled_boosted = _tree_query("fc_pooled_boosted", "boosted")
fc_pooled_forest = _tree_query("fc_pooled_forest", "forest")
