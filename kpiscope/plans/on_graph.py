"""Queries on graph construction, loading and lookup."""

from __future__ import annotations

from pyspark.sql import functions as F

from kpiscope.functions.exprs import settle, settle_wide, small_table
from kpiscope.operators import graph_build as gb
from kpiscope.operators import graph_load as gl
from kpiscope.operators import graph_query as gq
from kpiscope.plans import inputs as src
from kpiscope.plans.on_profiles import tidy
from kpiscope.plans.registry import FORECAST, query, rnd, rnd_wide
from kpiscope.session import scratch_folder
from kpiscope.sources.tables import load


def triples(spark, sf):
    """Triples told by order lines: subject = supplier, predicate by return flag, object = part."""
    line, part, supp = F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")
    flag = F.col("l_returnflag")
    attr = F.element_at(F.array(*[F.lit(x) for x in ("has_unit", "has_formula", "has_min_value", "has_measurements")]), line % 4 + 1)
    predicate = F.when(flag == "N", attr).when(flag == "A", "AFFECTS").otherwise("measured_as")
    kind = (
        F.when(flag == "N", "kpi_definition")
        .when(flag == "A", "relationship")
        .when(F.col("l_linestatus") == "O", "causal_chain")
        .otherwise("measurement")
    )
    obj = (
        F.when(predicate == "has_min_value", F.concat(part % 50, F.lit("%")))
        .when(predicate == "has_measurements", F.concat(F.lit("C"), part % 7, F.lit("; C"), supp % 5, F.lit(" ,")))
        .otherwise(F.concat(F.lit("P"), part))
    )
    return load(spark, sf, "lineitem").select(
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("ord"),
        F.concat(F.lit("S "), supp).alias("subject"),
        predicate.alias("predicate"),
        obj.alias("object"),
        kind.alias("triple_type"),
        F.concat(F.lit("TS 28.55"), line % 4).alias("source_spec"),
        F.concat(line, F.lit("."), part % 3, F.when(F.col("l_quantity") > 25, ".1").otherwise("")).alias("source_clause"),
        F.concat(F.lit("line "), line).alias("raw_text"),
        (1 - F.col("l_discount")).alias("relation_prob"),
        F.when(F.col("l_tax") > 0.02, F.col("l_quantity") * 4).alias("min_pct_source"),
        F.lit(None).cast("double").alias("min_pct_target"),
        F.when(F.col("l_tax") > 0.05, F.concat(F.lit("tax "), part % 5)).alias("mechanism"),
        F.lit(None).cast("string").alias("fine_clause"),
        (1 - F.col("l_discount")).alias("confidence"),
        (1 - F.col("l_tax")).alias("clarity"),
        (F.col("l_quantity") / 50).alias("relevance"),
        F.lit(None).cast("double").alias("quality_score"),
    )


def alignments(spark, sf):
    """Two thirds of the suppliers have an alignment, a quarter of those point elsewhere."""
    k = F.col("s_suppkey")
    return load(spark, sf, "supplier").filter(k % 3 != 2).select(
        F.concat(F.lit("S "), k).alias("original_name"),
        F.concat(F.lit("S_"), k).alias("aligned_name"),
        F.when(k % 3 == 0, "Measurement").otherwise("KPIDefinition").alias("entity_type"),
        F.lit(False).alias("is_new"),
        F.when(k % 4 == 0, F.concat(F.lit("M"), k % 8)).alias("mapped_to"),
        F.lit(0.8).alias("align_conf"),
    )


def validated(spark, sf):
    return gb.integrate_scores(gb.align(gb.normalize_triples(triples(spark, sf)), alignments(spark, sf)))


T = """WITH t0 AS (SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS ord, *,
    CASE l_returnflag WHEN 'N' THEN CASE l_linenumber % 4 WHEN 0 THEN 'has_unit' WHEN 1 THEN 'has_formula' WHEN 2 THEN 'has_min_value' ELSE 'has_measurements' END
      WHEN 'A' THEN 'AFFECTS' ELSE 'measured_as' END AS predicate,
    CASE WHEN l_returnflag = 'N' THEN 'kpi_definition' WHEN l_returnflag = 'A' THEN 'relationship' WHEN l_linestatus = 'O' THEN 'causal_chain' ELSE 'measurement' END AS triple_type FROM lineitem),
  tr AS (SELECT ord, l_suppkey AS sk, 'S ' || l_suppkey AS subject, predicate, triple_type,
    CASE predicate WHEN 'has_min_value' THEN (l_partkey % 50) || '%' WHEN 'has_measurements' THEN 'C' || (l_partkey % 7) || '; C' || (l_suppkey % 5) || ' ,' ELSE 'P' || l_partkey END AS object,
    'TS 28.55' || (l_linenumber % 4) AS source_spec, l_linenumber || '.' || (l_partkey % 3) || CASE WHEN l_quantity > 25 THEN '.1' ELSE '' END AS source_clause,
    1 - l_discount AS relation_prob, least(CASE WHEN l_tax > 0.02 THEN l_quantity * 4 END, CASE WHEN l_tax > 0.02 THEN 100.0 END) AS min_pct_source,
    CASE WHEN l_tax > 0.05 THEN 'tax ' || (l_partkey % 5) END AS mechanism,
    1 - l_discount AS confidence, 1 - l_tax AS clarity, l_quantity / 50 AS relevance FROM t0),
  v AS (SELECT *, CASE WHEN sk % 3 = 2 THEN 'NEW_TYPE' WHEN sk % 3 = 0 THEN 'Measurement' ELSE 'KPIDefinition' END AS entity_type, sk % 3 = 2 AS is_new,
    'S_' || sk AS aligned_name, CASE WHEN sk % 3 <> 2 AND sk % 4 = 0 THEN 'M' || (sk % 8) END AS mapped_to, CASE WHEN sk % 3 = 2 THEN 0.3 ELSE 0.8 END::DOUBLE AS align_conf,
    (confidence + clarity + relevance) / 3 AS score FROM tr),
  vn AS (SELECT *, coalesce(mapped_to, aligned_name) AS node_id FROM v)
"""


@query(
    "kg_triple_normalize",
    T + f"SELECT predicate, triple_type, count(*) AS n, {rnd('min(relation_prob)', 4)} AS min_prob, {rnd('max(min_pct_source)', 4)} AS max_pct, count(min_pct_source) AS n_pct FROM tr GROUP BY 1, 2",
)
def kg_triple_normalize(spark, sf):
    return gb.normalize_triples(triples(spark, sf)).groupBy("predicate", "triple_type").agg(
        F.count("*").alias("n"),
        settle(F.min("relation_prob"), 4).alias("min_prob"),
        settle(F.max("min_pct_source"), 4).alias("max_pct"),
        F.count("min_pct_source").alias("n_pct"),
    )


@query(
    "kg_align_default",
    T + "SELECT aligned_name, entity_type, is_new, mapped_to, align_conf, count(*) AS n FROM v GROUP BY ALL",
)
def kg_align_default(spark, sf):
    out = gb.align(gb.normalize_triples(triples(spark, sf)), alignments(spark, sf))
    return out.groupBy("aligned_name", "entity_type", "is_new", "mapped_to", "align_conf").agg(F.count("*").alias("n"))


@query(
    "kg_core_alignment",
    T + """, p AS (SELECT *, CASE WHEN aligned_name IN ('S_1', 'S_5', 'S_7', 'M0', 'M4') THEN aligned_name WHEN mapped_to IN ('S_1', 'S_5', 'S_7', 'M0', 'M4') THEN mapped_to END AS k FROM v)
    SELECT coalesce(k, aligned_name) AS aligned_name, CASE WHEN k IS NOT NULL THEN 'KPIDefinition' ELSE entity_type END AS entity_type, CASE WHEN k IS NOT NULL THEN false ELSE is_new END AS is_new,
      CASE WHEN k IS NOT NULL THEN greatest(align_conf, 0.95) ELSE align_conf END AS align_conf, count(*) AS n FROM p GROUP BY ALL""",
)
def kg_core_alignment(spark, sf):
    out = gb.pin_core_kpis(gb.align(gb.normalize_triples(triples(spark, sf)), alignments(spark, sf)), ["S_1", "S_5", "S_7", "M0", "M4"])
    return out.groupBy("aligned_name", "entity_type", "is_new", "align_conf").agg(F.count("*").alias("n"))


@query(
    "kg_embed_align",
    f"""WITH o AS (SELECT label, min(vec_id) AS vec_id FROM embeddings GROUP BY 1),
    ov AS (SELECT e.label, e.vec_id, e.embedding::DOUBLE[] AS v FROM embeddings e JOIN o ON o.vec_id = e.vec_id),
    s AS (SELECT e.vec_id, ov.label, list_cosine_similarity(e.embedding::DOUBLE[], ov.v) AS sim FROM embeddings e, ov WHERE e.vec_id NOT IN (SELECT vec_id FROM o)),
    r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, label) AS r FROM s)
    SELECT vec_id AS entity_id, 'label_' || label AS aligned_name, {rnd('1 - sim', 5)} AS distance FROM r WHERE r = 1""",
)
def kg_embed_align(spark, sf):
    vecs = load(spark, sf, "embeddings")
    first = vecs.groupBy("label").agg(F.min("vec_id").alias("vec_id"))
    onto = vecs.join(first, ["label", "vec_id"]).select(F.concat(F.lit("label_"), "label").alias("name"), F.col("embedding").alias("vec"))
    ents = vecs.join(first, ["label", "vec_id"], "left_anti").select(F.col("vec_id").alias("entity_id"), F.col("embedding").alias("vec"))
    return tidy(gb.embed_align(ents, onto), "distance", digits=5)


CONF = T + """, g AS (SELECT *, count(*) OVER (PARTITION BY aligned_name, predicate) AS n,
      row_number() OVER (PARTITION BY aligned_name, predicate ORDER BY relation_prob DESC, length(source_clause) DESC, ord) AS r FROM v),
  g2 AS (SELECT *, row_number() OVER (PARTITION BY aligned_name, predicate ORDER BY ord) AS o FROM g WHERE r <= 10 AND n > 1),
  g3 AS (SELECT *, CASE WHEN n > 10 THEN r ELSE o END AS place FROM g2),
  cpairs AS (SELECT a.aligned_name, a.predicate, a.place AS i, b.place AS j, a.object AS object_a, b.object AS object_b, a.relation_prob AS pa, b.relation_prob AS pb FROM g3 a
    JOIN g3 b ON a.aligned_name = b.aligned_name AND a.predicate = b.predicate AND a.place < b.place AND trim(a.object) <> trim(b.object))
"""


def _aligned(spark, sf):
    return gb.align(gb.normalize_triples(triples(spark, sf)), alignments(spark, sf))


@query("kg_conflict_pairs", CONF + "SELECT aligned_name, predicate, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, object_a, object_b FROM cpairs")
def kg_conflict_pairs(spark, sf):
    return gb.conflict_pairs(_aligned(spark, sf)).select(
        "aligned_name", "predicate", "i", "j", F.col("a.object").alias("object_a"), F.col("b.object").alias("object_b")
    )


@query(
    "kg_conflict_leading",
    T + """, ob AS (SELECT *, row_number() OVER (PARTITION BY aligned_name, predicate, trim(object) ORDER BY relation_prob DESC, length(source_clause) DESC, ord) AS r FROM v),
    q AS (SELECT *, row_number() OVER (PARTITION BY aligned_name, predicate ORDER BY relation_prob DESC, length(source_clause) DESC, ord) AS place FROM ob WHERE r = 1)
    SELECT a.aligned_name, a.predicate, CAST(b.place AS INTEGER) AS j, a.object AS object_a, b.object AS object_b FROM q a JOIN q b ON a.aligned_name = b.aligned_name AND a.predicate = b.predicate AND a.place = 1 AND b.place > 1""",
)
def kg_conflict_leading(spark, sf):
    """Conflicts without a cap: every object of a group against that of its leading row."""
    pairs = gb.conflict_pairs(_aligned(spark, sf), cap=None)
    return pairs.select("aligned_name", "predicate", "j", F.col("a.object").alias("object_a"), F.col("b.object").alias("object_b"))


@query(
    "kg_conflict_resolve",
    CONF.replace("WITH", "WITH RECURSIVE", 1) + """, told AS (SELECT a.aligned_name, a.predicate, a.place AS i, b.place AS j, row_number() OVER (PARTITION BY a.aligned_name, a.predicate ORDER BY a.place, b.place) AS k,
      CASE WHEN a.relation_prob < b.relation_prob OR (a.relation_prob = b.relation_prob AND len(string_split(a.source_clause, '.')) < len(string_split(b.source_clause, '.'))) THEN a.place ELSE b.place END AS loser
      FROM g3 a JOIN g3 b ON a.aligned_name = b.aligned_name AND a.predicate = b.predicate AND a.place < b.place AND trim(a.object) <> trim(b.object) AND (length(a.object) + length(b.object)) % 2 = 0),
    replay AS (SELECT DISTINCT aligned_name, predicate, 0::BIGINT AS k, 0::BIGINT AS lost FROM told
      UNION ALL SELECT t.aligned_name, t.predicate, t.k, CASE WHEN ((lost >> i) | (lost >> j)) & 1 = 1 THEN lost ELSE lost | (1::BIGINT << loser) END
        FROM replay r JOIN told t ON t.aligned_name = r.aligned_name AND t.predicate = r.predicate AND t.k = r.k + 1),
    fin AS (SELECT aligned_name, predicate, arg_max(lost, k) AS lost FROM replay GROUP BY 1, 2),
    gone AS (SELECT g3.ord FROM g3 JOIN fin ON g3.aligned_name = fin.aligned_name AND g3.predicate = fin.predicate WHERE (lost >> place) & 1 = 1)
    SELECT aligned_name, predicate, count(*) AS kept FROM v WHERE ord NOT IN (SELECT ord FROM gone) GROUP BY 1, 2""",
)
def kg_conflict_resolve(spark, sf):
    aligned = _aligned(spark, sf)
    p = gb.conflict_pairs(aligned)
    told = F.when((F.length("a.object") + F.length("b.object")) % 2 == 0, "contradict").otherwise("agree")
    verdicts = p.select(F.col("a.ord").alias("ord_a"), F.col("b.ord").alias("ord_b"), told.alias("verdict"))
    return gb.conflict_resolve(aligned, verdicts).groupBy("aligned_name", "predicate").agg(F.count("*").alias("kept"))


@query("kg_integrate_score", T + f"SELECT sk AS suppkey, count(*) AS n, {rnd('avg(score)', 5)} AS mean_score, {rnd('min(score)', 5)} AS min_score, {rnd('max(score)', 5)} AS max_score FROM v GROUP BY 1")
def kg_integrate_score(spark, sf):
    return validated(spark, sf).groupBy(F.split_part("subject", F.lit(" "), F.lit(2)).cast("long").alias("suppkey")).agg(
        F.count("*").alias("n"),
        settle(F.avg("integrate_score"), 5).alias("mean_score"),
        settle(F.min("integrate_score"), 5).alias("min_score"),
        settle(F.max("integrate_score"), 5).alias("max_score"),
    )


@query(
    "kg_threshold",
    T + """SELECT triple_type, count(*) AS validated, count(*) FILTER (score + 1e-9 >= 0.8) AS approved, count(*) FILTER (score + 1e-9 < 0.8) AS rejected,
      count(*) FILTER (score + 1e-9 >= 0.8 AND is_new) AS new_entities, count(*) FILTER (score + 1e-9 >= 0.8 AND mapped_to IS NOT NULL) AS mapped_entities FROM v GROUP BY 1""",
)
def kg_threshold(spark, sf):
    return gb.approval_counts(gb.approve(validated(spark, sf), 0.8), ("triple_type",))


@query(
    "kg_quality_summary",
    T + f"""SELECT count(*) FILTER (score + 1e-9 >= 0.8) AS approved, count(*) FILTER (score + 1e-9 < 0.8) AS rejected, {rnd('avg(confidence) FILTER (score + 1e-9 >= 0.8)', 5)} AS avg_confidence,
      {rnd('avg(clarity) FILTER (score + 1e-9 >= 0.8)', 5)} AS avg_clarity, {rnd('avg(relevance) FILTER (score + 1e-9 >= 0.8)', 5)} AS avg_relevance, {rnd('avg(score) FILTER (score + 1e-9 >= 0.8)', 5)} AS avg_integrate_score FROM v""",
)
def kg_quality_summary(spark, sf):
    out = gb.quality_summary(gb.approve(validated(spark, sf), 0.8))
    return tidy(out, "avg_confidence", "avg_clarity", "avg_relevance", "avg_integrate_score", digits=5)


@query(
    "kg_feedback_replace",
    T + """, f AS (SELECT DISTINCT source_spec, source_clause FROM tr WHERE relation_prob < 0.905),
    r AS (SELECT t.* FROM tr t ANTI JOIN f ON t.source_spec = f.source_spec AND t.source_clause = f.source_clause
      UNION ALL SELECT t.* REPLACE ('again' AS predicate) FROM tr t SEMI JOIN f ON t.source_spec = f.source_spec AND t.source_clause = f.source_clause WHERE t.predicate = 'AFFECTS')
    SELECT source_spec, predicate, count(*) AS n FROM r GROUP BY 1, 2""",
)
def kg_feedback_replace(spark, sf):
    t = triples(spark, sf)
    flagged = t.filter("relation_prob < 0.905")
    again = t.filter("predicate = 'AFFECTS'").join(
        flagged.select("source_spec", "source_clause").distinct(), ["source_spec", "source_clause"], "left_semi"
    ).withColumn("predicate", F.lit("again"))
    return gb.feedback_replace(t, flagged, again).groupBy("source_spec", "predicate").agg(F.count("*").alias("n"))


@query(
    "kg_dedupe_triples",
    T + """, r AS (SELECT *, row_number() OVER (PARTITION BY subject, predicate, object ORDER BY ord) AS r FROM tr)
    SELECT subject, predicate, object, source_clause, mechanism FROM r WHERE r = 1""",
)
def kg_dedupe_triples(spark, sf):
    return gb.dedupe_triples(triples(spark, sf)).select("subject", "predicate", "object", "source_clause", "mechanism")


GRAPH = T + """, d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subject, predicate, object ORDER BY ord) AS dr FROM vn) WHERE dr = 1),
  cnt AS (SELECT d.*, trim(c.x) AS counter FROM d, unnest(string_split(replace(object, ';', ','), ',')) c(x) WHERE predicate = 'has_measurements' AND trim(c.x) <> ''),
  sight AS (SELECT node_id, CASE triple_type WHEN 'kpi_definition' THEN 'KPIDefinition' WHEN 'measurement' THEN 'Measurement' WHEN 'causal_chain' THEN 'CausalChain'
        ELSE CASE WHEN entity_type IN ('KPIDefinition', 'Measurement') THEN entity_type ELSE 'Entity' END END AS node_type, ord, 0 AS side FROM d
    UNION ALL SELECT counter, 'Measurement', ord, 1 FROM cnt
    UNION ALL SELECT object, 'Entity', ord, 1 FROM d WHERE triple_type <> 'kpi_definition'),
  ntype AS (SELECT node_id, node_type FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY ord, side) AS r FROM sight) WHERE r = 1),
  erow AS (SELECT node_id AS source, object AS target, predicate AS relation_type, triple_type, source_clause, score, align_conf, min_pct_source, mechanism, ord FROM d WHERE triple_type <> 'kpi_definition'
    UNION ALL SELECT node_id, counter, 'uses_counter', triple_type, source_clause, score, align_conf, min_pct_source, mechanism, ord FROM cnt),
  edges AS (SELECT source, target, arg_max(relation_type, ord) AS relation_type, arg_max(triple_type, ord) AS triple_type, arg_max(source_clause, ord) AS source_clause, arg_max(score, ord) AS quality_score,
    arg_max(min_pct_source, ord) FILTER (min_pct_source IS NOT NULL) AS min_pct_source, arg_max(mechanism, ord) FILTER (mechanism IS NOT NULL) AS mechanism FROM erow GROUP BY 1, 2)
"""


def deduped(spark, sf):
    """Validated triples, each once; alignment and scores follow from a triple itself, so they are added to those that stay."""
    return gb.integrate_scores(gb.align(gb.dedupe_triples(gb.normalize_triples(triples(spark, sf))), alignments(spark, sf)))


def deduped_once(spark, sf, path, columns=gb.GRAPH_COLUMNS):
    """Deduplicated triples kept as a table, for queries that write both nodes and edges of them."""
    deduped(spark, sf).select(*columns).write.parquet(f"{path}/triples")
    return spark.read.parquet(f"{path}/triples")


@query("kg_node_type", GRAPH + "SELECT * FROM ntype")
def kg_node_type(spark, sf):
    return gb.node_types(deduped(spark, sf))


@query(
    "kg_node_aggregate",
    GRAPH + f"SELECT node_id, max(align_conf) AS confidence, arg_max(mapped_to, ord) FILTER (mapped_to IS NOT NULL) AS mapped_to, count(*) AS n_triples, {rnd('avg(score)', 5)} AS mean_quality FROM d GROUP BY 1",
)
def kg_node_aggregate(spark, sf):
    return tidy(gb.node_aggregate(deduped(spark, sf)), "mean_quality", digits=5)


@query(
    "kg_node_values",
    GRAPH + """SELECT DISTINCT node_id, 'original_names' AS field, subject AS value FROM d UNION SELECT node_id, 'source_specs', source_spec FROM d
    UNION SELECT node_id, 'source_clauses', source_clause FROM d UNION SELECT node_id, 'provenance', source_spec || ':' || source_clause FROM d""",
)
def kg_node_values(spark, sf):
    return gb.node_values(deduped(spark, sf)).drop("first_ord")


@query(
    "kg_kpi_attributes",
    GRAPH + """SELECT node_id, arg_max(object, ord) FILTER (predicate = 'has_formula') AS formula, arg_max(object, ord) FILTER (predicate = 'has_unit') AS unit,
      arg_max(CAST(rtrim(object, '%') AS DOUBLE), ord) FILTER (predicate = 'has_min_value') AS min_value FROM (SELECT node_id, predicate, ord, CASE WHEN predicate = 'has_min_value' THEN object ELSE object END AS object FROM d
      WHERE triple_type = 'kpi_definition' AND predicate <> 'has_measurements') GROUP BY 1""".replace(
        "arg_max(CAST(rtrim(object, '%') AS DOUBLE), ord)", "arg_max(TRY_CAST(rtrim(object, '%') AS DOUBLE), ord)"
    ),
)
def kg_kpi_attributes(spark, sf):
    return gb.kpi_attributes(deduped(spark, sf)).select("node_id", "formula", "unit", "min_value")


@query(
    "kg_node_measurements",
    GRAPH + """, lists AS (SELECT node_id, ord, list_filter(list_transform(string_split(replace(object, ';', ','), ','), lambda x: trim(x)), lambda x: x <> '') AS l FROM d WHERE predicate = 'has_measurements'),
    m AS (SELECT node_id, ord, unnest(l) AS measurement, generate_subscripts(l, 1) AS pos FROM lists),
    f AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY node_id, measurement ORDER BY ord, pos) = 1)
    SELECT node_id, CAST(row_number() OVER (PARTITION BY node_id ORDER BY ord, pos) AS INTEGER) AS place, measurement FROM f""",
)
def kg_node_measurements(spark, sf):
    return gb.node_measurements(deduped(spark, sf))


@query("kg_counter_edges", GRAPH + "SELECT node_id AS source, counter AS target, count(*) AS n FROM cnt GROUP BY 1, 2")
def kg_counter_edges(spark, sf):
    return gb.counter_edges(deduped(spark, sf)).groupBy(gb.node_id().alias("source"), F.col("counter").alias("target")).agg(F.count("*").alias("n"))


@query("kg_edges", GRAPH + f"SELECT source, target, relation_type, triple_type, source_clause, {rnd('quality_score', 5)} AS quality_score, min_pct_source, mechanism FROM edges")
def kg_edges(spark, sf):
    out = gb.graph_edges(deduped(spark, sf)).select(
        "source", "target", "relation_type", "triple_type", "source_clause", "quality_score", "min_pct_source", "mechanism"
    )
    return tidy(out, "quality_score", digits=5)


@query("kg_stats", GRAPH + "SELECT 'node_type' AS what, node_type AS name, count(*) AS n FROM ntype GROUP BY 2 UNION ALL SELECT 'triple_type', triple_type, count(*) FROM edges GROUP BY 2")
def kg_stats(spark, sf):
    d = deduped(spark, sf)
    return gb.graph_stats(gb.node_types(d), gb.graph_edges(d))


@query(
    "sink_kg",
    GRAPH + """SELECT 'node' AS what, node_type AS name, count(*) AS n, NULL AS mean_quality FROM ntype GROUP BY 2
    UNION ALL SELECT 'edge', relation_type, count(*), """ + rnd("avg(quality_score)", 5) + """ FROM edges GROUP BY 2
    UNION ALL SELECT 'metadata', 'num_nodes', (SELECT count(*) FROM ntype), NULL UNION ALL SELECT 'metadata', 'num_edges', (SELECT count(*) FROM edges), NULL""",
)
def sink_kg(spark, sf):
    """The graph written with its metadata, and what the written tables hold."""
    from kpiscope.sources.graph_files import read_written_graph, write_graph

    path = scratch_folder(spark, "kg")
    d = deduped_once(spark, sf, scratch_folder(spark, "stage"))
    write_graph(gb.node_types(d), gb.graph_edges(d), path)
    g = read_written_graph(spark, path)
    nodes = g["nodes"].groupBy(F.col("node_type").alias("name")).agg(F.count("*").alias("n")).select(F.lit("node").alias("what"), "name", "n")
    edges = g["edges"].groupBy(F.col("relation_type").alias("name")).agg(F.count("*").alias("n"), settle(F.avg("quality_score"), 5).alias("mean_quality"))
    sizes = g["metadata"].select(F.lit("metadata").alias("what"), F.expr("stack(2, 'num_nodes', num_nodes, 'num_edges', num_edges) AS (name, n)"))
    return nodes.unionByName(edges.withColumn("what", F.lit("edge")), allowMissingColumns=True).unionByName(sizes, allowMissingColumns=True)


# KPI-level edges between nations, told by who ships to whom.


def nation_edges(spark, sf):
    nation = load(spark, sf, "nation")
    lines = load(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_discount", "l_returnflag", "l_linestatus")
    orders = load(spark, sf, "orders").select("o_orderkey", "o_custkey")
    cust = load(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("t"))
    supp = load(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("s"))
    d = F.col("l_discount").cast("decimal(18,2)")
    grouped = (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(cust, F.col("o_custkey") == F.col("c_custkey"))
        .join(supp, F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy("s", "t", "l_returnflag", "l_linestatus")
        .agg(F.count("*").alias("weight"), (1 - F.sum(d).cast("double") / F.count("*")).alias("confidence"))
    )
    code = F.concat("l_returnflag", "l_linestatus")
    relation = (
        F.when(code == "AF", "positively_affects").when(code == "AO", "increases").when(code == "NF", "inversely_affects")
        .when(code == "NO", "LIMITS").when(code == "RF", "uses_counter").otherwise("Determines")
    )
    strength = F.element_at(
        F.array(*[F.lit(x) for x in ("critical", "strong", "moderate", "weak", "extracted", "odd", "extracted")]), ((F.col("s") + 2 * F.col("t")) % 7 + 1)
    )
    name = nation.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("n"))
    return (
        grouped.join(name.withColumnsRenamed({"k": "s", "n": "source"}), "s")
        .join(name.withColumnsRenamed({"k": "t", "n": "target"}), "t")
        .select(
            "source",
            "target",
            relation.alias("relation_type"),
            F.when(F.col("l_returnflag") == "R", "relationship").otherwise("ontology_relationship").alias("triple_type"),
            strength.alias("strength"),
            "confidence",
            F.when(F.col("s") % 5 == 0, F.concat("target", F.lit("_baseline > 10"))).otherwise("").alias("condition"),
            F.concat(F.lit("w"), F.col("weight") % 3).alias("reason"),
            F.when(F.col("t") % 2 == 0, F.concat(F.lit("TS 38.214 §7."), "t")).otherwise("TS 28.552").alias("spec_reference"),
            F.when(F.col("s") % 3 == 0, F.concat(F.lit("via "), "source")).alias("mechanism"),
            F.when(F.col("t") % 4 == 0, F.lit(6.0)).alias("min_pct_source"),
            F.lit(None).cast("double").alias("min_pct_target"),
            F.struct("l_returnflag", "l_linestatus").alias("ord"),
            (F.col("confidence") - (F.col("s") % 5) * 0.01).alias("quality_score"),
            "weight",
        )
    )


def known(spark, sf):
    return load(spark, sf, "nation").filter("n_regionkey < 4").select(F.col("n_name").alias("name"))


E = """WITH ne0 AS (SELECT s.s_nationkey AS s, c.c_nationkey AS t, l_returnflag AS rf, l_linestatus AS ls, count(*) AS weight,
      1 - CAST(sum(CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS confidence
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer c ON o_custkey = c_custkey JOIN supplier s ON l_suppkey = s_suppkey GROUP BY 1, 2, 3, 4),
  ne AS (SELECT a.n_name AS source, b.n_name AS target, CASE rf || ls WHEN 'AF' THEN 'positively_affects' WHEN 'AO' THEN 'increases' WHEN 'NF' THEN 'inversely_affects' WHEN 'NO' THEN 'LIMITS' WHEN 'RF' THEN 'uses_counter' ELSE 'Determines' END AS raw_type,
    CASE WHEN rf = 'R' THEN 'relationship' ELSE 'ontology_relationship' END AS triple_type,
    CASE (s + 2 * t) % 7 WHEN 0 THEN 'critical' WHEN 1 THEN 'strong' WHEN 2 THEN 'moderate' WHEN 3 THEN 'weak' WHEN 5 THEN 'odd' ELSE 'extracted' END AS raw_strength, confidence,
    CASE WHEN s % 5 = 0 THEN b.n_name || '_baseline > 10' ELSE '' END AS condition, 'w' || (weight % 3) AS reason, CASE WHEN t % 2 = 0 THEN 'TS 38.214 §7.' || t ELSE 'TS 28.552' END AS spec_reference,
    CASE WHEN s % 3 = 0 THEN 'via ' || a.n_name END AS mechanism, CASE WHEN t % 4 = 0 THEN 6.0 END::DOUBLE AS min_pct_source, rf || ls AS ord, confidence - (s % 5) * 0.01::DOUBLE AS quality_score, s, t, weight
    FROM ne0 JOIN nation a ON a.n_nationkey = s JOIN nation b ON b.n_nationkey = t),
  nc AS (SELECT *, CASE upper(raw_type) WHEN 'INVERSELY_AFFECTS' THEN 'DECREASES' WHEN 'POSITIVELY_AFFECTS' THEN 'INCREASES' WHEN 'SEVERELY_DECREASES' THEN 'DECREASES' WHEN 'DIRECTLY_PROPORTIONAL' THEN 'INCREASES' WHEN 'ENABLES' THEN 'INCREASES' ELSE upper(raw_type) END AS relation_type,
    CASE WHEN raw_strength = 'odd' THEN 'moderate' ELSE raw_strength END AS strength FROM ne),
  us0 AS (SELECT * FROM nc WHERE relation_type IN ('INCREASES', 'DECREASES', 'DETERMINES', 'LIMITS', 'CAUSES') AND source IN (SELECT n_name FROM nation WHERE n_regionkey < 4) AND target IN (SELECT n_name FROM nation WHERE n_regionkey < 4)),
  us AS (SELECT * FROM us0 WHERE strength <> 'extracted' OR confidence >= 0.95),
  rel AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, target, relation_type ORDER BY ord) AS r FROM us) WHERE r = 1),
  rule AS (SELECT *, CASE WHEN relation_type IN ('INCREASES', 'DETERMINES', 'CAUSES') THEN 'positive' ELSE 'negative' END AS coupling FROM (SELECT *, row_number() OVER (PARTITION BY source, target ORDER BY ord) AS r2 FROM us) WHERE r2 = 1)
"""


def rels(spark, sf):
    return gl.relationships(nation_edges(spark, sf), known(spark, sf), 0.95)


@query("kg_relation_alias", E + "SELECT raw_type, relation_type, count(*) AS n FROM nc GROUP BY 1, 2")
def kg_relation_alias(spark, sf):
    return nation_edges(spark, sf).groupBy(
        F.col("relation_type").alias("raw_type"), gl.canonical_relation("relation_type").alias("canonical")
    ).agg(F.count("*").alias("n")).withColumnRenamed("canonical", "relation_type")


@query("kg_relationships", E + f"SELECT source, target, relation_type, strength, {rnd('confidence', 5)} AS confidence, nullif(condition, '') AS condition, reason, spec_reference FROM rel")
def kg_relationships(spark, sf):
    return tidy(rels(spark, sf), "confidence", digits=5)


SRC_PCT = "coalesce(min_pct_source, CASE strength WHEN 'critical' THEN 5 WHEN 'strong' THEN 8 WHEN 'moderate' THEN 10 WHEN 'weak' THEN 15 ELSE 12 END)::DOUBLE"
TGT_PCT = "(CASE strength WHEN 'critical' THEN 5 WHEN 'strong' THEN 10 WHEN 'moderate' THEN 10 WHEN 'weak' THEN 15 ELSE 12 END)::DOUBLE"


@query(
    "kg_directional_rules",
    E + f"""SELECT source, target, coupling, CASE WHEN strength = 'extracted' THEN 'moderate' ELSE strength END AS strength, {SRC_PCT} AS min_pct_source, {TGT_PCT} AS min_pct_target,
      coalesce(mechanism, reason) AS mechanism, trim(split_part(spec_reference, '§', 1)) AS spec_reference, trim(split_part(spec_reference, '§', 2)) AS spec_clause,
      'Adjust ' || target || ' in the ' || CASE WHEN coupling = 'positive' THEN 'same' ELSE 'opposite' END || ' direction as ' || source || '.' AS correction_hint, nullif(condition, '') AS condition FROM rule""",
)
def kg_directional_rules(spark, sf):
    return gl.directional_rules(nation_edges(spark, sf), known(spark, sf), 0.95)


@query(
    "kg_drop_fraction",
    E + f""", best AS (SELECT source, target, relation_type, max(confidence) AS b FROM nc GROUP BY 1, 2, 3),
    sc AS (SELECT r.source, r.target, r.relation_type, r.strength, CASE r.strength WHEN 'critical' THEN 1.0 WHEN 'strong' THEN 0.9 WHEN 'moderate' THEN 0.7 WHEN 'weak' THEN 0.5 ELSE b.b END AS score
      FROM rel r JOIN best b ON r.source = b.source AND r.target = b.target AND r.relation_type = b.relation_type),
    p AS (SELECT *, row_number() OVER (ORDER BY score, source, target, relation_type) AS pos, count(*) OVER () AS n FROM sc)
    SELECT source, target, relation_type, strength, {rnd('score', 5)} AS score FROM p WHERE pos > round_even(0.3 * n, 0)""",
)
def kg_drop_fraction(spark, sf):
    scored = gl.scored_relationships(nation_edges(spark, sf), known(spark, sf), 0.95)
    out = gl.drop_weakest(scored, 0.3).select("source", "target", "relation_type", "strength", "score")
    return tidy(out, "score", digits=5)


@query(
    "kg_drop_rules",
    E + """, sr AS (SELECT source, target, coupling, CASE WHEN strength = 'extracted' THEN 'moderate' ELSE strength END AS strength FROM rule),
    p AS (SELECT *, row_number() OVER (ORDER BY CASE strength WHEN 'critical' THEN 1.0 WHEN 'strong' THEN 0.9 WHEN 'moderate' THEN 0.7 ELSE 0.5 END, source, target) AS pos, count(*) OVER () AS n FROM sr)
    SELECT source, target, coupling, strength FROM p WHERE pos > round_even(0.3 * n, 0)""",
)
def kg_drop_rules(spark, sf):
    """The weakest rules go by their strength, as relationships do."""
    rules = gl.directional_rules(nation_edges(spark, sf), known(spark, sf), 0.95)
    scored = rules.withColumn("score", gl.strength_score("strength"))
    return gl.drop_weakest(scored, 0.3, ("source", "target")).select("source", "target", "coupling", "strength")


@query("kg_related", E + "SELECT source, target, relation_type, 'affects' AS direction FROM rel WHERE source = 'NATION_3' UNION ALL SELECT source, target, relation_type, 'affected_by' FROM rel WHERE target = 'NATION_3'")
def kg_related(spark, sf):
    return gq.related(rels(spark, sf), "NATION_3").select("source", "target", "relation_type", "direction")


@query(
    "kg_neighbourhood",
    E + """, un AS (SELECT source AS a, target AS b FROM rel WHERE strength = 'critical' UNION SELECT target, source FROM rel WHERE strength = 'critical'),
    n1 AS (SELECT 'NATION_3' AS n UNION SELECT b FROM un WHERE a = 'NATION_3'), n2 AS (SELECT n FROM n1 UNION SELECT b FROM un JOIN n1 ON a = n)
    SELECT source, target, relation_type, strength FROM rel WHERE strength = 'critical' AND (source IN (SELECT n FROM n2) OR target IN (SELECT n FROM n2))""",
)
def kg_neighbourhood(spark, sf):
    critical = rels(spark, sf).filter("strength = 'critical'")  # the feature: relations of one strength around a KPI
    start = load(spark, sf, "nation").filter("n_name = 'NATION_3'").select(F.col("n_name").alias("name"))
    return gq.neighbourhood(critical, start).select("source", "target", "relation_type", "strength")


@query(
    "kg_edge_score",
    E + f"""SELECT source, target, relation_type, {rnd('''(CASE strength WHEN 'critical' THEN 4 WHEN 'strong' THEN 3 WHEN 'moderate' THEN 2 ELSE 1 END + CASE WHEN source IN ('NATION_1', 'NATION_2') OR target IN ('NATION_1', 'NATION_2') THEN 2 ELSE 0 END
      + CASE WHEN contains(condition, 'NATION_1') THEN 3 ELSE 0 END) * CASE WHEN source = 'NATION_2' THEN 1.5 ELSE 1 END * CASE WHEN target = 'NATION_2' THEN 1.5 ELSE 1 END''', 3)} AS score FROM rel""",
)
def kg_edge_score(spark, sf):
    out = gq.edge_score(rels(spark, sf), ["NATION_1", "NATION_2"], ["NATION_1"], {"NATION_2": 1.5, "NATION_3": 0.5})
    return tidy(out.select("source", "target", "relation_type", "score"), "score", digits=3)


def chain_tables(spark, sf):
    conv = load(spark, sf, "conversations")
    steps = conv.filter("role = 'assistant'").select(
        F.col("conv_id").alias("chain_id"), F.col("turn").alias("step_no"), F.lower("text").alias("step")
    )
    chains = conv.filter("turn = 0").select(
        F.col("conv_id").alias("chain_id"),
        F.concat(F.lit("chain "), F.col("conv_id") % 40).alias("name"),
        F.col("role").alias("description"),
        F.lower("text").alias("trigger"),
        ((F.col("conv_id") + 1) % 2).cast("int").alias("population"),
        F.col("conv_id").alias("ord"),
    )
    return chains, steps


CH = """WITH st AS (SELECT conv_id AS chain_id, turn AS step_no, lower(text) AS step FROM conversations WHERE role = 'assistant'),
  ch AS (SELECT conv_id AS chain_id, 'chain ' || (conv_id % 40) AS name, role AS description, lower(text) AS trigger, (conv_id + 1) % 2 AS population FROM conversations WHERE turn = 0),
  cs AS (SELECT ch.*, n.n_steps FROM ch JOIN (SELECT chain_id, count(*) AS n_steps FROM st GROUP BY 1) n ON n.chain_id = ch.chain_id),
  cf AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY population, chain_id) AS r FROM cs) WHERE r = 1)
"""


@query("kg_causal_chains", CH + "SELECT name, chain_id, CAST(population AS INTEGER) AS population, n_steps FROM cf")
def kg_causal_chains(spark, sf):
    chains, steps = chain_tables(spark, sf)
    return gl.causal_chains(chains, steps).select("name", "chain_id", "population", "n_steps")


@query(
    "kg_chain_score",
    CH + """, h AS (SELECT chain_id, sum(CASE WHEN contains(step, 'the') THEN 1 ELSE 0 END + CASE WHEN contains(step, 'eau') THEN 1 ELSE 0 END + CASE WHEN contains(step, 'ion') THEN 1 ELSE 0 END) AS hits FROM st GROUP BY 1),
    s AS (SELECT cf.name, cf.chain_id, contains(trigger, 'que') OR contains(trigger, 'ing') AS active, CAST(5 * (CASE WHEN contains(trigger, 'que') THEN 1 ELSE 0 END + CASE WHEN contains(trigger, 'ing') THEN 1 ELSE 0 END) + coalesce(hits, 0) AS DOUBLE) AS score
      FROM cf LEFT JOIN h ON h.chain_id = cf.chain_id) SELECT * FROM s ORDER BY score DESC, chain_id LIMIT 12""",
)
def kg_chain_score(spark, sf):
    chains, steps = chain_tables(spark, sf)
    top = gq.chain_score(gl.causal_chains(chains, steps), steps, ["the", "eau", "ion"], ["que", "ing"], 12)
    return top.select("name", "chain_id", "active", "score")


@query("kg_chains_with", CH + "SELECT DISTINCT chain_id FROM st WHERE contains(step, 'tion')")
def kg_chains_with(spark, sf):
    return gq.chains_with(chain_tables(spark, sf)[1], "tion")


def part_nodes(spark, sf):
    size = F.col("p_size")
    units = F.array(*[F.lit(u) for u in ("Number of UE", "%", "success ratio", "kbps", "index", "dB", "integer", "probability")])
    return load(spark, sf, "part").select(
        F.col("p_partkey").alias("ord"),
        F.col("p_partkey").cast("string").alias("id"),
        F.concat_ws("_", F.replace("p_name", F.lit(" "), F.lit("_")), "p_size").alias("aligned_name"),
        F.when(F.col("p_type").isin("PROMO", "ECONOMY", "STANDARD"), "KPIDefinition").otherwise("Entity").alias("node_type"),
        F.when(size % 3 == 0, F.concat(F.lit("mean CQI of "), "p_brand")).otherwise(F.col("p_brand")).alias("description"),
        F.when(size % 2 == 0, F.concat(F.lit("a / "), "p_brand", F.lit(" × b"))).alias("formula"),
        F.element_at(units, size % 8 + 1).alias("unit"),
        F.array("p_brand", "p_type").alias("aliases"),
    )


PN = """WITH pn AS (SELECT p_partkey AS ord, replace(p_name, ' ', '_') || '_' || p_size AS aligned_name, CASE WHEN p_type IN ('PROMO', 'ECONOMY', 'STANDARD') THEN 'KPIDefinition' ELSE 'Entity' END AS node_type,
    CASE WHEN p_size % 3 = 0 THEN 'mean CQI of ' || p_brand ELSE p_brand END AS description, CASE WHEN p_size % 2 = 0 THEN 'a / ' || p_brand || ' × b' END AS formula,
    CASE p_size % 8 WHEN 0 THEN 'Number of UE' WHEN 1 THEN '%' WHEN 2 THEN 'success ratio' WHEN 3 THEN 'kbps' WHEN 4 THEN 'index' WHEN 5 THEN 'dB' WHEN 6 THEN 'integer' ELSE 'probability' END AS unit, p_brand, p_type, p_size FROM part),
  kd AS (SELECT *, unit IN ('Number of UE', 'integer') OR (unit = 'index' AND description LIKE '%CQI%') AS is_integer FROM (SELECT *, row_number() OVER (PARTITION BY aligned_name ORDER BY ord) AS r FROM pn WHERE node_type = 'KPIDefinition') WHERE r = 1),
  kr AS (SELECT *, CASE WHEN unit = '%' THEN 100.0 WHEN unit IN ('success ratio', 'probability') THEN 1.0 WHEN unit = 'kbps' OR is_integer THEN 'Infinity'::DOUBLE END AS hi FROM kd)
"""


@query("kg_kpi_defs", PN + "SELECT aligned_name AS short_name, description, coalesce(formula, '') AS formula, unit FROM kr")
def kg_kpi_defs(spark, sf):
    return gl.kpi_definitions(part_nodes(spark, sf)).select("short_name", "description", "formula", "unit")


@query(
    "kg_numeric_meta",
    PN + "SELECT unit, CASE WHEN hi IS NOT NULL THEN 0.0 END::DOUBLE AS lo, CASE WHEN hi = 'Infinity' THEN -1.0 ELSE hi END::DOUBLE AS hi, is_integer, count(*) AS n FROM kr GROUP BY ALL",
)
def kg_numeric_meta(spark, sf):
    hi = F.when(F.col("hi") == float("inf"), -1.0).otherwise(F.col("hi"))
    return gl.kpi_definitions(part_nodes(spark, sf)).groupBy("unit", "lo", hi.alias("hi"), "is_integer").agg(F.count("*").alias("n"))


@query(
    "kg_mechanism",
    E + """, p AS (SELECT DISTINCT a.n_name AS source, b.n_name AS target FROM nation a JOIN nation b ON (a.n_nationkey + 1) % 25 = b.n_nationkey)
    SELECT p.source, p.target, coupling, CASE WHEN strength = 'extracted' THEN 'moderate' ELSE strength END AS strength, coalesce(mechanism, reason) AS mechanism,
      'region ' || a.n_regionkey AS source_description, 'region ' || b.n_regionkey AS target_description, CASE coupling WHEN 'positive' THEN 'increase' WHEN 'negative' THEN 'decrease' END AS expected_direction
    FROM p LEFT JOIN rule r ON r.source = p.source AND r.target = p.target JOIN nation a ON a.n_name = p.source JOIN nation b ON b.n_name = p.target""",
)
def kg_mechanism(spark, sf):
    nation = load(spark, sf, "nation")
    a = nation.select(F.col("n_name").alias("source"), ((F.col("n_nationkey") + 1) % 25).alias("k"))
    pairs = a.join(nation.select(F.col("n_name").alias("target"), F.col("n_nationkey").alias("k")), "k").drop("k")
    defs = nation.select(
        F.col("n_name").alias("short_name"), F.concat(F.lit("region "), "n_regionkey").alias("description"), F.lit(None).cast("string").alias("unit")
    )
    rules = gl.directional_rules(nation_edges(spark, sf), known(spark, sf), 0.95)
    out = gq.mechanism(pairs, rules, defs)
    return out.drop("source_unit", "target_unit")


@query(
    "kg_lookup_tables",
    """SELECT 'index' AS what, CAST(p_size AS VARCHAR) AS key, p_name AS value, count(*) AS n FROM (SELECT * FROM part WHERE p_size = 7 OR p_name LIKE '%7' ORDER BY p_size, p_name LIMIT 1) GROUP BY 1, 2, 3
    UNION ALL SELECT 'formula', p_type, p_brand, count(*) FROM part WHERE upper(p_type) LIKE 'E%' GROUP BY 2, 3""",
)
def kg_lookup_tables(spark, sf):
    part = load(spark, sf, "part")
    one = gq.lookup_index(part.withColumnRenamed("p_name", "name"), "p_size", 7)
    envs = part.select(F.col("p_type").alias("env_name")).distinct()
    links = part.groupBy(F.col("p_type").alias("env_name"), F.col("p_brand").alias("value")).agg(F.count("*").alias("n"))
    formulas = gq.formulas_for(envs, links, "e").select(F.lit("formula").alias("what"), F.col("env_name").alias("key"), "value", "n")
    return one.select(
        F.lit("index").alias("what"), F.col("p_size").cast("string").alias("key"), F.col("name").alias("value"), F.lit(1).cast("long").alias("n")
    ).unionByName(formulas)


def merged_nodes(spark, sf):
    nodes = part_nodes(spark, sf).withColumnRenamed("aligned_name", "name")
    base = nodes.filter("node_type = 'KPIDefinition'").groupBy("name").agg(
        F.min("node_type").alias("node_type"), F.min("formula").alias("formula"), F.min("description").alias("description")
    )
    fresh = load(spark, sf, "part").withColumn("ord", F.col("p_partkey")).join(nodes.select("ord", "name", "node_type", "formula", "description"), "ord")
    extracted = fresh.filter("p_size >= 20").groupBy("name").agg(
        F.min("node_type").alias("node_type"),
        F.max("formula").alias("formula"),
        F.max("description").alias("description"),
        (F.max("p_retailprice") / 2000).alias("confidence"),
        F.max(F.lit(0.9)).alias("mean_quality"),
    )
    return gq.merge_nodes(base, extracted, min_confidence=0.5)


MERGE = PN + """, pp AS (SELECT pn.*, p_retailprice FROM pn JOIN part ON p_partkey = ord),
  b AS (SELECT aligned_name AS name, min(node_type) AS node_type, min(formula) AS formula, min(description) AS description FROM pp WHERE node_type = 'KPIDefinition' GROUP BY 1),
  x AS (SELECT aligned_name AS name, min(node_type) AS node_type, max(formula) AS formula, max(description) AS description, max(p_retailprice) / 2000 >= 0.5 AS ok FROM pp WHERE p_size >= 20 GROUP BY 1),
  mg AS (SELECT coalesce(b.name, x.name) AS name, coalesce(b.node_type, CASE WHEN ok THEN x.node_type END) AS node_type, coalesce(CASE WHEN ok THEN x.formula END, b.formula) AS formula,
    coalesce(CASE WHEN ok THEN x.description END, b.description) AS description, CASE WHEN ok IS NULL THEN 'untouched' WHEN NOT ok THEN 'skipped' WHEN b.name IS NOT NULL THEN 'enriched' ELSE 'added' END AS outcome
    FROM b FULL OUTER JOIN x ON b.name = x.name)
"""


@query("kg_merge", MERGE + "SELECT * FROM mg")
def kg_merge(spark, sf):
    return merged_nodes(spark, sf)


@query("kg_merge_counts", MERGE + "SELECT outcome, count(*) AS n FROM mg GROUP BY 1")
def kg_merge_counts(spark, sf):
    return gq.merge_counts(merged_nodes(spark, sf))


@query(
    "kg_upsert_typed",
    E + f""", al AS (SELECT source, target, upper(regexp_replace(raw_type, '[^A-Za-z0-9_]', '_', 'g')) AS label, triple_type, confidence, reason AS note, weight FROM ne),
    o AS (SELECT * FROM al WHERE confidence < 0.955), i AS (SELECT * FROM al WHERE weight > 1 AND confidence >= 0.95)
    SELECT coalesce(o.source, i.source) AS source, coalesce(o.target, i.target) AS target, coalesce(o.label, i.label) AS label, coalesce(i.triple_type, o.triple_type) AS triple_type,
      {rnd('coalesce(i.confidence, o.confidence)', 5)} AS confidence, CASE WHEN i.source IS NULL THEN 'kept' WHEN o.source IS NULL THEN 'created' ELSE 'updated' END AS outcome
    FROM o FULL OUTER JOIN i ON o.source = i.source AND o.target = i.target AND o.label = i.label""",
)
def kg_upsert_typed(spark, sf):
    all_edges = nation_edges(spark, sf).withColumn("label", gq.sanitize_label("relation_type")).withColumn("note", F.col("reason"))
    base = all_edges.filter("confidence < 0.955")
    incoming = all_edges.filter("weight > 1")
    out = gq.upsert_typed(base, incoming, 0.95).drop("note")
    return tidy(out, "confidence", digits=5)


def merge_sides(spark, sf):
    """Stored edges (every third source) and extracted ones, some of them weak or of ends that are not stored."""
    every = nation_edges(spark, sf).withColumn("raw_text", F.concat("reason", F.lit(" "), "relation_type"))
    ord_ = F.concat("ord.l_returnflag", "ord.l_linestatus")
    number = F.array_position(F.array(*[F.lit(x) for x in ("AF", "AO", "NF", "NO", "RF", "RO")]), ord_)
    base = every.filter("strength IN ('critical', 'strong', 'weak')").select("source", "target", "relation_type", "strength", "condition", "reason")
    spec = F.when(F.col("weight") % 2 == 0, F.col("spec_reference"))
    extracted = every.select("source", "target", F.when(F.col("weight") % 3 > 0, F.col("relation_type")).alias("relation_type"), "confidence", "quality_score", number.alias("ord"), spec.alias("source_spec"), F.col("condition").alias("source_clause"), "raw_text", "triple_type")
    return base, extracted


EDGE_MERGE = E + """, x AS (SELECT *, reason || ' ' || raw_type AS raw_text, CASE WHEN weight % 3 > 0 THEN raw_type END AS rel, CASE WHEN weight % 2 = 0 THEN spec_reference END AS spec, confidence >= 0.95 AND quality_score >= 0.92 AS ok FROM ne),
  b AS (SELECT source, target, raw_type, raw_strength, condition, reason, row_number() OVER (PARTITION BY source, target ORDER BY raw_type, raw_strength) AS place FROM ne WHERE raw_strength IN ('critical', 'strong', 'weak')),
  p AS (SELECT source, target, count(*) FILTER (ok) AS n, count(*) FILTER (NOT ok) AS skipped, first(rel ORDER BY ord) FILTER (ok) AS rel, first(raw_text ORDER BY ord) FILTER (ok) AS txt,
    arg_max(spec, ord) FILTER (ok AND spec IS NOT NULL) AS extracted_source_spec, arg_max(condition, ord) FILTER (ok) AS extracted_source_clause, arg_max(raw_text, ord) FILTER (ok) AS extracted_raw_text, arg_max(triple_type, ord) FILTER (ok) AS extracted_triple_type FROM x GROUP BY 1, 2),
  em AS (SELECT coalesce(b.source, p.source) AS source, coalesce(b.target, p.target) AS target, CASE WHEN b.source IS NULL AND n > 0 THEN coalesce(rel, 'RELATED_TO') ELSE raw_type END AS relation_type,
    CASE WHEN b.source IS NULL AND n > 0 THEN 'weak' ELSE raw_strength END AS strength, CASE WHEN b.source IS NULL AND n > 0 THEN '' ELSE condition END AS condition, CASE WHEN b.source IS NULL AND n > 0 THEN txt ELSE reason END AS reason,
    extracted_source_spec, extracted_source_clause, extracted_raw_text, extracted_triple_type,
    CASE WHEN coalesce(n, 0) > 0 AND b.source IS NOT NULL THEN 'enriched' WHEN coalesce(n, 0) > 0 THEN 'added' WHEN b.source IS NOT NULL THEN 'untouched' ELSE 'skipped' END AS outcome,
    CASE WHEN coalesce(place, 1) = 1 THEN coalesce(n, 0) ELSE 0 END AS n_extracted, CASE WHEN coalesce(place, 1) = 1 THEN coalesce(skipped, 0) ELSE 0 END AS n_skipped
    FROM b FULL OUTER JOIN p ON b.source = p.source AND b.target = p.target)
"""


@query("kg_merge_edges", EDGE_MERGE + "SELECT * FROM em")
def kg_merge_edges(spark, sf):
    return gq.merge_edges(*merge_sides(spark, sf), 0.95, 0.92)


@query(
    "kg_merge_edge_counts",
    EDGE_MERGE + """SELECT count(*) FILTER (outcome = 'added') AS edges_added, CAST(sum(n_extracted) - count(*) FILTER (outcome = 'added') AS BIGINT) AS edges_enriched, CAST(sum(n_skipped) AS BIGINT) AS edges_skipped FROM em""",
)
def kg_merge_edge_counts(spark, sf):
    merged = gq.merge_edges(*merge_sides(spark, sf), 0.95, 0.92)
    return merged.agg(*gq.merge_edge_counts(merged))


@query("kg_merge_endpoints", EDGE_MERGE + "SELECT DISTINCT n AS name FROM (SELECT source AS n, ok FROM x UNION ALL SELECT target, ok FROM x) WHERE ok AND n NOT IN (SELECT n_name FROM nation WHERE n_regionkey < 4)")
def kg_merge_endpoints(spark, sf):
    return gq.merge_endpoints(known(spark, sf), merge_sides(spark, sf)[1], 0.95, 0.92)


@query(
    "kg_upsert_nodes",
    """WITH b AS (SELECT DISTINCT p_brand AS name, 'KPIDEFINITION' AS label FROM part),
    i AS (SELECT p_partkey AS ord, p_brand AS name, CASE p_size % 3 WHEN 0 THEN 'KPIDefinition' WHEN 1 THEN 'KPI Set' END AS node_type, CASE WHEN p_size % 2 = 0 THEN p_type END AS formula, p_size FROM part),
    l AS (SELECT *, CASE node_type WHEN 'KPIDefinition' THEN 'KPIDEFINITION' WHEN 'KPI Set' THEN 'KPI_SET' ELSE 'ENTITY' END AS label FROM i),
    m AS (SELECT name, label, arg_max(formula, ord) FILTER (formula IS NOT NULL) AS formula, CAST(arg_max(p_size, ord) AS VARCHAR) AS size FROM l GROUP BY 1, 2)
    SELECT coalesce(b.name, m.name) AS name, coalesce(b.label, m.label) AS label, coalesce(m.formula, CASE WHEN b.name IS NOT NULL THEN 'stored' END) AS formula, m.size, CASE WHEN b.name IS NOT NULL THEN 'old' END AS note,
      CASE WHEN m.name IS NULL THEN 'kept' WHEN b.name IS NULL THEN 'created' ELSE 'updated' END AS outcome FROM b FULL OUTER JOIN m ON b.name = m.name AND b.label = m.label""",
)
def kg_upsert_nodes(spark, sf):
    parts = load(spark, sf, "part")
    stored = F.create_map(F.lit("formula"), F.lit("stored"), F.lit("note"), F.lit("old"))
    base = parts.select(F.col("p_brand").alias("name")).distinct().select("name", F.lit("KPIDEFINITION").alias("label"), stored.alias("props"))
    kind = F.when(F.col("p_size") % 3 == 0, "KPIDefinition").when(F.col("p_size") % 3 == 1, "KPI Set")
    props = F.create_map(F.lit("formula"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")), F.lit("size"), F.col("p_size").cast("string"))
    incoming = parts.select(F.col("p_brand").alias("name"), kind.alias("node_type"), props.alias("props"), F.col("p_partkey").alias("ord"))
    out = gq.upsert_nodes(base, incoming)
    return out.select("name", "label", *(F.try_element_at("props", F.lit(k)).alias(k) for k in ("formula", "size", "note")), "outcome")


@query(
    "kg_theta_sweep",
    E + f""", th AS (SELECT CAST(x AS DOUBLE) AS theta FROM (VALUES (0.88), (0.92), (0.95)) v(x)), mc AS (SELECT CAST(x AS DOUBLE) AS min_confidence FROM (VALUES (0.5), (0.95), (0.96)) v(x)),
    sz AS (SELECT theta, count(*) AS total_edges, count(*) AS relationship_edges, count(*) FILTER (upper(raw_type) IN ('INCREASES', 'DECREASES', 'DETERMINES', 'LIMITS', 'CAUSES')) AS canonical_edges,
      avg(quality_score) AS avg_quality FROM ne JOIN th ON quality_score >= theta GROUP BY 1),
    ru AS (SELECT theta, min_confidence, count(DISTINCT (source, target)) AS n FROM us0 JOIN th ON quality_score >= theta JOIN mc ON strength <> 'extracted' OR confidence >= min_confidence GROUP BY 1, 2)
    SELECT sz.theta, mc.min_confidence, total_edges, relationship_edges, canonical_edges, {rnd('avg_quality', 5)} AS avg_quality, coalesce(ru.n, 0) AS directional_rules,
      {rnd('canonical_edges / (SELECT canonical_edges FROM sz WHERE theta = 0.88)', 5)} AS retention FROM sz CROSS JOIN mc LEFT JOIN ru ON ru.theta = sz.theta AND ru.min_confidence = mc.min_confidence""",
)
def kg_theta_sweep(spark, sf):
    out = gl.theta_sweep(nation_edges(spark, sf), known(spark, sf), [0.88, 0.92, 0.95], [0.5, 0.95, 0.96])
    return tidy(out, "avg_quality", "retention", digits=5)


@query(
    "kg_search",
    PN + """, s AS (SELECT aligned_name AS short_name, (CASE WHEN contains(lower(aligned_name), 'brand#1') THEN 2 ELSE 0 END) + (CASE WHEN contains(lower(description), 'brand#1') THEN 1 ELSE 0 END)
      + (CASE WHEN contains(lower(p_brand), 'brand#1') OR contains(lower(p_type), 'brand#1') THEN 1 ELSE 0 END) AS score FROM pn WHERE node_type = 'KPIDefinition')
    SELECT short_name, score FROM s WHERE score > 0 ORDER BY score DESC, short_name LIMIT 10""",
)
def kg_search(spark, sf):
    defs = part_nodes(spark, sf).filter("node_type = 'KPIDefinition'").withColumnRenamed("aligned_name", "short_name")
    return gq.search(defs, "Brand#1").select("short_name", "score")


@query(
    "kg_formula_overlap",
    PN + """, f AS (SELECT ord, formula AS canonical, 'b × ' || p_type AS x FROM pn)
    SELECT ord, CASE WHEN canonical IS NULL THEN 0 ELSE 1 END AS shared_tokens, true AS consistent FROM f""",
)
def kg_formula_overlap(spark, sf):
    checked = part_nodes(spark, sf).select("ord", F.col("formula").alias("canonical"), F.concat(F.lit("b × "), F.element_at("aliases", 2)).alias("formula"))
    return gq.formula_overlap(checked).select("ord", "shared_tokens", "consistent")


RULES = (
    ("click", "purchase", "positive", "strong", 8.0, 10.0, None),
    ("error", "view", "negative", "critical", 5.0, 5.0, None),
    ("view", "signup", "positive", "moderate", 10.0, 10.0, "view_baseline > 40"),
    ("signup", "click", "negative", "weak", 15.0, 15.0, "signup_baseline < 45"),
)


@query(
    "kg_directional_check",
    FORECAST + f""", hb AS (SELECT station_id, kpi, t % 168 AS h, median(value) AS b FROM panel WHERE t < 504 GROUP BY 1, 2, 3),
    im AS (SELECT station_id, kpi, avg(value) AS m FROM panel WHERE t < 552 GROUP BY 1, 2),
    pc AS (SELECT f.station_id, f.kpi, f.h, 100 * (f.truth - b) / (abs(b) + 1e-8) AS pct FROM fc f JOIN hb ON hb.station_id = f.station_id AND hb.kpi = f.kpi AND hb.h = f.h),
    ru AS (SELECT * FROM (VALUES ('click', 'purchase', 'positive', 'strong', 8.0, 10.0, NULL, NULL, NULL), ('error', 'view', 'negative', 'critical', 5.0, 5.0, NULL, NULL, NULL),
      ('view', 'signup', 'positive', 'moderate', 10.0, 10.0, 'view', '>', 40.0), ('signup', 'click', 'negative', 'weak', 15.0, 15.0, 'signup', '<', 45.0)) r(source, target, coupling, strength, ps, pt, ck, op, lim)),
    hit AS (SELECT a.station_id, ru.source, ru.target, coupling, strength, a.h, a.pct AS sp, b.pct AS tp FROM pc a JOIN ru ON a.kpi = ru.source JOIN pc b ON b.station_id = a.station_id AND b.kpi = ru.target AND b.h = a.h
      LEFT JOIN im ON im.station_id = a.station_id AND im.kpi = ru.ck
      WHERE abs(a.pct) >= ps AND CASE WHEN coupling = 'positive' THEN (a.pct > 0 AND b.pct < -pt) OR (a.pct < 0 AND b.pct > pt) ELSE (a.pct > 0 AND b.pct > pt) OR (a.pct < 0 AND b.pct < -pt) END
      AND (op IS NULL OR (op = '>' AND im.m > lim) OR (op = '<' AND im.m < lim))),
    ag AS (SELECT station_id, source, target, coupling, strength, count(*) AS violating_hours, min(h) AS first_hour, max(h) AS last_hour, avg(sp) AS s, avg(tp) AS t FROM hit GROUP BY 1, 2, 3, 4, 5 HAVING count(*) >= 8)
    SELECT station_id, source, target, coupling, strength, violating_hours, first_hour, last_hour, {rnd_wide('s', 1)} AS mean_source_pct, {rnd_wide('t', 1)} AS mean_target_pct,
      CASE WHEN (s > 0) = (coupling = 'positive') THEN '↑' ELSE '↓' END AS expected_direction, CASE WHEN (s > 0) = (coupling = 'positive') THEN '↓' ELSE '↑' END AS actual_direction FROM ag""",
)
def kg_directional_check(spark, sf):
    rules = small_table(
        spark, list(RULES), "source string, target string, coupling string, strength string, min_pct_source double, min_pct_target double, condition string"
    )
    week = src.target(spark, sf).withColumnRenamed("truth", "pred")
    out = gq.directional_check(src.inputs(spark, sf), week, rules)
    return out.withColumns({c: settle_wide(c, 1) for c in ("mean_source_pct", "mean_target_pct")})
