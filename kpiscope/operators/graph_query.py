"""Lookups on the graph tables: neighbourhoods, scores, mechanisms, merges, rule checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from kpiscope.functions.exprs import SERIES
from kpiscope.operators.profiles import hour_of_week_baseline


def related(rels: DataFrame, kpi: str) -> DataFrame:
    """Edges that leave or enter a KPI."""
    out = rels.filter(F.col("source") == kpi).withColumn("direction", F.lit("affects"))
    return out.unionByName(rels.filter(F.col("target") == kpi).withColumn("direction", F.lit("affected_by")))


def chains_with(steps: DataFrame, word: str) -> DataFrame:
    """Chains that mention a KPI in any step."""
    return steps.filter(F.col("step").contains(word)).select("chain_id").distinct()


def neighbourhood(rels: DataFrame, targets: DataFrame) -> DataFrame:
    """Edges that touch anything within two undirected hops of the targets.

    Hops are semi joins on distinct node lists, so no path is ever materialised.
    """
    both = rels.select("source", "target").unionByName(
        rels.select(F.col("target").alias("source"), F.col("source").alias("target"))
    )
    near = targets.select(F.col("name").alias("node")).distinct()
    for _ in range(2):
        step = both.join(near, both["source"] == near["node"], "left_semi").select(F.col("target").alias("node"))
        near = near.unionByName(step).distinct()
    out_hit = rels.join(near.select(F.col("node").alias("source"), F.lit(True).alias("_a")), "source", "left")
    hit = out_hit.join(near.select(F.col("node").alias("target"), F.lit(True).alias("_b")), "target", "left")
    return hit.filter(F.col("_a").isNotNull() | F.col("_b").isNotNull()).select(*rels.columns)


def edge_score(rels: DataFrame, targets: list[str], active_conditions: list[str] = (), weights: dict[str, float] | None = None) -> DataFrame:
    """Relevance of an edge: strength, +2 on a target, +3 per active condition, times node weights."""
    s = F.col("strength")
    base = F.when(s == "critical", 4.0).when(s == "strong", 3.0).when(s == "moderate", 2.0).otherwise(1.0)
    hit = F.col("source").isin(targets) | F.col("target").isin(targets)
    score: Column = base + F.when(hit, 2.0).otherwise(0.0)
    for word in active_conditions:
        score = score + F.when(F.coalesce(F.col("condition"), F.lit("")).contains(word), 3.0).otherwise(0.0)
    if weights:
        pairs = [F.lit(x) for k, w in weights.items() if w > 1 for x in (k, float(w))]
        if pairs:
            table = F.create_map(*pairs)
            for end in ("source", "target"):
                score = score * F.coalesce(F.try_element_at(table, F.col(end)), F.lit(1.0))
    return rels.withColumn("score", score)


def chain_score(chains: DataFrame, steps: DataFrame, targets: list[str], active: list[str], top_n: int) -> DataFrame:
    """Relevance of a chain: +5 per active KPI in its trigger, +1 per step and target named there."""
    hits = sum((F.col("step").contains(t).cast("int") for t in targets), F.lit(0))
    per = steps.groupBy("chain_id").agg(F.sum(hits).alias("_hits"))
    trig = sum((F.coalesce(F.col("trigger"), F.lit("")).contains(a).cast("int") for a in active), F.lit(0))
    scored = chains.join(per, "chain_id", "left").withColumn("active", trig > 0).withColumn(
        "score", (5 * trig + F.coalesce("_hits", F.lit(0))).cast("double")
    )
    return scored.drop("_hits").orderBy(F.col("score").desc(), "chain_id").limit(top_n)


def mechanism(pairs: DataFrame, rules: DataFrame, defs: DataFrame) -> DataFrame:
    """Definitions and expected direction for (source, target) pairs."""
    d = defs.select("short_name", "description", "unit")
    src = d.select(F.col("short_name").alias("source"), F.col("description").alias("source_description"), F.col("unit").alias("source_unit"))
    tgt = d.select(F.col("short_name").alias("target"), F.col("description").alias("target_description"), F.col("unit").alias("target_unit"))
    expected = F.when(F.col("coupling") == "positive", "increase").when(F.col("coupling") == "negative", "decrease")
    return (
        pairs.join(rules.select("source", "target", "coupling", "strength", "mechanism"), ["source", "target"], "left")
        .join(src, "source", "left")
        .join(tgt, "target", "left")
        .withColumn("expected_direction", expected)
    )


def lookup_index(table: DataFrame, index_col: str, index: int | None = None) -> DataFrame:
    """All rows of an index table in order, or the one row of an index."""
    if index is None:
        return table.orderBy(index_col)
    return table.filter((F.col(index_col) == index) | F.col("name").endswith(str(index))).orderBy(index_col, "name").limit(1)


def formulas_for(env: DataFrame, links: DataFrame, prefix: str) -> DataFrame:
    """Environments whose name starts with a prefix, beside their formulas (one row each)."""
    chosen = env.filter(F.upper("env_name").startswith(prefix.upper()))
    return chosen.join(links, "env_name", "left")


def merge_nodes(base: DataFrame, extracted: DataFrame, min_confidence: float = 0.5, min_quality: float = 0.5) -> DataFrame:
    """Upsert extracted nodes over a base graph; weak ones are skipped. `outcome` tells what happened.

    base is (name, node_type, formula, description), extracted adds confidence and mean_quality.
    """
    ok = (F.coalesce("confidence", F.lit(0.0)) >= min_confidence) & (F.coalesce("mean_quality", F.lit(1.0)) >= min_quality)
    e = extracted.select(
        "name",
        F.col("node_type").alias("_type"),
        F.col("formula").alias("_formula"),
        F.col("description").alias("_description"),
        ok.alias("_ok"),
    )
    b = base.select("name", "node_type", "formula", "description", F.lit(True).alias("_base"))
    j = b.join(e, "name", "full_outer")
    outcome = (
        F.when(F.col("_ok").isNull(), "untouched")
        .when(~F.col("_ok"), "skipped")
        .when(F.col("_base").isNotNull(), "enriched")
        .otherwise("added")
    )
    use = F.coalesce("_ok", F.lit(False))
    return j.select(
        "name",
        F.coalesce("node_type", F.when(use, F.coalesce("_type", F.lit("Entity")))).alias("node_type"),
        F.coalesce(F.when(use, F.col("_formula")), "formula").alias("formula"),
        F.coalesce(F.when(use, F.col("_description")), "description").alias("description"),
        outcome.alias("outcome"),
    )


#: Fields of an extracted edge that a stored edge takes over, under the prefix extracted_.
EXTRACTED = ("source_spec", "source_clause", "raw_text", "triple_type")


def _accepted(edges: DataFrame, min_confidence: float, min_quality: float) -> Column:
    return (F.coalesce("confidence", F.lit(0.0)) >= min_confidence) & (F.coalesce("quality_score", F.lit(1.0)) >= min_quality)


def merge_edges(base: DataFrame, extracted: DataFrame, min_confidence: float = 0.5, min_quality: float = 0.5) -> DataFrame:
    """Extracted edges merged into a base graph by their pair of ends, in one full outer join.

    base is (source, target, relation_type, strength, condition, reason); all edges of a pair are enriched. extracted is (source, target,
    relation_type, confidence, quality_score, ord, and EXTRACTED), merged in the order of ord: weak ones are skipped, a pair
    that base lacks is added as a weak edge by its first one, and every field keeps its last value that is not null.
    n_extracted and n_skipped count the extracted edges of a pair on its first row; they and `outcome` feed merge_edge_counts.
    """
    ok = _accepted(extracted, min_confidence, min_quality)
    known = lambda c: F.when(ok & F.col(c).isNotNull(), F.col("ord"))
    first = F.when(ok, F.col("ord"))
    per = extracted.groupBy("source", "target").agg(
        F.count_if(ok).alias("_n"),
        F.count_if(~ok).alias("_skipped"),
        F.min_by(F.struct("relation_type", "raw_text"), first).alias("_first"),
        *(F.max_by(c, known(c)).alias(f"extracted_{c}") for c in EXTRACTED),
    )
    place = F.row_number().over(Window.partitionBy("source", "target").orderBy("relation_type", "strength"))
    stored = base.select("source", "target", "relation_type", "strength", "condition", "reason", place.alias("_place"))
    both = stored.join(per, ["source", "target"], "full_outer")
    taken, old = F.coalesce("_n", F.lit(0)) > 0, F.col("_place").isNotNull()
    outcome = F.when(taken & old, "enriched").when(taken, "added").when(old, "untouched").otherwise("skipped")
    lead = F.coalesce("_place", F.lit(1)) == 1
    count = lambda c: F.when(lead, F.coalesce(c, F.lit(0))).otherwise(0).cast("long")
    fresh = taken & ~old
    return both.select(
        "source",
        "target",
        F.when(fresh, F.coalesce(F.col("_first.relation_type"), F.lit("RELATED_TO"))).otherwise(F.col("relation_type")).alias("relation_type"),
        F.when(fresh, "weak").otherwise(F.col("strength")).alias("strength"),
        F.when(fresh, "").otherwise(F.col("condition")).alias("condition"),
        F.when(fresh, F.coalesce("_first.raw_text", F.lit(""))).otherwise(F.col("reason")).alias("reason"),
        *(f"extracted_{c}" for c in EXTRACTED),
        outcome.alias("outcome"),
        count("_n").alias("n_extracted"),
        count("_skipped").alias("n_skipped"),
    )


def merge_edge_counts(merged: DataFrame) -> list[Column]:
    """Counts of a merge of edges, as aggregates for `observe` or `agg`: further edges of an added pair enrich it."""
    fresh = F.col("outcome") == "added"
    return [
        F.coalesce(F.sum(fresh.cast("long")), F.lit(0)).alias("edges_added"),
        F.coalesce(F.sum(F.col("n_extracted") - fresh.cast("long")), F.lit(0)).alias("edges_enriched"),
        F.coalesce(F.sum("n_skipped"), F.lit(0)).alias("edges_skipped"),
    ]


def merge_endpoints(nodes: DataFrame, extracted: DataFrame, min_confidence: float = 0.5, min_quality: float = 0.5) -> DataFrame:
    """(name): ends of accepted edges that no node has yet; they are created as plain KPI nodes."""
    ends = extracted.filter(_accepted(extracted, min_confidence, min_quality)).select(F.explode(F.array("source", "target")).alias("name"))
    return ends.filter("name is not null").distinct().join(nodes.select("name"), "name", "left_anti")


def merge_counts(merged: DataFrame) -> DataFrame:
    return merged.groupBy("outcome").agg(F.count("*").alias("n"))


def counted(merged: DataFrame, counts: list[Column]) -> tuple[DataFrame, Observation]:
    """The merged table with an observation: the counts come with the action that writes it, without a second pass."""
    seen = Observation()
    return merged.observe(seen, *counts), seen


def sanitize_label(c: str | Column) -> Column:
    """Label made of word characters only."""
    text = F.col(c) if isinstance(c, str) else c
    return F.upper(F.regexp_replace(text, "[^A-Za-z0-9_]", "_"))


def upsert_typed(base: DataFrame, incoming: DataFrame, min_confidence: float) -> DataFrame:
    """Edges upserted by (source, target, label); the confidence gate holds for relationships only.

    Both sides are (source, target, label, triple_type, confidence, note). Incoming values replace
    stored ones where they are present.
    """
    is_rel = F.col("triple_type").isin("ontology_relationship", "relationship")
    conf = F.when(F.coalesce("confidence", F.lit(0.0)) == 0, 1.0).otherwise(F.col("confidence"))
    complete = (F.coalesce("source", F.lit("")) != "") & (F.coalesce("target", F.lit("")) != "")
    ok = incoming.filter(complete & (~is_rel | (conf >= min_confidence)))
    keys = ["source", "target", "label"]
    new = ok.select(*keys, F.col("triple_type").alias("_t"), F.col("confidence").alias("_c"), F.col("note").alias("_n"), F.lit(True).alias("_in"))
    old = base.select(*keys, "triple_type", "confidence", "note", F.lit(True).alias("_old"))
    return old.join(new, keys, "full_outer").select(
        *keys,
        F.coalesce("_t", "triple_type").alias("triple_type"),
        F.coalesce("_c", "confidence").alias("confidence"),
        F.coalesce("_n", "note").alias("note"),
        F.when(F.col("_in").isNull(), "kept").when(F.col("_old").isNull(), "created").otherwise("updated").alias("outcome"),
    )


def upsert_nodes(base: DataFrame, incoming: DataFrame) -> DataFrame:
    """Typed nodes upserted by (name, label): (name, label, props, outcome).

    base is (name, label, props), incoming (name, node_type, props, ord), props a map of strings. Values that are not null
    replace stored ones, later rows (ord) earlier ones; a node without a type is an Entity. Properties meet as rows of one union, so no
    node gathers more than its own keys.
    """
    label = sanitize_label(F.coalesce(F.nullif("node_type", F.lit("")), F.lit("Entity")))
    old = base.select("name", "label", "props", F.struct(F.lit(0).alias("fresh"), F.lit(0).cast("long").alias("ord")).alias("at"))
    new = incoming.filter("name is not null").select("name", label.alias("label"), "props", F.struct(F.lit(1).alias("fresh"), F.col("ord").cast("long").alias("ord")).alias("at"))
    rows = old.unionByName(new).repartition("name", "label")
    pairs = rows.select("name", "label", "at", F.explode_outer("props").alias("key", "value"))
    last = pairs.groupBy("name", "label", "key").agg(F.max_by("value", F.when(F.col("value").isNotNull(), F.col("at"))).alias("value"), F.min("at.fresh").alias("least"), F.max("at.fresh").alias("most"))
    held = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("value").isNotNull(), F.struct("key", "value")))))
    nodes = last.groupBy("name", "label").agg(held.alias("props"), F.min("least").alias("least"), F.max("most").alias("most"))
    outcome = F.when(F.col("most") == 0, "kept").when(F.col("least") == 1, "created").otherwise("updated")
    return nodes.select("name", "label", "props", outcome.alias("outcome"))


def search(defs: DataFrame, query: str, k: int = 10) -> DataFrame:
    """Definitions whose name, description or alias contains the query, best first."""
    q = query.lower()

    def hit(c: str, points: int) -> Column:
        return F.when(F.lower(F.coalesce(F.col(c), F.lit(""))).contains(q), points).otherwise(0)

    aliases = F.when(F.exists("aliases", lambda a: F.lower(a).contains(q)), 1).otherwise(0)
    scored = defs.withColumn("score", hit("short_name", 2) + hit("description", 1) + aliases)
    return scored.filter("score > 0").orderBy(F.col("score").desc(), "short_name").limit(k)


def formula_overlap(checked: DataFrame) -> DataFrame:
    """Do an extracted formula and the canonical one share a token? No canonical formula is no conflict."""

    def tokens(c: str) -> Column:
        return F.array_distinct(F.filter(F.split(F.translate(F.col(c), "/×", "  "), r"\s+"), lambda t: t != ""))

    shared = F.size(F.array_intersect(tokens("canonical"), tokens("formula")))
    no_canon = F.coalesce(F.col("canonical"), F.lit("")) == ""
    return checked.withColumn("shared_tokens", F.when(no_canon, 0).otherwise(shared)).withColumn(
        "consistent", no_canon | (shared > 0)
    )


def directional_check(inputs: DataFrame, forecast: DataFrame, rules: DataFrame, min_hours: int = 8) -> DataFrame:
    """Hours in which a forecast moves against a rule of the graph.

    Percent changes against the hour-of-week baseline are computed once per (station, kpi, hour);
    a rule meets its two KPIs by equality joins on station and hour. rules is a KPI-level table.
    Conditions read "<kpi>_baseline <op> <number>" and test the input mean.
    """
    base = hour_of_week_baseline(inputs)
    pct = (
        forecast.select(*SERIES, "h", "pred")
        .join(base, [*SERIES, "h"])
        .withColumn("pct", 100 * (F.col("pred") - F.col("baseline")) / (F.abs("baseline") + 1e-8))
        .select(*SERIES, "h", "pct")
    )
    r = rules.select("source", "target", "coupling", "strength", "min_pct_source", "min_pct_target", "condition")
    src = pct.select("station_id", F.col("kpi").alias("source"), "h", F.col("pct").alias("src_pct")).join(r, "source")
    tgt = pct.select("station_id", F.col("kpi").alias("target"), "h", F.col("pct").alias("tgt_pct"))
    s, t = F.col("src_pct"), F.col("tgt_pct")
    down, up = t < -F.col("min_pct_target"), t > F.col("min_pct_target")
    positive = F.col("coupling") == "positive"
    wrong = F.when(positive, ((s > 0) & down) | ((s < 0) & up)).otherwise(((s > 0) & up) | ((s < 0) & down))
    hits = src.filter(F.abs(s) >= F.col("min_pct_source")).join(tgt, ["station_id", "target", "h"]).filter(wrong)

    cond = F.split("condition", r"\s+")
    means = inputs.groupBy(*SERIES).agg(F.avg("value").alias("_mean"))
    means = means.select(F.col("station_id"), F.col("kpi").alias("_cond_kpi"), "_mean")
    hits = hits.withColumn("_cond_kpi", F.replace(F.try_element_at(cond, F.lit(1)), F.lit("_baseline"), F.lit("")))
    hits = hits.join(means, ["station_id", "_cond_kpi"], "left")
    op, limit = F.try_element_at(cond, F.lit(2)), F.try_element_at(cond, F.lit(3)).try_cast("double")
    mean = F.coalesce("_mean", F.lit(0.0))
    blocked = ((op == ">") & (mean <= limit)) | ((op == "<") & (mean >= limit))
    hits = hits.filter(~F.coalesce(blocked, F.lit(False)))

    out = hits.groupBy("station_id", "source", "target", "coupling", "strength").agg(
        F.count("*").alias("violating_hours"),
        F.min("h").alias("first_hour"),
        F.max("h").alias("last_hour"),
        F.avg("src_pct").alias("mean_source_pct"),
        F.avg("tgt_pct").alias("mean_target_pct"),
    ).filter(F.col("violating_hours") >= min_hours)
    rising = F.col("mean_source_pct") > 0
    expected = F.when(rising == (F.col("coupling") == "positive"), "↑").otherwise("↓")
    return out.withColumn("expected_direction", expected).withColumn(
        "actual_direction", F.when(expected == "↑", "↓").otherwise("↑")
    )


