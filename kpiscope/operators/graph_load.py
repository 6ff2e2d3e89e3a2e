"""Loading a property graph as an ontology: relationships, rules, chains, definitions.

Edges are (source, target, relation_type, triple_type, strength, confidence, condition, reason,
spec_reference, mechanism, min_pct_source, min_pct_target, ord).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kpiscope.functions.exprs import col, first_per, has_any, range_position

# Canonical relation types, spellings mapped onto them, and their coupling sign.
RELATION_TYPES = ("INCREASES", "DECREASES", "DETERMINES", "LIMITS", "CAUSES")
RELATION_ALIASES = {
    "INVERSELY_AFFECTS": "DECREASES",
    "POSITIVELY_AFFECTS": "INCREASES",
    "SEVERELY_DECREASES": "DECREASES",
    "DIRECTLY_PROPORTIONAL": "INCREASES",
    "ENABLES": "INCREASES",
}
POSITIVE_TYPES = ("INCREASES", "DETERMINES", "CAUSES")
RELATION_TRIPLES = ("ontology_relationship", "relationship")

# Strength -> (rank score, default source threshold, default target threshold).
STRENGTHS = {
    "critical": (1.0, 5.0, 5.0),
    "strong": (0.9, 8.0, 10.0),
    "moderate": (0.7, 10.0, 10.0),
    "weak": (0.5, 15.0, 15.0),
    "extracted": (0.0, 12.0, 12.0),
}

# Unit words by the kind of number they announce.
INTEGER_UNITS = ("count", "number", "ue", "integer", "attempts", "events")
PERCENT_UNITS = ("%", "percent", "percentage")
PROBABILITY_UNITS = ("ratio", "probability", "fraction")
RATE_UNITS = ("kbit/s", "kbps", "bit/s", "bps", "mbit/s", "mbps")


def _lookup(table: dict, key: Column) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key)


def canonical_relation(relation: str | Column) -> Column:
    """Upper-cased relation type with known aliases resolved."""
    r = F.upper(F.coalesce(col(relation), F.lit("")))
    return F.coalesce(_lookup(RELATION_ALIASES, r), r)


def known_strength(strength: str | Column) -> Column:
    s = F.coalesce(col(strength), F.lit("moderate"))
    return F.when(s.isin(*STRENGTHS), s).otherwise("moderate")


def _between_known(edges: DataFrame, known: DataFrame) -> DataFrame:
    names = known.select("name").distinct()
    return (
        edges.filter(F.col("triple_type").isin(*RELATION_TRIPLES))
        .join(names.select(F.col("name").alias("source")), "source", "left_semi")
        .join(names.select(F.col("name").alias("target")), "target", "left_semi")
    )


def _usable(edges: DataFrame, known: DataFrame, min_confidence: float) -> DataFrame:
    e = (
        _between_known(edges, known)
        .withColumn("relation_type", canonical_relation("relation_type"))
        .withColumn("strength", known_strength("strength"))
        .withColumn("confidence", F.coalesce("confidence", F.lit(1.0)))
    )
    firm = (F.col("strength") != "extracted") | (F.col("confidence") >= min_confidence)
    return e.filter(F.col("relation_type").isin(*RELATION_TYPES) & firm)


def relationships(edges: DataFrame, known: DataFrame, min_confidence: float = 0.7) -> DataFrame:
    """Typed relationships between known KPIs, first edge per (source, target, type)."""
    e = _usable(edges, known, min_confidence)
    blank = F.lit("")
    e = e.withColumn("condition", F.nullif(F.col("condition"), blank)).withColumn(
        "spec_reference", F.nullif(F.col("spec_reference"), blank)
    )
    return first_per(e, ["source", "target", "relation_type"], "ord").select(
        "source", "target", "relation_type", "strength", "confidence", "condition", "reason", "spec_reference"
    )


def directional_rules(edges: DataFrame, known: DataFrame, min_confidence: float = 0.7) -> DataFrame:
    """Expected co-movement per KPI pair with its thresholds, first edge per (source, target)."""
    e = first_per(_usable(edges, known, min_confidence), ["source", "target"], "ord")
    coupling = F.when(F.col("relation_type").isin(*POSITIVE_TYPES), "positive").otherwise("negative")
    ref = F.coalesce("spec_reference", F.lit(""))
    clause = F.trim(F.regexp_extract(ref, "^[^§]*§(.*)$", 1))
    spec = F.trim(F.split_part(ref, F.lit("§"), F.lit(1)))
    hint = F.format_string(
        "Adjust %s in the %s direction as %s.",
        "target",
        F.when(coupling == "positive", "same").otherwise("opposite"),
        "source",
    )
    s = F.col("strength")
    return e.select(
        "source",
        "target",
        coupling.alias("coupling"),
        F.when(s == "extracted", "moderate").otherwise(s).alias("strength"),
        F.coalesce("min_pct_source", _lookup({k: v[1] for k, v in STRENGTHS.items()}, s)).alias("min_pct_source"),
        F.coalesce("min_pct_target", _lookup({k: v[2] for k, v in STRENGTHS.items()}, s)).alias("min_pct_target"),
        F.coalesce(F.nullif(F.col("mechanism"), F.lit("")), "reason", F.lit("")).alias("mechanism"),
        F.coalesce(F.nullif(spec, F.lit("")), F.lit("TS 28.554")).alias("spec_reference"),
        clause.alias("spec_clause"),
        hint.alias("correction_hint"),
        F.nullif(F.col("condition"), F.lit("")).alias("condition"),
    )


def causal_chains(chains: DataFrame, steps: DataFrame) -> DataFrame:
    """Named chains with at least one step; node chains (population 0) come before top-level ones.

    chains is (chain_id, name, description, trigger, population, ord), steps (chain_id, step_no, step).
    """
    filled = steps.groupBy("chain_id").agg(F.count("*").alias("n_steps"))
    usable = chains.filter(F.coalesce("name", F.lit("")) != "").join(filled, "chain_id")
    return first_per(
        usable.withColumn("trigger", F.nullif(F.col("trigger"), F.lit(""))).withColumn("_o", F.struct("population", "ord")),
        ["name"],
        "_o",
    ).drop("_o")


def numeric_meta(unit: str | Column, description: str | Column) -> dict[str, Column]:
    """Valid range and integer flag told by unit words (columns lo, hi, is_integer)."""
    u = F.lower(F.trim(F.coalesce(col(unit), F.lit(""))))
    d = F.lower(F.coalesce(col(description), F.lit("")))
    is_integer = has_any(u, INTEGER_UNITS) | ((u == "index") & d.contains("cqi"))
    inf = F.lit(float("inf"))
    hi = (
        F.when(has_any(u, PERCENT_UNITS), 100.0)
        .when(has_any(u, PROBABILITY_UNITS), 1.0)
        .when(u.isin(*RATE_UNITS) | is_integer, inf)
    )
    return {"lo": F.when(hi.isNotNull(), 0.0), "hi": hi, "is_integer": is_integer}


def kpi_definitions(nodes: DataFrame) -> DataFrame:
    """KPI definition nodes, first per short name, with range and integer flag."""
    short = F.coalesce(F.nullif(F.col("aligned_name"), F.lit("")), F.nullif(F.col("id"), F.lit("")))
    named = nodes.filter("node_type = 'KPIDefinition'").withColumn("short_name", short).filter("short_name IS NOT NULL")
    first = first_per(named, ["short_name"], "ord")
    meta = numeric_meta("unit", "description")
    return first.select(
        "short_name",
        F.coalesce("description", F.lit("")).alias("description"),
        F.coalesce("formula", F.lit("")).alias("formula"),
        F.coalesce("unit", F.lit("")).alias("unit"),
        *[c.alias(n) for n, c in meta.items()],
    )


def relation_scores(rels: DataFrame, edges: DataFrame) -> DataFrame:
    """Support of a relationship: its strength, or for extracted ones the best confidence on record."""
    conf = (
        edges.filter(F.col("triple_type").isin(*RELATION_TRIPLES))
        .groupBy("source", "target", canonical_relation("relation_type").alias("relation_type"))
        .agg(F.max(F.coalesce("confidence", F.lit(1.0))).alias("_best"))
    )
    score = F.when(F.col("strength") == "extracted", F.coalesce("_best", F.lit(0.0))).otherwise(strength_score("strength"))
    return rels.join(conf, ["source", "target", "relation_type"], "left").withColumn("score", score).drop("_best")


def scored_relationships(edges: DataFrame, known: DataFrame, min_confidence: float = 0.7) -> DataFrame:
    """relationships with the score of relation_scores, from one pass over the edges.

    The first usable edge and the best confidence of a (source, target, type) are partial aggregates; the known names are
    looked up for the groups, not for the edges.
    """
    conf, strength = F.coalesce("confidence", F.lit(1.0)), known_strength("strength")
    blank = F.lit("")
    kept = F.struct(
        strength.alias("strength"),
        conf.alias("confidence"),
        F.nullif(F.col("condition"), blank).alias("condition"),
        "reason",
        F.nullif(F.col("spec_reference"), blank).alias("spec_reference"),
    )
    firm = (strength != "extracted") | (conf >= min_confidence)
    groups = (
        edges.filter(F.col("triple_type").isin(*RELATION_TRIPLES))
        .withColumn("relation_type", canonical_relation("relation_type"))
        .filter(F.col("relation_type").isin(*RELATION_TYPES))
        .groupBy("source", "target", "relation_type")
        .agg(F.min_by(kept, F.when(firm, F.col("ord"))).alias("_first"), F.max(conf).alias("_best"))
        .filter("_first IS NOT NULL")
    )
    names = known.select("name").distinct()
    groups = groups.join(names.select(F.col("name").alias("source")), "source", "left_semi").join(
        names.select(F.col("name").alias("target")), "target", "left_semi"
    )
    rels = groups.select("source", "target", "relation_type", "_first.*", "_best")
    return rels.withColumn("score", F.when(F.col("strength") == "extracted", F.col("_best")).otherwise(strength_score("strength"))).drop("_best")


def strength_score(strength: str | Column) -> Column:
    """Rank of a strength; an unknown one has none."""
    return F.coalesce(_lookup({k: v[0] for k, v in STRENGTHS.items()}, col(strength)), F.lit(0.0))


def drop_weakest(scored: DataFrame, fraction: float, stored: tuple[str, ...] = ("source", "target", "relation_type")) -> DataFrame:
    """Remove the weakest round(fraction * n) rows by score; the stored order, which has no ties, decides between equal scores.

    Serves relationships and, with stored = (source, target), directional rules.
    """
    ranked = range_position(scored, ["score", *stored])
    return ranked.filter(F.col("position") > F.bround(F.lit(fraction) * F.col("total"), 0)).drop("position", "total")


def theta_sweep(edges: DataFrame, known: DataFrame, thetas: list[float], min_confs: list[float]) -> DataFrame:
    """Graph size and rule count over a grid of quality thresholds and confidence floors.

    Every edge lists the thresholds it passes, so one aggregation serves the whole grid.
    """
    passed = F.filter(F.array(*[F.lit(t) for t in thetas]), lambda t: F.col("quality_score") >= t)
    e = edges.withColumn("theta", F.explode(passed))
    rel = F.col("triple_type").isin(*RELATION_TRIPLES)
    size = e.groupBy("theta").agg(
        F.count("*").alias("total_edges"),
        F.count_if(rel).alias("relationship_edges"),
        F.count_if(rel & F.upper("relation_type").isin(*RELATION_TYPES)).alias("canonical_edges"),
        F.coalesce(F.avg(F.when(rel, F.col("quality_score"))), F.lit(0.0)).alias("avg_quality"),
    )
    # the first edge of a pair inside a threshold decides the rule, a stricter floor may pick a later one
    usable = _usable(e, known, 0.0)
    floors = F.filter(
        F.array(*[F.lit(c) for c in min_confs]),
        lambda c: (F.col("strength") != "extracted") | (F.col("confidence") >= c),
    )
    rules = (
        usable.withColumn("min_confidence", F.explode(floors))
        .groupBy("theta", "min_confidence")
        .agg(F.count_distinct("source", "target").alias("directional_rules"))
    )
    grid = size.withColumn("min_confidence", F.explode(F.array(*[F.lit(c) for c in min_confs])))
    out = grid.join(rules, ["theta", "min_confidence"], "left").withColumn(
        "directional_rules", F.coalesce("directional_rules", F.lit(0)).cast("long")
    )
    first = size.filter(F.col("theta") == min(thetas)).select(F.col("canonical_edges").alias("_first")).scalar()
    return out.withColumn("retention", F.col("canonical_edges") / first)

