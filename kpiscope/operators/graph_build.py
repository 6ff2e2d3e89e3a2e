"""From extracted triples to the tables of a property graph.

A triple is (ord, subject, predicate, object, triple_type, source_spec, source_clause, raw_text,
relation_prob, min_pct_source, min_pct_target, mechanism, fine_clause). `ord` is any orderable
column that holds the extraction order; every first-wins and last-wins rule refers to it.
Alignment adds original_name, aligned_name, entity_type, is_new, mapped_to, align_conf; evaluation
adds confidence, clarity, relevance, integrate_score.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Attribute predicates of KPI definitions and the node column each one sets.
ATTRIBUTES = {
    "formula": ("calculated_by", "has_formula"),
    "physical_formula": ("has_physical_formula",),
    "description": ("defined_as", "has_description"),
    "unit": ("has_unit",),
    "category": ("has_category",),
    "kpi_object": ("has_kpi_object",),
    "kpi_type": ("has_kpi_type",),
    "min_value": ("has_min_value",),
    "max_value": ("has_max_value",),
}
NUMERIC_ATTRIBUTES = ("min_value", "max_value")
COUNTER_PREDICATES = ("has_measurements", "uses_counter")

EDGE_FIELDS = (
    "relation_type", "triple_type", "strength", "source_spec", "source_clause", "quality_score",
    "confidence", "raw_text", "min_pct_source", "min_pct_target", "mechanism", "fine_clause",
)


def clipped(v: Column, high: float) -> Column:
    """v between 0 and high; NULL and NaN stay."""
    return F.when(v.isNull() | F.isnan(v), v).when(v < 0, F.lit(0.0)).when(v > high, F.lit(high)).otherwise(v)


def unit_interval(c: str | Column, default: float | None = None) -> Column:
    v = (F.col(c) if isinstance(c, str) else c).try_cast("double")
    if default is not None:
        v = F.coalesce(v, F.lit(default))
    return clipped(v, 1.0)


def _percent(c: str) -> Column:
    v = F.col(c).try_cast("double")
    return clipped(v, 100.0)


def normalize_triples(raw: DataFrame) -> DataFrame:
    """Clip probabilities and percentages to their ranges and fill the defaults."""
    return (
        raw.withColumn("relation_prob", unit_interval("relation_prob", 1.0))
        .withColumn("min_pct_source", _percent("min_pct_source"))
        .withColumn("min_pct_target", _percent("min_pct_target"))
        .withColumn("triple_type", F.coalesce("triple_type", F.lit("relationship")))
        .na.fill("", ["subject", "predicate", "object"])
    )


def align(triples: DataFrame, alignments: DataFrame) -> DataFrame:
    """Attach alignments by subject; unmatched subjects become new low-confidence entities."""
    a = alignments.select(
        F.col("original_name").alias("subject"), "aligned_name", "entity_type", "is_new", "mapped_to", "align_conf"
    )
    missing = F.col("aligned_name").isNull()
    return (
        triples.join(a, "subject", "left")
        .withColumn("original_name", F.col("subject"))
        .withColumn("entity_type", F.when(missing, "NEW_TYPE").otherwise(F.col("entity_type")))
        .withColumn("is_new", F.when(missing, F.lit(True)).otherwise(F.col("is_new")))
        .withColumn("align_conf", F.when(missing, F.lit(0.3)).otherwise(F.col("align_conf")))
        .withColumn("aligned_name", F.coalesce("aligned_name", F.replace(F.col("subject"), F.lit(" "), F.lit("_"))))
    )


def pin_core_kpis(aligned: DataFrame, core: list[str]) -> DataFrame:
    """Rows that name a core KPI in any of three columns become definitions of that KPI."""
    names = F.array_intersect(
        F.array_compact(F.array("aligned_name", "mapped_to", "original_name")), F.array(*[F.lit(k) for k in core])
    )
    kpi = F.try_element_at(names, F.lit(1))
    return (
        aligned.withColumn("_kpi", kpi)
        .withColumn("entity_type", F.when(F.col("_kpi").isNotNull(), "KPIDefinition").otherwise(F.col("entity_type")))
        .withColumn("is_new", F.when(F.col("_kpi").isNotNull(), F.lit(False)).otherwise(F.col("is_new")))
        .withColumn(
            "align_conf",
            F.when(F.col("_kpi").isNotNull(), F.greatest("align_conf", F.lit(0.95))).otherwise(F.col("align_conf")),
        )
        .withColumn("aligned_name", F.coalesce("_kpi", "aligned_name"))
        .withColumn("mapped_to", F.coalesce("_kpi", "mapped_to"))
        .drop("_kpi")
    )


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def _held(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are worked out once: a generator keeps the optimizer from repeating them where they are used."""
    for name, value in columns.items():
        df = df.select(*(c for c in df.columns if c != name), F.explode(F.array(value)).alias(name))
    return df


def _units(df: DataFrame) -> DataFrame:
    """Column vec as u, of length 1 or of zeros."""
    raw = _held(df.withColumn("vec", F.col("vec").cast("array<double>")), length=F.sqrt(_dot(F.col("vec"), F.col("vec"))))
    size = F.when(F.col("length") < 1e-12, 1.0).otherwise(F.col("length"))
    return _held(raw, u=F.transform("vec", lambda x: x / size)).drop("vec", "length")


def _away(u: Column, w: Column) -> Column:
    return F.sqrt(F.greatest(F.lit(0.0), _dot(u, u) + _dot(w, w) - 2 * _dot(u, w)))


def embed_visits(entities: DataFrame, ontology: DataFrame, block_size: int = 512, n_pivots: int = 16) -> tuple[DataFrame, DataFrame]:
    """Blocks of ontology vectors, (block, refs), and the blocks each entity has to look into: (entity_id, u, blocks, n_blocks).

    A few ontology vectors are pivots. Each vector belongs to its nearest pivot, and the vectors of a pivot are dealt to blocks of about
    block_size. A block keeps, for each pivot, the least and greatest distance of its vectors. By the triangle inequality no vector of a
    block can be nearer to an entity than the entity's own distances to the pivots allow; a block whose best possible product is below that
    of the nearest pivot, itself a candidate, is left out. All of this is one plan, whatever the size of the ontology.
    """
    onto = _units(ontology.select("name", "vec"))
    picked = onto.select("u", F.struct(F.xxhash64("name"), "name").alias("h")).orderBy("h").limit(n_pivots)
    pivots = picked.agg(F.transform(F.array_sort(F.collect_list(F.struct("h", "u"))), lambda p: p["u"]).alias("p")).scalar()
    placed = _held(_held(onto, p=pivots), d=F.transform("p", lambda p: _away(F.col("u"), p))).drop("p")
    placed = placed.withColumn("pivot", (F.array_position("d", F.array_min("d")) - 1).cast("int"))
    pieces = placed.groupBy("pivot").agg(F.ceil(F.count("*") / block_size).alias("pieces"))
    dealt = placed.join(pieces, "pivot").withColumn("block", F.struct("pivot", F.pmod(F.xxhash64("name"), F.col("pieces")).alias("piece")))
    reach = [side(F.get("d", F.lit(q))) for q in range(n_pivots) for side in (F.min, F.max)]
    blocks = dealt.groupBy("block").agg(
        F.collect_list(F.struct("name", "u")).alias("refs"), F.array(*reach).alias("reach"), F.max(_dot(F.col("u"), F.col("u"))).alias("longest")
    )
    bounds = blocks.agg(F.collect_list(F.struct("block", "reach", "longest")).alias("b")).scalar()
    ents = _held(_units(entities.select("entity_id", "vec")), p=pivots)
    known = F.array_max(F.transform("p", lambda p: _dot(F.col("u"), p)))
    ents = _held(ents, d=F.transform("p", lambda p: _away(F.col("u"), p)), known=known, own=_dot(F.col("u"), F.col("u"))).withColumn("b", bounds)

    def hopeful(block: Column) -> Column:
        gaps = F.transform("d", lambda d, q: F.greatest(F.get(block["reach"], 2 * q) - d, d - F.get(block["reach"], 2 * q + 1)))
        near = F.greatest(F.lit(0.0), F.array_max(gaps))
        return (F.col("own") + block["longest"] - near * near) / 2 >= F.col("known") - 1e-9

    return blocks.select("block", "refs"), ents.select("entity_id", "u", F.transform(F.filter("b", hopeful), lambda b: b["block"]).alias("blocks"), F.size("b").alias("n_blocks"))


def embed_align(entities: DataFrame, ontology: DataFrame, block_size: int = 512, n_pivots: int = 16) -> DataFrame:
    """Nearest ontology vector by cosine: (entity_id, aligned_name, distance). Exact; ties go to the first name.

    entities is (entity_id, vec), ontology (name, vec). An entity meets the blocks it has to look into (see embed_visits) by an equality
    join and keeps one best hit of each. No entity-vector pair is ever a row.
    """
    blocks, ents = embed_visits(entities, ontology, block_size, n_pivots)
    met = ents.select("entity_id", "u", F.explode("blocks").alias("block")).join(blocks, "block")
    # smallest negative product first, so the smallest struct is the nearest name
    scored = F.transform("refs", lambda r: F.struct((-_dot(F.col("u"), r["u"])).alias("neg"), r["name"].alias("name")))
    best = met.select("entity_id", F.array_min(scored).alias("b")).groupBy("entity_id").agg(F.min("b").alias("b"))
    return best.select("entity_id", F.col("b.name").alias("aligned_name"), (1 + F.col("b.neg")).alias("distance"))


def conflict_groups(aligned: DataFrame, cap: int = 10) -> DataFrame:
    """Rows of the same (aligned_name, predicate) that may contradict each other, as a short array.

    Groups above the cap keep their most probable rows, then the longest clause; small groups keep
    extraction order. One row more than the cap tells the two apart, so the group size needs no
    second pass. The rank filter also runs before the shuffle: a hot group never travels whole.
    """
    by_prob = Window.partitionBy("aligned_name", "predicate").orderBy(
        F.col("relation_prob").desc(), F.length(F.coalesce("source_clause", F.lit(""))).desc(), "ord"
    )
    fields = ("ord", "object", "relation_prob", "source_clause")
    kept = (
        aligned.select("aligned_name", "predicate", *fields)
        .withColumn("_r", F.row_number().over(by_prob))
        .filter(F.col("_r") <= cap + 1)
    )
    ranked = kept.groupBy("aligned_name", "predicate").agg(
        F.array_sort(F.collect_list(F.struct("_r", *fields))).alias("_g")
    )  # at most cap + 1 entries

    def plain(rows: Column) -> Column:
        return F.transform(rows, lambda r: F.struct(*[r[f].alias(f) for f in fields]))

    rows = F.when(F.size("_g") > cap, plain(F.slice("_g", 1, cap))).otherwise(F.array_sort(plain(F.col("_g"))))
    return ranked.filter(F.size("_g") > 1).select("aligned_name", "predicate", rows.alias("rows"))


def leading_conflicts(aligned: DataFrame) -> DataFrame:
    """Every distinct object of a (name, predicate) group once against the group's leading row, in the columns of conflict_pairs.

    The leading row is the most probable one (longest clause, then first on ties), likewise for each object. Both are found by aggregates
    that combine on the map side, and a group gives fewer pairs than rows, so any size is seen whole.
    """
    keys = ["aligned_name", "predicate"]
    row = F.struct("ord", "object", "relation_prob", "source_clause")
    first = F.struct(-F.col("relation_prob"), -F.length(F.coalesce("source_clause", F.lit(""))), "ord")
    marked = aligned.filter("object is not null").withColumn("_o", F.trim("object"))
    each = marked.groupBy(*keys, "_o").agg(F.min_by(row, first).alias("b"), F.min(first).alias("_first"))
    lead = each.groupBy(*keys).agg(F.min_by(F.struct("_o", "b"), "_first").alias("_lead"), F.count("*").alias("_n")).filter("_n > 1")
    pairs = each.join(lead, keys).filter(F.col("_o") != F.col("_lead._o"))
    order = F.row_number().over(Window.partitionBy(*keys).orderBy("_first"))
    return pairs.select(*keys, F.lit(1).alias("i"), (order + 1).cast("int").alias("j"), F.col("_lead.b").alias("a"), "b")


def conflict_pairs(aligned: DataFrame, cap: int | None = 10) -> DataFrame:
    """Pairs of the same subject and predicate with different objects, read off the short arrays; cap None takes leading_conflicts."""
    if cap is None:
        return leading_conflicts(aligned)
    later = lambda a, i: F.transform(
        F.slice("rows", i + 2, F.size("rows")),
        lambda b, j: F.struct((i + 1).alias("i"), (i + j + 2).alias("j"), a.alias("a"), b.alias("b")),
    )
    pairs = conflict_groups(aligned, cap).select(
        "aligned_name", "predicate", F.inline(F.flatten(F.transform("rows", later)))
    )
    return pairs.filter(F.trim("a.object") != F.trim("b.object"))


def conflict_resolve(aligned: DataFrame, verdicts: DataFrame, cap: int = 10) -> DataFrame:
    """Drop the loser of every contradicting pair.

    verdicts is (ord_a, ord_b, verdict). Pairs are replayed in order; a row that already lost takes
    no part in later pairs. The replay folds over at most cap * (cap - 1) / 2 pairs of a group.
    The less probable row loses, then the one with the shallower clause, then the second.
    """
    pairs = conflict_pairs(aligned, cap)
    told = pairs.join(
        verdicts.filter("verdict = 'contradict'").select(
            F.col("ord_a").alias("_oa"), F.col("ord_b").alias("_ob")
        ),
        (F.col("a.ord") == F.col("_oa")) & (F.col("b.ord") == F.col("_ob")),
        "left_semi",
    )

    def depth(c: str) -> Column:
        clause = F.coalesce(F.col(c), F.lit(""))
        return F.size(F.split(clause, r"\."))

    a_loses = (F.col("a.relation_prob") < F.col("b.relation_prob")) | (
        (F.col("a.relation_prob") == F.col("b.relation_prob")) & (depth("a.source_clause") < depth("b.source_clause"))
    )
    loser = F.when(a_loses, F.struct(F.col("i").alias("at"), F.col("a.ord").alias("ord"))).otherwise(
        F.struct(F.col("j").alias("at"), F.col("b.ord").alias("ord"))
    )
    queue = told.groupBy("aligned_name", "predicate").agg(
        F.array_sort(F.collect_list(F.struct("i", "j", loser.alias("loser")))).alias("q")
    )
    lost = F.aggregate(
        "q",
        F.array().cast("array<int>"),
        lambda out, p: F.when(
            F.array_contains(out, p["i"]) | F.array_contains(out, p["j"]), out
        ).otherwise(F.concat(out, F.array(p["loser"]["at"]))),
    )
    gone = queue.withColumn("_lost", lost).select(
        F.explode(F.filter("q", lambda p: F.array_contains("_lost", p["loser"]["at"]))).alias("p")
    )
    return aligned.join(gone.select(F.col("p.loser.ord").alias("ord")), "ord", "left_anti")


def integrate_scores(evaluated: DataFrame) -> DataFrame:
    """Mean of the three clipped signals; a missing signal falls back to the old score, then to 0.5."""
    legacy = F.coalesce(F.col("quality_score").try_cast("double"), F.lit(0.5))
    out = evaluated
    for s in ("confidence", "clarity", "relevance"):
        out = out.withColumn(s, unit_interval(F.coalesce(F.col(s).try_cast("double"), legacy)))
    return out.withColumn("integrate_score", (F.col("confidence") + F.col("clarity") + F.col("relevance")) / 3)


def approve(scored: DataFrame, theta: float) -> DataFrame:
    """Threshold applied last, so that scores stay independent of it."""
    return scored.withColumn("approved", F.col("integrate_score") + 1e-9 >= theta)


def approval_counts(approved: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    ok = F.col("approved")
    return approved.groupBy(*keys).agg(
        F.count("*").alias("validated"),
        F.count_if(ok).alias("approved"),
        F.count_if(~ok).alias("rejected"),
        F.count_if(ok & F.col("is_new")).alias("new_entities"),
        F.count_if(ok & F.col("mapped_to").isNotNull()).alias("mapped_entities"),
    )


def quality_summary(approved: DataFrame) -> DataFrame:
    ok = F.col("approved")
    means = [F.avg(F.when(ok, F.col(c))).alias(f"avg_{c}") for c in ("confidence", "clarity", "relevance", "integrate_score")]
    return approved.agg(F.count_if(ok).alias("approved"), F.count_if(~ok).alias("rejected"), *means)


def feedback_replace(triples: DataFrame, flagged: DataFrame, re_extracted: DataFrame) -> DataFrame:
    """Replace all triples of flagged (spec, clause) sections by their second extraction."""
    sections = flagged.select("source_spec", "source_clause").distinct()
    return triples.join(sections, ["source_spec", "source_clause"], "left_anti").unionByName(
        re_extracted, allowMissingColumns=True
    )


#: What node types and edges need of a triple.
GRAPH_COLUMNS = (
    "subject", "predicate", "object", "ord", "triple_type", "entity_type", "aligned_name", "mapped_to", "align_conf", "source_spec",
    "source_clause", "raw_text", "min_pct_source", "min_pct_target", "mechanism", "fine_clause", "integrate_score",
)


def dedupe_triples(triples: DataFrame) -> DataFrame:
    """First triple of each subject, predicate and object.

    A rank filter, which runs before the shuffle as well; unlike an aggregate of whole rows it moves only the columns that are used later.
    """
    first = Window.partitionBy("subject", "predicate", "object").orderBy("ord")
    return triples.withColumn("_r", F.row_number().over(first)).filter("_r = 1").drop("_r")


def node_id() -> Column:
    return F.coalesce(F.nullif(F.col("mapped_to"), F.lit("")), F.col("aligned_name"))


def _is_attribute() -> Column:
    p = F.lower("predicate")
    return p.isin(*[x for names in ATTRIBUTES.values() for x in names])


def split_counters(c: str | Column) -> Column:
    """Names in a comma or semicolon list."""
    col = F.col(c) if isinstance(c, str) else c
    return F.filter(F.transform(F.split(col, "[,;]"), lambda s: F.trim(s)), lambda s: s != "")


def counter_edges(triples: DataFrame) -> DataFrame:
    """KPI definition -> counter edges from counter lists and single counters."""
    p = F.lower("predicate")
    names = F.when(p == "has_measurements", split_counters("object")).otherwise(F.array("object"))
    return triples.filter((F.col("triple_type") == "kpi_definition") & p.isin(*COUNTER_PREDICATES)).withColumn(
        "counter", F.explode(names)
    ).withColumn("relation_type", F.lit("uses_counter"))


def node_measurements(triples: DataFrame) -> DataFrame:
    """Counters listed for a KPI definition, each once: (node_id, place, measurement), places in the order of first mention.

    They stay rows, so a node with very many counters is sorted with spilling instead of being gathered in a list.
    """
    p = F.lower("predicate")
    names = F.when(p == "has_measurements", split_counters("object")).otherwise(F.array("object"))
    told = triples.filter((F.col("triple_type") == "kpi_definition") & p.isin(*COUNTER_PREDICATES)).select(
        node_id().alias("node_id"), "ord", F.posexplode(names).alias("pos", "measurement")
    )
    first = told.groupBy("node_id", "measurement").agg(F.min(F.struct("ord", "pos")).alias("_first"))
    place = F.row_number().over(Window.partitionBy("node_id").orderBy("_first"))
    return first.select("node_id", place.alias("place"), "measurement")


def node_sightings(triples: DataFrame) -> DataFrame:
    """Every mention of a node with the type it would get: (node_id, node_type, ord, side)."""
    tt, et = F.col("triple_type"), F.col("entity_type")
    own = (
        F.when(tt == "kpi_definition", "KPIDefinition")
        .when(tt == "measurement", "Measurement")
        .when(tt == "causal_chain", "CausalChain")
        .when(et.isin("KPIDefinition", "Measurement"), et)
        .otherwise("Entity")
    )
    subjects = triples.select(node_id().alias("node_id"), own.alias("node_type"), "ord", F.lit(0).alias("side"))
    counters = counter_edges(triples).select(
        F.col("counter").alias("node_id"), F.lit("Measurement").alias("node_type"), "ord", F.lit(1).alias("side")
    )
    plain = (tt != "kpi_definition") | ~(_is_attribute() | F.lower("predicate").isin(*COUNTER_PREDICATES))
    objects = triples.filter(plain).select(
        F.col("object").alias("node_id"), F.lit("Entity").alias("node_type"), "ord", F.lit(1).alias("side")
    )
    return subjects.unionByName(counters).unionByName(objects)


def node_types(triples: DataFrame) -> DataFrame:
    """One type per node: the first mention decides."""
    return node_sightings(triples).groupBy("node_id").agg(
        F.min_by("node_type", F.struct("ord", "side")).alias("node_type")
    )


def node_aggregate(triples: DataFrame) -> DataFrame:
    """Scalar provenance per subject node: largest confidence, last mapping, quality moments."""
    mapped = F.nullif(F.col("mapped_to"), F.lit(""))
    return triples.groupBy(node_id().alias("node_id")).agg(
        F.max("align_conf").alias("confidence"),
        F.max_by(mapped, F.when(mapped.isNotNull(), F.col("ord"))).alias("mapped_to"),
        F.count("*").alias("n_triples"),
        F.avg("integrate_score").alias("mean_quality"),
    )


def node_values(triples: DataFrame) -> DataFrame:
    """Distinct names, specs, clauses and provenance per node, one row each, in order of appearance.

    Kept as rows (node_id, field, value, first_ord): a popular node may have any number of values,
    which must not end up in one list inside one task.
    """
    prov = F.concat_ws(":", "source_spec", "source_clause")
    cells = F.array(
        F.struct(F.lit("original_names").alias("field"), F.col("original_name").alias("value")),
        F.struct(F.lit("source_specs").alias("field"), F.col("source_spec").alias("value")),
        F.struct(F.lit("source_clauses").alias("field"), F.col("source_clause").alias("value")),
        F.struct(F.lit("provenance").alias("field"), prov.alias("value")),
    )
    return (
        triples.select(node_id().alias("node_id"), "ord", F.inline(cells))
        .groupBy("node_id", "field", "value")
        .agg(F.min("ord").alias("first_ord"))
    )


def kpi_attributes(triples: DataFrame) -> DataFrame:
    """Attribute predicates of definitions as node columns; the last usable value wins."""
    p = F.lower("predicate")
    cells = []
    for name, predicates in ATTRIBUTES.items():
        value: Column = F.col("object")
        if name in NUMERIC_ATTRIBUTES:
            value = F.regexp_replace(F.trim("object"), "%+$", "").try_cast("double")
        usable = p.isin(*predicates) & value.isNotNull()
        cells.append(F.max_by(value, F.when(usable, F.col("ord"))).alias(name))
    return (
        triples.filter((F.col("triple_type") == "kpi_definition") & _is_attribute())
        .groupBy(node_id().alias("node_id"))
        .agg(*cells)
    )


def graph_edges(triples: DataFrame) -> DataFrame:
    """One edge per (source, target): later triples overwrite the fields they carry, and only those."""
    tt = F.col("triple_type")
    plain = triples.filter(
        (tt != "kpi_definition") | ~(_is_attribute() | F.lower("predicate").isin(*COUNTER_PREDICATES))
    ).select("*", F.col("object").alias("counter"), F.col("predicate").alias("relation_type"))
    rows = plain.unionByName(counter_edges(triples).select(*plain.columns)).select(
        node_id().alias("source"),
        F.col("counter").alias("target"),
        "relation_type",
        "triple_type",
        F.lit("extracted").alias("strength"),
        "source_spec",
        "source_clause",
        F.col("integrate_score").alias("quality_score"),
        F.col("align_conf").alias("confidence"),
        "raw_text",
        "min_pct_source",
        "min_pct_target",
        F.nullif(F.col("mechanism"), F.lit("")).alias("mechanism"),
        F.nullif(F.col("fine_clause"), F.lit("")).alias("fine_clause"),
        "ord",
    )
    latest = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("ord"))).alias(c) for c in EDGE_FIELDS]
    return rows.groupBy("source", "target").agg(*latest, F.min("ord").alias("ord"))


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts by node type and triple type."""
    n = nodes.groupBy(F.col("node_type").alias("name")).agg(F.count("*").alias("n")).withColumn("what", F.lit("node_type"))
    e = edges.groupBy(F.col("triple_type").alias("name")).agg(F.count("*").alias("n")).withColumn("what", F.lit("triple_type"))
    return n.unionByName(e)
