"""Candidate causes of events from a KPI relationship graph.

edges is (source_kpi, target_kpi, relation_type, strength, edge_ord), a KPI-level ontology; `attach` also takes a column spec_reference. Events come
ranked (see events.rank_topn), all of a station if so asked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kpiscope.functions.exprs import settle
from kpiscope.operators.events import strength_rank

# Relation types by expected polarity.
POSITIVE = ("INCREASES", "DETERMINES", "CAUSES")
NEGATIVE = ("DECREASES", "LIMITS")

#: Hours of a bucket of the interval join.
BUCKET_HOURS = 12


def direction_consistency(relation: str, source_dir: str, target_dir: str) -> Column:
    """Does the observed pair of directions fit the polarity of the edge? NULL when it cannot tell."""
    r, s, t = F.col(relation), F.col(source_dir), F.col(target_dir)
    return F.when((s == "mixed") | (t == "mixed"), F.lit(None).cast("boolean")).when(
        r.isin(*NEGATIVE), s != t
    ).when(r.isin(*POSITIVE), s == t)


def _event_edges(events: DataFrame, edges: DataFrame) -> DataFrame:
    """Every single-KPI event beside the edges that point at its KPI."""
    e = edges.filter("source_kpi <> target_kpi")
    return events.filter("kpi <> 'MULTI'").join(e, F.col("kpi") == F.col("target_kpi")).drop("target_kpi")


def overlapping(targets: DataFrame, sources: DataFrame, keys: list[str], bucket_h: int = BUCKET_HOURS) -> DataFrame:
    """Rows of targets beside those of sources with equal keys, and `meets`: their intervals (a, b) and (c, d), ends included, share an hour.

    Both sides list the buckets of time that their interval touches, and the bucket is part of the equality, so a row meets
    only what lies near it. A pair that shares several buckets meets in that of the first shared hour alone. Targets without any source
    near them stay, with nulls.
    """
    touched = lambda first, last: F.explode(F.sequence(F.floor(F.col(first) / bucket_h), F.floor(F.col(last) / bucket_h)))
    left = targets.withColumn("_bucket", touched("a", "b"))
    right = sources.withColumn("_bucket", touched("c", "d"))
    share = (F.col("c") <= F.col("b")) & (F.col("a") <= F.col("d")) & (F.floor(F.greatest("a", "c") / bucket_h) == F.col("_bucket"))
    return left.join(right, [*keys, "_bucket"], "left").withColumn("meets", F.coalesce(share, F.lit(False))).drop("_bucket", "a", "b", "c", "d")


def edge_evidence(events: DataFrame, edges: DataFrame, window: int = 6, bucket_h: int = BUCKET_HOURS) -> DataFrame:
    """Every event with every edge that points at its KPI, and `s`: the strongest source event whose widened window touches it, or null.

    An interval join by buckets of time: for a fixed window its work grows with a station's events, not with their square,
    unless they lie in the same hours.
    """
    targets = _event_edges(events, edges).withColumns({"a": F.col("t_start"), "b": F.col("t_end")})
    src = events.filter("kpi <> 'MULTI'").select(
        F.col("station_id"),
        F.col("kpi").alias("source_kpi"),
        F.struct("type", "t_start", "t_end", "magnitude", "z_score", "direction", "event_idx").alias("s"),
        (F.col("t_start") - window).alias("c"),
        (F.col("t_end") + window).alias("d"),
    )
    met = overlapping(targets, src, ["station_id", "source_kpi"], bucket_h)
    own = F.struct("source_kpi", "relation_type", "strength", "direction", "t_start", "t_end")
    best = met.groupBy("station_id", "event_idx", "edge_ord").agg(
        F.max(own).alias("own"), F.max_by("s", F.when(F.col("meets"), F.struct(F.abs("s.z_score"), -F.col("s.event_idx")))).alias("s")
    )  # own is the same on all rows of an event and edge
    return best.select("station_id", "event_idx", "edge_ord", "own.*", "s")


#: What tells of a source event, in the columns of a cause.
_EVIDENCE = ("src_type", "src_t_start", "src_t_end", "src_magnitude", "src_z_score", "src_direction", "lag_hours")


def _with_evidence(rows: DataFrame) -> DataFrame:
    s = F.col("s")
    values = (s["type"], s["t_start"], s["t_end"], settle(s["magnitude"], 4), settle(s["z_score"], 3), s["direction"], s["t_start"] - F.col("t_start"))
    named = rows.withColumns({n: F.when(s.isNotNull(), v) for n, v in zip(_EVIDENCE, values, strict=True)}).withColumnRenamed("direction", "target_direction")
    fits = direction_consistency("relation_type", "src_direction", "target_direction")
    return named.withColumn("consistent", F.when(s.isNotNull(), fits))


def concurrent(events: DataFrame, edges: DataFrame, window: int = 6, bucket_h: int = BUCKET_HOURS) -> DataFrame:
    """Edges with a concurrent source event, the strongest one."""
    return _with_evidence(edge_evidence(events, edges, window, bucket_h).filter("s is not null")).drop("s", "t_start", "t_end")


def weighed(evidence: DataFrame, marks: DataFrame, min_z: float = 1.5) -> DataFrame:
    """Causes: edges with a concurrent event (has_concurrent 1), and those without whose source KPI is off during the event anyway (0).

    Open edges list their event's hours and meet the forecast marks on (station, kpi, hour), an equality join in place of a
    range join. Closed ones go through with one empty hour, so events are read once for both. The marks carry the baseline moments.
    """
    hours = F.when(F.col("s").isNull(), F.sequence("t_start", "t_end"))
    rows = _with_evidence(evidence).select("*", F.explode_outer(hours).alias("h"))
    f = marks.select("station_id", F.col("kpi").alias("source_kpi"), "h", "pred", "mu", "sd")
    keys = ["station_id", "event_idx", "edge_ord"]
    own = ["source_kpi", "relation_type", "strength", "target_direction", *_EVIDENCE, "consistent"]
    during = rows.join(f, ["station_id", "source_kpi", "h"], "left").groupBy(*keys, *own).agg(
        F.avg("pred").alias("mean_during_event"), F.max("mu").alias("baseline_mean"), F.max("sd").alias("_sd")
    )
    spread = F.when(F.col("_sd") == 0, 1.0).otherwise(F.col("_sd"))
    out = during.withColumn("z_deviation", (F.col("mean_during_event") - F.col("baseline_mean")) / spread)
    out = out.withColumn("has_concurrent", F.col("src_type").isNotNull().cast("int"))
    return out.filter((F.col("has_concurrent") == 1) | (F.abs("z_deviation") >= min_z)).drop("_sd")


def background(events: DataFrame, edges: DataFrame, marks: DataFrame, min_z: float = 1.5) -> DataFrame:
    """Edges without a concurrent event whose source KPI is off during the event anyway."""
    return weighed(edge_evidence(events, edges), marks, min_z).filter("has_concurrent = 0")


def multi_causes(events: DataFrame, edges: DataFrame, top_k: int = 5) -> DataFrame:
    """Known edges among the KPIs of a joint event, strongest first.

    The KPIs of an event pick their outgoing edges and keep those that end inside the event, so no
    pair is formed that the graph does not hold.
    """
    first = Window.partitionBy("source_kpi", "target_kpi").orderBy("edge_ord")
    distinct = edges.withColumn("_r", F.row_number().over(first)).filter("_r = 1").drop("_r")
    fan = events.filter((F.col("type") == "multi_kpi") & (F.size("co_occurring_kpis") >= 2)).select(
        "station_id", "event_idx", "co_occurring_kpis", F.posexplode("co_occurring_kpis").alias("a", "source_kpi")
    )
    hit = fan.join(distinct, "source_kpi").filter(
        (F.col("source_kpi") != F.col("target_kpi")) & F.array_contains("co_occurring_kpis", F.col("target_kpi"))
    )
    w = Window.partitionBy("station_id", "event_idx").orderBy(
        strength_rank().desc(), "a", F.array_position("co_occurring_kpis", F.col("target_kpi"))
    )
    return (
        hit.withColumn("rank", F.row_number().over(w))
        .filter(F.col("rank") <= top_k)
        .select("station_id", "event_idx", "rank", "source_kpi", "target_kpi", "relation_type", "strength", "edge_ord")
    )


def rank_causes(causes: DataFrame, top_k: int = 5) -> DataFrame:
    """Concurrent causes first, then by strength, z, small lag and consistency; best five per event."""
    w = Window.partitionBy("station_id", "event_idx").orderBy(
        F.col("has_concurrent").desc(),
        strength_rank().desc(),
        F.abs(F.coalesce("src_z_score", F.lit(0.0))).desc(),
        F.abs(F.coalesce("lag_hours", F.lit(0))),
        F.coalesce(F.col("consistent").cast("int"), F.lit(0)).desc(),
        "edge_ord",
    )
    return causes.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top_k)


def infer(events: DataFrame, edges: DataFrame, marks: DataFrame, top_k: int = 5) -> DataFrame:
    """Ranked candidate causes of every event of every station."""
    single = rank_causes(weighed(edge_evidence(events, edges), marks), top_k).withColumn("shared_mechanism", F.lit(False))
    joint = multi_causes(events, edges, top_k).drop("target_kpi").withColumn("shared_mechanism", F.lit(True))
    return single.unionByName(joint, allowMissingColumns=True)


#: What an event carries of each cause, in this order.
CAUSE_FIELDS = ("rank", "source_kpi", "relation_type", "strength", "spec_reference", "has_concurrent", "src_type", "src_z_score", "lag_hours", "z_deviation", "consistent", "shared_mechanism")


def attach(events: DataFrame, causes: DataFrame, edges: DataFrame, environment: DataFrame | None = None) -> DataFrame:
    """Enriched event records: events with candidate_causes as one ordered array (at most top_k entries) and the environment of their station.

    Events without a cause have an empty array. environment is (station_id, ...), one row per station; its columns become a struct.
    """
    known = set(edges.columns)
    reference = F.col("spec_reference") if "spec_reference" in known else F.lit(None).cast("string")
    named = causes.join(edges.select("edge_ord", reference.alias("spec_reference")), "edge_ord", "left")
    lists = named.groupBy("station_id", "event_idx").agg(F.array_sort(F.collect_list(F.struct(*CAUSE_FIELDS))).alias("candidate_causes"))
    out = events.join(lists, ["station_id", "event_idx"], "left")
    empty = F.array().cast(lists.schema["candidate_causes"].dataType)
    out = out.withColumn("candidate_causes", F.coalesce("candidate_causes", empty))
    if environment is None:
        return out
    around = environment.select("station_id", F.struct(*(c for c in environment.columns if c != "station_id")).alias("environmental_context"))
    return out.join(around, "station_id", "left")


def pairs_from_causes(events: DataFrame, causes: DataFrame) -> DataFrame:
    """Distinct (source, target) KPI pairs named by any cause of a station, those of joint events (target MULTI) included."""
    return (
        causes.join(events.select("station_id", "event_idx", "kpi"), ["station_id", "event_idx"])
        .select("station_id", "source_kpi", F.col("kpi").alias("target_kpi"))
        .distinct()
    )


