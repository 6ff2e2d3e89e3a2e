"""Deterministic audit of written reports against the numbers they quote.

Reports are (station_id, arm, report): markdown with `## §N` sections. Everything that looks at one
report is a column expression over its text, so audits are narrow until claims meet their truth.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kpiscope.functions.exprs import any_of, col, has_any, settle

# Fixed values of the report format: section headings, numbers, the headline, words of a sign, tags, words before a clause.
SECTION_START = r"#{1,6}\s*§\d\b"
NUMBER = r"-?\d+(?:\.\d+)?"
Z_CLAIM = rf"(?i)\|\s*z\s*\|\s*=\s*({NUMBER})"
RESULT_LINE = r"\*\*Result:\s*(\d+)/(\d+) match\*\*"
POSITIVE_WORDS = ("positive", "increase", "↑", "+")
NEGATIVE_WORDS = ("negative", "decrease", "↓", "−", "-")
TAGS = ("GraphRAG", "Cause", "Sensitivity-Local", "Sensitivity-Matrix", "Sensitivity", "Anomaly", "Temporal", "OSM", "Forecast", "Spatial", "Parametric")
CLAUSE_WORDS = ("section", "clause", "sec.", "sec", "§")
NEGLIGIBLE_SIZE = "<0.001"

#: Signs between a source and its target in tables and tags.
PAIR_ARROWS, SOURCE_ARROWS = "→|->|=>", "← |<- "
#: Column names that make a table row a header: any of the alternatives, each with names for some of its columns.
HEADERS = {
    "coupling": [{0: ("source", "kpi", "")}, {1: ("target", "relationship", ""), 2: ("mechanism", "strength", "description", "")}],
    "action": [{0: ("action", "priority", "")}],
}

ID = ("station_id", "arm")


def parts(report: str | Column) -> Column:
    """Report cut before each section heading."""
    return F.split(col(report), rf"(?m)^(?={SECTION_START})", -1)


def section(report: str | Column, n: int) -> Column:
    """Text of section n, heading included; the last one wins, no section gives an empty text."""
    return _last(parts(report), n)


def sections(reports: DataFrame) -> DataFrame:
    """(id, tag, text) rows, last occurrence of each tag."""
    cut = reports.select(*ID, F.posexplode(parts("report")).alias("pos", "text"))
    tag = F.regexp_extract("text", r"^#{1,6}\s*(§\d)\b", 1)
    tagged = cut.withColumn("tag", tag).filter("tag <> ''")
    return tagged.groupBy(*ID, "tag").agg(F.max_by("text", "pos").alias("text"))


def _lines(text: Column) -> Column:
    return F.transform(F.split(text, r"\r?\n"), lambda s: F.trim(s))


def row_cells(text: Column) -> Column:
    """Body rows of markdown tables as arrays of cells; header and rule lines are left out."""
    rows = F.filter(_lines(text), lambda s: s.startswith("|") & ~s.rlike(r"^\|\s*[:\-]+"))
    inner = F.transform(rows, lambda s: F.regexp_replace(s, r"^\|+|\|+$", ""))
    cells = F.transform(inner, lambda s: F.transform(F.split(s, r"\|", -1), lambda c: F.trim(c)))
    return F.filter(cells, lambda r: F.exists(r, lambda c: c.rlike(r"^[+-]?\d")))


def wide_rows(text: Column, least: int = 3) -> Column:
    """All table rows with so many cells at least, as arrays of trimmed cells; header and rule rows are still among them."""
    lines = F.filter(F.split(text, r"\r?\n"), lambda s: s.startswith("|"))
    cut = F.filter(F.transform(lines, lambda s: F.split(s, r"\|", -1)), lambda r: F.size(r) >= least + 2)
    return F.transform(cut, lambda r: F.transform(F.slice(r, F.lit(2), F.size(r) - 2), lambda c: F.trim(c)))


def is_rule(cell: Column) -> Column:
    """Whether a cell only draws a line."""
    return (cell != "") & (F.translate(cell, "-: ", "") == "")


def is_header(cells: Column, table: str) -> Column:
    """Whether a row holds the column names of a table."""
    def fits(names: dict[int, tuple[str, ...]]) -> Column:
        return reduce(lambda x, y: x & y, [F.lower(cells[i]).isin(*words) for i, words in names.items()])

    return any_of([fits(names) for names in HEADERS[table]])


def tags(text: Column) -> Column:
    """What stands between square brackets."""
    opened = F.split(text, r"\[", -1)
    closed = F.filter(F.slice(opened, F.lit(2), F.greatest(F.size(opened) - 1, F.lit(0))), lambda p: p.contains("]"))
    return F.transform(closed, lambda p: F.substring_index(p, "]", 1))


def untagged(line: Column) -> Column:
    """A line without its known tags, white space evened out."""
    opened = F.split(line, r"\[", -1)
    known = lambda p: any_of([p.startswith(t) for t in TAGS]) & p.contains("]")
    kept = F.transform(opened, lambda p, i: F.when(i == 0, p).when(known(p), F.substring(p, F.instr(p, F.lit("]")) + 1, F.length(p))).otherwise(F.concat(F.lit("["), p)))
    return F.regexp_replace(F.trim(F.array_join(kept, "")), r"\s{2,}", " ")


def occurrences(text: Column, word: str) -> Column:
    """How often a fixed word stands in a text."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(word), F.lit("")))) / len(word)).cast("int")


def first_pair(text: Column) -> Column:
    """(src, tgt) around the first arrow that has a name on both sides; null without one."""
    parts_ = F.split(text, PAIR_ARROWS, -1)
    around = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(parts_) - 1, F.lit(1))),
        lambda k: F.struct(F.regexp_extract(F.get(parts_, k - 1), r"([A-Za-z_]\w+)\s*$", 1).alias("src"), F.regexp_extract(F.get(parts_, k), r"^\s*([A-Za-z_]\w+)", 1).alias("tgt")),
    )
    return F.get(F.filter(around, lambda p: (p["src"] != "") & (p["tgt"] != "")), F.lit(0))


def table_rows(reports: DataFrame, n: int) -> DataFrame:
    return reports.select(*ID, F.posexplode(row_cells(section("report", n))).alias("row_no", "cells"))


def _cited(after: Column) -> Column:
    """(ts, clause) of the text that follows the letters TS; an empty ts if it is no citation."""
    bare = F.regexp_replace(after, r"^\s+", "")
    number = F.substring(bare, 1, 6)
    rest = F.regexp_replace(F.substring(bare, 7, 64), r"^\s+", "")
    behind = reduce(
        lambda found, word: found.when(F.lower(rest).startswith(word), F.substring(rest, len(word) + 1, 64)), CLAUSE_WORDS[1:],
        F.when(F.lower(rest).startswith(CLAUSE_WORDS[0]), F.substring(rest, len(CLAUSE_WORDS[0]) + 1, 64)),
    )
    clause = F.regexp_extract(behind, r"^\s*(\d+(?:\.\d+)*)", 1)
    return F.struct(F.when(number.rlike(r"^\d\d\.\d{3}$"), number).otherwise("").alias("ts"), F.coalesce(clause, F.lit("")).alias("clause"))


def spec_citations(reports: DataFrame) -> DataFrame:
    """Every citation in canonical form, duplicates kept: the text is cut at the letters TS and each piece read from its start."""
    pieces = F.split("report", "(?i)ts", -1)
    cited = F.filter(F.transform(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), _cited), lambda c: c["ts"] != "")
    out = reports.select(*ID, F.posexplode(cited).alias("cite_no", "c"))
    ts = F.concat(F.lit("TS "), F.col("c.ts"))
    return out.select(
        *ID,
        "cite_no",
        ts.alias("spec"),
        F.when(F.col("c.clause") == "", ts).otherwise(F.concat(ts, F.lit(" §"), F.col("c.clause"))).alias("citation"),
    )


def audit_citations(reports: DataFrame, known_specs: DataFrame) -> DataFrame:
    """Citations marked as known to the graph or not, on the level of the specification number."""
    known = known_specs.select("spec").distinct().withColumn("in_graph", F.lit(True))
    return spec_citations(reports).join(known, "spec", "left").withColumn(
        "in_graph", F.coalesce("in_graph", F.lit(False))
    )


def citation_counts(audited: DataFrame) -> DataFrame:
    return audited.groupBy(*ID).agg(
        F.count("*").alias("citations"),
        F.count_if("in_graph").alias("in_graph"),
        F.count_if(~F.col("in_graph")).alias("hallucinated"),
        F.count_distinct(F.when(~F.col("in_graph"), F.col("spec"))).alias("hallucinated_specs"),
    )


def truth_table(summary: DataFrame, metrics: DataFrame) -> DataFrame:
    """(station_id, kpi, field, truth): every number a forecast table may quote."""
    s = summary.join(metrics.select("station_id", "kpi", "smape", "mase", "mae", "rmse"), ["station_id", "kpi"], "left")
    change = F.when(F.abs("baseline_mean") > 1e-8, F.col("increase_pct"))
    cells = {
        "forecast_min": settle("forecast_min", 2),
        "forecast_mean": settle("forecast_mean", 2),
        "forecast_max": settle("forecast_max", 2),
        "baseline_mean": settle("baseline_mean", 2),
        "change_pct": settle(change, 2),
        "smape": settle("smape", 4),
        "mase": settle("mase", 4),
        "mae": settle("mae", 4),
        "rmse": settle("rmse", 4),
    }
    rows = F.array(*[F.struct(F.lit(k).alias("field"), c.alias("truth")) for k, c in cells.items()])
    return s.select("station_id", "kpi", F.inline(rows)).filter("truth IS NOT NULL")


def _number(token: Column) -> Column:
    return F.regexp_replace(token, "[,%+]", "").try_cast("double")


def forecast_claims(reports: DataFrame, kpis: list[str]) -> DataFrame:
    """Numbers quoted in the forecast table: (id, kpi, field, claimed)."""
    rows = table_rows(reports, 1).withColumn("kpi", F.col("cells")[0]).filter(F.col("kpi").isin(kpis))

    def triple(c: Column) -> Column:
        return F.transform(F.split(c, r"\s*/\s*", -1), _number)

    spans = F.filter(
        F.slice("cells", 3, 3),
        lambda c: (F.size(F.split(c, r"\s*/\s*", -1)) == 3) & F.forall(triple(c), lambda v: v.isNotNull()),
    )
    names = ("forecast_min", "forecast_mean", "forecast_max")
    first = F.when(F.size(spans) > 0, triple(spans[0]))
    span_claims = F.when(
        first.isNotNull(),
        F.array(*[F.struct(F.lit(k).alias("field"), F.get(first, F.lit(i)).alias("claimed")) for i, k in enumerate(names)]),
    )
    labels = (("baseline", "baseline_mean"), ("smape", "smape"), ("mase", "mase"))
    labelled = F.flatten(
        F.transform(
            "cells",
            lambda c: F.array(
                *[
                    F.struct(
                        F.lit(field).alias("field"),
                        F.when(F.lower(c).contains(word), _number(F.regexp_extract(c, f"({NUMBER})", 1))).alias("claimed"),
                    )
                    for word, field in labels
                ]
            ),
        )
    )
    empty = F.array().cast("array<struct<field:string,claimed:double>>")
    claims = F.concat(F.coalesce(span_claims, empty), labelled)
    return rows.select(*ID, "kpi", F.inline(claims)).filter("claimed IS NOT NULL")


def z_claims(reports: DataFrame, events: DataFrame) -> DataFrame:
    """|z| values of section 4 beside the nearest event score of the station.

    Events are ranked and few per station, so the nearest one is found by an equality join on the
    station and a smallest-distance aggregate.
    """
    quoted = reports.select(
        *ID, F.posexplode(F.regexp_extract_all(section("report", 4), F.lit(Z_CLAIM), F.lit(1))).alias("claim_no", "z")
    ).withColumn("claimed", F.col("z").cast("double"))
    pool = events.select("station_id", settle(F.abs("z_score"), 2).alias("t"))
    near = quoted.join(pool, "station_id").groupBy(*ID, "claim_no", "claimed").agg(
        F.min_by("t", F.struct(F.abs(F.col("claimed") - F.col("t")), "t")).alias("truth")
    )
    return near.withColumn("field", F.lit("z_score"))


def verdict(claimed: Column, truth: Column) -> Column:
    """1 % relative tolerance with an absolute floor of 0.01."""
    ok = F.abs(claimed - truth) <= F.greatest(F.lit(0.01), 0.01 * F.abs(truth))
    return F.when(truth.isNull(), "unverifiable").when(ok, "match").otherwise("mismatch")


def judged_claims(reports: DataFrame, truth: DataFrame, events: DataFrame, kpis: list[str]) -> DataFrame:
    """All numeric claims of sections 1 and 4 with their truth and verdict."""
    one = forecast_claims(reports, kpis).join(truth, ["station_id", "kpi", "field"], "left").withColumn("section", F.lit("§1"))
    four = z_claims(reports, events).withColumn("section", F.lit("§4")).withColumn("kpi", F.lit("")).drop("claim_no")
    both = one.unionByName(four)
    return both.withColumn("verdict", verdict(F.col("claimed"), F.col("truth")))


def faithfulness(claims: DataFrame) -> DataFrame:
    counts = claims.groupBy(*ID).agg(
        *[F.count_if(F.col("verdict") == v).alias(n) for v, n in (("match", "matches"), ("mismatch", "mismatches"), ("unverifiable", "unverifiable"))]
    )
    total = F.col("matches") + F.col("mismatches")
    return counts.withColumn("ratio", F.when(total > 0, F.col("matches") / total))


def coupling_sign(text: Column) -> Column:
    """+1 or -1 told by the words of a row; a row with words of both kinds tells nothing."""
    t = F.lower(text)
    pos, neg = has_any(t, POSITIVE_WORDS), has_any(t, NEGATIVE_WORDS)
    return F.when(pos & ~neg, 1).when(neg & ~pos, -1)


def coupling_rows(reports: DataFrame, kpis: list[str]) -> DataFrame:
    """Rows of section 2 that claim a sign for a KPI pair: (id, src, tgt, claimed_sign)."""
    rows = reports.select(*ID, F.explode(wide_rows(section("report", 2))).alias("r"))
    cells = F.slice("r", 1, 3)
    joined = F.array_join(cells, " | ")
    drawn = F.exists(cells, lambda c: c.startswith("-") | c.startswith(":"))
    names = joined.contains("Source") & joined.contains("Target")
    pair = F.coalesce(first_pair(F.col("r")[0]), first_pair(joined))
    out = rows.filter(~drawn & ~names).select(*ID, pair.alias("p"), coupling_sign(joined).alias("claimed_sign"))
    out = out.select(*ID, "p.src", "p.tgt", "claimed_sign")
    return out.filter(F.col("src").isin(kpis) & F.col("tgt").isin(kpis) & F.col("claimed_sign").isNotNull())


def local_sources(text: Column) -> Column:
    """KPIs that local sensitivity tags name as their source."""
    own = F.filter(tags(text), lambda t: t.startswith("Sensitivity-Local"))
    named = F.transform(own, lambda t: F.get(F.filter(F.transform(F.split(t, SOURCE_ARROWS, -1), lambda p, i: F.when(i > 0, F.regexp_extract(p, r"^[A-Za-z_]\w+", 0))), lambda n: n != ""), F.lit(0)))
    return F.array_compact(named)


def negligible_tags(text: Column) -> Column:
    """How many sensitivity tags quote a negligible effect."""
    bare = F.transform(tags(text), lambda t: F.lower(F.translate(t, " \t\r\n", "")))
    return F.size(F.filter(bare, lambda t: t.startswith("sensitivity") & (t.contains("negligible") | t.contains(NEGLIGIBLE_SIZE))))


def audit_sensitivity(reports: DataFrame, global_sens: DataFrame, local_sens: DataFrame, kpis: list[str], order: tuple[str, ...]) -> DataFrame:
    """Five consistency scores per report; a score without input rows is NULL.

    global_sens is (station_id, src, tgt, ptype, s_norm), local_sens (station_id, event_idx, src,
    s_norm). `order` lists the perturbation types.
    """
    place = F.array_position(F.array(*[F.lit(p) for p in order]), F.col("ptype"))
    size = F.struct(F.abs("s_norm"), -place)
    cell = global_sens.groupBy("station_id", "src", "tgt").agg(
        F.signum(F.max_by("s_norm", size)).alias("sign"), F.avg(F.abs("s_norm")).alias("mean_abs")
    )
    claimed = coupling_rows(reports, kpis)
    agree = (
        claimed.join(cell.select("station_id", "src", "tgt", "sign"), ["station_id", "src", "tgt"], "left")
        .groupBy(*ID)
        .agg(F.avg(F.coalesce(F.col("sign") == F.col("claimed_sign"), F.lit(False)).cast("double")).alias("directional_global"))
    )
    rank = F.struct(-F.round(F.abs("s_norm"), 12), -F.array_position(F.array(*[F.lit(k) for k in kpis]), F.col("src")))
    top3 = F.slice(F.array_sort(F.collect_list(F.struct(rank.alias("r"), "src"))), 1, 3)  # one entry per KPI
    sources = (
        local_sens.groupBy("station_id", "event_idx")
        .agg(F.transform(top3, lambda x: x["src"]).alias("top"))
        .groupBy("station_id")
        .agg(F.array_distinct(F.flatten(F.collect_set("top"))).alias("anywhere"))
    )
    cited = reports.select(*ID, F.explode(local_sources(section("report", 4))).alias("src"))
    local = (
        cited.join(sources, "station_id")
        .groupBy(*ID)
        .agg(F.avg(F.array_contains("anywhere", F.col("src")).cast("double")).alias("directional_local"))
    )
    pos = F.array(*[F.lit(k) for k in kpis])
    top = (
        cell.filter("src <> tgt")
        .groupBy("station_id")
        .agg(
            F.min_by(
                F.struct("src", "tgt"),
                F.struct(-F.round("mean_abs", 12), F.array_position(pos, F.col("src")), F.array_position(pos, F.col("tgt"))),
            ).alias("top")
        )
    )
    base = reports.select(
        *ID,
        section("report", 2).alias("_s2"),
        (occurrences(F.col("report"), "[Sensitivity]") + occurrences(F.col("report"), "[Sensitivity-Local")).alias("citations"),
        negligible_tags(F.col("report")).alias("unsupported"),
    )
    recall = F.when(
        (F.col("_s2") != "") & F.col("top").isNotNull(),
        (F.col("_s2").contains(F.col("top.src")) & F.col("_s2").contains(F.col("top.tgt"))).cast("double"),
    )
    return (
        base.join(agree, list(ID), "left")
        .join(local, list(ID), "left")
        .join(top, "station_id", "left")
        .withColumn("top1_recall", recall)
        .select(*ID, "directional_global", "directional_local", "top1_recall", "citations", "unsupported")
    )


def sensitivity_passes(scores: DataFrame) -> DataFrame:
    """How many of the five scores pass, and how many could be judged."""
    checks = [
        F.col("directional_global") >= 0.5,
        F.col("directional_local") >= 0.5,
        F.col("top1_recall") >= 1.0,
        F.col("citations") > 0,
        F.col("unsupported") == 0,
    ]
    passed = sum((F.coalesce(c.cast("int"), F.lit(0)) for c in checks), F.lit(0))
    seen = sum((c.isNotNull().cast("int") for c in checks), F.lit(0))
    return scores.withColumn("passed", passed).withColumn("seen", seen)


def result_line(faith: DataFrame, passes: DataFrame) -> DataFrame:
    """Headline of the audit over numeric and sensitivity checks."""
    j = faith.join(passes.select(*ID, "passed", "seen"), list(ID), "full_outer").na.fill(0)
    hit = F.col("matches") + F.col("passed")
    total = F.col("matches") + F.col("mismatches") + F.col("seen")
    return j.select(*ID, hit.alias("verified"), total.alias("total"), F.format_string("**Result: %d/%d match**", hit, total).alias("line"))


def parse_result_line(text: str | Column) -> Column:
    t = col(text)
    return F.struct(
        F.regexp_extract(t, RESULT_LINE, 1).try_cast("int").alias("verified"),
        F.regexp_extract(t, RESULT_LINE, 2).try_cast("int").alias("total"),
    )


def _last(cut: Column, n: int) -> Column:
    hits = F.filter(cut, lambda p: p.rlike(rf"^#{{1,6}}\s*§{n}\b"))
    return F.when(F.size(hits) > 0, F.element_at(hits, -1)).otherwise("")


def atomic_claims(reports: DataFrame, min_length: int = 10) -> DataFrame:
    """Claims of a report in order: coupling rows, tagged bullets, action rows.

    The report is cut once: sections, their rows and their bullets are columns of their own.
    """
    cut = reports.select(*ID, parts("report").alias("_p"))
    split = cut.select(*ID, *[_last(F.col("_p"), n).alias(f"_s{n}") for n in (2, 4, 5)])
    bullet = r"^\s*[-*]\s+"
    points = F.filter(F.split("_s4", r"\n"), lambda s: s.rlike(bullet + "."))
    rows = split.select(
        *ID,
        wide_rows(F.col("_s2")).alias("_couplings"),
        F.transform(points, lambda s: F.regexp_replace(s, bullet, "")).alias("_points"),
        wide_rows(F.col("_s5")).alias("_actions"),
    )
    body = lambda rows_, table: F.filter(rows_, lambda r: ~is_rule(r[0]) & ~is_header(r, table))
    tagged = F.filter("_points", lambda s: F.exists(tags(s), lambda t: any_of([t.startswith(x) for x in TAGS])) & ~s.rlike(r"^\["))
    said = F.transform(body(F.col("_couplings"), "coupling"), lambda r: F.when(r[2] == "", r[0]).otherwise(F.concat(F.lit("("), r[0], F.lit(" → "), r[1], F.lit(") "), r[2])))
    claims = F.concat(said, F.transform(tagged, untagged), F.transform(body(F.col("_actions"), "action"), lambda r: r[0]))
    kept = F.filter(claims, lambda c: F.length(c) >= min_length)
    return rows.select(*ID, F.posexplode(kept).alias("claim_no", "claim"))


def evidence_contexts(reports: DataFrame) -> DataFrame:
    """Sections 1 to 3 as separate contexts, in order, repeated texts once."""
    chunks = F.filter(parts("report"), lambda p: p.rlike(r"^#{1,6}\s*§[123]\b"))
    clean = F.array_distinct(F.transform(chunks, lambda p: F.regexp_replace(p, r"\s+$", "")))
    return reports.select(*ID, F.posexplode(clean).alias("context_no", "context"))


# Words that appeal to the surroundings of a cell.
OSM_WORDS = (
    "transit", "residential", "urban", "suburban", "dense", "low-rise", "low rise", "high-rise", "high rise", "mast",
    "poi", "building",
)


#: Signs between a cause and its effect.
ARROWS = r"->|→|=>|⇒|="


def claim_pairs(claims: DataFrame, kpis: list[str]) -> DataFrame:
    """Directed KPI pairs named in a claim: (station_id, claim_no, src, tgt)."""
    # a claim cut at its arrows: what ends one piece points to what starts the next; each pair uses its words up
    pieces = F.split("claim", ARROWS, -1)
    ends = F.transform(pieces, lambda p: F.struct(F.regexp_extract(p, r"(\w+)\s*$", 1).alias("last"), F.regexp_extract(p, r"^\s*(\w+)", 1).alias("first"), F.trim(p).rlike(r"^\w+$").alias("one")))
    start = F.struct(F.lit(False).alias("used"), F.array().cast("array<struct<src:string,tgt:string>>").alias("pairs"))

    def step(acc: Column, k: Column) -> Column:
        src, tgt = F.get(F.col("_e"), k - 1), F.get(F.col("_e"), k)
        ok = (src["last"] != "") & (tgt["first"] != "") & ~(acc["used"] & src["one"])
        more = F.concat(acc["pairs"], F.array(F.struct(src["last"].alias("src"), tgt["first"].alias("tgt"))))
        return F.struct(ok.alias("used"), F.when(ok, more).otherwise(acc["pairs"]).alias("pairs"))

    cut = claims.select("station_id", "claim_no", ends.alias("_e")).filter(F.size("_e") > 1)
    both = F.aggregate(F.sequence(F.lit(1), F.size("_e") - 1), start, step)["pairs"]
    out = cut.select("station_id", "claim_no", F.explode(both).alias("p")).select("station_id", "claim_no", "p.src", "p.tgt")
    return out.filter(F.col("src").isin(kpis) & F.col("tgt").isin(kpis) & (F.col("src") != F.col("tgt")))


def directional_issues(claims: DataFrame, rules: DataFrame, kpis: list[str]) -> DataFrame:
    """Arrow statements of a claim that contradict a rule; the last arrow of a KPI counts."""
    pattern = r"(\w+)(↑|↓)"
    arrows = F.arrays_zip(
        F.regexp_extract_all("claim", F.lit(pattern), F.lit(1)).alias("kpi"),
        F.regexp_extract_all("claim", F.lit(pattern), F.lit(2)).alias("arrow"),
    )
    listed = claims.withColumn("_a", arrows).filter(F.size("_a") >= 2)
    each = listed.select("station_id", "claim_no", F.posexplode("_a").alias("pos", "a")).filter(F.col("a.kpi").isin(kpis))
    last = each.groupBy("station_id", "claim_no", F.col("a.kpi").alias("kpi")).agg(F.max_by("a.arrow", "pos").alias("arrow"))
    r = rules.select("source", "target", "coupling")  # KPI-level rules
    src = last.select("station_id", "claim_no", F.col("kpi").alias("source"), F.col("arrow").alias("sa")).join(r, "source")
    tgt = last.select("station_id", "claim_no", F.col("kpi").alias("target"), F.col("arrow").alias("ta"))
    same = F.col("sa") == F.col("ta")
    bad = F.when(F.col("coupling") == "positive", ~same).otherwise(same)
    return src.join(tgt, ["station_id", "claim_no", "target"]).filter(bad)


def verify_claims(
    claims: DataFrame,
    causes: DataFrame,
    rules: DataFrame,
    grounded: DataFrame,
    kpis: list[str],
    graph_hits: bool = False,
) -> DataFrame:
    """Check claims (station_id, claim_no, claim, environment_type) against what is known.

    causes is (station_id, src, tgt); grounded lists stations with parsed surroundings. A claim is
    supported when the graph was consulted for a KPI it names, or when it names a KPI and no arrow
    in it contradicts a rule.
    """
    known = causes.select("station_id", "src", "tgt").distinct().withColumn("_k", F.lit(1))
    pairs = (
        claim_pairs(claims, kpis)
        .join(known, ["station_id", "src", "tgt"], "left")
        .groupBy("station_id", "claim_no")
        .agg(F.count("*").alias("pairs"), F.count("_k").alias("pairs_verified"))
    )
    issues = directional_issues(claims, rules, kpis).groupBy("station_id", "claim_no").agg(F.count("*").alias("issues"))
    mentioned = F.filter(F.array(*[F.lit(k) for k in kpis]), lambda k: F.col("claim").contains(k))
    osm = has_any(F.lower("claim"), OSM_WORDS)
    g = grounded.select("station_id").distinct().withColumn("_g", F.lit(True))
    out = (
        claims.join(pairs, ["station_id", "claim_no"], "left")
        .join(issues, ["station_id", "claim_no"], "left")
        .join(g, "station_id", "left")
        .na.fill(0, ["pairs", "pairs_verified", "issues"])
        .withColumn("mentioned", mentioned)
    )
    named = F.size("mentioned") > 0
    return (
        out.withColumn("pairs_unsupported", F.col("pairs") - F.col("pairs_verified"))
        .withColumn("environment_warning", F.col("environment_type").isin("RMa", "InH") & F.col("claim").contains("POI"))
        .withColumn("osm_grounding", F.when(osm, F.when(F.coalesce("_g", F.lit(False)), "present").otherwise("missing")))
        .withColumn("supported", (F.lit(graph_hits) & named) | ((F.col("issues") == 0) & named))
        .drop("_g")
    )


def missing_kpis(events: DataFrame, covered: DataFrame) -> DataFrame:
    """KPIs with events that a report does not cover."""
    return events.select("station_id", "kpi").distinct().join(covered, ["station_id", "kpi"], "left_anti")


def title_parts(title: Column) -> Column:
    """(kpi, at) of a root-cause title `KPI: ... at WHEN (|z|...`; both null for other titles."""
    halves = F.split(title, ":", 2)
    kpi = F.get(halves, F.lit(0))
    rest = F.get(F.split(F.get(halves, F.lit(1)), "at", 2), F.lit(1))
    when = F.rtrim(F.regexp_replace(F.rtrim(F.substring_index(rest, "|z|", 1)), r"\($", ""))
    named = kpi.rlike(r"^\w+$") & rest.contains("|z|")
    return F.struct(F.when(named, kpi).alias("kpi"), F.when(named, F.ltrim(when)).alias("at"))


def rca_dedupe(reports: DataFrame) -> DataFrame:
    """Root-cause titles folded by KPI and hour window, with the days they occur on in order and the bullets of the first.

    An entry is a bold line and what follows it up to the next one; its lines that start with `- ` are its bullets. The
    days of a week bound the list that is gathered.
    """
    lines = F.split(section("report", 4), r"\n")
    numbered = reports.select(*ID, F.posexplode(lines).alias("pos", "line"))
    bold = F.trim(F.regexp_extract("line", r"^\*\*([^*]+?)\*\*", 1))
    entry = Window.partitionBy(*ID).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    marked = numbered.withColumn("title", F.nullif(bold, F.lit(""))).withColumn("entry", F.last(F.when(F.col("title").isNotNull(), F.col("pos")), ignorenulls=True).over(entry))
    point = F.when(F.trim("line").startswith("- "), F.struct("pos", F.trim(F.substring(F.trim("line"), 3, 1 << 30)).alias("said")))
    entries = marked.filter("entry is not null").groupBy(*ID, F.col("entry").alias("pos")).agg(
        F.max("title").alias("title"), F.transform(F.array_sort(F.collect_list(point)), lambda p: p["said"]).alias("bullets")
    )
    stable = F.lower("title").contains("stable") | F.lower("title").contains("no anomaly events")
    named = entries.filter(~stable).withColumn("_t", title_parts(F.col("title")))
    hour = F.nullif(F.regexp_extract("_t.at", r"(\d{2}:\d{2}\s*[–-]\s*\d{2}:\d{2})", 1), F.lit(""))
    keyed = named.withColumn("hour", F.when(F.col("_t.kpi").isNull(), "").otherwise(F.coalesce(hour, F.col("_t.at")))).withColumn("kpi", F.coalesce("_t.kpi", "title"))
    day = F.nullif(F.regexp_extract("title", r"Day\s*\d+\s*\(([A-Za-z]+)\)", 1), F.lit(""))
    per_day = keyed.withColumn("day", day).groupBy(*ID, "kpi", "hour", "day").agg(
        F.count("*").alias("n"), F.min_by(F.struct("title", "bullets"), "pos").alias("first"), F.min("pos").alias("pos")
    )
    days = F.array_sort(F.collect_list(F.when(F.col("day").isNotNull(), F.struct("pos", "day"))))
    return per_day.groupBy(*ID, "kpi", "hour").agg(
        F.sum("n").alias("n_events"),
        F.min_by("first.title", "pos").alias("title"),
        F.array_join(F.transform(days, lambda d: d["day"]), ", ").alias("days"),
        F.min_by("first.bullets", "pos").alias("bullets"),
    )
