"""Queries on report audits and judge answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from kpiscope.functions.exprs import small_table
from kpiscope.operators import audit as au
from kpiscope.operators import judge as jd
from kpiscope.operators import metrics as acc
from kpiscope.operators import profiles
from kpiscope.plans import inputs as src
from kpiscope.plans.on_graph import RULES
from kpiscope.plans.on_metrics import SCORES
from kpiscope.plans.on_profiles import tidy
from kpiscope.plans.registry import query, rnd
from kpiscope.sources.tables import PANEL_KPIS, load

KPIS = list(PANEL_KPIS)


def report_base(spark, sf):
    """One report per document: fixed tables filled with numbers of the document, and its whole text."""
    a, m = F.col("n_chars") % 97, F.col("doc_id") % 5
    return load(spark, sf, "documents").select(
        "doc_id",
        F.floor(F.col("doc_id") / 2).alias("station_id"),
        (F.col("doc_id") % 2).alias("arm"),
        a.alias("a"),
        m.alias("m"),
        F.translate("text", "|\n\r", "   ").alias("clean"),
    )


def reports(spark, sf):
    a, m = F.col("a"), F.col("m")
    day = F.element_at(F.array(*[F.lit(d) for d in ("Mon", "Tue", "Wed", "Thu", "Fri")]), (m + 1).cast("int"))
    sign = F.when(m == 0, "positive").when(m == 1, "negative").otherwise("increase and decrease")
    pieces = [
        "# Report\n\n## §1 Forecast\n| KPI | Unit | Min / Mean / Max | Baseline | sMAPE |\n|---|---|---|---|---|\n| click | n | ",
        a, ".50 / ", a + 1, ".25 / ", a + 2, ".00 | baseline ", a, ".75 | sMAPE 12.5% |\n| view | n | 1.00 / x / ", a, ".10 | n/a | MASE 0.", m,
        " |\n| other | n | 1 / 2 / 3 | - | - |\n## §2 Coupling\n| Source → Target | Coupling | Mechanism |\n|---|---|---|\n| click → purchase | ",
        sign, " | per 3GPP TS 28.552 §5.1.", m, " |\n| error → view | ", F.when(F.col("arm") == 0, "decrease").otherwise("positive"), " | see TS 38.", m + 100,
        " |\n## §3 Spatial\nurban area ", a, "\n## §4 Anomalies\n**click: +", m, "% spike at Day ", m + 1, " (", day, ") 08:00–09:00 (|z|=", m,
        ".25)**\n- click rises with load [Anomaly] and [Sensitivity] here\n- error moves [Sensitivity-Local: click ← error, negligible] ",
        F.col("clean"), "\n**click: +9% spike at Day 7 (Sun) 08:00–09:00 (|z|=", a, ".10)**\n**view is stable**\n## §5 Actions\n| Action | Priority | Note |\n|---|---|---|\n| ",
        F.col("clean"), " | high | now |\n",
    ]
    text = F.concat(*[p.cast("string") if not isinstance(p, str) else F.lit(p) for p in pieces])
    return report_base(spark, sf).select("station_id", "arm", text.alias("report"))


R = """WITH rb AS (SELECT doc_id, doc_id // 2 AS station_id, doc_id % 2 AS arm, n_chars % 97 AS a, doc_id % 5 AS m, translate(text, '|' || chr(10) || chr(13), '   ') AS clean FROM documents),
  tb AS (SELECT station_id, a, m FROM rb WHERE arm = 0)
"""


#: The whole report of every document, as text, and its sections as SQL cuts them out of it.
TEXT = R + """, rt AS (SELECT station_id, arm, '# Report

## §1 Forecast
| KPI | Unit | Min / Mean / Max | Baseline | sMAPE |
|---|---|---|---|---|
| click | n | ' || a || '.50 / ' || (a + 1) || '.25 / ' || (a + 2) || '.00 | baseline ' || a || '.75 | sMAPE 12.5% |
| view | n | 1.00 / x / ' || a || '.10 | n/a | MASE 0.' || m || ' |
| other | n | 1 / 2 / 3 | - | - |
## §2 Coupling
| Source → Target | Coupling | Mechanism |
|---|---|---|
| click → purchase | ' || CASE m WHEN 0 THEN 'positive' WHEN 1 THEN 'negative' ELSE 'increase and decrease' END || ' | per 3GPP TS 28.552 §5.1.' || m || ' |
| error → view | ' || CASE WHEN arm = 0 THEN 'decrease' ELSE 'positive' END || ' | see TS 38.' || (m + 100) || ' |
## §3 Spatial
urban area ' || a || '
## §4 Anomalies
**click: +' || m || '% spike at Day ' || (m + 1) || ' (' || ['Mon', 'Tue', 'Wed', 'Thu', 'Fri'][m + 1] || ') 08:00–09:00 (|z|=' || m || '.25)**
- click rises with load [Anomaly] and [Sensitivity] here
- error moves [Sensitivity-Local: click ← error, negligible] ' || clean || '
**click: +9% spike at Day 7 (Sun) 08:00–09:00 (|z|=' || a || '.10)**
**view is stable**
## §5 Actions
| Action | Priority | Note |
|---|---|---|
| ' || clean || ' | high | now |
' AS report FROM rb),
  cut AS (SELECT station_id, arm, unnest(p) AS part, generate_subscripts(p, 1) AS no, len(p) AS total FROM (SELECT *, string_split(report, chr(10) || '## §') AS p FROM rt)),
  sect AS (SELECT station_id, arm, no, '§' || part[1] AS tag, '## §' || part || CASE WHEN no < total THEN chr(10) ELSE '' END AS text FROM cut WHERE no > 1)
"""


@query("au_sections", TEXT + "SELECT station_id, arm, tag, length(text) AS n, md5(text) AS text_md5 FROM sect")
def au_sections(spark, sf):
    return au.sections(reports(spark, sf)).select("station_id", "arm", "tag", F.length("text").cast("long").alias("n"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query(
    "au_table_rows",
    R + "SELECT station_id, arm, 'click' AS kpi, 5 AS cells, a || '.50 / ' || (a + 1) || '.25 / ' || (a + 2) || '.00' AS span FROM rb UNION ALL SELECT station_id, arm, 'view', 5, '1.00 / x / ' || a || '.10' FROM rb UNION ALL SELECT station_id, arm, 'other', 5, '1 / 2 / 3' FROM rb",
)
def au_table_rows(spark, sf):
    c = F.col("cells")
    return au.table_rows(reports(spark, sf), 1).select("station_id", "arm", c[0].alias("kpi"), F.size(c).alias("cells"), c[2].alias("span"))


def known_specs(spark, sf):
    k = F.col("n_nationkey")
    spec = F.when(k == 0, "TS 28.552").otherwise(F.concat(F.lit("TS 38."), (k + 100).cast("string")))
    return load(spark, sf, "nation").filter((k == 0) | (k % 2 == 1)).select(spec.alias("spec"))


@query(
    "au_spec_citations",
    R + """, c AS (SELECT station_id, arm, 'TS 28.552 §5.1.' || m AS citation, true AS in_graph FROM rb UNION ALL SELECT station_id, arm, 'TS 38.' || (m + 100), m % 2 = 1 FROM rb
      UNION ALL SELECT station_id, arm, 'TS ' || ts, false FROM (SELECT station_id, arm, unnest(regexp_extract_all(clean, '(?i)TS\\s*(\\d{2}\\.\\d{3})', 1)) AS ts FROM rb, range(2)))
    SELECT station_id, arm, count(*) AS citations, count(*) FILTER (in_graph) AS in_graph, count(*) FILTER (NOT in_graph) AS hallucinated,
      count(DISTINCT CASE WHEN NOT in_graph THEN split_part(citation, ' §', 1) END) AS hallucinated_specs FROM c GROUP BY 1, 2""",
)
def au_spec_citations(spark, sf):
    return au.citation_counts(au.audit_citations(reports(spark, sf), known_specs(spark, sf)))


@query(
    "au_truth_table",
    SCORES + f""", s AS (SELECT station_id, kpi, min(pred) AS mn, avg(pred) AS mean, max(pred) AS mx FROM fc GROUP BY 1, 2),
    b AS (SELECT station_id, kpi, avg(value) AS b FROM panel WHERE t >= 384 AND t < 552 GROUP BY 1, 2),
    j AS (SELECT s.*, b.b, m.smape, m.mase, m.mae, m.rmse FROM s JOIN b ON s.station_id = b.station_id AND s.kpi = b.kpi JOIN met m ON m.station_id = s.station_id AND m.kpi = s.kpi)
    SELECT * FROM (SELECT station_id, kpi, 'forecast_min' AS field, {rnd('mn', 2)} AS truth FROM j UNION ALL SELECT station_id, kpi, 'forecast_mean', {rnd('mean', 2)} FROM j UNION ALL SELECT station_id, kpi, 'forecast_max', {rnd('mx', 2)} FROM j
      UNION ALL SELECT station_id, kpi, 'baseline_mean', {rnd('b', 2)} FROM j UNION ALL SELECT station_id, kpi, 'change_pct', {rnd('CASE WHEN abs(b) > 1e-8 THEN (mean - b) / abs(b) * 100 END', 2)} FROM j
      UNION ALL SELECT station_id, kpi, 'smape', {rnd('smape', 4)} FROM j UNION ALL SELECT station_id, kpi, 'mase', {rnd('mase', 4)} FROM j
      UNION ALL SELECT station_id, kpi, 'mae', {rnd('mae', 4)} FROM j UNION ALL SELECT station_id, kpi, 'rmse', {rnd('rmse', 4)} FROM j) WHERE truth IS NOT NULL""",
)
def au_truth_table(spark, sf):
    metrics = acc.score(src.scored(spark, sf), acc.season_scale(src.inputs(spark, sf)))
    return au.truth_table(profiles.forecast_summary(src.forecast(spark, sf), src.baseline(spark, sf)), metrics)


def truth(spark, sf):
    """What the first report of each station quotes, so the second one mostly misses it."""
    a = F.col("a")
    rows = [
        ("click", "forecast_min", a + 0.5),
        ("click", "forecast_mean", a + 1.25),
        ("click", "baseline_mean", a + 0.75),
        ("click", "smape", F.lit(12.5)),
        ("view", "mase", F.lit(0.2)),
    ]
    cells = F.array(*[F.struct(F.lit(k).alias("kpi"), F.lit(f).alias("field"), v.cast("double").alias("truth")) for k, f, v in rows])
    return report_base(spark, sf).filter("arm = 0").select("station_id", F.inline(cells))


def z_pool(spark, sf):
    zs = F.array((F.col("m") + 0.25).cast("double"), (-(F.col("a") + 0.5)).cast("double"))
    return report_base(spark, sf).filter("arm = 0").select("station_id", F.explode(zs).alias("z_score"))


CLAIMS = R + f""", fcl AS (SELECT station_id, arm, 'click' AS kpi, 'forecast_min' AS field, a + 0.5::DOUBLE AS claimed FROM rb UNION ALL SELECT station_id, arm, 'click', 'forecast_mean', a + 1.25::DOUBLE FROM rb
    UNION ALL SELECT station_id, arm, 'click', 'forecast_max', a + 2.0::DOUBLE FROM rb UNION ALL SELECT station_id, arm, 'click', 'baseline_mean', a + 0.75::DOUBLE FROM rb UNION ALL SELECT station_id, arm, 'click', 'smape', 12.5::DOUBLE FROM rb
    UNION ALL SELECT station_id, arm, 'view', 'mase', m / 10.0::DOUBLE FROM rb),
  tru AS (SELECT station_id, 'click' AS kpi, 'forecast_min' AS field, a + 0.5::DOUBLE AS truth FROM tb UNION ALL SELECT station_id, 'click', 'forecast_mean', a + 1.25::DOUBLE FROM tb UNION ALL SELECT station_id, 'click', 'baseline_mean', a + 0.75::DOUBLE FROM tb
    UNION ALL SELECT station_id, 'click', 'smape', 12.5::DOUBLE FROM tb UNION ALL SELECT station_id, 'view', 'mase', 0.2::DOUBLE FROM tb),
  zp AS (SELECT station_id, m + 0.25::DOUBLE AS t FROM tb UNION ALL SELECT station_id, a + 0.5::DOUBLE FROM tb),
  zq AS (SELECT station_id, arm, 0 AS claim_no, m + 0.25::DOUBLE AS claimed FROM rb UNION ALL SELECT station_id, arm, 1, a + 0.1::DOUBLE FROM rb),
  zc AS (SELECT station_id, arm, claim_no, claimed, t AS truth FROM (SELECT q.*, t, row_number() OVER (PARTITION BY q.station_id, q.arm, claim_no ORDER BY abs(claimed - t), t) AS r FROM zq q JOIN zp ON zp.station_id = q.station_id) WHERE r = 1),
  jc AS (SELECT f.station_id, f.arm, f.kpi, f.field, claimed, truth FROM fcl f LEFT JOIN tru t ON t.station_id = f.station_id AND t.kpi = f.kpi AND t.field = f.field
    UNION ALL SELECT station_id, arm, '', 'z_score', claimed, truth FROM zc),
  jv AS (SELECT *, CASE WHEN truth IS NULL THEN 'unverifiable' WHEN abs(claimed - truth) <= greatest(0.01, 0.01 * abs(truth)) THEN 'match' ELSE 'mismatch' END AS verdict FROM jc),
  fa AS (SELECT station_id, arm, count(*) FILTER (verdict = 'match') AS matches, count(*) FILTER (verdict = 'mismatch') AS mismatches, count(*) FILTER (verdict = 'unverifiable') AS unverifiable FROM jv GROUP BY 1, 2)
"""


def judged(spark, sf):
    return au.judged_claims(reports(spark, sf), truth(spark, sf), z_pool(spark, sf), KPIS)


@query("au_forecast_claims", CLAIMS + f"SELECT station_id, arm, kpi, field, {rnd('claimed', 4)} AS claimed FROM fcl")
def au_forecast_claims(spark, sf):
    return tidy(au.forecast_claims(reports(spark, sf), KPIS), "claimed")


@query("au_z_claims", CLAIMS + f"SELECT station_id, arm, CAST(claim_no AS INTEGER) AS claim_no, {rnd('claimed', 4)} AS claimed, {rnd('truth', 4)} AS truth FROM zc")
def au_z_claims(spark, sf):
    return tidy(au.z_claims(reports(spark, sf), z_pool(spark, sf)).drop("field"), "claimed", "truth")


@query("au_faithfulness", CLAIMS + f"SELECT *, {rnd('matches / (matches + mismatches)', 6)} AS ratio FROM fa")
def au_faithfulness(spark, sf):
    return tidy(au.faithfulness(judged(spark, sf)), "ratio", digits=6)


def sens_global(spark, sf):
    m = F.col("m")
    cells = [
        ("click", "purchase", "mean", (m - 2) * 0.1),
        ("click", "purchase", "variance", F.lit(0.05)),
        ("click", "purchase", "trend", F.lit(-0.01)),
        ("error", "view", "mean", F.lit(-0.3)),
        ("error", "view", "variance", F.lit(0.0)),
        ("error", "view", "trend", F.lit(0.0)),
        ("signup", "purchase", "mean", m * 0.1),
    ]
    rows = F.array(
        *[F.struct(F.lit(s).alias("src"), F.lit(t).alias("tgt"), F.lit(p).alias("ptype"), v.cast("double").alias("s_norm")) for s, t, p, v in cells]
    )
    return report_base(spark, sf).filter("arm = 0").select("station_id", F.inline(rows))


def sens_local(spark, sf):
    m = F.col("m")
    cells = [("click", F.lit(0.5)), ("error", m * 0.1), ("purchase", F.lit(-0.2)), ("signup", F.lit(0.15)), ("view", F.lit(0.1))]
    rows = F.array(*[F.struct(F.lit(k).alias("src"), v.cast("double").alias("s_norm")) for k, v in cells])
    return report_base(spark, sf).filter("arm = 0").select("station_id", F.lit(0).alias("event_idx"), F.inline(rows))


SENS = CLAIMS + """, sm AS (SELECT station_id, m FROM tb),
  se AS (SELECT r.station_id, r.arm,
    CASE WHEN r.m >= 2 THEN CASE WHEN r.arm = 0 THEN 1.0 ELSE 0.0 END ELSE ((CASE WHEN r.arm = 0 THEN 1 ELSE 0 END) + (CASE WHEN (CASE r.m WHEN 0 THEN 1 ELSE -1 END) = (CASE WHEN t.m >= 2 THEN 1 ELSE -1 END) THEN 1 ELSE 0 END)) / 2.0 END::DOUBLE AS directional_global,
    CASE WHEN t.m >= 2 THEN 1.0 ELSE 0.0 END::DOUBLE AS directional_local, CASE WHEN t.m >= 2 THEN 0.0 ELSE 1.0 END::DOUBLE AS top1_recall, 2 AS citations, 1 AS unsupported
    FROM rb r JOIN sm t ON t.station_id = r.station_id)
"""


def sens_scores(spark, sf):
    return au.audit_sensitivity(reports(spark, sf), sens_global(spark, sf), sens_local(spark, sf), KPIS, ("mean", "variance", "trend"))


@query("au_sensitivity", SENS + "SELECT * FROM se")
def au_sensitivity(spark, sf):
    return sens_scores(spark, sf)


@query(
    "au_result_line",
    SENS + """, p AS (SELECT *, (CASE WHEN directional_global >= 0.5 THEN 1 ELSE 0 END) + (CASE WHEN directional_local >= 0.5 THEN 1 ELSE 0 END) + (CASE WHEN top1_recall >= 1 THEN 1 ELSE 0 END) + 1 AS passed FROM se)
    SELECT p.station_id, p.arm, matches + passed AS verified, matches + mismatches + 5 AS total, '**Result: ' || (matches + passed) || '/' || (matches + mismatches + 5) || ' match**' AS line,
      CAST(matches + passed AS INTEGER) AS parsed_verified FROM p JOIN fa ON fa.station_id = p.station_id AND fa.arm = p.arm""",
)
def au_result_line(spark, sf):
    line = au.result_line(au.faithfulness(judged(spark, sf)), au.sensitivity_passes(sens_scores(spark, sf)))
    return line.withColumn("parsed_verified", au.parse_result_line("line")["verified"])


SIGN = "CASE m WHEN 0 THEN 'positive' WHEN 1 THEN 'negative' ELSE 'increase and decrease' END"


@query(
    "cl_atomic_claims",
    R + f""", c AS (SELECT station_id, arm, 0 AS o, '(Source → Target → Coupling) Mechanism' AS claim FROM rb UNION ALL SELECT station_id, arm, 1, '(click → purchase → ' || {SIGN} || ') per 3GPP TS 28.552 §5.1.' || m FROM rb
      UNION ALL SELECT station_id, arm, 2, '(error → view → ' || CASE WHEN arm = 0 THEN 'decrease' ELSE 'positive' END || ') see TS 38.' || (m + 100) FROM rb
      UNION ALL SELECT station_id, arm, 3, 'click rises with load and here' FROM rb
      UNION ALL SELECT station_id, arm, 4, regexp_replace(trim('error moves  ' || clean), '\\s{{2,}}', ' ', 'g') FROM rb
      UNION ALL SELECT station_id, arm, 5, trim(clean) FROM rb WHERE NOT regexp_matches(trim(clean), '^[-: ]+$') AND lower(trim(clean)) NOT IN ('action', 'priority', ''))
    SELECT station_id, arm, CAST(row_number() OVER (PARTITION BY station_id, arm ORDER BY o) - 1 AS INTEGER) AS claim_no, length(claim) AS n, md5(claim) AS claim_md5 FROM c WHERE length(claim) >= 10""",
)
def cl_atomic_claims(spark, sf):
    return au.atomic_claims(reports(spark, sf)).select(
        "station_id", "arm", "claim_no", F.length("claim").cast("long").alias("n"), F.md5("claim").alias("claim_md5")
    )


@query(
    "cl_evidence",
    TEXT + "SELECT station_id, arm, CAST(no - 2 AS INTEGER) AS context_no, length(t) AS n, md5(t) AS context_md5 FROM (SELECT *, rtrim(text, chr(10)) AS t FROM sect WHERE tag IN ('§1', '§2', '§3'))",
)
def cl_evidence(spark, sf):
    return au.evidence_contexts(reports(spark, sf)).select(
        "station_id", "arm", "context_no", F.length("context").cast("long").alias("n"), F.md5(F.col("context").cast("binary")).alias("context_md5")
    )


@query(
    "cl_rca_dedupe",
    R + """SELECT station_id, arm, 'click' AS kpi, '08:00–09:00' AS hour, 2 AS n_events, 'click: +' || m || '% spike at Day ' || (m + 1) || ' (' || ['Mon', 'Tue', 'Wed', 'Thu', 'Fri'][m + 1] || ') 08:00–09:00 (|z|=' || m || '.25)' AS title,
      ['Mon', 'Tue', 'Wed', 'Thu', 'Fri'][m + 1] || ', Sun' AS days,
      md5('click rises with load [Anomaly] and [Sensitivity] here / ' || trim('error moves [Sensitivity-Local: click ← error, negligible] ' || clean)) AS bullets_md5 FROM rb""",
)
def cl_rca_dedupe(spark, sf):
    out = au.rca_dedupe(reports(spark, sf))
    return out.withColumn("bullets_md5", F.md5(F.array_join("bullets", " / "))).drop("bullets")


def claims(spark, sf):
    k = F.array(*[F.lit(x) for x in KPIS])
    turn, conv = F.col("turn"), F.col("conv_id")
    s = F.element_at(k, (turn % 5 + 1).cast("int"))
    t = F.element_at(k, ((turn + 1 + conv % 3) % 5 + 1).cast("int"))
    text = F.concat(
        F.lit("Because "), s, F.lit(" -> "), t, F.lit(" we see "), s, F.lit("↑ "), t, F.when(conv % 2 == 0, "↓").otherwise("↑"),
        F.lit(" near "), F.when(F.col("role") == "user", "urban POI").otherwise("open field"),
    )
    env = F.when(conv % 3 == 0, "RMa").when(conv % 3 == 1, "InH").otherwise("UMa")
    return load(spark, sf, "conversations").select(conv.alias("station_id"), turn.alias("claim_no"), text.alias("claim"), env.alias("environment_type"))


@query(
    "cl_verify",
    """WITH k AS (SELECT ['click', 'error', 'purchase', 'signup', 'view'] AS k),
    c AS (SELECT conv_id AS station_id, turn AS claim_no, k[turn % 5 + 1] AS s, k[(turn + 1 + conv_id % 3) % 5 + 1] AS t, CASE WHEN conv_id % 2 = 0 THEN '↓' ELSE '↑' END AS ta, role, conv_id % 3 AS e FROM conversations, k),
    ca AS (SELECT DISTINCT conv_id AS station_id, k[turn % 5 + 1] AS s, k[(turn + 1) % 5 + 1] AS t FROM conversations, k WHERE role = 'user'),
    ru AS (SELECT * FROM (VALUES ('click', 'purchase', 'positive'), ('error', 'view', 'negative'), ('view', 'signup', 'positive'), ('signup', 'click', 'negative')) r(source, target, coupling)),
    i AS (SELECT c.*, (SELECT count(*) FROM ru WHERE ((ru.source = c.s AND ru.target = c.t) OR (ru.source = c.t AND ru.target = c.s)) AND (CASE WHEN coupling = 'positive' THEN c.ta <> '↑' ELSE c.ta = '↑' END)) AS issues FROM c)
    SELECT i.station_id, i.claim_no, 1 AS pairs, CASE WHEN ca.s IS NOT NULL THEN 1 ELSE 0 END AS pairs_verified, CASE WHEN ca.s IS NOT NULL THEN 0 ELSE 1 END AS pairs_unsupported, issues,
      e < 2 AND role = 'user' AS environment_warning, CASE WHEN role = 'user' THEN CASE WHEN i.station_id % 4 <> 0 THEN 'present' ELSE 'missing' END END AS osm_grounding, issues = 0 AS supported
    FROM i LEFT JOIN ca ON ca.station_id = i.station_id AND ca.s = i.s AND ca.t = i.t""",
)
def cl_verify(spark, sf):
    k = F.array(*[F.lit(x) for x in KPIS])
    conv = load(spark, sf, "conversations")
    turn = F.col("turn")
    causes = conv.filter("role = 'user'").select(
        F.col("conv_id").alias("station_id"),
        F.element_at(k, (turn % 5 + 1).cast("int")).alias("src"),
        F.element_at(k, ((turn + 1) % 5 + 1).cast("int")).alias("tgt"),
    )
    rules = small_table(spark, [r[:3] for r in RULES], "source string, target string, coupling string")
    grounded = conv.filter("conv_id % 4 <> 0").select(F.col("conv_id").alias("station_id"))
    out = au.verify_claims(claims(spark, sf), causes, rules, grounded, KPIS)
    return out.select(
        "station_id", "claim_no", "pairs", "pairs_verified", "pairs_unsupported", "issues", "environment_warning", "osm_grounding", "supported"
    )


@query(
    "cl_missing_kpis",
    """WITH k AS (SELECT ['click', 'error', 'purchase', 'signup', 'view'] AS k), e AS (SELECT conv_id, k[turn % 5 + 1] AS kpi, role FROM conversations, k)
    SELECT DISTINCT conv_id AS station_id, kpi FROM e WHERE (conv_id, kpi) NOT IN (SELECT (conv_id, kpi) FROM e WHERE role = 'assistant')""",
)
def cl_missing_kpis(spark, sf):
    k = F.array(*[F.lit(x) for x in KPIS])
    e = load(spark, sf, "conversations").select(
        F.col("conv_id").alias("station_id"), F.element_at(k, (F.col("turn") % 5 + 1).cast("int")).alias("kpi"), "role"
    )
    return au.missing_kpis(e, e.filter("role = 'assistant'").select("station_id", "kpi"))


def answers(spark, sf):
    d = F.col("doc_id")
    n = 1 + 2 * F.col("quality") + 2 * (1 - F.col("toxic"))
    shown = F.when(d % 7 == 0, F.lit(6)).otherwise(n)
    obj = F.concat(
        F.lit('{"score": '), shown.cast("string"), F.lit(', "kpi_mention": '), n.cast("string"), F.lit(', "time_mention": "4", "mechanism": 9, "mitigation": '),
        shown.cast("string"), F.lit(', "rationale": "seen"}'),
    )
    text = F.when(d % 11 == 0, F.lit("no answer")).otherwise(F.concat(F.lit("Sure:\n```json\n"), obj, F.lit("\n```")))
    return load(spark, sf, "labels").select(
        F.floor(d / 10).alias("station_id"), (d % 2).alias("arm"), d.alias("claim_no"), text.alias("answer")
    )


J = """WITH an AS (SELECT doc_id // 10 AS station_id, doc_id % 2 AS arm, doc_id, doc_id % 11 <> 0 AS has, 1 + 2 * quality + 2 * (1 - toxic) AS n, CASE WHEN doc_id % 7 = 0 THEN 6 ELSE 1 + 2 * quality + 2 * (1 - toxic) END AS shown FROM labels),
  ps AS (SELECT *, CASE WHEN has AND shown BETWEEN 1 AND 5 THEN (shown - 1) / 4.0 END::DOUBLE AS score, CASE WHEN has THEN ((n - 1) / 4.0 + 0.75 + CASE WHEN shown BETWEEN 1 AND 5 THEN (shown - 1) / 4.0 ELSE 0 END) / 4 ELSE 0 END::DOUBLE AS alignment FROM an),
  fa AS (SELECT station_id, arm, avg(score) AS faithfulness, count(*) AS n_claims, count(score) AS n_scored FROM ps GROUP BY 1, 2),
  ar AS (SELECT d.station_id, d.arm, p.ar AS answer_relevancy, coalesce(p.n, 0) AS n_events FROM (SELECT DISTINCT doc_id // 10 AS station_id, doc_id % 2 AS arm FROM documents) d
    LEFT JOIN (SELECT station_id, arm, avg(alignment) AS ar, count(*) AS n FROM ps GROUP BY 1, 2) p ON p.station_id = d.station_id AND p.arm = d.arm),
  sc AS (SELECT ar.station_id, ar.arm, faithfulness, answer_relevancy, n_events FROM ar LEFT JOIN fa ON fa.station_id = ar.station_id AND fa.arm = ar.arm)
"""


def scores(spark, sf):
    a = answers(spark, sf)
    ids = load(spark, sf, "documents").select(F.floor(F.col("doc_id") / 10).alias("station_id"), (F.col("doc_id") % 2).alias("arm"))
    f = jd.faithfulness(jd.parse_answers(a))
    r = jd.answer_relevancy(ids, jd.parse_axes(a))
    return r.join(f, ["station_id", "arm"], "left").withColumn("arm", F.col("arm").cast("string"))


@query("jd_parse", J + "SELECT station_id, arm, doc_id AS claim_no, score, score IS NOT NULL AS parsed, CASE WHEN has THEN 'seen' END AS rationale FROM ps")
def jd_parse(spark, sf):
    return jd.parse_answers(answers(spark, sf)).drop("answer")


@query("jd_faithfulness", J + f"SELECT station_id, arm, {rnd('faithfulness', 5)} AS faithfulness, n_claims, n_scored FROM fa")
def jd_faithfulness(spark, sf):
    return tidy(jd.faithfulness(jd.parse_answers(answers(spark, sf))), "faithfulness", digits=5)


@query("jd_answer_relevancy", J + f"SELECT station_id, arm::VARCHAR AS arm, {rnd('answer_relevancy', 5)} AS answer_relevancy, n_events FROM ar")
def jd_answer_relevancy(spark, sf):
    return tidy(scores(spark, sf).select("station_id", "arm", "answer_relevancy", "n_events"), "answer_relevancy", digits=5)


@query(
    "jd_ragas",
    J + f"SELECT station_id, arm::VARCHAR AS arm, {rnd('CASE WHEN faithfulness <= 0 OR answer_relevancy <= 0 THEN 0 ELSE 2 / (1 / faithfulness + 1 / answer_relevancy) END', 5)} AS ragas FROM sc WHERE faithfulness IS NOT NULL",
)
def jd_ragas(spark, sf):
    s = scores(spark, sf).filter("faithfulness IS NOT NULL")
    return tidy(s.select("station_id", "arm", jd.harmonic("faithfulness", "answer_relevancy").alias("ragas")), "ragas", digits=5)


@query(
    "jd_arm_summary",
    J + f""", lg AS (SELECT station_id, arm::VARCHAR AS arm, 'faithfulness' AS metric, faithfulness AS value FROM sc WHERE faithfulness IS NOT NULL UNION ALL SELECT station_id, arm::VARCHAR, 'answer_relevancy', answer_relevancy FROM sc WHERE answer_relevancy IS NOT NULL),
    df AS (SELECT a.station_id, '1 - 0 (paired)' AS arm, a.metric, a.value - b.value AS value FROM lg a JOIN lg b ON a.station_id = b.station_id AND a.metric = b.metric AND a.arm = '1' AND b.arm = '0'),
    al AS (SELECT * FROM lg UNION ALL SELECT * FROM df)
    SELECT arm, metric, count(*) AS n, {rnd('avg(value)', 5)} AS mean, {rnd('coalesce(stddev_samp(value), 0)', 5)} AS stdev, {rnd('min(value)', 5)} AS min, {rnd('max(value)', 5)} AS max FROM al GROUP BY 1, 2""",
)
def jd_arm_summary(spark, sf):
    return tidy(jd.arm_summary(scores(spark, sf), "1", "0"), "mean", "stdev", "min", "max", digits=5)


@query(
    "jd_arm_wide",
    J + "SELECT station_id, " + ", ".join(f"{rnd(f'max(CASE WHEN arm = {a} THEN {m} END)', 5)} AS {m}_{a}" for m in ("faithfulness", "answer_relevancy") for a in (0, 1)) + " FROM sc GROUP BY 1",
)
def jd_arm_wide(spark, sf):
    out = jd.arm_wide(scores(spark, sf), ["0", "1"], ("faithfulness", "answer_relevancy"))
    return tidy(out, *[c for c in out.columns if c != "station_id"], digits=5)
