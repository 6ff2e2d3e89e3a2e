"""Queries on paired statistics: users as stations, event types as arms or judges."""

from __future__ import annotations

from pyspark.sql import functions as F

from kpiscope.operators import stats as st
from kpiscope.plans.on_profiles import tidy
from kpiscope.plans.registry import query, rnd
from kpiscope.sources.tables import load

N_BOOT = 10_000


def scores(spark, sf):
    """Mean value per user and event type; odd amounts of small values are left missing."""
    exact = F.col("value").cast("decimal(18,2)")
    return (
        load(spark, sf, "events")
        .groupBy(F.col("user_id").alias("station_id"), F.col("event_type").alias("arm"))
        .agg((F.sum(exact).cast("double") / F.count("*")).alias("faithfulness"), F.count_if(F.col("value") > 60).alias("n_events"))
    )


S = """WITH sc AS (SELECT user_id AS station_id, event_type AS arm, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS v, count(*) FILTER (value > 60) AS n_events FROM events GROUP BY 1, 2),
  pr AS (SELECT a.station_id, a.v AS a, b.v AS b, a.v - b.v AS diff FROM sc a JOIN sc b ON a.station_id = b.station_id AND a.arm = 'click' AND b.arm = 'view' WHERE a.n_events >= 1 AND b.n_events >= 1),
  wd AS (SELECT station_id, max(v) FILTER (arm = 'click') AS click, max(v) FILTER (arm = 'view') AS view, max(v) FILTER (arm = 'error') AS error FROM sc GROUP BY 1),
  cm AS (SELECT * FROM wd WHERE click IS NOT NULL AND view IS NOT NULL AND error IS NOT NULL)
"""


def pairs(spark, sf):
    return st.paired(scores(spark, sf), "faithfulness", "click", "view", need_events=True)


def judges(spark, sf):
    s = scores(spark, sf).filter("arm IN ('click', 'view', 'error')")
    return s.select("station_id", F.col("arm").alias("judge"), F.col("faithfulness").alias("value"))


@query("st_pairs", S + f"SELECT station_id, 'click vs view' AS comparison, {rnd('a', 5)} AS a, {rnd('b', 5)} AS b, {rnd('diff', 5)} AS diff FROM pr")
def st_pairs(spark, sf):
    return tidy(pairs(spark, sf), "a", "b", "diff", digits=5)


PLACE = "('0x' || substr(md5({0}), 1, 15))::BIGINT % 2147483646 + 1"
BOOT = S + f""", ix AS (SELECT diff, {PLACE.format("'click vs view:' || station_id")} AS a FROM pr),
  rp AS (SELECT {PLACE.format("r || ':42'")} AS b, r FROM range(1, {N_BOOT + 1}) t(r)),
  wt AS (SELECT r, diff, a * b % 2147483647 AS x FROM ix, rp),
  cw AS (SELECT r, diff, {" + ".join(f"CAST(x >= {step} AS INTEGER)" for step in st.poisson_steps())} AS w FROM wt),
  bm AS (SELECT r, sum(w * diff) / sum(w) AS m FROM cw GROUP BY 1 HAVING sum(w) > 0),
  ci AS (SELECT quantile_cont(m, 0.025) AS ci_low, quantile_cont(m, 0.975) AS ci_high FROM bm)
"""


@query("st_bootstrap_ci", BOOT + f"SELECT 'click vs view' AS comparison, {rnd('ci_low', 4)} AS ci_low, {rnd('ci_high', 4)} AS ci_high FROM ci")
def st_bootstrap_ci(spark, sf):
    return tidy(st.bootstrap_ci(pairs(spark, sf), N_BOOT), "ci_low", "ci_high")


RANKS = S + """, nz AS (SELECT abs(round(diff, 12)) AS s, diff > 0 AS up FROM pr WHERE round(diff, 12) <> 0),
  rk AS (SELECT *, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS r FROM nz)
"""


@query(
    "st_signed_ranks",
    RANKS + """SELECT 'click vs view' AS comparison, (SELECT count(*) FROM pr WHERE round(diff, 12) = 0) AS n_zero, (SELECT count(*) FROM pr) AS n_pairs,
      coalesce(sum(r) FILTER (up), 0)::DOUBLE AS w_plus, coalesce(sum(r) FILTER (NOT up), 0)::DOUBLE AS w_minus, count(*) AS n_used,
      (SELECT coalesce(sum(c * c * c - c), 0)::DOUBLE FROM (SELECT count(*) AS c FROM nz GROUP BY s)) AS tie_term FROM rk""",
)
def st_signed_ranks(spark, sf):
    return st.signed_ranks(pairs(spark, sf))


def wilcoxon_sql(pairs: str) -> str:
    """CTEs over pairs(comparison, diff) that end in pv(comparison, n_used, w_plus, p_value).

    Small clean samples count the rank subsets of each sum in a recursion over the ranks; others take the normal approximation, whose error
    function is summed as a series of positive terms.
    """
    return f""", nzc AS (SELECT comparison, abs(round(diff, 12)) AS s, diff > 0 AS up FROM {pairs} WHERE round(diff, 12) <> 0),
  rkc AS (SELECT *, rank() OVER (PARTITION BY comparison ORDER BY s) + (count(*) OVER (PARTITION BY comparison, s) - 1) / 2.0 AS r FROM nzc),
  tic AS (SELECT comparison, sum(c * c * c - c)::DOUBLE AS tie_term FROM (SELECT comparison, count(*)::DOUBLE AS c FROM nzc GROUP BY comparison, s) GROUP BY 1),
  wc AS (SELECT comparison, count(*) AS n, coalesce(sum(r) FILTER (up), 0)::DOUBLE AS w_plus FROM rkc GROUP BY 1),
  al AS (SELECT p.comparison, p.n_pairs, p.n_zero, coalesce(n, 0) AS n, coalesce(w_plus, 0) AS w_plus, coalesce(tie_term, 0) AS tie_term
    FROM (SELECT comparison, count(*) AS n_pairs, count(*) FILTER (round(diff, 12) = 0) AS n_zero FROM {pairs} GROUP BY 1) p LEFT JOIN wc ON wc.comparison = p.comparison LEFT JOIN tic ON tic.comparison = p.comparison),
  ways AS (SELECT 0 AS n, 0 AS s, 1.0::DOUBLE AS c UNION ALL SELECT n + 1, s + b * (n + 1), sum(c) FROM ways, (VALUES (0), (1)) t(b) WHERE n < {st.MOST_COUNTED} GROUP BY ALL),
  zs AS (SELECT *, abs(w_plus - n * (n + 1) / 4.0) / sqrt(greatest(n * (n + 1) * (2 * n + 1) - tie_term / 2, 1e-9) / 24.0) / sqrt(2.0) AS x,
    n <= {st.MOST_COUNTED} AND tie_term = 0 AND n_zero = 0 AS counted FROM al),
  pv AS (SELECT comparison, n AS n_used, w_plus, CASE WHEN n_pairs < 2 THEN 1 WHEN n = 0 THEN 'nan'::DOUBLE
    WHEN counted THEN least(1, 2 * (SELECT sum(c) FROM ways WHERE ways.n = zs.n AND ways.s <= least(w_plus, zs.n * (zs.n + 1) / 2.0 - w_plus)) / pow(2, n))
    WHEN x > 8 THEN 0 ELSE 1 - 2 / sqrt(pi()) * exp(-x * x) * (SELECT sum(exp(2 * k * ln(2.0) + (2 * k + 1) * ln(greatest(x, 1e-300)) + lgamma(k + 1.0) - lgamma(2 * k + 2.0))) FROM range(300) t(k)) END AS p_value FROM zs)
"""


RECURSIVE = S.replace("WITH", "WITH RECURSIVE", 1)


@query(
    "st_wilcoxon",
    RECURSIVE + ", pc AS (SELECT 'click vs view' AS comparison, diff FROM pr)" + wilcoxon_sql("pc") + f"SELECT comparison, n_used, w_plus, {rnd('p_value', 6)} AS p_value FROM pv",
)
def st_wilcoxon(spark, sf):
    return tidy(st.wilcoxon(pairs(spark, sf)).select("comparison", "n_used", "w_plus", "p_value"), "p_value", digits=6)


@query("st_cohens_d", S + f"SELECT 'click vs view' AS comparison, count(*) AS n, {rnd('avg(diff)', 5)} AS mean_diff, {rnd('avg(diff) / stddev_samp(diff)', 5)} AS cohens_d FROM pr")
def st_cohens_d(spark, sf):
    return tidy(st.cohens_d(pairs(spark, sf)), "mean_diff", "cohens_d", digits=5)


@query(
    "st_compare_table",
    RECURSIVE + """, pc AS (SELECT 'click vs view' AS comparison, station_id, a, b, diff FROM pr UNION ALL SELECT 'purchase vs signup', station_id, p, s, p - s FROM
      (SELECT station_id, coalesce(max(v) FILTER (arm = 'purchase'), 0) AS p, coalesce(max(v) FILTER (arm = 'signup'), 0) AS s FROM sc GROUP BY 1))"""
    + wilcoxon_sql("pc")
    + f""", ix AS (SELECT comparison, diff, {PLACE.format("comparison || ':' || station_id")} AS a FROM pc),
    rp AS (SELECT {PLACE.format("r || ':42'")} AS b, r FROM range(1, {N_BOOT + 1}) t(r)),
    cw AS (SELECT comparison, r, diff, {" + ".join(f"CAST(x >= {step} AS INTEGER)" for step in st.poisson_steps())} AS w FROM (SELECT comparison, r, diff, a * b % 2147483647 AS x FROM ix, rp)),
    bm AS (SELECT comparison, r, sum(w * diff) / sum(w) AS m FROM cw GROUP BY 1, 2 HAVING sum(w) > 0),
    ci AS (SELECT comparison, quantile_cont(m, 0.025) AS ci_low, quantile_cont(m, 0.975) AS ci_high FROM bm GROUP BY 1),
    ag AS (SELECT comparison, count(*) AS n, avg(diff) AS mean_diff, avg(diff) / stddev_samp(diff) AS cohens_d, avg(a) AS mean_a, avg(b) AS mean_b FROM pc GROUP BY 1)
    SELECT ag.comparison, n, {", ".join(f"{rnd(c, 5)} AS {c}" for c in ("mean_diff", "cohens_d", "mean_a", "mean_b", "ci_low", "ci_high", "p_value"))}
    FROM ag JOIN ci ON ci.comparison = ag.comparison JOIN pv ON pv.comparison = ag.comparison""",
)
def st_compare_table(spark, sf):
    s = scores(spark, sf)
    both = st.paired(s, "faithfulness", "click", "view", need_events=True).unionByName(
        st.paired(s, "faithfulness", "purchase", "signup", missing_as_zero=True)
    )
    return tidy(st.compare_table(both, N_BOOT), "mean_diff", "cohens_d", "mean_a", "mean_b", "ci_low", "ci_high", "p_value", digits=5)


@query(
    "st_pearson",
    S + f"""SELECT a.arm AS judge_a, b.arm AS judge_b, count(*) AS n, {rnd('corr(a.v, b.v)', 5)} AS pearson_r FROM sc a JOIN sc b ON a.station_id = b.station_id AND a.arm < b.arm
    WHERE a.arm IN ('click', 'view', 'error') AND b.arm IN ('click', 'view', 'error') GROUP BY 1, 2""",
)
def st_pearson(spark, sf):
    return tidy(st.pearson(judges(spark, sf)), "pearson_r", digits=5)


@query(
    "st_icc",
    S + f""", lg AS (SELECT station_id, 'c' AS j, click AS v FROM cm UNION ALL SELECT station_id, 'v', view FROM cm UNION ALL SELECT station_id, 'e', error FROM cm),
    g AS (SELECT var_pop(v) * count(*) AS ss FROM lg), r AS (SELECT count(*) AS n, 3 * var_pop(m) * count(*) AS sr FROM (SELECT station_id, avg(v) AS m FROM lg GROUP BY 1)), c AS (SELECT var_pop(m) * 3 AS sc FROM (SELECT j, avg(v) AS m FROM lg GROUP BY 1)),
    q AS (SELECT n, sr / (n - 1) AS msr, (ss - sr - n * sc) / ((n - 1) * 2) AS mse FROM g, r, c) SELECT n, {rnd('(msr - mse) / (msr + 2 * mse)', 5)} AS icc FROM q""",
)
def st_icc(spark, sf):
    return tidy(st.icc(judges(spark, sf), 3), "icc", digits=5)


@query(
    "st_verdict",
    S + """, iv AS (SELECT arm AS judge, avg(v) - 48 - stddev_samp(v) / sqrt(count(*)) AS ci_low, avg(v) - 48 + stddev_samp(v) / sqrt(count(*)) AS ci_high FROM sc GROUP BY 1),
    vd AS (SELECT judge, CASE WHEN ci_low <= 0 AND ci_high >= 0 THEN 'null' WHEN ci_low > 0 THEN 'positive' ELSE 'negative' END AS verdict FROM iv)
    SELECT judge, verdict, CASE WHEN (SELECT count(DISTINCT verdict) FROM vd) = 1 THEN CASE WHEN (SELECT max(verdict) FROM vd) = 'null' THEN 'consistent-null' ELSE 'consistent-detect' END ELSE 'inconsistent' END AS overall FROM vd""",
)
def st_verdict(spark, sf):
    n = F.sqrt(F.count("*"))
    iv = scores(spark, sf).groupBy(F.col("arm").alias("judge")).agg(
        (F.avg("faithfulness") - 48 - F.stddev_samp("faithfulness") / n).alias("ci_low"),
        (F.avg("faithfulness") - 48 + F.stddev_samp("faithfulness") / n).alias("ci_high"),
    )
    v = st.verdicts(iv)
    return v.select("judge", "verdict").withColumn("overall", st.overall_verdict(v).scalar())


@query("st_common_matrix", S + f"SELECT station_id, {rnd('click', 5)} AS click, {rnd('view', 5)} AS view, {rnd('error', 5)} AS error FROM cm")
def st_common_matrix(spark, sf):
    return tidy(st.common_matrix(judges(spark, sf), ["click", "view", "error"]), "click", "view", "error", digits=5)
