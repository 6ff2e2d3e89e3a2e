"""Paired statistics of report arms and judges.

Pairs are (comparison, station_id, a, b): values of the same station in two arms.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def paired(scores: DataFrame, metric: str, first: str, second: str, need_events: bool = False, missing_as_zero: bool = False) -> DataFrame:
    """Station-matched values of two arms.

    Missing values drop the station, or count as 0 where absence is the worst score. need_events
    keeps stations whose both arms saw at least one event.
    """

    def side(arm: str, c: str) -> Column:
        return F.max(F.when(F.col("arm") == arm, F.col(c)))

    aggs = [side(first, metric).alias("a"), side(second, metric).alias("b")]
    if need_events:
        aggs += [side(first, "n_events").alias("_ea"), side(second, "n_events").alias("_eb")]
    p = scores.groupBy("station_id").agg(*aggs)
    if missing_as_zero:
        p = p.na.fill(0.0, ["a", "b"])
    p = p.filter("a IS NOT NULL AND b IS NOT NULL")
    if need_events:
        p = p.filter("coalesce(_ea, 0) >= 1 AND coalesce(_eb, 0) >= 1").drop("_ea", "_eb")
    return p.withColumn("comparison", F.lit(f"{first} vs {second}")).withColumn("diff", F.col("a") - F.col("b"))


def cohens_d(pairs: DataFrame) -> DataFrame:
    """Mean difference over its sample deviation; undefined below two pairs."""
    s = pairs.groupBy("comparison").agg(
        F.count("*").alias("n"), F.avg("diff").alias("mean_diff"), F.stddev_samp("diff").alias("_sd"),
        (F.max("diff") == F.min("diff")).alias("_flat"),
    )
    m = F.col("mean_diff")
    flat = F.when(m == 0, 0.0).otherwise(F.signum(m) * float("inf"))
    d = F.when(F.col("n") < 2, F.lit(float("nan"))).when(F.col("_flat"), flat).otherwise(m / F.col("_sd"))
    return s.withColumn("cohens_d", d).drop("_sd", "_flat")


#: Prime below 2^31: products of two numbers under it fit a long.
PRIME = (1 << 31) - 1
#: Stations times resamples that are weighed at a time, and comparisons whose sums a task holds.
WEIGHED, MOST_HELD = 1 << 20, 256


def poisson_steps() -> list[int]:
    """Borders in 1..PRIME-1 between the counts 0, 1, 2, ... of a Poisson variable of mean 1."""
    total, part, out = 0.0, math.exp(-1), []
    for k in range(1, 13):
        total += part
        out.append(int(total * PRIME))
        part /= k
    return out


def _place(text: Column) -> Column:
    """A number in 1..PRIME-1 from a hash of a text."""
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long"), F.lit(PRIME - 1)) + 1


def resampled(pairs: DataFrame, n_boot: int = 10000, seed: int = 42) -> DataFrame:
    """(comparison, rep, n_drawn, mean): mean difference of every resample.

    A station is drawn a Poisson number of times in each resample, told by a hash of station and resample, so a lost task draws the same
    again and no station needs to know how many others there are. The draws are never rows: a task adds weights and weighted
    differences up in one array of n_boot numbers a comparison, and only these sums are shuffled. Resamples that drew nothing are left out.
    """
    keyed = pairs.select("comparison", _place(F.concat_ws(":", "comparison", F.col("station_id").cast("string"))).alias("place"), F.col("diff").cast("double").alias("diff"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reps = [int(hashlib.md5(f"{r}:{seed}".encode()).hexdigest()[:15], 16) % (PRIME - 1) + 1 for r in range(1, n_boot + 1)]
        by, steps, held = np.array(reps, dtype=np.int64), np.array(poisson_steps()), {}
        rows = max(1, WEIGHED // n_boot)

        def sums(name: str, parts: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([name] * n_boot), pa.array(np.arange(1, n_boot + 1), pa.int32()), pa.array(parts[0]), pa.array(parts[1])], names=["comparison", "rep", "drawn", "total"]
            )

        for batch in batches:
            place, diff = batch.column("place").to_numpy(), batch.column("diff").to_numpy(zero_copy_only=False)
            names = np.array(batch.column("comparison").to_pylist(), dtype=object)
            for name in dict.fromkeys(names):
                own = np.flatnonzero(names == name)
                if name not in held and len(held) >= MOST_HELD:
                    old = next(iter(held))
                    yield sums(old, held.pop(old))
                parts = held.setdefault(name, np.zeros((2, n_boot)))
                for start in range(0, len(own), rows):
                    at = own[start : start + rows]
                    weight = np.searchsorted(steps, place[at][:, None] * by % PRIME, side="right").astype(np.float64)
                    parts[0] += weight.sum(axis=0)
                    parts[1] += diff[at] @ weight
        for name, parts in held.items():
            yield sums(name, parts)

    added = keyed.mapInArrow(run, "comparison string, rep int, drawn double, total double").groupBy("comparison", "rep").agg(F.sum("drawn").alias("n_drawn"), F.sum("total").alias("total"))
    return added.filter("n_drawn > 0").select("comparison", "rep", F.col("n_drawn").cast("long").alias("n_drawn"), (F.col("total") / F.col("n_drawn")).alias("mean"))


def bootstrap_ci(pairs: DataFrame, n_boot: int = 10000, seed: int = 42, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Percentile interval of the mean difference from resampled stations."""
    means = resampled(pairs, n_boot, seed)
    return means.groupBy("comparison").agg(F.percentile("mean", F.lit(low)).alias("ci_low"), F.percentile("mean", F.lit(high)).alias("ci_high"))


def signed_ranks(pairs: DataFrame) -> DataFrame:
    """W+, W-, pairs used, zero differences and the tie term of the signed-rank test.

    Equal sizes are first merged into one row each; ranks are running counts over size classes of
    bounded number, then inside a class, so no task has to sort a whole comparison.
    """
    d = F.round(F.col("diff"), 12)
    zeros = pairs.groupBy("comparison").agg(F.count_if(d == 0).alias("n_zero"), F.count("*").alias("n_pairs"))
    sizes = (
        pairs.filter(d != 0)
        .groupBy("comparison", F.abs(d).alias("size"))
        .agg(F.count("*").alias("t"), F.count_if(d > 0).alias("up"))
        .withColumn("_c", F.floor(F.log2("size") * 32))
    )
    classes = sizes.groupBy("comparison", "_c").agg(F.sum("t").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("comparison").orderBy("_c")) - F.col("_n")
    classes = classes.select("comparison", "_c", before.alias("_before"))
    within = F.sum("t").over(Window.partitionBy("comparison", "_c").orderBy("size"))
    ranked = sizes.withColumn("_upto", within).join(classes, ["comparison", "_c"])
    rank = F.col("_before") + F.col("_upto") - F.col("t") + (F.col("t") + 1) / 2
    t = F.col("t").cast("double")
    w = ranked.groupBy("comparison").agg(
        F.sum(rank * F.col("up")).alias("w_plus"),
        F.sum(rank * (F.col("t") - F.col("up"))).alias("w_minus"),
        F.sum("t").alias("n_used"),
        F.sum(t * t * t - t).alias("tie_term"),
    )
    return zeros.join(w, "comparison", "left").na.fill(0.0, ["w_plus", "w_minus", "tie_term"]).na.fill(0, ["n_used"])


#: Up to so many pairs the p-value of clean samples is counted, if the method is left open.
MOST_COUNTED = 50


def _signed_rank_p(w_plus: float, n: int, tie_term: float, n_zero: int, method: str) -> float:
    """Two-sided p-value: exact count of rank subsets, or the normal approximation."""
    if n == 0:
        return float("nan")
    if method == "exact" or method == "auto" and n <= MOST_COUNTED and tie_term == 0 and n_zero == 0:
        ways = [1] + [0] * (n * (n + 1) // 2)
        for r in range(1, n + 1):
            for s in range(len(ways) - 1, r - 1, -1):
                ways[s] += ways[s - r]
        low = min(int(w_plus), len(ways) - 1 - int(w_plus))
        return min(1.0, 2 * sum(ways[: low + 1]) / 2**n)
    mean = n * (n + 1) / 4
    var = (n * (n + 1) * (2 * n + 1) - tie_term / 2) / 24
    return math.erfc(abs(w_plus - mean) / math.sqrt(var) / math.sqrt(2)) if var > 0 else float("nan")


def wilcoxon(pairs: DataFrame, method: str = "auto") -> DataFrame:
    """Signed-rank p-value per comparison; fewer than two pairs give 1.

    method is exact (right without ties), approx, or auto: exact for samples of up to MOST_COUNTED pairs without ties and zeros.
    """
    if method not in ("exact", "approx", "auto"):
        raise ValueError(f"unknown method: {method}")

    @F.pandas_udf("double")
    def p_value(w: pd.Series, n: pd.Series, tie: pd.Series, zero: pd.Series) -> pd.Series:
        return pd.Series([_signed_rank_p(float(a), int(b), float(c), int(d), method) for a, b, c, d in zip(w, n, tie, zero)])

    s = signed_ranks(pairs)
    return s.withColumn(
        "p_value", F.when(F.col("n_pairs") < 2, 1.0).otherwise(p_value("w_plus", "n_used", "tie_term", "n_zero"))
    )


def compare_table(pairs: DataFrame, n_boot: int = 10000, seed: int = 42) -> DataFrame:
    """All statistics per comparison; fewer than two pairs leave NaN."""
    means = pairs.groupBy("comparison").agg(F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"))
    out = (
        cohens_d(pairs)
        .join(means, "comparison")
        .join(bootstrap_ci(pairs, n_boot, seed), "comparison")
        .join(wilcoxon(pairs).select("comparison", "p_value"), "comparison")
    )
    nan = F.lit(float("nan"))
    for c in ("mean_diff", "ci_low", "ci_high", "p_value"):
        out = out.withColumn(c, F.when(F.col("n") < 2, nan).otherwise(F.col(c)))
    return out


def _clean(c: str) -> Column:
    return F.col(c).isNotNull() & ~F.isnan(c)


def pearson(scores: DataFrame) -> DataFrame:
    """Correlation of every judge pair over (station_id, judge, value)."""
    s = scores.filter(_clean("value"))
    a = s.select("station_id", F.col("judge").alias("judge_a"), F.col("value").alias("va"))
    b = s.select("station_id", F.col("judge").alias("judge_b"), F.col("value").alias("vb"))
    pairs = a.join(b, "station_id").filter("judge_a < judge_b")  # judges per station are few
    return pairs.groupBy("judge_a", "judge_b").agg(
        F.count("*").alias("n"), F.when(F.count("*") >= 2, F.corr("va", "vb")).alias("pearson_r")
    )


def icc(scores: DataFrame, n_judges: int) -> DataFrame:
    """Two-way consistency over stations that every judge scored.

    Sums of squares come from three grouped sums; nothing is arranged as a matrix.
    """
    complete = common_stations(scores, n_judges)
    s = scores.filter(_clean("value")).join(complete, "station_id", "left_semi")
    rows = s.groupBy("station_id").agg(F.avg("value").alias("rm"))
    cols = s.groupBy("judge").agg(F.avg("value").alias("cm"))
    g = s.agg(F.avg("value").alias("gm"), F.count("*").alias("cells"), (F.var_pop("value") * F.count("*")).alias("ss_total"))
    r = rows.agg(F.count("*").alias("n"), (F.var_pop("rm") * F.count("*")).alias("_sr"))
    c = cols.agg((F.var_pop("cm") * F.count("*")).alias("_sc"))
    one = F.lit(1)
    j = g.withColumn("_j", one).join(r.withColumn("_j", one), "_j").join(c.withColumn("_j", one), "_j")  # one row each
    k = F.lit(n_judges)
    ss_rows, ss_cols = k * F.col("_sr"), F.col("n") * F.col("_sc")
    ms_rows = ss_rows / (F.col("n") - 1)
    ms_error = (F.col("ss_total") - ss_rows - ss_cols) / ((F.col("n") - 1) * (k - 1))
    den = ms_rows + (k - 1) * ms_error
    ok = (F.col("n") >= 2) & (k >= 2) & (den != 0)
    return j.select("n", F.when(ok, (ms_rows - ms_error) / den).otherwise(float("nan")).alias("icc"))


def verdicts(intervals: DataFrame) -> DataFrame:
    """What an interval says per judge: null, positive, negative or nothing."""
    lo, hi = F.col("ci_low"), F.col("ci_high")
    v = (
        F.when(lo.isNull() | hi.isNull() | F.isnan(lo) | F.isnan(hi), "indeterminate")
        .when((lo <= 0) & (hi >= 0), "null")
        .when(lo > 0, "positive")
        .otherwise("negative")
    )
    return intervals.withColumn("verdict", v)


def overall_verdict(judged: DataFrame) -> DataFrame:
    """Do all judges agree? An undecidable interval counts as negative here, as comparisons with NaN fail."""
    v = F.when(F.col("verdict") == "indeterminate", "negative").otherwise(F.col("verdict"))
    s = judged.agg(F.array_sort(F.collect_set(v)).alias("set"))  # three values at most
    one = F.size("set") == 1
    return s.select(
        F.when(one & (F.col("set")[0] == "null"), "consistent-null").when(one, "consistent-detect").otherwise("inconsistent").alias("overall")
    )


def common_stations(scores: DataFrame, n_judges: int) -> DataFrame:
    """Stations every judge scored."""
    return (
        scores.filter(_clean("value")).groupBy("station_id").agg(F.count_distinct("judge").alias("_n")).filter(F.col("_n") == n_judges).select("station_id")
    )


def common_matrix(scores: DataFrame, judges: list[str]) -> DataFrame:
    """Station rows, judge columns, complete rows only."""
    cells = [F.max(F.when(F.col("judge") == j, F.col("value"))).alias(j) for j in judges]
    wide = scores.filter(_clean("value")).groupBy("station_id").agg(*cells)
    return wide.na.drop("any", subset=judges)


