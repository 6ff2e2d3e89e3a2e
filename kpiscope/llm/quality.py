"""Quality rules: a hashed n-gram log-likelihood ratio between a trusted target and the raw corpus, DataFrame functions only.

Words and pairs of words are hashed into BUCKETS. Two multinomials over the buckets, of the trusted documents and of all
documents, give each bucket a log ratio; a document's score is the mean over its n-grams. Ratios are whole numbers of
2^-20, so sums are exact and the verdict of every document is the same whatever the order of rows.

The counts cover all documents. The model has one number a bucket, whatever the corpus; it is the only thing collected.

Nulls: a null or empty text has no words and fails the base rules. Labels with a null id are ignored, repeated ones count once; without a
trusted document all ratios are 0 and only the base rules decide. Repeated documents are judged each. Extra columns
pass through; input columns named like the results are replaced, any other name is free. An empty table gives an empty table. A very long text
is one row of arrays as long as its words.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kpiscope.llm.shared import WORD, sheltered, words

BUCKETS = 1 << 18
SMOOTHING = 1.0
UNIT = 1 << 20
#: Mean log ratio of an n-gram that a document needs.
LEAST_SCORE = -0.45
#: Trusted ids up to this number (32 MB) are broadcast; more are joined by a shuffle.
MOST_BROADCAST_IDS = 4_000_000
RESULT = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score", "base_failed", "kept"]


def spread(h: Column, step: int) -> Column:
    """Hash of each element with the one `step` places on."""
    n = F.greatest(F.size(h) - step, F.lit(0))
    return F.zip_with(F.slice(h, 1, n), F.slice(h, step + 1, n), lambda a, b: F.xxhash64(a, b))


def bucket(h: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(h, F.lit(buckets)).cast("int")


def ngrams(df: DataFrame, text: str) -> DataFrame:
    """df with its words (_words), their hashes (_one) and those of pairs of neighbours (_two)."""
    df = df.withColumn("_words", words(F.col(text)))
    return df.withColumn("_one", F.transform("_words", lambda w: F.xxhash64(w))).withColumn("_two", spread(F.col("_one"), 1))


def fit(docs: DataFrame, trusted: DataFrame, text: str = "text", buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> list[int]:
    """Log ratio of each bucket in UNIT. trusted: doc_id of the trusted documents."""
    ids = trusted.select("doc_id").filter("doc_id is not null").distinct()
    n = ids.count()
    ids = ids.withColumn("_trusted", F.lit(1))
    marked = docs.select("doc_id", text).join(F.broadcast(ids) if n <= MOST_BROADCAST_IDS else ids, "doc_id", "left")
    grams = ngrams(marked, text).select("_trusted", F.explode(F.concat("_one", "_two")).alias("h"))
    counts = grams.groupBy(bucket(F.col("h"), buckets).alias("k")).agg(F.count(F.lit(1)).alias("raw"), F.count("_trusted").alias("target")).collect()
    raw, target = [0] * buckets, [0] * buckets
    for r in counts:
        raw[r["k"]], target[r["k"]] = r["raw"], r["target"]
    if not sum(target):
        return [0] * buckets
    of_raw, of_target = sum(raw) + smoothing * buckets, sum(target) + smoothing * buckets
    return [round(UNIT * (math.log((t + smoothing) / of_target) - math.log((r + smoothing) / of_raw))) for t, r in zip(target, raw, strict=True)]


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the base columns and, for scores, _one and _two."""
    # hashes of windows of eight words, from those of two and of four
    rows = ngrams(docs, text).withColumn("_four", spread(F.col("_two"), 2)).withColumn("_windows", spread(F.col("_four"), 4))
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)
    rows = rows.withColumn("_lines", F.filter(lines, lambda x: x.rlike(WORD)))
    rows = rows.withColumns({
        "n_words": F.size("_one").cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_symbols": F.coalesce(F.length(F.regexp_replace(F.col(text), r"[^#*$%&|<>]+", "")), F.lit(0)).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_again": F.size(F.array_distinct("_windows")) < F.size("_windows"),
    })
    # windows with their places, sorted; only texts with a repeated window are looked at
    placed = F.array_sort(F.zip_with("_windows", F.sequence(F.lit(0), F.size("_windows") - 1), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    # explode keeps a list a column of its own, so that functions read it and don't make it again for each element
    rows = rows.withColumn("_sorted", F.explode(F.array(F.when(F.col("_again"), placed))))
    twice = F.filter("_sorted", lambda x, k: (F.get("_sorted", k - 1)["h"] == x["h"]) | (F.get("_sorted", k + 1)["h"] == x["h"]))
    rows = rows.withColumn("_places", F.explode(F.array(F.array_sort(F.transform(twice, lambda x: x["i"])))))
    covered = F.aggregate(F.transform("_places", lambda p, k: F.least(F.lit(8), F.coalesce(F.get("_places", k + 1) - p, F.lit(8)))), F.lit(0), lambda a, x: a + x)
    return rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))


@sheltered("_words", "_one", "_two", "_four", "_windows", "_lines", "_again", "_sorted", "_places", "_sum", "_n")
def judge(docs: DataFrame, ratios: list[int], text: str = "text", least_score: float = LEAST_SCORE) -> DataFrame:
    """Add RESULT to every document: the base columns, the mean log ratio, base_failed and kept."""
    names = [F.col(f"`{c}`") for c in docs.columns if c not in RESULT]
    table = F.from_json(F.lit(json.dumps(ratios)), "array<int>")
    rows = measured(docs.select(*names), text)
    summed = F.aggregate(F.concat("_one", "_two"), F.lit(0).cast("long"), lambda a, h: a + F.get(table, bucket(h, len(ratios))))
    n = F.size("_one") + F.size("_two")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    rows = rows.withColumns({"_sum": summed, "_n": n, "base_failed": failed})
    good = F.col("_sum") >= F.lit(round(least_score * UNIT)).cast("long") * F.col("_n")
    rows = rows.withColumns({"score": F.when(F.col("_n") > 0, F.col("_sum") / F.col("_n") / UNIT), "kept": ~F.col("base_failed") & good})
    return rows.select(*names, *(F.col(c) for c in RESULT))
