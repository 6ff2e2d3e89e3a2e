"""Benchmark decontamination by spaced-seed hashing, with DataFrame functions only.

Tokens are runs of letters and digits, lower-cased. A seed is the hash of the tokens at the kept positions of a mask over nine
tokens. The two masks together find every window of 13 tokens with at most two substitutions. Seeds of all documents
are joined with those of all benchmark items. Around a hit the windows of 13 tokens that hold the seed are compared
token by token; one with 11 equal tokens contaminates the document. Items of 5 to 12 tokens are one window as a whole, of which four fifths
must be equal. Each such length has masks of its own: its places are cut into blocks, and a mask keeps all but as many blocks as
substitutions are allowed, so that some mask keeps none of the substituted places. They lie at fixed places of the item and have no
outer zeros, so they also fit where a text starts or ends inside the item. Items of fewer than five tokens are too common and never match.

The seeds of the benchmark are counted first. Up to MOST_SEEDS (about 100 MB) they are broadcast; a longer benchmark is taken
in slices of that size, each with its own pass over the documents. No seed or hit is left out.

Nulls: a null text or item has no tokens; hits of an item with a null id are counted under null. Repeated documents get the same
findings: these are kept by a hash of the text, so a text with many copies is reported once and joined as a
small table. Extra columns pass through; input columns named like the results are replaced, any other name is free. An empty benchmark leaves all documents clean.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kpiscope.llm.shared import hash64, sheltered, stash

MASKS = ("111101001", "100110111")
SPAN, WINDOW, EQUAL = 9, 13, 0.8
#: Tokens of the shortest items, and tokens that a mask of a short item keeps at least.
LEAST_ITEM, LEAST_KEPT = 5, 4
MOST_SEEDS = 3_000_000
RESULT = ["n_items", "first_item", "best_equal", "contaminated", "kept"]


def tokens(text: Column) -> Column:
    """Hashes of the tokens of a text."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    return F.transform(F.coalesce(found, F.array().cast("array<string>")), lambda t: F.xxhash64(t))


def short_masks(n: int) -> list[tuple[str, int]]:
    """Masks for items of n tokens (under WINDOW) and where each lies; any allowed substitutions leave one of them whole."""
    wrong = n // 5
    for blocks in range(wrong + 1, n + 1):
        ends = [n * k // blocks for k in range(blocks + 1)]
        out = []
        for left_out in combinations(range(blocks), wrong):
            mask = "".join("0" if any(ends[b] <= k < ends[b + 1] for b in left_out) else "1" for k in range(n))
            out.append((mask.strip("0"), mask.index("1")))
        if all(mask.count("1") >= LEAST_KEPT for mask, _ in out):
            return out
    raise ValueError(f"no masks for {n} tokens")


def seed(h: Column, i: Column, mask: str) -> Column:
    """Hash of the tokens of h that the mask keeps from place i on; null where the text ends before."""
    at = [k for k, c in enumerate(mask) if c == "1"]
    return F.when(i + len(mask) <= F.size(h), F.xxhash64(F.lit(mask), *(F.get(h, i + k) for k in at)))


def seeds(rows: DataFrame, kinds: list[str]) -> DataFrame:
    """rows (with token hashes h) by place i and mask, with the seed."""
    least = min(map(len, kinds))
    placed = rows.filter(F.size("h") >= least).select("*", F.explode(F.sequence(F.lit(0), F.size("h") - least)).alias("i"))
    return placed.select("*", F.explode(F.array(*(seed(F.col("h"), F.col("i"), m) for m in kinds))).alias("seed"))


def overlap(h: Column, i: Column, item: Column, j: Column) -> Column:
    """Most equal tokens, as a share, of the item's windows that hold place j, laid so that it meets place i of h."""
    size = F.least(F.lit(WINDOW), F.size(item))
    low = F.greatest(F.lit(0), F.least(j + F.least(F.lit(SPAN), F.size(item)) - size, F.size(item) - size))
    high = F.greatest(low, F.least(j, F.size(item) - size))

    def equal(start: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(0), size - 1), F.lit(0), lambda n, k: n + F.when(F.get(h, i - j + start + k) == F.get(item, start + k), 1).otherwise(0))

    return F.array_max(F.transform(F.sequence(low, high), equal)) / size


def find(docs: DataFrame, benchmark: DataFrame, text: str = "text", most_seeds: int = MOST_SEEDS) -> DataFrame:
    """Contaminated texts by their hash (a, b): n_items, first_item, best_equal."""
    items = benchmark.select("item_id", tokens(F.col("text")).alias("h")).filter(F.size("h") >= LEAST_ITEM)
    items = stash(items.withColumn("item", F.xxhash64("item_id", "h")), "items")
    lengths = [r[0] for r in items.filter(F.size("h") < WINDOW).select(F.size("h")).distinct().collect()]  # eight at most
    short = [(n, mask, at) for n in sorted(lengths) for mask, at in short_masks(n)]
    kinds = [*MASKS, *sorted({mask for _, mask, _ in short})]
    theirs = seeds(items.filter(F.size("h") >= WINDOW), list(MASKS)).filter("seed is not null").select("seed", "item", F.col("i").alias("j"))
    if short:
        one = [F.when(F.size("h") == n, F.struct(seed(F.col("h"), F.lit(at), mask).alias("seed"), F.lit(at).alias("j"))) for n, mask, at in short]
        own = items.filter(F.size("h") < WINDOW).select("item", F.explode(F.array(*one)).alias("s")).filter("s is not null")
        theirs = theirs.union(own.select("s.seed", "item", "s.j"))
    theirs = stash(theirs.select("seed", "item", "j").distinct(), "item-seeds")
    slices = max(1, -(-theirs.count() // most_seeds))
    whole = items.select("item", "item_id", F.col("h").alias("item_h")).dropDuplicates(["item"])
    ours = docs.select(hash64(F.col(text)).alias("a"), hash64(1, F.col(text)).alias("b"), tokens(F.col(text)).alias("h"))
    placed = seeds(ours, kinds)
    hits = None
    for k in range(slices):
        part = theirs.filter(F.pmod(F.xxhash64("item"), F.lit(slices)) == k) if slices > 1 else theirs
        some = whole.join(part.select("item").distinct(), "item", "left_semi") if slices > 1 else whole
        met = placed.join(F.broadcast(part), "seed").join(F.broadcast(some), "item")
        met = met.withColumn("equal", overlap(F.col("h"), F.col("i"), F.col("item_h"), F.col("j"))).filter(F.col("equal") >= EQUAL)
        met = met.groupBy("a", "b", "item_id").agg(F.max("equal").alias("equal"))
        hits = met if hits is None else hits.union(met)
    return hits.groupBy("a", "b").agg(F.countDistinct("item_id").alias("n_items"), F.min("item_id").alias("first_item"), F.max("equal").alias("best_equal"))


@sheltered("_a", "_b")
def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", most_seeds: int = MOST_SEEDS) -> DataFrame:
    """Add n_items, first_item, best_equal, contaminated and kept to every document."""
    found = stash(find(docs, benchmark, text, most_seeds), "contaminated")
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in RESULT]
    keyed = docs.select(*kept, hash64(F.col(text)).alias("_a"), hash64(1, F.col(text)).alias("_b"))
    found = found.withColumnsRenamed({"a": "_a", "b": "_b"})
    bad = F.col("best_equal").isNotNull()
    return keyed.join(found, ["_a", "_b"], "left").select(*kept, F.coalesce("n_items", F.lit(0)).alias("n_items"), "first_item", "best_equal", bad.alias("contaminated"), (~bad).alias("kept"))
