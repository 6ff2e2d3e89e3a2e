"""Line deduplication over a corpus, with DataFrame functions only.

Lines are normalised and hashed once, into a written table of 16 bytes a line; from it documents are counted per hash and the places of
too frequent keys are found. Lines at these places are dropped and the rest is joined again by position. A document counts once for a key, however often it has the line.

Documents are joined to their places by a hash of the text: equal texts lose equal lines, so copies share a row. The
frequent keys and the joined side are written tables of known size, so a hot line or a text with many copies meets either
a measured broadcast or a join whose skewed partitions Spark splits.

Nulls: a null or empty text is one empty line. Repeated rows count as a document each. Extra columns pass through; text is
replaced, and input columns named n_lines or n_dropped too; any other name is free. An empty table gives an empty table. The length
of a text only costs time in proportion; its lines are one array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kpiscope.llm.shared import hash64, lower_ascii, sheltered, stash

WHITE = " \t\n\x0b\f\r"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def hashed_keys(text: Column, least_chars: int) -> Column:
    """128 bits of each line's key, by which lines are compared; null for shorter keys."""
    keys = F.transform(lines_of(lower_ascii(text)), lambda x: F.btrim(x, F.lit(WHITE)))
    return F.transform(keys, lambda k: F.when(F.length(k) >= least_chars, F.struct(hash64(k).alias("a"), hash64(1, k).alias("b"))))


@sheltered("_lines", "_a", "_b", "_drop", "_stay")
def dedup(docs: DataFrame, least_docs: int = 10, least_chars: int = 1, text: str = "text") -> DataFrame:
    """Drop lines whose key has least_chars code points at least and is found in least_docs documents at least."""
    keyed = docs.withColumns({"_a": hash64(F.col(text)), "_b": hash64(1, F.col(text))})
    keys = stash(keyed.select("_a", "_b", hashed_keys(F.col(text), least_chars).alias("keys")), "line-keys")
    own = keys.select(F.explode(F.array_distinct("keys")).alias("key")).filter("key is not null")
    frequent = own.groupBy("key.a", "key.b").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_docs).select("a", "b")
    frequent = stash(frequent, "frequent-lines")
    placed = keys.select("_a", "_b", F.posexplode("keys").alias("at", "key")).filter("key is not null").select("_a", "_b", "at", "key.a", "key.b")
    drop = stash(placed.join(frequent, ["a", "b"]).groupBy("_a", "_b").agg(F.collect_set("at").alias("_drop")), "dropped-lines")
    out = keyed.join(drop, ["_a", "_b"], "left").withColumn("_lines", lines_of(F.col(text)))
    stay = F.when(F.col("_drop").isNull(), F.col("_lines")).otherwise(F.filter("_lines", lambda x, i: ~F.array_contains(F.col("_drop"), i)))
    out = out.withColumn("_stay", stay)
    names = [F.array_join("_stay", "\n").alias(text) if c == text else F.col(f"`{c}`") for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return out.select(*names, F.size("_lines").cast("long").alias("n_lines"), (F.size("_lines") - F.size("_stay")).cast("long").alias("n_dropped"))
