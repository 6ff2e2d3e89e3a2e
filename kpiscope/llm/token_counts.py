"""Token counts of whole texts with a sentencepiece model, huge documents by overlapping chunks.

A text of up to CHUNK_CHARS bytes is encoded as it is. A longer one is cut into chunks of CHUNK_CHARS code points, each with the
first OVERLAP_CHARS of the next one, which Spark deals out as rows of their own. Every chunk is encoded with offsets and
reports, inside its two overlaps, where its tokens begin and how many stand before. Two neighbours are spliced at the first place
where both begin a token and that is proven stable; the counts on either side of it are then those of the whole text. If
two neighbours have no such place, the document is encoded again with chunks and overlaps WIDEN times as long, at last in
one piece, so that every document ends and the work is a few times its length.

A place is proven stable if no piece of the vocabulary holds its two neighbouring characters side by side: a merge makes
only pieces of the vocabulary, so none ever crosses it, whatever stands around. That needs a BPE model that leaves
the text as it is (no normalising, no removal of white space) and falls back to bytes; with other models no place is
proven, and long texts are encoded in one piece.

Nulls: a null or empty text has 0 bytes and 0 tokens. Repeated rows are counted each. Strings of control tokens inside a text
are ordinary text, as the library has it. An empty table gives an empty table. Extra columns pass through; input columns named
like the results are replaced, any other name is free.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kpiscope.llm.shared import bounded_batches, stash

CHUNK_CHARS, OVERLAP_CHARS, WIDEN = 32_768, 256, 8
#: Texts are handed to the library so many bytes at a time.
SLICE_BYTES = 1 << 20
RESULT = ["n_bytes", "n_tokens", "over_limit"]
#: The library writes a space as this character; it puts one in front of every text.
SPACE = "▁"
BPE = 2
ZONE = "array<struct<at: long, before: long>>"


class Counter:
    """The library's tokens of a text, and the places in it that no token can cross."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        rules, kind = model.normalizer_spec, model.trainer_spec
        self.plain = kind.model_type == BPE and kind.byte_fallback and not rules.precompiled_charsmap and not rules.remove_extra_whitespaces
        texts = [p.piece for p in model.pieces if p.type not in (p.CONTROL, p.BYTE, p.UNKNOWN)]
        self.joined = {t[i : i + 2] for t in texts for i in range(len(t) - 1)}

    def counts(self, texts: list[str]) -> list[int]:
        return [len(ids) for ids in self.library.encode(texts, num_threads=1)]

    def stable(self, before: str, after: str) -> bool:
        """Whether no token holds these two neighbours."""
        return self.plain and (before + after).replace(" ", SPACE) not in self.joined

    def zones(self, text: str, overlaps: list[tuple[int, int]]) -> tuple[int, list[list[tuple[int, int]]]]:
        """The number of tokens, and for each overlap (from, to) the stable places in it with the tokens before them."""
        begins = [a for a, _ in self.library.encode(text, return_type="offset_mapping")["offsets"]] if text else []
        found: list[list[tuple[int, int]]] = [[] for _ in overlaps]
        for n, at in enumerate(begins):
            if n and at == begins[n - 1]:
                continue  # a further byte of the same character
            for zone, (low, high) in zip(found, overlaps, strict=True):
                if low < at < high and self.stable(text[at - 1], text[at]):
                    zone.append((at, n))
        return len(begins), found


@lru_cache(2)
def counter(path: str) -> Counter:
    return Counter(path)


def _whole(path: str, text: Column) -> Column:
    """Tokens of each text, encoded in one piece."""

    @F.arrow_udf("long")
    def count(texts: pa.Array) -> pa.Array:
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
        out, start, held = [], 0, 0
        for i, size in enumerate(sizes.tolist()):
            held += size
            if held > SLICE_BYTES or i == len(sizes) - 1:
                out += counter(path).counts(texts.slice(start, i + 1 - start).to_pylist())
                start, held = i + 1, 0
        return pa.array(out, pa.int64())

    return count(text)


def _chunks(huge: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """(uid, k, part, more): texts in chunks, each followed by the first characters of the next one."""
    parts = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{chunk}}}"), F.lit(0))
    after = F.concat(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), F.array(F.lit(None).cast("string")))
    both = F.zip_with(parts, after, lambda a, b: F.struct(F.concat(a, F.coalesce(F.left(b, F.lit(overlap)), F.lit(""))).alias("part"), b.isNotNull().alias("more")))
    return huge.select("uid", F.posexplode(both)).select("uid", F.col("pos").cast("long").alias("k"), "col.part", "col.more")


def _encoded(chunks: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """Tokens of each chunk and the stable places in its overlaps, counted from the start of the document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                base = r["k"] * chunk
                total, (left, right) = counter(path).zones(r["part"], [(0, overlap if r["k"] else 0), (chunk, chunk + overlap)])
                shift = [[{"at": base + at, "before": n} for at, n in zone] for zone in (left, right)]
                rows.append({"uid": r["uid"], "k": r["k"], "more": r["more"], "total": total, "left": shift[0], "right": shift[1]})
            zone = pa.list_(pa.struct([("at", pa.int64()), ("before", pa.int64())]))
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("uid", pa.int64()), ("k", pa.int64()), ("more", pa.bool_()), ("total", pa.int64()), ("left", zone), ("right", zone)]))

    return chunks.repartition("uid", "k").mapInArrow(run, f"uid long, k long, more boolean, total long, left {ZONE}, right {ZONE}")


def spliced(huge: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """(uid, n_tokens) of texts put together from their chunks; null where two neighbours have no stable place in common."""
    parts = _encoded(_chunks(huge, chunk, overlap), path, chunk, overlap)
    before = F.lag("right").over(Window.partitionBy("uid").orderBy("k"))
    places = lambda zone: F.transform(zone, lambda x: x["at"])
    at_place = lambda zone: F.get(F.filter(zone, lambda x: x["at"] == F.col("place")), F.lit(0))["before"]
    laid = parts.withColumn("before", before).withColumn("place", F.array_min(F.array_intersect(places("left"), places("before"))))
    moved = F.when(F.col("k") == 0, F.lit(0)).otherwise(at_place("before") - at_place("left"))
    own = F.when(F.col("more"), F.lit(0)).otherwise(F.col("total"))
    rows = laid.select("uid", (moved + own).alias("n"))
    return rows.groupBy("uid").agg(F.when(F.count("n") == F.count(F.lit(1)), F.sum("n")).alias("n_tokens"))


def count(docs: DataFrame, path: str, text: str = "text", limit: int = 4096, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """Add RESULT to every document: bytes in UTF-8, tokens, and whether these are more than limit."""
    if overlap > chunk:
        raise ValueError("an overlap must not be longer than a chunk")
    spark = docs.sparkSession
    bounded_batches(spark)
    kept = [c for c in docs.columns if c not in RESULT]
    whole_text = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"), whole_text.alias("text"))
    long = F.octet_length("text") > chunk
    short = rows.filter(~long).select("row", F.octet_length("text").cast("long").alias("n_bytes"), _whole(path, F.col("text")).alias("n_tokens"))

    huge = stash(rows.filter(long).withColumn("uid", F.monotonically_increasing_id()), "huge-texts")
    left, found, size, zone = huge.select("uid", "text"), [], chunk, overlap
    while not left.isEmpty():
        done = stash(spliced(left, path, size, zone), "spliced-counts")
        found.append(done.filter("n_tokens is not null"))
        left = left.join(done.filter("n_tokens is null"), "uid", "left_semi")
        size, zone = size * WIDEN, zone * WIDEN
    counted = huge.select("row", F.octet_length("text").cast("long").alias("n_bytes"), "uid")
    for one in found[1:]:
        found[0] = found[0].unionByName(one)
    if found:
        short = short.unionByName(counted.join(found[0], "uid").select("row", "n_bytes", "n_tokens"))
    return short.select("row.*", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
