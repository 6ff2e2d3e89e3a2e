"""Language identification by compression.

For every language a zstandard raw-content dictionary holds sample text. A text is compressed in blocks with each
dictionary; the smallest sum names the language, of equal ones that with more training documents. Case and everything but
letters is evened out first, so that punctuation or capitals don't drown the language. Short texts are compressed after a run of
spaces, else zstandard would store them as they are.

Narrow margins are rejected, but for texts under LEAST_BYTES, ties included: sizes are whole bytes, and these are too short to
tell a narrow margin from chance. What is narrow is learned for each language from its training documents: each half of the samples
in the dictionaries is judged with dictionaries of the other halves, and a margin under MARGIN_SHARE of the language's median
is narrow. The median isn't moved by some mixed or wrongly labelled documents. Texts in a language without training rows gain little from any
dictionary over the others and so have narrow margins.

The dictionaries are fitted on a bounded sample: of each language about SAMPLE_DOCS documents chosen by a hash of doc_id, of
each the first SLICE_CHARS characters, DICT_BYTES in all. Predictions read whole texts.

Nulls: without text or without a letter a document gets `und`, score 0, and is rejected. Training rows with a null text,
lang or doc_id are left out; without any training row every document gets `und`. Repeated rows are judged each. Extra
columns pass through; input columns named like the results are replaced, any other name is free.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from statistics import median

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kpiscope.llm.shared import bounded_batches, sheltered

SAMPLE_DOCS, SLICE_CHARS, DICT_BYTES = 200, 1500, 1 << 17
LEVEL, BLOCK, SHORT = 6, 2048, 600
PADDING = b" " * 1024
#: A document is rejected if the relative gain of its best over its second language is below this share of the usual gain; where
#: no usual gain is known, because no language has two samples of LEAST_BYTES, below LEAST_MARGIN.
MARGIN_SHARE, LEAST_MARGIN, LEAST_BYTES = 0.2, 0.001, 64
MOST_LANGUAGES = 500
FOLDS = 5
SPACES = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in range(256))
RESULT = ["lang_pred", "score", "margin", "rejected"]


def held_out(doc_id: Column) -> Column:
    """One document in five, by a checksum of its id; a null id is not held out."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % FOLDS == 0, F.lit(False))


def evened(text: str) -> bytes:
    return text.lower().encode().translate(SPACES)


def fit(docs: DataFrame) -> dict[str, bytes]:
    """Dictionaries by language, most frequent first, from documents that are not held out."""
    rows = docs.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not counts:
        return {}
    place = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 30)).alias("place")
    share = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, 1.5 * SAMPLE_DOCS / n * (1 << 30))))
    picked = rows.withColumn("place", place).filter(F.col("place") < share[F.col("lang")])
    texts = defaultdict(list)
    for r in picked.select("lang", "place", F.substring("text", 1, SLICE_CHARS).alias("text")).collect():
        texts[r["lang"]].append((r["place"], r["text"]))
    order = sorted(texts, key=lambda lang: (-counts[lang], lang))
    return {lang: b"\n".join(evened(t) for _, t in sorted(texts[lang])[:SAMPLE_DOCS])[:DICT_BYTES] for lang in order}


@lru_cache(4)
def compressors(model: tuple[tuple[str, bytes], ...]) -> list[tuple[str, zstandard.ZstdCompressor]]:
    out = []
    for lang, sample in model:
        raw = zstandard.ZstdCompressionDict(sample, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        raw.precompute_compress(level=LEVEL)
        out.append((lang, zstandard.ZstdCompressor(level=LEVEL, dict_data=raw, write_content_size=False, write_dict_id=False)))
    return out


def ranked(data: bytes, tools: list) -> list[tuple[int, int]]:
    """Compressed sizes of an evened text with the place of their language, smallest first."""
    read = PADDING + data if len(data) < SHORT else data
    return sorted((sum(len(z.compress(read[k : k + BLOCK])) for k in range(0, len(read), BLOCK)), place) for place, (_, z) in enumerate(tools))


def gain(sizes: list[tuple[int, int]]) -> float:
    return (sizes[1][0] - sizes[0][0]) / sizes[1][0] if len(sizes) > 1 else 1.0


def least_margins(model: dict[str, bytes]) -> dict[str, float]:
    """The narrowest margin of each language that is accepted, from the samples in its dictionary (a line each)."""
    lines = {lang: sample.split(b"\n") for lang, sample in model.items()}
    found = defaultdict(list)
    for half in (0, 1):
        tools = compressors(tuple((lang, b"\n".join(rows[1 - half :: 2])) for lang, rows in lines.items()))
        for place, (lang, rows) in enumerate(lines.items()):
            for row in rows[half::2] if len(rows) > 1 else ():
                if len(row) >= LEAST_BYTES:
                    sizes = ranked(row, tools)
                    # a sample told wrong has no margin
                    found[lang].append(gain(sizes) if sizes[0][1] == place else 0.0)
    known = {lang: MARGIN_SHARE * median(margins) for lang, margins in found.items()}
    other = min(known.values(), default=LEAST_MARGIN)
    return {lang: max(LEAST_MARGIN, known.get(lang, other)) for lang in model}


def judge(text: str | None, tools: list, least: dict[str, float]) -> tuple[str, float, float, bool]:
    """Language, score, margin and whether it is rejected, for a text with a letter or None."""
    if text is None or not tools:
        return "und", 0.0, 0.0, True
    data = evened(text)
    sizes = ranked(data, tools)
    margin = gain(sizes)
    score = 1 / sum(math.exp((sizes[0][0] - s) / 2) for s, _ in sizes)
    lang = tools[sizes[0][1]][0]
    return lang, score, margin, margin < least[lang] and len(data) >= LEAST_BYTES


@sheltered("_read")
def predict(docs: DataFrame, model: dict[str, bytes]) -> DataFrame:
    """Add lang_pred, score, margin and rejected, from the text alone."""
    bounded_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast((tuple(model.items()), least_margins(model)))
    kept = [f for f in docs.schema.fields if f.name not in RESULT]
    names = [f.name for f in kept]
    kinds = [("lang_pred", pa.string(), T.StringType()), ("score", pa.float64(), T.DoubleType()), ("margin", pa.float64(), T.DoubleType()), ("rejected", pa.bool_(), T.BooleanType())]
    schema = T.StructType([*kept, *(T.StructField(n, t) for n, _, t in kinds)])
    rows = docs.select(*(F.col(f"`{n}`") for n in names), F.when(F.col("text").rlike(r"\p{L}"), F.col("text")).alias("_read"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, least = held.value
        tools = compressors(languages)
        for batch in batches:
            found = [judge(t.as_py(), tools, least) for t in batch.column("_read")]
            cols = [pa.array(list(c), kind) for c, (_, kind, _) in zip(zip(*found, strict=True) if found else [()] * 4, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *cols], names=schema.names)

    return rows.mapInArrow(run, schema)
