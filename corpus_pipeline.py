"""Training-data pipeline over `documents`: language ID, line dedup, near-dedup, decontamination, byte-level BPE.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each as Parquet and reads it again as
the next one's docs. All but the last return the columns of documents; n_chars follows the text. Edge cases are those of the
operators, named in their docstrings.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiscope.llm import bpe, decontam, language, lines, neardup
from kpiscope.llm.queries import bpe_digests
from kpiscope.llm.shared import load, stash

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Least similarity of near copies at this stage; op2's contract has its own.
NEAR_PERCENT = 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told by a clear margin; those without a letter go."""
    return language.predict(docs, language.fit(docs)).filter(~F.col("rejected")).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that ten documents or more share; all documents stay."""
    return lines.dedup(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (NEAR_PERCENT of their shingles of five words): that with the smallest id."""
    return neardup.firsts(docs, percent=NEAR_PERCENT).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return decontam.decontaminate(docs, load(spark, sf_dir, "benchmark")).filter("kept").select(*COLUMNS)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as token ids, with digests of the ids and of the text they decode to."""
    both = bpe.round_trip(docs.select("doc_id", "text", "lang", "source"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return both.select("doc_id", "lang", "source", "token_ids", *bpe_digests(), "decoded_sha256")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("byte_bpe", byte_bpe),
]

#: SQL has no zstandard, MinHash or BPE.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
