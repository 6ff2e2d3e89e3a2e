from __future__ import annotations

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def tables(sf):
    """Rows of the small tables."""
    return {t: duckdb.sql(f"SELECT * FROM '{sf}/{t}.parquet'").fetchall() for t in ("documents", "pages", "labels", "benchmark")}


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from (doc_id, text) pairs."""

    def make(rows, **more):
        extra = "".join(f", {c} string" for c in more)
        return spark.createDataFrame([(*r, *more.values()) for r in rows], f"doc_id long, text string{extra}").repartition(3)

    return make
