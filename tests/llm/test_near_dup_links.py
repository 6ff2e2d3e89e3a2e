"""Near copies by similarity, and chains of them."""

from __future__ import annotations

import random

import brute
import pytest

from kpiscope.llm import neardup


def words_of(rng, n):
    return ["".join(rng.choice("abcdefghijk") for _ in range(6)) for _ in range(n)]


@pytest.mark.parametrize("percent", [80, 85])
def test_signatures_fit_the_percentage(percent):
    assert neardup.missed(percent, neardup.entries_for(percent)) <= neardup.MOST_MISSED


def test_the_stage_joins_near_copies_from_four_fifths(spark, docs_of):
    """Pairs with a similarity from 0.80 up to 0.85, which op2 leaves apart."""
    import corpus_pipeline

    rng, rows = random.Random(4), []
    for g in range(40):
        one = words_of(rng, 104)  # 100 shingles; two words in the middle touch 9 or 10 of them
        two = list(one)
        at = 40 + g % 5
        two[at : at + 1 + g % 6] = words_of(rng, 1 + g % 6)
        rows += [(2 * g, " ".join(one)), (2 * g + 1, " ".join(two))]
    docs = docs_of(rows, lang="x", source="s", n_chars="1")
    sets = {i: brute.shingle_set(t) for i, t in rows}
    share = [len(sets[2 * g] & sets[2 * g + 1]) / len(sets[2 * g] | sets[2 * g + 1]) for g in range(40)]
    assert any(0.80 <= s < 0.85 for s in share)
    for percent, kept in ((85, neardup.firsts(docs)), (80, corpus_pipeline.near_dedup(spark, docs, ""))):
        assert {r["doc_id"] for r in kept.collect()} == {i for i, (_, _, k) in brute.components(rows, percent).items() if k}


def test_components_of_a_shuffled_chain(spark):
    """Revisions linked only to the one before, with ids in any order; and pairs beside them."""
    ids = list(range(1000, 1400))
    random.Random(8).shuffle(ids)
    links = list(zip(ids, ids[1:], strict=False)) + [(2 * k, 2 * k + 1) for k in range(50)]
    links = spark.createDataFrame([(min(p), max(p)) for p in links], "x long, y long").repartition(3)
    got = {r["uid"]: r["comp"] for r in neardup.components(links).collect()}
    assert got == {**dict.fromkeys(ids, 1000), **{2 * k + b: 2 * k for k in range(50) for b in (0, 1)}}
