"""Benchmark items shorter than a window, with every substitution their rule allows."""

from __future__ import annotations

import itertools
import random

import brute
import pytest

from kpiscope.llm import decontam


@pytest.mark.parametrize("n", range(5, 13))
def test_masks_leave_out_any_allowed_substitutions(n):
    masks = [{at + k for k, c in enumerate(mask) if c == "1"} for mask, at in decontam.short_masks(n)]
    most = max(w for w in range(n) if n - w >= 0.8 * n)
    assert all(len(kept) >= 4 and max(kept) < n for kept in masks)
    for wrong in itertools.combinations(range(n), most):
        assert any(kept.isdisjoint(wrong) for kept in masks), wrong


def test_short_items_are_found_with_substitutions(spark, docs_of):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(6))
    items = [(n, " ".join(word() for _ in range(n))) for n in range(4, 14)]
    texts = []
    for n, text in items:
        for wrong in itertools.chain.from_iterable(itertools.combinations(range(n), k) for k in range(4 if n < 8 else 3)):
            w = [word() if k in wrong else t for k, t in enumerate(text.split())]
            texts.append(" ".join([word(), *w, word()] if len(texts) % 2 else w))
        texts += [" ".join(text.split()[k:]) for k in (1, 2)] + [" ".join(text.split()[:-k]) for k in (1, 2)]  # cut by the text's ends
    rows = list(enumerate(texts))
    got = decontam.decontaminate(docs_of(rows), spark.createDataFrame(items, "item_id long, text string"))
    got = {r["doc_id"]: (r["n_items"], r["first_item"]) for r in got.collect()}
    want = {i: brute.leaking(t, items) for i, t in rows}
    assert got == {i: (len(f), min(f, default=None)) for i, f in want.items()}
    assert sum(map(bool, want.values())) > 200
