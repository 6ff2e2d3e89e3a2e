"""Counts of overlapping chunks against the library on whole texts."""

from __future__ import annotations

import random

import public_tokenizers
import pytest
import sentencepiece

from kpiscope.llm import token_counts
from kpiscope.llm.queries import QUERIES

PATH = public_tokenizers.path("piece_bpe_32k.model")
OWN = sentencepiece.SentencePieceProcessor(model_file=PATH)


def want(text):
    n = len(OWN.encode(text or ""))
    return len((text or "").encode()), n, n > 4096


def test_op11(spark, sf, tables):
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op11_token_counts"](spark, sf).collect()}
    assert got == {d[0]: want(d[1]) for d in tables["documents"]}


def hard_texts():
    rng = random.Random(4)
    words = ["the", "and", " ", "  ", "é", "中国", "😀", "\n", "\t", "x" * 30, "<s>", "</s>", "<unk>", "<0x41>", "▁", "\x00", "é", "don't", "..."]
    yield from ("".join(rng.choice(words) + rng.choice(["", " "]) for _ in range(n)) for n in (0, 1, 5, 40, 200, 900, 3000))
    yield from ("a" * 5000, "ab" * 3000, " " * 2000, "中" * 3000, "\n" * 1000, " a" * 2000, "é" * 999, "=" * 777 + " " + "=" * 901)
    yield "word " * 100 + "z" * 4000 + " word" * 100  # only its middle has no stable place
    yield None


@pytest.mark.parametrize(("chunk", "overlap"), [(64, 16), (50, 50), (7, 1), (token_counts.CHUNK_CHARS, token_counts.OVERLAP_CHARS)])
def test_spliced_counts_are_those_of_whole_texts(docs_of, chunk, overlap):
    texts = list(enumerate(hard_texts()))
    docs = docs_of([*texts, *texts[-3:], (None, "an id is missing " * 30)], n_tokens="mine", uid="u", row="r", k="k")
    got = token_counts.count(docs, PATH, chunk=chunk, overlap=overlap)
    assert {"uid", "row", "k"} < set(got.columns) and got.columns.count("n_tokens") == 1
    rows = [(r["doc_id"], (r["n_bytes"], r["n_tokens"], r["over_limit"]), r["uid"]) for r in got.collect()]
    expected = [(i, want(t), "u") for i, t in [*texts, *texts[-3:], (None, "an id is missing " * 30)]]
    assert sorted(rows, key=repr) == sorted(expected, key=repr)


def test_a_document_without_stable_places_is_encoded_in_one_piece(spark):
    huge = spark.createDataFrame([(1, "ab" * 500), (2, "so it is " * 99)], "uid long, text string")
    got = {r["uid"]: r["n_tokens"] for r in token_counts.spliced(huge, PATH, 100, 20).collect()}
    assert got == {1: None, 2: len(OWN.encode("so it is " * 99))}
    got = {r["uid"]: r["n_tokens"] for r in token_counts.spliced(huge, PATH, 1000, 200).collect()}
    assert got[1] == len(OWN.encode("ab" * 500))


def test_stable_places_are_never_crossed():
    one, rng = token_counts.counter(PATH), random.Random(8)
    for _ in range(300):
        a, b = ("".join(rng.choice("ab e\n中é.t") for _ in range(rng.randint(1, 12))) for _ in range(2))
        ends = {at for at, _ in OWN.encode(a + b, return_type="offset_mapping")["offsets"]}
        assert len(a) in ends or not one.stable(a[-1], b[0])


def test_empty_table(docs_of):
    assert token_counts.count(docs_of([(1, "x")]).limit(0), PATH).count() == 0
    with pytest.raises(ValueError, match="overlap"):
        token_counts.count(docs_of([(1, "x")]), PATH, chunk=10, overlap=11)
