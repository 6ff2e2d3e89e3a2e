"""Every query over its whole table against a straight loop or SQL."""

from __future__ import annotations

import base64
import hashlib
import zlib

import brute
import duckdb
import numpy as np
import public_tokenizers
import pytest

from kpiscope.llm import quality
from kpiscope.llm.queries import ORACLES, QUERIES


def rows(spark, sf, name):
    query = next(q for n, q in QUERIES.items() if n.split("_")[0] == name)
    return [r.asDict() for r in query(spark, sf).collect()]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, sf, name):
    from parity import compare, oracle_connection

    status, n, _, note = compare(spark, oracle_connection(sf), sf, name, QUERIES[name], ORACLES[name])
    assert status == "ok" and n, note


def test_op1(spark, sf, tables):
    docs = [(d[0], d[1]) for d in tables["documents"]]
    table = brute.ratios(docs, {x[0] for x in tables["labels"] if x[1] == 1}, quality.BUCKETS)
    got = {r["doc_id"]: r for r in rows(spark, sf, "op1")}
    assert len(got) == len(docs)
    for i, text in docs:
        want = brute.base(text)
        found = [table[k] for k in brute.grams(text, quality.BUCKETS)]
        want["kept"] = not want["base_failed"] and sum(found) >= round(quality.LEAST_SCORE * quality.UNIT) * len(found)
        assert {k: got[i][k] for k in want} == want, i


def test_op1_keeps_the_good_and_drops_junk(spark, sf, tables):
    good = {x[0]: x[1] for x in tables["labels"]}
    got = [r for r in rows(spark, sf, "op1") if r["doc_id"] in good and not r["base_failed"]]
    assert all(r["kept"] for r in got if good[r["doc_id"]] == 1)
    junk = [r["kept"] for r in got if good[r["doc_id"]] == 0]
    assert junk and not any(junk)


def test_op2(spark, sf, tables):
    want = brute.components([(d[0], d[1]) for d in tables["documents"]])
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in rows(spark, sf, "op2")} == want


def test_op3_is_the_article(spark, sf, tables):
    import html
    import re

    got = {r["page_id"]: r for r in rows(spark, sf, "op3")}
    for page_id, url, page in tables["pages"]:
        article = re.search(r"<article>(.*?)(</article>|\Z)", page, re.S)[1]
        text = " ".join(html.unescape(re.sub(r"<(b|/b)>", "", re.sub(r"</?(p|h1|br)>", " ", article))).split())
        assert (got[page_id]["url"], got[page_id]["text"], got[page_id]["n_chars"]) == (url, text, len(text))


def test_op5(spark, sf, tables):
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r["doc_id"]: r for r in rows(spark, sf, "op5")}
    for i, text, *_ in tables["documents"]:
        ids = own.encode_ordinary(text or "")
        want = {"doc_id": i, "n_tokens": len(ids), "ids_sha256": brute.sha(" ".join(map(str, ids))), "decoded_sha256": brute.sha(text or "")}
        assert got[i] == want


def test_op6(spark, sf, tables):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got, start = {r["doc_id"]: r for r in rows(spark, sf, "op6")}, 0
    for i, text, *_ in sorted(tables["documents"]):
        ids = [*own.encode(text or "", add_special_tokens=False).ids, 0]
        assert got[i] == {"doc_id": i, "start": start, "n_tokens": len(ids), "ids_crc32": zlib.crc32(np.array(ids, "<u4").tobytes())}
        start += len(ids)


def test_op8(spark, sf, tables):
    largest = {}
    for i, _, page in tables["pages"]:
        largest[page or ""] = max(i, largest.get(page or "", i))
    want = {}
    for i, _, page in tables["pages"]:
        body = (page or "").encode()
        held = largest[page or ""]
        want[i] = (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if held == i else "revisit", None if held == i else held)
    assert {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows(spark, sf, "op8")} == want


def test_op9_on_held_out_documents(spark, sf, tables):
    lang = {d[0]: d[2] for d in tables["documents"]}
    got = rows(spark, sf, "op9")
    assert all(r["held_out"] == brute.held_out(r["doc_id"]) and 0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"] and lang[r["doc_id"]]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert not any(r["rejected"] for r in got if r["lang_pred"] == lang[r["doc_id"]])


def test_op9_is_the_smallest_output_of_a_plain_loop(spark, sf, tables):
    import zstandard

    from kpiscope.llm import language
    from kpiscope.llm.shared import load

    model = language.fit(load(spark, sf, "documents"))
    made = [(lang, zstandard.ZstdCompressionDict(sample, dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for lang, sample in model.items()]
    got = {r["doc_id"]: r for r in rows(spark, sf, "op9")}
    for i, text, *_ in tables["documents"]:
        if not any(c.isalpha() for c in text or ""):
            assert got[i]["lang_pred"] == "und"
            continue
        data = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in text.lower().encode())
        data = b" " * 1024 + data if len(data) < 600 else data
        sizes = []
        for lang, raw in made:
            tool = zstandard.ZstdCompressor(level=language.LEVEL, dict_data=raw, write_content_size=False, write_dict_id=False)
            sizes.append((sum(len(tool.compress(data[k : k + 2048])) for k in range(0, len(data), 2048)), len(sizes), lang))
        first, second = sorted(sizes)[:2]
        assert (got[i]["lang_pred"], round(got[i]["margin"], 9)) == (first[2], round((second[0] - first[0]) / second[0], 9)), i


def test_op10(spark, sf, tables):
    items = [(b[0], b[1]) for b in tables["benchmark"]]
    got = {r["doc_id"]: r for r in rows(spark, sf, "op10")}
    for i, text, *_ in tables["documents"]:
        found = brute.leaking(text, items)
        assert (got[i]["n_items"], got[i]["first_item"], got[i]["kept"]) == (len(found), min(found, default=None), not found), i


def test_pipeline(spark, sf, tables):
    """Stage by stage with the loops; languages as the operator tells them."""
    import corpus_pipeline
    import tiktoken

    told = {r["doc_id"]: r["rejected"] for r in rows(spark, sf, "op9")}
    docs = [(d[0], d[1]) for d in tables["documents"] if not told[d[0]]]
    split = [(t or "").split("\n") for _, t in docs]
    keys = brute.Counter(k for ls in split for k in {x.strip(brute.BLANK).translate(brute.LOWER) for x in ls})
    docs = [(i, "\n".join(x for x in ls if not (k := x.strip(brute.BLANK).translate(brute.LOWER)) or keys[k] < 10)) for (i, _), ls in zip(docs, split, strict=True)]
    one = brute.components(docs, corpus_pipeline.NEAR_PERCENT)
    docs = [d for d in docs if one[d[0]][2]]
    items = [(b[0], b[1]) for b in tables["benchmark"]]
    docs = [d for d in docs if not brute.leaking(d[1], items)]
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r["doc_id"]: (r["token_ids"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == {i: (own.encode_ordinary(t), brute.sha(t)) for i, t in docs}
    assert len(got) < len(tables["documents"])
