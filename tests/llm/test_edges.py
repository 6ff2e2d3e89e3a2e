"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns; and hard groups."""

from __future__ import annotations

import itertools
import random

import brute
import numpy as np
import public_tokenizers
import pytest

from pyspark.sql import functions as F

from kpiscope.llm import bpe, decontam, html, language, lines, neardup, pretokens, quality, token_files, urls, warc

RANKS, JSON = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
PATTERN = public_tokenizers.PATTERN
random.seed(5)
LONG = " ".join(random.choice("abcdefgh") * random.randint(1, 9) for _ in range(30_000))
ROWS = [(1, None), (2, ""), (3, " \t\n"), (4, "one two\nOne  two \n\none two"), (4, "one two\nOne  two \n\none two"), (5, LONG), (None, "an id is missing here"), (6, "x" * 20_000), (7, "##** 12 34")]


@pytest.fixture(scope="module")
def docs(docs_of):
    return docs_of(ROWS, kept="mine", text2="t", part="p")


def named(df, *cols):
    assert len(set(df.columns)) == len(df.columns)
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def test_quality(spark, docs):
    trusted = spark.createDataFrame([(4,), (4,), (None,)], "doc_id long")
    got = quality.judge(docs, quality.fit(docs, trusted))
    cols = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert named(got, "doc_id", *cols) == sorted(((i, *(brute.base(t)[c] for c in cols)) for i, t in ROWS), key=repr)
    assert "text2" in got.columns and got.filter("doc_id = 5").first()["kept"] in (True, False)
    assert quality.judge(docs.limit(0), quality.fit(docs.limit(0), trusted.limit(0))).count() == 0


def test_near_dup_edges(spark, docs):
    got = named(neardup.dedup(docs), "doc_id", "n_shingles", "component_id", "kept", "first")
    assert [r[0] for r in got].count(4) == 2 and sum(r[4] for r in got if r[0] == 4) == 1
    assert all(r[3] and r[2] == r[0] for r in got)
    assert (1, 0, 1, True, True) in got and (2, 0, 2, True, True) in got
    assert neardup.dedup(docs.limit(0)).count() == 0


@pytest.mark.parametrize("cell", [10_000, 7])
def test_near_dup_of_hard_groups(docs_of, cell):
    """Near copies around the threshold, chains, copies, shared passages; cells of any size give the same."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijk") for _ in range(5))
    rows, passage = [], [word() for _ in range(40)]
    for g in range(6):
        one = [word() for _ in range(rng.choice([8, 30, 120, 300]))]
        for _ in range(25):
            two = list(one)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                two[rng.randrange(len(two))] = word()
            rows.append(" ".join(two))
            if g == 5:
                one = two  # a chain
    rows += [" ".join([word() for _ in range(15)] + passage + [word() for _ in range(15)]) for _ in range(40)]
    rows = list(enumerate(rows))
    want = brute.components(rows)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.dedup(docs_of(rows), cell, 200 * cell).collect()}
    assert got == want
    assert 10 < sum(k for *_, k in want.values()) < len(rows) - 60


def test_lines(docs):
    got = lines.dedup(docs, least_docs=2).selectExpr("doc_id", "n_lines", "n_dropped", "sha2(text, 256) h")
    want = [(i, *x) for (i, _), x in zip(ROWS, brute.kept_lines([t for _, t in ROWS], 2), strict=True)]
    assert named(got, *got.columns) == sorted(want, key=repr)
    assert lines.dedup(docs.limit(0)).count() == 0


def test_decontamination_of_substituted_passages(spark, docs_of):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(6))
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate((4, 5, 8, 9, 13, 20, 60))] + [(7, None), (8, "")]
    rows = [(0, None), (1, ""), (2, " ".join(word() for _ in range(50)))]
    for k, text in items[:7]:
        w = text.split()
        rows.append((10 + k, "before " + text.upper() + ", after"))
        for hits in range(3):  # two substitutions of thirteen are found wherever they are
            two = list(w)
            for p in rng.sample(range(min(13, len(w))), min(hits + 1, len(w))):
                two[p] = word()
            rows.append((100 + 10 * k + hits, " ".join([word(), *two[:13], word()])))
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {i: len(brute.leaking(t, items)) for i, t in rows}
    for most in (decontam.MOST_SEEDS, 20):  # in slices too
        got = {r["doc_id"]: r["n_items"] for r in decontam.decontaminate(docs_of(rows, kept="x"), bench, most_seeds=most).collect()}
        long = {i: n for i, n in want.items() if i < 100 or i >= 140}
        assert {i: got[i] for i in long} == long
        assert all(got[i] <= n for i, n in want.items())
    assert decontam.decontaminate(docs_of(rows), bench.limit(0)).filter("kept").count() == len(rows)


HELPERS = ["_a", "_b", "_lines", "_stay", "_drop", "_words", "_one", "_two", "_four", "_windows", "_again", "_sorted", "_places", "_sum", "_n", "uid", "_read", "_host", "host", "page", "row", "_found", "key", "a", "b", "h", "i", "seed", "item", "UID2"]


def test_columns_named_like_helpers_keep_their_values(spark):
    values = {c: f"my {c}" for c in HELPERS}
    docs = spark.createDataFrame([(i, f"line {i % 2} has some words\nand another line {i}", f"http://h{i}/p", "<p>x", *values.values()) for i in range(4)], "doc_id long, text string, url string, html string, " + ", ".join(f"`{c}` string" for c in HELPERS))
    bench = spark.createDataFrame([(1, "line 0 has some words and")], "item_id long, text string")
    free = lambda *taken: {c: v for c, v in values.items() if c not in taken}
    for out, want in (
        (lines.dedup(docs, 2), values),
        (quality.judge(docs, quality.fit(docs, docs.select("doc_id"))), values),
        (neardup.dedup(docs), values),
        (neardup.firsts(docs.withColumn("kept", F.lit("my kept"))), {**values, "kept": "my kept"}),
        (decontam.decontaminate(docs, bench), values),
        (language.predict(docs, {"a": b"line has some words"}), values),
        (html.extract(docs.withColumnRenamed("doc_id", "page_id").drop("text")), values),
        (urls.judge(docs, [("block", "h1", "/")]), free("host")),
        (urls.judge(docs, [("block", "h1", "/")], most=0), free("host")),
        (bpe.round_trip(docs, RANKS, PATTERN), values),
    ):
        got = [r.asDict() for r in out.collect()]
        assert got and all(want.items() <= r.items() for r in got)


def test_negative_page_ids(spark):
    pages = spark.createDataFrame([(-5, "http://a", "<p>same"), (-9, "http://b", "<p>same")], "page_id long, url string, html string")
    got = named(warc.read(warc.write(pages)), "page_id", "record_type", "refers_to")
    assert got == [(-5, "response", None), (-9, "revisit", -5)]


def test_sql_of_short_items_finds_every_substitution(spark, tmp_path):
    """The SQL counts equal tokens of every laying; it knows no masks."""
    import duckdb

    from kpiscope.llm.queries import ORACLES

    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(6))
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate((4, 5, 7, 9, 10, 11, 12, 13, 25))]
    rows = []
    for _, text in items:
        for hits in range(4):
            two = text.split()
            for p in rng.sample(range(min(13, len(two))), min(hits, len(two))):
                two[p] = word()
            rows.append((len(rows), " ".join([word(), *two[:13], word()])))
    con = duckdb.connect()
    for name, key, table in (("documents", "doc_id", rows), ("benchmark", "item_id", items)):
        con.execute(f"CREATE TABLE {name} ({key} BIGINT, text VARCHAR)")
        con.executemany(f"INSERT INTO {name} VALUES (?, ?)", table)
    sql = {r[0]: (r[1], r[2]) for r in con.execute(ORACLES["op10_decontamination"]).fetchall()}
    want = {i: brute.leaking(t, items) for i, t in rows}
    assert sql == {i: (len(found), min(found, default=None)) for i, found in want.items()}
    docs, bench = (spark.createDataFrame(t, f"{k} long, text string") for k, t in (("doc_id", rows), ("item_id", items)))
    assert {r["doc_id"]: (r["n_items"], r["first_item"]) for r in decontam.decontaminate(docs, bench).collect()} == sql


def test_tokens_round_trip(docs):
    both = bpe.decode(bpe.encode(docs.withColumnRenamed("part", "token_ids"), RANKS, PATTERN), RANKS)
    assert named(both, "doc_id", "decoded") == sorted(((i, bytearray((t or "").encode())) for i, t in ROWS), key=repr)
    read = token_files.read(token_files.write(docs, JSON, PATTERN))
    assert [(r["doc_id"], r["ids"][:-1]) for r in read.orderBy("start").collect()][:1] == [(None, bpe.vocabulary(RANKS) and read.filter("doc_id is null").first()["ids"][:-1])]
    ids = {r["doc_id"]: r["token_ids"] for r in both.collect()}
    assert all(r["ids"] == [*ids[r["doc_id"]], 0] for r in read.collect())
    assert token_files.read(token_files.write(docs.limit(0), JSON, PATTERN)).count() == 0


def test_bitmap():
    bits, have = bpe.Bitmap(300_000), set()
    rng = random.Random(1)
    for _ in range(5000):
        i = rng.randrange(300_000)
        (bits.add(i), have.add(i)) if rng.random() < 0.6 else (bits.discard(i), have.discard(i))
        assert bits.first() == min(have, default=-1)


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 5000])
def test_blocks(n):
    rng = np.random.default_rng(n)
    ids = np.where(rng.random(n) < 0.97, rng.integers(1000, 1100, n), rng.integers(0, 2**32, n)).astype(np.uint32)
    lengths = np.array([n // 2, 0, n - n // 2])
    packed = token_files.pack(ids, lengths, np.array([1, -5, token_files.NO_ID]))
    doc_ids, got, back = token_files.unpack(packed)
    assert doc_ids.tolist() == [1, -5, token_files.NO_ID] and got.tolist() == lengths.tolist() and back.tolist() == ids.tolist()
    if n > 300:
        assert token_files.unpack(packed, 2, 4)[2].tolist() == ids[256:512].tolist()
        assert len(packed) < 2 * n
        with pytest.raises(ValueError, match="cut short"):
            token_files.unpack(packed[:-1])


def test_language(spark, docs_of):
    rows = [(i, t) for i, t in ROWS if i]
    got = language.predict(docs_of(rows, lang="xx"), {})
    assert {r["lang_pred"] for r in got.collect()} == {"und"} and "lang" in got.columns
    model = {"a": b"the and of that is " * 50, "b": "étaient où çà est ".encode() * 50}
    got = {r["doc_id"]: r for r in language.predict(docs_of([*rows, (8, "the and of that is"), (9, "12 34 !!")]), model).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3, 8, 9)] == ["und", "und", "und", "a", "und"]
    assert got[1]["rejected"] and got[1]["score"] == 0 and not got[8]["rejected"]
    assert language.fit(docs_of(rows, lang="x").limit(0)) == {}
    assert language.predict(docs_of(rows).limit(0), model).count() == 0


URLS = [
    (1, None), (2, ""), (3, "no scheme/net/"), (4, "http://A.NET/x"), (5, "https://www.example.net/en/"), (6, "http://example.net/en"), (7, "http://x.example.com/de/1?q=/de/"),
    (8, "http://example.com?/de/"), (9, "http://a.org/fr/x#y"), (10, "http://notexample.com/de/"), (11, "http://net"), (12, "http://net/"), (12, "http://net/"), (13, "http://b.org//fr/"), (14, "http://u:p@example.com:80/de/"),
]
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"), ("allow", "net", "/"), ("block", "org", "/fr/x"), ("allow", "com", "/d")]


def test_urls_by_trie_by_join_and_by_loop(spark):
    pages = spark.createDataFrame([(i, u, "mine") for i, u in URLS], "page_id long, url string, verdict string")

    def loop(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = rest.split("/")[0].split("?")[0].split("#")[0].translate(brute.LOWER)
        path = rest[len(host) :].split("?")[0].split("#")[0]
        fits = [(len(h), len(p), v, h + p) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, max(fits)[3], max(fits)[2]) if fits else (host, path, None, "allow")

    want = sorted(((i, *loop(u)) for i, u in URLS), key=repr)
    for most in (100, 0):
        assert named(urls.judge(pages, RULES, most=most), "page_id", "host", "path", "rule", "verdict") == want
    assert urls.judge(pages.limit(0), RULES).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var x = "</p><article>no";</script></head>
<body class="nav-open"><header>Site</header><div id=menu>Menu</div>{top}<main><article><header><h1>Head &amp; line</h1></header>
<p>First  <b>bo</b>ld<p>Second&nbsp;&lt;one&gt;<!-- no --><br>here<div class="cookie-notice">Cookies!</div>
<ul><li>a<li>b</ul><table><tr><td>c<td>d</table><form><input value="x">No</form><section class='comments'><p>Me too</section></article></main>
<aside>Aside</aside><div style="display: none">Hidden</div><footer>&copy;</footer></body>"""


def test_html(spark):
    rows = [(1, "http://h/1", PAGE.replace("{top}", "")), (2, None, None), (3, "http://h/2", ""), (4, "http://h/3", "plain < text &amp; <b>more"), (5, "x", "<p>unclosed <a href='"), (5, "x", "<script>never ends")]
    pages = spark.createDataFrame([(*r, "mine") for r in rows], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r for r in html.extract(pages).collect()}
    assert got[1]["text"] == "Head & line First bold Second <one> here a b c d"
    assert [got[i]["text"] for i in (2, 3, 4)] == ["", "", "plain < text & more"] and got[4]["n_chars"] == 19
    assert html.extract(pages.limit(0)).count() == 0


def test_templates_are_counted_on_different_pages(spark):
    site = lambda k: f"<body><div>Ours since 1999</div><p>Only page {k} has this</p><p>Shared by few {k % 9}</p></body>"
    rows = [(k, "http://one.example/", site(k)) for k in range(40)] + [(100 + k, "http://two.example/", site(1)) for k in range(40)] + [(200 + k, f"http://h{k}.example/", site(k)) for k in range(40)]
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in range(40):
        own = f"Only page {k} has this Shared by few {k % 9}"
        assert (got[k], got[100 + k], got[200 + k]) == (own, "Ours since 1999 Only page 1 has this Shared by few 1", "Ours since 1999 " + own)


def test_warc(spark):
    rows = [(1, "http://a", "<p>same"), (2, "http://b\r\nX: y", "<p>same"), (2, "http://b", "<p>same"), (3, None, None), (None, "http://c", "é"), (4, "http://d", "x" * 200_000)]
    pages = spark.createDataFrame([(*r, "mine") for r in rows], "page_id long, url string, html string, refers_to string")
    for packed in (True, False):
        got = warc.read(warc.write(pages, compressed=packed)).filter("reason is null")
        assert named(got, "page_id", "record_type", "payload_bytes", "refers_to") == sorted([(1, "revisit", 7, 2), (2, "response", 7, None), (2, "response", 7, None), (3, "response", 0, None), (None, "response", 2, None), (4, "response", 200_000, None)], key=repr)
    assert {r["record_type"] for r in warc.read(warc.write(pages, least_bytes=8)).collect()} == {"response"}
    assert warc.read(warc.write(pages.limit(0))).count() == 0


@pytest.mark.parametrize("packed", [True, False])
def test_salvage(packed):
    raws = [warc.record(i, f"http://{i}", body, warc.digest(body), None) for i in range(6) for body in [f"body {i} ".encode() * 50]]
    parts = [warc.gzip_member(r) if packed else r for r in raws]
    at = [sum(map(len, parts[:k])) for k in range(7)]
    data = bytearray(b"".join(parts))
    data[at[1] + len(parts[1]) // 2] ^= 0xFF  # a flipped bit
    data[at[3] : at[3]] = b"noise" * 9  # bytes in between
    del data[-len(parts[5]) // 2 :]  # cut short
    got = list(warc.salvage(bytes(data)))
    assert [r["page_id"] for r in got if "reason" not in r] == [0, 2, 3, 4]
    gaps = [(r["gap_start"], r["gap_bytes"]) for r in got if "reason" in r]
    assert gaps == [(at[1], len(parts[1])), (at[3], 45), (at[5] + 45, len(data) - at[5] - 45)]
    assert list(warc.salvage(b"")) == [] and len(list(warc.salvage(b"junk"))) == 1


def test_real_archive_files(spark, tmp_path):
    raw = warc.gzip_member(warc.record(9, "http://x", b"hi", warc.digest(b"hi"), None))
    (tmp_path / "a.warc.gz").write_bytes(raw)
    got = warc.read(spark.read.format("binaryFile").load(str(tmp_path))).first()
    assert (got["page_id"], bytes(got["payload"]), got["payload_digest"]) == (9, b"hi", warc.digest(b"hi"))


def test_odd_spaces_are_those_of_the_pattern():
    parts = ["a", "é", " ", "\n", "\t", "\x85", " ", " ", "　", "\x1c", "中", ""]
    for text in ("".join(some) for some in itertools.product(parts, repeat=4)):
        assert pretokens.has_odd_spaces(text) == (pretokens.ODD_SPACES.search(text) is not None), repr(text)


def test_ids_are_those_of_the_library_with_special_strings_in_texts(docs_of):
    from tokenizers import Tokenizer

    own, rng = Tokenizer.from_file(JSON), random.Random(3)
    parts = ["<|endoftext|>", " ", "a", "  ", "\n", "é", " b", "<|", "|>"]
    rows = [(0, "a <|endoftext|> b"), *((i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))) for i in range(1, 400))]
    got = {r["doc_id"]: r["ids"] for r in token_files.read(token_files.write(docs_of(rows), JSON, PATTERN)).collect()}
    assert got == {i: [*own.encode(t, add_special_tokens=False).ids, 0] for i, t in rows} and got[0] == [64, 220, 50256, 275, 0]


def test_the_round_trip_in_one_pass_is_encoding_and_decoding(docs):
    both = bpe.round_trip(docs.withColumnRenamed("part", "token_ids"), RANKS, PATTERN)
    want = bpe.decode(bpe.encode(docs, RANKS, PATTERN), RANKS).selectExpr("doc_id", "token_ids", "sha2(decoded, 256) d")
    assert named(both, "doc_id", "token_ids", "decoded_sha256") == named(want, *want.columns)
    assert bpe.round_trip(docs.limit(0), RANKS, PATTERN).count() == 0


def test_a_memo_bounded_by_bytes_gives_the_same_ids():
    texts = [f"word{i} other{i % 7} é{i}" for i in range(500)]
    encode = lambda ts: bpe.vocabulary(RANKS).encode([t.encode() for t in ts])
    small, large = (pretokens.Memo(PATTERN, encode, most_bytes=n) for n in (2000, 1 << 30))
    for i in range(0, 500, 20):
        assert small.ids(texts[i : i + 20]) == large.ids(texts[i : i + 20])
    assert len(small.plain) + len(small.spaced) < 200 < len(large.plain) + len(large.spaced)


def test_joined_pieces_have_the_ids_of_single_ones():
    encoder = token_files.Encoder(JSON)
    texts = ["", " ", " a", "a", "  a", " a b", " a\n", " \na", " é中", " don't", " x.\n\ny", " 12ab", " <|endoftext|>", " Ġx", " a "]
    for some in (texts, texts[2:3], texts[:2], []):
        assert encoder.encode(some) == encoder._each(some)
