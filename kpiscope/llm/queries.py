"""One query for each operator over its whole table, and SQL counterparts where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiscope.llm import bpe, centroids, decontam, html, infill, language, lines, neardup, quality, token_counts, token_files, urls, warc
from kpiscope.llm.shared import load

Query = Callable[[SparkSession, str], DataFrame]

#: Fixed by the contract of op4: verdict, host, path.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op1_quality_llr(spark: SparkSession, sf: str) -> DataFrame:
    docs = load(spark, sf, "documents").select("doc_id", "text")
    ratios = quality.fit(docs, load(spark, sf, "labels").filter("quality = 1"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")
    return quality.judge(docs, ratios).select("doc_id", *names)


def op2_minhash_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.dedup(load(spark, sf, "documents").select("doc_id", "text")).select("doc_id", *neardup.RESULT)


def op3_html_text(spark: SparkSession, sf: str) -> DataFrame:
    return html.extract(load(spark, sf, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


def op4_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    return urls.judge(load(spark, sf, "pages").select("page_id", "url"), RULES).select("page_id", "host", "path", "rule", "verdict")


def op5_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    docs = load(spark, sf, "documents").select("doc_id", "text")
    both = bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return both.select("doc_id", *bpe_digests(), "decoded_sha256")


def bpe_digests() -> list:
    """Number and digest of the ids."""
    joined = F.array_join(F.col("token_ids").cast("array<string>"), " ")
    return [F.size("token_ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256")]


def op6_token_files(spark: SparkSession, sf: str) -> DataFrame:
    segments = token_files.write(load(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, end_id=0)
    return token_files.read(segments, with_ids=False)


def op7_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    out = lines.dedup(load(spark, sf, "documents").select("doc_id", "text"), least_docs=10, least_chars=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


def op8_warc(spark: SparkSession, sf: str) -> DataFrame:
    found = warc.read(warc.write(load(spark, sf, "pages"), least_bytes=0))
    return found.filter("reason is null").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = load(spark, sf, "documents").select("doc_id", "text", "lang")
    out = language.predict(docs.select("doc_id", "text"), language.fit(docs))
    return out.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "margin", "rejected")


def op10_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    out = decontam.decontaminate(load(spark, sf, "documents").select("doc_id", "text"), load(spark, sf, "benchmark"))
    return out.select("doc_id", "n_items", "first_item", "contaminated", "kept")


def op11_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    out = token_counts.count(load(spark, sf, "documents").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"), limit=4096)
    return out.select("doc_id", *token_counts.RESULT)


def op12_centroids(spark: SparkSession, sf: str) -> DataFrame:
    out = centroids.cluster(load(spark, sf, "embeddings").select("vec_id", "embedding"), k=40, rounds=5, dims=64)
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_infill(spark: SparkSession, sf: str) -> DataFrame:
    out = infill.transform(load(spark, sf, "documents").select("doc_id", "text"))
    restored = infill.restore(F.col("output"), F.col("form"))
    digests = [F.sha2(F.encode(c, "UTF-8"), 256).alias(name) for c, name in ((F.col("output"), "output_sha256"), (restored, "restored_sha256"))]
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def pipeline(spark: SparkSession, sf: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_quality_llr, op2_minhash_near_dedup, op3_html_text, op4_url_filter, op5_byte_bpe, op6_token_files, op7_line_dedup,
        op8_warc, op9_language_id, op10_decontamination, op11_token_counts, op12_centroids, op13_infill, pipeline,
    )
}

URL_PARTS = r"""
located AS (SELECT page_id,
  CASE WHEN instr(url, '://') > 0 THEN substring(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (SELECT page_id,
  translate(regexp_extract(coalesce(rest, ''), '\A[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(rest, ''), '\A[^/?#]*([^?#]*)', 1) AS path FROM located)"""

BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

ROUNDS = 5


def clusters_sql() -> str:
    """Rounds of assigning and moving, written out one after the other."""
    away = "list_sum(list_transform(range(64), lambda i: (p[i + 1] - c[i + 1]) * (p[i + 1] - c[i + 1])))"
    parts = ["""
points AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, sha256('2:' || vec_id) AS h, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS p
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, p) - 1 AS k, p AS c FROM points QUALIFY k < 40)"""]
    for n in range(ROUNDS + 1):
        parts.append(f"""
near{n} AS MATERIALIZED (SELECT r, vec_id, p, k, d FROM (SELECT r, vec_id, p, k, {away} AS d FROM points, c{n})
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, k) = 1)""")
        if n < ROUNDS:
            parts.append(f"""
mean{n} AS (SELECT k, list(m ORDER BY i) AS c FROM (SELECT k, i, ((s - ((s % n) + n) % n) // n)::BIGINT AS m
  FROM (SELECT k, i, sum(v) AS s, count(*) AS n FROM (SELECT k, unnest(p) AS v, unnest(range(64)) AS i FROM near{n}) GROUP BY k, i)) GROUP BY k),
c{n + 1} AS MATERIALIZED (SELECT a.k, coalesce(b.c, a.c) AS c FROM c{n} a LEFT JOIN mean{n} b ON a.k = b.k)""")
    return f"""WITH{",".join(parts)}
SELECT vec_id, n.k::INTEGER AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY n.k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256
FROM near{ROUNDS} n JOIN c{ROUNDS} f ON f.k = n.k"""


ORACLES: dict[str, str] = {
    "op12_centroids": clusters_sql(),
    "op13_infill": r"""
WITH cut AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || doc_id) AS h FROM documents),
drawn AS (SELECT *, len(u)::BIGINT AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM cut),
formed AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
parts AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM formed)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM parts""",
    "op4_url_filter": f"""
WITH rules(verdict, rule_host, rule_path) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
{URL_PARTS},
fits AS (SELECT page_id, rule_host || rule_path AS rule, verdict,
  row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host) DESC, length(rule_path) DESC) AS n
  FROM split JOIN rules ON (host = rule_host OR host LIKE '%.' || rule_host) AND starts_with(path, rule_path))
SELECT s.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM split s LEFT JOIN fits f ON f.page_id = s.page_id AND n = 1""",
    "op7_line_dedup": f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS all_lines FROM documents),
lines AS (SELECT r, doc_id, unnest(all_lines) AS line, generate_subscripts(all_lines, 1) AS pos FROM docs),
keyed AS (SELECT *, translate(trim(line, {BLANKS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
frequent AS (SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10),
marked AS (SELECT k.*, f.key IS NOT NULL AS drop_it FROM keyed k LEFT JOIN frequent f ON f.key = k.key)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (drop_it) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT drop_it), '')) AS kept_sha256
FROM marked GROUP BY r""",
    "op10_decontamination": r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS h FROM documents),
items AS (SELECT * FROM (SELECT row_number() OVER () AS b, item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS h FROM benchmark) WHERE len(h) >= 5),
ours AS (SELECT r, unnest(h) AS w, unnest(range(len(h))) AS i FROM docs),
theirs AS (SELECT b, least(13, len(h)) AS size, unnest(h) AS w, unnest(range(len(h))) AS j FROM items),
laid AS (SELECT r, b, size, i - j AS off, j FROM ours JOIN theirs USING (w)),
often AS (SELECT *, count(*) OVER (PARTITION BY r, b, off) AS n FROM laid QUALIFY n >= 0.8 * least(size, 7)),
windows AS (SELECT r, b, size, count(*) OVER (PARTITION BY r, b, off ORDER BY j RANGE BETWEEN CURRENT ROW AND 12 FOLLOWING) AS same FROM often),
found AS (SELECT r, count(DISTINCT item_id) AS n_items, min(item_id) AS first_item FROM windows JOIN items USING (b) WHERE same >= 0.8 * size GROUP BY r)
SELECT doc_id, coalesce(n_items, 0) AS n_items, first_item, n_items IS NOT NULL AS contaminated, n_items IS NULL AS kept
FROM docs LEFT JOIN found USING (r)""",
}
