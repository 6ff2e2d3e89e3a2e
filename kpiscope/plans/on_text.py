"""Queries on specification text."""

from __future__ import annotations

from pyspark.sql import functions as F

from kpiscope.operators import spec_text as tx
from kpiscope.plans.registry import query
from kpiscope.sources.tables import load


@query(
    "tx_spec_id",
    """WITH f AS (SELECT p_partkey, p_name, lpad(CAST(p_partkey % 1000 AS VARCHAR), 3, '0') AS n FROM part)
    SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'TS 28.' || n WHEN 1 THEN 'TS 38.' || n ELSE p_name END AS spec FROM f""",
)
def tx_spec_id(spark, sf):
    k = F.col("p_partkey")
    n = F.lpad((k % 1000).cast("string"), 3, "0")
    name = (
        F.when(k % 3 == 0, F.concat(F.lit("ts_128"), n, F.lit("v190500p.pdf")))
        .when(k % 3 == 1, F.concat(F.lit("TS_38."), n, F.lit(".pdf")))
        .otherwise(F.col("p_name"))
    )
    return load(spark, sf, "part").select("p_partkey", tx.spec_id(name).alias("spec"))


def pages(spark, sf):
    """Conversations read as files: even turns open a numbered section, odd turns carry it on. Every third file has its titles on the next line."""
    turn = F.col("turn")
    gap = F.when(F.col("conv_id") % 3 == 0, " \n\nTitle ").otherwise(" Title ")
    head = F.concat((turn + 1).cast("string"), F.lit("."), (F.col("conv_id") % 7 + 1).cast("string"), gap, "role", F.lit("\n"))
    return load(spark, sf, "conversations").select(
        F.col("conv_id").alias("file"),
        turn.alias("page"),
        F.concat(F.when(turn % 2 == 0, head).otherwise(""), "text").alias("text"),
    )


SECTIONS = """WITH s AS (SELECT a.conv_id AS file, a.turn // 2 + 1 AS section, (a.turn + 1) || '.' || (a.conv_id % 7 + 1) AS clause, 'Title ' || a.role AS title,
    regexp_replace(a.text || coalesce(chr(10) || b.text, ''), '^\\s+|\\s+$', '', 'g') AS body, a.turn AS page_start, coalesce(b.turn, a.turn) AS page_end
  FROM conversations a LEFT JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 WHERE a.turn % 2 = 0)
"""


@query("tx_sections", SECTIONS + "SELECT file, CAST(section AS INTEGER) AS section, clause, title, length(body) AS body_length, md5(body) AS body_md5, page_start, page_end FROM s WHERE length(body) >= 20")
def tx_sections(spark, sf):
    out = tx.sections(pages(spark, sf), min_body=20, max_depth=2)
    return out.select(
        "file", "section", "clause", "title", F.length("body").cast("long").alias("body_length"), F.md5("body").alias("body_md5"), "page_start", "page_end"
    )


@query("tx_section_tables", SECTIONS + "SELECT s.file, CAST(section AS INTEGER) AS section, c.turn AS page, c.role AS tbl FROM s JOIN conversations c ON c.conv_id = s.file AND c.turn BETWEEN page_start AND page_end WHERE c.role = 'assistant'")
def tx_section_tables(spark, sf):
    tables = load(spark, sf, "conversations").filter("role = 'assistant'").select(
        F.col("conv_id").alias("file"), F.col("turn").alias("page"), F.col("role").alias("tbl")
    )
    return tx.section_tables(tx.sections(pages(spark, sf)), tables).select("file", "section", "page", "tbl")


# the last empty line, else the last full stop, in the second half of a part of 3,000 characters
LINE, STOP = (f"length(regexp_extract(substr(text, start + 1501, 1500), '(?s)^.*{mark}'))" for mark in (r"\n\n", r"[.][ \n]"))
CUT = f"CASE WHEN {LINE} > 0 THEN start + 1498 + {LINE} WHEN {STOP} > 0 THEN start + 1498 + {STOP} ELSE start + 3000 END"


@query(
    "tx_split_long",
    f"""WITH RECURSIVE s AS (SELECT doc_id, lang, text, 0 AS k, 0::BIGINT AS start FROM documents WHERE length(text) > 3000
      UNION ALL SELECT doc_id, lang, text, k + 1, greatest(start, {CUT} - 200) FROM s WHERE start + 3000 < length(text)),
    p AS (SELECT doc_id, lang, k, trim(substr(text, start + 1, CASE WHEN start + 3000 < length(text) THEN {CUT} ELSE length(text) END - start), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM s),
    n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS part_no, count(*) OVER (PARTITION BY doc_id) AS n_parts FROM p WHERE body <> '')
    SELECT doc_id, '1.' || doc_id || '/' || part_no AS clause, coalesce(lang, 'null') || ' (part ' || part_no || '/' || n_parts || ')' AS title, part_no::INTEGER AS part_no, n_parts::INTEGER AS n_parts, length(body)::INTEGER AS body_length, md5(body) AS body_md5 FROM n
    UNION ALL SELECT doc_id, '1.' || doc_id, lang, 1, 1, length(text)::INTEGER, md5(text) FROM documents WHERE NOT coalesce(length(text) > 3000, false)""",
)
def tx_split_long(spark, sf):
    docs = load(spark, sf, "documents").select(
        F.col("doc_id"), F.concat(F.lit("1."), F.col("doc_id")).alias("clause"), F.col("lang").alias("title"), F.col("text").alias("body")
    )
    return tx.split_long(docs, 3000).select("doc_id", "clause", "title", "part_no", "n_parts", F.length("body").alias("body_length"), F.md5(F.col("body").cast("binary")).alias("body_md5"))


@query(
    "tx_normalize",
    """WITH a AS (SELECT doc_id, regexp_replace(text, '-\\n([\\pL\\pN_])', '\\1', 'g') AS t FROM documents),
    b AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, '[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS t FROM a)
    SELECT doc_id, length(t) AS n, md5(t) AS text_md5 FROM b""",
)
def tx_normalize(spark, sf):
    t = load(spark, sf, "documents").select("doc_id", tx.normalize("text").alias("t"))
    return t.select("doc_id", F.length("t").cast("long").alias("n"), F.md5("t").alias("text_md5"))


def _relevance(spark, sf):
    return load(spark, sf, "documents").select("doc_id", "lang", (F.col("n_chars") / 4000).alias("relevance"))


@query("tx_relevance_filter", "SELECT doc_id, lang FROM documents WHERE n_chars / 4000 >= 0.3")
def tx_relevance_filter(spark, sf):
    return tx.relevance_filter(_relevance(spark, sf), 0.3).drop("relevance")


@query("tx_skipped_count", "SELECT count(*) FILTER (n_chars / 4000 >= 0.3) AS kept, count(*) FILTER (n_chars / 4000 < 0.3) AS skipped FROM documents")
def tx_skipped_count(spark, sf):
    return tx.skipped_count(_relevance(spark, sf), 0.3)


@query(
    "tx_truncate",
    """WITH s AS (SELECT doc_id, text, CASE doc_id % 3 WHEN 0 THEN ' ' WHEN 1 THEN ' summary of ' || lang ELSE text || text END AS m FROM documents),
    t AS (SELECT doc_id, CASE WHEN length(text) <= 1000 THEN text WHEN trim(m) <> '' AND length(regexp_replace(m, '^\\s+|\\s+$', '', 'g')) <= length(text) THEN trim(m) ELSE substr(text, 1, 1000) END AS b FROM s)
    SELECT doc_id, length(b) AS n, md5(b) AS body_md5 FROM t""",
)
def tx_truncate(spark, sf):
    d = F.col("doc_id")
    summary = F.when(d % 3 == 0, F.lit(" ")).when(d % 3 == 1, F.concat(F.lit(" summary of "), "lang")).otherwise(F.concat("text", "text"))
    b = load(spark, sf, "documents").select("doc_id", tx.condense("text", summary, 1000).alias("b"))
    return b.select("doc_id", F.length("b").cast("long").alias("n"), F.md5("b").alias("body_md5"))
