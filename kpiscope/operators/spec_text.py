"""Specification text: ids, sections, long-section splits, clean-up, filters.

Pages are (file, page, text). Sections may run over page borders.
"""

from __future__ import annotations

import bisect
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kpiscope.functions.exprs import col

# A clause number that begins a line, and the two forms of file names.
NUMBER = r"\d+(?:\.\d+)+"
VERSIONED_NAME = r"ts_1(\d{5})v\d+p"
DOTTED_NAME = r"ts[_\s]?(\d\d\.\d{3})"


def spec_id(name: str | Column) -> Column:
    """Specification number told by a file name (`ts_128552v190500p.pdf`, else `TS_38.214.pdf`); the name itself when there is none."""
    n = col(name)
    versioned, dotted = F.regexp_extract(F.lower(n), VERSIONED_NAME, 1), F.regexp_extract(F.lower(n), DOTTED_NAME, 1)
    five = F.concat(F.lit("TS "), F.substring(versioned, 1, 2), F.lit("."), F.substring(versioned, 3, 3))
    return F.when(versioned != "", five).when(dotted != "", F.concat(F.lit("TS "), dotted)).otherwise(n)


def _numbered(pages: DataFrame) -> DataFrame:
    """Lines of all pages with what they are: `bare` (only a clause number), `full` (number and title), `said` (not blank)."""
    rows = pages.select("file", "page", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("no", "line"))
    said = ~F.col("line").rlike(r"^\s*$")
    return rows.withColumns({"said": said, "bare": F.col("line").rlike(rf"^{NUMBER}\s*$"), "full": F.col("line").rlike(rf"^{NUMBER}[^\S\n]+\S")})


def heading_lines(pages: DataFrame) -> DataFrame:
    """Lines with `opens` (a heading begins here) and `is_title` (it is the title of a number on a line before).

    A number alone on its line takes the next line that is not blank as its title, whatever that is and however many pages on it stands;
    of several numbers in a row every other one is a title. Whether a page begins with such an open number depends on the pages before it only
    through the parity of the numbers that stand in a row up to its start, so pages are counted first, that parity is carried over the
    pages of a file, and lines are looked at inside their page.
    """
    page = Window.partitionBy("file", "page").orderBy("no")
    lines = _numbered(pages).withColumn("said_no", F.sum(F.col("said").cast("int")).over(page))
    bound = F.col("said") & ~F.col("bare")  # ends a row of numbers
    lines = lines.withColumn("_run", F.sum(bound.cast("int")).over(page.rowsBetween(Window.unboundedPreceding, -1)))
    lines = lines.withColumn("_run", F.coalesce("_run", F.lit(0)))
    in_run = Window.partitionBy("file", "page", "_run").orderBy("no").rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumn("_before", F.coalesce(F.sum(F.col("bare").cast("int")).over(in_run), F.lit(0)))

    last_bound = F.max(F.when(bound, F.col("no")))
    ends = lines.groupBy("file", "page").agg(
        last_bound.alias("_bound"), F.max_by(F.col("_before") + F.col("bare").cast("int"), "no").alias("_open_run"), F.max_by(bound, "no").alias("_closed"), F.count_if("said").alias("_said")
    )
    # numbers in a row at the page's end: none if the last line closes the row
    row_left = F.when(F.col("_closed"), 0).otherwise(F.col("_open_run")).cast("int")
    order = Window.partitionBy("file").orderBy("page")
    ends = ends.withColumns({"_left": row_left, "_reset": F.col("_bound").isNotNull().cast("int")}).withColumn("_group", F.sum("_reset").over(order))
    carried = F.sum("_left").over(Window.partitionBy("file", "_group").orderBy("page"))
    ends = ends.withColumn("_after", carried).withColumn("_carry", F.coalesce(F.lag("_after").over(order), F.lit(0)) % 2)
    # a number that nothing follows in its file has no title and is no heading
    last = F.max(F.when(F.col("_said") > 0, F.col("page"))).over(Window.partitionBy("file"))
    state = ends.select("file", "page", "_carry", F.when(F.col("page") == last, F.col("_said")).alias("_last"))

    row = F.col("_before") + F.when(F.col("_run") == 0, F.col("_carry")).otherwise(0)
    taken = F.col("said") & (row % 2 == 1)
    marked = lines.join(state, ["file", "page"]).withColumn("is_title", taken)
    return marked.withColumn("opens", (F.col("full") | F.col("bare") & ~F.coalesce(F.col("said_no") == F.col("_last"), F.lit(False))) & ~F.col("is_title")).select("file", "page", "no", "line", "bare", "opens", "is_title")


def sections(pages: DataFrame, min_body: int = 0, max_depth: int | None = None) -> DataFrame:
    """One row per numbered section: (file, section, clause, title, body, page_start, page_end).

    Section numbers are a running count of headings: counted by page, added up over the pages of a file, and counted on inside a page, so
    only one row a page of a file meets in a task. The lines of one section meet in one row, its body.
    """
    lines = heading_lines(pages)
    counts = lines.groupBy("file", "page").agg(F.sum(F.col("opens").cast("int")).alias("_n"))
    counts = counts.withColumn("_base", F.sum("_n").over(Window.partitionBy("file").orderBy("page")) - F.col("_n")).drop("_n")
    within = F.sum(F.col("opens").cast("int")).over(Window.partitionBy("file", "page").orderBy("no"))
    numbered = lines.withColumn("_within", within).join(counts, ["file", "page"])
    numbered = numbered.withColumn("section", (F.col("_base") + F.col("_within")).cast("int")).filter("section > 0")
    title = F.when(F.col("is_title"), F.trim(F.regexp_replace("line", r"^\s+", ""))).when(F.col("opens") & ~F.col("bare"), F.trim(F.regexp_replace("line", rf"^{NUMBER}\s+", "")))
    rest = F.when(~F.col("opens") & ~F.col("is_title"), F.struct("page", "no", "line"))
    whole = numbered.groupBy("file", "section").agg(
        F.max(F.when(F.col("opens"), F.regexp_extract("line", rf"^{NUMBER}", 0))).alias("clause"),
        F.max(title).alias("title"),
        F.array_sort(F.collect_list(rest)).alias("_lines"),
        F.min("page").alias("page_start"),
        F.max("page").alias("page_end"),
    )
    text = F.array_join(F.transform("_lines", lambda x: x["line"]), "\n")
    out = whole.select(
        "file", "section", "clause", "title", F.regexp_replace(text, r"^\s+|\s+$", "").alias("body"), "page_start", "page_end"
    )
    depth = F.size(F.split("clause", r"\."))
    keep = F.length("body") >= min_body
    if max_depth is not None:
        keep = keep & (depth <= max_depth)
    return out.filter(keep)


def section_tables(secs: DataFrame, tables: DataFrame) -> DataFrame:
    """Tables (file, page, table_no, table) of the pages a section covers."""
    pages = secs.select("file", "section", F.explode(F.sequence("page_start", "page_end")).alias("page"))
    return pages.join(tables, ["file", "page"])


#: Where a part may end, best first: before an empty line, before the full stop of a sentence.
BREAKS = (re.compile(r"\n(?=\n)"), re.compile(r"\.(?=[ \n])"))


def _split_body(body: str, limit: int, overlap: int) -> list[str]:
    """Parts of at most `limit` characters. Every break of the body is found once; a part ends at the last one of the best
    kind in its second half, else at its limit, and the next part begins `overlap` before that."""
    marks = [[m.start() for m in pattern.finditer(body)] for pattern in BREAKS]
    spans, start = [], 0
    while start + limit < len(body):
        low, high = start + limit // 2, start + limit
        ends = [places[k - 1] for places in marks if (k := bisect.bisect_left(places, high - 1)) and places[k - 1] >= low]
        end = ends[0] if ends else high
        spans.append((start, end))
        start = max(start, end - overlap)
    texts = [body[a:b].strip() for a, b in (*spans, (start, len(body)))]
    return [t for t in texts if t] if spans else [body]


def split_long(secs: DataFrame, max_chars: int, overlap: int = 200) -> DataFrame:
    """Sections over the limit in overlapping parts; clause and title name the part.

    Where a cut falls depends on the cut before, so this is a Python helper. It takes plain rows, which Spark sends a hundred
    at a time: an Arrow batch would hold ten thousand long bodies and all their parts. Sections
    within the limit, and those without a body, do not need it and stay as they are.
    """
    if max_chars // 2 <= overlap:
        raise ValueError("parts must be longer than twice the overlap")

    @F.udf(T.ArrayType(T.StringType()), useArrow=False)
    def parts_of(body: str) -> list[str]:
        return _split_body(body, max_chars, overlap)

    long = F.coalesce(F.length("body") > max_chars, F.lit(False))
    short_rows = secs.filter(~long).withColumn("part_no", F.lit(1)).withColumn("n_parts", F.lit(1))
    cut = (
        secs.filter(long)
        .withColumn("_p", parts_of.asNondeterministic()("body"))  # else a filter on its size cuts every body a second time
        .withColumn("n_parts", F.size("_p"))
        .select(*[c for c in secs.columns if c != "body"], "n_parts", F.posexplode("_p").alias("_i", "body"))
        .withColumn("part_no", F.col("_i") + 1)
        .drop("_i")
        .withColumn("clause", F.concat_ws("/", "clause", "part_no"))
        .withColumn("title", F.format_string("%s (part %d/%d)", "title", "part_no", "n_parts"))
    )
    return short_rows.unionByName(cut)


def normalize(text: str | Column) -> Column:
    """Join words broken at line ends, squeeze blanks, keep at most one empty line."""
    t = F.regexp_replace(F.coalesce(col(text), F.lit("")), r"-\n([\p{L}\p{N}_])", "$1")
    t = F.regexp_replace(t, r"[ \t]+", " ")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    return F.regexp_replace(t, r"^\s+|\s+$", "")


def relevance_filter(chunks: DataFrame, delta: float, score: str = "relevance") -> DataFrame:
    return chunks.filter(F.col(score) >= delta)


def skipped_count(chunks: DataFrame, delta: float, score: str = "relevance") -> DataFrame:
    return chunks.agg(F.count_if(F.col(score) >= delta).alias("kept"), F.count_if(F.col(score) < delta).alias("skipped"))


def condense(body: str | Column, summary: str | Column, threshold: int) -> Column:
    """Body up to the threshold as it is; beyond it the summary if usable, else the cut body."""
    b = col(body)
    s = F.regexp_replace(F.coalesce(col(summary), F.lit("")), r"^\s+|\s+$", "")
    usable = (s != "") & (F.length(s) <= F.length(b))
    return F.when(F.length(b) <= threshold, b).when(usable, s).otherwise(F.substring(b, 1, threshold))
