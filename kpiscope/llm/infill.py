"""Fill-in-middle transformation by a counted-quantifier regular expression, with DataFrame functions only.

regexp_count gives the number n of units of a text (a run of letters, or any other character). Two cuts a <= b between units are
drawn from hashes of the id. A pattern made for each row, with the possessive groups (unit){a}+ and (unit){b-a}+, captures
prefix, middle and suffix in one match, and one replacement writes them in the order of the form. Possessive counted groups
are loops in the regular-expression library, without recursion, so the length of a text does not matter; a unit has one way to
match at a place, so nothing is given up by not going back.

`restore` builds the text from output and form alone: a marked output is cut at its three marks, which no text has
that was transformed.

Nulls: a null or empty text is plain, with 0 units and an empty output. A null id is hashed as an empty one. Repeated rows come out alike.
An empty table gives an empty table. Extra columns pass through; input columns named like the results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed by the contract: what a unit is, the marks, and the shares of texts left plain and of the second form.
UNIT = "[A-Za-z]+|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARK = "<[PSM]>"
FORM_SHARE, SPM_SHARE = 90, 20
RESULT = ["n", "form", "prefix_chars", "middle_chars", "output"]


def draws(doc_id: Column, seed: int = 1) -> list[Column]:
    """Four whole numbers under 2^32 from a document's id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def transform(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", seed: int = 1) -> DataFrame:
    """Add RESULT to every document: units, form, characters of prefix and middle (null if plain), and the output."""
    kept = [c for c in docs.columns if c not in RESULT]
    h1, h2, h3, h4 = draws(F.col(f"row.`{doc_id}`"), seed)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    rows = rows.withColumn("n", F.regexp_count("text", F.lit(UNIT)).cast("long"))
    plain = (F.col("text") == "") | F.col("text").rlike(MARK) | (h3 % 100 >= FORM_SHARE)
    first, second = h1 % (F.col("n") + 1), h2 % (F.col("n") + 1)
    rows = rows.withColumns({"form": F.when(plain, "plain").when(h4 % 100 < SPM_SHARE, "spm").otherwise("psm"), "a": F.least(first, second), "b": F.greatest(first, second)})
    pattern = F.format_string(rf"(?s)\A((?:{UNIT}){{%d}}+)((?:{UNIT}){{%d}}+)(.*)\z", F.col("a"), F.col("b") - F.col("a"))
    written = F.when(F.col("form") == "spm", f"{SUFFIX}$3{PREFIX}$1{MIDDLE}$2").otherwise(f"{PREFIX}$1{SUFFIX}$3{MIDDLE}$2")
    rows = rows.withColumn("output", F.when(F.col("form") == "plain", F.col("text")).otherwise(F.regexp_replace(F.col("text"), pattern, written)))
    prefix, middle, _ = pieces(F.col("output"), F.col("form"))
    return rows.select("row.*", "n", "form", F.length(prefix).cast("long").alias("prefix_chars"), F.length(middle).cast("long").alias("middle_chars"), "output")


def pieces(output: Column, form: Column) -> tuple[Column, Column, Column]:
    """Prefix, middle and suffix of a marked output; null if plain."""
    cut = F.when(form != "plain", F.split(output, MARK, -1))
    spm = form == "spm"
    return F.get(cut, F.when(spm, 2).otherwise(1)), F.get(cut, F.lit(3)), F.get(cut, F.when(spm, 1).otherwise(2))


def restore(output: Column, form: Column) -> Column:
    """The text that was transformed, from output and form."""
    prefix, middle, suffix = pieces(output, form)
    return F.when(form == "plain", output).otherwise(F.concat(prefix, middle, suffix))
