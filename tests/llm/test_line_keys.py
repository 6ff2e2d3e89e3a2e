"""Line keys: made once for a document, and of the same letters as before."""

from __future__ import annotations

from pyspark.sql import functions as F

from kpiscope.llm import lines, shared


def test_lines_are_normalised_and_hashed_once(spark, monkeypatch):
    """The texts were split, normalised and hashed to count keys, again to find those of a text, and again to drop its lines."""
    plans = {}

    def watched(df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return shared.stash(df, name)

    monkeypatch.setattr(lines, "stash", watched)
    docs = spark.createDataFrame([(k, f"Common\nown {k}\n COMMON \t\ncommon\n") for k in range(10)] + [(10, None)], "doc_id long, text string")
    out = lines.dedup(docs)
    rest = out._jdf.queryExecution().optimizedPlan().toString()
    assert [name for name, plan in (plans | {"result": rest}).items() if "btrim" in plan or "trim(" in plan] == ["line-keys"]
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in out.collect()}
    assert got == {k: (f"own {k}\n", 5, 3) for k in range(10)} | {10: ("", 1, 0)}


def test_only_ascii_letters_are_lowered(spark):
    texts = ["ABC xyZ 1\n", "ÀÉ Straße ΣΑΣ", "İI K K", "ǅ Ⅷ Ⓐ Z", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", shared.lower_ascii(F.col("t")).alias("low")).collect()
    table = str.maketrans(shared.UPPER, shared.LOWER)
    assert {r["t"]: r["low"] for r in rows} == {t: t and t.translate(table) for t in texts}
