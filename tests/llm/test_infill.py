"""Cuts, forms and round trips against straight loops."""

from __future__ import annotations

import hashlib
import random
import re

from kpiscope.llm import infill

UNIT = re.compile("[A-Za-z]+|[^A-Za-z]")


def loop(doc_id, text):
    text = text or ""
    units, h = UNIT.findall(text), hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_infill(docs_of):
    rng = random.Random(2)
    parts = ["word", "Two", " ", "\n", "é", "中", "😀", "$1", "\\", "<", "P>", "<S", ">", " ", "\r\n", "9"]
    texts = ["", None, "x", " ", "<P>", "a<M>b", "<p>", "$2 \\1", "<<S>"] + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 30))) for _ in range(300)]
    texts += ["word é " * 150_000, "z" * 500_000, "\n" * 300_000, "a b" * 200_000]
    rows = [(10 * i + rng.randrange(10), t) for i, t in enumerate(texts * 2)]
    rows += [rows[20], (None, "no id here"), (-7, "a minus")]
    out = infill.transform(docs_of(rows, output="mine", a="a", row="r")).withColumn("restored", infill.restore(infill.F.col("output"), infill.F.col("form")))
    assert {"a", "row"} < set(out.columns) and out.columns.count("output") == 1
    got = sorted(((r["doc_id"], *(r[c] for c in infill.RESULT), r["restored"]) for r in out.collect()), key=repr)
    assert got == sorted(((i, *loop(i, t), t or "") for i, t in rows), key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    assert infill.transform(docs_of(rows).limit(0)).count() == 0
