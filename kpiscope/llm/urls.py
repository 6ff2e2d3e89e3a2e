"""URL filters: a trie over reversed host labels, then path segments, with longest-match precedence.

A rule is (verdict, host, path). It fits its host and all subdomains if the url's path starts with the rule's path. Of the
rules that fit, the one with the longest host wins, then the longest path, then block before allow. Urls that no rule
fits get the default verdict. The trie is broadcast: its number of rules is checked against MOST_RULES; longer lists are
joined by host suffix and path prefix instead, with the same result.

Nulls: a null url, or one without `://`, has an empty host and path, so no rule fits. Repeated rows are judged each.
Extra columns pass through; input columns named like the results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kpiscope.llm.shared import LOWER, UPPER, sheltered

#: At about 1 kB a rule in Python, a worker holds 200 MB at most.
MOST_RULES = 200_000
Rule = tuple[str, str, str]


def parts(df: DataFrame, url: str = "url") -> DataFrame:
    """Add host and path."""
    has = F.instr(F.col(url), "://") > 0
    rest = F.when(has, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"\A[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return df.withColumns({"host": F.coalesce(host, F.lit("")), "path": F.coalesce(path, F.lit(""))})


class Trie:
    """Nodes are dicts: host labels from the right, then below PATHS whole segments; RULES holds what ends at a node."""

    PATHS, RULES = object(), object()

    def __init__(self, rules: Iterable[Rule]):
        self.root: dict = {}
        for verdict, host, path in rules:
            node = self.root
            for label in reversed(host.split(".")):
                node = node.setdefault(label, {})
            node = node.setdefault(self.PATHS, {})
            *whole, rest = path.split("/")
            for segment in whole:
                node = node.setdefault(segment, {})
            # what stands after the last slash is only the start of a segment
            old = node.setdefault(self.RULES, {}).get(rest)
            if old is None or verdict == "block":
                node[self.RULES][rest] = (verdict, host + path)

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """Verdict and text of the winning rule."""
        node, best = self.root, None
        segments = path.split("/")
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                break
            if self.PATHS in node:  # a longer host wins over any shorter one
                best = self._path(node[self.PATHS], segments) or best
        return best

    def _path(self, node: dict, segments: list[str]) -> tuple[str, str] | None:
        best = None
        for segment in segments:
            fits = [r for r in node.get(self.RULES, ()) if segment.startswith(r)]
            if fits:
                best = node[self.RULES][max(fits, key=len)]
            node = node.get(segment)
            if node is None:
                break
        return best


@sheltered("_found", "_n")
def judge(df: DataFrame, rules: list[Rule], url: str = "url", default: str = "allow", most: int = MOST_RULES) -> DataFrame:
    """Add host, path, rule (null if none fits) and verdict."""
    df = parts(df, url)
    if len(rules) > most:
        return _joined(df, rules, default)
    held = df.sparkSession.sparkContext.broadcast(rules)
    kept: dict = {}

    @F.pandas_udf("rule string, verdict string")
    def match(host: pd.Series, path: pd.Series) -> pd.DataFrame:
        trie = kept.setdefault("trie", None) or Trie(held.value)
        kept["trie"] = trie
        found = [trie.match(h, p) or (default, None) for h, p in zip(host, path, strict=True)]
        return pd.DataFrame({"rule": [r for _, r in found], "verdict": [v for v, _ in found]}, dtype=object)

    names = [c for c in df.columns if c not in ("rule", "verdict")]
    return df.withColumn("_found", match("host", "path")).select(*(F.col(f"`{c}`") for c in names), "_found.rule", "_found.verdict")


def _joined(df: DataFrame, rules: list[Rule], default: str) -> DataFrame:
    """The same by a join: each distinct (host, path) is looked up with its host suffixes; no row is multiplied by rules
    of other hosts, and the widest rule lists of a host are split by their first path segment."""
    spark = df.sparkSession
    table = spark.createDataFrame(rules, "verdict string, rule_host string, rule_path string")
    table = table.groupBy("rule_host", "rule_path").agg(F.max("verdict").alias("verdict"))  # block sorts after allow
    urls = df.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffix = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    sizes = F.array(*(F.lit(n) for n in sorted({len(path) for _, _, path in rules})))
    starts = F.transform(F.filter(sizes, lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    wide = urls.select("host", "path", F.explode(suffix).alias("rule_host")).withColumn("rule_path", F.explode(starts))
    order = Window.partitionBy("host", "path").orderBy(F.length("rule_host").desc(), F.length("rule_path").desc())
    best = wide.join(table, ["rule_host", "rule_path"]).withColumn("_n", F.row_number().over(order)).filter("_n = 1")
    best = best.select("host", "path", F.concat("rule_host", "rule_path").alias("rule"), "verdict")
    names = [c for c in df.columns if c not in ("rule", "verdict")]
    out = df.select(*(F.col(f"`{c}`") for c in names)).join(best, ["host", "path"], "left")
    return out.select(*(F.col(f"`{c}`") for c in names), "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
