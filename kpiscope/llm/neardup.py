"""Near-duplicate documents: MinHash signatures joined by a multi-index Hamming join.

A signature has chunks of four entries of 16 bits. Two documents whose signatures differ in fewer than twice as many entries as
there are chunks differ in at most one entry of some chunk (pigeonhole), so every document is filed under each chunk with each entry
left out: the allowed chunk errors, enumerated. Every pair under the distance shares a key. entries_for() takes as many entries as
the least similarity of a link (percent) needs, so that a pair just at it is missed with a chance of MOST_MISSED at most. Links are
confirmed on the full shingle sets.

Copies and hot groups:
- Documents with equal sets become one node before anything else.
- In a bucket (documents of one key) signatures are compared in blocks inside a task; only a spanning forest of the pairs
  under the distance leaves it, fewer pairs than documents. Buckets of more than CELL documents are dealt out to cells, one for each
  pair of their parts. The components of all forests are the groups: every pair under the distance is inside one.
- The full sets of a group's documents meet once. Pairs under the distance that aren't connected yet are compared, and
  again a forest of the confirmed links leaves the task, so the components stay whole and no group is written out in pairs.
  Groups of more than CELL_SHINGLES shingles are dealt out to cells in the same way.

Nulls: a null text, or one without words, has an empty set, links with nothing and is its own component. A null doc_id
has a null component unless a linked document has an id, and is kept only as a text of its own. Repeated rows are copies;
repeated ids with different texts are documents of their own that share an id. Very long texts are whole. Extra columns
pass through; input columns named like the results are replaced (firsts() keeps them), any other name is free. An empty table gives
an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiscope.llm.shared import LOWER, UPPER, bounded_batches, sheltered, stash, words

WIDTH, SHINGLE = 4, 5
LEAST_ENTRIES, MOST_ENTRIES, MOST_MISSED = 32, 128, 4e-6
CELL, CELL_SHINGLES = 4096, 1_000_000
#: 32 MB of ids.
MOST_BROADCAST_IDS = 4_000_000
#: Links have 100 * intersection >= percent * union; the contract of op2 fixes this one.
PERCENT = 85
RESULT = ["n_shingles", "component_id", "kept"]

_rng = np.random.default_rng(20240101)
MULTIPLY = _rng.integers(1, 2**63, MOST_ENTRIES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADD = _rng.integers(0, 2**63, MOST_ENTRIES, dtype=np.uint64)
STEP = np.uint64(0x9E3779B97F4A7C15)


def most_apart(entries: int) -> int:
    return 2 * (entries // WIDTH) - 1


def missed(percent: int, entries: int) -> float:
    """Chance that the signatures of a pair of that similarity are too far apart."""
    p = 1 - percent / 100
    return sum(math.comb(entries, k) * p**k * (1 - p) ** (entries - k) for k in range(most_apart(entries) + 1, entries + 1))


def entries_for(percent: int) -> int:
    """Entries of a signature that finds pairs of this similarity."""
    for entries in range(LEAST_ENTRIES, MOST_ENTRIES + 1, WIDTH):
        if missed(percent, entries) <= MOST_MISSED:
            return entries
    raise ValueError(f"links of {percent} per cent need longer signatures")


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingles(hashes: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text's word hashes; a shorter text is one shingle."""
    n = max(1, len(hashes) - size + 1)
    if not len(hashes):
        return np.zeros(0, np.uint64)
    acc = np.full(n, len(hashes) if len(hashes) < size else size, np.uint64)
    for k in range(min(size, len(hashes))):
        acc = mixed(acc * STEP + hashes[k : k + n])
    return np.unique(acc)


def signature(found: np.ndarray, entries: int) -> np.ndarray:
    """The low 16 bits of the least hash under each of so many functions."""
    out = np.empty(entries, np.uint16)
    for k in range(entries):
        x = (found ^ ADD[k]) * MULTIPLY[k]
        x = (x ^ (x >> np.uint64(31))) * MULTIPLY[MOST_ENTRIES - 1 - k]
        out[k] = (x ^ (x >> np.uint64(33))).min() & np.uint64(0xFFFF)
    return out


def _hashed(docs: DataFrame) -> DataFrame:
    return docs.select("uid", F.transform(words(F.translate("text", UPPER, LOWER)), lambda w: F.xxhash64(w)).alias("words"))


def _sets(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    col = batch.column("words")
    flat, ends = col.values.to_numpy(zero_copy_only=False).view(np.uint64), col.offsets.to_numpy()
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        yield shingles(flat[a:b])


def _signed(rows: DataFrame, entries: int) -> DataFrame:
    """uid, n_shingles, a 128-bit mark of the set (a, b), the signature; an empty set has no signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, a, b, sig = [], [], [], []
            for found in _sets(batch):
                n.append(len(found))
                a.append(int(mixed(found).sum(dtype=np.uint64).view(np.int64)))
                b.append(int(mixed(found * STEP + np.uint64(1)).sum(dtype=np.uint64).view(np.int64)))
                sig.append(signature(found, entries).tobytes() if len(found) else None)
            yield pa.RecordBatch.from_pydict({"uid": batch.column("uid"), "n_shingles": pa.array(n, pa.int64()), "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "sig": pa.array(sig, pa.binary())})

    return rows.mapInArrow(run, "uid long, n_shingles long, a long, b long, sig binary")


def _filed(nodes: DataFrame, entries: int) -> DataFrame:
    """A row for each node, chunk and entry left out: key, uid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint16).reshape(-1, entries).astype(np.uint64)
            keys = keys_of(sig)
            uid = np.repeat(batch.column("uid").to_numpy(), keys.shape[1])
            yield pa.RecordBatch.from_pydict({"key": pa.array(keys.reshape(-1).view(np.int64)), "uid": pa.array(uid)})

    return nodes.select("uid", "sig").mapInArrow(run, "key long, uid long")


def keys_of(sig: np.ndarray) -> np.ndarray:
    """Keys of each signature: chunk by chunk, and in it by the entry left out."""
    out = np.empty(sig.shape, np.uint64)
    for chunk in range(sig.shape[1] // WIDTH):
        for left_out in range(WIDTH):
            acc = np.full(len(sig), chunk * WIDTH + left_out + 1, np.uint64)
            for k in range(WIDTH):
                if k != left_out:
                    acc = mixed(acc * STEP + sig[:, chunk * WIDTH + k])
            out[:, chunk * WIDTH + left_out] = acc
    return out


def near_pairs(sig: np.ndarray, side: np.ndarray, step: int = 128) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places and distances of pairs under the distance, in blocks: among all (side 0), or between sides 1 and 2."""
    alone = not side[0]
    rows, cols = (np.arange(len(sig)),) * 2 if alone else (np.flatnonzero(side == 1), np.flatnonzero(side == 2))
    for k in range(0, len(rows), step):
        i = rows[k : k + step]
        j = cols[cols > i[0]] if alone else cols
        if not len(j):
            continue
        apart = np.zeros((len(i), len(j)), np.uint8)
        for e in range(sig.shape[1]):
            apart += sig[i, e][:, None] != sig[j, e][None, :]
        ok = apart <= most_apart(sig.shape[1])
        if alone:
            ok &= i[:, None] < j[None, :]
        x, y = np.nonzero(ok)
        yield i[x], j[y], apart[x, y]


def forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs a spanning forest of near ones: at each block the forest so far and the new pairs, nearest first."""
    held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8))
    for new in pairs:
        i, j, d = (np.concatenate(x) for x in zip(held, new, strict=True))
        root, stay = list(range(n)), []
        for e in np.argsort(d, kind="stable").tolist():
            x, y = int(i[e]), int(j[e])
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            while root[y] != y:
                root[y] = root[root[y]]
                y = root[y]
            if x != y:
                root[max(x, y)] = min(x, y)
                stay.append(e)
        held = i[stay], j[stay], d[stay]
    return held[:2]


def links_of(sig: np.ndarray, side: np.ndarray, sets: list[np.ndarray], percent: int) -> tuple[list[int], list[int]]:
    """A spanning forest of the links among a cell's documents: pairs under the distance, confirmed on the full sets."""
    size = np.array([len(x) for x in sets])
    start = np.cumsum(size) - size
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    mark, label = np.zeros(len(ids), bool), np.arange(len(sets))
    left, right = [], []
    for i in np.flatnonzero(side != 2).tolist():
        j = np.arange(i + 1, len(sets)) if not side[i] else np.flatnonzero(side == 2)
        j = j[label[j] != label[i]]
        j = j[(sig[j] != sig[i]).sum(axis=1) <= most_apart(sig.shape[1])]
        if not len(j):
            continue
        own = ids[start[i] : start[i] + size[i]]
        mark[own] = True
        end = np.cumsum(size[j])
        places = np.arange(end[-1]) + np.repeat(start[j] - end + size[j], size[j])
        same = np.add.reduceat(mark[ids[places]], end - size[j], dtype=np.int64)
        mark[own] = False
        for k in j[100 * same >= percent * (size[i] + size[j] - same)].tolist():
            if label[k] != label[i]:
                left.append(i)
                right.append(k)
                label[label == label[k]] = label[i]
    return left, right


def _paired(cells: DataFrame, confirm: bool, percent: int) -> DataFrame:
    """Pairs (x < y) from rows (key, cell, side, uid, sig, and to confirm found) that stand together by key and cell.

    side is 0 in a cell of one part, else 1 or 2 for the parts that meet in it.
    """
    entries = entries_for(percent)
    names = ["key", "cell", "side", "uid", "sig"] + ["found"] * confirm
    rows = cells.select(*names).repartition("key", "cell").sortWithinPartitions("key", "cell", "uid")

    def pairs(held: list[tuple]) -> tuple[np.ndarray, np.ndarray] | None:
        if len(held) < 2:
            return None
        side, uid = (np.array([r[k] for r in held]) for k in (0, 1))
        sig = np.frombuffer(b"".join([r[2] for r in held]), np.uint16).reshape(-1, entries)
        i, j = links_of(sig, side, [np.frombuffer(r[3], np.uint64) for r in held], percent) if confirm else forest(len(uid), near_pairs(sig, side))
        return (np.minimum(uid[i], uid[j]), np.maximum(uid[i], uid[j])) if len(i) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None
        for batch in batches:
            out = []
            for key, cell, *row in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
                if (key, cell) != at:
                    out.append(pairs(held))
                    held, at = [], (key, cell)
                held.append(row)
            yield from emit(out)
        yield from emit([pairs(held)])

    def emit(out):
        out = [x for x in out if x]
        if out:
            yield pa.RecordBatch.from_pydict({"x": pa.array(np.concatenate([x for x, _ in out]), pa.int64()), "y": pa.array(np.concatenate([y for _, y in out]), pa.int64())})

    return rows.mapInArrow(run, "x long, y long")


def _cells(rows: DataFrame) -> DataFrame:
    """Rows (key, uid, parts) by cell and side: one cell for a single part, else one for each pair of parts."""
    g = F.col("parts")
    part = F.pmod(F.xxhash64("uid", "key"), g).cast("int")
    lone = F.array(F.struct(F.lit(0).alias("cell"), F.lit(0).alias("side")))
    low, high = (lambda p: F.least(F.col("part"), p)), (lambda p: F.greatest(F.col("part"), p))
    number = lambda p: (low(p) * g + high(p) + 1).cast("int")
    side = lambda p: F.when(p == F.col("part"), 0).when(F.col("part") < p, 1).otherwise(2)
    many = F.transform(F.sequence(F.lit(0), g - 1), lambda p: F.struct(number(p).alias("cell"), side(p).alias("side")))
    return rows.withColumn("part", part).select("key", "uid", F.inline(F.when(g == 1, lone).otherwise(many)))


def _sets_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """uid, found (the full set) of the documents in ids (no repeats).

    Up to MOST_BROADCAST_IDS ids are broadcast, so that the other texts aren't moved; more are joined by a shuffle.
    """
    if ids.count() <= MOST_BROADCAST_IDS:
        ids = F.broadcast(ids)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"uid": batch.column("uid"), "found": pa.array([f.tobytes() for f in _sets(batch)], pa.binary())})

    return _hashed(docs.join(ids, "uid", "left_semi")).mapInArrow(whole, "uid long, found binary")


def components(links: DataFrame) -> DataFrame:
    """uid, comp for every node of a link; comp is the component's smallest uid.

    Each round every node offers the smallest label among its neighbours to itself and to the node its label names, takes the
    least offer, and then its label's label. Labels only fall, so the rounds end by themselves, when none has changed; as whole
    trees are hooked, chains in any order need about as many rounds as the logarithm of their length.
    """
    edges = stash(links.select("x", "y").union(links.select(F.col("y"), F.col("x"))), "edges")
    label = stash(edges.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("uid"), F.least("x", "m").alias("comp")), "labels")
    while True:
        near = edges.join(label.withColumnsRenamed({"uid": "y"}), "y").groupBy("x").agg(F.min("comp").alias("m"))
        near = stash(label.join(near.withColumnRenamed("x", "uid"), "uid").select("uid", "comp", "m"), "offers")
        offers = near.select("uid", "m").union(near.filter("m < comp").select("comp", "m")).groupBy("uid").agg(F.min("m").alias("m"))
        step = label.join(offers, "uid").select("uid", F.col("comp").alias("old"), F.least("comp", "m").alias("comp"))
        jump = step.select(F.col("uid").alias("comp"), F.col("comp").alias("further"))
        new = stash(step.join(jump, "comp").select("uid", "old", F.col("further").alias("comp")), "labels")
        label = new.select("uid", "comp")
        if new.filter("comp <> old").isEmpty():
            return label


def linked(docs: DataFrame, cell: int = CELL, cell_shingles: int = CELL_SHINGLES, percent: int = PERCENT) -> DataFrame:
    """uid, n_shingles and comp (the smallest uid of the component) for docs with uid and text, as a written table."""
    bounded_batches(docs.sparkSession)
    entries = entries_for(percent)
    sets = stash(_signed(_hashed(docs), entries), "signatures")
    copies = sets.filter("n_shingles > 0").groupBy("a", "b", "n_shingles").agg(F.min("uid").alias("rep"), F.count(F.lit(1)).alias("n"))
    copies = stash(copies.filter("n > 1").drop("n"), "copies")
    member = sets.select("uid", "n_shingles", "a", "b").join(copies, ["a", "b", "n_shingles"], "left")
    member = stash(member.select("uid", "n_shingles", F.coalesce("rep", "uid").alias("rep")), "members")
    nodes = sets.filter("n_shingles > 0").select("uid", "n_shingles", "sig").join(member.filter("uid <> rep").select("uid"), "uid", "left_anti")
    nodes = stash(nodes, "nodes")
    filed = _filed(nodes, entries)
    shared = filed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = stash(shared.select("key", F.ceil(F.col("n") / cell).cast("int").alias("parts")), "shared-keys")
    near = _paired(_cells(filed.join(shared, "key")).join(nodes, "uid"), False, percent)
    group = stash(components(stash(near.distinct(), "near")).withColumnRenamed("comp", "key").join(nodes, "uid"), "groups")
    parts = group.groupBy("key").agg(F.ceil(F.sum("n_shingles") / cell_shingles).cast("int").alias("parts"))
    dealt = _cells(group.select("key", "uid").join(stash(parts, "parts"), "key")).join(group.select("uid", "sig"), "uid")
    links = _paired(dealt.join(_sets_of(docs, group.select("uid")), "uid"), True, percent)
    final = components(stash(links.distinct(), "links")).withColumnsRenamed({"uid": "rep"})
    out = member.join(final, "rep", "left").select("uid", "n_shingles", F.coalesce("comp", "rep").alias("comp"))
    return stash(out, "components")


def numbered(docs: DataFrame) -> DataFrame:
    """docs with uid: the written table keeps the numbers, whatever is computed again."""
    return stash(docs.withColumn("uid", F.monotonically_increasing_id()), "numbered")


def _judged(docs: DataFrame, cell: int, cell_shingles: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The rows with uid, and by uid: n_shingles, component_id, first."""
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in (*RESULT, "first")]
    rows = numbered(docs.select(*kept))
    found = linked(rows.select("uid", "text"), cell, cell_shingles, percent).join(rows.select("uid", "doc_id"), "uid")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "uid")
    leader = found.groupBy("comp").agg(F.min("doc_id").alias("component_id"), F.min(order).alias("o"))
    leader = stash(leader.select("comp", "component_id", F.col("o.uid").alias("first_uid")), "leaders")
    found = found.join(leader, "comp").select("uid", "n_shingles", "component_id", (F.col("uid") == F.col("first_uid")).alias("first"))
    return rows, stash(found, "near-duplicates")


@sheltered("uid")
def dedup(docs: DataFrame, cell: int = CELL, cell_shingles: int = CELL_SHINGLES, percent: int = PERCENT) -> DataFrame:
    """Add n_shingles, component_id (the smallest doc_id of the component), kept (it is this document's) and first.

    first is true for exactly one row of each component, also where rows repeat an id.
    """
    rows, found = _judged(docs, cell, cell_shingles, percent)
    same = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("first"))
    out = rows.join(found, "uid").withColumn("kept", same)
    return out.select(*(F.col(f"`{c}`") for c in rows.columns if c != "uid"), *RESULT, "first")


@sheltered("uid", "n_shingles", "component_id", "kept", "first")
def firsts(docs: DataFrame, cell: int = CELL, cell_shingles: int = CELL_SHINGLES, percent: int = PERCENT) -> DataFrame:
    """One row of each component, with the columns of docs. What goes is broadcast if few enough, so that texts stay in place."""
    rows, found = _judged(docs, cell, cell_shingles, percent)
    others = found.filter(~F.col("first")).select("uid")
    if others.count() <= MOST_BROADCAST_IDS:
        others = F.broadcast(others)
    return rows.join(others, "uid", "left_anti").drop("uid")
