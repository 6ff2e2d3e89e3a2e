"""Straight loops that say what the operators return."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BLANK = "\x20\x09\x0a\x0b\x0c\x0d"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def base(text):
    """Columns of the quality rules that need no model."""
    w, t = words(text), text or ""
    at = defaultdict(list)
    for i in range(len(w) - 7):
        at[tuple(w[i : i + 8])].append(i)
    again = {p for places in at.values() if len(places) > 1 for i in places for p in range(i, i + 8)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    failed = len(w) < 20 or 100 * len(again) > 30 * len(w)
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in t), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(again), "base_failed": failed}


def h64(data, seed=42):
    """Spark's xxhash64 of a string or of two longs."""
    if isinstance(data, str):
        return (xxhash.xxh64_intdigest(data.encode(), seed) + 2**63) % 2**64 - 2**63
    for x in data:
        seed = xxhash.xxh64_intdigest(int(x).to_bytes(8, "little", signed=True), seed)
    return (seed + 2**63) % 2**64 - 2**63


def grams(text, buckets):
    one = [h64(w) for w in words(text)]
    return [h % buckets for h in one] + [h64(p) % buckets for p in zip(one, one[1:], strict=False)]


def ratios(docs, trusted, buckets, unit=1 << 20):
    raw, target = Counter(), Counter()
    for doc_id, text in docs:
        found = grams(text, buckets)
        raw.update(found)
        if doc_id in trusted:
            target.update(found)
    if not target:
        return [0] * buckets
    a, b = sum(target.values()) + buckets, sum(raw.values()) + buckets
    return [round(unit * (math.log((target[k] + 1) / a) - math.log((raw[k] + 1) / b))) for k in range(buckets)]


def shingle_set(text):
    w = words((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def components(docs, percent=85):
    """doc_id -> (n_shingles, component_id, kept) over all pairs that share a shingle."""
    sets = {i: shingle_set(t) for i, t in docs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    groups, by = {}, defaultdict(list)
    for i in sorted(sets):
        first = groups.setdefault(frozenset(sets[i]), i)
        if first != i and sets[i]:
            root[i] = first
    for s, i in groups.items():
        for g in s:
            by[g].append(i)
    for i in groups.values():
        for j in {j for g in sets[i] for j in by[g] if j < i}:
            same = len(sets[i] & sets[j])
            if 100 * same >= percent * (len(sets[i]) + len(sets[j]) - same):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def kept_lines(texts, least_docs=10):
    split = [(t or "").split("\n") for t in texts]
    key = lambda x: x.strip(BLANK).translate(LOWER)
    n = Counter(k for ls in split for k in {key(x) for x in ls})
    out = []
    for ls in split:
        stay = [x for x in ls if not (key(x) and n[key(x)] >= least_docs)]
        out.append((len(ls), len(ls) - len(stay), sha("\n".join(stay))))
    return out


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def tokens(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def leaking(text, items, window=13, need=0.8):
    """Items of which a window, as laid over the text, is equal enough; only layings with six equal tokens are looked at."""
    h, found = tokens(text), set()
    at = defaultdict(list)
    for i, w in enumerate(h):
        at[w].append(i)
    for item_id, item in items:
        b = tokens(item)
        if len(b) < 5:
            continue
        size = min(window, len(b))
        layings = Counter(i - j for j, w in enumerate(b) for i in at[w])
        for off in (o for o, n in layings.items() if n >= min(6, math.ceil(need * size))):
            eq = [0 <= off + k < len(h) and h[off + k] == b[k] for k in range(len(b))]
            if any(sum(eq[s : s + size]) >= need * size for s in range(len(b) - size + 1)):
                found.add(item_id)
    return found
