"""Byte-level BPE encoding and decoding with a rank queue.

Encoding keeps all pre-tokens of a batch in one linked list of positions. Every merge rank has a bucket of positions
whose pair merges at that rank; a hierarchical bitmap (64-way) tells the lowest rank with a bucket by find-first-set.
The bucket's positions are merged together, from left to right where they overlap; entries whose pair has changed since
are stale and skipped. A pre-token of any length costs time in proportion to its merges.

Nulls: a null text has no tokens (an empty list, decoded to no bytes); empty texts likewise. Repeated rows are encoded
each. Extra columns pass through; an input column with the name of the result is replaced.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from kpiscope.llm.pretokens import Memo
from kpiscope.llm.shared import bounded_batches

#: So many characters are encoded at a time.
CHUNK_CHARS = 2_000_000
#: Bits of a rank beside its pair; a pair then has 43 bits, enough for vocabularies of 2.9 million tokens.
RANK_BITS = 20
#: A worker remembers pieces of this size in all.
MEMO_BYTES = 48 << 20
RANK_MASK = (1 << RANK_BITS) - 1


class Bitmap:
    """Set of small integers with find-first-set over levels of 64-bit words."""

    def __init__(self, size: int):
        self.levels = []
        while True:
            size = (size + 63) >> 6
            self.levels.append([0] * size)
            if size == 1:
                break

    def add(self, i: int) -> None:
        for level in self.levels:
            word = level[i >> 6]
            level[i >> 6] = word | 1 << (i & 63)
            if word:
                return
            i >>= 6

    def discard(self, i: int) -> None:
        for level in self.levels:
            level[i >> 6] &= ~(1 << (i & 63))
            if level[i >> 6]:
                return
            i >>= 6

    def first(self) -> int:
        """The smallest member; -1 if there is none."""
        i = 0
        for level in reversed(self.levels):
            word = level[i]
            if not word:
                return -1
            i = i << 6 | (word & -word).bit_length() - 1
        return i


class Vocabulary:
    """Token bytes by id, and the rank at which two neighbouring tokens merge."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.size = max(ranks.values()) + 1
        self.bytes = [b""] * self.size
        for token, r in ranks.items():
            self.bytes[r] = token
        self.slots = None  # decoding needs no pairs
        self.tokens = None  # and encoding no bytes

    def _prepare(self) -> None:
        ranks = self.ranks
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        pairs = {}
        for token, r in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left * self.size + right] = r
        self.bits = max(4, int(4 * len(pairs)).bit_length())
        self.slots = np.full(1 << self.bits, -1, dtype=np.int64)  # pair and rank in one word; -1 is free
        todo, probe = np.array([k << RANK_BITS | r for k, r in pairs.items()], dtype=np.int64), 0
        while len(todo):  # linear probing, all keys at once
            at = self._slot(todo >> RANK_BITS, probe)
            free = self.slots[at] == -1
            self.slots[at[free]] = todo[free]  # of several for a slot one stays
            todo, probe = todo[self.slots[at] != todo], probe + 1
        self.probes = probe

    def _slot(self, key: np.ndarray, probe: int) -> np.ndarray:
        at = (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).view(np.int64)
        return (at + probe) & ((1 << self.bits) - 1) if probe else at

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; size where the pair doesn't merge."""
        key = left * np.int64(self.size) + right
        slot = self.slots[self._slot(key, 0)]
        found = (slot >> RANK_BITS) == key
        out = np.where(found, slot & RANK_MASK, self.size)
        open_ = np.flatnonzero(~found & (slot != -1))
        for probe in range(1, self.probes):
            if not len(open_):
                break
            slot = self.slots[self._slot(key[open_], probe)]
            hit = (slot >> RANK_BITS) == key[open_]
            out[open_[hit]] = slot[hit] & RANK_MASK
            open_ = open_[~hit & (slot != -1)]
        return out

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece as little-endian int32; nothing merges across pieces."""
        if self.slots is None:
            self._prepare()
        out = [b""] * len(pieces)
        many = []
        for i, piece in enumerate(pieces):
            one = self.ranks.get(piece)  # a piece that is a token is that token
            if one is None and piece:
                many.append(i)
            elif piece:
                out[i] = one.to_bytes(4, "little")
        if not many:
            return out
        ends = np.cumsum([len(pieces[i]) for i in many])
        token = self.of_byte[np.frombuffer(b"".join([pieces[i] for i in many]), dtype=np.uint8)]
        alive = self._merge(token, ends)
        ids, at = token[alive].astype("<i4").tobytes(), (4 * np.cumsum(alive)[ends - 1]).tolist()
        for i, start, end in zip(many, [0, *at[:-1]], at, strict=True):
            out[i] = ids[start:end]
        return out

    def _merge(self, token: np.ndarray, ends: np.ndarray) -> np.ndarray:
        n, none = len(token), self.size
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends - 1] = -1
        before[0] = -1
        before[ends[:-1]] = -1
        alive, merged = np.ones(n, dtype=bool), np.zeros(n, dtype=bool)
        rank = np.full(n, none, dtype=np.int64)
        head = np.flatnonzero(after >= 0)
        rank[head] = self.pair_ranks(token[head], token[after[head]])
        buckets: dict[int, list[np.ndarray]] = {}
        queue = Bitmap(none + 1)

        def put(at: np.ndarray) -> None:
            r = rank[at]
            at, r = at[r < none], r[r < none]
            if not len(at):
                return
            order = np.lexsort((at, r)) if len(r) > 1 else slice(None)
            at, r = at[order], r[order]
            cuts = np.flatnonzero(np.diff(r)) + 1
            for some, which in zip(np.split(at, cuts), r[np.r_[0, cuts]].tolist(), strict=True):
                if which in buckets:
                    buckets[which].append(some)
                else:
                    buckets[which] = [some]
                    queue.add(which)

        put(head)
        while (r := queue.first()) >= 0:
            queue.discard(r)
            got = buckets.pop(r)
            at = got[0] if len(got) == 1 else np.sort(np.concatenate(got))
            at = at[rank[at] == r]  # the others are stale
            if len(got) > 1 and len(at) > 1:
                at = at[np.r_[True, at[1:] != at[:-1]]]
            if not len(at):
                continue
            touching = after[at[:-1]] == at[1:]
            if touching.any():  # of overlapping pairs every other one, from the left
                k = np.arange(len(at))
                start = np.maximum.accumulate(np.where(np.r_[True, ~touching], k, 0))
                at = at[(k - start) % 2 == 0]
            gone = after[at]
            then = after[gone]
            alive[gone] = False
            rank[gone] = none
            token[at] = r
            after[at] = then
            more = then >= 0
            before[then[more]] = at[more]
            rank[at[~more]] = none
            left = before[at]
            left = left[left >= 0]
            merged[at] = True
            left = left[~merged[left]]  # the others are in at themselves
            merged[at] = False
            changed = np.concatenate((at[more], left))
            if len(changed):
                rank[changed] = self.pair_ranks(token[changed], token[after[changed]])
                put(changed)
        return alive

    def decode(self, lists: pa.ListArray) -> pa.Array:
        """Bytes of each list of ids, as slices of one buffer."""
        if self.tokens is None:
            self.tokens = pa.array(self.bytes, pa.large_binary())
        lists = lists.fill_null([]) if lists.null_count else lists
        ends = lists.offsets.to_numpy().astype(np.int64)
        taken = self.tokens.take(lists.values.slice(ends[0], ends[-1] - ends[0]))
        at = np.frombuffer(taken.buffers()[1], np.int64)[taken.offset :][ends - ends[0]]
        return pa.Array.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(at.tobytes()), taken.buffers()[2]]).cast(pa.binary())


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    with open(path, "rb") as f:
        return Vocabulary({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})


@lru_cache(2)
def memo(path: str, pattern: str) -> Memo:
    return Memo(pattern, lambda ts: vocabulary(path).encode([t.encode() for t in ts]), most_bytes=MEMO_BYTES)


def int_lists(rows: list[bytes]) -> pa.Array:
    """Arrow lists from the bytes of each row's int32 values."""
    ends = np.cumsum([0, *map(len, rows)]) // 4
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(rows))]))


def slices(batch: pa.RecordBatch, sizes: np.ndarray, most: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about `most` in size, one row at least."""
    start, total = 0, 0
    for i, s in enumerate(sizes.tolist()):
        if i > start and total + s > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += s
    if start < batch.num_rows:
        yield batch.slice(start)


def _with(df: DataFrame, new: list[T.StructField], source: str, fn: Callable[[pa.Array], list[pa.Array]]) -> DataFrame:
    """df with the columns `new` made from column `source` of each batch."""
    bounded_batches(df.sparkSession)
    added = [f.name for f in new]
    kept = [f for f in df.schema.fields if f.name not in added]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = pa.types.is_list(batch.column(source).type)
            sizes = (batch.column(source).value_lengths() if lists else pc.binary_length(batch.column(source))).fill_null(0).to_numpy(zero_copy_only=False)
            for part in slices(batch, sizes, CHUNK_CHARS):
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), *fn(part.column(source))], names=[*names, *added])

    return df.mapInArrow(run, T.StructType([*kept, *new]))


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", out: str = "token_ids") -> DataFrame:
    """Add the ids of each whole text, as the rank file at `path` and the pattern give them."""
    return _with(df, [T.StructField(out, T.ArrayType(T.IntegerType()))], text, lambda col: [int_lists(memo(path, pattern).ids(col.to_pylist()))])


def decode(df: DataFrame, path: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """Add the bytes the ids stand for; null ids give no bytes."""
    return _with(df, [T.StructField(out, T.BinaryType())], ids, lambda col: [vocabulary(path).decode(col)])


def round_trip(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "token_ids", digest: str = "decoded_sha256") -> DataFrame:
    """Add the ids of each whole text and the SHA-256 of the bytes they decode to.

    One function does both, so a core has one worker with one vocabulary, and decoded bytes stay in it.
    """

    def both(col: pa.Array) -> list[pa.Array]:
        found = int_lists(memo(path, pattern).ids(col.to_pylist()))
        back = vocabulary(path).decode(found)
        return [found, pa.array([hashlib.sha256(b.as_buffer()).hexdigest() for b in back], pa.string())]

    return _with(df, [T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(digest, T.StringType())], text, both)
