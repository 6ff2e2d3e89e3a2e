"""Token ids in files of patched frame-of-reference blocks.

A segment holds the ids of consecutive documents:

    "PFR1", documents, ids, blocks, ids in a block       4 bytes and 4 x uint32, little-endian
    document ids (int64; NO_ID for null), ids of each    8 + 4 bytes a document
    where each block starts, and the end                 uint32 each, from the start of the segment
    blocks: minimum uint32, width uint8, exceptions uint16, the differences from the minimum packed at `width` bits,
    then positions (uint16) and whole differences (uint32) of the exceptions

The width of a block is the smallest that holds the given percentile of its differences; larger ones are exceptions.
Segments are rows (part, seq, content, ...) of a table that Spark's own committer writes, so a lost executor or a task
that runs twice leaves no torn file. The block index gives any range of ids without reading the rest.

Nulls: a null text has only the end id; a null doc_id sorts first and stays null. Repeated rows are all written; rows
with equal ids are ordered by text. Other columns of the input are left out.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kpiscope.llm.bpe import slices
from kpiscope.llm.pretokens import Memo
from kpiscope.llm.shared import bounded_batches, stash

MAGIC, HEAD, BLOCK_HEAD = b"PFR1", 20, 7
BLOCK, PERCENTILE = 128, 95
NO_ID = -(2**63)
#: So many characters make a segment, one document at least.
SEGMENT_CHARS = 2_000_000
#: Pieces whose ids a worker remembers; all pieces are encoded.
MEMO_PIECES = 1_500_000
#: Fixed by byte-level vocabularies: how they spell a space.
SPACE = "\u0120"


def to_bits(values: np.ndarray, width: int) -> np.ndarray:
    """Bytes of each row's values, `width` low bits of each; all rows at once, one column after the other."""
    rows, n = values.shape
    columns = np.ascontiguousarray(values.T).astype(np.uint64) & np.uint64((1 << width) - 1)
    words = np.zeros((-(-n * width // 64), rows), np.uint64)
    for k in range(n):
        word, shift = divmod(k * width, 64)
        words[word] |= columns[k] << np.uint64(shift)
        if shift + width > 64:
            words[word + 1] |= columns[k] >> np.uint64(64 - shift)
    return np.ascontiguousarray(words.T).astype("<u8").view(np.uint8)[:, : (n * width + 7) // 8]


def from_bits(packed: np.ndarray, width: int, n: int) -> np.ndarray:
    """The n values of each row that to_bits packed."""
    padded = np.zeros((len(packed), 8 * -(-n * width // 64)), np.uint8)
    padded[:, : packed.shape[1]] = packed
    words = np.ascontiguousarray(padded.view("<u8").T).astype(np.uint64)
    columns, mask = np.empty((n, len(packed)), np.uint32), np.uint64((1 << width) - 1)
    for k in range(n):
        word, shift = divmod(k * width, 64)
        value = words[word] >> np.uint64(shift)
        if shift + width > 64:
            value |= words[word + 1] << np.uint64(64 - shift)
        columns[k] = value & mask
    return columns.T


def pack(ids: np.ndarray, lengths: np.ndarray, doc_ids: np.ndarray, block: int = BLOCK, percentile: int = PERCENTILE) -> bytes:
    """A segment from the ids of its documents, one after the other."""
    n, blocks = len(ids), -(-len(ids) // block)
    low, width, rest, over = [np.zeros((blocks, *shape), t) for shape, t in (((), np.uint32), ((), np.uint8), ((block,), np.uint32), ((block,), bool))]
    if n:
        full = np.full(blocks * block, ids[-1], dtype=np.uint32)
        full[:n] = ids
        full = full.reshape(blocks, block)
        low = full.min(axis=1)
        rest = full - low[:, None]
        at = np.partition(rest, block * percentile // 100 - 1, axis=1)[:, block * percentile // 100 - 1]
        width = np.ceil(np.log2(at.astype(np.float64) + 1)).astype(np.uint8)
        over = rest >> width[:, None].astype(np.uint32) != 0
    extra = over.sum(axis=1)
    sizes = BLOCK_HEAD + (block * width.astype(np.int64) + 7) // 8 + 6 * extra
    index = HEAD + 12 * len(lengths) + 4 * (blocks + 1) + np.cumsum([0, *sizes])
    out = np.zeros(int(index[-1]), dtype=np.uint8)
    head = MAGIC + struct.pack("<4I", len(lengths), n, blocks, block) + doc_ids.astype("<i8").tobytes() + lengths.astype("<u4").tobytes() + index.astype("<u4").tobytes()
    out[: len(head)] = np.frombuffer(head, np.uint8)
    heads = np.zeros((blocks, BLOCK_HEAD), np.uint8)
    heads[:, :4] = low.astype("<u4").view(np.uint8).reshape(-1, 4)
    heads[:, 4] = width
    heads[:, 5:] = extra.astype("<u2").view(np.uint8).reshape(-1, 2)
    out[index[:-1, None] + np.arange(BLOCK_HEAD)] = heads
    for w in np.unique(width[width > 0]).tolist():
        which = np.flatnonzero(width == w)
        packed = to_bits(rest[which], w)
        out[index[which][:, None] + BLOCK_HEAD + np.arange(packed.shape[1])] = packed
    b, p = np.nonzero(over)
    if len(b):
        k = np.arange(len(b)) - (np.cumsum(extra) - extra)[b]
        tail = index[b] + BLOCK_HEAD + (block * width.astype(np.int64)[b] + 7) // 8
        out[(tail + 2 * k)[:, None] + np.arange(2)] = p.astype("<u2").view(np.uint8).reshape(-1, 2)
        out[(tail + 2 * extra[b] + 4 * k)[:, None] + np.arange(4)] = rest[b, p].astype("<u4").view(np.uint8).reshape(-1, 4)
    return out.tobytes()


def unpack(segment: bytes, first: int = 0, last: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document ids, their lengths, and the ids of blocks first to last (all of them by default)."""
    if segment[:4] != MAGIC:
        raise ValueError("not a segment of token ids")
    docs, n, blocks, block = struct.unpack_from("<4I", segment, 4)
    doc_ids = np.frombuffer(segment, "<i8", docs, HEAD)
    lengths = np.frombuffer(segment, "<u4", docs, HEAD + 8 * docs)
    index = np.frombuffer(segment, "<u4", blocks + 1, HEAD + 12 * docs).astype(np.int64)
    if index[-1] != len(segment):
        raise ValueError("a segment of token ids is cut short")
    last = blocks if last is None else min(last, blocks)
    index = index[first:last]
    data = np.frombuffer(segment, np.uint8)
    heads = data[index[:, None] + np.arange(BLOCK_HEAD)]
    low = np.ascontiguousarray(heads[:, :4]).view("<u4")[:, 0]
    width, extra = heads[:, 4].astype(np.int64), np.ascontiguousarray(heads[:, 5:]).view("<u2")[:, 0].astype(np.int64)
    out = np.zeros((len(index), block), np.uint32)
    for w in np.unique(width[width > 0]).tolist():
        which = np.flatnonzero(width == w)
        packed = data[index[which][:, None] + BLOCK_HEAD + np.arange((block * w + 7) // 8)]
        out[which] = from_bits(packed, w, block)
    b = np.repeat(np.arange(len(index)), extra)
    if len(b):
        k = np.arange(len(b)) - (np.cumsum(extra) - extra)[b]
        tail = index[b] + BLOCK_HEAD + (block * width[b] + 7) // 8
        p = data[(tail + 2 * k)[:, None] + np.arange(2)].view("<u2")[:, 0]
        out[b, p] = data[(tail + 2 * extra[b] + 4 * k)[:, None] + np.arange(4)].view("<u4")[:, 0]
    out += low[:, None]
    return doc_ids, lengths, out.reshape(-1)[: n - first * block]


def spaced(text: str) -> bool:
    """Whether it is a space and a piece without any, which white space neither begins nor ends."""
    return text.rfind(" ") == 0 and not (text[-1].isspace() or text[1].isspace())


class Encoder:
    """Ids of strings by the tokenizers library.

    Strings with a space in front and none inside go through the library as one text: a space starts a match of the
    pattern wherever something other than white space follows, so the ids that begin with a space tell them apart again.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.starts = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.starts[[i for token, i in vocab.items() if token[0] == SPACE]] = True

    def _each(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<i4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        out = [b""] * len(texts)
        joined = [i for i, t in enumerate(texts) if spaced(t)]
        ids = np.array(self.tokenizer.encode_batch_fast(["".join([texts[i] for i in joined])], add_special_tokens=False)[0].ids, "<i4")
        at = np.flatnonzero(self.starts[ids])
        if len(at) == len(joined) and (not len(at) or at[0] == 0):
            raw, ends = ids.tobytes(), (4 * np.r_[at[1:], len(ids)]).tolist()
            for i, start, end in zip(joined, (4 * at).tolist(), ends if joined else [], strict=True):
                out[i] = raw[start:end]
        else:  # another kind of vocabulary
            joined = []
        alone = sorted(set(range(len(texts))) - set(joined))
        for i, one in zip(alone, self._each([texts[i] for i in alone]), strict=True):
            out[i] = one
        return out


@lru_cache(2)
def memo(path: str, pattern: str) -> Memo:
    return Memo(pattern, Encoder(path).encode, whole=True, limit=MEMO_PIECES)


def write(docs: DataFrame, path: str, pattern: str, end_id: int = 0, block: int = BLOCK, percentile: int = PERCENTILE) -> DataFrame:
    """Segments of all documents in ascending doc_id order, as a table (part, seq, n_docs, n_ids, content).

    Parts are ranges of doc_id; a part's rows, not the corpus, are sorted in a task.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        end = int(end_id).to_bytes(4, "little")
        for batch in batches:
            for piece in slices(batch, pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False), SEGMENT_CHARS):
                ids = [x + end for x in memo(path, pattern).ids(piece.column("text").to_pylist())]
                lengths = np.array([len(x) // 4 for x in ids], np.int64)
                doc_ids = pc.fill_null(piece.column("doc_id"), NO_ID).to_numpy()
                content = pack(np.frombuffer(b"".join(ids), "<u4"), lengths, doc_ids, block, percentile)
                yield pa.RecordBatch.from_pydict({"part": [part], "seq": [seq], "n_docs": [len(ids)], "n_ids": [int(lengths.sum())], "content": [content]}, schema=SEGMENTS)
                seq += 1

    return stash(rows.mapInArrow(run, "part int, seq int, n_docs long, n_ids long, content binary"), "token-ids")


SEGMENTS = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("content", pa.binary())])
READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.list_(pa.int32()))])


def with_base(segments: DataFrame) -> DataFrame:
    """Segments with the number of ids before each: sums over parts first, then inside a part."""
    parts = segments.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    before = F.coalesce(F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = segments.select("part", "seq", inside.alias("inside"))
    base = sizes.join(parts.select("part", before.alias("before")), "part").select("part", "seq", (F.col("inside") + F.col("before")).alias("base"))
    return segments.join(base, ["part", "seq"])


def read(segments: DataFrame, with_ids: bool = True) -> DataFrame:
    """Documents of the segments: doc_id, start, n_tokens, ids_crc32 and, if wanted, the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, content in zip(batch.column("base").to_pylist(), batch.column("content"), strict=True):
                doc_ids, lengths, ids = unpack(content.as_buffer().to_pybytes())
                ends = np.cumsum(lengths, dtype=np.int64)
                raw, starts = ids.astype("<u4").tobytes(), ends - lengths
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                cols = [pa.array(doc_ids, pa.int64(), mask=doc_ids == NO_ID), pa.array(base + starts), pa.array(lengths.astype(np.int64)), pa.array(crc, pa.int64())]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(cols, schema=pa.schema(list(READ)[: len(cols)]))

    kind = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    return with_base(segments).select("base", "content").mapInArrow(run, kind)
