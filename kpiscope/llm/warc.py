"""WARC archives: a writer with revisit records and a salvaging reader.

An archive is a row (path, content), the columns of Spark's binaryFile source, so the reader takes the writer's table
and `spark.read.format("binaryFile")` over real .warc or .warc.gz files alike. The writer's table is committed by Spark.

The reader checks each record (gzip member, version line, headers, lengths, end mark, payload digest). After a failed check it
searches for the next valid gzip member or version line, goes on from there, and logs the bytes between as a gap. Inside a gzip member
it does the same with the inflated bytes, those before a failed check or a cut included; gaps there count inflated bytes and name
the member's place in the column `inside`. Where a member of several records fails its check, records that pass their own are given and the failure is logged
as a gap, empty if no bytes are left; a member with a single record then is a gap as a whole.

Nulls: a null html is an empty payload, a null url an empty target, a null page_id is written as `none` and read as null.
Of repeated rows with the largest page_id each is a response. Other columns of the input are left out.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiscope.llm.bpe import slices
from kpiscope.llm.shared import bounded_batches, stash

#: So many bytes of payload make an archive, one record at least.
ARCHIVE_BYTES = 8 << 20
VERSION = b"WARC/1.1\r\n"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ARCHIVES = pa.schema([("path", pa.string()), ("content", pa.binary())])
FOUND = "path string, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary, gap_start long, gap_bytes long, inside long, reason string"
FIELDS = [f.split()[0] for f in FOUND.split(", ")]


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def holders(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Payloads found more than once, with the page that holds the response: key, holder."""
    keyed = pages.select("page_id", F.sha1(F.encode("html", "UTF-8")).alias("key"), F.octet_length("html").alias("size"))
    keyed = keyed.filter(F.col("size") >= least_bytes)
    return keyed.groupBy("key").agg(F.max("page_id").alias("holder"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", "holder")


def record(page_id: int | None, url: str, payload: bytes, payload_digest: str, refers_to: int | None) -> bytes:
    kind = "response" if refers_to is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'none' if page_id is None else page_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {re.sub(r'[\r\n]', ' ', url)}", f"WARC-Payload-Digest: sha1:{payload_digest}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return VERSION + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write(pages: DataFrame, least_bytes: int = 0, compressed: bool = True) -> DataFrame:
    """Archives of all pages. Of equal payloads of least_bytes at least, the largest page_id is the response."""
    bounded_batches(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    held = stash(holders(rows, least_bytes), "warc-holders")
    found = rows.withColumn("key", F.when(F.octet_length("html") >= least_bytes, F.sha1(F.encode("html", "UTF-8")))).join(held, "key", "left")
    other = F.col("holder").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("holder"))
    rows = found.select("page_id", "url", "html", F.when(other, F.col("holder")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            for piece in slices(batch, pc.binary_length(batch.column("html")).to_numpy(zero_copy_only=False), ARCHIVE_BYTES):
                out = []
                for page_id, url, html, refers in zip(*(c.to_pylist() for c in piece.columns), strict=True):
                    payload = html.encode()
                    raw = record(page_id, url, payload, digest(payload), refers)
                    out.append(gzip_member(raw) if compressed else raw)
                name = f"pages-{part:05d}-{seq:05d}.warc" + ".gz" * compressed
                yield pa.RecordBatch.from_pydict({"path": [name], "content": [b"".join(out)]}, schema=ARCHIVES)
                seq += 1

    return stash(rows.mapInArrow(run, "path string, content binary"), "warc")


def gzip_member(raw: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


class Bad(ValueError):
    """A failed check; the message is logged."""


def parse(raw: bytes, at: int = 0) -> tuple[dict, int]:
    """The record at a place, and where it ends."""
    if not raw.startswith(b"WARC/1.", at):
        raise Bad("no version line")
    end = raw.find(b"\r\n\r\n", at)
    if end < 0:
        raise Bad("headers do not end")
    head = {}
    for line in raw[at:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Bad("a header has no colon")
        head[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    if not head.get("content-length", "").isdecimal():
        raise Bad("no content length")
    start, size = end + 4, int(head["content-length"])
    if raw[start + size : start + size + 4] != b"\r\n\r\n":
        raise Bad("the block does not end where its length says")
    block = raw[start : start + size]
    http, blank, payload = block.partition(b"\r\n\r\n")
    if head.get("warc-type") in ("response", "revisit") and not blank:
        raise Bad("no HTTP headers")
    said = head.get("warc-payload-digest", "").removeprefix("sha1:")
    if head.get("warc-type") == "response" and said and said != digest(payload):
        raise Bad("the payload does not match its digest")
    length = re.search(rb"(?im)^content-length:\s*(\d+)", http)
    page, refers = (re.search(r"urn:page:(-?\d+)", head.get(k, "")) for k in ("warc-record-id", "warc-refers-to"))
    return {
        "page_id": int(page[1]) if page else None, "url": head.get("warc-target-uri"), "record_type": head.get("warc-type"),
        "payload_bytes": int(length[1]) if length and head.get("warc-type") == "revisit" else len(payload),
        "payload_digest": said or digest(payload), "refers_to": int(refers[1]) if refers else None, "payload": payload,
    }, start + size + 4


FAILED = "a gzip member fails its check"


def member(data: bytes, at: int, step: int = 1 << 16) -> tuple[bytes, int, str | None]:
    """What the gzip member at a place inflates to, where it ends or fails, and why it fails."""
    z, out = zlib.decompressobj(31), []
    while not z.eof:
        if at >= len(data):
            return b"".join(out), at, "a gzip member is cut short"
        held = z.copy() if step > 1 else None
        try:
            out.append(z.decompress(data[at : at + step]))
        except zlib.error:
            if step == 1:
                return b"".join(out), at, FAILED
            z, step = held, 1  # byte by byte, for all that comes before the error
            continue
        at = min(at + step, len(data))
    return b"".join(out), at - len(z.unused_data), None


def inner(raw: bytes, inside: int) -> Iterator[dict]:
    """Records of a member's inflated bytes; a gap for each stretch between them that could not be read."""
    at = 0
    while at < len(raw):
        try:
            row, at = parse(raw, at)
            yield row
        except Bad as why:
            found = next_record(raw, at + 1)
            yield {"gap_start": at, "gap_bytes": found - at, "inside": inside, "reason": str(why)}
            at = found


def salvage(data: bytes) -> Iterator[dict]:
    """Records of an archive in order; rows with gap_bytes stand for bytes that could not be read."""
    at, size = 0, len(data)
    while at < size:
        if data.startswith(b"\x1f\x8b", at):
            raw, end, why = member(data, at)
            if not raw and why is None:  # an empty member
                at = end
                continue
            if holds(raw, why):
                yield from inner(raw, at)
                at = end
                if why is None:
                    continue
                search = at  # may be the end; the gap then is empty and says why
            else:
                why, search = why or "a gzip member holds no record", at + 1
        else:
            try:
                row, at = parse(data, at)
                yield row
                continue
            except Bad as e:
                why, search = str(e), at + 1
        found = following(data, search)
        yield {"gap_start": at, "gap_bytes": found - at, "reason": why}
        at = found


def holds(raw: bytes, why: str | None) -> bool:
    """Whether records of a member can be read. A failed check is that of its record, if there is only one."""
    at = next_record(raw, 0)
    if at == len(raw) or why != FAILED:
        return at < len(raw)
    return next_record(raw, parse(raw, at)[1]) < len(raw)


def next_record(raw: bytes, at: int) -> int:
    """The next place with a record; else the end."""
    for m in re.compile(rb"WARC/1\.").finditer(raw, at):
        try:
            parse(raw, m.start())
        except Bad:
            continue
        return m.start()
    return len(raw)


def following(data: bytes, at: int) -> int:
    """The next place with a gzip member that holds a record, or with a record; else the end."""
    for m in re.compile(rb"\x1f\x8b\x08|WARC/1\.").finditer(data, at):
        place = m.start()
        if m[0] == b"\x1f\x8b\x08":
            raw, _, why = member(data, place)
            if holds(raw, why):
                return place
            continue
        try:
            parse(data, place)
        except Bad:
            continue
        return place
    return len(data)


def read(archives: DataFrame) -> DataFrame:
    """Records and gaps of all archives (columns FOUND); gap rows have a reason, records have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                data = content.as_py()
                rows, held = [], 0
                for row in salvage(data or b""):
                    rows.append({"path": path, **row})
                    held += len(row.get("payload") or b"")
                    if held > ARCHIVE_BYTES:
                        yield to_batch(rows)
                        rows, held = [], 0
                if rows:
                    yield to_batch(rows)

    return archives.select("path", "content").mapInArrow(run, FOUND)


def to_batch(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([r.get(f.split()[0]) for r in rows], kinds[f.split()[1]]) for f in FOUND.split(", ")], names=FIELDS)
