"""Damaged gzip members of several records: what is whole in them is read."""

from __future__ import annotations

import random
import zlib

import pytest

from kpiscope.llm import warc

rng = random.Random(2)
BODIES = [bytes(rng.choices(b"abcdefghijklmnop", k=900)) for _ in range(6)]
RAWS = [warc.record(i, f"http://{i}", body, warc.digest(body), None) for i, body in enumerate(BODIES)]


def split(data):
    rows = list(warc.salvage(bytes(data)))
    return [r["page_id"] for r in rows if "reason" not in r], [(r["gap_start"], r["gap_bytes"], r.get("inside")) for r in rows if "reason" in r]


@pytest.mark.parametrize("hurt", [0, 2, 5])
def test_a_damaged_record_inside_a_member(hurt):
    raws = list(RAWS)
    raws[hurt] = raws[hurt].replace(BODIES[hurt], BODIES[hurt][::-1])
    first = warc.gzip_member(warc.record(9, "", b"", warc.digest(b""), None))
    got = split(first + warc.gzip_member(b"".join(raws)) + first)
    assert got == ([9, *(i for i in range(6) if i != hurt), 9], [(sum(map(len, raws[:hurt])), len(raws[hurt]), len(first))])


def test_a_member_that_is_cut():
    data = warc.gzip_member(b"".join(RAWS))
    ids, gaps = split(data[: len(data) * 3 // 4])
    assert ids == [0, 1, 2, 3] and gaps[0][2] == 0 and gaps[-1][2] is None


def test_a_member_with_a_wrong_check_sum():
    one, two = bytearray(warc.gzip_member(b"".join(RAWS))), warc.gzip_member(RAWS[0])
    one[-6] ^= 1
    ids, gaps = split(one + two)
    assert ids == [0, 1, 2, 3, 4, 5, 0] and len(gaps) == 1 and gaps[0][0] + gaps[0][1] == len(one)


def test_a_member_with_a_damaged_stream():
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    parts = [z.compress(r) + z.flush(zlib.Z_FULL_FLUSH) for r in RAWS] + [z.flush()]
    data = bytearray(b"".join(parts))
    at = sum(map(len, parts[:4]))
    data[at : at + 60] = b"\xff" * 60
    ids, gaps = split(data + warc.gzip_member(RAWS[5]))
    assert ids == [0, 1, 2, 3, 5] and gaps
    assert sum(n for start, n, inside in gaps if inside is None) > 0


def test_members_found_again_by_a_later_record():
    bad = RAWS[0].replace(BODIES[0], BODIES[0][::-1])
    ids, gaps = split(b"noise" + warc.gzip_member(bad + RAWS[1]))
    assert ids == [1] and gaps == [(0, 5, None), (0, len(bad), 5)]
