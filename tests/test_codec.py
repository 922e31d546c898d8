"""Checksums, records and frames."""

from __future__ import annotations

import numpy as np
import pytest

from ledgerline.functions import codec
from ledgerline.schema import BAD_MAGIC, BAD_OP, BAD_VERSION, NO_SESSION, PAYLOAD_TOO_BIG


def record(seq=1, payload=b"Z" * 24, **more):
    return {"term": 1, "seq": seq, "session": 1, "client_seq": seq, "record_type": 0, "flags": 3, "partition_key": 1, "payload": payload} | more


def test_crc_vectors_and_chaining():
    assert codec.crc32c(b"123456789") == 0xE3069283
    assert codec.crc32c(b"a") == 0xC1D04330
    assert codec.crc32c(b"") == 0
    data = bytes(range(256)) * 2
    whole = codec.crc32c(data)
    assert all(codec.crc32c(data[k:], codec.crc32c(data[:k])) == whole for k in range(len(data)))


def test_crc_of_many_equals_single():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 5000, np.uint8)
    starts, lengths = rng.integers(0, 4000, 60), rng.integers(0, 40, 60)
    got = codec.crc32c_many(data, starts, lengths)
    assert [codec.crc32c(data[s : s + n].tobytes()) for s, n in zip(starts, lengths, strict=True)] == got.tolist()


def test_sizes():
    assert [codec.size_of(n) for n in (0, 1, 8, 9, -1, (1 << 20) + 1)] == [56, 64, 64, 72, 0, 0]


def test_round_trip_with_unsigned_ids():
    r = record(12345, b"fourteen bytes", term=3, session=-1, client_seq=7, flags=7, partition_key=0x1122334455667788)
    data = codec.encode([r | {"seq": 1}])[0]
    s = codec.scan(data, 1)
    assert len(data) == 72 and len(s.headers) == 1 and not s.torn and s.end == 72
    h = s.headers[0]
    assert (h["session"], h["partition_key"], h["len"], h["flags"]) == ((1 << 64) - 1, 0x1122334455667788, 14, 7)


def test_scan_stops_at_damage():
    data = b"".join(codec.encode([record(k) for k in (1, 2, 3)]))
    assert (len(codec.scan(data, 1).headers), codec.scan(data, 1).torn) == (3, False)
    for at in (160 + 70, 160 + 8, 160 + 44):  # payload, header, padding of the header
        bad = bytearray(data)
        bad[at] ^= 1
        s = codec.scan(bytes(bad), 1)
        assert (len(s.headers), s.end, s.torn) == (2, 160, True)
    shorter = bytearray(data)
    shorter[164] = 23  # a length of the same padded size
    assert codec.scan(bytes(shorter), 1).torn
    assert (len(codec.scan(data[:-1], 1).headers), codec.scan(data[:-1], 1).torn) == (2, True)
    clean = codec.scan(data + bytes(200), 1)
    assert (len(clean.headers), clean.torn) == (3, False)
    assert len(codec.scan(data, 5).headers) == 0 and codec.scan(data, 5).torn
    stale = data[:80] + codec.encode([record(9)])[0]
    assert (len(codec.scan(stale, 1).headers), codec.scan(stale, 1).torn) == (1, True)


def test_frames_and_their_order():
    hello, write = codec.frame("HELLO", codec.hello(0, b"me")), codec.frame("WRITE", b"x", 3, 1, 9)
    got = list(codec.frames(hello + write + write[:-1]))
    assert [f["op"] for f in got] == ["HELLO", "WRITE"] and got[1]["partition_key"] == 9
    for k in range(len(hello + write)):  # any prefix gives whole frames only
        assert len(list(codec.frames((hello + write)[:k]))) == (k >= len(hello))
    bad = {BAD_MAGIC: (0, 1), BAD_VERSION: (4, 9), BAD_OP: (8, 99), PAYLOAD_TOO_BIG: (15, 255)}
    for err, (at, value) in bad.items():
        frame = bytearray(write)
        frame[at] = value
        rows = list(codec.frames(hello + bytes(frame) + write))
        assert [r["err"] for r in rows] == [0, err]
    assert [r["err"] for r in codec.frames(write)] == [NO_SESSION]
    assert [r["err"] for r in codec.frames(hello + hello)] == [0, NO_SESSION]


def test_payloads_state_their_tails_exactly():
    p = codec.hello(7, b"name")
    assert codec.parse_hello(p) == {"session": 7, "name": b"name"}
    assert codec.parse_hello(p + b"x") is None and codec.parse_hello(p[:-1]) is None and codec.parse_hello(b"") is None
    e = codec.error(5, b"host:1")
    assert codec.parse_error(e) == {"code": 5, "text": b"host:1"} and codec.parse_error(e[:-1]) is None
    assert codec.parse_fixed(codec.SUBSCRIBE, codec.SUBSCRIBE.pack(1, 2)) == (1, 2)
    assert codec.parse_fixed(codec.READ, b"short") is None
    with pytest.raises(ValueError):
        codec.encode([record(payload=bytes((1 << 20) + 1))])
