"""Ogg: checksums, lacing, streams and timestamps."""

import hashlib
import os
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tarmac.llm import ogg


def slow_crc(data: bytes) -> int:
    c = 0
    for b in data:
        c ^= b << 24
        for _ in range(8):
            c = ((c << 1) ^ 0x04C11DB7) & 0xFFFFFFFF if c & 0x80000000 else (c << 1) & 0xFFFFFFFF
    return c


def test_page_checksum():
    for n in (0, 1, 27, 400):
        data = os.urandom(n)
        assert ogg.page_crc(data) == slow_crc(data)


@pytest.mark.parametrize("n", [0, 1, 575, 576, 577, 1152, 30_000])
def test_round_trip(n):
    payload = ogg.padded("é" * (n // 2) + "x" * (n % 2))
    assert len(payload) % 576 == 0 and payload
    found = ogg.read(ogg.store(payload))
    assert ogg.payload_of(found) == payload
    assert found["bad"] == found["junk"] == 0 and all(s.ended and not s.gaps for s in found["streams"])
    first = found["streams"][0]
    assert first.seconds[:2] == [0.0, 576 / 8000]


def test_packets_over_pages_and_lengths_of_255():
    rnd = random.Random(1)
    sizes = [0, 1, 254, 255, 256, 510, 511, 4335, 9000, 70_000]
    packets, at = [], 0
    for n in sizes:
        at += n
        packets.append((rnd.randbytes(n), at))
    pages = ogg.paged([(ogg.pcm_header(), 0), *packets], 7)
    found = ogg.read(b"".join(p for _, p in pages))
    (s,) = found["streams"]
    assert s.packets[1:] == [p for p, _ in packets]
    assert s.seconds[-1] == at / 8000 and not s.broken


def test_streams_apart_and_damage():
    a = ogg.paged([(b"a" * 3000, 3000), (b"b" * 10, 3010)], 1, segments=5)
    b = ogg.paged([(b"c" * 2000, 2000)], 2, segments=5)
    mixed = b"".join(x for pair in zip(a, b + [(0, b"")] * len(a)) for _, x in pair)
    found = ogg.read(b"junk" + mixed + b"??")
    assert [s.packets for s in found["streams"]] == [[b"a" * 3000, b"b" * 10], [b"c" * 2000]]
    assert found["junk"] == 6
    broken = bytearray(mixed)
    broken[mixed.index(b"aaaa") + 2] ^= 1
    found = ogg.read(bytes(broken))
    assert found["bad"] == 1
    assert any(s.serial == 2 and s.packets == [b"c" * 2000] for s in found["streams"])
    assert ogg.read(b"")["streams"] == [] and ogg.read(b"OggS")["streams"] == []


def test_columns(spark):
    df = spark.createDataFrame([(1, "x" * 1000, "m"), (1, None, None), (None, "", "k")], "doc_id long, text string, media string")
    coded = ogg.encode_ogg(df)
    assert coded.columns == ["doc_id", "text", "media"]
    back = ogg.decode_ogg(coded).collect()
    assert all(r["ogg"]["bad"] == 0 and len(r["ogg"]["streams"]) == 2 for r in back)
    got = {r["text"]: r["digest"] for r in ogg.ogg_digest(coded).collect()}
    want = b"x" * 1000 + b"\xff" * 152
    assert got["x" * 1000]["payload_sha256"] == hashlib.sha256(want).hexdigest()
    assert got["x" * 1000]["tail_crc32"] == zlib.crc32(want[-32:])
    assert got[None] == got[""] and got[None]["payload_bytes"] == 576
    nothing = ogg.decode_ogg(df.where("false").select(F.lit(None).cast("binary").alias("media")))
    assert nothing.count() == 0
    assert ogg.decode_ogg(spark.createDataFrame([(None,), (bytearray(b"no"),)], "media binary")).where("ogg is null").count() == 1
