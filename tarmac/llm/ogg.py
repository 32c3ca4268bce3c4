"""Ogg media columns: page checksums, lacing, logical streams and granule timestamps.

A physical stream is a run of pages. A page holds lacing values, which cut its body into segments; a
segment of under 255 bytes ends a packet, so a packet may go on over pages. Pages of several logical
streams, told apart by serial number, are interleaved. The granule position of a page counts the
samples up to the end of the last packet that ends on it.

``store`` writes bytes as 8-bit unsigned mono samples in the OggPCM mapping, dealt block by block to two
logical streams; ``read`` takes any Ogg bytes.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarmac.llm.batches import mapped, slices
from tarmac.llm.storage import free_name

RATE, BLOCK, STREAMS = 8000, 576, 2
PAGE_SEGMENTS = 17
_HEAD = struct.Struct("<4sBBqIIIB")
_MIRROR = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))
CONTINUED, FIRST, LAST = 1, 2, 4


def page_crc(page: bytes) -> int:
    """CRC of polynomial 0x04c11db7, most significant bit first, from 0: the mirrored CRC of the mirrored bytes."""
    mirrored = zlib.crc32(page.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(_MIRROR), "big")


def _page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = _HEAD.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    crc = page_crc(head + body)
    return head[:22] + crc.to_bytes(4, "little") + head[26:] + body


def paged(packets: list[tuple[bytes, int]], serial: int, number: int = 0, first: bool = True, last: bool = True, segments: int = PAGE_SEGMENTS) -> list[tuple[int, bytes]]:
    """(granule reached, page) for packets given with the granule at their ends. -1: no packet ends on the page."""
    lacing, sizes = bytearray(), []
    for data, granule in packets:
        whole, rest = divmod(len(data), 255)
        lacing += b"\xff" * whole + bytes([rest])
        sizes += [-1] * whole + [granule]
    body, out, at, going = b"".join(d for d, _ in packets), [], 0, False
    for lo in range(0, len(lacing), segments):
        own, ends = bytes(lacing[lo : lo + segments]), sizes[lo : lo + segments]
        n = sum(own)
        granule = next((g for g in reversed(ends) if g >= 0), -1)
        flags = (CONTINUED if going else 0) | (FIRST if first and lo == 0 else 0) | (LAST if last and lo + segments >= len(lacing) else 0)
        out.append((granule, _page(flags, granule, serial, number, own, body[at : at + n])))
        at, going, number = at + n, own[-1] == 255, number + 1
    return out


def pcm_header(channels: int = 1, rate: int = RATE) -> bytes:
    """OggPCM: magic, version 0.0, format 1 (unsigned 8 bit), rate, significant bits, channels, frames a packet, extra headers."""
    return b"PCM     " + struct.pack(">HHIIBBHI", 0, 0, 1, rate, 8, channels, BLOCK, 0)


def store(payload: bytes) -> bytes:
    """``payload`` as 8-bit samples: block i of 576 is a packet of logical stream i mod 2."""
    blocks = [payload[i : i + BLOCK] for i in range(0, len(payload), BLOCK)]
    head, rest = [], []
    for s in range(STREAMS):
        own = blocks[s::STREAMS]
        head += [p for _, p in paged([(pcm_header(), 0)], s + 1, last=not own)]
        at, packets = 0, []
        for b in own:
            at += len(b)
            packets.append((b, at))
        pages = paged(packets, s + 1, number=1, first=False) if own else []
        reached = 0
        for i, (granule, page) in enumerate(pages):
            reached = max(reached, granule)
            rest.append((reached, s, i, page))
    rest.sort(key=lambda x: x[:3])
    return b"".join(head) + b"".join(x[3] for x in rest)


class Stream:
    """A logical stream as read: whole packets, the seconds at which they end, lost pages and broken packets."""

    def __init__(self, serial: int):
        self.serial, self.packets, self.seconds, self.pages, self.gaps, self.broken, self.ended = serial, [], [], 0, 0, 0, False
        self.granule, self._next, self._open, self._undated, self.rate = 0, None, None, [], RATE

    def take(self, flags: int, granule: int, number: int, lacing: bytes, data: bytes, at: int) -> None:
        lost = self._next is not None and number != self._next
        self.gaps += lost
        self._next, self.pages, self.ended = (number + 1) & 0xFFFFFFFF, self.pages + 1, self.ended or bool(flags & LAST)
        going = self._open if flags & CONTINUED and not lost else None
        if self._open is not None and going is None:
            self.broken += 1
        # what goes on from a packet whose beginning is lost is skipped up to its end
        skipping = bool(flags & CONTINUED) and going is None
        parts = [going] if going is not None else []
        begun, start, dated = going is not None, at, []
        for x in lacing:
            at += x
            begun = True
            if x < 255:
                if not skipping:
                    dated.append(b"".join([*parts, data[start:at]]))
                self.broken += skipping
                skipping, parts, start, begun = False, [], at, False
        self._open = b"".join([*parts, data[start:at]]) if begun and not skipping else None
        if dated:
            self._date(dated, granule)

    def _date(self, packets: list[bytes], granule: int) -> None:
        """The page's granule is the end of its last packet; the others end a packet's samples earlier."""
        if not self.packets and packets[0][:8] == b"PCM     " and len(packets[0]) >= 28:
            self.rate = struct.unpack(">I", packets[0][16:20])[0] or RATE
            self.packets.append(packets.pop(0))
            self.seconds.append(0.0)
        ends = []
        for p in reversed(packets):
            ends.append(granule)
            granule -= len(p)
        self.packets += packets
        self.seconds += [x / self.rate for x in reversed(ends)]
        if ends:
            self.granule = ends[0]


def read(media: bytes) -> dict:
    """streams (by first page), pages, bad (pages whose checksum is wrong, skipped) and junk (bytes between pages)."""
    streams: dict[int, Stream] = {}
    at, bad, junk, pages, n = 0, 0, 0, 0, len(media)
    while at + 27 <= n:
        if media[at : at + 4] != b"OggS":
            to = media.find(b"OggS", at + 1)
            to = n if to < 0 else to
            junk, at = junk + to - at, to
            continue
        _, version, flags, granule, serial, number, crc, count = _HEAD.unpack_from(media, at)
        lacing = media[at + 27 : at + 27 + count]
        body = at + 27 + count
        end = body + sum(lacing)
        if version or len(lacing) < count or end > n or page_crc(media[at : at + 22] + b"\0\0\0\0" + media[at + 26 : end]) != crc:
            bad, at = bad + 1, at + 4  # look for the next page within, as the lengths may be wrong too
            continue
        pages += 1
        streams.setdefault(serial, Stream(serial)).take(flags, granule, number, lacing, media, body)
        at = end
    return {"streams": list(streams.values()), "pages": pages, "bad": bad, "junk": junk + n - at}


def payload_of(found: dict) -> bytes:
    """The samples of ``store``, block by block from its logical streams in the order of their timestamps."""
    lanes = [s.packets[1:] for s in sorted(found["streams"], key=lambda s: s.serial)]
    longest = max(map(len, lanes), default=0)
    return b"".join(lane[i] for i in range(longest) for lane in lanes if i < len(lane))


def padded(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw + b"\xff" * (max(1, -(-len(raw) // BLOCK)) * BLOCK - len(raw))


def _mapped(df: DataFrame, column: str, new: str, of, kind) -> DataFrame:
    """``df`` with a column computed from another, a value at a time, in Arrow batches."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import from_arrow_type

    name = free_name([c for c in df.columns if c != new], new)
    kept = [c for c in df.columns if c != name]
    at = df.columns.index(column)
    use = [df.columns.index(c) for c in kept]
    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField(name, from_arrow_type(kind))])

    def run(batches: Iterator) -> Iterator:
        for b in slices(batches):
            values = pa.array([of(v) for v in b.column(at).to_pylist()], kind)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in use), values], [*kept, name])

    return mapped(df, run, schema)


def encode_ogg(df: DataFrame, text_col: str = "text", media_col: str = "media") -> DataFrame:
    """``df`` with the whole text's UTF-8 bytes, filled up with 255 to a positive multiple of 576, stored as Ogg.

    A null or empty text is one block of 255. A column called ``media_col`` is replaced.
    """
    import pyarrow as pa

    return _mapped(df, text_col, media_col, lambda t: store(padded(t)), pa.binary())


def decode_ogg(df: DataFrame, media_col: str = "media", out_col: str = "ogg") -> DataFrame:
    """``df`` with a struct of pages, bad, junk and, per logical stream, its packets and their end times.

    Pages with a wrong checksum are counted and skipped, as are packets that lose a part by it. A null
    is null; bytes that are no Ogg give no streams.
    """
    import pyarrow as pa

    stream = pa.struct([("serial", pa.int64()), ("pages", pa.int64()), ("gaps", pa.int64()), ("broken", pa.int64()), ("ended", pa.bool_()), ("packets", pa.list_(pa.binary())), ("seconds", pa.list_(pa.float64()))])
    kind = pa.struct([("pages", pa.int64()), ("bad", pa.int64()), ("junk", pa.int64()), ("streams", pa.list_(stream))])

    def of(media):
        if media is None:
            return None
        x = read(media)
        return x | {"streams": [{k: getattr(s, k) for k in ("serial", "pages", "gaps", "broken", "ended", "packets", "seconds")} for s in x["streams"]]}

    return _mapped(df, media_col, out_col, of, kind)


def features(found: dict, payload: bytes) -> str:
    """Streams, pages, packets, duration, and level, loudness and crossings of the samples as read."""
    import numpy as np

    x = np.frombuffer(payload, np.uint8).astype(np.float32) - 128
    crossings = int(np.count_nonzero(np.signbit(x[1:]) != np.signbit(x[:-1])))
    seconds = sum(s.granule / s.rate for s in found["streams"])
    ok = not (found["bad"] or found["junk"] or any(s.gaps or s.broken or not s.ended for s in found["streams"]))
    packets = sum(len(s.packets) for s in found["streams"])
    return f"ok={int(ok)};streams={len(found['streams'])};pages={found['pages']};packets={packets};seconds={seconds:.6f};mean={float(x.mean(dtype=np.float64)):.4f};rms={float(np.sqrt(np.square(x).mean(dtype=np.float64))):.4f};crossings={crossings}"


def ogg_digest(df: DataFrame, media_col: str = "media", out_col: str = "digest") -> DataFrame:
    """``df`` with digests of the samples that are read back from ``store``'s bytes, and of those bytes."""
    import pyarrow as pa

    kind = pa.struct([("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("seconds", pa.float64())])

    def of(media):
        if media is None:
            return None
        found = read(media)
        payload = payload_of(found)
        seconds = max((s.seconds[-1] for s in found["streams"] if s.seconds), default=0.0)
        return {"payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-32:]), "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(), "feature": features(found, payload), "seconds": seconds}

    return _mapped(df, media_col, out_col, of, kind)


def op1_ogg_media(spark, sf_dir: str) -> DataFrame:
    """Every whole text stored as Ogg, read back and digested."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    media = encode_ogg(docs.withColumn("n_bytes", F.octet_length("text").cast("long")))
    return ogg_digest(media.drop("text")).select("doc_id", "n_bytes", "digest.*")
