"""Media columns: an Ogg writer and reader for binary columns.

The reader walks the pages of a physical stream, verifies each page's checksum
and sequence number, rebuilds packets from the lacing values (also those that
run over several pages), separates the logical streams by serial number, and
derives times from granule positions.  The writer multiplexes a stream of 8-bit
samples with an index stream that states offset and CRC-32 of each packet.

Defined cases: null and empty payloads are stored as 64 zero samples by
``pad``; equal payloads give equal bytes (serial numbers come from the
payload); damaged pages raise ``OggError``.  Memory is that of one payload.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow

RATE = 8000
PACKET = 16384
PAD = 64

# Fixed values of the Ogg format: capture pattern, header layout, flags.
MAGIC = b"OggS"
HEADER = struct.Struct("<4sBBqIIIB")
CONTINUED, FIRST, LAST = 1, 2, 4

_SAMPLES = struct.Struct("<8sIHH")  # head of the sample stream: name, rate, channels, bits
_INDEX = struct.Struct("<QII")  # an entry of the index stream: first sample, samples, CRC-32
SAMPLE_HEAD, INDEX_HEAD = b"\x01pcm8   ", b"\x01index  "

_MIRROR = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


class OggError(ValueError):
    pass


def checksum(page: bytes) -> int:
    """The page checksum (polynomial 0x04C11DB7, high bit first, start 0, no final inversion).

    It is the mirror image of zlib's CRC over mirrored bytes, with zlib's inversions undone.
    """
    low_first = zlib.crc32(page.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(low_first.to_bytes(4, "little").translate(_MIRROR), "big")


def _page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = HEADER.pack(MAGIC, 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    crc = checksum(head + body)
    return b"".join((head[:22], crc.to_bytes(4, "little"), head[26:], body))


def pages(packets: list[tuple[bytes, int]], serial: int) -> Iterator[tuple[int, bytes]]:
    """(granule, page) for a logical stream of (packet, granule at its end); the first packet has a page of its own."""
    number = 0
    for k, part in enumerate((packets[:1], packets[1:])):
        lacing, body, granule, flags = bytearray(), bytearray(), -1, FIRST if k == 0 else 0
        left = len(part)
        if not part and k:
            continue
        for data, ends in part:
            left -= 1
            sizes = bytes([255]) * (len(data) // 255) + bytes([len(data) % 255])
            at = 0
            while sizes:
                take = sizes[: 255 - len(lacing)]
                sizes = sizes[len(take) :]
                n = sum(take)
                lacing += take
                body += data[at : at + n]
                at += n
                if not sizes:
                    granule = ends
                if len(lacing) == 255 and (sizes or left):
                    yield max(granule, 0), _page(flags, granule, serial, number, bytes(lacing), bytes(body))
                    number += 1
                    lacing, body, granule = bytearray(), bytearray(), -1
                    flags = CONTINUED if sizes else 0
        yield max(granule, 0), _page(flags | (LAST if k or len(packets) == 1 else 0), granule, serial, number, bytes(lacing), bytes(body))
        number += 1


def write(payload: bytes, rate: int = RATE, packet: int = PACKET) -> bytes:
    """The payload as 8-bit samples of one stream, beside its index stream."""
    parts = [payload[i : i + packet] for i in range(0, len(payload), packet)] or [b""]
    ends = np.cumsum([len(p) for p in parts]).tolist()
    serial = zlib.crc32(payload)
    samples = [(_SAMPLES.pack(SAMPLE_HEAD, rate, 1, 8), 0), *zip(parts, ends, strict=True)]
    index = [(INDEX_HEAD, 0), *((_INDEX.pack(e - len(p), len(p), zlib.crc32(p)), e) for p, e in zip(parts, ends, strict=True))]
    streams = [list(pages(samples, serial)), list(pages(index, serial ^ 0xFFFFFFFF))]
    return b"".join([*(s[0][1] for s in streams), *_by_time([s[1:] for s in streams])])


def _by_time(streams: list[list[tuple[int, bytes]]]) -> Iterator[bytes]:
    """Pages of all streams by granule, those of one stream in their own order."""
    at, now = [0] * len(streams), [0] * len(streams)
    while open_ := [k for k, s in enumerate(streams) if at[k] < len(s)]:
        k = min(open_, key=lambda k: (now[k], k))
        granule, page = streams[k][at[k]]
        now[k] = max(now[k], granule)
        at[k] += 1
        yield page


@dataclass
class Logical:
    """A logical stream as read: whole packets, and the end time of each page that ends one."""

    serial: int
    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)
    pages: int = 0
    ended: bool = False
    partial: bytearray | None = None


def read(media: bytes) -> list[Logical]:
    """The logical streams of a physical stream, in order of appearance."""
    streams: dict[int, Logical] = {}
    at, view = 0, memoryview(media)
    while at < len(media):
        if len(media) - at < HEADER.size:
            raise OggError(f"page at {at}: cut short")
        magic, version, flags, granule, serial, number, crc, n = HEADER.unpack_from(media, at)
        if magic != MAGIC or version:
            raise OggError(f"page at {at}: no page begins here")
        lacing = view[at + HEADER.size : at + HEADER.size + n]
        body = at + HEADER.size + n
        end = body + sum(lacing)
        if len(lacing) < n or end > len(media):
            raise OggError(f"page at {at}: cut short")
        if checksum(b"".join((view[at : at + 22], b"\0\0\0\0", view[at + 26 : end]))) != crc:
            raise OggError(f"page at {at}: checksum differs")
        if flags & FIRST:
            if serial in streams:
                raise OggError(f"page at {at}: stream {serial} begins twice")
            streams[serial] = Logical(serial)
        s = streams.get(serial)
        if s is None or s.ended or s.pages != number:
            raise OggError(f"page at {at}: not the next page of stream {serial}")
        if bool(flags & CONTINUED) != (s.partial is not None):
            raise OggError(f"page at {at}: a packet's continuation is missing")
        whole, start, cursor = 0, body, body
        for size in lacing:
            cursor += size
            if size < 255:
                part = bytes(view[start:cursor])
                s.packets.append(bytes(s.partial) + part if s.partial is not None else part)
                s.partial, start = None, cursor
                whole += 1
        if n and lacing[-1] == 255:
            s.partial = (s.partial or bytearray()) + view[start:cursor]
        if (granule == -1) != (whole == 0):
            raise OggError(f"page at {at}: granule position does not fit its packets")
        if whole:
            s.granules.append(granule)
        s.pages += 1
        s.ended = bool(flags & LAST)
        at = end
    for s in streams.values():
        if not s.ended or s.partial is not None:
            raise OggError(f"stream {s.serial} does not end")
    return list(streams.values())


@dataclass
class Media:
    samples: bytes
    rate: int
    duration_s: float
    pages: int
    packets: int


def decode(media: bytes) -> Media:
    """The samples of what ``write`` made, checked against its index stream."""
    by_head = {s.packets[0][: len(SAMPLE_HEAD)]: s for s in read(media)}
    if set(by_head) != {SAMPLE_HEAD, INDEX_HEAD}:
        raise OggError("the sample stream or its index is missing")
    own, index = by_head[SAMPLE_HEAD], by_head[INDEX_HEAD]
    _, rate, _, _ = _SAMPLES.unpack(own.packets[0])
    parts, at = own.packets[1:], 0
    if len(index.packets) - 1 != len(parts):
        raise OggError("the index has another number of packets")
    for part, entry in zip(parts, index.packets[1:], strict=True):
        if _INDEX.unpack(entry) != (at, len(part), zlib.crc32(part)):
            raise OggError(f"samples from {at} differ from the index")
        at += len(part)
    if own.granules[-1] != at:
        raise OggError("the last granule position is not the number of samples")
    return Media(b"".join(parts), rate, own.granules[-1] / rate, own.pages + index.pages, len(parts))


def pad(text: str | None) -> tuple[int, bytes]:
    """(bytes of the text, payload): UTF-8, then zeros up to a positive multiple of 64."""
    raw = (text or "").encode()
    size = max(PAD, -(-len(raw) // PAD) * PAD)
    return len(raw), raw.ljust(size, b"\0")


def describe(m: Media) -> str:
    """Features of the samples: length, pages, mean, level about the middle (128), share of middle crossings."""
    x = np.frombuffer(m.samples, np.uint8).astype(np.int64)
    mean = int(x.sum()) / len(x) if len(x) else 0.0
    level = (float(((x - 128) ** 2).sum()) / len(x)) ** 0.5 if len(x) else 0.0
    crossings = int(np.count_nonzero((x[1:] >= 128) != (x[:-1] >= 128)))
    return f"duration_ms={round(m.duration_s * 1000)};rate={m.rate};pages={m.pages};packets={m.packets};mean={mean:.4f};level={level:.4f};crossings={crossings}"


DIGEST = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digest(text: str | None) -> tuple:
    n, payload = pad(text)
    stored = write(payload)
    m = decode(stored)
    return n, len(m.samples), hashlib.sha256(m.samples).hexdigest(), zlib.crc32(m.samples[-PAD:]), len(stored), hashlib.sha256(stored).hexdigest(), describe(m)


def encode_column(docs: DataFrame, *, text_col: str = "text", media_col: str = "media", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` and a binary column with the stored form of each text."""
    keep = keep or []
    source = docs.select(*keep, F.col(text_col).alias("__text"))

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array([write(pad(t.as_py())[1]) for t in batch.column("__text")], pa.binary())], [*keep, media_col])

    return map_arrow(source, run, T.StructType([*(source.schema[c] for c in keep), T.StructField(media_col, T.BinaryType())]))


def report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store each text, read the stored bytes back, and describe them: one row per document."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    fields = T._parse_datatype_string(DIGEST).fields
    schema = T.StructType([source.schema["id"], *fields])

    def run(batches):
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            rows = [digest(t.as_py()) for t in batch.column("text")]
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["id", *(f.name for f in fields)])

    return map_arrow(source, run, schema).withColumnRenamed("id", id_col)
