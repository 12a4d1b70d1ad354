"""Texts as Ogg media: pages with checksums, packets laced over segments, two logical streams, granule times.

A text's bytes, padded with 255 to a positive multiple of 576, are the 8-bit samples of one logical stream, 576 to a
packet; a second stream holds the unpadded length. Reading verifies every page's checksum, demultiplexes by serial
number, reassembles packets from lacing values (over page ends too) and takes times from granule positions.

Cases: a null or empty text is one packet of padding; equal texts give equal media, since serial numbers come from
the payload; in a table, null media have null features, and damaged media null features and an error that names the page (`read`
itself raises OggError); ids are passed through with any nulls or repeats; texts may be of any length; other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmark.llm.common import documents, mapped

PACKET, RATE, PAGE_SEGMENTS = 576, 48_000, 255
_HEAD = struct.Struct("<4sBBqIIIB")
_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))
CONTINUED, FIRST, LAST = 1, 2, 4


class OggError(ValueError):
    pass


def checksum(page: bytes) -> int:
    """CRC with polynomial 0x04C11DB7, highest bit first, from 0: zlib's CRC over bytes and sums with bits reversed."""
    found = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(found.to_bytes(4, "little").translate(_REVERSED), "big")


def lacing(size: int) -> bytes:
    return b"\xff" * (size // 255) + bytes([size % 255])


def page(serial: int, number: int, flags: int, granule: int, table: bytes, body: bytes) -> bytes:
    raw = _HEAD.pack(b"OggS", 0, flags, granule, serial, number, 0, len(table)) + table + body
    return raw[:22] + struct.pack("<I", checksum(raw)) + raw[26:]


def write_stream(serial: int, packets: list[bytes], granules: list[int]) -> list[bytes]:
    """Pages of one logical stream; a packet that doesn't end on a page goes on in the next."""
    table, body, ends = b"".join(map(lacing, map(len, packets))), b"".join(packets), []
    segment = 0
    for p, g in zip(packets, granules, strict=True):
        segment += len(p) // 255 + 1
        ends.append((segment, g))
    out, at, e, last_granule = [], 0, 0, -1
    split = range(0, len(table), PAGE_SEGMENTS)
    open_packet = False
    for k, start in enumerate(split):
        some = table[start : start + PAGE_SEGMENTS]
        granule = -1
        while e < len(ends) and ends[e][0] <= start + len(some):
            granule = last_granule = ends[e][1]
            e += 1
        size = sum(some)
        flags = (CONTINUED if open_packet else 0) | (FIRST if k == 0 else 0) | (LAST if k == len(split) - 1 else 0)
        out.append(page(serial, k, flags, granule, some, body[at : at + size]))
        at += size
        open_packet = some[-1] == 255
    return out


@dataclass
class Stream:
    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)
    pages: int = 0
    closed: bool = False
    rest: list[bytes] = field(default_factory=list)


def read(media: bytes) -> dict[int, Stream]:
    """Logical streams by serial number."""
    streams: dict[int, Stream] = {}
    at = number = 0
    while at < len(media):
        if len(media) - at < _HEAD.size or media[at : at + 4] != b"OggS" or media[at + 4] != 0:
            raise OggError(f"page {number}: no page begins at byte {at}")
        _, _, flags, granule, serial, sequence, crc, segments = _HEAD.unpack_from(media, at)
        table = media[at + _HEAD.size : at + _HEAD.size + segments]
        body = at + _HEAD.size + segments
        end = body + sum(table)
        if len(table) < segments or end > len(media):
            raise OggError(f"page {number}: cut short")
        if checksum(media[at : at + 22] + bytes(4) + media[at + 26 : end]) != crc:
            raise OggError(f"page {number}: wrong checksum")
        if bool(flags & FIRST) != (serial not in streams):
            raise OggError(f"page {number}: stream {serial} begins twice or not at all")
        s = streams.setdefault(serial, Stream())
        if s.closed or sequence != s.pages or bool(flags & CONTINUED) != bool(s.rest):
            raise OggError(f"page {number}: out of order in stream {serial}")
        done, size = 0, 0
        for value in table:
            size += value
            if value < 255:
                s.packets.append(b"".join([*s.rest, media[body : body + size]]) if s.rest else media[body : body + size])
                s.rest = []
                body += size
                size = 0
                done += 1
        if size:
            s.rest.append(media[body:end])
        if done:
            s.granules += [-1] * (done - 1) + [granule]  # a page's granule is that of its last whole packet
        s.pages += 1
        s.closed = bool(flags & LAST)
        at, number = end, number + 1
    for serial, s in streams.items():
        if s.rest or not s.closed:
            raise OggError(f"stream {serial}: not ended")
    return streams


def times(stream: Stream, rate: int = RATE, samples: int = PACKET) -> list[float]:
    """End times of packets in seconds, from the granule positions of pages and the packets' fixed length between them."""
    ends, following = [], None
    for g in reversed(stream.granules):
        following = g if g >= 0 else (following or 0) - samples
        ends.append(following / rate)
    return ends[::-1]


def payload_of(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode()
    return raw + b"\xff" * (max(1, -(-len(raw) // PACKET)) * PACKET - len(raw)), len(raw)


def encode(text: str | None) -> bytes:
    payload, n = payload_of(text)
    serial = zlib.crc32(payload) & ~1
    packets = [payload[i : i + PACKET] for i in range(0, len(payload), PACKET)]
    samples = write_stream(serial, packets, [PACKET * (i + 1) for i in range(len(packets))])
    extra = write_stream(serial | 1, [n.to_bytes(8, "little")], [0])
    return b"".join([samples[0], *extra, *samples[1:]])


def describe(media: bytes) -> dict:
    """What the media hold, from the stored bytes alone."""
    streams = read(media)
    if len(streams) != 2 or not all(s.packets for s in streams.values()):
        raise OggError("two logical streams are expected")
    samples, extra = (streams[s] for s in sorted(streams))
    payload = b"".join(samples.packets)
    n = int.from_bytes(extra.packets[0], "little")
    ends = times(samples)
    loud = sum(payload[:n]) / max(n, 1)
    feature = f"streams={len(streams)};pages={sum(s.pages for s in streams.values())};packets={len(samples.packets)};seconds={ends[-1]:.6f};mean={loud:.4f}"
    return {"n_bytes": n, "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-32:]), "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(), "feature": feature}


_FIELDS = {"n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string(), "error": pa.string()}
_SCHEMA = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"


def _described(media: bytes | None) -> dict:
    """describe(), or what is wrong with the media."""
    if media is None:
        return {}
    try:
        return describe(media)
    except OggError as e:
        return {"media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(), "error": str(e)}


def to_media(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and media (binary): every whole text as an Ogg bitstream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([encode(t.as_py()) for t in some.column(1)], pa.binary())], names=["doc_id", "media"])

    return mapped(docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")), run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """doc_id, describe() of stored media and error. media: (doc_id, media)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                found = [_described(m.as_py()) for m in some.column(1)]
                yield pa.RecordBatch.from_arrays([some.column(0), *(pa.array([f.get(k) for f in found], t) for k, t in _FIELDS.items())], names=["doc_id", *_FIELDS])

    return mapped(media.select("doc_id", "media"), run, f"doc_id {media.schema['doc_id'].dataType.simpleString()}, {_SCHEMA}")


def op5_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(to_media(documents(spark, sf_dir))).drop("error")
