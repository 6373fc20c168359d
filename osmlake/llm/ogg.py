"""Media columns in Ogg: pages with checksums, lacing, logical streams and granule positions.

A payload is stored as 8-bit mono samples in one logical stream; a second one
carries the unpadded length.  Reading verifies every page's checksum, takes
the logical streams apart by serial number, puts packets together from lacing
values over page ends, and derives timestamps from granule positions.
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

from osmlake.llm import textkernel as tk

#: Samples a second, bytes in a packet of samples, and the multiple that payloads are padded to.
RATE, PACKET, UNIT = 8000, 4096, 64

#: Fixed values of the Ogg page header.
MAGIC, HEADER, CONTINUED, FIRST, LAST = b"OggS", "<4sBBqIIIB", 1, 2, 4
NO_GRANULE = -1
SEGMENTS = 255

#: Serial numbers and identification packets of the two logical streams.
SAMPLES, LENGTH = 1, 2
SAMPLES_HEAD, LENGTH_HEAD = b"\x7fPCM8" + struct.pack("<I", RATE), b"\x7fSIZE"

_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def checksum(page: bytes) -> int:
    """CRC-32 of polynomial 0x04C11DB7, most significant bit first, from 0 and without a final inversion.

    That is zlib's CRC of the bit-reversed bytes, bit-reversed, without its
    two inversions.
    """
    mirrored = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(_REVERSED), "big")


class BadOgg(ValueError):
    """The bytes aren't a well-formed Ogg stream."""


def _page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = struct.pack(HEADER, MAGIC, 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    page = head + body
    return page[:22] + struct.pack("<I", checksum(page)) + page[26:]


def pages(serial: int, packets: list[tuple[bytes, int]]) -> list[bytes]:
    """The pages of one logical stream, from (packet, granule position at its end).

    The first packet has a page of its own.  A page's granule position is
    that of the last packet that ends on it, -1 if none does.
    """
    out: list[bytes] = []
    lacing, body, granule, carried = bytearray(), bytearray(), NO_GRANULE, False

    def flush(last: bool) -> None:
        nonlocal lacing, body, granule, carried
        flags = CONTINUED * carried | FIRST * (not out) | LAST * last
        out.append(_page(flags, granule, serial, len(out), bytes(lacing), bytes(body)))
        carried = bool(lacing) and lacing[-1] == 255
        lacing, body, granule = bytearray(), bytearray(), NO_GRANULE

    for k, (packet, at) in enumerate(packets):
        sizes = [255] * (len(packet) // 255) + [len(packet) % 255]
        done = 0
        for size in sizes:
            if len(lacing) == SEGMENTS:
                flush(False)
            lacing.append(size)
            body += packet[done : done + size]
            done += size
        granule = at
        if k == 0 or k == len(packets) - 1:
            flush(k == len(packets) - 1)
    return out


def store(payload: bytes, n_bytes: int) -> bytes:
    """An Ogg file of a payload and its unpadded length; equal inputs give equal bytes."""
    cut = [(payload[k : k + PACKET], min(k + PACKET, len(payload))) for k in range(0, len(payload), PACKET)]
    samples = pages(SAMPLES, [(SAMPLES_HEAD, 0), *cut])
    length = pages(LENGTH, [(LENGTH_HEAD, 0), (struct.pack("<Q", n_bytes), len(payload))])
    heads, rest = [samples[0], length[0]], samples[1:]
    middle = len(rest) // 2
    return b"".join(heads + rest[:middle] + length[1:] + rest[middle:])


@dataclass
class LogicalStream:
    """One stream of a file: its packets and, for each, the seconds at its end (None where no page says)."""

    packets: list[bytes] = field(default_factory=list)
    granules: list[int | None] = field(default_factory=list)
    pages: int = 0
    ended: bool = False
    partial: bytes | None = None


def demultiplex(data: bytes) -> dict[int, LogicalStream]:
    """The logical streams of a file by serial number; raises BadOgg on any fault."""
    streams: dict[int, LogicalStream] = {}
    at = 0
    while at < len(data):
        if len(data) - at < 27:
            raise BadOgg("a page header is cut off")
        magic, version, flags, granule, serial, number, crc, n = struct.unpack_from(HEADER, data, at)
        lacing = data[at + 27 : at + 27 + n]
        body_at = at + 27 + n
        end = body_at + sum(lacing)
        if magic != MAGIC or version or len(lacing) < n or end > len(data):
            raise BadOgg("not a whole page")
        if checksum(data[at : at + 22] + bytes(4) + data[at + 26 : end]) != crc:
            raise BadOgg("a page has a wrong checksum")
        if bool(flags & FIRST) != (serial not in streams):
            raise BadOgg("a stream doesn't begin once")
        s = streams.setdefault(serial, LogicalStream())
        if s.ended or number != s.pages or bool(flags & CONTINUED) != (s.partial is not None):
            raise BadOgg("a page is missing or out of order")
        held = [s.partial] if s.partial is not None else []
        ended, p = 0, body_at
        for size in lacing:
            held.append(data[p : p + size])
            p += size
            if size < 255:
                s.packets.append(b"".join(held))
                s.granules.append(None)
                held, ended = [], ended + 1
        if (granule == NO_GRANULE) != (not ended):
            raise BadOgg("a granule position doesn't go with the packets")
        if ended:
            s.granules[-1] = granule
        s.partial = b"".join(held) if n and lacing[-1] == 255 else None
        s.pages += 1
        s.ended = bool(flags & LAST)
        at = end
    if any(not s.ended or s.partial is not None for s in streams.values()):
        raise BadOgg("a stream has no end")
    return streams


def timestamps(stream: LogicalStream, rate: int = RATE) -> list[float]:
    """Seconds at the end of each packet of samples; where no page has one, counted from the one before."""
    out, granule = [], 0
    for packet, said in zip(stream.packets[1:], stream.granules[1:]):
        granule += len(packet)
        if said is not None:
            if said != granule:
                raise BadOgg("granule positions don't follow the samples")
        out.append(granule / rate)
    return out


def load(data: bytes) -> tuple[bytes, int, float]:
    """(payload, unpadded length, duration in seconds) of a stored file."""
    streams = demultiplex(data)
    if set(streams) != {SAMPLES, LENGTH}:
        raise BadOgg("the streams aren't samples and their length")
    samples, length = streams[SAMPLES], streams[LENGTH]
    if samples.packets[0] != SAMPLES_HEAD or length.packets[0] != LENGTH_HEAD:
        raise BadOgg("a stream has another kind")
    times = timestamps(samples)
    return b"".join(samples.packets[1:]), struct.unpack("<Q", length.packets[1])[0], times[-1]


def feature(payload: bytes, seconds: float) -> str:
    """Duration, mean, root mean square about it and share of sign changes, of 8-bit samples."""
    x = np.frombuffer(payload, np.uint8)
    mean = x.mean(dtype=np.float64)
    rms = x.astype(np.float32).std(dtype=np.float64)
    crossings = np.count_nonzero((x[1:] >= 128) != (x[:-1] >= 128))
    return f"{seconds:.6f}s mean={mean:.4f} rms={rms:.4f} peak={int(x.max())} cross={crossings}"


def encode_media(docs: DataFrame) -> DataFrame:
    """(doc_id, media): every text as UTF-8, padded with byte 0 to a positive multiple of 64, in Ogg.

    Null text counts as empty (64 bytes of padding).  Extra columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tk.small_batches(batches):
            media = [store(t.ljust(max(1, -(-len(t) // UNIT)) * UNIT, b"\0"), len(t)) for t in tk.as_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(media, pa.binary())], ["doc_id", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, media binary")


def decode_media(media: DataFrame) -> DataFrame:
    """Digests and features of stored media, all from what is read back; raises on a damaged file, null media give nulls."""
    fields = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string(), "seconds": pa.float64()}

    def row(data: bytes | None) -> tuple:
        if data is None:
            return (None,) * 8
        payload, n, seconds = load(data)
        return n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), feature(payload, seconds), seconds

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tk.small_batches(batches):
            columns = zip(*(row(x) for x in batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), kind) for c, kind in zip(columns, list(fields.values())[1:]))], list(fields))

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, seconds double"
    return media.select("doc_id", "media").mapInArrow(run, schema)
