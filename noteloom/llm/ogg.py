"""Media columns: Ogg multiplexing and demultiplexing.

``encode`` stores text as unsigned 8-bit samples in an Ogg physical stream with two logical streams: the samples
and an index that carries length and CRC-32 of every sample packet.  ``demultiplex`` verifies page checksums,
rebuilds packets from lacing values, separates logical streams by serial number and derives timestamps from
granule positions.  Null text counts as empty, empty text becomes one block of 192 spaces.  Damaged pages are dropped
and counted and a packet that loses a page is counted as lost; where the samples can't be rebuilt whole the payload's
columns are null, and so they are for null, empty and foreign media.  Repeated rows are coded each, equally; an empty
table gives no rows; other columns, whatever their names, play no part.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 192
RATE = 8000
PACKET = 10 * BLOCK
SEGMENTS_PER_PAGE = 34
CONTINUED, FIRST, LAST = 1, 2, 4
PCM_ID, INDEX_ID = b"PCM     ", b"PCMINDEX"

_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def page_checksum(page: bytes) -> int:
    """CRC with polynomial 0x04C11DB7, no reflection, start and final value zero: the reflected CRC of reversed bits."""
    reflected = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(reflected.to_bytes(4, "little").translate(_REVERSED), "big")


@dataclass
class _Writer:
    serial: int
    sequence: int = 0
    pages: list[bytes] = field(default_factory=list)

    def _page(self, flags: int, granule: int, lacing: bytes, body: bytes) -> None:
        head = struct.pack("<4sBBqIII", b"OggS", 0, flags, granule, self.serial, self.sequence, 0)
        page = head + bytes([len(lacing)]) + lacing + body
        self.pages.append(page[:22] + struct.pack("<I", page_checksum(page)) + page[26:])
        self.sequence += 1

    def write(self, packets: list[tuple[bytes, int]], flags: int) -> None:
        """Packets with the granule position at their end; ``flags`` may hold FIRST and LAST."""
        segments: list[tuple[bytes, int]] = []
        for packet, granule in packets:
            cuts = range(0, len(packet) + 1, 255)
            segments += [(packet[i : i + 255], granule if i + 255 > len(packet) else -1) for i in cuts]
        continued = 0
        for at in range(0, len(segments), SEGMENTS_PER_PAGE):
            part = segments[at : at + SEGMENTS_PER_PAGE]
            granule = max((g for _, g in part), default=-1)
            final = at + SEGMENTS_PER_PAGE >= len(segments)
            kind = continued | (flags & FIRST if at == 0 else 0) | (flags & LAST if final else 0)
            self._page(kind, granule, bytes(len(s) for s, _ in part), b"".join(s for s, _ in part))
            continued = CONTINUED if len(part[-1][0]) == 255 else 0


def pad(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes filled with spaces to a positive multiple of 192, and the length without filling."""
    raw = (text or "").encode()
    return raw + b" " * (max(BLOCK, -(-len(raw) // BLOCK) * BLOCK) - len(raw)), len(raw)


def write_ogg(payload: bytes, length: int) -> bytes:
    serial = zlib.crc32(payload)
    samples, index = _Writer(serial), _Writer(serial ^ 0x5A5A5A5A)
    header = struct.pack("<8sHHIIBBHI", PCM_ID, 0, 0, 1, RATE, 8, 1, PACKET, 0)
    samples.write([(header, 0)], FIRST)
    index.write([(struct.pack("<8sQQ", INDEX_ID, length, len(payload)), 0)], FIRST)
    packets = [payload[i : i + PACKET] for i in range(0, len(payload), PACKET)]
    ends = np.minimum((np.arange(len(packets)) + 1) * PACKET, len(payload)).tolist()
    samples.write(list(zip(packets, ends, strict=True)), LAST)
    index.write([(struct.pack("<II", len(p), zlib.crc32(p)), e) for p, e in zip(packets, ends, strict=True)], LAST)
    mixed, a, b = [samples.pages[0], index.pages[0]], samples.pages[1:], index.pages[1:]
    step = -(-len(a) // len(b))
    for i, page in enumerate(b):
        mixed += a[i * step : (i + 1) * step] + [page]
    return b"".join(mixed)


@dataclass
class LogicalStream:
    serial: int
    pages: int = 0
    damaged: int = 0
    lost: int = 0
    packets: list[bytes] = field(default_factory=list)
    #: granule position where a page states one for the last packet that ends on it, else -1
    granules: list[int] = field(default_factory=list)
    first: bool = False
    last: bool = False
    _open: list[bytes] | None = None
    _next: int = -1


def read_ogg(media: bytes) -> dict[int, LogicalStream]:
    """Logical streams by serial number.  Bytes that are no page are skipped to the next capture pattern."""
    streams: dict[int, LogicalStream] = {}
    at, end = media.find(b"OggS"), len(media)
    while 0 <= at <= end - 27:
        _, version, kind, granule, serial, sequence, crc, count = struct.unpack_from("<4sBBqIIIB", media, at)
        lacing = media[at + 27 : at + 27 + count]
        start = at + 27 + count
        stop = start + sum(lacing)
        page = media[at:stop]
        whole = version == 0 and len(lacing) == count and stop <= end
        if not whole or page_checksum(page[:22] + b"\0\0\0\0" + page[26:]) != crc:
            if serial in streams:
                streams[serial].damaged += 1
            elif streams:
                next(iter(streams.values())).damaged += 1
            at = media.find(b"OggS", at + 4)
            continue
        s = streams.setdefault(serial, LogicalStream(serial))
        s.first |= bool(kind & FIRST)
        s.last |= bool(kind & LAST)
        s.pages += 1
        gap = s._next not in (-1, sequence)
        s._next = sequence + 1
        if s._open is not None and (gap or not kind & CONTINUED):
            s.lost += 1
            s._open = None
        orphan = bool(kind & CONTINUED) and s._open is None
        parts, place, ended = s._open or [], start, 0
        for size in lacing:
            parts.append(media[place : place + size])
            place += size
            if size < 255:
                if orphan:
                    s.lost, orphan = s.lost + 1, False
                else:
                    s.packets.append(b"".join(parts))
                    s.granules.append(-1)
                    ended += 1
                parts = []
        s._open = parts if parts and not orphan else None
        if ended:
            s.granules[-1] = granule
        at = media.find(b"OggS", stop)
    for s in streams.values():
        s.lost += s._open is not None
    return streams


def timestamps(stream: LogicalStream, rate: int, first: int) -> list[float]:
    """Seconds at the end of each packet from ``first`` on; packets without a granule count back from the next one."""
    out: list[float] = []
    after, size_after = None, 0
    for packet, granule in zip(reversed(stream.packets[first:]), reversed(stream.granules[first:]), strict=True):
        after = granule if granule >= 0 else None if after is None else after - size_after
        size_after = len(packet)
        out.append(float("nan") if after is None else after / rate)
    return out[::-1]


def encode(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, media: one Ogg physical stream for each row, equal for equal texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "media": [write_ogg(*pad(t)) for t in b["text"]]})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col(text).alias("text")).mapInPandas(run, f"doc_id {kind}, media binary")


def _payload(streams: dict[int, LogicalStream]) -> tuple[bytes, int, LogicalStream] | None:
    """Samples, length without filling and the sample stream; None unless every packet agrees with the index."""
    kind = lambda name: next((s for s in streams.values() if s.packets and s.packets[0][:8] == name), None)
    samples, index = kind(PCM_ID), kind(INDEX_ID)
    if samples is None or index is None or len(index.packets[0]) < 24:
        return None
    length, size = struct.unpack_from("<QQ", index.packets[0], 8)
    payload = b"".join(samples.packets[1:])
    if len(payload) != size or [struct.pack("<II", len(p), zlib.crc32(p)) for p in samples.packets[1:]] != index.packets[1:]:
        return None
    return payload, length, samples


def decode(media: DataFrame) -> DataFrame:
    """Reads ``media`` back: payload digests, stored form's digests and features of samples and container, one row for each row."""
    digest = hashlib.sha256

    def row(doc_id, stored: bytes | None) -> tuple:
        if stored is None:
            return (doc_id, *[None] * 8, 0, 0)
        streams = read_ogg(stored)
        faults = sum(s.damaged for s in streams.values()), sum(s.lost for s in streams.values())
        found = _payload(streams)
        if found is None:
            return (doc_id, *[None] * 4, len(stored), digest(stored).hexdigest(), None, None, *faults)
        payload, length, samples = found
        x = np.frombuffer(payload, np.uint8)
        times = timestamps(samples, RATE, 1)
        centred = x.astype(np.int64) - 128
        crossings = int(np.count_nonzero((centred[1:] >= 0) != (centred[:-1] >= 0)))
        rms = float(np.sqrt(np.mean(centred * centred)))
        feature = (
            f"streams={len(streams)};pages={sum(s.pages for s in streams.values())};packets={len(samples.packets) - 1};end={times[-1]:.6f};"
            f"mean={x.mean():.4f};rms={rms:.4f};crossings={crossings};distinct={np.count_nonzero(np.bincount(x))}"
        )
        return (doc_id, length, len(payload), digest(payload).hexdigest(), zlib.crc32(payload[-16:]), len(stored), digest(stored).hexdigest(), feature, times[-1], *faults)

    kind = media.schema["doc_id"].dataType.simpleString()
    fields = (
        f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
        "media_sha256 string, feature string, end_s double, damaged_pages long, lost_packets long"
    )
    names = [x.split()[0] for x in fields.split(", ")]
    whole = {x.split()[0]: "Int64" for x in fields.split(", ")[1:] if x.endswith("long")}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [row(i, None if m is None else bytes(m)) for i, m in zip(b["doc_id"], b["media"], strict=True)]
            yield pd.DataFrame(rows, columns=names).astype(whole | {"end_s": "float64"})

    return media.select("doc_id", "media").mapInPandas(run, fields)


def demultiplex(media: DataFrame) -> DataFrame:
    """One row for each packet: doc_id, serial, packet number, bytes, end granule (null inside a page), page counts."""
    kind = media.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, serial long, packet int, data binary, granule long, pages int, damaged int, lost int"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [
                (i, s.serial, k, p, g if g >= 0 else None, s.pages, s.damaged, s.lost)
                for i, m in zip(b["doc_id"], b["media"], strict=True)
                if m is not None
                for s in read_ogg(bytes(m)).values()
                for k, (p, g) in enumerate(zip(s.packets, s.granules, strict=True))
            ]
            out = pd.DataFrame(rows, columns=["doc_id", "serial", "packet", "data", "granule", "pages", "damaged", "lost"])
            yield out.astype({"granule": "Int64"})

    return media.select("doc_id", "media").mapInPandas(run, schema)


def media_digest(docs: DataFrame) -> DataFrame:
    return decode(encode(docs))
