"""Ogg media columns: write and read physical streams held in binary columns.

Writing cuts a payload into packets of 8-bit samples on one logical stream, adds a
second logical stream of cues, and multiplexes the pages of both. Reading trusts
nothing: page checksums are verified, packets are reassembled from lacing values
(across pages where a packet is continued), logical streams are demultiplexed by
serial number, and timestamps follow from granule positions.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm.arrow import map_texts
from fathomline.shipping import ship

#: Fixed values of the container format (RFC 3533).
CAPTURE, CONTINUED, FIRST, LAST = b"OggS", 1, 2, 4
NO_PACKET_ENDS = 0xFFFFFFFFFFFFFFFF
HEADER = struct.Struct("<4sBBQIIIB")
#: Own parameters of the streams written here.
RATE, PACKET, PAGE_SEGMENTS, CUE_EVERY = 8000, 4000, 128, 16
SAMPLES, CUES = 1, 2
_MIRROR = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def checksum(page: bytes) -> int:
    """CRC-32 of a page (polynomial 04C11DB7, most significant bit first, no inversions).

    zlib's CRC has the same polynomial in mirrored form, so bytes are mirrored on
    the way in, the register on the way out, and its two inversions are undone.
    """
    mirrored = zlib.crc32(page.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(_MIRROR), "big")


def _page(kind: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    raw = bytearray(HEADER.pack(CAPTURE, 0, kind, granule, serial, number, 0, len(lacing)) + lacing + body)
    raw[22:26] = checksum(bytes(raw)).to_bytes(4, "little")
    return bytes(raw)


def write_stream(serial: int, packets: list[bytes], granules: list[int], segments: int = PAGE_SEGMENTS) -> list[tuple[int, bytes]]:
    """Pages of a logical stream, each with the granule position by which it sorts.

    The first packet has a page of its own. A packet may go on over many pages; a
    page on which none ends has the granule position that says so.
    """
    pages: list[tuple[int, bytes]] = []
    lacing, body, ends, carried, at = bytearray(), [], NO_PACKET_ENDS, False, 0

    def close(last: bool) -> None:
        nonlocal lacing, body, ends, at
        kind = CONTINUED * carried | FIRST * (not pages) | LAST * last
        pages.append((at, _page(kind, ends, serial, len(pages), bytes(lacing), b"".join(body))))
        lacing, body, ends = bytearray(), [], NO_PACKET_ENDS

    for n, (packet, granule) in enumerate(zip(packets, granules, strict=True)):
        values = [255] * (len(packet) // 255) + [len(packet) % 255]
        done = 0
        while values:
            if len(lacing) == segments:
                close(False)
                carried = done > 0
            take = min(segments - len(lacing), len(values))
            size = sum(values[:take])
            lacing += bytes(values[:take])
            body.append(packet[done : done + size])
            done += size
            del values[:take]
        ends = at = granule
        if n == 0 or n == len(packets) - 1:
            close(n == len(packets) - 1)
            carried = False
        elif len(lacing) == segments:
            close(False)
            carried = False
    return pages


def mux(payload: bytes) -> bytes:
    """A physical stream: samples (serial 1) and cues (serial 2), pages in time order."""
    head = b"Samples\0" + struct.pack("<IBQ", RATE, 8, len(payload))
    parts = [payload[i : i + PACKET] for i in range(0, len(payload), PACKET)]
    ends = [min((i + 1) * PACKET, len(payload)) for i in range(len(parts))]
    cues = [struct.pack("<QI", ends[i], zlib.crc32(parts[i])) for i in range(CUE_EVERY - 1, len(parts), CUE_EVERY)]
    samples = write_stream(SAMPLES, [head, *parts], [0, *ends])
    marks = write_stream(CUES, [b"Cues\0" + struct.pack("<I", len(cues)), *cues], [0, *[struct.unpack_from("<Q", c)[0] for c in cues]])
    first, rest = [samples[0][1], marks[0][1]], [*samples[1:], *marks[1:]]
    return b"".join([*first, *[page for _, page in sorted(rest, key=lambda x: x[0])]])


@dataclass
class Logical:
    """A logical stream as read: packets with the time at which each ends (None: unknown)."""

    packets: list[bytes] = field(default_factory=list)
    granules: list[int | None] = field(default_factory=list)
    pages: int = 0
    held: list[bytes] = field(default_factory=list)
    ended: bool = False
    lost: int = 0


class BrokenMedia(ValueError):
    """Bytes that are no valid physical stream."""


def demux(media: bytes, strict: bool = True) -> dict[int, Logical]:
    """Logical streams by serial number.

    ``strict``: any fault raises BrokenMedia. Otherwise bytes up to the next capture
    pattern are skipped, pages with a wrong checksum are left out, and packets with
    missing parts are dropped and counted in ``lost``.
    """
    streams: dict[int, Logical] = {}
    at = 0

    def fault(what: str) -> None:
        if strict:
            raise BrokenMedia(f"{what} at byte {at}")

    while at < len(media):
        if media[at : at + 4] != CAPTURE or len(media) < at + HEADER.size:
            fault("no page")
            at = media.find(CAPTURE, at + 1)
            if at < 0:
                break
            continue
        _, version, kind, granule, serial, number, crc, n = HEADER.unpack_from(media, at)
        lacing = media[at + HEADER.size : at + HEADER.size + n]
        end = at + HEADER.size + n + sum(lacing)
        page = media[at:end]
        if version or len(lacing) < n or end > len(media) or checksum(page[:22] + b"\0\0\0\0" + page[26:]) != crc:
            fault("checksum or length wrong")
            at = media.find(CAPTURE, at + 1)
            if at < 0:
                break
            continue
        stream = streams.setdefault(serial, Logical())
        if number != stream.pages or bool(kind & FIRST) != (number == 0):
            fault("page out of order")
            stream.lost += bool(stream.held)
            stream.held, stream.pages = [], number
        broken = bool(kind & CONTINUED) != bool(stream.held)
        if broken:
            fault("continuation wrong")
            stream.held = []
        stream.pages += 1
        stream.ended |= bool(kind & LAST)
        skip = broken and bool(kind & CONTINUED)
        ended_here = 0
        place = begin = HEADER.size + n
        for value in lacing:
            place += value
            if value < 255:
                if skip:
                    skip, stream.lost = False, stream.lost + 1
                else:
                    stream.packets.append(b"".join([*stream.held, page[begin:place]]))
                    stream.granules.append(None)
                    ended_here += 1
                stream.held, begin = [], place
        if place > begin and not skip:
            stream.held.append(page[begin:place])
        if ended_here:
            stream.granules[-1] = granule if granule != NO_PACKET_ENDS else None
        at = end
    if any(s.held or not s.ended for s in streams.values()):
        fault("stream without its end")
    return streams


def timestamps(granules: list[int | None], packet_units: list[int], rate: int) -> list[float]:
    """Seconds at which each packet ends: granule positions where a page has one, else
    counted back from the next one by the units of the packets between."""
    out, known = [0.0] * len(granules), None
    for i in range(len(granules) - 1, -1, -1):
        if granules[i] is not None:
            known = granules[i]
        elif known is not None:
            known -= packet_units[i + 1]
        out[i] = known / rate if known is not None else float("nan")
    return out


def read_samples(media: bytes) -> tuple[bytes, dict[str, object]]:
    """Payload and facts of a stream that ``mux`` wrote; cues are checked against it."""
    streams = demux(media)
    samples, cues = streams[SAMPLES], streams[CUES]
    rate, bits, size = struct.unpack_from("<IBQ", samples.packets[0], 8)
    payload = b"".join(samples.packets[1:])
    if not samples.packets[0].startswith(b"Samples\0") or bits != 8 or len(payload) != size:
        raise BrokenMedia("samples missing")
    times = timestamps(samples.granules, [0, *map(len, samples.packets[1:])], rate)
    ends = np.cumsum([len(p) for p in samples.packets])[0:] - len(samples.packets[0])
    if not np.allclose(times, ends / rate):
        raise BrokenMedia("granule positions disagree with the samples")
    part = {end: zlib.crc32(p) for end, p in zip(ends[1:].tolist(), samples.packets[1:], strict=True)}
    if any(part.get(end) != crc for end, crc in (struct.unpack("<QI", c) for c in cues.packets[1:])):
        raise BrokenMedia("a cue disagrees with its samples")
    facts = {"streams": len(streams), "pages": sum(s.pages for s in streams.values()), "packets": sum(len(s.packets) for s in streams.values()), "cues": len(cues.packets) - 1, "seconds": times[-1]}
    return payload, facts


def payload_of(text: str) -> bytes:
    """UTF-8 and zero bytes up to a positive multiple of 64."""
    raw = text.encode()
    return raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))


def text_to_ogg(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, media)``: each whole text as samples of a physical stream.

    Null and empty texts give 64 zero samples; very long ones many pages. One row
    per input row, also for repeated rows and null ids; an empty table gives an
    empty one; other columns are ignored.
    """
    return map_texts(docs, [doc_id], text, "n_bytes long, media binary", lambda texts: {"n_bytes": pa.array([len(t.encode()) for t in texts], pa.int64()), "media": pa.array([mux(payload_of(t)) for t in texts], pa.binary())})


def read_ogg(media: DataFrame, column: str = "media") -> DataFrame:
    """The frame with ``payload`` (bytes read back) and facts of each stream, without ``column``.

    Columns added: payload, streams, pages, packets, cues, seconds, mean, deviation,
    crossings (of the middle level by neighbouring samples). Null media give nulls;
    broken media raise BrokenMedia. All other columns are kept; those named like the
    added ones are replaced.
    """
    ship(media.sparkSession)
    added = ("payload", "streams", "pages", "packets", "cues", "seconds", "mean", "deviation", "crossings")
    rest = [c for c in media.columns if c != column and c not in added]
    source = media.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{column}`").alias("_media"))
    made = {"payload": pa.binary(), "streams": pa.int32(), "pages": pa.int32(), "packets": pa.int32(), "cues": pa.int32(), "seconds": pa.float64(), "mean": pa.float64(), "deviation": pa.float64(), "crossings": pa.int64()}
    kinds = "payload binary, streams int, pages int, packets int, cues int, seconds double, mean double, deviation double, crossings long"
    schema = ", ".join([*(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in rest), kinds])

    def one(raw: bytes | None) -> dict[str, object]:
        if raw is None:
            return dict.fromkeys(made)
        payload, facts = read_samples(raw)
        level = np.frombuffer(payload, np.uint8)
        above = level >= 128
        return {"payload": payload, **facts, "mean": float(level.mean()), "deviation": float(level.std()), "crossings": int((above[1:] != above[:-1]).sum())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                rows = [one(x.as_py()) for x in part.column(len(rest))]
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in range(len(rest))], *[pa.array([r[c] for r in rows], kind) for c, kind in made.items()]], names=[*rest, *made])

    return source.mapInArrow(run, schema)


