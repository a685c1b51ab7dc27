"""MPEG transport streams as media columns: multiplexing, and parsing with all the checks a receiver makes.

A stream is 188-byte packets.  Packet id 0 carries the association table, which names
the program's map table, which names the elementary stream.  The stream's PES packets each
hold an access unit of 8-bit samples with a presentation time in 90 kHz ticks; units at which a
decoder may begin are marked as random-access points, carry a clock reference and follow fresh tables.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import stored

PACKET, SYNC = 188, 0x47
PAT_PID, PMT_PID, ES_PID = 0x0000, 0x0100, 0x0101
PRIVATE_PES, PRIVATE_STREAM_1 = 0x06, 0xBD
#: Samples of a unit's multiple, of an access unit, and a second; ticks of a second.
GRAIN, UNIT, RATE, TICKS = 192, 2880, 48_000, 90_000
#: Every so many access units one is a random-access point.
GROUP = 8
FIRST_PTS = TICKS


def padded(text: bytes) -> bytes:
    """The text with spaces up to a positive multiple of GRAIN."""
    return text.ljust(max(GRAIN, -(-len(text) // GRAIN) * GRAIN), b" ")


def crc_mpeg(data: bytes) -> int:
    """CRC-32 as the tables carry it: most significant bit first, no final inversion."""
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ (0x04C11DB7 if crc & 0x80000000 else 0)) & 0xFFFFFFFF
    return crc


def _section(table: int, extension: int, body: bytes) -> bytes:
    head = bytes([table]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + extension.to_bytes(2, "big") + b"\xc1\0\0"
    return head + body + crc_mpeg(head + body).to_bytes(4, "big")


_PAT = _section(0, 1, (1).to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
_PMT = _section(2, 1, (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\0" + bytes([PRIVATE_PES]) + (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\0")


def _head(pid: int, start: bool, control: int, counter: int) -> bytes:
    return bytes([SYNC, start << 6 | pid >> 8, pid & 255, control << 4 | counter & 15])


def _table_packet(pid: int, section: bytes, counter: int) -> bytes:
    return (_head(pid, True, 1, counter) + b"\0" + section).ljust(PACKET, b"\xff")


def _time(mark: int, ticks: int) -> bytes:
    """33 bits of ticks in five bytes with marker bits."""
    return bytes([mark << 4 | ticks >> 29 & 14 | 1, ticks >> 22 & 255, ticks >> 14 & 254 | 1, ticks >> 7 & 255, ticks << 1 & 254 | 1])


def _adaptation(flags: int, fields: bytes, length: int) -> bytes:
    """An adaptation field of `length` bytes, its length byte included."""
    return b"\0" if length == 1 else (bytes([length - 1, flags]) + fields).ljust(length, b"\xff")


def mux(payload: bytes) -> bytes:
    """The transport stream of a payload."""
    out, counter, tables = [], 0, 0
    for k, at in enumerate(range(0, len(payload), UNIT)):
        unit = payload[at : at + UNIT]
        pts = (FIRST_PTS + at * TICKS // RATE) & (1 << 33) - 1
        pes = b"\0\0\1" + bytes([PRIVATE_STREAM_1]) + (len(unit) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _time(2, pts) + unit
        fields, flags = b"", 0
        if k % GROUP == 0:
            out += [_table_packet(PAT_PID, _PAT, tables), _table_packet(PMT_PID, _PMT, tables)]
            tables += 1
            base = pts - TICKS // 10
            fields, flags = (base << 15 | 0x7E00).to_bytes(6, "big"), 0x50
        begin = 0
        while begin < len(pes):
            least = len(fields) + 2 if fields else 0
            room = PACKET - 4 - least
            take = min(room, len(pes) - begin)
            field_bytes = PACKET - 4 - take
            out.append(_head(ES_PID, begin == 0, 3 if field_bytes else 1, counter))
            if field_bytes:
                out.append(_adaptation(flags, fields, field_bytes))
            out.append(pes[begin : begin + take])
            begin, counter, fields, flags = begin + take, counter + 1, b"", 0
    return b"".join(out)


@dataclass
class Stream:
    """What a transport stream holds."""

    packets: int = 0
    programs: dict[int, int] = field(default_factory=dict)
    streams: dict[int, int] = field(default_factory=dict)
    table_errors: int = 0
    continuity_errors: int = 0
    damaged: int = 0
    payload: bytes = b""
    pts: list[int] = field(default_factory=list)
    access_points: list[tuple[int, int]] = field(default_factory=list)


def _read_section(payload: bytes, found: Stream) -> bytes | None:
    at = 1 + payload[0]
    length = 3 + (int.from_bytes(payload[at + 1 : at + 3], "big") & 0xFFF)
    section = payload[at : at + length]
    if len(section) < length or crc_mpeg(section) != 0:
        found.table_errors += 1
        return None
    return section


def demux(data: bytes) -> Stream:
    """Parse a transport stream: tables by their checksum, counters of each packet id, PES packets by their length."""
    found = Stream(packets=len(data) // PACKET)
    counters: dict[int, int] = {}
    seen: dict[bytes, bytes | None] = {}
    units: list[list[bytes]] = []
    marked: list[tuple[int, bool]] = []
    for index in range(found.packets):
        at = index * PACKET
        if data[at] != SYNC or data[at + 1] & 0x80:
            found.damaged += 1
            continue
        start, pid, control, counter = data[at + 1] & 0x40, (data[at + 1] & 31) << 8 | data[at + 2], data[at + 3] >> 4 & 3, data[at + 3] & 15
        body, end, random = at + 4, at + PACKET, False
        if control & 2:
            length = data[body]
            random = length > 0 and data[body + 1] & 0x40 > 0
            body += 1 + length
        if not control & 1:
            continue
        last = counters.get(pid)
        counters[pid] = counter
        if last is not None and counter != last + 1 & 15:
            if counter == last:
                continue  # a packet sent twice
            found.continuity_errors += 1
        if pid == PAT_PID or pid in found.programs.values():
            payload = data[body:end]
            if not start or payload in seen:
                continue
            section = seen[payload] = _read_section(payload, found)
            if section and pid == PAT_PID:
                entries = section[8:-4]
                found.programs |= {int.from_bytes(entries[i : i + 2], "big"): int.from_bytes(entries[i + 2 : i + 4], "big") & 0x1FFF for i in range(0, len(entries), 4)}
            elif section:
                i = 12 + (int.from_bytes(section[10:12], "big") & 0xFFF)
                while i < len(section) - 4:
                    found.streams[int.from_bytes(section[i + 1 : i + 3], "big") & 0x1FFF] = section[i]
                    i += 5 + (int.from_bytes(section[i + 3 : i + 5], "big") & 0xFFF)
        elif pid in found.streams:
            if start:
                units.append([])
                marked.append((index, random))
            if units:
                units[-1].append(data[body:end])
    whole = []
    for parts, (index, random) in zip(units, marked):
        pes = b"".join(parts)
        if pes[:3] != b"\0\0\1" or len(pes) != 6 + int.from_bytes(pes[4:6], "big"):
            found.damaged += 1
            continue
        if pes[7] & 0x80:
            t = pes[9:14]
            pts = (t[0] >> 1 & 7) << 30 | t[1] << 22 | t[2] >> 1 << 15 | t[3] << 7 | t[4] >> 1
            found.pts.append(pts)
            if random:
                found.access_points.append((index, pts))
        whole.append(pes[9 + pes[8] :])
    found.payload = b"".join(whole)
    return found


def describe(s: Stream) -> str:
    streams = ",".join(f"{pid}:{kind}" for pid, kind in sorted(s.streams.items()))
    points = ",".join(f"{i}@{t}" for i, t in s.access_points)
    return f"packets={s.packets};programs={len(s.programs)};streams={streams};units={len(s.pts)};pts={min(s.pts, default=-1)}..{max(s.pts, default=-1)};points={points};continuity={s.continuity_errors};tables={s.table_errors};damaged={s.damaged}"


def _mux(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), 256):
            part = batch.slice(at, 256)
            texts = [bytes(t.as_buffer()) if t.is_valid and len(t.as_buffer()) else b"" for t in part["text"]]
            yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(map(len, texts), pa.int64()), pa.array([mux(padded(t)) for t in texts], pa.binary())], ["doc_id", "n_bytes", "media"])


def media_column(documents: DataFrame, *, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, n_bytes, media): each text as a transport stream."""
    source = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return source.mapInArrow(_mux, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


PARSED = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, continuity_errors int, pts array<long>, access_points array<struct<packet: int, pts: long>>"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    point = pa.list_(pa.struct([("packet", pa.int32()), ("pts", pa.int64())]))
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.list_(pa.int64()), point]
    names = [c.split(" ")[0] for c in PARSED.split(", ")][: len(types)]
    for batch in batches:
        rows = []
        for media in batch["media"]:
            data = bytes(media.as_buffer()) if len(media.as_buffer()) else b""
            s = demux(data)
            points = [{"packet": i, "pts": t} for i, t in s.access_points]
            rows.append((len(s.payload), sha256(s.payload).hexdigest(), zlib.crc32(s.payload[-16:]), len(data), sha256(data).hexdigest(), describe(s), s.continuity_errors, s.pts, points))
        columns = list(zip(*rows)) if rows else [[]] * len(types)
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["n_bytes"], *(pa.array(c, t) for c, t in zip(columns, types))], ["doc_id", "n_bytes", *names])


def parsed(media: DataFrame) -> DataFrame:
    """The streams of media (doc_id, n_bytes, media) parsed: payload digests, continuity, timestamps, random-access points."""
    kind = media.schema["doc_id"].dataType.simpleString()
    return media.mapInArrow(_parse, f"doc_id {kind}, n_bytes long, {PARSED}")


def round_trip(documents: DataFrame, **names) -> DataFrame:
    """Store every text as a transport stream in the shared folder, read the streams back and parse them.

    A row per row of documents, repeated ones included; null texts are empty ones, which
    are one unit of spaces.  An empty table gives no rows; other columns are not read.
    """
    return parsed(stored(media_column(documents, **names), "media"))
