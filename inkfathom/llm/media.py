"""Payloads in MPEG transport streams: 188-byte packets with program tables, timestamps and random-access points.

`mux` stores bytes as one private elementary stream: access units of `UNIT` bytes, each a PES packet with a presentation
timestamp; every `EVERY`-th unit begins a random-access point with a program clock reference. `demux` parses the program
association and map tables and checks their CRC, checks sync bytes and continuity counters, reassembles the elementary
packets and returns payload, timestamps and random-access points; it accepts any stream with these tables.

Null and empty texts become 64 zero bytes; equal payloads give equal streams; a text of any length is one stream, built
row by row, so memory is bounded by the largest text. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_and_text, slices

PACKET, SYNC = 188, 0x47
PMT_PID, ES_PID, PROGRAM, STREAM_TYPE, STREAM_ID = 0x1000, 0x100, 1, 0x06, 0xBD
UNIT, EVERY, TICKS, FIRST_PTS = 16_384, 8, 3_600, 90_000
MEDIA_SCHEMA = "doc_id long, n_bytes long, media binary"
READ_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pts array<long>, random_access array<struct<pts:long,packet:long,offset:long>>"


class StreamError(ValueError):
    """The bytes are no transport stream that can be read without loss."""


@lru_cache(1)
def _crc_table() -> list[int]:
    table = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1
        table.append(c & 0xFFFFFFFF)
    return table


@lru_cache(64)
def crc32_mpeg(data: bytes) -> int:
    c, t = 0xFFFFFFFF, _crc_table()
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ t[(c >> 24) ^ b]
    return c


def _section(table_id: int, number: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\x00\x00" + body
    return head + crc32_mpeg(head).to_bytes(4, "big")


@lru_cache(1)
def _tables() -> bytes:
    """The packets of both tables."""
    pat = _section(0, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
    pmt = _section(2, PROGRAM, (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([STREAM_TYPE]) + (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00")
    return b"".join((bytes([SYNC, 0x40 | pid >> 8, pid & 0xFF, 0x10, 0]) + s).ljust(PACKET, b"\xff") for pid, s in ((0, pat), (PMT_PID, pmt)))


def _stamp(pts: int) -> bytes:
    return bytes([0x21 | (pts >> 30 & 7) << 1, pts >> 22 & 0xFF, 1 | (pts >> 15 & 0x7F) << 1, pts >> 7 & 0xFF, 1 | (pts & 0x7F) << 1])


def mux(payload: bytes) -> bytes:
    """payload as a transport stream."""
    out, counter = [_tables()], 0
    for k, at in enumerate(range(0, len(payload), UNIT)):
        pts, part = FIRST_PTS + k * TICKS, payload[at : at + UNIT]
        data = b"\x00\x00\x01" + bytes([STREAM_ID]) + (len(part) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(pts) + part
        extra = b""
        if k % EVERY == 0:
            base = pts & ((1 << 33) - 1)
            extra = b"\x50" + (base << 15 | 0x7E00).to_bytes(6, "big")  # random access, and a clock reference
        room = 184 - (len(extra) + 1 if extra else 0)
        n = 1 + max(0, -(-(len(data) - room) // 184))
        packets = np.full((n, PACKET), 0xFF, np.uint8)
        packets[:, 0], packets[:, 1], packets[:, 2] = SYNC, ES_PID >> 8, ES_PID & 0xFF
        packets[0, 1] |= 0x40
        packets[:, 3] = 0x10 | (counter + np.arange(n)) & 15
        counter += n
        fill = room + 184 * (n - 1) - len(data)  # stuffing, in the last packet
        raw = np.frombuffer(data, np.uint8)
        if n > 1:
            first = room
            packets[0, PACKET - room :] = raw[:room]
            if n > 2:
                packets[1:-1, 4:] = raw[first : first + 184 * (n - 2)].reshape(-1, 184)
        tail = raw[len(data) - ((room if n == 1 else 184) - fill) :]
        packets[-1, PACKET - len(tail) :] = tail
        adapt = [(0, extra)] if extra else []
        if fill and n > 1 or fill and not extra:
            adapt.append((n - 1, b""))
        for row, field in adapt:
            space = PACKET - 4 - ((len(tail) if row == n - 1 else room))
            packets[row, 3] |= 0x20
            packets[row, 4] = space - 1
            if space > 1:
                packets[row, 5] = 0
                packets[row, 5 : 5 + len(field)] = np.frombuffer(field, np.uint8)
        out.append(packets.tobytes())
    return b"".join(out)


@dataclass
class Stream:
    programs: dict[int, dict[int, int]]  # program: {pid: stream type}
    packets: int
    payload: bytes
    pts: list[int]
    random_access: list[tuple[int, int, int]]  # timestamp, packet, offset in the payload
    discontinuities: int


def _read_section(packet: np.ndarray) -> bytes:
    raw = packet.tobytes()
    at = 4 if not raw[3] & 0x20 else 5 + raw[4]
    at += 1 + raw[at]  # pointer field
    size = 3 + (int.from_bytes(raw[at + 1 : at + 3], "big") & 0xFFF)
    section = raw[at : at + size]
    if len(section) < size or crc32_mpeg(section[:-4]) != int.from_bytes(section[-4:], "big"):
        raise StreamError("a program table is damaged")
    return section


def demux(media: bytes) -> Stream:
    """What a stream holds; StreamError if sync bytes, tables, continuity or packet lengths are wrong."""
    if not media or len(media) % PACKET:
        raise StreamError("not a whole number of packets")
    p = np.frombuffer(media, np.uint8).reshape(-1, PACKET)
    if (p[:, 0] != SYNC).any() or (p[:, 1] & 0x80).any():
        raise StreamError("lost sync or a transport error")
    pid = (p[:, 1].astype(np.int32) & 0x1F) << 8 | p[:, 2]
    starts, adapted, loaded = (p[:, 1] & 0x40) > 0, (p[:, 3] & 0x20) > 0, (p[:, 3] & 0x10) > 0
    programs: dict[int, dict[int, int]] = {}
    for row in np.flatnonzero((pid == 0) & starts)[:1]:
        body = _read_section(p[row])[8:-4]
        for i in range(0, len(body), 4):
            if number := int.from_bytes(body[i : i + 2], "big"):
                rows = np.flatnonzero((pid == (int.from_bytes(body[i + 2 : i + 4], "big") & 0x1FFF)) & starts)
                if not len(rows):
                    raise StreamError("a program has no map")
                own = _read_section(p[rows[0]])
                at = 12 + (int.from_bytes(own[10:12], "big") & 0xFFF)
                streams = programs.setdefault(number, {})
                while at < len(own) - 4:
                    streams[int.from_bytes(own[at + 1 : at + 3], "big") & 0x1FFF] = own[at]
                    at += 5 + (int.from_bytes(own[at + 3 : at + 5], "big") & 0xFFF)
    wanted = sorted({x for s in programs.values() for x in s})
    if not wanted:
        raise StreamError("no elementary stream")
    discontinuities, parts, pts, points, done = 0, [], [], [], 0
    for x in wanted:
        rows = np.flatnonzero((pid == x) & loaded)
        counter = p[rows, 3].astype(np.int16) & 15
        discontinuities += int(((np.diff(counter) & 15) != 1).sum())
        own = p[rows]
        begin = 4 + np.where(adapted[rows], 1 + own[:, 4].astype(np.int32), 0)
        flags = np.where(adapted[rows] & (own[:, 4] > 0), own[:, 5], 0)
        data = own[np.arange(PACKET) >= begin[:, None]].tobytes()
        at = np.concatenate([[0], np.cumsum(PACKET - begin)])
        heads = np.flatnonzero(starts[rows])
        for h, end in zip(heads, [*heads[1:], len(rows)]):
            pes = data[at[h] : at[end]]
            size = int.from_bytes(pes[4:6], "big")
            if pes[:3] != b"\x00\x00\x01" or size and size + 6 != len(pes):
                raise StreamError("an elementary packet is damaged")
            skip = 9 + pes[8]
            if pes[7] & 0x80:
                s = pes[9:14]
                pts.append((s[0] >> 1 & 7) << 30 | s[1] << 22 | s[2] >> 1 << 15 | s[3] << 7 | s[4] >> 1)
                if flags[h] & 0x40:
                    points.append((pts[-1], int(rows[h]), done))
            parts.append(pes[skip:])
            done += len(parts[-1])
    if discontinuities:
        raise StreamError(f"{discontinuities} breaks in continuity counters")
    return Stream(programs, len(p), b"".join(parts), pts, points, discontinuities)


def padded(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % 64 or (0 if raw else 64))


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media (a transport stream of the padded UTF-8 text) of docs(doc_id, text)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            raws = [(t or "").encode() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(r) for r in raws], pa.int64()), pa.array([mux(padded(r)) for r in raws], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return id_and_text(docs).mapInArrow(write, MEDIA_SCHEMA)


def read(media: DataFrame) -> DataFrame:
    """Digests and features of stored streams (doc_id, n_bytes, media), from the bytes as read back."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "media"):
            rows = []
            for doc, n, raw in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media"))):
                s = demux(raw)
                feature = f"programs={len(s.programs)};types={','.join(sorted({str(t) for x in s.programs.values() for t in x.values()}))};packets={s.packets};units={len(s.pts)};first_pts={s.pts[0]};last_pts={s.pts[-1]};random_access={len(s.random_access)};discontinuities={s.discontinuities}"
                rows.append((doc, n, len(s.payload), hashlib.sha256(s.payload).hexdigest(), zlib.crc32(s.payload[-64:]), len(raw), hashlib.sha256(raw).hexdigest(), feature, s.pts, [dict(zip(("pts", "packet", "offset"), x)) for x in s.random_access]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    point = pa.struct([(x, pa.int64()) for x in ("pts", "packet", "offset")])
    types = [pa.int64()] * 3 + [pa.string()] + [pa.int64()] * 2 + [pa.string()] * 2 + [pa.list_(pa.int64()), pa.list_(point)]
    names = [x.split()[0] for x in READ_SCHEMA.replace("struct<pts:long,packet:long,offset:long>", "struct").split(", ")]
    return media.mapInArrow(parse, READ_SCHEMA)
