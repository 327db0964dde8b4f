"""Media columns: MPEG transport streams in a binary column, with their time stamps and random-access points.

A payload is stored as one elementary stream of private data (stream type 6): access units of UNIT bytes, read as 8-bit
samples at RATE a second, each in one packetized elementary stream (PES) packet with its presentation time stamp (PTS).
Program tables go before each access unit, whose first packet carries the random-access flag and a clock reference, so a
reader can start at any of them. The reader takes nothing from the writer: it parses the program association and map
tables with their checksums, checks each packet's continuity counter, reassembles the PES packets and returns time stamps,
byte offsets and random-access points.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import col, spread, stored, texts

PACKET, SYNC = 188, 0x47
PMT_PID, ES_PID, PROGRAM = 0x1000, 0x0100, 1
STREAM_TYPE, STREAM_ID = 0x06, 0xBD
UNIT, RATE, CLOCK = 8192, 8000, 90_000
#: Payloads are padded with zero bytes to a positive multiple of this.
ALIGN = 64


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1
        out.append(c & 0xFFFFFFFF)
    return out


_CRC = _crc_table()


def crc32_mpeg(data: bytes) -> int:
    """The checksum of program tables: polynomial 04C11DB7, most significant bit first, start and no end inversion."""
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ b]
    return c


def _section(table_id: int, number: int, body: bytes) -> bytes:
    length = 5 + len(body) + 4
    head = bytes([table_id, 0xB0 | length >> 8, length & 0xFF, number >> 8, number & 0xFF, 0xC1, 0, 0]) + body
    return head + crc32_mpeg(head).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    """A packet without its continuity counter (byte 3 is 0x10)."""
    return bytes([SYNC, 0x40 | pid >> 8, pid & 0xFF, 0x10, 0]) + section + b"\xff" * (PACKET - 5 - len(section))


_PAT = _table_packet(0, _section(0, 1, bytes([PROGRAM >> 8, PROGRAM & 0xFF, 0xE0 | PMT_PID >> 8, PMT_PID & 0xFF])))
_PMT = _table_packet(PMT_PID, _section(2, PROGRAM, bytes([0xE0 | ES_PID >> 8, ES_PID & 0xFF, 0xF0, 0, STREAM_TYPE, 0xE0 | ES_PID >> 8, ES_PID & 0xFF, 0xF0, 0])))
_TABLES = [_PAT[:3] + bytes([0x10 | i]) + _PAT[4:] + _PMT[:3] + bytes([0x10 | i]) + _PMT[4:] for i in range(16)]
_START = [bytes([SYNC, 0x40 | ES_PID >> 8, ES_PID & 0xFF, 0x30 | i]) for i in range(16)]
_FULL = [bytes([SYNC, ES_PID >> 8, ES_PID & 0xFF, 0x10 | i]) for i in range(16)]
_STUFFED = [bytes([SYNC, ES_PID >> 8, ES_PID & 0xFF, 0x30 | i]) for i in range(16)]
_STUFF = [b"" if n == 0 else bytes([n - 1]) if n == 1 else bytes([n - 1, 0]) + b"\xff" * (n - 2) for n in range(PACKET)]


def _stamp(pts: int) -> bytes:
    return bytes([0x21 | pts >> 29 & 0x0E, pts >> 22 & 0xFF, 0x01 | pts >> 14 & 0xFE, pts >> 7 & 0xFF, 0x01 | pts << 1 & 0xFE])


def _clock(pts: int) -> bytes:
    """A clock reference: 33 bits of the base, 6 set bits, 9 bits of extension 0."""
    return bytes([pts >> 25 & 0xFF, pts >> 17 & 0xFF, pts >> 9 & 0xFF, pts >> 1 & 0xFF, (pts & 1) << 7 | 0x7E, 0])


def padded(data: bytes) -> bytes:
    return data + bytes(-len(data) % ALIGN if data else ALIGN)


def write_stream(payload: bytes) -> bytes:
    """A transport stream that holds payload; time stamps wrap at 33 bits, as the format has it."""
    out: list[bytes] = []
    counter = 0
    for no, at in enumerate(range(0, len(payload), UNIT)):
        unit = payload[at : at + UNIT]
        pts = at * CLOCK // RATE & 0x1FFFFFFFF
        pes = b"\x00\x00\x01" + bytes([STREAM_ID]) + (len(unit) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(pts) + unit
        out.append(_TABLES[no & 15])
        # The first packet's adaptation field: length, flags (random access, clock reference), clock, stuffing.
        room = PACKET - 4 - 8
        fill = max(0, room - len(pes))
        out += [_START[counter], bytes([7 + fill, 0x50]), _clock(pts), b"\xff" * fill, pes[:room]]
        counter = counter + 1 & 15
        for p in range(room, len(pes), PACKET - 4):
            part = pes[p : p + PACKET - 4]
            short = PACKET - 4 - len(part)
            out += [_STUFFED[counter], _STUFF[short], part] if short else [_FULL[counter], part]
            counter = counter + 1 & 15
    return b"".join(out)


@dataclass
class Stream:
    """What a reader finds; faults counts lost synchronisation, broken packets, checksums, continuity and lengths."""

    payload: bytes = b""  # of the first program's first stream, as are stamps, offsets and points
    program: int | None = None
    pmt_pid: int | None = None
    es_pid: int | None = None
    stream_type: int | None = None
    programs: int = 0
    streams: int = 0  # elementary streams of all programs
    packets: int = 0
    faults: int = 0
    stamps: list[int] = field(default_factory=list)  # of each unit
    offsets: list[int] = field(default_factory=list)  # of each unit in the payload
    points: list[int] = field(default_factory=list)  # units at which a reader can start
    others: dict[int, bytes] = field(default_factory=dict)  # payloads of other streams by their packet identifier

    def feature(self) -> str:
        return f"program={self.program};type={self.stream_type};packets={self.packets};units={len(self.stamps)};points={len(self.points)};last_pts={self.stamps[-1] if self.stamps else ''};faults={self.faults}"


class _Sections:
    """Assembles the sections of one packet identifier; a section may go over several packets, several may end in one."""

    def __init__(self) -> None:
        self.held: bytes | None = None

    def take(self, data: bytes, start: bool) -> list[bytes | None]:
        """The sections that data completes; None for a broken one."""
        out: list[bytes | None] = []
        if start:
            if not data or data[0] >= len(data):
                self.held = None
                return [None]
            if self.held is not None:
                self.held += data[1 : 1 + data[0]]
                out += self._whole()
                if self.held:
                    out.append(None)  # the next one starts before its end
            self.held = data[1 + data[0] :]
        elif self.held is not None:
            self.held += data
        return out + self._whole()

    def _whole(self) -> list[bytes | None]:
        out: list[bytes | None] = []
        while self.held is not None and len(self.held) >= 3:
            if self.held[0] == 0xFF:
                self.held = None  # stuffing to the packet's end
                break
            n = 3 + ((self.held[1] & 0x0F) << 8 | self.held[2])
            if len(self.held) < n:
                break
            section, self.held = self.held[:n], self.held[n:]
            out.append(section if n >= 12 and not crc32_mpeg(section) else None)
        return out


class _Units:
    """Reassembles the PES packets of one elementary stream."""

    def __init__(self, s: Stream) -> None:
        self.s, self.parts, self.bodies, self.size, self.point = s, [], [], 0, False
        self.stamps: list[int] = []
        self.offsets: list[int] = []
        self.points: list[int] = []

    def take(self, data: bytes, start: bool, random: bool) -> None:
        if start:
            self.close()
            self.point = random
        if start or self.parts:
            self.parts.append(data)

    def close(self) -> None:
        if not self.parts:
            return
        data = b"".join(self.parts)
        self.parts = []
        whole = len(data) >= 14 and data[:3] == b"\x00\x00\x01" and int.from_bytes(data[4:6], "big") in (0, len(data) - 6)
        if not whole or not data[7] & 0x80 or 9 + data[8] > len(data):
            self.s.faults += 1
            return
        p = data[9:14]
        if self.point:
            self.points.append(len(self.bodies))
        self.stamps.append((p[0] >> 1 & 7) << 30 | p[1] << 22 | p[2] >> 1 << 15 | p[3] << 7 | p[4] >> 1)
        self.offsets.append(self.size)
        self.bodies.append(data[9 + data[8] :])
        self.size += len(self.bodies[-1])


def read_stream(media: bytes) -> Stream:
    """Parses a transport stream, whatever its bytes; what is broken is counted in faults and left out.

    Where a packet doesn't start with the sync byte, reading goes on at the next sync byte that another one follows a packet later, or
    that is the last. A packet that repeats the one before it (same counter, same bytes) is taken once, as the format allows.
    """
    s = Stream()
    last: dict[int, tuple[int, bytes]] = {}
    sections: dict[int, _Sections] = {0: _Sections()}
    maps: dict[int, int] = {}  # identifier of a program map -> program
    units: dict[int, _Units] = {}
    seen: dict[bytes, bool] = {}
    at, end = 0, len(media)
    while at < end:
        if media[at] != SYNC or at + PACKET > end:
            s.faults += 1
            at += 1
            while 0 <= (at := media.find(SYNC, at)) and not (at + PACKET == end or at + PACKET < end and media[at + PACKET] == SYNC):
                at += 1
            if at < 0:
                break
            continue
        s.packets += 1
        b1, b3 = media[at + 1], media[at + 3]
        pid = (b1 & 0x1F) << 8 | media[at + 2]
        start, stop, random = at + 4, at + PACKET, False
        at = stop
        if b1 & 0x80:
            s.faults += 1  # marked as damaged by the transport
            continue
        if b3 & 0x20:
            n = media[start]
            if n > PACKET - 5:
                s.faults += 1
                continue
            random = n > 0 and bool(media[start + 1] & 0x40)
            start += 1 + n
        if not b3 & 0x10 or pid == 0x1FFF:
            continue
        counter, data = b3 & 0x0F, media[start:stop]
        if pid in last:
            if last[pid][0] == counter and last[pid][1] == data:
                last[pid] = (counter, b"")  # once only
                continue
            if last[pid][0] != counter - 1 & 15:
                s.faults += 1
        last[pid] = (counter, data)
        if pid in units:
            units[pid].take(data, bool(b1 & 0x40), random)
        elif pid == 0 or pid in maps:
            for body in sections[pid].take(data, bool(b1 & 0x40)):
                if body is None:
                    s.faults += 1
                elif body not in seen:
                    seen[body] = True
                    _table(s, body, pid, maps, sections, units)
    for u in units.values():
        u.close()
    s.programs, s.streams = len(set(maps.values())), len(units)
    for pid, u in units.items():
        if pid == s.es_pid:
            s.payload, s.stamps, s.offsets, s.points = b"".join(u.bodies), u.stamps, u.offsets, u.points
        else:
            s.others[pid] = b"".join(u.bodies)
    return s


def _table(s: Stream, section: bytes, pid: int, maps: dict[int, int], sections: dict[int, _Sections], units: dict[int, _Units]) -> None:
    """Takes a program association (identifier 0) or program map section."""
    body = section[8:-4]
    if pid == 0 and section[0] == 0:
        for k in range(0, len(body) - 3, 4):
            program, of = int.from_bytes(body[k : k + 2], "big"), (body[k + 2] & 0x1F) << 8 | body[k + 3]
            if program:  # 0 names the network's tables
                maps.setdefault(of, program)
                sections.setdefault(of, _Sections())
                if s.program is None:
                    s.program, s.pmt_pid = program, of
    elif pid in maps and section[0] == 2 and len(body) >= 4:
        k = 4 + ((body[2] & 0x0F) << 8 | body[3])
        while k + 5 <= len(body):
            kind, of = body[k], (body[k + 1] & 0x1F) << 8 | body[k + 2]
            units.setdefault(of, _Units(s))
            if s.es_pid is None and pid == s.pmt_pid:
                s.stream_type, s.es_pid = kind, of
            k += 5 + ((body[k + 3] & 0x0F) << 8 | body[k + 4])
    else:
        s.faults += 1


def to_media(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in column:
        yield pa.array((write_stream(padded(t)) for t in texts(batch)), pa.binary())


DIGEST = "struct<payload_bytes:long,payload_sha256:string,tail_crc32:long,media_bytes:long,media_sha256:string,feature:string,stamps:array<long>,points:array<struct<stamp:long,offset:long>>,faults:long>"
PARSED = "struct<payload:binary,program:int,stream_type:int,packets:long,faults:long,stamps:array<long>,offsets:array<long>,points:array<long>>"


def digests(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "stamps", "points", "faults"]
    point = pa.struct([("stamp", pa.int64()), ("offset", pa.int64())])
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(point), pa.int64()]
    for batch in column:
        rows = []
        for x in batch:
            media = x.as_py() or b""
            s = read_stream(media)
            rows.append((len(s.payload), hashlib.sha256(s.payload).hexdigest(), zlib.crc32(s.payload[-ALIGN:]), len(media), hashlib.sha256(media).hexdigest(), s.feature(), s.stamps, [{"stamp": s.stamps[p], "offset": s.offsets[p]} for p in s.points], s.faults))
        cols = list(zip(*rows)) or [()] * len(names)
        yield pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)


def parsed(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
    kind = pa.struct([("payload", pa.binary()), ("program", pa.int32()), ("stream_type", pa.int32()), ("packets", pa.int64()), ("faults", pa.int64()), *((c, pa.list_(pa.int64())) for c in ("stamps", "offsets", "points"))])
    for batch in column:
        yield pa.array(({c: getattr(s, c) for c in kind.names} for s in (read_stream(x.as_py() or b"") for x in batch)), kind)


def with_media(docs: DataFrame, text_col: str = "text", out: str = "media") -> DataFrame:
    """docs with the binary column `out`: the text's UTF-8 bytes (null: none), padded, as a transport stream. Columns stay; one
    that is already named `out` is replaced."""
    return docs.withColumn(out, arrow_udf(to_media, "binary")(col(text_col)))


def with_parsed(rows: DataFrame, media_col: str = "media", out: str = "stream") -> DataFrame:
    """rows with the struct `out`: payload, program, stream_type, packets, faults, stamps, offsets and points."""
    return rows.withColumn(out, arrow_udf(parsed, PARSED)(col(media_col)))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes every document's stream to a table in the shared folder, reads that and returns digests of what it holds.

    Besides: the time stamps of all units, the random-access points as (time stamp, byte offset in the payload), and faults. A null or
    empty text is 64 zero bytes; one of any length is one stream. Repeated rows each have a row, ids may be null, an empty table
    gives an empty result, other columns are ignored, whatever their names.
    """
    rows = spread(docs.select(col(id_col).alias("doc_id"), F.coalesce(F.octet_length(col(text_col)), F.lit(0)).cast("long").alias("n_bytes"), col(text_col).alias("text")))
    kept = stored(with_media(rows, "text").drop("text"), "media")
    return kept.withColumn("d", arrow_udf(digests, DIGEST)("media")).select("doc_id", "n_bytes", "d.*")
