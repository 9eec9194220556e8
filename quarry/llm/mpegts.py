"""Media columns: payloads stored as MPEG transport streams, and read back from them.

A payload becomes one elementary stream of private data in one program, carried in PES packets
of UNIT bytes. Every PES packet has a presentation time stamp; the first of every RANDOM_ACCESS
carries the random access flag and a clock reference, and stands behind a program association
table and a program map table (ISO/IEC 13818-1, with their CRC-32), so a reader may cut in at any
packet and read from the next entry point on. Packets are 188 bytes, continuity counters run per
PID, short packets are filled by adaptation fields.

Reading goes by the tables found in the stream: the association table names the map table's
PID, the map table names the elementary PIDs, sections are put together from the packets that
they run over and checked by CRC, the continuity counters of every PID are checked, and PES
packets are put together again and checked against their lengths. Timestamps are kept with their
random access flags and byte offsets.

Defined cases: null and empty texts are payloads of blanks; payloads of any length are whole;
a damaged stream gives the errors counted and the bytes that can be read; equal texts give equal
streams; an empty table gives an empty table; result columns replace input columns of the name.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quarry.llm.common import mapped

PACKET, SYNC = 188, 0x47
PAT_PID, PMT_PID, DATA_PID = 0, 0x100, 0x101
PROGRAM, STREAM_TYPE, STREAM_ID = 1, 0x06, 0xBD
#: Payload bytes of a PES packet, ticks of 90 kHz between them, PES packets between entry points.
UNIT, TICKS, RANDOM_ACCESS = 16_384, 3_003, 12
#: Texts are filled with blanks to a multiple of this.
ROUND = 192


def padded(text: str | None) -> bytes:
    data = (text or "").encode()
    return data + b" " * (-len(data) % ROUND or (ROUND if not data else 0))


def _crc_table() -> list[int]:
    out = []
    for byte in range(256):
        value = byte << 24
        for _ in range(8):
            value = (value << 1 ^ 0x04C11DB7 if value >> 31 else value << 1) & 0xFFFFFFFF
        out.append(value)
    return out


CRC_TABLE = _crc_table()


def section_crc(data: bytes) -> int:
    """The CRC-32 of program tables: high bit first, all ones at the start, no final change."""
    value = 0xFFFFFFFF
    for byte in data:
        value = (value << 8 & 0xFFFFFFFF) ^ CRC_TABLE[value >> 24 ^ byte]
    return value


def section(table: int, ident: int, body: bytes) -> bytes:
    head = struct.pack(">BHHBBB", table, 0xB000 | len(body) + 9, ident, 0xC1, 0, 0) + body
    return head + struct.pack(">I", section_crc(head))


def section_packets(pid: int, data: bytes, counter: int = 0) -> list[bytes]:
    """The packets of a section, numbered from ``counter`` on; the last is filled up."""
    body = b"\0" + data
    room = PACKET - 4
    return [(struct.pack(">BHB", SYNC, (0 if at else 0x4000) | pid, 0x10 | counter + at // room & 15) + body[at : at + room]).ljust(PACKET, b"\xff") for at in range(0, len(body), room)]


ASSOCIATION = section(0, 1, struct.pack(">HH", PROGRAM, 0xE000 | PMT_PID))
MAP = section(2, PROGRAM, struct.pack(">HH", 0xE000 | DATA_PID, 0xF000) + struct.pack(">BHH", STREAM_TYPE, 0xE000 | DATA_PID, 0xF000))
#: The tables' packets for each value of their counters, which run alike as either table takes one packet.
TABLES = [b"".join(section_packets(PAT_PID, ASSOCIATION, i) + section_packets(PMT_PID, MAP, i)) for i in range(16)]


def stamp(ticks: int) -> bytes:
    """A presentation time stamp's five bytes, marker bits included."""
    return bytes((0x21 | ticks >> 29 & 0x0E, ticks >> 22 & 0xFF, ticks >> 14 & 0xFE | 1, ticks >> 7 & 0xFF, ticks << 1 & 0xFE | 1))


def mux(payload: bytes) -> bytes:
    """The transport stream of a payload."""
    out, counter = [], 0
    for number, start in enumerate(range(0, len(payload), UNIT)):
        unit = payload[start : start + UNIT]
        ticks = number * TICKS & 0x1FFFFFFFF
        pes = b"\0\0\1" + struct.pack(">BHBBB", STREAM_ID, len(unit) + 8, 0x84, 0x80, 5) + stamp(ticks) + unit
        entry = number % RANDOM_ACCESS == 0
        if entry:
            out.append(TABLES[number // RANDOM_ACCESS & 15])
        field_ = bytes((7, 0x50)) + struct.pack(">IH", ticks >> 1, (ticks & 1) << 15 | 0x7E00) if entry else b""
        at = 0
        while at < len(pes):
            room = PACKET - 4 - len(field_)
            part = pes[at : at + room]
            if len(part) < room:
                short = room - len(part)
                if not field_:
                    field_ = b"\0" if short == 1 else bytes((short - 1, 0)) + b"\xff" * (short - 2)
                else:
                    field_ = bytes((field_[0] + short,)) + field_[1:] + b"\xff" * short
            out.append(struct.pack(">BHB", SYNC, (0x4000 if at == 0 else 0) | DATA_PID, (0x30 if field_ else 0x10) | counter))
            out.append(field_)
            out.append(part)
            counter = counter + 1 & 15
            at += len(part)
            field_ = b""
    return b"".join(out)


@dataclass
class Stream:
    """What a transport stream holds."""

    programs: dict[int, int] = field(default_factory=dict)  # program to the PID of its map table
    kinds: dict[int, int] = field(default_factory=dict)  # elementary PID to its stream type
    data: dict[int, bytes] = field(default_factory=dict)  # elementary PID to its bytes
    times: list[tuple[int, int, bool, int]] = field(default_factory=list)  # PID, stamp, random access, byte offset
    packets: int = 0
    errors: int = 0


def demux(stream: bytes) -> Stream:
    """Read a transport stream by its own tables. A payload-less or repeated packet keeps its counter."""
    got = Stream()
    counters: dict[int, int] = {}
    open_: dict[int, list[bytes]] = {}
    entry: dict[int, bool] = {}
    parts: dict[int, list[bytes]] = {}
    sizes: dict[int, int] = {}
    repeated: dict[int, bytes] = {}
    sections: dict[int, bytes] = {}  # table PID to what its packets have brought of a section

    def tables(pid: int, body: bytes, begins: bool) -> None:
        """Put sections together; a packet in which one begins says where, and ends the one before it."""
        if begins:
            if pid in sections:
                got.errors += bool(read(pid, sections.pop(pid) + body[1 : 1 + body[0]]))
            begun = body[1 + body[0] :]
            got.errors += begun[:1] in (b"", b"\xff")  # the pointer shows filling where a section should begin
            sections[pid] = read(pid, begun)
        elif pid in sections:
            sections[pid] = read(pid, sections[pid] + body)
        if not sections.get(pid, b"x"):
            del sections[pid]

    def read(pid: int, data: bytes) -> bytes:
        """Take the whole sections off the data; what is left of one that goes on."""
        while data and data[0] != 0xFF:
            size = 3 + (struct.unpack_from(">H", data, 1)[0] & 0x0FFF) if len(data) >= 3 else PACKET
            if len(data) < size:
                return data
            _table(got, pid, data[:size])
            data = data[size:]
        return b""

    def close(pid: int) -> None:
        pes = b"".join(open_.pop(pid, ()))
        if not pes:
            return
        if len(pes) < 9 or pes[:3] != b"\0\0\1":
            got.errors += 1
            return
        size, skip = struct.unpack_from(">H", pes, 4)[0], 9 + pes[8]
        if size and size != len(pes) - 6:
            got.errors += 1
        if pes[7] & 0x80 and len(pes) >= 14:
            b = pes[9:14]
            ticks = (b[0] >> 1 & 7) << 30 | b[1] << 22 | b[2] >> 1 << 15 | b[3] << 7 | b[4] >> 1
            got.times.append((pid, ticks, entry.pop(pid, False), sizes.get(pid, 0)))
        body = pes[skip : 6 + size] if size else pes[skip:]
        parts.setdefault(pid, []).append(body)
        sizes[pid] = sizes.get(pid, 0) + len(body)

    for at in range(0, len(stream) - PACKET + 1, PACKET):
        got.packets += 1
        sync, head, flags = struct.unpack_from(">BHB", stream, at)
        if sync != SYNC or head & 0x8000:
            got.errors += 1
            continue
        pid, counter, begins = head & 0x1FFF, flags & 15, head & 0x4000
        start, jump = at + 4, False
        if flags & 0x20:
            size = stream[start]
            if size:
                jump = bool(stream[start + 1] & 0x80)
                if stream[start + 1] & 0x40:
                    entry[pid] = True
            start += size + 1
        if not flags & 0x10 or pid == 0x1FFF:
            continue
        before = counters.get(pid)
        counters[pid] = counter
        if before is not None and not jump and counter != (before + 1 & 15):
            if counter == before and repeated.get(pid) == stream[at : at + PACKET]:
                continue
            got.errors += 1
            sections.pop(pid, None)
        repeated[pid] = stream[at : at + PACKET]
        body = stream[start : at + PACKET]
        if pid == PAT_PID or pid in got.programs.values():
            if body:
                tables(pid, body, bool(begins))
        elif pid in got.kinds:
            if begins:
                flagged = entry.pop(pid, False) if flags & 0x20 else False
                close(pid)
                if flagged:
                    entry[pid] = True
                open_[pid] = []
            if pid in open_:
                open_[pid].append(body)
    for pid in list(open_):
        close(pid)
    got.errors += bool(len(stream) % PACKET) + len(sections)
    got.data = {pid: b"".join(parts.get(pid, ())) for pid in got.kinds}
    return got


def _table(got: Stream, pid: int, whole: bytes) -> None:
    """Note what a whole section says."""
    if len(whole) < 12 or section_crc(whole):
        got.errors += 1
        return
    table, size = whole[0], len(whole) - 3
    if pid == PAT_PID and table == 0:
        for at in range(8, size - 1, 4):
            program, where = struct.unpack_from(">HH", whole, at)
            if program:
                got.programs[program] = where & 0x1FFF
    elif table == 2:
        at = 12 + (struct.unpack_from(">H", whole, 10)[0] & 0x0FFF)
        while at + 5 <= size - 1:
            kind, where, more = struct.unpack_from(">BHH", whole, at)
            got.kinds[where & 0x1FFF] = kind
            at += 5 + (more & 0x0FFF)


def with_media(docs: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """``docs`` with the text's padded bytes as a transport stream, and n_bytes before padding."""
    at = docs.columns.index(text)

    def row(batch: pa.RecordBatch) -> list[pa.Array]:
        texts = batch.column(at).to_pylist()
        return [pa.array([len((x or "").encode()) for x in texts], pa.int64()), pa.array([mux(padded(x)) for x in texts], pa.binary())]

    return mapped(docs, row, [T.StructField("n_bytes", T.LongType()), T.StructField(media, T.BinaryType())])


def with_features(docs: DataFrame, media: str = "media") -> DataFrame:
    """``docs`` with what the stored stream says: payload digests, packets, errors and entry points."""
    at = docs.columns.index(media)
    times = T.ArrayType(T.StructType([T.StructField("pts", T.LongType()), T.StructField("random_access", T.BooleanType()), T.StructField("offset", T.LongType())]))

    def row(batch: pa.RecordBatch) -> list[pa.Array]:
        got = [demux(batch.column(at)[i].as_py() or b"") for i in range(batch.num_rows)]
        data = [b"".join(s.data[p] for p in sorted(s.data)) for s in got]
        kind = pa.list_(pa.struct([("pts", pa.int64()), ("random_access", pa.bool_()), ("offset", pa.int64())]))
        return [
            pa.array([len(d) for d in data], pa.int64()),
            pa.array([hashlib.sha256(d).hexdigest() for d in data], pa.string()),
            pa.array([zlib.crc32(d[-16:]) for d in data], pa.int64()),
            pa.array([s.packets for s in got], pa.int64()),
            pa.array([s.errors for s in got], pa.int64()),
            pa.array([len(s.kinds) for s in got], pa.int64()),
            pa.array([[{"pts": t, "random_access": r, "offset": o} for _, t, r, o in s.times] for s in got], kind),
        ]

    new = [("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("packets", T.LongType()), ("errors", T.LongType()), ("streams", T.LongType()), ("times", times)]
    return mapped(docs, row, [T.StructField(*f) for f in new])
