"""Operator 10: MPEG transport streams as media columns."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from spindex.llm.common import bounded_batches, bytes_of

# Fixed values of the transport stream format.
PACKET, SYNC, NULL_PID, PAT_PID = 188, 0x47, 0x1FFF, 0
PRIVATE_TYPE, PRIVATE_STREAM = 0x06, 0xBD
CLOCK = 90_000
CRC_POLYNOMIAL = 0x04C11DB7
# Choices of this writer.
PMT_PID, DATA_PID, STREAM_ID, PROGRAM = 0x1000, 0x0100, 1, 1
#: Payload bytes in an access unit, units between random-access points, ticks between units.
UNIT, RANDOM_ACCESS_EVERY, TICKS = 16_384, 8, CLOCK // 25
#: Payload bytes are padded with zeros to a positive multiple of this.
ALIGN = 64


@functools.cache
def _crc_table() -> list[int]:
    table = []
    for byte in range(256):
        c = byte << 24
        for _ in range(8):
            c = (c << 1 ^ (CRC_POLYNOMIAL if c & 0x80000000 else 0)) & 0xFFFFFFFF
        table.append(c)
    return table


@functools.lru_cache(4096)
def section_crc(data: bytes) -> int:
    """CRC-32 of program tables: zero over a section with its own CRC."""
    c, table = 0xFFFFFFFF, _crc_table()
    for x in data:
        c = (c << 8 & 0xFFFFFFFF) ^ table[c >> 24 ^ x]
    return c


def _section(table_id: int, table_key: int, body: bytes) -> bytes:
    length = 5 + len(body) + 4
    head = bytes([table_id, 0xB0 | length >> 8, length & 255]) + table_key.to_bytes(2, "big") + bytes([0xC1, 0, 0])
    return head + body + section_crc(head + body).to_bytes(4, "big")


@functools.cache
def _tables() -> list[bytes]:
    """PAT and PMT packets without their continuity counters."""
    pat = _section(0, STREAM_ID, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
    pmt = _section(2, PROGRAM, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\0" + bytes([PRIVATE_TYPE]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\0")
    return [(bytes([SYNC, 0x40 | pid >> 8, pid & 255, 0x10, 0]) + s).ljust(PACKET, b"\xff") for pid, s in ((PAT_PID, pat), (PMT_PID, pmt))]


def _stamp(mark: int, t: int) -> bytes:
    return bytes([mark << 4 | t >> 29 & 0x0E | 1, t >> 22 & 255, t >> 14 & 0xFE | 1, t >> 7 & 255, t << 1 & 0xFE | 1])


def mux(payload: bytes) -> bytes:
    """A stream of one program that carries `payload` in elementary packets.

    Each access unit is one elementary packet with a timestamp; random-access
    points come with the program tables before them and a clock reference.
    """
    parts, counter, table_counter = [], 0, 0
    for number, at in enumerate(range(0, len(payload), UNIT)):
        data = payload[at : at + UNIT]
        time = number * TICKS
        entry = number % RANDOM_ACCESS_EVERY == 0
        if entry:
            for t in _tables():
                parts.append(t[:3] + bytes([0x10 | table_counter]) + t[4:])
            table_counter = table_counter + 1 & 15
        unit = b"\0\0\1" + bytes([PRIVATE_STREAM]) + (len(data) + 8).to_bytes(2, "big") + b"\x84\x80\5" + _stamp(2, time) + data
        field_ = bytes([7, 0x50]) + (time << 15 | 0x7E00).to_bytes(6, "big") if entry else b""
        first = PACKET - 4 - len(field_)
        n = 1 + max(0, -(-(len(unit) - first) // (PACKET - 4)))
        room = first + (n - 1) * (PACKET - 4)
        fill = room - len(unit)
        packets = np.empty((n, PACKET), np.uint8)
        packets[:, 0] = SYNC
        packets[:, 1] = DATA_PID >> 8
        packets[0, 1] |= 0x40
        packets[:, 2] = DATA_PID & 255
        packets[:, 3] = 0x10 | (np.arange(counter, counter + n) & 15)
        counter += n
        if n > 1:
            if field_:
                packets[0, 3] |= 0x20
            packets[0, 4:] = np.frombuffer(field_ + unit[:first], np.uint8)
            whole = n - 2
            packets[1:-1, 4:] = np.frombuffer(unit, np.uint8, whole * (PACKET - 4), first).reshape(whole, PACKET - 4)
            rest, head = unit[first + whole * (PACKET - 4) :], b""
        else:
            rest, head = unit, field_
        if fill:
            head = bytes([len(head) - 1 + fill]) + head[1:] + b"\xff" * fill if head else bytes([fill - 1]) + (b"\0" + b"\xff" * (fill - 2) if fill > 1 else b"")
        if head:
            packets[-1, 3] |= 0x20
        packets[-1, 4:] = np.frombuffer(head + rest, np.uint8)
        parts.append(packets.tobytes())
    return b"".join(parts)


#: Stream ids whose elementary packets have no header fields after their length; padding is one of them.
BARE_IDS, PADDING_ID = frozenset((0xBC, 0xBE, 0xBF, 0xF0, 0xF1, 0xF2, 0xF8, 0xFF)), 0xBE


@dataclass
class Stream:
    """An elementary stream and what serves to seek in it."""

    pid: int
    kind: int = 0
    program: int = 0
    payload: bytes = b""
    timestamps: list[int] = field(default_factory=list)  # presentation, of each elementary packet; -1 without
    decode_timestamps: list[int] = field(default_factory=list)  # the same where there is none of its own
    starts: list[int] = field(default_factory=list)  # payload byte at which each begins
    random_access: list[int] = field(default_factory=list)  # numbers of elementary packets
    broken_units: int = 0


@dataclass
class Demuxed:
    """What `demux` finds in a transport stream."""

    programs: dict[int, int] = field(default_factory=dict)  # number: PID of its table
    streams: dict[int, Stream] = field(default_factory=dict)  # by PID, the lowest first
    packets: int = 0
    clocks: list[int] = field(default_factory=list)
    sync_errors: int = 0
    counter_errors: int = 0
    crc_errors: int = 0

    @property
    def first(self) -> Stream:
        return next(iter(self.streams.values()), Stream(0))


def _stamp_of(t: bytes) -> int:
    return (t[0] >> 1 & 7) << 30 | t[1] << 22 | t[2] >> 1 << 15 | t[3] << 7 | t[4] >> 1


class _Packets:
    """The constant packets of a stream, as columns."""

    def __init__(self, stream: bytes, out: Demuxed):
        n = len(stream) // PACKET
        self.p = p = np.frombuffer(stream, np.uint8, n * PACKET).reshape(n, PACKET)
        self.pid = (p[:, 1].astype(np.int32) & 0x1F) << 8 | p[:, 2]
        self.begins = p[:, 1] & 0x40 > 0
        control = p[:, 3] >> 4 & 3
        bad = (p[:, 0] != SYNC) | (p[:, 1] & 0x80 > 0) | (p[:, 3] >> 6 > 0)
        out.sync_errors += int(bad.sum())
        field_size = np.where(control & 2, p[:, 4].astype(np.int32), -1)
        #: Flags of the adaptation field; where the payload begins.
        self.flags = np.where(field_size > 0, p[:, 5], 0)
        self.begin = 5 + field_size
        self.good = ~bad
        self.data = ~bad & (control & 1 > 0) & (self.begin < PACKET) & (self.pid != NULL_PID)
        #: Packets before which one of the same PID is missing.
        self.gap = np.zeros(n, bool)
        for x in np.unique(self.pid[self.data]):
            at = np.flatnonzero(self.data & (self.pid == x))
            count = p[at, 3] & 15
            same = np.r_[False, (count[1:] == count[:-1]) & (p[at[1:]] == p[at[:-1]]).all(1)]
            self.data[at[same]] = False
            at, count = at[~same], count[~same]
            told = self.flags[at[1:]] & 0x80 > 0  # a break that the stream itself announces
            self.gap[at[1:]] = (count[1:] != (count[:-1] + 1 & 15)) & ~told
        out.counter_errors += int(self.gap.sum())

    def of(self, pid: int) -> np.ndarray:
        return np.flatnonzero(self.data & (self.pid == pid))

    def body(self, at: np.ndarray) -> bytes:
        """The payloads of some packets, joined."""
        if not len(at):
            return b""
        whole = self.begin[at] == 4
        if whole.all():
            return (self.p[at[0] : at[-1] + 1, 4:] if at[-1] - at[0] + 1 == len(at) else self.p[at, 4:]).tobytes()
        if len(at) > 2 and whole[1:-1].all():
            return self.p[at[0], self.begin[at[0]] :].tobytes() + self.body(at[1:-1]) + self.p[at[-1], self.begin[at[-1]] :].tobytes()
        return b"".join(self.p[i, self.begin[i] :].tobytes() for i in at)


def sections(packets: _Packets, pid: int, out: Demuxed) -> Iterator[bytes]:
    """Current table sections of a PID with a right CRC, joined over packets; others are counted."""
    held, begun = b"", False

    def whole(data: bytes) -> tuple[list[bytes], bytes]:
        found = []
        while len(data) >= 3 and data[0] != 0xFF:
            size = 3 + ((data[1] & 15) << 8 | data[2])
            if len(data) < size:
                break
            found.append(data[:size])
            data = data[size:]
        return found, b"" if data[:1] == b"\xff" else data

    def right(found: list[bytes], rest: bytes) -> list[bytes]:
        kept = [s for s in found if len(s) >= 12 and not section_crc(s)]
        out.crc_errors += len(found) - len(kept) + (len(rest) > 0)
        return [s for s in kept if s[5] & 1]

    for i in packets.of(pid):
        if packets.gap[i] and held:
            out.crc_errors += 1
            held, begun = b"", False
        body = packets.p[i, packets.begin[i] :].tobytes()
        if packets.begins[i]:
            before, body = body[1 : 1 + body[0]], body[1 + body[0] :]
            if begun:
                yield from right(*whole(held + before))
            held, begun = b"", True
        if begun:
            found, held = whole(held + body)
            yield from right(found, b"")
    if held:
        out.crc_errors += 1


def _elementary(packets: _Packets, stream: Stream, out: Demuxed) -> None:
    """Reassemble the elementary packets of a stream.

    One of declared length is broken if it has another; one of length 0, as most
    video has, ends where the next begins, and is broken if a packet is missing
    in it or at its end.
    """
    at = packets.of(stream.pid)
    starts = np.flatnonzero(packets.begins[at])
    stream.broken_units += int(len(at) > 0 and (not len(starts) or starts[0] > 0))
    payload, size = [], 0
    for a, b in zip(starts, np.r_[starts[1:], len(at)]):
        first, unit = at[a], packets.body(at[a:b])
        if unit[:3] != b"\0\0\1" or len(unit) < 6:
            stream.broken_units += 1
            continue
        length, bare = int.from_bytes(unit[4:6], "big"), unit[3] in BARE_IDS
        lost = packets.gap[at[a + 1 : b]].any() or (not length and b < len(at) and packets.gap[at[b]])
        if lost or (length and len(unit) != 6 + length) or (not bare and (len(unit) < 9 or len(unit) < 9 + unit[8])):
            stream.broken_units += 1
            continue
        if unit[3] == PADDING_ID:
            continue
        pts = dts = -1
        if not bare:
            if unit[7] & 0x80 and unit[8] >= 5:
                pts = dts = _stamp_of(unit[9:14])
            if unit[7] & 0xC0 == 0xC0 and unit[8] >= 10:
                dts = _stamp_of(unit[14:19])
        if packets.flags[first] & 0x40:
            stream.random_access.append(len(stream.timestamps))
        stream.timestamps.append(pts)
        stream.decode_timestamps.append(dts)
        stream.starts.append(size)
        payload.append(unit[6:] if bare else unit[9 + unit[8] :])
        size += len(payload[-1])
    stream.payload = b"".join(payload)


def demux(stream: bytes) -> Demuxed:
    """Read a stream of constant packets and all elementary streams that its tables name.

    Program tables are parsed, over several packets too, and their CRC checked;
    continuity counters of each PID are checked but for announced breaks, an
    exact repeat of a packet is dropped; a packet that is flagged faulty, out of
    step or scrambled is dropped and counted.
    """
    out = Demuxed()
    out.packets = len(stream) // PACKET
    out.sync_errors = int(len(stream) % PACKET > 0)
    if not out.packets:
        return out
    packets = _Packets(stream, out)
    for s in sections(packets, PAT_PID, out):
        for i in range(8, len(s) - 4, 4):
            if number := int.from_bytes(s[i : i + 2], "big"):
                out.programs[number] = int.from_bytes(s[i + 2 : i + 4], "big") & 0x1FFF
    found: dict[int, Stream] = {}
    for table_pid in sorted(set(out.programs.values())):
        for s in sections(packets, table_pid, out):
            i = 12 + (int.from_bytes(s[10:12], "big") & 0xFFF)
            while i < len(s) - 4:
                pid = int.from_bytes(s[i + 1 : i + 3], "big") & 0x1FFF
                found[pid] = Stream(pid, s[i], int.from_bytes(s[3:5], "big"))
                i += 5 + (int.from_bytes(s[i + 3 : i + 5], "big") & 0xFFF)
    out.streams = dict(sorted(found.items()))
    for own in out.streams.values():
        _elementary(packets, own, out)
    for i in np.flatnonzero(packets.good & (packets.flags & 0x10 > 0)):
        out.clocks.append(int.from_bytes(packets.p[i, 6:12].tobytes(), "big") >> 15)
    return out


def padded(data: bytes, align: int = ALIGN) -> bytes:
    return data + b"\0" * (max(align, -(-len(data) // align) * align) - len(data))


def to_transport_stream(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text's UTF-8 bytes, padded, as a stream.

    Null text is empty, which gives 64 zero bytes; null ids stay null; repeated
    rows give a stream each; an empty table gives none.  Equal texts give equal
    streams.  Other columns are ignored.
    """
    bounded_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            texts = bytes_of(b, "text")
            media = [mux(padded(t)) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


_OTHER = "pid int, type int, program int, payload binary, timestamps array<long>, decode_timestamps array<long>, unit_starts array<long>, random_access array<long>, broken_units long"
READ = "payload binary, program int, table_pid int, stream_pid int, stream_type int, packets long, units long, timestamps array<long>, decode_timestamps array<long>, unit_starts array<long>, random_access array<long>, sync_errors long, counter_errors long, crc_errors long, broken_units long"
_LONGS = pa.list_(pa.int64())
_OTHER_TYPE = pa.list_(pa.struct([("pid", pa.int32()), ("type", pa.int32()), ("program", pa.int32()), ("payload", pa.binary()), ("timestamps", _LONGS), ("decode_timestamps", _LONGS), ("unit_starts", _LONGS), ("random_access", _LONGS), ("broken_units", pa.int64())]))


def read_transport_stream(media: DataFrame, media_col: str = "media") -> DataFrame:
    """`media` with the parts of each stream in further columns (see READ).

    `timestamps` and `decode_timestamps` (90 kHz), `unit_starts` (payload byte)
    and `random_access` (unit numbers) serve to seek in the payload.  These
    columns are of the elementary stream of the lowest PID; `other_streams` has
    the same of all others, by PID.  Null media is a stream without packets:
    empty payload, null tables.  New columns replace those of the same names.
    """
    bounded_batches(media.sparkSession)
    own = [*[c.split()[0] for c in READ.split(", ")], "other_streams"]
    kept = media.drop(*own)

    def run(batches):
        for b in batches:
            rows = []
            for x in bytes_of(b, media_col):
                d = demux(x)
                first, *others = d.streams.values() or [None]
                f = first or Stream(0)
                number, table = (f.program, d.programs.get(f.program)) if first else min(d.programs.items(), default=(None, None))
                rest = [dict(pid=s.pid, type=s.kind, program=s.program, payload=s.payload, timestamps=s.timestamps, decode_timestamps=s.decode_timestamps, unit_starts=s.starts, random_access=s.random_access, broken_units=s.broken_units) for s in others]
                rows.append((f.payload, number, table, first and f.pid, first and f.kind, d.packets, len(f.timestamps), f.timestamps, f.decode_timestamps, f.starts, f.random_access, d.sync_errors, d.counter_errors, d.crc_errors, f.broken_units, rest))
            types = [pa.binary(), *[pa.int32()] * 4, pa.int64(), pa.int64(), *[_LONGS] * 4, *[pa.int64()] * 4, _OTHER_TYPE]
            new = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], names=[*b.schema.names, *own])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema], READ, f"other_streams array<struct<{_OTHER.replace(' ', ':').replace(',:', ',')}>>"])
    return kept.mapInArrow(run, schema)
