"""Media columns as MPEG transport streams (ISO/IEC 13818-1).

``mux`` stores a payload losslessly: a program association and a program map table, then one
elementary stream of private data whose access units of ``UNIT`` bytes are packetised with
presentation times, clock references and random-access flags. ``demux`` reads such bytes (or any
stream of 188-byte packets) back: it parses the program tables (sections of any number of packets),
checks their CRCs and every PID's continuity counter (a packet sent twice counts once, an announced
discontinuity is none), reassembles the elementary packets and lists their timestamps with
the random-access points. Both work on whole packets as numpy arrays. ``media_table`` stores the
streams, ``unit_table`` the access units of each: where they begin, their timestamps, and whether
one can start there.

Defined cases: a null text is empty; every payload is padded with zeros to a positive multiple
of 64 bytes; texts of any length are stored whole; equal texts give equal bytes. Repeated
rows are handled one by one, further columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from skyloom.llm.common import table, utf8

PACKET, SYNC = 188, 0x47
PMT_PID, DATA_PID = 0x1000, 0x0100
PRIVATE_STREAM, PRIVATE_DATA = 0xBD, 0x06
#: Bytes of payload of an access unit, clock ticks between units, units between random-access points.
UNIT, TICKS, KEY_EVERY = 4096, 3600, 8
_PES_HEADER, _LEAD = 14, 8  # bytes of a PES header with a timestamp; of an adaptation field with a clock reference


def _crc_table() -> list[int]:
    out = []
    for n in range(256):
        c = n << 24
        for _ in range(8):
            c = (c << 1) ^ (0x04C11DB7 if c & 0x80000000 else 0)
        out.append(c & 0xFFFFFFFF)
    return out


_CRC = _crc_table()


def crc32_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ b]
    return c


def _section(pid: int, body: bytes) -> bytes:
    """One packet that holds a whole table section with its CRC."""
    section = body + struct.pack(">I", crc32_mpeg(body))
    head = bytes([SYNC, 0x40 | pid >> 8, pid & 255, 0x10, 0])
    return (head + section).ljust(PACKET, b"\xff")


_TABLES = _section(0, bytes([0x00, 0xB0, 13, 0, 1, 0xC1, 0, 0]) + struct.pack(">HH", 1, 0xE000 | PMT_PID)) + _section(
    PMT_PID,
    bytes([0x02, 0xB0, 18, 0, 1, 0xC1, 0, 0]) + struct.pack(">HH", 0xE000 | DATA_PID, 0xF000) + bytes([PRIVATE_DATA]) + struct.pack(">HH", 0xE000 | DATA_PID, 0xF000),
)


def _stamp(ticks: int) -> bytes:
    return bytes([0x21 | (ticks >> 29) & 0x0E, ticks >> 22 & 255, 0x01 | (ticks >> 14) & 0xFE, ticks >> 7 & 255, 0x01 | (ticks << 1) & 0xFE])


def _unstamp(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | b[2] >> 1 << 15 | b[3] << 7 | b[4] >> 1


def _unit_packets(unit: bytes, k: int, count: int) -> tuple[bytes, int]:
    """The packets of access unit ``k`` and the next continuity counter."""
    ticks = k * TICKS & (1 << 33) - 1
    pes = b"\x00\x00\x01" + bytes([PRIVATE_STREAM]) + struct.pack(">H", len(unit) + _PES_HEADER - 6) + b"\x84\x80\x05" + _stamp(ticks) + unit
    clock = struct.pack(">IH", ticks >> 1, (ticks & 1) << 15 | 0x7E00)
    lead = bytes([_LEAD - 1, 0x10 | (0x40 if k % KEY_EVERY == 0 else 0)]) + clock
    first = PACKET - 4 - _LEAD
    if len(pes) < first:  # a short unit: the adaptation field grows by stuffing
        stuffing = first - len(pes)
        lead = bytes([_LEAD - 1 + stuffing]) + lead[1:] + b"\xff" * stuffing
    rest = max(0, len(pes) - first)
    full, tail = divmod(rest, PACKET - 4)
    n = 1 + full + (tail > 0)
    out = np.empty((n, PACKET), np.uint8)
    out[:, 0] = SYNC
    out[:, 1] = DATA_PID >> 8
    out[0, 1] |= 0x40
    out[:, 2] = DATA_PID & 255
    out[:, 3] = 0x10 | (np.arange(count, count + n) & 15)
    out[0, 3] |= 0x20
    body = np.frombuffer(lead + pes[:first], np.uint8)
    out[0, 4:] = body
    out[1 : 1 + full, 4:] = np.frombuffer(pes, np.uint8)[first : first + full * (PACKET - 4)].reshape(full, PACKET - 4)
    if tail:
        gap = PACKET - 4 - tail
        out[-1, 3] |= 0x20
        out[-1, 4 : 4 + gap] = 0xFF
        out[-1, 4] = gap - 1
        if gap > 1:
            out[-1, 5] = 0
        out[-1, 4 + gap :] = np.frombuffer(pes, np.uint8)[-tail:]
    return out.tobytes(), count + n & 15


def mux(payload: bytes) -> bytes:
    """The transport stream that stores ``payload``."""
    out, count = [_TABLES], 0
    for k in range(0, max(1, -(-len(payload) // UNIT))):
        packets, count = _unit_packets(payload[k * UNIT : (k + 1) * UNIT], k, count)
        out.append(packets)
    return b"".join(out)


@dataclass
class Stream:
    """What a transport stream holds. ``units``: (pid, timestamp or None, random access, data) and
    ``offsets``: the byte at which each unit's first packet begins."""

    programs: dict[int, int] = field(default_factory=dict)
    streams: dict[int, int] = field(default_factory=dict)
    units: list[tuple[int, int | None, bool, bytes]] = field(default_factory=list)
    offsets: list[int] = field(default_factory=list)
    discontinuities: int = 0
    bad_sections: int = 0

    def payload(self) -> bytes:
        return b"".join(u[3] for u in self.units)


def _section_bytes(packets: np.ndarray, begin: np.ndarray) -> Iterator[bytes]:
    """The table sections of one PID, which may run over several packets or share one."""
    held: bytes | None = None
    for row, at in zip(packets, begin, strict=True):
        body = row[at:].tobytes()
        if row[1] & 0x40 and body:  # the pointer says where the next section begins
            rest, body = body[1 : 1 + body[0]], body[1 + body[0] :]
            if held is not None:
                yield held + rest
            held = body
        elif held is not None:
            held += body
        while held and held[0] != 0xFF and len(held) >= 3 and len(held) >= (size := 3 + ((held[1] & 0x0F) << 8 | held[2])):
            yield held[:size]
            held = held[size:]
        if held is not None and held[:1] in (b"", b"\xff"):  # stuffing up to the packet's end
            held = None
    if held is not None:
        yield held


def _sections(found: Stream, pid: int, packets: np.ndarray, begin: np.ndarray) -> None:
    for body in _section_bytes(packets, begin):
        size = 3 + ((body[1] & 0x0F) << 8 | body[2]) if len(body) > 3 else 0
        if size < 12 or size > len(body) or crc32_mpeg(body[: size - 4]) != struct.unpack(">I", body[size - 4 : size])[0]:
            found.bad_sections += 1
        elif body[0] == 0x00 and pid == 0:
            for k in range(8, size - 4, 4):
                number, at_pid = struct.unpack(">HH", body[k : k + 4])
                found.programs[number] = at_pid & 0x1FFF
        elif body[0] == 0x02:
            k = 12 + (struct.unpack(">H", body[10:12])[0] & 0x0FFF)
            while k + 5 <= size - 4:
                kind, es, info = struct.unpack(">BHH", body[k : k + 5])
                found.streams[es & 0x1FFF] = kind
                k += 5 + (info & 0x0FFF)


def _in_order(rows: np.ndarray, announced: np.ndarray) -> tuple[np.ndarray, int]:
    """Which packets of a PID count, and how often its counter breaks. A packet may come twice in a
    row; the counter may jump where a discontinuity is announced."""
    counter = (rows[:, 3] & 15).astype(np.int64)
    step = np.diff(counter) & 15
    again = np.zeros(len(rows), bool)
    for k in np.flatnonzero(step == 0) + 1:
        again[k] = not again[k - 1] and bool((rows[k, 4:] == rows[k - 1, 4:]).all())
    kept = np.flatnonzero(~again)
    broken = ((np.diff(counter[kept]) & 15) != 1) & ~announced[kept[1:]]
    return kept, int(broken.sum())


def _unit(pid: int, rows: np.ndarray, begin: np.ndarray, key: bool) -> tuple[int, int | None, bool, bytes]:
    if len(rows) > 2 and (begin[1:-1] == 4).all():
        data = rows[0, begin[0] :].tobytes() + rows[1:-1, 4:].tobytes() + rows[-1, begin[-1] :].tobytes()
    else:
        data = b"".join(r[a:].tobytes() for r, a in zip(rows, begin, strict=True))
    size = data[4] << 8 | data[5]
    stamp = _unstamp(data[9:14]) if data[7] & 0x80 else None
    return pid, stamp, key, data[9 + data[8] : 6 + size if size else None]


def demux(data: bytes) -> Stream:
    """Read a transport stream back; raises ValueError where it isn't one."""
    if len(data) % PACKET:
        raise ValueError("not a whole number of packets")
    rows = np.frombuffer(data, np.uint8).reshape(-1, PACKET)
    if not (rows[:, 0] == SYNC).all():
        raise ValueError("a packet lacks its sync byte")
    pid = (rows[:, 1].astype(np.int32) & 0x1F) << 8 | rows[:, 2]
    adapted, carries = rows[:, 3] & 0x20 > 0, rows[:, 3] & 0x10 > 0
    begin = np.where(adapted, 5 + rows[:, 4].astype(np.int32), 4)
    flags = np.where(adapted & (rows[:, 4] > 0), rows[:, 5], 0)
    key, announced = flags & 0x40 > 0, flags & 0x80 > 0
    found, packets = Stream(), {}
    for p in sorted(set(pid.tolist()) - {0x1FFF}):
        own = np.flatnonzero((pid == p) & carries)
        kept, broken = _in_order(rows[own], announced[own])
        found.discontinuities += broken
        packets[p] = own[kept]
        if p == 0 or p in found.programs.values():
            _sections(found, p, rows[packets[p]], begin[packets[p]])
    for p in found.streams:
        own = packets.get(p, np.zeros(0, np.int64))
        starts = np.flatnonzero(rows[own, 1] & 0x40)
        for a, b in zip(starts, [*starts[1:], len(own)][: len(starts)], strict=True):
            found.units.append(_unit(p, rows[own[a:b]], begin[own[a:b]], bool(key[own[a]])))
            found.offsets.append(int(own[a]) * PACKET)
    return found


def padded(text: bytes) -> bytes:
    """The text with zeros appended up to a positive multiple of 64 bytes."""
    return text.ljust(max(64, -(-len(text) // 64) * 64), b"\0")


def feature(found: Stream) -> str:
    """A short description: streams, units, last timestamp, random-access points, counter errors
    and a coarse histogram of the bytes read back."""
    data = np.frombuffer(found.payload(), np.uint8)
    bins = np.bincount(data >> 5, minlength=8)
    last = max((u[1] or 0 for u in found.units), default=0)
    keys = sum(u[2] for u in found.units)
    return f"streams={len(found.streams)};units={len(found.units)};pts={last};keys={keys};cc={found.discontinuities};crc={found.bad_sections};bytes=" + ",".join(map(str, bins))


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, at = utf8(batch.column(1))
        whole = data.tobytes()
        out: list[list] = [[] for _ in range(7)]
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            media = mux(padded(whole[a:b]))
            found = demux(media)
            back = found.payload()
            row = (b - a, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(found))
            for column, value in zip(out, row, strict=True):
                column.append(value)
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, k) for v, k in zip(out, kinds, strict=True))], names=names)


def media_columns(docs: DataFrame) -> DataFrame:
    """Store each document's text as a transport stream, read it back and describe it."""
    return docs.select("doc_id", "text").mapInArrow(_rows, SCHEMA)


def media_table(docs: DataFrame) -> DataFrame:
    """The stored streams themselves: doc_id and media."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = utf8(batch.column(1))
            whole = data.tobytes()
            media = [mux(padded(whole[a:b])) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(media, pa.binary())], names=["doc_id", "media"])

    return docs.select("doc_id", "text").mapInArrow(encode, "doc_id long, media binary")


UNITS = "doc_id long, unit int, pid int, pts long, random_access boolean, media_offset long, n_bytes int"


def unit_table(media: DataFrame) -> DataFrame:
    """The access units of stored streams (doc_id, media): number, PID, presentation time, random-access
    flag, the byte of the stream at which the unit begins, and its size. A null stream has none."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.int32()]
        for batch in batches:
            for doc_id, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = demux(data.as_buffer()) if data.is_valid else Stream()
                rows = [(doc_id, k, pid, stamp, key, at, len(unit)) for k, ((pid, stamp, key, unit), at) in enumerate(zip(found.units, found.offsets, strict=True))]
                columns = list(zip(*rows, strict=True)) or [()] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in UNITS.split(", ")])

    return media.select("doc_id", "media").mapInArrow(read, UNITS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(table(spark, sf_dir, "documents"))
