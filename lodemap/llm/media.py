"""Media columns: MPEG transport streams (ISO/IEC 13818-1) written and parsed per row.

``multiplex`` stores bytes as one private elementary stream of one program: program association and map tables
before every random-access point, one packetised elementary packet per access unit with its presentation time
stamp, program clock reference and random-access flag in the adaptation field, stuffing in the last packet of a
unit. ``demultiplex`` reads any transport stream: tables (checksums verified), continuity counters of each packet
identifier, reassembled elementary packets, time stamps, clock references and random-access points.

Nulls read as empty; an empty, cut or foreign stream gives empty tables and counts its damage, it never fails.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PACKET, SYNC = 188, 0x47
PAT_PID, PMT_PID, STREAM_PID = 0x0000, 0x0100, 0x0101
PROGRAM, PRIVATE_DATA, PRIVATE_STREAM = 1, 0x06, 0xBD
UNIT = 192
ACCESS_UNIT = 15 * UNIT  # bytes of payload of an elementary packet
TICKS = 3600  # of 90 kHz, from one access unit to the next
GOP = 8  # every so many access units there is a random-access point
#: Stream identifiers whose elementary packets have no optional header.
PLAIN_STREAMS = (0xBC, 0xBE, 0xBF, 0xF0, 0xF1, 0xF2, 0xF8, 0xFF)


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1
        out.append(c & 0xFFFFFFFF)
    return out


_CRC = _crc_table()


def section_crc(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ b]
    return c


def _section(table: int, ident: int, body: bytes) -> bytes:
    length = 5 + len(body) + 4
    head = bytes([table, 0xB0 | length >> 8, length & 255, ident >> 8, ident & 255, 0xC1, 0, 0]) + body
    return head + section_crc(head).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> np.ndarray:
    raw = bytes([SYNC, 0x40 | pid >> 8, pid & 255, 0x10, 0]) + section
    return np.frombuffer(raw.ljust(PACKET, b"\xff"), np.uint8)


_PAT = _table_packet(PAT_PID, _section(0x00, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big")))
_PMT = _table_packet(
    PMT_PID,
    _section(0x02, PROGRAM, (0xE000 | STREAM_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([PRIVATE_DATA]) + (0xE000 | STREAM_PID).to_bytes(2, "big") + b"\xf0\x00"),
)


def _stamp(ticks: int) -> bytes:
    t = ticks & ((1 << 33) - 1)
    return bytes([0x21 | (t >> 29) & 0x0E, (t >> 22) & 255, 0x01 | (t >> 14) & 0xFE, (t >> 7) & 255, 0x01 | (t << 1) & 0xFE])


def _clock(ticks: int) -> bytes:
    t = ticks & ((1 << 33) - 1)
    return bytes([(t >> 25) & 255, (t >> 17) & 255, (t >> 9) & 255, (t >> 1) & 255, (t & 1) << 7 | 0x7E, 0])


def multiplex(payload: bytes) -> bytes:
    """The transport stream that holds ``payload`` as one elementary stream."""
    parts: list[np.ndarray] = []
    counter = tables = 0
    for k, at in enumerate(range(0, len(payload), ACCESS_UNIT)):
        unit, ticks, point = payload[at : at + ACCESS_UNIT], k * TICKS, k % GOP == 0
        if point:
            for packet in (_PAT, _PMT):
                packet = packet.copy()
                packet[3] |= tables & 15
                parts.append(packet)
            tables += 1
        size = 8 + len(unit)
        pes = b"\x00\x00\x01" + bytes([PRIVATE_STREAM, size >> 8, size & 255, 0x84, 0x80, 5]) + _stamp(ticks) + unit
        field_ = b"\x07\x50" + _clock(ticks) if point else b""
        head = PACKET - 4 - len(field_)
        n = 1 + max(0, -(-(len(pes) - head) // (PACKET - 4)))
        rows = np.empty((n, PACKET), np.uint8)
        rows[:, 0], rows[:, 1], rows[:, 2] = SYNC, STREAM_PID >> 8, STREAM_PID & 255
        rows[0, 1] |= 0x40
        rows[:, 3] = 0x10 | (counter + np.arange(n)) & 15
        counter += n
        room = n * (PACKET - 4) - len(field_)
        stuffing = room - len(pes)
        flat = np.frombuffer(pes, np.uint8)
        if field_:
            rows[0, 3] |= 0x20
            rows[0, 4 : 4 + len(field_)] = np.frombuffer(field_, np.uint8)
        if n == 1:
            if stuffing:
                start = 4 + len(field_)
                if field_:
                    rows[0, 4] += stuffing
                    rows[0, start : start + stuffing] = 0xFF
                else:
                    rows[0, 3] |= 0x20
                    rows[0, 4] = stuffing - 1
                    rows[0, 5 : 4 + stuffing] = 0xFF
                    if stuffing > 1:
                        rows[0, 5] = 0
            rows[0, PACKET - len(pes) :] = flat
        else:
            rows[0, 4 + len(field_) :] = flat[:head]
            whole = flat[head : head + (n - 2) * (PACKET - 4)]
            rows[1:-1, 4:] = whole.reshape(n - 2, PACKET - 4)
            last = flat[head + len(whole) :]
            rows[-1, PACKET - len(last) :] = last
            if stuffing:
                rows[-1, 3] |= 0x20
                rows[-1, 4] = stuffing - 1
                rows[-1, 5 : 4 + stuffing] = 0xFF
                if stuffing > 1:
                    rows[-1, 5] = 0
        parts.append(rows.ravel())
    return b"".join(p.tobytes() for p in parts)


@dataclass
class Stream:
    """What a transport stream holds. ``units``: (pid, pts or -1, offset in the pid's bytes, length, random access, whole).

    A unit is whole if no packet of it is missing and it has the length that it says."""

    packets: int = 0
    damaged: int = 0
    gaps: int = 0
    bad_tables: int = 0
    programs: dict[int, int] = field(default_factory=dict)
    streams: dict[int, int] = field(default_factory=dict)
    units: list[tuple[int, int, int, int, bool, bool]] = field(default_factory=list)
    clocks: list[tuple[int, int]] = field(default_factory=list)
    data: dict[int, bytes] = field(default_factory=dict)


def _sections(rows: np.ndarray, start: np.ndarray, begins: np.ndarray) -> Iterator[bytes | None]:
    """The table sections that a pid's packets carry, however many packets each takes; None for a broken one."""
    held = b""

    def cut(final: bool) -> Iterator[bytes | None]:
        nonlocal held
        while len(held) >= 3 and held[0] != 0xFF:
            end = 3 + ((held[1] & 0x0F) << 8 | held[2])
            if end > len(held):
                break
            section, held = held[:end], held[end:]
            good = end >= 12 and section_crc(section[:-4]) == int.from_bytes(section[-4:], "big")
            yield section if good else None
        if final:
            if held and held[0] != 0xFF:
                yield None
            held = b""

    for row, s, begin in zip(rows, start.tolist(), begins.tolist(), strict=True):
        body = row[s:].tobytes()
        if begin:
            point = 1 + body[0] if body else 0
            if held:
                held += body[1:point]
            yield from cut(True)
            held = body[point:]
        elif held:
            held += body
        yield from cut(False)
    yield from cut(True)


def _aligned(stream: bytes) -> tuple[np.ndarray, int]:
    """The packets of a stream (rows), and how many stretches between them are no packets.

    Where the sync byte is missing, the next one that stands a packet's length before another, or before the end, counts.
    """
    data, n = np.frombuffer(stream, np.uint8), len(stream)
    rows = data[: n - n % PACKET].reshape(-1, PACKET)
    if n % PACKET == 0 and (rows[:, 0] == SYNC).all():
        return rows, 0
    sync = np.flatnonzero(data == SYNC)
    sync = sync[sync + PACKET <= n]
    after = np.minimum(sync + PACKET, n - 1) if n else sync
    sure = sync[(sync + PACKET == n) | (data[after] == SYNC)]
    kept, lost, at = [], 0, 0
    while at + PACKET <= n:
        if data[at] == SYNC:
            stop = at
            while stop + PACKET <= n and data[stop] == SYNC:
                stop += PACKET
            kept.append(data[at:stop].reshape(-1, PACKET))
            at = stop
            continue
        lost += 1
        k = int(np.searchsorted(sure, at))
        if k == len(sure):
            return (np.concatenate(kept) if kept else rows[:0]), lost
        at = int(sure[k])
    return (np.concatenate(kept) if kept else rows[:0]), lost + (at < n)


def demultiplex(stream: bytes) -> Stream:
    """Parse a transport stream: tables, continuity, elementary packets, time stamps, random-access points.

    Tables that are not yet in force are passed over; where packets are out of step, the next in step go on.
    """
    out = Stream()
    rows, lost = _aligned(stream)
    good = rows[:, 1] & 0x80 == 0
    out.packets, out.damaged = len(rows), int(len(rows) - good.sum()) + lost
    rows = rows[good]
    pids = (rows[:, 1].astype(np.int32) & 0x1F) << 8 | rows[:, 2]
    begins = rows[:, 1] & 0x40 > 0
    has_field, has_data = rows[:, 3] & 0x20 > 0, rows[:, 3] & 0x10 > 0
    start = np.where(has_field, 5 + rows[:, 4].astype(np.int32), 4)
    has_data &= start <= PACKET
    start = np.minimum(start, PACKET)
    flags = np.where(has_field & (rows[:, 4] > 0), rows[:, 5], 0)
    counters = rows[:, 3] & 15

    def tables(pid: int, kind: int) -> Iterator[bytes]:
        own = np.flatnonzero((pids == pid) & has_data)
        for s in _sections(rows[own], start[own], begins[own]):
            if s is None or s[0] != kind:
                out.bad_tables += 1
            elif s[5] & 1:
                yield s

    for s in tables(PAT_PID, 0):
        for at in range(8, len(s) - 7, 4):
            if number := s[at] << 8 | s[at + 1]:
                out.programs[number] = (s[at + 2] & 0x1F) << 8 | s[at + 3]
    for pmt in sorted(set(out.programs.values())):
        for s in tables(pmt, 2):
            at = 12 + ((s[10] & 0x0F) << 8 | s[11])
            while at + 5 <= len(s) - 4:
                out.streams[(s[at + 1] & 0x1F) << 8 | s[at + 2]] = s[at]
                at += 5 + ((s[at + 3] & 0x0F) << 8 | s[at + 4])

    for pid in np.unique(pids).tolist():
        if pid == 0x1FFF:
            continue
        own = np.flatnonzero((pids == pid) & has_data)
        missing = np.zeros(len(own), bool)
        if len(own) > 1:
            step = (counters[own[1:]].astype(np.int16) - counters[own[:-1]]) & 15
            jump = flags[own[1:]] & 0x80 > 0  # a signalled discontinuity is no gap
            repeat = (step == 0) & (rows[own[1:], 4:] == rows[own[:-1], 4:]).all(axis=1)
            missing[1:] = (step != 1) & ~repeat
            out.gaps += int((missing[1:] & ~jump).sum())
            if repeat.any():
                once = np.append(True, ~repeat)
                own, missing = own[once], missing[once]
        if pid in out.streams:
            _reassemble(out, pid, rows[own], start[own], begins[own], flags[own], missing)
    return out


def _reassemble(out: Stream, pid: int, rows: np.ndarray, start: np.ndarray, begins: np.ndarray, flags: np.ndarray, missing: np.ndarray) -> None:
    for i in np.flatnonzero(flags & 0x10):
        b = rows[i, 6:12].astype(np.int64)
        if rows[i, 4] >= 7:
            out.clocks.append((pid, int(b[0] << 25 | b[1] << 17 | b[2] << 9 | b[3] << 1 | b[4] >> 7)))
    sizes = PACKET - start
    ends = np.cumsum(sizes)
    body = rows[np.arange(PACKET) >= start[:, None]].tobytes()
    at = np.flatnonzero(begins)
    begin = (ends - sizes)[at].tolist()
    parts, total = [], 0
    for k, s in enumerate(begin):
        e = begin[k + 1] if k + 1 < len(begin) else len(body)
        if body[s : s + 3] != b"\x00\x00\x01" or e - s < 6:
            out.damaged += 1
            continue
        plain = body[s + 3] in PLAIN_STREAMS
        if not plain and e - s < 9:
            out.damaged += 1
            continue
        size = body[s + 4] << 8 | body[s + 5]
        end = min(e, s + 6 + size) if size else e
        whole = not (size and e < s + 6 + size) and not missing[at[k] + 1 : at[k + 1] if k + 1 < len(at) else len(missing)].any()
        if size and e < s + 6 + size:
            out.damaged += 1
        pts = -1
        if not plain and body[s + 7] & 0x80 and body[s + 8] >= 5:
            b = body[s + 9 : s + 14]
            pts = (b[0] >> 1 & 7) << 30 | b[1] << 22 | (b[2] >> 1) << 15 | b[3] << 7 | b[4] >> 1
        data = body[s + 6 if plain else s + 9 + body[s + 8] : end]
        out.units.append((pid, pts, total, len(data), bool(flags[at[k]] & 0x40), whole))
        parts.append(data)
        total += len(data)
    out.data[pid] = b"".join(parts)


def padded(text: bytes) -> bytes:
    """The bytes, filled with spaces up to a positive multiple of UNIT."""
    return text + b" " * (max(UNIT, -(-len(text) // UNIT) * UNIT) - len(text))


def feature(s: Stream) -> str:
    """One line on programs, streams, packets, damage, time stamps and random-access points."""
    stamps = [u[1] for u in s.units if u[1] >= 0]
    points = [f"{u[1]}@{u[2]}" for u in s.units if u[4]]
    return (
        f"programs={','.join(f'{k}:{v}' for k, v in sorted(s.programs.items()))};streams={','.join(f'{k}:{v}' for k, v in sorted(s.streams.items()))};"
        f"packets={s.packets};damaged={s.damaged};gaps={s.gaps};units={len(s.units)};pts={min(stamps, default=-1)}..{max(stamps, default=-1)};"
        f"clocks={len(s.clocks)};points={','.join(points)}"
    )


def store_media(df: DataFrame, column: str = "text", media: str = "media") -> DataFrame:
    """Add binary column ``media`` (in place of one called so): the transport stream of the padded UTF-8 bytes of ``column`` (null: empty)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column(part.num_columns - 1).to_pylist()
                made = pa.array([multiplex(padded(x or b"")) for x in texts], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], made], [*part.schema.names[:-1], media])

    kept = [f for f in df.schema.fields if f.name != media]
    wide = df.select(*[F.col(f"`{f.name}`") for f in kept], F.col(f"`{column}`").cast("binary").alias(media))
    return wide.mapInArrow(write, T.StructType([*kept, T.StructField(media, T.BinaryType())]))


def parse_media(df: DataFrame, key: str, media: str = "media") -> DataFrame:
    """Per row: ``key``, tables as maps, packet and damage counts, elementary units with time stamps and random access."""
    unit = "pid:int,pts:bigint,offset:bigint,length:bigint,random_access:boolean,whole:boolean"
    kind = dict(df.dtypes)[key]
    schema = f"`{key}` {kind}, packets bigint, damaged bigint, gaps bigint, programs map<int,int>, streams map<int,int>, units array<struct<{unit}>>"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split(":")[0] for x in unit.split(",")]
        types = pa.list_(pa.struct([("pid", pa.int32()), ("pts", pa.int64()), ("offset", pa.int64()), ("length", pa.int64()), ("random_access", pa.bool_()), ("whole", pa.bool_())]))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                got = [demultiplex(x or b"") for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        *(pa.array([getattr(s, n) for s in got], pa.int64()) for n in ("packets", "damaged", "gaps")),
                        *(pa.array([list(getattr(s, n).items()) for s in got], pa.map_(pa.int32(), pa.int32())) for n in ("programs", "streams")),
                        pa.array([[dict(zip(names, u, strict=True)) for u in s.units] for s in got], types),
                    ],
                    [key, "packets", "damaged", "gaps", "programs", "streams", "units"],
                )

    return df.select(key, F.col(f"`{media}`").cast("binary")).mapInArrow(read, schema)


def media_digests(df: DataFrame) -> DataFrame:
    """Contract rows of a frame with doc_id and text, by way of the stored stream: one row per input row.

    Null text is empty; repeated rows give repeated results; other columns are ignored.
    """
    schema = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, stored = batch.columns
            rows = []
            for media in stored:
                raw = media.as_py()
                s = demultiplex(raw)
                payload = b"".join(s.data[p] for p in sorted(s.data))
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(raw), hashlib.sha256(raw).hexdigest(), feature(s)))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([ids, sizes, *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], [x.split()[0] for x in schema.split(", ")])

    slim = df.select(F.col("doc_id").cast("bigint"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"), "text")
    stored = store_media(slim, "text").select("doc_id", "n_bytes", "media")
    return stored.mapInArrow(read, schema)
