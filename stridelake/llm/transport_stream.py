"""MPEG transport streams in binary columns: multiplexing, demultiplexing, timestamps and random-access points.

A payload of 8-bit samples becomes one private elementary stream: access units of ``UNIT`` bytes, each
a PES packet with a presentation timestamp, cut into 188-byte transport packets. Program tables (PAT and
PMT) precede every ``TABLES_EVERY``-th unit, whose first packet is marked as a random-access point and
carries a clock reference. The reader trusts nothing: it follows PAT to PMT to the elementary stream,
checks the tables' CRCs, sync bytes and continuity counters, and reassembles the PES packets.

Defined results: a null text is empty; an empty text is one unit of 64 zero bytes; equal texts give equal
streams; an empty table gives no rows; further columns are never read. A damaged stream gives counts
of what is wrong and the samples that could be read, never an exception.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Workspace

PACKET, SYNC = 188, 0x47
UNIT = 4096
TABLES_EVERY = 8
SAMPLE_RATE = 8000
PMT_PID, STREAM_PID, PROGRAM, STREAM_TYPE = 0x1000, 0x0100, 1, 0x06
STREAM_ID = 0xBD  # private stream 1
TICKS = 90_000
STAMP_BITS = (1 << 33) - 1


def crc32_mpeg(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ (0x04C11DB7 if crc & 0x80000000 else 0)) & 0xFFFFFFFF
    return crc


@lru_cache(4096)
def section_ok(section: bytes) -> bool:
    return crc32_mpeg(section) == 0


def _section(table_id: int, extension: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + extension.to_bytes(2, "big") + b"\xc1\x00\x00"
    return head + body + crc32_mpeg(head + body).to_bytes(4, "big")


PAT = _section(0, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
PMT = _section(2, PROGRAM, (0xE000 | STREAM_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([STREAM_TYPE]) + (0xE000 | STREAM_PID).to_bytes(2, "big") + b"\xf0\x00")


def _heads(pid: int, flags: int, control: int) -> list[bytes]:
    """The 4-byte packet headers for the 16 values of the continuity counter."""
    return [bytes([SYNC, flags | pid >> 8, pid & 255, control << 4 | counter]) for counter in range(16)]


_TABLE_PACKETS = [
    (head_pat + b"\x00" + PAT).ljust(PACKET, b"\xff") + (head_pmt + b"\x00" + PMT).ljust(PACKET, b"\xff")
    for head_pat, head_pmt in zip(_heads(0, 0x40, 1), _heads(PMT_PID, 0x40, 1))
]
_FIRST = _heads(STREAM_PID, 0x40, 3)
_PLAIN = _heads(STREAM_PID, 0, 1)
_STUFFED = _heads(STREAM_PID, 0, 3)


def _stamp(ticks: int) -> bytes:
    t = ticks & STAMP_BITS
    return bytes([0x21 | t >> 29 & 0x0E, t >> 22 & 255, t >> 14 & 254 | 1, t >> 7 & 255, t << 1 & 254 | 1])


def unit_ticks(unit: int) -> int:
    return unit * UNIT * TICKS // SAMPLE_RATE


def mux(payload: bytes) -> bytes:
    """A transport stream whose only elementary stream holds ``payload``."""
    out, counter, tables = [], 0, 0
    for unit, at in enumerate(range(0, len(payload), UNIT)):
        data = payload[at : at + UNIT]
        ticks = unit_ticks(unit)
        pes = b"\x00\x00\x01" + bytes([STREAM_ID]) + (len(data) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(ticks) + data
        if unit % TABLES_EVERY == 0:
            out.append(_TABLE_PACKETS[tables & 15])
            tables += 1
            clock = ticks & STAMP_BITS  # the base of the clock reference; its extension is 0
            field_ = b"\x50" + (clock << 15 | 0x7E00).to_bytes(6, "big")
        else:
            field_ = b"\x00"
        room = PACKET - 5 - len(field_)
        if len(pes) < room:
            field_ += b"\xff" * (room - len(pes))
            room = len(pes)
        out += (_FIRST[counter & 15], bytes([len(field_)]), field_, pes[:room])
        counter += 1
        whole = (len(pes) - room) // 184
        for k in range(whole):
            begin = room + k * 184
            out += (_PLAIN[(counter + k) & 15], pes[begin : begin + 184])
        counter += whole
        rest = pes[room + whole * 184 :]
        if rest:
            gap = 183 - len(rest)  # bytes of the adaptation field after its length
            out += (_STUFFED[counter & 15], bytes([gap]), (b"\x00" + b"\xff" * (gap - 1)) if gap else b"", rest)
            counter += 1
    return b"".join(out)


@dataclass
class Stream:
    """What a transport stream holds. ``units``: (timestamp in 90 kHz ticks, byte offset of the first packet, length, random access)."""

    samples: bytes = b""
    units: list[tuple[int, int, int, bool]] = field(default_factory=list)
    packets: int = 0
    programs: dict[int, int] = field(default_factory=dict)
    streams: dict[int, int] = field(default_factory=dict)
    continuity_errors: int = 0
    damaged: int = 0
    clocks: list[int] = field(default_factory=list)


def _read_section(payload: bytes) -> bytes | None:
    begin = 1 + payload[0] if payload else 0
    size = int.from_bytes(payload[begin + 1 : begin + 3], "big") & 0x0FFF
    section = payload[begin : begin + 3 + size]
    return section if len(section) == size + 3 and size >= 9 and section_ok(section) else None


def demux(media: bytes) -> Stream:
    """The samples of the first elementary stream of the first program, and its index."""
    got = Stream()
    last: dict[int, int] = {}
    parts: list[bytes] = []
    unit: list[bytes] | None = None
    began, access, wanted = 0, False, None

    def close() -> None:
        nonlocal unit
        if unit is None:
            return
        pes = b"".join(unit)
        unit = None
        if len(pes) < 14 or pes[:3] != b"\x00\x00\x01" or not pes[7] & 0x80:
            got.damaged += 1
            return
        data = pes[9 + pes[8] : 6 + int.from_bytes(pes[4:6], "big")]
        if len(pes) < 6 + int.from_bytes(pes[4:6], "big"):
            got.damaged += 1
        t = pes[9:14]
        ticks = (t[0] >> 1 & 7) << 30 | t[1] << 22 | t[2] >> 1 << 15 | t[3] << 7 | t[4] >> 1
        got.units.append((ticks, began, len(data), access))
        parts.append(data)

    for at in range(0, len(media) - PACKET + 1, PACKET):
        got.packets += 1
        if media[at] != SYNC:
            got.damaged += 1
            continue
        b1, b3 = media[at + 1], media[at + 3]
        pid = (b1 & 0x1F) << 8 | media[at + 2]
        begin = at + 4
        random = False
        if b3 & 0x20:
            size = media[begin]
            if size > 183:
                got.damaged += 1
                continue
            if size:
                flags = media[begin + 1]
                random = bool(flags & 0x40)
                if flags & 0x10 and size >= 7:
                    got.clocks.append(int.from_bytes(media[begin + 2 : begin + 8], "big") >> 15)
            begin += 1 + size
        if not b3 & 0x10:
            continue
        counter = b3 & 15
        if pid in last and counter != (last[pid] + 1) & 15:
            got.continuity_errors += 1
        last[pid] = counter
        if pid == wanted:
            if b1 & 0x40:
                close()
                unit, began, access = [], at, random
            if unit is not None:
                unit.append(media[begin : at + PACKET])
        elif pid == 0 or pid in got.programs.values():
            section = _read_section(media[begin : at + PACKET]) if b1 & 0x40 else None
            if section is None:
                got.damaged += 1
            elif pid == 0:
                for k in range(8, len(section) - 4, 4):
                    if number := int.from_bytes(section[k : k + 2], "big"):
                        got.programs[number] = int.from_bytes(section[k + 2 : k + 4], "big") & 0x1FFF
            else:
                k = 12 + (int.from_bytes(section[10:12], "big") & 0x0FFF)
                while k < len(section) - 4:
                    stream = int.from_bytes(section[k + 1 : k + 3], "big") & 0x1FFF
                    got.streams[stream] = section[k]
                    wanted = stream if wanted is None else wanted
                    k += 5 + (int.from_bytes(section[k + 3 : k + 5], "big") & 0x0FFF)
    close()
    got.samples = b"".join(parts)
    return got


def feature(stream: Stream) -> str:
    """One line: counts, faults, timestamps and the random-access points as time@byte."""
    stamps = [u[0] for u in stream.units]
    points = [f"{u[0]}@{u[1]}" for u in stream.units if u[3]]
    ends = f"{stamps[0]}-{stamps[-1]}" if stamps else ""
    kinds = ",".join(f"{pid:x}:{kind:x}" for pid, kind in sorted(stream.streams.items()))
    return f"packets={stream.packets};streams={kinds};units={len(stream.units)};cc={stream.continuity_errors};damaged={stream.damaged};clocks={len(stream.clocks)};pts={ends};rap={','.join(points)}"


def padded(text: bytes) -> bytes:
    return text.ljust(max(64, -(-len(text) // 64) * 64), b"\x00")


def store_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = 4_000_000) -> DataFrame:
    """doc_id, n_bytes and media: each text's bytes, padded to a multiple of 64, as a transport stream."""
    source = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))

    def write(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            ids, texts = batch.column(0), batch.column(1)
            begin, held, media, sizes = 0, 0, [], []
            for i in range(batch.num_rows):
                text = texts[i].as_py()
                media.append(mux(padded(text)))
                sizes.append(len(text))
                held += len(media[-1])
                if held >= batch_bytes or i + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([ids.slice(begin, len(media)), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])
                    begin, held, media, sizes = i + 1, 0, [], []

    return source.mapInArrow(write, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


def probe(df: DataFrame) -> DataFrame:
    """What the stored streams hold: the input's doc_id and n_bytes, digests and features of what was read back, the units'
    timestamps (ticks) and the byte offsets of the random-access points."""
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "ticks", "access_offsets"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]

    def read(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            rows: list[tuple] = []
            for value in batch.column(2):
                media = value.as_py()
                got = demux(media)
                rows.append((len(got.samples), hashlib.sha256(got.samples).hexdigest(), zlib.crc32(got.samples[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(got), [u[0] for u in got.units], [u[1] for u in got.units if u[3]]))
            found = [pa.array(c, t) for c, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *found], names=["doc_id", "n_bytes", *names])

    return df.select("doc_id", "n_bytes", "media").mapInArrow(read, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, ticks array<long>, access_offsets array<long>")


def access_points(df: DataFrame) -> DataFrame:
    """doc_id, unit, ticks, byte_offset, length, random_access: the index by which a reader seeks in a stored stream."""

    def read(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            who, rows = [], []
            for i, value in enumerate(batch.column(1)):
                for k, unit in enumerate(demux(value.as_py()).units):
                    who.append(i)
                    rows.append((k, *unit))
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
            cols = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)] if rows else [pa.array([], t) for t in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(who, pa.int64())), *cols], names=["doc_id", "unit", "ticks", "byte_offset", "length", "random_access"])

    return df.select("doc_id", "media").mapInArrow(read, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, unit int, ticks long, byte_offset long, length long, random_access boolean")


def store_and_probe(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the streams to a media table, read them back from there, and compute their features."""
    work = Workspace(df.sparkSession, "transport-stream")
    media = work.put(store_texts(df, id_col, text_col), "media")
    return work.finish(probe(media))
