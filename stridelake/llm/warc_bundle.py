"""WARC archives as seekable Zstandard bundles.

A bundle is one binary value: independent Zstandard frames of whole WARC records, a skippable frame with
the record index (record identifier -> frame, offset in the frame, length), and last the seek table of
the seekable format. A reader finds the seek table from the bundle's end, and decompresses one frame to
get one record. Bundles are rows of a table, so any store that Spark reaches can hold them and a task
that is run again can't leave half a file behind.

Of records with equal payloads of at least ``revisit_bytes`` bytes, that with the smallest identifier is a
response and the others are revisits that name it.

Defined results: a null text is an empty payload; a null URL is replaced by the record's identifier; rows
that repeat the smallest identifier and payload are all responses; an empty table gives no bundles;
further columns are never read. A bundle whose seek table or frame is damaged raises ValueError.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Workspace, flagged, join_groups, key_filter

SKIPPABLE_INDEX, SKIPPABLE_SEEK, SEEK_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
FRAME_BYTES, BUNDLE_BYTES, LEVEL = 256 * 1024, 32 * 1024 * 1024, 3
DATE = "2024-01-01T00:00:00Z"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()  # noqa: S324  what WARC files use


def record_urn(page_id: object) -> str:
    """A page's record identifier; white space, control and other special signs of string identifiers are percent-encoded."""
    return "urn:nopage" if page_id is None else f"urn:page:{quote(str(page_id), safe='')}"


def page_of(urn: str) -> str | None:
    """The identifier that record_urn() was given, as a string."""
    return None if urn == "urn:nopage" else unquote(urn.removeprefix("urn:page:"))


def _safe(uri: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in uri)


def record(page_id: object, url: str | None, payload: bytes, refers_to: object | None) -> bytes:
    """A response, or with ``refers_to`` a revisit without the payload."""
    urn, revisit = record_urn(page_id), refers_to is not None
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{urn}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_safe(url) if url else urn}",
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
    ]
    if revisit:
        head += [f"WARC-Refers-To: <{record_urn(refers_to)}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    else:
        block += payload
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _skippable(magic: int, content: bytes) -> bytes:
    return struct.pack("<II", magic, len(content)) + content


class BundleWriter:
    """Collects records; ``bytes`` closes the bundle."""

    def __init__(self, frame_bytes: int = FRAME_BYTES, level: int = LEVEL):
        import zstandard

        self.zstd = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.frame_bytes = frame_bytes
        self.frames: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.index: list[tuple[str, int, int, int]] = []
        self.open: list[bytes] = []
        self.open_bytes = self.raw_bytes = 0

    def add(self, urn: str, data: bytes) -> None:
        if self.open and self.open_bytes + len(data) > self.frame_bytes:
            self._close_frame()
        self.index.append((urn, len(self.frames), self.open_bytes, len(data)))
        self.open.append(data)
        self.open_bytes += len(data)
        self.raw_bytes += len(data)

    def _close_frame(self) -> None:
        if self.open:
            raw = b"".join(self.open)
            self.frames.append(self.zstd.compress(raw))
            self.sizes.append((len(self.frames[-1]), len(raw)))
            self.open, self.open_bytes = [], 0

    def bytes(self) -> bytes:
        self._close_frame()
        index = "".join(f"{urn}\t{frame}\t{offset}\t{length}\n" for urn, frame, offset, length in self.index).encode()
        held = _skippable(SKIPPABLE_INDEX, self.zstd.compress(index))
        entries = [*self.sizes, (len(held), 0)]
        seek = b"".join(struct.pack("<II", *e) for e in entries) + struct.pack("<IBI", len(entries), 0, SEEK_MAGIC)
        return b"".join(self.frames) + held + _skippable(SKIPPABLE_SEEK, seek)


class BundleReader:
    """Random access to a bundle."""

    def __init__(self, data: bytes):
        import zstandard

        self.data, self.zstd = data, zstandard.ZstdDecompressor()
        if len(data) < 17:
            raise ValueError("not a seekable bundle")
        count, descriptor, magic = struct.unpack("<IBI", data[-9:])
        width = 12 if descriptor & 0x80 else 8
        table = len(data) - 9 - count * width
        if magic != SEEK_MAGIC or table < 8 or struct.unpack("<II", data[table - 8 : table]) != (SKIPPABLE_SEEK, len(data) - table):
            raise ValueError("the bundle's seek table is damaged")
        at, self.frames = 0, []
        for k in range(count):
            packed, raw = struct.unpack("<II", data[table + k * width : table + k * width + 8])
            self.frames.append((at, packed, raw))
            at += packed
        if at != table - 8:
            raise ValueError("the bundle's frames don't fill it")
        self.index_frame = self.frames.pop()

    def frame(self, k: int) -> bytes:
        import zstandard

        at, packed, raw = self.frames[k]
        try:
            return self.zstd.decompress(self.data[at : at + packed], max_output_size=raw)
        except zstandard.ZstdError as damage:
            raise ValueError(f"frame {k} is damaged: {damage}") from damage

    def index(self) -> list[tuple[str, int, int, int]]:
        at, packed, _ = self.index_frame
        text = self.zstd.decompress(self.data[at + 8 : at + packed]).decode()
        return [(urn, int(frame), int(offset), int(length)) for urn, frame, offset, length in (x.split("\t") for x in text.splitlines())]

    def record(self, urn: str) -> bytes:
        """One record by its identifier: one frame is decompressed."""
        for found, frame, offset, length in self.index():
            if found == urn:
                return self.frame(frame)[offset : offset + length]
        raise KeyError(urn)


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (names in lower case) and payload: the HTTP body of the block."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {name.lower(): value.strip() for name, _, value in (x.partition(":") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def revisits(work: Workspace, pages: DataFrame, revisit_bytes: int = 0) -> DataFrame:
    """_key (identifier and digest) and refers_to of the pages that repeat another's payload."""
    hashed = pages.select("page_id", F.sha2("payload", 256).alias("_digest"), F.octet_length("payload").alias("_size")).where(F.col("_size") >= revisit_bytes)
    hashed = work.put(hashed.select("page_id", "_digest"), "digests")
    level = work.put(hashed.groupBy("_digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("_rows")).where("_rows > 1"), "level")
    found = join_groups(hashed, level, ["_digest"], "_rows").where(~F.col("page_id").eqNullSafe(F.col("refers_to")) & F.col("refers_to").isNotNull())
    return work.put(found.select(F.concat_ws(":", F.coalesce(F.col("page_id").cast("string"), F.lit("")), "_digest").alias("_key"), "refers_to").distinct(), "revisits")


def write_bundles(work: Workspace, df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", revisit_bytes: int = 0, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """One row per bundle: content binary. Pages that repeat nothing never leave their task."""
    pages = df.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"))
    again = revisits(work, pages, revisit_bytes)
    key = F.concat_ws(":", F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.sha2("payload", 256))
    split = flagged(pages.withColumn("_key", key), F.col("_key"), key_filter(again, F.col("_key")))
    clear = split.where("not _maybe").withColumn("refers_to", F.lit(None).cast(pages.schema["page_id"].dataType))
    held = split.where("_maybe").join(again, "_key", "left")
    columns = ["page_id", "url", "payload", "refers_to"]

    def write(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle = BundleWriter(frame_bytes)
        for batch in stream:
            ids, urls, payloads, refers = batch.columns
            for i in range(batch.num_rows):
                page_id = ids[i].as_py()
                bundle.add(record_urn(page_id), record(page_id, urls[i].as_py(), payloads[i].as_py(), refers[i].as_py()))
                if bundle.raw_bytes >= bundle_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([bundle.bytes()], pa.binary())], names=["content"])
                    bundle = BundleWriter(frame_bytes)
        if bundle.index:
            yield pa.RecordBatch.from_arrays([pa.array([bundle.bytes()], pa.binary())], names=["content"])

    bundles = clear.select(*columns).unionByName(held.select(*columns)).mapInArrow(write, "content binary")
    return work.put(bundles, "bundles", compression="none")


_READ = "page_id string, url string, record_type string, refers_to string, payload_digest string, payload_bytes long"


def read_bundles(bundles: DataFrame, with_payload: bool = False) -> DataFrame:
    """One row per record, frame by frame. Digests of responses are computed from what was read, and must agree with the record's header."""
    names = [x.split()[0] for x in _READ.split(", ")] + ["payload"] * with_payload
    types = [pa.string()] * 5 + [pa.int64()] + [pa.binary()] * with_payload

    def read(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for value in batch.column(0):
                bundle = BundleReader(value.as_py())
                frames: dict[int, list[tuple[int, int]]] = {}
                for _, frame, offset, length in bundle.index():
                    frames.setdefault(frame, []).append((offset, length))
                for frame, places in frames.items():
                    raw, rows = bundle.frame(frame), []
                    for offset, length in places:
                        fields, payload = parse_record(raw[offset : offset + length])
                        said = fields["warc-payload-digest"].removeprefix("sha1:")
                        if fields["warc-type"] == "response" and payload_digest(payload) != said:
                            raise ValueError(f"the payload of {fields['warc-record-id']} is damaged")
                        bare = [page_of(fields[k].strip("<>")) if k in fields else None for k in ("warc-record-id", "warc-refers-to")]
                        row = (bare[0], fields["warc-target-uri"], fields["warc-type"], bare[1], said, int(fields["x-payload-length"]))
                        rows.append((*row, payload) if with_payload else row)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return bundles.mapInArrow(read, _READ + ", payload binary" * with_payload)


def record_index(bundles: DataFrame) -> DataFrame:
    """bundle (its digest), page_id, frame, frame_offset, frame_bytes, record_offset, record_bytes: where each record lies."""

    def read(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for value in batch.column(0):
                data = value.as_py()
                bundle, name = BundleReader(data), hashlib.sha256(data).hexdigest()
                rows = [(name, page_of(urn), frame, *bundle.frames[frame][:2], offset, length) for urn, frame, offset, length in bundle.index()]
                kinds = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["bundle", "page_id", "frame", "frame_offset", "frame_bytes", "record_offset", "record_bytes"])

    return bundles.mapInArrow(read, "bundle string, page_id string, frame int, frame_offset long, frame_bytes long, record_offset long, record_bytes long")


def archive_and_read(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", revisit_bytes: int = 0) -> DataFrame:
    """Write the archives, then read them: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    work = Workspace(df.sparkSession, "warc")
    kind = df.schema[id_col].dataType.simpleString()
    rows = read_bundles(write_bundles(work, df, id_col, url_col, html_col, revisit_bytes))
    return work.finish(rows.select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to")))
