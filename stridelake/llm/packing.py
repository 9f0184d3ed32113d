"""Best-fit packing of token sequences, planned on a histogram of lengths.

Documents are tokenised and cut into pieces of at most ``max_tokens``. The driver gets one row a length,
never a row a document, and plans best fit decreasing over counts: all pieces of a length go, run by
run, to the open sequences with the least room that still holds them. Pieces are then ranked within
their length by Spark and take their planned places by a join on length and rank.

Defined results: a null text is empty, and an empty text is the end token alone; equal rows are pieces
like any others; an empty table gives no rows; further columns are never read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import LOWER, Spans, gather, joined, returning, text_slices
from .shared import BATCH_ROWS, Workspace, ranked

END = 0
#: Distinct words that a worker keeps the ids of, at about 150 bytes each.
KNOWN_WORDS = 400_000

# Splits that the tokenizer makes wherever they occur: around white space, and between ASCII letters, digits
# and other signs. Apostrophes (contractions) and all other bytes are never split from their neighbours.
_CLASS = np.zeros(256, np.uint8)
_CLASS[33:127] = 3
_CLASS[48:58] = 2
_CLASS[65:91] = _CLASS[97:123] = 1
_CLASS[[32, 9, 10, 11, 12, 13]] = 8


class WordIds:
    """Token ids by the tokenizer, which sees each distinct word once; texts are put together from these."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.specials = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._forget()

    def _forget(self) -> None:
        self.index: dict[bytes, int] = {}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.begin = np.zeros(1 << 14, np.int64)
        self.length = np.zeros(1 << 14, np.int64)
        self.used = 0

    def _learn(self, new: list[bytes]) -> None:
        for k in range(0, len(new), 4096):
            known = new[k : k + 4096]
            part = [w.decode() for w in known]
            got = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            ids = np.array(got.ids, np.uint32)
            at = np.fromiter((o[0] for o in got.offsets), np.int64, len(ids))
            size = np.fromiter(map(len, part), np.int64, len(part)) + 1
            cut = np.searchsorted(at, np.cumsum(size) - size)
            n, have = len(self.index), self.used + len(ids)
            while have > len(self.flat):
                self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
            while n + len(part) > len(self.begin):
                self.begin = np.concatenate((self.begin, np.zeros_like(self.begin)))
                self.length = np.concatenate((self.length, np.zeros_like(self.length)))
            self.flat[self.used : have] = ids
            self.begin[n : n + len(part)] = cut + self.used
            self.length[n : n + len(part)] = np.diff(np.append(cut, len(ids)))
            self.index.update(zip(known, range(n, n + len(part))))
            self.used = have

    def _whole(self, texts: list[bytes]) -> list[np.ndarray]:
        return [np.array(self.tokenizer.encode(t.decode(), add_special_tokens=False).ids, np.uint32) for t in texts]

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text, as the tokenizer gives for the whole text without special tokens added."""
        if any(s in t for t in texts for s in self.specials if s[:2] in t):  # special tokens' strings: case matters there
            return self._whole(texts)
        data, starts = joined(texts)
        data = LOWER[data]
        kind = _CLASS[data]
        left, right = kind[:-1], kind[1:]
        split = (left != right) & (((left != 0) & (right != 0)) | (left == 8) | (right == 8))
        split &= ~(((data[:-1] == 39) & (right != 8)) | ((data[1:] == 39) & (left != 8)))
        edge = np.concatenate(([0], np.flatnonzero(split) + 1, [len(data)]))
        begin, end = edge[:-1], edge[1:]
        word = kind[begin] != 8
        begin, end = begin[word], end[word]
        spans = Spans(data)
        _, first, inverse = np.unique(spans.hash(begin, end), return_index=True, return_inverse=True)
        if not spans.equal(begin, end, begin[first][inverse], end[first][inverse]):  # words of one hash that differ
            return self._whole(texts)
        if len(self.index) + len(first) > KNOWN_WORDS:
            self._forget()
        raw = data.tobytes()
        keys = [raw[i:j] for i, j in zip(begin[first].tolist(), end[first].tolist())]
        get = self.index.get
        where = np.fromiter((get(k, -1) for k in keys), np.int64, len(keys))
        missing = np.flatnonzero(where < 0)
        if len(missing):
            where[missing] = np.arange(len(self.index), len(self.index) + len(missing))
            self._learn([keys[i] for i in missing.tolist()])
        at = where[inverse]
        length = self.length[at]
        ids = gather(self.flat, self.begin[at], length)
        upto = np.concatenate(([0], np.cumsum(length)))[np.searchsorted(begin, starts)].tolist()
        return [ids[i:j] for i, j in zip(upto, upto[1:])]


_tokenizers: dict[str, WordIds] = {}


def tokenised(path: str) -> WordIds:
    """One a worker, kept from task to task."""
    if path not in _tokenizers:
        _tokenizers[path] = WordIds(path)
    return _tokenizers[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces(df: DataFrame, tokenizer: str | None = None, max_tokens: int = 2048, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids: each document's tokens and the end token, in pieces."""
    path = tokenizer or default_tokenizer()
    source = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    id_type = source.schema["doc_id"].dataType.simpleString()

    def cut(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = tokenised(path), np.array([END], "<u4")
        for batch in returning(stream):
            for rows, texts in text_slices(batch, batch.column(1)):
                who, piece, start, length, crc, ids = [], [], [], [], [], []
                for k, got in enumerate(encoder.encode(texts)):
                    tokens = np.concatenate((got.astype("<u4", copy=False), end))
                    for p, at in enumerate(range(0, len(tokens), max_tokens)):
                        part = tokens[at : at + max_tokens]
                        who.append(k)
                        piece.append(p)
                        start.append(at)
                        length.append(len(part))
                        crc.append(zlib.crc32(part.tobytes()))
                        if with_ids:
                            ids.append(part.astype(np.int32))
                columns = [rows.column(0).take(pa.array(who, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array(ids, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return source.mapInArrow(cut, schema)


@dataclass(frozen=True)
class Run:
    """Pieces ``rank0 .. rank0 + count - 1`` of ``length``: ``per_sequence`` side by side from ``offset0`` on in each of the sequences from ``sequence0`` on."""

    length: int
    rank0: int
    count: int
    per_sequence: int
    sequence0: int
    offset0: int


def plan_best_fit(histogram: dict[int, int], capacity: int) -> tuple[list[Run], int]:
    """Best fit decreasing over counts: the runs and the number of sequences. Work and output depend on the capacity, not on the number of pieces."""
    room: dict[int, list[tuple[int, int]]] = {}  # room left -> runs of sequences (first, how many)
    runs: list[Run] = []
    sequences = 0
    for length in sorted(histogram, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} tokens doesn't fit a sequence of {capacity}")
        left, rank = histogram[length], 0

        def place(first: int, n: int, free: int, per: int) -> None:
            nonlocal rank, left
            runs.append(Run(length, rank, n * per, per, first, capacity - free))
            rank, left = rank + n * per, left - n * per
            if free - per * length:
                room.setdefault(free - per * length, []).append((first, n))

        for free in sorted(r for r in room if r >= length):
            # A sequence that got one such piece has the least room that still holds another, so it is filled up first.
            per = free // length
            for first, n in room.pop(free):
                full = min(n, left // per)
                if full:
                    place(first, full, free, per)
                if full < n and left and left < per:
                    place(first + full, 1, free, left)
                    full += 1
                if full < n:
                    room.setdefault(free, []).append((first + full, n - full))
            if not left:
                break
        if left:
            per = capacity // length
            full = left // per
            if full:
                first, sequences = sequences, sequences + full
                place(first, full, capacity, per)
            if left:
                first, sequences = sequences, sequences + 1
                place(first, 1, capacity, left)
    return runs, sequences


def pack_pieces(work: Workspace, cut: DataFrame, max_tokens: int = 2048) -> DataFrame:
    """``cut`` with sequence_id and offset. Every length is ranked by many tasks, however common it is."""
    spark = cut.sparkSession
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most max_tokens rows
    runs, _ = plan_best_fit(histogram, max_tokens)
    rows = np.array([(r.length, r.rank0, r.rank0 + r.count - 1, r.per_sequence, r.sequence0, r.offset0) for r in runs], np.int64).reshape(-1, 6)
    # As an Arrow table: rows of Python objects would start further Python workers on the executors, only to be read.
    plan = spark.createDataFrame(pa.table(list(rows.T), names=["length", "_r0", "_r1", "_per", "_s0", "_o0"]))
    order = ranked(cut, ["length"], F.xxhash64("doc_id", "piece", "ids_crc32"), [F.col("doc_id"), F.col("piece")], rank="_rank")
    if len(runs) < 200_000:  # some MB at most; the number depends on max_tokens
        plan = F.broadcast(plan)
    nth = F.col("_rank") - F.col("_r0")
    return (
        order.join(plan, (order["length"] == plan["length"]) & F.col("_rank").between(F.col("_r0"), F.col("_r1")))
        .drop(plan["length"])
        .withColumn("sequence_id", F.col("_s0") + F.floor(nth / F.col("_per")))
        .withColumn("offset", F.col("_o0") + F.pmod(nth, F.col("_per")) * F.col("length"))
        .drop("_rank", "_r0", "_r1", "_per", "_s0", "_o0")
    )


def pack_documents(df: DataFrame, tokenizer: str | None = None, max_tokens: int = 2048, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, [ids,] sequence_id, offset."""
    work = Workspace(df.sparkSession, "packing", batch_rows=BATCH_ROWS)
    cut = work.put(pieces(df, tokenizer, max_tokens, id_col, text_col, with_ids), "pieces")
    return work.finish(pack_pieces(work, cut, max_tokens))
