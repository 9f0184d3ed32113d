"""Vectorised word and span hashing over batches of texts in UTF-8.

A span's hash takes its bytes eight at a time, each piece mixed into the state by a 64-bit finaliser, and its length
last: no algebra holds over positions, so no family of words collides by construction. Memory is a few times the batch.
"""

from __future__ import annotations

import ctypes
import hashlib
import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Space, tab, LF, VT, FF, CR.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Longer spans are hashed one by one.
LONG = 64
_SEED = np.uint64(0x9E3779B97F4A7C15)
_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)  # the low k bytes of a piece


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that any bits of a hash may serve to deal or order by."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


class Spans:
    """Hashes and comparisons of spans of one byte array."""

    def __init__(self, data: np.ndarray):
        self.data = np.concatenate((data, np.zeros(8, np.uint8)))
        self.eights = np.ndarray((len(data) + 1,), "<u8", self.data, strides=(1,))

    def _piece(self, begin: np.ndarray, length: np.ndarray, k: int) -> np.ndarray:
        return self.eights[begin + k] & _KEEP[np.minimum(length - k, 8)]

    def hash(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """One 64-bit hash a span; equal spans have equal hashes wherever they lie."""
        length = end - begin
        h = np.full(len(begin), _SEED)
        at, left, size = np.arange(len(begin)), begin, length
        for k in range(0, LONG, 8):
            if k:
                more = np.flatnonzero(size > k)
                if not len(more):
                    break
                at, left, size = at[more], left[more], size[more]
            h[at] = mix(h[at] ^ self._piece(left, size, k)) + _SEED
        for i in np.flatnonzero(length > LONG).tolist():
            h[i] = int.from_bytes(hashlib.blake2b(self.data[begin[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
        return mix(h + length.astype(np.uint64))

    def equal(self, a: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_end: np.ndarray) -> bool:
        """Whether all spans a equal their spans b, byte by byte."""
        size = a_end - a
        if not np.array_equal(size, b_end - b):
            return False
        other = np.flatnonzero(a != b)
        a, b, size, k = a[other], b[other], size[other], 0
        while len(a) and k < LONG:
            if not np.array_equal(self._piece(a, size, k), self._piece(b, size, k)):
                return False
            k += 8
            more = size > k
            a, b, size = a[more], b[more], size[more]
        return all(np.array_equal(self.data[i + k : i + n], self.data[j + k : j + n]) for i, j, n in zip(a.tolist(), b.tolist(), size.tolist()))


def chained(hashes: list[np.ndarray]) -> np.ndarray:
    """One hash of several in order, as of the words of a shingle."""
    h = hashes[0]
    for x in hashes[1:]:
        h = h * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        h += x
    return mix(h)


def batches(texts: list[bytes], most: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` bytes together; a longer text stands alone."""
    return _ranges(map(len, texts), most)


def _ranges(sizes: Iterable[int], most: int) -> Iterator[tuple[int, int]]:
    begin = total = end = 0
    for i, size in enumerate(sizes):
        if total and total + size > most:
            yield begin, i
            begin, total = i, 0
        total += size + 1
        end = i + 1
    if begin < end:
        yield begin, end


def text_slices(batch: pa.RecordBatch, column: pa.Array, most: int = 500_000) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """``batch`` in slices of about ``most`` bytes of ``column``, each with its texts (null: empty): only a slice's are Python objects."""
    column = column.cast(pa.large_binary())
    for i, j in _ranges(pc.fill_null(pc.binary_length(column), 0).to_pylist(), most):
        yield batch.slice(i, j - i), [v or b"" for v in column.slice(i, j - i).to_pylist()]


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None  # glibc's


def give_back() -> None:
    """Memory that was freed goes back to the system: a worker idles on through later stages, beside the JVM's peak."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def returning(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``stream``, giving memory back after each batch and at the end."""
    for batch in stream:
        yield batch
        del batch
        give_back()
    give_back()


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """One byte array with a line feed after each text, and where each text begins (and, last, the length)."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1, out=starts[1:])
    return data, starts


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of every run without white space. The array ends with white space."""
    space = SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate(([0], edge))
    return edge[0::2], edge[1::2]


def gather(flat: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The slices flat[begin:begin+length], one after the other."""
    total = int(length.sum())
    before = np.cumsum(length) - length
    return flat[np.repeat(begin - before, length) + np.arange(total)]
