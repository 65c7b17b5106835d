"""Vectorised scanning of Arrow text columns inside Python tasks.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``; the separators
are ASCII, so words of UTF-8 text can be cut at byte level.  All helpers work
on one slice of a record batch (about ``SLICE_BYTES`` of text, or one longer
document), which bounds a task's memory whatever the batch size.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Spans up to this many bytes are hashed eight bytes at a time; longer ones one by one.
LONG_SPAN = 256
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def is_space(data: np.ndarray) -> np.ndarray:
    """Which bytes separate words."""
    return _IS_SPACE[data]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts record batches into row slices of at most ``limit`` text bytes, or of one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = text_buffers(batch.column(batch.schema.get_field_index(column)))[1]
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(ends, ends[start] + limit, "right")) - 1
            stop = min(max(stop, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop
    release()


def release() -> None:
    """Gives memory that a finished task has freed back to the system: workers are reused and share a machine."""
    pa.default_memory_pool().release_unused()
    ctypes.CDLL(None).malloc_trim(0)


def text_buffers(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array (null as empty) and its len + 1 offsets into them."""
    if array.null_count:
        array = array.fill_null("")
    wide = pa.types.is_large_string(array.type)
    n = len(array)
    _, off, data = array.buffers()
    if n == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[array.offset : array.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans start[i]:end[i] of data."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    # the eight bytes that begin at every place
    loads = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    left = end - start
    h = mix(left.astype(np.uint64) * _MULTIPLIER)
    long = np.flatnonzero(left > LONG_SPAN)
    if len(long):
        left = np.where(left > LONG_SPAN, 0, left)
    now = np.flatnonzero(left > 0)
    at, rest = start[now], left[now]
    while len(now):
        h[now] = mix((h[now] ^ (loads[at] & _MASKS[np.minimum(rest, 8)])) * _MULTIPLIER)
        more = rest > 8
        now, at, rest = now[more], at[more] + 8, rest[more] - 8
    for i in long.tolist():
        digest = hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest()
        h[i] = np.uint64(int.from_bytes(digest, "little"))
    return h


class Words:
    """Words of a slice: byte spans, row of each, first word of each row, 64-bit hashes."""

    def __init__(self, array: pa.Array, lower: bool = False, gaps: np.ndarray = _IS_SPACE):
        data, offsets = text_buffers(array)
        self.data = _LOWER[data] if lower else data
        self.offsets = offsets
        gap = np.ones(len(data) + 1, bool)
        gap[:-1] = gaps[data]
        before = np.ones(len(data) + 1, bool)
        before[1:] = gap[:-1]
        cuts = offsets[:-1][offsets[:-1] < len(data)]
        before[cuts] = True
        self.start = np.flatnonzero(before[:-1] & ~gap[:-1])
        after = gap[1:].copy()
        inner = offsets[1:-1]
        after[inner[inner > 0] - 1] = True
        self.end = np.flatnonzero(after & ~gap[:-1]) + 1
        self.first = np.searchsorted(self.start, offsets[:-1]).astype(np.int64)
        self.stop = np.append(self.first[1:], len(self.start)).astype(np.int64)
        self.count = self.stop - self.first
        self.row = np.repeat(np.arange(len(offsets) - 1), self.count)
        self._hash: np.ndarray | None = None

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            self._hash = span_hash(self.data, self.start, self.end)
        return self._hash

    def text(self, i: int, j: int) -> bytes:
        """Words i to j - 1 joined by one space."""
        return b" ".join(self.data[s:e].tobytes() for s, e in zip(self.start[i:j], self.end[i:j], strict=True))

    def joined(self, keep: np.ndarray, step: int = 1 << 18) -> list[bytes]:
        """Per row its kept words joined by one space, gathered ``step`` words at a time."""
        out = []
        held = np.flatnonzero(keep)
        ends = np.cumsum(np.bincount(self.row[held], minlength=len(self.count)))
        for a, b in zip(np.append(0, ends[:-1]).tolist(), ends.tolist(), strict=True):
            parts = []
            for at in range(a, b, step):
                now = held[at : min(at + step, b)]
                sizes = self.end[now] - self.start[now] + 1
                spread = self.data.take(ragged(self.start[now], sizes), mode="clip")
                spread[np.cumsum(sizes) - 1] = 0x20
                parts.append(spread.tobytes())
            out.append(b"".join(parts)[:-1])
        return out


def runs_hash(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive entries of h (len(h) - k + 1 of them)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * _MULTIPLIER + h[i : i + n]
    return mix(out)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated ranges starts[i] .. starts[i] + lengths[i] - 1."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) - np.repeat(ends - lengths - starts, lengths)


def windows(first: np.ndarray, count: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Start indices of all k-word windows that stay in one row, and the row of each."""
    n = np.maximum(count - k + 1, 0)
    return ragged(first, n), np.repeat(np.arange(len(first)), n)
