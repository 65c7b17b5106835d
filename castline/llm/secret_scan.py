"""Secrets in texts: named assignments, access keys and hex strings, and strings of high entropy.

Three patterns give the base spans.  The method adds spans: in every candidate
string (a maximal run of a class's characters, as long as the class's window)
a window slides over all places, and its Shannon entropy follows from counts
that change by one character out and one in.  With n characters in a window
and c of each, n * (log2(n) - entropy) is the sum of c * log2(c); that sum is
kept in whole 2^-20 bits, so windows are compared exactly and alike
everywhere.  High windows that overlap or touch make one span.

Candidates that an allow-list pattern matches as a whole (words joined by
separators, numbers, UUIDs, example keys) give none, and an added span that
lies inside a base span is not told twice.

Texts need no shuffle.  A task holds one slice of texts (or one longer text);
runs of any length are cut into pieces of ``STEPS`` windows, each with counts
of its own, and ``PIECES`` of them slide side by side.

Defined results: a null or empty text has no spans; rows with a null or
repeated key are scanned row by row; further columns are ignored, clashing
names included; an empty table gives no rows.  Places count code points.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textscan import ragged, slices, text_buffers

BASE_KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
ASSIGN_CHARS, ACCESS_CHARS, HEX_CHARS = 12, 18, 16

#: Windows that one set of counts slides over, and sets that slide at once.
STEPS, PIECES = 64, 2048
#: Parts of a bit that entropies are kept in.
UNIT = 1 << 20


@dataclass(frozen=True)
class CharClass:
    """Strings of ``chars`` hold a secret where a window of ``window`` characters has ``bits`` bits a character at least."""

    kind: str
    chars: str
    window: int
    bits: float

    def table(self) -> np.ndarray:
        """c * log2(c) for c = 0 .. window in whole units."""
        return np.array([0, *(round(c * math.log2(c) * UNIT) for c in range(1, self.window + 1))], np.int64)

    def limit(self) -> int:
        """The greatest sum of c * log2(c), in units, of a high window."""
        return math.floor(self.window * (math.log2(self.window) - self.bits) * UNIT)


_DIGITS, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CLASSES = (CharClass("dense_hex", _DIGITS + "ABCDEFabcdef", 20, 3.0), CharClass("dense_base64", _DIGITS + _UPPER + _LOWER + "+/_=-", 24, 4.0))

#: Whole candidates that are no secrets.
ALLOWED = (
    r"[/_=+-]*([A-Z]?[a-z]+|[A-Z]+)([/_=+-]+([A-Z]?[a-z]+|[A-Z]+))*[/_=+-]*",  # words joined by separators
    r"[0-9/_=+-]+",  # numbers, dates
    r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}",  # UUIDs
    r".*(EXAMPLE|example).*",
)


def char_runs(data: np.ndarray, offsets: np.ndarray, chars: str, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of the characters inside one text, of at least ``least`` bytes: (row, start, stop) in bytes of data."""
    inside = np.zeros(256, bool)
    inside[[ord(c) for c in chars]] = True
    held = inside[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = held[:-1], held[1:]
    edges = offsets[1:-1]
    before[edges[edges < len(data)]] = False
    after[edges[edges > 0] - 1] = False
    start, stop = np.flatnonzero(held & ~before), np.flatnonzero(held & ~after) + 1
    long = stop - start >= least
    start, stop = start[long], stop[long]
    return np.searchsorted(offsets, start, "right") - 1, start, stop


def high_windows(data: np.ndarray, start: np.ndarray, stop: np.ndarray, kind: CharClass) -> np.ndarray:
    """Places of the high windows inside the runs start:stop, in order for runs in order."""
    if not len(start):
        return np.zeros(0, np.int64)
    table, limit, width = kind.table(), kind.limit(), kind.window
    pieces = (stop - start - width + STEPS) // STEPS
    begins = np.repeat(start, pieces) + ragged(np.zeros_like(pieces), pieces) * STEPS
    places = np.minimum(np.repeat(stop, pieces) - width + 1 - begins, STEPS)
    found = []
    for low in range(0, len(begins), PIECES):
        at, n = begins[low : low + PIECES], places[low : low + PIECES]
        rows = np.arange(len(at))
        first = data[at[:, None] + np.arange(width)]
        counts = np.bincount((rows[:, None] * 256 + first).ravel(), minlength=len(at) * 256).reshape(len(at), 256)
        total = table[counts].sum(axis=1)
        found.append(at[total <= limit])
        for step in range(1, int(n.max())):
            live = rows[n > step]
            leaves, comes = data[at[live] + step - 1], data[at[live] + step - 1 + width]
            c = counts[live, leaves]
            counts[live, leaves] = c - 1
            change = table[c - 1] - table[c]
            c = counts[live, comes]
            counts[live, comes] = c + 1
            total[live] += change + table[c + 1] - table[c]
            found.append(at[live][total[live] <= limit] + step)
    return np.sort(np.concatenate(found))


def _dense(data: np.ndarray, offsets: np.ndarray, kind: CharClass, allowed: list[re.Pattern]) -> Iterator[tuple[int, int, int]]:
    """(row, start, stop) in bytes of the spans that high windows make."""
    row, start, stop = char_runs(data, offsets, kind.chars, kind.window)
    odd = np.array([not any(p.fullmatch(data[s:e].tobytes()) for p in allowed) for s, e in zip(start, stop, strict=True)], bool)
    row, start, stop = row[odd], start[odd], stop[odd]
    high = high_windows(data, start, stop, kind)
    if not len(high):
        return
    run = np.searchsorted(start, high, "right") - 1
    breaks = np.flatnonzero((np.diff(high) > kind.window) | (np.diff(run) > 0)) + 1
    for a, b in zip(np.append(0, breaks), np.append(breaks, len(high)), strict=True):
        yield int(row[run[a]]), int(high[a]), int(high[b - 1]) + kind.window


def _base(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(row, kind, start, stop) in bytes of the base spans."""
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        text = data[a:b].tobytes()
        low = text.lower()
        if any(w in low for w in ASSIGN_WORDS):
            yield from ((i, 0, a + m.start(), a + m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_CHARS)
        yield from ((i, 1, a + m.start(), a + m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_CHARS)
    yield from ((int(i), 2, int(s), int(e)) for i, s, e in zip(*char_runs(data, offsets, _DIGITS + "abcdef", HEX_CHARS), strict=True))


def _scanned(classes: tuple[CharClass, ...], allowed: tuple[str, ...]) -> object:
    kinds, patterns = [*BASE_KINDS, *(c.kind for c in classes)], [re.compile(p.encode()) for p in allowed]

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            data, offsets = text_buffers(part.column("text"))
            spans: list[list[tuple[int, int, int]]] = [[] for _ in range(part.num_rows)]
            for row, kind, start, stop in _base(data, offsets):
                spans[row].append((start, kind, stop))
            # base spans of the slice by start, and how far any that began reaches
            base = sorted((start, stop) for one in spans for start, _, stop in one)
            starts, reach = np.array([b[0] for b in base], np.int64), np.maximum.accumulate(np.array([b[1] for b in base], np.int64)) if base else None
            for k, c in enumerate(classes, len(BASE_KINDS)):
                for row, start, stop in _dense(data, offsets, c, patterns):
                    began = int(np.searchsorted(starts, start, "right"))
                    if not began or reach[began - 1] < stop:
                        spans[row].append((start, k, stop))
            # code points before each byte
            points = np.append(0, np.cumsum((data & 0xC0) != 0x80)) if any(spans) else None
            told = [[{"kind": kinds[k], "start": int(points[s] - points[offsets[i]]), "stop": int(points[e] - points[offsets[i]])} for s, k, e in sorted(one)] for i, one in enumerate(spans)]
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(told, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())])))], ["key", "spans"])

    return scanned


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", classes: tuple[CharClass, ...] = CLASSES, allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """Rows (key, spans) for every row of docs: spans (kind, start, stop) by start, then kind as BASE_KINDS and classes list them."""
    held = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = held.schema["key"].dataType.simpleString()
    return held.mapInArrow(_scanned(classes, allowed), f"key {kind}, spans array<struct<kind:string,start:bigint,stop:bigint>>").withColumnRenamed("key", key)
