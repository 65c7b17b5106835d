"""Periodic stretches of words, found on a harmonic grid of hashed blocks.

A run is a stretch of consecutive words whose smallest period is q (words q
apart are identical), of at least ``least`` words and ``repeats`` periods, that
no neighbouring word extends.  Its words a and a + q agree over a stretch of
A = max((repeats - 1) * q, least - q) places at the least, and so over one
whole block of t = (A + 1) // 2 places that begins at a multiple of t.  For
each period the grid has n / t such blocks, n * log(n) over all periods.

A slice of texts is worked on at once: prefix sums of word hashes compare all
(period, block) pairs in one step, the blocks that agree and follow none that
agrees are extended to both sides by binary searches that run side by side,
and of equal stretches the smallest period stays.  What is left is verified
word by word, byte by byte; a text in which two different words or blocks had
the same hash is searched again without hashes.  Texts need no shuffle, and a
task holds one slice of texts (or one longer text) and ``PAIRS`` pairs.

Defined results: a null or empty text has no words and no runs; rows with a
null or repeated key are searched row by row; further columns are ignored,
clashing names included; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textscan import Words, ragged, slices

#: Pairs of a period and a block that are compared at once.
PAIRS = 1 << 19
#: Any odd number with mixed bits: the base of the prefix sums.
BASE = np.uint64(0xD6E8FEB86659FD93)

_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


class Blocks:
    """Compares stretches of hashes at a distance by prefix sums of hash * BASE^place, modulo 2^64."""

    def __init__(self, hashes: np.ndarray):
        self.power = np.ones(len(hashes) + 1, np.uint64)
        np.cumprod(np.full(len(hashes), BASE), out=self.power[1:])
        self.sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * self.power[:-1], out=self.sums[1:])

    def equal(self, start: np.ndarray, stop: np.ndarray, period: np.ndarray) -> np.ndarray:
        """Whether start:stop and the stretch ``period`` places on have the same sum."""
        return (self.sums[stop] - self.sums[start]) * self.power[period] == self.sums[stop + period] - self.sums[start + period]

    def reach(self, at: np.ndarray, period: np.ndarray, limit: np.ndarray, side: int) -> np.ndarray:
        """How many places from ``at`` on (side 1) or before it (side -1) agree, at most ``limit``: all binary searches at once."""
        low, high = np.zeros_like(at), limit.copy()
        while (open_ := np.flatnonzero(low < high)).size:
            mid = (low[open_] + high[open_] + 1) // 2
            here = at[open_]
            same = self.equal(here, here + mid, period[open_]) if side > 0 else self.equal(here - mid, here, period[open_])
            low[open_] = np.where(same, mid, low[open_])
            high[open_] = np.where(same, high[open_], mid - 1)
        return low


def _agreement(period: np.ndarray, least: int, repeats: int) -> np.ndarray:
    return np.maximum((repeats - 1) * period, least - period)


def _candidates(hashes: np.ndarray, first: np.ndarray, count: np.ndarray, least: int, repeats: int) -> np.ndarray:
    """Rows (text, start, length, period) whose hashes agree, starts counted in all words."""
    most = np.where(count >= least, count // repeats, 0)
    text, period = np.repeat(np.arange(len(count)), most), ragged(np.ones_like(most), most)
    block = (_agreement(period, least, repeats) + 1) // 2
    grid = np.maximum((count[text] - period) // block, 0)
    text, period, block, grid = (x[grid > 0] for x in (text, period, block, grid))
    blocks, ends, found, low = Blocks(hashes), np.cumsum(grid), [], 0
    while low < len(grid):
        # whole (text, period) lines of the grid, as many as fit
        high = max(low + 1, int(np.searchsorted(ends, ends[low] - grid[low] + PAIRS, "right")))
        line = np.repeat(np.arange(low, high), grid[low:high])
        at = first[text[line]] + ragged(np.zeros(high - low, np.int64), grid[low:high]) * block[line]
        near = np.flatnonzero(hashes[at] == hashes[at + period[line]])
        near = near[blocks.equal(at[near], at[near] + block[line[near]], period[line[near]])]
        fresh = np.ones(len(near), bool)  # the block before it agrees: the same stretch
        fresh[1:] = (np.diff(near) > 1) | (np.diff(line[near]) > 0)
        at, line = at[near[fresh]], line[near[fresh]]
        p, t, begin = period[line], block[line], first[text[line]]
        stop = at + t + blocks.reach(at + t, p, begin + count[text[line]] - p - at - t, 1)
        start = at - blocks.reach(at, p, at - begin, -1)
        whole = stop - start >= _agreement(p, least, repeats)
        found.append(np.stack([text[line], start, stop - start + p, p])[:, whole])
        low = high
    out = np.concatenate(found, axis=1) if found else np.zeros((4, 0), np.int64)
    out = out[:, np.lexsort(out[::-1])]
    # of equal stretches the smallest period
    same = np.zeros(out.shape[1], bool)
    same[1:] = (out[:3, 1:] == out[:3, :-1]).all(axis=0)
    return out[:, ~same].T


def _verified(words: Words, start: int, length: int, period: int, step: int = 1 << 16) -> bool:
    """Whether the words of the stretch are the same bytes one period on."""
    for at in range(start, start + length - period, step):
        a = np.arange(at, min(at + step, start + length - period))
        sizes = words.end[a] - words.start[a]
        if (sizes != words.end[a + period] - words.start[a + period]).any():
            return False
        if (words.data[ragged(words.start[a], sizes)] != words.data[ragged(words.start[a + period], sizes)]).any():
            return False
    return True


def _scanned(words: Words, begin: int, n: int, least: int, repeats: int) -> list[tuple[int, int, int]]:
    """The runs (start, length, period) of one text without hashes, period by period."""
    numbers: dict[bytes, int] = {}
    ids = np.array([numbers.setdefault(words.data[s:e].tobytes(), len(numbers)) for s, e in zip(words.start[begin : begin + n], words.end[begin : begin + n], strict=True)])
    best: dict[tuple[int, int], int] = {}
    for p in range(1, n // repeats + 1):
        edge = np.diff(np.concatenate([[0], (ids[:-p] == ids[p:]).astype(np.int8), [0]]))
        for s, e in zip(np.flatnonzero(edge > 0).tolist(), np.flatnonzero(edge < 0).tolist(), strict=True):
            if e - s >= max((repeats - 1) * p, least - p):
                best.setdefault((s, e - s + p), p)
    return sorted((s, length, p) for (s, length), p in best.items())


def runs_of(words: Words, least: int, repeats: int, hashes: np.ndarray | None = None) -> list[list[tuple[int, int, int]]]:
    """Per text its runs (start, length, period), by start, then period."""
    found = _candidates(words.hash if hashes is None else hashes, words.first, words.count, least, repeats)
    out: list[list[tuple[int, int, int]]] = [[] for _ in words.count]
    again = set()
    for text, start, length, period in found.tolist():
        if _verified(words, start, length, period):
            out[text].append((start - int(words.first[text]), length, period))
        else:
            again.add(text)
    for text in again:
        out[text] = _scanned(words, int(words.first[text]), int(words.count[text]), least, repeats)
    return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in out]


def _searched(least: int, repeats: int) -> object:
    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            words = Words(part.column("text"))
            runs = runs_of(words, least, repeats)
            edge = np.zeros(len(words.start) + 1, np.int64)
            for i, begin in enumerate(words.first.tolist()):
                for start, length, period in runs[i]:
                    edge[begin + start + period] += 1
                    edge[begin + start + length] -= 1
            kept = words.joined(np.cumsum(edge)[:-1] == 0)
            spans = pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in one] for one in runs], _RUNS)
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(words.count.astype(np.int64)), spans, pa.array(kept, pa.binary()).cast(pa.string())], ["key", "n_words", "runs", "kept"])

    return searched


def collapse_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 24, repeats: int = 3) -> DataFrame:
    """Rows (key, n_words, runs, kept) for every row of docs: its runs as (start, length, period) by start, then period, and
    its words without those that any run holds after its first period, joined by one space."""
    held = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = held.schema["key"].dataType.simpleString()
    return held.mapInArrow(_searched(least, repeats), f"key {kind}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, kept string").withColumnRenamed("key", key)


def strongest(runs: Column) -> Column:
    """Of runs in order of start and period the first with the greatest length / period, compared as whole products; null if none."""
    none = F.get(runs, F.lit(0))
    return F.aggregate(runs, none, lambda best, run: F.when(run["length"] * best["period"] > best["length"] * run["period"], run).otherwise(best))


def run_digest(runs: Column) -> Column:
    """SHA-256 of the lines start,length,period of all runs."""
    lines = F.transform(runs, lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return F.sha2(F.array_join(lines, "").cast("binary"), 256)


def looped(text: Column, key: Column) -> Column:
    """The text with a periodic tail where crc32 of the key, as decimal text, is a multiple of 10: each word i >= a becomes word a + (i - a) % p.

    a and p follow from the number of words and the rest of the crc; other texts,
    null keys, and texts without words stay as they are.
    """
    crc = F.crc32(key.cast("string").cast("binary"))
    g = F.floor(crc / 10).cast("long")

    def tail(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8)).cast("long")
        word = lambda i: F.get(w, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(n - 1, F.lit(0))), word), " ")).otherwise(text)

    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    return F.when(crc % 10 == 0, F.get(F.transform(F.array(words), tail), F.lit(0))).otherwise(text)
