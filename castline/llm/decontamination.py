"""Benchmark decontamination by template canonicalisation.

A text becomes template tokens: white-space words without punctuation at their
ends, lower-cased, where numbers, units after numbers, and capitalised words
inside a sentence are typed placeholders.  Windows of ``WINDOW`` template tokens
of documents and benchmark items are hash-joined, so a question with other
numbers and names still meets its original.  A name is told by its case, so two
more kinds of windows join them: folded ones, where names are words in folded
case, meet passages whose case was changed, and opening ones, where a capitalised
first token is a name though it begins a sentence, meet an item's first token
anywhere.  Matches of a document with an
item that lie on one diagonal are then checked for slots: a slot value of the
item must stand for one value of the document and the other way round, but for
a share of ``CONFLICTS`` at most.  A pair counts if its consistent windows cover
``COVER`` tokens, those of typed windows alone or those of all kinds.

Document windows pass a Bloom filter of the item windows, of fixed size, in the
scan; only its hits go on to the join.  Windows meet without their words first
and fold to diagonals; of a pair's diagonals that hold the same windows, as a
text that repeats itself has many, one is judged.  So a group never holds more
than the windows of one item.

Defined results: null and empty texts match nothing, nor do items of fewer than
WINDOW template tokens; windows with fewer than LITERALS literal tokens are not
used; null keys match nothing; repeated rows with one key are one document; empty tables give no
rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small, stored
from .textscan import Words, mix, runs_hash, slices, span_hash

WINDOW, LITERALS, COVER, CONFLICTS = 8, 4, 13, 1 / 3
BLOOM_BITS = 24
UNITS = (
    "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg gram grams kilogram kilograms oz ounce ounces lb lbs pound pounds ton tons "
    "ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "cent cents dollar dollars usd eur euro euros percent mph kmh degree degrees volt volts watt watts byte bytes kb mb gb tb"
).split()
#: Typed placeholders as token hashes.
NUMBER, UNIT, NAME = (np.uint64(x) for x in (0x6E756D6265720001, 0x756E697400000002, 0x6E616D6500000003))

_PUNCT = np.zeros(256, bool)
_PUNCT[[ord(c) for c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_NUMERIC = _DIGIT.copy()
_NUMERIC[[ord(c) for c in ".,:/-"]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?:\"()"]] = True
_UNIT_HASHES = np.sort(Words(pa.array(UNITS, pa.string())).hash)


def _lowered(data: np.ndarray) -> np.ndarray:
    """Lower-cased A-Z and the capitals U+00C0-U+00DE of UTF-8 bytes."""
    out = data.copy()
    out[(data >= 65) & (data <= 90)] += 32
    latin = np.append(False, data[:-1] == 0xC3) & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)
    out[latin] += 32
    return out


def _trimmed(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indices of the words that are more than punctuation, their starts and ends without it."""
    data, start, end = w.data, w.start.copy(), w.end.copy()
    while True:
        cut = (start < end) & _PUNCT[data[np.minimum(start, max(len(data) - 1, 0))]] if len(start) else np.zeros(0, bool)
        if not cut.any():
            break
        start += cut
    while True:
        cut = (start < end) & _PUNCT[data[end - 1]] if len(start) else np.zeros(0, bool)
        if not cut.any():
            break
        end -= cut
    keep = np.flatnonzero(start < end)
    return keep, start[keep], end[keep]


def _folded(texts: pa.Array) -> pa.Array:
    """Texts without case; ASCII spaces and punctuation stay."""
    lower = pc.utf8_lower(texts)
    for one, other in (("ß", "ss"), ("ς", "σ")):
        lower = pc.replace_substring(lower, one, other)
    return lower


#: Kinds of windows.
TYPED, FOLDED, OPENING = 0, 1, 2


class Template:
    """Template tokens of a slice: word index, row, hash, whether it is a slot; hash and slot in folded case; whether it may open with a name."""

    def __init__(self, texts: pa.Array):
        w = self.words = Words(texts)
        data = w.data
        keep, self.start, self.end = _trimmed(w)
        self.row = w.row[keep]
        self.lower = _lowered(data)
        if not len(keep):
            self.hash = self.plain = np.zeros(0, np.uint64)
            self.slot = self.typed = self.opens = np.zeros(0, bool)
            return
        count = lambda mask: np.concatenate([[0], np.cumsum(mask)])
        digits, numeric, breaks = count(_DIGIT[data]), count(_NUMERIC[data]), count(data == 10)
        size = self.end - self.start
        number = (digits[self.end] > digits[self.start]) & ((numeric[self.end] - numeric[self.start] == size) | _DIGIT[data[self.start]])
        begins = np.append(True, w.row[1:] != w.row[:-1])
        begins[1:] |= _STOP[data[w.end[:-1] - 1]] | (breaks[w.start[1:]] > breaks[w.end[:-1]])
        first = data[self.start]
        after = data[np.minimum(self.start + 1, len(data) - 1)]
        capital = ((first >= 65) & (first <= 90)) | ((first == 0xC3) & (after >= 0x80) & (after <= 0x9E) & (after != 0x97))
        name = capital & ~begins[keep] & (size > 1) & ~number
        h = span_hash(self.lower, self.start, self.end)
        at = np.minimum(np.searchsorted(_UNIT_HASHES, h), len(_UNIT_HASHES) - 1)
        unit = (_UNIT_HASHES[at] == h) & np.append(False, number[:-1] & (self.row[1:] == self.row[:-1]))
        plain = h
        # beyond Latin capitals, or with a sharp s, folding moves the words
        if (data >= 0xC4).any() or ((data[:-1] == 0xC3) & (data[1:] == 0x9F)).any():
            moved = Words(_folded(texts))
            plain = span_hash(moved.data, *_trimmed(moved)[1:])
        typed = lambda h: np.where(number, NUMBER, np.where(unit, UNIT, h))
        self.hash, self.slot = typed(np.where(name, NAME, h)), number | unit | name
        self.plain, self.typed = typed(plain), number | unit
        self.opens = capital & begins[keep] & (size > 1) & ~self.typed

    def windows(self, size: int, item: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First tokens, hashes and kinds of the windows that stay in a row and have enough literal tokens.

        Folded windows that equal their typed ones are left out; of an item only the first window opens.
        """
        n = len(self.hash) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int8)
        inside = self.row[:n] == self.row[size - 1 :]
        held = lambda slot: np.convolve(slot, np.ones(size, np.int64), "valid")
        slots = held(self.slot)
        typed, folded = runs_hash(self.hash, size), runs_hash(self.plain, size)
        opening = inside & self.opens[:n] & (slots + 1 <= size - LITERALS)
        if item:
            opening &= np.append(True, self.row[1:n] != self.row[: n - 1])
        at = [np.flatnonzero(inside & (slots <= size - LITERALS)), np.flatnonzero(inside & (held(self.typed) <= size - LITERALS) & (typed != folded)), np.flatnonzero(opening)]
        tokens = self.hash[at[OPENING][:, None] + np.arange(size)]
        tokens[:, 0] = NAME
        opened = runs_hash(tokens.ravel(), size)[::size] if len(tokens) else np.zeros(0, np.uint64)
        return np.concatenate(at), np.concatenate([typed[at[TYPED]], folded[at[FOLDED]], opened]), np.repeat(np.arange(3, dtype=np.int8), [len(a) for a in at])

    def slots(self, at: int, size: int, kind: int) -> list[bool]:
        slots = (self.typed if kind == FOLDED else self.slot)[at : at + size].tolist()
        return [True, *slots[1:]] if kind == OPENING else slots

    def surfaces(self, at: int, size: int) -> list[str]:
        return [self.lower[s:e].tobytes().decode("utf-8", "replace") for s, e in zip(self.start[at : at + size].tolist(), self.end[at : at + size].tolist(), strict=True)]


_ROWS = "hash bigint, key bigint, at int, words array<string>, slots array<boolean>, typed boolean"


def _windows(size: int, bloom) -> object:
    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            t = Template(part.column("text"))
            at, h, kind = t.windows(size, item=bloom is None)
            if bloom is not None and len(h):
                hit = np.unpackbits(bloom.value[_byte(h)][:, None], axis=1, bitorder="little")[np.arange(len(h)), (h & np.uint64(7)).astype(np.int64)] > 0
                at, h, kind = at[hit], h[hit], kind[hit]
            keys = part.column("key")
            row = t.row[at]
            first = np.searchsorted(t.row, row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h.view(np.int64)), keys.take(pa.array(row)), pa.array((at - first).astype(np.int32)), pa.array([t.surfaces(int(a), size) for a in at], pa.list_(pa.string())), pa.array([t.slots(int(a), size, k) for a, k in zip(at, kind, strict=True)], pa.list_(pa.bool_())), pa.array(kind == TYPED)],
                ["hash", "key", "at", "words", "slots", "typed"],
            )

    return windows


def _byte(h: np.ndarray) -> np.ndarray:
    return ((mix(h) >> np.uint64(64 - BLOOM_BITS + 3))).astype(np.int64)


def _bloom(size: int) -> object:
    """A task's partial filter: the distinct (byte, bit) pairs of its windows."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            _, h, _ = Template(part.column("text")).windows(size, item=True)
            cell = np.unique(_byte(h) * 8 + (h & np.uint64(7)).astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(cell)], ["cell"])

    return bits


def judge(found: list[dict], size: int, cover: int, conflicts: float) -> tuple[int, int, int, int] | None:
    """(tokens covered, windows, slots, negated conflicts) of the windows on one diagonal of a document and an item, or None if it does not count."""
    tokens: dict[int, tuple[str, str, bool]] = {}
    for p in found:
        for i, (d, q, s) in enumerate(zip(p["words"], p["item_words"], p["slots"], strict=True)):
            tokens[p["item_at"] + i] = (q, d, s or tokens.get(p["item_at"] + i, (q, d, s))[2])
    there: dict[str, str] = {}
    back: dict[str, str] = {}
    slots = wrong = 0
    for _, (q, d, s) in sorted(tokens.items()):
        if s:
            slots += 1
            wrong += there.setdefault(q, d) != d or back.setdefault(d, q) != q
    return (len(tokens), len(found), slots, -wrong) if len(tokens) >= cover and wrong <= conflicts * slots else None


_VERDICT = "key bigint, item bigint, n_tokens int, n_windows int, n_slots int, agreed int"


def _judged(size: int, cover: int, conflicts: float) -> object:
    """Verdicts of rows that hold one diagonal each: its typed windows alone, and all of them."""

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                typed = [p for p in row["pairs"] if p["typed"]]
                verdicts = [judge(typed, size, min(cover, row["typed_tokens"]), conflicts)] if typed else []
                verdicts += [judge(row["pairs"], size, min(cover, row["item_tokens"]), conflicts)]
                out += [(row["key"], row["item"], *v) for v in verdicts if v]
            columns = list(zip(*out, strict=True)) or [[]] * 6
            types = [pa.int64()] * 2 + [pa.int32()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["key", "item", "n_tokens", "n_windows", "n_slots", "agreed"])

    return judged


def contaminated(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, cover: int = COVER, conflicts: float = CONFLICTS
) -> DataFrame:
    """Rows (key, item, n_windows, n_tokens, n_slots, n_conflicts) of the pairs that count."""
    spark = docs.sparkSession
    held = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    items = benchmark.where(F.col(item).isNotNull()).select(F.col(item).cast("long").alias("key"), F.col(item_text).alias("text"))
    wanted = stored(items.mapInArrow(_windows(window, None), _ROWS), "decontamination")
    # at most 2 ** BLOOM_BITS cells, 2 MB as bits, whatever the benchmark's size
    cells = items.mapInArrow(_bloom(window), "cell bigint").distinct().toPandas()["cell"].to_numpy(np.int64)
    bits = np.zeros(1 << BLOOM_BITS, bool)
    bits[cells] = True
    bloom = spark.sparkContext.broadcast(np.packbits(bits, bitorder="little"))
    lengths = wanted.groupBy("key").agg((F.max("at") + window).alias("item_tokens"), (F.max(F.when(F.col("typed"), F.col("at"))) + window).alias("typed_tokens")).withColumnRenamed("key", "item")
    n = wanted.count()
    hits = held.mapInArrow(_windows(window, bloom), _ROWS).join(small(wanted.select("hash").distinct(), n), "hash", "left_semi")
    hits = stored(hits.withColumn("face", F.xxhash64("words", "slots", "typed")), "decontamination-hits")
    bloom.destroy()
    right = wanted.select("hash", F.col("key").alias("item"), F.col("at").alias("item_at"), F.col("words").alias("item_words"), F.col("typed").alias("item_typed"))
    diagonal = (F.col("at") - F.col("item_at")).alias("diagonal")
    # the windows of a diagonal as a sum of hashes: counts fold in the join's own task, before any shuffle
    window_hash = F.xxhash64("item_at", "face", "item_typed").cast("decimal(38,0)")
    narrow = hits.select("hash", "key", "at", "face").join(small(right.drop("item_words"), n), "hash")
    diagonals = narrow.groupBy("key", "item", diagonal).agg(F.count("*").alias("n"), F.sum(window_hash).alias("held"))
    picked = diagonals.groupBy("key", "item", "n", "held").agg(F.min("diagonal").alias("diagonal")).select("key", "item", "diagonal")
    pairs = hits.join(small(right, n), "hash").select("*", diagonal).join(picked, ["key", "item", "diagonal"])
    pairs = pairs.groupBy("key", "item", "diagonal").agg(F.collect_set(F.struct("at", "item_at", "words", "item_words", "slots", (F.col("typed") & F.col("item_typed")).alias("typed"))).alias("pairs"))
    judged = pairs.join(small(lengths, n), "item").select("key", "item", "item_tokens", "typed_tokens", "pairs").mapInArrow(_judged(window, cover, conflicts), _VERDICT)
    best = judged.groupBy("key", "item").agg(F.max(F.struct("n_tokens", "n_windows", "n_slots", "agreed")).alias("b"))
    return best.select(F.col("key").alias(key), F.col("item").alias(item), "b.n_windows", "b.n_tokens", "b.n_slots", (-F.col("b.agreed")).alias("n_conflicts"))
