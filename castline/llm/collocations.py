"""Phrases whose words occur together more often than apart, by counted n-grams of word ids.

Texts are lower-cased (A-Z) and split at ``.,;:!?`` and line ends into pieces,
pieces at blanks and tabs into words.  All counts are per language.

1. Word counts, added up in tasks before the shuffle.  A word's 64-bit hash
   covers its language; all words of the corpus are tested for equal hashes,
   and counted again under another seed if any two are.
2. The dictionary: words of at least ``least`` occurrences (a phrase is no more
   frequent than its words).  Texts are written once more as ids, pieces broken
   at other words.  Ids are places in the sorted dictionary, four bytes each,
   while it has at most ``DENSE`` words; beyond that they are the hashes, eight
   bytes each, and a bitmap of fixed size sorts most other words out (what it
   lets through cannot be frequent and goes after counting).
3. For each length k the id k-grams are packed into fixed-width keys whose byte
   order is the order of ids.  Tasks radix-sort buffers of ``BUFFER`` keys and
   count runs, so a hot phrase leaves a task as a few rows; keys are then
   partitioned by range, sorted, and their runs counted across batches.  Only
   k-grams whose two (k-1)-grams are frequent are packed, tested by a ``Sieve``
   of bounded size that has no false negatives.
4. Scores, drops and ranks are joins of the small tables of frequent k-grams;
   arithmetic is in decimals of 38 digits, exact for counts up to 10^15.

Defined results: a null text is empty, a null language ``und``; keys are not
used, so repeated rows count as often as they stand; further columns are
ignored, clashing names included; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import dropped, small, stored
from .textscan import Words, mix, release, runs_hash, slices

#: Words that ids of four bytes number, and hashes that a sieve holds one by one: 32 MB at most.
DENSE = 1 << 22
#: Bits of a sieve that holds more hashes: 32 MB.
SIEVE_BITS = 28
#: Keys that a task sorts at once, and words it counts before it passes them on.
BUFFER, COUNTED = 1 << 20, 1 << 18
#: Parts that a language's phrases are ranked in first.
RANK_PARTS = 64
SEEDS = 8

_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_GAPS = _ENDS.copy()
_GAPS[[0x20, 0x09]] = True


def _narrow(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def _hashed(words: Words, langs: pa.Array, seed: int, bits: int) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Hash of each word in its language, the languages, and each word's place in them."""
    coded = langs.dictionary_encode()
    names = coded.dictionary.to_pylist()
    salts = np.array([int.from_bytes(hashlib.blake2b(f"{seed}:{name}".encode(), digest_size=8).digest(), "little") for name in names], np.uint64)
    of = coded.indices.to_numpy(zero_copy_only=False)[words.row] if len(names) else np.zeros(0, np.int64)
    h = mix(words.hash ^ salts[of]) if len(of) else np.zeros(0, np.uint64)
    h &= np.uint64((1 << bits) - 1)
    h[h == np.uint64(0xFFFFFFFFFFFFFFFF)] = 0  # all ones mark a break
    return h, names, of


def _counted(seed: int, bits: int) -> object:
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[int, bytes, str], int] = {}

        def told() -> pa.RecordBatch:
            h, words, langs = zip(*counts, strict=True)
            out = [pa.array(np.array(h, np.uint64).view(np.int64)), pa.array(langs), pa.array(words, pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64())]
            counts.clear()
            return pa.RecordBatch.from_arrays(out, ["h", "lang", "word", "n"])

        for part in slices(batches, "text"):
            words = Words(part.column("text"), lower=True, gaps=_GAPS)
            h, names, of = _hashed(words, part.column("lang"), seed, bits)
            # with few bits different words share a hash: words are told apart by their whole hash here
            _, at, n = np.unique(words.hash ^ mix(h) if bits < 64 else h, return_index=True, return_counts=True)
            for i, c in zip(at.tolist(), n.tolist(), strict=True):
                key = (int(h[i]), words.data[words.start[i] : words.end[i]].tobytes(), names[of[i]])
                counts[key] = counts.get(key, 0) + c
            if len(counts) >= COUNTED:
                yield told()
        if counts:
            yield told()

    return counted


def word_counts(rows: DataFrame, bits: int = 64) -> tuple[DataFrame, int]:
    """The stored counts (h, lang, word, n) of all words, and the seed under which no two of them share h."""
    for seed in range(SEEDS):
        words = stored(rows.mapInArrow(_counted(seed, bits), "h bigint, lang string, word string, n bigint").groupBy("h", "lang", "word").agg(F.sum("n").alias("n")), "collocations")
        if not words.groupBy("h").count().where("count > 1").limit(1).count():
            return words, seed
        dropped(words)
    raise RuntimeError("different words keep the same hash")


def _bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's rows of longs as the bytes of each column, one row in all."""
    held = [[c.to_numpy() for c in batch.columns] for batch in batches]
    columns = [np.concatenate(c).astype(np.int64).tobytes() for c in zip(*held, strict=True)] or [b""] * 2
    yield pa.RecordBatch.from_arrays([pa.array([columns[0]], pa.binary()), pa.array([columns[-1]], pa.binary())], ["first", "last"])


def fetched(table: DataFrame, *columns: str) -> list[np.ndarray]:
    """One or two long columns on the driver, packed by the tasks: the caller bounds their rows."""
    rows = table.select(*columns).mapInArrow(_bytes, "first binary, last binary").collect()
    return [np.frombuffer(b"".join(r[i] for r in rows), np.int64) for i in (0, 1)[: len(columns)]]


class Sieve:
    """A set of hashes in bounded memory: sorted while there are few, else a bitmap of their upper bits."""

    def __init__(self, values: np.ndarray | None, pages: np.ndarray | None = None):
        self.values, self.pages = values, pages

    @classmethod
    def of(cls, table: DataFrame, column: str, n: int, most: int = DENSE, bits: int = SIEVE_BITS) -> Sieve:
        """From the n rows of a column: at most ``most`` hashes, or 2^(bits - 6) pages of 64 bits, reach the driver."""
        if n <= most:
            return cls(np.sort(fetched(table, column)[0].view(np.uint64)))
        page, bit = F.shiftrightunsigned(column, 64 - bits + 6), F.shiftrightunsigned(column, 64 - bits).bitwiseAND(63)
        rows = table.groupBy(page.alias("page")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit.cast("int"))).alias("bits"))
        at, held = fetched(rows, "page", "bits")
        pages = np.zeros(1 << (bits - 6), np.uint64)
        pages[at] = held.view(np.uint64)
        return cls(None, pages)

    def place(self, h: np.ndarray) -> np.ndarray:
        """Place of each hash in the sorted set, -1 if it is not in it."""
        if not len(self.values):
            return np.full(len(h), -1, np.int64)
        at = np.searchsorted(self.values, h)
        at[at == len(self.values)] = 0
        return np.where(self.values[at] == h, at, -1)

    def has(self, h: np.ndarray) -> np.ndarray:
        """Which hashes are in the set; the bitmap may add some."""
        if self.values is not None:
            return self.place(h) >= 0
        bits = int(len(self.pages)).bit_length() - 1 + 6
        top = h >> np.uint64(64 - bits)
        return (self.pages[top >> np.uint64(6)] >> (top & np.uint64(63))) & np.uint64(1) == 1


def _encoded(seed: int, bits: int, sieve) -> object:
    """One row a slice: the ids of its words, all ones where a piece ends or a word is not in the dictionary."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sieve.value
        dense = held.values is not None
        for part in slices(batches, "text"):
            words = Words(part.column("text"), lower=True, gaps=_GAPS)
            h, _, _ = _hashed(words, part.column("lang"), seed, bits)
            if not len(h):
                continue
            known = held.place(h) if dense else held.has(h)
            ids = known.astype(np.uint32) if dense else np.where(known, h, ~np.uint64(0))  # -1 as all ones
            piece = np.cumsum(_ENDS[words.data])[words.start]
            edge = np.flatnonzero((np.diff(piece) > 0) | (np.diff(words.row) > 0)) + 1
            ids = np.insert(ids, edge, ~ids.dtype.type(0))
            # breaks in a row are one
            gap = ids == ~ids.dtype.type(0)
            keep = ~gap
            keep[1:] |= ~gap[:-1]
            yield pa.RecordBatch.from_arrays([pa.array([ids[keep].tobytes()], pa.binary())], ["ids"])

    return encoded


def radix_order(columns: list[np.ndarray]) -> np.ndarray:
    """The stable order of rows by the columns, first column first: one counting pass for each 16 bits, last ones first."""
    order = np.arange(len(columns[0]))
    for column in reversed(columns):
        for shift in range(0, column.dtype.itemsize * 8, 16):
            digit = ((column >> column.dtype.type(shift)) & column.dtype.type(0xFFFF)).astype(np.uint16)
            if len(digit) and digit.max() > digit.min():
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def run_starts(columns: list[np.ndarray]) -> np.ndarray:
    """Where rows differ from the row before, in sorted columns."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = functools.reduce(np.logical_or, [c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


def _packed(k: int, width: int, sieve, buffer: int) -> object:
    """Keys of k ids with their counts, buffer by buffer."""
    kind = np.dtype(f"u{width}")

    def told(held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        columns = [np.concatenate(c) for c in zip(*held, strict=True)]
        order = radix_order(columns)
        columns = [c[order] for c in columns]
        at = run_starts(columns)
        counts = np.diff(np.append(at, len(order)))
        keys = np.stack([c[at] for c in columns], axis=1).astype(kind.newbyteorder(">"))
        for low in range(0, len(at), 1 << 16):
            some = keys[low : low + (1 << 16)]
            offsets = np.arange(len(some) + 1, dtype=np.int32) * (k * width)
            yield pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(offsets), pa.py_buffer(some.tobytes())]), pa.array(counts[low : low + (1 << 16)])], ["key", "n"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for value in batch.column(0):
                ids = np.frombuffer(value.as_buffer(), kind)
                live = ids != ~kind.type(0)
                size = max(len(ids) - k + 1, 0)
                whole = functools.reduce(np.logical_and, [live[i : i + size] for i in range(k)])
                if sieve is not None and size:
                    # both (k-1)-grams are frequent
                    inner = sieve.value.has(runs_hash(ids.astype(np.uint64), k - 1))
                    whole = whole & inner[:size] & inner[1 : size + 1]
                at = np.flatnonzero(whole)
                for low in range(0, len(at), buffer):
                    some = at[low : low + buffer]
                    held.append([ids[some + i] for i in range(k)])
                    n += len(some)
                    if n >= buffer:
                        yield from told(held)
                        held, n = [], 0
        if n:
            yield from told(held)
        release()

    return packed


def _summed(k: int, width: int, dictionary, least: int) -> object:
    """From sorted keys with counts: the words' hashes, the key's hash and the sum, where it is ``least`` or more."""
    kind = np.dtype(f"u{width}")

    def told(columns: list[np.ndarray], sums: np.ndarray) -> pa.RecordBatch:
        keep = sums >= least
        columns = [c[keep] for c in columns]
        g = np.zeros(0, np.uint64) if not keep.any() else _gram_hash(columns)
        words = [c if dictionary is None else dictionary.value.values[c] for c in columns]
        return pa.RecordBatch.from_arrays([*[pa.array(w.astype(np.uint64).view(np.int64)) for w in words], pa.array(g.view(np.int64)), pa.array(sums[keep])], [*[f"w{i + 1}" for i in range(k)], "g", "n"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0)
            data = np.frombuffer(keys.buffers()[2], np.uint8)
            begin = np.frombuffer(keys.buffers()[1], np.int32)[keys.offset]
            rows = data[begin : begin + batch.num_rows * k * width].view(kind.newbyteorder(">")).reshape(-1, k).astype(kind)
            columns = [rows[:, i] for i in range(k)]
            at = run_starts(columns)
            sums = np.add.reduceat(batch.column(1).to_numpy(), at)
            firsts = rows[at]
            # the run that goes on from the batch before, and the one that may go on in the next
            if last is not None:
                if (firsts[0] == last).all():
                    sums[0] += total
                else:
                    firsts, sums = np.concatenate([last[None], firsts]), np.concatenate([[total], sums])
            last, total = firsts[-1], int(sums[-1])
            yield told([firsts[:-1, i] for i in range(k)], sums[:-1])
        if last is not None:
            yield told([last[None, i] for i in range(k)], np.array([total], np.int64))

    return summed


def _gram_hash(columns: list[np.ndarray]) -> np.ndarray:
    """The hash that ``runs_hash`` gives these ids where they stand one after another."""
    k = len(columns)
    return runs_hash(np.stack(columns, axis=1).astype(np.uint64).ravel(), k)[::k]


def frequent_grams(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = 3, least: int = 10, dense: int = DENSE, bits: int = 64, buffer: int = BUFFER) -> tuple[dict[int, DataFrame], dict[int, int], DataFrame]:
    """Stored tables of frequent k-grams, k = 1 .. longest, their row counts, and all words' total per language.

    k = 1: (w1, lang, word, n); others: (w1 .. wk, g, n), where w are hashes of words.
    """
    spark, rows = docs.sparkSession, _narrow(docs, text, lang)
    words, seed = word_counts(rows, bits)
    tables = {1: stored(words.where(F.col("n") >= least).select(F.col("h").alias("w1"), "lang", "word", "n"), "collocations")}
    totals = stored(words.groupBy("lang").agg(F.sum("n").alias("total")), "collocations")
    dropped(words)
    counts = {1: tables[1].count()}
    known = spark.sparkContext.broadcast(Sieve.of(tables[1], "w1", counts[1], dense))
    width, numbered = (4, known) if counts[1] <= dense else (8, None)
    ids, sieve = stored(rows.mapInArrow(_encoded(seed, bits, known), "ids binary"), "collocations"), None
    for k in range(2, longest + 1):
        part = stored(ids.mapInArrow(_packed(k, width, sieve, buffer), "key binary, n bigint"), "collocations")
        kinds = ", ".join(f"w{i + 1} bigint" for i in range(k)) + ", g bigint, n bigint"
        tables[k] = stored(part.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(_summed(k, width, numbered, least), kinds), "collocations")
        counts[k] = tables[k].count()
        dropped(part)
        if sieve is not None:
            sieve.destroy()
        sieve = spark.sparkContext.broadcast(Sieve.of(tables[k], "g", counts[k], dense)) if k < longest else None
    known.destroy()
    dropped(ids)
    return tables, counts, totals


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (l * r)) in whole numbers."""
    wide = lambda c: c.cast("decimal(15,0)")
    above, below = (wide(a) * wide(a) * F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(38,0)"), wide(left) * wide(right)
    return ((above - above % below) / below).cast("long")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = 3, least: int = 10, share: int = 50, top: int = 2000, **options) -> DataFrame:
    """Rows (lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases of 2 to ``longest`` words.

    a counts the phrase, l and r its parts at the cut of the lowest score (the
    earliest such cut), n all words of the language.  Phrases inside a longer
    frequent one of at least ``share`` percent of their count are dropped.
    """
    tables, counts, totals = frequent_grams(docs, text, lang, longest, least, **options)
    held = lambda k: small(tables[k], counts[k], 200_000)
    out = []
    for k in range(2, longest + 1):
        names = [f"w{i + 1}" for i in range(k)]
        grams = tables[k].select(*names, F.col("n").alias("a"))
        for cut in range(1, k):
            for side, low, high in (("l", 0, cut), ("r", cut, k)):
                part = held(high - low).select(*[F.col(f"w{i + 1}").alias(f"_{i}") for i in range(high - low)], F.col("n").alias(f"{side}{cut}"))
                grams = grams.join(part, [F.col(names[low + i]) == F.col(f"_{i}") for i in range(high - low)]).drop(*[f"_{i}" for i in range(high - low)])
        cuts = [F.struct(_score(F.col("a"), F.col(f"l{c}"), F.col(f"r{c}")).alias("score"), F.lit(c).alias("cut"), F.col(f"l{c}").alias("l"), F.col(f"r{c}").alias("r")) for c in range(1, k)]
        grams = grams.select(*names, "a", F.array_min(F.array(*cuts)).alias("best"))
        inner = [tables[m].select(*[F.col(f"w{o + i + 1}").alias(f"_{i}") for i in range(k)], F.col("n").alias("_n")) for m in range(k + 1, longest + 1) for o in range(m - k + 1)]
        if inner:
            around = functools.reduce(DataFrame.union, inner).groupBy(*[f"_{i}" for i in range(k)]).agg(F.max("_n").alias("_n"))
            grams = grams.join(around, [F.col(n) == F.col(f"_{i}") for i, n in enumerate(names)], "left").where(F.coalesce(100 * F.col("_n") < share * F.col("a"), F.lit(True)))
        for i, name in enumerate(names):
            grams = grams.join(held(1).select(F.col("w1").alias("_w"), F.col("lang").alias(f"lang{i}"), F.col("word").alias(f"word{i}")), F.col(name) == F.col("_w")).drop("_w")
        out.append(grams.select(F.col("lang0").alias("lang"), F.concat_ws(" ", *[f"word{i}" for i in range(k)]).alias("phrase"), "a", "best.l", "best.r", "best.score"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    phrases = functools.reduce(DataFrame.union, out).withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS)))
    # a language's best are among its parts' best
    near = phrases.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).where(F.col("rank") <= top)
    best = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    told = totals.select(F.col("lang").alias("_lang"), F.col("total").alias("n"))
    return best.join(small(told, told.count()), F.col("lang") == F.col("_lang")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
