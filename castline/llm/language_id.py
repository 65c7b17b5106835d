"""Language identification by interpolated Kneser-Ney character models.

A text is read as its letters, lower-cased, with every run of other characters
as one boundary symbol.  Each language gets an interpolated Kneser-Ney model of
order 4 (absolute discount per order, continuation counts below the top).
The languages share one set of tables: for each order the grams any language
has seen with the log probability in every language, and the contexts with
their back-off weights, both as arrays sorted by a 64-bit hash with an index on
its leading bits.  A gram no language has seen backs off order by order.

The prediction is the language of lowest cross-entropy per symbol.  Its score is
a softmax over the cross-entropies with a scale fitted on a calibration sample.
A document is rejected if its cross-entropy lies more than ``REJECT_Z`` deviations,
for its length, above what the calibration documents of that language have.

Learning takes a hash sample of about ``TRAIN_DOCS`` documents of each language,
and calibration another of ``CALIBRATION_DOCS``; whole texts, no other column.

Defined results: texts that are null, empty or without a letter are ``und`` with
score 0 and are rejected; where nothing was learned all are ``und``; ties go to the
language that sorts first; rows that repeat are predicted alike; an empty table
gives no rows; columns other than those named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textscan import mix, slices

ORDER, SYMBOL_BITS = 4, 14
TRAIN_DOCS, CALIBRATION_DOCS = 500, 150
#: Labelled documents under which a language is learned from all of them and never rejects.
FEW_DOCS = 40
REJECT_Z = 10.0
#: The least deviation of one symbol: a calm calibration sample must not turn clean documents away.
LEAST_SPREAD = 1.2
SLICE, BLOCK = 1 << 18, 1 << 15
UNKNOWN = "und"


def _symbol_table() -> np.ndarray:
    """For each code point of the first plane its symbol, 0 if it is no letter."""
    out = np.zeros(1 << 16, np.uint16)
    for cp in range(1 << 16):
        c = chr(cp)
        if c.isalpha():
            low = c.lower()
            out[cp] = fold(ord(low) if len(low) == 1 else cp)
    return out


def fold(cp: int) -> int:
    """Scripts below U+3000 keep their code points; the rest share 4,096 symbols."""
    return cp if cp < 0x3000 else 0x3000 + cp % 0x1000


_table: list[np.ndarray] = []


def symbols(texts: pa.Array, pad: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbol stream with ``pad`` boundaries before each row; positions of real symbols; their rows; letters of each row."""
    if not _table:
        _table.append(_symbol_table())
    strings = [t + " " if t else " " for t in texts.to_pylist()]
    lengths = np.array([len(s) for s in strings], np.int64)
    cps = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32)
    del strings
    sym = _table[0][np.minimum(cps, 0xFFFF)]
    high = np.flatnonzero(cps > 0xFFFF)
    if len(high):
        found, inverse = np.unique(cps[high], return_inverse=True)
        sym[high] = np.array([fold(int(c)) if chr(c).isalpha() else 0 for c in found], np.uint16)[inverse]
    del cps
    keep = sym > 0
    first = np.cumsum(lengths) - lengths
    count = lambda mask: np.add.reduceat(mask, first, dtype=np.int64) if len(first) else np.zeros(0, np.int64)
    letters = count(keep)
    # the symbol after a letter closes its run; every row ends in one that is none
    keep[1:] |= sym[:-1] > 0
    per_row = count(keep)
    row = np.repeat(np.arange(len(lengths), dtype=np.int32), per_row)
    at = (np.arange(len(row), dtype=np.int64) + pad * (row + 1).astype(np.int64)).astype(np.int32 if len(row) < 1 << 30 else np.int64)
    stream = np.zeros(len(row) + pad * len(lengths), np.uint16)
    stream[at] = sym[keep]
    return stream, at, row, letters


def packed(stream: np.ndarray, at: np.ndarray, order: int = ORDER) -> np.ndarray:
    """The symbols at the positions and the order - 1 before them in one integer, newest lowest."""
    out = np.zeros(len(at), np.uint64)
    for back in range(order - 1, -1, -1):
        out = (out << np.uint64(SYMBOL_BITS)) | stream[at - back]
    return out


@dataclass
class HashTable:
    """Rows of values by key; keys sorted by hash, the first row of each leading-bits bucket indexed."""

    hashes: np.ndarray
    values: np.ndarray
    first: np.ndarray
    shift: int

    @staticmethod
    def of(keys: np.ndarray, values: np.ndarray) -> HashTable:
        h = mix(keys)
        order = np.argsort(h)
        h = h[order]
        bits = max(4, int(len(keys)).bit_length())
        ends = np.cumsum(np.bincount((h >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits))
        held = np.zeros((len(keys) + 1, values.shape[1]), np.float32)
        held[:-1] = values[order]
        return HashTable(np.append(h, np.uint64((1 << 64) - 1)), held, np.append(0, ends[:-1]).astype(np.int32), 64 - bits)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, -1 if it has none."""
        h = mix(keys)
        at = self.first[(h >> np.uint64(self.shift)).astype(np.int64)].astype(np.int64)
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        while len(open_):
            here = self.hashes[at]
            hit = (here == h) & (at < len(self.hashes) - 1)
            out[open_[hit]] = at[hit]
            more = here < h
            open_, at, h = open_[more], at[more] + 1, h[more]
        return out


@dataclass
class Model:
    languages: list[str]
    grams: list[HashTable]
    contexts: list[HashTable]
    floor: np.ndarray
    scale: float = 1.0
    mean: np.ndarray | None = None
    spread: np.ndarray | None = None

    def symbol_logs(self, stream: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Natural log probability of each symbol in each language."""
        out = np.zeros((len(at), len(self.languages)), np.float32)
        left = np.arange(len(at))
        for k in range(ORDER, 0, -1):
            key = packed(stream, at[left], k)
            row = self.grams[k].find(key)
            hit = row >= 0
            out[left[hit]] += self.grams[k].values[row[hit]]
            left, key = left[~hit], key[~hit]
            if not len(left):
                return out
            row = self.contexts[k].find(key >> np.uint64(SYMBOL_BITS))
            out[left] += np.where((row >= 0)[:, None], self.contexts[k].values[row], 0)
        out[left] += self.floor
        return out

    def cross_entropy(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Nats per symbol of each row in each language, and the rows' numbers of symbols (0 without letters)."""
        stream, at, row, letters = symbols(texts, ORDER - 1)
        n = np.bincount(row, minlength=len(texts))
        sums = np.zeros((len(texts), len(self.languages)))
        for low in range(0, len(at), BLOCK):
            here = row[low : low + BLOCK]
            logs = self.symbol_logs(stream, at[low : low + BLOCK])
            for j in range(len(self.languages)):
                sums[here[0] : here[-1] + 1, j] += np.bincount(here - here[0], logs[:, j])
        return -sums / np.maximum(n, 1)[:, None], np.where(letters > 0, n, 0)

    def rejected(self, h: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Rows without letters, and those whose best cross-entropy is too far from the calibration documents'."""
        best = h.argmin(1)
        odd = h[np.arange(len(h)), best] - self.mean[best] > REJECT_Z * self.spread[best] / np.sqrt(np.clip(n, 1, 400))
        return (n == 0) | odd


def kneser_ney(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
    """The model from each language's distinct grams of the top order and their counts."""
    languages = sorted(counts)
    bits = np.uint64(SYMBOL_BITS)
    per: dict[str, dict[int, tuple[np.ndarray, np.ndarray]]] = {}
    for name in languages:
        grams, n = counts[name]
        order = np.argsort(grams)
        per[name] = {ORDER: (grams[order], n[order].astype(np.float64))}
        for k in range(ORDER - 1, 0, -1):
            mask = np.uint64((1 << (SYMBOL_BITS * k)) - 1)
            # distinct grams one symbol longer: the continuation counts
            per[name][k] = tuple(x if i == 0 else x.astype(np.float64) for i, x in enumerate(np.unique(per[name][k + 1][0] & mask, return_counts=True)))
    alphabet = len(np.unique(np.concatenate([per[name][1][0] for name in languages]))) + 1
    below_keys, below = np.zeros(1, np.uint64), np.full((1, len(languages)), 1.0 / alphabet)
    gram_tables: list = [None] * (ORDER + 1)
    context_tables: list = [None] * (ORDER + 1)
    floor = np.zeros(len(languages))
    for k in range(1, ORDER + 1):
        keys = np.unique(np.concatenate([per[name][k][0] for name in languages]))
        contexts = np.unique(keys >> bits)
        p, gamma = np.zeros((len(keys), len(languages))), np.ones((len(contexts), len(languages)))
        for j, name in enumerate(languages):
            grams, n = per[name][k]
            once, twice = (n == 1).sum(), (n == 2).sum()
            discount = once / (once + 2 * twice) if once and twice else 0.5
            at = np.searchsorted(contexts, grams >> bits)
            total, kinds = np.bincount(at, n, len(contexts)), np.bincount(at, minlength=len(contexts))
            seen = total > 0
            gamma[seen, j] = discount * kinds[seen] / total[seen]
            p[np.searchsorted(keys, grams), j] = np.maximum(n - discount, 0) / total[at]
        suffix = keys & np.uint64((1 << (SYMBOL_BITS * (k - 1))) - 1)
        # with no context the symbol backs off to the uniform distribution
        lower = below[np.searchsorted(below_keys, suffix)] if k > 1 else np.repeat(below, len(keys), 0)
        p += gamma[np.searchsorted(contexts, keys >> bits)] * lower
        gram_tables[k], context_tables[k] = HashTable.of(keys, np.log(p)), HashTable.of(contexts, np.log(gamma))
        below_keys, below = keys, p
    floor[:] = -np.log(alphabet)
    return Model(languages, gram_tables, context_tables, floor)


def _rows(docs: DataFrame, key: str, text: str, lang: str | None) -> DataFrame:
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text"), (F.col(lang) if lang else F.lit(None)).cast("string").alias("lang"))


def _hash_sample(labelled: DataFrame, per_language: dict[str, int], size: int, salt: int) -> DataFrame:
    """About ``size`` rows of each language by a hash of the key; the salts' samples are disjoint parts of the hash range."""
    u = F.pmod(F.xxhash64(F.lit("lang-id"), "key"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    low = 0.0 if salt == 0 else 0.75
    span = 0.75 if salt == 0 else 0.25
    keep = F.lit(False)
    for name, n in per_language.items():
        # a rare language is learned from all it has and not calibrated, so nothing predicted as it is rejected
        mine = F.lit(salt == 0) if n < FEW_DOCS else (u >= low) & (u < low + span * min(1.0, size / n / span))
        keep = keep | ((F.col("lang") == name) & mine)
    return labelled.where(keep)


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text", SLICE):
        stream, at, row, _ = symbols(part.column("text"), ORDER - 1)
        names = np.array(part.column("lang").to_pylist(), object)
        for name in np.unique(names):
            grams, n = np.unique(packed(stream, at[names[row] == name]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(grams), pa.string()), pa.array(grams.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])


def _entropies(model) -> object:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE):
            h, n = model.value.cross_entropy(part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column("lang"), pa.array(n, pa.int64()), pa.array(list(h.astype(np.float64)), pa.list_(pa.float64()))], ["lang", "n", "h"])

    return score


def train(docs: DataFrame, use: Column, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model | None:
    """The calibrated model learned from the rows of docs where ``use`` holds; None if no row can teach it."""
    spark = docs.sparkSession
    labelled = _rows(docs.where(use), key, text, lang).where("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    counts = _hash_sample(labelled, sizes, TRAIN_DOCS, 0).mapInArrow(_count_grams, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    if not len(counts):
        return None
    model = kneser_ney({name: (g["gram"].to_numpy(np.int64).view(np.uint64), g["n"].to_numpy()) for name, g in counts.groupby("lang")})
    shared = spark.sparkContext.broadcast(model)
    shown = _hash_sample(labelled, sizes, CALIBRATION_DOCS, 1).mapInArrow(_entropies(shared), "lang string, n bigint, h array<double>").where("n > 0").toPandas()
    shared.destroy()
    calibrate(model, shown["lang"].tolist(), shown["n"].to_numpy(np.int64), np.array(shown["h"].tolist()).reshape(len(shown), len(model.languages)))
    return model


def calibrate(model: Model, langs: list[str], n: np.ndarray, h: np.ndarray) -> None:
    """Fits the softmax scale by log loss, and each language's mean cross-entropy and deviation for one symbol."""
    k = len(model.languages)
    model.mean, model.spread = np.full(k, np.inf), np.zeros(k)
    own = np.array([model.languages.index(x) if x in model.languages else -1 for x in langs], np.int64)
    ok = own >= 0
    own, n, h = own[ok], n[ok], h[ok]
    if not len(own):
        return
    losses = []
    scales = [0.5, 1, 2, 4, 8, 16, 32, 64]
    for scale in scales:
        logits = -scale * (h - h.min(1, keepdims=True))
        losses.append(float(np.mean(np.log(np.exp(logits).sum(1)) - logits[np.arange(len(own)), own])))
    model.scale = float(scales[int(np.argmin(losses))])
    for j in range(k):
        mine = own == j
        if mine.sum() >= 8:
            model.mean[j] = np.median(h[mine, j])
            # a floor on the length keeps single odd words from being judged too sharply
            model.spread[j] = max(float(np.sqrt(np.mean((h[mine, j] - model.mean[j]) ** 2 * np.minimum(n[mine], 400)))), LEAST_SPREAD)


def _predict(model) -> object:
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        names = np.array([*m.languages, UNKNOWN], object)
        for part in slices(batches, "text", SLICE):
            h, n = m.cross_entropy(part.column("text"))
            best = h.argmin(1)
            low = h[np.arange(len(h)), best]
            score = 1 / np.exp(-m.scale * (h - low[:, None])).sum(1)
            known = n > 0
            yield pa.RecordBatch.from_arrays(
                [part.column("key"), part.column("held_out"), pa.array(names[np.where(known, best, len(names) - 1)].tolist(), pa.string()), pa.array(np.where(known, score, 0.0)), pa.array(low, mask=~known), pa.array(m.rejected(h, n))],
                ["key", "held_out", "lang_pred", "score", "cross_entropy", "rejected"],
            )

    return predict


def identify(docs: DataFrame, model: Model | None, held_out: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, held_out, lang_pred, score, cross_entropy, rejected) for every row of docs."""
    held = docs.select(F.col(key).cast("long").alias("key"), held_out.alias("held_out"), F.col(text).alias("text"))
    if model is None:
        return held.select(F.col("key").alias(key), "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("cross_entropy"), F.lit(True).alias("rejected"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = held.mapInArrow(_predict(shared), "key bigint, held_out boolean, lang_pred string, score double, cross_entropy double, rejected boolean")
    return out.withColumnRenamed("key", key)


def keep_identified(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """The rows of docs that the model does not reject, all columns as they are; without a model every row stays."""
    if model is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text, SLICE):
            h, n = shared.value.cross_entropy(part.column(part.schema.get_field_index(text)))
            yield part.filter(pa.array(~shared.value.rejected(h, n)))

    return docs.mapInArrow(keep, docs.schema)
