"""Scoring texts by context-tree weighting, with a token unigram base score.

Texts are read as A-Z lower-cased words joined by one space and one end symbol,
the same tokens the base score counts; the model codes the bytes of that
string.

1. Every training document adds its (depth + 1)-byte grams; a task folds its
   grams and sends each once with a count, and Spark sums them.
2. The grams are dealt to subtrees of the context tree by their newest context
   bytes, two or, where more than SUBTREE grams share them, more.  A task weighs
   a few whole subtrees at a time (``ctw.Subtree``); only sums over subtrees
   come to the driver, for the contexts above them (``ctw.Upper``).  Contexts
   count from ``least`` occurrences on, a fixed number: the tree grows with the
   corpus, and nothing in it is capped.
3. The HOT most frequent grams, a fixed number, are broadcast with their scores.
   All other bytes of the documents travel to their subtree, packed by task, are
   scored there, and only sums by document return.  The list only decides which
   way a byte's score travels, never its value.
4. Words go the same two ways: a list of WORDS hashes at most, taken from a
   bounded sample, is counted exactly and broadcast; all others are counted by a
   map-side sum and joined.

Defined results: a null or empty text is only its end token; a null key counts
as the empty id text; rows that repeat a key are scored each; an empty table
gives no rows; other columns are not read.  A task holds about ten bytes for
each byte of the longest text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ctw
from .language_id import HashTable
from .shared import dropped, small, stored
from .textscan import Words, is_space, mix, slices

DEPTH, LEAST = 6, 2
#: Grams of a subtree up to which it stays whole, and of a bundle of subtrees; both grow where there were more than BUNDLES.
SUBTREE, BUNDLE, BUNDLES = 1 << 16, 1 << 17, 2048
#: Grams scored by broadcast; bytes of a bundle scored in one group.
HOT, GROUP = 1 << 20, 1 << 22
WORDS, SAMPLE_DOCS = 1 << 17, 4096
SLICE, BLOCK = 1 << 19, 1 << 16


def id_crc(key: Column) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))


def coded(words: Words, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """All rows' strings, each after ``depth`` end symbols and closed by one; where each row begins, and the whole length."""
    inside = ~is_space(words.data)
    gaps = words.end[:-1][words.row[1:] == words.row[:-1]]
    keep = inside.copy()
    keep[gaps] = True
    flat = np.where(inside, words.data, np.uint8(0x20))[keep]
    size = np.bincount(words.row, words.end - words.start + 1, len(words.count)).astype(np.int64)
    size = np.maximum(size, 1)
    begin = np.concatenate([[0], np.cumsum(size + depth)])
    out = np.full(int(begin[-1]), ctw.END, np.uint8)
    done = 0
    for at, n in zip((begin[:-1] + depth).tolist(), (size - 1).tolist(), strict=True):
        out[at : at + n] = flat[done : done + n]
        done += n
    return out, begin


def grams(text: np.ndarray, begin: np.ndarray, depth: int, block: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Packed grams of the coded bytes and their rows, a block of positions at a time."""
    for low in range(depth, len(text), block):
        high = min(low + block, len(text))
        out = np.zeros(high - low, np.int64)
        for back in range(1, depth + 1):
            out = out << 8 | text[low - back : high - back]
        out = out << 8 | text[low:high]
        first, last = np.searchsorted(begin, [low, high - 1], "right") - 1
        edges = np.clip(begin[first : last + 2], low, high)
        edges[0], edges[-1] = low, high
        row = np.repeat(np.arange(first, last + 1), np.diff(edges))
        real = np.arange(low, high) - begin[row] >= depth
        yield out[real], row[real]


def _fold(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    return ctw.summed(np.concatenate([k for k, _ in parts]), np.concatenate([n for _, n in parts]))


def _count(depth: int, frequent) -> object:
    """Folded rows of a task: (0, gram, n), (1, place in the frequent list, n), (2, 0, tokens), (3, 0, documents)."""

    def rows(kind: int, key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int8)), pa.array(key.astype(np.int64)), pa.array(n.astype(np.int64))], ["kind", "k", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = frequent.value
        seen, held = np.zeros(len(hot), np.int64), []
        tokens = docs = loose = 0
        for part in slices(batches, "text", SLICE):
            words = Words(part.column("text"), lower=True)
            for block, _ in grams(*coded(words, depth), depth, SLICE):
                held.append(np.unique(block, return_counts=True))
                loose += len(held[-1][0])
            if loose > max(SLICE, 2 * len(held[0][0])):
                held, loose = [_fold(held)], 0
            if len(hot):
                at = np.minimum(np.searchsorted(hot, words.hash), len(hot) - 1)
                seen += np.bincount(at[hot[at] == words.hash], minlength=len(hot))
            tokens += len(words.start) + part.num_rows
            docs += part.num_rows
            if len(held) == 1 and len(held[0][0]) > 2 * SLICE:
                yield rows(0, *held.pop())
        if held:
            yield rows(0, *_fold(held))
        if docs:
            yield rows(1, np.flatnonzero(seen), seen[seen > 0])
            yield rows(2, np.zeros(1), np.array([tokens]))
            yield rows(3, np.zeros(1), np.array([docs]))

    return count


def frequent_words(docs: DataFrame, sample: int = SAMPLE_DOCS, limit: int = WORDS) -> np.ndarray:
    """Sorted hashes of the words most frequent in a hash sample of about ``sample`` documents."""
    every = max(1, docs.count() // sample)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE):
            found, n = np.unique(Words(part.column("text"), lower=True).hash, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], ["w", "n"])

    picked = docs.where(F.pmod(F.xxhash64("key", F.lit(9)), F.lit(every)) == 0)
    counts = picked.select("text").mapInArrow(count, "w bigint, n bigint").groupBy("w").agg(F.sum("n").alias("n")).where("n >= 2")
    top = counts.orderBy(F.desc("n"), "w").limit(limit).select("w").toPandas()["w"]
    return np.sort(top.to_numpy(np.int64).view(np.uint64))


def _context(d: int, depth: int) -> Column:
    """The d newest context bytes of a gram k."""
    return F.shiftright("k", 8 + 8 * (depth - d))


class Roots:
    """The subtree of each gram: the shortest context, of two bytes or more, that was not split; subtrees are dealt to bundles."""

    def __init__(self, depth: int, split: dict[int, np.ndarray], bundles: int):
        self.depth, self.split, self.bundles = depth, split, bundles

    @staticmethod
    def of(counted: DataFrame, depth: int, subtree: int, bundle: int) -> Roots:
        """Splits contexts of more than ``subtree`` grams; at most BUNDLES of a depth come to the driver."""
        total = counted.count()
        limit, split, inside = max(subtree, total // BUNDLES), {}, counted.select("k")
        for d in range(2, depth):
            sizes = inside.groupBy(_context(d, depth).alias("c")).agg(F.count("*").alias("n")).where(F.col("n") > limit)
            found = sizes.select("c").toPandas()["c"].to_numpy(np.int64)
            if not len(found):
                break
            split[d] = np.sort(found)
            inside = inside.join(F.broadcast(counted.sparkSession.createDataFrame([(int(c),) for c in found], "c bigint")), _context(d, depth) == F.col("c"), "left_semi")
        return Roots(depth, split, total // max(bundle, total // BUNDLES) + 1)

    def shard(self, grams: np.ndarray) -> np.ndarray:
        """The bundle of each gram; its lowest three bits are the depth of the roots."""
        top, open_ = np.full(len(grams), 2), np.arange(len(grams))
        for d in sorted(self.split):
            open_ = open_[ctw.place(self.split[d], grams[open_] >> (8 + 8 * (self.depth - d)))[1]]
            top[open_] = d + 1
        root = grams >> (8 + 8 * (self.depth - top))
        return (mix(root.astype(np.uint64)) % np.uint64(self.bundles)).astype(np.int64) << 3 | top


_UP = "shard bigint, parent bigint, cell int, value double, grams binary, counts binary"


def _weigh(roots: Roots, least: int) -> object:
    """A bundle's sums for the contexts above its subtrees, and its grams packed in one row."""

    def weigh(frame: pd.DataFrame) -> pd.DataFrame:
        shard = int(frame["shard"].iloc[0])
        grams, n = ctw.summed(frame["k"].to_numpy(np.int64), frame["n"].to_numpy(np.int64))
        parent, cell, value = ctw.Subtree(grams, n, shard & 7, roots.depth, least).upward()
        up = pd.DataFrame({"shard": shard, "parent": parent, "cell": cell.astype(np.int32), "value": value, "grams": None, "counts": None})
        return pd.concat([up, pd.DataFrame({"shard": [shard], "parent": [0], "cell": [-1], "value": [0.0], "grams": [grams.tobytes()], "counts": [n.tobytes()]})])

    return weigh


def upper_contexts(counted: DataFrame, weighed: DataFrame, roots: Roots, least: int) -> ctw.Upper:
    """The contexts above the roots; at most 512 rows for each of them come to the driver."""
    depth, contexts, counts, sums, kept = roots.depth, {}, {}, {}, {}
    up = weighed.where("cell >= 0").groupBy((F.col("shard").bitwiseAND(F.lit(7)) - 1).alias("d"), "parent", "cell").agg(F.sum("value").alias("value")).toPandas()
    for d in (0, 1, *sorted(roots.split)):
        rows = counted
        if d > 1:
            listed = counted.sparkSession.createDataFrame([(int(c),) for c in roots.split[d]], "c bigint")
            rows = counted.join(F.broadcast(listed), _context(d, depth) == F.col("c"), "left_semi")
        rows = rows.groupBy((_context(d, depth) if d else F.lit(0)).cast("long").alias("c"), F.col("k").bitwiseAND(F.lit(255)).alias("x")).agg(F.sum("n").alias("n")).toPandas()
        found, place = np.unique(rows["c"].to_numpy(np.int64), return_inverse=True)
        dense = np.zeros((len(found), 256), np.int64)
        dense[place, rows["x"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
        enough = dense.sum(1) >= least
        contexts[d], counts[d] = (found[enough], dense[enough]) if d else (np.zeros(1, np.int64), dense if len(dense) else np.zeros((1, 256), np.int64))
        sums[d], kept[d] = np.zeros((len(contexts[d]), 255)), np.zeros((len(contexts[d]), 256), np.int64)
        mine = up[up["d"] == d]
        row, cell, value = ctw.place(contexts[d], mine["parent"].to_numpy(np.int64))[0], mine["cell"].to_numpy(np.int64), mine["value"].to_numpy(float)
        low = cell < 256
        sums[d][row[low], cell[low]] = value[low]
        kept[d][row[~low], cell[~low] - 256] = value[~low].astype(np.int64)
    return ctw.Upper(contexts, counts, sums, kept)


def _settled(shard: int, grams: bytes | None, counts: bytes | None, depth: int, least: int, upper: ctw.Upper) -> ctw.Subtree:
    tree = ctw.Subtree(np.frombuffer(grams or b"", np.int64), np.frombuffer(counts or b"", np.int64), shard & 7, depth, least)
    tree.settle(upper)
    return tree


def _hot_scores(depth: int, least: int, often: int, upper) -> object:
    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, grams, counts in zip(*(batch.column(c).to_pylist() for c in ("shard", "grams", "counts")), strict=True):
                keys = np.frombuffer(grams, np.int64)[np.frombuffer(counts, np.int64) >= often]
                if len(keys):
                    logs = _settled(shard, grams, counts, depth, least, upper.value).score(keys).astype(np.float32)
                    yield pa.RecordBatch.from_arrays([pa.array([keys.tobytes()]), pa.array([logs.tobytes()])], ["k", "score"])

    return scores


def frequent_grams(packed: DataFrame, counted: DataFrame, depth: int, least: int, upper, hot: int) -> HashTable:
    """The scores of the grams most frequent in training, at most ``hot`` of them."""
    # steps of a quarter in log2
    step = F.floor(F.log2("n") * 4).cast("long")
    sizes = counted.groupBy(step.alias("s")).agg(F.count("*").alias("c")).orderBy(F.desc("s")).collect()
    often, total = 1 << 62, 0
    for r in sizes:
        total += r["c"]
        if total > hot:
            break
        often = math.ceil(2 ** (r["s"] / 4) - 1e-9)
    # at most ``hot`` grams of 12 bytes, packed by bundle
    found = packed.select("shard", "grams", "counts").mapInArrow(_hot_scores(depth, least, often, upper), "k binary, score binary").toArrow()
    keys, logs = (np.frombuffer(b"".join(found.column(c).to_pylist()), t) for c, t in (("k", np.uint64), ("score", np.float32)))
    return HashTable.of(keys, logs[:, None])


_SCORED = "word bigint, uid bigint, m int, train boolean, doc bigint, n_tokens bigint, n_known bigint, listed double, score double, shard bigint, n bigint, grams binary, docs binary"


def _score(roots: Roots, model) -> object:
    """Sums of each document (word and shard null), a row for each word off the list and document, and packed grams off the list by bundle."""
    names = [c.split()[0] for c in _SCORED.split(", ")]
    types = {"bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "double": pa.float64(), "binary": pa.binary()}
    kinds = {c.split()[0]: types[c.split()[1]] for c in _SCORED.split(", ")}

    def rows(size: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[c], kinds[c]) if c in columns else pa.nulls(size, kinds[c]) for c in names], names)

    def packed(cold: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        if cold:
            keys, uid = np.concatenate([k for k, _ in cold]), np.concatenate([u for _, u in cold])
            order = np.argsort(keys, kind="stable")
            keys, uid = keys[order], uid[order]
            shard = roots.shard(keys)
            order = np.argsort(shard, kind="stable")
            keys, uid, shard = keys[order], uid[order], shard[order]
            head = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))
            ends = np.append(head[1:], len(shard))
            base = int(uid.min())
            small_ids = (uid - base).astype(np.uint32)
            yield rows(len(head), shard=shard[head], uid=np.full(len(head), base), n=ends - head, grams=[keys[a:b].tobytes() for a, b in zip(head, ends)], docs=[small_ids[a:b].tobytes() for a, b in zip(head, ends)])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, hot, hot_counts = model.value
        listed = np.log10(hot_counts + 1.0)
        cold, waiting = [], 0
        for part in slices(batches, "text", SLICE):
            n = part.num_rows
            words = Words(part.column("text"), lower=True)
            uid, train = np.asarray(part.column("uid"), np.int64), np.asarray(part.column("train").cast(pa.int8()), np.int8).astype(bool)
            sums = np.zeros(n)
            for keys, row in grams(*coded(words, roots.depth), roots.depth, BLOCK):
                at = table.find(keys.view(np.uint64))
                hit = at >= 0
                first = int(row[0]) if len(row) else 0
                part_sums = np.bincount(row[hit] - first, table.values[at[hit], 0].astype(float))
                sums[first : first + len(part_sums)] += part_sums
                if not hit.all():
                    cold.append((keys[~hit], uid[row[~hit]]))
                    waiting += len(cold[-1][0])
            h = words.hash
            place = np.minimum(np.searchsorted(hot, h), max(len(hot) - 1, 0))
            on = hot[place] == h if len(hot) else np.zeros(len(h), bool)
            base = np.bincount(words.row[on], listed[place[on]], n)
            known = np.bincount(words.row[on], hot_counts[place[on]] > 0, n).astype(np.int64)
            yield rows(n, uid=uid, train=train, doc=part.column("doc"), n_tokens=words.count + 1, n_known=known, listed=base, score=sums)
            off_row, off = words.row[~on], h[~on]
            order = np.lexsort((off, off_row))
            off_row, off = off_row[order], off[order]
            if len(off):
                head = np.flatnonzero(np.append(True, (off[1:] != off[:-1]) | (off_row[1:] != off_row[:-1])))
                r = off_row[head]
                yield rows(len(head), word=off[head].view(np.int64), uid=uid[r], m=np.diff(np.append(head, len(off))).astype(np.int32), train=train[r])
            if waiting >= 1 << 20:
                yield from packed(cold)
                cold, waiting = [], 0
        yield from packed(cold)

    return score


def _score_bundle(depth: int, least: int, upper) -> object:
    """Sums by document of the packed grams of a bundle."""

    def score(asked: pa.Table, model: pa.Table) -> pa.Table:
        uids, sums = [], []
        if asked.num_rows:
            shard = asked.column("shard")[0].as_py()
            held = (model.column("grams")[0].as_py(), model.column("counts")[0].as_py()) if model.num_rows else (None, None)
            tree = _settled(shard, *held, depth, least, upper.value)
            for base, grams, docs in zip(*(asked.column(c).to_pylist() for c in ("uid", "grams", "docs")), strict=True):
                keys, place = np.unique(np.frombuffer(grams, np.int64), return_inverse=True)
                offset = np.frombuffer(docs, np.uint32).astype(np.int64)
                found, doc = np.unique(offset, return_inverse=True)
                uids.append(base + found)
                sums.append(np.bincount(doc, tree.score(keys)[place]))
        join = lambda parts, kind: pa.array(np.concatenate(parts) if parts else [], kind)
        return pa.table({"uid": join(uids, pa.int64()), "part": join(sums, pa.float64())})

    return score


def score_texts(docs: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text", depth: int = DEPTH, least: int = LEAST, hot: int = HOT, subtree: int = SUBTREE, bundle: int = BUNDLE) -> DataFrame:
    """Rows (key, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of docs; logs to base 10."""
    spark = docs.sparkSession
    share = spark.sparkContext.broadcast
    held = docs.select(F.col(key).cast("long").alias("key"), (~held_out).alias("train"), F.col(text).alias("text"))
    listed = frequent_words(held)
    listed_there = share(listed)
    counted = held.where("train").select("text").mapInArrow(_count(depth, listed_there), "kind tinyint, k bigint, n bigint")
    counted = stored(counted.groupBy("kind", "k").agg(F.sum("n").alias("n")), "lm-scoring")
    listed_there.destroy()
    totals = {r["kind"]: r["n"] for r in counted.where("kind > 1").collect()}
    tokens, ends = totals.get(2, 0), totals.get(3, 0)
    grams_of = counted.where("kind = 0").select("k", "n")
    roots = Roots.of(grams_of, depth, subtree, bundle)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(roots.shard(np.asarray(batch.column("k"), np.int64))), batch.column("k"), batch.column("n")], ["shard", "k", "n"])

    weighed = stored(grams_of.mapInArrow(dealt, "shard bigint, k bigint, n bigint").groupBy("shard").applyInPandas(_weigh(roots, least), _UP), "lm-subtrees")
    packed = weighed.where("cell < 0").select("shard", "grams", "counts")
    upper = share(upper_contexts(grams_of, weighed, roots, least))
    table = frequent_grams(packed, grams_of, depth, least, upper, hot)
    listed_counts = np.zeros(len(listed), np.int64)
    frame = counted.where("kind = 1").select("k", "n").toPandas()
    listed_counts[frame["k"].to_numpy(np.int64)] = frame["n"].to_numpy(np.int64)
    dropped(counted)
    model = share((table, listed, listed_counts))
    rows = held.select(F.monotonically_increasing_id().alias("uid"), "train", F.col("key").alias("doc"), "text").mapInArrow(_score(roots, model), _SCORED)
    rows = stored(rows, "lm-rows")
    model.destroy()
    # grams off the list, bundle by bundle; a bundle with many is scored in several groups
    asked = rows.where("shard is not null").select("shard", "uid", "n", "grams", "docs")
    salts = asked.groupBy("shard").agg(F.ceil(F.sum("n") / GROUP).cast("long").alias("salts"))
    salted = asked.join(F.broadcast(salts), "shard").withColumn("salt", F.pmod(F.xxhash64("uid"), F.col("salts")))
    spread = packed.join(F.broadcast(salts), "shard").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)))
    cogrouped = salted.drop("n", "salts").groupBy("shard", "salt").cogroup(spread.drop("salts").groupBy("shard", "salt"))
    cold = cogrouped.applyInArrow(_score_bundle(depth, least, upper), "uid bigint, part double").groupBy("uid").agg(F.sum("part").alias("part"))
    # words off the list
    words = rows.where("word is not null").select("word", "uid", "m", "train")
    counts = words.groupBy("word").agg(F.sum(F.when(F.col("train"), F.col("m")).otherwise(0)).alias("c")).where("c > 0")
    counts = stored(counts, "lm-words")
    distinct = counts.count()
    met = words.select("word", "uid", "m").join(small(counts, distinct, 1 << 18), "word")
    off = met.groupBy("uid").agg(F.sum("m").alias("known"), F.sum(F.col("m") * F.log10(F.col("c") + 1)).alias("logs"))
    distinct += int((listed_counts > 0).sum()) + (ends > 0)
    base = F.col("listed") + F.coalesce("logs", F.lit(0.0)) + F.lit(math.log10(ends + 1)) - F.col("n_tokens") * F.lit(math.log10(tokens + distinct + 1))
    docs_of = rows.where("n_tokens is not null").select("uid", "doc", "train", "n_tokens", "n_known", "listed", "score")
    out = docs_of.join(cold, "uid", "left").join(off, "uid", "left").select(
        F.col("doc").alias(key), (~F.col("train")).alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0)) + (1 if ends else 0)).cast("long").alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("score") + F.coalesce("part", F.lit(0.0))).alias("score"),
    )
    out = stored(out, "lm-scores")
    upper.destroy()
    dropped(weighed, rows, counts)
    return out
