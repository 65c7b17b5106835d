"""Exact Jaccard self-join of documents on word shingles with a token-group matrix.

1. Candidates.  A set's shingles are dealt by hash into m parts, m chosen per
   size class so that two sets that link must agree on one non-empty part
   whole; agreement on a part's content is an equality of 64-bit signatures.
   Shingles frequent in a bounded sample are left out of the parts at first;
   a document made of little else sends signatures over its full set as well,
   with ever finer parts, until the counting argument holds for it.  So no
   link is lost, whatever the sample says: it only steers the work.  Of a set
   with more filled parts than a linked set can differ in by d, the first d + 1
   parts in order of how many shingles they hold are sent: the first part of that
   order that two linked sets agree on is among these of both.  A part of a
   single shingle, on which long documents agree by chance, is hardly ever sent.
2. Similar documents.  Documents with a signature are linked to the smallest of
   them, and the connected components are the partition into similar documents.  Equal sets
   collapse into a class, of which one document stands for all.
3. Token-group matrix.  Inside a component, blocks of documents meet blocks.
   Blocks are cells of like size, dealt by hash; a block is cut into groups of like size; a group's row in the matrix is
   the union of its members' shingles.  The overlap of a query with that union
   bounds its overlap with every member, so only groups that reach the
   threshold are opened, and their members compared exactly.  Pairs that are
   connected already are skipped: the result is the components.

Signatures that repeat inside a task are linked there and sent once, so a
signature that a third of all documents share costs a row a flush, not a row a
document.  Large components are split into block pairs over many tasks.

Defined results: null, empty and word-less texts have no shingles and link with
nothing; texts of fewer than k words are one shingle; equal sets always link;
a null key gets its shingle count and a null component; rows that repeat a key
share a component; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import components, dropped, small, stored
from .textscan import Words, mix, ragged, runs_hash, slices, windows

#: The frequent-shingle set steers work and never decides a link: one document in SAMPLE_EVERY is counted.
SAMPLE_EVERY, SAMPLE_LEAST, FREQUENT_BITS, SHARE_BITS = 16, 3, 26, 6
BLOCK, GROUP = 2048, 32
#: Parts of a set for each shingle that a linked one may differ in: enough that those of two shingles or more outnumber the differences.
PARTS = 1.25
#: Shingles of a block of documents, 8 bytes each: what a task holds at once follows it, however long the documents.
BLOCK_SHINGLES = 1 << 20
#: Ratio of the largest to the smallest set of a cell, and rows of seats that are broadcast (some 100 bytes each).
CELL_GROWTH, SEATS = 1.25, 200_000
#: Text bytes of a slice, and signatures a scan holds before it links and sends them.
SLICE, FLUSH = 1 << 19, 1 << 19


def shingle_sets(words: Words, k: int) -> list[np.ndarray]:
    """Each row's sorted distinct shingle hashes; a row with fewer than k words has one for the whole."""
    h = words.hash
    starts, _ = windows(words.first, words.count, k)
    runs = runs_hash(h, k)[starts] if len(starts) else np.zeros(0, np.uint64)
    lengths = np.maximum(words.count - k + 1, 0)
    stops = np.cumsum(lengths)
    out = []
    for i, (stop, n) in enumerate(zip(stops, lengths, strict=True)):
        if n:
            s = np.sort(runs[stop - n : stop])
            out.append(s[np.append(True, s[1:] != s[:-1])])
        elif words.count[i]:
            c = int(words.count[i])
            out.append(mix(runs_hash(h[words.first[i] : words.stop[i]], c) + np.uint64(c)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def size_classes(limit: int, growth: float = 1.6) -> np.ndarray:
    bounds = [1]
    while bounds[-1] <= limit:
        bounds.append(max(bounds[-1] + 1, int(bounds[-1] * growth)))
    return np.array(bounds, np.int64)


def signatures(sets: list[np.ndarray], num: int, den: int, frequent: Frequent | None) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of all sets and the index of the set of each; two sets with J >= num / den share one.

    Sets that link agree on all filled parts of a level but for ``differ`` of them
    at most, so of those they agree on the first, in any order of signatures, has
    at most ``differ`` before it in either set.
    """
    n = np.array([len(s) for s in sets], np.int64)
    if not n.sum():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    tokens = np.concatenate(sets)
    start = np.cumsum(n) - n
    bounds = size_classes(int(n.max() * den // num + 1))
    own = np.searchsorted(bounds, n, "right") - 1
    last = np.searchsorted(bounds, n * den // num, "right") - 1
    spread = np.where(n > 0, last - own + 1, 0)
    who = np.repeat(np.arange(len(sets)), spread)
    cls = ragged(own, spread)
    rare = np.ones(len(tokens), bool)
    if frequent is not None:
        rare = ~frequent.has(tokens)
    keys = mix(tokens + np.uint64(0x51ED270B))
    differ = n * (den - num) // num  # two linked sets differ in so many shingles at most
    sigs, owners = [], []
    level = 0
    while len(who):
        largest = bounds[cls + 1] - 1
        parts = np.ceil(PARTS * (largest * (den - num) // num)).astype(np.int64) + 1
        parts *= 4 ** max(0, level - 1)
        index = ragged(start[who], n[who])
        task = np.repeat(np.arange(len(who)), n[who])
        if level == 0:
            index, task = index[rare[index]], task[rare[index]]
        offset = np.cumsum(parts) - parts
        cell = offset[task] + ((keys[index] >> np.uint64(16)) % parts[task].astype(np.uint64)).astype(np.int64)
        order = np.argsort(cell, kind="stable")
        cell = cell[order]
        heads = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])) if len(cell) else np.zeros(0, np.int64)
        filled = np.zeros(len(who), np.int64)
        if len(heads):
            sums = np.add.reduceat(keys[index[order]], heads)
            t = task[order][heads]
            part = (cell[heads] - offset[t]).astype(np.uint64)
            label = mix(part + (cls[t].astype(np.uint64) << np.uint64(40)) + (np.uint64(level) << np.uint64(56)))
            sig = mix(sums ^ label)
            filled = np.bincount(t, minlength=len(who))
            # t ascends: fullest parts first inside each task
            best = np.lexsort((sig, -np.diff(np.append(heads, len(cell))), t))
            rank = np.arange(len(t)) - (np.cumsum(filled) - filled)[t]
            sent = best[rank <= differ[who[t]]]
            sigs.append(sig[sent])
            owners.append(who[t[sent]])
        more = filled <= differ[who]
        who, cls = who[more], cls[more]
        level += 1
    return np.concatenate(sigs), np.concatenate(owners)


_SCAN = "kind tinyint, a bigint, b bigint"


def _scan(k: int, num: int, den: int, frequent) -> object:
    """Per document a size row (0, key, size), and edges (1, key, key) and signatures (2, signature, key)."""

    def rows(kind: int, a: np.ndarray, b: np.ndarray, nulls: np.ndarray | None = None) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int8)), pa.array(a.astype(np.int64), mask=nulls), pa.array(b.astype(np.int64))], ["kind", "a", "b"])

    def linked(sig: np.ndarray, key: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((key, sig))
        sig, key = sig[order], key[order]
        head = np.append(True, sig[1:] != sig[:-1]) if len(sig) else np.zeros(0, bool)
        yield rows(2, sig[head].view(np.int64), key[head])
        same = np.flatnonzero(~head)
        least = key[head][np.cumsum(head) - 1] if len(sig) else key
        edges = np.unique(np.stack([key[same], least[same]], 1), axis=0) if len(same) else np.zeros((0, 2), np.int64)
        yield rows(1, edges[:, 0], edges[:, 1])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = frequent.value
        held: list[tuple[np.ndarray, np.ndarray]] = []
        seen: dict[int, int] = {}
        for part in slices(batches, "text", SLICE):
            ids, words = part.column("key"), Words(part.column("text"), lower=True)
            missing = np.asarray(ids.is_null())
            keys = np.asarray(ids.fill_null(0), np.int64)
            sets = shingle_sets(words, k)
            yield rows(0, keys, np.array([len(s) for s in sets], np.int64), missing if missing.any() else None)
            whole = [int(mix(s).sum(dtype=np.uint64)) if len(s) else None for s in sets]
            again = []
            fresh = []
            for i, w in enumerate(whole):
                if w is None or missing[i]:
                    continue
                first = seen.setdefault(w, int(keys[i]))
                if first != keys[i]:
                    again.append((int(keys[i]), first))
                else:
                    fresh.append(i)
            if again:
                pairs = np.array(again, np.int64)
                yield rows(1, pairs[:, 0], pairs[:, 1])
            sig, owner = signatures([sets[i] for i in fresh], num, den, hot)
            held.append((sig, keys[np.array(fresh, np.int64)][owner] if len(owner) else np.zeros(0, np.int64)))
            if sum(len(s) for s, _ in held) >= FLUSH:
                yield from linked(np.concatenate([s for s, _ in held]), np.concatenate([o for _, o in held]))
                held, seen = [], {}
        if held:
            yield from linked(np.concatenate([s for s, _ in held]), np.concatenate([o for _, o in held]))

    return scan


class Frequent:
    """A set of shingles as a bitmap of 2 ** FREQUENT_BITS cells; any set gives right results, a good one less work."""

    def __init__(self, cells: np.ndarray):
        self.cells = cells

    def has(self, tokens: np.ndarray) -> np.ndarray:
        cell = tokens >> np.uint64(64 - FREQUENT_BITS)
        return (self.cells[(cell >> np.uint64(3)).astype(np.int64)] >> (cell & np.uint64(7)).astype(np.uint8)) & 1 > 0

    @staticmethod
    def of(tokens: np.ndarray) -> Frequent:
        out = Frequent(np.zeros(1 << (FREQUENT_BITS - 3), np.uint8))
        cell = tokens >> np.uint64(64 - FREQUENT_BITS)
        np.bitwise_or.at(out.cells, (cell >> np.uint64(3)).astype(np.int64), (np.uint8(1) << (cell & np.uint64(7)).astype(np.uint8)))
        return out


def frequent_shingles(docs: DataFrame, k: int) -> Frequent:
    """The shingles found in SAMPLE_LEAST or more documents of a hash sample, one in SAMPLE_EVERY (all of a small table)."""
    every = max(1, min(SAMPLE_EVERY, docs.count() // 4096))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE):
            sets = shingle_sets(Words(part.column("text"), lower=True), k)
            tokens, n = np.unique(np.concatenate(sets), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(n)], ["token", "n"])

    def packed(frame: pd.DataFrame) -> pd.DataFrame:
        tokens = frame["token"].to_numpy(np.int64).view(np.uint64)
        share = int(frame["share"].iloc[0])
        width = 1 << (FREQUENT_BITS - 3 - SHARE_BITS)
        return pd.DataFrame({"share": [share], "cells": [Frequent.of(tokens).cells[share * width : (share + 1) * width].tobytes()]})

    picked = docs.where(F.pmod(F.xxhash64("key", F.lit(5)), F.lit(every)) == 0)
    often = picked.mapInArrow(count, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= SAMPLE_LEAST)
    shares = often.select("token", F.shiftrightunsigned("token", 64 - SHARE_BITS).alias("share")).groupBy("share").applyInPandas(packed, "share bigint, cells binary")
    width = 1 << (FREQUENT_BITS - 3 - SHARE_BITS)
    cells = np.zeros(1 << (FREQUENT_BITS - 3), np.uint8)
    # at most 2 ** SHARE_BITS rows, 8 MB in all
    for row in shares.collect():
        cells[row["share"] * width : (row["share"] + 1) * width] = np.frombuffer(row["cells"], np.uint8)
    return Frequent(cells)


def _identity(found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each set: equal sets have equal ones."""
    h1 = np.array([mix(s).sum(dtype=np.uint64) for s in found], np.uint64).view(np.int64)
    return h1, np.array([mix(s ^ np.uint64(0xA5A5A5A5)).sum(dtype=np.uint64) for s in found], np.uint64).view(np.int64)


def _faces(k: int) -> object:
    """Of each text the identity of its set, without the set."""

    def faces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE):
            found = shingle_sets(Words(part.column("text"), lower=True), k)
            h1, h2 = _identity(found)
            yield pa.RecordBatch.from_arrays([part.column("component"), part.column("key"), pa.array([len(s) for s in found], pa.int64()), pa.array(h1), pa.array(h2)], ["component", "key", "n", "h1", "h2"])

    return faces


class _Forest:
    def __init__(self, n: int):
        self.top = np.arange(n)

    def find(self, i: int) -> int:
        while self.top[i] != i:
            self.top[i] = self.top[self.top[i]]
            i = self.top[i]
        return i

    def link(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.top[max(i, j)] = min(i, j)
        return i != j


def open_groups(sets: list[np.ndarray], side: np.ndarray, num: int, den: int, group: int = GROUP) -> list[tuple[int, int]]:
    """A spanning forest of the links between sets: of all, or of those on side 0 with those on side 1 if both occur.

    Queries meet groups of up to ``group`` sets of like size; the number of a
    query's tokens in a group's union decides if the group is opened.
    """
    order = np.argsort([len(s) for s in sets], kind="stable")
    n = np.array([len(sets[i]) for i in order], np.int64)
    two = len(np.unique(side)) > 1
    is_query = side[order] == 0 if two else np.ones(len(order), bool)
    is_member = side[order] == 1 if two else np.ones(len(order), bool)
    vocabulary, tokens = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
    start = np.cumsum(n) - n
    forest, links = _Forest(len(order)), []
    mark = np.zeros(len(vocabulary), bool)
    members = np.flatnonzero(is_member)
    own = lambda i: tokens[start[i] : start[i] + n[i]]

    def overlap(queries: np.ndarray) -> np.ndarray:
        hit = mark[tokens[ragged(start[queries], n[queries])]]
        return np.add.reduceat(hit.astype(np.int32), np.cumsum(n[queries]) - n[queries])

    for g in range(0, len(members), group):
        inside = members[g : g + group]
        low, high = n[inside[0]], n[inside[-1]]
        queries = np.flatnonzero(is_query & (n * den >= low * num) & (n * num <= high * den))
        if not len(queries):
            continue
        for i in inside:
            mark[own(i)] = True
        # a link needs num / den of the larger set shared
        opened = queries[overlap(queries) * den >= n[queries] * num]
        for i in inside:
            mark[own(i)] = False
        for i in inside:
            near = opened[(n[opened] * den >= n[i] * num) & (n[opened] * num <= n[i] * den)]
            if not two:
                near = near[near < i]
            mine = forest.find(int(i))
            near = np.array([q for q in near if forest.find(int(q)) != mine], np.int64)
            if not len(near):
                continue
            mark[own(i)] = True
            both = overlap(near)
            mark[own(i)] = False
            for q in near[both * den >= (n[near] + n[i] - both) * num]:
                if forest.link(int(q), int(i)):
                    links.append((int(order[q]), int(order[i])))
    return links


def _seated(one: pd.DataFrame, k: int) -> tuple[list[np.ndarray], list[int]]:
    """The sets of a component's rows here, and the rows' places: each set once, and only where the seat was meant for it."""
    sets, places, seen = [], [], set()
    for low in range(0, len(one), GROUP):
        part = one.iloc[low : low + GROUP]
        found = shingle_sets(Words(pa.array(part["text"], pa.string()), lower=True), k)
        for i, (s, key, block, h1, h2, a, b) in enumerate(zip(found, part["key"], part["block"], part["h1"], part["h2"], *_identity(found), strict=True)):
            # rows that repeat a key with another text meet its seats too
            if (a, b) == (h1, h2) and (key, block, a, b) not in seen:
                seen.add((key, block, a, b))
                sets.append(s)
                places.append(low + i)
    return sets, places


def _join_block(num: int, den: int, k: int) -> object:
    def join(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, one in frame.groupby("component", sort=False):
            if len(one) > 1:
                sets, places = _seated(one, k)
                keys, block = one["key"].to_numpy()[places], one["block"].to_numpy()[places]
                if len(sets) > 1:
                    out += [(keys[i], keys[j]) for i, j in open_groups(sets, (block != block.min()).astype(int), num, den)]
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return join


def _blocks(classes: DataFrame, block: int) -> DataFrame:
    """Rows (component, key, h1, h2, n, load, whole, block) of the classes in components of two or more.

    A component's sets fall into cells of like size.  Cells of up to half a block
    are packed into blocks in order of size by running sums over the cells, a few
    dozen a component at most; larger cells are dealt by hash into blocks of their
    own.  At a threshold of 0.8 a cell meets its two neighbours at most.
    """
    load = F.greatest("n", F.lit(BLOCK_SHINGLES // block))
    dealt = classes.withColumn("load", load).withColumn("cell", F.floor(F.log(CELL_GROWTH, F.col("n"))).cast("long"))
    cells = stored(dealt.groupBy("component", "cell").agg(F.sum("load").alias("cell_load"), F.count("*").alias("members")), "jaccard")
    wholes = cells.groupBy("component").agg(F.sum("cell_load").alias("whole"), F.sum("members").alias("members")).where("members > 1")
    half = BLOCK_SHINGLES // 2
    packed = F.when(F.col("cell_load") <= half, F.col("cell_load")).otherwise(0)
    before = F.sum(packed).over(Window.partitionBy("component").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)) - packed
    parts = cells.withColumn("start", before).drop("members").join(wholes.drop("members"), "component")
    part = F.pmod(F.xxhash64("key", "h1"), F.ceil(F.col("cell_load") / BLOCK_SHINGLES).cast("long"))
    number = F.when(F.col("whole") <= BLOCK_SHINGLES, F.lit(0)).when(F.col("cell_load") <= half, F.floor(F.col("start") / half)).otherwise((F.col("cell") + 1) * F.lit(1 << 40) + part).cast("long")
    return dealt.join(small(parts, cells.count(), SEATS), ["component", "cell"]).select("component", "key", "h1", "h2", "n", "load", "whole", number.alias("block"))


def link_components(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 3, num: int = 90, den: int = 100, block: int = BLOCK) -> DataFrame:
    """Rows (key, n_shingles, component_id) for every row of docs: sets with J >= num / den link."""
    spark = docs.sparkSession
    held = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    frequent = spark.sparkContext.broadcast(frequent_shingles(held, k))
    found = held.mapInArrow(_scan(k, num, den, frequent), _SCAN)
    # a running minimum: no rows of a signature are held back
    least = F.first("b").over(Window.partitionBy("kind", "a").orderBy("b").rowsBetween(Window.unboundedPreceding, 0))
    found = found.withColumn("c", F.when(F.col("kind") == 2, least)).where("kind < 2 or (c is not null and c <> b)")
    found = stored(found.select("kind", F.when(F.col("kind") == 2, F.col("c")).otherwise(F.col("a")).alias("a"), "b"), "jaccard")
    frequent.destroy()
    sizes = found.where("kind = 0").select(F.col("a").alias("key"), F.col("b").alias("n_shingles"))
    similar = components(found.where("kind > 0"), "jaccard-similar")
    picked = held.join(small(similar, similar.count()), F.col("key") == F.col("node")).select("component", "key", "text")
    faces = stored(picked.mapInArrow(_faces(k), "component bigint, key bigint, n bigint, h1 bigint, h2 bigint"), "jaccard")
    dropped(similar)
    # of equal sets one stands for all
    classes = stored(faces.where("n > 0").groupBy("component", "h1", "h2").agg(F.min("key").alias("key"), F.min("n").alias("n")), "jaccard")
    rep = classes.select("component", "h1", "h2", F.col("key").alias("rep"))
    same = stored(faces.join(rep, ["component", "h1", "h2"]).where("key <> rep").select(F.col("key").alias("a"), F.col("rep").alias("b")).distinct(), "jaccard")
    dropped(faces)
    reps = stored(_blocks(classes, block), "jaccard")
    dropped(classes)
    # components of one block are bundled; of the others every pair of blocks whose sizes allow a link is a group
    one = F.col("whole") <= BLOCK_SHINGLES
    ranges = reps.where(~one).groupBy("component", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    left = ranges.select("component", F.col("block").alias("i"), F.col("low").alias("low_i"), F.col("high").alias("high_i"))
    right = ranges.select("component", F.col("block").alias("j"), F.col("low").alias("low_j"), F.col("high").alias("high_j"))
    meets = left.join(right, "component").where((F.col("i") <= F.col("j")) & (F.col("low_j") * num <= F.col("high_i") * den) & (F.col("low_i") * num <= F.col("high_j") * den)).select("component", "i", "j")
    seats = meets.select("component", F.col("i").alias("block"), "i", "j").union(meets.where("i < j").select("component", F.col("j").alias("block"), "i", "j"))
    bundles = max(1, math.ceil(reps.where(one).agg(F.coalesce(F.sum("load"), F.lit(0))).first()[0] / BLOCK_SHINGLES))
    single = reps.where(one).select("component", "key", "h1", "h2", "block", F.lit(True).alias("bundled"), F.pmod(F.xxhash64("component"), F.lit(bundles)).alias("where"), F.col("block").alias("i"), F.col("block").alias("j"))
    several = reps.where(~one).join(seats, ["component", "block"]).select("component", "key", "h1", "h2", "block", F.lit(False).alias("bundled"), F.col("component").alias("where"), "i", "j")
    seated = single.union(several).groupBy(F.col("key").alias("k")).agg(F.collect_list(F.struct("h1", "h2", "component", "bundled", "where", "i", "j", "block")).alias("seats"))
    seated = stored(seated, "jaccard")
    # texts travel once to each group and are half the size of their sets, which are cut where they are compared
    seats = held.join(small(seated, reps.count(), SEATS), F.col("key") == F.col("k")).select("key", "text", F.inline("seats"))
    links = stored(seats.groupBy("bundled", "where", "i", "j").applyInPandas(_join_block(num, den, k), "a bigint, b bigint"), "jaccard")
    dropped(reps, seated)
    final = components(links.union(same), "jaccard-final")
    dropped(same, links)
    labelled = sizes.join(small(final, final.count()), sizes["key"] == final["node"], "left")
    return labelled.select(F.col("key").alias(key), "n_shingles", F.coalesce("component", "key").alias("component_id"))
