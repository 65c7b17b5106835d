"""Substring dedup: repeated word windows found by FM-index shards.

1. Routing.  Every window of ``window`` words has an anchor: the run of
   ``anchor`` words in it with the smallest hash, the leftmost if it repeats.
   Equal windows have equal anchors, so only text around anchors that two or
   more documents share can repeat; consecutive windows with one anchor are
   one piece.  Pieces are routed by anchor, not documents by shard, so no
   document streams past more than the shards that can hold a match.
2. Folding.  Equal pieces fold to their smallest document, with the list of
   its places there; all other holders lose the piece whole.
3. Shards.  Different pieces with a common anchor go to that anchor's shard.
   A shard builds an FM-index (BWT in a wavelet matrix) of its pieces and
   streams them through backward search: the matching statistics against
   smaller documents give the intervals of ``window`` words or more, which
   hold at every place of the piece in its document.
   An anchor with more than ``HOT`` different pieces is split by the words that
   all windows of a range of offsets have in common, twice if needed, down to
   single windows; equal sub-pieces fold again, so no shard grows with it.
4. Intervals return to their documents, whose uncovered words stay.

Defined results: a null or empty text has no words; a null key matches nothing
and loses nothing; rows that repeat a key are not earlier than one another;
windows are judged on the input; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fm_index import FMIndex
from .shared import small, stored
from .textscan import Words, mix, runs_hash, slices

ANCHOR = 12
#: Different pieces of an anchor up to which they stay in one shard; words of a shard; offsets of a range at each split.
HOT, SHARD_WORDS, RANGES = 1024, 400_000, (8, 1)
_POSITION_BITS = np.uint64(30)


class Pieces:
    """The pieces of a slice: first word, word count, anchor hash and position, row."""

    def __init__(self, words: Words, window: int, anchor: int):
        grams = runs_hash(words.hash, anchor)
        span = window - anchor + 1
        self.row = self.first = self.count = self.at = np.zeros(0, np.int64)
        self.anchor = np.zeros(0, np.uint64)
        if len(grams) < span:
            return
        key = ((grams >> _POSITION_BITS) << _POSITION_BITS) | np.arange(len(grams), dtype=np.uint64)
        width, least = 1, key
        while 2 * width <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < span:
            least = np.minimum(least[: len(key) - span + 1], least[span - width : span - width + len(key) - span + 1])
        # windows that stay in one row
        starts = np.flatnonzero(words.row[: len(least)] == words.row[window - 1 : window - 1 + len(least)])
        if not len(starts):
            return
        at = (least[starts] & ((np.uint64(1) << _POSITION_BITS) - np.uint64(1))).astype(np.int64)
        head = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)))
        n = np.diff(np.append(head, len(starts)))
        self.first, self.count, self.at = starts[head], n + window - 1, at[head]
        self.anchor = grams[self.at]
        self.row = words.row[self.first]

    def content(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of each piece's words."""
        out = []
        for salt in (1, 2):
            h = mix(words.hash + np.uint64(salt * 7919))
            total = np.zeros(len(self.first), np.uint64)
            for i in range(int(self.count.max(initial=0))):
                more = self.count > i
                total[more] = total[more] * np.uint64(0xD6E8FEB86659FD93) + h[self.first[more] + i]
            out.append(mix(total + self.count.astype(np.uint64)))
        return out[0], out[1]


def _anchors(window: int, anchor: int) -> object:
    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            keys, words = part.column("key"), Words(part.column("text"))
            pieces = Pieces(words, window, anchor)
            doc = np.asarray(keys.fill_null(0), np.int64)[pieces.row]
            known = ~np.asarray(keys.is_null())[pieces.row] if len(pieces.row) else np.zeros(0, bool)
            pair = np.unique(np.stack([pieces.anchor.view(np.int64)[known], doc[known]], 1), axis=0) if known.any() else np.zeros((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["anchor", "key"])

    return anchors


_PIECE = "anchor bigint, h1 bigint, h2 bigint, key bigint, first bigint, n int, at int, words binary"


def _piece_rows(words: Words, pieces: Pieces, keep: np.ndarray, anchor: np.ndarray, key: np.ndarray, first: np.ndarray) -> pa.RecordBatch:
    h1, h2 = pieces.content(words)
    body = [words.text(int(f), int(f + n)) for f, n in zip(pieces.first[keep], pieces.count[keep], strict=True)]
    return pa.RecordBatch.from_arrays(
        [pa.array(anchor[keep].view(np.int64)), pa.array(h1[keep].view(np.int64)), pa.array(h2[keep].view(np.int64)), pa.array(key[keep]), pa.array(first[keep]), pa.array(pieces.count[keep].astype(np.int32)), pa.array((pieces.at - pieces.first)[keep].astype(np.int32)), pa.array(body, pa.binary())],
        ["anchor", "h1", "h2", "key", "first", "n", "at", "words"],
    )


def _pieces(window: int, anchor: int) -> object:
    """Pieces of documents (key, text, anchors) around the listed anchors."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            words = Words(part.column("text"))
            found = Pieces(words, window, anchor)
            keys = np.asarray(part.column("key"), np.int64)
            shared = part.column("anchors")
            lists, sizes = np.asarray(shared.flatten(), np.int64), np.diff(np.asarray(shared.offsets))
            owner = np.repeat(np.arange(len(sizes)), sizes)
            # an anchor counts only in the rows that list it
            wanted = mix(lists.view(np.uint64) ^ mix(owner.astype(np.uint64)))
            keep = np.flatnonzero(np.isin(mix(found.anchor ^ mix(found.row.astype(np.uint64))), wanted))
            yield _piece_rows(words, found, keep, found.anchor, keys[found.row], found.first - words.first[found.row])

    return pieces


def _split(window: int, anchor: int, step: int) -> object:
    """Cuts pieces into ranges of ``step`` anchor offsets, each named by the words its windows have in common."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            col = {name: batch.column(name).to_pylist() for name in ("anchor", "key", "first", "n", "at", "words")}
            for a, key, first, n, at, body in zip(*col.values(), strict=True):
                words = body.split(b" ")
                # offset j: words of the window before the anchor
                low, high = at - (n - window), at
                for r in range(low // step, high // step + 1):
                    x, y = max(low, r * step), min(high, r * step + step - 1)
                    core = words[at - r * step : at - (r * step + step - 1) + window] if at - (r * step + step - 1) >= 0 else words[max(0, at - r * step) : at - (r * step + step - 1) + window]
                    s, e = at - y, at - x + window
                    name = hashlib.blake2b(b" ".join([str((a, step, r)).encode(), *core]), digest_size=8).digest()
                    own = b" ".join(words[s:e])
                    d = hashlib.blake2b(own, digest_size=16).digest()
                    out.append((int.from_bytes(name, "little", signed=True), int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True), key, first + s, e - s, at - s, own))
            cols = list(zip(*out, strict=True)) or [[]] * 8
            types = [pa.int64()] * 5 + [pa.int32()] * 2 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["anchor", "h1", "h2", "key", "first", "n", "at", "words"])

    return split


def search_shard(frame: pd.DataFrame, window: int) -> pd.DataFrame:
    """Intervals of a shard's pieces (key, firsts, words) that smaller keys hold, in words of the document, at each of the piece's places."""
    words = Words(pa.array([bytes(w).decode() for w in frame["words"]], pa.string()))
    ids = np.unique(words.hash, return_inverse=True)[1].astype(np.int64) + 1
    pieces = [ids[a:b] for a, b in zip(words.first, words.stop, strict=True)]
    owner = frame["key"].to_numpy(np.int64)
    firsts = frame["firsts"].tolist()
    found = FMIndex(pieces, owner).earlier_matches(pieces, owner, window)
    return pd.DataFrame([(owner[i], f + s, f + e) for i, s, e in found for f in firsts[i]], columns=["key", "start", "stop"]).astype("int64")


def _settle(rows: DataFrame, window: int, anchor: int, steps: tuple[int, ...], hot: int, name: str) -> list[DataFrame]:
    """Interval tables (key, start, stop) of stored piece rows."""
    least = stored(rows.groupBy("anchor", "h1", "h2").agg(F.min("key").alias("least")), "substring-dedup")
    whole = rows.select("anchor", "h1", "h2", "key", "first", "n").join(least, ["anchor", "h1", "h2"]).where("key > least")
    out = [whole.select("key", F.col("first").alias("start"), (F.col("first") + F.col("n")).alias("stop"))]
    kinds = least.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1")
    several = least.join(kinds, "anchor").withColumnRenamed("least", "key")
    # a document may hold a piece at several places
    held = rows.join(several, ["anchor", "h1", "h2", "key"]).groupBy("anchor", "h1", "h2", "key")
    several = stored(held.agg(F.collect_set("first").alias("firsts"), *[F.first(c).alias(c) for c in ("n", "at", "words", "kinds")]), "substring-dedup")
    sums = several.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("words"), F.coalesce(F.max("kinds"), F.lit(0)).alias("most")).first()
    plain = several.where(F.col("kinds") <= hot) if steps else several
    if sums["words"]:
        shards = max(1, sums["words"] // SHARD_WORDS + 1)
        sharded = plain.select("key", "firsts", "words", F.pmod(F.xxhash64("anchor"), F.lit(shards)).alias("shard"))
        search = lambda frame: search_shard(frame, window)
        out.append(sharded.groupBy("shard").applyInPandas(search, "key bigint, start bigint, stop bigint"))
    if steps and sums["most"] > hot:
        finer = several.where(F.col("kinds") > hot).select("anchor", "h1", "h2", "key", F.explode("firsts").alias("first"), "n", "at", "words").mapInArrow(_split(window, anchor, steps[0]), _PIECE)
        out += _settle(stored(finer, "substring-dedup"), window, anchor, steps[1:], hot, f"{name}x")
    return out


def repeated_intervals(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 50, anchor: int = ANCHOR, hot: int = HOT) -> DataFrame:
    """Rows (key, start, stop): word ranges of documents whose windows also start in a document of smaller key."""
    held = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    seen = stored(held.mapInArrow(_anchors(window, anchor), "anchor bigint, key bigint"), "substring-dedup")
    both = seen.groupBy("anchor").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low < high").select("anchor")
    shared = stored(seen.join(both, "anchor").groupBy("key").agg(F.collect_set("anchor").alias("anchors")), "substring-dedup")
    listed = shared.agg(F.coalesce(F.sum(F.size("anchors")), F.lit(0))).first()[0]
    rows = held.where("key is not null").join(small(shared, listed, 2_000_000), "key").mapInArrow(_pieces(window, anchor), _PIECE)
    tables = _settle(stored(rows, "substring-dedup"), window, anchor, RANGES, hot, "sub")
    out = tables[0]
    for t in tables[1:]:
        out = out.union(t)
    return stored(out, "substring-dedup")


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text"):
        words = Words(part.column("text"))
        spans = part.column("spans")
        removed, kept = [], []
        for i, span in enumerate(spans.to_pylist()):
            a, b = int(words.first[i]), int(words.stop[i])
            if not span:
                removed.append(0)
                kept.append(words.text(a, b))
                continue
            edge = np.zeros(b - a + 1, np.int64)
            np.add.at(edge, [s["start"] for s in span], 1)
            np.add.at(edge, [s["stop"] for s in span], -1)
            stay = np.flatnonzero(np.cumsum(edge)[:-1] <= 0) + a
            removed.append(b - a - len(stay))
            kept.append(b" ".join(words.data[words.start[j] : words.end[j]].tobytes() for j in stay))
        yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(words.count.astype(np.int64)), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["key", "n_words", "n_removed", "kept"])


def drop_repeated_substrings(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 50, anchor: int = ANCHOR, hot: int = HOT) -> DataFrame:
    """Rows (key, n_words, n_removed, kept) for every row of docs; kept is the remaining words joined by one space."""
    spans = repeated_intervals(docs, key, text, window, anchor, hot).groupBy(F.col("key").alias("k")).agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    # the spans grow with the corpus: texts are shuffled once to meet them, at every size
    held = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    joined = held.join(spans, F.col("key") == F.col("k"), "left").select("key", "text", "spans")
    return joined.mapInArrow(_kept, "key bigint, n_words bigint, n_removed bigint, kept string").withColumnRenamed("key", key)
