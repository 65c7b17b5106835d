"""Token ids in bit-plane-shuffled, zstandard-compressed chunks with an index.

Format.  A chunk holds whole documents: a header (documents, their numbers of
ids, where the chunk starts) and blocks of ``block`` ids.  A block is transposed
into byte planes (or bit planes), low plane first; planes above the largest id
are left out, each other plane is one zstandard frame.  Chunks lie in ascending
key order; the chunk index gives every chunk's bucket, place and id count, from
which any document's ids are found without reading other chunks.  Chunks are rows
of Parquet, so any store Spark writes to can hold them.

Encoding cuts a text where the pre-tokenizer must cut it anyway, between
words, and encodes each distinct piece of a slice once; equal pieces reuse the
ids.  A text that spells an added token, or has white space beyond ASCII, is
encoded whole.

Defined results: a null or empty text is the end id alone; null keys come
first; equal keys keep their relative order by text; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import os
import re
import string
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored
from .textscan import Words, ragged, slices, span_hash

BLOCK, CHUNK_IDS, BUCKET_ROWS = 1 << 16, 1 << 20, 4096
#: Buckets are shuffle partitions and rows of the broadcast index; past this number they hold more rows, streamed chunk by chunk.
BUCKETS_MOST = 20_000
#: Distinct pieces an encoder remembers before it starts afresh.
KNOWN = 2_500_000
_LEADS = np.zeros(256, bool)
_LEADS[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[[ord(c) for c in string.ascii_letters + string.digits]] = True
_POINT = np.zeros(256, bool)
_POINT[[ord(c) for c in string.punctuation]] = True
_encoders: dict[tuple[str, int], Encoder] = {}


def to_planes(ids: np.ndarray, bits: bool = False) -> list[bytes]:
    """Compressed planes of one block of uint32 ids, lowest first, without the empty high ones."""
    raw = ids.astype("<u4")
    if bits:
        width = max(1, int(raw.max(initial=0)).bit_length())
        planes = [np.packbits((raw >> np.uint32(b)) & np.uint32(1) != 0).tobytes() for b in range(width)]
    else:
        width = max(1, (int(raw.max(initial=0)).bit_length() + 7) // 8)
        cells = raw.view(np.uint8).reshape(-1, 4)
        planes = [np.ascontiguousarray(cells[:, b]).tobytes() for b in range(width)]
    press = zstandard.ZstdCompressor(level=1)
    return [press.compress(p) for p in planes]


def from_planes(planes: list[bytes], n: int, bits: bool = False) -> np.ndarray:
    out = np.zeros(n, "<u4")
    expand = zstandard.ZstdDecompressor()
    for b, frame in enumerate(planes):
        plane = np.frombuffer(expand.decompress(frame), np.uint8)
        if bits:
            out |= np.unpackbits(plane, count=n).astype(np.uint32) << np.uint32(b)
        else:
            out.view(np.uint8).reshape(-1, 4)[:, b] = plane
    return out


class Encoder:
    """Encodes slices with a tokenizers file whose pre-tokenizer is byte level with its own pattern."""

    def __init__(self, path: str, end: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.end = Tokenizer.from_file(path), end
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # added tokens, and white space beyond ASCII, which the pattern joins with its neighbours
        self.hard = re.compile("|".join([*map(re.escape, self.added), "[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"]))
        # byte-level vocabularies write a blank as U+0120
        self.begins_blank = np.array([(self.tokenizer.id_to_token(i) or "").startswith("\u0120") for i in range(self.tokenizer.get_vocab_size())])
        self.wide = self.tokenizer.get_vocab_size() > 1 << 16
        self.forget()

    def forget(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.starts, self.lengths = np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.pool, self.used = np.zeros(1 << 20, np.uint32 if self.wide else np.uint16), 0

    def _learn(self, hashes: np.ndarray, pieces: list[str]) -> None:
        """Encodes new pieces and keeps their ids by hash.

        Pieces of a blank and a word are encoded in one text: the pre-tokenizer
        cuts before each blank, and only a piece's first id begins with one.
        """
        n = np.zeros(len(pieces), np.int32)
        blank = np.array([p[0] == " " and len(p) > 1 for p in pieces], bool)
        place = np.concatenate([np.flatnonzero(blank), np.flatnonzero(~blank)])
        parts: list[np.ndarray] = []
        joined = place[: int(blank.sum())]
        groups = [joined[i : i + 2000] for i in range(0, len(joined), 2000)]
        for group, e in zip(groups, self.tokenizer.encode_batch_fast(["".join([pieces[i] for i in g]) for g in groups], add_special_tokens=False), strict=True):
            found = np.array(e.ids, self.pool.dtype)
            heads = np.flatnonzero(self.begins_blank[found])
            if len(heads) == len(group) and heads[0] == 0:
                parts.append(found)
                n[group] = np.diff(np.append(heads, len(found)))
            else:
                parts += self._one_by_one(pieces, group, n)
        parts += self._one_by_one(pieces, place[len(joined) :], n)
        order = np.concatenate([*groups, place[len(joined) :]]) if len(place) else place
        starts = np.zeros(len(pieces), np.int32)
        starts[order] = np.cumsum(n[order]) - n[order]
        new = np.concatenate(parts) if parts else np.zeros(0, self.pool.dtype)
        hashes_at = self.used + starts
        while self.used + len(new) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(new)] = new
        at = np.searchsorted(self.hashes, hashes)
        self.hashes = np.insert(self.hashes, at, hashes)
        self.starts = np.insert(self.starts, at, hashes_at)
        self.lengths = np.insert(self.lengths, at, n)
        self.used += len(new)

    def _one_by_one(self, pieces: list[str], which: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
        out = [np.array(e.ids, self.pool.dtype) for e in self.tokenizer.encode_batch_fast([pieces[i] for i in which], add_special_tokens=False)]
        n[which] = [len(x) for x in out]
        return out

    def _hard_rows(self, texts: pa.Array, data: np.ndarray) -> list[int]:
        # the lead bytes of white space beyond ASCII; most slices have none
        if not _LEADS[data].any() and not any(data.tobytes().find(a.encode()) >= 0 for a in self.added):
            return []
        return [i for i, t in enumerate(texts.to_pylist()) if t and self.hard.search(t)]

    @staticmethod
    def _without_punctuation(w: Words) -> np.ndarray:
        """Where each word ends without its closing ASCII punctuation, if a letter or digit stands before and the run is short."""
        end = w.end.copy()
        now = np.flatnonzero(_POINT[w.data[end - 1]]) if len(end) else end
        for _ in range(8):
            end[now] -= 1
            now = now[end[now] > w.start[now]]
            now = now[_POINT[w.data[end[now] - 1]]]
        end[now] = w.end[now]
        last, before = w.data[end - 1], w.data[np.maximum(end - 2, 0)]
        latin = (before == 0xC3) & (last >= 0x80) & (last != 0x97) & (last != 0xB7)
        return np.where((end > w.start) & (_ALNUM[last] | latin), end, w.end)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, each closed by the end id, and the rows' numbers of ids."""
        if len(self.hashes) > KNOWN:
            self.forget()
        w = Words(texts)
        whole = self._hard_rows(texts, w.data)
        n_rows = len(w.count)
        # white space before each word of its row, and after the last
        previous = np.empty(len(w.start), np.int64)
        if len(w.start):
            previous[1:] = w.end[:-1]
            first = w.first[w.count > 0]
            previous[first] = w.offsets[:-1][w.count > 0]
        gap = w.start - previous
        spaced = (gap > 0) & (w.data[np.maximum(w.start - 1, 0)] == 0x20) if len(gap) else np.zeros(0, bool)
        run = gap > 1
        single = (gap > 0) & ~spaced
        tail_start = np.where(w.count > 0, w.end[np.maximum(w.stop - 1, 0)] if len(w.end) else 0, w.offsets[:-1])
        tail = w.offsets[1:] > tail_start
        body = self._without_punctuation(w)
        point = body < w.end
        # pieces in order: [white space but its last] [last white space, if no blank] word with its blank [punctuation]
        per_word = 1 + run + single + point
        at = np.cumsum(per_word) - per_word
        before_row = np.concatenate([[0], np.cumsum(tail)])[w.row] if len(w.start) else np.zeros(0, np.int64)
        at = at + before_row
        total = int(per_word.sum() + tail.sum())
        start, end, row = np.empty(total, np.int64), np.empty(total, np.int64), np.empty(total, np.int64)
        for mask, place, s, e in ((run, at, previous, w.start - 1), (single, at + run, w.start - 1, w.start), (np.ones(len(w.start), bool), at + run + single, w.start - spaced, body), (point, at + run + single + 1, body, w.end)):
            start[place[mask]], end[place[mask]], row[place[mask]] = s[mask], e[mask], w.row[mask]
        words_until = np.concatenate([[0], np.cumsum(per_word)])[w.stop] if len(w.start) else np.zeros(n_rows, np.int64)
        tail_at = words_until + np.cumsum(tail) - tail
        start[tail_at[tail]], end[tail_at[tail]], row[tail_at[tail]] = tail_start[tail], w.offsets[1:][tail], np.flatnonzero(tail)
        h = span_hash(w.data, start, end)
        order = np.argsort(h)
        found = h[order]
        head = np.append(True, found[1:] != found[:-1]) if len(found) else np.zeros(0, bool)
        found, one = found[head], order[head]
        inverse = np.empty(len(h), np.int64)
        inverse[order] = np.cumsum(head) - 1
        at = np.minimum(np.searchsorted(self.hashes, found), max(len(self.hashes) - 1, 0))
        new = np.flatnonzero(self.hashes[at] != found) if len(self.hashes) else np.arange(len(found))
        if len(new):
            text = w.data.tobytes()
            self._learn(found[new], [text[s:e].decode() for s, e in zip(start[one[new]].tolist(), end[one[new]].tolist(), strict=True)])
        at = np.searchsorted(self.hashes, found)
        n_piece = self.lengths[at][inverse].astype(np.int64)
        per_row = np.bincount(row, n_piece, n_rows).astype(np.int64) if total else np.zeros(n_rows, np.int64)
        ids = self.pool[ragged(self.starts[at][inverse].astype(np.int64), n_piece)].astype(np.uint32)
        stops = np.cumsum(per_row)
        out = np.insert(ids, stops, np.uint32(self.end))
        if whole:
            rows = np.split(out, np.cumsum(per_row + 1)[:-1])
            for i in whole:
                rows[i] = np.append(np.array(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, np.uint32), np.uint32(self.end))
            out, per_row = np.concatenate(rows), np.array([len(r) - 1 for r in rows], np.int64)
        return out, per_row + 1


_CHUNK = "bucket int, first bigint, n bigint, keys array<bigint>, lengths array<int>, blocks array<array<binary>>"


def _write(path: str, end: int, block: int, bits: bool) -> object:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a reused worker goes on with the pieces it knows
        if (path, end) not in _encoders:
            _encoders[path, end] = Encoder(path, end)
        encoder, bucket, first = _encoders[path, end], None, 0
        keys: list = []
        lengths: list[int] = []
        ids: list[np.ndarray] = []
        held = 0

        def chunk() -> pa.RecordBatch:
            nonlocal first, keys, lengths, ids, held
            flat = np.concatenate(ids)
            blocks = [to_planes(flat[i : i + block], bits) for i in range(0, len(flat), block)]
            columns = [pa.array([bucket], pa.int32()), pa.array([first]), pa.array([len(flat)]), pa.array([keys], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int32())), pa.array([blocks], pa.list_(pa.list_(pa.binary())))]
            first += len(flat)
            keys, lengths, ids, held = [], [], [], 0
            return pa.RecordBatch.from_arrays(columns, ["bucket", "first", "n", "keys", "lengths", "blocks"])

        for part in slices(batches, "text", 1 << 20):
            flat, n = encoder.encode(part.column("text"))
            stops = np.cumsum(n)
            buckets = part.column("bucket").to_pylist()
            part_keys = part.column("key").to_pylist()
            i = 0
            while i < len(n):
                if buckets[i] != bucket:
                    if ids:
                        yield chunk()
                    bucket, first = buckets[i], 0
                j = i
                while j < len(n) and buckets[j] == bucket and (j == i or held + stops[j] - (stops[i] - n[i]) <= CHUNK_IDS):
                    j += 1
                keys += part_keys[i:j]
                lengths += n[i:j].tolist()
                ids.append(flat[stops[i] - n[i] : stops[j - 1]])
                held += len(ids[-1])
                if held >= CHUNK_IDS:
                    yield chunk()
                i = j
        if ids:
            yield chunk()

    return write


def write_ids(docs: DataFrame, path: str, end: int = 2, key: str = "doc_id", text: str = "text", block: int = BLOCK, bits: bool = False) -> DataFrame:
    """Writes the chunk files of docs in the shared folder and returns them as a table of chunks."""
    buckets = min(BUCKETS_MOST, max(1, -(-docs.count() // BUCKET_ROWS)))
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    order = F.col("key").asc_nulls_first()
    # a bucket is a range of keys, numbered in their order
    placed = rows.repartitionByRange(buckets, order).sortWithinPartitions(order, F.xxhash64("text")).withColumn("bucket", F.spark_partition_id())
    return stored(placed.mapInArrow(_write(path, end, block, bits), _CHUNK), "token-ids")


def _read(block: int, bits: bool) -> object:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n = row["n"]
                ids = np.concatenate([from_planes(planes, min(block, n - i * block), bits) for i, planes in enumerate(row["blocks"])])
                lengths = np.array(row["lengths"], np.int64)
                stops = np.cumsum(lengths)
                raw = memoryview(ids.tobytes())
                sums = [zlib.crc32(raw[4 * (b - a) : 4 * b]) for a, b in zip(lengths.tolist(), stops.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(row["keys"], pa.int64()), pa.array(stops - lengths + row["start"]), pa.array(lengths), pa.array(sums, pa.int64())], ["key", "start", "n_tokens", "ids_crc32"])

    return read


def read_index(chunks: DataFrame, key: str = "doc_id", block: int = BLOCK, bits: bool = False) -> DataFrame:
    """Rows (key, start, n_tokens, ids_crc32) of every document, decoded from the chunk files."""
    sizes = {r["bucket"]: r["n"] for r in chunks.groupBy("bucket").agg(F.sum("n").alias("n")).collect()}
    starts, at = [], 0
    for b in sorted(sizes):
        starts.append((b, at))
        at += sizes[b]
    spark = chunks.sparkSession
    # one row a bucket of BUCKET_ROWS documents
    index = F.broadcast(spark.createDataFrame(starts, "b int, base bigint"))
    rows = chunks.join(index, F.col("bucket") == F.col("b")).select((F.col("base") + F.col("first")).alias("start"), "n", "keys", "lengths", "blocks")
    return rows.mapInArrow(_read(block, bits), "key bigint, start bigint, n_tokens bigint, ids_crc32 bigint").withColumnRenamed("key", key)
