"""Nearest neighbours by multiprobe p-stable hashing.

Equal vectors fold to one representative with their smallest ids, which is all
a top-k list can need of them.  Each of TABLES hash tables cuts M Gaussian
projections into slots of width w; a bucket is a tuple of slots.  A neighbour at
distance r lies in a bucket with a probability that follows from the normal
law of its projections, so a query visits buckets in descending success
probability until a table's visited mass reaches the target.  Candidates of all
tables are ranked by exact distance in double precision and merged.

r is the distance of true neighbours of PILOTS sampled vectors, found by a pass
over all rows; the target mass is the least that finds RECALL of those
neighbours.  All rows are indexed; M grows with their logarithm.

Buckets lie in groups of bounded size, large buckets split over several, and a
group returns each query's best k only: no pair is ever a row.  Queries with
fewer than k results search all groups of one table exactly.

Defined results: vectors that are null, zero, of another length than most, or
hold null or non-finite components take no part, nor do null ids; equal
distances go by id; an id that repeats is one vector, its smallest in array order; fewer than k
candidates give fewer rows; an empty table gives none; other columns are not
read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored

TABLES, PILOTS, RECALL = 4, 64, 0.97
GROUP_ROWS, BUCKET_ROWS = 8192, 2048
REACH = 4


class Hasher:
    def __init__(self, dim: int, functions: int, width: float, seed: int = 7):
        draw = np.random.RandomState(seed)
        self.planes = draw.normal(size=(TABLES, functions, dim))
        self.shift = draw.uniform(0, 1, size=(TABLES, functions))
        self.width, self.functions = width, functions
        self.salt = draw.randint(1, 1 << 62, size=(TABLES, functions)).astype(np.uint64) | np.uint64(1)

    def places(self, table: int, vectors: np.ndarray) -> np.ndarray:
        return vectors @ self.planes[table].T / self.width + self.shift[table]

    def buckets(self, table: int, slots: np.ndarray) -> np.ndarray:
        key = (slots.astype(np.int64).view(np.uint64) * self.salt[table]).sum(-1, dtype=np.uint64) + np.uint64(table)
        key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return (key ^ (key >> np.uint64(32))).view(np.int64)

    def slot_odds(self, place: np.ndarray, r: float) -> np.ndarray:
        """For each function, the probability of each slot offset -REACH .. REACH of a neighbour at distance r."""
        sigma = max(r / self.width, 1e-9) * math.sqrt(2)
        edges = np.arange(-REACH, REACH + 2)[None, :] - (place - np.floor(place))[:, None]
        below = 0.5 * (1 + np.vectorize(math.erf, otypes=[float])(edges / sigma))
        return np.maximum(np.diff(below, axis=1), 1e-12)

    def probes(self, place: np.ndarray, r: float, mass: float) -> np.ndarray:
        """Slot tuples of the buckets to visit, likeliest first, until their probabilities reach ``mass``."""
        odds = self.slot_odds(place, r)
        order = np.argsort(-odds, axis=1, kind="stable")
        cost = -np.log(np.take_along_axis(odds, order, 1))
        base = np.floor(place).astype(np.int64)
        n = len(place)
        start = float(cost[:, 0].sum())
        heap = [(start, (0,) * n, 0)]
        out, reached = [], 0.0
        while heap:
            c, ranks, last = heapq.heappop(heap)
            out.append(base + order[np.arange(n), ranks] - REACH)
            reached += math.exp(-c)
            if reached >= mass:
                break
            # raising only functions from the last raised on makes every tuple once
            for j in range(last, n):
                if ranks[j] + 1 < 2 * REACH + 1:
                    heapq.heappush(heap, (c - cost[j, ranks[j]] + cost[j, ranks[j] + 1], (*ranks[:j], ranks[j] + 1, *ranks[j + 1 :]), j))
        return np.array(out)


def exact(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    return np.sqrt(((vectors - query) ** 2).sum(axis=1))


def nearest(query: np.ndarray, squares: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k least (exact distance, id) of the vectors, from a rough ranking with room for its rounding."""
    rough = squares - 2 * (vectors @ query)
    if len(rough) > k:
        edge = np.partition(rough, k - 1)[k - 1]
        near = np.flatnonzero(rough <= edge + 1e-9 * (1 + abs(edge) + float(query @ query)))
    else:
        near = np.arange(len(rough))
    score = exact(query, vectors[near])
    order = np.lexsort((ids[near], score))[:k]
    return ids[near][order], score[order]


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """Rows (id, v): one double array an id, all of the most frequent length."""
    v = F.col("v")
    rows = vectors.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = rows.where(fine)
    top = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if top is None:
        return rows.limit(0)
    # adding zero makes -0.0 equal to 0.0
    return rows.where(F.size("v") == top["n"]).groupBy("id").agg(F.min(F.transform("v", lambda x: x + 0.0)).alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = np.asarray(column.flatten(), np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _pilot(pilots: np.ndarray, k: int) -> object:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, m = np.asarray(batch.column("id"), np.int64), _matrix(batch.column("v"))
            squares = (m * m).sum(1)
            place = {int(i): j for j, i in enumerate(ids)}
            for p, q in enumerate(pilots):
                near, score = nearest(q, squares, m, ids, k)
                rows = [place[int(i)] for i in near]
                yield pa.RecordBatch.from_arrays([pa.array([p] * len(near), pa.int32()), pa.array(score), pa.array(near), pa.array(list(m[rows]), pa.list_(pa.float64()))], ["pilot", "score", "id", "v"])

    return scan


def fit(reps: DataFrame, n: int, k: int) -> tuple[Hasher, float, float]:
    """The hasher, neighbour distance and target mass from pilots searched against all rows."""
    sample = reps.orderBy(F.xxhash64("id"), "id").limit(PILOTS).toPandas()
    pilots = np.array(sample["v"].tolist(), np.float64)
    found = reps.mapInArrow(_pilot(pilots, k + 1), "pilot int, score double, id bigint, v array<double>")
    best = found.withColumn("r", F.row_number().over(Window.partitionBy("pilot").orderBy("score", "id"))).where(F.col("r") <= k + 1).where("score > 0").toPandas()
    scale = float(np.sqrt((pilots**2).sum(1).mean()))
    functions = int(min(16, max(2, round(math.log2(max(n, 512) / 256) / 1.6))))
    hasher = Hasher(pilots.shape[1], functions, 1.5 * scale)
    r = float(np.quantile(best["score"], 0.75)) if len(best) else scale
    need = []
    for pilot, frame in best.groupby("pilot"):
        near = np.array(frame["v"].tolist(), np.float64)
        masses = []
        for t in range(TABLES):
            place = hasher.places(t, pilots[int(pilot)][None])[0]
            slots = np.floor(hasher.places(t, near)).astype(np.int64)
            order = {tuple(s): None for s in slots.tolist()}
            odds, reached = hasher.slot_odds(place, r), 0.0
            for tried in hasher.probes(place, r, 0.995):
                reached += float(np.prod(odds[np.arange(functions), tried - np.floor(place).astype(np.int64) + REACH]))
                if tuple(tried.tolist()) in order:
                    order[tuple(tried.tolist())] = reached
            masses.append([order[tuple(s)] or 1.0 for s in slots.tolist()])
        need += np.min(masses, axis=0).tolist()
    mass = float(np.quantile(need, RECALL)) if need else 0.9
    return hasher, r, min(max(mass, 0.05), 0.995)


_INDEX = "bucket bigint, id bigint, v array<double>"


def _hash_rows(hasher: Hasher) -> object:
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            m = _matrix(batch.column("v"))
            for t in range(TABLES):
                bucket = hasher.buckets(t, np.floor(hasher.places(t, m)).astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(m), t, np.int32)), pa.array(bucket), batch.column("id"), batch.column("v")], ["t", "bucket", "id", "v"])

    return hashed


def _probe_rows(hasher: Hasher, r: float, mass: float) -> object:
    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            m = _matrix(batch.column("v"))
            for i in range(len(m)):
                for t in range(TABLES):
                    slots = hasher.probes(hasher.places(t, m[i : i + 1])[0], r, mass)
                    bucket = np.unique(hasher.buckets(t, slots))
                    same = pa.array([i] * len(bucket))
                    yield pa.RecordBatch.from_arrays([pa.array(bucket), batch.column("id").take(same), batch.column("v").take(same)], ["bucket", "id", "v"])

    return probed


def _search_group(k: int) -> object:
    """Each query's k nearest among the rows of the buckets it probes in this group; a null bucket probes all."""

    def search(rows: pd.DataFrame, probes: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(probes):
            rows = rows.sort_values(["bucket", "salt"], kind="stable")
            m, ids = np.array(rows["v"].tolist(), np.float64), rows["id"].to_numpy(np.int64)
            squares = (m * m).sum(1)
            key = pd.MultiIndex.from_frame(rows[["bucket", "salt"]])
            first = ~key.duplicated()
            starts = np.flatnonzero(first)
            spans = dict(zip(key[first], zip(starts, np.append(starts[1:], len(rows)), strict=True), strict=True))
            for query, mine in probes.groupby("id", sort=False):
                q = np.array(mine["v"].iloc[0], np.float64)
                if mine["bucket"].isna().any():
                    at = np.arange(len(rows))
                else:
                    at = np.concatenate([np.arange(*spans[x]) for x in zip(mine["bucket"].astype("int64"), mine["salt"].astype("int64"), strict=True) if x in spans] or [np.zeros(0, np.int64)])
                if len(at):
                    near, score = nearest(q, squares[at], m[at], ids[at], k)
                    out += zip([query] * len(near), near.tolist(), score.tolist(), strict=True)
        return pd.DataFrame(out, columns=["query", "rep", "score"]).astype({"query": "int64", "rep": "int64", "score": "float64"})

    return search


def search(vectors: DataFrame, queries: Column, key: str = "vec_id", vector: str = "embedding", k: int = 10) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the k nearest other vectors of every row for which ``queries`` (a condition on ``id``) holds."""
    spark = vectors.sparkSession
    rows = stored(usable(vectors, key, vector), "ann")
    place = Window.partitionBy("v").orderBy("id")
    least = rows.withColumn("r", F.row_number().over(place)).where(F.col("r") <= k + 1)
    folded = least.groupBy("v").agg(F.min("id").alias("id"), F.sort_array(F.collect_list("id")).alias("ids"))
    reps = stored(folded.select("id", "v", "ids"), "ann")
    n = reps.count()
    result = "query_id bigint, rank int, vec_id bigint, score double"
    if not n:
        return spark.createDataFrame([], result)
    points = reps.select("id", "v")
    hasher, r, mass = fit(points, n, k)
    asked = rows.where(queries)
    index = points.mapInArrow(_hash_rows(hasher), "t int, " + _INDEX)
    groups = max(1, math.ceil(n * TABLES / GROUP_ROWS))
    sizes = index.groupBy("bucket").agg(F.ceil(F.count("*") / BUCKET_ROWS).cast("long").alias("salts"))
    sizes = stored(sizes, "ann")
    group = F.pmod(F.xxhash64("bucket", "salt"), F.lit(groups)).alias("g")
    indexed = index.join(sizes, "bucket").withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts"))).select("t", "bucket", "salt", "id", "v", group)
    probes = asked.mapInArrow(_probe_rows(hasher, r, mass), _INDEX).join(sizes, "bucket").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).select("bucket", "salt", "id", "v", group)
    hits = "query bigint, rep bigint, score double"
    found = indexed.groupBy("g").cogroup(probes.groupBy("g")).applyInPandas(_search_group(k + 1), hits).distinct()
    best = Window.partitionBy("query").orderBy("score", "rep")
    top = stored(found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).drop("r"), "ann")

    def listed(hits: DataFrame) -> DataFrame:
        ids = reps.select(F.col("id").alias("rep"), F.explode("ids").alias("vec_id"))
        pairs = hits.join(ids, "rep").where("vec_id <> query")
        rank = F.row_number().over(Window.partitionBy("query").orderBy("score", "vec_id"))
        return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("query").alias("query_id"), F.col("rank").cast("int").alias("rank"), "vec_id", "score")

    out = stored(listed(top), "ann")
    full = min(k, rows.limit(k + 1).count() - 1)
    got = out.groupBy("query_id").agg(F.count("*").alias("n"))
    short = stored(asked.join(got, asked["id"] == got["query_id"], "left").where(F.coalesce("n", F.lit(0)) < full).select("id", "v"), "ann")
    if not short.limit(1).count():
        return out
    everywhere = short.select(F.lit(None).cast("long").alias("bucket"), F.lit(None).cast("long").alias("salt"), "id", "v", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("g"))
    again = indexed.where("t = 0").groupBy("g").cogroup(everywhere.groupBy("g")).applyInPandas(_search_group(k + 1), hits)
    again = again.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).drop("r")
    return out.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(listed(again))
