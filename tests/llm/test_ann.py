import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from castline.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k):
    fine = [(i, np.array(v, np.float64)) for i, v, _ in rows if i is not None and v is not None and len(v) == 16 and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, v in fine:
        if q % 10 == 0:
            near = sorted((float(np.sqrt(((v - w) ** 2).sum())), i) for i, w in fine if i != q)[:k]
            out[q] = near
    return out


def rows(n, seed=0):
    rng = np.random.RandomState(seed)
    centres = rng.normal(size=(8, 16))
    data = (centres[rng.randint(8, size=n)] + 0.4 * rng.normal(size=(n, 16))).astype(np.float32)
    data[n // 2 : n // 2 + n // 4] = data[0]
    odd = [(n, None, 1), (n + 10, [0.0] * 16, 1), (n + 20, [float("nan")] + [1.0] * 15, 1), (n + 30, [None] + [1.0] * 15, 1), (n + 40, [1.0] * 3, 1), (n + 50, [float("inf")] * 16, 1), (None, [1.0] * 16, 1)]
    return [(i, [float(x) for x in v], 0) for i, v in enumerate(data)] + odd


@pytest.mark.parametrize("n", [600, 5])
def test_recall_and_exact_scores(spark, n):
    table = rows(n)
    got = ann.search(spark.createDataFrame(table, SCHEMA).withColumn("bucket", F.lit(1)), F.col("id") % 10 == 0).collect()
    expected = brute(table, 10)
    hits = total = 0
    assert {r["query_id"] for r in got} == {q for q, near in expected.items() if near}
    for q, near in expected.items():
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [r for r, _, _ in mine] == list(range(1, len(near) + 1))
        assert [(s, i) for _, i, s in mine] == sorted((s, i) for _, i, s in mine)
        hits += len({i for _, i, _ in mine} & {i for _, i in near})
        total += len(near)
        truth = dict((i, s) for s, i in near)
        assert all(math.isclose(s, truth[i], rel_tol=1e-12) for _, i, s in mine if i in truth)
    assert hits >= 0.9 * total


def test_ties_repeated_ids_and_clashing_columns(spark):
    rng = np.random.RandomState(2)
    near = [[float(x) for x in rng.normal(size=16).astype(np.float32)] for _ in range(30)]
    # the four axis vectors are equally far from the query
    axes = [[0.0] * j + [2.0] + [0.0] * (15 - j) for j in range(4)]
    table = [(0, [1e-3] * 16, 0)] + [(10 * j + 1, v, 0) for j, v in enumerate(axes)] + [(200 + j, v, 0) for j, v in enumerate(near)] + [(205, near[5], 0)]
    frame = spark.createDataFrame(table, SCHEMA)
    for name in ("id", "v", "bucket", "salt", "g", "rep", "ids", "query", "score"):
        frame = frame.withColumn(name, F.lit("x"))
    got = [r for r in ann.search(frame, F.col("id") == 0, k=6).collect() if r["query_id"] == 0]
    want = sorted((math.dist(table[0][1], v), i) for i, v, _ in table[1:])[:6]
    assert [(r["vec_id"], r["rank"]) for r in sorted(got, key=lambda r: r["rank"])] == [(i, n) for n, (_, i) in enumerate(want, 1)]


def test_empty(spark):
    assert not ann.search(spark.createDataFrame([], SCHEMA), F.col("id") % 10 == 0).collect()


def test_probes_come_in_descending_probability():
    hasher = ann.Hasher(8, 3, 1.0)
    rng = random.Random(0)
    place = np.array([rng.random() * 5 for _ in range(3)])
    odds = hasher.slot_odds(place, 0.8)
    visited = hasher.probes(place, 0.8, 0.99)
    mass = [float(np.prod(odds[np.arange(3), s - np.floor(place).astype(int) + ann.REACH])) for s in visited]
    assert mass == sorted(mass, reverse=True) and len({tuple(s) for s in visited.tolist()}) == len(visited)
    assert sum(mass) >= 0.99
