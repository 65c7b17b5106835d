"""Pages over nullable keys, and numbers of whole tables."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from castline.functions.paging import after, numbered, ordering


@pytest.mark.parametrize("ways", list(itertools.product(["asc", "desc"], repeat=3)))
def test_pages_meet_every_row_once(spark, ways):
    rng = random.Random(1)
    rows = [(rng.choice([None, 1, 2]), rng.choice([None, "a", "b"]), i) for i in range(40)]
    keys = list(zip(["x", "y", "i"], ways))
    frame = spark.createDataFrame(rows, "x int, y string, i int").coalesce(1).cache()
    whole = [tuple(r) for r in frame.orderBy(*ordering(keys)).collect()]
    for at in range(0, 40, 7):
        cursor = dict(zip("xyi", whole[at]))
        assert [tuple(r) for r in frame.where(after(keys, cursor)).orderBy(*ordering(keys)).collect()] == whole[at + 1 :]
    frame.unpersist()


def test_numbered(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, *range(5)]), i) for i in range(300)]
    order = [F.col("x").desc_nulls_last(), F.col("i")]
    got = {r["i"]: r["n"] for r in numbered(spark.createDataFrame(rows, "x int, i int").repartition(7), order).collect()}
    want = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    assert got == {i: n for n, (_, i) in enumerate(want, 1)}
    assert numbered(spark.range(0), [F.col("id")]).count() == 0
