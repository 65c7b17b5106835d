"""Guarded batches and upserts: what is written, what is left alone, what is refused."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from castline.sources.guarded import BATCH_ROWS, GuardError, apply_batch, row_hash, upsert

ROWS = [(i, None if i % 3 else f"note {i}", i * 10, i % 4) for i in range(40)]
SCHEMA = "id long, note string, g long, bucket int"


def files(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/bucket=*/*.parquet")}


def rows(spark, path):
    return sorted(tuple(r) for r in spark.read.parquet(path).select("id", "note", "g", "bucket").collect())


@pytest.fixture
def path(spark, tmp_path):
    spark.createDataFrame(ROWS, SCHEMA).write.partitionBy("bucket").parquet(f"{tmp_path}/t")
    return f"{tmp_path}/t"


def batch(spark, path, ids, note="new"):
    table = spark.read.parquet(path)
    found = table.where(F.col("id").isin(ids)).select("id", "bucket", row_hash(table.columns).alias("before"), F.lit(note).alias("note"))
    return spark.createDataFrame(found.collect(), found.schema)


def test_batch_touches_its_buckets_alone_and_replays(spark, path):
    changes, before = batch(spark, path, [1, 5, 2]), files(path)
    assert apply_batch(spark, path, changes, "id", "bucket") == 3
    after = files(path)
    assert {f for f in before if "bucket=0" in f or "bucket=3" in f} == {f for f in after if before.get(f) == after[f]}
    assert rows(spark, path) == sorted((i, "new" if i in (1, 5, 2) else note, g, b) for i, note, g, b in ROWS)
    assert apply_batch(spark, path, changes, "id", "bucket") == 0 and files(path) == after


def test_half_applied_batch_goes_on(spark, path):
    changes = batch(spark, path, [1, 2, 3])
    apply_batch(spark, path, changes.where("id = 2"), "id", "bucket")
    assert apply_batch(spark, path, changes, "id", "bucket") == 2
    assert [r[1] for r in rows(spark, path)[1:4]] == ["new"] * 3


def test_changed_pre_image_fails_the_whole_batch(spark, path):
    changes = batch(spark, path, [1, 2])
    apply_batch(spark, path, batch(spark, path, [2], "other"), "id", "bucket")
    before = files(path)
    with pytest.raises(GuardError, match="CHANGED"):
        apply_batch(spark, path, changes, "id", "bucket")
    assert files(path) == before


def test_missing_repeated_and_oversized_batches_fail(spark, path):
    before = files(path)
    one = batch(spark, path, [1])
    for bad in (one.withColumn("id", F.lit(99).cast("long")), one.union(one), one.withColumn("id", F.lit(None).cast("long")), spark.range(BATCH_ROWS + 1).selectExpr("id", "0 bucket", "'' before", "'x' note")):
        with pytest.raises(GuardError):
            apply_batch(spark, path, bad, "id", "bucket")
    assert files(path) == before
    assert apply_batch(spark, path, one.limit(0), "id", "bucket") == 0


def test_null_is_a_value_of_its_own(spark):
    frame = spark.createDataFrame([(1, None, ""), (1, "", None)], "id long, a string, b string")
    assert frame.select(row_hash(frame.columns).alias("h")).distinct().count() == 2


def test_upsert(spark, tmp_path):
    path = f"{tmp_path}/u"
    frame = lambda rs: spark.createDataFrame(rs, SCHEMA)
    assert upsert(spark, path, frame(ROWS), "id", "bucket") == {"inserted": 40, "skipped": 0, "replaced": 0}
    before = files(path)
    assert upsert(spark, path, frame(ROWS), "id", "bucket") == {"inserted": 0, "skipped": 40, "replaced": 0} and files(path) == before
    new = [(0, "changed", 0, 0), (4, None, 40, 0), (5, "moved", 50, 2), (100, "x", 1, 9)]
    assert upsert(spark, path, frame(new), "id", "bucket") == {"inserted": 1, "skipped": 1, "replaced": 2}
    want = {r[0]: r for r in ROWS} | {r[0]: r for r in new}
    assert rows(spark, path) == sorted(want.values())
    assert {f for f in before if "bucket=3" in f} <= set(files(path))
    for bad in ([(1, None, 1, 1), (1, None, 2, 1)], [(None, None, 1, 1)]):
        with pytest.raises(GuardError):
            upsert(spark, path, frame(bad), "id", "bucket")
