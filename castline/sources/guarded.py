"""Writes to a partitioned table that know what they replace: guarded batches and idempotent upserts.

A table is Parquet files in folders of one bucket column.  Only the buckets
that change are read whole and written again, first to the checkpoint folder,
then over their folders by one dynamic partition overwrite, whose commit moves
finished files; other folders are not touched.  Nothing is written if nothing
changes, so a replay leaves every file as it was.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpointed

#: Rows of a guarded batch at most.
BATCH_ROWS = 100


class GuardError(ValueError):
    """A batch whose rows are not what it expects; nothing was written."""


def row_hash(columns: list[str], at: Column | None = None) -> Column:
    """SHA-256 of the named columns, in order of name, as one JSON object that keeps nulls."""
    fields = [(at[c] if at is not None else F.col(c)).alias(c) for c in sorted(columns)]
    return F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256)


def _written(spark: SparkSession, path: str, rows: DataFrame, bucket: str) -> None:
    held = checkpointed(rows)
    held.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(bucket).parquet(path)


def apply_batch(spark: SparkSession, path: str, changes: DataFrame, key: str, bucket: str) -> int:
    """Sets columns of rows whose hash is still the expected one; returns the number of rows changed.

    changes holds (key, bucket, before, and the columns to set); ``before`` is the
    ``row_hash`` of the whole row.  All or nothing: a missing or repeated row, or
    one that is neither the expected nor already the wanted row, raises
    GuardError.  A row that is already as wanted counts as applied.
    """
    table = spark.read.parquet(path)
    sets = [c for c in changes.columns if c not in (key, bucket, "before")]
    want = checkpointed(changes)
    n = want.count()
    if n > BATCH_ROWS:
        raise GuardError(f"{n} rows in a batch of {BATCH_ROWS} at most")
    # at most a batch of buckets: the scan reads their folders alone
    buckets = [r[0] for r in want.select(bucket).distinct().collect()]
    touched = table.where(F.col(bucket).isin(buckets))
    wanted = want.select(F.col(key).alias("_key"), F.col(bucket).alias("_bucket"), F.col("before").alias("_before"), *[F.col(c).alias(f"_{c}") for c in sets])
    same = (F.col(key) == F.col("_key")) & (F.col(bucket) == F.col("_bucket"))
    after = F.struct(*[(F.col(f"_{c}") if c in sets else F.col(c)).alias(c) for c in table.columns])
    met = wanted.join(touched, same, "left").select("_key", F.when(F.col(key).isNotNull(), F.when(row_hash(table.columns) == F.col("_before"), "READY").when(row_hash(table.columns) == row_hash(table.columns, after), "APPLIED").otherwise("CHANGED")).otherwise("MISSING").alias("state"))
    states = met.groupBy("_key").agg(F.count("*").alias("n"), F.first("state").alias("state")).collect()
    bad = sorted((str(r["_key"]), r["state"] if r["n"] == 1 else "REPEATED") for r in states if r["n"] != 1 or r["state"] in ("MISSING", "CHANGED"))
    if bad or len(states) != n:
        raise GuardError(f"the batch does not fit the table: {bad or 'null or repeated keys'}")
    ready = [r["_key"] for r in states if r["state"] == "READY"]
    if ready:
        live = wanted.where(F.col("_key").isin(ready))
        places = [r[0] for r in live.select("_bucket").distinct().collect()]
        new = table.where(F.col(bucket).isin(places)).join(F.broadcast(live), same, "left")
        _written(spark, path, new.select(*[(F.when(F.col("_key").isNotNull(), F.col(f"_{c}")).otherwise(F.col(c)) if c in sets else F.col(c)).alias(c) for c in table.columns]), bucket)
    return len(ready)


def upsert(spark: SparkSession, path: str, rows: DataFrame, key: str, bucket: str) -> dict[str, int]:
    """Brings a table to hold the rows: absent keys go in, equal rows skip, different ones are replaced; returns the three counts.

    Repeated or null keys among the rows are an error.  A table that is not there yet is made.
    """
    names = rows.columns
    want = checkpointed(rows)
    if want.where(F.col(key).isNull()).limit(1).count() or want.groupBy(key).count().where("count > 1").limit(1).count():
        raise GuardError("null or repeated keys")
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there):
        want.write.partitionBy(bucket).parquet(path)
        return {"inserted": want.count(), "skipped": 0, "replaced": 0}
    table = spark.read.parquet(path).select(*names)
    have = table.select(F.col(key).alias("_key"), F.col(bucket).alias("_old"), row_hash(names).alias("_hash"))
    kind = F.when(F.col("_key").isNull(), "inserted").when(row_hash(names) == F.col("_hash"), "skipped").otherwise("replaced")
    judged = checkpointed(want.join(have, F.col(key) == F.col("_key"), "left").withColumn("_kind", kind))
    counts = {"inserted": 0, "skipped": 0, "replaced": 0} | {r["_kind"]: r["count"] for r in judged.groupBy("_kind").count().collect()}
    moving = judged.where("_kind <> 'skipped'")
    if counts["inserted"] or counts["replaced"]:
        places = moving.select(F.col(bucket).alias("_b")).union(moving.where("_old is not null").select("_old")).distinct()
        kept = table.join(moving.select(F.col(key).alias("_key")), F.col(key) == F.col("_key"), "left_anti").join(places, F.col(bucket) == F.col("_b"), "left_semi")
        emptied = checkpointed(kept.select(*names).union(moving.select(*names)))
        left = places.join(emptied.select(bucket).distinct(), F.col("_b") == F.col(bucket), "left_anti").count()
        if left:
            raise GuardError("a row that moves would leave its bucket without rows")
        _written(spark, path, emptied, bucket)
    return counts
