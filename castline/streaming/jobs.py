"""Streams over the event log: weekly windows, maintained counts, dedup, change-gated snapshots."""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.classify import WEEK_START
from ..plans.registry import query
from ..plans.tables import Tables
from ..session import shared_folder

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def event_stream(t: Tables, files_per_trigger: int = 1, lateness: str | None = "1 day") -> DataFrame:
    """New files of the event log as a stream, with a watermark on the event time unless ``lateness`` is None."""
    path = f"{t.sf_dir}/events.parquet"
    rows = t.spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).option("recursiveFileLookup", "true").parquet(path)
    rows = rows.withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.withWatermark("ts", lateness) if lateness else rows


def shared_path(t: Tables, name: str) -> str:
    return f"{shared_folder(t.spark)}/{name}-{uuid.uuid4().hex}"


def run_once(t: Tables, stream: DataFrame, mode: str, name: str) -> DataFrame:
    """Runs a stream over all that is there and returns what its sink holds, the last version of each key in update mode."""
    out, at = shared_path(t, name), shared_path(t, f"{name}-checkpoint")
    if mode == "append":
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", at).outputMode("append").trigger(availableNow=True).start().awaitTermination()
        return t.spark.read.schema(stream.schema).parquet(out)

    def put(batch: DataFrame, batch_id: int) -> None:
        # a replayed batch overwrites its own folder, so each version is there once
        batch.withColumn("batch", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{out}/b={batch_id}")

    stream.writeStream.foreachBatch(put).option("checkpointLocation", at).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.option("recursiveFileLookup", "true").parquet(out)


@query(
    "stream_maintained_counts",
    "SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value >= 1) AS valued FROM events GROUP BY event_type",
)
def stream_maintained_counts(t: Tables) -> DataFrame:
    """Counts kept up to date by each micro-batch; the last version of a key is its count."""
    counts = event_stream(t).groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.expr("value >= 1")).alias("valued"))
    versions = run_once(t, counts, "update", "counts")
    return versions.groupBy("event_type").agg(F.max_by("n", "batch").alias("n"), F.max_by("valued", "batch").alias("valued"))


@query(
    "stream_weekly_windows",
    "SELECT time_bucket(INTERVAL '7 days', ts, TIMESTAMP '2023-12-31 19:00:00') AS week, event_type, count(*) AS n, max(event_id) AS last_event FROM events GROUP BY ALL",
)
def stream_weekly_windows(t: Tables) -> DataFrame:
    """Tumbling record weeks over event time; files may come in any order, as the state is a few rows a week and none is late."""
    counts = event_stream(t, lateness=None).groupBy(F.window("ts", "7 days", startTime=WEEK_START), "event_type").agg(F.count("*").alias("n"), F.max("event_id").alias("last_event"))
    versions = run_once(t, counts.select(F.col("window.start").alias("week"), "event_type", "n", "last_event"), "update", "weeks")
    return versions.groupBy(F.col("week").cast("timestamp_ntz").alias("week"), "event_type").agg(F.max_by("n", "batch").alias("n"), F.max_by("last_event", "batch").alias("last_event"))


@query("stream_distinct_events", "SELECT DISTINCT event_id, user_id, event_type FROM events")
def stream_distinct_events(t: Tables) -> DataFrame:
    """Events once each, however often they arrive; copies and files more than 400 days behind the newest event are late and dropped."""
    once = event_stream(t, lateness="400 days").dropDuplicatesWithinWatermark(["event_id"]).select("event_id", "user_id", "event_type")
    return run_once(t, once, "append", "distinct")


@query(
    "stream_enriched_snapshots",
    "SELECT e.event_id, user_id % 40 AS fish_id, b.name AS base FROM events e LEFT JOIN {base} b ON b.base_id = user_id % 5 WHERE value >= 1",
)
def stream_enriched_snapshots(t: Tables) -> DataFrame:
    """A stream joined to the catalog as it stands."""
    rows = event_stream(t).where("value >= 1").select("event_id", (F.col("user_id") % 40).alias("fish_id"), (F.col("user_id") % 5).cast("int").alias("base_id"))
    return run_once(t, rows.join(t.base.select("base_id", F.col("name").alias("base")), "base_id", "left").select("event_id", "fish_id", "base"), "append", "enriched")


def append_if_changed(batch: DataFrame, path: str, at: str, week: datetime, now: datetime, version: str = "1") -> bool:
    """Appends a week's snapshot unless its rows and version equal the week's latest; for use in foreachBatch.

    A row whose time ``at`` lies outside the week or over five minutes after
    ``now`` fails the whole batch.  Rows go to rows/seq=N before the log names
    N, so a replay after a loss overwrites what no log entry names yet.  An
    empty batch is an empty snapshot.
    """
    spark, time = batch.sparkSession, F.col(at).cast("timestamp_ntz")
    columns = sorted(batch.columns)
    total = lambda salt: F.sum(F.xxhash64(F.lit(salt), *[F.struct(c) for c in columns]).cast("decimal(38,0)"))
    inside = (time >= F.lit(week)) & (time < F.lit(week + timedelta(days=7))) & (time <= F.lit(now + timedelta(minutes=5)))
    seen = batch.agg(F.count("*").alias("n"), F.count_if(~F.coalesce(inside, F.lit(False))).alias("odd"), total(1).alias("a"), total(2).alias("b")).first()
    if seen["odd"]:
        raise ValueError(f"{seen['odd']} rows are outside the week or in the future")
    content = f"{seen['n']}:{seen['a']}:{seen['b']}"
    log = "week timestamp_ntz, seq long, content string, version string"
    try:
        entries = spark.read.schema(log).parquet(f"{path}/log")
        latest = entries.where(F.col("week") == F.lit(week)).agg(F.max(F.struct("seq", "content", "version")).alias("m")).first()["m"]
        seq = (entries.agg(F.max("seq")).first()[0] or 0) + 1
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        latest, seq = None, 1
    if latest and (latest["content"], latest["version"]) == (content, version):
        return False
    batch.write.mode("overwrite").parquet(f"{path}/rows/seq={seq}")
    spark.createDataFrame([(week, seq, content, version)], log).coalesce(1).write.mode("append").parquet(f"{path}/log")
    return True
