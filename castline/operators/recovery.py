"""Recovery of comments in guarded batches, and replayed upserts, over a table made of the orders, whose keys are unique."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.registry import query
from ..plans.tables import Tables
from ..session import shared_folder
from ..sources.guarded import apply_batch, row_hash, upsert

BUCKETS = 16


def comment_table(t: Tables) -> DataFrame:
    note = F.when(F.col("o_orderstatus") != "P", F.concat(F.lit("note "), "o_orderstatus"))
    return t.raw("orders").select(F.col("o_orderkey").alias("report_id"), note.alias("note"), F.col("o_custkey").alias("weight_grams"), (F.col("o_orderkey") % BUCKETS).cast("int").alias("bucket"))


@query(
    "guarded_recovery",
    """
WITH x AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS n FROM orders WHERE o_orderstatus = 'P'),
y AS (SELECT r.o_orderkey % 16 AS bucket, CASE WHEN n <= 100 THEN 'recovered ' || r.o_orderkey WHEN o_orderstatus <> 'P' THEN 'note ' || o_orderstatus END AS note, o_custkey AS g FROM orders r LEFT JOIN x ON x.o_orderkey = r.o_orderkey)
SELECT bucket, count(*) AS rows, count(note) AS notes, count(*) FILTER (WHERE note LIKE 'recovered%') AS recovered, CAST(sum(g) AS BIGINT) AS grams FROM y GROUP BY bucket
""",
)
def guarded_recovery(t: Tables) -> DataFrame:
    """The first batch of rows without a comment gets one, twice over; the second time changes nothing."""
    path = f"{shared_folder(t.spark)}/comments-{uuid.uuid4().hex}"
    comment_table(t).write.partitionBy("bucket").parquet(path)
    table = t.spark.read.parquet(path)
    batch = table.where("note is null").select("report_id", "bucket", row_hash(table.columns).alias("before"), F.concat(F.lit("recovered "), F.col("report_id").cast("string")).alias("note")).orderBy("report_id").limit(100)
    batch = t.spark.createDataFrame(batch.collect(), batch.schema)
    for _ in range(2):
        apply_batch(t.spark, path, batch, "report_id", "bucket")
    out = t.spark.read.parquet(path)
    return out.groupBy(F.col("bucket").cast("long").alias("bucket")).agg(F.count("*").alias("rows"), F.count("note").alias("notes"), F.count_if(F.col("note").startswith("recovered")).alias("recovered"), F.sum("weight_grams").alias("grams"))


@query(
    "upserted_reports",
    """
SELECT o_orderkey % 16 AS bucket, count(*) AS rows, CAST(sum(o_custkey + CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 7 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS grams FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 5 = 0 GROUP BY ALL
""",
)
def upserted_reports(t: Tables) -> DataFrame:
    """Rows put in by two overlapping loads, of which the second replaces some, adds some and skips the rest."""
    path = f"{shared_folder(t.spark)}/upserts-{uuid.uuid4().hex}"
    rows = comment_table(t)
    upsert(t.spark, path, rows.where("report_id % 5 = 0"), "report_id", "bucket")
    changed = F.col("weight_grams") + F.when(F.col("report_id") % 7 == 0, 1).otherwise(0)
    upsert(t.spark, path, rows.where("report_id % 3 = 0").withColumn("weight_grams", changed), "report_id", "bucket")
    return t.spark.read.parquet(path).groupBy(F.col("bucket").cast("long").alias("bucket")).agg(F.count("*").alias("rows"), F.sum("weight_grams").alias("grams"))
