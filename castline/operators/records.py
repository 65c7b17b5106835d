"""Weekly record snapshots: weeks, latest versions, assessment, ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.classify import record_status, week_start, weight_class
from ..functions.paging import numbered
from ..plans.registry import query
from ..plans.tables import Tables

WEEK_SQL = "time_bucket(INTERVAL '7 days', caught_at, TIMESTAMP '2023-12-31 19:00:00')"


@query("observation_copies", f"SELECT {WEEK_SQL} AS week, fish_id, base_id, weight_grams, count(*) AS copies FROM {{snapshot}} GROUP BY ALL")
def observation_copies(t: Tables) -> DataFrame:
    """Copies of one observation in a week's snapshots folded into one row."""
    return t.snapshot.groupBy(week_start(F.col("caught_at")).alias("week"), "fish_id", "base_id", "weight_grams").agg(F.count("*").alias("copies"))


@query(
    "weekly_records",
    f"""
WITH w AS (SELECT *, {WEEK_SQL} AS week FROM {{snapshot}}),
n AS (SELECT *, row_number() OVER (PARTITION BY week, fish_id ORDER BY weight_grams DESC, caught_at DESC, event_id DESC) AS n FROM w)
SELECT week, n.fish_id, n.base_id, b.name AS base, weight_grams, event_id FROM n LEFT JOIN {{base}} b ON b.base_id = n.base_id WHERE n = 1
""",
)
def weekly_records(t: Tables) -> DataFrame:
    """The best observation of each fish in each week; its base may be unknown."""
    best = t.snapshot.groupBy(week_start(F.col("caught_at")).alias("week"), "fish_id").agg(F.max(F.struct("weight_grams", "caught_at", "event_id", "base_id")).alias("r"))
    rows = best.select("week", "fish_id", "r.base_id", "r.weight_grams", "r.event_id")
    return rows.join(t.base.select("base_id", F.col("name").alias("base")), "base_id", "left").select("week", "fish_id", "base_id", "base", "weight_grams", "event_id")


@query("week_history", f"SELECT {WEEK_SQL} AS week, count(*) AS n, count(DISTINCT fish_id) AS fish, min(caught_at) AS first_at, max(caught_at) AS last_at FROM {{snapshot}} GROUP BY ALL")
def week_history(t: Tables) -> DataFrame:
    return t.snapshot.groupBy(week_start(F.col("caught_at")).alias("week")).agg(F.count("*").alias("n"), F.countDistinct("fish_id").alias("fish"), F.min("caught_at").alias("first_at"), F.max("caught_at").alias("last_at"))


@query(
    "missing_weeks",
    f"""
WITH w AS (SELECT DISTINCT fish_id, base_id, {WEEK_SQL} AS week FROM {{snapshot}} WHERE base_id IS NOT NULL AND weight_grams >= 20000),
n AS (SELECT *, lead(week) OVER (PARTITION BY fish_id, base_id ORDER BY week) AS next FROM w)
SELECT fish_id, base_id, week AS after_week, CAST(date_diff('day', week, next) // 7 - 1 AS BIGINT) AS missing FROM n WHERE date_diff('day', week, next) > 7
""",
)
def missing_weeks(t: Tables, least: int = 20000) -> DataFrame:
    """Gaps of whole weeks between the weeks a pair was seen in at a weight or more."""
    weeks = t.snapshot.where(F.col("base_id").isNotNull() & (F.col("weight_grams") >= least)).select("fish_id", "base_id", week_start(F.col("caught_at")).alias("week")).distinct()
    following = F.lead("week").over(Window.partitionBy("fish_id", "base_id").orderBy("week"))
    days = F.datediff("next", "week")
    return weeks.withColumn("next", following).where(days > 7).select("fish_id", "base_id", F.col("week").alias("after_week"), (F.floor(days / 7) - 1).cast("long").alias("missing"))


def fish_maxima(t: Tables) -> DataFrame:
    """Each fish's largest known maximum and the array of the bases that have it, sorted by name."""
    rows = t.member.where("max_weight_grams is not null").join(t.base.select("base_id", "name"), "base_id")
    top = F.max("max_weight_grams").over(Window.partitionBy("fish_id"))
    best = rows.withColumn("top", top).where("max_weight_grams = top")
    return best.groupBy("fish_id").agg(F.first("top").alias("max_grams"), F.sort_array(F.collect_list("name")).alias("max_bases"))


@query(
    "records_assessment",
    """
WITH m AS (SELECT *, max(max_weight_grams) OVER (PARTITION BY fish_id) AS top FROM {member} WHERE max_weight_grams IS NOT NULL),
x AS (SELECT m.fish_id, min(top) AS max_grams, string_agg(b.name, ',' ORDER BY b.name) AS max_bases FROM m JOIN {base} b ON b.base_id = m.base_id WHERE max_weight_grams = top GROUP BY m.fish_id),
r AS (SELECT fish_id, max(weight_grams) AS record_grams FROM {report} GROUP BY fish_id)
SELECT f.fish_id, r.record_grams, x.max_grams, x.max_bases, CAST(x.max_grams - r.record_grams AS BIGINT) AS headroom,
  CASE WHEN r.record_grams IS NULL THEN 'NO_RECORD' WHEN max_grams IS NULL THEN 'MAX_UNKNOWN' WHEN max_grams < r.record_grams THEN 'MUTANT' WHEN max_grams = r.record_grams THEN 'MAXIMUM'
       WHEN (max_grams - r.record_grams) * 1000 <= max_grams * 3 THEN 'NEAR_MAX' ELSE 'CAN_BEAT' END AS status
FROM {fish} f LEFT JOIN r ON r.fish_id = f.fish_id LEFT JOIN x ON x.fish_id = f.fish_id WHERE f.is_active
""",
)
def records_assessment(t: Tables) -> DataFrame:
    """Every active fish's record against its largest known maximum."""
    records = t.report.groupBy("fish_id").agg(F.max("weight_grams").alias("record_grams"))
    rows = t.fish.where("is_active").select("fish_id").join(records, "fish_id", "left").join(fish_maxima(t), "fish_id", "left")
    room = (F.col("max_grams") - F.col("record_grams")).cast("long")
    return rows.select("fish_id", "record_grams", "max_grams", F.array_join("max_bases", ",").alias("max_bases"), room.alias("headroom"), record_status(F.col("record_grams"), F.col("max_grams")).alias("status"))


@query(
    "records_ranked",
    """
WITH m AS (SELECT fish_id, max(max_weight_grams) AS max_grams FROM {member} GROUP BY fish_id), r AS (SELECT fish_id, max(weight_grams) AS g FROM {report} GROUP BY fish_id),
s AS (SELECT f.fish_id, f.name_normalized, CASE WHEN g IS NULL THEN 4 WHEN max_grams IS NULL THEN 5 WHEN max_grams < g THEN 0 WHEN max_grams = g THEN 1 WHEN (max_grams - g) * 1000 <= max_grams * 3 THEN 2 ELSE 3 END AS bucket, max_grams - g AS room
  FROM {fish} f LEFT JOIN r ON r.fish_id = f.fish_id LEFT JOIN m ON m.fish_id = f.fish_id)
SELECT fish_id, bucket, row_number() OVER (ORDER BY bucket, CASE WHEN bucket IN (1, 3) THEN room END DESC NULLS LAST, name_normalized, fish_id) AS n FROM s
""",
)
def records_ranked(t: Tables) -> DataFrame:
    """Default order of the records list: status buckets, headroom inside two of them, then name."""
    maxima = t.member.groupBy("fish_id").agg(F.max("max_weight_grams").alias("max_grams"))
    records = t.report.groupBy("fish_id").agg(F.max("weight_grams").alias("g"))
    rows = t.fish.select("fish_id", "name_normalized").join(records, "fish_id", "left").join(maxima, "fish_id", "left")
    status = record_status(F.col("g"), F.col("max_grams"))
    bucket = F.lit(5)
    for i, name in enumerate(("MUTANT", "MAXIMUM", "NEAR_MAX", "CAN_BEAT", "NO_RECORD")):
        bucket = F.when(status == name, i).otherwise(bucket)
    rows = rows.withColumn("bucket", bucket).withColumn("room", F.when(F.col("bucket").isin(1, 3), F.col("max_grams") - F.col("g")))
    keys = [F.col("bucket"), F.desc_nulls_last("room"), F.col("name_normalized"), F.col("fish_id")]
    return numbered(rows, keys).select("fish_id", "bucket", "n")


@query(
    "weight_classes",
    """
SELECT l.base_id, CASE WHEN weight_grams < min_weight_grams THEN 'SUSPICIOUS_LOW' WHEN weight_grams > max_weight_grams AND CAST(weight_grams AS BIGINT) * 20 <= CAST(max_weight_grams AS BIGINT) * 21 THEN 'MUTANT'
  WHEN weight_grams > max_weight_grams THEN 'SUSPICIOUS_HIGH' WHEN min_weight_grams IS NOT NULL AND max_weight_grams IS NOT NULL THEN 'ORDINARY' ELSE 'UNCLASSIFIED' END AS class, count(*) AS reports
FROM {report} r JOIN {location} l ON l.location_id = r.location_id LEFT JOIN {member} m ON m.base_id = l.base_id AND m.fish_id = r.fish_id GROUP BY ALL
""",
)
def weight_classes(t: Tables) -> DataFrame:
    """Reports by base and weight class against the membership's bounds."""
    rows = t.report.select("location_id", "fish_id", "weight_grams").join(t.location.select("location_id", "base_id"), "location_id").join(t.member, ["base_id", "fish_id"], "left")
    return rows.groupBy("base_id", weight_class(F.col("weight_grams"), F.col("min_weight_grams"), F.col("max_weight_grams")).alias("class")).agg(F.count("*").alias("reports"))
