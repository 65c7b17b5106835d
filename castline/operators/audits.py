"""Audits, diffs and event folding: what is missing, changed, repeated or inconsistent."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.registry import query
from ..plans.tables import Tables


@query(
    "invariant_audit",
    """
SELECT problem, count(*) AS reports FROM (SELECT unnest(list_filter([CASE WHEN fishing_method = 'SPINNING' AND spinning_size IS NULL THEN 'missing:size' END, CASE WHEN fishing_method = 'SPINNING' AND spinning_speed IS NULL THEN 'missing:speed' END,
  CASE WHEN fishing_method = 'BAIT_FISHING' AND fishing_note IS NULL THEN 'missing:note' END, CASE WHEN trim(spot_position_raw) = '' THEN 'blank:spot' END], lambda x: x IS NOT NULL)) AS problem FROM {report}) GROUP BY problem
""",
)
def invariant_audit(t: Tables) -> DataFrame:
    """Fields a fishing method misses, listed per report and counted per problem."""
    spinning = F.col("fishing_method") == "SPINNING"
    found = F.array_compact(F.array(
        F.when(spinning & F.col("spinning_size").isNull(), "missing:size"), F.when(spinning & F.col("spinning_speed").isNull(), "missing:speed"),
        F.when(~spinning & F.col("fishing_note").isNull(), "missing:note"), F.when(F.trim("spot_position_raw") == "", "blank:spot"),
    ))
    return t.report.select(F.explode(found).alias("problem")).groupBy("problem").agg(F.count("*").alias("reports"))


@query(
    "batch_errors",
    """
SELECT r.report_id, array_to_string(list_filter([CASE WHEN f.fish_id IS NULL THEN 'fish' END, CASE WHEN l.location_id IS NULL THEN 'location' END, CASE WHEN m.base_id IS NULL THEN 'membership' END], lambda x: x IS NOT NULL), ',') AS errors
FROM {report} r LEFT JOIN (SELECT * FROM {fish} WHERE is_active) f ON f.fish_id = r.fish_id LEFT JOIN (SELECT * FROM {location} WHERE is_active) l ON l.location_id = r.location_id
LEFT JOIN {member} m ON m.base_id = l.base_id AND m.fish_id = r.fish_id WHERE f.fish_id IS NULL OR l.location_id IS NULL OR m.base_id IS NULL
""",
)
def batch_errors(t: Tables) -> DataFrame:
    """Reports with an inactive fish, an inactive location or no membership, and all their errors."""
    fish = t.fish.where("is_active").select("fish_id", F.lit(1).alias("f"))
    places = t.location.where("is_active").select("location_id", "base_id", F.lit(1).alias("l"))
    rows = t.report.select("report_id", "fish_id", "location_id").join(fish, "fish_id", "left").join(places, "location_id", "left").join(t.member.select("base_id", "fish_id", F.lit(1).alias("m")), ["base_id", "fish_id"], "left")
    errors = F.array_compact(F.array(F.when(F.col("f").isNull(), "fish"), F.when(F.col("l").isNull(), "location"), F.when(F.col("m").isNull(), "membership")))
    return rows.where("f is null or l is null or m is null").select("report_id", F.array_join(errors, ",").alias("errors"))


@query(
    "import_replay",
    """
WITH want AS (SELECT import_key, weight_grams + CASE WHEN report_id % 7 = 0 THEN 1 ELSE 0 END AS g FROM {report} WHERE import_key IS NOT NULL UNION ALL SELECT concat('new:', CAST(fish_id AS VARCHAR)), 1 FROM {fish} WHERE is_rarest),
have AS (SELECT import_key, weight_grams AS g FROM {report} WHERE import_key IS NOT NULL)
SELECT CASE WHEN h.import_key IS NULL THEN 'insert' WHEN h.g = w.g THEN 'skip' ELSE 'conflict' END AS action, count(*) AS n FROM want w LEFT JOIN have h ON h.import_key = w.import_key GROUP BY 1
""",
)
def import_replay(t: Tables) -> DataFrame:
    """What a replayed import would do: equal rows skip, different ones conflict, absent ones go in."""
    have = t.report.where("import_key is not null").select("import_key", F.col("weight_grams").alias("have"))
    again = t.report.where("import_key is not null").select("import_key", (F.col("weight_grams") + F.when(F.col("report_id") % 7 == 0, 1).otherwise(0)).alias("g"))
    new = t.fish.where("is_rarest").select(F.concat(F.lit("new:"), F.col("fish_id").cast("string")).alias("import_key"), F.lit(1).alias("g"))
    action = F.when(F.col("have").isNull(), "insert").when(F.col("have") == F.col("g"), "skip").otherwise("conflict")
    return again.unionByName(new).join(have, "import_key", "left").groupBy(action.alias("action")).agg(F.count("*").alias("n"))


@query("duplicate_keys", "SELECT spot_position_raw, user_note_raw, count(*) AS n FROM {report} GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(t: Tables) -> DataFrame:
    return t.report.groupBy("spot_position_raw", "user_note_raw").agg(F.count("*").alias("n")).where("n > 1")


@query(
    "duplicate_links",
    """
SELECT event_id, CASE WHEN n = 1 THEN second ELSE first END AS linked_to FROM (SELECT event_id, row_number() OVER w AS n, count(*) OVER p AS c, min(event_id) OVER p AS first, nth_value(event_id, 2) OVER (PARTITION BY user_id, event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second
FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY event_id), p AS (PARTITION BY user_id, event_type)) WHERE c > 1
""",
)
def duplicate_links(t: Tables) -> DataFrame:
    """The first of equals points to the second, every later one to the first."""
    p = Window.partitionBy("user_id", "event_type")
    w = p.orderBy("event_id")
    rows = t.raw("events").select("event_id", F.row_number().over(w).alias("n"), F.count("*").over(p).alias("c"), F.min("event_id").over(p).alias("first"), F.nth_value("event_id", 2).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("second"), "user_id", "event_type")
    return rows.where("c > 1").select("event_id", F.when(F.col("n") == 1, F.col("second")).otherwise(F.col("first")).alias("linked_to"))


@query(
    "signed_deltas",
    "SELECT user_id, sum(d) AS delta FROM (SELECT user_id, 1 AS d FROM events WHERE event_type = 'signup' UNION ALL SELECT user_id, -1 FROM events WHERE event_type = 'error') GROUP BY user_id HAVING sum(d) <> 0",
)
def signed_deltas(t: Tables) -> DataFrame:
    """Net change of each key from inserts and deletes, zero changes left out."""
    change = F.when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "error", -1)
    return t.raw("events").select("user_id", change.alias("d")).where("d is not null").groupBy("user_id").agg(F.sum("d").alias("delta")).where("delta <> 0")


@query("latest_state", "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS state FROM events GROUP BY user_id HAVING arg_max(event_type, event_id) <> 'error'")
def latest_state(t: Tables) -> DataFrame:
    """An event log folded to its last state; keys whose last event deletes them are gone."""
    last = t.raw("events").groupBy("user_id").agg(F.max("event_id").alias("event_id"), F.max_by("event_type", "event_id").alias("state"))
    return last.where("state <> 'error'")


@query("activity_page", "SELECT event_id, type, actor_user_id, CAST(json_extract(payload, '$.k') AS BIGINT) AS k FROM {event} WHERE event_id < 900 ORDER BY event_id DESC LIMIT 51")
def activity_page(t: Tables, before: int = 900, limit: int = 50) -> DataFrame:
    """A page of the activity log, newest first, with its payload decoded."""
    rows = t.event.where(F.col("event_id") < before).orderBy(F.desc("event_id")).limit(limit + 1)
    return rows.select("event_id", "type", "actor_user_id", F.from_json("payload", "k bigint")["k"].alias("k"))


@query(
    "field_diff",
    """
WITH p AS (SELECT user_id, event_type, event_id, lag(event_type) OVER w AS was_type, CAST(floor(value) AS BIGINT) AS v, lag(CAST(floor(value) AS BIGINT)) OVER w AS was_v, lag(event_id) OVER w AS was FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT fields, count(*) AS n FROM (SELECT array_to_string(list_filter([CASE WHEN event_type IS DISTINCT FROM was_type THEN 'type' END, CASE WHEN v IS DISTINCT FROM was_v THEN 'value' END], lambda x: x IS NOT NULL), ',') AS fields FROM p WHERE was IS NOT NULL) GROUP BY fields
""",
)
def field_diff(t: Tables) -> DataFrame:
    """Which fields changed from one event of a user to the next."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    v = F.floor("value")
    rows = t.raw("events").select(F.lag("event_id").over(w).alias("was"), "event_type", F.lag("event_type").over(w).alias("was_type"), v.alias("v"), F.lag(v).over(w).alias("was_v"))
    changed = F.array_compact(F.array(F.when(~F.col("event_type").eqNullSafe(F.col("was_type")), "type"), F.when(~F.col("v").eqNullSafe(F.col("was_v")), "value")))
    return rows.where("was is not null").groupBy(F.array_join(changed, ",").alias("fields")).agg(F.count("*").alias("n"))


@query(
    "label_accuracy",
    """
SELECT source, count(*) AS n, count(*) FILTER (WHERE guess = quality) AS hits, count(*) FILTER (WHERE guess = 1) AS claimed, count(*) FILTER (WHERE guess = 1 AND quality = 1) AS right_claims,
  count(*) FILTER (WHERE guess = quality) * 1000 // count(*) AS accuracy_permille, count(*) FILTER (WHERE guess = 1 AND quality = 1) * 1000 // NULLIF(count(*) FILTER (WHERE guess = 1), 0) AS precision_permille
FROM (SELECT d.source, quality, CASE WHEN n_chars >= 600 THEN 1 ELSE 0 END AS guess FROM labels l JOIN documents d ON d.doc_id = l.doc_id) GROUP BY source
""",
)
def label_accuracy(t: Tables) -> DataFrame:
    """Accuracy and precision of a rule against labels, in thousandths; null where nothing was claimed."""
    rows = t.raw("labels").join(t.raw("documents").select("doc_id", "source", "n_chars"), "doc_id").withColumn("guess", F.when(F.col("n_chars") >= 600, 1).otherwise(0))
    sums = rows.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.expr("guess = quality")).alias("hits"), F.count_if(F.expr("guess = 1")).alias("claimed"), F.count_if(F.expr("guess = 1 and quality = 1")).alias("right_claims"))
    return sums.withColumn("accuracy_permille", F.expr("hits * 1000 div n")).withColumn("precision_permille", F.expr("right_claims * 1000 div nullif(claimed, 0)"))
