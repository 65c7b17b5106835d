"""Who is who: identities from several keys, suffix names, candidate matches, constraints, emitted events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.classify import week_start
from ..plans.registry import query
from ..plans.tables import Tables
from .records import WEEK_SQL

#: Row constraints of reports; as in a CHECK, null is no violation.
CONSTRAINTS = {
    "weight_positive": "weight_grams > 0",
    "depth_positive": "hole_depth_cm > 0",
    "spinning_without_note": "fishing_method <> 'SPINNING' OR fishing_note IS NULL",
    "bait_without_size": "fishing_method <> 'BAIT_FISHING' OR spinning_size IS NULL",
    "spot_not_blank": "trim(spot_position_raw) <> ''",
}


@query(
    "resolved_identities",
    """
WITH f AS (SELECT fish_id, concat(name_normalized, ' ', fish_id // 20) AS name FROM {fish}), n AS (SELECT name, min(fish_id) AS by_name FROM f GROUP BY name HAVING count(*) = 1),
x AS (SELECT e.event_id, CASE WHEN e.event_id % 5 <> 0 THEN f.fish_id + CASE WHEN e.event_id % 31 = 0 THEN 1 ELSE 0 END END AS by_image, CASE WHEN e.event_id % 7 <> 0 THEN f.name END AS name, e.base_id
  FROM {snapshot} e JOIN f ON f.fish_id = e.fish_id)
SELECT event_id, CASE WHEN by_image <> by_name THEN 'CONFLICT' WHEN coalesce(by_image, by_name) IS NULL THEN 'UNKNOWN' ELSE 'RESOLVED' END AS status,
  CASE WHEN by_image <> by_name THEN NULL ELSE coalesce(by_image, by_name) END AS fish_id, b.name AS base
FROM x LEFT JOIN n ON n.name = x.name LEFT JOIN {base} b ON b.base_id = x.base_id
""",
)
def resolved_identities(t: Tables) -> DataFrame:
    """Observations that show an image, a name or both: keys that disagree are a conflict, names held twice tell nothing, the base may stay null."""
    fish = t.fish.select("fish_id", F.concat_ws(" ", "name_normalized", F.floor(F.col("fish_id") / 20).cast("string")).alias("name"))
    unique = fish.groupBy("name").agg(F.min("fish_id").alias("by_name"), F.count("*").alias("n")).where("n = 1").drop("n")
    images = t.fish.select(F.concat(F.lit("image-"), F.col("fish_id").cast("string")).alias("image"), F.col("fish_id").alias("by_image"))
    event = F.col("event_id")
    shown = t.snapshot.join(fish, "fish_id").select(
        "event_id", "base_id", F.when(event % 5 != 0, F.concat(F.lit("image-"), (F.col("fish_id") + F.when(event % 31 == 0, 1).otherwise(0)).cast("string"))).alias("image"), F.when(event % 7 != 0, F.col("name")).alias("name")
    )
    rows = shown.join(images, "image", "left").join(unique, "name", "left").join(t.base.select("base_id", F.col("name").alias("base")), "base_id", "left")
    conflict, known = F.col("by_image") != F.col("by_name"), F.coalesce("by_image", "by_name")
    return rows.select("event_id", F.when(conflict, "CONFLICT").when(known.isNull(), "UNKNOWN").otherwise("RESOLVED").alias("status"), F.when(conflict, None).otherwise(known).alias("fish_id"), "base")


@query(
    "suffix_match",
    """
WITH f AS (SELECT fish_id, concat(name, ' ', fish_id // 20) AS name FROM {fish}), k AS (SELECT name, count(*) AS n, min(fish_id) AS fish_id FROM f GROUP BY name),
x AS (SELECT fish_id AS line_id, concat('a very big ', name, CASE WHEN fish_id % 5 = 0 THEN ' maybe' ELSE '' END) AS line FROM f),
m AS (SELECT line_id, max_by(k, length(k.name)) AS k FROM x JOIN k ON ends_with(line, concat(' ', k.name)) GROUP BY line_id)
SELECT x.line_id, k.name, CASE WHEN k.n IS NULL THEN 'NOT_FOUND' WHEN k.n = 1 THEN 'UNIQUE' ELSE 'AMBIGUOUS' END AS status, CASE WHEN k.n = 1 THEN k.fish_id END AS fish_id FROM x LEFT JOIN m ON m.line_id = x.line_id
""",
)
def suffix_match(t: Tables) -> DataFrame:
    """The longest catalog name that a line ends with, from a word's start; an ambiguous long one is not replaced by a shorter one."""
    tail = F.when(F.col("fish_id") % 5 == 0, " maybe").otherwise("")
    fish = t.fish.select("fish_id", F.concat_ws(" ", "name", F.floor(F.col("fish_id") / 20).cast("string")).alias("name"))
    lines = fish.select(F.col("fish_id").alias("line_id"), F.split(F.concat(F.lit("a very big "), "name", tail), " ").alias("words"))
    names = fish.groupBy("name").agg(F.count("*").alias("n"), F.min("fish_id").alias("fish_id"))
    # an equi-join on the line's own suffixes of as many words as names have: a row a word count
    counts = names.select(F.size(F.split("name", " ")).alias("count")).distinct()
    ends = lines.select("line_id", F.size("words").alias("size"), "words", F.posexplode(F.reverse(F.sequence(F.lit(1), F.size("words")))).alias("at", "first")).select("line_id", (F.col("at") + 1).alias("count"), F.slice("words", F.col("first"), F.col("size")).alias("end"))
    tried = ends.join(F.broadcast(counts), "count").select("line_id", F.array_join("end", " ").alias("name"))
    found = tried.join(names, "name").groupBy("line_id").agg(F.max(F.struct(F.length("name").alias("size"), "name", "n", "fish_id")).alias("k"))
    longest = lines.select("line_id").join(found, "line_id", "left")
    n = F.col("k.n")
    return longest.select("line_id", "k.name", F.when(n.isNull(), "NOT_FOUND").when(n == 1, "UNIQUE").otherwise("AMBIGUOUS").alias("status"), F.when(n == 1, F.col("k.fish_id")).alias("fish_id"))


@query(
    "candidate_matches",
    """
WITH s AS (SELECT import_key, weight_grams + CASE WHEN report_id % 11 = 0 THEN 1 ELSE 0 END AS weight_grams, fish_id + CASE WHEN report_id % 13 = 0 THEN 1 ELSE 0 END AS fish_id, copy
  FROM {report}, (VALUES (1), (2)) v(copy) WHERE import_key IS NOT NULL AND report_id % 7 <> 0 AND (copy = 1 OR report_id % 17 = 0)),
k AS (SELECT import_key, count(*) AS n, min(weight_grams) AS weight_grams, min(fish_id) AS fish_id FROM s GROUP BY import_key)
SELECT report_id, CASE WHEN k.n IS NULL THEN 'MISSING' WHEN k.n > 1 THEN 'AMBIGUOUS' WHEN k.weight_grams = r.weight_grams AND k.fish_id = r.fish_id THEN 'EXACT' ELSE 'MISMATCH' END AS status,
  CASE WHEN k.n > 1 THEN 'import_key' WHEN k.n = 1 THEN concat_ws(',', CASE WHEN k.weight_grams <> r.weight_grams THEN 'weight_grams' END, CASE WHEN k.fish_id <> r.fish_id THEN 'fish_id' END) ELSE '' END AS fields
FROM {report} r LEFT JOIN k ON k.import_key = r.import_key WHERE r.import_key IS NOT NULL
""",
)
def candidate_matches(t: Tables) -> DataFrame:
    """Imported reports against staged candidates of their key: exact, missing, ambiguous, or different in the named fields."""
    rows = t.report.where("import_key is not null").select("report_id", "import_key", "weight_grams", "fish_id")
    off = lambda n: F.when(F.col("report_id") % n == 0, 1).otherwise(0)
    copies = F.when(F.col("report_id") % 17 == 0, 2).otherwise(1)
    staged = rows.where("report_id % 7 <> 0").select("import_key", F.explode(F.array_repeat(F.struct((F.col("weight_grams") + off(11)).alias("weight_grams"), (F.col("fish_id") + off(13)).alias("fish_id")), copies)).alias("s"))
    return matched(rows, staged.select("import_key", "s.*"), "import_key", ["weight_grams", "fish_id"]).select("report_id", "status", "fields")


def matched(rows: DataFrame, candidates: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """rows with the status of their candidates and the fields that differ; candidates fold to one row a key before the join."""
    folded = candidates.groupBy(key).agg(F.count("*").alias("_n"), *[F.min(f).alias(f"_{f}") for f in fields])
    differ = F.array_join(F.array_compact(F.array(*[F.when(~F.col(f).eqNullSafe(F.col(f"_{f}")), f) for f in fields])), ",")
    n = F.col("_n")
    joined = rows.join(folded, key, "left").withColumn("fields", F.when(n > 1, key).when(n == 1, differ).otherwise(""))
    return joined.withColumn("status", F.when(n.isNull(), "MISSING").when(n > 1, "AMBIGUOUS").when(F.col("fields") == "", "EXACT").otherwise("MISMATCH"))


@query(
    "owner_notebook",
    """
WITH o AS (SELECT l.base_id, r.fish_id, max_by(user_note_raw, report_id) AS note FROM {report} r JOIN {location} l ON l.location_id = r.location_id WHERE user_id = 7 AND user_note_raw IS NOT NULL GROUP BY ALL)
SELECT m.base_id, m.fish_id, f.is_active, note FROM {member} m JOIN {fish} f ON f.fish_id = m.fish_id LEFT JOIN o ON o.base_id = m.base_id AND o.fish_id = m.fish_id
""",
)
def owner_notebook(t: Tables, user_id: int = 7) -> DataFrame:
    """All fish of all bases, inactive ones too, with an owner's latest note where there is one."""
    own = t.report.where((F.col("user_id") == user_id) & F.col("user_note_raw").isNotNull()).join(t.location.select("location_id", "base_id"), "location_id")
    notes = own.groupBy("base_id", "fish_id").agg(F.max_by("user_note_raw", "report_id").alias("note"))
    return t.member.select("base_id", "fish_id").join(t.fish.select("fish_id", "is_active"), "fish_id").join(notes, ["base_id", "fish_id"], "left").select("base_id", "fish_id", "is_active", "note")


@query("constraint_violations", " UNION ALL ".join(f"SELECT '{name}' AS name, count(*) FILTER (WHERE NOT ({rule})) AS violations FROM {{report}}" for name, rule in CONSTRAINTS.items()))
def constraint_violations(t: Tables) -> DataFrame:
    """Violations of every row constraint, counted in one scan; kept ones count zero."""
    return t.report.agg(*[F.count_if(~F.expr(rule)).alias(name) for name, rule in CONSTRAINTS.items()]).unpivot([], list(CONSTRAINTS), "name", "violations")


@query(
    "changed_snapshots",
    f"""
WITH d AS (SELECT fish_id, {WEEK_SQL} AS week, CAST(caught_at AS DATE) AS day, max(weight_grams) // 10000 AS best FROM {{snapshot}} GROUP BY ALL)
SELECT fish_id, day, sha256(CAST(best AS VARCHAR)) AS content FROM d QUALIFY best IS DISTINCT FROM lag(best) OVER (PARTITION BY fish_id, week ORDER BY day)
""",
)
def changed_snapshots(t: Tables) -> DataFrame:
    """A fish's daily content, kept where it differs from the day kept before it in the same week."""
    days = t.snapshot.groupBy("fish_id", week_start(F.col("caught_at")).alias("week"), F.col("caught_at").cast("date").alias("day")).agg(F.max("weight_grams").alias("top"))
    content = days.withColumn("content", F.sha2(F.expr("top div 10000").cast("string"), 256))
    before = F.lag("content").over(Window.partitionBy("fish_id", "week").orderBy("day"))
    return content.withColumn("before", before).where(~F.col("content").eqNullSafe(F.col("before"))).select("fish_id", "day", "content")


@query(
    "emitted_events",
    """
WITH e AS (SELECT *, lag(payload) OVER (PARTITION BY actor_user_id ORDER BY occurred_at, event_id) AS before FROM {event})
SELECT event_id, type, CASE WHEN type = 'CATCH_REPORT_DELETED' THEN before END AS pre_image FROM e WHERE type <> 'CATCH_REPORT_UPDATED' OR payload IS DISTINCT FROM before
""",
)
def emitted_events(t: Tables) -> DataFrame:
    """What an actor's mutations emit: an update that changes nothing emits nothing, a deletion carries the state before it."""
    before = F.lag("payload").over(Window.partitionBy("actor_user_id").orderBy("occurred_at", "event_id"))
    rows = t.event.select("event_id", "type", "payload", before.alias("before"))
    kept = rows.where((F.col("type") != "CATCH_REPORT_UPDATED") | ~F.col("payload").eqNullSafe(F.col("before")))
    return kept.select("event_id", "type", F.when(F.col("type") == "CATCH_REPORT_DELETED", F.col("before")).alias("pre_image"))
