"""Parsed candidates resolved against the catalog: a status for every field, folded into one for the row.

Each named field joins a small table of the catalog's keys that knows how many
entries share a key: none, one, or several; places only count inside the base
that was resolved.  Every test adds an issue (code, field); an issue that blocks
makes a row UNRESOLVED, one that only misses a required field USABLE_PARTIAL,
none USABLE_COMPLETE.  It is one pass: five equi-joins and a projection.

Defined results: a null name is missing, one that is no name is invalid, an
inactive entry does not resolve; repeated rows are judged alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.texts import catalog_name, edges_trimmed
from ..plans.registry import query
from ..plans.tables import Tables

#: The largest whole number, the longest text; forms of keys.
INT_MAX, TEXT_MAX = (1 << 31) - 1, 1000
CONTRIBUTOR_KEY, IMPORT_KEY = r"^external:[0-9a-z:-]+\z", r"^imp:[0-9]+\z"
#: Fields whose parse issues do not block.
OPTIONAL = ["hole_depth_cm", "spot", "fishing_note", "spinning_size", "spinning_speed", "user_note"]
UPPER = {"fish": "FISH", "base": "BASE", "place": "PLACE", "bait": "BAIT"}


def named(rows: DataFrame, field: str, names: DataFrame, scope: list[str] | None = None, extra: str | None = None) -> DataFrame:
    """rows plus (<field>_id, <field>_reason): the entry of names (scope, name_id, name, is_active) that the row's name means, or why none."""
    scope = scope or []
    columns = [F.count("*").alias("_n"), F.min("name_id").alias("_id"), F.min("is_active").alias("_active"), *([F.min(extra).alias(f"_{extra}")] if extra else [])]
    keys = names.select(*[F.col(c).alias(f"_{c}") for c in scope], catalog_name(F.col("name")).alias("_key"), "name_id", "is_active", *([extra] if extra else [])).groupBy(*[f"_{c}" for c in scope], "_key").agg(*columns)
    held = rows.withColumn("_own", catalog_name(F.col(field)))
    joined = held.join(keys, [F.col("_own") == F.col("_key"), *[F.col(c) == F.col(f"_{c}") for c in scope]], "left")
    waits = F.lit(False)
    for c in scope:
        waits = waits | F.col(c).isNull()
    reason = (
        F.when(F.col(field).isNull(), "MISSING_INPUT").when(waits, "DEPENDENCY_UNRESOLVED").when(F.col("_own").isNull(), "INVALID_INPUT").when(F.col("_n").isNull(), "NOT_FOUND")
        .when(F.col("_n") > 1, "AMBIGUOUS").when(~F.col("_active"), "INACTIVE")
    )
    out = {f"{field}_reason": reason, f"{field}_id": F.when(reason.isNull(), F.col("_id"))} | ({f"{field}_{extra}": F.when(reason.isNull(), F.col(f"_{extra}"))} if extra else {})
    return joined.withColumns(out).drop("_own", "_key", "_n", "_id", "_active", f"_{extra}", *[f"_{c}" for c in scope])


def _bad_text(name: str) -> Column:
    c = F.col(name)
    return c.isNotNull() & ((F.length(c) > TEXT_MAX) | c.rlike(r"[\p{Cc}\p{Cf}\p{Cs}]") | (edges_trimmed(c) == ""))


def resolved(rows: DataFrame, fish: DataFrame, bases: DataFrame, places: DataFrame, baits: DataFrame, members: DataFrame) -> DataFrame:
    """rows (contributor_key, import_key, fish, base, place, bait, weight_grams, method, hole_depth_cm, spinning_size, spinning_speed, spot, user_note)
    plus ids, reasons, fishing_method, status, and issues (code, field) in order."""
    d = named(rows, "fish", fish)
    d = named(d, "base", bases)
    d = named(d, "place", places, scope=["base_id"])
    d = named(d, "bait", baits, extra="type")
    pairs = members.select(F.col("base_id").alias("_mb"), F.col("fish_id").alias("_mf")).distinct()
    d = d.join(pairs, (F.col("base_id") == F.col("_mb")) & (F.col("fish_id") == F.col("_mf")), "left").withColumn("_member", F.col("_mb").isNotNull()).drop("_mb", "_mf")
    method = F.when(F.col("bait_type") == "BAIT", "BAIT_FISHING").when(F.col("bait_type") == "LURE", "SPINNING")
    d = d.withColumn("fishing_method", method)
    whole = lambda c: F.col(c).between(1, INT_MAX)
    blocks, misses = [], []
    issue = lambda test, code, field: F.when(test, F.struct(F.lit(code).alias("code"), F.lit(field).alias("field")))
    for field, name in UPPER.items():
        misses.append(issue(F.col(f"{field}_reason") == "MISSING_INPUT", f"MISSING_{name}", field))
        blocks.append(issue(F.col(f"{field}_reason").isNotNull() & (F.col(f"{field}_reason") != "MISSING_INPUT"), f"UNRESOLVED_{name}", field))
    misses.append(issue(F.col("weight_grams").isNull(), "MISSING_WEIGHT_GRAMS", "weight_grams"))
    of_bait = F.col("fishing_method") == "BAIT_FISHING"
    blocks += [
        issue(F.col("contributor_key").isNull(), "MISSING_EXTERNAL_MEMBER_ID", "contributor_key"), issue(~F.col("contributor_key").rlike(CONTRIBUTOR_KEY), "INVALID_CONTRIBUTOR_KEY", "contributor_key"),
        issue(~F.coalesce(F.col("import_key").rlike(IMPORT_KEY), F.lit(False)), "INVALID_IMPORT_KEY", "import_key"), issue(F.col("fish_id").isNotNull() & F.col("base_id").isNotNull() & ~F.col("_member"), "MISSING_MEMBERSHIP", "base_fish"),
        issue(~whole("weight_grams"), "INVALID_WEIGHT_GRAMS", "weight_grams"), issue(F.col("method").isNotNull() & ~F.col("method").eqNullSafe(F.col("fishing_method")), "FISHING_METHOD_CONFLICT", "method"),
        issue(~whole("hole_depth_cm"), "INVALID_HOLE_DEPTH_CM", "hole_depth_cm"), issue(of_bait & F.col("spinning_size").isNotNull(), "INVALID_SPINNING_SIZE_FOR_METHOD", "spinning_size"),
        issue(of_bait & F.col("spinning_speed").isNotNull(), "INVALID_SPINNING_SPEED_FOR_METHOD", "spinning_speed"), issue(_bad_text("spot"), "INVALID_SPOT", "spot"), issue(_bad_text("user_note"), "INVALID_USER_NOTE", "user_note"),
    ]
    d = d.withColumns({"_blocks": F.array_compact(F.array(*blocks)), "_misses": F.array_compact(F.array(*misses))})
    if "parse_issues" in rows.columns:
        found = F.coalesce(F.col("parse_issues"), F.array().cast("array<struct<code:string,field:string>>"))
        harmless = lambda i: F.coalesce(i["field"].isin(OPTIONAL), F.lit(False))
        d = d.withColumns({"_blocks": F.concat("_blocks", F.filter(found, lambda i: ~harmless(i))), "_shown": F.filter(found, harmless)})
    else:
        d = d.withColumn("_shown", F.array().cast("array<struct<code:string,field:string>>"))
    status = F.when(F.size("_blocks") > 0, "UNRESOLVED").when(F.size("_misses") > 0, "USABLE_PARTIAL").otherwise("USABLE_COMPLETE")
    return d.withColumns({"status": status, "issues": F.array_sort(F.array_distinct(F.concat("_blocks", "_misses", "_shown")))}).drop("_blocks", "_misses", "_shown", "_member", "bait_type")


@query(
    "resolved_candidates",
    """
WITH f AS (SELECT name_normalized AS k, count(*) AS n, min(fish_id) AS id, bool_and(is_active) AS active FROM {fish} GROUP BY 1),
x AS (SELECT DISTINCT r.report_id, r.fish_id, r.location_id, r.bait_id, r.weight_grams, f.name_normalized AS fish, l.base_id, l.is_active AS place_on, b.is_active AS base_on, i.type, r.report_id % 17 AS v FROM {report} r JOIN {fish} f ON f.fish_id = r.fish_id
  JOIN {location} l ON l.location_id = r.location_id JOIN {base} b ON b.base_id = l.base_id JOIN {bait} i ON i.bait_id = r.bait_id WHERE import_key IS NOT NULL),
y AS (SELECT x.*, CASE WHEN v = 1 THEN 'MISSING_INPUT' WHEN v = 2 THEN 'NOT_FOUND' WHEN f.n > 1 THEN 'AMBIGUOUS' WHEN NOT f.active THEN 'INACTIVE' END AS fish_reason, CASE WHEN base_on THEN NULL ELSE 'INACTIVE' END AS base_reason,
  CASE WHEN v = 3 THEN 'MISSING_INPUT' WHEN NOT base_on THEN 'DEPENDENCY_UNRESOLVED' WHEN NOT place_on THEN 'INACTIVE' END AS place_reason, CASE WHEN v = 4 THEN 'INVALID_INPUT' END AS bait_reason, f.id FROM x JOIN f ON f.k = x.fish)
SELECT status, fish_reason, base_reason, place_reason, bait_reason, count(*) AS n FROM (SELECT y.*, CASE WHEN fish_reason IN ('NOT_FOUND', 'AMBIGUOUS', 'INACTIVE') OR base_reason IS NOT NULL OR place_reason IN ('INACTIVE', 'DEPENDENCY_UNRESOLVED') OR bait_reason IS NOT NULL OR v IN (5, 6)
    OR (v = 7 AND type = 'BAIT') OR (fish_reason IS NULL AND base_reason IS NULL AND m.fish_id IS NULL) THEN 'UNRESOLVED' WHEN fish_reason IS NOT NULL OR place_reason IS NOT NULL OR v = 8 THEN 'USABLE_PARTIAL' ELSE 'USABLE_COMPLETE' END AS status
  FROM y LEFT JOIN {member} m ON m.base_id = y.base_id AND m.fish_id = y.id) GROUP BY ALL
""",
)
def resolved_candidates(t: Tables) -> DataFrame:
    """Imported reports written as names, some missing, unknown, invalid or in conflict, by what the catalog makes of them."""
    v = F.col("report_id") % 17
    names = t.report.where("import_key is not null").select("report_id", "contributor_key", "import_key", "fish_id", "location_id", "bait_id", "weight_grams", "hole_depth_cm").dropDuplicates(["report_id", "fish_id", "location_id", "bait_id", "weight_grams"])
    names = names.join(t.fish.select("fish_id", F.col("name").alias("fish")), "fish_id").join(t.location.select("location_id", "base_id", F.col("name").alias("place")), "location_id")
    names = names.join(t.base.select("base_id", F.col("name").alias("base")), "base_id").join(t.bait.select("bait_id", F.col("name").alias("bait"), "type"), "bait_id")
    method = F.when(v == 6, F.when(F.col("type") == "BAIT", "SPINNING").otherwise("BAIT_FISHING"))
    rows = names.select(
        F.when(v != 5, F.col("contributor_key")).alias("contributor_key"), "import_key", F.when(v == 2, "no such fish").when(v != 1, F.col("fish")).alias("fish"), "base", F.when(v != 3, F.col("place")).alias("place"),
        F.when(v == 4, "--").otherwise(F.col("bait")).alias("bait"), F.when(v != 8, F.col("weight_grams")).alias("weight_grams"), method.alias("method"), "hole_depth_cm", F.when(v == 7, "SMALL").alias("spinning_size"),
        F.lit(None).cast("string").alias("spinning_speed"), F.lit(None).cast("string").alias("spot"), F.lit(None).cast("string").alias("user_note"),
    )
    by = lambda df, key, *more: df.select(F.col(key).alias("name_id"), "name", *more)
    out = resolved(rows, by(t.fish, "fish_id", "is_active"), by(t.base, "base_id", "is_active"), by(t.location, "location_id", "base_id", "is_active"), t.bait.select(F.col("bait_id").alias("name_id"), "name", "type", F.lit(True).alias("is_active")), t.member)
    return out.groupBy("status", "fish_reason", "base_reason", "place_reason", "bait_reason").agg(F.count("*").alias("n"))
