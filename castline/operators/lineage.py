"""Candidates of an older catalog resolved in the newer one: by their own name first, else along the lineage of their fish.

Renames and merges are links from a fish to the one that stands for it; chains
of them are followed by doubling, so a chain of n links takes log2(n) joins, and
what still has a link after that many turns is in a cycle.  Whatever does not
fit the frozen state is told as a reason that blocks: nothing is matched by
likeness.

Defined results: keys that only one side holds, that repeat or are null are
told as such; a candidate that was not resolved before keeps what its own name gives.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.registry import query
from ..plans.tables import Tables
from ..session import checkpointed
from .candidates import named


def followed(links: DataFrame) -> DataFrame:
    """Rows (fish_id, target_id, cyclic) for each link (fish_id, target_id): the end of its chain, null in or before a cycle."""
    start = checkpointed(links.where("fish_id is not null and target_id is not null and fish_id <> target_id").select("fish_id", "target_id").distinct())
    ends, turns = start, math.ceil(math.log2(start.count() + 1)) + 1
    for _ in range(turns):
        onward = ends.select(F.col("fish_id").alias("_from"), F.col("target_id").alias("_to"))
        ends = checkpointed(ends.join(onward, F.col("target_id") == F.col("_from"), "left").select("fish_id", F.coalesce("_to", "target_id").alias("target_id"), F.col("_to").isNotNull().alias("_moved")))
        if not ends.where("_moved").limit(1).count():
            break
    open_ = start.select(F.col("fish_id").alias("_from")).distinct()
    return ends.join(open_, F.col("target_id") == F.col("_from"), "left").select("fish_id", F.when(F.col("_from").isNull(), F.col("target_id")).alias("target_id"), F.col("_from").isNotNull().alias("cyclic"))


def recovered(parsed: DataFrame, previous: DataFrame, entries: DataFrame, fish: DataFrame) -> DataFrame:
    """Rows (import_key, fish_id, route, blocked) of parsed candidates (import_key, fish).

    previous are (import_key, was_id, was_name), null where nothing was resolved;
    entries the lineage (fish_id, name, target_id, target_name), a null target standing
    for itself; fish the current catalog (name_id, name, is_active).
    """
    once = parsed.groupBy("import_key").agg(F.count("*").alias("n"), F.min("fish").alias("fish"))
    before = previous.groupBy("import_key").agg(F.count("*").alias("m"), F.min("was_id").alias("was_id"), F.min("was_name").alias("was_name"))
    rows = once.join(before, "import_key", "full")
    rows = named(rows, "fish", fish).withColumnRenamed("fish_id", "own_id")
    ends = followed(entries.select("fish_id", "target_id")).select(F.col("fish_id").alias("_f"), F.col("target_id").alias("end_id"), "cyclic")
    lineage = entries.groupBy("fish_id").agg(F.count("*").alias("lines"), F.min("name").alias("line_name"), F.min("target_name").alias("target_name"))
    lineage = lineage.join(ends, F.col("fish_id") == F.col("_f"), "left").select("fish_id", "lines", "line_name", "target_name", F.coalesce("cyclic", F.lit(False)).alias("cyclic"), F.coalesce("end_id", "fish_id").alias("target"))
    rows = rows.join(lineage, F.col("was_id") == F.col("fish_id"), "left").drop("fish_id")
    current = fish.select(F.col("name_id").alias("_t"), F.col("name").alias("now"), F.col("is_active").alias("now_active"))
    rows = rows.join(current, F.col("target") == F.col("_t"), "left").drop("_t")
    rows = named(rows.withColumn("via", F.col("now")), "via", fish)
    held = F.col("was_id").isNotNull() | F.col("was_name").isNotNull()
    blocked = (
        F.when(F.col("import_key").isNull() | (F.col("n") > 1) | (F.col("m") > 1), "REPEATED_KEY").when(F.col("n").isNull(), "MISSING_KEY").when(F.col("m").isNull(), "UNEXPECTED_KEY").when(~held, None)
        .when(F.col("was_id").isNull() | F.col("was_name").isNull(), "INCOMPLETE_IDENTITY").when(F.col("lines").isNull(), "NO_LINEAGE").when(F.col("lines") > 1, "REPEATED_LINEAGE").when(F.col("cyclic"), "CYCLE")
        .when(F.col("line_name") != F.col("was_name"), "NAME_DRIFT").when(F.col("now").isNull() | ~F.col("now_active"), "TARGET_ABSENT")
        .when(F.col("now") != F.coalesce("target_name", "line_name"), "TARGET_RENAMED").when(F.col("own_id").isNotNull() & (F.col("own_id") != F.col("target")), "EXACT_CONFLICT")
        .when(F.col("own_id").isNull() & ~F.col("via_id").eqNullSafe(F.col("target")), "TARGET_AMBIGUOUS")
    )
    rows = rows.withColumn("blocked", blocked)
    route = F.when(F.col("blocked").isNotNull(), None).when(F.col("own_id").isNotNull(), "EXACT").when(held, "LINEAGE").otherwise("UNRESOLVED")
    return rows.withColumn("route", route).select("import_key", F.when(F.col("route") == "EXACT", F.col("own_id")).when(F.col("route") == "LINEAGE", F.col("target")).alias("fish_id"), "route", "blocked")


@query(
    "recovered_fish",
    """
WITH x AS (SELECT e.event_id, f.fish_id, f.fish_id % 6 AS kind, f.is_active AS own_on, n.is_active AS end_on FROM {event} e JOIN {fish} f ON f.fish_id = e.event_id % 97 + 1 LEFT JOIN {fish} n ON n.fish_id = f.fish_id + 2)
SELECT event_id, CASE WHEN kind IN (2, 5) AND own_on THEN fish_id WHEN kind = 3 AND end_on THEN fish_id + 2 END AS fish_id,
  CASE WHEN kind = 4 OR (kind = 5 AND NOT own_on) THEN 'UNRESOLVED' WHEN kind IN (2, 5) AND own_on THEN 'EXACT' WHEN kind = 3 AND end_on THEN 'LINEAGE' END AS route,
  CASE WHEN kind = 0 THEN 'NO_LINEAGE' WHEN kind = 1 THEN 'NAME_DRIFT' WHEN (kind = 2 AND NOT own_on) OR (kind = 3 AND NOT end_on) THEN 'TARGET_ABSENT' END AS blocked FROM x
""",
)
def recovered_fish(t: Tables) -> DataFrame:
    """Events that name fish as an older catalog did: without lineage, under a drifted name, unchanged, merged along two links, or never resolved."""
    fish = t.fish.select(F.col("fish_id").alias("name_id"), F.concat_ws(" ", "name", "fish_id").alias("name"), "is_active")
    rows = t.event.select("event_id", (F.col("event_id") % 97 + 1).alias("name_id")).join(fish.select("name_id", "name"), "name_id")
    kind = F.col("name_id") % 6
    parsed = rows.select(F.col("event_id").alias("import_key"), F.when(kind.isin(3, 4), F.concat(F.lit("formerly "), "name")).otherwise(F.col("name")).alias("fish"))
    previous = rows.select(F.col("event_id").alias("import_key"), F.when(kind < 4, F.col("name_id")).alias("was_id"), F.when(kind < 4, F.concat(F.lit("old "), "name")).alias("was_name"))
    old = F.concat(F.lit("old "), "name")
    # kind 3 goes to a fish of kind 4, and that to one of kind 5
    onward = fish.select((F.col("name_id") - 2).alias("name_id"), F.col("name").alias("end_name"))
    listed = fish.where(kind.isin(1, 2, 3, 4)).join(onward, "name_id", "left")
    entries = listed.select(
        F.col("name_id").alias("fish_id"), F.when(kind == 1, F.concat(F.lit("other "), "name")).otherwise(old).alias("name"), F.when(kind.isin(3, 4), F.col("name_id") + 1).alias("target_id"),
        F.when(kind == 3, F.col("end_name")).otherwise(F.col("name")).alias("target_name"),
    )
    return recovered(parsed, previous, entries, fish).select(F.col("import_key").alias("event_id"), "fish_id", "route", "blocked")
