"""Order modes and row filters of the list views; orders are given as row numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.classify import week_start
from ..functions.paging import numbered
from ..functions.texts import digit_padded
from ..plans.registry import query
from ..plans.tables import Tables
from .records import WEEK_SQL
from .reports import dealt

#: Columns of the notebook's sort modes: each goes up and down, nulls last both ways, ties in the given order.
NOTEBOOK_KEYS = {"name": "name_normalized", "catches": "catches", "min": "min_weight_grams", "max": "max_weight_grams"}
NOTEBOOK_MODES = [("default", "i", "ASC"), *[(f"{mode}-{way.lower()}", key, way) for mode, key in NOTEBOOK_KEYS.items() for way in ("ASC", "DESC")]]


def in_modes(rows: DataFrame, modes: dict[str, list[Column]], *keys: str) -> DataFrame:
    """Rows (mode, *keys, n): the place of each row of one list under every mode; the list is read and gathered once."""
    places = [F.struct(F.lit(mode).alias("mode"), F.row_number().over(Window.orderBy(*order)).alias("n")) for mode, order in modes.items()]
    return rows.withColumn("_places", F.array(*places)).select(*keys, F.inline("_places")).select("mode", *keys, "n")


@query(
    "notebook_orders",
    """
WITH c AS (SELECT fish_id, count(*) AS catches FROM {report} r JOIN {location} l ON l.location_id = r.location_id WHERE l.base_id = 3 GROUP BY fish_id),
x AS (SELECT m.fish_id, name_normalized, coalesce(catches, 0) AS catches, min_weight_grams, max_weight_grams, row_number() OVER (ORDER BY max_weight_grams DESC NULLS LAST, m.fish_id) AS i
  FROM {member} m JOIN {fish} f ON f.fish_id = m.fish_id LEFT JOIN c ON c.fish_id = m.fish_id WHERE m.base_id = 3)
"""
    + " UNION ALL ".join(f"SELECT '{mode}' AS mode, fish_id, row_number() OVER (ORDER BY {key} {way} NULLS LAST, i) AS n FROM x" for mode, key, way in NOTEBOOK_MODES),
)
def notebook_orders(t: Tables, base_id: int = 3) -> DataFrame:
    """One base's fish under the nine sort modes of its notebook."""
    places = t.location.where(F.col("base_id") == base_id).select("location_id")
    catches = t.report.select("fish_id", "location_id").join(places, "location_id").groupBy("fish_id").agg(F.count("*").alias("catches"))
    rows = t.member.where(F.col("base_id") == base_id).join(t.fish.select("fish_id", "name_normalized"), "fish_id").join(catches, "fish_id", "left").fillna(0, ["catches"])
    rows = rows.withColumn("i", F.row_number().over(Window.orderBy(F.desc_nulls_last("max_weight_grams"), "fish_id")))
    return in_modes(rows, {mode: [F.asc_nulls_last(key) if way == "ASC" else F.desc_nulls_last(key), F.col("i")] for mode, key, way in NOTEBOOK_MODES}, "fish_id")


@query(
    "aggregate_orders",
    """
WITH x AS (SELECT l.base_id, b.name_normalized AS base, r.location_id, l.number, r.bait_id, i.name AS bait, count(*) AS intensity FROM {report} r JOIN {location} l ON l.location_id = r.location_id
  JOIN {base} b ON b.base_id = l.base_id JOIN {bait} i ON i.bait_id = r.bait_id WHERE r.fish_id = 7 GROUP BY ALL)
SELECT 'catches-desc' AS mode, location_id, bait_id, row_number() OVER (ORDER BY intensity DESC, location_id, bait_id) AS n FROM x
UNION ALL SELECT 'catches-asc', location_id, bait_id, row_number() OVER (ORDER BY intensity, location_id, bait_id) FROM x
UNION ALL SELECT 'places', location_id, bait_id, row_number() OVER (ORDER BY base, base_id, number, location_id, intensity DESC, bait, bait_id) FROM x
""",
)
def aggregate_orders(t: Tables, fish_id: int = 7) -> DataFrame:
    """A fish's places and baits by intensity, up or down, or by place."""
    counts = t.report.where(F.col("fish_id") == fish_id).groupBy("location_id", "bait_id").agg(F.count("*").alias("intensity"))
    rows = counts.join(t.location.select("location_id", "base_id", "number"), "location_id").join(t.base.select("base_id", F.col("name_normalized").alias("base")), "base_id")
    rows = rows.join(t.bait.select("bait_id", F.col("name").alias("bait")), "bait_id")
    places = [F.col(c) for c in ("base", "base_id", "number", "location_id")] + [F.desc("intensity"), F.col("bait"), F.col("bait_id")]
    ids = [F.col("location_id"), F.col("bait_id")]
    return in_modes(rows, {"catches-desc": [F.desc("intensity"), *ids], "catches-asc": [F.asc("intensity"), *ids], "places": places}, "location_id", "bait_id")


@query("locale_order", "SELECT fish_id, row_number() OVER (ORDER BY name, fish_id) AS n FROM {fish}")
def locale_order(t: Tables, locale: str = "ru") -> DataFrame:
    """All fish by name and number as readers of a locale expect: letters before case and accents, digit runs by value."""
    key = digit_padded(F.concat_ws(" ", "name", F.col("fish_id").cast("string")))
    order = [F.collate(key, f"{locale}_CI_AI"), F.collate(key, locale), F.col("fish_id")]
    return numbered(t.fish.select("fish_id", "name"), order).select("fish_id", "n")


@query(
    "correction_ranking",
    f"""
WITH s AS (SELECT fish_id, base_id, max(weight_grams) AS top, count(DISTINCT {WEEK_SQL}) AS weeks, count(DISTINCT weight_grams) AS weights FROM {{snapshot}} WHERE base_id IS NOT NULL GROUP BY ALL),
x AS (SELECT s.*, f.name AS fish, b.name AS base, CASE WHEN max_weight_grams IS NULL THEN 2 WHEN top > max_weight_grams THEN 0 ELSE 1 END AS kind, CASE WHEN weeks >= 4 THEN 0 WHEN weeks >= 2 THEN 1 ELSE 2 END AS trust
  FROM s JOIN {{fish}} f ON f.fish_id = s.fish_id JOIN {{base}} b ON b.base_id = s.base_id LEFT JOIN {{member}} m ON m.fish_id = s.fish_id AND m.base_id = s.base_id)
SELECT fish_id, base_id, kind, trust, CASE WHEN kind = 0 AND trust = 0 THEN top END AS proposed, row_number() OVER (ORDER BY least(kind, 1), trust, CASE WHEN kind = 0 AND trust = 0 THEN 0 ELSE 1 END, weeks DESC, weights DESC, fish, base, fish_id, base_id) AS n
FROM x
""",
)
def correction_ranking(t: Tables) -> DataFrame:
    """Pairs whose bound looks wrong first, then by trust, a proposal, weeks, weights and names."""
    rows = t.snapshot.where("base_id is not null").select("fish_id", "base_id", "weight_grams", week_start(F.col("caught_at")).alias("week"))
    seen = rows.groupBy("fish_id", "base_id").agg(F.max("weight_grams").alias("top"), F.countDistinct("week").alias("weeks"), F.countDistinct("weight_grams").alias("weights"))
    named = seen.join(t.fish.select("fish_id", F.col("name").alias("fish")), "fish_id").join(t.base.select("base_id", F.col("name").alias("base")), "base_id")
    bounds = t.member.select("fish_id", "base_id", "max_weight_grams")
    kind = F.when(F.col("max_weight_grams").isNull(), 2).when(F.col("top") > F.col("max_weight_grams"), 0).otherwise(1)
    trust = F.when(F.col("weeks") >= 4, 0).when(F.col("weeks") >= 2, 1).otherwise(2)
    x = named.join(bounds, ["fish_id", "base_id"], "left").withColumns({"kind": kind, "trust": trust}).withColumn("proposed", F.when((F.col("kind") == 0) & (F.col("trust") == 0), F.col("top")))
    order = [F.least("kind", F.lit(1)), F.col("trust"), F.col("proposed").isNull(), F.desc("weeks"), F.desc("weights"), F.col("fish"), F.col("base"), F.col("fish_id"), F.col("base_id")]
    return numbered(x, order).select("fish_id", "base_id", "kind", "trust", "proposed", "n")


@query(
    "location_rows",
    """
WITH b AS (SELECT location_id, fish_id, bait_id, count(*) AS n, bool_or(hole_depth_cm IS NOT NULL) AS hole, bool_or(spinning_size IS NOT NULL) AS spinning, bool_or(user_note_raw IS NOT NULL) AS comment FROM {report} GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY location_id, fish_id ORDER BY n DESC, bait_id) AS k FROM b)
SELECT location_id, fish_id, CAST(sum(n) AS BIGINT) AS reports, max(CASE WHEN k = 1 THEN bait_id END) AS main_bait FROM k GROUP BY ALL
HAVING sum(n) >= 2 AND bool_or(hole) AND bool_or(spinning) AND bool_or(comment) AND bool_or(k <= 3 AND bait_id = 2)
""",
)
def location_rows(t: Tables, min_count: int = 2, bait_id: int = 2) -> DataFrame:
    """Fish of locations with enough reports, a hole, a spinning and a comment, and the bait among their top three."""
    some = lambda c: F.bool_or(F.col(c).isNotNull())
    facts = dealt(t, t.report.select("location_id", "fish_id", "bait_id", "hole_depth_cm", "spinning_size", "user_note_raw"), "location_id", "fish_id")
    baits = facts.groupBy("location_id", "fish_id", "bait_id").agg(F.count("*").alias("n"), some("hole_depth_cm").alias("hole"), some("spinning_size").alias("spinning"), some("user_note_raw").alias("comment"))
    ranked = baits.withColumn("k", F.row_number().over(Window.partitionBy("location_id", "fish_id").orderBy(F.desc("n"), "bait_id")))
    rows = ranked.groupBy("location_id", "fish_id").agg(
        F.sum("n").alias("reports"), F.max(F.when(F.col("k") == 1, F.col("bait_id"))).alias("main_bait"),
        F.bool_or("hole").alias("hole"), F.bool_or("spinning").alias("spinning"), F.bool_or("comment").alias("comment"), F.bool_or((F.col("k") <= 3) & (F.col("bait_id") == bait_id)).alias("baited"),
    )
    return rows.where((F.col("reports") >= min_count) & F.col("hole") & F.col("spinning") & F.col("comment") & F.col("baited")).select("location_id", "fish_id", "reports", "main_bait")


@query("refetched_page", "SELECT location_id, l.name, b.name AS base, row_number() OVER (ORDER BY l.name DESC, location_id) AS n FROM {location} l JOIN {base} b ON b.base_id = l.base_id WHERE l.is_active ORDER BY n LIMIT 20")
def refetched_page(t: Tables, size: int = 20) -> DataFrame:
    """A page of ids in order, then the whole rows of those ids, each with its place on the page."""
    order = [F.desc("name"), F.col("location_id")]
    page = t.location.where("is_active").select("location_id", "name").orderBy(*order).limit(size).select("location_id", F.row_number().over(Window.orderBy(*order)).alias("n"))
    rows = t.location.select("location_id", "base_id", "name").join(F.broadcast(page), "location_id")
    return rows.join(t.base.select("base_id", F.col("name").alias("base")), "base_id").select("location_id", "name", "base", "n")
