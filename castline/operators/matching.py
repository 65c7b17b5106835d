"""Matching names, dates and selections; recurring ratio windows; evidence behind a page of spots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.classify import week_start
from ..plans.registry import query
from ..plans.tables import Tables, spot_key
from .records import WEEK_SQL
from .reports import located

#: Fixed value: a ratio window's width in thousandths.
WIDTH = 10


@query(
    "cascading_match",
    """
WITH q AS (SELECT fish_id AS k, CASE fish_id % 4 WHEN 0 THEN name WHEN 1 THEN upper(name) WHEN 2 THEN concat('old ', name_normalized) ELSE concat('x', name) END AS wanted FROM {fish}),
e AS (SELECT name, count(*) AS n, min(fish_id) AS id FROM {fish} GROUP BY name), f AS (SELECT name_normalized AS name, count(*) AS n, min(fish_id) AS id FROM {fish} GROUP BY name_normalized),
a AS (SELECT concat('old ', name) AS name, n, id FROM f)
SELECT k, CASE WHEN e.n = 1 THEN 'EXACT' WHEN f.n = 1 THEN 'FOLDED' WHEN a.n = 1 THEN 'ALIAS' WHEN coalesce(e.n, f.n, a.n) > 1 THEN 'AMBIGUOUS' ELSE 'MISSING' END AS status,
  CASE WHEN e.n = 1 THEN e.id WHEN f.n = 1 THEN f.id WHEN a.n = 1 THEN a.id END AS fish_id
FROM q LEFT JOIN e ON e.name = wanted LEFT JOIN f ON f.name = lower(wanted) LEFT JOIN a ON a.name = wanted
""",
)
def cascading_match(t: Tables) -> DataFrame:
    """Names matched exactly, else with folded case, else by alias; the first unique match counts."""
    kind = F.col("fish_id") % 4
    wanted = F.when(kind == 0, F.col("name")).when(kind == 1, F.upper("name")).when(kind == 2, F.concat(F.lit("old "), "name_normalized")).otherwise(F.concat(F.lit("x"), "name"))
    rows = t.fish.select(F.col("fish_id").alias("k"), wanted.alias("wanted")).withColumn("low", F.lower("wanted"))

    def index(name: Column, on: str, prefix: str) -> DataFrame:
        return t.fish.groupBy(name.alias(on)).agg(F.count("*").alias(f"{prefix}_n"), F.min("fish_id").alias(f"{prefix}_id"))

    rows = rows.join(index(F.col("name"), "wanted", "exact"), "wanted", "left").join(index(F.col("name_normalized"), "low", "folded"), "low", "left")
    rows = rows.join(index(F.concat(F.lit("old "), "name_normalized"), "wanted", "alias"), "wanted", "left")
    status, found = F.when(F.coalesce("exact_n", "folded_n", "alias_n") > 1, "AMBIGUOUS").otherwise("MISSING"), F.lit(None).cast("bigint")
    for stage in ("alias", "folded", "exact"):
        unique = F.col(f"{stage}_n") == 1
        status, found = F.when(unique, stage.upper()).otherwise(status), F.when(unique, F.col(f"{stage}_id")).otherwise(found)
    return rows.select("k", status.alias("status"), found.alias("fish_id"))


@query(
    "longest_prefix",
    """
WITH x AS (SELECT fish_id AS k, concat(name, ' caught at night') AS line FROM {fish}), n AS (SELECT DISTINCT name FROM {fish})
SELECT k, arg_max(name, length(name)) AS name FROM x JOIN n ON line = name OR starts_with(line, concat(name, ' ')) GROUP BY k
""",
)
def longest_prefix(t: Tables) -> DataFrame:
    """The longest catalog name a line starts with, ending between words: an equi-join on the line's own prefixes."""
    lines = t.fish.select(F.col("fish_id").alias("k"), F.split(F.concat("name", F.lit(" caught at night")), " ").alias("words"))
    prefixes = F.transform(F.sequence(F.lit(1), F.size("words")), lambda i: F.array_join(F.slice("words", 1, i), " "))
    starts = lines.select("k", F.explode(prefixes).alias("name"))
    return starts.join(t.fish.select("name").distinct(), "name").groupBy("k").agg(F.max_by("name", F.length("name")).alias("name"))


def shares(t: Tables) -> DataFrame:
    """Weekly observations of pairs as thousandths of the pair's heaviest."""
    rows = t.snapshot.where("base_id is not null").select("fish_id", "base_id", week_start(F.col("caught_at")).alias("week"), F.col("weight_grams").cast("long").alias("g"))
    top = rows.groupBy("fish_id", "base_id").agg(F.max("g").alias("top"))
    return rows.join(top, ["fish_id", "base_id"]).select("fish_id", "base_id", "week", F.expr("g * 1000 div top").alias("p"))


SHARES_SQL = f"""SELECT s.fish_id, s.base_id, {WEEK_SQL} AS week, CAST(weight_grams AS BIGINT) * 1000 // top AS p FROM {{snapshot}} s
  JOIN (SELECT fish_id, base_id, max(weight_grams) AS top FROM {{snapshot}} GROUP BY ALL) m ON m.fish_id = s.fish_id AND m.base_id = s.base_id"""


@query(
    "recurring_windows",
    f"""
WITH s AS ({SHARES_SQL}), r AS (SELECT DISTINCT p FROM s)
SELECT start, count(*) AS pairs FROM (SELECT r.p AS start, fish_id, base_id FROM r JOIN s ON s.p BETWEEN r.p AND r.p + {WIDTH} GROUP BY ALL HAVING count(DISTINCT week) >= 2) GROUP BY start
""",
)
def recurring_windows(t: Tables) -> DataFrame:
    """For each share that occurs, the pairs seen in two weeks or more within the window above it.

    A share lies in the windows that start up to the width below it, so each row is
    dealt to those and the range join becomes a grouping.
    """
    rows = shares(t).distinct()
    dealt = rows.select("fish_id", "base_id", "week", F.explode(F.sequence(F.col("p") - WIDTH, F.col("p"))).alias("start"))
    recurring = dealt.groupBy("start", "fish_id", "base_id").agg(F.countDistinct("week").alias("weeks")).where("weeks >= 2")
    return recurring.groupBy("start").agg(F.count("*").alias("pairs")).join(rows.select(F.col("p").alias("start")).distinct(), "start", "left_semi")


@query(
    "band_statistics",
    f"""
WITH s AS ({SHARES_SQL}), g AS (SELECT p // 50 AS band, fish_id, base_id, count(DISTINCT week) AS weeks FROM s GROUP BY ALL)
SELECT band, count(*) AS pairs, count(DISTINCT fish_id) AS fish, count(DISTINCT base_id) AS bases, CAST(sum(weeks) AS BIGINT) AS pair_weeks, count(*) FILTER (WHERE weeks >= 2) AS repeated FROM g GROUP BY band
""",
)
def band_statistics(t: Tables) -> DataFrame:
    """Pairs, fish, bases and weeks of each band of shares in two levels of grouping."""
    pairs = shares(t).groupBy(F.expr("p div 50").alias("band"), "fish_id", "base_id").agg(F.countDistinct("week").alias("weeks"))
    return pairs.groupBy("band").agg(
        F.count("*").alias("pairs"), F.countDistinct("fish_id").alias("fish"), F.countDistinct("base_id").alias("bases"), F.sum("weeks").alias("pair_weeks"), F.count_if(F.expr("weeks >= 2")).alias("repeated")
    )


def strict_moment(text: Column) -> Column:
    """UTC of 'dd.MM.yyyy HH:mm' written in UTC+3; null if it is not spelled so or no such day exists."""
    spelled = text.rlike(r"^[0-9]{2}\.[0-9]{2}\.[0-9]{4} [0-9]{2}:[0-9]{2}$")
    return F.when(spelled, F.try_to_timestamp(text, F.lit("dd.MM.yyyy HH:mm")).cast("timestamp_ntz") - F.expr("interval 3 hours"))


@query(
    "strict_dates",
    r"""
WITH x AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN '31.02.2024 10:00' WHEN 1 THEN '1.2.2024 10:00' ELSE strftime(occurred_at, '%d.%m.%Y %H:%M') END AS s FROM {event})
SELECT event_id, CASE WHEN regexp_full_match(s, '[0-9]{2}\.[0-9]{2}\.[0-9]{4} [0-9]{2}:[0-9]{2}') THEN try_strptime(s, '%d.%m.%Y %H:%M') - INTERVAL 3 HOUR END AS moment FROM x
""",
)
def strict_dates(t: Tables) -> DataFrame:
    """Dates written as text and read back; days that do not exist and loose spellings are null."""
    kind = F.col("event_id") % 5
    text = F.when(kind == 0, "31.02.2024 10:00").when(kind == 1, "1.2.2024 10:00").otherwise(F.date_format("occurred_at", "dd.MM.yyyy HH:mm"))
    return t.event.select("event_id", strict_moment(text).alias("moment"))


SPOT = ["location_id", "hole_depth_cm", "spot"]


@query(
    "spot_evidence",
    """
WITH c AS (SELECT * FROM (SELECT report_id, location_id, hole_depth_cm, {spot_key} AS spot FROM {report}) WHERE hole_depth_cm IS NOT NULL OR spot IS NOT NULL),
p AS (SELECT location_id, hole_depth_cm, spot, count(*) AS n FROM c GROUP BY ALL ORDER BY n DESC, location_id, hole_depth_cm NULLS LAST, spot NULLS LAST LIMIT 10)
SELECT report_id, c.location_id, c.hole_depth_cm, c.spot FROM c JOIN p ON p.location_id = c.location_id AND p.hole_depth_cm IS NOT DISTINCT FROM c.hole_depth_cm AND p.spot IS NOT DISTINCT FROM c.spot
""",
)
def spot_evidence(t: Tables, limit: int = 10) -> DataFrame:
    """The reports behind a page of spots: a null-safe semi join with the page's keys."""
    rows = t.report.select("report_id", "location_id", "hole_depth_cm", spot_key(F.col("spot_position_raw")).alias("spot")).where("hole_depth_cm is not null or spot is not null")
    order = [F.desc("n"), F.col("location_id"), F.asc_nulls_last("hole_depth_cm"), F.asc_nulls_last("spot")]
    page = rows.groupBy(*SPOT).agg(F.count("*").alias("n")).orderBy(*order).limit(limit).select(*[F.col(k).alias(f"p_{k}") for k in SPOT])
    return rows.join(page, [rows[k].eqNullSafe(page[f"p_{k}"]) for k in SPOT], "left_semi")


@query(
    "location_top_baits",
    """
WITH g AS (SELECT location_id, fish_id, r.bait_id, b.name, count(*) AS n FROM {report} r JOIN {bait} b ON b.bait_id = r.bait_id GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY location_id, fish_id ORDER BY n DESC, lower(name), bait_id) AS i FROM g)
SELECT location_id, fish_id, string_agg(name, ',' ORDER BY i) AS baits FROM k WHERE i <= 3 GROUP BY ALL
""",
)
def location_top_baits(t: Tables) -> DataFrame:
    """The three most used baits of each fish at each location, by count, name and id."""
    counts = t.report.groupBy("location_id", "fish_id", "bait_id").agg(F.count("*").alias("n")).join(t.bait.select("bait_id", "name"), "bait_id")
    i = F.row_number().over(Window.partitionBy("location_id", "fish_id").orderBy(F.desc("n"), F.lower("name"), "bait_id"))
    best = counts.withColumn("i", i).where("i <= 3").groupBy("location_id", "fish_id").agg(F.array_sort(F.collect_list(F.struct("i", "name"))).alias("best"))
    return best.select("location_id", "fish_id", F.array_join(F.transform("best", lambda x: x["name"]), ",").alias("baits"))


@query(
    "base_selections",
    """
WITH k AS (SELECT list_sort(list(base_id)) AS known FROM {base} WHERE is_active),
u AS (SELECT r.user_id, list_sort(list(DISTINCT l.base_id)) AS chosen FROM {report} r JOIN {location} l ON l.location_id = r.location_id JOIN {base} b ON b.base_id = l.base_id WHERE b.is_active GROUP BY r.user_id)
SELECT user_id, CASE WHEN len(chosen) * 2 <= len(known) THEN 'include' ELSE 'exclude' END AS mode,
  array_to_string(CASE WHEN len(chosen) * 2 <= len(known) THEN chosen ELSE list_filter(known, lambda x: NOT list_contains(chosen, x)) END, ',') AS ids FROM u, k
""",
)
def base_selections(t: Tables) -> DataFrame:
    """Each user's active bases in the shorter spelling: those included or those excluded."""
    active = t.base.where("is_active").select("base_id")
    known = active.agg(F.sort_array(F.collect_list("base_id"))).scalar()
    chosen = located(t).join(active, "base_id", "left_semi").groupBy("user_id").agg(F.sort_array(F.collect_set("base_id")).alias("chosen"))
    rows = chosen.select("user_id", "chosen", known.alias("known"))
    few = F.size("chosen") * 2 <= F.size("known")
    ids = F.when(few, F.col("chosen")).otherwise(F.array_except("known", "chosen"))
    return rows.select("user_id", F.when(few, "include").otherwise("exclude").alias("mode"), F.array_join(F.transform(ids, lambda x: x.cast("string")), ",").alias("ids"))
