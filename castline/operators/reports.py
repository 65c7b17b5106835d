"""Statistics over catch reports: distinct contributors, spots, baits, conditions, personal records, feeds."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paging import after, ordering
from ..plans.registry import query
from ..plans.tables import Tables, spot_key

PAGE = 20
#: Rows a task holds where facts are dealt by a group's key: what it sorts follows this, however many rows there are.
DEALT = 1 << 17
SPEEDS = {"SLOW": 0, "MEDIUM": 1, "FAST": 2}
SIZES = {"SMALL": 0, "LARGE": 1}


def _rank(value: Column, ranks: dict[str, int]) -> Column:
    out = F.lit(len(ranks))
    for name, rank in ranks.items():
        out = F.when(value == name, rank).otherwise(out)
    return out


def parts_of(facts: DataFrame) -> int:
    """The parts that facts are dealt into, by their number."""
    return max(1, -(-facts.count() // DEALT))


def dealt(t: Tables, rows: DataFrame, *keys: str) -> DataFrame:
    """rows of the facts shuffled once by the keys, into parts by the number of facts; what is grouped by the keys and more needs no other shuffle."""
    return rows.repartition(parts_of(t.raw("lineitem")), *keys)


def first_of(keys: list[str], *value: str) -> Column:
    """Whether a row is one that stands for its value in its group: the sum over a group counts its distinct values, nulls left out."""
    n = F.row_number().over(Window.partitionBy(*keys, *value).orderBy(value[0]))
    known = F.col(value[0]).isNotNull()
    for v in value[1:]:
        known = known | F.col(v).isNotNull()
    return (known & (n == 1)).cast("long")


def located(t: Tables) -> DataFrame:
    return t.report.join(t.location.select("location_id", "base_id"), "location_id")


def fish_catch_aggregates(t: Tables, least_contributors: int = 2) -> DataFrame:
    """Per fish, base, location and bait: contributors, reports, weights, spots, spinning combinations; history stays without a membership.

    One pass over the facts: a location tells its base and a pair its bounds, so
    these join the groups that are left.  A value is the only one if least and
    greatest agree, and the few combinations are bits; distinct contributors and
    places are counted where the group's rows are.
    """
    keys = ["fish_id", "location_id", "bait_id"]
    columns = [*keys, "contributor_key", "weight_grams", "hole_depth_cm", "user_note_raw", "fishing_method", "spinning_speed", "spinning_size"]
    rows = dealt(t, t.report.select(*columns, spot_key(F.col("spot_position_raw")).alias("spot")), *keys)
    rows = rows.withColumns({"_contributor": first_of(keys, "contributor_key"), "_place": first_of(keys, "hole_depth_cm", "spot")})
    bit = _rank(F.col("spinning_speed"), SPEEDS) * (len(SIZES) + 1) + _rank(F.col("spinning_size"), SIZES)
    spun = (F.col("fishing_method") == "SPINNING") & (F.col("spinning_speed").isNotNull() | F.col("spinning_size").isNotNull())
    only = lambda c: F.when(F.min(c) == F.max(c), F.min(c))
    grouped = rows.groupBy(*keys).agg(
        F.sum("_contributor").alias("contributors"),
        F.count("*").alias("reports"),
        F.max("weight_grams").alias("max_observed"),
        F.sum("_place").alias("places"),
        only("hole_depth_cm").alias("only_depth"),
        only("user_note_raw").alias("only_note"),
        F.bit_or(F.when(spun, F.pow(F.lit(2), bit).cast("long"))).alias("bits"),
    )
    names = [f"{speed}/{size}" for speed in (*SPEEDS, "-") for size in (*SIZES, "-")]
    held = F.filter(F.array(*[F.when(F.col("bits").bitwiseAND(1 << i) != 0, name) for i, name in enumerate(names)]), lambda x: x.isNotNull())
    kept = grouped.where(F.col("contributors") >= least_contributors).withColumn("combinations", F.array_join(held, ",")).drop("bits")
    located_groups = kept.join(t.location.select("location_id", "base_id"), "location_id").join(t.member, ["base_id", "fish_id"], "left")
    return located_groups.join(t.fish.select("fish_id", F.col("name").alias("fish")), "fish_id").join(t.base.select("base_id", F.col("name").alias("base")), "base_id")


query(
    "fish_catch_aggregates",
    """
SELECT r.fish_id, l.base_id, r.location_id, r.bait_id, m.min_weight_grams, m.max_weight_grams, f.name AS fish, b.name AS base,
  count(DISTINCT contributor_key) AS contributors, count(*) AS reports, max(weight_grams) AS max_observed,
  count(DISTINCT CASE WHEN hole_depth_cm IS NOT NULL OR {spot_key} IS NOT NULL THEN {'d': hole_depth_cm, 's': {spot_key}} END) AS places,
  CASE WHEN count(DISTINCT hole_depth_cm) = 1 THEN min(hole_depth_cm) END AS only_depth,
  CASE WHEN count(DISTINCT user_note_raw) = 1 THEN min(user_note_raw) END AS only_note,
  coalesce(array_to_string(list_transform(list_sort(list_distinct(list({'a': CASE spinning_speed WHEN 'SLOW' THEN 0 WHEN 'MEDIUM' THEN 1 WHEN 'FAST' THEN 2 ELSE 3 END,
    'b': CASE spinning_size WHEN 'SMALL' THEN 0 WHEN 'LARGE' THEN 1 ELSE 2 END, 'c': coalesce(spinning_speed, '-') || '/' || coalesce(spinning_size, '-')})
    FILTER (WHERE fishing_method = 'SPINNING' AND (spinning_speed IS NOT NULL OR spinning_size IS NOT NULL)))), lambda x: x.c), ','), '') AS combinations
FROM {report} r JOIN {location} l ON l.location_id = r.location_id LEFT JOIN {member} m ON m.base_id = l.base_id AND m.fish_id = r.fish_id
JOIN {fish} f ON f.fish_id = r.fish_id JOIN {base} b ON b.base_id = l.base_id
GROUP BY ALL HAVING count(DISTINCT contributor_key) >= 2
""",
)(fish_catch_aggregates)


@query(
    "bait_statistics",
    """
SELECT fish_id, bait_id, type, contributors, reports, fish_reports, fish_contributor_rows, rank FROM (
  SELECT g.*, b.type, sum(reports) OVER (PARTITION BY fish_id) AS fish_reports, sum(contributors) OVER (PARTITION BY fish_id) AS fish_contributor_rows,
    row_number() OVER (PARTITION BY fish_id ORDER BY contributors DESC, reports DESC, g.bait_id) AS rank
  FROM (SELECT fish_id, bait_id, count(DISTINCT contributor_key) AS contributors, count(*) AS reports FROM {report} GROUP BY ALL) g
  JOIN {bait} b ON b.bait_id = g.bait_id) WHERE rank <= 3
""",
)
def bait_statistics(t: Tables) -> DataFrame:
    """The three best baits of each fish, with totals over all its baits."""
    groups = t.report.groupBy("fish_id", "bait_id").agg(F.countDistinct("contributor_key").alias("contributors"), F.count("*").alias("reports")).join(t.bait.select("bait_id", "type"), "bait_id")
    of_fish = Window.partitionBy("fish_id")
    best = of_fish.orderBy(F.desc("contributors"), F.desc("reports"), "bait_id")
    totals = groups.withColumn("fish_reports", F.sum("reports").over(of_fish)).withColumn("fish_contributor_rows", F.sum("contributors").over(of_fish))
    return totals.withColumn("rank", F.row_number().over(best)).where("rank <= 3").select("fish_id", "bait_id", "type", "contributors", "reports", "fish_reports", "fish_contributor_rows", "rank")


@query(
    "condition_statistics",
    """
SELECT fish_id, fishing_method, fishing_note, spinning_size, spinning_speed, count(DISTINCT contributor_key) AS contributors, count(*) AS reports, max(created_at) AS latest
FROM {report} GROUP BY ALL
""",
)
def condition_statistics(t: Tables) -> DataFrame:
    """Per fish and combination of method, note, size and speed; a null is a group of its own."""
    return t.report.groupBy("fish_id", "fishing_method", "fishing_note", "spinning_size", "spinning_speed").agg(F.countDistinct("contributor_key").alias("contributors"), F.count("*").alias("reports"), F.max("created_at").alias("latest"))


@query(
    "hole_statistics",
    """
WITH c AS (SELECT *, {spot_key} AS spot FROM {report} WHERE hole_depth_cm IS NOT NULL),
v AS (SELECT location_id, hole_depth_cm, spot, spot_position_raw, count(DISTINCT contributor_key) AS contributors, count(*) AS reports, max(created_at) AS latest FROM c GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY location_id, hole_depth_cm, spot ORDER BY contributors DESC, reports DESC, latest DESC, spot_position_raw) AS n FROM v WHERE spot IS NOT NULL),
g AS (SELECT location_id, hole_depth_cm, spot, count(DISTINCT contributor_key) AS contributors, count(*) AS reports, count(DISTINCT fish_id) AS fish, max(created_at) AS latest FROM c GROUP BY ALL)
SELECT g.location_id, g.hole_depth_cm, g.contributors, g.reports, g.fish, g.latest, r.spot_position_raw AS spot_position, g.spot
FROM g LEFT JOIN r ON r.n = 1 AND r.location_id = g.location_id AND r.hole_depth_cm = g.hole_depth_cm AND r.spot = g.spot
""",
)
def hole_statistics(t: Tables) -> DataFrame:
    """Per location, depth and normalised spot, with its most usual spelling; no spot means no spelling."""
    return _places(t, "hole_depth_cm is not null").drop("top_baits")


@query(
    "spot_statistics",
    """
WITH c AS (SELECT * FROM (SELECT *, {spot_key} AS spot FROM {report}) WHERE hole_depth_cm IS NOT NULL OR spot IS NOT NULL),
v AS (SELECT location_id, hole_depth_cm, spot, spot_position_raw, count(DISTINCT contributor_key) AS contributors, count(*) AS reports, max(created_at) AS latest FROM c GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY location_id, hole_depth_cm, spot ORDER BY contributors DESC, reports DESC, latest DESC, spot_position_raw) AS n FROM v WHERE spot IS NOT NULL),
g AS (SELECT location_id, hole_depth_cm, spot, count(DISTINCT contributor_key) AS contributors, count(*) AS reports, count(DISTINCT fish_id) AS fish, max(created_at) AS latest FROM c GROUP BY ALL),
k AS (SELECT location_id, hole_depth_cm, spot, bait_id, count(DISTINCT contributor_key) AS contributors, count(*) AS reports FROM c GROUP BY ALL),
top AS (SELECT location_id, hole_depth_cm, spot, string_agg(CAST(bait_id AS VARCHAR), ',' ORDER BY n) AS top_baits FROM
  (SELECT *, row_number() OVER (PARTITION BY location_id, hole_depth_cm, spot ORDER BY contributors DESC, reports DESC, bait_id) AS n FROM k) WHERE n <= 3 GROUP BY ALL)
SELECT g.location_id, g.hole_depth_cm, g.contributors, g.reports, g.fish, g.latest, r.spot_position_raw AS spot_position, g.spot, top.top_baits
FROM g LEFT JOIN r ON r.n = 1 AND r.location_id = g.location_id AND r.hole_depth_cm IS NOT DISTINCT FROM g.hole_depth_cm AND r.spot IS NOT DISTINCT FROM g.spot
LEFT JOIN top ON top.location_id = g.location_id AND top.hole_depth_cm IS NOT DISTINCT FROM g.hole_depth_cm AND top.spot IS NOT DISTINCT FROM g.spot
""",
)
def spot_statistics(t: Tables) -> DataFrame:
    """Per location, depth and spot where either is known, null-safe, with the top three baits."""
    return _places(t, "hole_depth_cm is not null or spot is not null")


def _places(t: Tables, known: str) -> DataFrame:
    """Counts, latest report, usual spelling and top three baits of each place, from one shuffle of the facts by place.

    Spellings and baits are groups inside a place, so their sums are windows over
    the place's few combinations of both; a baits' list is as long as the catalog.
    """
    keys = ["location_id", "hole_depth_cm", "spot"]
    spelling, bait = [*keys, "spot_position_raw"], [*keys, "bait_id"]
    facts = t.report.select("location_id", "hole_depth_cm", spot_key(F.col("spot_position_raw")).alias("spot"), "spot_position_raw", "bait_id", "contributor_key", "fish_id", "created_at").where(known)
    who = "contributor_key"
    rows = dealt(t, facts, *keys).withColumns({"c": first_of(keys, who), "cs": first_of(spelling, who), "cb": first_of(bait, who), "f": first_of(keys, "fish_id")})
    sums = [F.sum(c).alias(c) for c in ("c", "cs", "cb", "f")]
    both = rows.groupBy(*spelling, "bait_id").agg(F.count("*").alias("r"), F.max("created_at").alias("latest"), *sums)
    of_spelling, of_bait = Window.partitionBy(*spelling), Window.partitionBy(*bait)
    both = both.withColumns({"s_c": F.sum("cs").over(of_spelling), "s_r": F.sum("r").over(of_spelling), "s_latest": F.max("latest").over(of_spelling), "b_c": F.sum("cb").over(of_bait), "b_r": F.sum("r").over(of_bait)})
    # least struct: most contributors, most reports, latest, spelling
    usual = F.struct((-F.col("s_c")).alias("c"), (-F.col("s_r")).alias("r"), F.coalesce(-F.unix_micros(F.col("s_latest").cast("timestamp")), F.lit((1 << 63) - 1)).alias("l"), F.col("spot_position_raw").alias("name"))
    best = F.slice(F.array_sort(F.collect_set(F.struct((-F.col("b_c")).alias("c"), (-F.col("b_r")).alias("r"), "bait_id"))), 1, 3)
    places = both.groupBy(*keys).agg(
        F.sum("c").alias("contributors"), F.sum("r").alias("reports"), F.sum("f").alias("fish"), F.max("latest").alias("latest"), F.min(F.when(F.col("spot").isNotNull(), usual)).alias("usual"), best.alias("best")
    )
    top = F.array_join(F.transform("best", lambda x: x["bait_id"].cast("string")), ",")
    return places.select("location_id", "hole_depth_cm", "contributors", "reports", "fish", "latest", F.col("usual.name").alias("spot_position"), "spot", top.alias("top_baits"))


@query(
    "spot_summary",
    """
WITH c AS (SELECT *, {spot_key} AS spot FROM {report})
SELECT fish_id, count(*) AS reports, count(*) FILTER (WHERE hole_depth_cm IS NULL AND spot IS NULL) AS unlocated,
  count(DISTINCT {'l': location_id, 'd': hole_depth_cm, 's': spot}) FILTER (WHERE hole_depth_cm IS NOT NULL OR spot IS NOT NULL) AS spots FROM c GROUP BY fish_id
""",
)
def spot_summary(t: Tables) -> DataFrame:
    """Reports, reports without a place and distinct places of each fish in one pass."""
    rows = t.report.withColumn("spot", spot_key(F.col("spot_position_raw")))
    placed = F.col("hole_depth_cm").isNotNull() | F.col("spot").isNotNull()
    return rows.groupBy("fish_id").agg(F.count("*").alias("reports"), F.count_if(~placed).alias("unlocated"), F.countDistinct(F.when(placed, F.struct("location_id", "hole_depth_cm", "spot"))).alias("spots"))



def native() -> Column:
    """A user's own report, not an imported one."""
    return F.col("import_key").isNull() & (F.col("contributor_key") == F.concat(F.lit("local-user:"), F.col("user_id").cast("string")))


NATIVE_SQL = "import_key IS NULL AND contributor_key = concat('local-user:', CAST(user_id AS VARCHAR))"


@query(
    "personal_statistics",
    f"""
SELECT user_id, count(*) AS reports, count(DISTINCT fish_id) AS fish, count(DISTINCT l.base_id) AS bases, count(DISTINCT r.location_id) AS locations,
  max(weight_grams) AS heaviest, min(created_at) AS first_at FROM {{report}} r JOIN {{location}} l ON l.location_id = r.location_id WHERE {NATIVE_SQL} GROUP BY user_id
""",
)
def personal_statistics(t: Tables) -> DataFrame:
    """Each user's own reports, imports left out."""
    return located(t).where(native()).groupBy("user_id").agg(
        F.count("*").alias("reports"), F.countDistinct("fish_id").alias("fish"), F.countDistinct("base_id").alias("bases"), F.countDistinct("location_id").alias("locations"),
        F.max("weight_grams").alias("heaviest"), F.min("created_at").alias("first_at"),
    )


@query(
    "personal_rankings",
    f"""
SELECT user_id, fish_id, reports, rank FROM (SELECT g.*, row_number() OVER (PARTITION BY user_id ORDER BY reports DESC, name_normalized, g.fish_id) AS rank
FROM (SELECT user_id, fish_id, count(*) AS reports FROM {{report}} WHERE {NATIVE_SQL} GROUP BY ALL) g JOIN {{fish}} f ON f.fish_id = g.fish_id) WHERE rank <= 10
""",
)
def personal_rankings(t: Tables) -> DataFrame:
    """Each user's ten most reported fish, by count, name and id."""
    counts = t.report.where(native()).groupBy("user_id", "fish_id").agg(F.count("*").alias("reports")).join(t.fish.select("fish_id", "name_normalized"), "fish_id")
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("reports"), "name_normalized", "fish_id"))
    return counts.withColumn("rank", rank).where("rank <= 10").select("user_id", "fish_id", "reports", "rank")


@query(
    "personal_records",
    f"""
SELECT user_id, fish_id, report_id, weight_grams, created_at FROM (SELECT *, row_number() OVER (PARTITION BY user_id, fish_id ORDER BY weight_grams DESC, created_at, report_id) AS n
FROM {{report}} WHERE {NATIVE_SQL}) WHERE n = 1
""",
)
def personal_records(t: Tables) -> DataFrame:
    """Each user's heaviest report of each fish; the oldest of equals."""
    n = F.row_number().over(Window.partitionBy("user_id", "fish_id").orderBy(F.desc("weight_grams"), "created_at", "report_id"))
    return t.report.where(native()).select("user_id", "fish_id", "report_id", "weight_grams", "created_at").withColumn("n", n).where("n = 1").drop("n")


@query(
    "location_observations",
    """
WITH g AS (SELECT location_id, fish_id, count(*) AS reports, count(DISTINCT contributor_key) AS contributors, count(DISTINCT hole_depth_cm) AS holes, count(DISTINCT user_note_raw) AS notes FROM {report} GROUP BY ALL),
m AS (SELECT * FROM (SELECT location_id, fish_id, report_id, weight_grams, row_number() OVER (PARTITION BY location_id, fish_id ORDER BY weight_grams DESC, created_at DESC, report_id DESC) AS n FROM {report}) WHERE n = 1)
SELECT g.*, m.report_id AS record_id, m.weight_grams AS record_grams FROM g JOIN m ON m.location_id = g.location_id AND m.fish_id = g.fish_id
""",
)
def location_observations(t: Tables) -> DataFrame:
    """Per location and fish: counts, and the heaviest report, the newest of equals, where the group's rows are."""
    keys = ["location_id", "fish_id"]
    best = F.max(F.struct("weight_grams", "created_at", "report_id"))
    rows = dealt(t, t.report.select(*keys, "contributor_key", "hole_depth_cm", "user_note_raw", "weight_grams", "created_at", "report_id"), *keys)
    rows = rows.withColumns({"c": first_of(keys, "contributor_key"), "h": first_of(keys, "hole_depth_cm"), "u": first_of(keys, "user_note_raw")})
    groups = rows.groupBy(*keys).agg(F.count("*").alias("reports"), F.sum("c").alias("contributors"), F.sum("h").alias("holes"), F.sum("u").alias("notes"), best.alias("best"))
    return groups.select("location_id", "fish_id", "reports", "contributors", "holes", "notes", F.col("best.report_id").alias("record_id"), F.col("best.weight_grams").alias("record_grams"))


FEED = [("created_at", "desc"), ("report_id", "desc")]


def feed(t: Tables, limit: int = PAGE, cursor: dict | None = None, base_ids: list[int] | None = None, own: bool = False, **equal: int | None) -> DataFrame:
    """A page of reports, newest first, and one row more that tells if another page follows.

    ``equal`` are values of fish_id, base_id, location_id, bait_id or user_id; ``own`` leaves imports out and needs a user_id.
    """
    if unknown := set(equal) - {"fish_id", "base_id", "location_id", "bait_id", "user_id"}:
        raise ValueError(f"no such filters: {sorted(unknown)}")
    if own and equal.get("user_id") is None:
        raise ValueError("only a user's own reports are native")
    rows = located(t)
    for name, value in equal.items():
        rows = rows if value is None else rows.where(F.col(name) == value)
    if base_ids is not None:
        rows = rows.where(F.col("base_id").isin(base_ids))
    if own:
        rows = rows.where(native())
    if cursor:
        rows = rows.where(after(FEED, cursor))
    return rows.orderBy(*ordering(FEED)).limit(limit + 1)


@query("feed_page", "SELECT report_id, r.location_id, fish_id, bait_id, weight_grams, created_at FROM {report} r JOIN {location} l ON l.location_id = r.location_id WHERE base_id IN (1, 2, 3, 4, 5, 6, 7) ORDER BY created_at DESC, report_id DESC LIMIT 21")
def feed_page(t: Tables) -> DataFrame:
    return feed(t, base_ids=[1, 2, 3, 4, 5, 6, 7]).select("report_id", "location_id", "fish_id", "bait_id", "weight_grams", "created_at")


@query(
    "owner_feed_page",
    f"SELECT report_id, r.location_id, fish_id, bait_id, weight_grams, created_at FROM {{report}} r JOIN {{location}} l ON l.location_id = r.location_id WHERE user_id = 52 AND bait_id = 3 AND {NATIVE_SQL} AND (created_at < TIMESTAMP '2000-06-01' OR (created_at = TIMESTAMP '2000-06-01' AND report_id < 5000)) ORDER BY created_at DESC, report_id DESC LIMIT 21",
)
def owner_feed_page(t: Tables) -> DataFrame:
    """A later page of one user's own reports with one bait."""
    cursor = {"created_at": datetime(2000, 6, 1), "report_id": 5000}
    return feed(t, cursor=cursor, own=True, user_id=52, bait_id=3).select("report_id", "location_id", "fish_id", "bait_id", "weight_grams", "created_at")


def aggregate_order(by_place: bool, way: str = "desc") -> list[tuple[str, str]]:
    """Keys of a fish's aggregates: by intensity, or by place with intensity inside it."""
    if not by_place:
        return [("intensity", way), ("location_id", "asc"), ("bait_id", "asc")]
    return [("base", "asc"), ("base_id", "asc"), ("number", "asc"), ("location_id", "asc"), ("intensity", way), ("bait", "asc"), ("bait_id", "asc")]


def aggregates_of_fish(
    t: Tables, fish_id: int, by_place: bool = False, way: str = "desc", cursor: dict | None = None, limit: int = PAGE, base_ids: list[int] | None = None, least: int | None = None, comment: bool = False, hole: bool = False, spinning: bool = False
) -> DataFrame:
    """A page of a fish's places and baits; filters look at the finished groups, so their counts stay whole."""
    rows = t.report.where(F.col("fish_id") == fish_id).withColumn("spot", spot_key(F.col("spot_position_raw")))
    placed = F.col("hole_depth_cm").isNotNull() | F.col("spot").isNotNull()
    spun = (F.col("fishing_method") == "SPINNING") & (F.col("spinning_speed").isNotNull() | F.col("spinning_size").isNotNull())
    groups = rows.groupBy("location_id", "bait_id").agg(F.count("*").alias("intensity"), F.countDistinct("user_note_raw").alias("comments"), F.countDistinct(F.when(placed, F.struct("hole_depth_cm", "spot"))).alias("holes"), F.count_if(spun).alias("spun"))
    named = groups.join(t.location.select("location_id", "base_id", "number"), "location_id").join(t.base.select("base_id", F.col("name_normalized").alias("base")), "base_id").join(t.bait.select("bait_id", F.col("name").alias("bait")), "bait_id")
    for wanted, test in ((base_ids is not None, F.col("base_id").isin(base_ids or [])), (least is not None, F.col("intensity") >= (least or 0)), (comment, F.col("comments") > 0), (hole, F.col("holes") > 0), (spinning, F.col("spun") > 0)):
        named = named.where(test) if wanted else named
    order = aggregate_order(by_place, way)
    if cursor:
        named = named.where(after(order, cursor))
    return named.orderBy(*ordering(order)).limit(limit + 1)


@query(
    "aggregates_by_place",
    """
WITH x AS (SELECT l.base_id, b.name_normalized AS base, r.location_id, l.number, r.bait_id, i.name AS bait, count(*) AS intensity, count(DISTINCT user_note_raw) AS comments,
    count(DISTINCT CASE WHEN hole_depth_cm IS NOT NULL OR {spot_key} IS NOT NULL THEN {'d': hole_depth_cm, 's': {spot_key}} END) AS holes
  FROM {report} r JOIN {location} l ON l.location_id = r.location_id JOIN {base} b ON b.base_id = l.base_id JOIN {bait} i ON i.bait_id = r.bait_id WHERE r.fish_id = 7 GROUP BY ALL)
SELECT base, number, location_id, bait_id, intensity, comments, holes FROM x WHERE base_id IN (2, 5, 8, 11, 14, 17, 20) AND intensity >= 1 AND holes > 0
  AND (base > 'nation_14' OR (base = 'nation_14' AND (base_id > 14 OR (base_id = 14 AND (number > 15 OR (number = 15 AND (location_id > 15 OR (location_id = 15 AND (intensity < 2 OR (intensity = 2 AND (bait > 'bait 2' OR (bait = 'bait 2' AND bait_id > 2))))))))))))
ORDER BY base, base_id, number, location_id, intensity DESC, bait, bait_id LIMIT 21
""",
)
def aggregates_by_place(t: Tables) -> DataFrame:
    """A later page in the order of places, over groups with a hole in chosen bases."""
    cursor = {"base": "nation_14", "base_id": 14, "number": 15, "location_id": 15, "intensity": 2, "bait": "bait 2", "bait_id": 2}
    rows = aggregates_of_fish(t, 7, by_place=True, cursor=cursor, base_ids=[2, 5, 8, 11, 14, 17, 20], least=1, hole=True)
    return rows.select("base", "number", "location_id", "bait_id", "intensity", "comments", "holes")


@query("fish_catch_values", "SELECT DISTINCT user_note_raw AS value FROM {report} WHERE user_note_raw IS NOT NULL ORDER BY value LIMIT 26")
def fish_catch_values(t: Tables, offset: int = 0) -> DataFrame:
    """A page of 25 distinct comments, and one more that tells if another page follows."""
    return t.report.where("user_note_raw is not null").select(F.col("user_note_raw").alias("value")).distinct().orderBy("value").offset(offset).limit(26)


@query(
    "top_contributors",
    """
SELECT contributor_key, count(*) AS reports, sum(weight_grams) AS grams, count(DISTINCT fish_id) AS fish FROM {report} GROUP BY contributor_key
ORDER BY reports DESC, grams DESC, fish DESC, contributor_key LIMIT 10
""",
)
def top_contributors(t: Tables) -> DataFrame:
    groups = t.report.groupBy("contributor_key").agg(F.count("*").alias("reports"), F.sum("weight_grams").alias("grams"), F.countDistinct("fish_id").alias("fish"))
    return groups.orderBy(F.desc("reports"), F.desc("grams"), F.desc("fish"), "contributor_key").limit(10)


@query(
    "native_users",
    f"SELECT DISTINCT user_id FROM {{report}} a WHERE EXISTS (SELECT 1 FROM {{report}} b WHERE b.user_id = a.user_id AND {NATIVE_SQL.replace('import_key', 'b.import_key').replace('contributor_key', 'b.contributor_key').replace('CAST(user_id', 'CAST(b.user_id')})",
)
def native_users(t: Tables) -> DataFrame:
    """Users with at least one report of their own, as a semi join."""
    return t.report.select("user_id").distinct().join(t.report.where(native()).select("user_id"), "user_id", "left_semi")
