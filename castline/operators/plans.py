"""Change plans and pages: reconciliation, drift, frontiers, mixed-direction pages, filters over assessed records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paging import after, ordering
from ..plans.registry import query
from ..plans.tables import Tables
from .records import fish_maxima
from .reports import located


@query(
    "weight_reconciliation",
    """
WITH seen AS (SELECT l.base_id, r.fish_id, count(*) AS n, max(weight_grams) AS top FROM {report} r JOIN {location} l ON l.location_id = r.location_id GROUP BY ALL),
known AS (SELECT base_id, fish_id, max_weight_grams AS high FROM {member})
SELECT coalesce(s.base_id, k.base_id) AS base_id, coalesce(s.fish_id, k.fish_id) AS fish_id, high, top,
  CASE WHEN k.fish_id IS NULL THEN 'MISSING_CREATE' WHEN s.fish_id IS NULL THEN 'NO_EVIDENCE' WHEN high IS NULL THEN 'FILL' WHEN CAST(top AS BIGINT) * 20 > CAST(high AS BIGINT) * 21 THEN 'RAISE' WHEN n >= 3 AND CAST(top AS BIGINT) * 2 < high THEN 'REVIEW_LOWER' ELSE 'KEEP' END AS action
FROM seen s FULL OUTER JOIN known k ON k.base_id = s.base_id AND k.fish_id = s.fish_id
""",
)
def weight_reconciliation(t: Tables) -> DataFrame:
    """What to do with each pair's maximum given what was seen: six kinds of decision from one full outer join."""
    seen = located(t).groupBy("base_id", "fish_id").agg(F.count("*").alias("n"), F.max("weight_grams").cast("long").alias("top"))
    known = t.member.select("base_id", "fish_id", F.col("max_weight_grams").cast("long").alias("high"), F.lit(True).alias("known"))
    rows = seen.join(known, ["base_id", "fish_id"], "full_outer")
    action = (
        F.when(F.col("known").isNull(), "MISSING_CREATE")
        .when(F.col("n").isNull(), "NO_EVIDENCE")
        .when(F.col("high").isNull(), "FILL")
        .when(F.col("top") * 20 > F.col("high") * 21, "RAISE")
        .when((F.col("n") >= 3) & (F.col("top") * 2 < F.col("high")), "REVIEW_LOWER")
        .otherwise("KEEP")
    )
    return rows.select("base_id", "fish_id", "high", "top", action.alias("action"))


@query(
    "manifest_drift",
    """
WITH old AS (SELECT event_id % 500 AS k, event_type FROM events WHERE event_id % 2 = 0), new AS (SELECT event_id % 500 AS k, event_type FROM events WHERE event_id % 2 = 0 AND event_id % 97 <> 0 UNION ALL SELECT 9999, 'added')
SELECT 'lost' AS side, k, event_type FROM (SELECT * FROM old EXCEPT ALL SELECT * FROM new) UNION ALL SELECT 'gained', k, event_type FROM (SELECT * FROM new EXCEPT ALL SELECT * FROM old)
""",
)
def manifest_drift(t: Tables) -> DataFrame:
    """Rows a new manifest lost and gained, with their multiplicity."""
    rows = t.raw("events").where("event_id % 2 = 0").select((F.col("event_id") % 500).alias("k"), "event_type", "event_id")
    old = rows.select("k", "event_type")
    new = rows.where("event_id % 97 <> 0").select("k", "event_type").union(t.spark.createDataFrame([(9999, "added")], "k bigint, event_type string"))
    return old.exceptAll(new).select(F.lit("lost").alias("side"), "*").union(new.exceptAll(old).select(F.lit("gained").alias("side"), "*"))


@query(
    "crawl_frontier",
    """
WITH found AS (SELECT DISTINCT unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS url FROM pages), pending AS (SELECT url FROM pages WHERE page_id % 2 = 0), done AS (SELECT url FROM pages WHERE page_id % 2 = 1)
SELECT url FROM (SELECT url FROM found UNION SELECT url FROM pending) WHERE url NOT IN (SELECT url FROM done)
""",
)
def crawl_frontier(t: Tables) -> DataFrame:
    """Addresses still to visit: pending and newly found, each once, without those done."""
    pages = t.raw("pages")
    found = pages.select(F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'))).alias("url"))
    wanted = found.union(pages.where("page_id % 2 = 0").select("url")).distinct()
    return wanted.join(pages.where("page_id % 2 = 1").select("url"), "url", "left_anti")


AGGREGATE_ORDER = [("contributors", "desc"), ("fish_id", "asc"), ("location_id", "asc"), ("bait_id", "asc")]


@query(
    "aggregate_page",
    """
SELECT fish_id, location_id, bait_id, count(DISTINCT contributor_key) AS contributors FROM {report} GROUP BY ALL
HAVING count(DISTINCT contributor_key) < 3 OR (count(DISTINCT contributor_key) = 3 AND (fish_id, location_id, bait_id) > (100, 50, 3)) ORDER BY contributors DESC, fish_id, location_id, bait_id LIMIT 101
""",
)
def aggregate_page(t: Tables, limit: int = 100) -> DataFrame:
    """A page of aggregates after a cursor whose keys run in both directions."""
    groups = t.report.groupBy("fish_id", "location_id", "bait_id").agg(F.countDistinct("contributor_key").alias("contributors"))
    cursor = {"contributors": 3, "fish_id": 100, "location_id": 50, "bait_id": 3}
    return groups.where(after(AGGREGATE_ORDER, cursor)).orderBy(*ordering(AGGREGATE_ORDER)).limit(limit + 1)


@query(
    "records_at_bases",
    """
WITH m AS (SELECT *, max(max_weight_grams) OVER (PARTITION BY fish_id) AS top FROM {member} WHERE max_weight_grams IS NOT NULL),
x AS (SELECT m.fish_id, min(top) AS max_grams, list(b.name) AS bases FROM m JOIN {base} b ON b.base_id = m.base_id WHERE max_weight_grams = top GROUP BY m.fish_id)
SELECT x.fish_id, x.max_grams, len(bases) AS n_bases FROM x JOIN {fish} f ON f.fish_id = x.fish_id WHERE NOT f.is_rarest AND list_has_any(bases, ['NATION_6', 'NATION_12', 'NATION_14'])
""",
)
def records_at_bases(t: Tables) -> DataFrame:
    """Fish that are not of the rarest and whose maximum belongs to one of the chosen bases."""
    rows = fish_maxima(t).join(t.fish.where("not is_rarest").select("fish_id"), "fish_id", "left_semi")
    bases = F.col("max_bases")
    chosen = F.array(F.lit("NATION_6"), F.lit("NATION_12"), F.lit("NATION_14"))
    return rows.where(F.arrays_overlap(bases, chosen)).select("fish_id", "max_grams", F.size(bases).cast("long").alias("n_bases"))


@query(
    "mismatch_ranking",
    """
WITH s AS (SELECT l.base_id, r.fish_id, max(weight_grams) AS top FROM {report} r JOIN {location} l ON l.location_id = r.location_id GROUP BY ALL)
SELECT m.base_id, m.fish_id, CAST(top - max_weight_grams AS BIGINT) AS delta, row_number() OVER (ORDER BY abs(top - max_weight_grams) DESC NULLS FIRST, m.base_id, m.fish_id) AS n
FROM {member} m JOIN s ON s.base_id = m.base_id AND s.fish_id = m.fish_id WHERE max_weight_grams IS DISTINCT FROM top QUALIFY n <= 25
""",
)
def mismatch_ranking(t: Tables, n: int = 25) -> DataFrame:
    """The pairs whose seen and known maxima differ most; unknown maxima count as infinitely far."""
    seen = located(t).groupBy("base_id", "fish_id").agg(F.max("weight_grams").alias("top"))
    delta = (F.col("top") - F.col("max_weight_grams")).cast("long")
    rows = t.member.join(seen, ["base_id", "fish_id"]).where(~F.col("max_weight_grams").eqNullSafe(F.col("top"))).select("base_id", "fish_id", delta.alias("delta"))
    keys = [F.desc_nulls_first(F.abs("delta")), F.col("base_id"), F.col("fish_id")]
    return rows.orderBy(*keys).limit(n).select("base_id", "fish_id", "delta", F.row_number().over(Window.orderBy(*keys)).alias("n"))


@query(
    "unique_names",
    """
SELECT k, fish_id FROM (SELECT substr(name_normalized, 1, 6) AS k, min(fish_id) AS fish_id, count(*) AS n FROM {fish} GROUP BY ALL) WHERE n = 1
UNION ALL SELECT k, NULL FROM (SELECT substr(name_normalized, 1, 6) AS k, count(*) AS n FROM {fish} GROUP BY ALL) WHERE n > 1
""",
)
def unique_names(t: Tables) -> DataFrame:
    """A mapping that keeps only unambiguous names; ambiguous ones map to nothing."""
    groups = t.fish.groupBy(F.substring("name_normalized", 1, 6).alias("k")).agg(F.min("fish_id").alias("only"), F.count("*").alias("n"))
    return groups.select("k", F.when(F.col("n") == 1, F.col("only")).alias("fish_id"))
