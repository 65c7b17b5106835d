"""Catalog queries: filters, counts, search, alphabet groups, lookups, set differences."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paging import numbered
from ..plans.registry import query
from ..plans.tables import Tables


@query("active_locations", "SELECT location_id, l.base_id, l.number, l.name FROM {location} l JOIN {base} b ON b.base_id = l.base_id WHERE l.is_active AND b.is_active")
def active_locations(t: Tables) -> DataFrame:
    """Active locations of active bases."""
    return t.location.where("is_active").join(t.base.where("is_active").select("base_id"), "base_id", "left_semi").select("location_id", "base_id", "number", "name")


@query(
    "base_summary",
    """
SELECT b.base_id, b.name, coalesce(l.n, 0) AS locations, coalesce(f.n, 0) AS fish FROM {base} b
LEFT JOIN (SELECT base_id, count(*) AS n FROM {location} WHERE is_active GROUP BY base_id) l ON l.base_id = b.base_id
LEFT JOIN (SELECT m.base_id, count(*) AS n FROM {member} m JOIN {fish} f ON f.fish_id = m.fish_id WHERE f.is_active GROUP BY m.base_id) f ON f.base_id = b.base_id
""",
)
def base_summary(t: Tables) -> DataFrame:
    """Active locations and fish of each base, aggregated apart so that neither multiplies the other."""
    locations = t.location.where("is_active").groupBy("base_id").agg(F.count("*").alias("locations"))
    fish = t.member.join(t.fish.where("is_active").select("fish_id"), "fish_id", "left_semi").groupBy("base_id").agg(F.count("*").alias("fish"))
    return t.base.select("base_id", "name").join(locations, "base_id", "left").join(fish, "base_id", "left").na.fill(0, ["locations", "fish"])


def tokens(text: Column) -> Column:
    """Lower-cased tokens between white space and punctuation."""
    return F.filter(F.split(F.lower(text), r"[\s\p{Punct}]+"), lambda x: x != "")


def _some(words: Column, x: Column, test: Callable[[Column, Column], Column]) -> Column:
    return F.exists(words, lambda w: test(w, x))


def search_rank(name: Column, wanted: str) -> Column:
    """0 equal, 1 prefix, 2 every token a prefix of one of the name's, 3 every token inside one, else null."""
    q = [x for x in wanted.lower().split() if x]
    words = tokens(name)
    all_prefix, all_inside = F.lit(True), F.lit(True)
    for x in map(F.lit, q):
        all_prefix = all_prefix & _some(words, x, F.startswith)
        all_inside = all_inside & _some(words, x, F.contains)
    low = F.lower(name)
    return F.when(low == wanted.lower(), 0).when(F.startswith(low, F.lit(wanted.lower())), 1).when(all_prefix, 2).when(all_inside, 3)


@query(
    "global_search",
    """
WITH a AS (SELECT 'base' AS kind, CAST(base_id AS BIGINT) AS id, name FROM {base} UNION ALL SELECT 'bait', CAST(bait_id AS BIGINT), name FROM {bait}
  UNION ALL SELECT 'fish', CAST(fish_id AS BIGINT), name FROM {fish} UNION ALL SELECT 'location', CAST(location_id AS BIGINT), name FROM {location}),
w AS (SELECT *, list_filter(regexp_split_to_array(lower(name), '[\\s!-/:-@\\[-`{-~]+'), lambda x: x <> '') AS ws FROM a),
r AS (SELECT *, CASE WHEN lower(name) = 'ba' THEN 0 WHEN starts_with(lower(name), 'ba') THEN 1 WHEN len(list_filter(ws, lambda x: starts_with(x, 'ba'))) > 0 THEN 2
  WHEN len(list_filter(ws, lambda x: contains(x, 'ba'))) > 0 THEN 3 END AS rank FROM w)
SELECT kind, id, name, rank FROM r WHERE rank IS NOT NULL ORDER BY rank, kind, lower(name), name, id LIMIT 50
""".replace("{-~]", "\\{-~]"),
)
def global_search(t: Tables, wanted: str = "ba", limit: int = 50) -> DataFrame:
    """One ranked list over bases, locations, fish and baits."""
    parts = [t.base.select(F.lit("base").alias("kind"), F.col("base_id").cast("long").alias("id"), "name")]
    for kind, table, key in (("bait", t.bait, "bait_id"), ("fish", t.fish, "fish_id"), ("location", t.location, "location_id")):
        parts.append(table.select(F.lit(kind).alias("kind"), F.col(key).cast("long").alias("id"), "name"))
    everything = parts[0]
    for part in parts[1:]:
        everything = everything.unionByName(part)
    ranked = everything.withColumn("rank", search_rank(F.col("name"), wanted)).where("rank is not null")
    return ranked.orderBy("rank", "kind", F.lower("name"), "name", "id").limit(limit)


@query("alphabet_groups", r"SELECT upper(regexp_extract(name, '[\p{L}\p{N}]', 0)) AS letter, count(*) AS fish, min(name) AS first_name FROM {fish} GROUP BY ALL")
def alphabet_groups(t: Tables) -> DataFrame:
    """Fish by the first letter, of any script, or digit of the name."""
    return t.fish.groupBy(F.upper(F.regexp_extract("name", r"[\p{L}\p{N}]", 0)).alias("letter")).agg(F.count("*").alias("fish"), F.min("name").alias("first_name"))


@query("fish_numeric_order", "SELECT fish_id, row_number() OVER (ORDER BY length(CAST(fish_id AS VARCHAR)), CAST(fish_id AS VARCHAR)) AS n FROM {fish} WHERE is_rarest")
def fish_numeric_order(t: Tables) -> DataFrame:
    """Decimal strings by length, then text."""
    text = F.col("fish_id").cast("string")
    return numbered(t.fish.where("is_rarest").select("fish_id"), [F.length(text), text]).select("fish_id", "n")


@query("hash_sample", "SELECT fish_id, sha256(name) AS h FROM {fish} ORDER BY h, fish_id LIMIT 25")
def hash_sample(t: Tables, n: int = 25) -> DataFrame:
    """A sample that any run draws alike: the n smallest hashes."""
    return t.fish.select("fish_id", F.sha2("name", 256).alias("h")).orderBy("h", "fish_id").limit(n)


@query(
    "lookup_status",
    """
WITH k AS (SELECT substr(name_normalized, 1, 8) AS k, count(*) AS n, min(fish_id) AS fish_id FROM {fish} GROUP BY ALL)
SELECT q.k, CASE WHEN k.n IS NULL THEN 'NOT_FOUND' WHEN k.n = 1 THEN 'UNIQUE' ELSE 'AMBIGUOUS' END AS status, CASE WHEN k.n = 1 THEN k.fish_id END AS fish_id
FROM (SELECT DISTINCT substr(lower(p_name), 1, 8) AS k FROM part WHERE p_partkey % 3 = 0 UNION SELECT 'no such ') q LEFT JOIN k ON k.k = q.k
""",
)
def lookup_status(t: Tables) -> DataFrame:
    """Names looked up in an index: unique, ambiguous or not found."""
    short = F.substring("name_normalized", 1, 8)
    index = t.fish.groupBy(short.alias("k")).agg(F.count("*").alias("n"), F.min("fish_id").alias("only"))
    wanted = t.fish.where("fish_id % 3 = 0").select(short.alias("k")).union(t.spark.createDataFrame([("no such ",)], "k string")).distinct()
    found = wanted.join(index, "k", "left")
    status = F.when(F.col("n").isNull(), "NOT_FOUND").when(F.col("n") == 1, "UNIQUE").otherwise("AMBIGUOUS")
    return found.select("k", status.alias("status"), F.when(F.col("n") == 1, F.col("only")).alias("fish_id"))


@query(
    "membership_diff",
    """
WITH want AS (SELECT DISTINCT l.base_id, r.fish_id FROM {report} r JOIN {location} l ON l.location_id = r.location_id WHERE r.weight_grams >= 2500),
have AS (SELECT base_id, fish_id FROM {member})
SELECT coalesce(w.base_id, h.base_id) AS base_id, count(*) FILTER (WHERE w.base_id IS NOT NULL AND h.base_id IS NOT NULL) AS kept, count(*) FILTER (WHERE h.base_id IS NULL) AS added, count(*) FILTER (WHERE w.base_id IS NULL) AS removed
FROM want w FULL OUTER JOIN have h ON h.base_id = w.base_id AND h.fish_id = w.fish_id GROUP BY 1
""",
)
def membership_diff(t: Tables) -> DataFrame:
    """Memberships that heavy reports would keep, add and remove, counted per base from one full outer join."""
    want = t.report.where("weight_grams >= 2500").join(t.location.select("location_id", "base_id"), "location_id").select("base_id", "fish_id").distinct().withColumn("w", F.lit(1))
    have = t.member.select("base_id", "fish_id").withColumn("h", F.lit(1))
    return want.join(have, ["base_id", "fish_id"], "full_outer").groupBy("base_id").agg(F.count_if(F.expr("w is not null and h is not null")).alias("kept"), F.count_if(F.expr("h is null")).alias("added"), F.count_if(F.expr("w is null")).alias("removed"))


@query(
    "base_notebook",
    """
SELECT base_id, m.fish_id, f.name, is_rarest, max_weight_grams, row_number() OVER (PARTITION BY base_id ORDER BY max_weight_grams DESC NULLS LAST, name_normalized, m.fish_id) AS n
FROM {member} m JOIN {fish} f ON f.fish_id = m.fish_id WHERE f.is_active AND (f.name_normalized LIKE '%a%')
""",
)
def base_notebook(t: Tables) -> DataFrame:
    """A base's active fish whose names hold the search text, heaviest bound first, unknown bounds last."""
    rows = t.member.join(t.fish.where("is_active").where(F.contains("name_normalized", F.lit("a"))), "fish_id")
    n = F.row_number().over(Window.partitionBy("base_id").orderBy(F.desc_nulls_last("max_weight_grams"), "name_normalized", "fish_id"))
    return rows.select("base_id", "fish_id", "name", "is_rarest", "max_weight_grams", n.alias("n"))


@query(
    "base_peers",
    """
SELECT a.base_id, a.fish_id, count(*) AS peers, min(b.base_id) AS first_peer FROM {member} a JOIN {member} b
ON b.fish_id = a.fish_id AND b.base_id <> a.base_id AND b.max_weight_grams * 100 BETWEEN a.max_weight_grams * 95 AND a.max_weight_grams * 105 GROUP BY ALL
""",
)
def base_peers(t: Tables) -> DataFrame:
    """Other bases of the same fish whose maximum lies within five per cent."""
    a = t.member.select("fish_id", "base_id", "max_weight_grams")
    b = a.select("fish_id", F.col("base_id").alias("other"), F.col("max_weight_grams").alias("theirs"))
    near = a.join(b, "fish_id").where((F.col("other") != F.col("base_id")) & (F.col("theirs") * 100).between(F.col("max_weight_grams") * 95, F.col("max_weight_grams") * 105))
    return near.groupBy("base_id", "fish_id").agg(F.count("*").alias("peers"), F.min("other").alias("first_peer"))


@query(
    "community_counts",
    """
WITH k AS (SELECT unnest(['signup', 'purchase', 'click', 'error', 'view', 'refund', 'share']) AS mark)
SELECT k.mark, coalesce(n, 0) AS votes, coalesce(u, 0) AS voters FROM k LEFT JOIN (SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS u FROM events GROUP BY ALL) e ON e.event_type = k.mark
""",
)
def community_counts(t: Tables) -> DataFrame:
    """All seven marks with their counts, zero where nobody voted."""
    marks = t.spark.createDataFrame([(m,) for m in ("signup", "purchase", "click", "error", "view", "refund", "share")], "mark string")
    votes = t.raw("events").groupBy(F.col("event_type").alias("mark")).agg(F.count("*").alias("votes"), F.countDistinct("user_id").alias("voters"))
    return marks.join(votes, "mark", "left").na.fill(0, ["votes", "voters"])


@query("location_ids_text", "SELECT base_id, string_agg(CAST(location_id AS VARCHAR), ', ' ORDER BY location_id) AS ids FROM {location} GROUP BY base_id")
def location_ids_text(t: Tables) -> DataFrame:
    """The location ids of each base, in order, as one text."""
    return t.location.groupBy("base_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("location_id")), lambda x: x.cast("string")), ", ").alias("ids"))
