"""Inferring weight bounds, generating counts and weights, parsing written lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.classify import decimal_text, half_up, week_start
from ..plans.registry import query
from ..plans.tables import Tables
from .records import WEEK_SQL

#: A boundary's score for the largest of these steps that divides it.
ROUNDNESS = ((100_000, 5.0), (10_000, 4.5), (1_000, 4.0), (500, 3.5), (100, 3.0), (50, 2.5), (10, 2.0), (5, 1.0))
#: Weight buckets as (draws below, from per cent, to per cent) of the range of weights.
BUCKETS = ((8, 10, 35), (43, 35, 60), (83, 60, 82), (97, 82, 95), (100, 95, 100))


def roundness(x: Column) -> Column:
    out = F.lit(0.0)
    for step, score in reversed(ROUNDNESS):
        out = F.when(x % step == 0, score).otherwise(out)
    return out


def natural_boundary(edge: Column, following: Column, most: Column) -> Column:
    """The first round multiple, coarse steps first, within 0.2 % (2 g at least) of a cluster's edge, else the edge."""
    magnitude = F.pow(F.lit(10.0), F.length(edge.cast("string")) - 1)
    room = F.greatest(F.lit(2.0), edge * 0.002)
    out = edge.cast("long")
    for part in (100, 20, 10, 2, 1):
        step = half_up(magnitude / part)
        near = half_up(edge / step) * step
        fits = (step >= 1) & (F.abs(near - edge) <= room) & (near > 0) & (near < most) & ((near <= edge) | (near < following))
        out = F.when(fits, near.cast("long")).otherwise(out)
    return out


def infer_boundaries(rows: DataFrame, keys: list[str], weight: str = "weight_grams", places: str = "location_id", baits: str = "bait_id", least_rows: int = 40) -> DataFrame:
    """For each group, the weight where a dense cluster ends and a sparse tail begins, with a confidence.

    Candidates are distinct weights with at least 75 % of the rows at or below and
    at most 12 % above; only those few are joined back to the group's weights
    to count their cluster and local gaps.
    """
    group = Window.partitionBy(*keys)
    up = group.orderBy("w")
    totals = rows.groupBy(*keys).agg(F.count("*").alias("rows"), F.countDistinct(places).alias("places"), F.countDistinct(baits).alias("baits"))
    values = rows.groupBy(*keys, F.col(weight).cast("long").alias("w")).agg(F.count("*").alias("c"))
    values = values.withColumn("through", F.sum("c").over(up.rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("c").over(group)).withColumn("most", F.max("w").over(group))
    values = values.withColumn("next", F.lead("w").over(up)).withColumn("i", F.row_number().over(up)).withColumn("kinds", F.count("*").over(group))
    tail = F.col("n") - F.col("through")
    edges = values.where((F.col("n") >= least_rows) & (F.col("kinds") >= 12) & (F.col("i") > 1) & F.col("next").isNotNull() & (F.col("through") >= 0.75 * F.col("n")) & (tail <= 0.12 * F.col("n")) & (tail >= 1) & (F.col("w") >= 1))
    edges = edges.withColumn("span", F.greatest(F.lit(5), half_up(F.col("w") * 0.01))).withColumn("edge", natural_boundary(F.col("w"), F.col("next"), F.col("most")))
    edges = edges.withColumn("edge_span", F.greatest(F.lit(5), half_up(F.col("edge") * 0.01)))
    own = values.select(*[F.col(k).alias(f"v_{k}") for k in keys], F.col("w").alias("v"), F.col("c").alias("vc"), F.col("next").alias("v_next"), F.col("i").alias("v_i"))
    near = edges.join(own, [edges[k].eqNullSafe(own[f"v_{k}"]) for k in keys]).where((F.col("v") >= F.least(F.col("w") - F.col("span"), F.col("edge") - F.col("edge_span"))) & ((F.col("v") <= F.col("w")) | (F.col("v") <= F.col("edge"))))
    gap = F.when((F.col("v_i") >= F.col("i") - 40) & (F.col("v_i") < F.col("i")) & (F.col("v") >= F.col("w") - F.col("span")), F.col("v_next") - F.col("v"))
    counted = near.groupBy(*keys, "w", "next", "most", "n", "through", "span", "edge").agg(
        F.sum(F.when((F.col("v") >= F.col("w") - F.col("span")) & (F.col("v") <= F.col("w")), F.col("vc")).otherwise(0)).alias("cluster"),
        F.sum(F.when((F.col("v") >= F.col("edge") - F.col("edge_span")) & (F.col("v") <= F.col("edge")), F.col("vc")).otherwise(0)).alias("near"),
        F.sum(F.when((F.col("v") > F.col("w")) & (F.col("v") <= F.col("edge")), F.col("vc")).when((F.col("v") > F.col("edge")) & (F.col("v") <= F.col("w")), -F.col("vc")).otherwise(0)).alias("moved"),
        F.coalesce(F.median(gap), F.lit(1.0)).alias("usual_gap"),
    )
    tail = F.col("n") - F.col("through")
    ratios = counted.where("cluster >= 8").select(
        *keys, "w", "edge", "n", "near", (tail - F.col("moved")).alias("above"), "cluster", tail.alias("tail"), (F.col("next") - F.col("w")).alias("gap"),
        ((F.col("next") - F.col("w")) / F.greatest(F.lit(1.0), "usual_gap")).alias("gap_ratio"),
        ((F.col("cluster") / F.col("span")) / (tail / F.greatest(F.lit(1), F.col("most") - F.col("w")))).alias("density_ratio"),
        (F.col("cluster") / tail).alias("cluster_ratio"),
    ).where((F.col("gap_ratio") >= 4) & (F.col("density_ratio") >= 4) & (F.col("cluster_ratio") >= 1.5) & (F.col("gap") >= 0.0005 * F.col("w")))
    score = F.log2("gap_ratio") * 2 + F.log2("density_ratio") + F.log2("cluster_ratio") + F.log2("cluster") * 0.75 + roundness(F.col("edge")) * 0.65 - F.col("tail") / F.col("n") * 10
    ranked = ratios.withColumn("score", score)
    best = Window.partitionBy(*keys).orderBy(F.desc("score"), F.desc(roundness(F.col("edge"))), "edge")
    ranked = ranked.withColumn("rank", F.row_number().over(best)).withColumn("margin", F.col("score") - F.lead("score").over(best)).where("rank = 1")
    found = totals.join(ranked.select(*[F.col(k).alias(f"r_{k}") for k in keys], "edge", "near", "above", "gap_ratio", "density_ratio", "cluster_ratio", "margin", "n"), [totals[k].eqNullSafe(F.col(f"r_{k}")) for k in keys], "left")
    share, margin = F.col("above") / F.col("n"), F.coalesce("margin", F.lit(float("inf")))
    high = (F.col("rows") >= 80) & (F.col("near") >= 20) & (F.col("above") >= 2) & (share <= 0.08) & (F.col("gap_ratio") >= 8) & (F.col("density_ratio") >= 8) & (F.col("cluster_ratio") >= 3) & (F.col("places") >= 2) & (F.col("baits") >= 3) & (margin >= 1.5)
    medium = (F.col("near") >= 10) & (F.col("above") >= 2) & (share <= 0.1) & (F.col("gap_ratio") >= 6) & (F.col("density_ratio") >= 5) & (F.col("places") >= 1) & (F.col("baits") >= 2) & (margin >= 0.5)
    return found.select(*keys, "rows", "places", "baits", F.col("edge").alias("boundary"), F.col("near").alias("near_rows"), F.col("above").alias("tail_rows"), F.when(high, "HIGH").when(medium, "MEDIUM").otherwise("LOW").alias("confidence"))


@query("inferred_boundaries")
def inferred_boundaries(t: Tables) -> DataFrame:
    """Boundaries of the weights of each base and method."""
    rows = t.report.select("location_id", "fishing_method", "bait_id", "weight_grams").join(t.location.select("location_id", "base_id"), "location_id")
    return infer_boundaries(rows, ["base_id", "fishing_method"])


@query(
    "generated_counts",
    """
WITH c AS (SELECT fish_id, count(*) * 97 AS i FROM {report} GROUP BY fish_id),
b AS (SELECT *, CASE WHEN i <= 10 THEN i WHEN i >= 55000 THEN 100 ELSE CAST(floor(10 + 90 * ln(i / 10.0) / ln(5500.0) + 0.5) AS BIGINT) END AS base, CAST(('0x' || substr(sha256(concat('count|', CAST(fish_id AS VARCHAR))), 1, 2)) AS INT) % 4 AS d FROM c)
SELECT fish_id, i, CASE WHEN i <= 10 THEN base ELSE greatest(10, least(100, base + CASE d WHEN 0 THEN -1 WHEN 3 THEN 1 ELSE 0 END)) END AS copies FROM b
""",
)
def generated_counts(t: Tables) -> DataFrame:
    """Observation numbers brought to 1..100 on a logarithmic scale, with a shift fixed by a hash."""
    counts = t.report.groupBy("fish_id").agg((F.count("*") * 97).alias("i"))
    return counts.select("fish_id", "i", copies(F.col("i"), F.col("fish_id").cast("string")).alias("copies"))


def copies(i: Column, name: Column) -> Column:
    """How many lines stand for i observations: 1 to 100 on a logarithmic scale, shifted by a hash of the name."""
    base = F.when(i <= 10, i).when(i >= 55000, 100).otherwise(F.floor(10 + 90 * F.ln(i / 10) / F.ln(F.lit(5500.0)) + 0.5))
    byte = F.conv(F.substring(F.sha2(F.concat(F.lit("count|"), name), 256), 1, 2), 16, 10).cast("int") % 4
    shifted = F.greatest(F.lit(10), F.least(F.lit(100), base + F.when(byte == 0, -1).when(byte == 3, 1).otherwise(0)))
    return F.when(i <= 10, base).otherwise(shifted).cast("long")


def drawn_weight(low: Column, high: Column, text: Column) -> Column:
    """A weight between the bounds fixed by a hash of text: 64 bits choose the bucket, 64 the place in it, all in exact integers."""
    digest = F.sha2(text, 256)
    big = lambda c: c.cast("decimal(38,0)")
    bucket = big(F.conv(F.substring(digest, 1, 16), 16, 10))
    place = big(F.conv(F.substring(digest, 17, 16), 16, 10))
    full = big(F.lit("18446744073709551615"))
    # floor(bucket * 100 / 2 ** 64) < below, without a division
    start, width = F.lit(None).cast("int"), F.lit(None).cast("int")
    for below, first, last in reversed(BUCKETS):
        chosen = bucket * 100 < big(F.lit(str(below * 2**64)))
        start = F.when(chosen, first).otherwise(start)
        width = F.when(chosen, last - first).otherwise(width)
    part = big(big(start) * full) + big(big(width) * place)
    offset = F.call_function("div", big(big(high - low) * big(part)), F.lit("1844674407370955161500").cast("decimal(38,0)"))
    return low + offset.cast("long")


@query(
    "drawn_weights",
    """
WITH h AS (SELECT base_id, fish_id, min_weight_grams AS lo, max_weight_grams AS hi, sha256(concat('weight|', CAST(base_id AS VARCHAR), '|', CAST(fish_id AS VARCHAR))) AS d FROM {member} WHERE min_weight_grams <= max_weight_grams),
u AS (SELECT *, CAST(CAST(('0x' || substr(d, 1, 16)) AS UBIGINT) AS HUGEINT) AS b, CAST(CAST(('0x' || substr(d, 17, 16)) AS UBIGINT) AS HUGEINT) AS p FROM h),
s AS (SELECT *, b * 100 // 18446744073709551616 AS slot FROM u),
w AS (SELECT *, CASE WHEN slot < 8 THEN 10 WHEN slot < 43 THEN 35 WHEN slot < 83 THEN 60 WHEN slot < 97 THEN 82 ELSE 95 END AS f, CASE WHEN slot < 8 THEN 35 WHEN slot < 43 THEN 60 WHEN slot < 83 THEN 82 WHEN slot < 97 THEN 95 ELSE 100 END AS e FROM s)
SELECT base_id, fish_id, CAST(lo + (CAST(hi - lo AS HUGEINT) * (f * CAST(18446744073709551615 AS HUGEINT) + (e - f) * p)) // 1844674407370955161500 AS BIGINT) AS grams FROM w
""",
)
def drawn_weights(t: Tables) -> DataFrame:
    """A weight for each membership with both bounds, the same on every run."""
    rows = t.member.where("min_weight_grams <= max_weight_grams")
    text = F.concat(F.lit("weight|"), F.col("base_id").cast("string"), F.lit("|"), F.col("fish_id").cast("string"))
    return rows.select("base_id", "fish_id", drawn_weight(F.col("min_weight_grams").cast("long"), F.col("max_weight_grams").cast("long"), text).alias("grams"))


@query(
    "source_caps",
    """
WITH s AS (SELECT l.base_id, r.fish_id, count(*) AS n, max(weight_grams) AS top FROM {report} r JOIN {location} l ON l.location_id = r.location_id GROUP BY ALL)
SELECT m.base_id, m.fish_id, CAST(CASE WHEN max_weight_grams * 2 <= top * 3 THEN max_weight_grams ELSE least(max_weight_grams, CAST(top AS BIGINT) * CASE WHEN n <= 2 THEN 200 WHEN n <= 5 THEN 175 WHEN n <= 20 THEN 150 WHEN n <= 100 THEN 135 ELSE 125 END // 100) END AS BIGINT) AS cap
FROM {member} m JOIN s ON s.base_id = m.base_id AND s.fish_id = m.fish_id WHERE max_weight_grams IS NOT NULL
""",
)
def source_caps(t: Tables) -> DataFrame:
    """A maximum far above what was seen gives way to the seen maximum with a margin that shrinks with evidence."""
    seen = t.report.join(t.location.select("location_id", "base_id"), "location_id").groupBy("base_id", "fish_id").agg(F.count("*").alias("n"), F.max("weight_grams").cast("long").alias("top"))
    rows = t.member.where("max_weight_grams is not null").join(seen, ["base_id", "fish_id"])
    n, high = F.col("n"), F.col("max_weight_grams").cast("long")
    margin = F.when(n <= 2, 200).when(n <= 5, 175).when(n <= 20, 150).when(n <= 100, 135).otherwise(125)
    cap = F.call_function("div", F.col("top") * margin, F.lit(100).cast("long"))
    return rows.select("base_id", "fish_id", F.when(high * 2 <= F.col("top") * 3, high).otherwise(F.least(high, cap)).alias("cap"))


@query(
    "control_pairs",
    f"""
WITH w AS (SELECT DISTINCT s.fish_id, s.base_id, {WEEK_SQL} AS week, s.weight_grams AS g, m.top FROM {{snapshot}} s JOIN (SELECT fish_id, base_id, max(weight_grams) AS top FROM {{snapshot}} GROUP BY ALL) m ON m.fish_id = s.fish_id AND m.base_id = s.base_id)
SELECT fish_id, base_id, max(weeks) AS weeks FROM (SELECT u.fish_id, u.base_id, u.g, count(DISTINCT w.week) AS weeks FROM (SELECT DISTINCT fish_id, base_id, g, top FROM w) u
  JOIN w ON w.fish_id = u.fish_id AND w.base_id = u.base_id AND w.g <= u.g AND w.g >= u.g / 1.01 WHERE u.g >= u.top * 0.98 GROUP BY ALL) GROUP BY ALL HAVING max(weeks) >= 2
""",
)
def control_pairs(t: Tables) -> DataFrame:
    """Pairs whose weights cluster within one per cent near their maximum in two weeks or more."""
    rows = t.snapshot.where("base_id is not null").select("fish_id", "base_id", week_start(F.col("caught_at")).alias("week"), F.col("weight_grams").alias("g")).distinct()
    top = F.max("g").over(Window.partitionBy("fish_id", "base_id"))
    held = rows.withColumn("top", top).where("g >= top * 0.98 / 1.0101")
    uppers = held.where("g >= top * 0.98").select("fish_id", "base_id", F.col("g").alias("u")).distinct()
    near = uppers.join(held, ["fish_id", "base_id"]).where((F.col("g") <= F.col("u")) & (F.col("g") >= F.col("u") / 1.01))
    weeks = near.groupBy("fish_id", "base_id", "u").agg(F.countDistinct("week").alias("weeks"))
    return weeks.groupBy("fish_id", "base_id").agg(F.max("weeks").alias("weeks")).where("weeks >= 2")


LINE = r"^(.*) ([0-9]+(?:,[0-9]{3})?) (кг|грамм)\. Поймана на ([^:]*): ([^,]*), (.*)\.$"


def weight_text(grams: Column) -> Column:
    kilos, rest = F.floor(grams / 1000).cast("string"), F.lpad((grams % 1000).cast("string"), 3, "0")
    return F.when(grams < 1000, F.concat(grams.cast("string"), F.lit(" грамм"))).otherwise(F.concat(kilos, F.lit(","), rest, F.lit(" кг")))


@query(
    "parsed_lines",
    """
SELECT r.report_id, r.fish_id, l.base_id, r.location_id, r.bait_id, CAST(weight_grams AS BIGINT) AS grams,
  CASE WHEN r.report_id % 11 = 0 THEN 'bait' WHEN r.report_id % 13 = 0 THEN 'location' ELSE '' END AS unresolved
FROM (SELECT report_id, fish_id, CASE WHEN report_id % 11 <> 0 AND report_id % 13 = 0 THEN NULL ELSE location_id END AS location_id, location_id AS place, CASE WHEN report_id % 11 = 0 THEN NULL ELSE bait_id END AS bait_id, weight_grams FROM {report}) r
JOIN {location} l ON l.location_id = r.place
""",
)
def parsed_lines(t: Tables) -> DataFrame:
    """Reports written as lines, some with unknown names, parsed back and resolved: locations only inside their base."""
    names = t.report.join(t.fish.select("fish_id", F.concat_ws("#", "name", "fish_id").alias("fish")), "fish_id").join(t.location.select("location_id", "base_id", F.col("name").alias("place")), "location_id")
    names = names.join(t.base.select("base_id", F.col("name").alias("base")), "base_id").join(t.bait.select("bait_id", F.col("name").alias("bait")), "bait_id")
    bait = F.when(F.col("report_id") % 11 == 0, "odd bait").otherwise(F.col("bait"))
    place = F.when((F.col("report_id") % 11 != 0) & (F.col("report_id") % 13 == 0), "odd place").otherwise(F.col("place"))
    lines = names.select("report_id", F.concat("fish", F.lit(" "), weight_text(F.col("weight_grams")), F.lit(". Поймана на "), "base", F.lit(": "), place, F.lit(", "), bait, F.lit(".")).alias("line"))
    return parse_lines(t, lines)


def parse_lines(t: Tables, lines: DataFrame) -> DataFrame:
    """Rows (report_id, line) to ids and grams; what does not resolve is null and named in ``unresolved``."""
    part = lambda i: F.regexp_extract("line", LINE, i)
    grams = F.when(part(3) == "кг", decimal_text(part(2), 3)).otherwise(part(2).cast("long"))
    parts = lines.select("report_id", part(1).alias("fish"), grams.alias("grams"), part(4).alias("base"), part(5).alias("place"), part(6).alias("bait"))
    fish = t.fish.select(F.concat_ws("#", "name", "fish_id").alias("fish"), "fish_id")
    rows = parts.join(fish, "fish", "left").join(t.base.select(F.col("name").alias("base"), "base_id"), "base", "left")
    rows = rows.join(t.location.select("base_id", F.col("name").alias("place"), "location_id"), ["base_id", "place"], "left").join(t.bait.select(F.col("name").alias("bait"), "bait_id"), "bait", "left")
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), n) for c, n in (("fish_id", "fish"), ("base_id", "base"), ("location_id", "location"), ("bait_id", "bait"), ("grams", "weight"))]))
    return rows.select("report_id", "fish_id", "base_id", "location_id", "bait_id", "grams", F.array_join(missing, ",").alias("unresolved"))
