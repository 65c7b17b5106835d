"""Weight statistics: weekly weights, clusters, ratios, histograms, quantiles, grids."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.classify import half_up, week_start
from ..plans.registry import query
from ..plans.tables import Tables
from .records import WEEK_SQL


@query(
    "pair_weekly_weights",
    f"SELECT fish_id, base_id, {WEEK_SQL} AS week, max(weight_grams) AS highest, count(DISTINCT weight_grams) AS n, string_agg(DISTINCT CAST(weight_grams AS VARCHAR), ',' ORDER BY CAST(weight_grams AS VARCHAR)) AS weights FROM {{snapshot}} WHERE base_id IS NOT NULL GROUP BY ALL",
)
def pair_weekly_weights(t: Tables) -> DataFrame:
    """Distinct weights of each pair and week."""
    rows = t.snapshot.where("base_id is not null").groupBy("fish_id", "base_id", week_start(F.col("caught_at")).alias("week"))
    return rows.agg(F.max("weight_grams").alias("highest"), F.countDistinct("weight_grams").alias("n"), F.array_join(F.array_sort(F.collect_set(F.col("weight_grams").cast("string"))), ",").alias("weights"))


@query(
    "weight_clusters",
    f"""
WITH w AS (SELECT DISTINCT fish_id, weight_grams AS g, {WEEK_SQL} AS week FROM {{snapshot}}), u AS (SELECT DISTINCT fish_id, g FROM w)
SELECT u.fish_id, u.g AS upper, count(DISTINCT w.g) AS members, count(DISTINCT w.week) AS weeks FROM u JOIN w ON w.fish_id = u.fish_id AND w.g <= u.g AND w.g * 101 >= u.g * 100 GROUP BY ALL HAVING count(DISTINCT w.week) >= 2
""",
)
def weight_clusters(t: Tables) -> DataFrame:
    """For each weight of a fish, the weights up to one per cent below and the weeks they were seen in."""
    seen = t.snapshot.select("fish_id", F.col("weight_grams").cast("long").alias("g"), week_start(F.col("caught_at")).alias("week")).distinct()
    out = swept(seen, ["fish_id"], F.expr("g * 101 div 100"))
    return out.select("fish_id", F.col("upper").cast("int").alias("upper"), "members", "weeks")


def swept(seen: DataFrame, keys: list[str], reach: Column) -> DataFrame:
    """Rows (keys, upper, members, weeks) of the distinct weights g of a key's weeks: for each weight as the upper end, the
    weights that reach it and the weeks that hold one of them, at least two.

    A sweep, linear in the distinct weights of a week: a weight counts for the
    uppers from itself to its reach, for its week only as far as the week's next
    weight, so that no week counts twice.  Both are steps up and down, and their
    running sums at an upper are its members and weeks.
    """
    following = F.lead("g").over(Window.partitionBy(*keys, "week").orderBy("g"))
    # of a weight's weeks the first counts it as a member
    new = F.when(F.row_number().over(Window.partitionBy(*keys, "g").orderBy("week")) == 1, 1).otherwise(0)
    held = seen.withColumns({"beyond": (reach + 1).cast("long"), "following": following, "new": new})
    step = lambda at, members, weeks, upper: F.struct(at.alias("at"), members.alias("members"), F.lit(weeks).alias("weeks"), F.lit(upper).alias("upper"))
    beyond, none = F.col("beyond"), F.lit(0)
    moves = held.select(*keys, F.inline(F.array(step(F.col("g"), F.col("new"), 1, True), step(F.least("beyond", F.coalesce("following", "beyond")), none, -1, False), step(beyond, -F.col("new"), 0, False))))
    moves = moves.groupBy(*keys, "at").agg(F.sum("members").alias("members"), F.sum("weeks").alias("weeks"), F.max("upper").alias("upper"))
    until = Window.partitionBy(*keys).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    out = moves.select(*keys, "at", "upper", F.sum("members").over(until).alias("members"), F.sum("weeks").over(until).alias("weeks")).where("upper and weeks >= 2")
    return out.select(*keys, F.col("at").alias("upper"), "members", "weeks")


@query(
    "ratio_histogram",
    """
WITH r AS (SELECT CAST(weight_grams AS DOUBLE) / max_weight_grams AS ratio, r.fish_id, l.base_id FROM {report} r JOIN {location} l ON l.location_id = r.location_id JOIN {member} m ON m.base_id = l.base_id AND m.fish_id = r.fish_id WHERE max_weight_grams IS NOT NULL)
SELECT CAST(floor(ratio / 0.005 + 0.5) AS BIGINT) AS bin, count(*) AS n, count(DISTINCT fish_id) AS fish, count(DISTINCT base_id) AS bases FROM r GROUP BY 1
""",
)
def ratio_histogram(t: Tables) -> DataFrame:
    """Reports by ratio of weight to maximum, in bins of half a per cent."""
    return ratios(t).groupBy(half_up(F.col("ratio") / 0.005).alias("bin")).agg(F.count("*").alias("n"), F.countDistinct("fish_id").alias("fish"), F.countDistinct("base_id").alias("bases"))


def ratios(t: Tables) -> DataFrame:
    rows = t.report.select("location_id", "fish_id", "weight_grams").join(t.location.select("location_id", "base_id"), "location_id").join(t.member.where("max_weight_grams is not null"), ["base_id", "fish_id"])
    return rows.select("fish_id", "base_id", (F.col("weight_grams").cast("double") / F.col("max_weight_grams")).alias("ratio"))


@query(
    "dense_regimes",
    """
WITH r AS (SELECT CAST(floor(CAST(weight_grams AS DOUBLE) / max_weight_grams / 0.005 + 0.5) AS BIGINT) AS bin FROM {report} r JOIN {location} l ON l.location_id = r.location_id JOIN {member} m ON m.base_id = l.base_id AND m.fish_id = r.fish_id WHERE max_weight_grams IS NOT NULL),
h AS (SELECT bin, count(*) AS n FROM r GROUP BY bin), d AS (SELECT *, bin - row_number() OVER (ORDER BY bin) AS island FROM h WHERE n * 250 >= (SELECT sum(n) FROM h))
SELECT min(bin) AS first_bin, max(bin) AS last_bin, CAST(sum(n) AS BIGINT) AS n FROM d GROUP BY island
""",
)
def dense_regimes(t: Tables) -> DataFrame:
    """Runs of neighbouring dense bins merged into one regime (islands over the histogram's few rows)."""
    bins = ratio_histogram(t).select("bin", "n")
    total = F.sum("n").over(Window.partitionBy())
    dense = bins.withColumn("total", total).where("n * 250 >= total").withColumn("island", F.col("bin") - F.row_number().over(Window.orderBy("bin")))
    return dense.groupBy("island").agg(F.min("bin").alias("first_bin"), F.max("bin").alias("last_bin"), F.sum("n").alias("n")).drop("island")


@query(
    "weight_quantiles",
    """
WITH s AS (SELECT fish_id, list_sort(list(weight_grams)) AS a, count(*) AS n FROM {report} GROUP BY fish_id)
SELECT fish_id, n, a[1] AS least, a[CAST(floor((n - 1) * 0.5) AS INT) + 1] AS p50, a[CAST(floor((n - 1) * 0.9) AS INT) + 1] AS p90, a[CAST(floor(n * 0.5) AS INT) + 1] AS upper_median, a[CAST(floor(n * 0.05) AS INT) + 1] AS p05,
  (a[CAST(floor((n - 1) / 2.0) AS INT) + 1] + a[CAST(floor(n / 2.0) AS INT) + 1]) / 2.0 AS median, a[n] AS most FROM s
""",
)
def weight_quantiles(t: Tables) -> DataFrame:
    """Three kinds of quantile by rank: floor((n - 1) f), floor(n f), and the mean of the middle two.

    Reports fold to counts of their distinct weights before they are ordered.
    """
    place = Window.partitionBy("fish_id")
    counts = t.report.where("weight_grams is not null").groupBy("fish_id", "weight_grams").agg(F.count("*").alias("c"))
    rows = counts.withColumn("upto", F.sum("c").over(place.orderBy("weight_grams").rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("c").over(place))
    at = lambda k: F.max(F.when((F.col("upto") - F.col("c") <= k) & (k < F.col("upto")), F.col("weight_grams")))
    low, high = at(F.floor((F.col("n") - 1) / 2)), at(F.floor(F.col("n") / 2))
    return rows.groupBy("fish_id", "n").agg(
        F.min("weight_grams").alias("least"), at(F.floor((F.col("n") - 1) * 0.5)).alias("p50"), at(F.floor((F.col("n") - 1) * 0.9)).alias("p90"), at(F.floor(F.col("n") * 0.5)).alias("upper_median"),
        at(F.floor(F.col("n") * 0.05)).alias("p05"), ((low + high) / 2.0).alias("median"), F.max("weight_grams").alias("most"),
    )


STEPS = (5, 10, 25, 50, 100, 250, 500, 1000)


@query("divisibility_counts", f"WITH s AS (SELECT unnest({list(STEPS)}) AS step) SELECT step, count(*) FILTER (WHERE max_weight_grams % step = 0) AS divisible, count(*) AS maxima FROM {{member}}, s WHERE max_weight_grams IS NOT NULL GROUP BY step")
def divisibility_counts(t: Tables) -> DataFrame:
    """How many maxima each round step divides, in one pass over the maxima."""
    counts = [F.struct(F.lit(s).alias("step"), F.count_if(F.col("max_weight_grams") % s == 0).alias("divisible"), F.count("*").alias("maxima")) for s in STEPS]
    return t.member.where("max_weight_grams is not null").agg(F.array(*counts).alias("a")).select(F.inline("a"))


@query(
    "grid_steps",
    """
WITH d AS (SELECT DISTINCT max_weight_grams AS g, length(CAST(max_weight_grams AS VARCHAR)) AS digits FROM {member} WHERE max_weight_grams > 0),
s AS (SELECT DISTINCT a.digits, gcd(a.g, b.g) AS step FROM d a JOIN d b ON a.digits = b.digits AND a.g < b.g WHERE gcd(a.g, b.g) > 1)
SELECT s.digits, CAST(s.step AS BIGINT) AS step, count(*) AS n, count(*) FILTER (WHERE d.g % s.step = 0) AS support FROM s JOIN d ON d.digits = s.digits GROUP BY ALL
""",
)
def grid_steps(t: Tables) -> DataFrame:
    """Steps that could make the grid of maxima of a magnitude: the divisors two maxima share, with their support.

    A magnitude's distinct maxima are few, as rounded weights of at most ten digits
    are, and meet in one pandas group, where every two of them are compared.
    """

    def steps(frame: pd.DataFrame) -> pd.DataFrame:
        values = sorted(set(frame["g"].tolist()))
        found: set[int] = set()
        for i, a in enumerate(values):
            found.update(math.gcd(a, b) for b in values[i + 1 :])
        found.discard(1)
        digits = int(frame["digits"].iloc[0])
        return pd.DataFrame([(digits, s, len(values), sum(v % s == 0 for v in values)) for s in sorted(found)], columns=["digits", "step", "n", "support"])

    maxima = t.member.where("max_weight_grams > 0").select(F.col("max_weight_grams").cast("long").alias("g")).distinct().withColumn("digits", F.length(F.col("g").cast("string")).cast("long"))
    return maxima.groupBy("digits").applyInPandas(steps, "digits bigint, step bigint, n bigint, support bigint")


@query(
    "neighbour_gaps",
    """
WITH d AS (SELECT DISTINCT fish_id, weight_grams AS g FROM {report})
SELECT fish_id, g, g - lag(g) OVER w AS below, lead(g) OVER w - g AS above, count(*) OVER (PARTITION BY fish_id ORDER BY g RANGE BETWEEN 100 PRECEDING AND CURRENT ROW) AS inside FROM d WINDOW w AS (PARTITION BY fish_id ORDER BY g)
""",
)
def neighbour_gaps(t: Tables) -> DataFrame:
    """Gaps to the next distinct weights of a fish, and how many lie within 100 g below."""
    w = Window.partitionBy("fish_id").orderBy("g")
    rows = t.report.select("fish_id", F.col("weight_grams").alias("g")).distinct()
    return rows.select("fish_id", "g", (F.col("g") - F.lag("g").over(w)).alias("below"), (F.lead("g").over(w) - F.col("g")).alias("above"), F.count("*").over(w.rangeBetween(-100, 0)).alias("inside"))
