"""Boundaries of weights moved to a nearby round value, if the weights on both sides of it say so.

The distinct weights of a group get running counts and numbers once.  Every
candidate then looks up its place among them as of its value, by one window over
weights and candidates together, which gives the mass on both sides and the next
weight above; the usual gap below it is the median of at most 40 gaps, met by
their numbers.  So a group costs its distinct weights and a few rows a
candidate, not their product.

Defined results: weights that are null or negative do not count; groups with no
previous boundary are not refined; a group that nothing confirms is UNKNOWN with
a reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.classify import half_up
from ..functions.texts import collapsed, composed
from ..plans.registry import query
from ..plans.tables import Tables
from ..session import checkpointed
from .inference import infer_boundaries

#: Divisors of round weights and their scores.
ROUND_SCORES = (
    (1_000_000, 8.0), (500_000, 7.5), (100_000, 7.0), (50_000, 6.5), (10_000, 6.0), (5_000, 5.5), (1_000, 5.0), (500, 4.5), (100, 4.0), (50, 3.5), (10, 3.0), (5, 2.0),
)
#: Rows, places and baits needed; rows below, share above, gap, density and cluster that confirm; gaps of the median.
LEAST_ROWS, LEAST_PLACES, LEAST_BAITS = 80, 2, 3
NEAR_ROWS, TAIL_SHARE, GAP_RATIO, DENSITY_RATIO, CLUSTER_RATIO, GAPS = 20, 0.08, 8, 8, 3, 40
#: Steps 1, 2, 2.5 and 5 times a power of ten, with the power.
STEPS = [(e, int(m * 10.0**e + 0.5)) for e in range(-1, 10) for m in (1, 2, 2.5, 5) if int(m * 10.0**e + 0.5) >= 1]


def round_score(x: Column) -> Column:
    """The score of the largest divisor in the list, 0 if none divides x."""
    out = F.lit(0.0)
    for divisor, score in reversed(ROUND_SCORES):
        out = F.when(x % divisor == 0, score).otherwise(out)
    return out


def nearby_rounds(previous: Column) -> Column:
    """The distinct round values within half a per cent (5 at least) of a boundary."""
    size = F.length(previous.cast("string")) - 1
    room = F.greatest(F.lit(5), half_up(previous * 0.005)).cast("long")
    steps = F.filter(F.array(*[F.struct(F.lit(e).alias("e"), F.lit(s).cast("long").alias("s")) for e, s in STEPS]), lambda s: s["e"] <= size)
    near = F.array_distinct(F.flatten(F.transform(steps, lambda s: F.array((F.floor(previous / s["s"]) * s["s"]).cast("long"), (F.ceil(previous / s["s"]) * s["s"]).cast("long")))))
    natural = lambda c: F.greatest(F.lit(5.0), 5 * F.pow(F.lit(10.0), F.length(c.cast("string")) - 4)).cast("long")
    return F.filter(near, lambda c: (c >= F.greatest(F.lit(1), previous - room)) & (c <= previous + room) & (c % natural(c) == 0) & (round_score(c) > 0))


def _label(name: str) -> Column:
    return F.nullif(F.lower(collapsed(composed(F.col(name)))), F.lit(""))


def _rounded(x: Column) -> Column:
    return F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(F.format_string("%.1f", x))


def refined(rows: DataFrame, previous: DataFrame, keys: list[str]) -> DataFrame:
    """Per row of previous (keys, previous, known_max) its refinement from rows (keys, g, place, bait)."""
    held = checkpointed(rows.where("g >= 0").join(previous.select(*keys), keys, "left_semi").select(*keys, F.col("g").cast("long").alias("g"), "place", "bait"))
    # spellings are few: each is composed once a group
    labels = held.select(*keys, F.inline(F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(kind).alias("name")) for kind in ("place", "bait")]))).distinct()
    diverse = labels.withColumn("label", _label("name")).groupBy(*keys).agg(F.countDistinct(F.when(F.col("kind") == "place", F.col("label"))).alias("places"), F.countDistinct(F.when(F.col("kind") == "bait", F.col("label"))).alias("baits"))
    up = Window.partitionBy(*keys).orderBy("g")
    weights = held.groupBy(*keys, "g").agg(F.count("*").alias("c"))
    weights = checkpointed(weights.withColumns({"through": F.sum("c").over(up.rowsBetween(Window.unboundedPreceding, 0)), "i": F.row_number().over(up), "gap": F.col("g") - F.lag("g").over(up), "next": F.lead("g").over(up)}))
    ends = weights.groupBy(*keys).agg(F.sum("c").alias("n"), F.max("g").alias("most"))
    facts = previous.join(ends, keys, "left").join(diverse, keys, "left").fillna(0, ["n", "places", "baits"])
    enough = (F.col("n") >= LEAST_ROWS) & (F.col("places") >= LEAST_PLACES) & (F.col("baits") >= LEAST_BAITS)
    tried = facts.where(enough).select(*keys, "previous", "n", "most", F.explode(nearby_rounds(F.col("previous").cast("long"))).alias("b")).where("b < most")
    window = F.greatest(F.lit(5), half_up(F.col("b") * 0.01)).cast("long")
    tried = tried.withColumn("window", window).withColumn("low", F.greatest(F.lit(0), F.col("b") - F.col("window")))
    # as of b: weights up to it; as of low: weights below it
    points = tried.select(*keys, "b", F.explode(F.array(F.struct(F.col("b").alias("at"), F.lit(True).alias("upper")), F.struct((F.col("low") - 1).alias("at"), F.lit(False).alias("upper")))).alias("p"))
    line = weights.select(*keys, F.col("g").alias("at"), F.lit(0).alias("kind"), "through", "i", "next", F.lit(None).cast("long").alias("b"), F.lit(None).cast("boolean").alias("upper"))
    asked = points.select(*keys, "p.at", F.lit(1).alias("kind"), *[F.lit(None).cast(t).alias(c) for c, t in (("through", "long"), ("i", "int"), ("next", "long"))], "b", "p.upper")
    so_far = Window.partitionBy(*keys).orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    found = line.union(asked).withColumns({c: F.last(c, ignorenulls=True).over(so_far) for c in ("through", "i", "next")}).where("kind = 1")
    sides = found.groupBy(*keys, "b").agg(
        *[F.max(F.when(F.col("upper"), F.col(c))).alias(c) for c in ("through", "i", "next")], F.coalesce(F.max(F.when(~F.col("upper"), F.col("through"))), F.lit(0)).alias("below"), F.coalesce(F.max(F.when(~F.col("upper"), F.col("i"))), F.lit(0)).alias("below_i")
    )
    seen = tried.join(sides, [*keys, "b"]).where("through is not null").withColumn("near", F.col("through") - F.col("below")).withColumn("above", F.col("n") - F.col("through"))
    density = (F.col("near") / F.col("window")) / (F.col("above") / F.greatest(F.lit(1), F.col("most") - F.col("b")))
    seen = seen.withColumn("density", density).where((F.col("above") >= 2) & (F.col("near") >= NEAR_ROWS) & (F.col("above") / F.col("n") <= TAIL_SHARE) & (F.col("density") >= DENSITY_RATIO) & (F.col("near") / F.col("above") >= CLUSTER_RATIO))
    seen = checkpointed(seen)
    # the last gaps inside the window, by their numbers
    first = F.greatest(F.col("below_i") + 2, F.col("i") - (GAPS - 1))
    asked_gaps = seen.where(first <= F.col("i")).select(*keys, "b", F.explode(F.sequence(first, F.col("i"))).alias("i"))
    usual = asked_gaps.join(weights.select(*keys, "i", "gap"), [*keys, "i"]).groupBy(*keys, "b").agg(F.median("gap").alias("usual"))
    judged = seen.join(usual, [*keys, "b"], "left").withColumn("jump", F.col("next") - F.col("b")).withColumn("gap_ratio", F.col("jump") / F.greatest(F.lit(1.0), F.coalesce("usual", F.lit(1.0)))).where(F.col("gap_ratio") >= GAP_RATIO)
    away = F.abs(F.col("b") - F.col("previous"))
    score = F.log2("gap_ratio") * 2 + F.log2("density") + F.log2(F.col("near") / F.col("above")) + F.log2("near") * 0.75 + round_score(F.col("b")) * 0.8 - away / F.col("previous") * 100
    order = F.struct((-score).alias("s"), (-round_score(F.col("b"))).alias("r"), away.alias("away"), "b", "near", "above", "jump", "gap_ratio", "density")
    best = judged.groupBy(*keys).agg(F.min(order).alias("best"))
    out = facts.join(best, keys, "left")
    told = F.concat(
        F.col("best.near").cast("string"), F.lit(" rows immediately below; "), F.col("best.above").cast("string"), F.lit(" above after a "), F.col("best.jump").cast("string"), F.lit(" g gap ("), _rounded(F.col("best.gap_ratio")),
        F.lit("x local spacing); density contrast "), _rounded(F.col("best.density")), F.lit("x across "), F.col("places").cast("string"), F.lit(" places and "), F.col("baits").cast("string"), F.lit(" baits"),
    )
    high = F.coalesce(F.col("best.b") < F.col("known_max"), F.lit(False))
    reason = F.when(F.col("n") < LEAST_ROWS, "FEW_ROWS").when(~enough, "FEW_PLACES_OR_BAITS").when(F.col("best").isNull(), "NO_DENSE_CLUSTER_BELOW_A_SPARSE_TAIL").when(~high, "KNOWN_MAX_NOT_OVERSTATED").otherwise(told)
    shown = lambda c: F.when(high, F.col(f"best.{c}"))
    return out.select(*keys, shown("b").alias("refined"), F.col("n").alias("rows"), shown("near").alias("near_rows"), shown("above").alias("tail_rows"), "places", "baits", F.when(high, "HIGH").otherwise("UNKNOWN").alias("confidence"), reason.alias("reason"))


@query("refined_boundaries")
def refined_boundaries(t: Tables) -> DataFrame:
    """Boundaries inferred for each fish, of weights drawn in at a ceiling with few beyond it, moved to round values."""
    place = t.location.select("location_id", "base_id", F.col("name").alias("place"))
    n, kept = F.col("report_id") % 97, F.col("report_id") % 41
    ceiling = F.lit(20_000) + F.col("fish_id") % 5 * 1_000
    # derived weights: most under the fish's ceiling, one in forty-one far above it
    g = F.when(kept == 0, ceiling + 900 + n * 40).when(kept < 20, ceiling - n % 24 * 8).otherwise((F.col("weight_grams") * 3) % (ceiling - 2_000) + 100)
    rows = t.report.select("report_id", "location_id", "bait_id", "weight_grams", (F.col("fish_id") % 50).alias("fish_id")).join(place, "location_id").join(t.bait.select("bait_id", F.col("name").alias("bait")), "bait_id")
    rows = checkpointed(rows.select("fish_id", g.cast("long").alias("g"), "place", "bait", "location_id", "bait_id"))
    found = checkpointed(infer_boundaries(rows.withColumnRenamed("g", "weight_grams"), ["fish_id"]).where("boundary is not null"))
    known = rows.groupBy("fish_id").agg(F.max("g").alias("known_max"))
    return refined(rows, found.select("fish_id", F.col("boundary").alias("previous")).join(known, "fish_id"), ["fish_id"])
