"""Whether catalog maxima agree with weekly records: calibrate, cluster, classify, veto by bands, rank.

Pairs of a fish and a base have weekly weights.  Narrow clusters of weights
that recur over weeks suggest a boundary; how far pairs whose records sit right
below their maximum stay under it is learned over all pairs and fed back as one
row.  Ratios of weights to maxima that recur across species form bands, some
anchored by control pairs, others found by windows chosen greedily so that no
pair supports two; a boundary that lies in a band is not trusted.

Observations are (fish_id, base_id, week, g), pairs (fish_id, base_id,
fish_name, base_name, max_grams).  Repeated observations count once a week.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.classify import half_up, week_start
from ..functions.paging import numbered
from ..plans.registry import query
from ..plans.tables import Tables
from ..session import checkpointed
from .records import WEEK_SQL
from .weights import swept

#: Cluster width, share of the maximum that is near it, calibrators needed, bin and window width, band tolerance.
WIDTH, NEAR, CALIBRATORS, BIN, WINDOW = 1.01, 0.98, 20, 0.005, 0.01
TOLERANCE = BIN / 2
#: Control fish and bases that fill a bin.
BIN_FISH, BIN_BASES = 5, 3

PAIR = ["fish_id", "base_id"]


def weekly(observations: DataFrame) -> DataFrame:
    """The distinct weights of each pair's weeks; rows without a base or a weight go."""
    return observations.where("base_id is not null and g is not null").select(*PAIR, "week", F.col("g").cast("long").alias("g")).distinct()


def clusters(seen: DataFrame) -> DataFrame:
    """Rows (pair, upper, members, weeks): weights within the width below an upper one, seen in two weeks or more."""
    g, floor = F.col("g"), F.floor(F.col("g") * WIDTH)
    # the largest upper whose hundredth below still holds g, in the doubles of the rule
    reach = F.when((floor + 1) / WIDTH <= g, floor + 1).when(floor / WIDTH <= g, floor).otherwise(floor - 1)
    # dealt once by what the sweep's windows and sums have in common
    return swept(seen.repartition(*PAIR), PAIR, reach)


def calibrators(seen: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs of three or more weeks whose records lie close together right below their maximum: (pair, max_grams, ratio)."""
    highs = seen.groupBy(*PAIR, "week").agg(F.max("g").alias("high")).groupBy(*PAIR).agg(F.count("*").alias("weeks"), F.min("high").alias("low"), F.max("high").alias("high"))
    tight = (F.col("weeks") >= 3) & (F.col("low") >= F.col("max_grams") * NEAR) & (F.col("high") <= F.col("max_grams")) & (F.col("high") / F.col("low") <= WIDTH)
    return highs.join(pairs.where("max_grams is not null"), PAIR).where(tight).select(*PAIR, "max_grams", (F.col("high") / F.col("max_grams")).alias("ratio"))


def magnitude(weight: Column) -> Column:
    """floor(log10) of a whole positive weight."""
    return F.length(weight.cast("long").cast("string")) - 1


def catalog_step(size: Column) -> Column:
    """11 * 10 ** max(0, magnitude - 2)."""
    return (F.lit(11) * F.pow(F.lit(10), F.greatest(F.lit(0), size - 2))).cast("long")


def grids(pairs: DataFrame) -> DataFrame:
    """Per magnitude of the catalog's maxima their number and the share on that magnitude's grid: a row a digit."""
    held = pairs.where("max_grams is not null").withColumn("size", magnitude(F.col("max_grams")))
    return held.groupBy("size").agg(F.count("*").alias("comparable"), (F.count_if(F.col("max_grams") % catalog_step(F.col("size")) == 0) / F.count("*")).alias("support"))


def provisional(seen: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row a pair that has weights: its cluster, range, grid candidate, and verdict before bands are known."""
    facts = calibrators(seen, pairs).agg(F.count("*").alias("n"), F.min("ratio").alias("least"))
    facts = facts.select("n", F.when(F.col("n") >= CALIBRATORS, F.col("least")).otherwise(F.lit(NEAR)).alias("floor"))
    maxima = pairs.select(*PAIR, "fish_name", "base_name", F.col("max_grams").cast("long").alias("current"))
    near = F.coalesce((F.col("upper") >= F.col("current") * NEAR) & (F.col("upper") <= F.col("current")), F.lit(False))
    best = clusters(seen).join(maxima.select(*PAIR, "current"), PAIR, "left").groupBy(*PAIR).agg(F.max(F.struct(near.alias("near"), "weeks", "upper", "members")).alias("c"))
    rows = seen.groupBy(*PAIR).agg(F.countDistinct("week").alias("n_weeks")).join(maxima, PAIR, "left").join(best, PAIR, "left")
    rows = rows.withColumn("calibrators", facts.select("n").scalar()).withColumn("floor", facts.select("floor").scalar()).withColumn("size", magnitude(F.col("c.upper")))
    rows = rows.join(grids(pairs), "size", "left").fillna({"comparable": 0, "support": 0.0})
    low, step, current, weeks = F.col("c.upper"), catalog_step(F.col("size")), F.col("current"), F.col("c.weeks")
    high, grid = F.ceil(low / F.col("floor")), (F.ceil(low / step) * step).cast("long")
    unique = (grid <= high) & (grid + step > high) & (F.col("comparable") >= 20) & (F.col("support") >= 0.75)
    kind = F.when(low.isNull() | current.isNull(), "NONE").when(F.col("c.near"), "NEAR").when(low > current, "ABOVE").when((high < current * 0.95) & (weeks >= 3), "BELOW").otherwise("WEAK")
    strong = F.when((F.col("calibrators") >= CALIBRATORS) & (weeks >= 3) & (F.col("c.members") >= 3), "HIGH").otherwise("MEDIUM")
    rows = rows.withColumns({"low": low, "high": high, "grid": F.when(unique, grid), "kind": kind, "strong": strong})
    confidence = F.when(F.col("kind").isin("NONE", "WEAK"), "LOW").when(F.col("kind") == "BELOW", "MEDIUM").when((F.col("kind") == "ABOVE") & (F.col("low") / current > 1.25), "MEDIUM").otherwise(F.col("strong"))
    classification = F.when(F.col("kind") == "NEAR", "OK").when(F.col("kind") == "ABOVE", "MAX_TOO_LOW").when(F.col("kind") == "BELOW", "MAX_TOO_HIGH").otherwise("REVIEW")
    why = (
        F.when(F.col("low").isNull(), "INSUFFICIENT_INDEPENDENT_WEEKS_OR_NO_STABLE_1_PERCENT_CLUSTER").when(F.col("kind") == "NONE", "MISSING_CURRENT_MAX_OR_MEMBERSHIP")
        .when(F.col("kind") == "NEAR", "REPEATED_NORMAL_CLUSTER_NEAR_CURRENT_MAX;HIGHER_VALUES_ARE_MUTANT_AMBIGUOUS").when(F.col("kind") == "ABOVE", "PROVISIONAL_REPEATED_BOUNDARY_ABOVE_CURRENT")
        .when(F.col("kind") == "BELOW", "THREE_WEEK_STABLE_BOUNDARY_BELOW_CURRENT;LOW_EFFORT_REMAINS_POSSIBLE").otherwise("INSUFFICIENT_LOWER_BOUNDARY_SUPPORT")
    )
    told = F.format_string(";clusterWeeks=%d;distinctWeights=%d;gridStep=%d;gridSupport=%.4f;calibrators=%d", weeks, F.col("c.members"), step, F.col("support"), F.col("calibrators"))
    rows = rows.withColumns({"confidence": confidence, "classification": classification, "reason": F.concat(why, F.when(F.col("low").isNotNull(), told).otherwise(""))})
    proposed = F.when((F.col("confidence") == "HIGH") & (F.col("classification") == "MAX_TOO_LOW"), F.col("grid"))
    ranged = F.col("low").isNotNull() & (F.col("kind") != "NEAR")
    return rows.select(
        *PAIR, F.coalesce("fish_name", F.col("fish_id").cast("string")).alias("fish_name"), F.coalesce("base_name", F.col("base_id").cast("string")).alias("base_name"), "current", "n_weeks",
        F.coalesce("c.near", F.lit(False)).alias("near"), F.col("low").alias("cluster_upper"), F.coalesce(weeks, F.lit(0)).alias("cluster_weeks"), F.coalesce("c.members", F.lit(0)).alias("cluster_weights"),
        proposed.alias("proposed"), F.when(ranged, F.col("low")).alias("range_low"), F.when(ranged, F.col("high")).alias("range_high"), F.col("grid").alias("grid_candidate"), "confidence", "classification", "reason",
    )


def samples(seen: DataFrame, rows: DataFrame) -> DataFrame:
    """Each weight of a week as a ratio to the pair's maximum: (pair, week, g, current, control, ratio, bin)."""
    held = seen.join(rows.where("current is not null").select(*PAIR, "current", F.col("near").alias("control")), PAIR)
    return held.withColumn("ratio", F.col("g") / F.col("current")).withColumn("bin", half_up(F.col("ratio") / BIN))


def band_counts(rows: DataFrame, *keys: str) -> DataFrame:
    """Weights, pairs, fish, bases, weeks of pairs, recurring pairs of each key, and all six again of control pairs."""
    pairs = rows.groupBy(*keys, *PAIR, "control").agg(F.count("*").alias("n"), F.countDistinct("week").alias("w"))
    of = lambda kept, prefix: [
        F.sum(F.when(kept, F.col("n")).otherwise(0)).alias(f"{prefix}weekly_weights"), F.count_if(kept).alias(f"{prefix}pairs"), F.countDistinct(F.when(kept, F.col("fish_id"))).alias(f"{prefix}fish"),
        F.countDistinct(F.when(kept, F.col("base_id"))).alias(f"{prefix}bases"), F.sum(F.when(kept, F.col("w")).otherwise(0)).alias(f"{prefix}pair_weeks"), F.count_if(kept & (F.col("w") >= 2)).alias(f"{prefix}repeated_pairs"),
    ]
    return pairs.groupBy(*keys).agg(*of(F.lit(True), ""), *of(F.col("control"), "control_"))


def control_bands(ratios: DataFrame) -> DataFrame:
    """Runs of neighbouring bins above the maximum that control pairs of many fish and bases fill: (band, lower, upper)."""
    dense = ratios.where("control and ratio > 1").groupBy("bin").agg(F.countDistinct("fish_id").alias("f"), F.countDistinct("base_id").alias("b")).where((F.col("f") >= BIN_FISH) & (F.col("b") >= BIN_BASES))
    # a row a bin of half a per cent: the histogram's few rows
    runs = dense.withColumn("island", F.col("bin") - F.row_number().over(Window.orderBy("bin"))).groupBy("island").agg(F.min("bin").alias("first"), F.max("bin").alias("last"))
    numbered = runs.withColumn("band", F.concat(F.lit("control-"), F.row_number().over(Window.orderBy("first")).cast("string")))
    return numbered.select("band", F.greatest(F.lit(1.0), (F.col("first") - 0.5) * BIN).alias("lower"), ((F.col("last") + 0.5) * BIN).alias("upper"))


def within(rows: DataFrame, bands: DataFrame, slack: float = 0.0, how: str = "inner") -> DataFrame:
    """rows (with ratio) joined to the bands that hold them, ends included: an equality of cells of one bin's width, then the exact test."""
    cells = bands.withColumns({"_lower": F.col("lower") - slack, "_upper": F.col("upper") + slack})
    cells = cells.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("_lower") / BIN) - 1, F.floor(F.col("_upper") / BIN) + 1)))
    return rows.join(cells, (F.floor(F.col("ratio") / BIN) == F.col("_cell")) & (F.col("ratio") >= F.col("_lower")) & (F.col("ratio") <= F.col("_upper")), how).drop("_cell", "_lower", "_upper")


#: Nodes (level, node) of a binary tree over numbers: those that make up first to last, two a level at most, and those above a number.
PIECES = """filter(flatten(transform(sequence(0, {0}), k -> array(
  IF(shiftright(first + shiftleft(1L, k) - 1, k) < shiftright(last + 1, k) AND shiftright(first + shiftleft(1L, k) - 1, k) % 2 = 1, named_struct('level', k, 'node', shiftright(first + shiftleft(1L, k) - 1, k)), NULL),
  IF(shiftright(first + shiftleft(1L, k) - 1, k) < shiftright(last + 1, k) AND shiftright(last + 1, k) % 2 = 1, named_struct('level', k, 'node', shiftright(last + 1, k) - 1), NULL)))), p -> p IS NOT NULL)"""
ABOVE = "transform(sequence(0, {0}), k -> named_struct('level', k, 'node', shiftright(at, k)))"


def over(points: DataFrame, ranges: DataFrame, levels: int, *totals: Column) -> DataFrame:
    """Rows (at, totals) of points (at) that ranges (first, last, ...) hold, totals over those ranges; of totals that can be totalled again."""
    parts = ranges.select("*", F.expr(f"inline({PIECES.format(levels)})")).groupBy("level", "node").agg(*totals)
    return points.select("at", F.expr(f"inline({ABOVE.format(levels)})")).join(parts, ["level", "node"]).groupBy("at").agg(*totals)


def earliest(ranges: DataFrame, points: DataFrame, levels: int) -> DataFrame:
    """Rows (first, last, turn) of the ranges that hold a point (at, turn), with the least turn inside."""
    parts = points.select("turn", F.expr(f"inline({ABOVE.format(levels)})")).groupBy("level", "node").agg(F.min("turn").alias("turn"))
    return ranges.select("first", "last", F.expr(f"inline({PIECES.format(levels)})")).join(parts, ["level", "node"]).groupBy("first", "last").agg(F.min("turn").alias("turn"))


def recurring_spans(envelope: DataFrame, starts: DataFrame) -> DataFrame:
    """Rows (pair, first, last, weeks, least, most): from which start (by number) to which a window above it holds the same weights of the pair, of two weeks or more.

    A ratio lies in the windows from the first start whose end reaches it to
    itself.  So a pair's windows change only where one of its ratios comes or
    goes, and its rows are as many as its ratios, not as the windows it lies in.
    """
    ends = starts.select("start", F.lit(0).alias("end")).union(starts.select(F.col("start") + WINDOW, F.lit(1)))
    places = numbered(ends, [F.col("start"), F.col("end")], "place").where("end = 0").select("start", "place")
    reach = starts.join(places, "start").select(F.col("start").alias("ratio"), (F.col("place") - F.col("n") + 1).alias("first"), (F.col("n") + 1).alias("stop"))
    held = envelope.select(*PAIR, "week", "ratio").join(reach, "ratio").repartition(*PAIR)
    # a week counts once: for a ratio as far as the week's next one
    following = F.lead("first").over(Window.partitionBy(*PAIR, "week").orderBy("ratio"))
    held = held.withColumn("until", F.least("stop", F.coalesce(following, F.col("stop"))))
    step = lambda at, weeks, comes, goes: F.struct(F.col(at).alias("at"), F.lit(weeks).alias("weeks"), comes.alias("comes"), goes.alias("goes"))
    ratio, none = F.col("ratio"), F.lit(None).cast("double")
    moves = held.select(*PAIR, F.inline(F.array(step("first", 1, ratio, none), step("until", -1, none, none), step("stop", 0, none, ratio))))
    moves = moves.groupBy(*PAIR, "at").agg(F.sum("weeks").alias("weeks"), F.max("comes").alias("comes"), F.min("goes").alias("goes"))
    place = Window.partitionBy(*PAIR)
    upto, after = place.orderBy("at").rowsBetween(Window.unboundedPreceding, 0), place.orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, -1)
    out = moves.select(*PAIR, F.col("at").alias("first"), (F.lead("at").over(place.orderBy("at")) - 1).alias("last"), F.sum("weeks").over(upto).alias("weeks"), F.min("goes").over(after).alias("least"), F.max("comes").over(upto).alias("most"))
    return out.where("weeks >= 2")


def recurring_windows(spans: DataFrame, starts: DataFrame, levels: int) -> DataFrame:
    """Rows (at, turn): the windows of two fish and two bases or more, and their place in order of pair weeks, narrowness and place.

    Only starts where a span begins or has ended: at another the window holds what
    the one before it holds, comes after it and is never taken.
    """
    totals = {"w": F.sum, "low": F.min, "top": F.max, "fish": F.min, "fish_to": F.max, "base": F.min, "base_to": F.max}
    ranges = spans.groupBy("first", "last").agg(
        F.sum("weeks").alias("w"), F.min("least").alias("low"), F.max("most").alias("top"), F.min("fish_id").alias("fish"), F.max("fish_id").alias("fish_to"), F.min("base_id").alias("base"), F.max("base_id").alias("base_to")
    )
    points = spans.select(F.explode(F.array(F.col("first"), F.col("last") + 1)).alias("at")).distinct()
    whole = over(points, ranges, levels, *[f(c).alias(c) for c, f in totals.items()]).where("fish < fish_to and base < base_to")
    whole = whole.join(starts, F.col("at") == F.col("n")).select("at", "w", (F.col("top") - F.col("low")).alias("width"), "low")
    return numbered(whole, [F.desc("w"), F.col("width"), F.col("low"), F.col("at")], "turn").select("at", "turn")


def disjoint_windows(spans: DataFrame, windows: DataFrame, levels: int) -> DataFrame:
    """Of windows in their order those that share no pair with one taken before: (turn, pair, least, most).

    In a round every window that comes first among all that share a pair with it
    is taken, and those that share one with it go: what taking one after another
    would leave, in as many rounds as chains of overlaps are long.
    """
    left, taken = checkpointed(windows), None
    while taken is None or left.limit(1).count():
        own = spans.join(earliest(spans.select("first", "last").distinct(), left, levels), ["first", "last"])
        own = checkpointed(own.withColumn("turn", F.min("turn").over(Window.partitionBy(*PAIR))))
        next_ = over(left, own.groupBy("first", "last").agg(F.min("turn").alias("next")), levels, F.min("next").alias("next"))
        won = checkpointed(left.join(next_, "at").where("turn = next").select("at", "turn"))
        mine = checkpointed(own.join(won, "turn"))
        gone = over(left, mine.select("first", "last").distinct(), levels, F.first(F.lit(1)).alias("gone"))
        left, spans = checkpointed(left.join(gone, "at", "left_anti")), own.join(won, "turn", "left_anti").drop("turn")
        found = mine.where("at between first and last").select("turn", *PAIR, "least", "most")
        taken = found if taken is None else taken.union(found)
    return taken


def bands(ratios: DataFrame) -> DataFrame:
    """All bands with their counts and median: (band, support, lower, upper, median, weekly_weights, ..., control_pairs)."""
    anchored = checkpointed(control_bands(ratios))
    inside = within(ratios, anchored).where("ratio > lower")
    middle = inside.where("control and ratio > 1").groupBy("band").agg(F.median("ratio").alias("median"))
    counted = band_counts(inside, "band").join(middle, "band").join(anchored, "band").withColumn("support", F.lit("CONTROL_SUPPORTED_REGIME"))
    envelope = checkpointed(within(ratios.where("ratio > 1"), anchored, how="left_anti"))
    starts = checkpointed(numbered(envelope.select(F.col("ratio").alias("start")).distinct(), [F.col("start")]))
    levels = starts.count().bit_length()
    spans = checkpointed(recurring_spans(envelope, starts))
    taken = checkpointed(disjoint_windows(spans.drop("weeks"), recurring_windows(spans, starts, levels), levels))
    ends = taken.groupBy("turn").agg(F.min("least").alias("lower"), F.max("most").alias("upper"))
    # a row a band: bands share no pair
    ends = ends.withColumn("band", F.concat(F.lit("cross-"), F.row_number().over(Window.orderBy("turn")).cast("string")))
    mine = taken.join(ends, "turn").select("band", *PAIR, "lower", "upper")
    weeks = envelope.join(mine, PAIR).where("ratio between lower and upper").groupBy("band", *PAIR, "week").agg(F.max("ratio").alias("ratio"))
    crossing = band_counts(within(envelope, ends.drop("turn")), "band").join(weeks.groupBy("band").agg(F.median("ratio").alias("median")), "band").join(ends.drop("turn"), "band")
    names = ["band", "support", "lower", "upper", "median", "weekly_weights", "pairs", "fish", "bases", "pair_weeks", "repeated_pairs", "control_pairs"]
    return counted.select(*names).union(crossing.withColumn("support", F.lit("UNANCHORED_POSSIBLE_MUTANT_BAND")).select(*names))


def analyzed(observations: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(candidates in order of review, bands, samples) of observations against pairs.

    Of an unanchored band other fish always take part, so two weeks in it are enough for a veto.
    """
    seen = checkpointed(weekly(observations))
    rows = checkpointed(provisional(seen, pairs))
    ratios = checkpointed(samples(seen, rows))
    found = checkpointed(bands(ratios))
    own = ratios.join(rows.select(*PAIR, "cluster_upper"), PAIR).where(F.col("g").between(F.ceil(F.col("cluster_upper") / WIDTH), F.col("cluster_upper")) & (F.col("g") > F.col("current")))
    hits = within(own, found.select("band", "support", "lower", "upper"), TOLERANCE).groupBy(*PAIR, "band", "support", "lower").agg(F.countDistinct("week").alias("w"))
    hits = hits.where((F.col("w") >= 2) | (F.col("support") == "CONTROL_SUPPORTED_REGIME"))
    matched = hits.groupBy(*PAIR).agg(F.transform(F.array_sort(F.collect_list(F.struct("lower", "band"))), lambda b: b["band"]).alias("bands"))
    joined = rows.join(matched, PAIR, "left").withColumn("bands", F.coalesce("bands", F.array().cast("array<string>")))
    veto = (F.size("bands") > 0) & F.col("classification").isin("MAX_TOO_LOW", "REVIEW")
    normal = ~veto & (F.col("classification") == "MAX_TOO_LOW") & F.col("grid_candidate").isNotNull()
    loose = ~veto & (F.col("classification") == "MAX_TOO_LOW") & F.col("grid_candidate").isNull()
    kept = lambda c, but: F.when(~but, F.col(c))
    out = joined.select(
        *PAIR, "fish_name", "base_name", "current", "n_weeks", "cluster_upper", "cluster_weeks", "cluster_weights", kept("proposed", veto | loose).alias("proposed"), kept("range_low", veto | loose).alias("range_low"),
        kept("range_high", veto | loose).alias("range_high"), kept("grid_candidate", veto).alias("grid_candidate"), F.when(veto, "POSSIBLE_MUTANT_CAP").when(normal, "NORMAL_CAP_MISMATCH").alias("assessment"),
        F.array_join("bands", ",").alias("bands"), F.when(veto, "MEDIUM").when(loose, "LOW").otherwise(F.col("confidence")).alias("confidence"), F.when(veto | loose, "REVIEW").otherwise(F.col("classification")).alias("classification"),
        F.when(veto, F.concat(F.lit("POSSIBLE_MUTANT_CAP;matchedBands="), F.array_join("bands", ","), F.lit(";"), "reason")).when(normal, F.concat(F.lit("NORMAL_CAP_MISMATCH;NO_RECURRING_CROSS_SPECIES_BAND;"), "reason"))
        .when(loose, F.concat(F.lit("NO_UNIQUE_SUPPORTED_NORMAL_CATALOG_BOUNDARY;"), "reason")).otherwise(F.col("reason")).alias("reason"),
    )
    certain = F.when(F.col("confidence") == "HIGH", 0).when(F.col("confidence") == "MEDIUM", 1).otherwise(2)
    order = [F.when(F.col("classification").startswith("MAX_TOO_"), 0).otherwise(1), certain, F.col("proposed").isNull(), F.desc("cluster_weeks"), F.desc("cluster_weights"), "fish_name", "base_name"]
    return out.orderBy(*order), found, ratios


def regimes(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Reports as weekly observations in which weights gather right below and five per cent above the pairs' maxima, and the pairs."""
    pairs = t.member.join(t.fish.select("fish_id", F.col("name").alias("fish_name")), "fish_id").join(t.base.select("base_id", F.col("name").alias("base_name")), "base_id")
    most, off = F.col("max_weight_grams"), F.col("fish_id") % 7
    pairs = pairs.select(*PAIR, "fish_name", "base_name", most.alias("true_max"), F.when(off == 0, F.expr("max_weight_grams * 4 div 5")).when(off == 1, F.expr("max_weight_grams * 3 div 2")).otherwise(most).alias("max_grams"))
    rows = t.report.select("report_id", "fish_id", "location_id", "created_at", "weight_grams").join(t.location.select("location_id", "base_id"), "location_id").join(pairs.select(*PAIR, "true_max"), PAIR)
    kind, jitter = F.col("report_id") % 10, F.col("report_id") % 7
    g = F.when(kind < 6, F.expr("true_max - true_max * (report_id % 7) div 1000")).when(kind < 8, F.expr("true_max * (1050 + report_id % 7) div 1000")).otherwise(F.col("weight_grams"))
    return rows.select(*PAIR, week_start(F.col("created_at")).alias("week"), F.when(F.col("true_max").isNull(), F.col("weight_grams")).otherwise(g).alias("g")), pairs.drop("true_max")


#: The same observations, pairs and samples as SQL.
REGIMES_SQL = f"""
q AS (SELECT m.fish_id, m.base_id, max_weight_grams AS top, CASE m.fish_id % 7 WHEN 0 THEN max_weight_grams * 4 // 5 WHEN 1 THEN max_weight_grams * 3 // 2 ELSE max_weight_grams END AS current FROM {{member}} m),
seen AS (SELECT DISTINCT q.fish_id, q.base_id, {WEEK_SQL.replace("caught_at", "created_at")} AS week, current,
  CASE WHEN top IS NULL OR report_id % 10 >= 8 THEN weight_grams WHEN report_id % 10 < 6 THEN top - top * (report_id % 7) // 1000 ELSE top * (1050 + report_id % 7) // 1000 END AS g
  FROM {{report}} r JOIN {{location}} l ON l.location_id = r.location_id JOIN q ON q.fish_id = r.fish_id AND q.base_id = l.base_id),
uppers AS (SELECT DISTINCT fish_id, base_id, current, g AS upper FROM seen),
c AS (SELECT u.fish_id, u.base_id, u.current, upper, count(DISTINCT week) AS weeks, count(DISTINCT g) AS members FROM uppers u JOIN seen s ON s.fish_id = u.fish_id AND s.base_id = u.base_id AND g <= upper AND g >= ceil(upper / CAST(1.01 AS DOUBLE)) GROUP BY ALL HAVING count(DISTINCT week) >= 2),
controls AS (SELECT DISTINCT fish_id, base_id FROM c WHERE upper >= current * CAST(0.98 AS DOUBLE) AND upper <= current),
samples AS (SELECT s.*, CAST(g AS DOUBLE) / current AS ratio, CAST(floor(CAST(g AS DOUBLE) / current / CAST(0.005 AS DOUBLE) + 0.5) AS BIGINT) AS bin, controls.fish_id IS NOT NULL AS control FROM seen s LEFT JOIN controls USING (fish_id, base_id) WHERE current IS NOT NULL)
"""


@query("official_max_candidates")
def official_max_candidates(t: Tables) -> DataFrame:
    """Every pair's verdict, suspected corrections first."""
    return analyzed(*regimes(t))[0]


@query("official_ratio_bands")
def official_ratio_bands(t: Tables) -> DataFrame:
    """The bands of ratios above the maximum and what supports them."""
    return analyzed(*regimes(t))[1]


@query(
    "official_ratio_histogram",
    f"""
WITH {REGIMES_SQL}, per AS (SELECT bin, fish_id, base_id, control, count(*) AS n, count(DISTINCT week) AS w FROM samples GROUP BY ALL)
SELECT bin, CAST(sum(n) AS BIGINT) AS weekly_weights, count(*) AS pairs, count(DISTINCT fish_id) AS fish, count(DISTINCT base_id) AS bases, CAST(sum(w) AS BIGINT) AS pair_weeks, count(*) FILTER (w >= 2) AS repeated_pairs,
  count(*) FILTER (control) AS control_pairs, CAST(coalesce(sum(n) FILTER (control), 0) AS BIGINT) AS control_weekly_weights, count(DISTINCT fish_id) FILTER (control) AS control_fish, count(DISTINCT base_id) FILTER (control) AS control_bases,
  CAST(coalesce(sum(w) FILTER (control), 0) AS BIGINT) AS control_pair_weeks, count(*) FILTER (control AND w >= 2) AS control_repeated_pairs FROM per GROUP BY bin
""",
)
def official_ratio_histogram(t: Tables) -> DataFrame:
    """Weekly weights by ratio to the maximum in bins of half a per cent, all pairs beside control pairs."""
    observations, pairs = regimes(t)
    seen = weekly(observations)
    return band_counts(samples(seen, provisional(seen, pairs)), "bin")


@query(
    "official_control_bands",
    f"""
WITH {REGIMES_SQL}, dense AS (SELECT bin FROM samples WHERE control AND ratio > 1 GROUP BY bin HAVING count(DISTINCT fish_id) >= 5 AND count(DISTINCT base_id) >= 3),
runs AS (SELECT min(bin) AS first, max(bin) AS last FROM (SELECT bin, bin - row_number() OVER (ORDER BY bin) AS island FROM dense) GROUP BY island)
SELECT 'control-' || row_number() OVER (ORDER BY first) AS band, greatest(1.0, (first - 0.5) * 0.005)::DOUBLE AS lower, ((last + 0.5) * 0.005)::DOUBLE AS upper FROM runs
""",
)
def official_control_bands(t: Tables) -> DataFrame:
    """The bands that control pairs anchor."""
    observations, pairs = regimes(t)
    seen = weekly(observations)
    return control_bands(samples(seen, provisional(seen, pairs)))
