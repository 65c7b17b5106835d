"""Whole report lines: fish and weight, base, then place and bait split by what the catalog knows, then the observation.

Names may hold the characters that part them.  So every comma of the rest is a
possible end of the place and every word end of what follows one of the bait;
they are looked up by equi-joins on their folded keys, and the longest known
one is taken.  One that several entries share is ambiguous; where none is known
the first comma, or the first full stop, parts the text and the name stays
unresolved.

A name can only be the prefix that holds as many marks (commas, or what may
stand behind a word) as the name does.  So rows meet the names once for each
number of marks that names hold and are not multiplied by their prefixes; a
small catalog comes to them.  What follows the place is read once a text.

Defined results: a line of another form has no parts; a null text gives nulls;
ids must be unique, since names of too many kinds meet all prefixes by id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.texts import FOLDED, INT_MAX, SPACE, collapsed, composed
from ..plans.registry import query
from ..plans.tables import Tables
from ..session import checkpointed, stored
from .inference import weight_text
from .observations import ANCHORS, parsed_observations, trimmed
from .reports import dealt

#: Form of a line up to the place, what no line holds as a rule, points and what else may stand behind a name, the longest name.
HEAD = r"(?s)^(.*) ([0-9]+(?:,[0-9]{3})?) (кг|грамм)\. Поймана на ([^:]*): (.*)\z"
PARTED = "\x1f"
_POINTS = r".,;:!?/\\()\[\]{}"
NAME_END = rf"[\s{_POINTS}]"
NAME_MAX = 128
#: Names that are broadcast; more are joined by a shuffle.
KNOWN = 500_000
#: Texts that a task reads at least, and texts that are broadcast once read.
TEXTS, NEAR_TEXTS = 1 << 12, 100_000
#: Numbers of marks that are looked up one by one; where names have more, all prefixes are tried in one join.
KINDS = 12


def _key(text: Column) -> Column:
    """The lookup key of a text that is composed already."""
    key = F.lower(collapsed(text))
    for letter, folded in zip(*FOLDED):
        key = F.replace(key, F.lit(letter), F.lit(folded))
    return key


def parts_of_line(line: Column) -> Column:
    """Fish, number, unit, base and rest of a line; null for a line of another form."""
    # one search writes all parts beside each other, unless the line holds what parts them
    held = F.when(F.instr(line, F.lit(PARTED)) == 0, F.split(F.regexp_replace(line, HEAD, PARTED.join(f"${i}" for i in range(1, 6))), PARTED)).when(line.rlike(HEAD), F.array(*[F.regexp_extract(line, HEAD, i) for i in range(1, 6)]))
    return F.when(F.size(held) == 5, held)


def near(names: DataFrame, n: int) -> DataFrame:
    """n names as a join's side: a small catalog comes to the rows, a larger one is hashed where they meet."""
    return F.broadcast(names) if n <= KNOWN else names.hint("shuffle_hash")


def longest_known(rows: DataFrame, ids: list[str], names: DataFrame, scope: list[str], found: str, marks: str, head: Callable[[int], Column], ends: Column) -> DataFrame:
    """rows plus (<found>_end, <found>_id, <found>_n, ...) of the longest prefix of ``rest`` that is a name: names are (scope, key, name_id, ...).

    head is the last prefix whose key may hold a number of marks, ends are all ends; ids tell rows apart where all are tried.
    """
    at, more = F.col, [c for c in names.columns if c not in (*scope, "key", "name_id")]
    # computed once: conditions on keys would else be tried on all rows that names are drawn from
    known = checkpointed(names.groupBy(*scope, "key").agg(F.count("*").alias("n"), *[F.min(c).alias(c) for c in ("name_id", *more)])).where("key <> ''").withColumn("marks", F.regexp_count("key", F.lit(marks)))
    kinds = sorted(((r["marks"], r["count"]) for r in known.groupBy("marks").count().collect()), reverse=True)
    name = F.struct("n", "name_id", *more)
    if 0 < len(kinds) <= KINDS:
        for k, n in kinds:
            one = near(known.where(at("marks") == k).select(*scope, at("key").alias("_key"), name.alias(f"_name{k}")), n)
            rows = rows.withColumns({f"_end{k}": F.length(head(k)), "_key": _key(head(k))}).join(one, [*scope, "_key"], "left").drop("_key")
        # more marks, longer prefix
        best = F.coalesce(*[F.when(at(f"_name{k}").isNotNull(), F.struct(at(f"_end{k}").alias("end"), at(f"_name{k}").alias("name"))) for k, _ in kinds])
        rows = rows.withColumn("_best", best).drop(*[f"_{c}{k}" for c in ("end", "name") for k, _ in kinds])
    else:
        tried = rows.where("rest is not null").select(*ids, *scope, "rest", F.explode(ends).alias("end"))
        tried = tried.select(*ids, *scope, "end", _key(F.substring(at("rest"), F.lit(1), at("end"))).alias("key"))
        rows = rows.join(tried.join(known, [*scope, "key"]).groupBy(*ids).agg(F.max(F.struct("end", name.alias("name"))).alias("_best")), ids, "left")
    sole = {c: F.when(at("_best.name.n") == 1, at(f"_best.name.{c}")) for c in ("name_id", *more)}
    return rows.withColumns({f"{found}_end": at("_best.end"), f"{found}_n": F.coalesce("_best.name.n", F.lit(0)), f"{found}_id": sole.pop("name_id"), **sole}).drop("_best")


def _placed(rows: DataFrame, places: DataFrame) -> DataFrame:
    """rows (id, base_id, rest, ...), composed and trimmed, plus (place_id, place_n, place_text); rest is what follows the place."""
    at = F.col
    commas = F.filter(F.sequence(F.lit(0), F.length("rest") - 1), lambda i: F.substring(at("rest"), i + 1, F.lit(1)) == ",")

    def head(k: int) -> Column:
        before = F.substring_index("rest", ",", k + 1)
        return F.when(F.length(before) < F.length("rest"), before)

    first = longest_known(rows, ["id"], places.select("base_id", _key(composed(at("name"))).alias("key"), "name_id"), ["base_id"], "place", ",", head, commas)
    comma = F.coalesce("place_end", F.nullif(F.instr("rest", F.lit(",")), F.lit(0)) - 1)
    return first.withColumn("_comma", comma).withColumns({
        "place_text": trimmed(F.when(at("_comma").isNotNull(), F.substring(at("rest"), F.lit(1), at("_comma"))).otherwise(at("rest"))),
        "rest": F.nullif(trimmed(F.when(at("_comma").isNotNull(), F.substring(at("rest"), at("_comma") + 2, F.length("rest")))), F.lit("")),
    }).drop("place_end", "_comma")


def _baited(rows: DataFrame, ids: list[str], baits: DataFrame) -> DataFrame:
    """rows (ids, rest, ...) with (bait_id, bait_n, bait_text, observation) and what else baits hold in place of rest; baits are (name_id, name, ...)."""
    at, space = F.col, SPACE.removesuffix("+")
    last = F.least(F.length("rest"), F.lit(NAME_MAX + 1))
    ends = F.filter(F.sequence(F.lit(1), last), lambda i: (i == F.length("rest")) | F.substring(at("rest"), i + 1, F.lit(1)).rlike(NAME_END))
    # as much of the rest as a name may take, and the character behind it
    start = F.substring(F.concat("rest", F.lit(" ")), 1, NAME_MAX + 2)
    letters = rf"[^{_POINTS}{space[1:-1]}]*+"
    head = lambda k: F.regexp_extract(start, rf"^{space}*+{letters}(?:(?:[{_POINTS}]|{space}++){letters}){{{k}}}{space}*(?={NAME_END})", 0)
    others = [c for c in baits.columns if c not in ("name_id", "name")]
    second = longest_known(rows, ids, baits.select(_key(composed(at("name"))).alias("key"), "name_id", *others), [], "bait", rf"[ {_POINTS}]", head, ends)
    stop = F.nullif(F.instr("rest", F.lit(".")), F.lit(0)) - 1
    text = F.when(at("bait_end").isNotNull(), F.substring(at("rest"), F.lit(1), at("bait_end"))).when(stop.isNotNull(), F.substring(at("rest"), F.lit(1), stop)).otherwise(at("rest"))
    tail = F.when(at("bait_end").isNotNull(), F.substring(at("rest"), at("bait_end") + 1, F.length("rest"))).when(stop.isNotNull(), F.substring(at("rest"), stop + 2, F.length("rest")))
    return second.withColumns({"bait_text": trimmed(text), "observation": F.nullif(trimmed(tail), F.lit(""))}).drop("rest", "bait_end")


def split_places(rows: DataFrame, places: DataFrame, baits: DataFrame) -> DataFrame:
    """rows (id, base_id, rest, ...) plus (place_id, place_n, place_text, bait_id, bait_n, bait_text, observation).

    places are (base_id, name_id, name), baits (name_id, name); n tells how many entries share the name, 0 that none is known.
    """
    return _baited(_placed(rows.withColumn("rest", trimmed(composed(F.col("rest")))), places), ["id"], baits)


def _kilos(number: Column) -> Column:
    """Grams of kilograms as HEAD reads them, up to ten digits and three behind a comma; null if they are too many."""
    digits = F.when(F.instr(number, F.lit(",")) > 0, F.replace(number, F.lit(","), F.lit(""))).otherwise(F.concat(number, F.lit("000")))
    value = F.when(F.length(digits) <= 13, digits).try_cast("long")
    return F.when(value <= INT_MAX, value)


def parse_reports(lines: DataFrame, fish: DataFrame, bases: DataFrame, places: DataFrame, baits: DataFrame, anchors: list[str], with_id: bool = True) -> DataFrame:
    """Lines (id, line) resolved whole: ids, grams, and what the observation says; fish, bases are (name_id, name), baits (name_id, name, type).

    Rows are stored with what follows their place; each text of that is read once and joined back.
    """
    at = F.col
    rows = lines.select("id", parts_of_line(at("line")).alias("_p")).select("id", *[F.nullif(F.get("_p", F.lit(i)), F.lit("")).alias(f"_p{i}") for i in range(5)])
    grams = F.when(at("_p2") == "кг", _kilos(at("_p1"))).otherwise(at("_p1").try_cast("long"))
    rows = rows.select("id", _key(composed(at("_p0"))).alias("fish_key"), grams.alias("grams"), _key(composed(at("_p3"))).alias("base_key"), trimmed(composed(at("_p4"))).alias("rest"))

    def named(names: DataFrame, what: str) -> DataFrame:
        return near(names.groupBy(_key(composed(at("name"))).alias(f"{what}_key")).agg(F.when(F.count("*") == 1, F.min("name_id")).alias(f"{what}_id")), names.count())

    rows = _placed(rows.join(named(bases, "base"), "base_key", "left").drop("base_key"), places).join(named(fish, "fish"), "fish_key", "left").drop("fish_key", *([] if with_id else ["id"]))
    held = stored(rows, "report-lines")
    texts = checkpointed(held.select("rest").distinct())
    n = texts.count()
    method = F.when(at("type") == "LURE", "SPINNING").when(at("type").isNotNull(), "BAIT_FISHING")
    read = parsed_observations(_baited(texts.repartition(-(-n // TEXTS) or 1, "rest").withColumn("_text", at("rest")), ["rest"], baits).withColumn("method", method), "observation", "method", anchors)
    read = held.join(F.broadcast(read) if n <= NEAR_TEXTS else read, held["rest"].eqNullSafe(read["_text"]), "left").drop("rest", "_text")
    state = lambda c: F.when(at(f"{c}_n") == 0, "missing").when(at(f"{c}_n") > 1, "ambiguous").otherwise("")
    return read.withColumns({"place_state": state("place"), "bait_state": state("bait")})


@query(
    "parsed_reports",
    """
WITH x AS (SELECT DISTINCT r.report_id, r.fish_id, l.base_id, r.location_id, r.bait_id, weight_grams, hole_depth_cm AS d, fishing_method, r.report_id % 11 = 0 AS nobait, r.report_id % 13 = 0 AS noplace FROM {report} r JOIN {location} l ON l.location_id = r.location_id)
SELECT fish_id, base_id, CASE WHEN NOT noplace THEN location_id END AS place_id, CASE WHEN noplace THEN 'odd place' ELSE '' END AS odd_place, CASE WHEN NOT nobait THEN bait_id END AS bait_id, CASE WHEN nobait THEN 'odd bait' ELSE '' END AS odd_bait,
  CAST(weight_grams AS BIGINT) AS grams, d AS depth_cm, CASE WHEN report_id % 3 = 0 THEN 'удочка' WHEN report_id % 3 = 2 AND d > 0 THEN 'над леской' END AS spot, CASE WHEN report_id % 3 = 1 THEN 'MIDWATER' END AS fishing_note,
  CASE WHEN report_id % 3 = 2 AND d IS NULL THEN 'вблизи' ELSE '' END AS unresolved
FROM x
""",
)
def parsed_reports(t: Tables) -> DataFrame:
    """Reports written as whole lines, with commas inside places, unknown places and baits, and observations, and parsed back."""
    bays = F.when(F.col("location_id") % 5 == 0, F.concat("name", F.lit(", bay"))).otherwise(F.col("name"))
    fish, bases = t.fish.select(F.col("fish_id").alias("name_id"), F.concat_ws("#", "name", "fish_id").alias("name")), t.base.select(F.col("base_id").alias("name_id"), "name")
    places, baits = t.location.select("base_id", F.col("location_id").alias("name_id"), bays.alias("name")), t.bait.select(F.col("bait_id").alias("name_id"), "name", "type")
    # lines are long to read for what they hold: parts by their number, not by their bytes
    columns = ["report_id", "fish_id", "location_id", "bait_id", "weight_grams", "hole_depth_cm"]
    rows = dealt(t, t.report.select(*columns), *columns).distinct()
    rows = rows.join(fish.select(F.col("name_id").alias("fish_id"), F.col("name").alias("fish")), "fish_id").join(places.select("base_id", F.col("name_id").alias("location_id"), F.col("name").alias("place")), "location_id")
    # the baits are few, which their plan over the facts does not tell
    rows = rows.join(bases.select(F.col("name_id").alias("base_id"), F.col("name").alias("base")), "base_id").join(near(baits.select(F.col("name_id").alias("bait_id"), F.col("name").alias("bait")), baits.count()), "bait_id")
    n, d = F.col("report_id"), F.col("hole_depth_cm")
    deep = F.when(d.isNotNull(), F.concat(F.expr("hole_depth_cm div 100").cast("string"), F.lit("."), F.lpad((d % 100).cast("string"), 2, "0")))
    said = F.when(n % 3 == 0, F.concat_ws(" ", F.when(d.isNotNull(), "ямка"), deep, F.lit("удочка"))).when(n % 3 == 1, F.concat_ws(" ", deep, F.lit("вполводы"))).otherwise(F.coalesce(F.concat(deep, F.lit(" над леской")), F.lit("вблизи")))
    place, bait = F.when(n % 13 == 0, "odd place").otherwise(F.col("place")), F.when(n % 11 == 0, "odd bait").otherwise(F.col("bait"))
    line = F.concat("fish", F.lit(" "), weight_text(F.col("weight_grams")), F.lit(". Поймана на "), "base", F.lit(": "), place, F.lit(", "), bait, F.lit(". "), said)
    # report ids of the given tables repeat: the whole row is the id
    whole = F.struct(*columns)
    out = parse_reports(rows.select(whole.alias("id"), line.alias("line")), fish, bases, places, baits, ANCHORS, with_id=False)
    odd = lambda c: F.when(F.col(f"{c}_state") == "missing", F.col(f"{c}_text")).otherwise(F.col(f"{c}_state"))
    return out.select("fish_id", "base_id", "place_id", odd("place").alias("odd_place"), "bait_id", odd("bait").alias("odd_bait"), "grams", "depth_cm", "spot", "fishing_note", F.array_join("unresolved", "|").alias("unresolved"))
