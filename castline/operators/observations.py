"""What players write after the bait: depth, spot, note, retrieve and comment, by spans in column expressions.

Each stage finds a span of the text and adds it to a list of intervals; the
list is folded in order into the gaps between them, and what the gaps hold,
split at ``.`` and ``;``, is a position if it names a known anchor and
unresolved otherwise.  Nothing is guessed: two depths are none, and a comment
begins only at a line end or at a sentence after the retrieve.  All of it is a
projection: no shuffle, no Python.

Defined results: a null text gives nulls and no fragments; an unknown method
reads no retrieve; spans count code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.texts import catalog_name
from ..plans.registry import query
from ..plans.tables import Tables
from .reports import parts_of

#: White space, words for size and speed, notes, short forms of anchors, the largest depth.
SPACES = " \t\n\x0b\f\r\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
_W = r"\s\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
SIZES = {
    "маленькая": "SMALL", "маленький": "SMALL", "мал.": "SMALL", "мал": "SMALL", "м": "SMALL", "средняя": "MEDIUM", "средний": "MEDIUM", "сред": "MEDIUM", "ср.": "MEDIUM", "ср": "MEDIUM",
    "большая": "LARGE", "большой": "LARGE", "бол.": "LARGE", "бол": "LARGE", "б": "LARGE",
}
SPEEDS = {
    "медленная": "SLOW", "медленно": "SLOW", "медл.": "SLOW", "медл": "SLOW", "м": "SLOW", "средняя": "MEDIUM", "средне": "MEDIUM", "сред": "MEDIUM", "ср.": "MEDIUM", "ср": "MEDIUM",
    "быстрая": "FAST", "быстро": "FAST", "быстр.": "FAST", "быстр": "FAST", "б": "FAST",
}
NOTES = {"вполводы": "MIDWATER", rf"со[{_W}]+дна": "FROM_BOTTOM", "поверху": "SURFACE"}
ANCHOR_SHORTS = {"уда": "удочка"}
DEPTH_MAX = 2147483647

_S, _EDGE = f"[{_W}]", rf"[{_W}.,;:!?]"
_END = rf"(?=\z|{_EDGE})"
_either = lambda words: "|".join(w.replace(".", r"\.") for w in words)
_PAIR = rf"({_either(SIZES)}){_S}*[/\\]{_S}*({_either(SPEEDS)})"
_RETRIEVES = (
    rf"(?iu)^\({_S}*{_PAIR}{_S}*\){_END}",
    rf"(?iu)^{_PAIR}{_END}",
    rf"(?iu)^({_either(SIZES)})(?:{_S}*,?{_S}+|{_S}*,{_S}*)(?:проводка{_S}+)?({_either(SPEEDS)}){_END}",
    rf"(?iu)^(сред){_S}+на{_S}+(средн){_S}+пров(?=\z|[.,;:!?])",
)
_DEPTH = rf"(?<![\p{{L}}\p{{N}},+-])(?<!\d\.)(?:ям(?:а|ка){_S}*)?(\d+(?:[,.]\d{{1,2}})?)(?![\d,.+-]|[\p{{L}}\p{{N}}])"
_OVER = rf"над{_S}+[^{_W}](?:.*[^{_W}])?"
_SENTENCE = rf"\.{_S}+\p{{Lu}}"
_alone = lambda word: rf"(?<![\p{{L}}\p{{N}}]){word}(?![\p{{L}}\p{{N}}])"


def trimmed(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(text, F.lit(SPACES))


def _after(text: Column, at: Column) -> Column:
    return F.substring(text, at + 1, F.length(text))


def _span(start: Column, end: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"))


def _alias(words: dict[str, str], text: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in words.items() for x in pair]), F.lower(text))


def _retrieve(text: Column) -> Column:
    """(size, speed, start, end) of the retrieve that the text begins with, after leading punctuation; else null."""
    lead = F.regexp_extract(text, rf"^{_EDGE}*", 0)
    rest = _after(text, F.length(lead))
    found = []
    for i, pattern in enumerate(_RETRIEVES):
        speed = F.regexp_extract(rest, pattern, 2)
        value = F.struct(
            _alias(SIZES, F.regexp_extract(rest, pattern, 1)).alias("size"), (F.lit("MEDIUM") if i == 3 else _alias(SPEEDS, speed)).alias("speed"),
            F.length(lead).alias("start"), (F.length(lead) + F.length(F.regexp_extract(rest, pattern, 0))).alias("end"),
        )
        found.append(F.when(rest.rlike(pattern), value))
    return F.coalesce(*found)


def anchor_tokens(names: list[str]) -> list[str]:
    """The words that point at active anchors: those of their names, and short forms of active ones."""
    import re

    tokens = {t for name in names for t in re.split(r"[\W_]+", name.lower()) if t}
    return sorted(tokens | {short for short, name in ANCHOR_SHORTS.items() if name in {n.lower() for n in names}})


def parsed_observations(rows: DataFrame, text: str, method: str, anchors: list[str]) -> DataFrame:
    """rows plus (depth_cm, spot, fishing_note, size, speed, user_note, unresolved, spans) parsed from the text; spans are the intervals that were read."""
    # a few names of the catalog: a parameter, not a table
    known = F.array(*[F.lit(a) for a in anchor_tokens(anchors)]).cast("array<string>")
    spinning, raw, at = F.col(method).eqNullSafe("SPINNING"), F.col(text), F.col
    d = rows.withColumn("_tail", trimmed(F.regexp_extract(raw, r"(?s)^.*?(?:\r\n|[\n\r])(.*)\z", 1)))
    d = d.withColumn("_line", F.when(spinning & (at("_tail") != ""), at("_tail"))).withColumn("_first", trimmed(F.when(at("_line").isNotNull(), F.regexp_extract(raw, r"(?s)^(.*?)(?:\r\n|[\n\r])", 1)).otherwise(raw)))
    d = d.withColumn("_r1", F.when(spinning, _retrieve(at("_first"))))
    # a line end that follows no retrieve may stand inside one: then the whole text is read
    again = at("_r1").isNull() & at("_line").isNotNull()
    d = d.withColumn("_source", F.when(again, trimmed(raw)).otherwise(at("_first"))).withColumn("_r", F.when(again, _retrieve(at("_source"))).otherwise(at("_r1")))
    d = d.withColumn("_said", F.when(at("_r").isNotNull() & ~(at("_r1").isNotNull() & at("_line").isNotNull()), F.regexp_extract(_after(at("_source"), at("_r.end")), rf"^{_S}*\.{_S}+(?=\p{{Lu}})", 0)))
    begins = F.when(at("_said") != "", at("_r.end") + F.length("_said"))
    d = d.withColumn("_begins", begins).withColumn("_note", F.when(at("_r1").isNotNull() & at("_line").isNotNull(), at("_line")).otherwise(trimmed(_after(at("_source"), at("_begins")))))
    d = d.withColumn("_e", F.when(at("_begins").isNotNull(), F.substring(at("_source"), F.lit(1), at("_begins"))).otherwise(at("_source"))).drop("_tail", "_line", "_first", "_r1", "_said", "_begins", "_source")
    e = at("_e")
    # exactly one depth
    deep = lambda i: F.regexp_extract(e, f"(?isu)^(.*?)({_DEPTH})", i)
    d = d.withColumn("_depths", F.regexp_count(e, F.lit(f"(?iu){_DEPTH}"))).withColumn("_before", deep(1)).withColumn("_match", deep(2)).withColumn("_number", deep(3))
    digits = F.concat(F.regexp_extract("_number", r"^\d+", 0), F.rpad(F.regexp_extract("_number", r"[,.](\d+)$", 1), 2, "0")).try_cast("decimal(38,0)")
    d = d.withColumn("_depth", F.when((at("_depths") == 1) & digits.between(1, DEPTH_MAX), digits).cast("int"))
    # a phrase right behind it, closing brackets aside
    p0, p1 = F.length("_before"), F.length("_before") + F.length("_match")
    d = d.withColumn("_behind", F.regexp_replace(_after(e, p1), rf"[{_W})\]}}]+\z", "")).withColumn("_phrase", F.regexp_extract("_behind", rf"(?isu)^{_S}+({_OVER}){_S}*\z", 1))
    plain = ~at("_phrase").rlike(r"[\n\r]") & ~at("_phrase").rlike(_SENTENCE)
    for word in NOTES:
        plain = plain & ~at("_phrase").rlike(f"(?iu){_alone(word)}")
    ending = rf"(?isu)^(.*?)({_S}+{_PAIR})\z"
    d = d.withColumn("_spot", F.when(at("_depth").isNotNull() & (at("_phrase") != "") & plain, at("_phrase"))).withColumn("_lead", F.regexp_extract("_spot", ending, 1))
    peeled = F.when(spinning & at("_r").isNull() & at("_lead").rlike(rf"(?isu)^{_OVER}\z"), F.struct(_alias(SIZES, F.regexp_extract("_spot", ending, 3)).alias("size"), _alias(SPEEDS, F.regexp_extract("_spot", ending, 4)).alias("speed")))
    d = d.withColumn("_peeled", peeled).withColumn("_bare", at("_before").rlike(rf"^[{_W}.,;:!?(\[{{]*\z"))
    fits = at("_bare") | (at("_peeled").isNotNull() & ~at("_before").rlike(r"[\n\r]") & ~at("_before").rlike(_SENTENCE))
    d = d.withColumn("_has", at("_spot").isNotNull() & fits).withColumn("_where", F.when(at("_has"), F.when(at("_peeled").isNotNull(), at("_lead")).otherwise(at("_spot"))))
    notes = [F.when(e.rlike(f"(?iu){_alone(word)}"), F.struct(F.lit(value).alias("value"), F.regexp_extract(e, f"(?isu)^(.*?)({_alone(word)})", 1).alias("b"), F.regexp_extract(e, f"(?isu)^(.*?)({_alone(word)})", 2).alias("m"))) for word, value in NOTES.items()]
    d = d.withColumn("_n", F.coalesce(*notes))
    begin = p1 + F.instr("_behind", at("_phrase")) - 1
    spans = F.array(
        F.when(at("_r").isNotNull(), _span(at("_r.start"), at("_r.end"))), F.when(at("_depth").isNotNull(), _span(p0, p1)),
        F.when(at("_has"), _span(F.lit(0), F.when(at("_bare"), p0).otherwise(F.length(F.regexp_extract("_before", rf"^[{_W}.,;:!?(\[{{]*", 0))))),
        F.when(at("_has"), _span(begin, begin + F.length("_where"))), F.when(at("_has") & at("_peeled").isNotNull(), _span(begin + F.length("_where"), begin + F.length("_phrase"))),
        F.when(at("_has"), _span(begin + F.length("_phrase"), F.length(e))), F.when(at("_n").isNotNull(), _span(F.length("_n.b"), F.length("_n.b") + F.length("_n.m"))),
    )
    d = d.withColumn("_spans", F.array_sort(F.filter(spans, lambda s: s.isNotNull() & (s["end"] > s["start"]))))
    none = F.array().cast("array<struct<start:int,end:int>>")
    step = lambda acc, s: F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] > acc["at"], F.concat(acc["gaps"], F.array(_span(acc["at"], s["start"])))).otherwise(acc["gaps"]).alias("gaps"))
    close = lambda acc: F.when(acc["at"] < F.length(e), F.concat(acc["gaps"], F.array(_span(acc["at"], F.length(e))))).otherwise(acc["gaps"])
    d = d.withColumn("_gaps", F.aggregate("_spans", F.struct(F.lit(0).alias("at"), none.alias("gaps")), step, close))
    pieces = lambda g: F.transform(F.split(F.substring(e, g["start"] + 1, g["end"] - g["start"]), "[.;]+"), lambda f: F.regexp_replace(f, rf"^{_EDGE}+|{_EDGE}+\z", ""))
    d = d.withColumn("_parts", F.coalesce(F.filter(F.flatten(F.transform("_gaps", pieces)), lambda f: f != ""), F.array().cast("array<string>")))
    named = F.transform("_parts", lambda f: F.coalesce(F.arrays_overlap(F.split(catalog_name(f, compose=False), r"[^\p{L}\p{N}]+"), known), F.lit(False)))
    d = d.withColumn("_place", F.when(at("_has") | (at("_depths") > 1), 0).otherwise(F.coalesce(F.array_position(named, True), F.lit(0))))
    out = {
        "depth_cm": at("_depth"), "spot": F.coalesce("_where", F.when(at("_place") > 0, F.get("_parts", at("_place").cast("int") - 1))), "fishing_note": at("_n.value"),
        "size": F.coalesce("_r.size", F.when(at("_has"), at("_peeled.size"))), "speed": F.coalesce("_r.speed", F.when(at("_has"), at("_peeled.speed"))), "user_note": F.nullif("_note", F.lit("")),
        "unresolved": F.filter("_parts", lambda f, i: i + 1 != at("_place")), "spans": F.coalesce("_spans", none),
    }
    return d.withColumns(out).drop(*[c for c in d.columns if c.startswith("_") and c not in rows.columns])


def parsed_repeats(rows: DataFrame, text: str, method: str, anchors: list[str], parts: int) -> DataFrame:
    """parsed_observations where texts repeat: rows are dealt by hash into parts, and each text of a part is read once.

    A part holds a share of the rows whatever they say, so a text that many rows share is no hot key.
    """
    others = [c for c in rows.columns if c not in (text, method)]
    held = rows.withColumn("_part", F.pmod(F.xxhash64(*others), F.lit(parts))).repartition(parts, "_part")
    once = held.groupBy("_part", text, method).agg(F.collect_list(F.struct(*others)).alias("_same"))
    read = parsed_observations(once, text, method, anchors).drop("_part")
    return read.select(*[c for c in read.columns if c != "_same"], F.inline("_same"))


#: Anchors of the derived texts.
ANCHORS = ["удочка", "леска", "чат", "блокнот"]


@query(
    "parsed_observations",
    r"""
WITH x AS (SELECT report_id, report_id % 8 AS form, hole_depth_cm AS d, fishing_method = 'SPINNING' AS lure FROM {report})
SELECT report_id, CASE WHEN form NOT IN (4, 6) THEN d END AS depth_cm,
  CASE WHEN form = 0 THEN 'удочка' WHEN form = 2 AND d > 0 THEN 'над леской' WHEN form = 3 THEN CASE WHEN lure OR d > 0 THEN 'чат' ELSE 'ср\м чат' END
       WHEN form = 5 AND d > 0 THEN CASE WHEN lure THEN 'над рюкзак/данные' ELSE 'над рюкзак/данные бол/м' END END AS spot,
  CASE form WHEN 1 THEN 'MIDWATER' WHEN 7 THEN 'FROM_BOTTOM' END AS fishing_note,
  CASE WHEN NOT lure THEN NULL WHEN form = 3 THEN 'MEDIUM' WHEN form = 4 OR (form = 5 AND d > 0) THEN 'LARGE' END AS size,
  CASE WHEN NOT lure THEN NULL WHEN form IN (3, 4) OR (form = 5 AND d > 0) THEN 'SLOW' END AS speed,
  CASE WHEN lure AND form = 4 THEN 'Взял сразу, номер ' || report_id || '.' END AS user_note,
  CASE WHEN form = 2 AND d IS NULL THEN 'вблизи' WHEN form = 3 AND NOT lure AND d > 0 THEN 'ср\м' WHEN form = 4 AND NOT lure THEN 'бол/м|Взял сразу, номер ' || report_id
       WHEN form = 5 AND d IS NULL THEN 'вдали' WHEN form = 6 THEN '4|65 над леской 5|55 над удочкой' WHEN form = 7 THEN 'непонятно' ELSE '' END AS unresolved
FROM x
""",
)
def observations_of_reports(t: Tables) -> DataFrame:
    """Reports written as players write them, in eight forms with and without a depth, and read back."""
    d, form = F.col("hole_depth_cm"), F.col("report_id") % 8
    deep = F.when(d.isNotNull(), F.format_string("%d.%02d", F.expr("hole_depth_cm div 100"), d % 100))
    texts = [
        F.concat_ws(" ", F.when(d.isNotNull(), "ямка"), deep, F.lit("удочка")), F.concat_ws(" ", deep, F.lit("вполводы")), F.coalesce(F.concat(F.lit("("), deep, F.lit(" над леской)")), F.lit("вблизи")), F.concat_ws(" ", F.lit(r"ср\м"), deep, F.lit("чат")),
        F.concat(F.lit("бол/м. Взял сразу, номер "), F.col("report_id").cast("string"), F.lit(".")), F.coalesce(F.concat(F.lit("("), deep, F.lit(" над рюкзак/данные бол/м)")), F.lit("вдали")), F.lit("4.65 над леской 5.55 над удочкой"), F.concat_ws(" ", F.lit("непонятно;"), deep, F.lit("со дна!")),
    ]
    rows = t.report.select("report_id", "hole_depth_cm", "fishing_method", F.element_at(F.array(*texts), (form + 1).cast("int")).alias("written"))
    out = parsed_repeats(rows, "written", "fishing_method", ANCHORS, parts_of(t.raw("lineitem")))
    return out.select("report_id", "depth_cm", "spot", "fishing_note", "size", "speed", "user_note", F.array_join("unresolved", "|").alias("unresolved"))
