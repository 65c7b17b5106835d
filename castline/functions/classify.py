"""Scalar rules as column expressions: weight classes, record assessment, weeks, exact text numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weeks start on Sunday 19:00 UTC.
WEEK_START = "3 days 19 hours"
INT_MAX = 2147483647


def week_start(ts: Column) -> Column:
    """The instant at which the ts's record week starts."""
    return F.window(ts.cast("timestamp"), "7 days", startTime=WEEK_START)["start"].cast("timestamp_ntz")


def weight_class(weight: Column, low: Column, high: Column) -> Column:
    """Below the minimum or far above the maximum is suspicious; up to 5 % above is a mutant; null bounds classify only what they can."""
    w = weight.cast("long")
    return (
        F.when(w < low, "SUSPICIOUS_LOW")
        .when((w > high) & (w * 20 <= high.cast("long") * 21), "MUTANT")
        .when(w > high, "SUSPICIOUS_HIGH")
        .when(low.isNotNull() & high.isNotNull(), "ORDINARY")
        .otherwise("UNCLASSIFIED")
    )


def record_status(record: Column, high: Column) -> Column:
    """How a record stands to the known maximum: headroom is maximum minus record."""
    room = high.cast("long") - record.cast("long")
    return (
        F.when(record.isNull(), "NO_RECORD")
        .when(high.isNull(), "MAX_UNKNOWN")
        .when(room < 0, "MUTANT")
        .when(room == 0, "MAXIMUM")
        .when(room * 1000 <= high.cast("long") * 3, "NEAR_MAX")
        .otherwise("CAN_BEAT")
    )


def decimal_text(text: Column, digits: int) -> Column:
    """The exact integer of a decimal number with up to ``digits`` fraction digits, scaled by 10 ** digits; null if it is none or too large."""
    pattern = rf"^\s*([0-9]{{1,10}})(?:[.,]([0-9]{{1,{digits}}}))?\s*$"
    whole, part = F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2)
    value = F.try_to_number(F.concat(whole, F.rpad(part, digits, "0")), F.lit("9" * (10 + digits))).cast("long")
    return F.when(text.rlike(pattern) & (value <= INT_MAX), value)


def grams(text: Column) -> Column:
    """Grams of '1,234 кг', '40 г', '40 гр' or '40 грамм'; null if it is no such weight."""
    pattern = r"^\s*([0-9]+(?:[.,][0-9]+)?)\s*(кг|г|гр|грамм)\.?\s*$"
    number, unit = F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2)
    return F.when(text.rlike(pattern), F.when(unit == "кг", decimal_text(number, 3)).otherwise(F.when(number.rlike("^[0-9]+$"), decimal_text(number, 0 + 1) / 10).cast("long")))


def half_up(x: Column) -> Column:
    return F.floor(x + F.lit(0.5))
