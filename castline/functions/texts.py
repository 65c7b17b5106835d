"""Text rules as column expressions: lookup keys, notes, exact numbers, ids, suffixes.

Spark has no Unicode compatibility form.  ``composed`` gives it, in Arrow batches
in which only texts beyond plain letters travel; where a rule is used inside a lambda
or over facts, ``half_width`` folds full-width forms as a column expression.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space beyond ASCII, letters folded in lookups, the largest exact integer of a double, the largest int.
SPACE = r"[\s\u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]+"
#: SPACE for searches over every letter: two looks tell that most are none.
_SPACE_SOON = r"[ \t\n\x0B\f\r\u0085\u00A0[\u1680-\uFEFF&&[\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]]]+"
FOLDED = ("ёй", "еи")
#: Letters that stay as they are in composed forms whatever stands around: ASCII, Western European, Cyrillic.
COMPOSED = r"\x00-\x7F\u00C0-\u00FF\u0400-\u0482\u048A-\u04FF"
SAFE_MAX = (1 << 53) - 1
INT_MAX = (1 << 31) - 1


def composed(text: Column, form: str = "NFKC") -> Column:
    """The text in a Unicode form; texts that are in it letter by letter stay in the JVM."""
    beyond = f"[^{COMPOSED}]" if form in ("NFC", "NFKC") else r"[^\x00-\x7F]"

    @F.arrow_udf("string")
    def normal(texts: pa.Array) -> pa.Array:
        import unicodedata

        if texts.null_count == len(texts):
            return texts
        return pa.array([t and unicodedata.normalize(form, t) for t in texts.to_pylist()], texts.type)

    return F.coalesce(normal(F.when((F.octet_length(text) > F.length(text)) & text.rlike(beyond), text)), text)


def lower_each(text: Column) -> Column:
    """Lower case letter by letter, whatever stands around: a sigma at a word's end stays one, a dotted capital I is an i."""
    return F.lower(F.translate(text, "\u0130\u03a3", "i\u03c3"))


def upper_letter(letter: Column) -> Column:
    """A letter's upper case where that is one letter too, else the letter; sharp s has a capital."""
    longer = [c for c in map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x10000)]) if len(c.upper()) > 1]
    one = {c: c.title() if len(c.title()) == 1 else c for c in longer} | {"\u00df": "\u1e9e"}
    return F.coalesce(F.create_map(*[F.lit(x) for pair in one.items() for x in pair])[letter], F.upper(letter))


def half_width(text: Column) -> Column:
    """Full-width forms of ASCII as ASCII."""
    wide = range(0xFF01, 0xFF5F)
    return F.translate(text, "".join(map(chr, wide)), "".join(chr(c - 0xFEE0) for c in wide))


def edges_trimmed(text: Column) -> Column:
    """The text without white space of any kind at its ends."""
    return F.regexp_replace(text, rf"^{SPACE}|{SPACE}\z", "")


def collapsed(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, _SPACE_SOON, " "))


def lookup_key(text: Column, form: str = "NFKC") -> Column:
    """The key by which names are looked up, letters lowered one by one."""
    return F.translate(lower_each(collapsed(composed(text, form))), *FOLDED)


def catalog_name(text: Column, compose: bool = True) -> Column:
    """A catalog name's key, null if it holds control characters, is empty or over 128 code points, or has no letter or digit."""
    trimmed = edges_trimmed(text)
    name = F.lower(F.regexp_replace(composed(trimmed) if compose else half_width(trimmed), SPACE, " "))
    sized = F.length(trimmed).between(1, 128) & F.length(name).between(1, 128)
    return F.when(~text.rlike(r"\p{C}") & ~name.rlike(r"\p{C}") & sized & name.rlike(r"[\p{L}\p{N}]"), name)


def evidence_text(text: Column) -> Column:
    """Text of outside sources as it is compared: composed, white space collapsed, one kind of dash and of quote, lower case; blank is null."""
    plain = F.translate(composed(text), "\u2010\u2011\u2012\u2013\u2014\u2212\u00ab\u00bb\u201c\u201d\u201e", '------"""""')
    return F.nullif(F.lower(collapsed(plain)), F.lit(""))


def note(text: Column) -> Column:
    """The trimmed note; blank is null."""
    return F.nullif(edges_trimmed(text), F.lit(""))


def without_suffix(text: Column, suffix: str) -> Column:
    """The text without an exact suffix."""
    return F.when(F.endswith(text, F.lit(suffix)), F.left(text, F.length(text) - len(suffix))).otherwise(text)


def positive_integer(text: Column) -> Column:
    """The value of digits alone, positive and exact in a double; else null."""
    value = F.when(text.rlike(r"^[0-9]{1,16}$"), text).try_cast("long")
    return F.when(value.between(1, SAFE_MAX), value)


def canonical_id(text: Column) -> Column:
    """A positive numeric id as text without leading zeros; else null."""
    return F.nullif(F.when(text.rlike("^[0-9]+$"), F.regexp_replace(text, "^0+", "")), F.lit(""))


def thousands(text: Column) -> Column:
    """The integer of digits grouped by dots, as 1.234.567, or of plain digits; else null."""
    return F.when(text.rlike(r"^([0-9]{1,3}(\.[0-9]{3}){1,4}|[0-9]{1,15})$"), F.replace(text, F.lit("."), F.lit(""))).try_cast("long")


def depth_cm(text: Column) -> Column:
    """Centimetres of metres with up to two fraction digits; else null."""
    pattern = r"^\s*([0-9]{1,6})(?:[.,]([0-9]{1,2}))?\s*(?:м|m)?\.?\s*$"
    digits = F.concat(F.regexp_extract(text, pattern, 1), F.rpad(F.regexp_extract(text, pattern, 2), 2, "0"))
    return F.when(text.rlike(pattern), digits).try_cast("int")


def exact_cell(text: Column) -> Column:
    """(value, reason) of a spreadsheet number: VALID only for a positive whole number within an int, however it is written; digits are moved, never rounded."""
    pattern = r"^([+-]?)([0-9]+)(?:\.([0-9]*))?(?:[eE]([+-]?[0-9]+))?\z"
    cell = edges_trimmed(text)
    part = lambda i: F.regexp_extract(cell, pattern, i)
    digits, power = F.concat(part(2), part(3)), part(4)
    scale = F.length(part(3)) - F.coalesce(F.when(F.length(power) <= 6, power).try_cast("int"), F.lit(0))
    n = F.length(digits)
    fraction = (scale > 0) & F.substring(digits, F.greatest(n - scale, F.lit(0)) + 1, n).rlike("[1-9]")
    moved = F.when(scale > 0, F.substring(digits, F.lit(1), F.greatest(n - scale, F.lit(0)))).otherwise(F.concat(digits, F.repeat(F.lit("0"), F.least(F.lit(12), -scale))))
    whole = F.regexp_replace(moved, "^0+", "")
    value = F.when(F.length(whole) <= 10, whole).try_cast("long")
    reason = (
        F.when(text.isNull() | (cell == ""), "EMPTY").when(~cell.rlike(pattern), "NOT_A_NUMBER").when(part(1) == "-", "NOT_POSITIVE")
        .when(F.length(power) > 6, F.when(power.startswith("-"), "FRACTION").otherwise("TOO_LARGE")).when(fraction, "FRACTION")
        .when((scale < 0) & (F.length(F.regexp_replace(digits, "^0+", "")) - scale > 10), "TOO_LARGE").when(whole == "", "NOT_POSITIVE").when((F.length(whole) > 10) | (value > INT_MAX), "TOO_LARGE").otherwise("VALID")
    )
    return F.struct(F.when(reason == "VALID", value).alias("value"), reason.alias("reason"))


def safe_count(count: Column) -> Column:
    """The count, or an error if a double cannot hold it exactly."""
    return F.when(count <= SAFE_MAX, count).otherwise(F.raise_error(F.lit("count is beyond 2^53 - 1")).cast("long"))


def grid_step(weight: Column) -> Column:
    """11 * 10 ** max(0, digits - 3) of a whole weight."""
    return (F.lit(11) * F.pow(F.lit(10), F.greatest(F.lit(0), F.length(weight.cast("string")) - 3))).cast("long")


def weight_name(text: Column) -> Column:
    """The exact key of names in weight tables: no letter is folded."""
    return lower_each(collapsed(text))


def mixed_script_tokens(text: Column) -> Column:
    """The words that hold Latin and Cyrillic letters, sorted."""
    words = F.split(text, r"[^\p{L}]+")
    return F.array_sort(F.filter(words, lambda w: w.rlike("[A-Za-z]") & w.rlike("[А-Яа-яЁё]")))


def digit_padded(text: Column, width: int = 12) -> Column:
    """The text with digit runs of up to ``width`` digits padded by zeros, so that they sort by value."""
    padded = F.regexp_replace(text, r"(?<![0-9])([0-9]+)", "0" * (width - 1) + "$1")
    return F.regexp_replace(padded, rf"(?<![0-9])0{{0,{width - 1}}}([0-9]{{{width},}})(?![0-9])", "$1")
