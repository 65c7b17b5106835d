import pytest
from pyspark.sql import functions as F

from castline.functions import texts

CASES = {
    "lookup_key": [("  Щука  Йод ", "щука иод"), ("ЁЖ", "еж"), (None, None)],
    "catalog_name": [(" Pike  One ", "pike one"), ("--", None), ("", None), ("a\u0007", None), ("x" * 129, None), (None, None), ("ﬁ\u00a0Ｑ", "fi q"), ("ﬁ" * 65, None), ("\u00a0a\u3000", "a")],
    "note": [("  ", None), (" a ", "a"), (None, None), ("\t\n\u00a0", None), ("\u00a0a b\r\n", "a b")],
    "positive_integer": [("12", 12), ("0", None), ("1.5", None), ("9007199254740992", None), ("9007199254740991", 9007199254740991), ("-3", None)],
    "canonical_id": [("0012", "12"), ("000", None), ("x", None)],
    "thousands": [("1.234.567", 1234567), ("1.23", None), ("40", 40), ("", None)],
    "depth_cm": [("1,5", 150), ("2.25 м", 225), ("3", 300), ("1.234", None), ("deep", None)],
    "weight_name": [("  Ёж  Йод ", "ёж йод"), (None, None)],
    "mixed_script_tokens": [("щукa, pike и Cом ok", ["Cом", "щукa"]), ("pike щука", []), (None, None)],
    "digit_padded": [("a10 b9", "a000000000010 b000000000009"), ("no", "no"), ("123456789012", "123456789012"), ("", ""), (None, None)],
    "grid_step": [("5", 11), ("999", 11), ("1000", 110), ("25000", 1100)],
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_text_rules(spark, name):
    rows = spark.createDataFrame([(t,) for t, _ in CASES[name]], "t string")
    column = F.col("t").cast("int") if name == "grid_step" else F.col("t")
    assert [r[0] for r in rows.coalesce(1).select(getattr(texts, name)(column)).collect()] == [v for _, v in CASES[name]]


def test_exact_cells_and_safe_counts(spark):
    wanted = {
        "12": 12, "1.2e3": 1200, "1.5": "FRACTION", "-4": "NOT_POSITIVE", "-0": "NOT_POSITIVE", "0": "NOT_POSITIVE", "abc": "NOT_A_NUMBER", None: "EMPTY", " ": "EMPTY", "1e30": "TOO_LARGE", "12.0": 12,
        "1.00000000001": "FRACTION", "1e-11": "FRACTION", "0e-11": "NOT_POSITIVE", " 7\u00a0": 7, "+7.": 7, ".5": "NOT_A_NUMBER", "2147483647": 2147483647, "2147483648": "TOO_LARGE", "21474836470e-1": 2147483647,
        "000000000000012": 12, "12000e-3": 12, "1200e-3": "FRACTION", "1e100000": "TOO_LARGE", "1e-1000000": "FRACTION", "0e20": "TOO_LARGE", "0e5": "NOT_POSITIVE", "1.23e2": 123, "1.234e2": "FRACTION", "9" * 40: "TOO_LARGE", "1\n": 1,
    }
    rows = spark.createDataFrame([(c,) for c in wanted], "t string").coalesce(1).select(texts.exact_cell(F.col("t")).alias("c")).collect()
    for (cell, want), r in zip(wanted.items(), rows):
        assert tuple(r["c"]) == ((want, "VALID") if isinstance(want, int) else (None, want)), cell
    assert spark.range(3).agg(texts.safe_count(F.count("*"))).first()[0] == 3
    with pytest.raises(Exception, match="beyond"):
        spark.range(1).select(texts.safe_count(F.lit(1 << 53))).collect()


def test_document_keys_of_odd_letters(spark, tmp_path):
    """Compatibility forms, dotted I, sigma at a word's end, capitals of several letters: as its SQL has them."""
    import pandas as pd
    from compare import oracle, rows

    import __spark_entry__ as entry

    odd = ["ﬁn Ｑ²", "İstanbul", "ΑΣ ΣΑΣ.", "ßa", "ᾀx", "ǰ", "é", " ˮ a", "", None]
    pd.DataFrame({"doc_id": range(len(odd)), "text": odd}).to_parquet(tmp_path / "documents.parquet")
    got = entry.queries()["document_keys"](spark, str(tmp_path)).toPandas()
    assert rows(got) == rows(oracle(str(tmp_path), entry.oracle_sql()["document_keys"]))


def test_letters_that_stay_as_they_are_when_composed():
    """Texts of these letters alone do not travel, so they must be composed already, whatever stands beside what."""
    import itertools
    import re
    import unicodedata

    letters = [chr(c) for c in range(0x600) if re.match(f"[{texts.COMPOSED}]", chr(c))]
    assert len(letters) > 400 and not any(unicodedata.combining(c) for c in letters)
    for form in ("NFC", "NFKC"):
        assert all(unicodedata.is_normalized(form, a + b) for a, b in itertools.product(letters, letters))


def test_only_texts_beyond_plain_letters_travel(spark):
    rows = spark.createDataFrame([("\u044f 5,00 \u0451\u0439",), ("e\u0301 \ufb01",), ("\u0438\u0306",), ("plain",), ("",), (None,)], "t string").coalesce(1)
    assert [r[0] for r in rows.select(texts.composed(F.col("t"))).collect()] == ["\u044f 5,00 \u0451\u0439", "\u00e9 fi", "\u0439", "plain", "", None]
    assert [r[0] for r in rows.select(texts.composed(F.col("t"), "NFD")).collect()][0] == "\u044f 5,00 \u0435\u0308\u0438\u0306"
    plan = rows.where(texts.composed(F.col("t")) == "x")._jdf.queryExecution().executedPlan().toString()
    assert "\\u0400-\\u0482" in plan


def test_white_space_is_the_same_by_any_search(spark):
    from castline.operators.observations import _S, trimmed

    every = spark.range(0x110, numPartitions=1).selectExpr("explode(transform(sequence(0, 255), i -> int(id * 256 + i))) as c").where("c not between 55296 and 57343")
    every = every.select(F.decode(F.unhex(F.lpad(F.hex("c"), 8, "0")), "UTF-32").alias("l")).select(F.concat("l", F.lit("a"), "l", "l", F.lit("b"), "l").alias("t"))
    slow = F.trim(F.regexp_replace("t", texts.SPACE, " "))
    assert every.where(~texts.collapsed(F.col("t")).eqNullSafe(slow) | ~trimmed(F.col("t")).eqNullSafe(F.regexp_replace("t", rf"^{_S}+|{_S}+\z", ""))).count() == 0
