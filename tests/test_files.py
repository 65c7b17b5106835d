import hashlib
import zipfile
from datetime import datetime

import pytest

from castline.session import ship_package
from castline.sources import files
from castline.streaming.jobs import append_if_changed


def test_csv_with_quotes_and_bad_records(spark, tmp_path):
    (tmp_path / "a.csv").write_text('name,grams\n"a, ""b""\nc",5\nx,notanumber\n')
    good, bad = files.read_csv(spark, str(tmp_path / "a.csv"), "name string, grams int")
    assert [tuple(r) for r in good.collect()] == [('a, "b"\nc', 5)]
    assert bad.count() == 1


def test_json_must_fit(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": 1}\n{"id": "x"}\n')
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|parse"):
        files.read_json_exact(spark, str(tmp_path / "a.json"), "id bigint").collect()


def test_release_lines_and_hashes(spark, tmp_path):
    folder = tmp_path / "r"
    folder.mkdir()
    (folder / "one.txt").write_text("a\nb\n")
    good = hashlib.sha256(b"a\nb\n").hexdigest()
    manifest = spark.createDataFrame([("one.txt", good, 2)], "file string, sha256 string, lines int")
    assert sorted(tuple(r) for r in files.read_release(spark, str(folder), manifest).collect()) == [("one.txt", 1, "a"), ("one.txt", 2, "b")]
    short = spark.createDataFrame([("one.txt", good, 99)], "file string, sha256 string, lines int")
    with pytest.raises(Exception, match="line count differs"):
        files.read_release(spark, str(folder), short).collect()
    wrong = spark.createDataFrame([("one.txt", "0", 2)], "file string, sha256 string, lines int")
    with pytest.raises(Exception, match="release file differs"):
        files.read_release(spark, str(folder), wrong).collect()


def test_workbook_cells(spark, tmp_path):
    ship_package(spark)
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as book:
        book.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>pike</t></si></sst>")
        book.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="2"><c r="B2" t="s"><v>0</v></c><c r="C2"><v>12.5</v></c></row></sheetData></worksheet>')
    rows = files.read_workbooks(spark, str(tmp_path / "b.xlsx")).drop("path").collect()
    assert sorted(tuple(r) for r in rows) == [("sheet1.xml", 2, "B", "s", "pike"), ("sheet1.xml", 2, "C", "n", "12.5")]


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 1, "z")], "g string, i int, l string")
    files.write_lines(rows, str(tmp_path / "out"), "g", "l", "i", most=1)
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "out/g=a")).collect()) == ["x", "y"]
    target = str(tmp_path / "same")
    assert files.write_if_changed(rows, target, ["g", "i"]) and not files.write_if_changed(rows.repartition(3), target, ["g", "i"])
    with pytest.raises(ValueError, match="other rows"):
        files.write_if_changed(rows.where("i = 1"), target, ["g", "i"])


def test_repeated_rows_do_not_cancel(spark, tmp_path):
    target = str(tmp_path / "twice")
    assert files.write_if_changed(spark.createDataFrame([(1, "a")] * 2, "i int, l string"), target, ["i"])
    with pytest.raises(ValueError, match="other rows"):
        files.write_if_changed(spark.createDataFrame([(1, "b")] * 2, "i int, l string"), target, ["i"])


def test_counts_gate(spark):
    rows = spark.createDataFrame([("a",), ("a",), ("b",)], "k string")
    assert files.require_counts(rows, {"a": 2, "b": 1}, "k").count() == 3
    with pytest.raises(ValueError, match="expected"):
        files.require_counts(rows, {"a": 3}, "k")


def test_tables_as_tsv_and_markdown(spark, tmp_path):
    rows = spark.createDataFrame([(2, "b\tc\nd", 0.5), (1, "a|b", None), (3, None, 1 / 3)], "id int, name string, ratio double")
    files.write_tsv(rows, str(tmp_path / "tsv"), "id", ("ratio",))
    lines = [line for f in sorted((tmp_path / "tsv").glob("part-*")) for line in f.read_text().splitlines()]
    assert [line for line in lines if not line.startswith("id")] == ["1\ta|b\t", "2\tb c d\t0.500000", "3\t\t0.333333"]
    assert files.markdown_table(rows.select("id", "name"), ["id"], 2) == "| id | name |\n|-|-|\n| 1 | a\\|b |\n| 2 | b\tc d |\n(1 more)\n"


def test_snapshots_are_appended_when_they_change(spark, tmp_path):
    week, now, path = datetime(2024, 1, 1), datetime(2024, 1, 3), str(tmp_path / "snapshots")
    one = spark.createDataFrame([(1, datetime(2024, 1, 2)), (1, datetime(2024, 1, 2))], "id int, at timestamp_ntz")
    put = lambda rows, **more: append_if_changed(rows, path, "at", week, now, **more)
    assert put(one) and not put(one.repartition(3)) and put(one.limit(1)) and put(one) and put(one, version="2")
    assert spark.read.parquet(f"{path}/rows").groupBy("seq").count().orderBy("seq").collect() == [(1, 2), (2, 1), (3, 2), (4, 2)]
    for odd in (datetime(2023, 12, 31), datetime(2024, 1, 3, 0, 6), datetime(2024, 1, 8), None):
        with pytest.raises(ValueError, match="outside"):
            put(spark.createDataFrame([(1, odd)], "id int, at timestamp_ntz"))
    assert put(one.limit(0)) and not put(one.limit(0))
