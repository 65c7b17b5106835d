"""Places and baits parted by what is known, longest names first, and whole lines."""

import pytest

from castline.operators.lines import parse_reports, split_places

PLACES = [(1, 10, "Old Mill"), (1, 11, "Old Mill, lower bay"), (1, 12, "Twin"), (1, 13, "twin "), (2, 20, "Old Mill"), (1, 14, "Ёлкин Мост"), (1, 15, "Ｃape")]
BAITS = [(1, "Worm"), (2, "Worm big"), (3, "Fly No. 5"), (4, "corn"), (5, "CORN")]

# rest -> place id, n, text, bait id, n, text, observation
CASES = [
    ("Old Mill, worm. deep", (10, 1, "Old Mill", 1, 1, "worm", ". deep")),
    ("Old Mill, lower bay, Worm big 5.50", (11, 1, "Old Mill, lower bay", 2, 1, "Worm big", "5.50")),
    ("Old Mill, lower bank, Worm", (10, 1, "Old Mill", None, 0, "lower bank, Worm", None)),
    ("old  mill , Worm bigger", (10, 1, "old  mill", 1, 1, "Worm", "bigger")),
    ("Twin, Worm", (None, 2, "Twin", 1, 1, "Worm", None)),
    ("Елкин мост, fly no. 5 чат", (14, 1, "Елкин мост", 3, 1, "fly no. 5", "чат")),
    ("cape, corn", (15, 1, "cape", None, 2, "corn", None)),
    ("Nowhere, Worm. x", (None, 0, "Nowhere", 1, 1, "Worm", ". x")),
    ("Nowhere, also here, odd bait. seen. twice", (None, 0, "Nowhere", None, 0, "also here, odd bait", "seen. twice")),
    ("Old Mill", (None, 0, "Old Mill", None, 0, None, None)),
    ("Old Mill,  ", (10, 1, "Old Mill", None, 0, None, None)),
    ("Old Mill, Worms", (10, 1, "Old Mill", None, 0, "Worms", None)),
    (None, (None, 0, None, None, 0, None, None)),
]


@pytest.fixture(scope="module")
def catalog(spark):
    return spark.createDataFrame(PLACES, "base_id long, name_id long, name string"), spark.createDataFrame([(i, n, "LURE" if i == 3 else "BAIT") for i, n in BAITS], "name_id long, name string, type string")


def test_split(spark, catalog):
    rows = spark.createDataFrame([(i, 1, rest) for i, (rest, _) in enumerate(CASES)] + [(99, 2, "Old Mill, lower bay, Worm")], "id long, base_id long, rest string")
    got = {r["id"]: tuple(r[c] for c in ("place_id", "place_n", "place_text", "bait_id", "bait_n", "bait_text", "observation")) for r in split_places(rows, catalog[0], catalog[1].drop("type")).collect()}
    assert got == {i: want for i, (_, want) in enumerate(CASES)} | {99: (20, 1, "Old Mill", None, 0, "lower bay, Worm", None)}


def test_lines(spark, catalog):
    lines = spark.createDataFrame(
        [(1, "Pike 1,250 кг. Поймана на Lake: Old Mill, lower bay, Fly No. 5 ср/м 3.20 чат"), (2, "pike 300 грамм. Поймана на lake: Old Mill, Worm. 2 удочка"), (3, "Carp 1 грамм. Поймана на Lake: Old Mill, corn"), (4, "no line at all"), (5, None)], "id long, line string"
    )
    names = lambda rows: spark.createDataFrame(rows, "name_id long, name string")
    got = {r["id"]: r for r in parse_reports(lines, names([(7, "Pike"), (8, "Carp"), (9, "carp")]), names([(1, "Lake")]), *catalog, ["чат", "удочка"]).collect()}
    shown = lambda r: tuple(r[c] for c in ("fish_id", "grams", "base_id", "place_id", "bait_id", "depth_cm", "spot", "size", "speed", "unresolved"))
    assert shown(got[1]) == (7, 1250, 1, 11, 3, 320, "чат", "MEDIUM", "SLOW", [])
    assert shown(got[2]) == (7, 300, 1, 10, 1, 200, "удочка", None, None, [])
    assert shown(got[3]) == (None, 1, 1, 10, None, None, None, None, None, []) and got[3]["bait_state"] == "ambiguous"
    assert shown(got[4]) == shown(got[5]) == (None,) * 9 + ([],)


ODD = [
    "Old Mill, worm\u0085, a", "Old Mill,worm \u0085 big. x", "old  mill ,  worm   BIG , y", "Old Mill, Fly No.", "Old Mill, fly no. 5", "Old Mill, fly no.", "Old Mill, Worm big" + " " * 140 + "z", "Old Mill, " + "x" * 140 + ", Worm",
    "Old Mill, lower bay , (worm)", "Ｏld Ｍill， ｗｏｒｍ． 5", "Old Mill,, Worm", ", Worm", "Old Mill, .worm", "Old Mill, ΑΣ, b", "İx, worm", "Old Mill, a.b c. d",
]


def test_names_by_their_marks_and_all_prefixes_give_the_same(spark, catalog, monkeypatch):
    """The longest name is found by one lookup for each number of marks, and where names have too many among all prefixes; large catalogs shuffle."""
    from castline.operators import lines

    places = catalog[0].union(spark.createDataFrame([(1, 30, "İx"), (1, 31, "Old Mill,"), (1, 32, ""), (1, 33, "Old Mill, lower bay, far, end")], "base_id long, name_id long, name string"))
    baits = catalog[1].drop("type").union(spark.createDataFrame([(20, "fly no."), (21, "ας"), (22, "a.b"), (23, "a.b c."), (24, "(worm)"), (25, ".")], "name_id long, name string"))
    rows = spark.createDataFrame([(i, i % 9 and 1 or None, rest) for i, rest in enumerate([rest for rest, _ in CASES] + ODD, 1)], "id long, base_id long, rest string")
    shown = lambda: sorted(map(repr, split_places(rows, places, baits).select("id", "place_id", "place_n", "place_text", "bait_id", "bait_n", "bait_text", "observation").collect()))
    by_marks = shown()
    for name, value in (("KINDS", 0), ("KNOWN", 3)):
        monkeypatch.setattr(lines, name, value)
        assert shown() == by_marks, name
        monkeypatch.undo()


def test_large_catalogs_are_hashed_where_rows_meet_them(spark, catalog, monkeypatch):
    from castline.operators import lines

    monkeypatch.setattr(lines, "KNOWN", 0)
    frame = split_places(spark.range(50).selectExpr("id", "1L as base_id", "concat('Old Mill, lower bay, Worm. ', id) as rest"), catalog[0], catalog[1].drop("type"))
    assert {(r["place_id"], r["bait_id"]) for r in frame.collect()} == {(11, 1)}
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "Generate" not in plan and "hashpartitioning(id" not in plan


def test_small_catalogs_come_to_the_rows(spark, catalog):
    """Rows are neither multiplied by their prefixes nor shuffled by id."""
    rows = spark.range(50).selectExpr("id", "1L as base_id", "concat('Old Mill, lower bay, Worm. ', id) as rest")
    frame = split_places(rows, catalog[0], catalog[1].drop("type"))
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "SortMergeJoin" not in plan and "hashpartitioning(id" not in plan and "explode" not in plan


def test_text_behind_places_is_read_once(spark, catalog, monkeypatch):
    """Texts that rows share are read once a text, and null ones and those of a large set come back to all their rows."""
    from castline.operators import lines

    said = ["Worm. 2 удочка", "Fly No. 5 ср/м 3.20 чат", "odd. 5 чат"]
    written = spark.createDataFrame([(i, f"Pike {i + 1} грамм. Поймана на Lake: Old Mill, {said[i % 3]}") for i in range(40)] + [(50, "no line"), (51, None), (52, "Pike 1 грамм. Поймана на Lake: Old Mill, ")], "id long, line string")
    names = lambda rows: spark.createDataFrame(rows, "name_id long, name string")
    seen, read = [], lines.parsed_observations
    monkeypatch.setattr(lines, "parsed_observations", lambda rows, *given: seen.append(rows.count()) or read(rows, *given))
    parse = lambda **kept: parse_reports(written, names([(7, "Pike")]), names([(1, "Lake")]), *catalog, ["чат", "удочка"], **kept)
    shown = lambda: {r["id"]: (r["grams"], r["place_id"], r["bait_id"], r["bait_text"], r["depth_cm"], r["spot"], r["unresolved"]) for r in parse().collect()}
    got = shown()
    assert seen == [4] and len(got) == 43
    assert got[0] == (1, 10, 1, "Worm", 200, "удочка", []) and got[37] == (38, 10, 3, "Fly No. 5", 320, "чат", []) and got[38] == (39, 10, None, "odd", 500, "чат", [])
    assert got[50] == got[51] == (None,) * 6 + ([],) and got[52] == (1, 10, None, None, None, None, [])
    monkeypatch.setattr(lines, "NEAR_TEXTS", 0)
    assert shown() == got
    assert "id" not in parse(with_id=False).columns


def test_lines_that_hold_what_parts_them(spark):
    from castline.operators.lines import PARTED, parts_of_line

    cases = {f"a{PARTED}b 1,250 кг. Поймана на L: p, q": [f"a{PARTED}b", "1,250", "кг", "L", "p, q"], PARTED * 4: None, "": None, None: None, "a 5 кг. Поймана на b: Pike 2 кг. Поймана на L: x": ["a 5 кг. Поймана на b: Pike", "2", "кг", "L", "x"], " 5 грамм. Поймана на : ": ["", "5", "грамм", "", ""]}
    rows = spark.createDataFrame([(line,) for line in cases], "line string").coalesce(1)
    assert [r[0] for r in rows.select(parts_of_line(rows["line"])).collect()] == list(cases.values())


def test_kilograms_are_exact_or_null(spark):
    lines = ["1,250", "5", "2147483,647", "2147483,648", "9999999999", "0000000001,250", "00000000001,250", "9" * 30]
    written = spark.createDataFrame([(i, f"Pike {n} кг. Поймана на L: x") for i, n in enumerate(lines)], "id long, line string")
    none = lambda columns: spark.createDataFrame([], columns)
    got = parse_reports(written, none("name_id long, name string"), none("name_id long, name string"), none("base_id long, name_id long, name string"), none("name_id long, name string, type string"), [])
    assert [r["grams"] for r in got.orderBy("id").collect()] == [1250, 5000, 2147483647, None, None, 1250, None, None]
