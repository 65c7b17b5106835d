"""What players write, case by case, and the spans that were read."""

import pytest

from castline.operators.observations import anchor_tokens, parsed_observations

ANCHORS = ["удочка", "леска", "блокнот", "чат"]
LURE, BAIT = "SPINNING", "BAIT_FISHING"

# text, method -> depth, spot, note, size, speed, comment, unresolved
CASES = [
    ("ямка 6,00 удочка", BAIT, (600, "удочка", None, None, None, None, [])),
    ("яма 6,00 удочка", BAIT, (600, "удочка", None, None, None, None, [])),
    ("ямка 7,63 вполводы", BAIT, (763, None, "MIDWATER", None, None, None, [])),
    ("ямка 5,55 блокнот вполводы", BAIT, (555, "блокнот", "MIDWATER", None, None, None, [])),
    ("12 со  дна", None, (1200, None, "FROM_BOTTOM", None, None, None, [])),
    ("Поверху вполводы", BAIT, (None, None, "MIDWATER", None, None, None, ["Поверху"])),
    ("бол\\м", LURE, (None, None, None, "LARGE", "SLOW", None, [])),
    ("(бол/м)", LURE, (None, None, None, "LARGE", "SLOW", None, [])),
    ("( Большая / БЫСТРО ), дальше", LURE, (None, None, None, "LARGE", "FAST", None, ["дальше"])),
    ("ср. медл", LURE, (None, None, None, "MEDIUM", "SLOW", None, [])),
    ("ср., проводка медленная", LURE, (None, None, None, "MEDIUM", "SLOW", None, [])),
    ("средняя, проводка медленная", LURE, (None, None, None, "MEDIUM", "SLOW", None, [])),
    ("сред на средн пров", LURE, (None, None, None, "MEDIUM", "MEDIUM", None, [])),
    ("сред на сред пров", LURE, (None, None, None, None, None, None, ["сред на сред пров"])),
    ("сред на средн провод", LURE, (None, None, None, None, None, None, ["сред на средн провод"])),
    ("ср/м", None, (None, None, None, None, None, None, ["ср/м"])),
    ("ср\\м 10.78 чат", LURE, (1078, "чат", None, "MEDIUM", "SLOW", None, [])),
    ("3.61 уда-леска надпись нахлыст.", BAIT, (361, "уда-леска надпись нахлыст", None, None, None, None, [])),
    ("(4.65 над леской)", BAIT, (465, "над леской", None, None, None, None, [])),
    ("6.98 над д.катушки/леска", BAIT, (698, "над д.катушки/леска", None, None, None, None, [])),
    ("5.55 над даные/удочкалеска", BAIT, (555, "над даные/удочкалеска", None, None, None, None, [])),
    ("(7.38 над рюкзак/данные бол/м)", LURE, (738, "над рюкзак/данные", None, "LARGE", "SLOW", None, [])),
    ("(7.38 над рюкзак/данные бол\\м)", LURE, (738, "над рюкзак/данные", None, "LARGE", "SLOW", None, [])),
    ("(4.65 над леской)", LURE, (465, "над леской", None, None, None, None, [])),
    ("(7.38 над рюкзак бол/м данные)", LURE, (738, "над рюкзак бол/м данные", None, None, None, None, [])),
    ("(забр 5.17 над леской ср\\м)", LURE, (517, "над леской", None, "MEDIUM", "SLOW", None, ["забр"])),
    ("забр 5.17 над камнем", BAIT, (517, None, None, None, None, None, ["забр", "над камнем"])),
    ("5.17 над камнем. Там глубоко", BAIT, (517, None, None, None, None, None, ["над камнем", "Там глубоко"])),
    ("5.17 над камнем вполводы", BAIT, (517, None, "MIDWATER", None, None, None, ["над камнем"])),
    ("4.65 над леской 5.55 над удочкой", BAIT, (None, None, None, None, None, None, ["4", "65 над леской 5", "55 над удочкой"])),
    ("14.68 блокнот.игродень.", BAIT, (1468, "блокнот", None, None, None, None, ["игродень"])),
    ("-6,00 чат", BAIT, (None, "-6,00 чат", None, None, None, None, [])),
    ("6,001 чат", BAIT, (None, "6,001 чат", None, None, None, None, [])),
    ("99999999999 чат", BAIT, (None, "99999999999 чат", None, None, None, None, [])),
    ("0 чат", BAIT, (None, "0 чат", None, None, None, None, [])),
    ("ср., проводка медленная.\nПоймал сразу, первую. Наверное, повезло)", LURE, (None, None, None, "MEDIUM", "SLOW", "Поймал сразу, первую. Наверное, повезло)", [])),
    ("ср., проводка медленная. Поймал сразу, первую.", LURE, (None, None, None, "MEDIUM", "SLOW", "Поймал сразу, первую.", [])),
    ("ср/м. поймал", LURE, (None, None, None, "MEDIUM", "SLOW", None, ["поймал"])),
    ("ср\n/ м 7 чат", LURE, (700, "чат", None, "MEDIUM", "SLOW", None, [])),
    ("просто\r\nтекст 7", LURE, (700, None, None, None, None, None, ["просто\r\nтекст"])),
    ("\nямка 6,00 удочка", BAIT, (600, "удочка", None, None, None, None, [])),
    (" 　; ", BAIT, (None, None, None, None, None, None, [])),
    ("", LURE, (None, None, None, None, None, None, [])),
    (None, LURE, (None, None, None, None, None, None, [])),
    ("\U0001f3a3 чат; ещё, чат", BAIT, (None, "\U0001f3a3 чат", None, None, None, None, ["ещё, чат"])),
]


@pytest.fixture(scope="module")
def parsed(spark):
    frame = spark.createDataFrame([(i, t, m) for i, (t, m, _) in enumerate(CASES)], "id long, written string, method string")
    return {r["id"]: r for r in parsed_observations(frame, "written", "method", ANCHORS).collect()}


@pytest.mark.parametrize("i", range(len(CASES)), ids=lambda i: repr(CASES[i][0]))
def test_case(parsed, i):
    r = parsed[i]
    assert (r["depth_cm"], r["spot"], r["fishing_note"], r["size"], r["speed"], r["user_note"], r["unresolved"]) == CASES[i][2]


def test_all_pairs_of_size_and_speed(spark):
    sizes = {"м": "SMALL", "мал": "SMALL", "ср": "MEDIUM", "сред": "MEDIUM", "б": "LARGE", "бол": "LARGE"}
    speeds = {"м": "SLOW", "медл": "SLOW", "ср": "MEDIUM", "сред": "MEDIUM", "б": "FAST", "быстр": "FAST"}
    rows = [(f"{a}{sep}{b}", LURE, x, y) for sep in "/\\" for a, x in sizes.items() for b, y in speeds.items()]
    for r in parsed_observations(spark.createDataFrame(rows, "written string, method string, x string, y string"), "written", "method", ANCHORS).collect():
        assert (r["size"], r["speed"], r["unresolved"]) == (r["x"], r["y"], [])


def test_inactive_anchors_name_nothing(spark):
    rows = spark.createDataFrame([("5 уда", BAIT), ("5 чат", BAIT)], "written string, method string")
    assert [(r["spot"], r["unresolved"]) for r in parsed_observations(rows, "written", "method", ["чат"]).collect()] == [(None, ["уда"]), ("чат", [])]
    assert [r["spot"] for r in parsed_observations(rows, "written", "method", []).collect()] == [None, None]
    assert anchor_tokens(["Удочка большая"]) == ["большая", "удочка"]


def test_plan_is_one_projection(spark):
    plan = parsed_observations(spark.range(5).selectExpr("cast(id as string) written", "'SPINNING' method"), "written", "method", ANCHORS)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_repeated_texts_are_read_once_and_rows_stay(spark):
    from castline.operators.observations import parsed_repeats

    said = ["ямка 6,00 удочка", "(бол/м)", None, "(4.65 над леской)"]
    rows = spark.createDataFrame([(i, said[i % 4], LURE if i % 3 else None) for i in range(40)] + [(7, said[0], BAIT), (7, said[0], BAIT)], "id long, t string, m string")
    shown = lambda d: sorted(map(repr, d.select("id", "t", "m", "depth_cm", "spot", "fishing_note", "size", "speed", "user_note", "unresolved", "spans").collect()))
    assert shown(parsed_repeats(rows, "t", "m", ANCHORS, 3)) == shown(parsed_observations(rows, "t", "m", ANCHORS))
