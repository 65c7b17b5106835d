"""Candidates case by case: what resolves, what blocks, what only lacks."""

import pytest

from castline.operators.candidates import resolved

FIELDS = "contributor_key string, import_key string, fish string, base string, place string, bait string, weight_grams long, method string, hole_depth_cm int, spinning_size string, spinning_speed string, spot string, user_note string, parse_issues array<struct<code:string,field:string>>"
GOOD = dict(contributor_key="external:1", import_key="imp:1", fish="Pike", base="Lake", place="Mill", bait="Worm", weight_grams=10, method=None, hole_depth_cm=None, spinning_size=None, spinning_speed=None, spot=None, user_note=None, parse_issues=None)

# changes -> status, issues
CASES = [
    ({}, "USABLE_COMPLETE", []),
    ({"fish": " PIKE "}, "USABLE_COMPLETE", []),
    ({"fish": None, "weight_grams": None}, "USABLE_PARTIAL", [("MISSING_FISH", "fish"), ("MISSING_WEIGHT_GRAMS", "weight_grams")]),
    ({"fish": "Carp"}, "UNRESOLVED", [("UNRESOLVED_FISH", "fish")]),
    ({"fish": "Twin"}, "UNRESOLVED", [("UNRESOLVED_FISH", "fish")]),
    ({"fish": "Old"}, "UNRESOLVED", [("UNRESOLVED_FISH", "fish")]),
    ({"fish": "--"}, "UNRESOLVED", [("UNRESOLVED_FISH", "fish")]),
    ({"fish": "Eel"}, "UNRESOLVED", [("MISSING_MEMBERSHIP", "base_fish")]),
    ({"base": None}, "UNRESOLVED", [("MISSING_BASE", "base"), ("UNRESOLVED_PLACE", "place")]),
    ({"base": None, "place": None}, "USABLE_PARTIAL", [("MISSING_BASE", "base"), ("MISSING_PLACE", "place")]),
    ({"base": "River", "fish": "Eel"}, "USABLE_COMPLETE", []),
    ({"place": "Bay"}, "UNRESOLVED", [("UNRESOLVED_PLACE", "place")]),
    ({"bait": "Fly", "spinning_size": "SMALL", "spinning_speed": "FAST"}, "USABLE_COMPLETE", []),
    ({"spinning_size": "SMALL", "spinning_speed": "FAST"}, "UNRESOLVED", [("INVALID_SPINNING_SIZE_FOR_METHOD", "spinning_size"), ("INVALID_SPINNING_SPEED_FOR_METHOD", "spinning_speed")]),
    ({"method": "SPINNING"}, "UNRESOLVED", [("FISHING_METHOD_CONFLICT", "method")]),
    ({"method": "BAIT_FISHING"}, "USABLE_COMPLETE", []),
    ({"bait": None, "method": "SPINNING"}, "UNRESOLVED", [("FISHING_METHOD_CONFLICT", "method"), ("MISSING_BAIT", "bait")]),
    ({"contributor_key": None}, "UNRESOLVED", [("MISSING_EXTERNAL_MEMBER_ID", "contributor_key")]),
    ({"contributor_key": "local"}, "UNRESOLVED", [("INVALID_CONTRIBUTOR_KEY", "contributor_key")]),
    ({"import_key": None}, "UNRESOLVED", [("INVALID_IMPORT_KEY", "import_key")]),
    ({"weight_grams": 0}, "UNRESOLVED", [("INVALID_WEIGHT_GRAMS", "weight_grams")]),
    ({"hole_depth_cm": 0}, "UNRESOLVED", [("INVALID_HOLE_DEPTH_CM", "hole_depth_cm")]),
    ({"spot": " "}, "UNRESOLVED", [("INVALID_SPOT", "spot")]),
    ({"user_note": "x" * 1001}, "UNRESOLVED", [("INVALID_USER_NOTE", "user_note")]),
    ({"user_note": "a​b"}, "UNRESOLVED", [("INVALID_USER_NOTE", "user_note")]),
    ({"parse_issues": [("ODD", "spot")]}, "USABLE_COMPLETE", [("ODD", "spot")]),
    ({"parse_issues": [("ODD", None)]}, "UNRESOLVED", [("ODD", None)]),
    ({"parse_issues": [("MISSING_FISH", "fish")], "fish": None}, "UNRESOLVED", [("MISSING_FISH", "fish")]),
]


@pytest.fixture(scope="module")
def got(spark):
    names = lambda rows: spark.createDataFrame(rows, "name_id long, name string, is_active boolean")
    rows = spark.createDataFrame([(i, *(GOOD | change).values()) for i, (change, *_) in enumerate(CASES)], "i int, " + FIELDS)
    out = resolved(
        rows, names([(1, "Pike", True), (2, "Twin", True), (3, "twin", True), (4, "Old", False), (5, "Eel", True)]), names([(1, "Lake", True), (2, "River", True)]),
        spark.createDataFrame([(1, 10, "Mill", True), (2, 20, "Mill", True), (2, 21, "Bay", True)], "base_id long, name_id long, name string, is_active boolean"),
        spark.createDataFrame([(1, "Worm", "BAIT", True), (2, "Fly", "LURE", True)], "name_id long, name string, type string, is_active boolean"), spark.createDataFrame([(1, 1), (2, 5)], "base_id long, fish_id long"),
    )
    return {r["i"]: r for r in out.collect()}


@pytest.mark.parametrize("i", range(len(CASES)), ids=lambda i: repr(CASES[i][0]))
def test_case(got, i):
    assert (got[i]["status"], [tuple(x) for x in got[i]["issues"]]) == CASES[i][1:]


def test_places_count_inside_their_base(got):
    assert (got[0]["place_id"], got[10]["place_id"]) == (10, 20) and got[8]["place_reason"] == "DEPENDENCY_UNRESOLVED" and got[11]["place_reason"] == "NOT_FOUND"
