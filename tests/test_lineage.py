"""Chains, cycles, and every reason that blocks a recovery."""

import pytest

from castline.operators.lineage import followed, recovered


def test_chains_and_cycles(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 102), (102, 100), (103, 100), (200, 201), (201, 200), (300, 300), (None, 1)]
    got = {r["fish_id"]: (r["target_id"], r["cyclic"]) for r in followed(spark.createDataFrame(links, "fish_id long, target_id long")).collect()}
    assert got == {i: (40, False) for i in range(1, 40)} | {i: (None, True) for i in (100, 101, 102, 103, 200, 201)}
    assert followed(spark.createDataFrame([], "fish_id long, target_id long")).count() == 0


FISH = [(1, "Pike", True), (2, "Great Pike", True), (3, "Old", False), (4, "Twin", True), (5, "twin", True), (6, "Eel", True)]
LINEAGE = [(1, "Pike", None, None), (7, "Small Pike", 2, "Great Pike"), (8, "Lost", 99, "Gone"), (9, "Aged", 3, "Old"), (10, "One", 4, "Twin"), (11, "Ring", 12, "Ring"), (12, "Ring", 11, "Ring"), (13, "Two", 1, "Pike"), (13, "Two", 2, "Pike"), (14, "Eely", 6, "Another"), (15, "Far", 7, "Great Pike")]
# key, own name, id and name before -> fish, route, blocked
CASES = [
    ("a", "pike", 1, "Pike", 1, "EXACT", None),
    ("b", "tiny pike", 7, "Small Pike", 2, "LINEAGE", None),
    ("c", "tiny pike", 15, "Far", 2, "LINEAGE", None),
    ("d", "Pike", None, None, 1, "EXACT", None),
    ("e", "nothing", None, None, None, "UNRESOLVED", None),
    ("f", None, None, None, None, "UNRESOLVED", None),
    ("g", "Pike", 50, "Unknown", None, None, "NO_LINEAGE"),
    ("h", "Pike", 1, "Perch", None, None, "NAME_DRIFT"),
    ("i", "x", 8, "Lost", None, None, "TARGET_ABSENT"),
    ("j", "x", 9, "Aged", None, None, "TARGET_ABSENT"),
    ("k", "x", 10, "One", None, None, "TARGET_AMBIGUOUS"),
    ("l", "x", 11, "Ring", None, None, "CYCLE"),
    ("m", "x", 13, "Two", None, None, "REPEATED_LINEAGE"),
    ("n", "Pike", 7, "Small Pike", None, None, "EXACT_CONFLICT"),
    ("o", "x", 14, "Eely", None, None, "TARGET_RENAMED"),
    ("p", "Pike", 1, None, None, None, "INCOMPLETE_IDENTITY"),
]


@pytest.fixture(scope="module")
def got(spark):
    parsed = spark.createDataFrame([(c[0], c[1]) for c in CASES] + [("twice", "Pike"), ("twice", "Pike"), ("new", "Pike")], "import_key string, fish string")
    previous = spark.createDataFrame([(c[0], c[2], c[3]) for c in CASES] + [("twice", 1, "Pike"), ("gone", 1, "Pike")], "import_key string, was_id long, was_name string")
    out = recovered(parsed, previous, spark.createDataFrame(LINEAGE, "fish_id long, name string, target_id long, target_name string"), spark.createDataFrame(FISH, "name_id long, name string, is_active boolean"))
    return {r["import_key"]: (r["fish_id"], r["route"], r["blocked"]) for r in out.collect()}


@pytest.mark.parametrize("case", CASES, ids=lambda c: c[0])
def test_case(got, case):
    assert got[case[0]] == case[4:]


def test_keys_of_one_side(got):
    assert (got["twice"], got["new"], got["gone"]) == ((None, None, "REPEATED_KEY"), (None, None, "UNEXPECTED_KEY"), (None, None, "MISSING_KEY"))
