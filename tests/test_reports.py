"""Facts are dealt once by a group's key, and shared suffixes are not tried."""

import io
from contextlib import redirect_stdout

import pytest

import __spark_entry__ as entry


def plan(spark, sf_dir, name):
    out = io.StringIO()
    with redirect_stdout(out):
        entry.queries()[name](spark, sf_dir).explain()
    return out.getvalue()


@pytest.mark.parametrize("name", ["spot_statistics", "hole_statistics", "location_observations", "fish_catch_aggregates", "location_rows"])
def test_one_shuffle_of_facts(spark, sf_dir, name):
    shown = plan(spark, sf_dir, name)
    # distinct counts by rows repeated for each of them, or another exchange under a group, are gone
    assert "Expand" not in shown
    assert shown.count("REPARTITION_BY_NUM") == 1
    if name in ("spot_statistics", "hole_statistics"):
        assert shown.count("lineitem.parquet") == 1


def test_suffixes_of_no_names_length_stay_home(spark, sf_dir):
    # word counts of names join before the names do: a last word that many lines share is no key
    assert "BroadcastHashJoin [count" in plan(spark, sf_dir, "suffix_match")
