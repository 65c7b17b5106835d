import pytest
from compare import oracle, rows

import __spark_entry__ as entry
from castline.plans import registry

NAMES = sorted(registry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, sf_dir, name):
    frame = entry.queries()[name](spark, sf_dir).toPandas()
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert len(frame)
        return
    expected = oracle(sf_dir, sql)
    assert sorted(frame.columns) == sorted(expected.columns)
    assert rows(frame) == rows(expected)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
