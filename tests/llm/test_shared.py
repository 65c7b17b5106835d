import random
import re

import pytest

from castline.llm import shared
from castline.llm.shared import components


def test_cc(spark):
    rng=random.Random(0)
    for n,m in ((50,30),(300,200),(100,99)):
        e=[(i,i+1) for i in range(99)] if m==99 else [(rng.randrange(n),rng.randrange(n)) for _ in range(m)]
        got={r[0]:r[1] for r in components(spark.createDataFrame(e+[(None,3),(7,7)],"a long, b long"),"t").collect()}
        p={}
        def f(x):
            p.setdefault(x,x)
            while p[x]!=x: x=p[x]
            return x
        for a,b in e:
            if a!=b:
                a,b=sorted((f(a),f(b))); p[b]=a
        assert got=={x:f(x) for x in p}


def test_a_stored_table_leaves_no_shuffle_files_and_the_session_as_it_was(spark):
    from castline.llm.shared import SHUFFLE_CLEANUP, stored
    before = spark.conf.get(SHUFFLE_CLEANUP)
    got = stored(spark.range(100).selectExpr("id % 7 AS k").groupBy("k").count(), "t")
    assert spark.conf.get(SHUFFLE_CLEANUP) == before
    assert {r["k"]: r["count"] for r in got.collect()} == {k: len(range(k, 100, 7)) for k in range(7)}


def told_by(spark, work):
    """What work returns, and the plans that Spark ran for it, as text."""
    tracked = spark._jsparkSession.sharedState().statusStore()
    done = tracked.executionsCount()
    out = work()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    runs = tracked.executionsList(int(done), 1000)
    return out, [runs.apply(i).physicalPlanDescription() for i in range(runs.size())]


@pytest.mark.parametrize("limit", [200_000, 0])
def test_a_round_of_components_is_a_small_plan(spark, monkeypatch, limit):
    """Chains up, down and mixed, and a hub: what the driver plans for a round stays a few exchanges, broadcast or shuffled."""
    monkeypatch.setattr(shared, "LABEL_ROWS", limit)
    mixed = list(range(1000, 1200))
    random.Random(3).shuffle(mixed)
    edges = [(i, i + 1) for i in range(299)] + [(i + 501, i + 500) for i in range(299)] + list(zip(mixed, mixed[1:])) + [(5000, i) for i in range(4000, 4300)]
    table = spark.createDataFrame(edges, "a long, b long").repartition(3)
    got, plans = told_by(spark, lambda: {r[0]: r[1] for r in components(table, "t").collect()})
    want = {i: 0 for i in range(300)} | {i: 500 for i in range(500, 800)} | {i: 1000 for i in mixed} | {i: 4000 for i in [5000, *range(4000, 4300)]}
    assert got == want
    assert len(plans) > 4 and max(len(re.findall(r"Exchange \(\d+\)", p)) for p in plans) <= 30


def test_components_of_nothing(spark):
    assert not components(spark.createDataFrame([(None, 1), (2, 2)], "a long, b long"), "t").collect()
