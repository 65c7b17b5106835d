import pytest
from pyspark.sql import functions as F

from castline.functions import classify, paging
from castline.operators.reports import FEED, feed
from castline.plans.tables import Tables
from castline.sources.html import _Blocks


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "grams"), [("1,234 кг", 1234), ("40 г", 40), ("40 гр", 40), ("40 грамм", 40), ("0,5 кг", 500), ("1,2345 кг", None), ("x", None), ("", None), (None, None)]
)
def test_grams(spark, text, grams):
    assert value(spark, classify.grams(F.lit(text).cast("string"))) == grams


@pytest.mark.parametrize(("moment", "start"), [("2026-09-06 18:59:59.999", "2026-08-30 19:00:00"), ("2026-09-06 19:00:00", "2026-09-06 19:00:00")])
def test_week_starts_on_sunday_evening(spark, moment, start):
    assert str(value(spark, classify.week_start(F.lit(moment).cast("timestamp")))) == start


@pytest.mark.parametrize(("w", "low", "high", "kind"), [(10, 20, 100, "SUSPICIOUS_LOW"), (105, 20, 100, "MUTANT"), (106, 20, 100, "SUSPICIOUS_HIGH"), (50, 20, 100, "ORDINARY"), (50, None, 100, "UNCLASSIFIED")])
def test_weight_class(spark, w, low, high, kind):
    as_int = lambda x: F.lit(x).cast("int")
    assert value(spark, classify.weight_class(as_int(w), as_int(low), as_int(high))) == kind


def test_cursor_is_canonical():
    cursor = paging.encode_cursor("feed", {"id": 5})
    assert paging.decode_cursor("feed", cursor, {"id": int}) == {"id": 5}
    for bad in (cursor + "A", "!!", paging.encode_cursor("other", {"id": 5}), paging.encode_cursor("feed", {"id": "5"}), paging.encode_cursor("feed", {"id": 5, "x": 1})):
        with pytest.raises(ValueError, match="cursor"):
            paging.decode_cursor("feed", bad, {"id": int})


def test_pages_concatenate_to_the_whole(spark, sf_dir):
    t = Tables(spark, sf_dir)
    user = t.report.groupBy("user_id").count().orderBy(F.desc("count")).first()["user_id"]
    everything = [r["report_id"] for r in t.report.where(F.col("user_id") == user).orderBy(*paging.ordering(FEED)).collect()]
    seen, cursor = [], None
    while True:
        page = feed(t, limit=17, cursor=cursor, user_id=user).collect()
        seen += [r["report_id"] for r in page[:17]]
        if len(page) <= 17:
            break
        cursor = {"created_at": page[16]["created_at"], "report_id": page[16]["report_id"]}
    assert seen == everything


def test_html_blocks_skip_quotes():
    parser = _Blocks()
    parser.feed("<h1>A &amp; B</h1><p>one <b>two</b></p><blockquote><p>no</p></blockquote><script>x</script><li>three")
    parser.close()
    parser.close_block()
    assert [t for _, t in parser.found] == ["A & B", "one two", "three"]


def test_boundary_of_a_dense_cluster(spark):
    import random

    from castline.operators.inference import infer_boundaries

    rng = random.Random(1)
    dense = [(1, 9000 + i * 10, i % 4, i % 5) for i in range(201)] * 2 + [(1, rng.randrange(1000, 9000), 1, 1) for _ in range(100)]
    tail = [(1, 12000, 1, 1), (1, 13500, 1, 1), (1, 15000, 2, 2)]
    sparse = [(2, 100 * i, 1, 1) for i in range(10)]
    frame = spark.createDataFrame(dense + tail + sparse, "pair int, weight_grams int, location_id int, bait_id int")
    got = {r["pair"]: r for r in infer_boundaries(frame, ["pair"]).collect()}
    assert (got[1]["boundary"], got[1]["tail_rows"], got[1]["confidence"]) == (11000, 3, "HIGH")
    assert (got[2]["boundary"], got[2]["confidence"]) == (None, "LOW")
