"""The pipeline's stages against brute-force versions, over repeated and null ids, clashing names and empty tables."""

import collections
import random

import corpus_pipeline
import pytest
from corpus import SCHEMA, documents, words
from pyspark.sql import functions as F
from test_language_model import BruteModel
from test_text_operators import brute_components, brute_force_leaks, brute_shard

from castline.llm import language_id, mixing
from castline.llm.shared import with_row

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def told(frame):
    return collections.Counter(tuple(r[c] for c in COLUMNS) for r in frame.collect())


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Rows with a copy of an earlier text under an id that repeats, null ids, one text in two sources, and a benchmark item in three places."""
    folder = tmp_path_factory.mktemp("corpus")
    rows = [(i, t, "en" if lang is None else lang, s, n) for i, t, lang, s, n in documents(n=60)]
    rng = random.Random(9)
    own = " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(40))
    item = " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(30))
    rows += [
        (5, rows[3][1], "en", "s0", 1), (5, own, "en", "s0", 1),  # one id, a copy and a text of its own
        (None, item + " and more", "en", "s1", 1), (None, own + " x y z", "en", "s1", 1), (900, "some words " + item, "fr", None, 1),
        (901, " ".join(words(own)[::-1]), "en", "s0", 1), (901, " ".join(words(own)[::-1]), "en", "s1", 1), (902, " ".join(words(item)[::-1]), "en", "s2", 1), (902, " ".join(words(item)[::-1]), "en", "s2", 1),
    ]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None), (None, "no item")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), rows, own, item


def read(spark, corpus):
    return spark.read.parquet(f"{corpus[0]}/documents.parquet")


def test_rows_have_numbers_of_their_own(spark, corpus):
    first = {(r["n"], r["text"]) for r in with_row(read(spark, corpus), "n").collect()}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    again = {(r["n"], r["text"]) for r in with_row(read(spark, corpus), "n").collect()}
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert first == again and len({n for n, _ in first}) == len(first) == len(corpus[1])
    assert with_row(spark.createDataFrame(corpus[1], SCHEMA), "n").select("n").distinct().count() == len(corpus[1])


def test_language_stage(spark, corpus):
    docs = read(spark, corpus)
    model = language_id.train(docs, F.lit(True))
    brute = BruteModel([(t, lang) for _, t, lang, *_ in corpus[1] if t is not None])
    want = collections.Counter()
    for row in corpus[1]:
        h, n = brute.cross_entropy(row[1])
        if n:
            best = min(range(len(h)), key=h.__getitem__)
            if h[best] - model.mean[best] <= language_id.REJECT_Z * model.spread[best] / min(n, 400) ** 0.5:
                want[row] += 1
    assert told(corpus_pipeline.language_stage(spark, docs, corpus[0])) == want
    assert 0 < sum(want.values()) < len(corpus[1])


def test_near_duplicate_stage(spark, corpus):
    got = told(corpus_pipeline.near_duplicate_stage(spark, read(spark, corpus), corpus[0]))
    numbered = list(enumerate(corpus[1]))
    group = brute_components([(i, r[1]) for i, r in numbered], 5, 80, 100)
    groups = collections.defaultdict(collections.Counter)
    for i, r in numbered:
        groups[group[i][1]][r] += 1
    assert sum(got.values()) == len(groups)
    # one row of each group, and no other
    for rows in groups.values():
        mine = got & rows
        assert sum(mine.values()) >= 1
        got -= collections.Counter([next(iter(mine))])
    assert not got
    kept = {r[1] for r in told(corpus_pipeline.near_duplicate_stage(spark, read(spark, corpus), corpus[0]))}
    assert corpus[2] in kept or corpus[2] + " x y z" in kept


def test_decontamination_stage(spark, corpus):
    got = told(corpus_pipeline.decontamination_stage(spark, read(spark, corpus), corpus[0]))
    leaks = {pair[0] for pair in brute_force_leaks([(i, r[1]) for i, r in enumerate(corpus[1])], [(1, corpus[3])])}
    assert got == collections.Counter(r for i, r in enumerate(corpus[1]) if i not in leaks)
    assert len(leaks) == 2 and not any(corpus[3] in (r[1] or "") for r in got)


def test_mixing_stage(spark, corpus):
    docs = read(spark, corpus)
    got = told(corpus_pipeline.mixing_stage(spark, docs, corpus[0]))
    before = collections.Counter(corpus[1])
    assert set(got) <= set(before) and all(n <= 2 * before[r] for r, n in got.items())
    goals = {r["source_key"]: r["target"] for r in mixing.plan(docs).select("source_key", "target").distinct().collect()}
    taken = collections.Counter()
    for r, n in got.items():
        taken["null" if r[3] is None else "s" + r[3]] += n * len(words(r[1]))
    smallest = {s: min(len(words(r[1])) for r in before if r[1] and words(r[1]) and ("null" if r[3] is None else "s" + r[3]) == s) for s in goals}
    for s, goal in goals.items():
        # what is missing is less than any document that could still go in
        assert taken[s] <= goal + 1e-6 and goal - taken[s] < max(smallest[s], 400)


def test_sharding_stage(spark, corpus):
    out = corpus_pipeline.sharding_stage(spark, read(spark, corpus), corpus[0])
    assert told(out) == collections.Counter(corpus[1])
    for r in out.where("doc_id between 0 and 3").collect():
        assert r["shard"] == brute_shard([1.0] * corpus_pipeline.SHARDS, r["doc_id"], spark) and r["shard_size"] == len((r["text"] or "").encode()) + 8


def test_one_text_in_two_sources_is_mixed_as_planned(spark):
    rows = [(i, f"word{i} " * (10 + i), None, s, 1) for i in range(40) for s in ("a", "b")]
    docs = spark.createDataFrame(rows, SCHEMA)
    taken = mixing.mix_plan(docs).agg(F.sum(F.col("taken") / F.col("size")).cast("long")).first()[0]
    mixed = mixing.mix(docs)
    assert mixed.count() == taken and mixed.groupBy("doc_id", "source").count().agg(F.max("count")).first()[0] <= 2


def test_run_with_clashing_columns(spark, corpus, tmp_path):
    docs = read(spark, corpus)
    for name in ("key", "component", "h1", "block", "k", "copies", "_source", "_doc", "row", "mix_shard", "shard", "node", "pipeline-path"):
        docs = docs.withColumn(name, F.lit("x"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{corpus[0]}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns[: len(docs.columns)] == docs.columns and {"shard_2", "shard_size"} <= set(out.columns)
    rows = out.collect()
    assert rows and all(r["block"] == "x" and r["shard"] == "x" and 0 <= r["shard_2"] < 24 for r in rows)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
