"""Periodic runs against a brute-force search, with hashes that collide, over odd tables."""

import random

import numpy as np
import pyarrow as pa
import pytest
from corpus import SCHEMA, documents, words
from pyspark.sql import functions as F

from castline.llm import periodic_runs
from castline.llm.textscan import Words


def brute(w, least=24, repeats=3):
    """Every maximal stretch of every period; of equal stretches the smallest period."""
    best = {}
    for p in range(1, len(w) // repeats + 1):
        i = 0
        while i < len(w) - p:
            if w[i] != w[i + p]:
                i += 1
                continue
            j = i
            while j < len(w) - p and w[j] == w[j + p]:
                j += 1
            if j - i + p >= max(least, repeats * p):
                best.setdefault((i, j - i + p), p)
            i = j
    return sorted(((s, n, p) for (s, n), p in best.items()), key=lambda r: (r[0], r[2]))


def kept(w, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def periodic_texts(seed, n=120):
    """Random words of small alphabets with repeated blocks, some blocks repeated with a change, nested and touching runs."""
    rng = random.Random(seed)
    out = [None, "", "a", " ".join(["the"] * 400), " ".join(["a", "b"] * 40), " ".join(["x"] * 23), " ".join(["x"] * 24), "é　 É é " * 30]
    for _ in range(n):
        text = []
        for _ in range(rng.randint(1, 5)):
            block = [rng.choice("abcd"[: rng.randint(1, 4)]) for _ in range(rng.randint(1, 12))]
            times = rng.randint(1, 9)
            part = block * times + block[: rng.randint(0, len(block))]
            if part and rng.random() < 0.3:
                part[rng.randrange(len(part))] = "z"
            text += part
        out.append((" " if rng.random() < 0.5 else "\n\t").join(text))
    return out


@pytest.mark.parametrize("least, repeats", [(24, 3), (1, 3), (10, 2), (30, 4)])
def test_runs_of_a_slice(least, repeats):
    texts = periodic_texts(1)
    found = periodic_runs.runs_of(Words(pa.array(texts, pa.string())), least, repeats)
    assert found == [brute(words(t), least, repeats) for t in texts]


def test_equal_hashes_of_different_words():
    texts = periodic_texts(2)
    w = Words(pa.array(texts, pa.string()))
    for bits in (0, 1):
        weak = w.hash & np.uint64(bits)
        assert periodic_runs.runs_of(w, 24, 3, weak) == [brute(words(t)) for t in texts]


def test_pairs_in_small_steps(monkeypatch):
    monkeypatch.setattr(periodic_runs, "PAIRS", 7)
    texts = periodic_texts(3, 30)
    assert periodic_runs.runs_of(Words(pa.array(texts, pa.string())), 24, 3) == [brute(words(t)) for t in texts]


def test_collapse(spark):
    texts = periodic_texts(4)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in periodic_runs.collapse_runs(docs).withColumn("best", periodic_runs.strongest(F.col("runs"))).collect()}
    for i, t in enumerate(texts):
        w = words(t)
        runs = brute(w)
        assert [tuple(r) for r in got[i]["runs"]] == runs and got[i]["n_words"] == len(w) and got[i]["kept"] == kept(w, runs)
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
        assert (got[i]["best"] and tuple(got[i]["best"])) == best


def test_null_and_repeated_keys_clashing_columns_empty_table(spark):
    rows = [(None, "a b " * 20, "en", "s", 1), (1, "a b " * 20, "en", "s", 1), (1, "a b " * 20, "en", "s", 1), (2, None, None, None, None)]
    frame = spark.createDataFrame(rows, SCHEMA)
    for name in ("key", "runs", "kept", "n_words", "best"):
        frame = frame.withColumn(name, F.lit("x"))
    got = periodic_runs.collapse_runs(frame).collect()
    assert sorted((r["doc_id"] or 0, len(r["runs"]), r["kept"]) for r in got) == [(0, 1, "a b"), (1, 1, "a b"), (1, 1, "a b"), (2, 0, "")]
    assert periodic_runs.collapse_runs(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_very_long_text(spark):
    text = " ".join(f"w{i}" for i in range(200_000)) + " x y z" * 50_000
    got = periodic_runs.collapse_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [tuple(r) for r in got["runs"]] == [(200_000, 150_000, 3)] and got["n_words"] == 350_000 and got["kept"].endswith("w199999 x y z")


def test_looped_tails(spark):
    import zlib

    rows = [(i, t) for i, t, *_ in documents()] + [(None, "a b c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["new"] for r in docs.select("doc_id", periodic_runs.looped(F.col("text"), F.col("doc_id")).alias("new")).collect()}
    changed = 0
    for i, t in rows:
        h, w = zlib.crc32(str(i).encode()), words(t)
        if i is None or h % 10 or not w:
            assert got[i] == t
            continue
        n, g = len(w), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        assert got[i] == " ".join(w[j] if j < a else w[a + (j - a) % p] for j in range(n))
        changed += 1
    assert changed
