"""Phrases against brute-force counts, in both forms of ids, with few bits and small buffers, over odd tables."""

import collections
import random
import re

import numpy as np
import pytest
from corpus import SCHEMA, documents, low
from pyspark.sql import functions as F

from castline.llm.collocations import Sieve, collocations, radix_order, word_counts


def brute(rows, longest=3, least=10, share=50, top=2000):
    grams, totals = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang or "und"] += len(w)
            for k in range(1, longest + 1):
                grams[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in grams.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        around = collections.Counter()
        for p, a in candidates.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    around[p[i : i + k]] = max(around[p[i : i + k]], a)
        told = []
        for p, a in candidates.items():
            if 100 * around[p] >= share * a:
                continue
            score, _, left, right = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            told.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(told)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def rows_of(frame):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in frame.collect())


def texts(seed, n=60):
    rng = random.Random(seed)
    vocabulary = ["the", "The", "of", "new york", "new york city", "É", "a.b", "x,", "one\ntwo", "　", "far", "away", "far away", "zebra"]
    return [(rng.choice([None, "", *[" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 80)))] * 20]), rng.choice(["en", "fr", None, "und"])) for _ in range(n)] + [(t, lang) for _, t, lang, *_ in documents()]


@pytest.mark.parametrize(
    "longest, least, options",
    [(3, 10, {}), (4, 2, {"buffer": 37}), (3, 3, {"dense": 2}), (4, 4, {"dense": 2, "buffer": 100}), (3, 4, {"bits": 22}), (2, 2, {"top": 3}), (3, 2, {"share": 80})],
)
def test_phrases(spark, longest, least, options):
    rows = texts(longest * 7 + least)
    docs = spark.createDataFrame([(t, lang, i) for i, (t, lang) in enumerate(rows)], "text string, lang string, rank int").repartition(5)
    want = brute(rows, longest, least, options.get("share", 50), options.get("top", 2000))
    assert want and rows_of(collocations(docs, longest=longest, least=least, **options)) == want


def test_equal_hashes_take_another_seed(spark):
    rows = spark.createDataFrame([(" ".join(f"w{i}" for i in range(40)), "en")], "text string, lang string").select("lang", "text")
    words, seed = word_counts(rows, bits=9)
    assert seed > 0 and words.count() == words.select("h").distinct().count() == 40


def test_sieve(spark):
    rng = np.random.RandomState(3)
    values = rng.randint(-(2**63), 2**63 - 1, 3000, np.int64)
    frame = spark.createDataFrame([(int(v),) for v in values], "h long")
    others = rng.randint(-(2**63), 2**63 - 1, 3000, np.int64).view(np.uint64)
    whole, pages = Sieve.of(frame, "h", 3000), Sieve.of(frame, "h", 3000, most=10, bits=18)
    for sieve in (whole, pages):
        assert sieve.has(values.view(np.uint64)).all()
    assert not whole.has(others).any() and pages.has(others).mean() < 0.03
    assert (whole.values[whole.place(values.view(np.uint64))] == values.view(np.uint64)).all()


def test_radix_order():
    rng = np.random.RandomState(4)
    for kind in (np.uint32, np.uint64):
        columns = [rng.randint(0, 5, 500).astype(kind) << kind(rng.randint(0, 30)) for _ in range(3)]
        assert (radix_order(columns) == np.lexsort(columns[::-1])).all()


def test_clashing_columns_and_empty_table(spark):
    frame = spark.createDataFrame([(None, "a b. " * 12, "en", "s", 1), (1, None, None, None, None)], SCHEMA)
    for name in ("h", "w1", "n", "key", "score", "l", "rank"):
        frame = frame.withColumn(name, F.lit("x"))
    assert rows_of(collocations(frame)) == [("en", 1, "a b", 12, 12, 12, 24, 1_000_000)]
    assert collocations(spark.createDataFrame([], SCHEMA)).count() == 0
