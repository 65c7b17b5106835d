"""Context-tree weighting against block probabilities counted one bit at a time, and the query's scores against it."""

import collections
import math
import random
import zlib

import numpy as np
import pytest
from corpus import SCHEMA, low, words
from pyspark.sql import functions as F

from castline.llm import ctw, lm_scoring


def pairs_of(texts, depth):
    out = []
    for t in texts:
        coded = b"\xff" * depth + " ".join(words(low(t))).encode() + b"\xff"
        out += [(coded[i - depth : i], coded[i]) for i in range(depth, len(coded))]
    return out


def kept_contexts(pairs, depth, least):
    seen = collections.Counter(h[len(h) - d :] for h, _ in pairs for d in range(1, depth + 1))
    return {c for c, n in seen.items() if n >= least}


def single(pairs, kept, history, byte, depth):
    """log10 probability of one byte after the pairs, by the ratio of weighted block probabilities."""

    def kt(sub, node):
        bits = [(x >> (7 - node[0])) & 1 for _, x in sub if x >> (8 - node[0]) == node[1]]
        a, c = bits.count(0), bits.count(1)
        return math.lgamma(a + 0.5) + math.lgamma(c + 0.5) - math.lgamma(a + c + 1) - math.log(math.pi)

    def ln_pw(sub, node, context):
        d = len(context)
        children = {bytes([o]) + context for o in range(256)} & kept if d < depth else set()
        if not children:
            return kt(sub, node)
        parts = collections.defaultdict(list)
        for h, x in sub:
            older = h[depth - d - 1 :]
            parts[older if older in children else None].append((h, x))
        split = sum(kt(part, node) if c is None else ln_pw(part, node, c) for c, part in parts.items())
        return np.logaddexp(kt(sub, node), split) - math.log(2)

    total = 0.0
    for b in range(8):
        node = (b, byte >> (8 - b))
        total += ln_pw([*pairs, (history, byte)], node, b"") - ln_pw(pairs, node, b"")
    return total / math.log(10)


TEXTS = ["abab ba", "abba  ABBA", "baab ab", "", "abc é", "ba ab ba ab", "zz", "abab ba", None, "c"]


@pytest.mark.parametrize(("depth", "least", "subtree", "hot"), [(3, 2, 1 << 16, 1 << 20), (3, 1, 3, 5), (4, 2, 2, 0), (5, 3, 4, 10)])
def test_scores_equal_weighted_block_probabilities(spark, depth, least, subtree, hot):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["score"] for r in lm_scoring.score_texts(docs, F.col("doc_id") % 3 == 1, depth=depth, least=least, subtree=subtree, bundle=2 * subtree, hot=hot).collect()}
    pairs = pairs_of([t for i, t in enumerate(TEXTS) if i % 3 != 1], depth)
    kept = kept_contexts(pairs, depth, least)
    for i, t in enumerate(TEXTS):
        want = sum(single(pairs, kept, h, x, depth) for h, x in pairs_of([t], depth))
        assert math.isclose(got[i], want, rel_tol=1e-5), (i, t)


def test_bytes_sum_to_one():
    rng = np.random.RandomState(0)
    depth = 4
    grams = np.unique(rng.choice([97, 98, 99, 32], (400, depth + 1)) @ (256 ** np.arange(depth, -1, -1)))
    n = rng.randint(1, 5, len(grams))
    first, total = ctw.summed(grams >> 8 * depth, n)
    dense = np.zeros((len(first), 256), np.int64)
    np.add.at(dense, (ctw.place(first, grams >> 8 * depth)[0], grams & 255), n)
    tree = ctw.Subtree(grams, n, 2, depth, 2)
    sums, kept = np.zeros((len(first), 255)), np.zeros((len(first), 256), np.int64)
    for p, c, v in zip(*tree.upward()):
        row = ctw.place(first, np.array([p]))[0][0]
        (sums if c < 256 else kept)[row, c % 256] += v
    tree.settle(ctw.Upper({0: np.zeros(1, np.int64), 1: first}, {0: dense.sum(0)[None], 1: dense}, {0: np.zeros((1, 255)), 1: sums}, {0: np.zeros((1, 256), np.int64), 1: kept}))
    contexts = rng.choice([97, 98, 99, 32, 120], (60, depth)) @ (256 ** np.arange(depth - 1, -1, -1))
    logs = tree.score((contexts[:, None] << 8 | np.arange(256)).ravel())
    assert np.allclose((10**logs).reshape(-1, 256).sum(1), 1)


def test_log_gamma():
    x = np.array([0.5, 1, 2.5, 7, 100.5, 1e6])
    assert np.allclose(ctw.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-10, atol=1e-9)
    assert np.allclose(ctw.log_kt(np.array([3, 200_000]), np.array([1, 70_000])), [math.lgamma(a + 0.5) + math.lgamma(c + 0.5) - math.lgamma(a + c + 1) - math.log(math.pi) for a, c in ((2, 1), (130_000, 70_000))], rtol=1e-9)


def test_the_model_grows_with_the_corpus_and_beats_the_base(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice(["ber", "ta", "lo", "schi", "in", "ei", "mo", "ka"]) for _ in range(3))
    phrases = [" ".join(word() for _ in range(6)) for _ in range(40)]
    texts = [(i, " ".join(rng.choice(phrases) for _ in range(20))) for i in range(500)]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    out = lm_scoring.score_texts(frame, F.pmod(lm_scoring.id_crc(F.col("doc_id")), F.lit(7)) == 2).where("held_out").collect()
    assert len(out) == sum(zlib.crc32(str(i).encode()) % 7 == 2 for i in range(500))
    assert sum(r["score"] > r["base_score"] for r in out) >= 0.9 * len(out)


def test_a_very_long_text_without_spaces(spark):
    docs = spark.createDataFrame([(1, "ab" * 1_500_000), (2, "a b " * 500_000), (3, "ab")], SCHEMA.split(", lang")[0])
    got = {r["doc_id"]: r for r in lm_scoring.score_texts(docs, F.lit(False)).collect()}
    assert got[2]["n_tokens"] == 1_000_001 and got[1]["n_tokens"] == 2
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got.values())
