"""Language identification against a Kneser-Ney model written with dictionaries, and its rejections."""

import collections
import math
import random

import pytest
from corpus import SCHEMA
from pyspark.sql import functions as F

from castline.llm import language_id


def symbols(text):
    """Letters in lower case, runs of others after a letter as one boundary, three boundaries before."""
    out = [0, 0, 0]
    for c in (text or "") + " ":
        if c.isalpha():
            low = c.lower()
            cp = ord(low) if len(low) == 1 else ord(c)
            out.append(cp if cp < 0x3000 else 0x3000 + cp % 0x1000)
        elif out[-1]:
            out.append(0)
    return out


class BruteModel:
    """Interpolated Kneser-Ney of order 4, probability by probability."""

    def __init__(self, labelled, order=4):
        self.order, self.counts = order, {}
        for lang in sorted({lang for _, lang in labelled}):
            counts = {order: collections.Counter()}
            for text, own in labelled:
                if own == lang:
                    s = symbols(text)
                    counts[order].update(tuple(s[i - order + 1 : i + 1]) for i in range(order - 1, len(s)))
            for k in range(order - 1, 0, -1):
                counts[k] = collections.Counter(g[1:] for g in counts[k + 1])
            self.counts[lang] = counts
        self.alphabet = len({g for c in self.counts.values() for g in c[1]}) + 1
        self.rows = {lang: {k: self.by_context(c[k]) for k in c} for lang, c in self.counts.items()}

    @staticmethod
    def by_context(counts):
        once, twice = (sum(n == k for n in counts.values()) for k in (1, 2))
        total, kinds = collections.Counter(), collections.Counter()
        for g, n in counts.items():
            total[g[:-1]] += n
            kinds[g[:-1]] += 1
        return once / (once + 2 * twice) if once and twice else 0.5, total, kinds

    def p(self, lang, gram):
        if not gram:
            return 1 / self.alphabet
        discount, total, kinds = self.rows[lang][len(gram)]
        lower = self.p(lang, gram[1:])
        if not total[gram[:-1]]:
            return lower
        return (max(self.counts[lang][len(gram)][gram] - discount, 0) + discount * kinds[gram[:-1]] * lower) / total[gram[:-1]]

    def cross_entropy(self, text):
        s = symbols(text)
        n = len(s) - self.order + 1
        if not any(s):
            return [], 0
        return [-sum(math.log(self.p(lang, tuple(s[i - self.order + 1 : i + 1]))) for i in range(self.order - 1, len(s))) / n for lang in self.counts], n


def text(rng, letters, n=60):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 6))) for _ in range(n))


@pytest.mark.parametrize("seed", [1, 2])
def test_predictions_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    learned = [(i, text(rng, letters, 20), lang, "s", 0) for i, (letters, lang) in enumerate([("abcdé", "aa"), ("bcdefß", "bb"), ("éxyz　漢", "cc")] * 8)]
    model = language_id.train(spark.createDataFrame(learned, SCHEMA), F.lit(True))
    brute = BruteModel([(t, lang) for _, t, lang, *_ in learned])
    shown = [text(rng, "abcdefßxyzéÉ.,1 　漢", rng.randint(1, 30)) for _ in range(60)] + ["12 34", "", None, "a", "Q", "İ ǅ"]
    got = {r["doc_id"]: r for r in language_id.identify(spark.createDataFrame([(i, t, None, None, 0) for i, t in enumerate(shown)], SCHEMA), model, F.lit(True)).collect()}
    for i, t in enumerate(shown):
        h, n = brute.cross_entropy(t)
        if not n:
            assert (got[i]["lang_pred"], got[i]["score"], got[i]["rejected"]) == ("und", 0.0, True)
            continue
        assert got[i]["cross_entropy"] == pytest.approx(min(h), rel=1e-4)
        if sorted(h)[1] - min(h) > 1e-3:
            assert got[i]["lang_pred"] == model.languages[h.index(min(h))]
        assert got[i]["score"] == pytest.approx(1 / sum(math.exp(-model.scale * (x - min(h))) for x in h), abs=1e-3)


def test_texts_of_no_learned_language_are_rejected(spark):
    rng = random.Random(4)
    sample = [(i, text(rng, "abcd" if i % 2 else "wxyz"), "aa" if i % 2 else "ww", "s", 0) for i in range(400)]
    model = language_id.train(spark.createDataFrame(sample, SCHEMA), F.lit(True))
    shown = [(1, text(rng, "klmnop"), None, None, 0), (2, text(rng, "漢字仮名"), None, None, 0), (3, text(rng, "abcd"), None, None, 0), (4, text(rng, "wxyz", 4), None, None, 0), (5, text(rng, "awbxcydz"), None, None, 0)]
    got = {r["doc_id"]: r["rejected"] for r in language_id.identify(spark.createDataFrame(shown, SCHEMA), model, F.lit(True)).collect()}
    assert got == {1: True, 2: True, 3: False, 4: False, 5: True}
    assert {r["doc_id"] for r in language_id.keep_identified(spark.createDataFrame(shown, SCHEMA), model).collect()} == {3, 4}
