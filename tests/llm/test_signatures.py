"""The frequent-shingle set steers work only: with any set at all, linked sets share a signature."""

import numpy as np
import pytest

from castline.llm.jaccard import Frequent, signatures


@pytest.mark.parametrize("share", [0.0, 0.5, 0.97, 1.0])
@pytest.mark.parametrize("num", [80, 90])
def test_linked_sets_share_a_signature_whatever_is_frequent(share, num):
    draw = np.random.default_rng(7)
    sets = []
    for n in (1, 2, 5, 9, 10, 11, 40, 137, 400):
        for _ in range(6):
            whole = np.unique(draw.integers(0, 1 << 63, n, dtype=np.uint64))
            other = whole[draw.random(len(whole)) > (100 - num) / 100]
            sets += [whole, other]
    every = np.unique(np.concatenate(sets))
    sig, owner = signatures(sets, num, 100, Frequent.of(every[draw.random(len(every)) < share]))
    held = [set(sig[owner == i].tolist()) for i in range(len(sets))]
    linked = 0
    for i in range(0, len(sets), 2):
        a, b = sets[i], sets[i + 1]
        both = len(np.intersect1d(a, b))
        if len(b) and 100 * both >= num * (len(a) + len(b) - both):
            linked += 1
            assert held[i] & held[i + 1]
    assert linked > 10


def test_sets_that_share_few_shingles_share_no_signature():
    draw = np.random.default_rng(3)
    common = draw.integers(0, 1 << 63, 300, dtype=np.uint64)
    sets = [np.unique(np.append(draw.integers(0, 1 << 63, 1000, dtype=np.uint64), draw.choice(common, 10, replace=False))) for _ in range(60)]
    sig, owner = signatures(sets, 80, 100, None)
    # one more than linked sets can differ in, in each of a set's size classes, which are two at most
    assert np.bincount(owner).max() <= 2 * (1010 // 4 + 1)
    pairs = np.unique(np.stack([sig.view(np.int64), owner], 1), axis=0)
    assert len(pairs) - len(np.unique(sig)) <= 2
