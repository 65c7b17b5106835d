"""Context-tree weighting over bytes, each byte coded as eight binary choices.

A context of depth d (the last d bytes) holds a Krichevsky-Trofimov estimate for
each node of the binary tree of the next byte.  For a node the weighted
probability of its training bits is

    P_w = 1/2 P_KT + 1/2 prod P_w of the contexts one byte longer

which needs only the counts, since a KT block probability does not depend on
order.  With training done, the next bit's probability along a context path
mixes all depths' KT predictions by the posterior weights 1/2 P_KT / P_w; the
product over a byte's eight nodes is its probability, so the codes are
normalised and the code length of a text is minus the sum of its logs.

A context is kept if training holds it ``least`` times, a fixed number: the tree
grows with the corpus.  The rarer contexts under one parent share a leaf with a
KT estimate of its own, which is also what stands for contexts never seen.

The tree is cut into subtrees, each the contexts below one root context, of a
bounded number of grams.  ``Subtree`` holds some of them, with the seen nodes
only; ``Upper`` holds the contexts above all roots.  Weights travel from the
subtrees up and probabilities from the upper contexts down.

A gram is the packed integer of a context and the byte after it, newest context
byte highest and the byte lowest, so a context's parent is the context without
its lowest byte.
"""

from __future__ import annotations

import numpy as np

END = 255
_LN2 = np.log(2.0)
_HALF, _WHOLE = (np.zeros(0), np.zeros(0))
_TABLE = 1 << 16


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln gamma for x > 0: Stirling's series at x + 8, brought back by the recurrence."""
    product = np.ones_like(x)
    for i in range(8):
        product *= x + i
    z = x + 8
    return (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - np.log(product)


def _looked_up(n: np.ndarray, table: np.ndarray, add: float) -> np.ndarray:
    out = table[np.minimum(n, _TABLE - 1)]
    large = n >= _TABLE
    if large.any():
        out[large] = log_gamma(n[large] + add)
    return out


def log_kt(total: np.ndarray, one: np.ndarray) -> np.ndarray:
    """ln KT block probabilities of nodes with ``one`` ones among ``total`` bits; integers."""
    global _HALF, _WHOLE
    if not len(_HALF):
        steps = np.arange(_TABLE, dtype=float)
        _HALF, _WHOLE = log_gamma(steps + 0.5), log_gamma(steps + 1)
    return _looked_up(total - one, _HALF, 0.5) + _looked_up(one, _HALF, 0.5) - _looked_up(total, _WHOLE, 1.0) - np.log(np.pi)


def kt_one(total: np.ndarray, one: np.ndarray) -> np.ndarray:
    return (one + 0.5) / (total + 1.0)


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct keys and the sums of n."""
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    head = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[head], np.add.reduceat(n, head) if len(head) else n


def place(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each wanted value stands in sorted keys, and if it does."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def parent_key(key: np.ndarray, bits: int) -> np.ndarray:
    """From (context, first ``bits`` bits) to those of the parent context."""
    return (key >> (8 + bits)) << bits | (key & ((1 << bits) - 1))


class Level:
    """The kept contexts of one depth: for b bits of the next byte the seen (context, bits) keys with their counts.

    ``up[b]`` is the place of each entry's first b - 1 bits among ``keys[b - 1]``.
    """

    def __init__(self, grams: np.ndarray, n: np.ndarray):
        self.keys, self.total, self.one, self.up = [grams], [n], [], []
        for _ in range(8):
            keys, total = self.keys[0], self.total[0]
            short = keys >> 1
            first = np.append(True, short[1:] != short[:-1])[: len(short)]
            head = np.flatnonzero(first)
            self.up.insert(0, np.cumsum(first) - 1)
            self.keys.insert(0, short[head])
            self.one.insert(0, np.add.reduceat(total * (keys & 1), head) if len(head) else total)
            self.total.insert(0, np.add.reduceat(total, head) if len(head) else total)

    @property
    def contexts(self) -> np.ndarray:
        return self.keys[0]


class Subtree:
    """The kept contexts from depth ``top`` (the roots') to ``depth`` of whole subtrees, from their grams of full depth."""

    def __init__(self, grams: np.ndarray, n: np.ndarray, top: int, depth: int, least: int):
        self.top, self.depth = top, depth
        self.levels: dict[int, Level] = {}
        self.stay: dict[tuple[int, int], np.ndarray] = {}
        self.rest: dict[tuple[int, int], np.ndarray] = {}
        keys, n = summed(grams.astype(np.int64), n.astype(np.int64))
        for d in range(depth, top - 1, -1):
            context = keys >> 8
            head = np.flatnonzero(np.append(True, context[1:] != context[:-1])) if len(keys) else np.zeros(0, np.int64)
            total = np.add.reduceat(n, head) if len(head) else n
            kept = np.repeat(total >= least, np.diff(np.append(head, len(keys))))
            self.levels[d] = Level(keys[kept], n[kept])
            if d > top:
                keys, n = summed((keys >> 16) << 8 | (keys & 255), n)
        below: list[np.ndarray] = []
        for d in range(depth, top - 1, -1):
            level, child = self.levels[d], self.levels.get(d + 1)
            inner = np.zeros(len(level.contexts), bool)
            if child is not None:
                inner[place(level.contexts, child.contexts >> 8)[0]] = True
            weighted, context = [], np.arange(len(level.contexts))
            for b in range(8):
                if b:
                    context = context[level.up[b - 1]]
                own = log_kt(level.total[b], level.one[b])
                here = inner[context]
                if here.any():
                    at = place(level.keys[b], parent_key(child.keys[b], b))[0]
                    size = len(own)
                    total = level.total[b] - np.bincount(at, child.total[b], size).astype(np.int64)
                    one = level.one[b] - np.bincount(at, child.one[b], size).astype(np.int64)
                    split = np.bincount(at, below[b], size) + log_kt(total, one)
                    both = np.where(here, np.logaddexp(own, split) - _LN2, own)
                    self.rest[d, b] = kt_one(total, one)
                else:
                    both = own
                    self.rest[d, b] = np.full(len(own), 0.5)
                self.stay[d, b] = np.where(here, np.exp(np.minimum(own - _LN2 - both, 0)), 1.0)
                weighted.append(both)
            below = weighted
        self.weighted = below

    def upward(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(parent context, cell, value) sums for the roots' parents: ln P_w in cells 0-254, byte counts in cells 256-511."""
        root = self.levels[self.top]
        parents = [root.keys[8] >> 16]
        cells, values = [256 + (root.keys[8] & 255)], [root.total[8].astype(float)]
        for b in range(8):
            parents.append(root.keys[b] >> (8 + b))
            cells.append((1 << b) - 1 + (root.keys[b] & ((1 << b) - 1)))
            values.append(self.weighted[b])
        key, value = summed(np.concatenate(parents) << 9 | np.concatenate(cells), np.concatenate(values))
        return key >> 9, key & 511, value

    def settle(self, upper: Upper) -> None:
        """Probabilities from the upper contexts down: of bit 1 where a path ends (end), where a longer context lacks the node (novel)."""
        self.upper = upper
        self.end: dict[tuple[int, int], np.ndarray] = {}
        self.novel: dict[tuple[int, int], np.ndarray] = {}
        self.logs: dict[int, np.ndarray] = {}
        before: list[tuple[np.ndarray, np.ndarray]] = []
        for d in range(self.top, self.depth + 1):
            level, now = self.levels[d], []
            logs = np.zeros(len(level.contexts))
            for b in range(8):
                keys = level.keys[b]
                if d == self.top:
                    row, node = upper.row(d - 1, keys >> (8 + b)), (1 << b) - 1 + (keys & ((1 << b) - 1))
                    mixed, left = upper.mixed[d - 1][row, node], upper.left[d - 1][row, node]
                else:
                    at = place(self.levels[d - 1].keys[b], parent_key(keys, b))[0]
                    mixed, left = before[b][0][at], before[b][1][at]
                stay = self.stay[d, b]
                mixed, left = mixed + left * stay * kt_one(level.total[b], level.one[b]), left * (1 - stay)
                now.append((mixed, left))
                self.end[d, b], self.novel[d, b] = _sure(mixed + left * self.rest[d, b]), _sure(mixed + left * 0.5)
                bit = level.keys[b + 1] & 1
                p = self.end[d, b][level.up[b]]
                logs = logs[level.up[b]] + np.log10(np.where(bit, p, 1 - p))
            before, self.logs[d] = now, logs

    def score(self, grams: np.ndarray) -> np.ndarray:
        """log10 probability of each gram's byte after its context; of full depth, sorted or not."""
        out = np.zeros(len(grams))
        ends = np.full(len(grams), self.top - 1)
        live = np.arange(len(grams))
        for d in range(self.top, self.depth + 1):
            context = grams[live] >> (8 + 8 * (self.depth - d))
            live = live[place(self.levels[d].contexts, context)[1]]
            ends[live] = d
        above = np.flatnonzero(ends < self.top)
        out[above] = self.upper.score(grams[above], self.depth, self.top - 1)
        for d in range(self.top, self.depth + 1):
            mine = np.flatnonzero(ends == d)
            key = (grams[mine] >> (8 + 8 * (self.depth - d))) << 8 | (grams[mine] & 255)
            at, hit = place(self.levels[d].keys[8], key)
            out[mine[hit]] = self.logs[d][at[hit]]
            if not hit.all():
                out[mine[~hit]] = self._unseen(grams[mine[~hit]], d)
        return out

    def _unseen(self, grams: np.ndarray, ends: int) -> np.ndarray:
        out, byte = np.zeros(len(grams)), grams & 255
        row = self.upper.row(self.top - 1, grams >> (8 + 8 * (self.depth - self.top + 1)))
        for b in range(8):
            prefix = byte >> (8 - b)
            p = self.upper.novel[self.top - 1][row, (1 << b) - 1 + prefix]
            open_ = np.arange(len(grams))
            for d in range(ends, self.top - 1, -1):
                key = (grams[open_] >> (8 + 8 * (self.depth - d))) << b | prefix[open_]
                at, hit = place(self.levels[d].keys[b], key)
                p[open_[hit]] = (self.end if d == ends else self.novel)[d, b][at[hit]]
                open_ = open_[~hit]
            out += np.log10(np.where((byte >> (7 - b)) & 1, p, 1 - p))
        return out


def _sure(p: np.ndarray) -> np.ndarray:
    return np.clip(p, 1e-12, 1 - 1e-12)


def node_counts(dense: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bits and ones at the 255 nodes (heap order from 0) of rows of 256 byte counts."""
    total, one = np.empty((len(dense), 255), np.int64), np.empty((len(dense), 255), np.int64)
    for b in range(8):
        halves = dense.reshape(len(dense), 1 << b, 2, 128 >> b).sum(-1)
        total[:, (1 << b) - 1 : (2 << b) - 1], one[:, (1 << b) - 1 : (2 << b) - 1] = halves.sum(-1), halves[..., 1]
    return total, one


class Upper:
    """The contexts above the roots, with all 255 nodes each: those of depth 0 and 1, and those split for their size."""

    def __init__(self, contexts: dict[int, np.ndarray], counts: dict[int, np.ndarray], sums: dict[int, np.ndarray], kept: dict[int, np.ndarray]):
        """Sorted contexts and their (n, 256) counts by depth; of the children in subtrees the summed ln P_w (n, 255) and counts (n, 256)."""
        self.contexts = contexts
        deepest = max(contexts)
        stay, rest, nodes, below = {}, {}, {}, None
        for d in range(deepest, -1, -1):
            split, inside = sums[d].copy(), kept[d].copy()
            if d < deepest and len(contexts[d + 1]):
                at = self.row(d, contexts[d + 1] >> 8)
                np.add.at(split, at, below)
                np.add.at(inside, at, counts[d + 1])
            inner = inside.any(1)
            nodes[d] = node_counts(counts[d])
            own, left = log_kt(*nodes[d]), node_counts(counts[d] - inside)
            weighted = np.where(inner[:, None], np.logaddexp(own, split + log_kt(*left)) - _LN2, own)
            stay[d], rest[d] = np.where(inner[:, None], np.exp(np.minimum(own - _LN2 - weighted, 0)), 1.0), kt_one(*left)
            below = weighted
        self.mixed: dict[int, np.ndarray] = {}
        self.left: dict[int, np.ndarray] = {}
        self.end: dict[int, np.ndarray] = {}
        self.novel: dict[int, np.ndarray] = {}
        for d in range(deepest + 1):
            at = self.row(d - 1, contexts[d] >> 8) if d else None
            before, weight = (self.mixed[d - 1][at], self.left[d - 1][at]) if d else (0.0, 1.0)
            self.mixed[d], self.left[d] = before + weight * stay[d] * kt_one(*nodes[d]), weight * (1 - stay[d])
            self.end[d], self.novel[d] = _sure(self.mixed[d] + self.left[d] * rest[d]), _sure(self.mixed[d] + self.left[d] * 0.5)

    def row(self, d: int, context: np.ndarray) -> np.ndarray:
        return place(self.contexts[d], context)[0]

    def score(self, grams: np.ndarray, depth: int, top: int) -> np.ndarray:
        """log10 probabilities of grams of full depth whose paths end at depth ``top`` or before."""
        out, byte = np.zeros(len(grams)), grams & 255
        open_ = np.arange(len(grams))
        for d in range(top, -1, -1):
            at, hit = place(self.contexts[d], grams[open_] >> (8 + 8 * (depth - d)))
            mine, at = open_[hit], at[hit]
            for b in range(8):
                p = self.end[d][at, (1 << b) - 1 + (byte[mine] >> (8 - b))]
                out[mine] += np.log10(np.where((byte[mine] >> (7 - b)) & 1, p, 1 - p))
            open_ = open_[~hit]
        return out
