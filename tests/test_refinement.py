"""Inferred and refined boundaries against plain versions of both."""

import math
import random
import statistics

import pytest

from castline.operators import inference, refinement


def group(rng, kind):
    """Weights of one group: a dense cluster under a ceiling, a sparse tail, noise below; some kinds lack one of them."""
    ceiling = rng.choice([950, 2000, 5000, 12500, 20000, 30000])
    span = max(5, ceiling // 110)
    out = [ceiling - rng.randint(0, span) for _ in range(rng.randint(30, 200))] + [rng.randint(ceiling // 10, ceiling - span) for _ in range(rng.randint(20, 60))]
    if kind != "flat":
        out += [ceiling + rng.randint(ceiling // 20, ceiling) for _ in range(rng.randint(2, 8))]
    if kind == "few":
        out = out[:60]
    if kind == "busy":
        out += [rng.randint(1, 2 * ceiling) for _ in range(150)]
    return ceiling, out


@pytest.fixture(scope="module")
def groups():
    rng = random.Random(5)
    kinds = ["good"] * 25 + ["flat", "few", "busy", "plain"] * 4
    out = []
    for i, kind in enumerate(kinds):
        ceiling, weights = group(rng, kind)
        places = 1 if kind == "plain" else 6
        rows = [(i, g, rng.choice(["Near  Stone", " near stone", "ＮＥＡＲ stone", "far", "deep"][: places if places > 1 else 3]), f"bait {rng.randint(1, 5)}", rng.randint(1, 9), rng.randint(1, 7)) for g in weights]
        out.append((i, ceiling + rng.choice([-3, 0, 2, 7]), rng.choice([ceiling * 2, ceiling * 2, ceiling]), rows))
    return out


def score_of(x, table):
    return next((s for d, s in table if x % d == 0), 0)


def rounds(previous):
    room = max(5, math.floor(previous * 0.005 + 0.5))
    size = len(str(previous)) - 1
    steps = {math.floor(m * 10**e + 0.5) for e in range(-1, size + 1) for m in (1, 2, 2.5, 5)} - {0}
    near = {k * s for s in steps for k in (previous // s, -(-previous // s))}
    return sorted(c for c in near if max(1, previous - room) <= c <= previous + room and c % max(5, math.floor(5 * 10.0 ** (len(str(c)) - 4) + 0.5)) == 0 and score_of(c, refinement.ROUND_SCORES))


def assess(weights, b, previous):
    through, above = [g for g in weights if g <= b], [g for g in weights if g > b]
    if not through or len(above) < 2:
        return None
    window = max(5, math.floor(b * 0.01 + 0.5))
    near = [g for g in through if g >= max(0, b - window)]
    kinds = sorted(set(near))
    gaps = [y - x for x, y in zip(kinds, kinds[1:])][-40:]
    jump = min(above) - b
    gap = jump / max(1, statistics.median(gaps) if gaps else 1)
    density = (len(near) / window) / (len(above) / max(1, max(weights) - b))
    if len(near) < 20 or len(above) / len(weights) > 0.08 or gap < 8 or density < 8 or len(near) / len(above) < 3:
        return None
    r = score_of(b, refinement.ROUND_SCORES)
    score = math.log2(gap) * 2 + math.log2(density) + math.log2(len(near) / len(above)) + math.log2(len(near)) * 0.75 + r * 0.8 - abs(b - previous) / previous * 100
    return (-score, -r, abs(b - previous), b), len(near), len(above), jump


def test_refined_boundaries(spark, groups):
    rows = spark.createDataFrame([r for *_, rs in groups for r in rs], "k int, g long, place string, bait string, location_id int, bait_id int")
    rows = rows.union(spark.createDataFrame([(0, None, "x", "y", 1, 1), (0, -5, "x", "y", 1, 1)], rows.schema))
    previous = spark.createDataFrame([(k, p, m) for k, p, m, _ in groups], "k int, previous long, known_max long")
    got = {r["k"]: r for r in refinement.refined(rows, previous, ["k"]).collect()}
    assert len(got) == len(groups)
    seen = set()
    for k, previous_, known, rs in groups:
        weights, r = [x[1] for x in rs], got[k]
        label = lambda s: " ".join(s.replace("ＮＥＡＲ", "NEAR").split()).lower()
        places, baits = len({label(x[2]) for x in rs}), len({x[3] for x in rs})
        assert (r["rows"], r["places"], r["baits"]) == (len(weights), places, baits)
        found = sorted(a for a in (assess(weights, b, previous_) for b in rounds(previous_)) if a)
        want = "FEW_ROWS" if len(weights) < 80 else "FEW_PLACES_OR_BAITS" if places < 2 or baits < 3 else "NO_DENSE_CLUSTER_BELOW_A_SPARSE_TAIL" if not found else "KNOWN_MAX_NOT_OVERSTATED" if found[0][0][3] >= known else None
        seen.add(want)
        if want:
            assert (r["confidence"], r["refined"], r["near_rows"], r["reason"]) == ("UNKNOWN", None, None, want)
        else:
            order, near, above, jump = found[0]
            assert (r["confidence"], r["refined"], r["near_rows"], r["tail_rows"]) == ("HIGH", order[3], near, above)
            assert r["reason"].startswith(f"{near} rows immediately below; {above} above after a {jump} g gap (")
    assert seen >= {None, "FEW_ROWS", "FEW_PLACES_OR_BAITS", "NO_DENSE_CLUSTER_BELOW_A_SPARSE_TAIL"}


def natural(edge, following, most):
    size, room = 10.0 ** (len(str(edge)) - 1), max(2.0, edge * 0.002)
    for part in (1, 2, 10, 20, 100):
        step = math.floor(size / part + 0.5)
        if step >= 1:
            near = math.floor(edge / step + 0.5) * step
            if abs(near - edge) <= room and 0 < near < most and (near <= edge or near < following):
                return near
    return edge


def infer(rows, least=40):
    """The best edge of a group, edge by edge over its sorted weights."""
    weights = sorted(r[1] for r in rows)
    kinds, n = sorted(set(weights)), len(weights)
    best = []
    if n >= least and len(kinds) >= 12:
        for i in range(1, len(kinds) - 1):
            w, following = kinds[i], kinds[i + 1]
            through = sum(g <= w for g in weights)
            tail = n - through
            if through < 0.75 * n or tail > 0.12 * n or tail < 1 or w < 1:
                continue
            span = max(5, math.floor(w * 0.01 + 0.5))
            cluster = sum(w - span <= g <= w for g in weights)
            gaps = [kinds[j + 1] - kinds[j] for j in range(max(0, i - 40), i) if kinds[j] >= w - span]
            gap = following - w
            usual = statistics.median(gaps) if gaps else 1.0
            ratio, density, share = gap / max(1.0, usual), (cluster / span) / (tail / max(1, kinds[-1] - w)), cluster / tail
            if cluster < 8 or ratio < 4 or density < 4 or share < 1.5 or gap < 0.0005 * w:
                continue
            edge = natural(w, following, kinds[-1])
            r = score_of(edge, inference.ROUNDNESS)
            score = math.log2(ratio) * 2 + math.log2(density) + math.log2(share) + math.log2(cluster) * 0.75 + r * 0.65 - tail / n * 10
            edge_span = max(5, math.floor(edge * 0.01 + 0.5))
            best.append((-score, -r, edge, sum(edge - edge_span <= g <= edge for g in weights), sum(g > edge for g in weights), ratio, density, share))
    best.sort()
    places, baits = len({r[4] for r in rows}), len({r[5] for r in rows})
    if not best:
        return None, None, None, "LOW"
    score, _, edge, near, above, ratio, density, share = best[0]
    margin = best[1][0] - score if len(best) > 1 else math.inf
    if n >= 80 and near >= 20 and above >= 2 and above / n <= 0.08 and ratio >= 8 and density >= 8 and share >= 3 and places >= 2 and baits >= 3 and margin >= 1.5:
        return edge, near, above, "HIGH"
    if near >= 10 and above >= 2 and above / n <= 0.1 and ratio >= 6 and density >= 5 and places >= 1 and baits >= 2 and margin >= 0.5:
        return edge, near, above, "MEDIUM"
    return edge, near, above, "LOW"


def test_inferred_boundaries(spark, groups):
    rows = spark.createDataFrame([r for *_, rs in groups for r in rs], "k int, weight_grams long, place string, bait string, location_id int, bait_id int")
    got = {r["k"]: (r["boundary"], r["near_rows"], r["tail_rows"], r["confidence"]) for r in inference.infer_boundaries(rows, ["k"]).collect()}
    want = {k: infer(rs) for k, *_, rs in groups}
    assert got == want and {w[3] for w in want.values()} >= {"HIGH", "LOW"}
