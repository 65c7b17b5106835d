"""The analysis of maxima against a plain version of it, over snapshots with planted regimes."""

import collections
import datetime
import decimal
import math
import random
import statistics

import pytest

from castline.operators import maxima


def planted(seed):
    """Pairs whose records sit under their maximum, mutants at recurring ratios, wrong maxima, gaps, missing members."""
    rng = random.Random(seed)
    weeks = [datetime.datetime(2026, 1, 4, 19) + datetime.timedelta(7 * i) for i in range(9)]
    seen, pairs = [], []
    for fish in range(16):
        for base in range(1, 6):
            kind = rng.random()
            top = rng.choice([1100, 2200, 3300, 5500, 11000, 12100, 22000, 33000, rng.randint(500, 40000)])
            if kind > 0.04:
                pairs.append((fish, base, f"fish {fish:02}", f"base {base}", None if kind < 0.08 else top))
            true = top if kind < 0.75 else int(top * rng.choice([0.8, 1.1, 1.21, 1.3, 1.5]))
            for week in rng.sample(weeks, rng.randint(1, 9)):
                for _ in range(rng.randint(1, 3)):
                    seen.append((fish, base, week, max(1, int(true * rng.uniform(0.9925, 1.0)))))
                if rng.random() < 0.4:
                    seen.append((fish, base, week, int(true * (1.05 + rng.randint(0, 4) / 1000))))
                if rng.random() < 0.25:
                    seen.append((fish, base, week, int(true * rng.choice([1.31, 1.315, 1.47, 1.6, 2.0]) * rng.uniform(1, 1.004))))
                if rng.random() < 0.3:
                    seen.append((fish, base, week, int(true * rng.uniform(0.3, 0.95)) + 1))
    seen += rng.sample(seen, 40) + [(3, None, weeks[0], 500), (3, 2, weeks[0], None)]
    return seen, pairs


def clusters(by_week):
    weights = sorted({g for gs in by_week.values() for g in gs})
    out = []
    for upper in weights:
        members = [g for g in weights if math.ceil(upper / 1.01) <= g <= upper]
        n = sum(any(g in members for g in gs) for gs in by_week.values())
        if n >= 2:
            out.append((n, upper, members))
    return out


def brute(seen, pairs):
    table = collections.defaultdict(lambda: collections.defaultdict(set))
    for fish, base, week, g in seen:
        if base is not None and g is not None:
            table[fish, base][week].add(g)
    maximum = {(f, b): m for f, b, _, _, m in pairs}
    ratios = []
    for pair, top in maximum.items():
        highs = [max(gs) for gs in table[pair].values()] if pair in table else []
        if top is not None and len(highs) >= 3 and min(highs) >= top * 0.98 and max(highs) <= top and max(highs) / min(highs) <= 1.01:
            ratios.append(max(highs) / top)
    calibrated = len(ratios) >= 20
    floor = min(ratios) if calibrated else 0.98
    tops = [m for m in maximum.values() if m is not None]
    rows = {}
    for pair, by_week in table.items():
        current, found = maximum.get(pair), clusters(by_week)
        near = [c for c in found if current is not None and current * 0.98 <= c[1] <= current]
        best = max(near or found, key=lambda c: c[:2], default=None)
        row = dict(n_weeks=len(by_week), current=current, near=bool(near), cluster=best, grid=None, proposed=None, range=None, assessment=None, bands=[], confidence="LOW", classification="REVIEW", reason="INSUFFICIENT_INDEPENDENT_WEEKS_OR_NO_STABLE_1_PERCENT_CLUSTER")
        rows[pair] = row
        if not best:
            continue
        n, low, members = best
        high, size = math.ceil(low / floor), len(str(low)) - 1
        step = 11 * 10 ** max(0, size - 2)
        same = [m for m in tops if len(str(m)) - 1 == size]
        support = sum(m % step == 0 for m in same) / max(1, len(same))
        grid = math.ceil(low / step) * step
        supported = grid <= high < grid + step and len(same) >= 20 and support >= 0.75
        row |= dict(range=(low, high), grid=grid if supported else None, confidence="HIGH" if calibrated and n >= 3 and len(members) >= 3 else "MEDIUM")
        if current is None:
            row |= dict(confidence="LOW", reason="MISSING_CURRENT_MAX_OR_MEMBERSHIP")
        elif near:
            row |= dict(classification="OK", range=None, reason="REPEATED_NORMAL_CLUSTER_NEAR_CURRENT_MAX;HIGHER_VALUES_ARE_MUTANT_AMBIGUOUS")
        elif low > current:
            row |= dict(classification="MAX_TOO_LOW", reason="PROVISIONAL_REPEATED_BOUNDARY_ABOVE_CURRENT")
            if low / current > 1.25:
                row["confidence"] = "MEDIUM"
        elif high < current * 0.95 and n >= 3:
            row |= dict(classification="MAX_TOO_HIGH", confidence="MEDIUM", reason="THREE_WEEK_STABLE_BOUNDARY_BELOW_CURRENT;LOW_EFFORT_REMAINS_POSSIBLE")
        else:
            row |= dict(confidence="LOW", reason="INSUFFICIENT_LOWER_BOUNDARY_SUPPORT")
        if row["confidence"] == "HIGH" and supported and row["classification"] == "MAX_TOO_LOW":
            row["proposed"] = grid
        shown = decimal.Decimal(support).quantize(decimal.Decimal("0.0001"), decimal.ROUND_HALF_UP)
        row["reason"] += f";clusterWeeks={n};distinctWeights={len(members)};gridStep={step};gridSupport={shown};calibrators={len(ratios)}"
    samples = [(g / rows[p]["current"], p, week) for p, by_week in table.items() if rows[p]["current"] is not None for week, gs in by_week.items() for g in gs]
    control = {p for p, r in rows.items() if r["near"]}
    filled = collections.defaultdict(list)
    for r, p, _ in samples:
        if r > 1 and p in control:
            filled[math.floor(r / 0.005 + 0.5)].append(p)
    runs = []
    for b in sorted(b for b, ps in filled.items() if len({p[0] for p in ps}) >= 5 and len({p[1] for p in ps}) >= 3):
        if runs and runs[-1][-1] + 1 == b:
            runs[-1].append(b)
        else:
            runs.append([b])
    bands = []
    for i, run in enumerate(runs, 1):
        low, high = max(1, (run[0] - 0.5) * 0.005), (run[-1] + 0.5) * 0.005
        inside = [s for s in samples if low < s[0] <= high]
        bands.append((f"control-{i}", low, high, statistics.median(s[0] for s in inside if s[1] in control and s[0] > 1), inside))
    outside = [s for s in samples if s[0] > 1 and not any(b[1] <= s[0] <= b[2] for b in bands)]
    found = []
    for start in sorted({s[0] for s in outside}):
        held = [s for s in outside if start <= s[0] <= start + 0.01]
        weeks = collections.defaultdict(set)
        for _, p, w in held:
            weeks[p].add(w)
        again = {p for p, ws in weeks.items() if len(ws) >= 2}
        mine = [s for s in held if s[1] in again]
        if len({p[0] for p in again}) >= 2 and len({p[1] for p in again}) >= 2:
            low, high = min(s[0] for s in mine), max(s[0] for s in mine)
            found.append((-sum(len(weeks[p]) for p in again), high - low, low, start, high, again, mine))
    used, n = set(), 0
    for _, _, low, _, high, again, mine in sorted(found, key=lambda f: f[:4]):
        if used & again:
            continue
        used, n = used | again, n + 1
        most = collections.defaultdict(float)
        for r, p, w in mine:
            most[p, w] = max(most[p, w], r)
        bands.append((f"cross-{n}", low, high, statistics.median(most.values()), [s for s in outside if low <= s[0] <= high]))
    for pair, row in rows.items():
        if row["current"] is None or not row["cluster"]:
            continue
        for name, low, high, *_ in sorted(bands, key=lambda b: b[1]):
            hit = sum(any(g in row["cluster"][2] and g > row["current"] and low - 0.0025 <= g / row["current"] <= high + 0.0025 for g in gs) for gs in table[pair].values())
            if hit >= (1 if name.startswith("control") else 2):
                row["bands"].append(name)
        if row["bands"] and row["classification"] in ("MAX_TOO_LOW", "REVIEW"):
            row |= dict(assessment="POSSIBLE_MUTANT_CAP", classification="REVIEW", confidence="MEDIUM", proposed=None, grid=None, range=None, reason=f"POSSIBLE_MUTANT_CAP;matchedBands={','.join(row['bands'])};" + row["reason"])
        elif row["classification"] == "MAX_TOO_LOW" and row["grid"] is not None:
            row |= dict(assessment="NORMAL_CAP_MISMATCH", reason="NORMAL_CAP_MISMATCH;NO_RECURRING_CROSS_SPECIES_BAND;" + row["reason"])
        elif row["classification"] == "MAX_TOO_LOW":
            row |= dict(classification="REVIEW", confidence="LOW", proposed=None, range=None, reason="NO_UNIQUE_SUPPORTED_NORMAL_CATALOG_BOUNDARY;" + row["reason"])
    return rows, bands, control


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_candidates_and_bands(spark, seed):
    seen, pairs = planted(seed)
    observations = spark.createDataFrame(seen, "fish_id long, base_id long, week timestamp_ntz, g long")
    candidates, found, _ = maxima.analyzed(observations, spark.createDataFrame(pairs, "fish_id long, base_id long, fish_name string, base_name string, max_grams long"))
    rows, bands, control = brute(seen, pairs)
    got = candidates.collect()
    assert len(got) == len(rows)
    for r in got:
        want = rows[r["fish_id"], r["base_id"]]
        cluster, span = want["cluster"] or (0, None, []), want["range"] or (None, None)
        assert (r["n_weeks"], r["current"], r["cluster_weeks"], r["cluster_upper"], r["cluster_weights"]) == (want["n_weeks"], want["current"], cluster[0], cluster[1], len(cluster[2]))
        assert (r["proposed"], r["grid_candidate"], r["range_low"], r["range_high"]) == (want["proposed"], want["grid"], *span)
        assert (r["assessment"], r["bands"], r["confidence"], r["classification"], r["reason"]) == (want["assessment"], ",".join(want["bands"]), want["confidence"], want["classification"], want["reason"])
    rank = [(not r["classification"].startswith("MAX_TOO_"), ["HIGH", "MEDIUM", "LOW"].index(r["confidence"]), r["proposed"] is None, -r["cluster_weeks"], -r["cluster_weights"], r["fish_name"], r["base_name"]) for r in got]
    assert rank == sorted(rank)
    told = {r["band"]: r for r in found.collect()}
    assert set(told) == {b[0] for b in bands}
    for name, low, high, middle, inside in bands:
        r = told[name]
        pairs_in = {s[1] for s in inside}
        assert (r["lower"], r["upper"]) == (low, high) and r["median"] == pytest.approx(middle)
        assert (r["weekly_weights"], r["pairs"], r["fish"], r["bases"]) == (len(inside), len(pairs_in), len({p[0] for p in pairs_in}), len({p[1] for p in pairs_in}))
        assert (r["pair_weeks"], r["control_pairs"]) == (len({s[1:] for s in inside}), len(pairs_in & control))
    kinds = {r["classification"] for r in got} | {r["assessment"] for r in got}
    assert {"OK", "REVIEW", "POSSIBLE_MUTANT_CAP"} <= kinds and any(b[0].startswith("cross") for b in bands) and any(b[0].startswith("control") for b in bands)


def test_nothing_to_analyze(spark):
    none = spark.createDataFrame([], "fish_id long, base_id long, week timestamp_ntz, g long")
    candidates, found, _ = maxima.analyzed(none, spark.createDataFrame([], "fish_id long, base_id long, fish_name string, base_name string, max_grams long"))
    assert candidates.count() == found.count() == 0


def test_spans_follow_the_ratios_not_the_windows_that_hold_them(spark):
    rng = random.Random(5)
    weeks = [datetime.datetime(2026, 1, 4, 19) + datetime.timedelta(7 * i) for i in range(4)]
    rows = [(fish, base, rng.choice(weeks), 1.2 + rng.choice([rng.randint(0, 90) / 10000, rng.random() / 50])) for fish in range(5) for base in range(4) for _ in range(12)]
    envelope = spark.createDataFrame(rows, "fish_id long, base_id long, week timestamp_ntz, ratio double").distinct()
    starts = maxima.numbered(envelope.select(maxima.F.col("ratio").alias("start")).distinct(), [maxima.F.col("start")])
    spans = maxima.recurring_spans(envelope, starts).collect()
    want = {}
    for start in {r[3] for r in rows}:
        held = collections.defaultdict(list)
        for fish, base, week, ratio in rows:
            if start <= ratio <= start + maxima.WINDOW:
                held[fish, base].append((week, ratio))
        for pair, inside in held.items():
            if len({w for w, _ in inside}) >= 2:
                want[start, *pair] = (len({w for w, _ in inside}), min(r for _, r in inside), max(r for _, r in inside))
    at = {r["n"]: r["start"] for r in starts.collect()}
    assert want == {(at[n], s["fish_id"], s["base_id"]): (s["weeks"], s["least"], s["most"]) for s in spans for n in range(s["first"], s["last"] + 1)}
    assert len(spans) <= 3 * len(rows) < len(want) / 2
