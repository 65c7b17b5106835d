"""Each operator over the small corpus against a brute-force version, and over odd tables."""

import collections
import hashlib
import math
import random
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from corpus import SCHEMA, documents, low, words
from pyspark.sql import functions as F

from castline.llm import decontamination, fm_index, jaccard, language_id, line_dedup, lm_scoring, mixing, sharding, substring_dedup, token_files
from castline.llm.textscan import Words, runs_hash, windows


@pytest.fixture(scope="module")
def rows():
    return documents()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def clashing(spark, rows):
    """Null keys, repeated rows, and extra columns whose names the operators use inside."""
    odd = [(None, "null key here", "en", "s0", 3), (0, rows[0][1], "en", "s0", 1), (0, rows[0][1], "en", "s0", 1)]
    frame = spark.createDataFrame(odd + rows[1:25], SCHEMA)
    for name in ("key", "k", "n", "block", "copies", "component", "node", "doc", "drop", "words", "at", "shard", "slot", "h1", "bucket"):
        frame = frame.withColumn(name, F.lit("x"))
    return frame


def by_id(frame, key="doc_id"):
    return {r[key]: r.asDict() for r in frame.collect()}


def test_words_match_the_pattern():
    rng = random.Random(1)
    for _ in range(200):
        texts = ["".join(rng.choice(" \t\nabÉ\x0b") for _ in range(rng.randint(0, 12))) if rng.random() < 0.9 else None for _ in range(rng.randint(1, 6))]
        w = Words(pa.array(texts, pa.string()))
        assert [[w.data[s:e].tobytes().decode() for s, e in zip(w.start[a:b], w.end[a:b])] for a, b in zip(w.first, w.stop)] == [words(t) for t in texts]


def brute_substring(rows, size):
    first = {}
    for i, t, *_ in sorted(rows):
        w = words(t)
        for s in range(len(w) - size + 1):
            first.setdefault(tuple(w[s : s + size]), i)
    out = {}
    for i, t, *_ in rows:
        w = words(t)
        gone = set()
        for s in range(len(w) - size + 1):
            if first[tuple(w[s : s + size])] < i:
                gone.update(range(s, s + size))
        out[i] = (len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone))
    return out


@pytest.mark.parametrize("hot", [1024, 1])
def test_substring_dedup(docs, rows, hot):
    got = by_id(substring_dedup.drop_repeated_substrings(docs, window=20, anchor=5, hot=hot))
    assert {i: (r["n_words"], r["n_removed"], r["kept"]) for i, r in got.items()} == brute_substring(rows, 20)


def test_substring_dedup_of_repetitive_texts(spark):
    rows = [(i, " ".join(["the"] * (30 + i)), "en", "s", 0) for i in range(6)] + [(9, " ".join(["a", "b"] * 40), "en", "s", 0), (10, " ".join(["b", "a"] * 40), "en", "s", 0)]
    got = by_id(substring_dedup.drop_repeated_substrings(spark.createDataFrame(rows, SCHEMA), window=20, anchor=5))
    assert {i: (r["n_words"], r["n_removed"], r["kept"]) for i, r in got.items()} == brute_substring(rows, 20)


@pytest.mark.parametrize("hot", [1024, 1])
def test_substring_dedup_inside_one_document(spark, hot):
    passage = " ".join(f"w{i}" for i in range(26))
    rows = [(3, f"a b c {passage} d e f", "en", "s", 0), (5, " ".join([f"u v {passage} x y"] * 10), "en", "s", 0), (6, f"u v {passage} x y", "en", "s", 0)]
    got = by_id(substring_dedup.drop_repeated_substrings(spark.createDataFrame(rows, SCHEMA), window=20, anchor=5, hot=hot))
    want = brute_substring(rows, 20)
    assert want[5][1] == 260
    assert {i: (r["n_words"], r["n_removed"], r["kept"]) for i, r in got.items()} == want


def test_fm_index_counts_and_owners():
    rng = np.random.RandomState(0)
    pieces = [rng.randint(1, 4, rng.randint(5, 30)) for _ in range(20)]
    owner = rng.permutation(20).astype(np.int64)
    index = fm_index.FMIndex(pieces, owner)
    for _ in range(200):
        p = pieces[rng.randint(20)]
        a = rng.randint(len(p))
        pattern = p[a : a + rng.randint(1, 6)]
        low_, high = np.array([0]), np.array([index.n])
        for c in pattern[::-1]:
            low_, high = index.extend(np.array([c]), low_, high)
        holds = [o for q, o in zip(pieces, owner) for s in range(len(q) - len(pattern) + 1) if (q[s : s + len(pattern)] == pattern).all()]
        assert high[0] - low_[0] == len(holds)
        assert index.least_owner(low_, high)[0] == min(holds)


def brute_components(rows, k, num, den):
    sets = {}
    for i, t, *_ in rows:
        w = words(low(t))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    label = {i: i for i in sets}

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((find(a), find(b)))
                    label[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("k", "num", "block"), [(3, 90, 512), (5, 80, 512), (2, 60, 3)])
def test_jaccard_components(docs, rows, k, num, block):
    got = by_id(jaccard.link_components(docs, k=k, num=num, den=100, block=block))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == brute_components(rows, k, num, 100)


@pytest.mark.parametrize("num", [90, 80, 60])
@pytest.mark.parametrize("hot", [False, True])
def test_linked_sets_share_a_signature(num, hot):
    rng = np.random.RandomState(3)
    for _ in range(150):
        n = rng.randint(1, 200)
        base = rng.randint(1, 1 << 62, n).astype(np.uint64)
        other = base.copy()
        change = rng.choice(n, rng.randint(0, n * (100 - num) // 100 + 1), replace=False)
        other[change] = rng.randint(1, 1 << 62, len(change)).astype(np.uint64)
        a, b = np.unique(base), np.unique(other[rng.rand(n) < 0.98]) if n > 1 else np.unique(other)
        both = len(np.intersect1d(a, b))
        frequent = jaccard.Frequent.of(rng.permutation(a)[: len(a) * 9 // 10]) if hot else None
        if len(b) and 100 * both >= num * (len(a) + len(b) - both):
            sig, owner = jaccard.signatures([a, b], num, 100, frequent)
            assert set(sig[owner == 0]) & set(sig[owner == 1])


def brute_lines(rows, length, least):
    holders = collections.defaultdict(set)
    key = lambda line: low(line.strip(" \t\n\x0b\f\r"))
    for i, t, *_ in rows:
        for line in (t or "").split("\n"):
            holders[key(line)].add(i)
    out = {}
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= length and len(holders[key(x)]) >= least and max(holders[key(x)]) != i)]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


@pytest.mark.parametrize(("batches", "fanout"), [(1, 4), (3, 2), (5, 2)])
def test_line_dedup(docs, rows, batches, fanout):
    got = by_id(line_dedup.drop_repeated_lines(docs, min_length=20, batches=batches, fanout=fanout))
    assert {i: (r["n_lines"], r["n_dropped"], r["kept"]) for i, r in got.items()} == brute_lines(rows, 20, 5)


def test_line_runs_compact_in_place(spark, rows):
    runs = line_dedup.LineRuns(spark, fanout=2, buckets=4)
    for low_ in (3, 2, 1, 0):
        batch = spark.createDataFrame([(h, -h, 1, 10 * low_ + h % 7) for h in range(low_, 60, 3)], "h1 long, h2 long, n long, holder long")
        runs.add(batch)
    assert runs.merges == 3 and [len(level) for level in runs.levels] == [0, 0, 1]
    two = [spark.table(runs.written(spark.createDataFrame([(h, h, 1, 1) for h in range(9)], "h1 long, h2 long, n long, holder long"))) for _ in range(2)]
    plan = runs.merged(two)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    held = {r["h1"]: (r["n"], r["holder"]) for r in runs.all()[0].collect()}
    for h in range(60):
        found = [10 * low_ + h % 7 for low_ in (3, 2, 1, 0) if h >= low_ and (h - low_) % 3 == 0]
        assert held[h] == (len(found), max(found))
    runs.close()


def test_line_dedup_of_many_lines_in_a_document(spark):
    line = lambda i: f"line number {i} that many of the documents have in common"
    rows = [(d, "\n".join([line(i) for i in range(150)] + [f"own {d}", line(3)]), "en", "s", 0) for d in range(6)] + [(7, "x", "en", "s", 0)]
    got = by_id(line_dedup.drop_repeated_lines(spark.createDataFrame(rows + rows[:1], SCHEMA)))
    assert {i: (r["n_lines"], r["n_dropped"], r["kept"]) for i, r in got.items()} == brute_lines(rows, 40, 5)


def test_line_keys_fold_only_a_to_z(spark):
    rng = random.Random(4)
    lines = ["".join(rng.choice("aAéÉßẞǅx÷×ÿŸ日Ａａ ") for _ in range(4)) for _ in range(400)]
    frame = spark.createDataFrame([(x,) for x in lines], "l string").select("l", line_dedup.key_hash(line_dedup.line_key(F.col("l"))).alias("h")).collect()
    classes = collections.defaultdict(set)
    for r in frame:
        classes[low(r["l"])].add(tuple(r["h"]))
    assert all(len(v) == 1 for v in classes.values())
    assert len({next(iter(v)) for v in classes.values()}) == len(classes)


def test_sharding(docs, rows):
    got = by_id(sharding.shard_records(docs, 7))
    assert len(got) == len(rows)
    for i, t, *_ in rows:
        raw = (t or "").encode()
        assert (got[i]["size"], got[i]["text_crc32"], got[i]["law"]) == (len(raw) + 8, zlib.crc32(raw), "key")
        assert got[i]["grown_shard"] in (got[i]["shard"], 7)
    for s in range(7):
        slots = sorted(r["slot"] for r in got.values() if r["shard"] == s)
        assert slots == list(range(len(slots)))


def brute_shard(weights, key, spark, seed=17):
    """The shard of the largest -w / ln(u), from hashes taken one by one."""
    scores = []
    for i, w in enumerate(weights):
        h = spark.sql(f"select xxhash64('{seed}:{i}', '{key}') as h").first()["h"] % (1 << 64)
        scores.append((-w / math.log(((h >> 11) + 0.5) / (1 << 53)), -i))
    return -max(scores)[1]


def test_shards_equal_brute_force_scores(spark):
    frame = spark.createDataFrame([(i, f"t{i}", "mine") for i in range(12)], "doc_id long, text string, shard string")
    weights = [1.0, 2.0, 0.5]
    out = sharding.with_shard(frame, 3, weights=weights)
    assert out.columns == ["doc_id", "text", "shard", "shard_2", "shard_size"]
    for r in out.collect():
        assert r["shard"] == "mine" and r["shard_2"] == brute_shard(weights, r["doc_id"], spark)


def test_rendezvous_follows_weights_and_growth(spark):
    ids = spark.range(20000)
    counts = {r["s"]: r["count"] for r in ids.select(sharding.rendezvous(F.col("id"), [1.0, 2.0, 5.0]).alias("s")).groupBy("s").count().collect()}
    assert abs(counts[0] / 2500 - 1) < 0.1 and abs(counts[1] / 5000 - 1) < 0.1 and abs(counts[2] / 12500 - 1) < 0.1


def test_mixing(docs, rows):
    got = by_id(mixing.mix_plan(docs))
    again = by_id(mixing.mix_plan(docs.repartition(5)))
    assert got == again
    sizes = collections.Counter()
    for i, t, _, s, _ in rows:
        assert got[i]["size"] == len(words(t))
        sizes[s] += len(words(t))
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, open_ = {}, set(sizes)
    left = 1.5 * sum(sizes.values())
    while True:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not over:
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= over
    target |= {s: level * weight[s] for s in open_}
    taken = collections.Counter()
    for i, _, _, s, _ in rows:
        assert math.isclose(got[i]["target"], target[s]) and got[i]["source_size"] == sizes[s]
        assert got[i]["taken"] in (0, got[i]["size"], 2 * got[i]["size"])
        taken[s] += got[i]["taken"]
    for s in sizes:
        assert abs(taken[s] - target[s]) <= max(10, 0.03 * target[s])


def test_mixed_rows_and_tree(spark, docs):
    mixed = mixing.mix(docs, shards=5)
    plan = by_id(mixing.mix_plan(docs))
    counts = collections.Counter(r["doc_id"] for r in mixed.collect())
    assert {i: c * plan[i]["size"] for i, c in counts.items()} == {i: r["taken"] for i, r in plan.items() if r["taken"]}
    draws = spark.range(1000).select((F.col("id") % 4).cast("string").alias("source_key"), F.col("id").cast("int").alias("block"), F.lit(1).alias("copy"))
    split = mixing.split_blocks(draws, 6, 1)
    assert split.count() == 1000
    sizes = [r["count"] for r in split.groupBy("mix_shard").count().collect()]
    assert len(sizes) == 6 and max(sizes) - min(sizes) <= 6
    table = {(r["source_key"], r["mix_shard"]): r["count"] for r in split.groupBy("source_key", "mix_shard").count().collect()}
    assert all(20 <= table[s, m] <= 65 for s in "0123" for m in range(6))


def test_mix_passes_over_documents_larger_than_the_room(spark):
    rows = [(i, f"d{i} " + "x " * 99, "en", "s", 0) for i in range(200)] + [(200, "y " * 18000, "en", "s", 0)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for seed in (29, 30):
        plan = mixing.mix_plan(frame, share=16050 / 38000, seed=seed).collect()
        assert sum(r["taken"] for r in plan) == 16000


def test_mix_plan_counts_the_placed_draws(docs):
    shards = collections.defaultdict(list)
    mixed = mixing.mix(docs)
    for r in mixed.collect():
        shards[r["doc_id"]].append(r["mix_shard"])
    plan = mixing.mix_plan(docs).collect()
    assert {r["doc_id"]: r["mix_shards"] for r in plan} == {r["doc_id"]: ",".join(map(str, sorted(shards[r["doc_id"]]))) for r in plan}
    assert all(r["taken"] == r["size"] * len(shards[r["doc_id"]]) for r in plan)
    table = mixing.written(mixed, "test-mixed")
    assert table.columns == mixed.columns and table.count() == mixed.count()
    files = collections.defaultdict(list)
    for r in table.select("mix_shard", "mix_order", F.input_file_name().alias("f")).collect():
        files[r["f"]].append((r["mix_shard"], r["mix_order"]))
    assert all(f == sorted(f) and f"mix_shard={f[0][0]}/" in name for name, f in files.items())


def test_language_id(docs, rows, empty):
    texts = {"aa": "abab baba aabb ", "xx": "xyxy yxyx xxyy ", "éé": "éèé èéè ééèè "}
    rng = random.Random(2)
    sample = [(i, "".join(rng.choice(list(texts[k].split())) + " " for _ in range(30)), k, "s", 0) for i, k in enumerate(["aa", "xx", "éé"] * 40)]
    frame = docs.sparkSession.createDataFrame(sample, SCHEMA)
    model = language_id.train(frame, F.col("doc_id") % 5 != 0)
    got = by_id(language_id.identify(frame, model, F.col("doc_id") % 5 == 0))
    assert all(got[i]["lang_pred"] == k and not got[i]["rejected"] for i, _, k, *_ in sample)
    odd = by_id(language_id.identify(docs, model, F.lit(False)))
    for i, t, *_ in rows:
        assert (odd[i]["lang_pred"] == "und") == (not any(c.isalpha() for c in t or ""))
        assert 0 <= odd[i]["score"] <= 1
    assert language_id.train(empty, F.lit(True)) is None
    assert by_id(language_id.identify(docs, None, F.lit(True)))[0]["lang_pred"] == "und"


def test_a_language_of_two_documents_is_learned(spark):
    rng = random.Random(8)
    text = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 6))) for _ in range(60))
    sample = [(i, text("abcd"), "aa", "s", 0) for i in range(200)] + [(i, text("wxyz"), "ww", "s", 0) for i in (900, 901)]
    model = language_id.train(spark.createDataFrame(sample, SCHEMA), F.lit(True))
    shown = spark.createDataFrame([(1, text("abcd"), None, "s", 0), (2, text("wxyz"), None, "s", 0)], SCHEMA)
    got = by_id(language_id.identify(shown, model, F.lit(True)))
    assert (got[1]["lang_pred"], got[2]["lang_pred"]) == ("aa", "ww") and not got[1]["rejected"] and not got[2]["rejected"]


def test_kneser_ney_sums_to_one():
    rng = random.Random(5)
    counts = {}
    for name, letters in (("a", "abcd "), ("b", "bcde ")):
        texts = pa.array(["".join(rng.choice(letters) for _ in range(300)) for _ in range(3)], pa.string())
        stream, at, _, _ = language_id.symbols(texts, language_id.ORDER - 1)
        counts[name] = np.unique(language_id.packed(stream, at), return_counts=True)
    model = language_id.kneser_ney(counts)
    for context in ("abc", "bcd", " ab", "zzz", "  a"):
        symbols = [0 if c == " " else ord(c) for c in context]
        ends = [0, *map(ord, "abcdez")]
        stream = np.array([s for e in ends for s in [*symbols, e]], np.uint64)
        logs = model.symbol_logs(stream, np.arange(3, len(stream), 4))
        assert np.allclose(np.exp(logs).sum(0), 1, atol=1e-5)  # z stands for all unseen symbols


def test_lm_scoring_base_is_exact(docs, rows):
    held_out = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    got = by_id(lm_scoring.score_texts(docs, F.pmod(lm_scoring.id_crc(F.col("doc_id")), F.lit(7)) == 2))
    tokens = {i: words(low(t)) + ["\0end"] for i, t, *_ in rows}
    counts = collections.Counter(w for i, ws in tokens.items() if not held_out(i) for w in ws)
    n, v = sum(counts.values()), len(counts)
    for i, ws in tokens.items():
        r = got[i]
        assert math.isclose(r["base_score"], sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held_out(i), len(ws), sum(counts[w] > 0 for w in ws), n)
        assert math.isfinite(r["score"]) and r["score"] < 0


@pytest.mark.parametrize("bits", [False, True])
def test_token_files_round_trip(docs, rows, bits):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer, at = Tokenizer.from_file(path), 0
    got = by_id(token_files.read_index(token_files.write_ids(docs, path, end=2, block=512, bits=bits), block=512, bits=bits))
    for i, t, *_ in sorted(rows):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_decontamination_catches_other_numbers_and_names(spark):
    item = "Yesterday in the old market Anna bought 12 apples for 30 cents each while Peter sold 45 kg of plums to Anna and paid her 12 coins back"
    other = item.replace("Anna", "Clara").replace("Peter", "Hugo").replace("12", "17").replace("45", "8")
    mixed = item.replace("Anna", "Clara", 1).replace("12", "17", 1)
    clean = "Nothing of this kind was ever asked before and the weather stayed fine for Anna and for Peter on all 12 days of that long month"
    docs = spark.createDataFrame([(1, "Before it. " + item + " after"), (2, "x y z\n" + other), (3, clean), (4, None), (5, ""), (6, mixed), (None, item)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (8, "too short"), (9, None)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(docs, bench, conflicts=0.0).collect()}
    assert {(1, 7), (2, 7)} <= got and not {d for d, _ in got} & {3, 4, 5}
    assert (6, 7) not in got
    assert not decontamination.contaminated(docs, bench.limit(0)).collect()


def test_decontamination_of_changed_case_and_first_names(spark):
    item = "Yesterday in the old market Anna bought 12 apples for 30 cents each while Peter sold 45 kg of plums to Anna and paid her 12 coins back"
    opening = "Anna bought twelve apples for Peter at the old market"
    street = "Der Gärtner fand in der großen Straße am Śluza einen Жёлтый Mantel und trug ihn weg"
    texts = [item.upper(), "so " + item.lower() + " it was", item.upper().replace("12", "17"), "He heard that " + opening.replace("Anna", "Clara"), street.upper(), "Clara slept all day while Hugo read about Anna and Peter in the evening papers of that town"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (8, opening), (9, street)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(docs, bench).collect()}
    assert got == {(0, 7), (1, 7), (2, 7), (3, 8), (4, 9)}


def brute_force_leaks(docs, bench):
    """All windows of all diagonals of all pairs, without filter, join or folding."""
    size, found = decontamination.WINDOW, {}

    def windows(text, item):
        t = decontamination.Template(pa.array([text], pa.string()))
        return [(h, a, k, t.surfaces(a, size), t.slots(a, size, k)) for a, h, k in zip(*[x.tolist() for x in t.windows(size, item)], strict=True)]

    for key, text in docs:
        for item, other in bench:
            mine, theirs = windows(text, False), windows(other, True)
            lines = {}
            for h, a, k, words, slots in mine:
                for g, b, m, item_words, _ in theirs:
                    if h == g:
                        lines.setdefault(a - b, {})[a, b, k == m == decontamination.TYPED, tuple(slots)] = {"at": a, "item_at": b, "words": words, "item_words": item_words, "slots": slots, "typed": k == m == decontamination.TYPED}
            whole, typed = (max((w[1] for w in theirs if w[2] in kinds), default=0) + size for kinds in ((0, 1, 2), (0,)))
            for line in lines.values():
                for pairs, tokens in (([p for p in line.values() if p["typed"]], typed), (list(line.values()), whole)):
                    verdict = decontamination.judge(pairs, size, min(decontamination.COVER, tokens), decontamination.CONFLICTS) if pairs else None
                    if verdict:
                        found[key, item] = max(found.get((key, item), verdict), verdict)
    return found


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(5)
    pool = ["Anna", "Peter", "Hugo", "12", "30", "7", "kg", "the", "market", "sold", "plums", "to", "and", "at.", "paid", "COINS"]
    passage = lambda n: " ".join(rng.choices(pool, k=n))
    bench = [(i, passage(rng.randint(5, 30))) for i in range(8)] + [(90, "one two three four " * 5)]
    docs = []
    for i in range(60):
        words = bench[i % 8][1].split()
        changed = [rng.choice(pool) if rng.random() < (i % 4) * 0.06 else w for w in words]
        docs.append((i, " ".join([passage(9), *changed, passage(9)]) * (1 + i % 2)))
    docs.append((99, "one two three four " * 40))
    tables = spark.createDataFrame(docs + docs[:20], "doc_id long, text string").withColumns({c: F.lit("x") for c in ("hash", "key", "item", "item_id", "words", "diagonal")}), spark.createDataFrame(bench, "item_id long, text string").withColumn("doc_id", F.lit("y"))
    got = {(r["doc_id"], r["item_id"]): (r["n_tokens"], r["n_windows"], r["n_slots"], -r["n_conflicts"]) for r in decontamination.contaminated(*tables).collect()}
    assert got == brute_force_leaks(docs, bench) and len(got) > 20 and (99, 90) in got


def test_decontamination_folds_equal_diagonals(spark):
    docs = spark.createDataFrame([(1, "one two three four five " * 2000)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "one two three four five " * 32)], "item_id long, text string")
    started = time.monotonic()
    assert [tuple(r) for r in decontamination.contaminated(docs, bench).collect()] == [(1, 7, 153, 160, 0, 0)]
    assert time.monotonic() - started < 15


def test_empty_tables(spark, empty):
    import public_tokenizers

    assert not substring_dedup.drop_repeated_substrings(empty).collect()
    assert not jaccard.link_components(empty).collect()
    assert not line_dedup.drop_repeated_lines(empty).collect()
    assert not sharding.shard_records(empty, 3).collect()
    assert not mixing.mix_plan(empty).collect()
    assert not mixing.mix(empty).collect()
    assert not lm_scoring.score_texts(empty, F.lit(False)).collect()
    assert not token_files.read_index(token_files.write_ids(empty, public_tokenizers.path("byte_bpe_50k.json"))).collect()
    assert not decontamination.contaminated(empty, spark.createDataFrame([], "item_id long, text string")).collect()


def test_null_keys_repeated_rows_and_clashing_columns(spark, clashing):
    import public_tokenizers

    n = clashing.count()
    assert substring_dedup.drop_repeated_substrings(clashing, window=20, anchor=5).count() == n
    linked = jaccard.link_components(clashing).collect()
    assert len(linked) == n and [r["component_id"] for r in linked if r["doc_id"] is None] == [None]
    assert line_dedup.drop_repeated_lines(clashing).count() == n
    assert sharding.shard_records(clashing, 3).count() == n
    assert mixing.mix_plan(clashing).count() == n
    assert set(mixing.mix(clashing).columns) == {*clashing.columns, "mix_shard", "mix_order"}
    assert lm_scoring.score_texts(clashing, F.lit(False)).count() == n
    assert token_files.read_index(token_files.write_ids(clashing, public_tokenizers.path("byte_bpe_50k.json"))).count() == n
    model = language_id.train(clashing, F.lit(True))
    assert language_id.identify(clashing, model, F.lit(False)).count() == n
    assert language_id.keep_identified(clashing, model).columns == clashing.columns


def test_leaks_of_null_and_repeated_rows_and_clashing_columns(spark, clashing):
    item = " ".join(f"word{i}" for i in range(40))
    rows = [(None, item, "en", "s", 1), (7001, item, "en", "s", 1), (7001, "nothing here", "en", "s", 1), (7001, item, "en", "s", 1), (7002, None, "en", "s", 1), (7003, "", "en", "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for name in ("key", "hash", "at", "words", "slots", "typed", "item", "face", "item_id", "diagonal"):
        docs = docs.withColumn(name, F.lit("x"))
    bench = spark.createDataFrame([(1, item), (1, item), (None, item), (2, None), (3, "")], "item_id long, text string").withColumn("key", F.lit("x")).withColumn("doc_id", F.lit("x"))
    got = [(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(docs, bench).collect()]
    assert got == [(7001, 1)]


@pytest.mark.parametrize("block", [2048, 2])
def test_jaccard_of_one_key_with_several_texts(spark, block):
    rng = random.Random(4)
    base = [" ".join(rng.choice("abcdefgh") * 3 for _ in range(60)) for _ in range(3)]
    near = [b + " tail" for b in base]
    rows = [(1, base[0], "en", "s", 0), (1, base[1], "en", "s", 0), (2, near[0], "en", "s", 0), (3, near[1], "en", "s", 0), (4, base[2], "en", "s", 0), (5, near[2], "en", "s", 0), (5, near[2], "en", "s", 0)]
    got = [(r["doc_id"], r["component_id"]) for r in jaccard.link_components(spark.createDataFrame(rows, SCHEMA), block=block).collect()]
    assert sorted(got) == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (5, 4)]


def test_windows_and_runs():
    w = Words(pa.array(["a b c", "d", "e f g h"], pa.string()))
    at, row = windows(w.first, w.count, 3)
    assert at.tolist() == [0, 4, 5] and row.tolist() == [0, 2, 2]
    assert len(runs_hash(w.hash, 3)) == 6
    assert hashlib.sha256(w.text(0, 3)).hexdigest() == hashlib.sha256(b"a b c").hexdigest()
