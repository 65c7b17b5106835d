"""Secret spans against a brute-force scan of every window, and over odd tables."""

import collections
import math
import random
import re
import string
import time

import pyarrow as pa
import pytest
from corpus import SCHEMA, documents
from pyspark.sql import functions as F

from castline.llm import secret_scan
from castline.llm.secret_scan import CLASSES, CharClass

ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def brute(text, classes=CLASSES, allowed=secret_scan.ALLOWED):
    text = text or ""
    base = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 12]
    base += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    base += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    out = list(base)
    for k, c in enumerate(classes, 3):
        for m in re.finditer(f"[{re.escape(c.chars)}]+", text):
            if any(re.fullmatch(p, m[0]) for p in allowed):
                continue
            spans = []
            for i in range(len(m[0]) - c.window + 1):
                counts = collections.Counter(m[0][i : i + c.window]).values()
                if sum(int(c.table()[n]) for n in counts) <= c.limit():
                    a, b = m.start() + i, m.start() + i + c.window
                    if spans and a <= spans[-1][1]:
                        spans[-1][1] = b
                    else:
                        spans.append([a, b])
            out += [(a, k, b) for a, b in spans if not any(s <= a and b <= e for s, _, e in base)]
    kinds = ["assign", "access", "hex", *(c.kind for c in classes)]
    return [(kinds[k], a, b) for a, k, b in sorted(out)]


def secret_texts(seed, n=150):
    rng = random.Random(seed)
    some = lambda chars, size: "".join(rng.choice(chars) for _ in range(size))
    base64, hexes = string.ascii_letters + string.digits + "+/", "0123456789abcdef"
    parts = [
        lambda: some(base64, rng.randint(18, 70)), lambda: some(hexes, rng.randint(10, 60)), lambda: some(hexes.upper(), rng.randint(15, 60)), lambda: "AKIA" + some(string.ascii_uppercase + string.digits, rng.randint(8, 20)),
        lambda: rng.choice(["password", "PASSWD", "Secret", "token", "api_key", "ApiKey"]) + rng.choice(['"', "", "'"]) + " " * rng.randint(0, 2) + rng.choice(":=") + rng.choice(["", " ", ' "', "'"]) + some(base64 + "._-", rng.randint(8, 30)),
        lambda: some(string.ascii_lowercase, rng.randint(1, 30)), lambda: "é" * rng.randint(1, 4), lambda: "x" * 300 + some(base64, 30) + "y" * 200, lambda: "-".join(some(hexes, k) for k in (8, 4, 4, 4, 12)),
        lambda: "src/Main_Java/example-words/Some/Path/OfWords", lambda: some(string.digits, 40), lambda: "\U0001f600",
    ]
    return ["".join(rng.choice(parts)() + rng.choice([" ", "\n", ". ", "", "|"]) for _ in range(rng.randint(0, 12))) for _ in range(n)]


@pytest.mark.parametrize("classes", [CLASSES, (CharClass("dense_any", string.ascii_letters + string.digits, 5, 2.0), CharClass("dense_low", "abcdef0", 3, 1.5))])
def test_spans(spark, classes):
    texts = [None, "", *secret_texts(5), *[t for _, t, *_ in documents()]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in secret_scan.find_secrets(docs, classes=classes).collect()}
    assert got == {i: brute(t, classes) for i, t in enumerate(texts)}
    assert {kind for spans in got.values() for kind, _, _ in spans} >= {"assign", "access", "hex", classes[0].kind, classes[1].kind}


def test_pieces_of_few_windows(spark, monkeypatch):
    monkeypatch.setattr(secret_scan, "STEPS", 3)
    monkeypatch.setattr(secret_scan, "PIECES", 2)
    for text in secret_texts(6, 40):
        frame = secret_scan.text_buffers(pa.array([text]))
        for c in CLASSES:
            row, start, stop = secret_scan.char_runs(*frame, c.chars, c.window)
            high = secret_scan.high_windows(frame[0], start, stop, c)
            want = [i for s, e in zip(start, stop) for i in range(s, e - c.window + 1) if sum(int(c.table()[n]) for n in collections.Counter(frame[0][i : i + c.window].tolist()).values()) <= c.limit()]
            assert high.tolist() == want


def test_limit_is_the_entropy():
    for c in CLASSES:
        for counts in ([1] * c.window, [2] * (c.window // 2), [c.window]):
            bits = -sum(n / c.window * math.log2(n / c.window) for n in counts)
            assert (sum(int(c.table()[n]) for n in counts) <= c.limit()) == (bits >= c.bits)


def test_null_and_repeated_keys_clashing_columns_empty_table(spark):
    secret = "token = 0123456789abcdef0123"
    frame = spark.createDataFrame([(None, secret, "en", "s", 1), (1, secret, "en", "s", 1), (1, secret, "en", "s", 1), (2, None, None, None, None)], SCHEMA)
    for name in ("key", "spans", "kind", "start"):
        frame = frame.withColumn(name, F.lit("x"))
    got = sorted((r["doc_id"] or 0, [tuple(s) for s in r["spans"]]) for r in secret_scan.find_secrets(frame).collect())
    want = [("assign", 0, 28), ("hex", 8, 28)]
    assert got == [(0, want), (1, want), (1, want), (2, [])]
    assert secret_scan.find_secrets(spark.createDataFrame([], SCHEMA)).count() == 0


def test_very_long_strings(spark):
    rng = random.Random(8)
    long = "".join(rng.choices(string.ascii_letters + string.digits, k=1_000_000))
    began = time.time()
    got = secret_scan.find_secrets(spark.createDataFrame([(1, "é " + long), (2, "x" * 3_000_000)], "doc_id long, text string")).collect()
    spans = {r["doc_id"]: r["spans"] for r in got}
    assert spans[2] == [] and sum(s["stop"] - s["start"] for s in spans[1]) > 990_000 and spans[1][-1]["stop"] <= 1_000_002
    assert time.time() - began < 60
