"""A small corpus with copies, near copies, passages, odd rows, and brute-force helpers."""

import random
import re
import string

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def low(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def words(text):
    return WORD.findall(text or "")


def prose(rng, n, alphabet="abcdefghij"):
    return [" ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(2, 7))) for _ in range(1))[:9] for _ in range(n)]


def documents(seed=0, n=60):
    rng = random.Random(seed)
    passage = prose(rng, 70)
    common = "This line is common to many of the documents here, word for word"
    texts = []
    for i in range(n):
        kind = i % 6
        body = prose(rng, rng.randint(20, 160))
        if kind == 1 and texts:
            body = words(texts[rng.randrange(len(texts))] or "") or body
        elif kind == 2 and texts:
            body = words(texts[rng.randrange(len(texts))] or "") or body
            for _ in range(max(1, len(body) // 60)):
                body[rng.randrange(len(body))] = "".join(rng.choice(string.ascii_lowercase) for _ in range(6))
        elif kind == 3:
            at = rng.randrange(len(body))
            body[at:at] = passage[rng.randrange(5) :]
        text = ""
        for w in body:
            text += w + rng.choice([" ", " ", " ", " ", "  ", "\n", "\t"])
        if rng.random() < 0.5:
            text += "\n  " + (common if rng.random() < 0.5 else common.upper()) + " \n"
        texts.append(text)
    odd = [None, "", " \n\t ", "one", "Émile É x　y", "a b", "a b", "\U0001f600 \U0001d4d0", "x" * 5000, " ".join(["the"] * 400), "<|endoftext|> it's 12,5 kg\r\nNext\x0bline"]
    return [(i, t, ["en", "fr", None][i % 3], ["s0", "s0", "s1", None, "s2"][i % 5], len(t or "")) for i, t in enumerate(texts + odd)]
