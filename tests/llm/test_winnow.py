import random

import numpy as np

from lorewell.llm import winnow as W

from . import cases


def brute(text):
    lower, word, _ = W.characters()
    letters = [(i, int(lower[ord(c)])) for i, c in enumerate(text) if word[ord(c)]]
    n = len(letters) - W.K + 1
    hashes = [(sum(letters[i + t][1] * pow(W.BASE, t, 1 << 64) for t in range(W.K)) % (1 << 64)) for i in range(n)]
    size = min(W.WINDOW, max(n, 0))
    found = set()
    for i in range(n - size + 1 if n > 0 else 0):
        least = min(hashes[i : i + size])
        j = max(j for j in range(i, i + size) if hashes[j] == least)
        found.add((letters[j][0], hashes[j] - (hashes[j] >> 63 << 64)))
    return sorted(found)


def both(text):
    return list(zip(*(x.tolist() for x in W.fingerprints(text))))


def test_against_brute_force():
    rng = random.Random(2)
    texts = ["", "short", "a" * 150, "ab, " * 200, "é" * 24, "é" * 25, "x1" * 70] + ["".join(rng.choice("abc éÜ.1") for _ in range(rng.randint(30, 700))) for _ in range(25)]
    for t in texts:
        assert both(t) == brute(t)


def test_blocks_of_long_texts(monkeypatch):
    rng = random.Random(3)
    text = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    whole = both(text)
    monkeypatch.setattr(W, "BLOCK", 1 << 8)
    W._powers.cache_clear()
    parts = []
    hashes = W.gram_hashes
    try:
        lower, word, _ = W.characters()
        codes = np.array([ord(c) for c in text], dtype=np.uint32)
        where = np.flatnonzero(word[codes])
        monkeypatch.setattr(W, "chosen", lambda h, window=W.WINDOW: _plain(h, window))
        parts = both(text)
    finally:
        monkeypatch.undo()
        W._powers.cache_clear()
    assert parts == whole and hashes is W.gram_hashes and len(where) > 2000


def _plain(h, window):
    out = []
    for i in range(max(1, len(h) - window + 1) if len(h) else 0):
        part = h[i : i + window]
        j = i + max(np.flatnonzero(part == part.min()))
        if not out or out[-1] != j:
            out.append(int(j))
    return np.array(out, dtype=np.int64)


def test_guarantee():
    """Texts that share 50 letters share a fingerprint at the same place of the shared part."""
    rng = random.Random(4)
    for _ in range(40):
        shared = "".join(rng.choice("abcdefghij") for _ in range(W.K + W.WINDOW - 1))
        a, b = ("".join(rng.choice("klmnop") for _ in range(rng.randint(0, 200))) for _ in range(2))
        one = {(p - len(a), h) for p, h in both(a + shared + b)}
        two = {(p - len(b), h) for p, h in both(b + shared + a)}
        assert {x for x in one & two if 0 <= x[0] <= W.WINDOW}


def test_cases(spark):
    df = cases.clashing(cases.docs(spark))
    out = cases.collected(W.winnow(df))
    ids = [r["doc_id"] for r in out]
    assert not {2, 3, 4, 8, 9, 10} & set(ids)
    assert ids.count(5) == 2 * ids.count(1) > 0 and None in ids
    assert sorted((r["pos"], r["fingerprint"]) for r in out if r["doc_id"] == 7) == both(cases.LONG)
    assert W.winnow(df.limit(0)).count() == 0


def test_short_passages_share_a_fingerprint(spark, data):
    """Every benchmark text that a document holds, and any 50 letters, leave a common fingerprint."""
    prints_of = lambda t: set(W.fingerprints(t)[1].tolist())
    letters = lambda t: "".join(c for c in t.lower() if c.isalnum())
    items = [r["text"] for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    docs = [r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect() if r["text"]]
    rng = random.Random(5)
    for size in (50, 55, 66, 99):
        for _ in range(40):
            items.append("".join(rng.choice("abcdefghij") for _ in range(size)))
            docs.append("".join(rng.choice("klmnop") for _ in range(80)) + " " + items[-1] + " " + "".join(rng.choice("klmnop") for _ in range(80)))
    plain, prints = [letters(d) for d in docs], [prints_of(d) for d in docs]
    held = [(i, d) for i in items for d in range(len(docs)) if letters(i) in plain[d]]
    assert len(held) >= 160 and min(len(letters(i)) for i, _ in held) == 50
    assert all(prints_of(i) & prints[d] for i, d in held)
