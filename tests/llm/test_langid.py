import math

import numpy as np

from lorewell.llm import langid as L

from . import cases


def test_codewords():
    for k in range(2, 8):
        code = L.codewords(k)
        assert code.shape == (k, 2 ** (k - 1) - 1)
        assert all((code[i] != code[j]).sum() == 2 ** (k - 2) for i in range(k) for j in range(i))
        assert (np.abs(code.sum(0)) < k).all()
    code = L.codewords(20)
    assert min((code[i] != code[j]).sum() for i in range(20) for j in range(i)) >= 15


def test_wrong_bits_are_corrected():
    code = L.codewords(4)
    model = L.Model(["a", "b", "c", "d"], code, np.zeros((1, 7)), np.ones(7))
    for k in range(4):
        for bit in range(7):
            margins = 3 * code[k].copy()
            margins[bit] *= -1
            best, _, apart = model.decode(margins)
            assert best == k and apart > 0
    assert model.decode(np.zeros(7))[2] == 0  # nothing known: ambiguous


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    train = docs.where("doc_id % 2 = 0")
    model = L.train(train, 60)
    held = L.identify(docs.where("doc_id % 2 = 1"), model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    right = sum(r["lang_pred"] == r["lang"] for r in held)
    assert right / len(held) > 0.97
    assert sum(r["rejected"] for r in held) / len(held) < 0.01
    assert all(r["lang_pred"] in {"en", "de", "fr", "es", "und"} for r in held)


def test_sample_is_bounded(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = L.sample(docs, 5)
    count = {lang: sum(x == lang for _, _, x in rows) for _, _, lang in rows}
    assert count and max(count.values()) <= 5


def test_cases(spark):
    df = cases.clashing(cases.docs(spark))
    model = L.train(df, 10)
    out = cases.collected(L.identify(df, model))
    assert len(out) == len(cases.ROWS)
    for r in out:
        if r["doc_id"] in (2, 3, 4, 8):
            assert r["lang_pred"] == "und" and r["rejected"] and r["ambiguous"]
    twins = [r for r in out if r["doc_id"] in (1, 5)]
    assert len({(r["lang_pred"], r["loss"]) for r in twins}) == 1
    kept = L.keep_identified(df, model)
    assert kept.columns == df.columns
    assert kept.where("doc_id in (2, 3, 4, 8)").count() == 0 and kept.where("doc_id in (1, 5)").count() == 3
    empty = df.limit(0)
    assert L.identify(empty, L.train(empty)).count() == 0
    assert {r["lang_pred"] for r in L.identify(df, L.train(empty)).collect()} == {"und"}
    one = L.train(df.where("lang = 'en'"), 5)
    assert {r["lang_pred"] for r in L.identify(df.where("doc_id = 1"), one).collect()} == {"en"}


def plain_rows(texts, model):
    """Trigrams, bits, losses and verdicts by loops over Python numbers."""
    out = []
    for text in texts:
        b = [32 if not (97 <= x <= 122 or x >= 128) else x for x in f" {text.lower()} ".encode()]
        b = [32] + [x for i, x in enumerate(b) if x != 32 or (i and b[i - 1] != 32)]
        counts = {}
        for i in range(len(b) - 2):
            h = ((b[i] * 0x9E3779B1 ^ b[i + 1] * 0x85EBCA6B ^ b[i + 2] * 0xC2B2AE35) * 0x27D4EB2F % 2**32) >> 19
            counts[h] = counts.get(h, 0) + 1
        n = sum(counts.values())
        if not n:
            out.append(("und", "", 0.0, 0.0, True, True))
            continue
        norm = math.sqrt(n)
        margins = [sum(math.sqrt(c) / norm * model.weights[h, j] for h, c in counts.items()) + model.weights[-1, j] for j in range(model.code.shape[1])]
        losses = [sum(t * math.log1p(math.exp(-c * m)) for t, c, m in zip(model.trust, word, margins)) / sum(model.trust) for word in model.code]
        order = sorted(range(len(losses)), key=lambda k: (losses[k], k))
        apart = losses[order[1]] - losses[order[0]]
        out.append((model.languages[order[0]], "".join("1" if m > 0 else "0" for m in margins), losses[order[0]], apart, apart < L.MIN_MARGIN, apart + L.SPREAD / math.sqrt(n) < L.MIN_MARGIN))
    return out


def test_against_a_plain_version(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    model = L.train(docs, 30)
    rows = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=lambda r: r[0])
    rows += [(10**6, "12 !!"), (10**6 + 1, "a"), (10**6 + 2, (rows[0][1] + " ") * 2 + rows[50][1])]
    got = sorted(L.identify(cases.docs(spark, [(d, t, None, None, 0) for d, t in rows]), model).collect(), key=lambda r: r["doc_id"])
    for r, (lang, bits, loss, apart, ambiguous, rejected) in zip(got, plain_rows([t for _, t in rows], model), strict=True):
        assert (r["lang_pred"], r["bits"], r["ambiguous"], r["rejected"]) == (lang, bits, ambiguous, rejected)
        assert abs(r["loss"] - loss) < 1e-5 and abs(r["margin"] - apart) < 1e-5


def test_fit_against_plain_descent(monkeypatch):
    """The weights of a few rows, in one chunk or several, are those of the same descent over dense rows in double precision."""
    rows = [("the cat and the dog", "en"), ("der hund und die katze", "de"), ("le chat et le chien", "fr"), ("a dog with the cat", "en"), ("die katze mit dem hund", "de")]
    monkeypatch.setattr(L, "EPOCHS", 12)
    x = np.array([[*L.features(t)[0], 1.0] for t, _ in rows])
    names = ["de", "en", "fr"]
    y = L.codewords(3)[[names.index(lang) for _, lang in rows]]
    share = np.array([1 / sum(b == lang for _, b in rows) for _, lang in rows])
    share = (share / share.sum())[:, None]
    w = np.zeros((x.shape[1], 3))
    speed = w.copy()
    for _ in range(12):
        speed = 0.9 * speed + L.RATE * (x.T @ (y / (1 + np.exp(y * (x @ w))) * share) - L.RIDGE * w)
        w += speed
    for chunk in (1024, 2):
        monkeypatch.setattr(L, "CHUNK", chunk)
        model = L.fit(rows)
        assert model.languages == names and np.abs(model.weights - w).max() < 1e-4
