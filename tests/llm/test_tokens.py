import random

import pytest

from lorewell.llm import tokens as T

from . import cases


def test_safe_boundaries_change_nothing():
    rng = random.Random(1)
    bpe = T.encoding()
    for _ in range(60):
        text = "".join(rng.choice(["a", "Zz", " ", "  ", "\n", "'s", "1", "é", "😀", "...", " 'll", "\t", "don't", "<|endoftext|>"]) for _ in range(400))
        parts = T.chunks(text, 20)
        assert "".join(parts) == text
        assert [t for p in parts for t in bpe.encode_ordinary(p)] == bpe.encode_ordinary(text)


def test_long_text():
    text = cases.LONG + "x" * 70_000 + " end"
    assert len(T.chunks(text)) > 3
    assert T.decode(T.encode(text)) == text
    assert T.encode(cases.LONG) == T.encoding().encode_ordinary(cases.LONG)


def test_decoding_is_by_bytes():
    ids = T.encode("😀é")
    assert T.encoding().decode_bytes(ids) == "😀é".encode()
    assert T.decode(ids[:1] + ids[1:]) == "😀é"


def test_byte_bpe_cases(spark):
    df = cases.clashing(cases.docs(spark))
    out = cases.collected(T.encode_documents(df))
    assert len(out) == len(cases.ROWS)
    for r in out:
        if r["doc_id"] == 2:
            assert r["token_ids"] is None and r["n_tokens"] is None and r["round_trip"] is None
        else:
            assert r["round_trip"] and r["n_tokens"] == len(r["token_ids"])
        if r["doc_id"] == 3:
            assert r["token_ids"] == []
    back = {r["doc_id"]: r["text"] for r in T.decode_documents(T.encode_documents(df)).collect()}
    assert back == {r[0]: r[1] for r in cases.ROWS}
    assert T.encode_documents(df.limit(0)).count() == 0


@pytest.fixture
def counted(monkeypatch, tmp_path):
    return f"file://{tmp_path}/cache"


def plain(text):
    import re

    text = re.sub(r"^[ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+$", "", re.sub(r"\r\n?", "\n", text or ""))
    return len(T.encoding().encode_ordinary(text)) if text else 0


def test_counts_and_cache(spark, counted):
    df = cases.clashing(cases.docs(spark))
    out = cases.collected(T.count_tokens(df, counted))
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in out) == sorted((str(r[0]), plain(r[1])) for r in cases.ROWS)
    folder = f"{counted}/{T.version()}"
    stored = T.cached(spark, folder).count()
    assert stored == len({(r[1] or "").strip() for r in cases.ROWS} - {""})
    again = T.count_tokens(df, counted).count()  # everything is known: nothing is appended
    assert again == len(out) and spark.read.parquet(folder).count() == stored
    more = cases.docs(spark, [(50, "  brand new text\r\n", None, None, 0), (51, "brand new text", None, None, 0)])
    assert {r["n_tokens"] for r in T.count_tokens(more, counted).collect()} == {plain("brand new text")}
    assert spark.read.parquet(folder).count() == stored + 1
    assert T.count_tokens(df.limit(0), counted).count() == 0


def test_stored_counts_are_used(spark, counted):
    """What the cache says is what counts: a stored figure isn't computed again."""
    df = cases.docs(spark, [(1, "hello world", None, None, 0)])
    import hashlib

    spark.createDataFrame([(hashlib.md5(b"hello world").digest(), 77)], "digest binary, n_tokens long").write.parquet(f"{counted}/{T.version()}")
    assert T.count_tokens(df, counted).first()["n_tokens"] == 77
