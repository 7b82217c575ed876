"""Rows that every operator has to stand: nulls, empty and long texts, repeats, extra columns with clashing names."""

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike november oscar papa".split()


def sentence(n: int, seed: int = 0) -> str:
    return " ".join(WORDS[(i * 7 + seed * 3 + i * i * (seed + 1)) % len(WORDS)] + str((i * seed) % 11) for i in range(n)).capitalize() + "."


LONG = " ".join(sentence(12, s) for s in range(3000))
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank. It was a fine day.", "en", "a", 84),
    (2, None, "en", "a", None),
    (3, "", "de", None, 0),
    (4, "   \n\t ", None, "b", 6),
    (5, "The quick brown fox jumps over the lazy dog near the river bank. It was a fine day.", "en", "b", 84),
    (5, "The quick brown fox jumps over the lazy dog near the river bank. It was a fine day.", "en", "b", 84),
    (None, "Der schnelle braune Fuchs springt über den faulen Hund.", "de", "c", 55),
    (7, LONG, "en", "c", len(LONG)),
    (8, "!!! ??? ...", "fr", "c", 11),
    (9, "😀 émoji ünïcode ﬁ", "fr", None, 17),
    (10, "a\u0001b. c", None, None, 7),
]


def docs(spark, rows=ROWS):
    return spark.createDataFrame(rows, SCHEMA)


def clashing(df):
    """Extra columns named like what operators use inside."""
    for name in ("hi", "lo", "key", "rank", "part", "pos", "h", "starts", "units", "__extra", "n_words", "digest", "content", "score", "toxic", "Bin_id", "__id", "__rest", "__starts", "__gone", "own_id", "gone", "found", "row", "language", "copies"):
        df = df.withColumn(name, F.lit(name))
    return df


def collected(df):
    return [r.asDict(recursive=True) for r in df.collect()]
