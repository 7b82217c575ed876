"""Text functions as Column builders."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _decompose(text: Column) -> Column:
    """Compatibility decomposition by ICU, which Spark ships, inside the JVM. ``reflect`` would do the same, but as nondeterministic it keeps filters and joins from passing below it."""
    jvm = SparkContext._active_spark_context._jvm
    util, objects, types = jvm.org.apache.spark.sql.classic.ExpressionUtils, jvm.org.apache.spark.sql.catalyst.expressions.objects, jvm.org.apache.spark.sql.types
    loaded = lambda name: jvm.java.lang.Class.forName(name, True, jvm.java.lang.Thread.currentThread().getContextClassLoader())
    of = lambda *x: jvm.PythonUtils.toSeq(list(x))
    string = types.ObjectType(loaded("java.lang.String"))

    def static(name: str, kind, function: str, *args):
        return objects.StaticInvoke(loaded(name), kind, function, of(*args), of(), True, True, True, jvm.scala.Option.empty())

    plain = objects.Invoke(util.expression(text._jc), "toString", string, of(), of(), True, True, True)
    apart = static("com.ibm.icu.text.Normalizer", string, "decompose", plain, util.expression(F.lit(True)._jc))
    return Column(util.column(static("org.apache.spark.unsafe.types.UTF8String", types.DataType.fromDDL("string"), "fromString", apart)))


def unmarked(text: Column | str) -> Column:
    """Decomposed, without marks. Only texts with a character beyond ASCII are taken apart; none reaches Python."""
    text = _col(text)
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.regexp_replace(_decompose(text), r"\p{M}+", "")).otherwise(text)


def normalize(text: Column | str) -> Column:
    """Decomposed, without marks, lower case; all but letters, numbers, white space and hyphens become spaces."""
    return F.regexp_replace(F.lower(unmarked(text)), r"[^\p{L}\p{N}\s-]", " ")


def plain_normalize(text: str) -> str:
    """``normalize`` of a Python string, white space collapsed."""
    t = "".join(c for c in unicodedata.normalize("NFKD", text) if unicodedata.category(c)[0] != "M").lower()
    return " ".join("".join(c if unicodedata.category(c)[0] in "LN" or c in "-" else " " for c in t).split())


def tokenize(text: Column | str) -> Column:
    """Terms in order; their positions are their places in the array, from 0. What ``normalize`` makes a space ends a term, as white space does."""
    return F.filter(F.split(F.lower(unmarked(text)), r"[^\p{L}\p{N}-]+"), lambda x: x != "")


def lite_normalize(text: Column | str) -> Column:
    return F.trim(F.lower(_col(text)))


def lite_tokenize(text: Column | str) -> Column:
    """Runs of letters and numbers, lower case: hyphens split, accents stay."""
    return F.filter(F.split(F.lower(_col(text)), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def strip_markdown(text: Column | str) -> Column:
    """Code, emphasis, heading marks and links reduced to their words, white space collapsed."""
    t = _col(text)
    for pattern, to in (
        (r"(?s)```.*?```", " "),
        (r"`[^`]*`", " "),
        (r"[*_~]+", " "),
        (r"(?m)^#+\s*", ""),
        (r"\[([^\]]+)\]\([^)]+\)", "$1"),
        (r"[\[\]()]", " "),
    ):
        t = F.regexp_replace(t, pattern, to)
    return collapse(t)


def phrases(query: Column | str) -> Column:
    """The segments between quotation marks, straight or curly, as arrays of raw words."""
    found = F.regexp_extract_all(_col(query), F.lit(r'["“”]([^"“”]*)["“”]'), 1)
    cut = F.transform(found, lambda p: F.filter(F.split(F.trim(p), r"\s+"), lambda w: w != ""))
    return F.filter(cut, lambda p: F.size(p) > 0)


def joined(tokens: Column) -> Column:
    """Tokens as one string in which a phrase is a substring."""
    return F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" "))


def contains_phrase(tokens: Column, phrase: Column) -> Column:
    """Whether the phrase, an array of terms, occurs contiguously. An empty phrase doesn't."""
    return (F.size(phrase) > 0) & F.contains(joined(tokens), joined(phrase))


def ngrams(normalized: Column, n: int = 5) -> Column:
    """Distinct character n-grams; a shorter text is its own only one; an empty one has none."""

    def of(chars: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.size(chars) - n + 1), lambda i: F.array_join(F.slice(chars, i, F.lit(n)), ""))
        return F.when(F.size(chars) == 0, F.array().cast("array<string>")).when(F.size(chars) < n, F.array(F.array_join(chars, ""))).otherwise(F.array_distinct(grams))

    # Characters are taken apart once: a substring by position would count from the start each time.
    return F.transform(F.array(F.regexp_extract_all(normalized, F.lit("(?s)."), F.lit(0))), of)[0]


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; 1 if both are empty."""
    both = F.size(F.array_intersect(a, b)).cast("double")
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(both / F.size(F.array_union(a, b)))


def plain_jaccard(a: str, b: str, n: int = 5) -> float:
    """Of the distinct n-grams of two texts: a shorter text is its own only one, an empty one has none; 1 if both are empty."""
    if not a and not b:
        return 1.0
    letters, codes = np.unique(np.frombuffer((a + b).encode("utf-32-le", "replace"), dtype=np.uint32), return_inverse=True)
    if min(len(a), len(b)) < n or len(letters) ** n >= 1 << 63:
        x, y = ({t[i : i + n] for i in range(len(t) - n + 1)} if len(t) >= n else {t} - {""} for t in (a, b))
        return len(x & y) / len(x | y)
    whole = np.zeros(len(codes) - n + 1, np.int64)
    for k in range(n):
        whole = whole * len(letters) + codes[k : len(codes) - n + 1 + k]
    x, y = np.unique(whole[: len(a) - n + 1]), np.unique(whole[len(a) :])
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)


def text_jaccard(a: Column, b: Column) -> Column:
    """``jaccard`` of the n-grams of two normalized texts, which are made and dropped pair by pair."""

    @F.pandas_udf("double")
    def likeness(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if s is None or t is None else plain_jaccard(s, t) for s, t in zip(x, y)], dtype="float64")

    return likeness(a, b)


def kns_signature(text: Column | str) -> Column:
    """struct(s1, s2, s3) of three modular sums over code points, summed by NumPy for whole Arrow batches."""

    @F.pandas_udf("s1 bigint, s2 bigint, s3 bigint")
    def signed(s: pd.Series) -> pd.DataFrame:
        rows = []
        for t in s:
            c = np.frombuffer((t or "").encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.int64)
            i = np.arange(len(c))
            rows.append((c.sum() % 257, (c * (i + 1)).sum() % 263, (c << 1 ^ (i + 7)).sum() % 269))
        return pd.DataFrame(rows, columns=["s1", "s2", "s3"], dtype="int64")

    return signed(_col(text))


def kns_distance(a: Column, b: Column) -> Column:
    """Mean circular distance, 0 to 1."""

    def part(name: str, prime: int) -> Column:
        apart = F.abs(a[name] - b[name])
        return F.least(apart, prime - apart) / float(prime)

    return (part("s1", 257) + part("s2", 263) + part("s3", 269)) / 3.0


def fnv32(text: Column) -> Column:
    """FNV-1a over UTF-16 code units, eight hexadecimal digits. A character beyond the BMP counts as its two surrogates."""

    @F.pandas_udf("string")
    def hashed(s: pd.Series) -> pd.Series:
        there = s[s.notna()]
        return pd.Series([f"{h:08x}" for h in fnv32s(list(there))], there.index, dtype=object).reindex(s.index)

    return hashed(text)


def fnv32s(texts: list[str]) -> list[int]:
    """``plain_fnv32`` of many texts, unit by unit of all of them at once; the few that go on longest by themselves."""
    units = [np.frombuffer(t.encode("utf-16-le", "surrogatepass"), dtype=np.uint16) for t in texts]
    sizes = np.array([len(u) for u in units], np.int64)
    order = np.argsort(-sizes, kind="stable")
    starts, flat = (np.cumsum(sizes) - sizes)[order], np.concatenate(units) if units else np.zeros(0, np.uint16)
    h = np.full(len(texts), 2166136261, np.uint64)
    ends, j = np.sort(sizes), 0
    while (n := len(texts) - int(np.searchsorted(ends, j, side="right"))) > 8:
        h[:n] = (h[:n] ^ flat[starts[:n] + j]) * np.uint64(16777619) & np.uint64(0xFFFFFFFF)
        j += 1
    for i in range(n):
        h[i] = plain_fnv32(texts[order[i]].encode("utf-16-le", "surrogatepass")[2 * j :].decode("utf-16-le", "surrogatepass"), int(h[i]))
    out = np.empty(len(texts), np.uint64)
    out[order] = h
    return out.tolist()


def plain_fnv32(units: str, h: int = 2166136261) -> int:
    """FNV-1a over UTF-16 code units of a Python string, going on from ``h``."""
    for unit in np.frombuffer(units.encode("utf-16-le", "surrogatepass"), dtype=np.uint16).tolist():
        h = (h ^ unit) * 16777619 & 0xFFFFFFFF
    return h


def fnv64(text: str) -> str:
    """FNV-1a over code points modulo 2**64, sixteen digits (driver-side and inside Pandas functions)."""
    h = 0xCBF29CE484222325
    for c in text:
        h = (h ^ ord(c)) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return f"{h:016x}"


def fnv64_column(text: Column) -> Column:
    @F.pandas_udf("string")
    def hashed(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else fnv64(t))

    return hashed(text)


def sentences(text: Column | str) -> Column:
    unix = F.regexp_replace(_col(text), "\r\n", "\n")
    return F.filter(F.transform(F.split(unix, r"(?<=[.?!])\s+"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def opening(text: Column | str) -> Column:
    """The first of ``sentences`` of a text without white space before it; the rest isn't taken apart."""
    unix = F.regexp_replace(_col(text), "\r\n", "\n")
    return F.regexp_replace(F.get(F.split(unix, r"(?<=[.?!])\s+", 2), F.lit(0)), r"^\s+|\s+$", "")


def first_sentence(text: Column) -> Column:
    """A first sentence of 10 to 200 characters, or the first 160 characters."""
    found = F.regexp_extract(text, r"^(.{10,200}?[.!?])\s", 1)
    return F.when(found != "", found).otherwise(F.substring(text, 1, 160))


def truncate(text: Column, n: int) -> Column:
    return F.when(F.length(text) <= n, text).otherwise(F.concat(F.substring(text, 1, n), F.lit("…")))


def claim_label(label: Column | str) -> Column:
    return F.substring(collapse(normalize(label)), 1, 200)


def memory_label(label: Column | str) -> Column:
    """Dotted path: separators and anything else become dots, runs of dots one, none at the ends."""
    t = F.trim(F.lower(unmarked(label)))
    t = F.regexp_replace(t, r"[^\p{L}\p{N}_-]+", ".")
    return F.regexp_replace(F.regexp_replace(t, r"\.+", "."), r"^\.|\.$", "")


def plain_label(label: str) -> str:
    """``memory_label`` of a Python string."""
    t = "".join(c for c in unicodedata.normalize("NFKD", label) if unicodedata.category(c)[0] != "M").lower().strip()
    return re.sub(r"\.+", ".", re.sub(r"[^\w-]+", ".", t)).strip(".")


def normalized_labels(labels: Column) -> Column:
    """An array of labels, each normalized; without empty ones, distinct, sorted."""

    @F.pandas_udf("array<string>")
    def normal(s: pd.Series) -> pd.Series:
        return s.map(lambda a: sorted({p for x in (a if a is not None else ()) if x is not None and (p := plain_label(x))}))

    return normal(labels)


def memory_labels(labels: Column) -> Column:
    """Of normalized labels: without empty ones, distinct, sorted."""
    return F.array_sort(F.array_distinct(F.filter(labels, lambda x: x != "")))


def prefix_match(value: Column, filters: list[str]) -> Column:
    """Whether a dotted value is one of the filters or below one."""
    out = F.lit(False)
    for f in filters:
        out = out | (value == f) | value.startswith(f + ".")
    return out


def overlap(query: Column, field: Column) -> Column:
    """Share of the distinct query terms that the field holds; 0 if either is empty."""
    q = F.array_distinct(query)
    return F.when((F.size(q) == 0) | (F.size(field) == 0), 0.0).otherwise(F.size(F.array_intersect(q, field)).cast("double") / F.size(q))


def listed(text: Column) -> Column:
    """A JSON array, a list by line or a list by comma: trimmed, distinct, the first twenty."""
    parsed = F.from_json(text, "array<string>")
    lines = F.split(text, r"\n")
    raw = F.when(F.trim(text).startswith("["), parsed).when(F.contains(text, F.lit("\n")), lines).otherwise(F.split(text, ","))
    return F.slice(F.array_distinct(F.filter(F.transform(raw, lambda x: F.trim(x)), lambda x: x != "")), 1, 20)
