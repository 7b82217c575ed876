"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import sys
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import checkpointed, shared_dir

__all__ = ["characters", "checkpointed", "code_points", "free", "pick", "shared_dir", "table", "texts"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(docs: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, so that no extra column can clash."""
    return docs.select(*(F.col(f"`{n}`") for n in names))


def texts(column: pa.Array) -> list[str]:
    """Python strings, null as the empty string."""
    return ["" if t is None else t for t in column.to_pylist()]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until no column of ``df`` has them, whatever its case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


@lru_cache(maxsize=1)
def characters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each code point: its lower case where that is one, whether it is a letter or number, whether a decimal digit."""
    every = "".join(map(chr, range(0xD800))) + "\0" * 0x800 + "".join(map(chr, range(0xE000, sys.maxunicode + 1)))
    low = every.lower()
    if len(low) == len(every):
        lower = code_points(low).copy()
    else:  # some letters become two: those stay
        lower = np.arange(len(every), dtype=np.uint32)
        for first in range(0, len(every), 256):
            part = every[first : first + 256]
            if len(low := part.lower()) == len(part):
                lower[first : first + 256] = code_points(low)
            else:
                lower[first : first + 256] = [ord(x) if len(x := c.lower()) == 1 else ord(c) for c in part]
    word, digit = (np.fromiter(map(kind, every), bool, len(every)) for kind in (str.isalnum, str.isdecimal))
    lower[0xD800:0xE000] = np.arange(0xD800, 0xE000)
    word[0xD800:0xE000] = digit[0xD800:0xE000] = False
    return lower, word, digit
