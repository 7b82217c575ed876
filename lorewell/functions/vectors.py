"""Vector functions as Column builders."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, also where lambdas inside use it for each element."""
    return F.transform(F.array(value), body)[0]


def dot(a: Column, b: Column) -> Column:
    """0 for vectors of different or no length."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), total).otherwise(0.0)


def unit(v: Column) -> Column:
    """v / |v|; a zero vector stays."""

    def scaled(x: Column) -> Column:
        return F.transform(x["v"], lambda y: F.when(x["norm"] > 0, y.cast("double") / x["norm"]).otherwise(0.0))

    return let(F.struct(v.alias("v"), F.sqrt(dot(v, v)).alias("norm")), scaled)


def quantize(v: Column) -> Column:
    """struct(q, scale): the unit vector as integers of -127 to 127 and their scale; halves round up."""

    def whole(x: Column) -> Column:
        q = F.transform(x["u"], lambda y: F.when(x["scale"] > 0, F.greatest(F.lit(-127), F.least(F.lit(127), F.floor(y / x["scale"] + 0.5)))).otherwise(0).cast("int"))
        return F.struct(q.alias("q"), F.coalesce(x["scale"], F.lit(0.0)).alias("scale"))

    def scaled(u: Column) -> Column:
        return F.struct(u.alias("u"), (F.array_max(F.transform(u, lambda x: F.abs(x))) / 127.0).alias("scale"))

    return let(let(F.transform(unit(v), lambda x: x.cast("float").cast("double")), scaled), whole)


def half(x: Column) -> Column:
    """Rounded to IEEE half precision and back, as stored scales are."""

    @F.pandas_udf("double")
    def to_half(s: pd.Series) -> pd.Series:
        return pd.Series(s.to_numpy(dtype=np.float32).astype(np.float16).astype(np.float64))

    return to_half(x)


def encode_half(x: float) -> int:
    return int(np.float16(x).view(np.uint16))


def decode_half(bits: int) -> float:
    return float(np.uint16(bits).view(np.float16))


def int_dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("long") * y.cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)


def clamp01(x: Column) -> Column:
    good = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.when(good, F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))).otherwise(0.0)
