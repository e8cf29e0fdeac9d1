"""Vectors as array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null where a vector is zero."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size)


def normalized(v: Column) -> Column:
    """The vector at length one; a zero vector stays."""
    n = norm(v)
    bound = F.transform(F.array(F.struct(doubles(v).alias("v"), n.alias("n"))), lambda p: F.transform(p["v"], lambda x: x / p["n"]))  # the norm is taken once
    return F.when(n > 0, bound[0]).otherwise(doubles(v))


def rounded(x: Column, places: int) -> Column:
    """A double at so many places, half away from zero, as DuckDB rounds: by scaling, and what becomes zero keeps its sign."""
    scaled = F.abs(x) * 10.0**places
    whole = F.floor(scaled)
    near = whole + F.when(scaled - whole >= 0.5, 1.0).otherwise(0.0)
    return F.when(F.abs(x) < 1e9, F.signum(x) * near / 10.0**places).otherwise(x)


def hashed(c: Column, width: int = 384) -> Column:
    """A stand-in embedding where no model is at hand: the bytes of the MD5 over 255, padded with zeros."""
    code = F.md5(c)
    head = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: F.conv(F.substring(code, k * 2 + 1, F.lit(2)), 16, 10).cast("double") / 255)
    return F.concat(head, F.array_repeat(F.lit(0.0), width - 16))


def halved(v: Column) -> Column:
    """Components at half precision (eleven significant bits), for vectors of moderate size."""

    def half(x: Column) -> Column:
        scale = F.pow(F.lit(2.0), F.lit(10) - F.floor(F.log2(F.abs(x))))
        return F.when(x == 0, 0.0).otherwise(F.rint(x * scale) / scale)

    return F.transform(doubles(v), half)
