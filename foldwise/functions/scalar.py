"""Scalar helpers; all JVM-side expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from foldwise.functions.hashing import hash_u32


def flag(cond: Column) -> Column:
    """boolean as 0/1 int."""
    return cond.cast("int")


def clamp(x: Column, lo: float, hi: float) -> Column:
    """F12"""
    return F.greatest(F.least(x, F.lit(hi)), F.lit(lo))


def string_key(a: str, b: str, sep: str = "_") -> Column:
    """F8: ``str(a) + '_' + str(b)`` for integer columns (floats should be keyed as structs);
    NULL is the word ``nan``, as in the reference, so (NULL, 5) and (5, NULL) differ."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("nan"))
    return F.concat(word(a), F.lit(sep), word(b))


def hash_normal(seed: int, id_col: str | Column) -> Column:
    """A standard normal draw per id (Box-Muller over two hash draws): it does not
    depend on partitioning or row order."""
    u = (hash_u32(f"{seed}a", id_col) + 1) / F.lit(4294967297.0)
    v = hash_u32(f"{seed}b", id_col) / F.lit(4294967296.0)
    return F.sqrt(F.lit(-2.0) * F.log(u)) * F.cos(F.lit(2.0 * math.pi) * v)


def add_noise(x: Column, level: float, seed: int, id_col: str | Column = "id") -> Column:
    """``x * (1 + level * N(0,1))``; level 0 is the identity."""
    if level == 0:
        return x
    return x * (F.lit(1.0) + F.lit(float(level)) * hash_normal(seed, id_col))
