"""Random numbers keyed by what they are for, so that they depend on neither order nor partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STEPS = 4503599627370496  # 2^52


def uniform(*key) -> Column:
    """A number in (0, 1) from the first 13 hexadecimal digits of the MD5 of the key's parts joined by '|'."""
    parts = [k if isinstance(k, Column) else F.lit(str(k)) for k in key]
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    digits = F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("bigint")
    return (digits + F.lit(0.5)) / F.lit(float(STEPS))


def uniform_int(low, high, *key) -> Column:
    """A whole number from low to high, both included."""
    low, high = (x if isinstance(x, Column) else F.lit(x) for x in (low, high))
    return (low + F.floor(uniform(*key) * (high - low + 1))).cast("bigint")


def exponential(*key) -> Column:
    return -F.ln(uniform(*key))


def beta_one(alpha, *key) -> Column:
    """Beta(1, alpha) by its inverse distribution function."""
    alpha = alpha if isinstance(alpha, Column) else F.lit(float(alpha))
    return F.lit(1.0) - F.pow(F.lit(1.0) - uniform(*key), F.lit(1.0) / alpha)


def gamma_whole(shape: int, *key) -> Column:
    """A gamma variate of a whole shape, as the sum of so many exponential ones."""
    parts = [exponential(*key, i) for i in range(shape)]
    return sum(parts[1:], parts[0])
