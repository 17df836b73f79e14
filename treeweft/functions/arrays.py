"""Scalar and array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fraction(text) -> Column:
    """The number that a text such as '0.25' or '1/96' stands for; null for what is neither."""
    text = F.trim(F.col(text) if isinstance(text, str) else text)
    top = F.try_element_at(F.split(text, "/"), F.lit(1)).try_cast("double")
    bottom = F.try_element_at(F.split(text, "/"), F.lit(2)).try_cast("double")
    return F.when(F.contains(text, F.lit("/")), F.try_divide(top, bottom)).otherwise(top)


def none_to_null(text) -> Column:
    """Null for 'none' in any case."""
    text = F.col(text) if isinstance(text, str) else text
    return F.when(F.lower(text) != "none", text)


def bound(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, however often, and in whatever lambda, ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def softmax_last_zero(eta) -> Column:
    """The softmax of an array of logits with a 0 put at its end."""
    eta = F.concat(F.col(eta) if isinstance(eta, str) else eta, F.array(F.lit(0.0)))

    def shares(powers: Column) -> Column:
        return bound(F.aggregate(powers, F.lit(0.0), lambda a, x: a + x), lambda total: F.transform(powers, lambda x: x / total))

    return bound(eta, lambda e: bound(F.array_max(e), lambda top: bound(F.transform(e, lambda x: F.exp(x - top)), shares)))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def gather(values, index) -> Column:
    """values[index[0]], values[index[1]], ... with indexes from 0."""
    values = F.col(values) if isinstance(values, str) else values
    return F.transform(index, lambda i: F.get(values, i))
