"""Column expressions over `ARRAY<FLOAT>` vectors, computed in doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuslake.functions.text import col


def let(value: Column, body) -> Column:
    """`body(value)` with the value computed once per row, also where the body is a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column | str, b: Column | str) -> Column:
    return _total(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")))


def l2_norm(v: Column | str) -> Column:
    return F.sqrt(_total(F.transform(col(v), lambda x: x.cast("double") * x.cast("double"))))


def l2_normalize(v: Column | str) -> Column:
    """Unit-length copy; a zero vector comes back unchanged."""
    def scaled(norm):
        return F.transform(col(v), lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(x.cast("double")))

    return let(l2_norm(v), scaled)


def cosine(a: Column | str, b: Column | str) -> Column:
    scale = l2_norm(a) * l2_norm(b)
    return F.when(scale > 0, dot(a, b) / scale).otherwise(F.lit(0.0))


def softmax(v: Column | str) -> Column:
    weights = let(F.array_max(col(v)).cast("double"), lambda top: F.transform(col(v), lambda x: F.exp(x.cast("double") - top)))
    return let(weights, lambda ws: let(_total(ws), lambda total: F.transform(ws, lambda w: w / total)))


def logsumexp(v: Column | str) -> Column:
    return let(
        F.array_max(col(v)).cast("double"),
        lambda top: top + F.log(_total(F.transform(col(v), lambda x: F.exp(x.cast("double") - top)))))
