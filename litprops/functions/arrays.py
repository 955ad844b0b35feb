"""Vector arithmetic on ``array<double>`` columns, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def doubles(c) -> Column:
    return _col(c).cast("array<double>")


def constant(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def zeros(n) -> Column:
    return F.array_repeat(F.lit(0.0), n if isinstance(n, Column) else F.lit(int(n)))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def scale(a: Column, k: Column) -> Column:
    return F.transform(a, lambda x: x * k)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def blend(a: Column, b: Column, beta: Column) -> Column:
    """``beta * a + (1 - beta) * b``."""
    return F.zip_with(a, b, lambda x, y: beta * x + (F.lit(1.0) - beta) * y)


def layer_norm(a: Column, eps: float = 1e-5) -> Column:
    """``(x - mean) / sqrt(population variance + eps)``. The variance sums squared distances from the mean, in a second pass over the
    array, so large values do not cancel."""
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x) / F.size(a)
    # The one-element arrays bind the mean and the scale once, so that they are not worked out again for each x.
    centred = F.flatten(F.transform(F.array(total(a)), lambda m: F.transform(a, lambda x: x - m)))

    def scaled(d: Column) -> Column:
        scale = F.sqrt(total(F.transform(d, lambda x: x * x)) + eps)
        return F.flatten(F.transform(F.array(scale), lambda t: F.transform(d, lambda x: x / t)))

    return F.flatten(F.transform(F.array(centred), scaled))


def one_hot(value: Column, allowed: list, unknown: bool = False) -> Column:
    """0/1 list over ``allowed``; ``unknown`` appends a flag for any other value."""
    hits = [F.coalesce(value == F.lit(v), F.lit(False)).cast("int") for v in allowed]
    if unknown:
        hits.append((~F.coalesce(value.isin(*allowed), F.lit(False))).cast("int"))
    return F.array(*hits)


def concat_features(parts: list[Column], width: int) -> Column:
    """Concatenate feature lists; the job fails when the result is not ``width`` long."""
    joined = F.concat(*parts)
    return F.when(F.size(joined) == width, joined).otherwise(
        F.raise_error(F.concat(F.lit(f"expected {width} features, got "), F.size(joined).cast("string"))).cast("array<double>")
    )


def clean_descriptors(a: Column, limit: float = 1e6) -> Column:
    """NaN -> 0, infinities and large values clipped to +-limit."""
    return F.transform(a, lambda x: F.when(F.isnan(x), F.lit(0.0)).otherwise(F.greatest(F.lit(-limit), F.least(F.lit(limit), x))))
