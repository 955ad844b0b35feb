"""Ridge fits from one additive statistic per group.

The statistic of a group of rows is the sum of ``z z'`` with ``z = (1, vector, target)``, kept as its upper triangle. It holds the row count, all
means, all covariances and the target's own mean and variance, and it is additive: a joint fit, a larger training fraction or a fit on two
domains is the sum of statistics that are there already. So one pass over the rows gives every fit, whatever the ridge values, and target
scaling is worked out of the statistic too.

Each task adds whole Arrow batches by matrix products and hands on one row per group (at most :data:`OPEN_GROUPS` at a time are held); the
partial sums are added vector-wise by partial aggregates. Solving reads one row per group.

A fit minimises ``mean squared error + ridge * sum of squared coefficients of the standardised vector``, the target in standard units.
Coordinates that are constant in the training rows get weight 0. Rows with a null vector or target take no part.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

from litprops.functions.arrays import dot
from litprops.operators.scaling import checked_target, inverse

#: Groups whose sums a task holds at a time.
OPEN_GROUPS = 256


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one batch; a vector of another width is an error."""
    sizes = np.diff(column.offsets.to_numpy())
    if len(sizes) and (sizes != sizes[0]).any():
        raise ValueError(f"vectors of different widths: {sorted(set(sizes.tolist()))[:5]}")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(sizes), -1)


def _fields(schema: T.StructType, names: Sequence[str]) -> str:
    return "".join(f"`{n}` {schema[n].dataType.simpleString()}, " for n in names)


def moments(rows: DataFrame, by: Sequence[str], vec: str = "pooled", y: str = "y", transform: str = "transform") -> DataFrame:
    """``by..., transform, s``: the statistic of every group; targets are checked and, under ``log``, logarithms."""
    by = [*by, transform]
    ready = rows.filter(F.col(vec).isNotNull() & F.col(y).isNotNull()).select(*by, checked_target(y, transform).cast("double").alias("_t"), F.col(vec).cast("array<double>").alias("_v"))

    def add(iterator: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        for batch in iterator:
            x = _matrix(batch.column(len(by) + 1))
            z = np.column_stack([np.ones(len(x)), x, batch.column(len(by)).to_numpy()])
            places: dict[tuple, list[int]] = {}
            for i, key in enumerate(zip(*(batch.column(k).to_pylist() for k in range(len(by))))):
                places.setdefault(key, []).append(i)
            for key, at in places.items():
                product = z[at].T @ z[at]
                held[key] = held[key] + product if key in held else product
            if len(held) > OPEN_GROUPS:
                yield out(held)
                held = {}
        yield out(held)

    def out(held):
        upper = np.triu_indices(len(next(iter(held.values())))) if held else None
        keys = [pa.array([k[i] for k in held], types[i]) for i in range(len(by))]
        return pa.RecordBatch.from_arrays([*keys, pa.array([m[upper] for m in held.values()], pa.list_(pa.float64()))], names=[*by, "s"])

    types = [to_arrow_type(ready.schema[n].dataType) for n in by]
    return merge(ready.mapInArrow(add, _fields(ready.schema, by) + "s array<double>"), by)


def merge(stats: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sums of statistics per ``by`` key."""
    added = stats.groupBy(*by).agg(Summarizer.metrics("sum").summary(array_to_vector("s")).alias("_sum"))
    return added.select(*by, vector_to_array("_sum.sum").alias("s"))


def _square(s: np.ndarray) -> np.ndarray:
    n = int((np.sqrt(8 * len(s) + 1) - 1) / 2)
    m = np.zeros((n, n))
    m[np.triu_indices(n)] = s
    return m + np.triu(m, 1).T


def _spread(m: np.ndarray, i) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population variance of the variables ``i``; what rounding leaves of a constant is no variance."""
    n = m[0, 0]
    mean = m[0, i] / n
    square = np.diagonal(m)[i] / n
    var = square - mean * mean
    return mean, np.where(var > 1e-12 * np.maximum(square, 1e-300), var, 0.0)


def _rows(stats: DataFrame, one, schema: str) -> DataFrame:
    """``one(row as dict, square matrix)`` gives the result rows of each statistic."""
    names = [p.split(" ")[0].strip("`") for p in schema.split(", ")]

    def run(iterator):
        for batch in iterator:
            out = [r for row in batch.to_pylist() for r in one(row, _square(np.array(row["s"])))]
            yield pa.RecordBatch.from_pylist([{n: r[n] for n in names} for r in out], schema=target)

    target = to_arrow_schema(T.StructType.fromDDL(schema))
    return stats.mapInArrow(run, schema)


def scalers(stats: DataFrame, by: Sequence[str], transform: str = "transform") -> DataFrame:
    """``by..., transform, n, mean, scale`` of the targets, as :func:`litprops.operators.scaling.fit` gives them; a deviation of 0 counts as 1."""

    def one(row, m):
        mean, var = _spread(m, len(m) - 1)
        yield {**row, "n": int(round(m[0, 0])), "mean": float(mean), "scale": float(np.sqrt(var)) or 1.0}

    return _rows(stats, one, _fields(stats.schema, [*by, transform]) + "n bigint, mean double, scale double")


def in_standard_units(stats: DataFrame) -> DataFrame:
    """The same statistics with every group's target scaled by its own mean and deviation; then groups of different properties may be added."""

    def one(row, m):
        mean, var = _spread(m, len(m) - 1)
        scale = float(np.sqrt(var)) or 1.0
        change = np.eye(len(m))
        change[-1, -1], change[-1, 0] = 1 / scale, -mean / scale
        yield {**row, "s": (change @ m @ change.T)[np.triu_indices(len(m))].tolist()}

    return _rows(stats, one, _fields(stats.schema, [c for c in stats.columns if c != "s"]) + "s array<double>")


def solve(stats: DataFrame, by: Sequence[str], ridges: Sequence[float]) -> DataFrame:
    """``by..., models``: an array of ``trial, ridge, weights, intercept`` with a fit for every ridge value.

    The correlation matrix of a group is decomposed once; each ridge value then costs two products.
    """
    ridges = [float(r) for r in ridges]

    def one(row, m):
        d, n = len(m) - 2, m[0, 0]
        mean, var = _spread(m, np.arange(1, d + 1))
        used = np.flatnonzero(var > 0)
        std = np.sqrt(var[used])
        inner = m[1 : d + 1, 1 : d + 1][np.ix_(used, used)] / n - np.outer(mean[used], mean[used])
        y_mean = m[0, -1] / n
        cross = (m[1 : d + 1, -1][used] / n - mean[used] * y_mean) / std
        values, basis = np.linalg.eigh(inner / np.outer(std, std)) if len(used) else (np.empty(0), np.empty((0, 0)))
        seen = basis.T @ cross
        models = []
        for trial, ridge in enumerate(ridges):
            size = values + ridge
            kept = size > 1e-12 * max(size.max(initial=0.0), 1.0)  # directions without variation, without ridge: no weight
            weights = np.zeros(d)
            weights[used] = basis[:, kept] @ (seen[kept] / size[kept]) / std
            models.append({"trial": trial, "ridge": ridge, "weights": weights.tolist(), "intercept": float(y_mean - weights @ mean)})
        yield {**row, "models": models}

    return _rows(stats, one, _fields(stats.schema, by) + "models array<struct<trial:int,ridge:double,weights:array<double>,intercept:double>>")


def cumulative(stats: DataFrame, by: Sequence[str], least: str, percents: Sequence[int], out: str = "pct") -> DataFrame:
    """Statistics of nested training subsets: each group belongs to every percentage from its column ``least`` on. Rows are not read again."""
    told = stats.withColumn(out, F.explode(F.filter(F.array(*[F.lit(int(p)) for p in percents]), lambda p: p >= F.col(least))))
    return merge(told, [*by, out])


def least_percent(unit_fraction: Column, percents: Sequence[int]) -> Column:
    """The smallest of ``percents`` whose subset holds a row with this fraction in [0, 1); null if none does."""
    return F.get(F.filter(F.array(*[F.lit(int(p)) for p in sorted(percents)]), lambda p: unit_fraction * 100 < p), F.lit(0))


def predict(rows: DataFrame, models: DataFrame, scaler: DataFrame, on: Sequence[str], by: Sequence[str], vec: str = "pooled", transform: str = "transform") -> DataFrame:
    """Every row with every model of its ``on`` key: ``trial, ridge, p_scaled``, and ``p`` in physical units by the scaler row of its ``by`` key.

    Models and scalers are best settled tables: Spark then sees how large they are, and sends small ones to the rows."""
    told = rows.drop(transform).join(scaler.select(*by, transform, "mean", "scale"), list(by)).join(models.select(*on, "models"), list(on))
    told = told.withColumn("_m", F.explode("models")).drop("models")
    scaled = dot(F.col(vec).cast("array<double>"), F.col("_m.weights")) + F.col("_m.intercept")
    told = told.withColumns({"trial": F.col("_m.trial"), "ridge": F.col("_m.ridge"), "p_scaled": scaled}).drop("_m")
    return told.withColumn("p", inverse("p_scaled", "mean", "scale", transform))
