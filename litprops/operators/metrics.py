"""Regression metrics as plain aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAN = float("nan")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def r2(y="y", p="p", few: float = NAN) -> Column:
    """Coefficient of determination. Fewer than two rows give ``few``; constant targets give 1 if met exactly, else 0."""
    y, p = _col(y), _col(p)
    n = F.count(y)
    residual = F.sum((y - p) * (y - p))
    spread = F.var_pop(y) * n
    return (
        F.when(n < 2, F.lit(few))
        .when(F.max(y) == F.min(y), F.when(residual == 0, 1.0).otherwise(0.0))
        .otherwise(1.0 - residual / F.nullif(spread, F.lit(0.0)))
    )


def rmse(y="y", p="p", few: float | None = NAN) -> Column:
    y, p = _col(y), _col(p)
    value = F.sqrt(F.avg((y - p) * (y - p)))
    return value if few is None else F.when(F.count(y) < 2, F.lit(few)).otherwise(value)


def mae(y="y", p="p", few: float | None = NAN) -> Column:
    y, p = _col(y), _col(p)
    value = F.avg(F.abs(y - p))
    return value if few is None else F.when(F.count(y) < 2, F.lit(few)).otherwise(value)


def regression_metrics(df: DataFrame, by: Sequence[str] = (), y: str = "y", p: str = "p", form: str = "baseline") -> DataFrame:
    """R2, RMSE, MAE and row count per ``by`` key; one shuffle of partial sums.

    ``baseline``: all three NaN below two rows. ``epoch``: R2 is 0 below two rows, the others are plain.
    """
    if form == "baseline":
        cols = [r2(y, p), rmse(y, p), mae(y, p)]
    elif form == "epoch":
        cols = [r2(y, p, few=0.0), rmse(y, p, few=None), mae(y, p, few=None)]
    else:
        raise ValueError(f"unknown form: {form!r}")
    named = [c.alias(n) for c, n in zip(cols, ("r2", "rmse", "mae"))]
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *named)


def format_mean_std(mean: Column | str, std: Column | str) -> Column:
    """``0.1234 ± 0.0056``."""
    return F.format_string("%.4f ± %.4f", _col(mean), _col(std))


def split_mean_std(c: Column | str) -> tuple[Column, Column]:
    """The two halves of ``m ± s``; without the sign the text and an empty string."""
    parts = F.split(_col(c), "±", 2)
    return F.trim(F.get(parts, F.lit(0))), F.trim(F.coalesce(F.get(parts, F.lit(1)), F.lit("")))


def seed_summary(per_seed: DataFrame, by: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Mean and population standard deviation of each metric over the seeds."""
    aggs = []
    for m in metrics:
        aggs += [F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std")]
    return per_seed.groupBy(*by).agg(F.count(F.lit(1)).alias("runs"), *aggs)


def with_summary_row(per_seed: DataFrame, by: Sequence[str], metrics: Sequence[str], seed: str = "seed") -> DataFrame:
    """Detail rows as text plus one ``mean ± std`` row per key; ``row_kind`` 0/1 sorts the summary last."""
    detail = per_seed.select(
        *by, F.col(seed).cast("string").alias(seed), *[F.format_string("%.4f", F.col(m)).alias(m) for m in metrics], F.lit(0).alias("row_kind")
    )
    total = seed_summary(per_seed, by, metrics).select(
        *by, F.lit("mean ± std").alias(seed), *[format_mean_std(f"{m}_mean", f"{m}_std").alias(m) for m in metrics], F.lit(1).alias("row_kind")
    )
    return detail.unionByName(total)


def dataset_mean(per_dataset: DataFrame, by: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Unweighted mean over datasets, the score of a joint run."""
    return per_dataset.groupBy(*by).agg(F.count(F.lit(1)).alias("datasets"), *[F.avg(m).alias(m) for m in metrics])


def improvement_row(stages: DataFrame, by: Sequence[str], before: str = "before", after: str = "after") -> DataFrame:
    """Stage rows plus an ``improvement`` row: R2 after - before, RMSE and MAE before - after."""
    pick = lambda m, s: F.max(F.when(F.col("stage") == s, F.col(m)))
    better = stages.groupBy(*by).agg(
        (pick("r2", after) - pick("r2", before)).alias("r2"),
        (pick("rmse", before) - pick("rmse", after)).alias("rmse"),
        (pick("mae", before) - pick("mae", after)).alias("mae"),
    )
    cols = [*by, "stage", "r2", "rmse", "mae"]
    return stages.select(*cols).unionByName(better.withColumn("stage", F.lit("improvement")).select(*cols))


def epoch_loss(batches: DataFrame, by: Sequence[str] = (), losses: Sequence[str] = ("loss",), n: str = "n") -> DataFrame:
    """Size-weighted average of batch losses; an epoch without rows has loss 0."""
    size = F.greatest(F.coalesce(F.sum(n), F.lit(0)), F.lit(1))
    means = [(F.coalesce(F.sum(F.col(c) * F.col(n)), F.lit(0.0)) / size).alias(c) for c in losses]
    return batches.groupBy(*by).agg(F.coalesce(F.sum(n), F.lit(0)).alias("rows"), *means)
