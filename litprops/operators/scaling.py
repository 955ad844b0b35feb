"""Target scaling fitted on training rows: optional natural log, then mean and population standard deviation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litprops.operators.spread import attach_small


def transform_for(prop, log_properties: Sequence[str]) -> Column:
    """``log`` or ``identity`` by property; ``E_article`` follows ``E``."""
    c = F.col(prop) if isinstance(prop, str) else prop
    c = F.when(c == "E_article", "E").otherwise(c)
    chosen = c.isin(*log_properties) if log_properties else F.lit(False)
    return F.when(chosen, "log").otherwise("identity")


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def bad_targets(df: DataFrame, y: str, transform: str, row_idx: str = "row_idx") -> DataFrame:
    """Rows whose target is not finite, or not positive under ``log``."""
    c = F.col(y)
    reason = F.when(~finite(c), "not finite").when((F.col(transform) == "log") & (c <= 0), "not positive")
    return df.withColumn("reason", reason).filter(F.col("reason").isNotNull()).select(row_idx, y, "reason")


def first_bad(df: DataFrame, y: str, transform: str, row_idx: str = "row_idx", n: int = 10) -> DataFrame:
    return bad_targets(df, y, transform, row_idx).orderBy(row_idx).limit(n)


def validate_targets(df: DataFrame, y: str, transform: str, row_idx: str = "row_idx") -> DataFrame:
    """Fail with the first ten bad rows; targets are never clipped or dropped."""
    rows = first_bad(df, y, transform, row_idx).collect()
    if rows:
        raise ValueError("bad targets at " + ", ".join(f"{r[0]} ({r['reason']})" for r in rows))
    return df


def checked_target(y: str, transform: str) -> Column:
    """Target on the scale it is fitted on; the job fails on a bad one."""
    c = F.col(y)
    bad = ~finite(c) | ((F.col(transform) == "log") & (c <= 0))
    return (
        F.when(bad, F.raise_error(F.concat(F.lit("bad target: "), F.coalesce(c.cast("string"), F.lit("null")))).cast("double"))
        .when(F.col(transform) == "log", F.ln(c))
        .otherwise(c)
    )


def fit(train: DataFrame, by: Sequence[str], y: str = "y", transform: str = "transform") -> DataFrame:
    """``(by..., transform, mean, scale)``; a standard deviation of 0 becomes 1."""
    t = checked_target(y, transform)
    std = F.stddev_pop("_t")
    return (
        train.withColumn("_t", t)
        .groupBy(*by, transform)
        .agg(F.avg("_t").alias("mean"), F.when(F.max("_t") == F.min("_t"), 1.0).otherwise(std).alias("scale"))
    )


def scale(df: DataFrame, scaler: DataFrame, by: Sequence[str], y: str = "y", out: str = "y_scaled", transform: str = "transform") -> DataFrame:
    """``(target - mean) / scale`` with the scaler row of each key."""
    joined = attach_small(df.drop(transform), scaler, by, "inner")
    return joined.withColumn(out, (checked_target(y, transform) - F.col("mean")) / F.col("scale"))


def inverse(value, mean="mean", scale="scale", transform="transform") -> Column:
    """Back to physical units; overflow or a non-finite value fails the job instead of being clipped."""
    v = F.col(value) if isinstance(value, str) else value
    line = v * F.col(scale) + F.col(mean)
    restored = F.when(F.col(transform) == "log", F.exp(line)).otherwise(line)
    return F.when(finite(restored), restored).otherwise(
        F.raise_error(F.concat(F.lit("inverse transform not finite for "), F.coalesce(v.cast("string"), F.lit("null")))).cast("double")
    )
