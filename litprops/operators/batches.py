"""Batches as columns: fixed-size, article-grouped, padded, and the early-stop trace of an epoch log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litprops.functions.hashing import hash_fraction, hash_number, hash_text
from litprops.operators.spread import lookup_join, rank_in_group, running_total


def fixed_batches(row_idx: str, size: int) -> Column:
    """Batch number of a 0-based position."""
    if not isinstance(size, int) or size <= 0:
        raise ValueError("batch size must be a positive int")
    return F.floor(F.col(row_idx) / F.lit(size)).cast("bigint")


def article_batches(df: DataFrame, article: str, row: str, size: int, seed: int | str, drop_last: bool = False) -> DataFrame:
    """Article-grouped batches: articles in md5 order, rows of an article in md5 order, cut every ``size`` rows.

    Adds ``pos`` (place in the epoch), ``batch_id`` (cut number) and ``batch_order`` (shuffled batch order, md5 text). A cut may
    fall inside an article. The place is the article's offset (prefix sum over article sizes) plus the row's rank in its article.
    """
    fixed_batches(row, size)
    sizes = df.groupBy(article).agg(F.count(F.lit(1)).alias("_size")).withColumn("_order", hash_number(seed, article))
    even = F.floor(F.col("_order") / F.lit(2.0**52) * 256).cast("int")
    starts = running_total(sizes, "_order", "_size", "_end", ties=[article], bucket=even).select(
        article, (F.col("_end") - F.col("_size")).alias("_start")
    )
    ranked = rank_in_group(df, [article], hash_fraction(seed, row), "_rank", ties=[row])
    placed = lookup_join(ranked, starts, [article], "inner", spread_by=[row]).withColumn("pos", F.col("_start") + F.col("_rank"))
    out = placed.drop("_start", "_rank").withColumn("batch_id", fixed_batches("pos", size)).withColumn("batch_order", hash_text(seed, "batch_id"))
    if drop_last:
        short = out.groupBy("batch_id").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") < size).select("batch_id")
        out = out.join(short, "batch_id", "left_anti")
    return out


def batch_max(df: DataFrame, length: str, batch: Sequence[str], out: str = "max_len") -> DataFrame:
    """Longest length of each batch on every row; a batch is a few rows, so a window is safe."""
    return df.withColumn(out, F.max(length).over(Window.partitionBy(*batch)))


def early_stop(log: DataFrame, patience: int, run: Sequence[str] = ("run",), epoch: str = "epoch", loss: str = "val_loss") -> DataFrame:
    """Trace of an epoch log up to its stop.

    Adds ``best`` (best loss so far), ``improved`` (strictly better than all before), ``waited`` (epochs since), ``stop`` (first
    epoch with ``waited >= patience``). A run is as long as its epoch budget, so one window per run is small.
    """
    before = Window.partitionBy(*run).orderBy(epoch).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*run).orderBy(epoch).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    traced = (
        log.withColumn("_prior", F.min(loss).over(before))
        .withColumn("improved", F.coalesce(F.col(loss) < F.coalesce("_prior", F.lit(float("inf"))), F.lit(False)))
        .withColumn("best", F.min(loss).over(upto))
        .withColumn("_n", F.row_number().over(Window.partitionBy(*run).orderBy(epoch)))
        .withColumn("_last", F.coalesce(F.max(F.when(F.col("improved"), F.col("_n"))).over(upto), F.lit(0)))
        .withColumn("waited", F.when(F.col(loss).isNull(), 0).otherwise(F.col("_n") - F.col("_last")))
    )
    stopped = F.min(F.when(F.col("waited") >= patience, F.col("_n"))).over(Window.partitionBy(*run))
    return (
        traced.withColumn("_stop", stopped)
        .filter(F.col("_stop").isNull() | (F.col("_n") <= F.col("_stop")))
        .withColumn("stop", F.coalesce(F.col("_n") == F.col("_stop"), F.lit(False)))
        .drop("_prior", "_n", "_last", "_stop")
    )


def stop_summary(trace: DataFrame, run: Sequence[str] = ("run",), epoch: str = "epoch", loss: str = "val_loss") -> DataFrame:
    """Last epoch run and the epoch whose weights are kept: the best one, or the last where nothing was validated."""
    return trace.groupBy(*run).agg(
        F.max(epoch).alias("last_epoch"),
        F.coalesce(F.max(F.when(F.col("improved"), F.col(epoch))), F.max(epoch)).alias("best_epoch"),
        F.min(loss).alias("best_loss"),
        F.max("stop").alias("stopped_early"),
    )


def keep_base_and_random(df: DataFrame, by: Sequence[str], position: str, seed: int | str, most: int = 10) -> DataFrame:
    """Per key keep position 0 and up to ``most - 1`` md5-picked others, in their old order.

    Spark turns ``row_number() <= n`` into a partial limit before the shuffle, so a hot key sends ``n`` rows per task.
    """
    order = Window.partitionBy(*by).orderBy(F.when(F.col(position) == 0, 0).otherwise(1), hash_text(seed, *by, position), position)
    return df.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= most).drop("_rn")
