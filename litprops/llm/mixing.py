"""Mixing sources to target weights by Poisson replication.

Source ``s`` holds ``size_s`` of all ``total`` characters and is to hold ``weight_s`` of the mix; each of its documents is repeated
``rate_s = total * weight_s / size_s`` times on average. The number of copies of one document is the inverse of the Poisson distribution
with that mean at a number that the document's id and the seed hash to. So the count needs no state, is the same on every run and every
partitioning, and a document's fate does not depend on any other document. The distribution is worked out once per source, up to where the
rest is below what a double can tell from 1. Copies are dealt out over the whole mix by a second hash.

Defined results: documents of a null source form a source of their own; null and empty texts count no characters, and a source without any
characters gets rate 1; given weights need not sum to 1, a source without a weight gets none and its documents go; a null id hashes as
empty text; repeated rows get equal counts; an empty table gives an empty table. A column ``copy_no`` or ``mix_key`` in the input is
replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litprops.llm.store import Scratch

#: A source's share of the mix goes with this power of its share of the corpus, where no weights are given.
POWER = 0.5


def uniform(seed: str, *parts: Column) -> Column:
    """A number in [0, 1) from the first 13 hex digits of an md5 sum."""
    text = F.concat_ws(":", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson_least(rate: Column) -> Column:
    """The first count of the table of :func:`poisson_steps`.

    It is 0 unless the rate is so large that the counts below are less likely than a double can tell from 0.
    """
    low = F.floor(rate - 12 * F.sqrt(rate) - 30).cast("int")
    return F.when(low < 30, F.lit(0)).otherwise(low)


def poisson_steps(rate: Column) -> Column:
    """Values of the cumulative distribution at :func:`poisson_least` and all counts after it, until it cannot grow any more.

    For large rates the first value comes from logarithms, since ``exp(-rate)`` would be 0.
    """
    least, last = poisson_least(rate), F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    n = least.cast("double")
    log_factorial = n * F.log(n) - n + F.log(2 * math.pi * n) / 2 + 1 / (12 * n) - 1 / (360 * n * n * n)  # Stirling; n is 30 or more here
    first = F.when(least == 0, F.exp(-rate)).otherwise(F.exp(n * F.log(rate) - rate - log_factorial))
    step = lambda acc, k: F.struct(
        (acc["p"] * rate / k).alias("p"), F.concat(acc["c"], F.array(F.element_at(acc["c"], -1) + acc["p"] * rate / k)).alias("c")
    )
    start = F.struct(first.alias("p"), F.array(first).alias("c"))
    return F.aggregate(F.sequence(least + 1, last), start, step, lambda acc: acc["c"])


def rates(docs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """``source, size, rate, least, steps``: one row per source."""
    size = docs.groupBy("source").agg(F.sum(F.coalesce(F.length("text"), F.lit(0))).cast("double").alias("size"))
    if weights is None:
        share = size.select("source", "size", F.pow("size", F.lit(POWER)).alias("w"))
    else:
        given = docs.sparkSession.createDataFrame(list(weights.items()), "name string, w double")
        share = size.join(F.broadcast(given), F.col("source").eqNullSafe(F.col("name")), "left").select("source", "size", F.coalesce("w", F.lit(0.0)).alias("w"))
    share = Scratch(docs.sparkSession, "mixing").put(share, "sources")
    all_size, all_w = share.agg(F.sum("size"), F.sum("w")).first()
    rate = F.when(F.col("size") > 0, F.lit(all_size or 0.0) * F.col("w") / F.lit(all_w or 1.0) / F.col("size")).otherwise(F.lit(1.0))
    share = share.select("source", "size", rate.alias("rate"))
    return share.withColumn("least", poisson_least(F.col("rate"))).withColumn("steps", poisson_steps(F.col("rate")))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, seed: str = "mix") -> DataFrame:
    """All copies of all documents, with ``copy_no`` from 1 and ``mix_key``; sorted by ``mix_key`` inside and across partitions.

    The table of rates has one row per source and is joined as Spark sees fit; a source with a third of all rows is split by its skew
    join. Copies go to their places by ranges of ``mix_key``, which is uniform, so partitions are even.
    """
    docs = docs.drop("copy_no", "mix_key")
    found = rates(docs, weights).select(F.col("source").alias("name"), "least", "steps")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))  # apart from the names used here
    n = F.col("least") + F.size(F.filter("steps", lambda c: c <= uniform(seed, F.col("row.doc_id"))))
    counted = rows.join(found, F.col("row.source").eqNullSafe(F.col("name"))).select("row", n.alias("n")).filter("n > 0")
    copies = counted.select("row", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy_no"))
    key = F.md5(F.concat_ws(":", F.lit(seed), F.lit("place"), F.col("row.doc_id").cast("string"), F.col("copy_no").cast("string")))
    copies = copies.select("row.*", "copy_no", key.alias("mix_key"))
    return copies.repartitionByRange("mix_key", "doc_id", "copy_no").sortWithinPartitions("mix_key", "doc_id", "copy_no")
