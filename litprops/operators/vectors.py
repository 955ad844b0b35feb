"""Pooling and alignment of token vectors: one row per token, one aggregate per record.

``ml.stat.Summarizer`` adds whole vectors with map-side partial sums, so a record with very many tokens costs one vector per task in
the shuffle, and tokens are never exploded into one row per dimension.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litprops.functions import arrays as A
from litprops.operators.spread import attach_small, lookup_join

POOLINGS = ("last_token", "mean_pooling", "sum_pooling", "attention_pooling", "sigmoid_pooling")
STRUCTURE_POOLINGS = ("mean_pooling", "sum_pooling", "attention_pooling", "sigmoid_pooling")


def vector_sum(vec: Column, weight: Column | None = None) -> Column:
    """Aggregate: element-wise (weighted) sum as ``array<double>``. A weight of zero still counts as a row."""
    v = A.doubles(vec)
    return vector_to_array(Summarizer.sum(array_to_vector(v if weight is None else A.scale(v, weight))))


def _active(mask: str | None) -> Column:
    return F.lit(1.0) if mask is None else F.when(F.col(mask) != 0, 1.0).otherwise(0.0)


def mean_pooling(tokens: DataFrame, by: Sequence[str], vec: str = "vec", mask: str | None = None, out: str = "pooled") -> DataFrame:
    """Mean of unmasked vectors; an all-masked record gives zeros."""
    w = _active(mask)
    sums = tokens.groupBy(*by).agg(vector_sum(F.col(vec), None if mask is None else w).alias(out), F.sum(w).alias("_n"))
    return sums.withColumn(out, A.scale(F.col(out), 1.0 / F.greatest(F.col("_n"), F.lit(1.0)))).drop("_n")


def sum_pooling(tokens: DataFrame, by: Sequence[str], vec: str = "vec", mask: str | None = None, out: str = "pooled") -> DataFrame:
    return tokens.groupBy(*by).agg(vector_sum(F.col(vec), None if mask is None else _active(mask)).alias(out))


def last_token_pooling(tokens: DataFrame, by: Sequence[str], vec: str = "vec", pos: str = "pos", mask: str | None = None, out: str = "pooled") -> DataFrame:
    """Vector of the last unmasked token (of the very last token when all are masked)."""
    order = F.struct((_active(mask) > 0).alias("a"), F.col(pos).alias("p"))
    return tokens.groupBy(*by).agg(A.doubles(F.max_by(vec, order)).alias(out))


def gate_score(vec: Column, w1: list[list[float]], b1: list[float], w2: list[float], b2: float) -> Column:
    """``w2 . tanh(W1 v + b1) + b2`` with given weights (``w1`` has one row per hidden unit)."""
    v = A.doubles(vec)
    hidden = [F.tanh(A.dot(v, A.constant(row)) + F.lit(float(b))) for row, b in zip(w1, b1)]
    score = F.lit(float(b2))
    for h, w in zip(hidden, w2):
        score = score + h * F.lit(float(w))
    return score


def score_bound(w2: list[float], b2: float) -> float:
    """No score exceeds this, since tanh stays within +-1."""
    return sum(abs(float(w)) for w in w2) + abs(float(b2))


def attention_weights(tokens: DataFrame, by: Sequence[str], score: Column, bound: float, mask: str | None = None, out: str = "alpha") -> DataFrame:
    """Softmax weight of every token. Scores are shifted by their known bound (softmax does not change), so the only group value
    needed is a partial sum; it comes back by a salted lookup, not by a window over a whole record."""
    shift = _shift(bound)
    raised = tokens.withColumn("_e", F.exp(score - F.lit(shift)) * _active(mask))
    sums = raised.groupBy(*by).agg(F.sum("_e").alias("_s"))
    return lookup_join(raised, sums, by, "inner").withColumn(out, F.col("_e") * _inverse("_s")).drop("_e", "_s")


def _inverse(total: str) -> Column:
    """1 / total; a record whose tokens are all masked has no softmax and gets NaN."""
    return F.when(F.col(total) == 0, F.lit(float("nan"))).otherwise(1.0 / F.col(total))


def _shift(bound: float) -> float:
    if bound > 300:
        raise ValueError("scores may differ by more than exp can hold; scale the weights down")
    return float(bound)


def attention_pooling(
    tokens: DataFrame, by: Sequence[str], score: Column, bound: float, vec: str = "vec", mask: str | None = None, out: str = "pooled"
) -> DataFrame:
    """Softmax-weighted sum of vectors in a single aggregate: sum(e v) / sum(e)."""
    e = F.exp(score - F.lit(_shift(bound))) * _active(mask)
    raised = tokens.select(*by, vec, e.alias("_e"))
    sums = raised.groupBy(*by).agg(vector_sum(F.col(vec), F.col("_e")).alias(out), F.sum("_e").alias("_s"))
    return sums.withColumn(out, A.scale(F.col(out), _inverse("_s"))).drop("_s")


def sigmoid_pooling(tokens: DataFrame, by: Sequence[str], score: Column, vec: str = "vec", mask: str | None = None, out: str = "pooled") -> DataFrame:
    """Sum of vectors weighted by sigmoid(score), not normalised."""
    gate = (F.lit(1.0) / (F.lit(1.0) + F.exp(-score))) * _active(mask)
    return tokens.select(*by, vec, gate.alias("_g")).groupBy(*by).agg(vector_sum(F.col(vec), F.col("_g")).alias(out))


def pool(kind: str, tokens: DataFrame, by: Sequence[str], structure: bool = False, **kw) -> DataFrame:
    """Pooling by name; an unknown name is an error. Structure streams have no ``last_token``."""
    allowed = STRUCTURE_POOLINGS if structure else POOLINGS
    if kind not in allowed:
        raise ValueError(f"unknown pooling: {kind!r}")
    return {
        "last_token": last_token_pooling,
        "mean_pooling": mean_pooling,
        "sum_pooling": sum_pooling,
        "attention_pooling": attention_pooling,
        "sigmoid_pooling": sigmoid_pooling,
    }[kind](tokens, by, **kw)


def normalise_tokens(tokens: DataFrame, vec: str = "vec", eps: float = 1e-5) -> DataFrame:
    return tokens.withColumn(vec, A.layer_norm(A.doubles(vec), eps))


def pad_batch(records: DataFrame, batch: Sequence[str], tokens: str = "tokens", width: int = 64) -> DataFrame:
    """Pad each record's list of vectors to the longest of its batch; adds ``mask`` (1 real, 0 padding)."""
    sized = records.withColumn("_len", F.size(tokens)).withColumn("max_len", F.max("_len").over(Window.partitionBy(*batch)))
    gap = F.col("max_len") - F.col("_len")
    return (
        sized.withColumn(tokens, F.concat(F.col(tokens), F.array_repeat(A.zeros(width), gap)))
        .withColumn("mask", F.concat(F.array_repeat(F.lit(1), F.col("_len")), F.array_repeat(F.lit(0), gap)))
        .drop("_len")
    )


def standardise(vectors: DataFrame, by: Sequence[str], vec: str = "vec", over: DataFrame | None = None) -> DataFrame:
    """Column-wise ``(x - mean) / population std`` (0 counts as 1) per ``by`` key, fitted on ``over`` (all rows by default).

    A key's means and deviations are one row; those few rows are checked and broadcast, so the vectors do not shuffle.
    """
    source = (vectors if over is None else over).select(*by, array_to_vector(A.doubles(vec)).alias("v"))
    fitted = source.groupBy(*by).agg(Summarizer.metrics("mean", "variance", "count").summary(F.col("v")).alias("s")).select(
        *by, vector_to_array("s.mean").alias("_mean"), vector_to_array("s.variance").alias("_var"), F.col("s.count").alias("_n")
    )
    std = F.transform("_var", lambda x: F.sqrt(x * (F.col("_n") - 1) / F.col("_n")))
    fitted = fitted.select(*by, "_mean", F.transform(std, lambda s: F.when(s == 0, 1.0).otherwise(s)).alias("_std"))
    scaled = F.zip_with(F.zip_with(A.doubles(vec), F.col("_mean"), lambda x, m: x - m), F.col("_std"), lambda x, s: x / s)
    return attach_small(vectors, fitted, by, "inner").withColumn(vec, scaled).drop("_mean", "_std")


def append_ratio(vec: Column, ratio: Column, width: int, ratio_width: int) -> Column:
    """Structure vector followed by its ratio vector; a missing part is zeros of its width."""
    return F.concat(F.coalesce(A.doubles(vec), A.zeros(width)), F.coalesce(A.doubles(ratio), A.zeros(ratio_width)))


def token_weights(tokens: DataFrame, by: Sequence[str], pos: str = "pos", token: str = "token", weight: str = "alpha") -> DataFrame:
    """Per-record list of ``(pos, token, weight)`` in token order, for the weight report. A record is one prompt, so its list is as
    long as a model's context."""
    return tokens.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(F.col(pos).alias("pos"), F.col(token).alias("token"), F.col(weight).alias("weight")))).alias("weights"))
