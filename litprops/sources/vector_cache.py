"""Token vectors in Parquet: one row per token, partitioned by dataset, model and input type.

Parquet lists are the ragged layout (values and offsets), a partition filter picks the cache, and the commit protocol publishes it
whole or not at all. Vectors are stored as ``ARRAY<FLOAT>``: Spark has no half type, so storage is wider and nothing is rounded.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CACHE_KEYS = ["dataset", "model", "input_type"]


def write_cache(tokens: DataFrame, folder: str) -> None:
    """``dataset, model, input_type, row_idx, pos, token, vec``; rows of a record stay together and in order.

    ``repartitionByRange`` on row and position splits even one enormous dataset, where a partitionBy alone would not.
    """
    cols = [*CACHE_KEYS, "row_idx", "pos"]
    shaped = tokens.withColumn("vec", F.col("vec").cast("array<float>"))
    shaped.repartitionByRange(*cols).sortWithinPartitions(*cols).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*CACHE_KEYS).parquet(folder)


def read_cache(spark: SparkSession, folder: str, dataset: str, model: str, input_type: str) -> DataFrame:
    """Token rows of one cache; the three filters prune partitions."""
    return spark.read.parquet(folder).filter((F.col("dataset") == dataset) & (F.col("model") == model) & (F.col("input_type") == input_type))


def ragged(tokens: DataFrame, by: Sequence[str]) -> DataFrame:
    """One row per record with its tokens in order. A record is one prompt, no longer than a model's context."""
    items = F.sort_array(F.collect_list(F.struct("pos", "vec")))
    return tokens.groupBy(*by).agg(F.transform(items, lambda t: t["vec"]).alias("tokens"))


def view(rows: DataFrame, tokens: DataFrame, on: Sequence[str]) -> DataFrame:
    """Tokens of the wanted rows. A wanted row without tokens fails the job."""
    found = rows.join(tokens.withColumn("_hit", F.lit(True)), list(on), "left")
    lost = F.raise_error(F.concat(F.lit("no cached vectors for row "), F.col(on[-1]).cast("string"))).cast("boolean")
    return found.filter(F.when(F.col("_hit"), F.lit(True)).otherwise(lost)).drop("_hit")


def check_counts(records: DataFrame, tokens: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per cache: records in the dataset and records with vectors. They must agree."""
    have = tokens.select(*by, "row_idx").distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("cached"))
    want = records.groupBy("dataset").agg(F.count(F.lit(1)).alias("records"))
    return want.join(have, "dataset", "left").withColumn("cached", F.coalesce("cached", F.lit(0))).withColumn("complete", F.col("records") == F.col("cached"))


def _words(df: DataFrame, by: Sequence[str], out: str) -> DataFrame:
    """Which rows are there, as one bit per row: ``by..., _word, out`` with 64 rows to a word."""
    row = F.col("row_idx").cast("bigint")
    bit = F.expr("shiftleft(1L, CAST(pmod(row_idx, 64) AS INT))")
    return df.filter("row_idx IS NOT NULL").groupBy(*by, F.floor(row / 64).alias("_word")).agg(F.bit_or(bit).alias(out))


def missing_vectors(records: DataFrame, tokens: DataFrame, dims: dict[str, Sequence[str]]) -> DataFrame:
    """Expected (record, model, input type) without vectors. ``dims`` are config lists.

    Rows are compared as bits, 64 at a time, so records times settings are never rows: token rows shrink to words before they are shuffled, and only
    words that lack a bit are opened again.
    """
    expected = _words(records, ["dataset"], "_want")
    for name, values in dims.items():
        expected = expected.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    keys = ["dataset", *dims]
    have = _words(tokens, keys, "_have")
    lacking = expected.join(have, [*keys, "_word"], "left").withColumn("_lack", F.col("_want").bitwiseAND(F.bitwise_not(F.coalesce("_have", F.lit(0).cast("bigint")))))
    places = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.bit_get(F.col("_lack"), i) == 1)
    return lacking.filter("_lack <> 0").select(*keys, "_word", F.explode(places).alias("_at")).select(*keys, (F.col("_word") * 64 + F.col("_at")).alias("row_idx"))


def token_counts(tokens: DataFrame, by: Sequence[str]) -> DataFrame:
    return tokens.groupBy(*by).agg(F.count(F.lit(1)).alias("n_tokens"))
