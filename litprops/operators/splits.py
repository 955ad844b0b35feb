"""Split tables: ``(dataset, split_name, part, pos, row_idx)``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litprops.functions.hashing import hash_fraction
from litprops.operators.spread import attach_small

# Names of the frozen splits, e.g. split_random, split_article_40pct.
_SPLIT_NAME = r"\Asplit_(random|article)(?:_(\d+)pct)?\z"


def gather(records: DataFrame, split: DataFrame, strict: bool = True) -> DataFrame:
    """Records of each split row; ``pos`` keeps the list order and repeats are kept.

    ``strict`` makes an index that is not in the dataset fail the job: an outer join whose hit flag a filter checks, so that no column
    pruning can lose the check and no second pass is needed. ``(dataset, row_idx)`` is unique in ``records``, so no key is hot.
    """
    keys = ["dataset", "row_idx"]
    if not strict:
        return split.join(records, keys, "inner")
    found = split.join(records.withColumn("_hit", F.lit(True)), keys, "left")
    message = F.concat(F.lit("split index out of range: "), F.col("dataset"), F.lit(" "), F.col("row_idx").cast("string"))
    return found.filter(F.when(F.col("_hit"), F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))).drop("_hit")


def missing_rows(records: DataFrame, split: DataFrame) -> DataFrame:
    """Split rows that point outside their dataset."""
    return split.join(records, ["dataset", "row_idx"], "left_anti")


def explode_lists(lists: DataFrame) -> DataFrame:
    """``(dataset, split_name, part, rows ARRAY<BIGINT>)`` to one row per index."""
    return lists.select("dataset", "split_name", "part", F.posexplode("rows").alias("pos", "row_idx")).withColumn(
        "pos", F.col("pos").cast("bigint")
    )


def split_rank(name) -> list[Column]:
    """Sort keys: random fractions, article fractions (no percentage counts as 100), domain splits, the rest; then by name."""
    c = F.col(name) if isinstance(name, str) else name
    kind = F.regexp_extract(c, _SPLIT_NAME, 1)
    pct = F.coalesce(F.nullif(F.regexp_extract(c, _SPLIT_NAME, 2), F.lit("")).cast("int"), F.lit(100))
    rank = F.when(kind == "random", 0).when(kind == "article", 1).when(c.startswith("continue_train"), 2).otherwise(3)
    return [rank, F.when(kind != "", pct).otherwise(0), F.when(kind == "", c).otherwise("")]


def assign_parts(unit: Column | str, seed: int | str, train: float = 0.7, val: float = 0.1) -> Column:
    """``train`` / ``val`` / ``test`` by the md5 fraction of ``unit``: the record for a random split, the article for a disjoint one."""
    u = hash_fraction(seed, unit)
    return F.when(u < train, "train").when(u < train + val, "val").otherwise("test")


def nested_fractions(split: DataFrame, unit: Sequence[str], seed: int | str, percents: Sequence[int] = (20, 40, 60, 80, 100)) -> DataFrame:
    """Nested training subsets: a row belongs to every percentage above its own md5 fraction; val and test stay whole."""
    u = hash_fraction(f"{seed}:fraction", *unit)
    wanted = F.filter(F.array(*[F.lit(p) for p in percents]), lambda p: (F.col("part") != "train") | (u * 100 < p))
    return split.withColumn("pct", F.explode(wanted)).withColumn(
        "split_name", F.when(F.col("pct") == 100, F.col("split_name")).otherwise(F.concat("split_name", F.lit("_"), "pct", F.lit("pct")))
    )


def overlaps(split: DataFrame) -> DataFrame:
    """Row indices that sit in more than one part of a split; empty when the parts are disjoint."""
    return (
        split.groupBy("dataset", "split_name", "row_idx")
        .agg(F.count_distinct("part").alias("n_parts"))
        .filter("n_parts > 1")
    )


def uncovered(records: DataFrame, split: DataFrame) -> DataFrame:
    """Records of a dataset that one of its splits leaves out."""
    names = split.select("dataset", "split_name").distinct()
    return attach_small(records.select("dataset", "row_idx"), names, ["dataset"], "inner").join(split, ["dataset", "split_name", "row_idx"], "left_anti")


def not_nested(split: DataFrame, small: str, large: str) -> DataFrame:
    """Training rows of split ``small`` that split ``large`` lacks."""
    rows = lambda name: split.filter((F.col("split_name") == name) & (F.col("part") == "train")).select("dataset", "row_idx")
    return rows(small).exceptAll(rows(large))


def sizes(split: DataFrame) -> DataFrame:
    """One row per split with its train / val / test counts and total."""
    return split.groupBy("dataset", "split_name").agg(
        *[F.count_if(F.col("part") == p).alias(p) for p in ("train", "val", "test")], F.count(F.lit(1)).alias("total")
    )


def stacked(records: DataFrame, split: DataFrame, parts: Sequence[str] = ("train", "val"), prop: str = "property") -> DataFrame:
    """Rows of several properties (datasets) under each other, in the wanted parts, with their property: the input of a joint fit."""
    return gather(records, split.filter(F.col("part").isin(*parts))).withColumnRenamed("dataset", prop)
