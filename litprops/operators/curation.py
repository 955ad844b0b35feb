"""Curation of candidate records: units, DOIs, duplicates, leakage, and dataset reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litprops.functions.text import strip

# Canonical unit per property, and value = factor * x + offset to reach it.
CANONICAL_UNIT = {"Tg": "°C", "Tm": "°C", "E": "GPa", "UTS": "MPa"}
CONVERSIONS = {
    ("°C", "°C"): (1.0, 0.0),
    ("K", "°C"): (1.0, -273.15),
    ("GPa", "GPa"): (1.0, 0.0),
    ("MPa", "GPa"): (0.001, 0.0),
    ("MPa", "MPa"): (1.0, 0.0),
    ("GPa", "MPa"): (1000.0, 0.0),
}


def canonical_value(prop: Column, value: Column, unit: Column) -> tuple[Column, Column]:
    """``(value, unit)`` in the property's canonical unit; a dimensionless property passes, an unknown unit gives NULL."""
    u = F.coalesce(strip(unit), F.lit(""))
    out_value, out_unit = None, None
    for p, target in CANONICAL_UNIT.items():
        for (source, goal), (factor, offset) in CONVERSIONS.items():
            if goal != target:
                continue
            hit = (prop == p) & (u == source)
            moved = value * F.lit(factor) + F.lit(offset)
            out_value = F.when(hit, moved) if out_value is None else out_value.when(hit, moved)
        named = prop == p
        out_unit = F.when(named, target) if out_unit is None else out_unit.when(named, target)
    return out_value.when(~prop.isin(*CANONICAL_UNIT), value), out_unit


def in_range(value: Column, low: float = 0.0, high: float = 1000.0) -> Column:
    """``low < value <= high``."""
    return (value > low) & (value <= high)


def drop_duplicates(df: DataFrame, content: Sequence[str], row_idx: str = "row_idx") -> DataFrame:
    """Keep the first row of equal content.

    Content is reduced to a digest and counted before the shuffle, so a group of copies, however large, sends one line per task;
    whole rows move only for the survivors' semi-join on the unique ``row_idx``.
    """
    digest = F.sha2(F.to_json(F.struct(*content), {"ignoreNullFields": "false"}), 256)
    first = df.select(row_idx, digest.alias("_d")).groupBy("_d").agg(F.min(row_idx).alias(row_idx)).select(row_idx)
    return df.join(first, row_idx, "left_semi")


def duplicate_groups(df: DataFrame, content: Sequence[str], row_idx: str = "row_idx") -> DataFrame:
    """Size and first row of each group of equal content."""
    digest = F.sha2(F.to_json(F.struct(*content), {"ignoreNullFields": "false"}), 256)
    return df.select(row_idx, digest.alias("_d")).groupBy("_d").agg(F.min(row_idx).alias("first_row"), F.count(F.lit(1)).alias("copies")).drop("_d")


def leaks_target(text: Column, value: Column) -> Column:
    """Whether the input text quotes the target as a number of its own (``88`` and ``88.0`` are the same, ``188`` is not)."""
    numbers = F.regexp_extract_all(text, F.lit(r"\d+(?:\.\d+)?"), F.lit(0))
    return F.coalesce(F.exists(numbers, lambda t: t.try_cast("double") == F.abs(value)), F.lit(False))


def property_report(records: DataFrame, prop: str = "property", article: str = "article_key") -> DataFrame:
    """Records and distinct articles per property, and once over all properties (articles are not summed)."""
    # Distinct pairs first: a hot article is one line per task, and no task holds a set of articles. Grouping sets then count the pairs and, once
    # more without their property, the articles; the records are read once.
    pairs = records.groupBy(prop, article).agg(F.count(F.lit(1)).alias("n"))
    told = pairs.groupingSets([[prop, article], [article]], prop, article).agg(F.sum("n").alias("n"), F.grouping(prop).alias("_all"))
    return told.groupBy("_all", prop).agg(F.sum("n").alias("records"), F.count(article).alias("articles")).drop("_all")


def publication_pairs(records: DataFrame, doi: Column, prop: str = "property") -> DataFrame:
    """Distinct DOI and property; ``E_article`` counts as ``E``."""
    named = F.when(F.col(prop) == "E_article", "E").otherwise(F.col(prop))
    return records.select(doi.alias("doi"), named.alias("property")).filter("doi IS NOT NULL").distinct()


def pair_counts(pairs: DataFrame) -> DataFrame:
    per = pairs.groupBy("doi").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.sum("n").alias("pairs"), F.count(F.lit(1)).alias("articles"))


def ordered_distinct(df: DataFrame, value: str, position: str) -> DataFrame:
    """Distinct values by first position."""
    return df.groupBy(value).agg(F.min(position).alias(position)).orderBy(position)


def infer_property(first_properties: Column, dataset: str, mode: str = "first") -> Column:
    """Property name of a dataset from its first record's property map: the dataset's own name, else the first key with a value.

    ``mode='strict'`` fails when none has a value, ``mode='unique'`` also when there are several.
    """
    valued = F.map_keys(F.map_filter(first_properties, lambda _, v: v["value"].isNotNull()))
    own = F.map_contains_key(first_properties, dataset)
    if mode == "first":
        return F.when(own, dataset).otherwise(F.coalesce(F.get(valued, F.lit(0)), F.lit(dataset)))
    if mode == "strict":
        return F.when(own, dataset).when(F.size(valued) > 0, F.get(valued, F.lit(0))).otherwise(F.raise_error(F.lit(f"no property with a value in {dataset}")))
    if mode == "unique":
        every = F.map_keys(first_properties)
        return F.when(F.size(every) == 1, F.get(every, F.lit(0))).otherwise(
            F.raise_error(F.lit(f"{dataset} does not have exactly one property"))
        )
    raise ValueError(f"unknown mode: {mode!r}")


def target_value(properties: Column, prop, strict: bool = False) -> Column:
    """First value of a property as DOUBLE. A missing one is NULL, or fails the job when ``strict``."""
    key = F.lit(prop) if isinstance(prop, str) else prop
    value = F.get(F.try_element_at(properties, key)["value"], F.lit(0)).cast("double")
    if strict:
        value = F.coalesce(value, F.raise_error(F.concat(F.lit("no value for property "), key)).cast("double"))
    return value
