"""Monomer arrays: ratio vectors, unit vocabulary, component slots and features computed once per distinct structure."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litprops.functions.arrays import zeros
from litprops.functions.text import blank_to_null, parse_ratio
from litprops.operators.spread import contiguous_index, lookup_join
from litprops.session import settle

DEFAULT_UNIT = "mol%"  # fixed value: unit of a homopolymer


def unit_vocabulary(monomers: DataFrame, unit: str) -> DataFrame:
    """Distinct trimmed units plus ``mol%``, numbered in code-point order: ``(unit, idx)``. Units of one first letter are sorted together."""
    found = monomers.select(blank_to_null(unit).alias("unit")).filter("unit IS NOT NULL")
    default = monomers.sparkSession.range(1).select(F.lit(DEFAULT_UNIT).alias("unit"))
    names = found.distinct().unionByName(default).distinct()
    return contiguous_index(names, "unit", bucket=F.ascii("unit")).select("unit", F.col("idx").cast("int").alias("idx"))


def unit_index(unit, vocabulary: list[str]) -> Column:
    """Position of a unit (0-based), -1 when unknown."""
    c = F.col(unit) if isinstance(unit, str) else unit
    return F.array_position(F.array(*[F.lit(u) for u in vocabulary]), F.coalesce(blank_to_null(c), F.lit(""))).cast("int") - 1


def ratio_vector(ratio_value, ratio_unit, is_homopolymer, vocabulary: list[str], strict: bool = True) -> Column:
    """``[value, has_value] ++ one-hot(unit)``; a homopolymer is 100 mol%, an unknown unit all zeros."""
    homo = F.coalesce(is_homopolymer, F.lit(False))
    idx = F.when(homo, F.lit(vocabulary.index(DEFAULT_UNIT))).otherwise(unit_index(ratio_unit, vocabulary))
    return indexed_ratio_vector(ratio_value, idx, is_homopolymer, len(vocabulary), strict)


def attach_unit_index(rows: DataFrame, vocabulary: DataFrame, ratio_unit: Column, is_homopolymer: Column, out: str = "unit_idx") -> DataFrame:
    """``out``: place of each row's unit in a vocabulary table (that of ``mol%`` for a homopolymer), NULL when unknown."""
    unit = F.when(F.coalesce(is_homopolymer, F.lit(False)), F.lit(DEFAULT_UNIT)).otherwise(blank_to_null(ratio_unit))
    known = vocabulary.select(F.col("unit").alias("_unit"), F.col("idx").alias(out))
    return rows.withColumn("_unit", unit).join(known, "_unit", "left").drop("_unit")


def indexed_ratio_vector(ratio_value, idx: Column, is_homopolymer, width: int, strict: bool = True) -> Column:
    """:func:`ratio_vector` for a unit whose place among ``width`` units is known."""
    value = parse_ratio(ratio_value, strict)
    homo = F.coalesce(is_homopolymer, F.lit(False))
    head = F.array(
        F.when(homo, 100.0).otherwise(F.coalesce(value, F.lit(0.0))),
        F.when(homo | value.isNotNull(), 1.0).otherwise(0.0),
    )
    return F.concat(head, F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.when(i == idx, 1.0).otherwise(0.0)))


def real_monomers(monomers: Column) -> Column:
    """Monomers with a non-blank SMILES, SMILES trimmed."""
    trimmed = F.transform(monomers, lambda m: m.withField("smiles", blank_to_null(m["smiles"])))
    return F.filter(trimmed, lambda m: m["smiles"].isNotNull())


def component_slots(monomers: Column) -> Column:
    """Exactly two slots: the first two monomers; one is doubled; none gives two empty slots. Blank SMILES become NULL."""
    trimmed = F.transform(F.slice(monomers, 1, 2), lambda m: m.withField("smiles", blank_to_null(m["smiles"])))
    none = F.filter(F.array(F.get(trimmed, F.lit(0))), lambda m: F.lit(False))
    count = F.coalesce(F.size(trimmed), F.lit(0))
    return (
        F.when(count >= 2, trimmed)
        .when(count == 1, F.concat(trimmed, trimmed))
        .otherwise(F.concat(none, F.array_repeat(F.get(trimmed, F.lit(0)), 2)))
    )


def graph_smiles(slots: Column, valid: Column) -> Column:
    """SMILES to draw per slot: the slot's own when it is in ``valid`` (an array), else the placeholder ``C``."""
    return F.transform(slots, lambda s: F.when(F.coalesce(F.array_contains(valid, s["smiles"]), F.lit(False)), s["smiles"]).otherwise("C"))


def type_flag(slots: Column, is_homopolymer: Column) -> Column:
    """0 for a homopolymer or at most one filled slot, else 1."""
    filled = F.size(F.filter(slots, lambda s: s["smiles"].isNotNull()))
    return F.when(F.coalesce(is_homopolymer, F.lit(False)) | (filled <= 1), 0).otherwise(1)


def distinct_smiles(records: DataFrame, monomers: str = "monomers") -> DataFrame:
    """Each trimmed SMILES once."""
    return (
        records.select(F.explode(real_monomers(F.col(monomers))).alias("m")).select(F.col("m.smiles").alias("smiles")).distinct()
    )


def smiles_counts(records: DataFrame, is_valid: Column, monomers: str = "monomers") -> DataFrame:
    """Distinct structures, valid and not. ``is_valid`` is a condition on ``smiles``."""
    return distinct_smiles(records, monomers).agg(
        F.count(F.lit(1)).alias("distinct_smiles"), F.count_if(is_valid).alias("valid"), F.count_if(~is_valid).alias("invalid")
    )


def multimer_requests(smiles: DataFrame, units: tuple[int, ...] = (3, 6, 9)) -> DataFrame:
    """One row per structure and chain length to compute features for."""
    return smiles.select("smiles", F.explode(F.array(*[F.lit(u) for u in units])).alias("units"))


def multimer_features(smiles: DataFrame, generate: Callable[[Column, Column], Column], compute: Callable[[DataFrame], DataFrame], units: tuple[int, ...] = (3, 6, 9)) -> DataFrame:
    """``smiles, units, chain, vec``: features of every distinct structure at every chain length.

    ``generate(smiles, units)`` gives the text of a chain; structures may share chains, and ``compute`` (``chain`` to ``chain, vec``) sees each
    distinct chain once. Both levels, and so the costly features, are worked out once and written to the shared folder.
    """
    asked = multimer_requests(smiles.select("smiles").distinct(), units)
    asked = settle(asked.withColumn("chain", generate(F.col("smiles"), F.col("units"))), "chains")
    made = settle(compute(asked.select("chain").distinct()).select("chain", "vec"), "chain-features")
    return asked.join(made, "chain", "left").select("smiles", "units", "chain", "vec")


def attach_slot_features(records: DataFrame, features: DataFrame, key: Sequence[str], width: int, units: tuple[int, ...] = (3, 6, 9), slots: str = "slots") -> DataFrame:
    """``key..., slot, smiles, by_units``: for both slots of every record its features at all chain lengths, in the order of ``units``.

    Slots and lengths come back by one join on the structure: features are a map by length, one row per structure. A structure without
    features, or a blank slot, has zero vectors.
    """
    lengths = features.groupBy("smiles").agg(F.map_from_entries(F.collect_list(F.struct("units", "vec"))).alias("_map"))  # one entry per length
    long = records.select(*key, F.posexplode(slots).alias("slot", "_m")).select(*key, "slot", F.col("_m.smiles").alias("smiles"))
    joined = lookup_join(long, lengths, ["smiles"])
    vectors = F.array(*[F.coalesce(F.try_element_at("_map", F.lit(u)), zeros(width)) for u in units])
    return joined.select(*key, "slot", "smiles", vectors.alias("by_units"))


def attach_features(records: DataFrame, features: DataFrame, on: str, width: int, vec: str = "vec") -> DataFrame:
    """Join features (unique by ``on``) back to records; missing ones become zero vectors. A structure shared by very many records
    is salted."""
    joined = lookup_join(records, features.select(on, vec), [on])
    return joined.withColumn(vec, F.coalesce(F.col(vec), zeros(width)))
