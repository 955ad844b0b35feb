"""Schema rules for extracted entries. Every broken rule is reported, in a fixed order; nothing shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litprops.functions.text import let
from litprops.functions.variants import elements, is_kind, kind, members

# Rule messages.
NOT_OBJECT = "entry is not a dict"
MISSING = "missing '{}' field"
STRING_OR_NULL = "'{}' must be string or null"
YEAR = "'year' must be integer or null"
COMPOSITION = "missing or invalid 'chemical_composition' (must be dict)"
COMPOSITION_MISSING = "chemical_composition missing '{}'"
MONOMERS = "chemical_composition missing or invalid 'monomers' (must be array)"
ADDITIVES = "'additives' must be array or null"
HOMOPOLYMER = "'is_homopolymer' must be boolean"
PROPERTIES = "missing or invalid 'properties' (must be dict)"
ITEM_NOT_OBJECT = "{} entry is not a dict"
ITEM_TEXT = "{} missing valid '{}' (string)"
ITEM_MISSING = "{} missing '{}' field"
ITEM_STRING_OR_NULL = "{} '{}' must be string or null"
PROPERTY_MISSING = "properties missing '{}' (must be dict)"
VALUE_EMPTY = "properties.{}.value must be a non-empty array"
VALUE_NUMBER = "properties.{}.value[{}] must be a number"
UNIT_MISSING = "properties.{} missing 'unit'"
UNIT_TEXT = "properties.{}.unit must be string or null"

_NUMBERS = ("TINYINT", "SMALLINT", "INT", "BIGINT", "DECIMAL", "FLOAT", "DOUBLE")
_NO_ERRORS = "array<string>"


def _none() -> Column:
    return F.array().cast(_NO_ERRORS)


def _if(broken: Column, message) -> Column:
    text = F.lit(message) if isinstance(message, str) else message
    return F.when(broken, F.array(text)).otherwise(_none())


def _text_or_null(v: Column, missing, wrong) -> Column:
    """Present, and a string or null."""
    return let(kind(v), lambda k: F.when(k.isNull(), F.array(missing)).when(~k.isin("STRING", "VOID"), F.array(wrong)).otherwise(_none()))


def _each(items: Column, name: str, rules) -> Column:
    """Errors of every array element, each with its position in front."""
    return F.flatten(
        F.transform(
            items,
            lambda item, i: F.transform(rules(item), lambda e: F.concat(F.lit(f"{name}["), i.cast("string"), F.lit("]: "), e)),
        )
    )


def _member(m: Column, key: str) -> Column:
    return F.try_element_at(m, F.lit(key))


def _monomer(item: Column) -> Column:
    def rules(m: Column) -> Column:
        return F.when(m.isNull(), F.array(F.lit(ITEM_NOT_OBJECT.format("monomer")))).otherwise(
            F.concat(
                _if(~is_kind(_member(m, "name"), "STRING"), ITEM_TEXT.format("monomer", "name")),
                _text_or_null(
                    _member(m, "smiles"), F.lit(ITEM_MISSING.format("monomer", "smiles")), F.lit(ITEM_STRING_OR_NULL.format("monomer", "smiles"))
                ),
                _if(_member(m, "ratio_value").isNull(), ITEM_MISSING.format("monomer", "ratio_value")),
                _if(_member(m, "ratio_unit").isNull(), ITEM_MISSING.format("monomer", "ratio_unit")),
            )
        )

    return let(members(item), rules)


def _additive(item: Column) -> Column:
    def rules(m: Column) -> Column:
        return F.when(m.isNull(), F.array(F.lit(ITEM_NOT_OBJECT.format("additive")))).otherwise(
            F.concat(
                _if(~is_kind(_member(m, "name"), "STRING"), ITEM_TEXT.format("additive", "name")),
                _if(~is_kind(_member(m, "type"), "STRING"), ITEM_TEXT.format("additive", "type")),
            )
        )

    return let(members(item), rules)


def _list_rules(v: Column, name: str, rules, wrong: str, may_lack: bool) -> Column:
    """Rules of an array member; ``may_lack`` lets it be absent or null."""

    def by_items(items: Column) -> Column:
        bad = F.when(items.isNotNull(), _each(items, name, rules))
        if may_lack:
            bad = bad.when(v.isNull() | F.is_variant_null(v), _none())
        return bad.otherwise(F.array(F.lit(wrong)))

    return let(elements(v), by_items)


def _composition(m: Column) -> Column:
    return F.when(m.isNull(), F.array(F.lit(COMPOSITION))).otherwise(
        F.concat(
            _text_or_null(
                _member(m, "repeat_unit_psmiles"),
                F.lit(COMPOSITION_MISSING.format("repeat_unit_psmiles")),
                F.lit(STRING_OR_NULL.format("repeat_unit_psmiles")),
            ),
            _list_rules(_member(m, "monomers"), "monomers", _monomer, MONOMERS, may_lack=False),
            _list_rules(_member(m, "additives"), "additives", _additive, ADDITIVES, may_lack=True),
            let(
                kind(_member(m, "is_homopolymer")),
                lambda k: F.when(k.isNull(), F.array(F.lit(COMPOSITION_MISSING.format("is_homopolymer"))))
                .when(k != "BOOLEAN", F.array(F.lit(HOMOPOLYMER)))
                .otherwise(_none()),
            ),
        )
    )


def _property(props: Column, prop: str, numbers: tuple[str, ...]) -> Column:
    number = lambda i: F.replace(F.lit(VALUE_NUMBER.format(prop, "\0")), F.lit("\0"), i.cast("string"))

    def value_rules(items: Column) -> Column:
        each = F.transform(items, lambda v, i: F.when(~is_kind(v, *numbers), number(i)))
        return F.when(items.isNull() | (F.size(items) == 0), F.array(F.lit(VALUE_EMPTY.format(prop)))).otherwise(F.filter(each, lambda e: e.isNotNull()))

    def rules(data: Column) -> Column:
        return F.when(data.isNull(), F.array(F.lit(PROPERTY_MISSING.format(prop)))).otherwise(
            F.concat(
                let(elements(_member(data, "value")), value_rules),
                _text_or_null(_member(data, "unit"), F.lit(UNIT_MISSING.format(prop)), F.lit(UNIT_TEXT.format(prop))),
            )
        )

    return F.when(props.isNull(), F.array(F.lit(PROPERTIES))).otherwise(let(members(_member(props, prop)), rules))


def entry_errors(entry: Column, prop: str, bool_is_number: bool = True) -> Column:
    """All rule violations of a VARIANT entry for property ``prop``.

    ``bool_is_number`` keeps the source behaviour in which ``true`` passes as a year or a value. Containers are opened once each;
    only scalars are asked for their type.
    """
    numbers = (*_NUMBERS, "BOOLEAN") if bool_is_number else _NUMBERS

    def rules(m: Column) -> Column:
        field = lambda k: _text_or_null(_member(m, k), F.lit(MISSING.format(k)), F.lit(STRING_OR_NULL.format(k)))
        return F.when(m.isNull(), F.array(F.lit(NOT_OBJECT))).otherwise(
            F.concat(
                field("doi"),
                let(
                    kind(_member(m, "year")),
                    lambda k: F.when(k.isNull(), F.array(F.lit(MISSING.format("year"))))
                    .when(~k.isin(*numbers, "VOID"), F.array(F.lit(YEAR)))
                    .otherwise(_none()),
                ),
                let(members(_member(m, "chemical_composition")), _composition),
                field("processing_history"),
                field("hierarchical_structure"),
                let(members(_member(m, "properties")), lambda p: _property(p, prop, numbers)),
            )
        )

    return let(members(entry), rules)


def validate(df: DataFrame, entry: str, prop: str, bool_is_number: bool = True) -> DataFrame:
    """Add ``errors`` and ``is_valid``."""
    checked = df.withColumn("errors", entry_errors(F.col(entry), prop, bool_is_number))
    return checked.withColumn("is_valid", F.size("errors") == 0)


def route(validated: DataFrame, entry: str = "entry", source_file: str | None = "filename") -> tuple[DataFrame, DataFrame]:
    """``(valid rows, error rows)``; an error row is ``entry, errors`` and its source file."""
    valid = validated.filter("is_valid").drop("errors", "is_valid")
    cols = [entry, "errors"] + ([F.col(source_file).alias("source_file")] if source_file else [])
    return valid, validated.filter("NOT is_valid").select(*cols)


def route_counts(validated: DataFrame, by: list[str]) -> DataFrame:
    return validated.groupBy(*by).agg(F.count_if("is_valid").alias("valid"), F.count_if(~F.col("is_valid")).alias("invalid"))


# Fields of a record, as the validator accepts, the sinks write and the readers read it. What may be of several types (a year, an amount)
# stays a VARIANT; ratios are text, because they may be a number or a range such as 97-99.
RECORD = (
    "doi STRING, title STRING, year VARIANT, filename STRING, "
    "chemical_composition STRUCT<repeat_unit_psmiles STRING, "
    "monomers ARRAY<STRUCT<name STRING, smiles STRING, ratio_value STRING, ratio_unit STRING>>, "
    "additives ARRAY<STRUCT<name STRING, type STRING, amount_value VARIANT, amount_unit VARIANT>>, is_homopolymer BOOLEAN>, "
    "processing_history STRING, hierarchical_structure STRING, "
    "properties MAP<STRING, STRUCT<value ARRAY<DOUBLE>, unit STRING>>"
)
RECORD_WITH_ANALYSES = RECORD + (
    ", analysis_with_hierarchical_structure STRUCT<descriptive_text STRING, reasoning_analysis STRING>"
    ", analysis_without_hierarchical_structure STRUCT<descriptive_text STRING, reasoning_analysis STRING>"
)


def typed(valid: DataFrame, entry: str = "entry") -> DataFrame:
    """Valid entries as typed record columns (kept beside the other columns of the row)."""
    record = F.try_variant_get(F.col(entry), "$", f"STRUCT<{RECORD}>")
    return valid.withColumn("_r", record).select(*[c for c in valid.columns if c != entry], "_r.*")
