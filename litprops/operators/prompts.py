"""Model prompts from records and articles, rendered in the JVM from raw JSON text so that key order survives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litprops.functions.hashing import pick
from litprops.functions.text import json_string, python_json_numbers, python_json_spacing
from litprops.functions.variants import child, elements, is_kind
from litprops.operators.spread import attach_small

STRUCT = "struct"
WITH = "analysis_with_hierarchical_structure"
WITHOUT = "analysis_without_hierarchical_structure"

# The sentences of the regression prompts; {} marks body, property and unit.
DATA = "Here is the data of a polymer, {}, please predict {} based on the data, in units of {}"
DESCRIPTION = "Here is a description of a polymer: {}. Please predict {} based on the description, in units of {}"
REASONING = "Here is a reasoning analysis of a polymer: {}. Please predict {} based on the analysis, in units of {}"
BOTH = "Here is a description and reasoning analysis of a polymer: {}. Please predict {} based on the above content, in units of {}"

# Which record parts each prompt type shows.
JSON_TYPES = {1: ("chemical_composition", "processing_history", "hierarchical_structure"), 2: ("chemical_composition", "processing_history"), 9: ("chemical_composition",)}
ANALYSIS_OF = {3: WITH, 4: WITHOUT, 5: WITH, 6: WITHOUT, 7: WITH, 8: WITHOUT}
TEXT_TYPES = {3: (DESCRIPTION, ("descriptive_text",)), 5: (REASONING, ("reasoning_analysis",)), 7: (BOTH, ("descriptive_text", "reasoning_analysis"))}
TEXT_TYPES |= {t + 1: TEXT_TYPES[t] for t in (3, 5, 7)}

# Property code, full name and usual units, as the extraction prompt names them.
PROPERTIES = {
    "Tg": ("Glass Transition Temperature (Tg)", '"°C" or "K"'),
    "Tm": ("Melting Temperature (Tm)", '"°C" or "K"'),
    "n": ("Refractive Index (n)", "null (dimensionless)"),
    "eps": ("Dielectric Constant (ε)", "null (dimensionless)"),
    "E": ("Young's Modulus (E)", '"GPa" or "MPa"'),
    "UTS": ("Ultimate Tensile Strength (UTS)", '"MPa" or "GPa"'),
}


def _fill(sentence: str, *parts: Column) -> Column:
    pieces = sentence.split("{}")
    out = [F.lit(pieces[0])]
    for part, tail in zip(parts, pieces[1:]):
        out += [part, F.lit(tail)]
    return F.concat(*out)


def _raw(entry: Column, key: str, missing: str) -> Column:
    """Raw JSON of an object member: its text with numbers as Python prints them, ``null`` when null, ``missing`` when absent."""
    text = python_json_numbers(F.get_json_object(entry, f"$.{key}"))
    absent = child(F.try_parse_json(entry), key).isNull()
    return F.when(absent, F.lit(missing)).otherwise(F.coalesce(text, F.lit("null")))


def _text_member(entry: Column, path: str) -> Column:
    return F.get_json_object(entry, f"$.{path}")


def composition_json(entry: Column, fields: tuple[str, ...], exact_spacing: bool = True) -> Column:
    """``{"chemical_composition": ..., "processing_history": ...}`` with the record's own key order inside."""
    parts = [F.concat(F.lit('"chemical_composition":'), _raw(entry, "chemical_composition", "{}"))]
    parts += [F.concat(F.lit(f'"{f}":'), json_string(_text_member(entry, f))) for f in fields if f != "chemical_composition"]
    body = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    return python_json_spacing(body) if exact_spacing else body


def struct_json(entry: Column, exact_spacing: bool = True) -> Column:
    """Structure fields only: each monomer's smiles, ratio value and unit, and the homopolymer flag (false when absent)."""
    cc = child(F.try_parse_json(entry), "chemical_composition")
    # A string is quoted again, anything else is shown from its raw text: VARIANT would print 1.0 as 1.
    member = lambda m, k: F.coalesce(
        F.when(is_kind(child(m["v"], k), "STRING"), F.to_json(child(m["v"], k))).otherwise(python_json_numbers(F.get_json_object(m["raw"], f"$.{k}"))), F.lit("null")
    )
    monomer = lambda m: F.concat(
        F.lit('{"smiles":'), member(m, "smiles"), F.lit(',"ratio_value":'), member(m, "ratio_value"),
        F.lit(',"ratio_unit":'), member(m, "ratio_unit"), F.lit("}"),
    )
    raw = F.from_json(F.get_json_object(entry, "$.chemical_composition.monomers"), "ARRAY<STRING>")
    both = F.zip_with(elements(child(cc, "monomers")), raw, lambda v, r: F.struct(v.alias("v"), r.alias("raw")))
    monomers = F.coalesce(F.array_join(F.transform(both, monomer), ","), F.lit(""))
    body = F.concat(
        F.lit('{"chemical_composition":{"monomers":['), monomers,
        F.lit('],"is_homopolymer":'), F.coalesce(F.to_json(child(cc, "is_homopolymer")), F.lit("false")), F.lit("}}"),
    )
    return python_json_spacing(body) if exact_spacing else body


def unit_of(entry: Column, prop: Column) -> Column:
    """Unit of the target property, empty when null or absent."""
    path = F.concat(F.lit("$.properties."), prop, F.lit(".unit"))
    return F.coalesce(F.call_function("get_json_object", entry, path), F.lit(""))


def prompt(entry, prop, input_type: int | str, exact_spacing: bool = True) -> Column:
    """One of the nine prompt types, or ``struct``. ``entry`` is the record's JSON text, ``prop`` the target property."""
    entry = F.col(entry) if isinstance(entry, str) else entry
    prop = F.col(prop) if isinstance(prop, str) else prop
    unit = unit_of(entry, prop)
    if input_type == STRUCT:
        return _fill(DATA, struct_json(entry, exact_spacing), prop, unit)
    if input_type in JSON_TYPES:
        return _fill(DATA, composition_json(entry, JSON_TYPES[input_type], exact_spacing), prop, unit)
    if input_type not in TEXT_TYPES:
        raise ValueError(f"unknown input type: {input_type!r}")
    sentence, members = TEXT_TYPES[input_type]
    texts = [F.coalesce(_text_member(entry, f"{ANALYSIS_OF[input_type]}.{m}"), F.lit("")) for m in members]
    body = texts[0] if len(texts) == 1 else F.concat(texts[0], F.lit(" "), texts[1])
    return _fill(sentence, body, prop, unit)


def random_prompt(entry, prop, types: list[int], seed: int | str, epoch, row) -> Column:
    """A prompt whose type is picked by md5 of seed, epoch and row: the same on every retry."""
    chosen = pick([str(t) for t in types], seed, epoch if isinstance(epoch, Column) else F.lit(epoch), row)
    out = None
    for t in dict.fromkeys(types):
        branch = prompt(entry, prop, t)
        out = F.when(chosen == str(t), branch) if out is None else out.when(chosen == str(t), branch)
    return out


def missing_input(df: DataFrame, entry: str, input_type: int, by: list[str]) -> DataFrame:
    """Rows, and rows without the analysis that ``input_type`` needs. All rows are looked at, not just the first."""
    needed = ANALYSIS_OF.get(input_type)
    if needed is None:
        empty = F.lit(False)
    else:
        part = child(F.try_parse_json(F.col(entry)), needed)
        empty = ~is_kind(part, "OBJECT") | (F.to_json(part) == "{}")
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.count_if(empty).alias("without_input"))


def extraction_prompt(df: DataFrame, templates: DataFrame, text: str = "text", prop: str = "property") -> DataFrame:
    """Template of each row's property, a line feed, the article text. ``templates`` is ``(property, template)``, one row per property;
    a property without a template is an error. Properties are few and each has very many articles, so whole texts never move by property."""
    known = templates.select(F.col("property").alias(prop), F.col("template").alias("_template"))
    missing = F.raise_error(F.concat(F.lit("no prompt template for property "), F.coalesce(F.col(prop), F.lit("NULL"))))
    template = F.when(F.col("_template").isNull(), missing).otherwise(F.col("_template"))
    return attach_small(df, known, [prop]).withColumn("prompt", F.concat(template, F.lit("\n"), F.col(text))).select(*dict.fromkeys([*df.columns, "prompt"]))


def default_extraction_template(prop: str) -> str:
    """A short extraction prompt for a known property; users may bring their own table of templates."""
    name, units = PROPERTIES[prop]
    return (
        f"Extract every polymer sample with a reported {name} from the paper below. Answer with a JSON array only; an empty array if "
        "there is none. Each entry has doi, year, chemical_composition (repeat_unit_psmiles, monomers, additives, is_homopolymer), "
        f"processing_history, hierarchical_structure and properties.{prop} with value (array of numbers) and unit ({units}).\n"
    )


def review_prompt(template, full_name, rules, extracted, text) -> Column:
    """Fill the four marks of a review template, in order: ``{PROP_FULL_NAME} {RULES} {EXTRACTED_DATA} {MD_TEXT}``."""
    out = template
    for mark, value in (("{PROP_FULL_NAME}", full_name), ("{RULES}", rules), ("{EXTRACTED_DATA}", extracted), ("{MD_TEXT}", text)):
        out = F.replace(out, F.lit(mark), value)
    return out


def generation_payloads(entry, exact_spacing: bool = True) -> tuple[Column, Column]:
    """JSON shown to the text generator: with and without ``hierarchical_structure``; property values never appear."""
    entry = F.col(entry) if isinstance(entry, str) else entry

    def body(fields: tuple[str, ...]) -> Column:
        parts = [F.concat(F.lit('"chemical_composition":'), _raw(entry, "chemical_composition", "null"))]
        parts += [F.concat(F.lit(f'"{f}":'), json_string(_text_member(entry, f))) for f in fields]
        out = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
        return python_json_spacing(out) if exact_spacing else out

    return body(("processing_history", "hierarchical_structure")), body(("processing_history",))


def generation_prompt(template: Column, prop: Column, payload: Column) -> Column:
    return F.replace(F.replace(template, F.lit("{TARGET_PROPERTY}"), prop), F.lit("{INPUT_JSON_DATA}"), payload)
