"""One entry per rule that breaks only that rule, then combinations; missing, null and wrong type stay apart."""

import copy
import json

import pytest
from pyspark.sql import functions as F

from litprops.operators import validate

GOOD = {
    "doi": None, "year": 2020,
    "chemical_composition": {
        "repeat_unit_psmiles": None,
        "monomers": [{"name": "a", "smiles": None, "ratio_value": "97-99", "ratio_unit": None}],
        "additives": [{"name": "b", "type": "filler"}], "is_homopolymer": False,
    },
    "processing_history": None, "hierarchical_structure": "x", "properties": {"Tg": {"value": [1, 2.5], "unit": None}},
}


def broken(path, value=..., base=None):
    """GOOD with one member removed (no value) or replaced."""
    entry = copy.deepcopy(base or GOOD)
    at = entry
    for key in path[:-1]:
        at = at[key]
    if value is ...:
        del at[path[-1]]
    else:
        at[path[-1]] = value
    return entry


CC, M0, A0 = "chemical_composition", ["chemical_composition", "monomers", 0], ["chemical_composition", "additives", 0]
CASES = [
    (GOOD, []),
    ([1], ["entry is not a dict"]),
    (None, ["entry is not a dict"]),
    (broken(["doi"]), ["missing 'doi' field"]),
    (broken(["doi"], 5), ["'doi' must be string or null"]),
    (broken(["year"]), ["missing 'year' field"]),
    (broken(["year"], "1999"), ["'year' must be integer or null"]),
    (broken(["year"], None), []),
    (broken(["year"], True), []),
    (broken(["year"], 1999.5), []),
    (broken([CC]), ["missing or invalid 'chemical_composition' (must be dict)"]),
    (broken([CC], []), ["missing or invalid 'chemical_composition' (must be dict)"]),
    (broken([CC, "repeat_unit_psmiles"]), ["chemical_composition missing 'repeat_unit_psmiles'"]),
    (broken([CC, "repeat_unit_psmiles"], 1), ["'repeat_unit_psmiles' must be string or null"]),
    (broken([CC, "monomers"]), ["chemical_composition missing or invalid 'monomers' (must be array)"]),
    (broken([CC, "monomers"], None), ["chemical_composition missing or invalid 'monomers' (must be array)"]),
    (broken([CC, "monomers"], []), []),
    (broken([CC, "monomers"], [3, None]), ["monomers[0]: monomer entry is not a dict", "monomers[1]: monomer entry is not a dict"]),
    (broken([*M0, "name"]), ["monomers[0]: monomer missing valid 'name' (string)"]),
    (broken([*M0, "name"], None), ["monomers[0]: monomer missing valid 'name' (string)"]),
    (broken([*M0, "smiles"]), ["monomers[0]: monomer missing 'smiles' field"]),
    (broken([*M0, "smiles"], 7), ["monomers[0]: monomer 'smiles' must be string or null"]),
    (broken([*M0, "ratio_value"]), ["monomers[0]: monomer missing 'ratio_value' field"]),
    (broken([*M0, "ratio_unit"]), ["monomers[0]: monomer missing 'ratio_unit' field"]),
    (broken([*M0, "ratio_value"], {"any": 1}), []),
    (broken([CC, "additives"]), []),
    (broken([CC, "additives"], None), []),
    (broken([CC, "additives"], "x"), ["'additives' must be array or null"]),
    (broken([*A0, "name"]), ["additives[0]: additive missing valid 'name' (string)"]),
    (broken([*A0, "type"], None), ["additives[0]: additive missing valid 'type' (string)"]),
    (broken([CC, "additives"], ["x"]), ["additives[0]: additive entry is not a dict"]),
    (broken([CC, "is_homopolymer"]), ["chemical_composition missing 'is_homopolymer'"]),
    (broken([CC, "is_homopolymer"], None), ["'is_homopolymer' must be boolean"]),
    (broken(["processing_history"]), ["missing 'processing_history' field"]),
    (broken(["hierarchical_structure"], []), ["'hierarchical_structure' must be string or null"]),
    (broken(["properties"]), ["missing or invalid 'properties' (must be dict)"]),
    (broken(["properties"], {}), ["properties missing 'Tg' (must be dict)"]),
    (broken(["properties", "Tg"], 3), ["properties missing 'Tg' (must be dict)"]),
    (broken(["properties", "Tg", "value"]), ["properties.Tg.value must be a non-empty array"]),
    (broken(["properties", "Tg", "value"], []), ["properties.Tg.value must be a non-empty array"]),
    (broken(["properties", "Tg", "value"], 5), ["properties.Tg.value must be a non-empty array"]),
    (broken(["properties", "Tg", "value"], [1, "2", None, True]), ["properties.Tg.value[1] must be a number", "properties.Tg.value[2] must be a number"]),
    (broken(["properties", "Tg", "unit"]), ["properties.Tg missing 'unit'"]),
    (broken(["properties", "Tg", "unit"], 3), ["properties.Tg.unit must be string or null"]),
    (
        broken(["properties"], base=broken(["doi"], base=broken([CC, "is_homopolymer"], 1))),
        ["missing 'doi' field", "'is_homopolymer' must be boolean", "missing or invalid 'properties' (must be dict)"],
    ),
]


@pytest.fixture(scope="module")
def checked(spark):
    df = spark.createDataFrame([(i, json.dumps(e)) for i, (e, _) in enumerate(CASES)], "i int, j string")
    entries = df.select("i", F.lit("f").alias("filename"), F.parse_json("j").alias("entry"))
    return validate.validate(entries, "entry", "Tg")


def test_rules(checked):
    got = {r["i"]: (r["errors"], r["is_valid"]) for r in checked.select("i", "errors", "is_valid").collect()}
    assert got == {i: (errors, not errors) for i, (_, errors) in enumerate(CASES)}


def test_strict_numbers(spark):
    df = spark.createDataFrame([(json.dumps(broken(["year"], True)),)], "j string").select(F.parse_json("j").alias("entry"))
    assert validate.validate(df, "entry", "Tg", bool_is_number=False).first()["errors"] == ["'year' must be integer or null"]


def test_route_and_counts(checked):
    valid, errors = validate.route(checked)
    n_valid = sum(not e for _, e in CASES)
    assert valid.count() == n_valid and valid.columns == ["i", "filename", "entry"]
    assert errors.columns == ["entry", "errors", "source_file"] and errors.count() == len(CASES) - n_valid
    assert validate.route_counts(checked, ["filename"]).collect()[0][1:] == (n_valid, len(CASES) - n_valid)


def test_typed(checked):
    valid, _ = validate.route(checked)
    r = validate.typed(valid).orderBy("i").first()
    assert r["chemical_composition"]["monomers"][0]["ratio_value"] == "97-99"
    assert r["properties"]["Tg"]["value"] == [1.0, 2.5] and r["doi"] is None


def test_property_name_with_blank(spark):
    entry = broken(["properties"], {"my prop": {"value": [1], "unit": None}})
    df = spark.createDataFrame([(json.dumps(entry),)], "j string").select(F.parse_json("j").alias("entry"))
    assert validate.validate(df, "entry", "my prop").first()["errors"] == []
