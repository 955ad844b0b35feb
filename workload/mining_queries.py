"""Responses, validation, routing, titles, prompts and progress."""

from __future__ import annotations

from pyspark.sql import functions as F

from litprops.functions import variants
from litprops.functions.text import json_string, strip_fences
from litprops.operators import mining, prompts, validate
from litprops.operators.spread import widen
from workload.bindings import ENTRY, MD, entry_json, markdown
from workload.registry import query, table

# ---- responses: conversation turns wrapped as a model might

_TURNS = "conversations"


def _responses(spark, d):
    k = F.col("conv_id") * 7 + F.col("turn")
    item = F.concat(F.lit('{"role":"'), F.col("role"), F.lit('","text":'), json_string("text"), F.lit("}"))
    fence = F.lit("```")
    content = (
        F.when(k % 8 == 0, F.concat(F.lit("```json\n["), item, F.lit("]\n"), fence))
        .when(k % 8 == 1, F.concat(F.lit("  ```"), item, fence, F.lit(" \n")))
        .when(k % 8 == 2, F.concat(F.lit("Here you are: ["), item, F.lit(","), item, F.lit("] and done")))
        .when(k % 8 == 3, F.lit("42"))
        .when(k % 8 == 4, F.concat(F.lit("["), item, F.lit(",")))
        .when(k % 8 == 5, F.lit("[]"))
        .when(k % 8 == 6, F.lit("[1] [2]"))
        .otherwise(F.lit("  \t"))
    )
    return table(spark, d, _TURNS).select("conv_id", "turn", "text", content.alias("content"))


_RESP = """resp AS (SELECT conv_id, turn, text, (conv_id * 7 + turn) % 8 AS k FROM conversations)"""


@query(
    f"""WITH {_RESP} SELECT conv_id, turn, CASE k WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 5 THEN 0 END AS n_entries, CASE WHEN k <= 2 THEN length(text) END::BIGINT AS text_length,
 k IN (3, 4, 6, 7) AS failed FROM resp"""
)
def parsed_responses(spark, d):
    """Fences removed and entries parsed leniently; the text inside survives unchanged."""
    parsed = mining.stage_entries(_responses(spark, d))
    first = F.try_variant_get(F.get("entries", F.lit(0)), "$.text", "string")
    return parsed.select(
        "conv_id", "turn", F.size("entries").alias("n_entries"), F.length(first).cast("bigint").alias("text_length"), F.col("entries").isNull().alias("failed")
    ).withColumn("n_entries", F.when(~F.col("failed"), F.col("n_entries")))


@query(
    f"""WITH {_RESP} SELECT conv_id, turn, md5('a' || text) AS extractor, md5(CASE WHEN k % 2 = 0 THEN 'a' || text ELSE chr(96)||chr(96)||chr(96) || 'a' || text END) AS generator FROM resp"""
)
def stripped_fences(spark, d):
    """The extractor drops a bare leading fence, the generator keeps it."""
    k = F.col("conv_id") * 7 + F.col("turn")
    raw = F.concat(F.lit(" "), F.when(k % 8 % 2 == 0, "```json").otherwise("```"), F.lit("a"), F.col("text"), F.lit("b```\n"))
    fenced = table(spark, d, _TURNS).withColumn("raw", F.replace(raw, F.lit("b```\n"), F.lit("```\n")))
    return fenced.select("conv_id", "turn", F.md5(strip_fences("raw")).alias("extractor"), F.md5(strip_fences("raw", "generator")).alias("generator"))


# Turns 2n and 2n + 1 of a conversation are the draft and the review of one file.
_PAIRS = f"""{_RESP}, f AS (SELECT conv_id * 1000 + turn // 2 AS filename, max(CASE WHEN turn % 2 = 0 THEN k END) AS k0, max(CASE WHEN turn % 2 = 1 THEN k END) AS k1 FROM resp GROUP BY 1),
e AS (SELECT filename, CASE k0 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 5 THEN 0 END AS draft, CASE k1 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 0 END AS review FROM f WHERE k0 IS NOT NULL),
st AS (SELECT filename, draft, CASE WHEN review > 0 THEN review ELSE draft END AS final, draft IS NULL AS error FROM e)"""


def _stages(spark, d):
    file = F.col("conv_id") * 1000 + F.floor(F.col("turn") / 2)
    parsed = mining.stage_entries(_responses(spark, d)).withColumns({"filename": file, "reasoning": F.lit("")})
    return mining.review_override(parsed.filter("turn % 2 = 0"), parsed.filter("turn % 2 = 1"))


@query(f"WITH {_PAIRS} SELECT * FROM st")
def review_override(spark, d):
    """Only a non-empty review replaces the draft."""
    n = lambda c: F.when(F.col(c).isNotNull(), F.size(c))
    return _stages(spark, d).select("filename", n("stage1_entries").alias("draft"), n("final_entries").alias("final"), "error")


@query(f"WITH {_PAIRS} SELECT filename FROM st WHERE NOT error AND final = 0")
def no_data_files(spark, d):
    return mining.no_data(_stages(spark, d))


# ---- validation

_T = lambda path: f"json_type(entry_text, '{path}')"
_STR = lambda path: f"({_T(path)} IN ('VARCHAR', 'NULL'))"
_HAS = lambda path: f"({_T(path)} IS NOT NULL)"


def _field(path: str, missing: str, wrong: str) -> str:
    return f"CASE WHEN NOT {_HAS(path)} THEN ['{missing}'] WHEN NOT {_STR(path)} THEN ['{wrong}'] ELSE [] END"


_Q = "''"
ERRORS = f"""{ENTRY}, chk AS (SELECT row_idx, filename, entry_text, CASE WHEN json_type(entry_text) <> 'OBJECT' THEN ['entry is not a dict'] ELSE list_concat(
  {_field('$.doi', f'missing {_Q}doi{_Q} field', f'{_Q}doi{_Q} must be string or null')},
  CASE WHEN NOT {_HAS('$.year')} THEN ['missing ''year'' field'] WHEN {_T('$.year')} IN ('VARCHAR', 'ARRAY', 'OBJECT') THEN ['''year'' must be integer or null'] ELSE [] END,
  CASE WHEN coalesce({_T('$.chemical_composition')}, '') <> 'OBJECT' THEN ['missing or invalid ''chemical_composition'' (must be dict)'] ELSE list_concat(
    {_field('$.chemical_composition.repeat_unit_psmiles', f'chemical_composition missing {_Q}repeat_unit_psmiles{_Q}', f'{_Q}repeat_unit_psmiles{_Q} must be string or null')},
    CASE WHEN coalesce({_T('$.chemical_composition.monomers')}, '') <> 'ARRAY' THEN ['chemical_composition missing or invalid ''monomers'' (must be array)']
      ELSE flatten(list_transform(range(json_array_length(entry_text, '$.chemical_composition.monomers')::BIGINT), lambda i: list_transform(
        CASE WHEN json_type(json_extract(entry_text, '$.chemical_composition.monomers[' || i || ']')) <> 'OBJECT' THEN ['monomer entry is not a dict'] ELSE list_concat(
          CASE WHEN coalesce(json_type(json_extract(entry_text, '$.chemical_composition.monomers[' || i || '].name')), '') <> 'VARCHAR' THEN ['monomer missing valid ''name'' (string)'] ELSE [] END,
          CASE WHEN json_extract(entry_text, '$.chemical_composition.monomers[' || i || '].smiles') IS NULL THEN ['monomer missing ''smiles'' field']
               WHEN json_type(json_extract(entry_text, '$.chemical_composition.monomers[' || i || '].smiles')) NOT IN ('VARCHAR', 'NULL') THEN ['monomer ''smiles'' must be string or null'] ELSE [] END,
          CASE WHEN json_extract(entry_text, '$.chemical_composition.monomers[' || i || '].ratio_value') IS NULL THEN ['monomer missing ''ratio_value'' field'] ELSE [] END,
          CASE WHEN json_extract(entry_text, '$.chemical_composition.monomers[' || i || '].ratio_unit') IS NULL THEN ['monomer missing ''ratio_unit'' field'] ELSE [] END) END,
        lambda e: 'monomers[' || i || ']: ' || e))) END,
    CASE WHEN coalesce({_T('$.chemical_composition.additives')}, 'NULL') = 'NULL' THEN [] WHEN {_T('$.chemical_composition.additives')} <> 'ARRAY' THEN ['''additives'' must be array or null']
      ELSE flatten(list_transform(range(json_array_length(entry_text, '$.chemical_composition.additives')::BIGINT), lambda i: list_transform(
        CASE WHEN json_type(json_extract(entry_text, '$.chemical_composition.additives[' || i || ']')) <> 'OBJECT' THEN ['additive entry is not a dict'] ELSE list_concat(
          CASE WHEN coalesce(json_type(json_extract(entry_text, '$.chemical_composition.additives[' || i || '].name')), '') <> 'VARCHAR' THEN ['additive missing valid ''name'' (string)'] ELSE [] END,
          CASE WHEN coalesce(json_type(json_extract(entry_text, '$.chemical_composition.additives[' || i || '].type')), '') <> 'VARCHAR' THEN ['additive missing valid ''type'' (string)'] ELSE [] END) END,
        lambda e: 'additives[' || i || ']: ' || e))) END,
    CASE WHEN NOT {_HAS('$.chemical_composition.is_homopolymer')} THEN ['chemical_composition missing ''is_homopolymer'''] WHEN {_T('$.chemical_composition.is_homopolymer')} <> 'BOOLEAN' THEN ['''is_homopolymer'' must be boolean'] ELSE [] END) END,
  {_field('$.processing_history', f'missing {_Q}processing_history{_Q} field', f'{_Q}processing_history{_Q} must be string or null')},
  {_field('$.hierarchical_structure', f'missing {_Q}hierarchical_structure{_Q} field', f'{_Q}hierarchical_structure{_Q} must be string or null')},
  CASE WHEN coalesce({_T('$.properties')}, '') <> 'OBJECT' THEN ['missing or invalid ''properties'' (must be dict)'] WHEN coalesce({_T('$.properties.price')}, '') <> 'OBJECT' THEN ['properties missing ''price'' (must be dict)'] ELSE list_concat(
    CASE WHEN coalesce({_T('$.properties.price.value')}, '') <> 'ARRAY' OR json_array_length(entry_text, '$.properties.price.value') = 0 THEN ['properties.price.value must be a non-empty array']
      ELSE list_filter(list_transform(range(json_array_length(entry_text, '$.properties.price.value')::BIGINT), lambda i: CASE WHEN json_type(json_extract(entry_text, '$.properties.price.value[' || i || ']')) IN ('VARCHAR', 'NULL', 'ARRAY', 'OBJECT') THEN 'properties.price.value[' || i || '] must be a number' END), lambda e: e IS NOT NULL) END,
    {_field('$.properties.price.unit', f'properties.price missing {_Q}unit{_Q}', 'properties.price.unit must be string or null')}) END) END AS errors FROM ent)"""


def _validated(spark, d):
    entries = entry_json(spark, d).select("row_idx", "filename", F.try_parse_json("entry_text").alias("entry"))
    return validate.validate(entries, "entry", "price")


@query(f"WITH {ERRORS} SELECT row_idx, len(errors)::INT AS n_errors, array_to_string(errors, '; ') AS errors FROM chk")
def validation_errors(spark, d):
    """Every broken rule of every entry, in rule order."""
    v = _validated(spark, d)
    return v.select("row_idx", F.size("errors").alias("n_errors"), F.array_join("errors", "; ").alias("errors"))


@query(f"WITH {ERRORS} SELECT filename, count(*) FILTER (len(errors) = 0) AS valid, count(*) FILTER (len(errors) > 0) AS invalid FROM chk GROUP BY filename")
def route_counts(spark, d):
    return validate.route_counts(_validated(spark, d), ["filename"])


@query(f"WITH {ERRORS} SELECT filename AS source_file, row_idx, len(errors)::INT AS n_errors FROM chk WHERE len(errors) > 0")
def error_rows(spark, d):
    """The error side of the routing, with its source file."""
    v = _validated(spark, d)
    _, errors = validate.route(v.withColumn("entry", F.struct("entry", "row_idx")))
    return errors.select("source_file", F.col("entry.row_idx").alias("row_idx"), F.size("errors").alias("n_errors"))


@query(
    f"""WITH {ERRORS} SELECT row_idx, json_extract_string(entry_text, '$.doi') AS doi, json_array_length(entry_text, '$.chemical_composition.monomers')::INT AS n_monomers,
 json_extract_string(entry_text, '$.chemical_composition.monomers[0].ratio_value') AS ratio, json_extract(entry_text, '$.properties.price.value[0]')::DOUBLE AS price FROM chk WHERE len(errors) = 0"""
)
def typed_records(spark, d):
    """Valid entries as typed record columns."""
    valid, _ = validate.route(_validated(spark, d))
    t = validate.typed(valid.select("row_idx", "entry"))
    return t.select("row_idx", "doi", F.size("chemical_composition.monomers").alias("n_monomers"), F.col("chemical_composition.monomers")[0]["ratio_value"].alias("ratio"), F.col("properties")["price"]["value"][0].alias("price"))


@query(
    f"""WITH {_PAIRS}, {ERRORS} SELECT (SELECT count(*) FROM st) AS files, (SELECT count(*) FROM st WHERE error) AS error, (SELECT count(*) FROM st WHERE NOT error AND final = 0) AS no_data,
 (SELECT count(*) FROM chk WHERE len(errors) = 0) AS valid, (SELECT count(*) FROM chk WHERE len(errors) > 0) AS invalid"""
)
def run_counters(spark, d):
    return mining.run_counters(_stages(spark, d), _validated(spark, d))


# ---- titles and progress


@query(f"WITH {MD} SELECT filename, CASE WHEN filename::INT % 3 = 0 THEN 'Title ' || filename END AS title FROM md")
def markdown_titles(spark, d):
    return mining.titles(markdown(spark, d))


@query(
    "SELECT doc_id::VARCHAR AS filename, quality, CASE WHEN doc_id % 3 = 0 AND doc_id IN (SELECT doc_id FROM documents) THEN 'Title ' || doc_id END AS title FROM labels"
)
def add_titles(spark, d):
    """Titles onto records (labels) by file name."""
    rec = table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("filename"), "quality")
    out = mining.add_titles(rec, mining.titles(markdown(spark, d)))
    return mining.insert_after(out, "title", "filename")


@query("SELECT quality, count(*) FILTER (doc_id % 3 = 0) AS with_title, count(*) FILTER (doc_id % 3 <> 0) AS without_title FROM labels GROUP BY quality")
def title_coverage(spark, d):
    return mining.title_coverage(add_titles(spark, d), ["quality"])


@query("SELECT o_orderkey AS key FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def pending_keys(spark, d):
    """Orders without a line item: work not done yet."""
    work = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"))
    return mining.pending(work, table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key")), "key")


@query("SELECT url, page_id FROM pages WHERE page_id NOT IN (SELECT doc_id FROM labels)")
def pending_rows(spark, d):
    """Pending by row index, and the switch that ignores progress."""
    work = table(spark, d, "pages").select("url", "page_id")
    done = table(spark, d, "labels").select(F.col("doc_id").alias("page_id"))
    left = mining.pending(work, done, "page_id")
    return left.join(mining.pending(work, done, "page_id", ignore_progress=True).select("page_id"), "page_id", "left_semi").select("url", "page_id")


@query("SELECT o_orderkey AS row_idx, 'random' AS mode FROM (SELECT o_orderkey FROM orders ORDER BY md5('5:' || o_orderkey) LIMIT 3) UNION ALL SELECT o_orderkey, 'first' FROM (SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 3)")
def sample_rows(spark, d):
    """Test mode: three random rows, or the first three."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("row_idx"))
    return mining.sample_rows(o, "row_idx", 5).withColumn("mode", F.lit("random")).unionByName(
        mining.sample_rows(o, "row_idx", 5, random=False).withColumn("mode", F.lit("first"))
    )


# ---- prompts


#: Numbers as a record file holds them, and as a prompt shows them; the other records show their size.
_NUMBERS = [("1e7", "10000000.0"), ("0.0005", "0.0005"), ("12345678.5", "12345678.5"), ("1e-5", "1e-05"), ("1.50", "1.5"), ("123456789012345678901234567890", "123456789012345678901234567890"), ("-2.5E+20", "-2.5e+20"), (None, None)]


def _prompt_records(spark, d):
    """Record JSON with analyses for prompt rendering; every fifth record lacks them, every seventh has a null history."""
    k = F.col("p_partkey")
    entry = F.concat(
        F.lit('{"chemical_composition":{"repeat_unit_psmiles":null,"monomers":[{"name":"'), F.col("p_name"), F.lit('","smiles":"C:C,\\"x","ratio_value":'),
        F.coalesce(F.element_at(F.array(*[F.lit(written) for written, _ in _NUMBERS]), (k % 8 + 1).cast("int")), F.col("p_size").cast("string")), F.lit(',"ratio_unit":"mol%"}],"is_homopolymer":'), F.when(k % 2 == 0, "true").otherwise("false"), F.lit('},"processing_history":'),
        F.when(k % 7 == 0, "null").otherwise(F.concat(F.lit('"'), F.col("p_brand"), F.lit(': a, \\"b\\" \\\\"'))), F.lit(',"hierarchical_structure":"h",'),
        F.when(k % 5 == 0, F.lit("")).otherwise(
            F.concat(
                F.lit('"analysis_with_hierarchical_structure":{"descriptive_text":"dw '), F.col("p_type"), F.lit('","reasoning_analysis":"rw"},'),
                F.lit('"analysis_without_hierarchical_structure":{"descriptive_text":"do","reasoning_analysis":"ro '), F.col("p_type"), F.lit('"},'),
            )
        ),
        F.lit('"properties":{"price":{"value":[1],"unit":'), F.when(k % 3 == 0, "null").otherwise('"EUR"'), F.lit("}}}"),
    )
    return widen(table(spark, d, "part")).select(k.alias("row_idx"), entry.alias("entry"))


_RATIO = "CASE p_partkey % 8 " + " ".join(f"WHEN {i} THEN '{shown}'" for i, (_, shown) in enumerate(_NUMBERS) if shown) + " ELSE p_size::VARCHAR END"
_CC = """'{"repeat_unit_psmiles": null, "monomers": [{"name": "' || p_name || '", "smiles": "C:C,\\"x", "ratio_value": ' || """ + _RATIO + """ || ', "ratio_unit": "mol%"}], "is_homopolymer": ' || CASE WHEN p_partkey % 2 = 0 THEN 'true' ELSE 'false' END || '}'"""
_PH = """CASE WHEN p_partkey % 7 = 0 THEN 'null' ELSE '"' || p_brand || ': a, \\"b\\" \\\\"' END"""
_U = "CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'EUR' END"
_AN = lambda good: f"CASE WHEN p_partkey % 5 = 0 THEN '' ELSE {good} END"
_DATA = lambda body: f"'Here is the data of a polymer, {{' || {body} || '}}, please predict price based on the data, in units of ' || {_U}"
_TYPES = {
    1: _DATA(f"""'"chemical_composition": ' || {_CC} || ', "processing_history": ' || {_PH} || ', "hierarchical_structure": "h"'"""),
    2: _DATA(f"""'"chemical_composition": ' || {_CC} || ', "processing_history": ' || {_PH}"""),
    3: f"""'Here is a description of a polymer: ' || {_AN("'dw ' || p_type")} || '. Please predict price based on the description, in units of ' || {_U}""",
    4: f"""'Here is a description of a polymer: ' || {_AN("'do'")} || '. Please predict price based on the description, in units of ' || {_U}""",
    5: f"""'Here is a reasoning analysis of a polymer: ' || {_AN("'rw'")} || '. Please predict price based on the analysis, in units of ' || {_U}""",
    6: f"""'Here is a reasoning analysis of a polymer: ' || {_AN("'ro ' || p_type")} || '. Please predict price based on the analysis, in units of ' || {_U}""",
    7: f"""'Here is a description and reasoning analysis of a polymer: ' || {_AN("'dw ' || p_type")} || ' ' || {_AN("'rw'")} || '. Please predict price based on the above content, in units of ' || {_U}""",
    8: f"""'Here is a description and reasoning analysis of a polymer: ' || {_AN("'do'")} || ' ' || {_AN("'ro ' || p_type")} || '. Please predict price based on the above content, in units of ' || {_U}""",
    9: _DATA(f"""'"chemical_composition": ' || {_CC}"""),
}
_STRUCT_SQL = _DATA(
    """'"chemical_composition": {"monomers": [{"smiles": "C:C,\\"x", "ratio_value": ' || """ + _RATIO + """ || ', "ratio_unit": "mol%"}], "is_homopolymer": ' || CASE WHEN p_partkey % 2 = 0 THEN 'true' ELSE 'false' END || '}'"""
)


@query("SELECT p_partkey AS row_idx, " + ", ".join(f"{sql} AS type{t}" for t, sql in _TYPES.items()) + f", {_STRUCT_SQL} AS type_struct FROM part")
def prompt_types(spark, d):
    """All nine prompt types and the structure prompt."""
    r = _prompt_records(spark, d).withColumn("prop", F.lit("price"))
    cols = [prompts.prompt("entry", "prop", t).alias(f"type{t}") for t in range(1, 10)]
    return r.select("row_idx", *cols, prompts.prompt("entry", "prop", prompts.STRUCT).alias("type_struct"))


@query(
    f"""WITH c AS (SELECT *, [1, 3, 9][(('0x' || substr(md5('11:4:' || p_partkey), 1, 13))::BIGINT % 3)::INT + 1] AS t FROM part)
SELECT p_partkey AS row_idx, CASE t WHEN 1 THEN {_TYPES[1]} WHEN 3 THEN {_TYPES[3]} ELSE {_TYPES[9]} END AS prompt FROM c"""
)
def random_prompts(spark, d):
    """One of three prompt types per record for seed 11, epoch 4."""
    r = _prompt_records(spark, d).withColumn("prop", F.lit("price"))
    return r.select("row_idx", prompts.random_prompt("entry", "prop", [1, 3, 9], 11, 4, F.col("row_idx")).alias("prompt"))


@query("SELECT p_brand, count(*) AS rows, count(*) FILTER (p_partkey % 5 = 0) AS without_input FROM part GROUP BY p_brand")
def missing_inputs(spark, d):
    r = _prompt_records(spark, d).join(table(spark, d, "part").select(F.col("p_partkey").alias("row_idx"), "p_brand"), "row_idx")
    return prompts.missing_input(r, "entry", 5, ["p_brand"])


_PAY1 = f"""'{{"chemical_composition": ' || {_CC} || ', "processing_history": ' || {_PH} || ', "hierarchical_structure": "h"}}'"""
_PAY2 = f"""'{{"chemical_composition": ' || {_CC} || ', "processing_history": ' || {_PH} || '}}'"""


@query(f"SELECT p_partkey AS row_idx, 'price <' || {_PAY1} || '>' AS with_structure, 'price <' || {_PAY2} || '>' AS without_structure FROM part")
def generation_prompts(spark, d):
    one, two = prompts.generation_payloads("entry")
    fill = lambda p: prompts.generation_prompt(F.lit("{TARGET_PROPERTY} <{INPUT_JSON_DATA}>"), F.lit("price"), p)
    return _prompt_records(spark, d).select("row_idx", fill(one).alias("with_structure"), fill(two).alias("without_structure"))


@query("SELECT doc_id, md5(CASE WHEN lang = 'en' THEN 'Extract Tg.' WHEN lang = 'fr' THEN 'Extraire Tm.' ELSE 'Other.' END || chr(10) || text) AS prompt FROM documents")
def extraction_prompts(spark, d):
    """Template of each article's property followed by its whole text."""
    docs = table(spark, d, "documents").withColumn("property", F.when(F.col("lang") == "en", "Tg").when(F.col("lang") == "fr", "Tm").otherwise("n"))
    templates = spark.createDataFrame([("Tg", "Extract Tg."), ("Tm", "Extraire Tm."), ("n", "Other.")], "property string, template string")
    return prompts.extraction_prompt(docs, templates).select("doc_id", F.md5("prompt").alias("prompt"))


@query("SELECT doc_id, md5('Check ' || 'Glass Transition Temperature (Tg)' || ' by R1: [{\"n\": ' || n_chars || '}] in ' || text) AS prompt FROM documents")
def review_prompts(spark, d):
    template = F.lit("Check {PROP_FULL_NAME} by {RULES}: {EXTRACTED_DATA} in {MD_TEXT}")
    data = F.concat(F.lit('[{"n": '), F.col("n_chars").cast("string"), F.lit("}]"))
    p = prompts.review_prompt(template, F.lit(prompts.PROPERTIES["Tg"][0]), F.lit("R1"), data, F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.md5(p).alias("prompt"))


@query("SELECT doc_id::VARCHAR AS filename, length(text)::BIGINT AS answer_length, 'Extract Tg.' AS asked FROM documents")
def model_map(spark, d):
    """Every article through a user's model (here a stub that measures the prompt); failures would come back empty."""
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("filename"), F.concat(F.lit("Extract Tg."), F.col("text")).alias("prompt"))

    def make_model():
        return lambda texts: [(str(len(t) - len("Extract Tg.")), t[: len("Extract Tg.")]) for t in texts]

    out = mining.map_model(docs, "prompt", ["filename"], make_model)
    return out.select("filename", F.col("content").cast("bigint").alias("answer_length"), F.col("reasoning").alias("asked"))


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, 'OBJECT' AS kind, NULL::VARCHAR AS missing_kind FROM events")
def variant_members(spark, d):
    """Members of raw JSON; a missing one has no kind."""
    e = table(spark, d, "events").select("event_id", F.try_parse_json("props").alias("v"))
    return e.select("event_id", F.try_variant_get("v", "$.k", "bigint").alias("k"), variants.kind(F.col("v")).alias("kind"), variants.kind(variants.child(F.col("v"), "z")).alias("missing_kind"))
