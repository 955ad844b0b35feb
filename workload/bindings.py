"""How the test tables stand in for records, predictions, tokens, texts and graphs. Whole tables, no subsets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from litprops.operators.spread import deal, widen
from workload.registry import table

# ---- records: an order is a record, its customer the article, its priority the dataset, its price the value


def part_of(c: str):
    return F.when(F.col(c) % 10 < 7, "train").when(F.col(c) % 10 == 7, "val").otherwise("test")


def records(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(
        F.col("o_orderkey").alias("row_idx"),
        F.col("o_custkey").alias("article_key"),
        F.col("o_orderpriority").alias("dataset"),
        F.col("o_totalprice").alias("y"),
        (F.col("o_totalprice") * (1 + ((F.col("o_orderkey") * 7) % 11 - 5) / 100.0)).alias("p"),
        part_of("o_orderkey").alias("part"),
        part_of("o_custkey").alias("article_part"),
    )


REC = """rec AS (
  SELECT o_orderkey AS row_idx, o_custkey AS article_key, o_orderpriority AS dataset, o_totalprice AS y,
         o_totalprice * (1 + ((o_orderkey * 7) % 11 - 5) / 100.0) AS p,
         CASE WHEN o_orderkey % 10 < 7 THEN 'train' WHEN o_orderkey % 10 = 7 THEN 'val' ELSE 'test' END AS part,
         CASE WHEN o_custkey % 10 < 7 THEN 'train' WHEN o_custkey % 10 = 7 THEN 'val' ELSE 'test' END AS article_part
  FROM orders)"""


def split(spark: SparkSession, d: str) -> DataFrame:
    """Random and article split of every dataset, as a long table."""
    both = F.explode(
        F.array(
            F.struct(F.lit("split_random").alias("split_name"), F.col("part").alias("part")),
            F.struct(F.lit("split_article").alias("split_name"), F.col("article_part").alias("part")),
        )
    )
    return records(spark, d).select("dataset", "row_idx", F.col("row_idx").alias("pos"), both.alias("s")).select(
        "dataset", "s.split_name", "s.part", "pos", "row_idx"
    )


SPLIT = REC + """, split AS (
  SELECT dataset, 'split_random' AS split_name, part, row_idx AS pos, row_idx FROM rec
  UNION ALL SELECT dataset, 'split_article', article_part, row_idx, row_idx FROM rec)"""


# ---- record JSON: every o_orderkey residue breaks another rule


def entry_json(spark: SparkSession, d: str) -> DataFrame:
    """``row_idx, filename, entry_text``: one JSON entry per order, most of them with some flaw."""
    k = F.col("o_orderkey")
    r = k % 19
    text = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    price = F.format_string("%.2f", F.col("o_totalprice"))

    def field(name, good, cases):
        out = None
        for residue, value in cases:
            v = F.lit("") if value is None else F.concat(F.lit(f'"{name}":'), F.lit(value), F.lit(","))
            out = F.when(r == residue, v) if out is None else out.when(r == residue, v)
        ok = F.concat(F.lit(f'"{name}":'), good, F.lit(","))
        return ok if out is None else out.otherwise(ok)

    monomers = F.concat(
        F.lit('[{"name":"m'), k.cast("string"), F.lit('","smiles":'), F.when(k % 2 == 0, "null").otherwise('"CC"'), F.lit(',"ratio_value":'),
        F.when(k % 3 == 0, '"97-99"').otherwise("50"), F.lit(',"ratio_unit":"mol%"}'),
        F.when(r == 6, ',{"name":5,"smiles":7,"ratio_value":1}').when(r == 7, ",3").otherwise(""), F.lit("]"),
    )
    cc = F.concat(
        F.lit('"chemical_composition":{'),
        field("repeat_unit_psmiles", F.lit('"[*]CC[*]"'), [(3, None), (4, "1")]),
        F.when(r == 5, '"monomers":{},').otherwise(F.concat(F.lit('"monomers":'), monomers, F.lit(","))),
        field("additives", F.lit("[]"), [(8, None), (9, "null"), (10, "3"), (11, '[{"name":"a","type":null},"x",{}]')]),
        F.when(r == 12, '"is_homopolymer":1').when(r == 13, '"z":1').otherwise('"is_homopolymer":false'),
        F.lit("},"),
    )
    prop = (
        F.when(r == 15, F.lit('"properties":{"other":{}}'))
        .when(r == 16, F.lit('"properties":{"price":{"value":[],"unit":3}}'))
        .when(r == 17, F.lit('"properties":{"price":{"value":[1,"2",null,true]}}'))
        .otherwise(F.concat(F.lit('"properties":{"price":{"value":['), price, F.lit('],"unit":'), F.when(k % 2 == 0, "null").otherwise('"USD"'), F.lit("}}")))
    )
    body = F.concat(
        F.lit("{"),
        field("doi", text(F.concat(F.lit("10.1/"), F.col("o_custkey").cast("string"))), [(0, None), (1, "5")]),
        field("year", F.year("o_orderdate").cast("string"), [(2, '"1999"'), (18, "true")]),
        F.when(r == 14, F.lit('"chemical_composition":[],')).otherwise(cc),
        F.lit('"processing_history":'), text(F.col("o_orderpriority")), F.lit(","),
        field("hierarchical_structure", F.lit("null"), [(0, None), (4, "[]")]),
        prop, F.lit("}"),
    )
    whole = F.when(k % 101 == 100, F.lit("[1]")).otherwise(body)
    return widen(table(spark, d, "orders")).select(k.alias("row_idx"), F.concat(F.lit("f"), F.col("o_custkey").cast("string")).alias("filename"), "o_orderpriority", whole.alias("entry_text"))


ENTRY = """src AS (SELECT *, o_orderkey % 19 AS r FROM orders),
ent AS (
  SELECT o_orderkey AS row_idx, 'f' || o_custkey AS filename, o_orderpriority,
   CASE WHEN o_orderkey % 101 = 100 THEN '[1]' ELSE '{'
   || CASE r WHEN 0 THEN '' WHEN 1 THEN '"doi":5,' ELSE '"doi":"10.1/' || o_custkey || '",' END
   || CASE r WHEN 2 THEN '"year":"1999",' WHEN 18 THEN '"year":true,' ELSE '"year":' || year(o_orderdate) || ',' END
   || CASE r WHEN 14 THEN '"chemical_composition":[],' ELSE '"chemical_composition":{'
      || CASE r WHEN 3 THEN '' WHEN 4 THEN '"repeat_unit_psmiles":1,' ELSE '"repeat_unit_psmiles":"[*]CC[*]",' END
      || CASE r WHEN 5 THEN '"monomers":{},' ELSE '"monomers":[{"name":"m' || o_orderkey || '","smiles":' || CASE WHEN o_orderkey % 2 = 0 THEN 'null' ELSE '"CC"' END
           || ',"ratio_value":' || CASE WHEN o_orderkey % 3 = 0 THEN '"97-99"' ELSE '50' END || ',"ratio_unit":"mol%"}'
           || CASE r WHEN 6 THEN ',{"name":5,"smiles":7,"ratio_value":1}' WHEN 7 THEN ',3' ELSE '' END || '],' END
      || CASE r WHEN 8 THEN '' WHEN 9 THEN '"additives":null,' WHEN 10 THEN '"additives":3,' WHEN 11 THEN '"additives":[{"name":"a","type":null},"x",{}],' ELSE '"additives":[],' END
      || CASE r WHEN 12 THEN '"is_homopolymer":1' WHEN 13 THEN '"z":1' ELSE '"is_homopolymer":false' END || '},' END
   || '"processing_history":"' || o_orderpriority || '",'
   || CASE r WHEN 0 THEN '' WHEN 4 THEN '"hierarchical_structure":[],' ELSE '"hierarchical_structure":null,' END
   || CASE r WHEN 15 THEN '"properties":{"other":{}}' WHEN 16 THEN '"properties":{"price":{"value":[],"unit":3}}'
        WHEN 17 THEN '"properties":{"price":{"value":[1,"2",null,true]}}'
        ELSE '"properties":{"price":{"value":[' || printf('%.2f', o_totalprice) || '],"unit":' || CASE WHEN o_orderkey % 2 = 0 THEN 'null' ELSE '"USD"' END || '}}' END
   || '}' END AS entry_text
  FROM src)"""


# ---- articles and responses


def markdown(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    head = F.when(k % 3 == 0, F.concat(F.lit("\n  # Title "), k.cast("string"), F.lit(" \n"))).when(k % 3 == 1, F.lit("## x\n")).otherwise(F.lit("#\n"))
    return table(spark, d, "documents").select(k.cast("string").alias("filename"), F.concat(head, F.col("text")).alias("text"), "lang", "source")


MD = """md AS (SELECT CAST(doc_id AS VARCHAR) AS filename, lang, source,
  CASE WHEN doc_id % 3 = 0 THEN chr(10) || '  # Title ' || doc_id || ' ' || chr(10) WHEN doc_id % 3 = 1 THEN '## x' || chr(10) ELSE '#' || chr(10) END || text AS text
  FROM documents)"""


# ---- tokens


def tokens(spark: SparkSession, d: str, size: int | None = None) -> DataFrame:
    """Token rows. Records are the ten labels, or runs of ``size`` vectors where an operator needs prompt-sized records."""
    e = table(spark, d, "embeddings")
    record = F.col("label").cast("bigint") if size is None else F.floor(F.col("vec_id") / size).cast("bigint")
    return e.select(
        F.lit("orders").alias("dataset"), F.when(F.col("vec_id") % 2 == 0, "a").otherwise("b").alias("model"), record.alias("row_idx"),
        F.col("vec_id").alias("pos"), F.col("embedding").alias("vec"), (F.col("vec_id") % 5 != 0).cast("int").alias("mask"),
    )


# ---- molecule graphs: bonds join consecutive line numbers of an order


def atoms(spark: SparkSession, d: str) -> DataFrame:
    line = table(spark, d, "lineitem")
    rows = line.select(F.col("l_orderkey").alias("mol_id"), F.when(F.col("l_linenumber") <= 4, 0).otherwise(1).alias("component"), F.col("l_linenumber").alias("atom"))
    return deal(rows, ["mol_id", "component"], line.count()).distinct()


def bonds(spark: SparkSession, d: str) -> DataFrame:
    """Bond between two neighbouring line numbers of one component, if both are there."""
    line = Window.partitionBy("mol_id", "component").orderBy("atom")
    return atoms(spark, d).withColumn("b", F.lead("atom").over(line)).filter("b = atom + 1").select("mol_id", "component", F.col("atom").alias("a"), "b")


GRAPH = """atoms AS (SELECT DISTINCT l_orderkey AS mol_id, CASE WHEN l_linenumber <= 4 THEN 0 ELSE 1 END AS component, l_linenumber AS atom FROM lineitem),
bonds AS (SELECT x.mol_id, x.component, x.atom AS lo, x.atom + 1 AS hi FROM atoms x JOIN atoms y ON x.mol_id = y.mol_id AND x.component = y.component AND y.atom = x.atom + 1),
alone AS (SELECT a.* FROM atoms a WHERE NOT EXISTS (SELECT 1 FROM bonds b WHERE b.mol_id = a.mol_id AND b.component = a.component AND (b.lo = a.atom OR b.hi = a.atom))),
nodes AS (
  SELECT mol_id, component, CAST(row_number() OVER (PARTITION BY mol_id, component ORDER BY kind, lo) - 1 AS INTEGER) AS node, lo, hi, role FROM (
    SELECT mol_id, component, 0 AS kind, lo, hi, 0 AS role FROM bonds UNION ALL SELECT mol_id, component, 1, atom, NULL, -1 FROM alone))"""
