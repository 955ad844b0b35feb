"""Monomer arrays, ratio vectors, features per distinct structure, and molecule graph tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from litprops.functions import arrays as A
from litprops.functions.text import parse_ratio
from litprops.operators import batches, composition, graph
from litprops.operators.spread import contiguous_index
from litprops.session import settle
from workload.bindings import GRAPH, atoms, bonds
from workload.registry import R, query, rnd, table

# ---- monomer arrays from parts: 0 to 3 monomers, blank SMILES, ranges, padded units

_FIELDS = "smiles", "ratio_value", "ratio_unit"


def _parts(spark, d):
    k = F.col("p_partkey")
    smiles = F.when(k % 6 == 5, "  ").otherwise(F.concat(F.lit(" "), F.col("p_name"), F.lit("\t")))
    size = F.col("p_size").cast("string")
    ratio = (
        F.when(k % 5 == 0, F.concat(size, F.lit("-"), (F.col("p_size") + 2).cast("string")))
        .when(k % 5 == 1, F.concat(F.lit("-"), size))
        .when(k % 5 == 2, F.concat(F.lit(" "), size, F.lit("e-1 ")))
        .when(k % 5 == 3, F.lit(None))
        .otherwise(size)
    )
    unit = F.when(k % 7 == 0, "").when(k % 7 == 1, F.lit(None)).otherwise(F.concat(F.lit(" "), F.col("p_type"), F.lit(" ")))
    first = F.struct(smiles.alias("smiles"), ratio.alias("ratio_value"), unit.alias("ratio_unit"))
    second = F.struct(F.col("p_brand").alias("smiles"), F.lit("3").alias("ratio_value"), F.lit("wt%").alias("ratio_unit"))
    third = F.struct(F.lit("C").alias("smiles"), F.lit(None).cast("string").alias("ratio_value"), F.lit("mol%").alias("ratio_unit"))
    monomers = F.slice(F.array(first, second, third), F.lit(1), (k % 4).cast("int"))
    return table(spark, d, "part").select(k.alias("row_idx"), monomers.alias("monomers"), (k % 11 == 0).alias("is_homopolymer"), "p_type", "p_brand", "p_name", "p_size")


_PARTS = """mono AS (
  SELECT p_partkey AS row_idx, p_partkey % 11 = 0 AS homo, p_partkey % 4 AS n, p_name, p_brand, p_type, p_size,
   CASE WHEN p_partkey % 6 = 5 THEN NULL ELSE p_name END AS s1,
   CASE p_partkey % 5 WHEN 0 THEN p_size + 1.0 WHEN 1 THEN -p_size WHEN 2 THEN p_size / 10.0 WHEN 3 THEN NULL ELSE p_size END::DOUBLE AS v1,
   CASE p_partkey % 7 WHEN 0 THEN NULL WHEN 1 THEN NULL ELSE p_type END AS u1 FROM part),
vocab AS (SELECT unit, (row_number() OVER (ORDER BY unit) - 1)::INT AS idx FROM (SELECT DISTINCT u1 AS unit FROM mono WHERE u1 IS NOT NULL AND n >= 1 UNION SELECT 'wt%' FROM mono WHERE n >= 2 UNION SELECT 'mol%'))"""


def _vocabulary(spark, d):
    units = _parts(spark, d).select(F.explode("monomers").alias("m")).select("m.ratio_unit")
    return composition.unit_vocabulary(units, "ratio_unit")


@query(
    """SELECT p_partkey AS row_idx, (round(CASE p_partkey % 5 WHEN 0 THEN p_size + 1.0 WHEN 1 THEN -p_size WHEN 2 THEN p_size / 10.0 WHEN 3 THEN -(p_size + 0.5) ELSE p_size END::DOUBLE, 4) + 0) AS value,
 CASE p_partkey % 5 WHEN 3 THEN NULL WHEN 4 THEN NULL ELSE TRUE END AS text_is_bad FROM part"""
)
def ratio_parse(spark, d):
    """Numbers, ranges, negative ranges, exponents; text that is no number gives NULL."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    bigger = (F.col("p_size") + 2).cast("string")
    text = (
        F.when(k % 5 == 0, F.concat(size, F.lit("-"), bigger))
        .when(k % 5 == 1, F.concat(F.lit("-"), size))
        .when(k % 5 == 2, F.concat(size, F.lit("e-1")))
        .when(k % 5 == 3, F.concat(F.lit("-"), size, F.lit("--"), (F.col("p_size") + 1).cast("string")))
        .otherwise(size)
    )
    bad = F.when(k % 5 <= 2, F.element_at(F.array(F.lit("1d"), F.lit("a-b"), F.lit("5 %")), (k % 5 + 1).cast("int"))).otherwise(size)
    return table(spark, d, "part").select(
        k.alias("row_idx"), (F.round(parse_ratio(text), 4) + F.lit(0.0)).alias("value"), F.when(parse_ratio(bad).isNull(), True).alias("text_is_bad")
    )


@query(f"WITH {_PARTS} SELECT unit, idx FROM vocab")
def unit_vocabulary(spark, d):
    """Distinct units of all monomers plus mol%, in code-point order."""
    return _vocabulary(spark, d)


@query(
    f"""WITH {_PARTS}, m AS (SELECT row_idx, 0 AS pos, homo, v1 AS v, u1 AS u FROM mono WHERE n >= 1 UNION ALL SELECT row_idx, 1, homo, 3.0, 'wt%' FROM mono WHERE n >= 2 UNION ALL SELECT row_idx, 2, homo, NULL, 'mol%' FROM mono WHERE n >= 3),
e AS (SELECT row_idx, pos, CASE WHEN homo THEN 100.0 ELSE coalesce(v, 0) END AS value, CASE WHEN homo OR v IS NOT NULL THEN 1.0 ELSE 0.0 END AS has, CASE WHEN homo THEN 'mol%' ELSE u END AS u FROM m),
l AS (SELECT row_idx, pos, 0 AS dim, value FROM e UNION ALL SELECT row_idx, pos, 1, has FROM e UNION ALL SELECT row_idx, pos, 2 + idx, 1.0 FROM e JOIN vocab ON unit = u)
SELECT row_idx, pos, dim, (round(value, 4) + 0)::DOUBLE AS value FROM l WHERE dim < 2 OR value <> 0"""
)
def ratio_vectors(spark, d):
    """``[value, has_value] + one-hot unit`` of every monomer, in long form (zero unit places left out)."""
    units = settle(_vocabulary(spark, d), "units")
    m = _parts(spark, d).select("row_idx", "is_homopolymer", F.posexplode("monomers").alias("pos", "m"))
    m = composition.attach_unit_index(m, units, F.col("m.ratio_unit"), F.col("is_homopolymer"))
    vec = composition.indexed_ratio_vector(F.col("m.ratio_value"), F.col("unit_idx"), F.col("is_homopolymer"), units.count())
    long = m.select("row_idx", "pos", F.posexplode(vec).alias("dim", "value"))
    return long.filter("dim < 2 OR value <> 0").withColumn("value", F.round("value", 4) + F.lit(0.0))


@query(
    f"""WITH {_PARTS} SELECT row_idx, CASE n WHEN 0 THEN NULL ELSE s1 END AS slot1, CASE n WHEN 0 THEN NULL WHEN 1 THEN s1 ELSE p_brand END AS slot2,
 CASE WHEN homo OR n = 0 OR (n = 1 AND s1 IS NULL) OR (n >= 2 AND s1 IS NULL) THEN 0 ELSE 1 END AS global_type,
 (CASE WHEN n >= 1 AND s1 IS NOT NULL THEN 1 ELSE 0 END + greatest(n - 1, 0))::INT AS real_monomers,
 CASE WHEN n >= 1 AND s1 LIKE 'red%' THEN s1 ELSE 'C' END AS drawn1 FROM mono"""
)
def component_slots(spark, d):
    """Two slots per record, the global type, the number of real monomers, and the structure drawn in slot 1 (placeholder C when
    the structure is not among the valid ones)."""
    p = _parts(spark, d).withColumn("slots", composition.component_slots(F.col("monomers")))
    valid = F.filter(F.transform(F.col("slots"), lambda s: s["smiles"]), lambda s: s.startswith("red"))
    return p.select(
        "row_idx", F.col("slots")[0]["smiles"].alias("slot1"), F.col("slots")[1]["smiles"].alias("slot2"),
        composition.type_flag(F.col("slots"), F.col("is_homopolymer")).alias("global_type"),
        F.size(composition.real_monomers(F.col("monomers"))).alias("real_monomers"),
        composition.graph_smiles(F.col("slots"), valid)[0].alias("drawn1"),
    )


_SMILES = f"""{_PARTS}, smi AS (SELECT DISTINCT smiles FROM (SELECT s1 AS smiles FROM mono WHERE n >= 1 AND s1 IS NOT NULL UNION ALL SELECT p_brand FROM mono WHERE n >= 2 UNION ALL SELECT 'C' FROM mono WHERE n >= 3))"""


@query(f"WITH {_SMILES} SELECT count(*) AS distinct_smiles, count(*) FILTER (length(smiles) > 3) AS valid, count(*) FILTER (length(smiles) <= 3) AS invalid FROM smi")
def smiles_counts(spark, d):
    return composition.smiles_counts(_parts(spark, d), F.length("smiles") > 3)


@query(
    f"""WITH {_PARTS}, sl AS (SELECT row_idx, unnest([0, 1])::INT AS slot, unnest([CASE WHEN n >= 1 THEN s1 END, CASE n WHEN 0 THEN NULL WHEN 1 THEN s1 ELSE p_brand END]) AS smiles FROM mono),
f AS (SELECT *, CASE WHEN length(smiles) > 3 THEN repeat(smiles, units) END AS chain FROM sl, (SELECT unnest([3, 6, 9])::INT AS units))
SELECT row_idx, slot, units, coalesce(length(chain), 0)::DOUBLE AS f0, coalesce(length(chain) - length(replace(chain, 'r', '')), 0)::DOUBLE AS f1 FROM f"""
)
def distinct_structure_features(spark, d):
    """Features of both slots at all chain lengths. They are computed once per distinct chain by a user's function; none gives zeros."""
    p = settle(_parts(spark, d).select("row_idx", "monomers"), "parts")

    def compute(chains):
        def run(frames):
            for f in frames:
                yield f.assign(vec=[[float(len(c)), float(c.count("r"))] for c in f["chain"]])

        return chains.mapInPandas(run, "chain string, vec array<double>")

    valid = composition.distinct_smiles(p).filter(F.length("smiles") > 3)
    made = settle(composition.multimer_features(valid, lambda smiles, units: F.repeat(smiles, units), compute), "features")
    rows = p.select("row_idx", composition.component_slots(F.col("monomers")).alias("slots"))
    out = composition.attach_slot_features(rows, made, ["row_idx"], 2)
    out = out.select("row_idx", "slot", F.explode(F.arrays_zip(F.array(*map(F.lit, (3, 6, 9))).alias("units"), F.col("by_units").alias("vec"))).alias("x"))
    return out.select("row_idx", "slot", "x.units", F.col("x.vec")[0].alias("f0"), F.col("x.vec")[1].alias("f1"))


@query(
    """SELECT p_partkey AS row_idx, (p_brand = 'Brand#1')::INT AS b1, (p_brand = 'Brand#2')::INT AS b2, (p_brand NOT IN ('Brand#1', 'Brand#2'))::INT AS other, 6 AS width, p_size::DOUBLE AS last FROM part"""
)
def one_hot_features(spark, d):
    """One-hot with an unknown flag, joined with another one-hot and a number to a checked width."""
    brand = A.one_hot(F.col("p_brand"), ["Brand#1", "Brand#2"], unknown=True)
    kind = A.one_hot(F.col("p_type"), ["SMALL", "LARGE"])
    all_ = A.concat_features([A.doubles(brand), A.doubles(kind), F.array(F.col("p_size").cast("double"))], 6)
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("row_idx"), brand[0].alias("b1"), brand[1].alias("b2"), brand[2].alias("other"), F.size(all_).alias("width"), all_[5].alias("last")
    )


@query(
    """WITH r AS (SELECT vec_id, unnest(range(len(embedding))) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings),
v AS (SELECT vec_id, dim, CASE (vec_id + dim) % 5 WHEN 0 THEN 'NaN'::DOUBLE WHEN 1 THEN 'Infinity'::DOUBLE WHEN 2 THEN x * 50 WHEN 3 THEN -1e300 ELSE x END AS v FROM r)
SELECT vec_id, dim, (round(CASE WHEN isnan(v) THEN 0 ELSE greatest(-1, least(1, v)) END, 4) + 0)::DOUBLE AS value FROM v"""
)
def clean_descriptors(spark, d):
    """Whole vectors in which four of five coordinates were spoilt."""
    flaw = lambda x, i: (F.col("vec_id") + i) % 5
    spoilt = lambda x, i: F.when(flaw(x, i) == 0, F.lit(float("nan"))).when(flaw(x, i) == 1, F.lit(float("inf"))).when(flaw(x, i) == 2, x * 50).when(flaw(x, i) == 3, F.lit(-1e300)).otherwise(x)
    raw = F.transform(F.col("embedding").cast("array<double>"), spoilt)
    return table(spark, d, "embeddings").select("vec_id", F.posexplode(A.clean_descriptors(raw, 1.0)).alias("dim", "v")).select(
        "vec_id", F.col("dim").cast("bigint").alias("dim"), (F.round("v", 4) + F.lit(0.0)).alias("value")
    )


@query(
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS k FROM part),
o AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN k = 0 THEN 0 ELSE 1 END, md5('9:' || p_brand || ':' || k), k) AS rn FROM r) SELECT p_brand, k, p_partkey FROM o WHERE rn <= 10"""
)
def keep_base_and_random(spark, d):
    """Per brand the first structure and up to nine random others."""
    part = table(spark, d, "part").select("p_brand", "p_partkey")
    numbered = contiguous_index(part, "p_partkey", "k", ["p_brand"])
    return batches.keep_base_and_random(numbered, ["p_brand"], "k", 9, 10).select("p_brand", "k", "p_partkey")


# ---- vocabulary


@query(
    """WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey % 104 AS a, l_suppkey % 104 AS b, (l_linenumber - 1) AS bond FROM lineitem)
SELECT l_orderkey, l_linenumber, a, b, CASE WHEN a > 101 OR b > 101 OR bond > 4 THEN 26367 ELSE 5 * (least(a, b) * 102 - (least(a, b) * (least(a, b) - 1)) // 2) + bond * (102 - least(a, b)) + abs(a - b) END::BIGINT AS triplet FROM t"""
)
def triplet_vocabulary(spark, d):
    """Number of an (atom, bond, atom) triplet in closed form; anything outside the vocabulary gets its size."""
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_partkey") % 104).alias("a"), (F.col("l_suppkey") % 104).alias("b"),
        graph.triplet_id(F.col("l_partkey") % 104, F.col("l_suppkey") % 104, F.col("l_linenumber") - 1).alias("triplet"),
    )


@query(f"SELECT l_orderkey, {R('count(l_quantity) / exp(avg(ln(l_quantity)))')} AS statistic FROM lineitem GROUP BY l_orderkey")
def geometric_statistic(spark, d):
    return graph.geometric_statistic(table(spark, d, "lineitem"), ["l_orderkey"], "l_quantity").withColumn("statistic", rnd("statistic"))


# ---- graphs


def _nodes(spark, d):
    return graph.triplet_nodes(atoms(spark, d), bonds(spark, d))


def _placed(spark, d, n_local=3):
    """Numbered and placed nodes, written once because every graph step reads them."""
    return graph.build_nodes(atoms(spark, d), bonds(spark, d), n_local)


@query(f"WITH {GRAPH} SELECT * FROM nodes")
def triplet_nodes(spark, d):
    return _nodes(spark, d)


_LINE = """line AS (SELECT x.mol_id, x.component, x.node AS src, y.node AS dst FROM nodes x JOIN nodes y ON x.mol_id = y.mol_id AND x.component = y.component AND x.role = 0 AND y.role = 0 AND x.node <> y.node
  AND (x.lo IN (y.lo, y.hi) OR x.hi IN (y.lo, y.hi)))"""


@query(f"WITH {GRAPH}, {_LINE} SELECT * FROM line")
def line_graph_edges(spark, d):
    return graph.line_edges(settle(_nodes(spark, d), "nodes"))


# In a chain the path from atom i to atom j (i < j) runs over all bonds between them.
_PATH = """reach AS (SELECT a.mol_id, a.component, a.lo AS i, b.hi AS j, a.node AS n1, b.node AS n2 FROM nodes a JOIN nodes b ON a.mol_id = b.mol_id AND a.component = b.component AND a.role = 0 AND b.role = 0 AND b.lo >= a.lo
  AND (SELECT count(*) FROM nodes c WHERE c.mol_id = a.mol_id AND c.component = a.component AND c.role = 0 AND c.lo BETWEEN a.lo AND b.lo) = b.lo - a.lo + 1),
hop AS (SELECT mol_id, component, n1 AS src, n2 AS dst, list_concat(range(n1, n2), []) AS fwd FROM reach WHERE j - i BETWEEN 3 AND 5 UNION ALL SELECT mol_id, component, n2, n1, range(n2, n1, -1) FROM reach WHERE j - i BETWEEN 3 AND 5),
pth AS (SELECT mol_id, component, src, dst, list_concat(list_concat(fwd, list_resize([]::BIGINT[], (4 - len(fwd))::BIGINT, -1000000)), [dst::BIGINT]) AS path FROM hop)"""


@query(f"WITH {GRAPH}, {_PATH} SELECT mol_id, component, src, dst, array_to_string(path, ',') AS path FROM pth")
def path_edges(spark, d):
    """Shortest bond paths over more than three atoms, padded."""
    p = graph.path_edges(_placed(spark, d), 5)
    return p.withColumn("path", F.array_join(F.col("path").cast("array<string>"), ","))


def _sizes(n_local: int) -> str:
    return f"""sz AS (SELECT mol_id, component, count(*)::INT AS base, (count(*) + {n_local})::INT AS total FROM nodes GROUP BY ALL),
off AS (SELECT *, coalesce(sum(total) OVER (PARTITION BY mol_id ORDER BY component ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS node_offset, ((row_number() OVER (PARTITION BY mol_id ORDER BY component) - 1) * {n_local})::INT AS first_label FROM sz)"""


_SIZES = _sizes(3)


@query(f"WITH {GRAPH}, {_SIZES} SELECT * FROM off")
def component_offsets(spark, d):
    return graph.component_sizes(_nodes(spark, d)).select("mol_id", "component", "base", "total", "node_offset", "first_label")


@query(f"WITH {GRAPH}, {_SIZES} SELECT mol_id, component, node_offset AS first_node, base AS n_nodes FROM off")
def prompt_slots(spark, d):
    """Where each component's prompt block starts."""
    return graph.prompt_slots(graph.component_sizes(_nodes(spark, d)))


def _local(n_local: int) -> str:
    return f"""loc AS (SELECT n.mol_id, n.component, o.base + j AS v, n.node, first_label + j + 1 AS label FROM nodes n JOIN off o USING (mol_id, component), (SELECT unnest(range({n_local})) AS j)),
local AS (SELECT mol_id, component, v::INT AS src, node AS dst, label::INT AS label FROM loc UNION ALL SELECT mol_id, component, node, v::INT, label::INT FROM loc)"""


_LOCAL = _local(3)


@query(f"WITH {GRAPH}, {_SIZES}, {_LOCAL} SELECT * FROM local")
def local_virtual_edges(spark, d):
    return graph.local_edges(_placed(spark, d)).drop("node_offset")


def _all(n_local: int, n_global: int) -> str:
    return f"""{GRAPH}, {_LINE}, {_PATH}, {_sizes(n_local)}, {_local(n_local)},
ends AS (SELECT mol_id, sum(total)::INT AS first_global, (count(*) * {n_local} + 1)::INT AS glabel FROM sz GROUP BY mol_id),
globe AS (SELECT mol_id, first_global AS src, node + node_offset AS dst, glabel AS label FROM nodes JOIN off USING (mol_id, component) JOIN ends USING (mol_id) WHERE {n_global} = 1),
edge AS (
  SELECT mol_id, 'line' AS kind, src + node_offset AS src, dst + node_offset AS dst, 0 AS label, [src + node_offset, -1000000, -1000000, -1000000, dst + node_offset]::BIGINT[] AS path FROM line JOIN off USING (mol_id, component)
  UNION ALL SELECT mol_id, 'path', src + node_offset, dst + node_offset, 0, list_transform(path, lambda p: CASE WHEN p >= 0 THEN p + node_offset ELSE p END) FROM pth JOIN off USING (mol_id, component)
  UNION ALL SELECT mol_id, 'local', src + node_offset, dst + node_offset, label, [src + node_offset, -1000000, -1000000, -1000000, dst + node_offset] FROM local JOIN off USING (mol_id, component)
  UNION ALL SELECT mol_id, 'self', s + node_offset, s + node_offset, 0, [s + node_offset, -1000000, -1000000, -1000000, s + node_offset] FROM (SELECT mol_id, component, node_offset, unnest(range(total)) AS s FROM off)
  UNION ALL SELECT mol_id, 'global', src, dst, label, [src, -1000000, -1000000, -1000000, dst] FROM globe
  UNION ALL SELECT mol_id, 'global', dst, src, label, [dst, -1000000, -1000000, -1000000, src] FROM globe)"""


_ALL = _all(3, 1)
_EDGES = "SELECT mol_id, kind, src::BIGINT AS src, dst::BIGINT AS dst, label, array_to_string(path, ',') AS path FROM edge"


def _shown(e):
    return e.select("mol_id", "kind", F.col("src").cast("bigint").alias("src"), F.col("dst").cast("bigint").alias("dst"), "label", F.array_join(F.col("path").cast("array<string>"), ",").alias("path"))


@query(f"WITH {_ALL} {_EDGES}")
def graph_edges(spark, d):
    """All edges of every molecule in one numbering: line, path, local, self and global."""
    return _shown(graph.graph_edges(_placed(spark, d)))


@query(f"WITH {_all(2, 0)} {_EDGES}")
def prompt_graph_edges(spark, d):
    """Edges of the map-back graph: two local virtual nodes per component, none global."""
    return _shown(graph.prompt_graph(_placed(spark, d, 2))[1])


_GNODES = f"""{GRAPH}, {_SIZES}, gn AS (SELECT mol_id, component, node + node_offset AS node, role, CASE WHEN role = 0 THEN node ELSE -1 END AS bid FROM nodes JOIN off USING (mol_id, component)
  UNION ALL SELECT mol_id, component, base + j + node_offset, first_label + j + 1, -1 FROM off, (SELECT unnest([0, 1, 2]) AS j)
  UNION ALL SELECT mol_id, -1, sum(total)::INT, (count(*) * 3 + 1)::INT, -1 FROM sz GROUP BY mol_id)"""


@query(f"WITH {_GNODES} SELECT mol_id, component, node::BIGINT AS node, role::INT AS role, bid::INT AS bid FROM gn")
def graph_nodes(spark, d):
    n = graph.graph_nodes(_placed(spark, d))
    return n.select("mol_id", "component", F.col("node").cast("bigint").alias("node"), F.col("role").cast("int").alias("role"), F.col("bid").cast("int").alias("bid"))


@query(f"WITH {GRAPH} SELECT mol_id, count(*) AS nodes, count(*) FILTER (bid >= 0) AS bonds, sum(bid)::BIGINT AS bids FROM (SELECT mol_id, CASE WHEN role = 0 THEN node ELSE -1 END AS bid FROM nodes UNION ALL SELECT DISTINCT mol_id, -1 - component * 0 FROM (SELECT mol_id, component FROM nodes) WHERE FALSE UNION ALL SELECT mol_id, -1 FROM (SELECT DISTINCT mol_id, component FROM nodes), (SELECT unnest([0, 1]))) GROUP BY mol_id")
def prompt_graph_nodes(spark, d):
    """The map-back graph: two local virtual nodes per component, none global, bonds carry their number."""
    n, _ = graph.prompt_graph(_placed(spark, d, 2))
    return n.groupBy("mol_id").agg(F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("bid") >= 0).alias("bonds"), F.sum("bid").cast("bigint").alias("bids"))


def _node_vectors(n):
    """Two-wide vectors for nodes, from numbers the tables hold."""
    return n.withColumn("vec", F.array((F.col("node") * 1.0), (F.col("mol_id") % 7) * 1.0))


def _numbered(spark, d):
    """Nodes in molecule numbering (both components), written once."""
    p = _placed(spark, d)
    return p.withColumn("node", (F.col("node") + F.col("node_offset")).cast("int"))


@query(
    f"""WITH {_GNODES}, b AS (SELECT mol_id * 2 + component AS mol_id, bid FROM gn WHERE bid >= 0), m AS (SELECT mol_id * 2 + component AS mol_id, bid, node FROM gn WHERE bid >= 0 AND bid % 2 = 0)
SELECT mol_id, bid::INT AS bid, node::DOUBLE AS v0, CASE WHEN node IS NOT NULL THEN (mol_id % 7)::DOUBLE END AS v1 FROM b LEFT JOIN m USING (mol_id, bid)"""
)
def map_back(spark, d):
    """Vectors of an augmented graph (here one that made every other bond) back onto base bonds; every component is a structure."""
    n = graph.graph_nodes(_placed(spark, d), n_global=0).withColumn("mol_id", F.col("mol_id") * 2 + F.col("component"))
    made = _node_vectors(n).filter("bid % 2 = 0 OR bid < 0")
    out = graph.map_back(n, made)
    return out.select("mol_id", F.col("bid").cast("int").alias("bid"), F.col("vec")[0].alias("v0"), F.col("vec")[1].alias("v1"))


@query(
    f"""WITH {GRAPH}, c AS (SELECT mol_id, count(*) AS n FROM nodes GROUP BY mol_id) SELECT mol_id, mol_id // 64 AS batch_id, n,
 coalesce(sum(n) OVER (PARTITION BY mol_id // 64 ORDER BY mol_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM c"""
)
def batch_offsets(spark, d):
    sizes = _nodes(spark, d).groupBy("mol_id").agg(F.count(F.lit(1)).alias("n")).withColumn("batch_id", F.floor(F.col("mol_id") / 64))
    return graph.batch_offsets(sizes, "batch_id", "mol_id", "n").select("mol_id", "batch_id", "n", "offset")


@query(
    f"""WITH {GRAPH}, {_LINE}, c AS (SELECT mol_id, count(*) AS n FROM nodes GROUP BY mol_id),
o AS (SELECT mol_id, coalesce(sum(n) OVER (PARTITION BY mol_id // 64 ORDER BY mol_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS f FROM c)
SELECT mol_id, component, src, dst, (src + f)::BIGINT AS first, (f - 1000000)::BIGINT AS pad FROM line JOIN o USING (mol_id)"""
)
def shifted_paths(spark, d):
    """Path positions moved by the molecule's offset in its batch."""
    n = _placed(spark, d)
    sizes = n.groupBy("mol_id").agg(F.count(F.lit(1)).alias("n")).withColumn("batch_id", F.floor(F.col("mol_id") / 64))
    line = graph.line_edges(n).withColumn("path", F.array(F.col("src"), F.lit(graph.PAD), F.col("dst")))
    out = graph.shift_paths(line, graph.batch_offsets(sizes, "batch_id", "mol_id", "n"), "mol_id")
    return out.select("mol_id", "component", "src", "dst", F.col("path")[0].alias("first"), F.col("path")[1].alias("pad"))


_SCORED = f"""{GRAPH}, {_LINE}, {_SIZES}, se AS (SELECT mol_id, src + node_offset AS src, dst + node_offset AS dst, ((src + node_offset) * 7 + (dst + node_offset) * 3 + mol_id) % 11 / 4.0 AS score FROM line JOIN off USING (mol_id, component))"""


def _scored_edges(nodes):
    return graph.line_edges(nodes).withColumn("score", ((F.col("src") * 7 + F.col("dst") * 3 + F.col("mol_id")) % 11) / 4.0)


@query(
    f"""WITH {_SCORED}, m AS (SELECT *, exp(score - max(score) OVER (PARTITION BY mol_id, dst)) AS e FROM se) SELECT mol_id, src, dst, {R('e / (sum(e) OVER (PARTITION BY mol_id, dst) + 1e-9)')} AS alpha FROM m"""
)
def edge_softmax(spark, d):
    return graph.edge_softmax(_scored_edges(_numbered(spark, d))).select("mol_id", "src", "dst", rnd("alpha").alias("alpha"))


@query(f"WITH {_SCORED} SELECT mol_id, dst, {R('sum(score * src)')} AS m0, {R('sum(score * (mol_id % 7))')} AS m1 FROM se GROUP BY mol_id, dst")
def neighbour_sum(spark, d):
    """One message-passing step with given weights."""
    n = _numbered(spark, d)
    out = graph.neighbour_sum(_scored_edges(n).withColumnRenamed("score", "weight"), _node_vectors(n))
    return out.select("mol_id", "dst", rnd(F.col("message")[0]).alias("m0"), rnd(F.col("message")[1]).alias("m1"))


@query(
    f"""WITH {GRAPH}, {_PATH}, {_SIZES}, p AS (SELECT mol_id, src + node_offset AS src, dst + node_offset AS dst, list_transform(list_filter(path, lambda x: x >= 0), lambda x: x + node_offset) AS q FROM pth JOIN off USING (mol_id, component)) SELECT mol_id, src, dst, len(q)::BIGINT AS path_len, {R('list_avg(q)')} AS v0, {R('(mol_id % 7)::DOUBLE')} AS v1 FROM p"""
)
def path_vectors(spark, d):
    """Length of each padded path and mean of the node vectors on it."""
    n = _numbered(spark, d)
    out = graph.path_vectors(settle(graph.path_edges(n, 5), "paths"), _node_vectors(n), ["src", "dst"])
    return out.select("mol_id", "src", "dst", "path_len", rnd(F.col("path_vec")[0]).alias("v0"), rnd(F.col("path_vec")[1]).alias("v1"))


@query(
    f"""WITH {_GNODES}, r AS (SELECT mol_id, avg(node) FILTER (role = 0) AS body, max(node) FILTER (role = 1) AS r1, max(node) FILTER (role = 2) AS r2, max(node) FILTER (role = 3) AS r3, max(node) FILTER (role = 4) AS r4, max(node) FILTER (role = 5) AS r5, max(node) FILTER (role = 6) AS r6, max(node) FILTER (role = 7) AS r7 FROM gn GROUP BY mol_id)
SELECT mol_id, CASE WHEN r7 IS NULL THEN r1 ELSE (r1 + r4) / 2.0 END AS f0, CASE WHEN r7 IS NULL THEN r2 ELSE (r2 + r5) / 2.0 END AS f1, CASE WHEN r7 IS NULL THEN r3 ELSE (r3 + r6) / 2.0 END AS f2, coalesce(r7, r4)::DOUBLE AS f3, {R('coalesce(body, 0)')} AS f4 FROM r"""
)
def graph_readout(spark, d):
    """Graph vectors: slot averages (one component counts twice), global node, mean of real nodes."""
    out = graph.readout(graph.graph_nodes(_placed(spark, d)).withColumn("vec", F.array(F.col("node") * 1.0)))
    return out.select("mol_id", *[(rnd(F.col("graph_vec")[i]) if i == 4 else F.col("graph_vec")[i]).alias(f"f{i}") for i in range(5)])
