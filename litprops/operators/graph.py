"""Molecule graphs as node and edge tables, built from atoms and bonds.

Inputs: ``atoms(mol_id, component, atom)`` and ``bonds(mol_id, component, a, b)``, components numbered 0, 1, .... A node is a bond
(role 0) or an isolated atom (role -1); virtual nodes have roles 1, 2, ....
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litprops.functions import arrays as A
from litprops.operators.spread import HEAVY_ROWS, contiguous_index, deal, heavy_keys, lookup_join
from litprops.operators.vectors import vector_sum
from litprops.session import settle

PAD = -1_000_000  # fixed value: path position without a node
ATOM_TYPES, BOND_TYPES = 102, 5  # fixed values: vocabulary size
_NONE = 999  # fixed value: vocabulary key of "no atom / no bond"
_PART = ["mol_id", "component"]
_PATH_COLUMNS = [*_PART, "src", "dst", "path", "via"]
_PATH_TYPES = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32())]
MOST_BONDS = 100_000  # bonds of a component that one row may hold (about 3 MB)
_CHUNK = 65_536  # atoms per numbering chunk of one component


def triplet_id(atom1: Column, atom2: Column, bond: Column, n_atoms: int = ATOM_TYPES, n_bonds: int = BOND_TYPES) -> Column:
    """Vocabulary number of (atom, bond, atom), atoms in either order; closed form, unknown triplets get the vocabulary size."""
    lo, hi = F.least(atom1, atom2).cast("bigint"), F.greatest(atom1, atom2).cast("bigint")
    pairs = F.lit(n_bonds * n_atoms * (n_atoms + 1) // 2)
    unknown = pairs + n_atoms
    known_lo = lo.between(0, n_atoms - 1)
    before = F.lit(n_bonds) * (lo * n_atoms - F.floor(lo * (lo - 1) / 2))
    return (
        F.when(known_lo & hi.between(0, n_atoms - 1) & bond.between(0, n_bonds - 1), before + bond * (F.lit(n_atoms) - lo) + (hi - lo))
        .when(known_lo & (hi == _NONE) & (bond == _NONE), pairs + lo)
        .otherwise(unknown)
        .cast("bigint")
    )


def triplet_nodes(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """``(mol_id, component, node, lo, hi, role)``: bonds by their sorted ends, then isolated atoms, numbered from 0.

    One sort per component numbers its nodes; the rows of a molecule meet in one task, where :func:`component_sizes` wants them too. Should a component be heavy, numbering becomes a prefix sum over chunks of atoms.
    """
    sizes = atoms.select(*_PART).unionByName(bonds.select(*_PART)).groupBy(*_PART).agg(F.count(F.lit(1)).alias("_n"))
    most, rows = (x or 0 for x in sizes.agg(F.max("_n"), F.sum("_n")).first())
    ends = bonds.select(*_PART, F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct()
    touched = ends.select(*_PART, F.explode(F.array("lo", "hi")).alias("atom"))
    at = [*_PART, "atom"]
    alone = deal(atoms.select(*at), at, rows).distinct().join(deal(touched, at, rows), at, "left_anti")
    nodes = ends.withColumn("role", F.lit(0)).unionByName(
        alone.select(*_PART, F.col("atom").alias("lo"), F.lit(None).cast("int").alias("hi"), F.lit(-1).alias("role"))
    )
    order = F.when(F.col("role") == 0, F.lit(0)).otherwise(F.lit(2**40)) + F.col("lo").cast("bigint")
    nodes = nodes.withColumn("_o", order)
    if most <= HEAVY_ROWS:
        numbered = deal(nodes, ["mol_id"], rows).withColumn("node", F.row_number().over(Window.partitionBy(*_PART).orderBy("_o", "hi")) - 1)
    else:
        numbered = contiguous_index(nodes, "_o", "node", _PART, ["hi"], bucket=F.floor(F.col("_o") / _CHUNK))
    return numbered.select(*_PART, F.col("node").cast("int").alias("node"), "lo", "hi", "role")


def _incidence(nodes: DataFrame, node: str) -> DataFrame:
    return nodes.filter("role = 0").select(*_PART, F.explode(F.array_distinct(F.array("lo", "hi"))).alias("atom"), F.col("node").alias(node))


def line_edges(nodes: DataFrame) -> DataFrame:
    """Ordered pairs of bonds that share an atom. The pairs are the result itself; their number per atom is bounded by its valence. Two
    different bonds share one atom at most, so no pair comes twice."""
    shared = _incidence(nodes, "src").join(_incidence(nodes, "dst"), [*_PART, "atom"])
    return shared.filter("src <> dst").select(*_PART, "src", "dst")


def _steps(nodes: DataFrame) -> DataFrame:
    """Each bond in both directions, and a step in place per atom which keeps finished paths through a join."""
    bond = nodes.filter("role = 0")
    there = bond.select(*_PART, F.col("lo").alias("a"), F.col("hi").alias("b"), "node")
    back = bond.select(*_PART, F.col("hi").alias("a"), F.col("lo").alias("b"), "node")
    both = there.unionByName(back)
    stay = both.select(*_PART, "a", F.col("a").alias("b"), F.lit(None).cast("int").alias("node")).distinct()
    return both.unionByName(stay)


def _walk(iterator: Iterator[pa.RecordBatch], max_length: int) -> Iterator[pa.RecordBatch]:
    """All shortest paths of components given as one row of bonds each; level by level from every atom."""
    for batch in iterator:
        out: list[list] = [[] for _ in range(6)]
        for mol, part, bonds in zip(*(batch.column(i).to_pylist() for i in range(3))):
            near: dict[int, list[tuple[int, int]]] = {}
            for b in bonds:
                near.setdefault(b["lo"], []).append((b["hi"], b["node"]))
                near.setdefault(b["hi"], []).append((b["lo"], b["node"]))
            for start in near:
                known, level = set(), {}
                for step in range(max_length + 1):
                    found: dict[int, tuple[tuple, tuple]] = {} if step else {start: ((start,), ())}
                    for atom, (path, via) in level.items():
                        for other, node in near[atom]:
                            # the smallest path to an atom goes over smallest paths to those before it
                            if other not in known and (other not in found or path < found[other][0][:-1]):
                                found[other] = ((*path, other), (*via, node))
                    for end, (path, via) in found.items():
                        for column, value in zip(out, (mol, part, start, end, path, via)):
                            column.append(value)
                    known.update(found)
                    level = found
        yield pa.RecordBatch.from_pydict(dict(zip(_PATH_COLUMNS, (pa.array(v, t) for v, t in zip(out, [batch.schema.field(0).type, batch.schema.field(1).type, *_PATH_TYPES])))))


def shortest_paths(nodes: DataFrame, max_length: int = 5, most: int = MOST_BONDS) -> DataFrame:
    """Shortest atom paths of up to ``max_length`` bonds, both directions, one per pair (smallest atom sequence).

    ``(mol_id, component, src, dst, path, via)``: ``path`` are atoms, ``via`` the bond nodes. A component of up to ``most`` bonds is one row of
    bonds, made by one shuffle, and its paths are walked inside it. Larger ones, if there are any, are walked by joins, see :func:`joined_paths`.
    """
    bonds = nodes.filter("role = 0").select(*_PART, F.struct(*[F.col(c).cast("bigint").alias(c) for c in ("lo", "hi")], "node").alias("b"))
    sizes = bonds.groupBy(*_PART).agg(F.count(F.lit(1)).alias("_n"))
    large = sizes.filter(F.col("_n") > most).select(*_PART)
    any_large = not large.isEmpty()
    small = bonds.join(large, _PART, "left_anti") if any_large else bonds
    kinds = [f"`{c}` {nodes.schema[c].dataType.simpleString()}" for c in _PART]
    schema = ", ".join([*kinds, "src bigint", "dst bigint", "path array<bigint>", "via array<int>"])
    walked = small.groupBy(*_PART).agg(F.collect_list("b").alias("bonds")).mapInArrow(lambda it: _walk(it, max_length), schema)
    return walked.unionByName(joined_paths(nodes.join(large, _PART, "left_semi"), max_length)) if any_large else walked


def joined_paths(nodes: DataFrame, max_length: int = 5) -> DataFrame:
    """The paths of :func:`shortest_paths` for components too large for one row: one join and one aggregate per step. A path either grows by a bond or stays as it is, then the shortest, smallest one per pair is kept."""
    steps = _steps(nodes)
    state = steps.filter("node IS NULL").select(
        *_PART, F.col("a").alias("src"), F.col("a").alias("dst"), F.array("a").alias("path"), F.array().cast("array<int>").alias("via")
    )
    for length in range(max_length):
        moves = steps.withColumnRenamed("a", "dst")
        grown = state.join(moves, [*_PART, "dst"])
        stay = F.col("node").isNull()
        fresh = (F.size("via") == length) & ~F.array_contains("path", F.col("b"))
        grown = grown.filter(stay | fresh).select(
            *_PART, "src", F.col("b").alias("dst"),
            F.when(stay, F.col("path")).otherwise(F.concat("path", F.array("b"))).alias("path"),
            F.when(stay, F.col("via")).otherwise(F.concat("via", F.array("node"))).alias("via"),
        )
        best = F.min(F.struct(F.size("path").alias("n"), F.col("path"), F.col("via")))
        state = grown.groupBy(*_PART, "src", "dst").agg(best.alias("k")).select(*_PART, "src", "dst", "k.path", "k.via")
    return state


def _padded(first: Column, middle: Column, last: Column, max_length: int) -> Column:
    gap = F.lit(max_length - 2) - F.size(middle)
    return F.concat(F.array(first), middle, F.array_repeat(F.lit(PAD), gap), F.array(last))


def _direct(src: str, dst: str, max_length: int) -> Column:
    return _padded(F.col(src), F.array().cast("array<int>"), F.col(dst), max_length)


def path_edges(nodes: DataFrame, max_length: int = 5) -> DataFrame:
    """Edges between the first and last bond of each shortest path of more than three atoms, with the padded bond path."""
    paths = shortest_paths(nodes, max_length).filter(F.size("path") > 3)
    n = F.size("via")
    middle = F.slice("via", F.lit(2), n - 2)
    return paths.select(
        *_PART, F.element_at("via", 1).alias("src"), F.element_at("via", -1).alias("dst"),
        _padded(F.element_at("via", 1), middle, F.element_at("via", -1), max_length).alias("path"),
    )


def component_sizes(nodes: DataFrame, n_local: int = 3) -> DataFrame:
    """Per component ``base`` and ``total`` nodes, ``node_offset`` and ``first_label``; per molecule ``first_global`` (node number)
    and ``global_label``. Labels follow the order of the components that are there. The windows run over components, of which a molecule has
    a few."""
    molecule = Window.partitionBy("mol_id")
    before = molecule.orderBy("component").rowsBetween(Window.unboundedPreceding, -1)
    sizes = nodes.groupBy(*_PART).agg(F.count(F.lit(1)).cast("int").alias("base"))
    return (
        sizes.withColumn("total", (F.col("base") + n_local).cast("int"))
        .withColumn("node_offset", F.coalesce(F.sum("total").over(before), F.lit(0)).cast("int"))
        .withColumn("first_label", ((F.row_number().over(molecule.orderBy("component")) - 1) * n_local).cast("int"))
        .withColumn("first_global", F.sum("total").over(molecule).cast("int"))
        .withColumn("global_label", (F.count(F.lit(1)).over(molecule) * n_local + 1).cast("int"))
    )


def place(nodes: DataFrame, n_local: int = 3) -> DataFrame:
    """Nodes with the sizes of their component beside them. Every edge but line and path edges is then a projection.

    ``nodes`` is read three times here and the result by all later steps, so both belong in a table: see :func:`build_nodes`.
    """
    sizes = component_sizes(nodes, n_local)
    return lookup_join(nodes, sizes, _PART, "inner", heavy=heavy_keys(sizes, _PART, "base"))


def build_nodes(atoms: DataFrame, bonds: DataFrame, n_local: int = 3) -> DataFrame:
    """Numbered and placed nodes in a table of the shared folder, ready for the edge functions."""
    return settle(place(settle(triplet_nodes(atoms, bonds), "nodes"), n_local), "placed")


def _each(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))


def _both_ways(a: Column, b: Column) -> Column:
    return F.explode(F.array(F.struct(a.alias("src"), b.alias("dst")), F.struct(b.alias("src"), a.alias("dst"))))


def local_nodes(placed: DataFrame, n_local: int = 3) -> DataFrame:
    """Virtual nodes of each component, numbered behind its real ones; every component has a node 0 to make them from."""
    return placed.filter("node = 0").select("*", _each(n_local).alias("_j")).select(
        *_PART, (F.col("base") + F.col("_j")).alias("node"), (F.col("first_label") + F.col("_j") + 1).alias("role"), "node_offset"
    )


def local_edges(placed: DataFrame, n_local: int = 3) -> DataFrame:
    """Each local virtual node to and from every real node of its component; ``label`` is the virtual node's role."""
    pairs = placed.select("*", _each(n_local).alias("_j"))
    ends = _both_ways(F.col("base") + F.col("_j"), F.col("node"))
    return pairs.select(*_PART, "node_offset", (F.col("first_label") + F.col("_j") + 1).alias("label"), ends.alias("e")).select(
        *_PART, "e.src", "e.dst", "label", "node_offset"
    )


def self_loops(nodes: DataFrame) -> DataFrame:
    return nodes.select(*_PART, F.col("node").alias("src"), F.col("node").alias("dst"))


def graph_nodes(placed: DataFrame, n_local: int = 3, n_global: int = 1) -> DataFrame:
    """All nodes of a molecule with one numbering over components, then global virtual nodes: ``(mol_id, component, node, role, bid)``.

    ``bid`` is the bond's number inside its component, -1 for anything that is not a bond.
    """
    shifted = (F.col("node") + F.col("node_offset")).alias("node")
    out = placed.select(*_PART, shifted, "role", F.when(F.col("role") == 0, F.col("node")).otherwise(-1).alias("bid"))
    if n_local:
        out = out.unionByName(local_nodes(placed, n_local).select(*_PART, shifted, "role", F.lit(-1).alias("bid")))
    if n_global:
        extra = placed.filter("node = 0 AND node_offset = 0").select("*", _each(n_global).alias("_j"))
        out = out.unionByName(
            extra.select(
                "mol_id", F.lit(-1).cast(placed.schema["component"].dataType).alias("component"), (F.col("first_global") + F.col("_j")).alias("node"),
                (F.col("global_label") + F.col("_j")).alias("role"), F.lit(-1).alias("bid"),
            )
        )
    return out


def global_edges(placed: DataFrame, n_global: int = 1) -> DataFrame:
    """Global virtual nodes to and from every bond or isolated atom, in molecule numbering."""
    pairs = placed.select("*", _each(n_global).alias("_j"))
    ends = _both_ways(F.col("first_global") + F.col("_j"), F.col("node") + F.col("node_offset"))
    return pairs.select("mol_id", (F.col("global_label") + F.col("_j")).alias("label"), ends.alias("e")).select("mol_id", "e.src", "e.dst", "label")


def graph_edges(placed: DataFrame, max_length: int = 5, n_local: int = 3, n_global: int = 1, loops: bool = True) -> DataFrame:
    """All edges in molecule numbering: ``(mol_id, src, dst, kind, label, path)``; kinds line, path, local, self, global."""
    shifted = placed.withColumn("node", (F.col("node") + F.col("node_offset")).cast("int"))

    def one(edges: DataFrame, kind: str) -> DataFrame:
        move = F.col("node_offset") if "node_offset" in edges.columns else F.lit(0)
        label = F.col("label") if "label" in edges.columns else F.lit(0)
        moved = edges.withColumns({"src": (F.col("src") + move).cast("int"), "dst": (F.col("dst") + move).cast("int")})
        path = F.col("path") if "path" in edges.columns else _direct("src", "dst", max_length)
        return moved.select("mol_id", "src", "dst", F.lit(kind).alias("kind"), label.cast("int").alias("label"), path.alias("path"))

    out = one(line_edges(shifted), "line").unionByName(one(path_edges(shifted, max_length), "path"))
    if n_local:
        out = out.unionByName(one(local_edges(placed, n_local), "local"))
    if loops:
        every = graph_nodes(placed, n_local, 0)
        out = out.unionByName(one(self_loops(every), "self"))
    if n_global:
        out = out.unionByName(one(global_edges(placed, n_global), "global"))
    return out


def prompt_graph(nodes: DataFrame, max_length: int = 5) -> tuple[DataFrame, DataFrame]:
    """Graph used to map node vectors back: two local virtual nodes, no global one; nodes carry ``bid``. ``nodes`` as placed with
    two local nodes."""
    return graph_nodes(nodes, 2, 0), graph_edges(nodes, max_length, 2, 0)


def map_back(base_nodes: DataFrame, made: DataFrame, vec: str = "vec") -> DataFrame:
    """Vectors computed on an augmented graph back onto base nodes of the same bond number; -1 never matches."""
    wanted = base_nodes.filter("bid >= 0")
    return wanted.join(made.filter("bid >= 0").select("mol_id", "bid", vec), ["mol_id", "bid"], "left")


def batch_offsets(sizes: DataFrame, batch: str, graph: str, n: str, out: str = "offset") -> DataFrame:
    """Where each graph's nodes start inside its batch (a batch is a few graphs)."""
    before = Window.partitionBy(batch).orderBy(graph).rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn(out, F.coalesce(F.sum(n).over(before), F.lit(0)))


def shift_paths(edges: DataFrame, offsets: DataFrame, graph: str, offset: str = "offset") -> DataFrame:
    """Add the offset to every path position. Padding is shifted too and stays far below zero."""
    joined = lookup_join(edges, offsets.select(graph, offset), [graph], "inner")
    return joined.withColumn("path", F.transform("path", lambda p: (p + F.col(offset)).cast("bigint"))).drop(offset)


def prompt_slots(sizes: DataFrame) -> DataFrame:
    """First node of each component's prompt block (from :func:`component_sizes`): the node count of the components before it."""
    return sizes.select(*_PART, F.col("node_offset").alias("first_node"), F.col("base").alias("n_nodes"))


def edge_softmax(edges: DataFrame, score: str = "score", by: tuple[str, ...] = ("mol_id", "dst"), out: str = "alpha") -> DataFrame:
    """``exp(a - max) / (sum + 1e-9)`` over the edges entering a node.

    Max and sum are partial aggregates that come back by salted lookups, so a node with very many edges is not one window.
    """
    by = list(by)
    top = edges.groupBy(*by).agg(F.max(score).alias("_m"), F.count(F.lit(1)).alias("_n"))
    heavy = heavy_keys(top, by)
    raised = lookup_join(edges, top.drop("_n"), by, "inner", heavy=heavy).withColumn("_e", F.exp(F.col(score) - F.greatest(F.col("_m"), F.lit(-1e9)))).drop("_m")
    sums = raised.groupBy(*by).agg(F.sum("_e").alias("_s"))
    return lookup_join(raised, sums, by, "inner", heavy=heavy).withColumn(out, F.col("_e") / (F.col("_s") + F.lit(1e-9))).drop("_e", "_s")


def neighbour_sum(edges: DataFrame, node_vectors: DataFrame, weight: str = "weight", vec: str = "vec", out: str = "message") -> DataFrame:
    """Per target node the weighted sum of source vectors."""
    sources = node_vectors.select("mol_id", F.col("node").alias("src"), vec)
    met = lookup_join(edges.select("mol_id", "src", "dst", weight), sources, ["mol_id", "src"], "inner")
    return met.groupBy("mol_id", "dst").agg(vector_sum(F.col(vec), F.col(weight)).alias(out))


def path_vectors(edges: DataFrame, node_vectors: DataFrame, key: list[str], vec: str = "vec") -> DataFrame:
    """Per edge the number of real path positions and the mean of their node vectors."""
    places = edges.select("mol_id", *key, F.explode(F.filter("path", lambda p: p >= 0)).alias("node"))
    met = lookup_join(places, node_vectors.select("mol_id", "node", vec), ["mol_id", "node"], "inner")
    sums = met.groupBy("mol_id", *key).agg(F.count(F.lit(1)).alias("path_len"), vector_sum(F.col(vec)).alias("_s"))
    return sums.withColumn("path_vec", F.transform("_s", lambda x: x / F.greatest(F.col("path_len"), F.lit(1)))).drop("_s")


def readout(node_vectors: DataFrame, n_local: int = 3, how: str = "mean", vec: str = "vec") -> DataFrame:
    """Graph vector: per virtual role the average over two components, the global node (the highest role), then the mean or sum of real
    nodes. A molecule of one component counts it twice."""
    if how not in ("mean", "sum"):
        raise ValueError(f"unknown readout: {how!r}")
    real = node_vectors.filter("role = 0").groupBy("mol_id").agg(vector_sum(F.col(vec)).alias("_r"), F.count(F.lit(1)).alias("_n"))
    by_role = node_vectors.filter("role > 0").groupBy("mol_id").agg(
        *[F.max_by(A.doubles(vec), F.when(F.col("role") == r, 1)).alias(f"_v{r}") for r in range(1, 2 * n_local + 2)], F.max("role").alias("_top")
    )
    joined = by_role.join(real, "mol_id", "left")
    alone = F.col("_top") <= n_local + 1
    glob = F.when(alone, F.col(f"_v{n_local + 1}")).otherwise(F.col(f"_v{2 * n_local + 1}"))
    second = lambda r: F.when(alone, F.col(f"_v{r}")).otherwise(F.col(f"_v{r + n_local}"))
    halves = [A.scale(A.add(F.col(f"_v{r}"), second(r)), F.lit(0.5)) for r in range(1, n_local + 1)]
    body = F.coalesce(F.col("_r"), A.zeros(F.size(glob)))
    if how == "mean":
        body = A.scale(body, 1.0 / F.greatest(F.coalesce(F.col("_n"), F.lit(1)), F.lit(1)))
    return joined.select("mol_id", F.concat(*halves, glob, body).alias("graph_vec"))


def geometric_statistic(distances: DataFrame, by: list[str], d: str = "d") -> DataFrame:
    """``n / exp(avg(ln d))`` per key; logs keep the product from overflowing, no distance gives no row value."""
    return distances.groupBy(*by).agg((F.count(d) / F.exp(F.avg(F.ln(d)))).alias("statistic"))
