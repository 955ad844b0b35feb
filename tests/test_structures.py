"""Compositions, vectors and graphs against plain loops."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from litprops.functions import arrays as A
from litprops.operators import composition, graph, vectors
from litprops.session import settle
from litprops.sources import vector_cache as cache
from tests.conftest import rows

UNITS = ["mol%", "wt%"]


@pytest.mark.parametrize(
    "value, unit, homo, expected",
    [
        ("97-99", " wt% ", False, [98.0, 1.0, 0.0, 1.0]),
        (None, "wt%", False, [0.0, 0.0, 0.0, 1.0]),
        ("5", "vol%", False, [5.0, 1.0, 0.0, 0.0]),
        ("5", None, False, [5.0, 1.0, 0.0, 0.0]),
        ("5", "wt%", True, [100.0, 1.0, 1.0, 0.0]),
        (None, None, None, [0.0, 0.0, 0.0, 0.0]),
    ],
)
def test_ratio_vector(spark, value, unit, homo, expected):
    df = spark.createDataFrame([(value, unit, homo)], "v string, u string, h boolean")
    assert df.select(composition.ratio_vector(F.col("v"), F.col("u"), F.col("h"), UNITS)).first()[0] == expected


def test_unit_vocabulary(spark):
    df = spark.createDataFrame([(" wt% ",), ("a",), ("",), (None,), ("é",), ("Z",)], "u string")
    assert rows(composition.unit_vocabulary(df, "u"), "idx") == [(u, i) for i, u in enumerate(sorted(["wt%", "a", "é", "Z", "mol%"]))]


@pytest.mark.parametrize(
    "smiles, slots, flag, flag_homo",
    [([], [None, None], 0, 0), (["A"], ["A", "A"], 1, 0), (["A", "B", "C"], ["A", "B"], 1, 0), ([" ", "B"], [None, "B"], 0, 0), ([None], [None, None], 0, 0)],
)
def test_slots(spark, smiles, slots, flag, flag_homo):
    df = spark.createDataFrame([([(s, "1") for s in smiles],)], "m array<struct<smiles string, ratio_value string>>")
    got = df.select(composition.component_slots(F.col("m")).alias("s"))
    got = got.select(F.transform("s", lambda s: s["smiles"]).alias("x"), composition.type_flag(F.col("s"), F.lit(False)).alias("f"), composition.type_flag(F.col("s"), F.lit(True)).alias("h")).first()
    assert got["x"] == slots and got["h"] == flag_homo and got["f"] == flag


def test_graph_smiles_placeholder(spark):
    df = spark.createDataFrame([([("A", "1"), ("B", "1")],)], "m array<struct<smiles string, ratio_value string>>")
    got = df.select(composition.graph_smiles(composition.component_slots(F.col("m")), F.array(F.lit("B")))).first()[0]
    assert got == ["C", "B"]


def test_array_functions(spark):
    df = spark.createDataFrame([([1.0, 3.0, 5.0], "x")], "a array<double>, k string")
    r = df.select(
        A.layer_norm(F.col("a")).alias("n"), A.one_hot(F.col("k"), ["x", "y"], True).alias("h"), A.blend(F.col("a"), F.col("a"), F.lit(0.3)).alias("b"),
        A.clean_descriptors(F.array(F.lit(float("nan")), F.lit(float("-inf")), F.lit(2e6))).alias("c"),
    ).first()
    x = np.array([1.0, 3.0, 5.0])
    assert r["n"] == pytest.approx(((x - 3) / math.sqrt(x.var() + 1e-5)).tolist())
    assert r["h"] == [1, 0, 0] and r["b"] == pytest.approx([1.0, 3.0, 5.0]) and r["c"] == [0.0, -1e6, 1e6]
    with pytest.raises(Exception, match="expected 4 features"):
        df.select(A.concat_features([F.col("a")], 4)).collect()


# ---- vectors

W1, B1, W2, B2 = [[1.0, -1.0], [0.5, 2.0]], [0.1, 0.2], [1.0, -2.0], 0.3


@pytest.fixture(scope="module")
def toks(spark):
    rng = np.random.default_rng(1)
    out = [(r, p, rng.normal(size=2).tolist(), int((p + r) % 3 != 0)) for r, n in enumerate([1, 3, 5, 4]) for p in range(n)]
    out += [(9, p, [1.0, 2.0 + p], 0) for p in range(2)]
    return out, spark.createDataFrame(out, "row_idx long, pos int, vec array<float>, mask int")


def by_record(toks):
    for k, g in itertools.groupby(toks, key=lambda t: t[0]):
        g = list(g)
        yield k, np.array([t[2] for t in g], dtype=np.float32).astype(float), np.array([t[3] for t in g], float)


def score(v):
    return np.tanh(v @ np.array(W1).T + B1) @ np.array(W2) + B2


@pytest.mark.parametrize("kind", vectors.POOLINGS)
def test_pooling(toks, kind):
    plain, df = toks
    s = vectors.gate_score(F.col("vec"), W1, B1, W2, B2)
    extra = {"attention_pooling": {"score": s, "bound": vectors.score_bound(W2, B2)}, "sigmoid_pooling": {"score": s}}.get(kind, {})
    got = dict(rows(vectors.pool(kind, df, ["row_idx"], mask="mask", **extra).select("row_idx", "pooled")))
    for k, v, m in by_record(plain):
        if kind == "mean_pooling":
            want = (v * m[:, None]).sum(0) / max(m.sum(), 1)
        elif kind == "sum_pooling":
            want = (v * m[:, None]).sum(0)
        elif kind == "last_token":
            want = v[np.flatnonzero(m)[-1]] if m.any() else v[-1]
        elif kind == "sigmoid_pooling":
            want = (v * (m / (1 + np.exp(-score(v))))[:, None]).sum(0)
        else:
            if not m.any():
                continue
            e = np.exp(score(v)) * m
            want = (v * (e / e.sum())[:, None]).sum(0)
        assert got[k] == pytest.approx(want.tolist(), abs=1e-6)


def test_unknown_pooling(toks):
    with pytest.raises(ValueError):
        vectors.pool("max", toks[1], ["row_idx"])
    with pytest.raises(ValueError):
        vectors.pool("last_token", toks[1], ["row_idx"], structure=True)
    with pytest.raises(ValueError):
        vectors.attention_pooling(toks[1], ["row_idx"], F.lit(1.0), 1e4)


def test_attention_weights_sum_to_one(toks, heavy):
    s = vectors.gate_score(F.col("vec"), W1, B1, W2, B2)
    w = vectors.attention_weights(toks[1].filter("row_idx < 9"), ["row_idx"], s, vectors.score_bound(W2, B2), "mask")
    sums = w.groupBy("row_idx").agg(F.sum("alpha").alias("s"), F.max(F.when(F.col("mask") == 0, F.col("alpha"))).alias("z")).collect()
    masked_out = [r for r in sums if r["s"] is not None and not math.isnan(r["s"])]
    assert all(r["s"] == pytest.approx(1.0) and (r["z"] in (None, 0.0)) for r in masked_out) and len(masked_out) >= 3


def test_padding(toks):
    rag = cache.ragged(toks[1].filter("row_idx < 4"), ["row_idx"]).withColumn("batch", F.lit(0))
    got = vectors.pad_batch(rag, ["batch"], width=2).orderBy("row_idx").collect()
    assert [len(r["tokens"]) for r in got] == [5] * 4 and [sum(r["mask"]) for r in got] == [1, 3, 5, 4]
    assert got[0]["tokens"][1] == [0.0, 0.0] and got[2]["mask"] == [1] * 5


def test_standardise_constant_column(spark):
    df = spark.createDataFrame([("a", [1.0, 7.0]), ("a", [3.0, 7.0]), ("b", [5.0, 1.0])], "k string, vec array<double>")
    assert rows(vectors.standardise(df, ["k"]), "k") == [("a", [-1.0, 0.0]), ("a", [1.0, 0.0]), ("b", [0.0, 0.0])]


def test_cache_view_needs_every_row(spark, toks):
    want = spark.createDataFrame([(0,), (7,)], "row_idx long")
    with pytest.raises(Exception, match="no cached vectors for row 7"):
        cache.view(want, toks[1], ["row_idx"]).collect()
    assert cache.view(want.filter("row_idx = 0"), toks[1], ["row_idx"]).count() == 1


def test_cache_counts(spark, toks):
    recs = spark.range(6).select(F.lit("d").alias("dataset"), F.col("id").alias("row_idx"))
    t = toks[1].withColumns({"dataset": F.lit("d"), "model": F.lit("m")}).filter("row_idx < 9")
    r = cache.check_counts(recs, t, ["dataset", "model"]).first()
    assert (r["records"], r["cached"], r["complete"]) == (6, 4, False)


# ---- graphs

MOLECULES = {  # atoms, bonds per component
    1: [(8, [(i, i + 1) for i in range(7)])],
    2: [(6, [(i, (i + 1) % 6) for i in range(6)])],
    3: [(4, [(0, i) for i in range(1, 4)])],
    4: [(1, [])],
    5: [(5, [(0, 1), (1, 2), (2, 3), (3, 4)]), (3, [(0, 1)])],
}


@pytest.fixture(scope="module")
def molecules(spark):
    atoms = [(m, c, a) for m, parts in MOLECULES.items() for c, (n, _) in enumerate(parts) for a in range(n)]
    bonds = [(m, c, b, a) for m, parts in MOLECULES.items() for c, (_, bs) in enumerate(parts) for a, b in bs]
    return spark.createDataFrame(atoms, "mol_id long, component int, atom int"), spark.createDataFrame(bonds, "mol_id long, component int, a int, b int")


def plain_nodes():
    out = {}
    for m, parts in MOLECULES.items():
        for c, (n, bonds) in enumerate(parts):
            nodes = [(lo, hi) for lo, hi in sorted((min(b), max(b)) for b in bonds)]
            touched = {a for b in bonds for a in b}
            out[m, c] = nodes, [a for a in range(n) if a not in touched]
    return out


@pytest.mark.parametrize("hot", [False, True])
def test_nodes(molecules, hot, request):
    if hot:
        request.getfixturevalue("heavy")
    got = {tuple(r) for r in graph.triplet_nodes(*molecules).collect()}
    want = set()
    for (m, c), (bonds, alone) in plain_nodes().items():
        want |= {(m, c, i, lo, hi, 0) for i, (lo, hi) in enumerate(bonds)}
        want |= {(m, c, len(bonds) + i, a, None, -1) for i, a in enumerate(alone)}
    assert got == want


def test_line_edges(molecules):
    got = {tuple(r) for r in graph.line_edges(graph.triplet_nodes(*molecules)).collect()}
    want = {(m, c, i, j) for (m, c), (b, _) in plain_nodes().items() for i, j in itertools.permutations(range(len(b)), 2) if set(b[i]) & set(b[j])}
    assert got == want


def plain_paths(bonds, longest):
    """Shortest atom path per ordered pair, the smallest sequence among equals, by trying all simple paths."""
    near = {}
    for a, b in bonds:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    best = {}
    for start in near:
        todo = [[start]]
        while todo:
            path = todo.pop()
            key = (start, path[-1])
            if key not in best or (len(path), path) < (len(best[key]), best[key]):
                best[key] = path
            if len(path) <= longest:
                todo += [path + [n] for n in near[path[-1]] if n not in path]
    return best


@pytest.mark.parametrize("most", [graph.MOST_BONDS, 3, 0])
def test_paths(molecules, most):
    """All components as rows, some of them, or none."""
    got = {(r["mol_id"], r["component"], r["src"], r["dst"]): (r["path"], r["via"]) for r in graph.shortest_paths(graph.triplet_nodes(*molecules), 5, most).collect()}
    for (m, c), (bonds, _) in plain_nodes().items():
        number = {b: i for i, b in enumerate(bonds)}
        want = plain_paths(bonds, 5)
        mine = {k[2:]: v for k, v in got.items() if k[:2] == (m, c)}
        assert {k: v[0] for k, v in mine.items()} == want
        assert all(v[1] == [number[tuple(sorted(p))] for p in itertools.pairwise(v[0])] for v in mine.values())


def test_padded_paths(molecules):
    got = {tuple(r["path"]) for r in graph.path_edges(graph.triplet_nodes(*molecules), 5).filter("mol_id = 1").collect()}
    assert (0, 1, graph.PAD, graph.PAD, 2) in got and (6, 5, 4, 3, 2) in got and (0, 1, 2, 3, 4) in got


def test_whole_graph(molecules):
    placed = graph.place(graph.triplet_nodes(*molecules))
    nodes = {(r["mol_id"], r["node"]): (r["role"], r["bid"]) for r in graph.graph_nodes(placed).collect()}
    five = [nodes[5, i] for i in range(sum(k[0] == 5 for k in nodes))]
    # four bonds and three virtual nodes, then one bond, one isolated atom and three virtual nodes, then the global one
    assert five == [(0, 0), (0, 1), (0, 2), (0, 3), (1, -1), (2, -1), (3, -1), (0, 0), (-1, -1), (4, -1), (5, -1), (6, -1), (7, -1)]
    edges = [tuple(r) for r in graph.graph_edges(placed).filter("mol_id = 5").select("kind", "src", "dst", "label").collect()]
    kinds = {k: sum(e[0] == k for e in edges) for k in ("line", "path", "local", "self", "global")}
    assert kinds == {"line": 6, "path": 6, "local": 2 * 3 * 4 + 2 * 3 * 2, "self": 12, "global": 12}
    assert ("local", 4, 0, 1) in edges and ("local", 7, 9, 4) in edges and ("global", 12, 8, 7) in edges and ("global", 12, 4, 7) not in edges


def test_edge_softmax(spark, heavy):
    df = spark.createDataFrame([(1, s, 0, float(s)) for s in range(6)] + [(1, 0, 1, -700.0)], "mol_id long, src int, dst int, score double")
    got = {(r["src"], r["dst"]): r["alpha"] for r in graph.edge_softmax(df).collect()}
    e = np.exp(np.arange(6) - 5.0)
    assert [got[s, 0] for s in range(6)] == pytest.approx((e / (e.sum() + 1e-9)).tolist()) and got[0, 1] == pytest.approx(1.0)


def test_triplet_vocabulary(spark):
    n, b, want, at = 4, 2, {}, 0
    for lo in range(n):
        for bond in range(b):
            for hi in range(lo, n):
                want[lo, bond, hi] = at
                at += 1
    df = spark.createDataFrame([(x, k, y) for x in range(n + 1) for k in range(b + 1) for y in range(n + 1)] + [(2, 999, 999)], "x int, k int, y int")
    for r in df.withColumn("t", graph.triplet_id(F.col("x"), F.col("y"), F.col("k"), n, b)).collect():
        key = (min(r["x"], r["y"]), r["k"], max(r["x"], r["y"]))
        assert r["t"] == (at + 2 if key == (2, 999, 999) else want.get(key, at + n))
    assert df.select(graph.triplet_id(F.lit(500), F.lit(1), F.lit(0))).first()[0] == 26367


def test_readout_and_statistic(spark):
    nodes = [(1, role, [float(role), float(i)]) for i, role in enumerate([1, 2, 3, 4, 5, 6, 7, 0, 0])]
    df = spark.createDataFrame(nodes, "mol_id long, role int, vec array<double>")
    assert graph.readout(df).first()["graph_vec"] == [2.5, 1.5, 3.5, 2.5, 4.5, 3.5, 7.0, 6.0, 0.0, 7.5]
    assert graph.readout(df, how="sum").first()["graph_vec"][-1] == 15.0
    d = spark.createDataFrame([("a", 1e200), ("a", 1e300), ("b", None)], "k string, d double")
    got = dict(rows(graph.geometric_statistic(d, ["k"])))
    assert got["a"] == pytest.approx(2e-250) and got["b"] is None


def test_readout_of_one_component(spark):
    nodes = [(1, role, [float(role), float(i)]) for i, role in enumerate([1, 2, 3, 4, 0, 0])]
    df = spark.createDataFrame(nodes, "mol_id long, role int, vec array<double>")
    assert graph.readout(df).first()["graph_vec"] == [1.0, 0.0, 2.0, 1.0, 3.0, 2.0, 4.0, 3.0, 0.0, 4.5]


def test_labels_follow_the_components_that_are_there(spark):
    nodes = spark.createDataFrame([(1, 1, 0), (1, 1, 1), (2, 0, 0), (2, 5, 0)], "mol_id long, component int, node int")
    got = rows(graph.component_sizes(nodes).select("mol_id", "component", "first_label", "global_label"), "mol_id", "component")
    assert got == [(1, 1, 0, 4), (2, 0, 0, 7), (2, 5, 3, 7)]


def test_chains_are_computed_once(spark):
    """Two structures share a chain; each distinct chain reaches the user's function once, and both slots get all lengths."""
    seen = spark.sparkContext.accumulator(0)

    def compute(chains):
        def run(frames):
            for f in frames:
                seen.add(len(f))
                yield f.assign(vec=[[float(len(c)), float(c.count("a"))] for c in f["chain"]])

        return chains.mapInPandas(run, "chain string, vec array<double>")

    smiles = spark.createDataFrame([("ab",), ("abab",), ("ab",), ("c",)], "smiles string")
    made = settle(composition.multimer_features(smiles, lambda s, u: F.repeat(s, u), compute, (3, 6)))
    assert made.count() == 6 and seen.value == 5  # ab x 6 is abab x 3
    recs = spark.createDataFrame([(0, [("ab",), ("abab",)]), (1, [("c",), (None,)]), (2, [("zz",), ("zz",)])], "row_idx long, slots array<struct<smiles string>>")
    got = rows(composition.attach_slot_features(recs, made, ["row_idx"], 2, (3, 6)), "row_idx", "slot")
    assert [(r[0], r[1], r[3]) for r in got] == [
        (0, 0, [[6.0, 3.0], [12.0, 6.0]]), (0, 1, [[12.0, 6.0], [24.0, 12.0]]), (1, 0, [[3.0, 0.0], [6.0, 0.0]]), (1, 1, [[0.0, 0.0]] * 2), (2, 0, [[0.0, 0.0]] * 2), (2, 1, [[0.0, 0.0]] * 2),
    ]
    assert composition.attach_slot_features(recs.limit(0), made, ["row_idx"], 2).count() == 0
