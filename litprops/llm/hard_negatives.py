"""Hard negatives by inner product, found best-first in STR-packed R-trees.

For every anchor: its ``positives`` rows of the same label with the highest scores, and for each of them the ``negatives`` best rows of another
label whose score lies between ``low`` and ``high`` per cent of the positive's. A score is the integer inner product of the components
``floor(scale * x)``; higher scores come first, ties by smaller id. Results are exact.

1. Packing. A bounded sample (:data:`SAMPLE` rows by hash of the id) gives the borders of tiles, sort-tile-recursive: slabs of the coordinate
   that varies most, each cut into slabs of the next one, and so on. Every row goes to its tile; a tile with more than :data:`GROVE` rows, such
   as copies of one vector, is dealt by hash of the id. Inside a part rows are packed the same way into leaves of :data:`LEAF`. The order is
   written to the shared folder.
2. Search. Tasks read the order and build trees over at most about :data:`GROVE` rows at a time: a node has the bounding box, the smallest id and
   the labels below it. Its box gives the least and greatest inner product per coordinate and so an interval of scores. A queue takes the node
   with the highest score first; nodes outside the score windows or strictly below the k-th score found so far (with an equal score: above its
   id) are dropped with all that stands below.
3. Anchors are sent to the tasks in chunks of about :data:`ANCHORS` by hash, so what is broadcast does not grow with the table. Each task keeps the
   best of an anchor over all its trees; a window over the few that remain of each task ends it. One pass finds positives, a second negatives.

The work is that of anchors times rows where boxes prune nothing, which is so for random vectors of many dimensions.

Defined results: rows with a null id, label or vector, with a null or non-finite component, or with a component beyond ``2**26 / scale`` take no
part; of several rows with one id the one with the smallest label and vector counts; vectors of different lengths are filled up with zeros; an
anchor without positives, and a positive without negatives, give no rows; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litprops.llm.store import Scratch
from litprops.llm.words import release

#: Rows that borders of tiles are taken from at most; every row is indexed, whatever the sample.
SAMPLE = 20_000
#: Rows of a leaf, children of a node, rows of a tree (about), anchors of a pass (about).
LEAF, FAN, GROVE, ANCHORS = 256, 8, 32_768, 8192
#: Greatest magnitude of a component after scaling; inner products of 2,048 of them fit 64 bits.
LARGEST = 1 << 26


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """``vec_id, label, q`` of the rows that take part, one per id."""
    x = lambda v: F.floor(v.cast("double") * scale)
    fine = F.forall("embedding", lambda v: F.coalesce(F.abs(v.cast("double")) * scale < LARGEST, F.lit(False)))  # NaN is above all numbers
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).filter(fine)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.struct(F.col("label").cast("long").alias("label"), F.transform("embedding", x).cast("array<int>").alias("q")).alias("r"))
    return rows.groupBy("vec_id").agg(F.min("r").alias("r")).select("vec_id", "r.label", "r.q")


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as a matrix, filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy()
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width), np.int32)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _shape(parts: int, width: int) -> tuple[int, int]:
    """Into how many slabs to cut, along how many coordinates, for about ``parts`` parts."""
    depth = max(1, min(width, round(np.log(max(parts, 1)) / np.log(4))))
    return max(1, int(np.ceil(parts ** (1 / depth) - 1e-9))), depth


def tile_borders(sample: np.ndarray, tiles: int) -> tuple[list[int], list[np.ndarray]]:
    """Coordinates, most varying first, and for each of them the borders inside every slab of the one before: ``[slabs so far, slabs - 1]``."""
    slabs, depth = _shape(tiles, sample.shape[1])
    axes = np.argsort(-sample.std(axis=0), kind="stable")[:depth].tolist()
    groups, borders = [sample], []
    for axis in axes:
        rows, below = np.zeros((len(groups), slabs - 1)), []
        for i, g in enumerate(groups):
            ordered = g[np.argsort(g[:, axis], kind="stable")]
            at = (np.arange(1, slabs) * len(ordered)) // slabs
            rows[i] = ordered[np.minimum(at, len(ordered) - 1), axis] if len(ordered) else 0
            slab = np.searchsorted(rows[i], ordered[:, axis], "right") if len(ordered) else np.empty(0, int)
            below += [ordered[slab == k] for k in range(slabs)]
        borders.append(rows)
        groups = below
    return axes, borders


def tile_of(x: np.ndarray, axes: list[int], borders: list[np.ndarray]) -> np.ndarray:
    tile = np.zeros(len(x), np.int64)
    for axis, rows in zip(axes, borders):
        tile = tile * (rows.shape[1] + 1) + (x[:, axis][:, None] >= rows[tile]).sum(axis=1)
    return tile


def str_leaves(x: np.ndarray, leaf: int = LEAF) -> list[np.ndarray]:
    """Sort-tile-recursive packing: row numbers of every leaf."""
    slabs, depth = _shape(-(-len(x) // leaf), x.shape[1] or 1)
    groups = [np.arange(len(x))]
    for axis in np.argsort(-x.std(axis=0), kind="stable")[:depth].tolist() if x.shape[1] else []:
        groups = [p for g in groups for p in np.array_split(g[np.argsort(x[g, axis], kind="stable")], slabs)]
    return [g[k : k + leaf] for g in groups for k in range(0, len(g), leaf)]


def _table(batches: list[pa.RecordBatch]) -> pa.Table:
    return pa.Table.from_batches(batches)


def _runs(iterator: Iterator[pa.RecordBatch], columns: int) -> Iterator[tuple[tuple, pa.Table]]:
    """Consecutive rows that agree in their first columns."""
    key, held = None, []
    for batch in iterator:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(i).to_numpy() for i in range(columns)], axis=1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            here = tuple(keys[a].tolist())
            if held and here != key:
                yield key, _table(held)
                held = []
            key = here
            held.append(batch.slice(a, b - a))
    if held:
        yield key, _table(held)


def packed(rows: DataFrame, width: int, count: int, scratch: Scratch, leaf: int = LEAF, grove: int = GROVE) -> DataFrame:
    """``leaf, vec_id, label, q`` in packed order, written to the shared folder."""
    sample = rows.orderBy(F.xxhash64("vec_id", F.lit(11)), "vec_id").limit(SAMPLE).select("q").toArrow()
    axes, borders = tile_borders(matrix(sample.column("q"), width), max(1, min(-(-count // grove), SAMPLE // 8)))

    def place(iterator):
        for b in iterator:
            yield pa.RecordBatch.from_arrays([pa.array(tile_of(matrix(b.column(2), width), axes, borders), pa.int64()), *b.columns], names=["tile", "vec_id", "label", "q"])

    tiled = scratch.put(rows.select("vec_id", "label", "q").mapInArrow(place, "tile long, vec_id long, label long, q array<int>"), "tiled")
    parts = tiled.groupBy("tile").agg(F.ceil(F.count("*") / grove).alias("parts"))
    tiled = tiled.join(parts, "tile").select("tile", F.pmod(F.xxhash64("vec_id"), "parts").alias("part"), "vec_id", "label", "q")

    def pack(iterator):
        for _, t in _runs(iterator, 2):
            x = matrix(t.column("q"), width)
            for number, rows_of in enumerate(str_leaves(x, leaf)):
                for b in t.take(pa.array(np.sort(rows_of))).combine_chunks().to_batches():
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, number), pa.int64()), *(b.column(c) for c in ("tile", "part", "vec_id", "label", "q"))], names=["leaf", "tile", "part", "vec_id", "label", "q"])
            release()

    order = ["tile", "part", "vec_id"]
    index = tiled.repartition("tile", "part").sortWithinPartitions(*order).mapInArrow(pack, "leaf long, tile long, part long, vec_id long, label long, q array<int>")
    index = scratch.put(index, "index")
    scratch.drop("tiled")
    return index


class Tree:
    """Levels of nodes over leaves, the leaves first; per node box, smallest id, least and greatest label, and its children or rows."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, labels: np.ndarray, cuts: np.ndarray):
        self.x, self.ids, self.labels = x, ids, labels
        at = cuts[:-1]
        level = (np.minimum.reduceat(x, at), np.maximum.reduceat(x, at), np.minimum.reduceat(ids, at), np.minimum.reduceat(labels, at), np.maximum.reduceat(labels, at))
        self.levels, self.spans = [level], [cuts]
        while len(self.levels[-1][0]) > 1:
            cuts = np.append(np.arange(0, len(self.levels[-1][0]), FAN), len(self.levels[-1][0]))
            at, below = cuts[:-1], self.levels[-1]
            self.levels.append((np.minimum.reduceat(below[0], at), np.maximum.reduceat(below[1], at), np.minimum.reduceat(below[2], at), np.minimum.reduceat(below[3], at), np.maximum.reduceat(below[4], at)))
            self.spans.append(cuts)

    def bounds(self, a: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per level the least and the greatest inner product of every anchor with anything in a node's box."""
        up, down = np.maximum(a, 0), np.minimum(a, 0)
        return [(up @ lo.T + down @ hi.T, up @ hi.T + down @ lo.T) for lo, hi, *_ in self.levels]

    def search(self, a: np.ndarray, anchor: int, label: int, bounds: list, same: bool, windows: list[list]) -> None:
        """Bring ``windows`` up to date, each ``[least score, greatest score, k, best]`` with ``best`` a sorted list of ``(-score, id)``."""

        def worth(low, high, smallest) -> int | None:
            best = None
            for least, greatest, k, found in windows:
                if low > greatest or high < least:
                    continue
                if len(found) == k and (high < -found[-1][0] or (high == -found[-1][0] and smallest > found[-1][1])):
                    continue
                best = max(best, min(high, greatest)) if best is not None else min(high, greatest)
            return best

        def push(level, node):
            _, _, smallest, l0, l1 = self.levels[level]
            if (label < l0[node] or label > l1[node]) if same else (l0[node] == l1[node] == label):
                return
            low, high = bounds[level][0][node], bounds[level][1][node]
            p = worth(low, high, smallest[node])
            if p is not None:
                heapq.heappush(queue, (-p, level, node, low, high))

        queue: list = []
        push(len(self.levels) - 1, 0)
        while queue:
            _, level, node, low, high = heapq.heappop(queue)
            if worth(low, high, self.levels[level][2][node]) is None:
                continue
            lo, hi = int(self.spans[level][node]), int(self.spans[level][node + 1])
            if level:
                for child in range(lo, hi):
                    push(level - 1, child)
                continue
            scores = self.x[lo:hi] @ a
            fit = (self.labels[lo:hi] == label) == same
            for w in windows:
                least, greatest, k, found = w
                if len(found) == k:
                    least = max(least, -found[-1][0])
                hit = np.flatnonzero(fit & (scores >= least) & (scores <= greatest))
                if len(hit):
                    ids = self.ids[lo + hit]
                    new = [(-int(s), int(i)) for s, i in zip(scores[hit], ids) if i != anchor]
                    w[3] = heapq.nsmallest(k, found + new) if len(new) > k else sorted(found + new)[:k]


def trees(iterator: Iterator[pa.RecordBatch], width: int, grove: int = GROVE) -> Iterator[Tree]:
    """Trees over about ``grove`` rows each of a stream in packed order."""

    def build(held):
        t = _table(held)
        x, ids, labels = matrix(t.column("q"), width), t.column("vec_id").to_numpy(), t.column("label").to_numpy()
        keys = np.stack([t.column(c).to_numpy() for c in ("tile", "part", "leaf")], axis=1)
        cuts = np.concatenate(([0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, [len(keys)]))
        return Tree(x, ids, labels, cuts)

    held, n = [], 0
    for batch in iterator:
        for k in range(0, batch.num_rows, grove):
            held.append(batch.slice(k, grove))
            n += held[-1].num_rows
            if n >= grove:
                yield build(held)
                held, n = [], 0
                release()
    if n:
        yield build(held)


def _search(anchors, width: int, same: bool, k: int, grove: int):
    """``anchors.value``: ids, labels, vectors and, per anchor, the windows ``(mark, least, greatest)``."""

    def run(iterator):
        ids, labels, vectors, windows = anchors.value
        state = [[[least, greatest, k, []] for _, least, greatest in w] for w in windows]
        for tree in trees(iterator, width, grove):
            most = float(np.abs(tree.x).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * max(width, 1)
            kind = np.float64 if most < 2**52 else np.int64  # both exact; the first is faster
            tree.x = tree.x.astype(kind)
            tree.levels = [(lo.astype(kind), hi.astype(kind), *rest) for lo, hi, *rest in tree.levels]
            for block in range(0, len(ids), 512):
                a = vectors[block : block + 512].astype(kind)
                bounds = tree.bounds(a)
                for i in range(len(a)):
                    if state[block + i]:
                        tree.search(a[i], int(ids[block + i]), int(labels[block + i]), [(lo[i], hi[i]) for lo, hi in bounds], same, state[block + i])
        out = [(int(i), mark, row, -score) for i, marks, ws in zip(ids, windows, state) for (mark, *_), w in zip(marks, ws) for score, row in w[3]]
        columns = list(zip(*out)) or [()] * 4
        for at in range(0, max(1, len(out)), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 100_000], pa.int64()) for c in columns], names=["anchor_id", "mark", "vec_id", "score"])

    return run


def _best(index: DataFrame, anchors: tuple, width: int, same: bool, k: int, grove: int, scratch: Scratch, name: str) -> DataFrame:
    """``anchor_id, mark, vec_id, score, rank`` of the ``k`` best rows per window, over all tasks."""
    sent = index.sparkSession.sparkContext.broadcast(anchors)
    found = index.select("leaf", "tile", "part", "vec_id", "label", "q").mapInArrow(_search(sent, width, same, k, grove), "anchor_id long, mark long, vec_id long, score long")
    order = Window.partitionBy("anchor_id", "mark").orderBy(F.desc("score"), "vec_id")
    out = scratch.put(found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k), name)
    sent.destroy()
    return out


def mine(
    vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256,
    leaf: int = LEAF, grove: int = GROVE, at_once: int = ANCHORS,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for the rows ``vec_id, label, embedding``.

    ``leaf``, ``grove`` and ``at_once`` (anchors of a pass) set sizes of work, never what is found."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "hard-negatives")
    rows = scratch.put(quantised(vectors, scale), "rows")
    count, width, n = rows.agg(F.count("*"), F.max(F.size("q")), F.count_if(is_anchor)).first()
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not n or not width:
        return spark.createDataFrame([], schema)
    index = packed(rows, width, count, scratch, leaf, grove)
    chunks, out = -(-n // at_once), None
    anywhere = -(1 << 62), 1 << 62
    for chunk in range(chunks):
        picked = rows.filter(is_anchor & (F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(chunks)) == chunk)).orderBy("vec_id").toArrow()
        ids, labels, a = picked.column("vec_id").to_numpy(), picked.column("label").to_numpy(), matrix(picked.column("q"), width)
        near = _best(index, (ids, labels, a, [[(0, *anywhere)]] * len(ids)), width, True, positives, grove, scratch, f"positives-{chunk}")
        windows: dict[int, list] = {int(i): [] for i in ids}
        for r in near.select("anchor_id", "vec_id", "score").collect():  # at most ``positives`` for each anchor of a chunk
            windows[r.anchor_id].append((r.vec_id, -(-low * r.score // 100), high * r.score // 100))
        hard = _best(index, (ids, labels, a, [windows[int(i)] for i in ids]), width, False, negatives, grove, scratch, f"negatives-{chunk}")
        pair = near.select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
        told = hard.select("anchor_id", F.col("mark").alias("positive_id"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
        told = told.join(pair, ["anchor_id", "positive_id"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
        out = told if out is None else out.unionByName(told)
    scratch.drop("rows", "index")
    return out
