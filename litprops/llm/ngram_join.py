"""N-gram Jaccard join by signature trees, exact at any threshold above one half.

A document's set is its distinct five-word shingles. Steps:

1. Documents with equal sets become one class (its smallest id stands for it).
2. A class is posted under its prefix: with similarity ``t`` two sets of sizes ``a, b`` share a shingle among the first
   ``n - ceil(t n) + 1`` of each, in any fixed order of shingles. The order puts shingles that very many documents hold last, so a passage
   that a third of all rows share is hardly ever posted.
3. Classes with many common postings are linked to the smallest and largest class of their postings, after their whole sets were
   compared. That joins groups of near copies by a star of links instead of by all pairs.
4. A posting list that still holds more than one component goes through a signature tree: items sorted by size, every node with the range
   of sizes and components below it and the OR of the shingle bitmaps below it. Two nodes are compared by the largest overlap they allow;
   a pair of nodes inside one component, of unfit sizes, with too few common bits or too late positions is dropped with all that stands
   below (where a pair's first common shingle stands at places ``i, j``, it has at most ``min(a - i, b - j)`` in common). The trees of all lists
   of a batch are walked together, many node pairs at a time. A list of more than :data:`CELL` items is cut into blocks by hash, and every
   two blocks make a cell with a tree of its own; so no task holds a whole long list, and every two items meet in exactly one cell. Of lists
   with the same members only the first in the order is searched, which has every pair of the others. A pair is left to the list of an earlier
   common shingle, where the last sixteen lists before show that there is one; so pairs with many common shingles are not found once for each.
   The bitmaps of the trees have one width, and what the leaves have left is compared by bitmaps that grow with the sets up to :data:`WIDE` bits.
5. The pairs found are compared by bitmaps as wide as their sets are large, then by whole sets. Links of steps 3 and 5 make the components.

Shingles are compared as 64-bit hashes, sets in step 1 by 128 bits.

Defined results: null, empty or word-less text has an empty set, no link, and its own id as component; fewer than five words are one
shingle, the whole sequence; repeated rows of one id count as one document; a document without an id comes after all others, its row has a null
id, and so has its component unless it holds a document with an id; columns other than ``doc_id`` and ``text`` are ignored; an
empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litprops.llm.store import Scratch, components, named, only_ids, unnamed
from litprops.llm.words import STEP, batches, mix, release, window_hashes, word_hashes

SHINGLE = 5
#: A shingle counts as frequent from this many documents of one batch on ...
LOCAL_FREQUENT = 16
#: ... and the order knows this many of the most frequent ones. Any choice gives the same links; it only spares work.
FREQUENT = 100_000
LEAF, FAN = 8, 4
#: Bits of a bitmap, and node pairs compared at a time.
SKETCH, AT_ONCE = 512, 4096
#: Earlier shingles of a prefix that travel with a posting (128 bytes).
HEAD = 16
#: Bits of the widest bitmap that travels with a posting.
WIDE = 1 << 14
#: Posting lists with more items than this are dealt into cells of at most about twice as many.
CELL = 2000


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text."""
    first, words = word_hashes(texts, lower=True)
    windows = window_hashes(words, SHINGLE)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= SHINGLE:
            s = np.sort(windows[a : b - SHINGLE + 1])
            if len(s) > 1:
                s = s[np.concatenate(([True], s[1:] != s[:-1]))]
        elif b > a:
            s = mix(np.array([(words[a:b] * STEP[10 : 10 + b - a]).sum(dtype=np.uint64) + np.uint64(b - a)]))
        else:
            s = words[:0]
        out.append(s)
    return out


def _need(a, b, percent: int):
    """Smallest overlap of sets of sizes ``a`` and ``b`` at a similarity of ``percent`` or more: 100 i >= p (a + b - i)."""
    return -(-percent * (a + b) // (100 + percent))


def _describe(iterator):
    """One row per document (size, set key) and one per shingle that is frequent in its batch."""
    for part in (p for b in iterator for p in [b]):
        ids, sizes, k1, k2, low = [], [], [], [], []
        for piece in batches([part]):
            for d, s in zip(piece.column(0).to_pylist(), shingle_sets(piece.column(1))):
                ids.append(d)
                sizes.append(len(s))
                k1.append(int(mix(s).sum(dtype=np.uint64)))
                k2.append(int(mix(s ^ STEP[20]).sum(dtype=np.uint64)))
                low.append(s[: np.searchsorted(s, np.uint64(0x5000000000000000))])
        token, count = np.unique(np.concatenate(low), return_counts=True) if low else (np.empty(0, np.uint64), np.empty(0, np.int64))
        token, count = token[count >= LOCAL_FREQUENT], count[count >= LOCAL_FREQUENT]
        n = len(token)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(ids + [None] * n, pa.int64()),
                pa.array(np.concatenate([np.array(sizes, np.int64), count])),
                pa.array(np.concatenate([np.array(k1, np.uint64), token]).view(np.int64)),
                pa.array(np.concatenate([np.array(k2, np.uint64), np.zeros(n, np.uint64)]).view(np.int64)),
            ],
            names=["doc_id", "n", "k1", "k2"],
        )


def sketch(s: np.ndarray) -> bytes:
    """Bitmap of a set, always :data:`SKETCH` bits wide, so that a posting costs the same whatever the length of its document."""
    bits = np.zeros(SKETCH, bool)
    bits[((s >> np.uint64(20)) & np.uint64(SKETCH - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def signature(s: np.ndarray, most: int = 1 << 62) -> bytes:
    """Bitmap of a set with two to four bits for each shingle, ``most`` in all; the width is a power of two, so that wide ones fold onto narrow ones."""
    width = min(most, max(64, 1 << int(2 * len(s) - 1).bit_length()))
    bits = np.zeros(width, bool)
    bits[((s >> np.uint64(20)) & np.uint64(width - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def may_be_similar(x: bytes, n: int, y: bytes, m: int, percent: int) -> bool:
    """Whether two signatures of sets of ``n`` and ``m`` shingles allow a link."""
    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    width = min(len(x), len(y))
    x, y = (np.bitwise_or.reduce(b.reshape(-1, width), axis=0) for b in (x, y))
    most = min(n - int(np.bitwise_count(x & ~y).sum()), m - int(np.bitwise_count(y & ~x).sum()))
    return most >= _need(n, m, percent)


def _post(frequent: np.ndarray, percent: int):
    def run(iterator):
        for part in batches(iterator):
            ids, sizes, prefixes, signs, leaves, wide = [], [], [], [], [], []
            for d, s in zip(part.column(0).to_pylist(), shingle_sets(part.column(1))):
                n = len(s)
                if not n:
                    continue
                if len(frequent):
                    hit = frequent[np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)] == s
                    ordered = np.concatenate([s[~hit], s[hit]])
                else:
                    ordered = s
                ids.append(d)
                sizes.append(n)
                prefixes.append(ordered[: n - -(-percent * n // 100) + 1].view(np.int64))
                signs.append(sketch(s))
                leaves.append(signature(s, WIDE))
                wide.append(signature(s))
            bitmaps = [pa.array(v, pa.binary()) for v in (signs, leaves, wide)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(sizes, pa.int32()), pa.array(prefixes, pa.list_(pa.int64())), *bitmaps],
                names=["rep", "n", "prefix", "sign", "leaf", "wide"],
            )

    return run


def _whole_sets(iterator):
    for part in batches(iterator):
        sets = [s.view(np.int64) for s in shingle_sets(part.column(1))]
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["rep", "tokens"])


class Level:
    """Nodes of one level over the trees of many lists; node ``k`` has the children ``start[k]:start[k + 1]`` of the level below."""

    def __init__(self, start, n0, n1, c0, c1, left, bits, slack):
        self.start, self.n0, self.n1, self.c0, self.c1, self.left, self.bits, self.slack = start, n0, n1, c0, c1, left, bits, slack


def _groups(first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Cut every list ``first[k]:first[k + 1]`` into groups of ``size``: the groups' borders, and the lists' borders among the groups."""
    many = -(-np.diff(first) // size)
    lists = np.concatenate(([0], np.cumsum(many)))
    start = np.repeat(first[:-1], many) + (np.arange(lists[-1]) - np.repeat(lists[:-1], many)) * size
    return np.append(start, first[-1]), lists


def build_trees(first: np.ndarray, n: np.ndarray, comp: np.ndarray, left: np.ndarray, bits: np.ndarray) -> list[Level]:
    """One tree per list of items, which are sorted by size inside their list; the leaves' level first, one node per list in the last.

    A node holds the ranges of sizes and components, the greatest overlap that positions allow (``left``), the OR of the bitmaps and ``slack``,
    the most shingles that any item below has beyond its distinct bits, so that ``common bits + slack`` bounds an overlap.
    """
    start, lists = _groups(first, LEAF)
    at = start[:-1]
    slack = n - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
    level = Level(start, np.minimum.reduceat(n, at), np.maximum.reduceat(n, at), np.minimum.reduceat(comp, at), np.maximum.reduceat(comp, at), np.maximum.reduceat(left, at), np.bitwise_or.reduceat(bits, at, axis=0), np.maximum.reduceat(slack, at))
    levels = [level]
    while (np.diff(lists) > 1).any():
        start, lists = _groups(lists, FAN)
        at, low = start[:-1], levels[-1]
        levels.append(Level(start, np.minimum.reduceat(low.n0, at), np.maximum.reduceat(low.n1, at), np.minimum.reduceat(low.c0, at), np.maximum.reduceat(low.c1, at), np.maximum.reduceat(low.left, at), np.bitwise_or.reduceat(low.bits, at, axis=0), np.maximum.reduceat(low.slack, at)))
    return levels


def _may_link(level: Level, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Which of the node pairs (``a`` not after ``b``) may hold a link between two components."""
    ok = (level.c0[a] != level.c1[b]) | (level.c1[a] != level.c0[b])
    ok &= 100 * level.n1[a] >= percent * level.n0[b]
    common = np.bitwise_count(level.bits[a] & level.bits[b]).sum(axis=1, dtype=np.int64) + np.minimum(level.slack[a], level.slack[b])
    most = np.minimum(np.minimum(level.left[a], level.left[b]), common)
    return ok & ((a == b) | (most >= _need(level.n0[a], level.n0[b], percent)))


def _children(start: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of a child of ``a`` and a child of ``b``; those of a node with itself once."""
    width = start[b + 1] - start[b]
    many = (start[a + 1] - start[a]) * width
    pair = np.repeat(np.arange(len(a)), many)
    inside = np.arange(len(pair)) - np.repeat(np.cumsum(many) - many, many)
    i, j = start[a][pair] + inside // width[pair], start[b][pair] + inside % width[pair]
    keep = (a[pair] != b[pair]) | (i <= j)
    return i[keep], j[keep]


def _met_before(head: np.ndarray, many: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs have a common shingle among the first ``many`` of ``head``, which stand before the shared one: they meet in that shingle's list."""
    known = np.arange(HEAD) < many[:, None]
    met = np.zeros(len(i), bool)
    for k in range(0, len(i), 4 * AT_ONCE):
        a, b = i[k : k + 4 * AT_ONCE], j[k : k + 4 * AT_ONCE]
        met[k : k + len(a)] = ((head[a][:, :, None] == head[b][:, None, :]) & known[a][:, :, None] & known[b][:, None, :]).any(axis=(1, 2))
    return met


def _fit(leaves: list[np.ndarray], n: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs the bitmaps of their own widths allow; those of one width are compared together, the wider one of a pair folded onto the other."""
    width = np.array([len(b) for b in leaves])
    kinds = width[i] * (1 << 32) + width[j]
    fit = np.zeros(len(i), bool)
    for kind in np.unique(kinds).tolist():
        of, low = np.flatnonzero(kinds == kind), min(kind >> 32, kind & 0xFFFFFFFF)
        step = max(1, (1 << 19) // low)
        for k in range(0, len(of), step):
            at = of[k : k + step]
            x, y = (np.bitwise_or.reduce(np.stack([leaves[p] for p in v[at].tolist()]).reshape(len(at), -1, low), axis=1) for v in (i, j))
            a, b = n[i[at]], n[j[at]]
            most = np.minimum(a - np.bitwise_count(x & ~y).sum(axis=1, dtype=np.int64), b - np.bitwise_count(y & ~x).sum(axis=1, dtype=np.int64))
            fit[at] = most >= _need(a, b, percent)
    return fit


def tree_pairs(
    first, n, comp, left, bits, percent: int, side: np.ndarray | None = None, head: np.ndarray | None = None, many: np.ndarray | None = None, leaves: list[np.ndarray] | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Item pairs of one list and of different components that positions and bitmaps cannot rule out: dual traversal of every list's tree with
    itself, many node pairs at a time. Items with a ``side`` (not negative) pair with those of another side only. With ``head`` (the first
    shingles of each item's set, or ``many`` others that stand before the shared one) pairs that surely meet in an earlier list are left to it.
    With ``leaves`` (a bitmap of its own width for each item) what the trees have left is compared by them."""
    levels = build_trees(first, n, comp, left, bits)
    roots = np.arange(len(levels[-1].n0))
    found, stack = [], [(len(levels) - 1, roots, roots)]
    while stack:
        depth, a, b = stack.pop()
        if len(a) > AT_ONCE:
            stack += [(depth, a[k : k + AT_ONCE], b[k : k + AT_ONCE]) for k in range(0, len(a), AT_ONCE)]
            continue
        level = levels[depth]
        ok = _may_link(level, a, b, percent)
        i, j = _children(level.start, a[ok], b[ok])
        if not len(i):
            continue
        if depth:
            stack.append((depth - 1, i, j))
            continue
        ok = (i != j) & (comp[i] != comp[j]) & (100 * n[i] >= percent * n[j])
        if side is not None:
            ok &= (side[i] < 0) | (side[i] != side[j])
        i, j = i[ok], j[ok]
        need = _need(n[i], n[j], percent)
        ok = np.minimum(left[i], left[j]) >= need
        if head is not None:
            ok[ok] = ~_met_before(head, n - left if many is None else many, i[ok], j[ok])
        i, j, need = i[ok], j[ok], need[ok]
        x, y = bits[i], bits[j]
        most = np.minimum(n[i] - np.bitwise_count(x & ~y).sum(axis=1, dtype=np.int64), n[j] - np.bitwise_count(y & ~x).sum(axis=1, dtype=np.int64))
        i, j = i[most >= need], j[most >= need]
        if leaves is not None and len(i):
            fit = _fit(leaves, n, i, j, percent)
            i, j = i[fit], j[fit]
        found.append((i, j))
    return tuple(np.concatenate(v) if v else np.empty(0, np.int64) for v in (zip(*found) if found else ((), ())))


def _bitmaps(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]].reshape(len(column), SKETCH // 8).view(np.uint64)


def _leaves(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(b.as_buffer(), np.uint64) for b in column]


def _heads(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The earlier shingles of every item, and how many there are."""
    column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    flat, row = column.flatten().to_numpy(), np.repeat(np.arange(len(sizes)), sizes)
    out = np.zeros((len(sizes), HEAD), np.int64)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out, sizes


def _search(percent: int):
    """Over rows sorted by token, cell and size: one tree per cell of a posting list. The cells of a batch are searched together; a cell that
    goes on in the next batch is held back."""

    def search(rows: pa.Table):
        cell = np.stack([rows.column(c).to_numpy() for c in ("token", "row", "column")], axis=1)
        first = np.concatenate(([0], np.flatnonzero((cell[1:] != cell[:-1]).any(axis=1)) + 1, [len(cell)]))
        n, comp, rep = (rows.column(c).to_numpy().astype(np.int64) for c in ("n", "comp", "rep"))
        side = np.where(cell[:, 1] != cell[:, 2], rows.column("block").to_numpy(), -1)
        left, bits, leaves = n - rows.column("pos").to_numpy(), _bitmaps(rows.column("sign")), _leaves(rows.column("leaf"))
        i, j = tree_pairs(first, n, comp, left, bits, percent, side, *_heads(rows.column("head")), leaves)
        pairs = np.unique(np.stack([np.minimum(rep[i], rep[j]), np.maximum(rep[i], rep[j])], axis=1), axis=0) if len(i) else np.empty((0, 2), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    def run(iterator):
        held: list[pa.RecordBatch] = []
        for batch in iterator:
            if not batch.num_rows:
                continue
            cell = np.stack([batch.column(c).to_numpy() for c in range(3)], axis=1)
            changes = np.flatnonzero((cell[1:] != cell[:-1]).any(axis=1)) + 1
            if held and any(held[-1].column(c)[held[-1].num_rows - 1].as_py() != int(cell[0, c]) for c in range(3)):
                yield search(pa.Table.from_batches(held))
                held = []
            if len(changes):
                yield search(pa.Table.from_batches([*held, batch.slice(0, int(changes[-1]))]))
                held = [batch.slice(int(changes[-1]))]
                release()
            else:
                held.append(batch)
        if held:
            yield search(pa.Table.from_batches(held))

    return run


def _cells(blocks: Column, block: Column) -> Column:
    """The cells ``row, column`` of an item of ``block``: one with every block of its list."""
    return F.transform(F.sequence(F.lit(0), blocks - 1), lambda k: F.struct(F.least(block, k).alias("row"), F.greatest(block, k).alias("column")))


def _lists(placed: DataFrame) -> DataFrame:
    """``token, blocks`` of the posting lists to search: those that hold more than one component, and of lists with the same members the first.
    Members are compared by two 64-bit hashes, added up in halves of 32 bits; the place of one member tells which list is first."""
    keys = [F.xxhash64("who", F.lit(k)) for k in range(2)]
    halves = [h for k in keys for h in (F.shiftrightunsigned(k, 32), k.bitwiseAND(F.lit(0xFFFFFFFF)))]
    sums = [F.sum(h).alias(f"s{k}") for k, h in enumerate(halves)]
    lists = placed.groupBy("token").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("c"), F.min(F.struct("who", "pos")).alias("at"), *sums)
    lists = lists.filter("x < y").groupBy("c", "at.who", *(f"s{k}" for k in range(4))).agg(F.min(F.struct("at.pos", "token")).alias("list"))
    return lists.select("list.token", F.when(F.col("c") > CELL, F.ceil(F.col("c") / CELL)).otherwise(1).cast("int").alias("blocks"))


def _likely(percent: int):
    def run(iterator):
        for batch in iterator:
            keep = [may_be_similar(x, n, y, m, percent) for n, x, m, y in zip(*(batch.column(c).to_pylist() for c in range(2, 6)))]
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _verified(pairs: DataFrame, base: DataFrame, texts: DataFrame, scratch: Scratch, name: str, percent: int) -> DataFrame:
    """Those of the pairs ``a, b`` whose whole sets are similar enough. Their wide bitmaps are compared first, which are a sixteenth of a set."""
    one = base.select(F.col("rep").alias("a"), F.col("n").alias("n"), F.col("wide").alias("x"))
    other = base.select(F.col("rep").alias("b"), F.col("n").alias("m"), F.col("wide").alias("y"))
    pairs = pairs.distinct().join(one, "a").join(other, "b").select("a", "b", "n", "x", "m", "y").mapInArrow(_likely(percent), "a long, b long")
    pairs = scratch.put(pairs, f"{name}-pairs")
    ids = scratch.put(pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct(), f"{name}-ids")
    sets = only_ids(texts, ids, "doc_id").mapInArrow(_whole_sets, "rep long, tokens array<long>")
    sets = scratch.put(sets.dropDuplicates(["rep"]), f"{name}-sets")
    both = F.size(F.array_intersect("x", "y"))
    links = (
        pairs.join(sets.select(F.col("rep").alias("a"), F.col("tokens").alias("x")), "a")
        .join(sets.select(F.col("rep").alias("b"), F.col("tokens").alias("y")), "b")
        .filter(100 * both >= percent * (F.size("x") + F.size("y") - both))
        .select("a", "b")
    )
    links = scratch.put(links, f"{name}-links")
    scratch.drop(f"{name}-pairs", f"{name}-ids", f"{name}-sets")
    return links


def near_duplicates(docs: DataFrame, percent: int = 80, keyed: bool = False) -> DataFrame:
    """``doc_id, n_shingles, class_id, component_id`` for every document.

    ``class_id`` is the smallest document with the same set, ``component_id`` the smallest one reachable by links of at least ``percent``
    per cent similarity. See the module for the steps and for unusual input. ``keyed``: the ids come from :func:`litprops.llm.store.named`
    and stay in the result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngram-join")
    texts = named(docs.select("doc_id", "text"))
    seen = scratch.put(texts.mapInArrow(_describe, "doc_id long, n long, k1 long, k2 long"), "described")
    sets = seen.filter("doc_id is not null").groupBy("doc_id").agg(F.min("n").alias("n"), F.min("k1").alias("k1"), F.min("k2").alias("k2"))
    classes = sets.filter("n > 0").groupBy("n", "k1", "k2").agg(F.min("doc_id").alias("rep"))
    members = sets.join(classes, ["n", "k1", "k2"], "left").select("doc_id", "n", F.coalesce("rep", "doc_id").alias("rep"))
    members = scratch.put(members, "members")
    top = seen.filter("doc_id is null").groupBy("k1").agg(F.sum("n").alias("c")).orderBy(F.desc("c"), "k1").limit(FREQUENT)
    frequent = np.sort(np.array([r.k1 for r in top.select("k1").collect()], np.int64).view(np.uint64))

    scratch.drop("described")
    copies = members.filter("rep <> doc_id or n = 0").select("doc_id")
    base = only_ids(texts, copies, "doc_id", "left_anti").mapInArrow(_post(frequent, percent), "rep long, n int, prefix array<long>, sign binary, leaf binary, wide binary")
    # ``who`` tells texts apart that stand under one id
    base = scratch.put(base.withColumn("who", F.xxhash64("rep", "prefix")), "base")
    posts = base.select("rep", "n", "who", F.posexplode("prefix").alias("pos", "token"))
    # of two similar sets the smaller one has its first common shingle among these, so a list without one links nothing
    early = F.col("n") - F.col("pos") >= F.ceil(2 * percent * F.col("n") / (100 + percent))
    shared = posts.groupBy("token").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi"), F.max(early).alias("early")).filter("lo < hi and early").drop("early")
    posts = scratch.put(posts.join(shared, "token"), "posts")

    near = (
        posts.select("rep", "n", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("other"))
        .filter("rep <> other")
        .groupBy("rep", "other")
        .agg(F.count("*").alias("c"), F.first("n").alias("n"))
        .filter(F.col("c") * 4 >= F.col("n") * (1 - percent / 100))
    )
    star = _verified(near.select(F.least("rep", "other").alias("a"), F.greatest("rep", "other").alias("b")), base, texts, scratch, "star", percent)
    first = scratch.put(components(star, scratch, "first"), "first")

    placed = posts.select("token", "rep", "who", "n", "pos").join(first, posts.rep == first.node, "left").select("token", "rep", "who", "n", "pos", F.coalesce("component", "rep").alias("comp"))
    placed = scratch.put(placed, "placed")
    scratch.drop("posts")
    items = placed.join(_lists(placed), "token").repartition("rep")
    before = Window.partitionBy("rep", "who").orderBy("pos").rowsBetween(-HEAD, -1)
    items = items.withColumn("head", F.collect_list("token").over(before)).join(base.select("rep", "who", "sign", "leaf"), ["rep", "who"])
    items = items.withColumn("block", F.pmod(F.xxhash64("rep", F.lit(7)), F.col("blocks")).cast("int"))
    items = items.select("token", F.inline(_cells(F.col("blocks"), F.col("block"))), "comp", "n", "pos", "rep", "block", "sign", "leaf", "head")
    cell = ["token", "row", "column"]
    found = items.repartition(*cell).sortWithinPartitions(*cell, "n", "rep").mapInArrow(_search(percent), "a long, b long")
    more = _verified(scratch.put(found, "found"), base, texts, scratch, "tree", percent)
    scratch.drop("base", "placed", "found")

    last = scratch.put(components(star.unionByName(more), scratch, "last"), "last")
    out = members.join(last, members.rep == last.node, "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("rep").alias("class_id"), F.coalesce("component", "rep").alias("component_id")
    )
    out = scratch.put(out, "result")
    scratch.drop("members", "first", "last", "star-links", "tree-links")
    return out if keyed else unnamed(unnamed(unnamed(out), "component_id"), "class_id")
