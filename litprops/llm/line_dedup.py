"""Line dedup by a deletion-neighbourhood join.

A line is what stands between line feeds, compared by its words (white space does not count). A line with a word goes if a line within the
edit bound stands earlier, in a smaller document or further up in the same one; both are taken from the input, so the rule does not depend on
what is removed elsewhere. The bound counts words replaced, added or left out: 1 for two lines of ``near_words`` words or more each, 0 (the same
words) for any other line.

Equal lines are found by hash, first inside a batch and then over all. A line with one word deleted, taken for every word, is its deletion
neighbourhood: two lines of equal length are one replacement apart when the variants of one position are equal, and a line is one addition
apart from another when it equals one of its variants. Each key takes the earliest line on it by an aggregate, so no pairs are formed and a
frequent line is no hot group. Variants are only made for lines that share the first or the last half with another line, which any two
lines within the bound do. A line that its variants would remove is compared with the earliest line on its key word by word before it goes.

Defined results: null text has no line and stays null; empty text is one empty line and stays; a document without an id is compared like the
others, after all that have one; rows repeated under one id are treated alike (a line is never earlier than itself); an empty table gives an
empty table. Columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litprops.llm.store import Scratch, named, only_ids, unnamed
from litprops.llm.words import STEP, _power, batches, mix, word_hashes

_Q = int(STEP[41])
_QINV = pow(_Q, -1, 1 << 64)


class _Spans:
    """Hashes of spans of one array of word hashes."""

    def __init__(self, words: np.ndarray):
        self.total = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * _power(_Q, len(words) + 1)[: len(words)], out=self.total[1:])
        self.back = _power(_QINV, len(words) + 1)

    def hash(self, a, b):
        return (self.total[b] - self.total[a]) * self.back[a]


def _split(texts) -> tuple[list[str], np.ndarray, np.ndarray]:
    """All lines, with the row and the number inside the row of each."""
    lines, rows, numbers = [], [], []
    for i, text in enumerate(texts):
        own = text.split("\n") if text is not None else []
        lines += own
        rows += [i] * len(own)
        numbers += range(len(own))
    return lines, np.array(rows, np.int64), np.array(numbers, np.int64)


def _describe(near_words: int):
    """One row per different line of a batch, at its earliest place; later places of it come as rows without halves and ``again``."""

    def run(iterator):
        for part in iterator:
            got = [[] for _ in range(5)]
            for piece in batches([part], rows=1 << 30, size=2 << 20):
                lines, row, number = _split(piece.column(1).to_pylist())
                first, words = word_hashes(pa.array(lines, pa.string()))
                spans, a, b = _Spans(words), first[:-1], first[1:]
                n = b - a
                key = mix(spans.hash(a, b) + n.astype(np.uint64))
                halves = []
                for q in ((n - 1) // 2, n // 2):
                    q = np.maximum(q, 0)
                    tag = q.astype(np.uint64) * STEP[50]
                    halves += [mix(spans.hash(a, a + q) + tag), mix(spans.hash(b - q, b) + tag + STEP[51])]
                keep = n > 0
                ids = piece.column(0).to_numpy()[row] if len(row) else np.empty(0, np.int64)
                for held, value in zip(got, (key, ids, number, n, np.stack(halves, axis=1))):
                    held.append(value[keep])
            key, doc, number, n, halves = (np.concatenate(v) for v in got) if got[0] else (np.empty(0, np.int64),) * 4 + (np.empty((0, 4), np.uint64),)
            order = np.lexsort((number, doc, key))
            key, doc, number, n, halves = (v[order] for v in (key, doc, number, n, halves))
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            head = np.flatnonzero(new)[np.cumsum(new) - 1] if len(key) else np.empty(0, np.int64)
            again = ~((doc == doc[head]) & (number == number[head]))
            size = np.where(new & (n >= near_words), 4, 0)
            ends = np.zeros(len(key) + 1, np.int32)
            np.cumsum(size, out=ends[1:])
            values = halves[size > 0].ravel().view(np.int64) if len(key) else np.empty(0, np.int64)
            keep = new | again
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(key.view(np.int64)),
                    pa.array(doc.astype(np.int64)),
                    pa.array(number.astype(np.int32)),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(values)),
                    pa.array(again),
                ],
                names=["key", "doc_id", "line", "halves", "again"],
            ).filter(pa.array(keep))

    return run


def _variants(iterator):
    """Rows ``kind, variant, doc_id, line``: a line less one word at a place (0), a line less any word (1), a whole line (2)."""
    for piece in batches(iterator, rows=500):
        kind, variant, doc, line = [], [], [], []
        for d, text, numbers in zip(*(piece.column(i).to_pylist() for i in range(3))):
            own = text.split("\n")
            first, words = word_hashes(pa.array([own[i] for i in numbers], pa.string()))
            spans = _Spans(words)
            for i, a, b in zip(numbers, first[:-1].tolist(), first[1:].tolist()):
                at = np.arange(a, b)
                n = b - a
                power = _power(_Q, n + 1)
                less = spans.hash(np.full(n, a), at) + spans.hash(np.minimum(at + 1, b - 1), np.full(n, b)) * (at + 1 < b) * power[at - a]
                place = mix(less + (at - a).astype(np.uint64) * STEP[52] + np.uint64(n))
                shorter = mix(less + np.uint64(n - 1))
                whole = mix(spans.hash(np.array([a]), np.array([b])) + np.uint64(n))
                for k, values in ((0, place), (1, np.unique(shorter)), (2, whole)):
                    kind.append(np.full(len(values), k, np.int8))
                    variant.append(values)
                    doc.append(np.full(len(values), d, np.int64))
                    line.append(np.full(len(values), i, np.int32))
        whole = [np.concatenate(v) if v else np.empty(0, t) for v, t in ((kind, np.int8), (variant, np.uint64), (doc, np.int64), (line, np.int32))]
        whole[1] = whole[1].view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in whole], names=["kind", "variant", "doc_id", "line"])


def one_edit(a: list, b: list) -> bool:
    """At most one word replaced, added or left out."""
    if abs(len(a) - len(b)) > 1:
        return False
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    same = next((i for i, x in enumerate(short) if x != long[i]), len(short))
    return short[same + (len(a) == len(b)) :] == long[same + 1 :]


def _verified(iterator):
    for piece in batches(iterator):
        keep = [one_edit(x.split(), y.split()) for x, y in zip(*(piece.column(i).cast(pa.binary()).to_pylist() for i in (2, 3)))]
        yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1)], names=["doc_id", "line"]).filter(pa.array(keep, pa.bool_()))


def _cut(iterator):
    for piece in batches(iterator):
        total, gone, kept = [], [], []
        for text, numbers in zip(piece.column(1).to_pylist(), piece.column(2).to_pylist()):
            own = text.split("\n") if text is not None else []
            out = set(numbers or ())
            total.append(len(own))
            gone.append(len(out))
            kept.append("\n".join(x for i, x in enumerate(own) if i not in out) if out else text)
        yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_lines", "n_removed", "kept"])


def repeated_lines(docs: DataFrame, scratch: Scratch, near_words: int = 10) -> DataFrame:
    """``doc_id, lines``: the numbers (from 0) of the lines to remove, for every document that has some. Documents have ids, see
    :func:`litprops.llm.store.named`."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    seen = scratch.put(texts.mapInArrow(_describe(near_words), "key long, doc_id long, line int, halves array<long>, again boolean"), "lines")
    here = F.struct("doc_id", "line")
    fresh = seen.filter("not again")
    earliest = fresh.groupBy("key").agg(F.min(here).alias("top"), F.count("*").alias("c"))
    earliest = scratch.put(earliest.select("key", "top.*", "c"), "earliest")
    places = seen.filter("again").select("doc_id", "line").unionByName(
        fresh.join(earliest.filter("c > 1").select("key", F.struct("doc_id", "line").alias("top")), "key").filter(here > F.col("top")).select("doc_id", "line")
    )
    halves = fresh.filter(F.size("halves") > 0).select("key", F.explode(F.array_distinct("halves")).alias("half"))
    shared = halves.groupBy("half").agg(F.min("key").alias("x"), F.max("key").alias("y")).filter("x < y").select("half")
    near = halves.join(shared, "half").select("key").distinct()
    near = scratch.put(near.join(earliest, "key").groupBy("doc_id").agg(F.collect_list("line").alias("lines")), "near")
    whole_texts = only_ids(texts, near.select("doc_id"), "doc_id").join(near, "doc_id").select("doc_id", "text", "lines")
    variants = scratch.put(whole_texts.mapInArrow(_variants, "kind byte, variant long, doc_id long, line int"), "variants")

    place = variants.filter("kind = 0")
    first = place.groupBy("variant").agg(F.min(here).alias("top"), F.max(here).alias("end")).filter("top < end").select("variant", "top")
    replaced = place.join(first, "variant").filter(here > F.col("top")).select("doc_id", "line", "top")
    longer, whole = variants.filter("kind = 1"), variants.filter("kind = 2")
    meet = longer.groupBy("variant").agg(F.min(here).alias("least")).join(whole.groupBy("variant").agg(F.min(here).alias("top")), "variant")
    meet = scratch.put(meet, "meet")
    added = longer.join(meet.select("variant", "top"), "variant").filter(here > F.col("top")).select("doc_id", "line", "top")
    left_out = meet.filter("top > least").select("top.doc_id", "top.line", F.col("least").alias("top"))
    doubtful = scratch.put(replaced.unionByName(added).unionByName(left_out).distinct(), "doubtful")

    ends = doubtful.select("doc_id", "line").unionByName(doubtful.select("top.doc_id", "top.line")).distinct()
    ends = scratch.put(ends.groupBy("doc_id").agg(F.collect_list("line").alias("lines")), "ends")
    told = only_ids(texts, ends.select("doc_id"), "doc_id").join(ends, "doc_id").withColumn("all", F.split("text", "\n", -1))
    told = told.select("doc_id", F.explode("lines").alias("line"), "all").select("doc_id", "line", F.get("all", F.col("line")).alias("words"))
    told = scratch.put(told.dropDuplicates(["doc_id", "line"]), "told")
    earlier = told.select(F.struct("doc_id", "line").alias("top"), F.col("words").alias("earlier"))
    near_places = doubtful.join(told, ["doc_id", "line"]).join(earlier, "top").select("doc_id", "line", "words", "earlier").mapInArrow(_verified, "doc_id long, line int")
    out = places.unionByName(near_places)
    out = scratch.put(out.groupBy("doc_id").agg(F.collect_set("line").alias("lines")), "removed")
    scratch.drop("lines", "earliest", "near", "variants", "meet", "doubtful", "ends", "told")
    return out


def remove_repeated_lines(docs: DataFrame, near_words: int = 10) -> DataFrame:
    """``doc_id, n_lines, n_removed, kept`` for every document: its text without the lines that repeat an earlier one."""
    scratch = Scratch(docs.sparkSession, "line-dedup")
    texts = named(docs.select("doc_id", "text"))
    gone = repeated_lines(texts, scratch, near_words)
    ids, out = gone.select("doc_id"), "doc_id long, n_lines long, n_removed long, kept string"
    same = only_ids(texts, ids, "doc_id", "left_anti").select("doc_id", "text", F.lit(None).cast("array<int>").alias("lines")).mapInArrow(_cut, out)
    cut = only_ids(texts, ids, "doc_id").join(gone, "doc_id").select("doc_id", "text", "lines").mapInArrow(_cut, out)
    return unnamed(same.unionByName(cut))
