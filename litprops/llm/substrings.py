"""Substring dedup with suffix automata: remove words of passages that also start earlier in the corpus.

The reference of every document is all that stands before it, which no task can hold. So the reference is dealt into shards in which equal
passages are sure to meet, and each shard gets its own automaton:

1. Every window of ``size`` words has an anchor, the ten-word sequence in it with the least hash. Consecutive windows with one anchor are a
   segment. Equal windows have equal anchors.
2. Inside a batch equal segments are kept once, the others are marked; so a passage that very many documents share travels once per batch.
   The rest meet by anchor: a segment equal to an earlier one is marked whole, and anchors with a single segment are done.
3. Where different segments share an anchor, their words are fetched. The segments of a shard go through a suffix automaton in corpus
   order: matching statistics against all earlier ones mark each window of ``size`` matched words, then the segment is added. An anchor
   with very many different segments is dealt out further, window by window, by the hash of the window, and of equal windows in a batch
   only the earliest goes there.
4. Marked windows go to their documents and the words under them are cut.

Words are compared as 64-bit hashes; a window counts as equal if anchor and all its word hashes are.

Defined results: null, empty or short text keeps all its words and has nothing removed; a document never counts as earlier than itself at
the same start, so rows repeated under one id are treated alike; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litprops.llm.store import Scratch, named, only_ids, unnamed
from litprops.llm.words import STEP, _power, batches, mix, window_hashes, word_hashes

ANCHOR = 10
#: Anchors with more different segments than this are dealt out by window.
CROWDED = 1000
_Q = int(STEP[40])
_QINV = pow(_Q, -1, 1 << 64)


def segments(first: np.ndarray, words: np.ndarray, size: int):
    """``row, start, windows, anchor, key`` of all segments; ``key`` is the hash of a segment's words."""
    windows = len(words) - size + 1
    if windows <= 0:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    grams = window_hashes(words, ANCHOR)
    reach = size - ANCHOR + 1
    at = np.arange(windows) + np.lib.stride_tricks.sliding_window_view(grams, reach)[:windows].argmin(axis=1)
    row = np.searchsorted(first, np.arange(len(words)), "right") - 1
    good = row[:windows] == row[size - 1 :]
    new = np.concatenate(([True], (at[1:] != at[:-1]) | (row[1:windows] != row[: windows - 1]) | (good[1:] != good[:-1])))
    start = np.flatnonzero(new)
    count = np.diff(np.concatenate((start, [windows])))
    start, count = start[good[start]], count[good[start]]
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * _power(_Q, len(words))[: len(words)], out=total[1:])
    key = mix((total[start + count + size - 1] - total[start]) * _power(_QINV, len(words))[start] + count.astype(np.uint64))
    return row[start], start - first[row[start]], count, grams[at[start]], key


def _deal(size: int):
    def run(iterator):
        for part in iterator:
            seen = {k: [] for k in ("doc", "start", "n", "anchor", "key")}
            for piece in batches([part], rows=1 << 30, size=2 << 20):
                first, words = word_hashes(piece.column(1))
                row, start, n, anchor, key = segments(first, words, size)
                ids = piece.column(0).to_numpy()
                for name, value in zip(seen, (ids[row], start, n, anchor, key)):
                    seen[name].append(value)
            doc, start, n, anchor, key = (np.concatenate(v) if v else np.empty(0, np.int64) for v in seen.values())
            order = np.lexsort((start, doc, key, anchor))
            doc, start, n, anchor, key = (v[order] for v in (doc, start, n, anchor, key))
            new = np.ones(len(doc), bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (key[1:] != key[:-1])
            head = np.flatnonzero(new)[np.cumsum(new) - 1] if len(doc) else np.empty(0, np.int64)
            later = ~((doc == doc[head]) & (start == start[head]))
            for lo in range(0, len(doc), 500_000):
                cut = slice(lo, lo + 500_000)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(doc[cut].astype(np.int64)),
                        pa.array(start[cut].astype(np.int32)),
                        pa.array(n[cut].astype(np.int32)),
                        pa.array(anchor[cut].view(np.int64)),
                        pa.array(key[cut].view(np.int64)),
                        pa.array(later[cut]),
                    ],
                    names=["doc_id", "start", "n", "anchor", "key", "later"],
                )

    return run


def _fetch(size: int):
    """Words of the listed segments; crowded ones window by window under the window's hash.

    Of equal crowded windows in a batch the earliest is kept, the others come without words as ``again``, under any shard.
    """

    def run(iterator):
        for part in iterator:
            earliest: dict[int, tuple[int, int]] = {}
            for piece in batches([part], rows=500):
                shard, doc, at, got, again = [], [], [], [], []
                first, words = word_hashes(piece.column(1))
                grams = window_hashes(words, size).view(np.int64)
                for i, (d, items) in enumerate(zip(piece.column(0).to_pylist(), piece.column(2).to_pylist())):
                    for s in items:
                        lo = int(first[i]) + s["start"]
                        if not s["crowded"]:
                            shard.append(s["anchor"])
                            doc.append(d)
                            at.append(s["start"])
                            got.append(words[lo : lo + s["n"] + size - 1].view(np.int64))
                            again.append(False)
                            continue
                        for k, gram in enumerate(grams[lo : lo + s["n"]].tolist()):
                            here = (d, s["start"] + k)
                            later = here > earliest.setdefault(gram, here)
                            earliest[gram] = min(here, earliest[gram])
                            shard.append(hash(here) if later else gram)
                            doc.append(d)
                            at.append(here[1])
                            got.append(words[:0].view(np.int64) if later else words[lo + k : lo + k + size].view(np.int64))
                            again.append(later)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard, pa.int64()), pa.array(doc, pa.int64()), pa.array(at, pa.int32()), pa.array(got, pa.list_(pa.int64())), pa.array(again, pa.bool_())],
                    names=["shard", "doc_id", "start", "words", "again"],
                )

    return run


class SuffixAutomaton:
    """Suffix automaton of a set of word sequences that grows one sequence at a time."""

    def __init__(self):
        self.next, self.link, self.length = [{}], [-1], [0]

    def _state(self, length: int, link: int, moves: dict) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, q: int, word) -> int:
        """A copy of ``q`` for the strings that reach it through ``p`` by ``word`` and are no longer than that."""
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def add(self, sequence) -> None:
        last = 0
        for word in sequence:
            q = self.next[last].get(word)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, q, word)
                continue
            new, p = self._state(self.length[last] + 1, 0, {}), last
            while p >= 0 and word not in self.next[p]:
                self.next[p][word] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][word]
                self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, word)
            last = new

    def matches(self, sequence) -> list[int]:
        """Matching statistics: at each word, how many words up to it stand in some added sequence."""
        out, state, length = [], 0, 0
        for word in sequence:
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if word in self.next[state]:
                state, length = self.next[state][word], length + 1
            out.append(length)
        return out


def _match(size: int):
    """Over segments sorted by shard and corpus order: windows that an earlier segment of the shard holds."""

    def run(iterator):
        shard, machine, same = None, None, None
        for batch in iterator:
            docs, starts = [], []
            for key, doc, start, words, again in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if again:
                    docs.append(doc)
                    starts.append(start)
                    continue
                if key != shard:
                    shard, machine, same = key, SuffixAutomaton(), None
                if (doc, start) != same:  # a row repeated under one id is no earlier than itself
                    found = machine.matches(words) if same else []
                    machine.add(words)
                    same = (doc, start)
                    for end, length in enumerate(found):
                        if length >= size:
                            docs.append(doc)
                            starts.append(start + end - size + 1)
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(starts, pa.int32())], names=["doc_id", "start"])

    return run


def _cut(size: int):
    """Texts without the words under the marked windows."""

    def run(iterator):
        for piece in batches(iterator):
            total, gone, kept = [], [], []
            for text, marks in zip(piece.column(1).to_pylist(), piece.column(2).to_pylist()):
                words = (text or "").encode().split()
                total.append(len(words))
                if marks:
                    edge = np.zeros(len(words) + 1, np.int64)
                    marks = np.array([(m["start"], m["n"]) for m in marks])
                    np.add.at(edge, marks[:, 0], 1)
                    np.add.at(edge, np.minimum(marks[:, 0] + marks[:, 1] + size - 1, len(words)), -1)
                    stay = np.cumsum(edge[:-1]) == 0
                    words = [w for w, s in zip(words, stay.tolist()) if s]
                gone.append(total[-1] - len(words))
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return run


def remove_repeated_passages(docs: DataFrame, size: int = 20) -> DataFrame:
    """``doc_id, n_words, n_removed, kept``: each text without the words of windows that also start earlier."""
    scratch = Scratch(docs.sparkSession, "substrings")
    texts = named(docs.select("doc_id", "text"))
    dealt = texts.mapInArrow(_deal(size), "doc_id long, start int, n int, anchor long, key long, later boolean")
    fresh, here = dealt.filter("not later"), F.struct("doc_id", "start")
    busy = fresh.groupBy("anchor").agg(F.min("key").alias("k0"), F.max("key").alias("k1"), F.count("*").alias("c")).filter("c > 1")
    busy = scratch.put(busy.select("anchor", (F.col("k0") < F.col("k1")).alias("mixed")), "busy")
    rows = scratch.put(fresh.drop("later").join(busy, "anchor"), "rows")
    earliest = scratch.put(rows.groupBy("anchor", "key").agg(F.min(here).alias("top"), F.count("*").alias("c")).filter("c > 1"), "earliest")
    kinds = rows.groupBy("anchor", "key").agg(F.lit(1).alias("x")).groupBy("anchor").agg(F.count("*").alias("kinds"))
    crowded = scratch.put(kinds.filter(F.col("kinds") > CROWDED).select("anchor", F.lit(True).alias("crowded")), "crowded")
    met = (
        rows.join(earliest.select("anchor", "key", "top"), ["anchor", "key"], "left")
        .join(crowded, "anchor", "left")
        .select("doc_id", "start", "n", "anchor", F.coalesce(here > F.col("top"), F.lit(False)).alias("again"), F.coalesce("crowded", F.lit(False)).alias("crowded"), "mixed")
        .filter("again or mixed")
        .drop("mixed")
    )
    met = scratch.put(met, "met")
    scratch.drop("busy", "rows", "earliest", "crowded")
    later = scratch.put(dealt.filter("later").select("doc_id", "start", "n"), "later")

    open_ = scratch.put(
        met.filter("not again").groupBy("doc_id").agg(F.collect_list(F.struct("start", "n", "anchor", "crowded")).alias("items")), "open"
    )
    fetched = only_ids(texts, open_.select("doc_id"), "doc_id").join(open_, "doc_id").select("doc_id", "text", "items")
    shards = fetched.mapInArrow(_fetch(size), "shard long, doc_id long, start int, words array<long>, again boolean")
    matched = shards.repartition("shard").sortWithinPartitions("shard", "doc_id", "start").mapInArrow(_match(size), "doc_id long, start int")
    marks = met.filter("again").select("doc_id", "start", "n").unionByName(later).unionByName(matched.select("doc_id", "start", F.lit(1).alias("n")))
    marks = scratch.put(marks.groupBy("doc_id").agg(F.collect_set(F.struct("start", "n")).alias("marks")), "marks")
    scratch.drop("met", "later", "open")

    hit = marks.select("doc_id")
    out = "doc_id long, n_words long, n_removed long, kept string"
    none = F.lit(None).cast("array<struct<start:int,n:int>>").alias("marks")
    clean = only_ids(texts, hit, "doc_id", "left_anti").select("doc_id", "text", none).mapInArrow(_cut(size), out)
    cut = only_ids(texts, hit, "doc_id").join(marks, "doc_id").select("doc_id", "text", "marks").mapInArrow(_cut(size), out)
    return unnamed(clean.unionByName(cut))
