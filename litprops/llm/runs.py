"""Periodic runs of words, found with a suffix automaton and link-cut access, and texts with the repetitions taken out.

A run is a stretch of consecutive words with smallest period ``q`` (words ``q`` apart are equal), at least ``min_words`` words and
``min_exponent`` periods long, that no neighbouring word extends. Steps, all inside one document:

1. Every run lies in a stretch of positions whose window of ``min_words // min_exponent`` words occurs at least twice in the document: a window
   of a run stands one period earlier or later as well. Windows of a whole batch are hashed and sorted at once, and only such stretches go on;
   equal hashes of different windows can add a stretch, never lose one.
2. The stretch gets a suffix automaton. Its words are appended one by one: position ``i`` accesses the state of the prefix that ends there, as
   in a link-cut tree, which gives the whole path to the root the colour ``i``, its last occurrence. The path falls into segments of one old
   colour. A segment with old colour ``e`` and longest word sequence ``m`` says that the last ``m`` words before ``i`` also end at ``e``; where
   ``i - e <= m``, the last ``2 (i - e)`` words are a square.
3. A square that lies in no run found before is extended to both sides as far as its period holds, which gives the run. Squares found this
   way have a root without a smaller period, so each run comes with its smallest period.

Segments change ``O(n log n)`` times for ``n`` words, so a document that is one long repetition costs no more than any other. Words are
compared whole in steps 2 and 3.

Defined results: a null or empty text has no words, no runs and an empty ``kept``; a null id is kept; repeated rows each give a row; other
columns are ignored; an empty table gives an empty table. One document's repeated part is held by one task (about 0.7 KB a word).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litprops.llm.words import STEP, batches, mix, window_hashes, word_hashes

MIN_WORDS, MIN_EXPONENT = 24, 3
RUN = "struct<start:bigint,length:bigint,period:bigint>"


def suffix_automaton(symbols: list) -> tuple[list[int], list[int], list[int]]:
    """``(link, size, ends)``: suffix link and longest sequence of every state, and the state of every prefix."""
    link, size, step, ends, last = [-1], [0], [{}], [], 0
    for c in symbols:
        new = len(link)
        link.append(0)
        size.append(size[last] + 1)
        step.append({})
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if size[p] + 1 == size[q]:
                link[new] = q
            else:
                twin = len(link)
                link.append(link[q])
                size.append(size[p] + 1)
                step.append(step[q].copy())
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
        ends.append(new)
    return link, size, ends


class LastOccurrence:
    """Link-cut access over a tree of suffix links: preferred paths are splay trees, each of one colour, kept at its root."""

    def __init__(self, link: list[int], size: list[int]):
        self.up, self.size = list(link), size
        self.left, self.right, self.colour = [-1] * len(link), [-1] * len(link), [-1] * len(link)

    def _rotate(self, x: int) -> None:
        up, left, right = self.up, self.left, self.right
        p = up[x]
        g = up[p]
        if left[p] == x:
            inner = left[p] = right[x]
            right[x] = p
        else:
            inner = right[p] = left[x]
            left[x] = p
        if inner >= 0:
            up[inner] = p
        if g >= 0:
            if left[g] == p:
                left[g] = x
            elif right[g] == p:
                right[g] = x
        up[p], up[x] = x, g

    def _splay(self, x: int) -> None:
        up, left, right = self.up, self.left, self.right
        top = x
        while (p := up[top]) >= 0 and (left[p] == top or right[p] == top):
            top = p
        if top == x:
            return
        colour = self.colour[top]
        while (p := up[x]) >= 0 and (left[p] == x or right[p] == x):
            g = up[p]
            if g >= 0 and (left[g] == p or right[g] == p):
                self._rotate(p if (left[g] == p) == (left[p] == x) else x)
            self._rotate(x)
        self.colour[x] = colour

    def access(self, state: int, now: int) -> list[tuple[int, int]]:
        """Colour the path from ``state`` to the root; the ``(old colour, longest sequence)`` of its segments, longest first."""
        segments, below, x = [], -1, state
        while x >= 0:
            self._splay(x)
            old = self.colour[x]
            if old >= 0:
                segments.append((old, self.size[x]))
            rest = self.right[x]
            if rest >= 0:
                self.colour[rest] = old
            self.right[x] = below
            below, x = x, self.up[x]
        self.colour[below] = now
        self._splay(state)
        return segments


def _extent(s: list, at: int, period: int, by: int) -> int:
    """How many words beyond ``at``, in direction ``by``, equal the word one period back; compared in blocks that double."""
    n, block = 0, 8
    while True:
        if by > 0:
            a, b = s[at + n : at + n + block], s[at + n - period : at + n - period + block]
            b = b[: len(a)]
        else:
            lo = max(0, at - n - block + 1)
            a, b = s[lo : at - n + 1], s[lo + period : at - n + 1 + period]
        if a != b:
            pairs = zip(a, b) if by > 0 else zip(reversed(a), reversed(b))
            return n + next(i for i, (x, y) in enumerate(pairs) if x != y)
        if len(a) < block:
            return n + len(a)
        n, block = n + block, block * 2


def runs_of(symbols: list, min_words: int = MIN_WORDS, min_exponent: int = MIN_EXPONENT) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of every run, by start and period."""
    link, size, ends = suffix_automaton(symbols)
    tree, seen, out = LastOccurrence(link, size), {}, []
    for i, state in enumerate(ends):
        for e, longest in tree.access(state, i):
            q = i - e
            if q <= longest and seen.get(q, -1) < i:
                end = i + _extent(symbols, i + 1, q, 1)
                start = i - 2 * q + 1
                start -= _extent(symbols, start - 1, q, -1)
                seen[q] = end
                length = end - start + 1
                if length >= min_words and length >= min_exponent * q:
                    out.append((start, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def _stretches(hashes: np.ndarray, first: np.ndarray, window: int, least: int) -> list[list[tuple[int, int]]]:
    """Per row the stretches ``(from, to)`` of words, at least ``least`` long, whose windows all occur twice or more in the row."""
    rows = [[] for _ in range(len(first) - 1)]
    keys = window_hashes(hashes, window)
    if not len(keys):
        return rows
    row = np.searchsorted(first, np.arange(len(keys)), "right") - 1
    inside = np.arange(len(keys)) + window <= first[row + 1]
    at = np.flatnonzero(inside)
    keys = mix(keys[at] ^ (row[at].astype(np.uint64) * STEP[40]))
    order = np.argsort(keys)
    equal = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(hashes) + 1, np.int8)
    hit = np.zeros(len(at), bool)
    hit[order[1:]] |= equal
    hit[order[:-1]] |= equal
    twice[at[hit]] = 1
    # a row's last windows cross its end and are never marked, so marked positions of two rows never touch
    edge = np.diff(np.concatenate(([0], twice)))
    for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
        if b - a + window - 1 >= least:
            r = int(row[a])
            rows[r].append((a - int(first[r]), b + window - 1 - int(first[r])))
    return rows


def collapse_runs(
    docs: DataFrame, min_words: int = MIN_WORDS, min_exponent: int = MIN_EXPONENT, reorder: Callable[[int | None, int], np.ndarray | None] | None = None
) -> DataFrame:
    """``doc_id, n_words, runs, kept``: all runs of a document by start and period, and its words, joined by one blank, without those that a run
    holds beyond its first period. ``reorder(doc_id, n)`` may name the words, by their places, that take the place of the ``n`` of a text."""
    window = min_words // min_exponent
    if window < 2 or min_exponent < 2:
        raise ValueError("a run needs at least two periods, and min_words at least twice min_exponent")

    def run(iterator):
        for part in batches(iterator):
            ids, texts = part.column(0).to_pylist(), part.column(1).fill_null("")
            first, hashes = word_hashes(texts)
            counts = np.diff(first)
            places = [reorder(i, int(n)) if reorder and n else None for i, n in zip(ids, counts)]
            for r, p in enumerate(places):
                if p is not None:
                    hashes[first[r] : first[r + 1]] = hashes[first[r] : first[r + 1]][p]
            found, kept = [], []
            for r, (data, stretches) in enumerate(zip(texts.cast(pa.binary()).to_pylist(), _stretches(hashes, first, window, min_words))):
                words = data.split()
                if places[r] is not None:
                    words = [words[k] for k in places[r].tolist()]
                runs = []
                for a, b in stretches:
                    number = {}
                    runs += [(a + s, n, q) for s, n, q in runs_of([number.setdefault(w, len(number)) for w in words[a:b]], min_words, min_exponent)]
                if runs:
                    keep = np.ones(len(words), bool)
                    for s, n, q in runs:
                        keep[s + q : s + n] = False
                    words = [words[k] for k in np.flatnonzero(keep).tolist()]
                found.append([{"start": s, "length": n, "period": q} for s, n, q in runs])
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0), pa.array(counts, pa.int64()),
                    pa.array(found, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), pa.array(kept, pa.binary()).cast(pa.string()),
                ],
                names=["doc_id", "n_words", "runs", "kept"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, n_words long, runs array<{RUN}>, kept string")
