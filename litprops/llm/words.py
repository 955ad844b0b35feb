"""Words of whole Arrow batches as 64-bit hashes, without one Python object per word.

A word is a run of bytes other than ``\\x20`` and ``\\x09-\\x0D``. Its hash is a polynomial over random byte values, worked out for all words
of a block from one running sum, then mixed. A block holds at most :data:`BLOCK` bytes and ends at white space; so memory follows the
block and not the text.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa

BLOCK = 1 << 19
_rng = np.random.Generator(np.random.PCG64(20240131))
_TABLE = _rng.integers(1, 1 << 64, 256, dtype=np.uint64)
_LOWER = _TABLE.copy()
_LOWER[65:91] = _TABLE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_P = int(_rng.integers(1 << 62, 1 << 63, dtype=np.uint64)) | 5
_PINV = pow(_P, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}
#: Odd multipliers for sequences of word hashes.
STEP = _rng.integers(1 << 62, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        p = np.full(max(n, BLOCK // 4), base, np.uint64)
        p[0] = 1
        have = _powers[base] = np.cumprod(p, dtype=np.uint64)
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit over all others."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    n = len(column)
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.empty(0, np.uint8)
    return data, offsets


def _cuts(data: np.ndarray, offsets: np.ndarray):
    """Blocks of whole rows; a longer row is cut after white space."""
    at, end = int(offsets[0]), int(offsets[-1])
    while at < end:
        to = min(end, at + BLOCK)
        if to < end:
            row = int(offsets[np.searchsorted(offsets, to, "right") - 1])
            if row > at:
                to = row
            else:
                stop = int(offsets[np.searchsorted(offsets, at, "right")])
                look = to
                while look < stop and not _SPACE[data[look]]:  # a word that crosses the border; words are short, or the row is one word
                    hit = np.flatnonzero(_SPACE[data[look : min(stop, look + BLOCK)]])
                    look = look + int(hit[0]) if len(hit) else min(stop, look + BLOCK)
                to = min(look, stop)
        yield at, to
        at = to


def word_hashes(column: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """``(first, hashes)``: row ``i`` has the word hashes ``hashes[first[i]:first[i + 1]]``."""
    data, offsets = buffers(column)
    rows = len(offsets) - 1
    table, counts, parts = _LOWER if lower else _TABLE, np.zeros(rows, np.int64), []
    for at, to in _cuts(data, offsets):
        block = data[at:to]
        space = _SPACE[block]
        edge = np.zeros(len(block) + 1, bool)  # a row starts here
        inner = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, to, "right")] - at
        edge[inner] = True
        edge[0] = edge[-1] = True
        start = ~space
        stop = start.copy()
        start[1:] &= space[:-1] | edge[1:-1]
        stop[:-1] &= space[1:] | edge[1:-1]
        start, stop = np.flatnonzero(start), np.flatnonzero(stop) + 1
        if not len(start):
            continue
        total = np.empty(len(block) + 1, np.uint64)
        total[0] = 0
        np.cumsum(table[block] * _power(_P, len(block))[: len(block)], out=total[1:])
        parts.append(mix((total[stop] - total[start]) * _power(_PINV, len(block))[start]))
        counts += np.bincount(np.searchsorted(offsets, start + at, "right") - 1, minlength=rows)[:rows]
    first = np.zeros(rows + 1, np.int64)
    np.cumsum(counts, out=first[1:])
    return first, np.concatenate(parts) if parts else np.empty(0, np.uint64)


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every ``size`` consecutive words; windows that cross a row's end are the caller's to leave out."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total += hashes[k : k + n] * STEP[k]
    return mix(total)


_malloc_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc; elsewhere nothing is trimmed


def release() -> None:
    """Hand freed memory back to the system. Spark keeps its Python workers from stage to stage, so what they hold adds up."""
    pa.default_memory_pool().release_unused()
    if _malloc_trim is not None:
        _malloc_trim(0)


def batches(iterator, rows: int = 2000, size: int = 4 << 20):
    """Cut record batches so that a part has at most ``rows`` rows and, where rows allow, ``size`` bytes."""
    for batch in iterator:
        step = max(1, min(rows, int(batch.num_rows * size / max(1, batch.nbytes))))
        for i in range(0, batch.num_rows, step):
            yield batch.slice(i, step)
        release()
