"""Files that hold one JSON array of objects, read by many tasks.

A JSON array has no record separator, so where a byte range starts is not known: inside a string or not, and how deep. Both are prefix sums. The
text source cuts files into splits and splits into segments at ``}``; an object ends behind a ``}`` outside strings where the depth is back at 1, and
the number of ends before it is its position. A task walks its splits once, in order, and puts segments together to chunks of at most
:data:`CHUNK` bytes. Whether a split starts inside a string, and how deep, is open then, so a chunk lists the ends of objects for both states and
each depth. The splits' totals, a few hundred rows for a large file, give the state, depth and position at which each split starts, and so the list
that holds.

Splits are settled once, so every step sees the same ones, and no segment is shuffled, sorted or kept: each step reads the files again. Only the
first and last piece of a chunk, which may cross its border, are put together by a shuffle. An object is bounded by VARIANT's size, a file by nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from litprops.functions.text import let
from litprops.functions.variants import json_array
from litprops.operators.spread import attach_small

CHUNK = 1 << 18  # bytes of a chunk, unless one segment is longer
_DEEPEST = 1100  # an object with more open levels is broken anyway: Spark's JSON parser stops at 1000
_QUOTE, _BACKSLASH, _BRACE = b'"\\}'
_STEP = np.zeros(256, np.int64)
_STEP[list(b"[{")], _STEP[list(b"]}")] = 1, -1
_SIGN = (_STEP != 0) | (np.arange(256) == _QUOTE)

_BLANK = r"[ \t\r\n]*+"
_KINDS = "file string, name string, size bigint, block bigint, chunk bigint, last boolean, text binary, bytes bigint, odd bigint, " + ", ".join(
    f"depth{s} bigint, seen{s} array<bigint>, ends{s} array<array<int>>" for s in (0, 1)
)
_ARROW = [pa.string(), pa.string(), *[pa.int64()] * 3, pa.bool_(), pa.binary(), *[pa.int64()] * 2, *[pa.int64(), pa.list_(pa.int64()), pa.list_(pa.list_(pa.int32()))] * 2]


def _signs(data: np.ndarray) -> np.ndarray:
    """Places of the quotes and brackets that no backslash hides; the brace that closes a segment is never hidden."""
    at = np.flatnonzero(_SIGN[data])
    back = np.flatnonzero(data == _BACKSLASH)
    if not len(back):
        return at
    k = np.arange(len(back))
    run = np.maximum.accumulate(np.where(np.diff(back, prepend=-2) > 1, k, 0))
    hidden = np.zeros(len(data) + 1, bool)
    hidden[back[(k - run) % 2 == 0] + 1] = True
    return at[~hidden[at] | (data[at] == _BRACE)]


class _Split:
    """A split up to some place: bytes and quotes (even or odd), and for both states of its start the depth relative to the start, and the
    number of objects that end if the start is ``b`` deep, by ``b``."""

    def __init__(self):
        self.chunks, self.bytes, self.odd, self.depth, self.seen = 0, 0, 0, [0, 0], [np.zeros(0, np.int64)] * 2

    def row(self, key: tuple, text: np.ndarray | None) -> pa.RecordBatch:
        """The chunk with what is before it, and goes on behind it. Without a chunk: what the whole split comes to."""
        odd, depth, seen = self.odd, self.depth, self.seen
        known = [*key, self.chunks, text is None, None if text is None else text.tobytes(), self.bytes, odd]
        ends = [None, None] if text is None else self._add(text)
        values = [*known, depth[0], seen[0], ends[0], depth[1], seen[1], ends[1]]
        return pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(values, _ARROW)], names=[x.split()[0] for x in _KINDS.split(", ")])

    def _add(self, data: np.ndarray) -> list[list[np.ndarray]]:
        """For both states the places behind the ends of objects, by the depth of the split's start."""
        at = _signs(data)
        sign = data[at]
        quote = sign == _QUOTE
        odd = (np.cumsum(quote) - quote + self.odd) & 1
        ends, depth, seen = [], [], []
        for state in (0, 1):
            outside = odd == state
            level = self.depth[state] + np.cumsum(np.where(outside, _STEP[sign], 0))
            start = 1 - level  # how deep the split's start is if an object ends here
            mark = outside & (sign == _BRACE) & (start >= 0) & (start < _DEEPEST)
            start, behind = start[mark], (at[mark] + 1).astype(np.int32)
            counts = np.bincount(start, minlength=len(self.seen[state]))
            ends.append(np.split(behind[np.argsort(start, kind="stable")], np.cumsum(counts)[:-1]) if len(counts) else [])
            seen.append(counts + np.pad(self.seen[state], (0, len(counts) - len(self.seen[state]))))
            depth.append(int(level[-1]))
        self.chunks, self.bytes, self.odd, self.depth, self.seen = self.chunks + 1, self.bytes + len(data), (self.odd + int(quote.sum())) & 1, depth, seen
        return ends


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The chunks of each split in order, and behind them what the split comes to."""
    key, split = None, _Split()
    for part in batches:
        n, file, text = part.num_rows, part.column(0), part.column(4)
        if not n:
            continue
        _, offsets, data = text.buffers()
        offsets = np.frombuffer(offsets, np.int64 if pa.types.is_large_string(text.type) else np.int32)[text.offset : text.offset + n + 1]
        data = np.frombuffer(data, np.uint8)
        other = (np.diff(part.column(3).to_numpy()) != 0) | pc.not_equal(file.slice(1), file.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        borders = [0, *(np.flatnonzero(other) + 1).tolist(), n]
        for a, b in zip(borders, borders[1:]):
            here = tuple(part.column(i)[a].as_py() for i in range(4))
            if here != key:
                if key:
                    yield split.row(key, None)
                key, split = here, _Split()
            while a < b:
                to = min(b, max(a + 1, int(np.searchsorted(offsets, offsets[a] + CHUNK, "right")) - 1))
                yield split.row(key, data[offsets[a] : offsets[to]])
                a = to
    if key:
        yield split.row(key, None)


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks, each segment's closing brace included, and one row without a chunk for each split. The last segment of a file gets a brace that is
    not there."""
    rows = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_size").alias("size"),
        F.col("_metadata.file_block_start").alias("block"), F.concat("value", F.lit("}")).alias("text"),
    )
    chunks = rows.mapInArrow(_cut, _KINDS)._jdf
    fixed = spark._jsparkSession.createDataFrame(chunks.toJavaRDD(), chunks.schema())  # another plan could cut files differently
    return DataFrame(fixed, spark)


def _of(what: str) -> Column:
    """What holds for the state at the split's start."""
    return F.when(F.col("inside") == 0, F.col(f"{what}0")).otherwise(F.col(f"{what}1"))


def _at_base(what: str) -> Column:
    return F.get(_of(what), F.when(F.col("base").between(0, _DEEPEST), F.col("base").cast("int")))


def _placed(spark: SparkSession, path: str) -> DataFrame:
    """Chunks with ``cuts`` (places behind the ends of the array's objects) and ``number`` (objects that end before, in the whole file)."""
    chunks = _chunks(spark, path)
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file")
    starts = chunks.filter("last").withColumn("inside", F.coalesce(F.sum("odd").over(earlier), F.lit(0)) % 2).withColumn("total", _of("depth"))
    starts = starts.withColumn("base", F.coalesce(F.sum("total").over(earlier), F.lit(0))).withColumn("n", F.coalesce(_at_base("seen"), F.lit(0)))
    # the array is closed, no string is open, and the file does not end with the brace that was added
    sound = (F.sum("total").over(whole) == -1) & (F.sum("odd").over(whole) % 2 == 0) & ~(F.col("size") - F.sum("bytes").over(whole)).isin(0, 3)
    starts = starts.select("file", "block", "inside", "base", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"), sound.alias("sound"))

    rows = attach_small(chunks.filter("not last"), starts, ["file", "block"], "inner").filter(_or_broken(F.col("sound"), F.col("file")))
    cuts = F.coalesce(_at_base("ends"), F.array().cast("array<int>"))
    return rows.select("file", "name", "block", "chunk", "text", cuts.alias("cuts"), (F.col("first") + F.coalesce(_at_base("seen"), F.lit(0))).alias("number"))


def _or_broken(good: Column, file: Column) -> Column:
    """True, or an error that names the file; for filters, which are never pruned."""
    return F.when(F.coalesce(good, F.lit(False)), True).otherwise(F.raise_error(F.concat(F.lit("not a JSON array of objects: "), file)).cast("boolean"))


def read_json_arrays(spark: SparkSession, path: str) -> DataFrame:
    """``file, name, position, entry`` (VARIANT) of every object of every file. A file that is not one JSON array of objects is an error that
    names it; Spark skips files of no bytes."""
    chunks, n, size = _placed(spark, path), F.size("cuts"), F.length("text")
    piece = lambda number, ends, t, start, stop: F.struct(number.alias("number"), ends.alias("ends"), F.substring(t, start + 1, stop - start).cast("string").alias("text"))
    cut, number, none = (lambda k: F.get("cuts", k)), F.col("number"), F.lit(0)
    # let: a row's binary value is copied whole each time it is asked for
    inner = let(F.col("text"), lambda t: F.transform(F.sequence(F.lit(1), n - 1), lambda k: piece(number + k, F.lit(True), t, cut(k - 1), cut(k))))
    objects = chunks.filter(n > 1).select("file", "name", F.inline(inner))
    outer = lambda t: F.array(piece(number, n > 0, t, none, F.coalesce(cut(none), size)), F.when(cut(n - 1) < size, piece(number + n, F.lit(False), t, cut(n - 1), size)))
    border = chunks.select("file", "name", "block", "chunk", F.inline(F.array_compact(let(F.col("text"), outer))))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "chunk", "text"))), lambda s: s["text"]), "")
    border = border.groupBy("file", "number").agg(F.first("name").alias("name"), F.max("ends").alias("ends"), joined.alias("text"))
    objects = objects.unionByName(border)
    first = F.col("number") == 0
    tail = F.when(first, F.col("text").rlike(rf"\A{_BLANK}\[{_BLANK}\]{_BLANK}\}}\z")).otherwise(F.col("text").rlike(rf"\A{_BLANK}\]{_BLANK}\}}\z"))
    opened = F.when(first, F.col("text").rlike(rf"\A{_BLANK}\[{_BLANK}\{{")).otherwise(F.col("text").rlike(rf"\A{_BLANK},{_BLANK}\{{"))
    objects = objects.filter(_or_broken(F.when(F.col("ends"), opened).otherwise(tail), F.col("file"))).filter("ends")
    alone = F.concat(F.lit("["), F.regexp_replace("text", rf"\A{_BLANK}[\[,]", ""), F.lit("]"))
    parsed = objects.withColumn("entry", F.get(json_array(alone), F.lit(0))).filter(_or_broken(F.col("entry").isNotNull(), F.col("file")))
    return parsed.select("file", "name", F.col("number").cast("bigint").alias("position"), "entry")
