"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

A mask picks some of a run of neighbouring words and ignores the others. For every place of a text and every mask the picked words are
hashed; equal hashes of a document and a benchmark item line the two up at one offset. At that offset all words of the item are compared,
and the document is contaminated if some stretch of ``window`` item words (all of them, if the item is shorter) has at least ``percent``
per cent equal words. The two default masks meet every stretch of 13 words with two replaced ones. An item shorter than ``window`` has masks
of its own length that meet every set of as many replaced words as it may have.

Words are compared without case (ASCII) and with their punctuation. Hashes decide only which offsets are looked at; the words decide the
result.

Defined results: null and empty texts and items match nothing; of rows repeated under one id any match counts; a null id is left out;
other columns are ignored; an empty table on either side gives an empty table.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litprops.llm.store import Scratch, only_ids

#: Word places that a mask looks at.
MASKS = ((0, 1, 2, 3, 6, 7), (0, 1, 3, 5, 6, 7))
#: Seeds that go to every task at most; with more, both sides are shuffled by seed.
MAX_BROADCAST_SEEDS = 2_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    parts = F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), r"[\x20\x09-\x0D]+")
    return F.filter(parts, lambda w: w != "")


NO_SEEDS = "array<struct<pos:int,seed:bigint>>"


def _seed(w: Column, tag: int, mask):
    return lambda p: F.struct(p.alias("pos"), F.xxhash64(F.lit(tag), *[F.get(w, p + o) for o in mask]).alias("seed"))


def _seeds(column: str, masks) -> Column:
    """All ``pos, seed`` of a word array; texts shorter than a mask have none."""
    n, out = F.size(column), []
    for k, mask in enumerate(masks):
        places = F.sequence(F.lit(0), n - 1 - max(mask))
        out.append(F.when(n > max(mask), F.transform(places, _seed(F.col(column), k, mask))).otherwise(F.array().cast(NO_SEEDS)))
    return F.concat(*out)


def short_masks(length: int, percent: int) -> list[tuple[int, ...]]:
    """Masks over an item of ``length`` words, one of which is clear of every set of words that may be replaced.

    Its places are dealt into two groups more than words may be replaced (as far as there are places); each mask leaves out as many groups
    as words may be replaced.
    """
    replaced = length * (100 - percent) // 100
    groups = min(length, replaced + 2)
    return [tuple(p for p in range(length) if p % groups not in out) for out in combinations(range(groups), replaced)]


def _short_seeds(column: str, length: int, percent: int) -> Column:
    """Seeds of all runs of ``length`` words."""
    n, places = F.size(column), F.sequence(F.lit(0), F.size(column) - length)
    runs = [F.transform(places, _seed(F.col(column), -1000 * length - k, mask)) for k, mask in enumerate(short_masks(length, percent))]
    return F.when(n >= length, F.concat(*runs)).otherwise(F.array().cast(NO_SEEDS))


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 13, percent: int = 80, masks=MASKS) -> DataFrame:
    """``doc_id, item_id, n_matched, n_item``: the largest number of equal words at one offset, for every contaminated pair."""
    scratch = Scratch(docs.sparkSession, "decontaminate")
    texts = docs.select("doc_id", "text").filter("doc_id is not null")
    items = scratch.put(benchmark.select("item_id", words(F.col("text")).alias("item")).filter("item_id is not null and size(item) > 0"), "items")
    short = [r.n for r in items.filter(F.size("item") < window).select(F.size("item").alias("n")).distinct().collect()]
    none = F.array().cast(NO_SEEDS)
    listed = [F.when(F.size("item") >= window, _seeds("item", masks)).otherwise(none)]
    listed += [F.when(F.size("item") == n, _short_seeds("item", n, percent)).otherwise(none) for n in short]
    seeds = items.select("item_id", F.inline(reduce(F.concat, listed))).select("item_id", F.col("pos").alias("item_pos"), "seed")
    seeds = scratch.put(seeds, "seeds")
    few = seeds.limit(MAX_BROADCAST_SEEDS + 1).count() <= MAX_BROADCAST_SEEDS
    split = texts.select("doc_id", words(F.col("text")).alias("w"))
    placed = split.select("doc_id", F.inline(reduce(F.concat, [_seeds("w", masks)] + [_short_seeds("w", n, percent) for n in short])))
    hits = placed.join(F.broadcast(seeds) if few else seeds, "seed").select("doc_id", "item_id", (F.col("pos") - F.col("item_pos")).alias("shift"))
    hits = scratch.put(hits.distinct(), "hits")

    looked = only_ids(texts, hits.select("doc_id").distinct(), "doc_id").select("doc_id", words(F.col("text")).alias("w"))
    pairs = hits.join(items, "item_id").join(looked, "doc_id")  # a text that is hit at many offsets is not shuffled once for each
    lo, hi = F.greatest(F.lit(0), -F.col("shift")), F.least(F.size("item"), F.size("w") - F.col("shift"))
    same = F.transform(F.sequence(lo, hi - 1), lambda p: (F.get("item", p) == F.get("w", p + F.col("shift"))).cast("int"))
    size = F.least(F.lit(window), F.size("item"))
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    judged = pairs.filter(hi - lo >= size).select("doc_id", "item_id", F.size("item").alias("n_item"), size.alias("size"), same.alias("same"))
    dense = F.exists(F.sequence(F.lit(1), F.size("same") - F.col("size") + 1), lambda s: 100 * total(F.slice("same", s, F.col("size"))) >= percent * F.col("size"))
    found = judged.filter(dense).groupBy("doc_id", "item_id").agg(F.max(total(F.col("same"))).cast("long").alias("n_matched"), F.max("n_item").cast("long").alias("n_item"))
    found = scratch.put(found, "found")
    scratch.drop("items", "seeds", "hits")
    return found
