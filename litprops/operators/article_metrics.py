"""Article-aware scores and losses."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litprops.operators.spread import contiguous_index, lookup_join, null_safe_join

LOSSES = ("mse", "consistency", "bias", "ranking")
BLOCKS = 8  # blocks that a large article is cut into
MOST_BLOCK = 65_536  # rows of a block (1 MB), which bounds a cell's memory; larger articles get more blocks
TASK_PAIRS = 2 * 10**10  # pairs that a task may score, about half a minute
_NEAR, _STRIP, _WIDTH = 10.0, 32, 512  # a product of 32 factors up to 1 + e^10 is far inside a double; columns scored at once


def article_ranges(train: DataFrame, by: Sequence[str], y: str = "y") -> DataFrame:
    """Smallest and largest training target per article."""
    return train.groupBy(*by).agg(F.min(y).alias("lo"), F.max(y).alias("hi"))


def in_range_rows(preds: DataFrame, ranges: DataFrame, by: Sequence[str], p: str = "p") -> DataFrame:
    """Predictions whose article has a real training range, with ``hit`` and the Gaussian range ``score``."""
    real = ranges.filter(F.col("lo") < F.col("hi"))
    mid = (F.col("lo") + F.col("hi")) / 2.0
    half = (F.col("hi") - F.col("lo")) / 2.0
    return (
        lookup_join(preds, real, by, "inner")
        .withColumn("hit", F.col(p).between(F.col("lo"), F.col("hi")).cast("int"))
        .withColumn("score", F.exp(-((F.col(p) - mid) * (F.col(p) - mid)) / (2.0 * half * half)))
    )


def range_scores(preds: DataFrame, ranges: DataFrame, on: Sequence[str], by: Sequence[str] = (), p: str = "p") -> DataFrame:
    """Hit rate and normalised article range score (NARS); NaN when no prediction is eligible."""
    nan = F.lit(float("nan"))
    return in_range_rows(preds, ranges, on, p).groupBy(*by).agg(
        F.count(F.lit(1)).alias("eligible"),
        F.coalesce(F.avg("hit"), nan).alias("hit_rate"),
        F.coalesce(F.avg("score"), nan).alias("nars"),
    )


def _pair_loss(items: Column) -> Column:
    """``struct(sum, n)`` of softplus(clamp(p_low - p_high, +-50)) over pairs of a small array with y_high > y_low."""

    def against(hi):
        lower = F.filter(items, lambda lo: lo["y"] < hi["y"])
        return F.struct(
            F.aggregate(lower, F.lit(0.0), lambda s, lo: s + F.log1p(F.exp(F.greatest(F.lit(-50.0), F.least(F.lit(50.0), lo["p"] - hi["p"]))))).alias("s"),
            F.size(lower).cast("bigint").alias("n"),
        )

    return F.aggregate(
        F.transform(items, against),
        F.struct(F.lit(0.0).alias("s"), F.lit(0).cast("bigint").alias("n")),
        lambda a, b: F.struct((a["s"] + b["s"]).alias("s"), (a["n"] + b["n"]).alias("n")),
    )


def _logs(low: np.ndarray, high: np.ndarray) -> float:
    """Sum of log(1 + low * high) over all pairs of two arrays, none negative.

    A strip of 32 factors 1 + low * x is a polynomial in x without negative coefficients, so one matrix product gives the products of all strips at
    all ``high`` without cancellation, and 32 pairs share a logarithm.
    """
    strips = np.zeros(-(-len(low) // _STRIP) * _STRIP)
    strips[: len(low)] = low
    strips = strips.reshape(-1, _STRIP)
    factors = np.zeros((len(strips), _STRIP + 1))
    factors[:, 0] = 1.0
    for k in range(_STRIP):
        factors[:, 1 : k + 2] += strips[:, k, None] * factors[:, : k + 1]
    total = 0.0
    for j in range(0, len(high), _WIDTH):
        total += float(np.log(factors @ high[None, j : j + _WIDTH] ** np.arange(_STRIP + 1)[:, None]).sum())
    return total


def _terms(low_p: np.ndarray, high_p: np.ndarray, counts: np.ndarray | bool, near: bool) -> float:
    """The pairs that ``counts``, one by one."""
    if near:
        return float(np.log1p(np.where(counts, low_p * high_p, 0.0)).sum())
    with np.errstate(invalid="ignore"):
        x = low_p - high_p
    return float(np.log1p(np.where(counts, np.exp(np.where(np.isnan(x), 50.0, np.clip(x, -50.0, 50.0))), 0.0)).sum())


def _cell_loss(low_y: np.ndarray, low_p: np.ndarray, high_y: np.ndarray, high_p: np.ndarray) -> tuple[float, int]:
    """Sum and number of softplus(clamp(p_low - p_high, +-50)) over all pairs with y_low < y_high; NaN is the largest number, as in Spark.

    softplus(a - b) is log(1 + e^a e^-b), and where predictions lie near each other those exponentials are taken once a row.
    """
    place = np.unique(np.concatenate([low_y, high_y]), return_inverse=True)[1]
    low, high = place[: len(low_y)], place[len(low_y) :]
    by_low, by_high = np.argsort(low), np.argsort(high)
    low, high, low_p, high_p = low[by_low], high[by_high], low_p[by_low], high_p[by_high]
    both = np.concatenate([low_p, high_p])
    near = bool(np.isfinite(both).all() and np.ptp(both) <= _NEAR)
    if near:
        low_p, high_p = np.exp(low_p - both.min()), np.exp(both.min() - high_p)
    total, todo = 0.0, [(0, len(low), 0, len(high))]
    while todo:
        a, b, c, d = todo.pop()
        c, cut = (int(np.searchsorted(high[:d], low[x], "right")) for x in (a, b - 1))  # above the least low one, above all of them
        if near:
            total += _logs(low_p[a:b], high_p[cut:d])
        elif cut < d:
            total += sum(_terms(low_p[a:b, None], high_p[None, j : min(j + _WIDTH, d)], True, near) for j in range(cut, d, _WIDTH))
        if c < cut and b - a > 8 * _STRIP:
            todo += [(a, (a + b) // 2, c, cut), ((a + b) // 2, b, c, cut)]
        elif c < cut:
            for j in range(c, cut, _WIDTH):
                part = slice(j, min(j + _WIDTH, cut))
                total += _terms(low_p[a:b, None], high_p[None, part], low[a:b, None] < high[None, part], near)
    return total, int(np.searchsorted(low, high, "left").sum())


def _cell_losses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns before ``low`` and ``high``, then the sum and the number of pairs; a cell without ``high`` is a block with itself."""

    def rows(block: pa.StructScalar) -> tuple[np.ndarray, np.ndarray]:
        return tuple(block[c].values.to_numpy(zero_copy_only=False) for c in ("y", "p"))

    for batch in batches:
        names = batch.schema.names
        found = []
        for low, high in zip(batch.column(names.index("low")), batch.column(names.index("high"))):
            low = rows(low)
            found.append(_cell_loss(*low, *(rows(high) if high.is_valid else low)))
        kept = [batch.column(i) for i in range(len(names) - 2)]
        yield pa.RecordBatch.from_arrays([*kept, pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], pa.int64())], [*names[:-2], "s", "pairs"])


def batch_losses(df: DataFrame, batch: str = "batch_id", article: str = "article_key", y: str = "y", p: str = "p", by: Sequence[str] = ()) -> DataFrame:
    """MSE, consistency, bias and ranking loss of each batch, as a training step computes them.

    ``batch`` comes from :mod:`litprops.operators.batches`, so a ``(batch, article)`` group never holds more rows than the batch
    size; pairs are scored inside that short array and never become rows. Work is ``rows x batch size``, whatever an article's size.
    """
    e = F.col(p) - F.col(y)
    per_article = (
        df.groupBy(*by, batch, article)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(e * e).alias("sq"),
            F.when(F.count(F.lit(1)) > 1, F.var_pop(e)).alias("var"),
            F.avg(e).alias("bias"),
            F.collect_list(F.struct(F.col(y).alias("y"), F.col(p).alias("p"))).alias("items"),
        )
        .withColumn("pairs", _pair_loss(F.col("items")))
    )
    zero = F.lit(0.0)
    return per_article.groupBy(*by, batch).agg(
        F.sum("n").alias("n"),
        (F.sum("sq") / F.sum("n")).alias("mse"),
        F.coalesce(F.avg("var"), zero).alias("consistency"),
        F.coalesce(F.avg(F.col("bias") * F.col("bias")), zero).alias("bias"),
        F.coalesce(F.avg(F.when(F.col("pairs.n") > 0, F.col("pairs.s") / F.col("pairs.n"))), zero).alias("ranking"),
    )


def consistency_and_bias(df: DataFrame, article: Sequence[str], by: Sequence[str] = (), y: str = "y", p: str = "p") -> DataFrame:
    """Whole-table form of the two losses that need no pairs: two levels of partial aggregates."""
    e = F.col(p) - F.col(y)
    per_article = df.groupBy(*by, *article).agg(F.when(F.count(F.lit(1)) > 1, F.var_pop(e)).alias("var"), F.avg(e).alias("m"))
    return per_article.groupBy(*by).agg(
        F.count(F.lit(1)).alias("articles"),
        F.coalesce(F.avg("var"), F.lit(0.0)).alias("consistency"),
        F.coalesce(F.avg(F.col("m") * F.col("m")), F.lit(0.0)).alias("bias"),
    )


def whole_article_losses(df: DataFrame, article: Sequence[str], by: Sequence[str] = (), y: str = "y", p: str = "p", block_rows: int = 512) -> DataFrame:
    """The four losses over whole articles, not only inside batches: ``by..., articles, n, mse, consistency, bias, ranking``.

    Ranking compares all rows of an article that differ in ``y``. Rows in the order of ``y`` are cut into blocks, every two blocks of an article (and
    every block with itself) are a cell, and a cell is scored by one task from two arrays. So an article of any size is exact, its pairs are spread
    over as many tasks as it has cells, and pairs are never rows. A block has ``block_rows`` rows at least and an eighth of its article up to
    ``MOST_BLOCK`` rows, so a row is copied eight times unless its article has more than half a million rows.
    """
    keys = [*by, *article]
    known = df.filter(F.col(y).isNotNull() & F.col(p).isNotNull()).select(*keys, F.col(y).cast("double").alias("_y"), F.col(p).cast("double").alias("_p"))
    e = F.col("_p") - F.col("_y")
    per = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(e * e).alias("sq"), F.when(F.count(F.lit(1)) > 1, F.var_pop(e)).alias("var"), F.avg(e).alias("m"))
    ranked = contiguous_index(known, "_y", "_rank", keys, ["_p"])
    size = F.greatest(F.lit(block_rows), F.least(F.lit(MOST_BLOCK), F.ceil(F.count(F.lit(1)) / BLOCKS)))
    sizes = ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), size.alias("_size"), F.floor((F.count(F.lit(1)) - 1) / size).alias("_last"))
    numbered = null_safe_join(ranked, sizes, keys).withColumn("_block", F.floor(F.col("_rank") / F.col("_size")))
    blocks = numbered.groupBy(*keys, "_block", "_last").agg(F.collect_list(F.struct(F.col("_y").alias("y"), F.col("_p").alias("p"))).alias("_rows"))
    cell = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("_last")), lambda k: F.struct(F.least("_block", k).alias("_lo"), F.greatest("_block", k).alias("_hi")))
    placed = blocks.select(*keys, F.struct(F.col("_rows.y").alias("y"), F.col("_rows.p").alias("p")).alias("_rows"), "_block", F.inline(cell))
    own = F.col("_block") == F.col("_lo")
    side = lambda mine: F.any_value(F.when(mine, F.col("_rows")), F.lit(True))  # noqa: E731  one block of a cell is its low one, one its high one
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), int((sizes.agg(F.sum(F.col("_n").cast("double") ** 2)).first()[0] or 0) / 2 / TASK_PAIRS))
    dealt = placed.repartition(tasks, *keys, "_lo", "_hi")  # a number of tasks by pairs, which Spark cannot tell from the bytes of the arrays
    cells = dealt.groupBy(*keys, "_lo", "_hi").agg(side(own).alias("low"), side(~own).alias("high")).drop("_lo", "_hi")
    kinds = ", ".join(f"`{c}` {known.schema[c].dataType.simpleString()}" for c in keys)
    scored = cells.mapInArrow(_cell_losses, f"{kinds}, s double, pairs bigint")
    pairs = scored.groupBy(*keys).agg(F.sum("s").alias("s"), F.sum("pairs").alias("pairs"))
    zero = F.lit(0.0)
    return null_safe_join(per, pairs, keys).groupBy(*by).agg(
        F.count(F.lit(1)).alias("articles"), F.sum("n").alias("n"), (F.sum("sq") / F.sum("n")).alias("mse"), F.coalesce(F.avg("var"), zero).alias("consistency"),
        F.coalesce(F.avg(F.col("m") * F.col("m")), zero).alias("bias"), F.coalesce(F.avg(F.when(F.col("pairs") > 0, F.col("s") / F.col("pairs"))), zero).alias("ranking"),
    )


def is_article_aware(weights: dict[str, float]) -> bool:
    return any(weights.get(k, 0) > 0 for k in LOSSES[1:])


def weighted_loss(weights: dict[str, float]) -> Column:
    """``w_mse * mse`` plus each article loss whose weight is positive."""
    total = F.lit(float(weights.get("mse", 1.0))) * F.col("mse")
    for name in LOSSES[1:]:
        if weights.get(name, 0) > 0:
            total = total + F.lit(float(weights[name])) * F.col(name)
    return total
