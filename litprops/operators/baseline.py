"""Article-memorisation baseline: predict a test record by the mean or median of its article's training values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from litprops.operators.metrics import NAN, regression_metrics
from litprops.operators.spread import HEAVY_ROWS, attach_small, grouped_median, heavy_keys, largest_group, lookup_join, mark_middle, hashable

STRATEGIES = ("mean", "median")
_NO_ARTICLE = "\u0000none"  # stands for a NULL article key inside the lookup


def training_statistics(train: DataFrame, by: Sequence[str], y: str = "y", most: int | None = None) -> DataFrame:
    """Mean, exact median and row count of the training values per key. NULL keys are left out. ``most``: rows of the fullest key or
    of a wider group, where known."""
    named = train
    for c in by:
        named = named.filter(F.col(c).isNotNull())
    if (largest_group(named, by) if most is None else most) <= HEAVY_ROWS:
        middle = F.avg(F.when(F.col("_mid"), F.col(y)))
        return mark_middle(named, by, y).groupBy(*by).agg(F.avg(y).alias("mean"), middle.alias("median"), F.count(F.lit(1)).alias("n_train"))
    mean = named.groupBy(*by).agg(F.avg(y).alias("mean"), F.count(F.lit(1)).alias("n_train"))
    return mean.join(grouped_median(named, by, y), list(by))


def predict(train: DataFrame, test: DataFrame, by: Sequence[str], key: str = "article_key", y: str = "y", most: int | None = None) -> DataFrame:
    """Test rows with ``mean``, ``median`` and ``n_train``: the article's value, else the value over all training rows of the ``by``
    group.

    The fallback is settled per test article (a table of articles, not of rows); the rows are joined once, salted where one article
    is heavy. A NULL article key is a key of its own that only meets the fallback.
    """
    by = list(by)
    most = largest_group(train, by) if most is None else most  # an article never has more rows than its group
    article = training_statistics(train, [*by, key], y, most).drop("n_train")
    whole = training_statistics(train, by, y, most).withColumnsRenamed({"mean": "_all_mean", "median": "_all_median"})
    rows = test.withColumn("_key", F.coalesce(F.col(key).cast("string"), F.lit(_NO_ARTICLE)))
    sizes = rows.groupBy(*by, "_key").agg(F.count(F.lit(1)).alias("_n"))
    known = article.withColumn("_key", F.col(key).cast("string")).drop(key)
    table = (
        attach_small(sizes.join(known, [*by, "_key"], "left"), whole, by)
        .select(*by, "_key", F.coalesce("mean", "_all_mean").alias("mean"), F.coalesce("median", "_all_median").alias("median"), "n_train")
    )
    return lookup_join(rows, table, [*by, "_key"], heavy=heavy_keys(sizes, [*by, "_key"])).drop("_key")


def predict_parts(rows: DataFrame, by: Sequence[str], key: str = "article_key", y: str = "y", part: str = "part", most: int | None = None) -> DataFrame:
    """Like :func:`predict` for train and test rows in one table.

    While no article is heavy, one shuffle by article serves both parts: windows hand the training mean and median straight to the
    article's test rows, and no join is needed. With a heavy article the salted join of :func:`predict` takes over.
    """
    by = list(by)
    train = F.col(part) == "train"
    most = largest_group(rows.filter(train), by) if most is None else most
    if most > HEAVY_ROWS and largest_group(rows.filter(F.col(key).isNotNull()), [*by, key]) > HEAVY_ROWS:
        return predict(rows.filter(train), rows.filter(F.col(part) == "test"), by, key, y, most)
    whole = training_statistics(rows.filter(train), by, y, most).withColumnsRenamed({"mean": "_all_mean", "median": "_all_median"})
    # Rows without a key would be one huge group; each becomes a group of its own, which holds no training row for a test row.
    alone = F.concat(F.lit(_NO_ARTICLE), F.col(part), F.xxhash64(*[F.col(c) for c in hashable(rows)]).cast("string"))
    article = Window.partitionBy(*by, "_key")
    trained = F.count(F.when(train, 1)).over(article)
    middle = F.col("_rank").isin(F.floor((F.col("_all") + 1) / 2), F.floor((F.col("_all") + 2) / 2))
    seen = (
        rows.filter(F.col(part).isin("train", "test"))
        .withColumn("_key", F.coalesce(F.col(key).cast("string"), alone))
        .withColumns({"_rank": F.row_number().over(article.orderBy(F.when(train, 0).otherwise(1), y)), "_all": trained})
        .withColumns({"mean": F.avg(F.when(train, F.col(y))).over(article), "median": F.avg(F.when(train & middle, F.col(y))).over(article)})
        .filter(F.col(part) == "test")
        .drop("_key", "_rank", "_all")
    )
    filled = {"mean": F.coalesce("mean", "_all_mean"), "median": F.coalesce("median", "_all_median")}
    return attach_small(seen, whole, by).withColumns(filled).drop("_all_mean", "_all_median")


def score(predicted: DataFrame, by: Sequence[str], y: str = "y") -> DataFrame:
    """One row per group and strategy: ``n_train, n_test, r2, rmse, mae``. Without training rows the metrics are NaN."""
    long = predicted.select(
        *by, "n_train", F.col(y).alias("y"),
        F.explode(F.array(*[F.struct(F.lit(s).alias("strategy"), F.col(s).alias("p")) for s in STRATEGIES])).alias("s"),
    ).select(*by, "n_train", "y", "s.strategy", "s.p")
    metrics = regression_metrics(long, [*by, "strategy", "n_train"]).withColumnRenamed("n", "n_test")
    untrained = F.col("n_train").isNull()
    return metrics.select(
        *by, "strategy", F.coalesce("n_train", F.lit(0)).alias("n_train"), "n_test",
        *[F.when(untrained, F.lit(NAN)).otherwise(F.col(m)).alias(m) for m in ("r2", "rmse", "mae")],
    )


def article_baseline(rows: DataFrame, by: Sequence[str] = ("dataset", "split_name"), key: str = "article_key", y: str = "y", most: int | None = None) -> DataFrame:
    """Baseline of every group from rows with a ``part``. ``most`` is the size of the fullest training group, where it is known."""
    return score(predict_parts(rows, by, key, y, most=most), by, y)


def pool_baseline(
    train: DataFrame, test: DataFrame, by: Sequence[str], train_by: Sequence[str], key: str = "article_key", y: str = "y"
) -> DataFrame:
    """Baseline of several test files that share a training pool: ``train_by`` is the part of ``by`` that names the pool."""
    return score(predict(train, test, train_by, key, y), by, y)


def best_strategy(result: DataFrame, by: Sequence[str] = ("dataset", "split_name")) -> DataFrame:
    """The better strategy per group; NaN counts as -inf and the median must be strictly better."""
    score = F.when(F.isnan("r2"), F.lit(float("-inf"))).otherwise(F.col("r2"))
    order = F.struct(score.alias("r2"), (F.col("strategy") == "mean").alias("mean_first"))
    row = F.struct("strategy", "n_train", "n_test", "r2", "rmse", "mae")
    return (
        result.groupBy(*by)
        .agg(F.max_by(row, order).alias("b"))
        .select(*by, F.col("b.strategy").alias("best_strategy"), "b.n_train", "b.n_test", "b.r2", "b.rmse", "b.mae")
    )
