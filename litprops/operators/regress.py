"""Ridge regression on pooled vectors: fits, sweeps over settings and training fractions, and before/after tuning, all from the additive statistics
of :mod:`litprops.operators.gram`; scored like any other predictions."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litprops.functions.hashing import hash_fraction
from litprops.operators import gram
from litprops.operators.article_metrics import article_ranges, range_scores
from litprops.operators.metrics import improvement_row, regression_metrics
from litprops.session import settle


def _fitted(stats: DataFrame, on: Sequence[str], by: Sequence[str], ridges: Sequence[float]) -> tuple[DataFrame, DataFrame]:
    """``(models, scalers)`` as settled tables: targets scaled per ``by`` key, one fit for each ``on`` key over all groups that share it."""
    scaler = settle(gram.scalers(stats, by), "scalers")
    models = gram.solve(gram.merge(gram.in_standard_units(stats), on), on, ridges)
    return settle(models, "models"), scaler


def fit_predict(rows: DataFrame, by: Sequence[str], ridge: float = 0.1, train_part: str = "train") -> DataFrame:
    """Scale targets on training rows, fit, predict every row; ``p`` is back in physical units.

    ``rows``: ``part, y, transform, pooled`` and the scaler key ``by``. One model over all rows (a joint fit when ``by`` names
    several properties). Training rows are read once.
    """
    stats = settle(gram.moments(rows.filter(F.col("part") == train_part), by).withColumn("_fit", F.lit(0)), "moments")
    models, scaler = _fitted(stats, ["_fit"], by, [ridge])
    return gram.predict(rows.withColumn("_fit", F.lit(0)), models, scaler, ["_fit"], by).drop("_fit", "trial", "ridge")


def sweep(rows: DataFrame, by: Sequence[str], ridges: Sequence[float], eval_part: str = "val") -> DataFrame:
    """Metrics of every ridge setting on the validation rows only: ``trial, ridge, n, r2, rmse, mae``.

    All settings share one statistic of the training rows, and validation rows are scored under all of them in one pass.
    """
    stats = settle(gram.moments(rows.filter("part = 'train'"), by).withColumn("_fit", F.lit(0)), "moments")
    models, scaler = _fitted(stats, ["_fit"], by, ridges)
    scored = gram.predict(rows.filter(F.col("part") == eval_part).withColumn("_fit", F.lit(0)), models, scaler, ["_fit"], by)
    return regression_metrics(scored, ["trial", "ridge"])


def fraction_sweep(
    rows: DataFrame, by: Sequence[str], unit: Sequence[str], seed: int | str, percents: Sequence[int] = (20, 40, 60, 80, 100), ridges: Sequence[float] = (0.1,), eval_part: str = "val"
) -> DataFrame:
    """``by..., pct, trial, ridge, n_train, n, r2, rmse, mae``: every property fitted alone on nested training subsets under every ridge value.

    A row belongs to the subsets of :func:`litprops.operators.splits.nested_fractions`. Rows are summed once, under the smallest subset
    that holds them; the larger subsets are sums of those.
    """
    least = gram.least_percent(hash_fraction(f"{seed}:fraction", *unit), percents)
    train = rows.filter("part = 'train'").withColumn("_least", least).filter("_least IS NOT NULL")
    stats = gram.moments(train, [*by, "_least"])
    stats = settle(gram.cumulative(stats, [*by, "transform"], "_least", percents), "moments")
    key = [*by, "pct"]
    models, scaler = _fitted(stats, key, key, ridges)
    tried = rows.filter(F.col("part") == eval_part).withColumn("pct", F.explode(F.array(*[F.lit(int(p)) for p in percents])))
    scored = gram.predict(tried, models, scaler, key, key)
    trained = scaler.groupBy(*key).agg(F.sum("n").alias("n_train"))
    return regression_metrics(scored, [*key, "trial", "ridge"]).join(trained, key)


def tune_domain(rows: DataFrame, source: Column, target: Column, ridge: float = 0.1, by: Sequence[str] = (), eval_part: str = "test") -> DataFrame:
    """``by..., stage, r2, rmse, mae``: a fit on the ``source`` domain scored on the target's held-out rows (``before``), the same with the target's
    training rows added (``after``), and the improvement.

    The training rows of both domains are summed once; the second fit is the sum of two statistics. Each stage scales targets on the
    rows it is fitted on.
    """
    train = rows.filter("part = 'train'").filter(source | target).withColumn("_from", F.when(source, "before").otherwise("after"))
    stats = gram.moments(train, [*by, "_from"])
    stages = F.when(F.col("_from") == "before", F.array(F.lit("before"), F.lit("after"))).otherwise(F.array(F.lit("after")))
    key = [*by, "stage"]
    stats = settle(gram.merge(stats.withColumn("stage", F.explode(stages)), [*key, "transform"]), "moments")
    models, scaler = _fitted(stats, key, key, [ridge])
    held_out = rows.filter(target & (F.col("part") == eval_part)).withColumn("stage", F.explode(F.array(F.lit("before"), F.lit("after"))))
    scored = regression_metrics(gram.predict(held_out, models, scaler, key, key), key)
    return improvement_row(scored.drop("n"), list(by))


def score_batches(
    df: DataFrame, key: Sequence[str], vec: str, make_scorer: Callable[[], Callable[[pd.Series], Sequence[float]]], out: str = "p_scaled"
) -> DataFrame:
    """Score rows by a user's model in Arrow batches; rows keep their key, so order does not matter."""
    keep = df.select(*key, vec)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep.schema if f.name != vec) + f", {out} double"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = make_scorer()
        for frame in frames:
            yield frame[list(key)].assign(**{out: [float(v) for v in scorer(frame[vec])]})

    return keep.mapInPandas(run, schema)


def evaluate(preds: DataFrame, train: DataFrame, by: Sequence[str], article: str = "article_key") -> DataFrame:
    """Metrics, range hit rate and NARS of predictions in physical units, per ``by`` key (at least one, such as the dataset)."""
    if not by:
        raise ValueError("name at least one key")
    scores = range_scores(preds, article_ranges(train, [*by, article]), [*by, article], by)
    metrics = regression_metrics(preds, by)
    nan = F.lit(float("nan"))
    return metrics.join(scores, list(by), "left").fillna({"eligible": 0}).withColumns(
        {"hit_rate": F.coalesce("hit_rate", nan), "nars": F.coalesce("nars", nan)}
    )
