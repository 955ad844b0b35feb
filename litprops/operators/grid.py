"""Experiment grids and result tables. Dimensions come from a config file, or from tables of any size."""

from __future__ import annotations

import itertools
import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from litprops.operators.spread import contiguous_index


def pairs(d1: Sequence[float], d2: Sequence[float], rule: str) -> list[list]:
    """``[d1, d2]`` values of a constrained dimension: rule ``d1_gt_d2`` or ``d1_eq_2d2``."""
    tests = {"d1_gt_d2": lambda a, b: a > b, "d1_eq_2d2": lambda a, b: a == 2 * b}
    if rule not in tests:
        raise ValueError(f"unknown grid generator: {rule}")
    return [[a, b] for a, b in itertools.product(d1, d2) if tests[rule](a, b)]


def pair_rows(first: DataFrame, second: DataFrame, rule: str, d1: str = "d1", d2: str = "d2") -> DataFrame:
    """:func:`pairs` for candidates in tables (``first`` with column ``d1``, ``second`` with ``d2``): a join under the rule's condition."""
    rules = {"d1_gt_d2": F.col(d1) > F.col(d2), "d1_eq_2d2": F.col(d1) == 2 * F.col(d2)}
    if rule not in rules:
        raise ValueError(f"unknown grid generator: {rule}")
    return first.join(second, rules[rule])


def expand(
    spark: SparkSession,
    grid: dict[str, Sequence],
    linked: dict[str, tuple[Sequence[str], Sequence[Sequence]]] | None = None,
    base: DataFrame | None = None,
) -> DataFrame:
    """One row per trial: every plain dimension times every linked group; ``trial`` numbers them with the last dimension fastest.

    ``linked`` maps a name to ``(parameter names, value tuples)``; a group is one dimension. With ``base`` the grid is laid out for each row
    of that table, numbered from 0 for each; no row leaves its task, however many there are.
    """
    groups = [((name,), [(v,) for v in values]) for name, values in grid.items()]
    groups += [(tuple(names), [tuple(v) for v in values]) for names, values in (linked or {}).values()]
    start = spark.range(1).select() if base is None else base
    out = start.withColumn("trial", F.lit(0).cast("bigint"))
    for names, values in groups:
        # One JSON literal per dimension keeps the plan small, however many values it has.
        fields = ", ".join(f"`{n}` {_type(v)}" for n, v in zip(names, values[0]))
        rows = F.from_json(F.lit(json.dumps([dict(zip(names, row)) for row in values])), f"ARRAY<STRUCT<{fields}>>", {"mode": "FAILFAST"})
        out = out.select("*", F.posexplode(rows).alias("_i", "_g")).select(
            (F.col("trial") * len(values) + F.col("_i")).alias("trial"), *[c for c in out.columns if c != "trial"], "_g.*"
        )
    return out


def _type(v) -> str:
    if isinstance(v, (list, tuple)):
        return f"ARRAY<{_type(v[0])}>"
    return {bool: "BOOLEAN", int: "BIGINT", float: "DOUBLE", str: "STRING"}[type(v)]


def score_grid(scores: DataFrame, weights: dict[str, Sequence[float]], keep: Sequence[str]) -> DataFrame:
    """Weighted total of each score row for every combination of weights.

    Scores are aggregated first, so the grid multiplies a few rows and never the data. ``weights`` maps a score column to its
    candidate weights; ``mse`` counts once.
    """
    out = scores
    for name, values in weights.items():
        out = out.withColumn(f"w_{name}", F.explode(F.array(*[F.lit(float(v)) for v in values])))
    total = F.col("mse")
    for name in weights:
        total = total + F.col(f"w_{name}") * F.col(name)
    return out.select(*keep, *[f"w_{name}" for name in weights], total.alias("total"))


def trial_results(trials: DataFrame, results: DataFrame) -> DataFrame:
    """Results with their configuration; trials without a result drop out. Ordered by trial number, not by its text."""
    return trials.join(results, "trial", "inner")


def trial_number(name: Column | str) -> Column:
    """The number at the end of a trial's name; NULL without one."""
    return F.regexp_extract(F.col(name) if isinstance(name, str) else name, r"(\d+)\z", 1).try_cast("bigint")


def trial_order(trials: DataFrame, name: str = "trial_name", out: str = "position") -> DataFrame:
    """Trials numbered from 1 by their number, not by its text (``trial_9`` before ``trial_10``); names without a number come last, by name."""
    ordered = trials.withColumns({"_none": trial_number(name).isNull(), "_number": F.coalesce(trial_number(name), F.lit(0).cast("bigint"))})
    return contiguous_index(ordered.withColumn("_key", F.struct("_none", "_number", name)), "_key", out).withColumn(out, F.col(out) + 1).drop("_none", "_number", "_key")


def best_trial(scored: DataFrame, metric: str, larger_is_better: bool = True) -> DataFrame:
    """The best trial on a validation metric; the smallest trial number wins a tie."""
    order = F.desc(metric) if larger_is_better else F.asc(metric)
    return scored.orderBy(order, F.asc("trial")).limit(1)


def training_splits(split_name: str, sweep: bool = False, grid_has_split: bool = False) -> list[str]:
    """Split names of a run, or of a sweep over nested training fractions of one of the two full splits."""
    if not sweep:
        return [split_name]
    if grid_has_split:
        raise ValueError("choose a fraction sweep or a split grid, not both")
    if split_name not in ("split_random", "split_article"):
        raise ValueError("a fraction sweep needs split_random or split_article")
    return [f"{split_name}_{p}pct" for p in (20, 40, 60, 80)] + [split_name]
