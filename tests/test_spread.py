"""The building blocks for hot keys and global orders, on small tables with every key made heavy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from litprops.operators import spread
from tests.conftest import rows


@pytest.fixture(scope="module")
def skewed(spark):
    """120 rows: a third in one key, some in a NULL key, the rest spread; values with ties."""
    rng = np.random.default_rng(3)
    keys = ["hot"] * 40 + [None] * 10 + [f"k{i % 11}" for i in range(70)]
    pdf = pd.DataFrame({"id": rng.permutation(120), "k": keys, "y": np.round(rng.normal(size=120), 1)})
    return pdf, spark.createDataFrame(pdf, "id long, k string, y double").repartition(7)


@pytest.mark.parametrize("how", ["left", "inner"])
@pytest.mark.parametrize("heavy_rows", [3, 1_000_000])
def test_lookup_join_equals_plain_join(spark, skewed, how, heavy_rows):
    _, df = skewed
    table = spark.createDataFrame([("hot", 1), ("k1", 2), ("k2", 3), ("none", 4), (None, 5)], "k string, v int")
    got = spread.lookup_join(df, table, ["k"], how, heavy_rows=heavy_rows).select("id", "k", "y", "v")
    assert rows(got, "id") == rows(df.join(table, "k", how).select("id", "k", "y", "v"), "id")


def test_lookup_join_spreads_the_hot_key(spark, skewed):
    _, df = skewed
    assert [tuple(r) for r in spread.heavy_keys(spread.key_counts(df, ["k"]), ["k"], heavy_rows=15)] == [("hot", 3)]


def test_attach_small_falls_back(spark, skewed):
    _, df = skewed
    table = spark.createDataFrame([("hot", 1), ("k1", 2)], "k string, v int")
    small = spread.attach_small(df, table, ["k"]).select("id", "v")
    big = spread.attach_small(df, table, ["k"], most=1).select("id", "v")
    assert rows(small, "id") == rows(big, "id") == rows(df.join(table, "k", "left").select("id", "v"), "id")


@pytest.mark.parametrize("by", [[], ["k"]])
@pytest.mark.parametrize("few", [True, False])
def test_running_total(spark, skewed, by, few, monkeypatch):
    if not few:
        monkeypatch.setattr(spread, "HEAVY_ROWS", 3)
    pdf, df = skewed
    got = spread.running_total(df, "id", F.col("id") * 2, "end", by).select("id", "end").toPandas().set_index("id")["end"]
    ordered = pdf.sort_values("id")
    want = (ordered.groupby("k", dropna=False)["id"] if by else ordered["id"]).cumsum() * 2
    assert got.sort_index().tolist() == want.tolist()


@pytest.mark.parametrize("cuts", [[], [10.0], [5.0, 17.0, 60.0, 1e9]])
def test_contiguous_index_any_borders(spark, skewed, cuts):
    _, df = skewed
    got = rows(spread.contiguous_index(df, "id", "i", cuts=cuts).select("id", "i"), "id")
    assert got == [(i, i) for i in range(120)]


@pytest.mark.parametrize("by", [[], ["k"]])
@pytest.mark.parametrize("ranges", [1, 5, 40])
def test_numbers_over_ranges(spark, skewed, by, ranges):
    """One plan for any number of ranges, also with a third of the rows in one key, NULL keys, ties and nothing at all."""
    pdf, df = skewed
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        numbered = spread.contiguous_index(df, "y", "i", by, ["id"]).select("id", "i")
        total = spread.running_total(df, "y", "id", "t", by, ["id"]).select("id", "t")
        got, sums = dict(rows(numbered)), dict(rows(total))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    ordered = pdf.sort_values(["y", "id"])
    groups = ordered.groupby("k", dropna=False) if by else ordered.groupby(lambda _: 0)
    assert got == dict(zip(ordered["id"], groups.cumcount()))
    assert sums == dict(zip(ordered["id"], groups["id"].cumsum()))
    assert spread.contiguous_index(df.limit(0), "y", "i", by).count() == spread.running_total(df.limit(0), "y", "id", "t", by).count() == 0


@pytest.mark.parametrize("cuts", [None, [], [-0.5, 0.0, 0.3], [100.0]])
def test_grouped_median(spark, skewed, cuts):
    pdf, df = skewed
    got = dict(rows(spread.grouped_median(df, ["k"], "y", cuts=cuts)))
    want = pdf.groupby("k", dropna=False)["y"].median()
    assert {k: round(v, 9) for k, v in got.items()} == {(None if pd.isna(k) else k): round(v, 9) for k, v in want.items()}
    whole = rows(spread.grouped_median(df, [], "y", cuts=cuts))
    assert [round(whole[0][0], 9)] == [round(pdf["y"].median(), 9)]


def test_grouped_median_switches_by_size(spark, skewed, monkeypatch):
    _, df = skewed
    small = rows(spread.grouped_median(df, ["k"], "y"), "k")
    monkeypatch.setattr(spread, "HEAVY_ROWS", 3)
    assert rows(spread.grouped_median(df, ["k"], "y"), "k") == small


def test_rank_in_group_cuts_a_hot_key(spark, skewed):
    pdf, df = skewed
    from litprops.functions.hashing import hash_fraction

    whole = spread.rank_in_group(df, ["k"], hash_fraction(1, "id"), "r", ties=["id"])
    cut = spread.rank_in_group(df, ["k"], hash_fraction(1, "id"), "r", ties=["id"], target_rows=3)
    assert rows(whole.select("id", "r"), "id") == rows(cut.select("id", "r"), "id")
    got = cut.groupBy("k").agg(F.sort_array(F.collect_list("r")).alias("r"))
    assert all(r["r"] == list(range(len(r["r"]))) for r in got.collect())


def test_hashable_looks_inside(spark):
    df = spark.range(3).select("id", F.array(F.parse_json(F.lit("1"))).alias("a"), F.struct(F.create_map(F.lit("k"), F.lit(1))).alias("b"), F.struct(F.array("id")).alias("c"))
    assert spread.hashable(df, ["id"]) == ["c"]
    joined = spread.lookup_join(df, spark.range(3).withColumn("t", F.lit(1)), ["id"], heavy=[(0, 2)])
    assert joined.filter("t = 1").count() == 3


def test_widen(spark):
    assert spread.widen(spark.range(0, 100, 1, 2), 4).rdd.getNumPartitions() == 4
    assert spread.widen(spark.range(0, 100, 1, 6), 4).rdd.getNumPartitions() == 6


def test_deal_bounds_the_rows_of_a_task(spark):
    """Adaptive execution leaves the given number of partitions alone, equal keys meet, and few rows move no more than before."""
    df = spark.range(4000).select((F.col("id") % 500).alias("k"), "id")
    parts = spark.sparkContext.defaultParallelism * 5
    dealt = spread.deal(df, ["k"], 4000, 4000 // parts).groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.spark_partition_id().alias("part"))
    assert {(r.k, r.n) for r in dealt.collect()} == {(k, 8) for k in range(500)}
    assert dealt.select("part").distinct().count() > spark.sparkContext.defaultParallelism * 3
    assert spread.deal(df, ["k"], 4000) is df


def test_widen_bounds_the_rows_of_a_task(spark):
    assert spread.widen(spark.range(0, 1001, 1, 4), 4, 100).rdd.getNumPartitions() == 11
    assert spread.widen(spark.range(0, 0, 1, 4), 4, 100).rdd.getNumPartitions() == 4
