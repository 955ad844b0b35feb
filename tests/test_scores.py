"""Baseline, metrics, article scores, losses, scaling, batches and reports against plain loops."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from litprops.operators import article_metrics as am
from litprops.operators import articles, baseline, batches, grid, metrics, regress, scaling, splits
from litprops.operators.spread import null_safe_join
from litprops.plans import jobs
from tests.conftest import rows


@pytest.fixture(scope="module")
def data(spark):
    """Two datasets; one article holds a third of the rows, some rows have no article, ties among values."""
    rng = np.random.default_rng(5)
    n = 90
    pdf = pd.DataFrame(
        {
            "dataset": rng.choice(["a", "b"], n),
            "row_idx": np.arange(n),
            "article_key": ["hot"] * 30 + [None] * 8 + [f"k{i % 9}" for i in range(n - 38)],
            "y": np.round(rng.normal(10, 3, n), 1),
            "part": rng.choice(["train", "train", "val", "test"], n),
        }
    )
    pdf["p"] = np.round(pdf["y"] + rng.normal(0, 1, n), 2)
    schema = "dataset string, row_idx long, article_key string, y double, part string, p double"
    return pdf, spark.createDataFrame(pdf, schema).repartition(5)


def plain_metrics(y, p):
    y, p = np.asarray(y, float), np.asarray(p, float)
    if len(y) < 2:
        return (math.nan,) * 3
    rss, tss = ((y - p) ** 2).sum(), ((y - y.mean()) ** 2).sum()
    r2 = 1 - rss / tss if tss else (1.0 if rss == 0 else 0.0)
    return r2, math.sqrt(((y - p) ** 2).mean()), np.abs(y - p).mean()


def plain_baseline(pdf, how):
    out = {}
    for ds, g in pdf.groupby("dataset"):
        train, test = g[g.part == "train"], g[g.part == "test"]
        stat = train.groupby("article_key")["y"].agg(how)
        pred = [stat.get(k, train["y"].agg(how)) if k is not None else train["y"].agg(how) for k in test["article_key"]]
        out[ds, how] = (len(train), len(test), *plain_metrics(test["y"], pred))
    return out


def check_baseline(got, pdf):
    want = plain_baseline(pdf, "mean") | plain_baseline(pdf, "median")
    found = {(r["dataset"], r["strategy"]): (r["n_train"], r["n_test"], r["r2"], r["rmse"], r["mae"]) for r in got.collect()}
    assert found.keys() == want.keys()
    for k in want:
        assert found[k] == pytest.approx(want[k], nan_ok=True)


def test_baseline(data):
    pdf, df = data
    check_baseline(baseline.article_baseline(df, ["dataset"]), pdf)


def test_baseline_with_heavy_articles(data, heavy):
    pdf, df = data
    check_baseline(baseline.article_baseline(df, ["dataset"]), pdf)


def test_baseline_heavy_groups_but_light_articles(data, monkeypatch):
    pdf, df = data
    monkeypatch.setattr(baseline, "HEAVY_ROWS", 30)
    check_baseline(baseline.article_baseline(df, ["dataset"], most=31), pdf)


def test_pool_baseline_without_training_rows(spark, data):
    _, df = data
    test = df.filter("part = 'test'").withColumn("file", F.lit("f"))
    none = baseline.pool_baseline(df.filter("part = 'nowhere'"), test, ["dataset", "file"], ["dataset"])
    assert all(math.isnan(r["r2"]) and r["n_train"] == 0 for r in none.collect())


def test_best_strategy(spark):
    schema = "dataset string, split_name string, strategy string, n_train int, n_test int, r2 double, rmse double, mae double"
    nan = math.nan
    df = spark.createDataFrame(
        [("a", "s", "mean", 1, 1, 0.5, 1.0, 1.0), ("a", "s", "median", 1, 1, 0.5, 2.0, 2.0), ("b", "s", "mean", 1, 1, nan, 1.0, 1.0), ("b", "s", "median", 1, 1, -3.0, 2.0, 2.0), ("c", "s", "mean", 1, 1, nan, 1.0, 1.0), ("c", "s", "median", 1, 1, nan, 2.0, 2.0)],
        schema,
    )
    assert [r["best_strategy"] for r in baseline.best_strategy(df).orderBy("dataset").collect()] == ["mean", "median", "mean"]


def test_metrics_edges(spark):
    df = spark.createDataFrame([("one", 1.0, 2.0), ("flat", 3.0, 3.0), ("flat", 3.0, 3.0), ("off", 3.0, 3.0), ("off", 3.0, 4.0)], "k string, y double, p double")
    base = {r["k"]: r for r in metrics.regression_metrics(df, ["k"]).collect()}
    epoch = {r["k"]: r for r in metrics.regression_metrics(df, ["k"], form="epoch").collect()}
    assert math.isnan(base["one"]["r2"]) and math.isnan(base["one"]["mae"]) and base["flat"]["r2"] == 1.0 and base["off"]["r2"] == 0.0
    assert epoch["one"]["r2"] == 0.0 and epoch["one"]["rmse"] == 1.0
    with pytest.raises(ValueError):
        metrics.regression_metrics(df, ["k"], form="x")


@pytest.mark.parametrize("hot", [False, True])
def test_range_scores(spark, hot, request):
    if hot:
        request.getfixturevalue("heavy")
    train = spark.createDataFrame([("a", 0.0), ("a", 10.0), ("flat", 5.0), ("flat", 5.0), ("one", 1.0)], "k string, y double")
    preds = spark.createDataFrame([("a", 5.0), ("a", 10.0), ("a", 20.0), ("flat", 5.0), ("one", 1.0), ("new", 1.0), (None, 1.0)], "k string, p double")
    got = am.range_scores(preds, am.article_ranges(train, ["k"]), ["k"]).first()
    assert got["eligible"] == 3 and got["hit_rate"] == pytest.approx(2 / 3)
    assert got["nars"] == pytest.approx((1 + math.exp(-0.5) + math.exp(-4.5)) / 3)
    none = am.range_scores(preds.filter("k = 'flat'"), am.article_ranges(train, ["k"]), ["k"]).first()
    assert none["eligible"] == 0 and math.isnan(none["hit_rate"]) and math.isnan(none["nars"])


def plain_losses(y, p, a):
    e = p - y
    var, bias, rank = [], [], []
    for k in pd.unique(a):
        m = a == k
        if m.sum() > 1:
            var.append(e[m].var())
        bias.append(e[m].mean() ** 2)
        pairs = [np.logaddexp(0, np.clip(pj - pi, -50, 50)) for yi, pi in zip(y[m], p[m]) for yj, pj in zip(y[m], p[m]) if yi > yj]
        if pairs:
            rank.append(np.mean(pairs))
    mean = lambda x: float(np.mean(x)) if x else 0.0
    return float((e**2).mean()), mean(var), mean(bias), mean(rank)


def test_batch_losses(data):
    pdf, df = data
    named = df.filter("article_key IS NOT NULL")
    batched = batches.article_batches(named, "article_key", "row_idx", 16, 1)
    got = {r["batch_id"]: r for r in am.batch_losses(batched).collect()}
    placed = batched.toPandas()
    assert sorted(placed["pos"]) == list(range(len(placed))) and placed.groupby("batch_id").size().max() == 16
    for b, g in placed.groupby("batch_id"):
        want = plain_losses(g["y"].to_numpy(), g["p"].to_numpy(), g["article_key"].to_numpy())
        assert [got[b][c] for c in am.LOSSES] == pytest.approx(want)


def test_article_batches_keep_articles_together_and_cut_hot_ones(data, heavy):
    _, df = data
    named = df.filter("article_key IS NOT NULL")
    out = batches.article_batches(named, "article_key", "row_idx", 16, 1).toPandas().sort_values("pos")
    assert out["pos"].tolist() == list(range(len(out)))
    changes = (out["article_key"] != out["article_key"].shift()).sum()
    assert changes == out["article_key"].nunique()
    full = batches.article_batches(named, "article_key", "row_idx", 16, 1, drop_last=True)
    assert full.count() == len(out) // 16 * 16


def test_whole_table_losses_and_weights(data):
    pdf, df = data
    pdf = pdf[pdf.article_key.notna()]
    got = am.consistency_and_bias(df.filter("article_key IS NOT NULL"), ["article_key"]).first()
    _, var, bias, _ = plain_losses(pdf["y"].to_numpy(), pdf["p"].to_numpy(), pdf["article_key"].to_numpy())
    assert (got["consistency"], got["bias"]) == pytest.approx((var, bias))
    assert am.is_article_aware({"bias": 0.1}) and not am.is_article_aware({"mse": 1.0})


def test_extreme_differences_are_clamped(spark):
    df = spark.createDataFrame([(0, "a", 1.0, -1e6), (0, "a", 0.0, 1e6)], "batch_id int, article_key string, y double, p double")
    assert am.batch_losses(df).first()["ranking"] == pytest.approx(50.0)


def test_scaler_round_trip(spark):
    df = spark.createDataFrame([("E", 1.0), ("E", 10.0), ("flat", 2.0), ("flat", 2.0), ("E_article", 5.0)], "prop string, y double")
    df = df.withColumn("transform", scaling.transform_for("prop", ["E"]))
    scaler = scaling.fit(df, ["prop"])
    got = {r["prop"]: (r["transform"], r["mean"], r["scale"]) for r in scaler.collect()}
    assert got["E"] == ("log", pytest.approx(math.log(10) / 2), pytest.approx(math.log(10) / 2))
    assert got["flat"] == ("identity", 2.0, 1.0) and got["E_article"][0] == "log"
    back = scaling.scale(df, scaler, ["prop"]).select("y", scaling.inverse("y_scaled").alias("z"))
    assert all(r["z"] == pytest.approx(r["y"]) for r in back.collect())


def test_bad_targets(spark):
    df = spark.createDataFrame([(0, 1.0, "log"), (1, 0.0, "log"), (2, math.inf, "identity"), (3, None, "identity"), (4, -1.0, "identity")], "row_idx long, y double, transform string")
    assert rows(scaling.bad_targets(df, "y", "transform").select("row_idx", "reason"), "row_idx") == [(1, "not positive"), (2, "not finite"), (3, "not finite")]
    with pytest.raises(ValueError, match="1 .not positive"):
        scaling.validate_targets(df, "y", "transform")
    with pytest.raises(Exception, match="bad target"):
        scaling.fit(df, []).collect()
    overflow = spark.createDataFrame([(1e5, 0.0, 1.0, "log")], "v double, mean double, scale double, transform string")
    with pytest.raises(Exception, match="not finite"):
        overflow.select(scaling.inverse("v")).collect()


@pytest.mark.parametrize(
    "losses, patience, last, best, stopped",
    [([3.0, 2.0, 1.0], 2, 2, 2, False), ([1.0, 1.0, 1.0, 0.5], 2, 2, 0, True), ([2.0, 3.0, 1.0, 4.0, 4.0, 0.1], 2, 4, 2, True), ([None, None], 1, 1, 1, False)],
)
def test_early_stop(spark, losses, patience, last, best, stopped):
    log = spark.createDataFrame([("r", i, v) for i, v in enumerate(losses)], "run string, epoch int, val_loss double")
    r = batches.stop_summary(batches.early_stop(log, patience)).first()
    assert (r["last_epoch"], r["best_epoch"], r["stopped_early"]) == (last, best, stopped)


def test_epoch_loss_of_nothing(spark):
    df = spark.createDataFrame([(0.5, 2), (1.0, 6)], "loss double, n long")
    assert metrics.epoch_loss(df).first()["loss"] == pytest.approx(0.875)
    assert metrics.epoch_loss(df.filter("n < 0")).first()["loss"] == 0.0


def test_fixed_batches_size():
    for bad in (0, -1, 2.5):
        with pytest.raises(ValueError):
            batches.fixed_batches("row_idx", bad)


def test_split_checks(spark):
    recs = spark.range(6).select(F.lit("d").alias("dataset"), F.col("id").alias("row_idx"), (F.col("id") * 10.0).alias("y"))
    lists = spark.createDataFrame([("d", "s", "train", [3, 1, 1]), ("d", "s", "test", [0, 9])], "dataset string, split_name string, part string, rows array<bigint>")
    split = splits.explode_lists(lists)
    assert rows(splits.missing_rows(recs, split).select("part", "pos", "row_idx")) == [("test", 1, 9)]
    with pytest.raises(Exception, match="out of range: d 9"):
        splits.gather(recs, split).collect()
    with pytest.raises(Exception, match="out of range: d 9"):
        splits.gather(recs, split).select("part").groupBy("part").count().collect()
    kept = splits.gather(recs, split.filter("row_idx < 9")).orderBy("part", "pos").select("part", "row_idx", "y")
    assert rows(kept) == [("test", 0, 0.0), ("train", 3, 30.0), ("train", 1, 10.0), ("train", 1, 10.0)]
    assert rows(splits.uncovered(recs, split).select("row_idx"), "row_idx") == [(2,), (4,), (5,)]
    twice = split.unionByName(split.limit(1).withColumn("part", F.lit("val")))
    assert splits.overlaps(twice).count() == 1 and splits.overlaps(split).count() == 0
    nested = splits.nested_fractions(split.filter("row_idx < 9"), ["row_idx"], 1)
    assert splits.not_nested(nested, "s_20pct", "s_60pct").count() == 0


def test_split_order(spark):
    names = ["z", "continue_train__b", "split_article", "split_article_20pct", "split_random", "split_random_80pct", "continue_train__a", "split_random_20pct"]
    df = spark.createDataFrame([(n,) for n in names], "s string").orderBy(*splits.split_rank("s"))
    assert [r[0] for r in df.collect()] == ["split_random_20pct", "split_random_80pct", "split_random", "split_article_20pct", "split_article", "continue_train__a", "continue_train__b", "z"]


def test_article_keys(spark):
    df = spark.createDataFrame([(0, " 10.1/A ", "T"), (1, "10.1/a", None), (2, None, " T "), (3, " ", ""), (4, None, None), (5, None, "10.1/a")], "row_idx long, doi string, title string")
    base = [r[0] for r in df.orderBy("row_idx").select(articles.baseline_key()).collect()]
    assert base == ["doi:10.1/a", "doi:10.1/a", "title:T", None, None, "title:10.1/a"]
    assert [r[0] for r in df.orderBy("row_idx").select(articles.baseline_key(mode="title")).collect()] == ["title:T", None, "title:T", None, None, "title:10.1/a"]
    ids = rows(jobs.number_articles(df).select("row_idx", "article_id"), "row_idx")
    assert ids == [(0, 0), (1, 0), (2, 1), (3, 2), (4, 3), (5, 0)]


def test_grid(spark):
    assert len(grid.pairs([512, 256, 128, 64], [256, 128, 64, 32], "d1_eq_2d2")) == 4
    pools = [["last", 128], ["mean", 128], ["sum", 128]] + [[p, d] for p in ("att", "sig") for d in (64, 128, 256)]
    trials = grid.expand(spark, {"dims": grid.pairs([512, 256, 128, 64], [256, 128, 64, 32], "d1_eq_2d2")}, {"pool": (["pooling", "proj"], pools)})
    assert trials.count() == 36 and trials.filter("dims[0] <> 2 * dims[1]").count() == 0
    assert [r[0] for r in trials.select("trial").orderBy("trial").collect()] == list(range(36))
    assert rows(trials.filter("trial = 10").select("dims", "pooling", "proj")) == [([256, 128], "mean", 128)]
    with pytest.raises(ValueError):
        grid.pairs([1], [2], "x")
    assert grid.training_splits("split_article", sweep=True)[0] == "split_article_20pct"
    with pytest.raises(ValueError):
        grid.training_splits("split_random", sweep=True, grid_has_split=True)


def test_evaluate_job(data):
    pdf, df = data
    named = df.filter("article_key IS NOT NULL")
    scores, losses = jobs.evaluate_predictions(named.filter("part = 'test'"), named.filter("part = 'train'"), ["dataset"], 8, 1)
    test = pdf[(pdf.part == "test") & pdf.article_key.notna()]
    for r in scores.collect():
        g = test[test.dataset == r["dataset"]]
        assert (r["r2"], r["rmse"], r["mae"]) == pytest.approx(plain_metrics(g["y"], g["p"]))
    assert losses.first()["rows"] == len(test)
    with pytest.raises(ValueError):
        regress.evaluate(named, named, [])


@pytest.mark.parametrize("block", [1, 3, 7, 512])
def test_whole_article_losses(spark, block):
    """Every pair of rows of an article counts once, whatever the blocks; ties in y, single rows, null targets and null articles."""
    rng = np.random.default_rng(block)
    data = [("d", ["a", "b", None][int(k)], float(y), float(p)) for k, y, p in zip(rng.integers(0, 3, 60), rng.integers(0, 9, 60), rng.normal(size=60))]
    data += [("d", "one", 1.0, 2.0), ("d", "a", None, 1.0), ("e", "flat", 2.0, 1.0), ("e", "flat", 2.0, 5.0)]
    df = spark.createDataFrame(data, "dataset string, article string, y double, p double").repartition(5)
    got = {r.dataset: r for r in am.whole_article_losses(df, ["article"], ["dataset"], block_rows=block).collect()}
    for name in "de":
        groups = {}
        for d, a, y, p in data:
            if d == name and y is not None:
                groups.setdefault(a, []).append((y, p))
        pair = [[math.log1p(math.exp(max(-50, min(50, q - p)))) for y, p in g for z, q in g if y > z] for g in groups.values()]
        e = [[p - y for y, p in g] for g in groups.values()]
        want = {
            "mse": np.mean(np.concatenate(e) ** 2), "consistency": np.mean([np.var(x) for x in e if len(x) > 1]), "bias": np.mean([np.mean(x) ** 2 for x in e]),
            "ranking": np.mean([np.mean(x) for x in pair if x]) if any(pair) else 0.0,
        }
        assert got[name].articles == len(groups) and got[name].n == sum(map(len, groups.values()))
        for k, v in want.items():
            assert got[name][k] == pytest.approx(v)


@pytest.mark.parametrize("spread", [0.5, 40.0])
def test_whole_article_losses_of_large_articles(spark, monkeypatch, spread):
    """An article is eight blocks however small ``block_rows`` is, so its rows are not copied once per ``block_rows`` rows; a bounded block
    gives more of them. Predictions near each other, far from each other, NaN and infinite ones."""
    rng = np.random.default_rng(7)
    data = [("big", float(y), float(p)) for y, p in zip(rng.integers(0, 900, 3000), rng.normal(size=3000) * spread)]
    data += [("odd", float(i % 4), p) for i, p in enumerate([1.0, float("nan"), float("inf"), -float("inf"), 3.0, 0.0, -1.0, float("nan")])]
    if spread == 0.5:
        data = [r for r in data if r[0] == "big"]
    df = spark.createDataFrame(data, "article string, y double, p double")
    means = []
    for name in {a for a, _, _ in data}:
        y, p = np.array([r[1:] for r in data if r[0] == name]).T
        with np.errstate(invalid="ignore"):
            x = p[:, None] - p[None, :]
        means.append(np.log1p(np.exp(np.where(np.isnan(x), 50.0, np.clip(x, -50, 50))))[y[:, None] < y[None, :]].mean())
    placed = []
    monkeypatch.setattr(am, "null_safe_join", lambda a, b, on, *how: placed.append((a, b)) or null_safe_join(a, b, on, *how))
    for most in (65_536, 100):
        monkeypatch.setattr(am, "MOST_BLOCK", most)
        placed.clear()
        assert am.whole_article_losses(df, ["article"], block_rows=1).first().ranking == pytest.approx(np.mean(means), rel=1e-9)
        last = placed[0][1].filter("article = 'big'").first()["_last"]
        assert last + 1 == (8 if most > 1000 else 30)
