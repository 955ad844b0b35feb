"""Additive statistics and ridge fits against numpy on the rows themselves."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from litprops.functions.hashing import hash_fraction
from litprops.operators import gram, regress, scaling
from litprops.operators.metrics import regression_metrics
from tests.conftest import rows

SCHEMA = "row_idx long, dataset string, domain string, part string, transform string, pooled array<float>, y double"


def records(n=400, width=5, seed=3):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        x = rng.normal(size=width).astype(np.float32)
        x[-1] = 7.0  # constant
        data = ["a", "b", None][i % 3]
        y = float(np.exp(0.3 * x[0] + 0.1 * rng.normal())) if data == "b" else float(2 * x[0] - x[1] + 0.5 * rng.normal() + 100)
        out.append((i, data, ["low", "high"][i % 2], ["train", "train", "val", "test", "train"][i % 5], "log" if data == "b" else "identity", [float(v) for v in x], y))
    return out


def plain_fit(x, t, ridge):
    mean, std = x.mean(0), x.std(0)
    used = std > 1e-9
    z = (x[:, used] - mean[used]) / std[used]
    w = np.zeros(x.shape[1])
    w[used] = np.linalg.solve(z.T @ z / len(z) + ridge * np.eye(used.sum()), z.T @ (t - t.mean()) / len(z)) / std[used]
    return w, t.mean() - w @ mean


def taken(data, keep):
    got = [r for r in data if keep(r)]
    return np.array([r[5] for r in got]), np.array([np.log(r[6]) if r[4] == "log" else r[6] for r in got])


@pytest.mark.parametrize("held", [1, 256])
def test_statistic_is_the_sum_of_products(spark, monkeypatch, held):
    monkeypatch.setattr(gram, "OPEN_GROUPS", held)
    data = records()
    df = spark.createDataFrame(data + [(900, "a", "low", "train", "identity", None, 1.0)], SCHEMA).repartition(7)
    got = {r.dataset: np.array(r.s) for r in gram.moments(df, ["dataset"]).collect()}
    assert set(got) == {"a", "b", None}
    for name, s in got.items():
        x, t = taken(data, lambda r: r[1] == name)
        z = np.column_stack([np.ones(len(x)), x, t])
        assert np.allclose(s, (z.T @ z)[np.triu_indices(z.shape[1])])


def test_scalers_equal_those_of_the_rows(spark):
    df = spark.createDataFrame(records(), SCHEMA)
    mine = rows(gram.scalers(gram.moments(df, ["dataset"]), ["dataset"]), "dataset")
    other = rows(scaling.fit(df, ["dataset"]), "dataset")
    assert [(r[0], r[1]) for r in mine] == [(r[0], r[1]) for r in other]
    assert np.allclose([r[3:] for r in mine], [r[2:] for r in other])
    constant = spark.createDataFrame([(1, "a", "x", "train", "identity", [1.0], 5.0)] * 3, SCHEMA)
    assert rows(gram.scalers(gram.moments(constant, ["dataset"]), ["dataset"]))[0][2:] == (3, 5.0, 1.0)


def test_every_ridge_value_from_one_statistic(spark):
    data = records()
    df = spark.createDataFrame(data, SCHEMA)
    solved = gram.solve(gram.in_standard_units(gram.moments(df, ["dataset"])), ["dataset"], [0.0, 0.1, 5.0]).collect()
    for r in solved:
        x, t = taken(data, lambda q: q[1] == r.dataset)
        for m in r.models:
            w, b = plain_fit(x, (t - t.mean()) / t.std(), m.ridge)
            assert np.allclose(m.weights, w, atol=1e-6) and np.isclose(m.intercept, b, atol=1e-6)


def test_directions_without_variation_get_no_weight(spark):
    """Two equal coordinates without ridge: the least-squares fit of smallest norm, not a division by zero."""
    data = [(i, "a", "x", "train", "identity", [float(i), float(i), 1.0], 3.0 * i + 1) for i in range(10)]
    m = gram.solve(gram.moments(spark.createDataFrame(data, SCHEMA), ["dataset"]), ["dataset"], [0.0]).first().models[0]
    assert np.allclose(m.weights, [1.5, 1.5, 0.0]) and np.isclose(m.intercept, 1.0)


def test_nested_fractions_are_sums(spark):
    data = records()
    df = spark.createDataFrame(data, SCHEMA)
    fraction = {r.row_idx: r.u for r in df.select("row_idx", hash_fraction("9:fraction", "row_idx").alias("u")).collect()}
    got = {(r.dataset, r.pct, r.ridge): r for r in regress.fraction_sweep(df, ["dataset"], ["row_idx"], 9, [30, 60, 100], [0.1, 1.0]).filter("dataset is not null").collect()}
    assert len(got) == 12
    for (name, pct, ridge), r in got.items():
        x, t = taken(data, lambda q: q[1] == name and q[3] == "train" and fraction[q[0]] * 100 < pct)
        w, b = plain_fit(x, t, ridge)
        vx, vt = taken(data, lambda q: q[1] == name and q[3] == "val")
        p, y = vx @ w + b, vt
        if name == "b":
            p, y = np.exp(p), np.exp(y)
        assert r.n_train == len(x) and r.n == len(vx)
        assert np.isclose(r.rmse, np.sqrt(np.mean((y - p) ** 2)), rtol=1e-5) and np.isclose(r.mae, np.mean(np.abs(y - p)), rtol=1e-5)


def test_tuning_adds_the_target_domain(spark):
    data = [r for r in records() if r[1] == "a"]
    df = spark.createDataFrame(data, SCHEMA)
    got = {r.stage: r for r in regress.tune_domain(df, F.col("domain") == "low", F.col("domain") == "high", 0.2).collect()}
    tx, ty = taken(data, lambda q: q[2] == "high" and q[3] == "test")
    for stage, domains in (("before", ["low"]), ("after", ["low", "high"])):
        w, b = plain_fit(*taken(data, lambda q: q[3] == "train" and q[2] in domains), 0.2)
        assert np.isclose(got[stage].rmse, np.sqrt(np.mean((ty - tx @ w - b) ** 2)), rtol=1e-6)
    assert np.isclose(got["improvement"].rmse, got["before"].rmse - got["after"].rmse)


def test_unequal_widths_are_an_error(spark):
    df = spark.createDataFrame([(1, "a", "x", "train", "identity", [1.0], 5.0), (2, "a", "x", "train", "identity", [1.0, 2.0], 5.0)], SCHEMA).coalesce(1)
    with pytest.raises(Exception, match="different widths"):
        gram.moments(df, ["dataset"]).collect()
    assert gram.moments(df.limit(0), ["dataset"]).count() == 0


def test_joint_fit_scores_each_property(spark):
    data = [r for r in records() if r[1]]
    fitted = regress.fit_predict(spark.createDataFrame(data, SCHEMA), ["dataset"], 0.1)
    scaled = []
    for name in "ab":
        x, t = taken(data, lambda q: q[1] == name and q[3] == "train")
        scaled.append((x, (t - t.mean()) / t.std(), t.mean(), t.std()))
    w, b = plain_fit(np.concatenate([s[0] for s in scaled]), np.concatenate([s[1] for s in scaled]), 0.1)
    for r in fitted.collect():
        _, _, mean, std = scaled["ab".index(r.dataset)]
        p = (np.array(r.pooled) @ w + b) * std + mean
        assert np.isclose(r.p, np.exp(p) if r.dataset == "b" else p, rtol=1e-5)
    assert regression_metrics(fitted, ["dataset"]).count() == 2
