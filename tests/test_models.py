"""One-pass ridge against refits, folds of groups, forests over a grid, nearest points in layers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from limnos.operators import models, spatial


def refit(x, y, fold, alpha=1.0):
    """Out-of-fold predictions of ridge on standardised features, a fit for each fold."""
    out = np.full(len(y), np.nan)
    for f in set(fold):
        a, b = fold != f, fold == f
        if not a.any():
            continue
        m, s = x[a].mean(axis=0), x[a].std(axis=0)
        s = np.where(s > 1e-12 * np.maximum(np.abs(m), 1), s, 1)
        z = (x[a] - m) / s
        w = np.linalg.solve(z.T @ z + alpha * np.eye(x.shape[1]), z.T @ (y[a] - y[a].mean()))
        out[b] = y[a].mean() + (x[b] - m) / s @ w
    return out


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(1)
    n = 400
    x = np.column_stack([rng.normal(1e4, 3, n), rng.normal(0, 50, n), rng.uniform(0, 1, n), np.full(n, 7.0)])
    x[rng.random((n, 4)) < 0.1] = np.nan
    y = np.nan_to_num(x[:, 1]) / 20 + rng.normal(0, 0.3, n) + 3
    y2 = np.where(rng.random(n) < 0.3, np.nan, rng.normal(1, 1, n))
    fold = rng.integers(0, 4, n)
    rows = [(k, *[None if np.isnan(v) else float(v) for v in (*x[k], y[k], y2[k])], int(fold[k])) for k in range(n)]
    return x, y, y2, fold, spark.createDataFrame(rows, "id int, a double, b double, c double, d double, y double, y2 double, fold int").repartition(5)


TIERS = {"one": ["b"], "two": ["a", "c"], "all": ["a", "b", "c", "d"]}


def test_one_pass_equals_refits(table):
    x, y, y2, fold, df = table
    got = {(r["target"], r["tier"], r["id"]): r for r in models.ridge_tiers(df, ["id"], TIERS, ["y", "y2"], "fold").collect()}
    assert len(got) == 3 * (len(y) + int((~np.isnan(y2)).sum()))
    for name, label in (("y", y), ("y2", y2)):
        own = ~np.isnan(label)
        full = np.where(np.isnan(x[own]), np.nanmedian(x[own], axis=0), x[own])
        for tier, fs in TIERS.items():
            want = refit(full[:, ["abcd".index(f) for f in fs]], label[own], fold[own])
            mine = np.array([got[name, tier, k]["prediction"] for k in np.flatnonzero(own)])
            assert np.allclose(mine, want, rtol=1e-7, atol=1e-7)


def test_one_pass_edges(spark, table):
    df = table[-1]
    assert models.ridge_ablation(df.limit(0), TIERS, ["y", "y2"], "fold").count() == 0
    alone = models.ridge_tiers(df.withColumn("fold", F.lit(0)), ["id"], TIERS, ["y"], "fold")
    assert alone.where("prediction IS NOT NULL").count() == 0 and alone.count() == 3 * 400
    none = df.withColumns({"a": F.lit(None).cast("double"), "fold": F.when(F.col("id") < 300, F.col("fold"))})
    assert models.ridge_tiers(none, ["id"], {"a": ["a"], "nothing": []}, ["y"], "fold").where("prediction IS NULL").count() == 0


def test_even_folds():
    assert models.even_folds({60: 5, 61: 5, 62: 3, 63: 9, 64: 1}, 2) == {63: 0, 61: 1, 60: 1, 62: 0, 64: 1}


def test_nearest_in_layers(spark):
    rng = np.random.default_rng(2)
    points = [(k, k % 3, float(x), float(y)) for k, (x, y) in enumerate(rng.normal(0, 1, (120, 2)) * 10.0 ** rng.integers(-2, 4, (120, 1)))] + [(500, 7, 1.0, 1.0), (501, 0, None, 2.0)]
    keys = [(k, j, float(x), float(y)) for k, (x, y) in enumerate(rng.uniform(-3000, 3000, (60, 2))) for j in (0, 1, 2, 7, 8)]
    got = {(r["k"], r["layer"]): (r["p"], r["dist"]) for r in spatial.nearest_in_layers(spark.createDataFrame(keys, "k int, layer int, x double, y double"), spark.createDataFrame(points, "p int, layer int, rx double, ry double"), "k", "p", ["layer"]).collect()}
    want = {}
    for k, j, x, y in keys:
        own = [(round(np.hypot(a - x, b - y), 3), p) for p, i, a, b in points if i == j and a is not None]
        if own:
            want[k, j] = min(own)[1]
    assert {k: v[0] for k, v in got.items()} == want
    assert spatial.nearest_in_layers(spark.createDataFrame(keys, "k int, layer int, x double, y double"), spark.createDataFrame([], "p int, layer int, rx double, ry double"), "k", "p", ["layer"]).count() == 0


def test_grid_forests(spark):
    rng = np.random.default_rng(3)
    places = [(k, float(55 + k % 7), float(rng.uniform(0, 100)), float(rng.uniform(0, 100)), None if k % 10 == 0 else float(k % 2)) for k in range(80)]
    values = [(k, "p", 1, 10.0 * (k % 2)) for k in range(80)] + [(k, "few", 1, 1.0) for k in range(4)] + [(k, "p", 2, None) for k in range(80)]
    cells = spark.createDataFrame([(c, float(c % 10 * 11), float(c // 10 * 11)) for c in range(100)], "cell int, x double, y double")
    out = models.grid_forests(spark.createDataFrame(values, "k int, param string, yr int, v double"), spark.createDataFrame(places, "k int, lat double, x double, y double, cov double"), cells, "k", "cell", ["param", "yr"], "v", ["cov"], trees=20).collect()
    by = {}
    for r in out:
        by.setdefault((r["param"], r["yr"]), {})[r["cell"]] = r
    assert set(by) == {("p", 1), ("few", 1)} and all(len(c) == 100 for c in by.values())
    assert all(r["prediction"] is None and r["rmse"] is None and r["n"] == 4 for r in by["few", 1].values())
    xy, means = {k: (x, y, c) for k, _, x, y, c in places}, {0.0: [], 1.0: []}
    for c, r in by["p", 1].items():
        x, y = c % 10 * 11.0, c // 10 * 11.0
        cov = min(xy.values(), key=lambda p: (p[0] - x) ** 2 + (p[1] - y) ** 2)[2]
        assert r["n"] == 80 and 0 < r["rmse"] < 5
        if cov is not None:
            means[cov].append(r["prediction"])
    assert np.mean(means[1.0]) > np.mean(means[0.0]) + 3
    assert models.grid_forests(spark.createDataFrame([], "k int, param string, yr int, v double"), spark.createDataFrame(places, "k int, lat double, x double, y double, cov double"), cells, "k", "cell", ["param", "yr"], "v", ["cov"]).count() == 0
