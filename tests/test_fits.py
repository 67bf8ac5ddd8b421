"""Fits over folds and windows: what they pass over and send to the driver, against refits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from limnos.operators import models
from limnos.plans import q_cases


def jobs(spark, run):
    """(result, Spark jobs it took)."""
    tracker, group = spark.sparkContext.statusTracker(), f"g{np.random.default_rng().integers(1 << 60)}"
    spark.sparkContext.setJobGroup(group, group)
    out = run()
    n = len(tracker.getJobIdsForGroup(group))
    spark.sparkContext.setJobGroup("rest", "rest")
    return out, n


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    n = 300
    x = np.column_stack([rng.normal(1000, 2, n), rng.normal(0, 30, n)])
    x[rng.random((n, 2)) < 0.2] = np.nan
    y = np.nan_to_num(x[:, 1]) / 20 + rng.normal(0, 0.3, n) + 3
    fold = rng.integers(0, 3, n)
    rows = [(i, *[None if np.isnan(v) else float(v) for v in x[i]], None if i % 29 == 0 else float(y[i]), int(fold[i]), 2000 + i % 4) for i in range(n)]
    return x, y, fold, spark.createDataFrame(rows, "id int, a double, b double, y double, fold int, yr int").repartition(4)


def ridge(x, y, asked, alpha=1.0):
    m = np.nanmedian(x, axis=0)
    x, asked = np.where(np.isnan(x), m, x), np.where(np.isnan(asked), m, asked)
    mean, sd = x.mean(axis=0), x.std(axis=0, ddof=1)
    z = (x - mean) / sd
    w = np.linalg.solve(z.T @ z + alpha * np.eye(x.shape[1]), z.T @ (y - y.mean()))
    return y.mean() + (asked - mean) / sd @ w


def test_ablation_takes_one_pass_of_sums(spark, table):
    """a fit and an approximate median for each tier and fold; medians were not those of the other folds."""
    x, y, fold, df = table
    got, n = jobs(spark, lambda: models.ablation(df, {"one": ["b"], "two": ["a", "b"]}, ["ridge"], "y", "fold", folds=3).collect())
    assert n < 25
    known = np.arange(300) % 29 != 0
    for r, cs in zip(got, ([1], [0, 1])):
        p = np.full(300, np.nan)
        for k in range(3):
            p[fold == k] = ridge(x[known & (fold != k)][:, cs], y[known & (fold != k)], x[fold == k][:, cs])
        assert r["n"] == known.sum() and abs(r["rmse"] - np.sqrt(np.mean((p - y)[known] ** 2))) < 1e-9
    empty = models.ablation(df.limit(0), {"one": ["b"]}, ["ridge"], "y", "fold").collect()
    assert [(r["tier"], r["rmse"], r["n"]) for r in empty] == [("one", None, 0)]


def test_rolling_windows_are_refits(spark, table):
    """each fit repeated the joins of its rows."""
    x, y, _, df = table
    known, yr = np.arange(300) % 29 != 0, 2000 + np.arange(300) % 4
    windows = [("b", 2000, 2001, 2001, 2002), ("a", 2000, 2002, 2003, 2003), ("none", 1990, 1991, 2000, 2000)]
    got = models.rolling_origin(df, ["a", "b"], "y", "yr", ["ridge"], windows).collect()
    assert [r["win"] for r in got] == ["a", "b"]
    for r, train, test in zip(got, (yr < 2003, yr < 2002), (yr == 2003, yr == 2002)):
        p = ridge(x[known & train], y[known & train], x[known & test])
        assert r["n"] == (known & test).sum() and abs(r["rmse"] / np.sqrt(np.mean((np.expm1(p) - np.expm1(y[known & test])) ** 2)) - 1) < 1e-9


def test_medians_are_exact(spark, table):
    """the medians of missing features were approximate, from summaries that every task sent to the driver."""
    x, y, fold, df = table
    got = models.medians(df, ["a", "b"], [F.col("fold") != 0, F.col("id") < 7, F.col("id") < 0])
    assert np.array_equal(got, [np.nanmedian(x[fold != 0], axis=0), np.nanmedian(x[:7], axis=0), [0, 0]])
    trees = models.out_of_fold(df, ["a", "b"], "y", "fold", "forest", folds=3, trees=5)
    assert trees.count() == 300 and trees.where("prediction IS NULL").count() == 0


def test_fourier_ridge_is_the_closed_form(spark, table):
    """A fit for each fold over features that every pass made anew."""
    x, y, fold, df = table
    got, n = jobs(spark, lambda: {r["id"]: r["prediction"] for r in models.fourier_ridge(df.withColumn("c", F.col("b") / 30), ["c"], "y", "fold", folds=3, tabular=["a"], dims=8, gamma=0.5).collect()})
    assert n < 8
    known = np.arange(300) % 29 != 0
    f = models._projection(1, 8, 0.5)(np.nan_to_num(x[:, 1:]) / 30)
    z, want = np.column_stack([f, np.nan_to_num(x[:, 0])]), np.zeros(300)
    for k in range(3):
        t = known & (fold != k)
        c = z[t] - z[t].mean(axis=0)
        want[fold == k] = y[t].mean() + (z[fold == k] - z[t].mean(axis=0)) @ np.linalg.solve(c.T @ c + np.eye(9), c.T @ (y[t] - y[t].mean()))
    assert set(got) == set(np.flatnonzero(known)) and all(abs(got[i] - want[i]) < 1e-6 for i in got)


def test_layer_errors_take_every_layer(spark, table):
    """forests of every layer of the rows, against fits one by one; a layer of one fold, rows without a layer or fold, a NaN label."""
    x, y, fold, df = table
    more = [(300 + i, 1.0, 2.0, 3.0, 1, 2009) for i in range(8)] + [(400, 1.0, 2.0, 3.0, 1, None), (401, 1.0, 2.0, 3.0, None, 2001), (402, 1.0, 2.0, float("nan"), 1, 2001)]
    rows = df.unionByName(spark.createDataFrame(more, df.schema)).withColumn("z", F.when(F.col("yr") > 2001, F.col("y")))
    got = {(r["param"], r["yr"]): r for r in models.layer_errors(rows, ["a", "b"], ["y", "z"], "yr", "fold", folds=3, trees=5).collect()}
    assert set(got) == {(p, t) for p in "yz" for t in (2000, 2001, 2002, 2003, 2009)}
    for (p, t), r in got.items():
        none = t == 2009 or p == "z" and t < 2002
        assert r["n"] == (0 if none else sum(i % 29 != 0 and i % 4 == t - 2000 for i in range(300))) and (r["rmse"] is None) == none
    one = models.out_of_fold(df.where("yr = 2002"), ["a", "b"], "y", "fold", "forest", folds=3, trees=5).select(F.sqrt(F.avg((F.col("y") - F.col("prediction")) ** 2))).first()[0]
    assert got["y", 2002]["rmse"] == got["z", 2002]["rmse"] and abs(got["y", 2002]["rmse"] - one) < 0.3
    assert models.layer_errors(df.where("id < 0"), ["a"], ["y"], "yr", "fold").count() == 0


def test_grid_forest_reads_all_years(spark, tmp_path):
    """the samples of two years only, and two of three parameters, were read."""
    spark.createDataFrame([(k, k % 5, 100.0 * k, "A") for k in range(30)], "c_custkey long, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    years = (1994, 1996, 1997, 2003)
    orders = [(k, k % 30, f"{years[k % 4]}-05-01" if k % 11 else None, 1.0) for k in range(240)] + [(240, 1, "1980-01-01", 1.0), (241, 99, "1981-01-01", 1.0)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate string, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    got = {(r["param"], r["yr"]): r for r in q_cases.gr5_grid_forest(spark, str(tmp_path)).collect()}
    assert set(got) == {(p, t) for p in ("tp", "chla", "secchi") for t in (*years, 1980)}
    for (p, t), r in got.items():
        n = sum(k % 11 != 0 and years[k % 4] == t and (p != "secchi" or k % 7 != 0) for k in range(240))
        assert r["n"] == n and (r["rmse"] is None) == (n == 0)
        assert abs(r["mean_rmse"] - np.mean([got[p, u]["rmse"] for u in years])) < 1e-9
