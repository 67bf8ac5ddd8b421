"""Out-of-fold predictions, ablations and importances: ridge from sums of products, trees with the models of pyspark.ml, where the driver loops over folds and each fit is a Spark job."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import scratch
from . import spatial, stats


def _number(c: str) -> Column:
    """The column as a double, NaN as null."""
    return F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))


def _cut(df: DataFrame, name: str = "model-rows") -> DataFrame:
    """df as a table, so that the passes of many fits do not repeat its joins."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def medians(df: DataFrame, features: list[str], groups: list[Column]) -> np.ndarray:
    """(groups, features): exact medians over the rows of each group (a condition; groups may overlap), 0 for a feature without a value there. Null and NaN take no part. One pass of running counts for all; groups x features rows come back."""
    out = np.zeros((len(groups), len(features)))
    if not features or not groups:
        return out
    long = df.select(*[g.alias(f"g{j}_") for j, g in enumerate(groups)], F.inline(F.array(*[F.struct(F.lit(i).alias("i_"), _number(c).alias("v_")) for i, c in enumerate(features)])))
    c = stats.running_counts(long, "v_", {f"n{j}": F.count(F.when(F.col(f"g{j}_"), 1)) for j in range(len(groups))}, ["i_"])

    def covers(j: int, place: Column) -> Column:
        return F.max(F.when((F.col(f"n{j}_to") >= place) & (F.col(f"n{j}_to") - F.col(f"n{j}") < place), F.col("v_")))

    middle = [(covers(j, F.floor((F.col(f"n{j}_all") + 1) / 2)) + covers(j, F.floor(F.col(f"n{j}_all") / 2) + 1)) / 2 for j in range(len(groups))]
    for r in c.groupBy("i_").agg(*[m.alias(f"m{j}") for j, m in enumerate(middle)]).collect():
        out[:, r["i_"]] = [r[f"m{j}"] or 0.0 for j in range(len(groups))]
    return out


def _assembled(df: DataFrame, features: list[str], middle: np.ndarray) -> DataFrame:
    """df with `features_`, a vector; missing ones are their medians."""
    return df.withColumn("features_", array_to_vector(F.array(*[F.coalesce(_number(c), F.lit(float(m))) for c, m in zip(features, middle)])))


def regressor(kind: str, label: str, trees: int = 300, seed: int = 42):
    """forest or boosted."""
    if kind == "forest":
        return RandomForestRegressor(labelCol=label, featuresCol="features_", numTrees=trees, minInstancesPerNode=5, featureSubsetStrategy="sqrt", seed=seed)
    return GBTRegressor(labelCol=label, featuresCol="features_", maxIter=trees, maxDepth=5, stepSize=0.1, subsamplingRate=0.8, seed=seed)


def _ridge(train: DataFrame, group: str, tiers: dict[str, list[str]], label: str, middle: np.ndarray, others: bool, alpha: float = 1.0) -> list[Column]:
    """Predictions of a row for each tier, by its `group` (0 to len(middle) - 1): of ridge on the rows of train that are in its group, or with `others` in any other one; missing features count as the group's medians (`middle`: groups x features of all tiers).

    One pass sums products of features, of marks of missing ones and of labels by group: sums over filled features follow for whatever they are filled with."""
    features = list(dict.fromkeys(c for fs in tiers.values() for c in fs))
    xs, centre, n = [f"x{i}_" for i in range(len(features))], middle.mean(axis=0), len(features)
    rows = train.where(F.col(group).isNotNull()).select(F.col(group).cast("int").alias("fold_"), *[_number(c).alias(x) for c, x in zip(features, xs)], F.col(label).cast("double").alias("y_"))

    def design(b: pa.RecordBatch) -> list[np.ndarray]:
        x = _matrix(b, xs)
        none = np.isnan(x)
        return [np.column_stack([np.ones(len(x)), np.where(none, 0.0, x - centre), none, _matrix(b, ["y_"])])]

    sums = {f: g for (_, f), g in _gram_sums(rows, "fold_", 2 * n + 2, design).items()}
    whole, weights = sum(sums.values(), np.zeros((2 * n + 2, 2 * n + 2))), np.zeros((len(middle), len(tiers), n + 1))
    for k, m in enumerate(middle):
        fill = np.zeros((n + 2, 2 * n + 2))
        fill[: n + 1, : n + 1], fill[-1, -1] = np.eye(n + 1), 1.0
        fill[np.arange(n) + 1, np.arange(n) + n + 1] = m - centre
        own = sums.get(k, np.zeros_like(whole))
        if others:  # sums of the others, not a difference: with nobody else they are 0
            own = sum((g for f, g in sums.items() if f != k), np.zeros_like(whole))
        gram = fill @ own @ fill.T
        # features are standardised by sample deviations here, which is a larger penalty on population ones
        weights[k] = [ridge_weights(gram, [features.index(c) for c in fs], alpha * gram[0, 0] / max(gram[0, 0] - 1, 1)) for fs in tiers.values()]
    of = lambda v: F.get(F.array(*[F.lit(None if np.isnan(x) else float(x)).cast("double") for x in v]), F.col(group).cast("int"))
    out = []
    for j, fs in enumerate(tiers.values()):
        p = of(weights[:, j, 0])
        for i in dict.fromkeys(map(features.index, fs)):
            p = p + (F.coalesce(_number(features[i]), of(middle[:, i])) - float(centre[i])) * of(weights[:, j, i + 1])
        out.append(p)
    return out


def _held_out(known: DataFrame, tiers: dict[str, list[str]], fold: str, folds: int) -> dict[str, np.ndarray]:
    """For each tier (folds, features): medians over the rows outside each fold."""
    features = list(dict.fromkeys(c for fs in tiers.values() for c in fs))
    m = medians(known, features, [F.col(fold) != k for k in range(folds)])
    return {t: m[:, [features.index(c) for c in fs]] for t, fs in tiers.items()} | {"": m}


def _out_of_fold(df: DataFrame, tiers: dict[str, list[str]], label: str, fold: str, kind: str, folds: int, alpha: float = 1.0, **opts) -> dict[str, DataFrame]:
    """For each tier the rows of df, a table, with `prediction`, as in `out_of_fold`."""
    known, there = df.where(F.col(label).isNotNull()), df.where(F.col(fold).between(0, folds - 1))
    middle = _held_out(known, tiers, fold, folds)
    if kind == "ridge":
        p = _ridge(known, fold, tiers, label, middle[""], True, alpha)
        return {t: there.withColumn("prediction", c) for t, c in zip(tiers, p)}
    out: dict[str, DataFrame] = {}
    for t, fs in tiers.items():
        for k in range(folds):
            m = regressor(kind, label, **opts).fit(_assembled(known.where(F.col(fold) != k), fs, middle[t][k]))
            p = m.transform(_assembled(there.where(F.col(fold) == k), fs, middle[t][k])).select(*df.columns, "prediction")
            out[t] = out[t].unionByName(p) if t in out else p
    return out


def out_of_fold(df: DataFrame, features: list[str], label: str, fold: str, kind: str, folds: int = 5, **opts) -> DataFrame:
    """Every row of folds 0 to folds - 1 with `prediction` by the model (ridge, forest or boosted) fitted on the other folds; missing features are the medians of those. Ridge is on standardised features, from one pass of sums."""
    return _out_of_fold(_cut(df), {"": features}, label, fold, kind, folds, **opts)[""]


def station_floor(df: DataFrame, key: str, fold: str, order: str, label: str, folds: int = 5) -> DataFrame:
    """df with `prediction`: the last label of the row's key in the training order (a unique number) among the other folds, else the mean of the other folds. Rows with a null label teach nothing."""
    known = df.where(F.col(label).isNotNull())
    last = known.groupBy(key, fold).agg(F.max(F.struct(order, label)).alias("last_"))
    others = last.withColumn("to_", F.explode(F.array(*map(F.lit, range(folds))))).where(F.col("to_") != F.col(fold))
    best = others.groupBy(key, F.col("to_").alias(fold)).agg(F.max("last_")[label].alias("own_"))
    sums = known.groupBy(fold).agg(F.sum(label).alias("s_"), F.count("*").alias("c_"))  # a row for each fold
    to = sums.withColumn("to_", F.explode(F.array(*map(F.lit, range(folds))))).where(F.col("to_") != F.col(fold))
    means = to.groupBy(F.col("to_").alias(fold)).agg((F.sum("s_") / F.sum("c_")).alias("mean_"))
    out = df.join(best, [key, fold], "left").join(F.broadcast(means), fold, "left")
    return out.withColumn("prediction", F.coalesce("own_", "mean_")).drop("own_", "mean_")


def rolling_roles(df: DataFrame, year: str, windows: list[tuple[str, int, int, int, int]], least: tuple[int, int] = (50, 10)) -> DataFrame:
    """df's rows once for each window (name, first and last year to train on, first and last to test on) that they take part in, with `win` and `role`; windows with fewer rows than `least` in a role go."""
    spark = df.sparkSession
    w = spark.createDataFrame(windows, "win string, a_ int, b_ int, c_ int, d_ int")
    y = F.col(year)
    role = F.when(y.between(F.col("a_"), F.col("b_")), "train").when(y.between(F.col("c_"), F.col("d_")), "test")
    rows = df.join(F.broadcast(w), y.between(F.col("a_"), F.col("b_")) | y.between(F.col("c_"), F.col("d_"))).withColumn("role", role).drop("a_", "b_", "c_", "d_")
    n = rows.groupBy("win").agg(F.count(F.when(F.col("role") == "train", 1)).alias("t_"), F.count(F.when(F.col("role") == "test", 1)).alias("v_"))
    return rows.join(F.broadcast(n.where((F.col("t_") >= least[0]) & (F.col("v_") >= least[1])).select("win")), "win")


def rolling_floor(rows: DataFrame, key: str, order: str, label: str) -> DataFrame:
    """The test rows of `rolling_roles` with `prediction`: the last label of the key in the window's training order, else the training mean."""
    train, test = rows.where("role = 'train'"), rows.where("role = 'test'")
    own = train.groupBy("win", key).agg(F.max_by(label, order).alias("own_"))
    mean = train.groupBy("win").agg(F.avg(label).alias("mean_"))
    out = test.join(own, ["win", key], "left").join(F.broadcast(mean), "win")
    return out.withColumn("prediction", F.coalesce("own_", "mean_")).drop("own_", "mean_")


def rolling_origin(df: DataFrame, features: list[str], label: str, year: str, kinds: list[str], windows: list[tuple[str, int, int, int, int]], least: tuple[int, int] = (50, 10), alpha: float = 1.0, **opts) -> DataFrame:
    """rmse, r2, mae, n on the original scale (labels are log1p) for each model and window: fitted on the window's training years, scored on its test years. Ridge takes one pass for all windows, other models a fit for each.

    Rows are written once with their year; windows are conditions on it, so that rows in several windows are not copied."""
    rows = _cut(df.where(F.col(label).isNotNull()).select(*dict.fromkeys([*features, label, year])))
    some = rows.groupBy(year).count().collect()  # a row for each year
    n = lambda a, b: sum(r["count"] for r in some if r[year] is not None and a <= r[year] <= b)
    # a row that is in both spans trains
    windows = sorted(w for w in windows if n(w[1], w[2]) >= least[0] and n(w[3], w[4]) - n(max(w[1], w[3]), min(w[2], w[4])) >= least[1])
    y = F.col(year)
    train = [y.between(w[1], w[2]) for w in windows]
    test = [y.between(w[3], w[4]) & ~t for w, t in zip(windows, train)]
    middle, out = medians(rows, features, train), None
    for j, w in enumerate(windows):
        for kind in kinds:
            own, asked = rows.where(train[j]), rows.where(test[j])
            if kind == "ridge":
                p = asked.withColumn("g_", F.lit(0)).withColumn("prediction", _ridge(own.withColumn("g_", F.lit(0)), "g_", {"": features}, label, middle[j : j + 1], False, alpha)[0])
            else:
                p = regressor(kind, label, **opts).fit(_assembled(own, features, middle[j])).transform(_assembled(asked, features, middle[j]))
            p = p.select(F.expm1(label).alias("y_"), F.expm1("prediction").alias("p_")).agg(*stats.metrics("y_", "p_")).select(F.lit(w[0]).alias("win"), F.lit(kind).alias("model"), "*")
            out = p if out is None else out.unionByName(p)
    return out if out is not None else df.sparkSession.createDataFrame([], "win string, model string, rmse double, r2 double, mae double, n long")


def ablation(df: DataFrame, tiers: dict[str, list[str]], kinds: list[str], label: str, fold: str, folds: int = 5, **opts) -> DataFrame:
    """rmse, r2, mae, n of out-of-fold predictions for each tier of features and kind of model. Ridge takes three passes for all tiers (medians, sums, scores), other models a fit for each tier and fold."""
    rows = _cut(df.select(*dict.fromkeys([label, fold, *(c for fs in tiers.values() for c in fs)])))
    out = None
    for k in kinds:
        for t, p in _out_of_fold(rows, tiers, label, fold, k, folds, **opts).items():
            r = p.agg(*stats.metrics(label, "prediction")).select(F.lit(t).alias("tier"), F.lit(k).alias("model"), "*")
            out = r if out is None else out.unionByName(r)
    return out


def importances(df: DataFrame, features: list[str], label: str, kind: str = "boosted", top: int = 20, **opts) -> DataFrame:
    """The `top` features by importance in a tree model of all rows."""
    known = _cut(df.where(F.col(label).isNotNull()).select(*dict.fromkeys([*features, label])))
    w = regressor(kind, label, **opts).fit(_assembled(known, features, medians(known, features, [F.lit(True)])[0])).featureImportances.toArray()
    best = sorted(zip(map(float, w), features), key=lambda p: (-p[0], p[1]))[:top]
    return df.sparkSession.createDataFrame([(i + 1, f, v) for i, (v, f) in enumerate(best)], "rank int, feature string, importance double")


def _projection(n: int, dims: int = 2048, gamma: float = 1.0, seed: int = 42) -> Callable[[np.ndarray], np.ndarray]:
    """Rows of n features to rows of `dims` cosines and sines."""
    rng = np.random.default_rng(seed)
    w = rng.normal(scale=np.sqrt(2 * gamma), size=(n, dims // 2))
    b = rng.uniform(0, 2 * np.pi, dims // 2)

    def of(x: np.ndarray) -> np.ndarray:
        z = x @ w + b
        return np.concatenate([np.cos(z), np.sin(z)], axis=1) / np.sqrt(dims // 2)

    return of


def fourier_features(df: DataFrame, features: list[str], dims: int = 2048, gamma: float = 1.0, seed: int = 42) -> DataFrame:
    """`fourier`: cosines and sines of a seeded Gaussian projection, `dims` entries in all, with a kernel exp(-gamma d^2) in the limit. Missing features count as 0."""
    of, n = _projection(len(features), dims, gamma, seed), len(features)

    @F.pandas_udf("array<double>")
    def project(x: pd.Series) -> pd.Series:
        return pd.Series(list(of(np.stack(x.to_numpy()) if len(x) else np.zeros((0, n)))))

    return df.withColumn("fourier", project(F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features])))


#: Entries of a matrix of features that a task makes at a time.
_ENTRIES = 1 << 21


def fourier_ridge(df: DataFrame, features: list[str], label: str, fold: str, alpha: float = 1.0, folds: int = 5, tabular: list[str] | None = None, dims: int = 2048, **opts) -> DataFrame:
    """As `out_of_fold` with ridge on Fourier features and, beside them, the `tabular` columns (missing ones count as 0), none of them standardised; 4096 in all at most (normal equations). Rows without a label go.

    Two passes for all folds: sums of products by fold, and predictions. Features exist inside tasks only."""
    of, tabular, n, columns = _projection(len(features), dims, **opts), tabular or [], len(features), df.columns
    size = dims // 2 * 2 + len(tabular)
    xs = [f"x{i}_" for i in range(n + len(tabular))]
    rows = df.where(F.col(label).isNotNull() & F.col(fold).isNotNull()).select(*df.columns, F.col(fold).cast("int").alias("fold_"), F.col(label).cast("double").alias("y_"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(x) for c, x in zip([*features, *tabular], xs)])

    def ones_and_features(b: pa.RecordBatch) -> np.ndarray:
        x = _matrix(b, xs)
        return np.column_stack([np.ones(len(x)), of(x[:, :n]), x[:, n:]])

    sums = _gram_sums(rows.select("fold_", "y_", *xs), "fold_", size + 2, lambda b: [np.column_stack([ones_and_features(b), _matrix(b, ["y_"])])])
    weights = {}
    for k in range(folds):
        rest = sum((g for (_, f), g in sums.items() if f != k), np.zeros((size + 2, size + 2)))
        weights[k] = ridge_weights(rest, list(range(size)), alpha, scale=False)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _slices(whole, size):
                z, fold_, p = ones_and_features(b), b.column("fold_").to_numpy(), np.zeros(b.num_rows)
                for k in np.unique(fold_):
                    p[fold_ == k] = z[fold_ == k] @ weights[int(k)]
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in columns], pa.array(p)], names=[*columns, "prediction"])

    out = rows.where(F.col("fold_").between(0, folds - 1)).mapInArrow(score, df.select("*", F.lit(0.0).alias("prediction")).schema)
    return out.withColumn("prediction", _number("prediction"))


def patch_boosted(df: DataFrame, patch: str, label: str, fold: str, folds: int = 5, **opts) -> DataFrame:
    """As `out_of_fold` with boosted trees on the flattened patch, an array of numbers; null and NaN entries count as 0, rows with a null patch or label go."""
    d = df.where(F.col(patch).isNotNull() & F.col(label).isNotNull())
    d = d.withColumn("features_", array_to_vector(F.transform(patch, lambda x: F.coalesce(F.nanvl(x.cast("double"), F.lit(0.0)), F.lit(0.0)))))
    parts = [regressor("boosted", label, **opts).fit(d.where(F.col(fold) != k)).transform(d.where(F.col(fold) == k)).select(*df.columns, "prediction") for k in range(folds)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _matrix(b: pa.RecordBatch, columns: list[str]) -> np.ndarray:
    return np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in columns], axis=1) if columns else np.zeros((b.num_rows, 0))


def _slices(b: pa.RecordBatch, width: int) -> Iterator[pa.RecordBatch]:
    step = max(1, _ENTRIES // max(1, width))
    return (b.slice(i, step) for i in range(0, b.num_rows, step))


def _gram_sums(rows: DataFrame, fold: str, size: int, design: Callable[[pa.RecordBatch], list[np.ndarray]]) -> dict[tuple[int, int], np.ndarray]:
    """By target and fold the sums of products of what `design` makes of rows: for each target a matrix of `size` columns, the label last; rows with a NaN label teach nothing. Tasks sum their rows, lines of the matrices are summed by target, fold and place; targets x folds matrices come back."""

    def of_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for whole in batches:
            for b in _slices(whole, size):
                fold_ = b.column(fold).to_numpy(zero_copy_only=False)
                for t, z in enumerate(design(b)):
                    known = ~np.isnan(z[:, -1])
                    for f in np.unique(fold_[known]):
                        some = z[(fold_ == f) & known]
                        sums[t, int(f)] = sums.get((t, int(f)), 0.0) + some.T @ some
        for (t, f), g in sums.items():
            yield _as_rows([(t, f, i) for i in range(size)], g)

    def of_tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int, int], np.ndarray] = {}
        for b in batches:
            lines = b.column("gram_").flatten().to_numpy().reshape(b.num_rows, size)
            for at, g in zip(zip(*(b.column(c).to_pylist() for c in ("target_", "fold_", "line_"))), lines):
                sums[at] = sums.get(at, 0.0) + g
        if sums:
            yield _as_rows(list(sums), np.stack(list(sums.values())))

    def _as_rows(at: list[tuple[int, int, int]], lines: np.ndarray) -> pa.RecordBatch:
        ends = pa.array(np.arange(0, lines.size + 1, size, dtype=np.int32))
        return pa.RecordBatch.from_arrays([*[pa.array([a[i] for a in at], pa.int32()) for i in range(3)], pa.ListArray.from_arrays(ends, pa.array(np.ravel(lines)))], names=["target_", "fold_", "line_", "gram_"])

    schema = "target_ int, fold_ int, line_ int, gram_ array<double>"
    met = rows.mapInArrow(of_rows, schema).repartition("target_", "fold_", "line_").mapInArrow(of_tasks, schema)
    out: dict[tuple[int, int], np.ndarray] = {}
    for r in met.collect():
        out.setdefault((r["target_"], r["fold_"]), np.zeros((size, size)))[r["line_"]] = r["gram_"]
    return out


def ridge_weights(gram: np.ndarray, some: list[int], alpha: float, scale: bool = True) -> np.ndarray:
    """Intercept and weights of all features (0 where not in `some`) from sums of products of (1, features, label): features are standardised by population deviations (1 where they do not vary, and with `scale` off), the penalty is alpha on the sum of squares."""
    n, size = gram[0, 0], len(gram) - 2
    out = np.zeros(size + 1)
    if n == 0:
        return np.full(size + 1, np.nan)
    mean = gram[0] / n
    cov = gram - n * np.outer(mean, mean)
    at = [i + 1 for i in some]
    sd = np.sqrt(np.maximum(np.diag(cov)[at] / n, 0.0))
    sd = np.where(scale & (sd > 1e-12 * np.maximum(np.abs(mean[at]), 1.0)), sd, 1.0)
    a = cov[np.ix_(at, at)] / np.outer(sd, sd)
    w = np.linalg.solve(a + alpha * np.eye(len(at)), cov[at, -1] / sd) / sd if at else np.zeros(0)
    out[at] = w
    out[0] = mean[-1] - w @ mean[at]
    return out


def ridge_tiers(df: DataFrame, keys: list[str], tiers: dict[str, list[str]], targets: list[str], fold: str, alpha: float = 1.0) -> DataFrame:
    """(keys, fold, target, tier, y, prediction): out-of-fold ridge predictions for every target that a row has and every tier of features, from sums of products by fold.

    The sums without a fold are all sums less the fold's, and a tier's are a part of them: three passes over the rows in all (medians, sums, predictions), however many tiers, targets and folds.
    Missing features (null or NaN) count as their median over the rows with the target, 0 if there is none. Rows with a null fold go; with one fold there is nothing to learn from and predictions are null."""
    features = list(dict.fromkeys(c for fs in tiers.values() for c in fs))
    num = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    rows = df.where(F.col(fold).isNotNull()).select(*keys, F.col(fold).cast("int").alias(fold), *[num(c).alias(f"x{i}_") for i, c in enumerate(features)], *[num(t).alias(f"y{i}_") for i, t in enumerate(targets)])
    xs, ys = [f"x{i}_" for i in range(len(features))], [f"y{i}_" for i in range(len(targets))]
    long = rows.select(F.explode(F.array(*[F.when(F.col(y).isNotNull(), F.lit(t)) for t, y in enumerate(ys)])).alias("t_"), *xs).where("t_ IS NOT NULL")
    long = long.select("t_", F.inline(F.array(*[F.struct(F.lit(i).alias("i_"), F.col(x).alias("v_")) for i, x in enumerate(xs)])))
    centre = np.zeros((len(ys), len(xs)))
    for r in stats.percentiles(long, ["t_", "i_"], "v_", {"m": 0.5}).collect():  # targets x features rows
        centre[r["t_"], r["i_"]] = r["m"]

    def design(b: pa.RecordBatch) -> list[np.ndarray]:
        x = _matrix(b, xs)
        return [np.column_stack([np.ones(len(x)), np.where(np.isnan(x), 0.0, x - centre[t]), _matrix(b, [y])]) for t, y in enumerate(ys)]

    sums = _gram_sums(rows.select(fold, *xs, *ys), fold, len(xs) + 2, design)
    weights: dict[tuple[int, int], np.ndarray] = {}
    for t in range(len(ys)):
        own = {f: g for (s, f), g in sums.items() if s == t}
        for f, g in own.items():
            rest = sum(own.values()) - g if len(own) > 1 else np.zeros_like(g)
            weights[t, f] = np.stack([ridge_weights(rest, [features.index(c) for c in fs], alpha) for fs in tiers.values()])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, fold_ = _matrix(b, xs), b.column(fold).to_numpy(zero_copy_only=False)
            columns = []
            for t, name in enumerate(ys):
                y = b.column(name).to_numpy(zero_copy_only=False).astype(float)
                z = np.column_stack([np.ones(len(y)), np.where(np.isnan(x), 0.0, x - centre[t])])
                p = np.full((len(y), len(tiers)), np.nan)
                for f in np.unique(fold_[~np.isnan(y)]):
                    own = (fold_ == f) & ~np.isnan(y)
                    p[own] = z[own] @ weights[t, int(f)].T
                columns.append(p)
            flat = np.concatenate(columns, axis=1)
            ends = np.arange(0, flat.size + 1, max(1, flat.shape[1]), dtype=np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.ravel()))], names=[*b.schema.names, "p_"])

    scored = rows.mapInArrow(score, rows.select("*", F.array().cast("array<double>").alias("p_")).schema)
    each = [F.struct(F.lit(name).alias("target"), F.lit(tier).alias("tier"), F.col(ys[t]).alias("y"), F.nanvl(F.get("p_", F.lit(t * len(tiers) + j)), F.lit(None).cast("double")).alias("prediction")) for t, name in enumerate(targets) for j, tier in enumerate(tiers)]
    return scored.select(*keys, fold, F.inline(F.array(*each))).where("y IS NOT NULL")


def ridge_ablation(df: DataFrame, tiers: dict[str, list[str]], targets: list[str], fold: str, alpha: float = 1.0) -> DataFrame:
    """(target, tier, model, rmse, r2, mae, n): scores of `ridge_tiers` on the original scale, where labels are log1p of it."""
    p = ridge_tiers(df, [], tiers, targets, fold, alpha).select("target", "tier", F.expm1("y").alias("y"), F.expm1("prediction").alias("p"))
    return p.groupBy("target", "tier").agg(*stats.metrics("y", "p")).select("target", "tier", F.lit("ridge").alias("model"), "rmse", "r2", "mae", "n")


def even_folds(sizes: dict[int, int], folds: int) -> dict[int, int]:
    """Groups to folds: the largest first, each into the fold with the fewest rows so far (the first on ties); of groups of one size the last first."""
    load, out = [0] * folds, {}
    for g in sorted(sizes, key=lambda g: (sizes[g], g), reverse=True):
        out[g] = load.index(min(load))
        load[out[g]] += sizes[g]
    return out


def grid_forests(values: DataFrame, places: DataFrame, cells: DataFrame, key: str, cell: str, layer: list[str], value: str, covariates: list[str], least: int = 10, folds: int = 5, trees: int = 100, seed: int = 42) -> DataFrame:
    """(cell, layer columns, prediction, n, rmse): for each layer of values (key, layer columns, value) a forest of the keys' covariates and coordinates, scored over all cells, and its error out of fold.

    places: key, lat, x, y, covariates; cells: cell, x, y. A cell has the covariates of the layer's nearest key. Missing covariates are a layer's median, over its keys to learn from and over the cells to score. Folds are groups of whole degrees of latitude
    (`even_folds`, five at most); rmse is null below ten rows or two groups. Layers with fewer keys than `least` keep their cells with a null prediction. Keys without a value or place go.

    One search finds the nearest keys for all layers; each forest reads its own layer's part of two tables, and all cells are scored in one job. Layers x degrees rows reach the driver."""
    spark = values.sparkSession
    degree = F.col("lat").cast("int").alias("degree_")
    rows = values.where(F.col(value).isNotNull()).join(places.where("lat IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL"), key).select(key, *layer, degree, "x", "y", *covariates, F.col(value).cast("double").alias("y_"))
    rows = _filled(rows, layer, covariates)
    path = scratch(spark, "layer-keys")
    rows.write.partitionBy(*layer).parquet(path)
    kinds = {f.name: f.dataType for f in values.schema}
    rows = spark.read.schema(rows.schema).parquet(path).select(key, *[F.col(c).cast(kinds[c]).alias(c) for c in layer], "degree_", "x", "y", *covariates, "y_")
    sizes: dict[tuple, dict[int, int]] = {}
    for r in rows.groupBy(*layer, "degree_").count().collect():
        sizes.setdefault(tuple(r[c] for c in layer), {})[r["degree_"]] = r["count"]
    none = cells.select(cell, *[F.lit(None).cast(kinds[c]).alias(c) for c in layer], F.lit(None).cast("double").alias("prediction"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("double").alias("rmse")).limit(0)
    if not sizes:
        return none
    names = F.array(*[F.struct(*[F.lit(v).cast(kinds[c]).alias(c) for c, v in zip(layer, name)]) for name in sizes])
    asked = cells.select(cell, "x", "y", F.inline(names))  # a row for each cell and layer, as in the result
    near = spatial.nearest_in_layers(asked, rows.select(key, *layer, F.col("x").alias("rx"), F.col("y").alias("ry")), cell, key, layer)
    own = near.select(cell, key, *layer).join(rows.select(key, *layer, *covariates), [key, *layer]).join(cells.select(cell, "x", "y"), cell).select(cell, *layer, "x", "y", *covariates)
    path = scratch(spark, "layer-cells")
    own = _filled(own, layer, covariates)
    own.write.partitionBy(*layer).parquet(path)
    own = spark.read.schema(own.schema).parquet(path).select(cell, *[F.col(c).cast(kinds[c]).alias(c) for c in layer], "x", "y", *covariates)
    vector = array_to_vector(F.array(*[F.col(c).cast("double") for c in [*covariates, "x", "y"]])).alias("features_")
    out = None
    for name, degrees in sorted(sizes.items(), key=lambda p: str(p[0])):
        at = F.lit(True)
        for c, v in zip(layer, name):
            at = at & (F.col(c) == F.lit(v).cast(kinds[c]))
        n, k = sum(degrees.values()), min(folds, len(degrees))
        mine, target = rows.where(at).select("degree_", "y_", vector), own.where(at).select(cell, *layer, vector)
        forest = lambda d: regressor("forest", "y_", trees=trees, seed=seed).fit(d)
        error = F.lit(None).cast("double")
        if n < least:
            p = target.select(cell, *layer, F.lit(None).cast("double").alias("prediction"))
        else:
            if n >= 10 and k >= 2:
                fold_of = even_folds(degrees, k)
                held = mine.withColumn("fold_", F.create_map(*[F.lit(x) for p in fold_of.items() for x in p])[F.col("degree_")])
                parts = [forest(held.where(F.col("fold_") != f)).transform(held.where(F.col("fold_") == f)).select(F.pow(F.col("prediction") - F.col("y_"), F.lit(2.0)).alias("e_")) for f in range(k)]
                for x in parts[1:]:
                    parts[0] = parts[0].unionByName(x)
                error = F.lit(parts[0].agg(F.sqrt(F.avg("e_")).alias("e")).first()["e"])
            p = forest(mine).transform(target).select(cell, *layer, "prediction")
        p = p.withColumns({"n": F.lit(n).cast("long"), "rmse": error})
        out = p if out is None else out.unionByName(p)
    return out


def layer_errors(df: DataFrame, features: list[str], labels: list[str], layer: str, fold: str, folds: int = 5, at_once: int = 4, **opts) -> DataFrame:
    """(param, layer, rmse, n): for each label and every value of `layer` in df the error of forests out of fold, each fitted on that layer's rows of the other folds; missing features are the medians of those. n rows are scored; rmse is null below five.

    Null and NaN labels teach nothing and are not scored, nor are rows of a fold that has no others to learn from. Rows without a layer or fold go.
    Rows are written once, by layer, so that a fit reads its own part; `at_once` labels and layers are under way together. Layers x folds rows of counts reach the driver, and one for each label and layer."""
    spark = df.sparkSession
    xs, ys = [f"x{i}_" for i in range(len(features))], [f"y{i}_" for i in range(len(labels))]
    rows = df.where(F.col(layer).isNotNull() & F.col(fold).isNotNull()).select(F.col(layer).alias("layer_"), F.col(fold).cast("int").alias("fold_"), *[_number(c).alias(x) for c, x in zip([*features, *labels], [*xs, *ys])])
    path = scratch(spark, "layer-rows")
    rows.write.partitionBy("layer_").parquet(path)
    rows = spark.read.schema(rows.schema).parquet(path)
    sizes: dict = {}
    for r in rows.groupBy("layer_", "fold_").agg(*[F.count(y).alias(y) for y in ys], *[F.count(F.when(F.col(x).isNull(), 1)).alias(x) for x in xs]).collect():
        sizes.setdefault(r["layer_"], []).append(r)

    def error(at, param: str, y: str) -> tuple:
        n = {r["fold_"]: r[y] for r in sizes[at]}
        held = [k for k in range(folds) if n.get(k, 0) > 0 and sum(n.values()) > n[k]]
        if not held:
            return param, at, None, 0
        own = rows.where((F.col("layer_") == F.lit(at)) & F.col(y).isNotNull())
        gaps = [i for i, x in enumerate(xs) if any(r[x] for r in sizes[at])]
        middle = np.zeros((len(held), len(xs)))
        middle[:, gaps] = medians(own, [xs[i] for i in gaps], [F.col("fold_") != k for k in held])
        fit = lambda k, m: regressor("forest", y, **opts).fit(_assembled(own.where(F.col("fold_") != k), xs, m)).transform(_assembled(own.where(F.col("fold_") == k), xs, m)).select(y, "prediction")
        r = reduce(DataFrame.unionByName, [fit(k, m) for k, m in zip(held, middle)]).agg(*stats.metrics(y, "prediction")).first()
        return param, at, r["rmse"], r["n"]

    tasks = [(at, param, y) for at in sizes for param, y in zip(labels, ys)]
    with ThreadPool(at_once) as pool:
        out = pool.starmap(lambda f, task: f(*task), [(inheritable_thread_target(spark)(error), task) for task in tasks])
    return spark.createDataFrame(out, f"param string, `{layer}` {df.schema[layer].dataType.simpleString()}, rmse double, n long")


def _filled(df: DataFrame, layer: list[str], covariates: list[str]) -> DataFrame:
    """df with missing covariates as their layer's median, 0 where the layer has none."""
    for c in covariates:
        m = stats.percentiles(df.select(*layer, c), layer, c, {"m_": 0.5})
        df = df.join(m, layer, "left").withColumn(c, F.coalesce(F.col(c).cast("double"), "m_", F.lit(0.0))).drop("m_")
    return df
