"""Paired statistics, metrics of predictions, conformal and interval scores: one grouped pass each."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.sinks import scratch


def correlation(x: Column, y: Column) -> Column:
    """Pearson's r over rows that have both, between -1 and 1; null where either does not vary, for which `corr` fails under ANSI rules."""
    both = x.isNotNull() & y.isNotNull()
    spread = F.stddev_pop(F.when(both, x)) * F.stddev_pop(F.when(both, y))
    r = F.covar_pop(x, y) / F.nullif(spread, F.lit(0.0))
    return F.when(r.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))


def paired(x: str, y: str, least: int = 10) -> list[Column]:
    """n, r2, rmse, bias; the last three null below `least` pairs."""
    a, b = F.col(x), F.col(y)
    n = F.count(a + b)
    ok = lambda c: F.when(n >= least, c)
    return [n.alias("n"), ok(F.pow(correlation(a, b), F.lit(2.0))).alias("r2"), ok(F.sqrt(F.avg((b - a) * (b - a)))).alias("rmse"), ok(F.avg(b - a)).alias("bias")]


def metrics(y: str, yhat: str, least: int = 5) -> list[Column]:
    """rmse, r2 = 1 - SSE / SST, mae, n; null below `least` rows."""
    e = F.col(y) - F.col(yhat)
    n = F.count(e)
    ok = lambda c: F.when(n >= least, c)
    return [ok(F.sqrt(F.avg(e * e))).alias("rmse"), ok(1 - F.sum(e * e) / F.nullif(F.var_pop(F.when(e.isNotNull(), F.col(y))) * n, F.lit(0.0))).alias("r2"), ok(F.avg(F.abs(e))).alias("mae"), n.alias("n")]


def order_statistics(df: DataFrame, keys: list[str], value: str, wanted: Callable[[Column, float], Column], levels: list[float]) -> DataFrame:
    """(keys, level, q): the value whose place in ascending order, from 1, is wanted(rows of the key, level). From running counts, in one pass: no task orders a whole key. Keys without a value have no row."""
    c = running_counts(df, value, {"n": F.count("*")}, keys)
    at = [wanted(F.col("n_all"), level) for level in levels]
    g = c.groupBy(*keys).agg(*[F.max(F.when((F.col("n_to") >= x) & (F.col("n_to") - F.col("n") < x), F.col(value))).alias(f"q{i}") for i, x in enumerate(at)])
    return g.select(*keys, F.inline(F.array(*[F.struct(F.lit(level).alias("level"), F.col(f"q{i}").alias("q")) for i, level in enumerate(levels)]))).where("q IS NOT NULL")


def conformal_widths(scores: DataFrame, keys: list[str], score: str, levels: list[float]) -> DataFrame:
    """The order statistic of each level by key: of n scores, 'higher' at ceil((n + 1) level) / n."""

    def place(n: Column, level: float) -> Column:
        return F.ceil(F.least(F.lit(1.0), F.ceil((n + 1) * level) / n) * (n - 1)) + 1

    return order_statistics(scores, keys, score, place, levels)


def percentiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(keys, one column for each named share): exact percentiles, linear between places, for any number of keys, from running counts in one pass: no task holds a key's values. Nulls take no part; keys without a value have no row."""
    c = running_counts(df, value, {"n": F.count("*")}, keys)
    covers = lambda x: (F.col("n_to") >= x) & (F.col("n_to") - F.col("n") < x)
    v, ends = F.col(value).cast("double"), []
    for i, p in enumerate(shares.values()):
        at = p * (F.col("n_all") - 1)
        ends += [F.max(F.when(covers(F.floor(at) + 1), v)).alias(f"a{i}_"), F.max(F.when(covers(F.ceil(at) + 1), v)).alias(f"b{i}_")]
    g = c.groupBy(*keys).agg(F.max("n_all").alias("n_"), *ends)

    def between(i: int, p: float) -> Column:
        at = p * (F.col("n_") - 1)
        return F.when(at == F.floor(at), F.col(f"a{i}_")).otherwise((F.ceil(at) - at) * F.col(f"a{i}_") + (at - F.floor(at)) * F.col(f"b{i}_"))

    return g.select(*keys, *[between(i, p).alias(name) for i, (name, p) in enumerate(shares.items())])


def clip_scale(df: DataFrame, channel: str, value: str, over: float = 10.0, least: float = 1e-8) -> DataFrame:
    """df with `scaled`: values of channels whose largest is over `over` between their 1st and 99th percentile, as -1 to 1; 0 in such channels whose percentiles differ by less than `least`; other channels as they are.

    Percentiles, a row for each channel, are broadcast: rows of a channel stay where they are, however many they are."""
    p = percentiles(df, [channel], value, {"low_": 0.01, "high_": 0.99, "top_": 1.0})
    spread = F.col("high_") - F.col("low_")
    x = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(F.col(value) - F.col("low_"), spread))) * 2 - 1
    out = F.when(F.col("top_") <= over, F.col(value)).when(spread < least, F.lit(0.0)).otherwise(x)
    return df.join(F.broadcast(p), channel, "left").withColumn("scaled", out).drop("low_", "high_", "top_")


def t_probability(t: Column, df: Column) -> Column:
    """Two-sided p of Student's t, for rows of statistics: the incomplete beta integral by its continued fraction."""

    @F.pandas_udf("double")
    def p(t: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([np.nan if pd.isna(a) or pd.isna(b) or b <= 0 else _beta_share(b / 2, 0.5, b / (b + a * a)) for a, b in zip(t, n)])

    return F.nanvl(p(t.cast("double"), df.cast("double")), F.lit(None).cast("double"))


def _beta_share(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta integral."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_share(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    # Lentz's evaluation
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
    out = d
    for m in range(1, 400):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / (1 + k * d or 1e-300), 1 + k / c or 1e-300
            out *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return front * out


def winkler(y: Column, low: Column, high: Column, alpha: Column) -> Column:
    return high - low + 2 / alpha * (F.greatest(low - y, F.lit(0.0)) + F.greatest(y - high, F.lit(0.0)))


def global_rank(df: DataFrame, order: str, tie: str) -> DataFrame:
    """df with `rank_`: its place from 1 in the order of a number, ties by another; (order, tie) is unique. From running counts: no task orders all rows. Rows with a null order go."""
    a = running_counts(df, order, {"a": F.count("*")}).select(order, (F.col("a_to") - F.col("a")).alias("ahead_"))
    b = running_counts(df.where(F.col(order).isNotNull()), tie, {"b": F.count("*")}, keys=[order]).select(order, tie, F.col("b_to").alias("inside_"))
    return df.join(b, [order, tie]).join(a, order).withColumn("rank_", F.col("ahead_") + F.col("inside_")).drop("ahead_", "inside_")


def group_folds(df: DataFrame, group: str, folds: int = 5) -> DataFrame:
    """fold of each group: groups in the order of size (then name, a number) dealt back and forth over the folds; a group never straddles."""
    sizes = df.groupBy(group).agg(F.count("*").alias("n_rows")).withColumn("less_", -F.col("n_rows"))
    r = F.col("rank_") - 1
    at = r % folds
    return global_rank(sizes, "less_", group).select(group, F.when(F.floor(r / folds) % 2 == 0, at).otherwise(folds - 1 - at).cast("int").alias("fold"), "n_rows")


def rolling_median(df: DataFrame, order: str, tie: str, value: str, rows: int = 200, least: int = 20, block: int = 4096) -> DataFrame:
    """df with `median`, of the value over a row and the `rows` - 1 before it in one order over all rows; null where there are fewer than `least`.

    Rows are ranked by running counts and cut into blocks; a block takes the last rows of the one before it along."""
    at = global_rank(df, order, tie).withColumn("block_", F.floor((F.col("rank_") - 1) / block))
    after = at.where((F.col("rank_") - 1) % block > block - rows).withColumn("block_", F.col("block_") + 1)
    both = at.withColumn("own_", F.lit(True)).unionByName(after.withColumn("own_", F.lit(False)))
    w = Window.partitionBy("block_").orderBy("rank_").rowsBetween(1 - rows, 0)
    median = F.when(F.count(value).over(w) >= least, F.percentile(value, 0.5).over(w))
    return both.withColumn("median", median).where("own_").drop("own_", "block_", "rank_")


def rolling_median_within(df: DataFrame, key: str, order: list[str], value: str, rows: int = 200, block: int = 1 << 16) -> DataFrame:
    """df with `median`, of the value over a row and up to `rows` - 1 before it in the order of unique `order` columns within its key. Null and NaN values take no part; a window of nothing else is null.

    Rows are sorted by ranges of key and order, whatever a key's size, and written with their places. Blocks of places are a task's work; each takes the last rows of the one before it along. A row for each range reaches the driver."""
    spark, place = df.sparkSession, F.col("at_").bitwiseAND(F.lit((1 << 33) - 1))
    path = scratch(spark, "in-order")
    at = df.repartitionByRange(key, *order).sortWithinPartitions(key, *order).withColumn("at_", F.monotonically_increasing_id())  # range, place in it
    at.write.parquet(path)
    at = spark.read.schema(at.schema).parquet(path).withColumn("range_", F.shiftright("at_", 33))
    first, n = [], 0
    for r in at.groupBy("range_").count().orderBy("range_").collect():  # a row for each range
        first.append((r["range_"], n))
        n += r["count"]
    starts = spark.createDataFrame(first, "range_ long, first_ long")
    at = at.join(F.broadcast(starts), "range_").withColumn("at_", F.col("first_") + place).drop("range_", "first_").withColumn("block_", F.floor(F.col("at_") / block))
    border = F.when(F.col("at_") % block > block - rows, F.col("block_") + 1)
    both = at.withColumn("own_", F.lit(True)).unionByName(at.withColumn("block_", border).where("block_ IS NOT NULL").withColumn("own_", F.lit(False)))
    columns = df.columns

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("at_")
        v, k = t.column(value).to_numpy().astype(float), t.column(key).to_pandas()
        cuts = [i for i in np.flatnonzero((k != k.shift()) & ~(k.isna() & k.shift().isna())) if i] if len(k) else []
        cuts = [0, *cuts]
        median = np.full(len(v), np.nan)
        for a, b in zip(cuts, [*cuts[1:], len(v)]):
            median[a:b] = _rolling(v[a:b], rows)
        t = t.append_column("median", pa.array(median, from_pandas=True)).filter(t.column("own_"))
        return t.select([*columns, "median"])

    return both.groupBy("block_").applyInArrow(run, df.select("*", F.lit(None).cast("double").alias("median")).schema)


def _rolling(v: np.ndarray, rows: int) -> np.ndarray:
    if np.isinf(v).any():  # which pandas takes for missing
        return np.array([np.median(w) if len(w) else np.nan for w in (x[~np.isnan(x)] for x in (v[max(0, i - rows + 1) : i + 1] for i in range(len(v))))])
    return pd.Series(v).rolling(rows, min_periods=1).median().to_numpy()


def _cell(value: str) -> Column:
    """A whole number that never falls as the value rises: cells of a 256th of the value's size, of a 2^-28th near 0. NaN comes last."""
    x = F.col(value).cast("double")
    return F.when(F.isnan(x), F.lit((1 << 63) - 1)).otherwise(F.floor(F.signum(x) * F.log1p(F.abs(x) * 2.0**20) * 256))


def running_counts(df: DataFrame, value: str, counts: dict[str, Column], keys: list[str] | None = None) -> DataFrame:
    """One row for each distinct value (a number) with the named aggregates and, as `{name}_to`, their running sums in the order of the value, as `{name}_all` their totals; with `keys` within each key. Null values and keys go.

    Values lie in cells in their order, some thousand for a key whose values differ. Sums run inside a cell, and over a key's table of cells, so no task orders all values. Nothing is sampled or counted
    ahead: the plan is one pass. Only values that lie within a 256th of each other share a cell however many they are."""
    keys = keys or []
    c = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(*[v.alias(k) for k, v in counts.items()]).withColumn("b_", _cell(value))
    tot = c.groupBy(*keys, "b_").agg(*[F.sum(k).alias(f"{k}_b") for k in counts])
    whole = Window.partitionBy(*keys)
    before = whole.orderBy("b_").rowsBetween(Window.unboundedPreceding, -1)
    base = tot.select(*[F.col(k).alias(f"{k}_k") for k in keys], F.col("b_").alias("b_k"), *[F.coalesce(F.sum(f"{k}_b").over(before), F.lit(0)).alias(f"{k}_0") for k in counts], *[F.sum(f"{k}_b").over(whole).alias(f"{k}_all") for k in counts])
    inside = Window.partitionBy(*keys, "b_").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    run = c.select("*", *[F.sum(k).over(inside).alias(f"{k}_in") for k in counts])
    met = run.join(base, [F.col(k) == F.col(f"{k}_k") for k in keys] + [F.col("b_") == F.col("b_k")])
    return met.select(*keys, value, *counts, *[(F.col(f"{k}_0") + F.col(f"{k}_in")).alias(f"{k}_to") for k in counts], *[f"{k}_all" for k in counts])


def mann_whitney(df: DataFrame, value: str, first: Column, least: int = 10) -> DataFrame:
    """One row: n1, n2, u (of the first group), z (two-sided, ties and continuity corrected), significant at 5 %. z and significant are null unless both groups have more than `least` rows."""
    c = running_counts(df, value, {"a": F.count(F.when(first, 1)), "b": F.count(F.when(~first, 1))})
    t = F.col("a") + F.col("b")
    mid = F.col("a_to") + F.col("b_to") - (t - 1) / 2
    s = c.agg(F.sum("a").alias("n1"), F.sum("b").alias("n2"), F.sum(F.col("a") * mid).alias("r1"), F.sum(F.pow(t.cast("double"), F.lit(3.0)) - t).alias("ties"))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n, u = n1 + n2, F.col("r1") - n1 * (n1 + 1) / 2
    sd = F.sqrt(n1 * n2 / 12 * (n + 1 - F.col("ties") / F.nullif(n * (n - 1), F.lit(0.0))))
    z = F.when((n1 > least) & (n2 > least), (F.greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / F.nullif(sd, F.lit(0.0)))
    return s.select("n1", "n2", u.alias("u"), z.alias("z"), (z > 1.959963984540054).alias("significant"))


def pooled_widths(scores: DataFrame, score: str, levels: list[float]) -> DataFrame:
    """As `conformal_widths` over all rows together."""
    return conformal_widths(scores, [], score, levels)


def calibration_cut(df: DataFrame, fold: str, order: str, folds: int = 5, share: float = 0.2, least: int = 10) -> DataFrame:
    """(fold, cut): of the rows outside each fold, in the order of a unique number, those from `cut` on are the last `share` of them, `least` at least: the calibration rows. Null orders take no part."""
    counts = {f"k{f}": F.count(F.when(F.col(fold) != f, 1)) for f in range(folds)}
    c = running_counts(df, order, counts)
    long = c.select(order, F.inline(F.array(*[F.struct(F.lit(f).alias(fold), F.col(f"k{f}").alias("k"), F.col(f"k{f}_to").alias("to"), F.col(f"k{f}_all").alias("n_")) for f in range(folds)])))
    held = F.greatest(F.lit(least), F.floor(F.col("n_") * share))
    return long.where((F.col("k") > 0) & (F.col("to") > F.col("n_") - held)).groupBy(fold).agg(F.min(order).alias("cut"))


def pinball(y: Column, q: Column, alpha: Column | float) -> Column:
    a = F.lit(alpha) if isinstance(alpha, float) else alpha
    return F.when(y < q, (1 - a) * (q - y)).otherwise(a * (y - q))


def crps_term(y: Column, q: Column, alpha: float) -> Column:
    """A quantile's share of the score; its mean over rows and levels is the ranked probability score as the reports give it."""
    return (2 * alpha - 1) * (y - q) + 2 * pinball(y, q, alpha)


def hashed(key: str, seed: int) -> Column:
    """A number of 52 bits from a seed and a key, the same on every run."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), 1, 13), 16, 10).cast("long")


def group_split(df: DataFrame, group: str, train: float = 0.8, val: float = 0.1, seed: int = 42) -> DataFrame:
    """split of each group: the first int(n train) groups in hashed order train, the next int(n val) val, the rest test; a null group trains."""
    g = df.select(group).distinct().where(F.col(group).isNotNull()).withColumn("h_", hashed(group, seed))
    c = running_counts(g, "h_", {"n": F.count("*")})
    a, b = F.floor(F.col("n_all") * train), F.floor(F.col("n_all") * val)
    at = c.withColumn("split", F.when(F.col("n_to") <= a, "train").when(F.col("n_to") <= a + b, "val").otherwise("test"))
    out = g.join(at.select("h_", "split"), "h_").select(group, "split")
    return df.join(out, group, "left").withColumn("split", F.coalesce("split", F.lit("train")))


def cap_per_group(df: DataFrame, group: str, key: str, most: int, seed: int = 42) -> DataFrame:
    """At most `most` rows a group in hashed order: a sampling operator."""
    w = Window.partitionBy(group).orderBy(hashed(key, seed), key)
    return df.withColumn("r_", F.row_number().over(w)).where(F.col("r_") <= most).drop("r_")


def seeded_sample(df: DataFrame, key: str, most: int, seed: int = 42) -> DataFrame:
    """At most `most` rows, the first in hashed order of a unique key: a sampling operator. Each task keeps its own first ones before the merge."""
    return df.orderBy(hashed(key, seed), key).limit(most)
