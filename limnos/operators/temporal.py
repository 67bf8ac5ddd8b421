"""Joins and windows in time. Interval joins are equi-joins on day buckets: one side keeps its bucket, the other is copied to the neighbouring ones."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.sinks import scratch
from . import stats


def _day(c: str) -> Column:
    return F.datediff(F.col(c), F.lit("1970-01-01").cast("date"))


def within_days(left: DataFrame, right: DataFrame, keys: list[str], days: int, left_date: str = "date", right_date: str = "obs_date") -> DataFrame:
    """Every pair with equal keys and dates at most `days` apart (inner), with `off`, the signed days from left to right. Null keys and dates match nothing.

    Buckets are four times as wide as needed: only rows of right that lie within `days` of a border go to two of them, some 1.4 copies of a row on average in place of three."""
    w = 4 * (days + 1)
    a = left.withColumn("bucket_", F.floor(_day(left_date) / w))
    b = right.withColumn("bucket_", F.explode(F.array_distinct(F.array(*[F.floor((_day(right_date) + k) / w) for k in (-days, days)]))))
    return a.join(b, [*keys, "bucket_"]).withColumn("off", F.datediff(right_date, left_date)).where(F.abs("off") <= days).drop("bucket_")


def nearest_within(left: DataFrame, right: DataFrame, keys: list[str], values: list[str], tie: list[str], days: int = 7, windows: tuple[int, ...] = (1, 3, 7), block: int | None = None) -> DataFrame:
    """Each row of left with its nearest row of right (keys, obs_date) within `days`: earlier dates win ties, then the order of `tie`, nulls last. Adds the values, `offset_days`, `n_obs` (how many lie within) and `match_{w}d`; unmatched rows, and those with a null key or date, have null values, 0 and false.

    Both sides are united and dealt out once, by key and block of days, so that a long series is many tasks' work; rows of right that lie within `days` of a block's border go to both blocks. Inside a block the rows in order of time tell the last one
    before and the first one after each row of left, and a range of days is counted: no pairs are built."""
    width = block or max(64, 16 * (days + 1))
    names = {c: f"k{i}_" for i, c in enumerate(keys)}
    here = left.select(*[F.col(c).alias(n) for c, n in names.items()], _day("date").alias("day_"), F.lit(1).alias("kind_"), F.struct(*[F.col(c) for c in left.columns]).alias("left_"))
    here = here.withColumn("block_", F.floor(F.col("day_") / width))
    there = right.where(F.col("obs_date").isNotNull()).select(*[F.col(c).alias(n) for c, n in names.items()], _day("obs_date").alias("day_"), F.lit(0).alias("kind_"), *[F.col(t).alias(f"t{i}_") for i, t in enumerate(tie)], F.struct(_day("obs_date").alias("day"), *[F.col(v) for v in values]).alias("right_"))
    for n in names.values():
        there = there.where(F.col(n).isNotNull())
    there = there.withColumn("block_", F.explode(F.array_distinct(F.array(*[F.floor((F.col("day_") + d) / width) for d in (-days, 0, days)]))))
    both = here.unionByName(there, allowMissingColumns=True)
    own = Window.partitionBy(*names.values(), "block_")
    # of one day the first by `tie`, nulls last, is the last that either order meets
    back = [F.desc_nulls_first(f"t{i}_") for i in range(len(tie))]
    before = own.orderBy("day_", "kind_", *back).rowsBetween(Window.unboundedPreceding, 0)
    after = own.orderBy(F.desc("day_"), F.desc("kind_"), *back).rowsBetween(Window.unboundedPreceding, 0)
    within = own.orderBy("day_").rangeBetween(-days, days)
    met = both.withColumns({"last_": F.last("right_", True).over(before), "next_": F.last("right_", True).over(after), "n_obs": F.sum(1 - F.col("kind_")).over(within)}).where("kind_ = 1")
    off = lambda c: F.abs(F.col(f"{c}.day") - F.col("day_"))
    a, b = F.coalesce(off("last_"), F.lit(days + 1)), F.coalesce(off("next_"), F.lit(days + 1))
    best = F.when((a <= b) & (a <= days), F.col("last_")).when(b <= days, F.col("next_"))
    met = met.withColumn("best_", best)
    n = F.when(F.col("day_").isNotNull(), F.col("n_obs")).otherwise(0).cast("long")
    out = met.select("left_.*", *[F.col(f"best_.{v}").alias(v) for v in values], off("best_").cast("int").alias("offset_days"), F.coalesce(n, F.lit(0)).alias("n_obs"))
    return out.withColumns({f"match_{w}d": F.coalesce(F.col("offset_days") <= w, F.lit(False)) for w in windows})


def antecedent_window(samples: DataFrame, daily: DataFrame, key: str, sample: str, value: str, days: int) -> DataFrame:
    """For each sample the values of its key that exist on the `days` days strictly before it, packed against the right end, the latest last: `seq` has `days` entries, 0 on the left; `has` is 1 if there is a day.

    Days that are missing leave no gap; a day with a null value keeps its place and counts as 0. (key, obs_date) is unique in daily. Samples with a null date or key have only zeros."""
    got = _gathered(samples.select(sample, key, _day("date").alias("at_")), daily.select(key, _day("obs_date").alias("n_"), F.col(value).alias("v_")), key, [sample], days)
    return got.select(sample, _packed("e_", days).alias("seq"), (F.size("e_") > 0).cast("int").alias("has"))


def antecedent_months(samples: DataFrame, daily: DataFrame, key: str, sample: str, value: str, months: int = 12) -> DataFrame:
    """Per sample and lag (1 to `months`) the calendar month's sum, min, max and mean, from a station-month rollup.

    Months are gathered by blocks of `months`, so that a sample meets at most two blocks; both sides are shuffled, neither is broadcast."""
    number = lambda c: F.year(c) * 12 + F.month(c)
    rolled = daily.where(F.col(key).isNotNull() & F.col("obs_date").isNotNull()).groupBy(key, number("obs_date").alias("n_")).agg(F.sum(value).alias("m_sum"), F.min(value).alias("m_min"), F.max(value).alias("m_max"), F.avg(value).alias("m_mean"))
    block = rolled.groupBy(key, F.floor(F.col("n_") / months).alias("block_")).agg(F.collect_list(F.struct("n_", "m_sum", "m_min", "m_max", "m_mean")).alias("b_"))
    at = samples.select(sample, key, number("date").alias("at_"))
    first, last = F.floor((F.col("at_") - months) / months), F.floor((F.col("at_") - 1) / months)
    # the planner takes rows to explode for few: without a hint it would send them to the driver
    met = at.withColumn("block_", F.explode(F.array_distinct(F.array(first, last)))).hint("merge").join(block, [key, "block_"])
    got = met.select(sample, "at_", F.inline("b_")).withColumn("lag", F.col("at_") - F.col("n_")).where(F.col("lag").between(1, months))
    return got.select(sample, "lag", "m_sum", "m_min", "m_max", "m_mean")


def fill_linear(df: DataFrame, keys: list[str], order: str, value: str, limit: int = 3) -> DataFrame:
    """Linear interpolation by position between known neighbours, at most `limit` rows into a gap; trailing gaps repeat the last value for `limit` rows."""
    w = Window.partitionBy(*keys).orderBy(order)
    n = F.row_number().over(w)
    d = df.withColumn("n_", n)
    known = F.when(F.col(value).isNotNull(), F.col("n_"))
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    d = d.withColumns({"p_": F.last(known, True).over(back), "q_": F.first(known, True).over(ahead), "pv_": F.last(value, True).over(back), "qv_": F.first(value, True).over(ahead)})
    step = F.col("n_") - F.col("p_")
    line = F.when(F.col("q_").isNotNull(), F.col("pv_") + (F.col("qv_") - F.col("pv_")) * step / (F.col("q_") - F.col("p_"))).otherwise(F.col("pv_"))
    return d.withColumn("filled", F.when(F.col(value).isNotNull(), F.col(value)).when(step <= limit, line)).drop("n_", "p_", "q_", "pv_", "qv_")


def fill_forward(df: DataFrame, keys: list[str], order: str, value: str, limit: int = 7) -> DataFrame:
    """The last value at most `limit` rows back, else 0."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-limit, 0)
    return df.withColumn("filled", F.coalesce(F.last(value, True).over(w), F.lit(0.0)))


def increments(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Differences of an accumulated series, none below 0; null for the first."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("increment", F.when(F.lag(value).over(w).isNotNull(), F.greatest(F.lit(0.0), F.col(value) - F.lag(value).over(w))))


def at_hour(df: DataFrame, keys: list[str], date: str, ts: str, value: str, hour: int) -> DataFrame:
    """(keys, date, value): the mean of a day's values at an hour; for a series (keys) that has none at that hour on any day, the mean of the day. Days without a value at the hour, in a series that has some, give no row."""
    at = F.when(F.hour(ts) == hour, F.col(value))
    by = df.groupBy(*keys, date).agg(F.avg(at).alias("at_"), F.avg(value).alias("all_"))
    has = F.max(F.col("at_").isNotNull()).over(Window.partitionBy(*keys))
    return by.withColumn("has_", has).select(*keys, date, F.when(F.col("has_"), F.col("at_")).otherwise(F.col("all_")).alias(value)).where(F.col(value).isNotNull())


def daily_series(df: DataFrame, keys: list[str], date: str, ts: str, value: str, most: int = 2) -> DataFrame:
    """(keys, date, value, is_daily): series (keys) with at most `most` distinct hours keep their rows, others become means by day."""
    hours = df.groupBy(*keys).agg((F.countDistinct(F.hour(ts)) <= most).alias("is_daily"))
    met = df.join(hours, keys)
    kept = met.where("is_daily").select(*keys, date, value, "is_daily")
    return kept.unionByName(met.where("NOT is_daily").groupBy(*keys, date, "is_daily").agg(F.avg(value).alias(value)).select(*keys, date, value, "is_daily"))


def worst_flag(flag: str) -> Column:
    """R over Y over G; null flags count as G."""
    return F.element_at(F.array(F.lit("G"), F.lit("Y"), F.lit("R")), F.max(F.when(F.col(flag) == "R", 3).when(F.col(flag) == "Y", 2).otherwise(1)))


def dedupe(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by an explicit order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rn_", F.row_number().over(w)).where("rn_ = 1").drop("rn_")


def _table(df: DataFrame, name: str) -> DataFrame:
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _in_window(samples: DataFrame, rows: DataFrame, key: str, days: int) -> DataFrame:
    """Each of samples (.., key, at_) with each of rows (key, n_, ..) of its key whose n_ lies from at_ - `days` to at_ - 1. Null keys and numbers match nothing.

    Buckets are four windows wide: a sample stays one row, a row of a series goes to the one or two buckets whose samples can ask for it."""
    w = 4 * days
    a = samples.withColumn("bucket_", F.floor(F.col("at_") / w))
    b = rows.where(F.col("n_").isNotNull()).withColumn("bucket_", F.explode(F.array_distinct(F.array(*[F.floor((F.col("n_") + k) / w) for k in (1, days)]))))
    return a.join(b.hint("merge"), [key, "bucket_"]).where((F.col("n_") < F.col("at_")) & (F.col("n_") >= F.col("at_") - days)).drop("bucket_")


def _gathered(samples: DataFrame, rows: DataFrame, key: str, sample: list[str], days: int) -> DataFrame:
    """(sample, at_, e_): for each of samples (sample, key, at_) the rows (key, n_, v_) of its key with n_ from at_ - `days` to at_ - 1, in order, as structs (n_, v_). (key, n_) is unique.

    Rows that no window asks for end in the join; the others are gathered once."""
    met = _in_window(samples, rows, key, days).select(*sample, "at_", F.struct("n_", "v_").alias("e_"))
    every = samples.select(*sample, "at_", F.lit(None).cast(met.schema["e_"].dataType).alias("e_"))
    return met.unionByName(every).groupBy(*sample, "at_").agg(F.array_sort(F.collect_list("e_")).alias("e_"))


def _packed(entries: str, days: int) -> Column:
    """The values of the entries, 0 for null, behind as many zeros as make `days`."""
    values = F.transform(entries, lambda x: F.coalesce(x["v_"].cast("double"), F.lit(0.0)))
    return F.concat(F.array_repeat(F.lit(0.0), F.lit(days) - F.size(entries)), values)


def local_nodes(graph: DataFrame, order: DataFrame, key: str, k: int) -> DataFrame:
    """(key, other, rank): for each node of a graph (src, dst) its first k neighbours in the order of nodes, from rank 1. order: key and `place`, a unique number."""
    at = graph.join(order.select(F.col(key).alias("dst"), "place"), "dst")
    rank = F.row_number().over(Window.partitionBy("src").orderBy("place"))
    return at.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("src").alias(key), F.col("dst").alias("other"), "rank")


def neighbour_windows(samples: DataFrame, near: DataFrame, daily: DataFrame, key: str, sample: str, value: str, days: int, k: int) -> DataFrame:
    """For each sample the antecedent windows of its own key and of its k neighbours, packed as in `antecedent_window`: `seq`, an array of k + 1 arrays, the own one first, zeros where a node has no day or there are fewer neighbours.

    `has` is 1 if the sample's key has a series at all, in the window or not; without one all windows are zeros. near: key, other, rank from 1."""
    series = daily.select(key).distinct()
    own = samples.select(F.col(key).alias("own_"), sample, _day("date").alias("at_")).join(series.select(F.col(key).alias("own_"), F.lit(1).alias("has")), "own_", "left")
    nodes = near.where(F.col("rank") <= k).select(F.col(key).alias("own_"), F.col("other").alias(key), "rank")
    self_ = own.select(sample, "at_", F.col("own_").alias(key), F.lit(0).alias("rank"))
    rows = self_.unionByName(own.where("has = 1").join(nodes, "own_").select(sample, "at_", key, "rank"))
    met = _in_window(rows, daily.select(key, _day("obs_date").alias("n_"), F.col(value).alias("v_")), key, days)
    # what exists is sorted, all nodes of a sample together; zeros come in afterwards
    met = met.select(sample, F.lit(0).alias("has"), "rank", "n_", F.coalesce(F.col("v_").cast("double"), F.lit(0.0)).alias("v_"))
    every = own.select(sample, F.coalesce("has", F.lit(0)).alias("has"))
    rows = met.unionByName(every, allowMissingColumns=True).repartition(sample).sortWithinPartitions(sample, "rank", "n_")

    def whole(batches):
        """Tables of whole samples, with the rows where one begins."""
        held = []
        for b in batches:
            t = pa.Table.from_batches([*held, b]).combine_chunks()
            if not t.num_rows:
                continue
            ids = t.column(0).combine_chunks()
            differ = pc.fill_null(pc.not_equal(ids[1:], ids[:-1]), False).to_numpy(zero_copy_only=False) | (np.diff(ids.is_valid().to_numpy(zero_copy_only=False).astype(int)) != 0)
            begin = np.flatnonzero(np.concatenate([[True], differ]))
            if len(begin) > 1:
                yield t.slice(0, begin[-1]), begin[:-1]
            held = t.slice(begin[-1]).to_batches()
        if held:
            yield pa.Table.from_batches(held), np.zeros(1, np.int64)

    def packed(batches):
        for t, begin in whole(batches):
            n = len(begin)
            rank = t.column("rank").fill_null(-1).to_numpy()
            at = np.repeat(np.arange(n), np.diff(np.concatenate([begin, [t.num_rows]])))
            some = np.flatnonzero(rank >= 0)
            node = at[some] * (k + 1) + rank[some]
            x = np.zeros((n * (k + 1), days))
            x[node, days - np.searchsorted(node, node, "right") + np.arange(len(node))] = t.column("v_").to_numpy()[some]
            inner = pa.ListArray.from_arrays(pa.array(np.arange(n * (k + 1) + 1, dtype=np.int32) * days), pa.array(x.ravel()))
            seq = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * (k + 1)), inner)
            yield pa.RecordBatch.from_arrays([t.column(0).take(pa.array(begin)).combine_chunks(), seq, pa.array(np.maximum.reduceat(t.column("has").to_numpy(), begin).astype(np.int32))], names=[sample, "seq", "has"])

    return rows.mapInArrow(packed, f"`{sample}` {samples.schema[sample].dataType.simpleString()}, seq array<array<double>>, has int")


def archive_ends(samples: DataFrame, archive: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((date, end_), (obs_date, n_)): how many days of an archive lie before each date of samples, and each archive day's number from 0. Both run over distinct days only, so a calendar bounds what is ordered."""
    days = archive.where("obs_date IS NOT NULL").select(F.col("obs_date").alias("day_")).distinct().withColumn("one_", F.lit(1))
    asked = samples.where("date IS NOT NULL").select(F.col("date").alias("day_")).distinct().withColumn("one_", F.lit(0))
    both = days.unionByName(asked).groupBy("day_").agg(F.max("one_").alias("one_"), F.min("one_").alias("asked_"))
    before = Window.orderBy("day_").rowsBetween(Window.unboundedPreceding, -1)
    at = both.withColumn("n_", F.coalesce(F.sum("one_").over(before), F.lit(0)).cast("int"))
    return at.select(F.col("day_").alias("date"), F.col("n_").alias("end_")), at.where("one_ = 1").select(F.col("day_").alias("obs_date"), "n_")


def patch_windows(samples: DataFrame, patches: DataFrame, key: str, sample: str, days: int, size: int, zero: list[int] | None = None, channels: int = 1) -> DataFrame:
    """For each sample the patches of its key on the last `days` days of the archive before it as `seq`, the oldest first, against the right end: the archive's days are those on which any key has a patch, so days that all lack do not count.

    Masked and non-finite entries are 0, as are all entries of the channels `zero`; days without a patch of the key are all 0, as are places before the archive begins. n_patches: how many there are.
    patches: key, obs_date, patch, mask (arrays of `size`, channels innermost; mask entries of 0 hide)."""
    bad = lambda x, m: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")) | m.isNull() | (m == 0)
    clean = F.zip_with("patch", "mask", lambda x, m: F.when(bad(x, m), F.lit(0.0)).otherwise(x.cast("double")))
    if zero:
        clean = F.transform(clean, lambda x, i: F.when((i % channels).isin(zero), F.lit(0.0)).otherwise(x))
    # which patches there are, and which of them the windows meet; no patch is moved for that
    index = _table(patches.select(key, "obs_date"), "patch-index")
    ends, numbers = archive_ends(samples, index)
    s = samples.select(sample, key, "date").join(ends, "date", "left").select(sample, key, F.col("end_").alias("at_"))
    met = _in_window(s, index.join(numbers, "obs_date").select(key, "n_", "obs_date"), key, days)
    met = _table(met.select(sample, key, "obs_date", (F.col("n_") - F.col("at_")).alias("place_")), "patch-met")
    asked = patches.join(met.select(key, "obs_date").distinct(), [key, "obs_date"], "left_semi").select(key, "obs_date", clean.alias("v_"))
    got = met.join(asked, [key, "obs_date"]).select(sample, F.struct("place_", "v_").alias("e_"))
    every = s.select(sample, F.lit(None).cast(got.schema["e_"].dataType).alias("e_"))
    w = got.unionByName(every).groupBy(sample).agg(F.collect_list("e_").alias("e_")).withColumn("m_", F.map_from_entries("e_"))
    place = F.sequence(F.lit(-days), F.lit(-1))
    seq = F.transform(place, lambda i: F.coalesce(F.try_element_at("m_", i), F.array_repeat(F.lit(0.0), size)))
    return w.select(sample, seq.alias("seq"), F.size("e_").alias("n_patches"))


#: Aggregates of a rollup by name; sums and counts of nothing are 0, all others null.
AGGREGATES = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "std": F.stddev_samp, "count": F.count}


def rollup(df: DataFrame, keys: list[str], value: str, aggregates: list[str]) -> DataFrame:
    """(keys, one column for each aggregate of `value`): mean, sum, min, max, std, count or median, which is exact and comes from running counts. Null values take no part; a key with nothing else keeps its row."""
    plain = [a for a in aggregates if a != "median"]
    g = df.groupBy(*keys).agg(F.count(value).alias("n_"), *[AGGREGATES[a](value).alias(a) for a in plain])
    if "median" in aggregates:
        m = stats.percentiles(df, keys, value, {"median": 0.5})
        g = g.join(m, keys, "left") if keys else g.join(F.broadcast(m), F.lit(True), "left")  # one row
    none = lambda a: F.coalesce(F.col(a), F.lit(0).cast(g.schema[a].dataType)) if a in ("sum", "count") else F.col(a)
    return g.select(*keys, *[none(a).alias(a) for a in aggregates])


def resample(df: DataFrame, keys: list[str], ts: str, value: str, step: str, aggregates: list[str]) -> DataFrame:
    """(keys, bin, aggregates): a series by hour, day, month or year, with every bin from a key's first to its last, empty ones too.

    A bin is known by its start, a month or year by its last day, at midnight. Rows without a time go. In an empty bin sums and counts are 0, other aggregates null. The number of bins is bounded by the calendar."""
    rows = df.where(F.col(ts).isNotNull()).withColumn("bin_", F.date_trunc(step, ts))
    got = rollup(rows, [*keys, "bin_"], value, aggregates)
    span = got.groupBy(*keys).agg(F.min("bin_").alias("a_"), F.max("bin_").alias("b_"))
    whole = span.select(*keys, F.explode(F.sequence("a_", "b_", F.expr(f"interval 1 {step}"))).alias("bin_"))
    met = whole.join(got, [*keys, "bin_"], "left")
    none = lambda a: F.coalesce(F.col(a), F.lit(0).cast(got.schema[a].dataType)) if a in ("sum", "count") else F.col(a)
    end = {"month": F.last_day("bin_").cast("timestamp"), "year": F.make_date(F.year("bin_"), F.lit(12), F.lit(31)).cast("timestamp")}
    return met.select(*keys, end.get(step, F.col("bin_")).alias("bin"), *[none(a).alias(a) for a in aggregates])
