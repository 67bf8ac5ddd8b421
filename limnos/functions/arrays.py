"""Patches as flat row-major arrays: Column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def resize_nearest(patch: Column, h: int, w: int, n: int = 32) -> Column:
    """An h x w patch as n x n, each entry the one at floor(i h / n), floor(j w / n)."""
    return F.transform(F.sequence(F.lit(0), F.lit(n * n - 1)), lambda k: F.get(patch, (F.floor(F.floor(k / n) * h / n) * w + F.floor((k % n) * w / n)).cast("int")))


def resize_bilinear(patch: Column, h: int, w: int, n: int = 32) -> Column:
    """An h x w patch as n x n, corners on corners; null where one of the four is null."""

    def entry(k: Column) -> Column:
        y, x = F.floor(k / n) * ((h - 1) / max(n - 1, 1)), (k % n) * ((w - 1) / max(n - 1, 1))
        y0, x0 = F.least(F.floor(y), F.lit(max(h - 2, 0))), F.least(F.floor(x), F.lit(max(w - 2, 0)))
        at = lambda a, b: F.get(patch, (a * w + b).cast("int"))
        fy, fx, y1, x1 = y - y0, x - x0, F.least(y0 + 1, F.lit(h - 1)), F.least(x0 + 1, F.lit(w - 1))
        return at(y0, x0) * (1 - fy) * (1 - fx) + at(y0, x1) * (1 - fy) * fx + at(y1, x0) * fy * (1 - fx) + at(y1, x1) * fy * fx

    return F.transform(F.sequence(F.lit(0), F.lit(n * n - 1)), entry)


def normalise_channels(patch: Column, offsets: list[float], scales: list[float], corrupted: list[int]) -> Column:
    """As `normalise` with an offset and a scale for each channel (channels innermost); entries of corrupted channels are 0."""
    n = len(offsets)
    offset, scale = F.array(*map(F.lit, offsets)), F.array(*map(F.lit, scales))
    bad = lambda x, c: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")) | c.isin(corrupted)
    return F.transform(patch, lambda x, i: F.when(bad(x, i % n), F.lit(0.0)).otherwise((x - F.get(offset, i % n)) / F.get(scale, i % n)))


def normalise(patch: Column, offset: float, scale: float) -> Column:
    """(x - offset) / scale; null, NaN and infinite entries become 0."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.transform(patch, lambda x: F.when(bad(x), F.lit(0.0)).otherwise((x - offset) / scale))


def crop_pad(patch: Column, h: int, w: int, n: int, fill: float = 0.0) -> Column:
    """The n x n entries around the centre of an h x w patch; what lies beyond its edge is `fill`. Offsets round down, as integer halves do."""
    dy, dx = (h - n) // 2 if h >= n else -((n - h) // 2), (w - n) // 2 if w >= n else -((n - w) // 2)

    def entry(k: Column) -> Column:
        y, x = F.floor(k / n) + dy, k % n + dx
        inside = y.between(0, h - 1) & x.between(0, w - 1)
        return F.when(inside, F.get(patch, (y * w + x).cast("int")).cast("double")).otherwise(F.lit(fill))

    return F.transform(F.sequence(F.lit(0), F.lit(n * n - 1)), entry)


def valid_patch(patch: Column, low: float, high: float) -> tuple[Column, Column]:
    """(patch or null, mask 1 or 0): a patch counts if all its entries are numbers in [low, high]."""
    ok = F.coalesce(F.forall(patch, lambda x: x.isNotNull() & ~F.isnan(x) & x.between(low, high)), F.lit(False))
    return F.when(ok, patch), ok.cast("int")


def cell_windows(anchors: DataFrame, cells: DataFrame, key: str, value: str, half: int) -> DataFrame:
    """For each anchor (key, gy, gx) the (2 half + 1)^2 cell values around it, row by row: `patch` (null beyond the edge) and `mask`. Cells: gy, gx, value."""
    step = F.sequence(F.lit(-half), F.lit(half))
    at = anchors.select(key, "gy", "gx").withColumn("dy", F.explode(step)).withColumn("dx", F.explode(step)).withColumns({"gy": F.col("gy") + F.col("dy"), "gx": F.col("gx") + F.col("dx")})
    got = at.join(cells.select("gy", "gx", value), ["gy", "gx"], "left").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("dy", "dx", F.col(value).alias("v")))).alias("a"))
    return got.select(key, F.transform("a", lambda x: x["v"]).alias("patch"), F.transform("a", lambda x: x["v"].isNotNull().cast("int")).alias("mask"))


def calendar_months(daily: DataFrame, key: str, date: str, value: str) -> DataFrame:
    """(key, month, values, mask): a row for every key and month of the years that the table spans, with arrays over the month's days, 0 for missing values. Null dates take no part; (key, date) is unique.

    A key's series is one row, bounded by the calendar, and its months are cut from it where it lies: days without a value are neither shuffled nor written."""
    span = daily.agg(F.trunc(F.min(date), "year").alias("a_"), F.date_sub(F.add_months(F.trunc(F.max(date), "year"), 12), 1).alias("z_"))  # one row
    rows = daily.select(F.col(key).alias("k_"), F.trunc(date, "month").alias("m_"), F.col(date).alias("d_"), F.col(value).alias("v_"))
    by_month = rows.groupBy("k_", "m_").agg(F.collect_list(F.struct(F.dayofmonth("d_").alias("day"), "v_")).alias("e_"))
    by_key = by_month.groupBy("k_").agg(F.map_from_entries(F.filter(F.collect_list(F.struct("m_", "e_")), lambda x: x["m_"].isNotNull())).alias("s_"))
    months = by_key.join(F.broadcast(span)).where("a_ IS NOT NULL AND k_ IS NOT NULL").select("k_", "s_", F.explode(F.sequence("a_", "z_", F.expr("interval 1 month"))).alias("m_"))
    known = F.filter(F.try_element_at("s_", F.col("m_")), lambda x: x["v_"].isNotNull())
    got = months.select("k_", "m_", F.dayofmonth(F.last_day("m_")).alias("n_"), F.coalesce(known, F.array().cast(by_month.schema["e_"].dataType)).alias("e_"))
    # the few days that are known are put into a month of zeros
    put = lambda zero, one: F.aggregate("e_", F.array_repeat(zero, F.col("n_")), lambda a, x: F.concat(F.slice(a, 1, x["day"] - 1), F.array(one(x)), F.slice(a, x["day"] + 1, F.col("n_"))))
    return got.select(F.col("k_").alias(key), F.col("m_").alias("month"), put(F.lit(0.0), lambda x: x["v_"].cast("double")).alias("values"), put(F.lit(0), lambda x: F.lit(1)).alias("mask"))


def on_calendar(daily: DataFrame, key: str, date: str, value: str) -> DataFrame:
    """Every key on every day of the years that the table spans, with `value` (0 if missing) and `mask`, from `calendar_months`. Null keys and dates take no part; (key, date) is unique."""
    days = calendar_months(daily, key, date, value).select(key, "month", F.posexplode(F.arrays_zip("values", "mask")).alias("i_", "x_"))
    return days.select(key, F.date_add("month", F.col("i_")).alias(date), F.col("x_.values").alias(value), F.col("x_.mask").alias("mask"))
