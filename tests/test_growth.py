"""Steps whose figures grew past their limits on larger tables (FINDINGS_r03): plans, and results at edges."""

import datetime as dt

from pyspark.sql import functions as F

from limnos.operators import spatial, stats, temporal
from limnos.plans import q_cases, q_eval, q_scalar, tables


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def day(n):
    return dt.date(2000, 1, 1) + dt.timedelta(days=n)


D = "/root/testdata/sf0.001"


def test_channels_are_not_dealt_out(spark):
    """rows were shuffled by channel, so one task read a whole channel."""
    df = spark.range(100).select((F.col("id") % 2).alias("c"), F.col("id").cast("double").alias("v"))
    assert "BroadcastHashJoin" in plan(stats.clip_scale(df, "c", "v"))


def test_within_days_copies_few_rows(spark):
    """every row of the right side was shuffled three times."""
    for days in (0, 3, 28):
        a = spark.createDataFrame([(1, day(n)) for n in range(-40, 200)] + [(None, day(0)), (1, None)], "k int, date date")
        b = spark.createDataFrame([(1, day(n)) for n in range(-40, 200, 3)], "k int, obs_date date")
        out = temporal.within_days(a, b, ["k"], days)
        got = sorted((r["date"], r["obs_date"], r["off"]) for r in out.collect())
        assert got == sorted((day(n), day(m), m - n) for n in range(-40, 200) for m in range(-40, 200, 3) if abs(n - m) <= days)
        assert "array_distinct" in plan(out)


def test_lines_are_not_sorted_for_their_orders(spark):
    """every task sorted its lines and orders; the two tiers of a report joined them twice."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "SortMergeJoin" not in plan(tables.obs(spark, D)) and "SortMergeJoin" not in plan(q_scalar.src2_schema_drift(spark, D))
        assert plan(q_eval.ev13_correction_rows(spark, D)).count("Scan parquet") == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")



def test_composites_in_one_grouping(spark):
    """the median took the rows through running counts again."""
    assert plan(q_cases.ag29_composites(spark, D)).count("Scan parquet") == 2


def test_nearest_pixel_searches_once_a_place(spark):
    """every anchor met all pixels around it, and all of these rows were sorted."""
    px = spark.createDataFrame([("a", 3, 4, 2.0), ("a", -3, 4, 1.0), ("a", 4, -3, 7.0), ("b", 40, 40, 3.0), ("b", 41, 42, 4.0)], "scene string, pr long, pc long, value double")
    an = spark.createDataFrame([(k, 0, 0) for k in range(50)] + [(60, 23, 60), (61, 22, 40), (62, 500, 500), (63, 41, 42)], "k int, r int, c int")
    out = spatial.nearest_pixel(an, px, "k", "scene")
    assert "SortAggregate" not in plan(out)
    got = {(r["k"], r["scene"]): (r["pr"], r["pc"], r["value"], r["dist2"]) for r in out.collect()}
    assert got == {(k, "a"): (-3, 4, 1.0, 25) for k in range(50)} | {(60, "b"): (41, 42, 4.0, 18 * 18 * 2), (61, "b"): (40, 40, 3.0, 18 * 18), (63, "b"): (41, 42, 4.0, 0)}


def test_cell_series(spark):
    """a cell's points were one task's work, and every row of the result was rounded."""
    p = spark.createDataFrame([(k, k % 2) for k in range(40)], "k int, gy int")
    s = spark.createDataFrame([(0, day(n), float(n)) for n in range(0, 70, 7)] + [(2, day(0), 1.0)], "gy int, date date, v double")
    got = spatial.cell_series(p, s, ["gy"], "date", "v").select("k", "date", "v").collect()
    assert sorted(map(tuple, got)) == sorted((k, day(n), float(n)) for k in range(0, 40, 2) for n in range(0, 70, 7))
    assert "part_" in plan(spatial.cell_series(p, s, ["gy"], "date", "v"))


def test_rolling_median_within(spark):
    """a group was one task's work, and every row sorted its window anew."""
    inf, v = float("inf"), [None if i % 7 == 0 else float(i * 37 % 101) for i in range(300)]
    v[150], v[160] = inf, -inf
    rows = [(None if i % 3 == 2 else i % 3, i * 53 % 300, v[i], f"t{i}") for i in range(300)] + [(9, 1, None, "none")]
    df = spark.createDataFrame(rows, "k int, o int, v double, t string").repartition(3)
    got = {r["t"]: r["median"] for r in stats.rolling_median_within(df, "k", ["o"], "v", 10, block=16).collect()}
    assert len(got) == 301 and got["none"] is None
    for k in (0, 1, None):
        own = sorted((r for r in rows if r[0] == k), key=lambda r: r[1])
        for i, r in enumerate(own):
            w = sorted(x[2] for x in own[max(0, i - 9) : i + 1] if x[2] is not None)
            want = (w[(len(w) - 1) // 2] + w[len(w) // 2]) / 2 if w else None
            assert got[r[3]] == want
    assert stats.rolling_median_within(df.limit(0), "k", ["o"], "v").count() == 0
