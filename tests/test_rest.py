"""Windows of neighbours and patches, feature tiers, products, report cells, sampling, patch models on small fixtures."""

import datetime as dt
import math

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from limnos.functions import schema, water
from limnos.operators import models, stats, temporal
from limnos.sources import sinks

D = dt.date


def test_windows_of_days_that_exist(spark):
    """Missing days leave no gap, null values keep their place as 0, and one mark a sample says whether there was a day."""
    daily = spark.createDataFrame([("a", D(2001, 1, 5), 5.0), ("a", D(2001, 1, 8), 8.0), ("a", D(2001, 1, 11), 11.0), ("c", D(2001, 1, 9), None), ("c", D(2001, 1, 10), 3.0), ("b", None, 1.0), (None, D(2001, 1, 4), 7.0)], "station string, obs_date date, v double")
    s = spark.createDataFrame([(1, "a", D(2001, 1, 11)), (2, "a", D(2001, 1, 5)), (3, "b", D(2001, 1, 5)), (4, None, D(2001, 1, 5)), (5, "a", None), (6, "c", D(2001, 1, 11)), (7, "a", D(2001, 1, 16))], "id int, station string, date date")
    got = {r["id"]: (r["seq"], r["has"]) for r in temporal.antecedent_window(s, daily, "station", "id", "v", 10).collect()}
    none = [0.0] * 10
    assert got == {1: ([0.0] * 8 + [5.0, 8.0], 1), 2: (none, 0), 3: (none, 0), 4: (none, 0), 5: (none, 0), 6: ([0.0] * 9 + [3.0], 1), 7: ([0.0] * 8 + [8.0, 11.0], 1)}
    assert temporal.antecedent_window(s.limit(0), daily, "station", "id", "v", 4).count() == 0
    assert {tuple(r["seq"]) for r in temporal.antecedent_window(s, daily.limit(0), "station", "id", "v", 4).collect()} == {(0.0,) * 4}


def test_windows_of_many_days(spark):
    """Against a plain loop, with gaps of all lengths around the borders of blocks."""
    days = [k for k in range(1, 200) if k % 7 and k % 11 and not 60 < k < 90]
    at = lambda k: D(2001, 1, 1) + dt.timedelta(k)
    daily = spark.createDataFrame([("a", at(k), float(k)) for k in days], "station string, obs_date date, v double").repartition(3)
    s = spark.createDataFrame([(k, "a", at(k)) for k in range(230)], "id int, station string, date date")
    for n in (1, 5, 30):
        got = {r["id"]: r["seq"] for r in temporal.antecedent_window(s, daily, "station", "id", "v", n).collect()}
        for k in range(230):
            own = [float(x) for x in days if k - n <= x < k]
            assert got[k] == [0.0] * (n - len(own)) + own


def test_neighbour_windows(spark):
    daily = spark.createDataFrame([("a", D(2001, 1, 3), 3.0), ("b", D(2001, 1, 4), 4.0), ("c", D(2001, 1, 4), 9.0)], "station string, obs_date date, v double")
    near = spark.createDataFrame([("a", "b", 1), ("a", "c", 2), ("b", "a", 1), ("x", "a", 1)], "station string, other string, rank int")
    s = spark.createDataFrame([(1, "a", D(2001, 1, 5)), (2, "b", D(2001, 1, 4)), (3, "x", D(2001, 1, 4)), (4, "c", D(2001, 2, 4))], "id int, station string, date date")
    got = {r["id"]: (r["seq"], r["has"]) for r in temporal.neighbour_windows(s, near, daily, "station", "id", "v", 2, 1).collect()}
    zero = [0.0, 0.0]
    assert got == {1: ([[0.0, 3.0], [0.0, 4.0]], 1), 2: ([zero, [0.0, 3.0]], 1), 3: ([zero, zero], 0), 4: ([zero, zero], 1)}


def test_neighbour_windows_gather_what_exists(spark):
    """nine dense windows a sample were shuffled and grouped twice. Against brute force, over samples that batches cut apart; two shuffles by sample at most, none of arrays."""
    at = lambda n: D(2001, 1, 1) + dt.timedelta(n)
    series = {st: {n: float(1 + (n * 7 + st) % 11) for n in range(0, 120) if (n * n + st) % 5 < 2} for st in range(6)}
    daily = spark.createDataFrame([(st, at(n), None if v == 3.0 else v) for st, x in series.items() for n, v in x.items()], "station int, obs_date date, v double")
    near = spark.createDataFrame([(a, (a + r) % 6, r) for a in range(7) for r in (1, 2, 3)], "station int, other int, rank int")
    s = spark.createDataFrame([(k, k % 7, at(k * 3 % 130)) for k in range(400)] + [(400, 1, None), (401, None, at(5))], "id int, station int, date date")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        frame = temporal.neighbour_windows(s, near, daily, "station", "id", "v", 30, 3)
        got = {r["id"]: (r["seq"], r["has"]) for r in frame.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")

    def window(st, n):
        x = [0.0 if v == 3.0 else v for m, v in sorted(series.get(st, {}).items()) if n - 30 <= m < n]
        return [0.0] * (30 - len(x)) + x

    none = [[0.0] * 30] * 4
    want = {k: ([window(k % 7 if r == 0 else (k % 7 + r) % 6, k * 3 % 130) for r in range(4)], 1) if series.get(k % 7) else (none, 0) for k in range(400)}
    assert got == want | {400: (none, 1), 401: (none, 0)}
    assert "collect_list" not in frame._jdf.queryExecution().executedPlan().toString()


def test_first_neighbours_in_the_order_of_nodes(spark):
    graph = spark.createDataFrame([("a", "b"), ("a", "c"), ("a", "d"), ("b", "a"), ("c", "a"), ("d", "a")], "src string, dst string")
    order = spark.createDataFrame([("d", 0), ("a", 1), ("c", 2), ("b", 3)], "station string, place int")
    assert sorted(tuple(r) for r in temporal.local_nodes(graph, order, "station", 2).collect()) == [("a", "c", 2), ("a", "d", 1), ("b", "a", 1), ("c", "a", 1), ("d", "a", 1)]


def test_patch_windows(spark):
    """The last days of the archive, whatever lies between them; a station's missing patches and the time before the archive are 0."""
    p = spark.createDataFrame([("a", D(2001, 1, 3), [1.0, 2.0, math.nan, 4.0], [1, 1, 1, 0]), ("a", D(2001, 1, 9), [5.0, None, math.inf, 8.0], [1, 1, 1, 1]), ("c", D(2001, 1, 6), [9.0] * 4, [1] * 4)], "station string, obs_date date, patch array<double>, mask array<int>")
    s = spark.createDataFrame([(1, "a", D(2001, 2, 5)), (2, "b", D(2001, 1, 12)), (3, "a", D(2001, 1, 9)), (4, "c", D(2001, 1, 10)), (5, "a", None), (6, "a", D(2000, 1, 1))], "id int, station string, date date")
    got = {r["id"]: (r["seq"], r["n_patches"]) for r in temporal.patch_windows(s, p, "station", "id", 3, 4).collect()}
    zero, first, last = [0.0] * 4, [1.0, 2.0, 0.0, 0.0], [5.0, 0.0, 0.0, 8.0]
    assert got == {1: ([first, zero, last], 2), 2: ([zero] * 3, 0), 3: ([zero, first, zero], 1), 4: ([zero, [9.0] * 4, zero], 1), 5: ([zero] * 3, 0), 6: ([zero] * 3, 0)}
    assert temporal.patch_windows(s, p, "station", "id", 2, 4, [1], 2).where("id = 1").first()["seq"] == [zero, [5.0, 0.0, 0.0, 0.0]]


def test_only_patches_that_a_window_meets_are_gathered(spark):
    """every patch of the archive was cleaned and gathered by blocks, then again by samples, whether a window met it or not. Those that none meets end in a semi-join."""
    at = lambda n: D(2001, 1, 1) + dt.timedelta(n)
    p = spark.createDataFrame([(st, at(n), [float(n), 1.0], [1, 1]) for st in "ab" for n in range(200)], "station string, obs_date date, patch array<double>, mask array<int>")
    s = spark.createDataFrame([(1, "a", at(50)), (2, "a", at(51)), (3, "c", at(50))], "id int, station string, date date")
    frame = temporal.patch_windows(s, p, "station", "id", 2, 2)
    got = {r["id"]: (r["seq"], r["n_patches"]) for r in frame.collect()}
    assert got == {1: ([[48.0, 1.0], [49.0, 1.0]], 2), 2: ([[49.0, 1.0], [50.0, 1.0]], 2), 3: ([[0.0, 0.0]] * 2, 0)}
    assert "LeftSemi" in frame._jdf.queryExecution().optimizedPlan().toString()


def test_percentiles_of_many_keys(spark):
    """Exact over keys of very different size and scale, ties, negative and huge values, in one pass: nothing runs before the action."""
    import numpy as np

    rng = np.random.default_rng(3)
    rows = [(k, float(x)) for k in range(40) for x in np.round(rng.normal(0, 10.0 ** (k % 9 - 3), int(rng.integers(1, 60))), k % 4)] + [(99, 1e300), (99, -1e300), (99, 0.0), (98, None), (97, 1e9), (97, 1e9 + 1)]
    df = spark.createDataFrame(rows, "k int, v double").repartition(3)
    jobs = spark.sparkContext.statusTracker()
    before = len(jobs.getJobIdsForGroup(None))
    q = stats.percentiles(df, ["k"], "v", {"a": 0.05, "b": 0.5, "c": 1.0})
    assert len(jobs.getJobIdsForGroup(None)) == before
    got = {r["k"]: (r["a"], r["b"], r["c"]) for r in q.collect()}
    want = {k: np.percentile([x for j, x in rows if j == k], [5, 50, 100]) for k in {k for k, x in rows if x is not None}}
    assert set(got) == set(want) and all(np.allclose(got[k], w, rtol=1e-12, atol=1e-12) for k, w in want.items())


def test_clip_scale_without_a_spread(spark):
    df = spark.createDataFrame([("flat", 50.0), ("flat", 50.0), ("small", 3.0), ("wide", 0.0), ("wide", 100.0)], "c string, v double")
    got = sorted((r["c"], round(r["scaled"], 9)) for r in stats.clip_scale(df, "c", "v").collect())
    assert got == [("flat", 0.0), ("flat", 0.0), ("small", 3.0), ("wide", -1.0), ("wide", 1.0)]


def test_tiers():
    s = StructType.fromDDL("area double, era5_t double, mesan_w double, mesan_product string, s2_chl_a double, s2_days_offset int, s2_secchi_obs int, s2_name string, derived_tsi double, tp double")
    pick = lambda t: schema.tier_columns(s, t, ["area", "missing", "area"])
    assert pick("static") == ["area"] and pick("met") == ["area", "era5_t"] and pick("met_mesan") == ["area", "era5_t", "mesan_w"]
    assert pick("full") == ["area", "era5_t", "mesan_w", "s2_chl_a"] and pick("published_alg") == ["s2_chl_a", "s2_secchi_obs"] and pick("?") == []
    assert schema.distinct_names(["b", "a", "b"]) == ["b", "a"]


def test_products_and_cells(spark):
    d = spark.createDataFrame([(0.5, 10.0, math.nan, 3.0, 0.02, 0.04), (0.0, math.nan, 2.0, 3.0, None, 0.04), (math.nan, None, None, None, 0.1, 0.001)], "k double, t double, a double, b double, x double, y double")
    c = {n: F.col(n) for n in d.columns}
    got = [tuple(None if v is None else round(v, 6) for v in r) for r in d.select(water.attenuation_secchi(c["k"]), water.matter_turbidity(c["t"]), water.product_chla(c["a"], c["b"]), water.product_cdom(c["x"], c["y"])).collect()]
    assert got == [(3.4, 8.0, 3.0, 0.346574), (None, None, 2.0, None), (None, None, None, 0.0)]
    v = spark.createDataFrame([(1.23456,), (-0.5,), (None,), (math.nan,), (math.inf,)], "v double")
    assert [r[0] for r in v.select(water.fixed_decimals(F.col("v"), 2)).collect()] == ["1.23", "-0.50", "---", "---", "---"]
    o = spark.createDataFrame([("b",), ("z",), ("a",), (None,)], "c string")
    assert [r[0] for r in o.select(water.place_in(F.col("c"), ["a", "b"])).collect()] == [2, 3, 1, 3]


def test_seeded_sample(spark):
    d = spark.range(100).repartition(5)
    a = sorted(r[0] for r in stats.seeded_sample(d, "id", 10).collect())
    assert len(a) == 10 and a == sorted(r[0] for r in stats.seeded_sample(d.repartition(2), "id", 10).collect()) and a != sorted(r[0] for r in stats.seeded_sample(d, "id", 10, 7).collect())
    assert stats.seeded_sample(d, "id", 1000).count() == 100


def test_patch_model(spark):
    d = spark.createDataFrame([(k, [float(k % 2), None if k == 3 else math.nan], float(k % 2), k // 2 % 2) for k in range(40)] + [(99, None, 1.0, 0)], "id int, patch array<double>, y double, fold int")
    got = models.patch_boosted(d, "patch", "y", "fold", 2, trees=3).collect()
    assert len(got) == 40 and all(abs(r["prediction"] - r["y"]) < 0.5 for r in got)


def test_scratch_is_shared(spark):
    assert sinks.scratch(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


def test_nearest_in_time_of_a_hot_station(spark):
    """Against a plain loop: a station with most rows, cut into many blocks, repeated days, ties, null keys and dates, one shuffle."""
    import random

    rng = random.Random(5)
    at = lambda k: D(2001, 1, 1) + dt.timedelta(k)
    sample = [(k, rng.choice(["hot", "hot", "b"]), at(rng.randrange(400))) for k in range(300)] + [(900, None, at(3)), (901, "hot", None), (902, "none", at(3))]
    obs = [(rng.choice(["hot"] * 5 + ["b"]), at(rng.randrange(-20, 430)), rng.randrange(4), k) for k in range(250)] + [("hot", None, 1, 999), (None, at(3), 1, 998)]
    s = spark.createDataFrame(sample, "id int, st string, date date").repartition(3)
    o = spark.createDataFrame(obs, "st string, obs_date date, tie int, v int").repartition(3)
    for days, block in ((7, 16), (3, 9), (0, 5), (7, None)):
        out = temporal.nearest_within(s, o, ["st"], ["v", "tie"], ["tie", "v"], days, (1, 3), block)
        got = {r["id"]: (r["v"], r["offset_days"], r["n_obs"], r["match_3d"]) for r in out.collect()}
        for i, st, d in sample:
            own = sorted((abs((x - d).days), x, t, v) for y, x, t, v in obs if st and d and x and y == st and abs((x - d).days) <= days)
            want = (own[0][3], own[0][0], len(own), own[0][0] <= 3) if own else (None, None, 0, False)
            assert got[i] == want
    assert out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange hashpartitioning") == 1
