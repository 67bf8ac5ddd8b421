"""Hand-computed cases of formulas, ranks, calibration, neighbours and series."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from limnos.functions import arrays, geo, water
from limnos.operators import models, spatial, stats, temporal
from limnos.sources import sinks


def one(spark, *cols):
    return list(spark.range(1).select(*cols).first())


def test_bands_clamp_reflectance(spark):
    lit = F.lit
    chla, cdom, flag, turb = one(spark, water.band_chla(lit(-0.1), lit(0.02)), water.band_cdom(lit(-0.1), lit(0.02)), water.negative_blue(lit(-0.1)), water.band_turbidity(lit(-1.0)))
    r = math.log10(1e-6 / 0.02)
    assert chla == pytest.approx(min(max(10 ** (0.366 - 3.067 * r + 1.93 * r * r + 0.649 * r**3), 0.01), 500)) and cdom == pytest.approx(-0.5 * math.log(1e-6 / 0.02))
    assert flag == 1 and turb == 0
    assert one(spark, water.band_chla(lit(None).cast("double"), lit(0.1)), water.negative_blue(lit(None).cast("double"))) == [None, 0]


def test_row_score_and_ice(spark):
    t, f, none = F.lit(True), F.lit(False), F.lit(None).cast("boolean")
    assert one(spark, *[water.row_score(a, b).alias(str(i)) for i, (a, b) in enumerate([(t, t), (t, f), (f, t), (f, f), (none, t), (t, none)])]) == [0, 1, 2, 3, 2, 1]
    d = lambda x: F.lit(x).cast("double")
    assert one(spark, *[water.ice_flag(d(a), d(b)).alias(str(i)) for i, (a, b) in enumerate([(-5, 1), (-5, 3), (-15, 1), (-5, None), (-5, float("nan")), (None, 1)])]) == [True, False, False, True, True, False]


def test_projections_come_back(spark):
    rows = [(lat, lon) for lat in (-10.0, 55.0, 61.5, 69.0) for lon in (10.0, 15.0, 24.0)]
    d = spark.createDataFrame(rows, "lat double, lon double")
    e, n = geo.transverse_mercator(F.col("lat"), F.col("lon"))
    back = geo.inverse_transverse_mercator(F.col("e"), F.col("n"))
    r, s = geo.rotate_pole(F.col("lat"), F.col("lon"), -38.0, 12.0)
    again = geo.unrotate_pole(F.col("r"), F.col("s"), -38.0, 12.0)
    for x in d.withColumns({"e": e, "n": n, "r": r, "s": s}).select("lat", "lon", back[0].alias("a"), back[1].alias("b"), again[0].alias("c"), again[1].alias("d")).collect():
        assert (x.a, x.b, x.c, x.d) == pytest.approx((x.lat, x.lon, x.lat, x.lon), abs=1e-8)


def test_patches(spark):
    p = F.array(*[F.lit(float(k)) for k in range(12)])  # 3 x 4
    crop, pad = one(spark, arrays.crop_pad(p, 3, 4, 2), arrays.crop_pad(p, 3, 4, 5, -1.0))
    assert crop == [1.0, 2.0, 5.0, 6.0] and np.array(pad).reshape(5, 5)[1:4, :4].tolist() == np.arange(12.0).reshape(3, 4).tolist() and sum(x == -1 for x in pad) == 13
    ok, mask, bad, none = one(spark, *[c.alias(str(i)) for i, c in enumerate([*arrays.valid_patch(p, 0, 11), arrays.valid_patch(p, 0, 10)[0], arrays.valid_patch(F.lit(None).cast("array<double>"), 0, 1)[1]])])
    assert ok == [float(k) for k in range(12)] and mask == 1 and bad is None and none == 0
    assert one(spark, arrays.normalise_channels(F.array(F.lit(3.0), F.lit(float("nan")), F.lit(5.0), F.lit(9.0)), [1.0, 0.0], [2.0, 4.0], [])) == [[1.0, 0.0, 2.0, 2.25]]


def test_percentiles_and_ranks(spark):
    rng = np.random.default_rng(0)
    rows = [(int(k), float(v), i) for i, (k, v) in enumerate(zip(rng.integers(0, 3, 500), rng.integers(0, 60, 500)))] + [(0, None, 500), (7, None, 501)]
    d = spark.createDataFrame(rows, "k int, v double, i int")
    got = {r["k"]: (r["a"], r["b"]) for r in stats.percentiles(d, ["k"], "v", {"a": 0.1, "b": 0.75}).collect()}
    for k in range(3):
        assert got[k] == pytest.approx(tuple(np.quantile([v for g, v, _ in rows if g == k and v is not None], [0.1, 0.75])))
    assert set(got) == {0, 1, 2}
    rank = {r["i"]: r["rank_"] for r in stats.global_rank(d, "v", "i").collect()}
    assert rank == {i: n + 1 for n, (v, i) in enumerate(sorted((v, i) for _, v, i in rows if v is not None))}
    q = {(r["k"], r["level"]): r["q"] for r in stats.conformal_widths(d, ["k"], "v", [0.8, 0.95]).collect()}
    for k in range(3):
        s = sorted(v for g, v, _ in rows if g == k and v is not None)
        for level in (0.8, 0.95):
            share = min(1.0, math.ceil((len(s) + 1) * level) / len(s))
            assert q[k, level] == np.quantile(s, share, method="higher")


@pytest.mark.parametrize("block", [4096, 40])
def test_rolling_median(spark, block):
    rng = np.random.default_rng(1)
    rows = [(i, float(o), float(v)) for i, (o, v) in enumerate(zip(rng.integers(0, 30, 300), rng.normal(size=300)))]
    d = spark.createDataFrame(rows, "i int, o double, v double")
    order = sorted(rows, key=lambda r: (r[1], r[0]))
    want = {r[0]: None if n < 4 else float(np.median([x[2] for x in order[max(0, n - 24) : n + 1]])) for n, r in enumerate(order)}
    got = {r["i"]: r["median"] for r in stats.rolling_median(d, "o", "i", "v", rows=25, least=5, block=block).collect()}
    assert got == pytest.approx(want)


def test_significance(spark):
    # Student's t: two-sided 5 % at 10 degrees of freedom is 2.228139, 1 % at 2 is 9.924843
    d = spark.createDataFrame([(2.228138852, 10.0), (9.924843201, 2.0), (0.0, 5.0), (None, 5.0), (1.0, 0.0)], "t double, n double")
    assert [r[0] for r in d.select(stats.t_probability(F.col("t"), F.col("n"))).collect()] == [pytest.approx(0.05), pytest.approx(0.01), pytest.approx(1.0), None, None]


def test_nearest_on_sphere(spark):
    rng = np.random.default_rng(3)
    left = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(rng.uniform(-90, 90, 60), rng.uniform(-180, 180, 60)))] + [(60, 10.0, 179.99), (61, None, 1.0)]
    right = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(rng.normal(40, 3, 80), rng.normal(10, 3, 80)))] + [(k, 10.0, -179.99) for k in range(80, 90)] + [(95, None, None)]
    meet = lambda a, b, c, d: 2 * 6371000 * math.asin(math.sqrt(math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2))
    a, b = spark.createDataFrame(left, "i int, lat double, lon double"), spark.createDataFrame(right, "j int, rlat double, rlon double")
    for k in (1, 5, 200):
        got = {}
        for r in spatial.nearest_on_sphere(a, b, "i", "j", k).collect():
            got.setdefault(r["i"], {})[r["rank"]] = r["j"]
        for i, lat, lon in left[:-1]:
            want = sorted((round(meet(lat, lon, p, q), 3), j) for j, p, q in right[:-1])
            if k == 200:  # of places that many share, the first ids
                assert len(got[i]) == 90
            else:
                assert [got[i][n] for n in range(1, k + 1)] == [j for _, j in want[:k]]
        assert 61 not in got
    assert spatial.nearest_on_sphere(a, b.limit(0), "i", "j").count() == 0 and spatial.nearest_on_sphere(a.limit(0), b, "i", "j").count() == 0


def test_daily_series(spark):
    rows = [("a", "2020-01-01 06:00:00", 1.0), ("a", "2020-01-01 18:00:00", 3.0), ("a", "2020-01-02 06:00:00", 5.0), *[("b", f"2020-01-01 0{h}:00:00", float(h)) for h in range(4)]]
    d = spark.createDataFrame(rows, "k string, t string, v double").withColumn("ts", F.to_timestamp("t")).withColumn("date", F.to_date("ts"))
    got = sorted((r["k"], r["is_daily"], r["v"]) for r in temporal.daily_series(d, ["k"], "date", "ts", "v").collect())
    assert got == [("a", True, 1.0), ("a", True, 3.0), ("a", True, 5.0), ("b", False, 1.5)]
    six = sorted((r["k"], str(r["date"]), r["v"]) for r in temporal.at_hour(d, ["k"], "date", "ts", "v", 6).collect())
    assert six == [("a", "2020-01-01", 1.0), ("a", "2020-01-02", 5.0), ("b", "2020-01-01", 1.5)]


def test_station_floor_and_windows(spark):
    rows = [(1, "a", 0, 1.0, 2000), (2, "a", 1, 2.0, 2001), (3, "a", 1, 3.0, 2002), (4, "b", 0, 9.0, 2003), (5, "c", 1, None, 2003)]
    d = spark.createDataFrame(rows, "i int, k string, f int, y double, yr int")
    got = {r["i"]: r["prediction"] for r in models.station_floor(d, "k", "f", "i", "y", 2).collect()}
    assert got == {1: 3.0, 2: 1.0, 3: 1.0, 4: 2.5, 5: 5.0}
    roles = models.rolling_roles(d, "yr", [("w", 2000, 2001, 2002, 2003), ("none", 1990, 1995, 2000, 2001)], (2, 1))
    assert sorted((r["win"], r["role"], r["i"]) for r in roles.collect()) == [("w", "test", 3), ("w", "test", 4), ("w", "test", 5), ("w", "train", 1), ("w", "train", 2)]
    floor = {r["i"]: r["prediction"] for r in models.rolling_floor(roles, "k", "i", "y").collect()}
    assert floor == {3: 2.0, 4: 1.5, 5: 1.5}


def test_csv_in_any_order(spark, tmp_path):
    (tmp_path / "x.csv").write_text("b,extra,a\n1.5,z,k\n,z,l\nbad,z,m\n")
    got = sinks.read_csv(spark, str(tmp_path / "x.csv"), "a string, b double", ["b"])
    assert [tuple(r) for r in got.collect()] == [("k", 1.5)] and got.columns == ["a", "b"]
