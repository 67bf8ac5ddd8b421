"""Readers, sinks, rank test, splits, patches, lines and models on small fixtures."""

import json
import math

import numpy as np
from pyspark.sql import functions as F

from limnos.functions import arrays, water
from limnos.operators import models, spatial, stats
from limnos.sources import readers, sinks


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_station_readings(spark):
    a = "Name;X\nDatum;Tid (UTC);Value;Quality\n2001-02-03;04:00:00;1,5;Y\n2001-02-03;05:00:00;x;G\n2001-02-03;06:00:00;2;G;more\nnever;07:00:00;3;G\n2001-02-04;00:00:00;4.25;"
    b = "datum;Value\r\n2002-01-01;-3\r\n"
    files = spark.createDataFrame([("a", a), ("b", b), ("c", "no header\n2001-01-01;1"), ("d", None), ("e", "")], "station string, text string")
    got = readers.station_readings(files)
    assert [(r.station, str(r.ts), r.value, r.quality) for r in got.orderBy("ts").collect()] == [("a", "2001-02-03 04:00:00", 1.5, "Y"), ("a", "2001-02-04 00:00:00", 4.25, "G"), ("b", "2002-01-01 00:00:00", -3.0, "G")]
    assert readers.station_readings(files.limit(0)).count() == 0


def test_sample_records(spark):
    ob = lambda c, *v: {"propertyCode": c, "qualityCode": "G", "observationValues": [{"value": x, "unit": "u"} for x in v]}
    rec = {"sampleId": "1", "stationId": "s", "samplingDate": "2001-05-06", "observations": [ob("P", "1"), ob("P", None, "2,5"), ob("Q", "<3"), ob("Z", " many "), ob("Y", "7")]}
    long = readers.sample_values(spark.createDataFrame([(json.dumps(rec),), ("{broken",), (None,)], "json string"))
    assert long.count() == 5
    r = readers.sample_rows(long, {"P": "tp", "Q": "q"}).collect()
    assert [(x.sample_id, str(x.date), x.tp, x.q) for x in r] == [("1", "2001-05-06", 2.5, None)]
    assert readers.open_columns(long, ["P", "Q"]).first()["bio"] == {"bio_Y": "7.0", "bio_Z": "many"}


def test_latest_and_live(spark):
    d = spark.sql("SELECT array(named_struct('from', '2001', 'x', 1), named_struct('from', '2003', 'x', 3), named_struct('from', '2002', 'x', 2)) AS p, array(map('t', 4.0D, 'w', -9.0D), map('t', 5.0D)) AS r")
    assert d.select(readers.latest(F.col("p"))["x"]).first()[0] == 3
    assert tuple(d.select(*readers.live_reading(F.col("r"), {"t": "temp", "w": "wind"})).first()) == (4.0, None)


def test_first_existing_and_columns(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0)], "station_id int, chl double")
    df.write.parquet(str(tmp_path / "b_2001.parquet"))
    names = [str(tmp_path / "a_*.parquet"), str(tmp_path / "b_*.parquet")]
    assert readers.read_first(spark, names, ["station_id"], "s2_").columns == ["station_id", "s2_chl"]
    assert readers.read_first(spark, names[:1], ["station_id"], "s2_") is None
    assert readers.pick_column(["p2_quality", "p2_temp", "t"], "^p2_") == "p2_temp"
    assert readers.pick_column(["x", "air_temp"], "^p2_", fallback="temp") == "air_temp"
    assert readers.pick_column(["x"], "^p2_") is None


def test_parts_are_filled_in(spark, tmp_path):
    path = str(tmp_path / "t")
    one = lambda *r: spark.createDataFrame(list(r), "v int, year int")
    sinks.write_parts(one((1, 2000), (2, 2001)), path)
    sinks.write_parts(one((9, 2001), (3, 2002)), path)
    assert rows(spark.read.parquet(path).select("v", "year"), "year") == [(1, 2000), (2, 2001), (3, 2002)]
    sinks.write_parts(one((9, 2001)), path, force=True)
    assert rows(spark.read.parquet(path).select("v", "year"), "year") == [(1, 2000), (9, 2001), (3, 2002)]


def test_merge_and_backfill(spark, tmp_path):
    old, new = spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int"), spark.createDataFrame([("b", 2), ("c", 2)], "k string, v int")
    assert rows(sinks.merge_results(old, new, ["k"]), "k") == [("a", 1), ("b", 2), ("c", 2)]
    assert rows(sinks.merge_results(old, new, ["k"], "first"), "k") == [("a", 1), ("b", 1), ("c", 2)]
    assert rows(sinks.not_done(new, old, ["k"]), "k") == [("c", 2)]
    d = spark.createDataFrame([(1, -0.5, "L2A"), (2, None, "L9"), (3, 0.5, "L1C")], "owt_class int, b2 double, product_level string")
    out, changed = sinks.backfill(d, "sentinel2", {}, "b2")
    assert changed and rows(out.select("owt_class_v1_provisional", "rw_blue_negative_flag", "ac_method"), "owt_class_v1_provisional") == [(1, 1, "sen2cor"), (2, 0, None), (3, 0, "toa")]
    assert not sinks.backfill(out, "sentinel2", {}, "b2")[1]
    d.write.parquet(str(tmp_path / "in"))
    assert not sinks.backfill_path(spark, str(tmp_path / "in"), str(tmp_path / "out"), "modis", {"modis": "m"}, dry_run=True)
    assert sinks.backfill_path(spark, str(tmp_path / "in"), str(tmp_path / "out"), "modis", {"modis": "m"})
    assert spark.read.parquet(str(tmp_path / "out")).where("ac_method = 'm'").count() == 3


def test_metadata_and_dictionary(spark, tmp_path):
    d = sinks.with_metadata(spark.createDataFrame([(1, 2.0)], "cell int, tsi double"), {"tsi": {"units": "1"}})
    d.write.parquet(str(tmp_path / "g"))
    assert spark.read.parquet(str(tmp_path / "g")).schema["tsi"].metadata == {"units": "1"}
    sinks.write_dictionary(spark, [{"i": 0, "name": "vv"}], "i int, name string", str(tmp_path / "d"))
    assert spark.read.json(str(tmp_path / "d")).first()["name"] == "vv"
    f = spark.createDataFrame([("x_modis_1",), ("other",)], "n string")
    assert rows(f.select("n", sinks.family(F.col("n"))), "n") == [("other", "unknown"), ("x_modis_1", "modis")]


def test_mann_whitney_and_running_counts(spark):
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 20, 300), rng.integers(3, 25, 200)
    df = spark.createDataFrame([(float(x), True) for x in a] + [(float(x), False) for x in b] + [(None, True)], "v double, g boolean")
    r = stats.mann_whitney(df, "v", F.col("g")).first()
    u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    n, both = 500, np.concatenate([a, b])
    ties = sum(c**3 - c for c in np.unique(both, return_counts=True)[1])
    z = (max(u, 300 * 200 - u) - 30000 - 0.5) / math.sqrt(300 * 200 / 12 * (n + 1 - ties / (n * (n - 1))))
    assert (r.n1, r.n2, r.u, r.significant) == (300, 200, u, True) and abs(r.z - z) < 1e-9
    c = stats.running_counts(df, "v", {"n": F.count("*")}).orderBy("v").collect()
    assert [x.n_to for x in c] == list(np.cumsum(np.unique(both, return_counts=True)[1]))
    assert stats.running_counts(df.limit(0), "v", {"n": F.count("*")}).count() == 0


def test_group_split(spark):
    d = spark.createDataFrame([(i % 50 if i % 7 else None,) for i in range(400)], "g int")
    s = stats.group_split(d, "g")
    assert s.count() == 400 and rows(s.where("g IS NULL").select("split").distinct(), "split") == [("train",)]
    per = s.where("g IS NOT NULL").select("g", "split").distinct()
    assert dict(per.groupBy("split").count().collect()) == {"train": 40, "val": 5, "test": 5}


def test_patches(spark):
    d = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0],)], "p array<double>")
    assert d.select(arrays.resize_nearest(F.col("p"), 2, 2, 4)).first()[0] == [1, 1, 2, 2, 1, 1, 2, 2, 3, 3, 4, 4, 3, 3, 4, 4]
    assert d.select(arrays.resize_bilinear(F.col("p"), 2, 2, 3)).first()[0] == [1, 1.5, 2, 2, 2.5, 3, 3, 3.5, 4]
    n = spark.createDataFrame([([1.0, None, float("nan"), float("inf"), 5.0],)], "p array<double>")
    assert n.select(arrays.normalise(F.col("p"), 1.0, 2.0)).first()[0] == [0, 0, 0, 0, 2]


def test_nearest_line_and_pixel(spark):
    p = spark.createDataFrame([(1, 0.0, 3.0), (2, 20.0, 0.0), (3, 5.0, -6.0)], "p int, x double, y double")
    s = spark.createDataFrame([(7, 0.0, 0.0, 10.0, 0.0), (6, 0.0, 6.0, 10.0, 6.0), (9, 24.0, 3.0, 24.0, 3.0)], "l int, x1 double, y1 double, x2 double, y2 double")
    assert rows(spatial.nearest_line(p, s, "p", "l", 5.0, 4.0), "p") == [(1, 6, 3.0), (2, 9, 5.0)]
    px = spark.createDataFrame([("a", 0, 19, 1.0), ("a", 3, 4, 2.0), ("a", 4, 3, 3.0)], "scene string, pr int, pc int, value double")
    assert rows(spatial.nearest_pixel(spark.createDataFrame([(1, 0, 0)], "k int, r int, c int"), px, "k", "scene"), "k") == [(1, "a", 3, 4, 2.0, 25)]


def test_text_and_types(spark):
    d = spark.createDataFrame([(2, "Air temp. (mean): 1 h", None, "2001_02_03_x"), (3, "Water", None, "s_20010203"), (4, None, None, "none")], "n int, t string, ts timestamp, i string")
    got = d.select(water.column_slug(F.col("n"), F.col("t")), water.scene_date(F.col("ts"), F.col("i"))).collect()
    assert [(r[0], str(r[1])) for r in got] == [("p2_air_temp_mean", "2001-02-03"), ("p3_water", "2001-02-03"), (None, "None")]
    w = spark.createDataFrame([(0.01, 0.01, 0.01, 21.0), (0.01, 0.01, 0.03, None), (0.01, 0.02, 0.01, 1.0), (0.03, 0.01, 0.001, 1.0), (0.01, 0.01, 0.01, 1.0)], "b double, r double, n double, c double")
    assert [x[0] for x in w.select(water.water_type(*map(F.col, "brnc"))).collect()] == [4, 3, 2, 1, 3]


def test_ridge_is_the_closed_form(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 2))
    y = x @ [2.0, -1.0] + rng.normal(size=120)
    df = spark.createDataFrame([(i, float(a), float(b), float(c), i % 5) for i, ((a, b), c) in enumerate(zip(x, y))], "i int, a double, b double, y double, fold int")
    got = np.array([r.prediction for r in models.out_of_fold(df, ["a", "b"], "y", "fold", "ridge", alpha=3.0).orderBy("i").collect()])
    want = np.zeros(120)
    for k in range(5):
        t = np.arange(120) % 5 != k
        m, s = x[t].mean(0), x[t].std(0, ddof=1)
        z = (x[t] - m) / s
        w = np.linalg.solve(z.T @ z + 3.0 * np.eye(2), z.T @ (y[t] - y[t].mean()))
        want[~t] = (x[~t] - m) / s @ w + y[t].mean()
    assert np.abs(got - want).max() < 1e-3
    top = models.importances(df, ["a", "b"], "y", trees=3).collect()
    assert [r.feature for r in top] == ["a", "b"]


def test_fourier_features_approximate_the_kernel(spark):
    df = spark.createDataFrame([(0.0, 0.0), (0.5, 0.2), (None, 1.0)], "a double, b double")
    f = [np.array(r.fourier) for r in models.fourier_features(df, ["a", "b"], 4096, 1.0).collect()]
    assert abs(f[0] @ f[1] - math.exp(-0.29)) < 0.06 and abs(f[0] @ f[0] - 1) < 1e-9 and abs(f[0] @ f[2] - math.exp(-1)) < 0.06
