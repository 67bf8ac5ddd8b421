"""Hand-computed cases of formulas, joins and scores."""

import pytest
from pyspark.sql import functions as F

from limnos.functions import geo
from limnos.functions import water as wq
from limnos.operators import spatial, stats, temporal

L = lambda x: F.lit(x).cast("double")


def cases():
    return [
    (wq.do_saturation(L(10)), 11.362940), (wq.do_pct_saturation(L(8), L(10)), 70.404314), (wq.cdom_absorption_440(L(100)), 4.881455), (wq.cdom_absorption_440(L(0)), 0.032851),
    (wq.spectral_slope(L(1.3), L(1)), 0.016398), (wq.np_molar_ratio(L(700), L(20)), 77.396302), (wq.np_molar_ratio(L(700), L(0)), None), (wq.tsi_chla(L(5)), 46.388586), (wq.tsi_tp(L(20)), 47.348459),
    (wq.tsi_secchi(L(3)), 44.168997), (wq.mean_of(wq.tsi_chla(L(5)), wq.tsi_tp(L(20)), wq.tsi_secchi(L(None))), 46.868523), (wq.secchi_from_turbidity(L(4)), 17.0), (wq.secchi_from_turbidity(L(0)), 40.0),
    (wq.band_turbidity(L(0.01)), 6.431522), (wq.band_chla(L(0.03), L(0.04)), 5.998575), (wq.band_cdom(L(0.03), L(0.04)), 0.143841), (wq.ndci_chla(wq.ndci(L(0.020), L(0.018))), 19.109665),
    (geo.haversine(L(59), L(18), L(60), L(18)), 111194.926645), (geo.haversine(L(59), L(18), L(59), L(19)), 57269.086885), (geo.laea(L(52), L(10))[0], 4321000.0), (geo.laea(L(52), L(10))[1], 3210000.0), (geo.transverse_mercator(L(60), L(15))[0], 500000.0),
    (stats.winkler(L(1), L(2), L(5), L(0.1)), 23.0),
    ]


def test_values(spark):
    got = spark.range(1).select(*[c.alias(str(k)) for k, (c, _) in enumerate(cases())]).first()
    for x, (_, want) in zip(got, cases()):
        assert x is None if want is None else x == pytest.approx(want, abs=1e-6)


def test_classes(spark):
    rows = spark.createDataFrame([(8.0,), (8.1,), (24.0,), (42.0,), (80.0,), (80.1,), (None,)], "tp double").select(wq.tp_status(F.col("tp"))).collect()
    assert [r[0] for r in rows] == ["High", "Good", "Good", "Moderate", "Poor", "Bad", None]


def test_nearest_ties_and_unmatched(spark):
    s = spark.sql("select 1 id, 7 st, date'2020-01-05' date union all select 2, 7, date'2021-01-01' union all select 3, null, date'2020-01-05'")
    o = spark.sql("select 7 st, date'2020-01-03' obs_date, 1.0 v union all select 7, date'2020-01-07', 2.0")
    got = {r["id"]: r for r in temporal.nearest_within(s, o, ["st"], ["v"], ["v"]).collect()}
    assert (float(got[1]["v"]), got[1]["offset_days"], got[1]["n_obs"], got[1]["match_1d"], got[1]["match_3d"]) == (1.0, 2, 2, False, True)
    assert (got[2]["v"], got[2]["n_obs"], got[2]["match_7d"], got[3]["n_obs"]) == (None, 0, False, 0)


def test_idw(spark):
    cells = spark.createDataFrame([(1, 0.0, 0.0), (2, 500000.0, 0.0)], "cell int, x double, y double")
    st = spark.createDataFrame([(1, 10000.0, 0.0, 1.0), (2, 20000.0, 0.0, 2.0), (3, 50000.0, 0.0, 4.0)], "s int, rx double, ry double, v double")
    got = {r["cell"]: r for r in spatial.idw(cells, st, "cell", "s", "v").collect()}
    assert got[1]["idw"] == pytest.approx(1.286822, abs=1e-6) and got[1]["n_stations"] == 3 and got[2]["idw"] is None


def test_conformal_order_statistic(spark):
    d = spark.range(1, 21).select(F.lit(0).alias("fold"), F.col("id").cast("double").alias("s"))
    assert {r["level"]: r["q"] for r in stats.conformal_widths(d, ["fold"], "s", [0.8, 0.9, 0.95]).collect()} == {0.8: 18.0, 0.9: 20.0, 0.95: 20.0}
