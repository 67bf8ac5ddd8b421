"""Steps that must hold on larger tables: what the planner does with them, and results at edges."""

import datetime as dt
import math

import numpy as np
from pyspark.sql import functions as F

from limnos.functions import arrays
from limnos.operators import kdtree, spatial, stats, temporal
from limnos.plans import q_cases, q_joins


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def day(s):
    return dt.date.fromisoformat(s)


def test_antecedent_months_broadcast_no_exploded_samples(spark, tmp_path):
    """samples of a small file were exploded twelvefold and then broadcast."""
    s = spark.createDataFrame([(1, 7, day("2001-02-28")), (2, 7, day("2000-01-31")), (3, 8, day("2001-01-01")), (4, None, day("2001-01-01")), (5, 7, None)], "sample int, k int, date date")
    d = spark.createDataFrame([(7, day("2001-02-01"), 1.0), (7, day("2001-01-31"), 2.0), (7, day("2001-01-01"), 4.0), (7, day("2000-02-01"), 5.0), (7, day("2000-01-31"), 6.0), (7, day("1999-12-31"), None)], "k int, obs_date date, q double")
    s.write.parquet(f"{tmp_path}/s")
    d.write.parquet(f"{tmp_path}/d")
    out = temporal.antecedent_months(spark.read.parquet(f"{tmp_path}/s"), spark.read.parquet(f"{tmp_path}/d"), "k", "sample", "q")
    assert "BroadcastHashJoin" not in plan(out)
    assert sorted(map(tuple, out.collect())) == [(1, 1, 6.0, 2.0, 4.0, 3.0), (1, 12, 5.0, 5.0, 5.0, 5.0), (2, 1, None, None, None, None)]


def test_correlation_without_spread(spark):
    """values of a group that do not vary raised an error of division by zero."""
    rows = [(1, 0.1, 0.1), (1, 0.1, 0.2), (1, 0.1, 0.3), (2, 0.1, 0.2), (2, 0.2, 0.4), (2, 0.3, 0.6), (3, 0.1, 0.1), (4, None, 1.0), (4, 5.0, None), (4, 2.0, 1.0), (4, 3.0, 3.0), (4, 4.0, 2.0)]
    d = spark.createDataFrame(rows, "k int, a double, b double")
    got = {r["k"]: r["r"] for r in d.groupBy("k").agg(stats.correlation(F.col("a"), F.col("b")).alias("r")).collect()}
    assert got[1] is None and got[3] is None and 1 - 1e-12 < got[2] <= 1 and abs(got[4] - 0.5) < 1e-12


def test_significance_of_constant_series(spark, tmp_path):
    """a station whose discounts do not vary."""
    spark.createDataFrame([(k, k % 2) for k in range(8)], "o_orderkey long, o_custkey long").withColumns({"o_orderdate": F.lit("1999-01-01"), "o_totalprice": F.lit(1.0)}).write.parquet(f"{tmp_path}/orders.parquet")
    lines = [(k, 1, "1999-01-02", "A", 1.0, 1.0, 0.05 if k % 2 else k / 100, k * k / 100) for k in range(8)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_shipdate string, l_returnflag string, l_quantity double, l_extendedprice double, l_discount double, l_tax double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r["station_id"]: r for r in q_cases.st3_significance(spark, str(tmp_path)).collect()}
    assert got[1]["r"] is None and got[1]["p"] is None and got[0]["r"] > 0.9 and 0 < got[0]["p"] < 0.1


def test_asof_of_repeated_lines_follows_no_row_order(spark, tmp_path):
    """two lines of one order, number and date; whichever came first was taken."""
    spark.createDataFrame([(k, 1, "1999-01-01", 1.0) for k in range(40)], "o_orderkey long, o_custkey long, o_orderdate string, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    lines = [(5, 1, "1999-01-02", "A", 1.0, p, 0.1, 0.0) for p in (30.0, 10.0, 20.0)]
    for name, own in (("a", lines), ("b", lines[::-1])):
        spark.createDataFrame(own, "l_orderkey long, l_linenumber int, l_shipdate string, l_returnflag string, l_quantity double, l_extendedprice double, l_discount double, l_tax double").coalesce(1).write.parquet(f"{tmp_path}/{name}/lineitem.parquet")
        (tmp_path / name / "orders.parquet").symlink_to(tmp_path / "orders.parquet")
        got = q_joins.jn4_asof_nearest(spark, f"{tmp_path}/{name}").collect()
        assert len(got) == 40 and {(r["price"], r["n_obs"]) for r in got} == {(10.0, 3)}


def test_asof_takes_lines_without_a_number_last(spark, tmp_path):
    """of lines on one day those without a number came first; the SQL's order has them last. Before, on and after the sample's day."""
    spark.createDataFrame([(k, 1, f"1999-01-{d:02}", 1.0) for k, d in ((5, 1), (6, 2), (7, 3))], "o_orderkey long, o_custkey long, o_orderdate string, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    lines = [(5, n, "1999-01-02", "A", 1.0, p, 0.1, 0.0) for n, p in ((None, 10.0), (2, 20.0), (1, 30.0), (None, 40.0))]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_shipdate string, l_returnflag string, l_quantity double, l_extendedprice double, l_discount double, l_tax double").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = q_joins.jn4_asof_nearest(spark, str(tmp_path)).collect()
    assert sorted((r["sample_id"], r["price"], r["offset_days"], r["n_obs"]) for r in got) == [(5, 30.0, 1, 4), (6, 30.0, 0, 4), (7, 30.0, 1, 4)]


def test_nearest_within_a_radius_meets_few(spark, monkeypatch):
    """every pair within the radius was built; here all points lie within it. Ties, shared places and points beyond the radius as all pairs give them."""
    monkeypatch.setattr(kdtree, "LEAF", 16)
    rng = np.random.default_rng(3)
    at = [(float(10 * a), float(10 * b)) for a, b in rng.integers(0, 40, (600, 2))] + [(50.0, 50.0)] * 12 + [(9000.0, 9000.0)]
    rows = [(i, a, b) for i, (a, b) in enumerate(at)]
    pts = spark.createDataFrame([*rows, (2000, None, 1.0)], "id int, x double, y double")
    far = lambda p, q: math.sqrt((p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2)
    for radius in (35.0, 1000.0):
        met = spatial.nearest(pts, pts.select(F.col("id").alias("o"), F.col("x").alias("rx"), F.col("y").alias("ry")), "id", "o", radius, 3)
        got = {(r["id"], r["rank"]): r["o"] for r in met.collect()}
        want = {(p[0], i + 1): o for p in rows for i, (d, o) in enumerate(sorted((far(p, q), q[0]) for q in rows)[:3]) if d <= radius}
        assert got == want
        edges = {(r["src"], r["dst"]) for r in spatial.knn_graph(pts, "id", radius, 4).collect()}
        top = {(p[0], o) for p in rows for d, o in sorted((far(p, q), q[0]) for q in rows if q[0] != p[0])[:4] if d <= radius}
        assert edges == top | {(b, a) for a, b in top}
    assert "leaf_" in plan(met)


def test_calendar_is_cut_from_one_row_a_series(spark):
    """every key's every day was a row of a join. Leap days, null values, keys and dates, a key of dates unknown."""
    rows = [(1, day("2000-02-29"), 2.0), (1, day("2000-03-01"), None), (1, day("2001-12-31"), 3.5), (2, day("2000-02-01"), 0.0), (3, None, 1.0), (None, day("2000-05-05"), 9.0)]
    d = spark.createDataFrame(rows, "k int, t date, v double")
    months = {(r["k"], str(r["month"])): r for r in arrays.calendar_months(d, "k", "t", "v").collect()}
    assert len(months) == 3 * 24 and {k for k, _ in months} == {1, 2, 3}
    feb = months[1, "2000-02-01"]
    assert feb["values"] == [0.0] * 28 + [2.0] and feb["mask"] == [0] * 28 + [1]
    assert sum(months[1, "2000-03-01"]["mask"]) == 0 and months[2, "2000-02-01"]["mask"] == [1] + [0] * 28
    out = arrays.on_calendar(d, "k", "t", "v")
    assert plan(out).count("Join") == 1  # with the span, one row
    got = {(r["k"], str(r["t"])): (r["v"], r["mask"]) for r in out.collect()}
    assert len(got) == 3 * 731 and got[1, "2001-12-31"] == (3.5, 1) and got[1, "2000-03-01"] == (0.0, 0) and sum(m for _, m in got.values()) == 3


def test_first_polygon_in_rounds(spark, monkeypatch):
    """a point met every polygon that holds it, though the smallest id is asked for. Rounds of 4 and 32 give what one round gives."""
    rng = np.random.default_rng(8)
    boxes = [(int(i), float(a), float(b)) for i, (a, b) in zip(rng.permutation(3000)[:150], rng.uniform(0, 60, (150, 2)))]
    edges = [(i, *e) for i, a, b in boxes for e in ((a, b, a + 30, b), (a + 30, b, a + 30, b + 30), (a + 30, b + 30, a, b + 30), (a, b + 30, a, b))]
    pts = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.uniform(-5, 95, (300, 2)))]
    want = {i: min((p for p, a, b in boxes if a <= x < a + 30 and b <= y < b + 30), default=None) for i, x, y in pts}
    e, p = spark.createDataFrame(edges, "poly int, x1 double, y1 double, x2 double, y2 double"), spark.createDataFrame(pts, "pt int, x double, y double")
    met, inside = [], spatial.points_in_polygons

    def counted(*args):
        out = inside(*args)
        met.append(out.count())
        return out

    monkeypatch.setattr(spatial, "points_in_polygons", counted)
    monkeypatch.setattr(spatial, "_FIRST", 4)
    got = {r["pt"]: r["poly"] for r in spatial.first_polygon(p, e, "pt", "poly", 10.0).collect()}
    assert got == {i: v for i, v in want.items() if v is not None}
    assert len(met) > 1 and sum(met) < inside(p, e, "pt", "poly", 10.0).count() / 2


def test_lags_are_looked_up_above_the_join(spark):
    """monthly means were copied to seven lags and then shuffled."""
    out = q_joins.jn11_lag_correlogram(spark, "/root/testdata/sf0.001")
    tree = out._jdf.queryExecution().optimizedPlan().toString()
    assert tree.index("Generate explode") < tree.index("Join")
