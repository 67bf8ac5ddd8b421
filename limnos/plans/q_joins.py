"""Queries of joins in time and space, windows and gridding."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import spatial, stats, temporal
from .tables import daily, obs, query, read, readings, samples, stations


@query("""
WITH m AS (SELECT s.sample_id, o.price, o.disc, abs(o.obs_date - s.date) AS off, o.obs_date, o.ok, o.ln,
  row_number() OVER (PARTITION BY s.sample_id ORDER BY abs(o.obs_date - s.date), o.obs_date, o.ok, o.ln) AS r, count(*) OVER (PARTITION BY s.sample_id) AS n
  FROM $samples s JOIN $obs o ON s.station_id = o.station_id AND abs(o.obs_date - s.date) <= 7)
SELECT s.sample_id, s.station_id, m.price, m.disc, coalesce(CAST(m.off AS INT), -1) AS offset_days, coalesce(m.n, 0) AS n_obs, coalesce(off <= 1, false) AS match_1d, coalesce(off <= 3, false) AS match_3d, coalesce(off <= 7, false) AS match_7d,
  CASE WHEN m.n IS NULL THEN 0 WHEN off <= 1 THEN 3 WHEN off <= 3 THEN 2 ELSE 1 END AS score
FROM $samples s LEFT JOIN m ON s.sample_id = m.sample_id AND m.r = 1""")
def jn4_asof_nearest(spark, d):
    """JN-4, JN-5, JN-6: nearest observation within seven days, its offset, flags by window, the count, a score."""
    s = samples(spark, d).select("sample_id", "station_id", "date")
    out = temporal.nearest_within(s, obs(spark, d), ["station_id"], ["price", "disc"], ["ok", "ln", "price", "disc"])
    score = F.when(F.col("n_obs") == 0, 0).when(F.col("offset_days") <= 1, 3).when(F.col("offset_days") <= 3, 2).otherwise(1)
    return out.withColumn("score", score).withColumn("offset_days", F.coalesce("offset_days", F.lit(-1))).drop("date")


@query("""SELECT sensor, count(*) AS n, round(sqrt(avg((q - tp) * (q - tp))), 4) AS rmse, round(avg(q - tp), 4) AS bias
FROM $samples s JOIN $obs o ON s.station_id = o.station_id AND abs(o.obs_date - s.date) <= 3 GROUP BY sensor""")
def jn7_interval_matchup(spark, d):
    """JN-7: all pairs within three days, scored by sensor."""
    m = temporal.within_days(samples(spark, d), obs(spark, d), ["station_id"], 3)
    e = F.col("q") - F.col("tp")
    return m.groupBy("sensor").agg(F.count("*").alias("n"), F.round(F.sqrt(F.avg(e * e)), 4).alias("rmse"), F.round(F.avg(e), 4).alias("bias"))


@query("""WITH p AS (SELECT DISTINCT a.station_id, a.obs_date AS da, b.obs_date AS db FROM $obs a JOIN $obs b ON a.station_id = b.station_id AND a.sensor = 'A' AND b.sensor = 'N' AND abs(a.obs_date - b.obs_date) <= 28)
SELECT station_id, count(*) AS n, CAST(min(da) AS VARCHAR) AS first_a, CAST(max(db) AS VARCHAR) AS last_b FROM p GROUP BY station_id""")
def jn8_sensor_pairs(spark, d):
    """JN-8 and SE-2: distinct date pairs of two sensors within 28 days, by adjacent buckets."""
    o = obs(spark, d)
    a = o.where("sensor = 'A'").select("station_id", F.col("obs_date").alias("date")).distinct()
    b = o.where("sensor = 'N'").select("station_id", "obs_date").distinct()
    m = temporal.within_days(a, b, ["station_id"], 28)
    return m.groupBy("station_id").agg(F.count("*").alias("n"), F.min("date").cast("string").alias("first_a"), F.max("obs_date").cast("string").alias("last_b"))


@query("""WITH k AS (SELECT s.sample_id, u.o AS shift, dd.q, row_number() OVER (PARTITION BY s.sample_id ORDER BY u.o) AS r
 FROM $samples s, (SELECT unnest(range(-3, 4)) AS o) u, $daily dd WHERE dd.station_id = s.station_id AND dd.obs_date = s.date + CAST(u.o AS INT))
SELECT sample_id, CAST(shift AS INT) AS shift, q FROM k WHERE r = 1""")
def jn9_shifted_key(spark, d):
    """JN-9: offsets -3 to 3 tried in order, the first hit stays."""
    s = samples(spark, d).select("sample_id", "station_id", "date").withColumn("shift", F.explode(F.sequence(F.lit(-3), F.lit(3)))).withColumn("obs_date", F.date_add("date", F.col("shift")))
    m = s.hint("merge").join(daily(spark, d), ["station_id", "obs_date"])  # seven rows a sample, which the planner takes for one
    return m.groupBy("sample_id").agg(F.min(F.struct("shift", "q")).alias("b")).select("sample_id", "b.shift", "b.q")


@query("""WITH a AS (SELECT station_id, year(date) * 12 + month(date) AS p, avg(v) AS av FROM $samples GROUP BY 1, 2), b AS (SELECT station_id, year(obs_date) * 12 + month(obs_date) AS p, avg(q) AS bv FROM $daily GROUP BY 1, 2)
SELECT CAST(l.lag AS INT) AS lag, count(*) AS n, round(corr(av, bv), 6) AS r FROM (SELECT unnest(range(7)) AS lag) l, a JOIN b ON a.station_id = b.station_id WHERE a.p = b.p + l.lag GROUP BY l.lag HAVING count(*) > 20""")
def jn11_lag_correlogram(spark, d):
    """JN-11, ST-9: monthly rollups joined at lags of 0 to 6 months, Pearson r by lag."""
    p = lambda c: F.year(c) * 12 + F.month(c)
    a = samples(spark, d).groupBy("station_id", p("date").alias("p")).agg(F.avg("v").alias("av"))
    b = daily(spark, d).groupBy("station_id", p("obs_date").alias("p")).agg(F.struct(F.avg("q").alias("bv")).alias("b")).where("p IS NOT NULL")
    # a station's months are one row, bounded by the calendar: lags are looked up there, not shuffled
    own = b.groupBy("station_id").agg(F.map_from_entries(F.collect_list(F.struct("p", "b"))).alias("months"))
    met = a.where("p IS NOT NULL").join(own, "station_id").select("av", "p", "months", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("lag"))
    met = met.select("lag", "av", F.try_element_at("months", F.col("p") - F.col("lag")).alias("b")).where("b IS NOT NULL").select("lag", "av", "b.bv")
    return met.groupBy("lag").agg(F.count("*").alias("n"), F.round(stats.correlation(F.col("av"), F.col("bv")), 6).alias("r")).where("n > 20")


@query("""SELECT s.sample_id, d1.q AS same_day, st.bal, st.seg, round(y.v_year, 4) AS v_year FROM $samples s LEFT JOIN $daily d1 ON s.station_id = d1.station_id AND s.date = d1.obs_date
LEFT JOIN $stations st ON s.station_id = st.station_id LEFT JOIN (SELECT station_id, year(date) AS yr, avg(v) AS v_year FROM $samples GROUP BY 1, 2) y ON y.station_id = s.station_id AND y.yr = year(s.date)""")
def jn1_feature_table(spark, d):
    """JN-1, JN-2, JN-3, PRJ-1: exact daily, static and station-year joins anchored on samples."""
    s = samples(spark, d)
    y = s.groupBy("station_id", F.year("date").alias("yr")).agg(F.round(F.avg("v"), 4).alias("v_year"))
    day = daily(spark, d).withColumnsRenamed({"obs_date": "date", "q": "same_day"})
    out = s.join(day, ["station_id", "date"], "left").join(stations(spark, d).select("station_id", "bal", "seg"), "station_id", "left")
    return out.withColumn("yr", F.year("date")).join(y, ["station_id", "yr"], "left").select("sample_id", "same_day", "bal", "seg", "v_year")


@query("""SELECT seg, count(*) AS n FROM $stations s WHERE s.station_id IN (SELECT station_id FROM $obs WHERE sensor = 'R') AND s.station_id NOT IN (SELECT station_id FROM $samples WHERE tp = 5) GROUP BY seg""")
def jn22_semi_anti(spark, d):
    """JN-22, FLT-7, SE-3: membership in one key set, absence from another."""
    s = stations(spark, d).join(obs(spark, d).where("sensor = 'R'").select("station_id"), "station_id", "left_semi")
    return s.join(samples(spark, d).where("tp = 5").select("station_id"), "station_id", "left_anti").groupBy("seg").agg(F.count("*").alias("n"))


@query("""WITH p AS (SELECT nation AS pid, avg(x) AS cx, avg(y) AS cy FROM $stations GROUP BY nation), e AS (SELECT pid, cx + dx1 AS x1, cy + dy1 AS y1, cx + dx2 AS x2, cy + dy2 AS y2 FROM p,
 (VALUES (-80000.5, -60000.5, 90000.5, -40000.5), (90000.5, -40000.5, 40000.5, 95000.5), (40000.5, 95000.5, -80000.5, -60000.5)) v(dx1, dy1, dx2, dy2))
SELECT station_id, pid FROM $stations s, e GROUP BY station_id, pid HAVING sum(CASE WHEN (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / nullif(y2 - y1, 0) + x1 THEN 1 ELSE 0 END) % 2 = 1""")
def jn12_point_in_polygon(spark, d):
    """JN-12: stations inside triangles around each nation's centre, by edge parity."""
    s = stations(spark, d)
    tri = [(-80000.5, -60000.5, 90000.5, -40000.5), (90000.5, -40000.5, 40000.5, 95000.5), (40000.5, 95000.5, -80000.5, -60000.5)]
    p = s.groupBy(F.col("nation").alias("pid")).agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    e = p.withColumn("e", F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("a", "b", "c", "d"), t)]) for t in tri])))
    e = e.select("pid", (F.col("cx") + F.col("e.a")).alias("x1"), (F.col("cy") + F.col("e.b")).alias("y1"), (F.col("cx") + F.col("e.c")).alias("x2"), (F.col("cy") + F.col("e.d")).alias("y2"))
    return spatial.points_in_polygons(s.select("station_id", "x", "y"), e, "station_id", "pid", 50_000.0)


@query("""WITH s AS (SELECT s_suppkey AS sup, CAST(s_suppkey * 6151 % 100000 AS DOUBLE) * 10 AS rx, CAST(s_suppkey * 3571 % 100000 AS DOUBLE) * 10 AS ry FROM supplier),
r AS (SELECT station_id, sup, sqrt((x - rx) * (x - rx) + (y - ry) * (y - ry)) AS dist FROM $stations, s)
SELECT station_id, sup, round(dist, 3) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY dist, sup) AS k FROM r WHERE dist <= 150000) WHERE k = 1""")
def jn18_nearest_point(spark, d):
    """JN-19: nearest of free coordinates within a cutoff."""
    k = F.col("s_suppkey")
    s = read(spark, d, "supplier").select(k.alias("sup"), ((k * 6151 % 100000).cast("double") * 10).alias("rx"), ((k * 3571 % 100000).cast("double") * 10).alias("ry"))
    return spatial.nearest(stations(spark, d).select("station_id", "x", "y"), s, "station_id", "sup", 150_000.0).select("station_id", "sup", F.round("dist", 3).alias("dist"))


@query("""WITH m AS (SELECT a.station_id AS src, b.station_id AS dst, row_number() OVER (PARTITION BY a.station_id ORDER BY sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), b.station_id) AS r
 FROM $stations a, $stations b WHERE a.station_id <> b.station_id AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 60000),
u AS (SELECT src, dst FROM m WHERE r <= 8 UNION SELECT dst, src FROM m WHERE r <= 8)
SELECT src, dst, round(1.0 / count(*) OVER (PARTITION BY src), 6) AS weight FROM u""")
def jn21_knn_graph(spark, d):
    """A symmetric graph of the eight nearest stations within 60 km in the plane (JN-21 on the sphere: `jn21_sphere_graph`), row-normalised."""
    return spatial.knn_graph(stations(spark, d), "station_id", 60_000.0).select("src", "dst", F.round("weight", 6).alias("weight"))


@query("""WITH c AS (SELECT gx * 25 + gy AS cell, CAST(gx * 40000 AS DOUBLE) + 20000 AS x, CAST(gy * 40000 AS DOUBLE) + 20000 AS y FROM (SELECT unnest(range(25)) AS gx) a, (SELECT unnest(range(25)) AS gy) b),
p AS (SELECT c.cell, s.station_id, s.bal, sqrt((c.x - s.x) * (c.x - s.x) + (c.y - s.y) * (c.y - s.y)) AS dist FROM c, $stations s),
r AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY dist, station_id) AS k FROM p WHERE dist <= 50000),
g AS (SELECT cell, coalesce(avg(CASE WHEN dist = 0 THEN bal END), sum(CASE WHEN k <= 12 AND dist > 0 THEN bal / (dist * dist) END) / sum(CASE WHEN k <= 12 AND dist > 0 THEN 1 / (dist * dist) END)) AS idw, count(*) AS n FROM r WHERE k <= 20 GROUP BY cell)
SELECT c.cell, round(g.idw, 4) AS idw, coalesce(g.n, 0) AS n_stations FROM c LEFT JOIN g ON c.cell = g.cell""")
def gr1_idw(spark, d):
    """GR-1, GR-2, FN-G6: inverse-distance gridding of a station value and the contributing stations."""
    c = spark.range(25).select(F.col("id").alias("gx")).withColumn("gy", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(24).cast("long"))))
    c = c.select((F.col("gx") * 25 + F.col("gy")).alias("cell"), (F.col("gx") * 40000.0 + 20000).alias("x"), (F.col("gy") * 40000.0 + 20000).alias("y"))
    s = stations(spark, d).select("station_id", F.col("x").alias("rx"), F.col("y").alias("ry"), "bal")
    return spatial.idw(c, s, "cell", "station_id", "bal").withColumn("idw", F.round("idw", 4))


@query("""SELECT CAST(least(greatest(round((lat - 55) / 0.5), 0), 27) AS INT) AS yi, CAST(least(greatest(round((lon - 11) / 0.5), 0), 25) AS INT) AS xi, count(*) AS n, round(avg(bal), 4) AS bal FROM $stations GROUP BY 1, 2""")
def jn16_regular_cell(spark, d):
    """JN-16: nearest cell of a regular grid by closed-form index, clipped to the grid."""
    i = lambda c, at, n: F.least(F.greatest(F.round((F.col(c) - at) / 0.5), F.lit(0)), F.lit(n)).cast("int")
    return stations(spark, d).groupBy(i("lat", 55, 27).alias("yi"), i("lon", 11, 25).alias("xi")).agg(F.count("*").alias("n"), F.round(F.avg("bal"), 4).alias("bal"))


@query("""WITH r AS (SELECT station_id, cos(radians(lon) - radians(15)) * cos(radians(lat)) AS x0, sin(radians(lon) - radians(15)) * cos(radians(lat)) AS y0, sin(radians(lat)) AS z0, radians(60) AS t FROM $stations)
SELECT station_id, round(degrees(asin(-sin(t) * x0 + cos(t) * z0)), 6) AS rlat, round(degrees(atan2(y0, cos(t) * x0 + sin(t) * z0)), 6) AS rlon FROM r""")
def jn17_rotated_pole(spark, d):
    """JN-17, FN-G3: station coordinates on a rotated-pole grid."""
    la, lo = geo.rotate_pole(F.col("lat"), F.col("lon"), -30.0, 15.0)
    return stations(spark, d).select("station_id", F.round(la, 6).alias("rlat"), F.round(lo, 6).alias("rlon"))


@query("""WITH g AS (SELECT station_id, obs_date, CASE WHEN (station_id + day(obs_date)) % 11 = 0 THEN NULL ELSE q END AS q FROM $daily),
w AS (SELECT s.sample_id, g.q, row_number() OVER (PARTITION BY s.sample_id ORDER BY g.obs_date DESC) AS back FROM $samples s JOIN g ON g.station_id = s.station_id AND g.obs_date >= s.date - 30 AND g.obs_date < s.date)
SELECT s.sample_id, CAST(count(w.back) > 0 AS INT) AS has, round(coalesce(sum(w.q), 0), 4) AS total, round(coalesce(sum(w.q * (31 - w.back)), 0), 4) AS weighted FROM samples s LEFT JOIN w ON w.sample_id = s.sample_id GROUP BY s.sample_id""")
def wn4_antecedent(spark, d):
    """WN-4: the days that exist among the thirty before each sample, packed against the right end, and one mask a sample; checked by sums over positions. Some values are null: their days keep their place."""
    q = F.when((F.col("station_id") + F.dayofmonth("obs_date")) % 11 != 0, F.col("q"))
    a = temporal.antecedent_window(samples(spark, d), daily(spark, d).withColumn("q", q), "station_id", "sample_id", "q", 30)
    total = F.aggregate("seq", F.lit(0.0), lambda s, x: s + x)
    weighted = F.aggregate(F.transform("seq", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return a.select("sample_id", "has", F.round(total, 4).alias("total"), F.round(weighted, 4).alias("weighted"))


@query("""WITH m AS (SELECT station_id, date_trunc('month', obs_date) AS mo, sum(q) AS s, min(q) AS lo, max(q) AS hi, avg(q) AS av FROM $daily GROUP BY 1, 2)
SELECT sample_id, CAST(l.lag AS INT) AS lag, round(s, 4) AS m_sum, lo AS m_min, hi AS m_max, round(av, 4) AS m_mean FROM $samples x, (SELECT unnest(range(1, 13)) AS lag) l, m WHERE m.station_id = x.station_id AND m.mo = date_trunc('month', x.date) - to_months(CAST(l.lag AS INT))""")
def wn5_antecedent_months(spark, d):
    """WN-5: twelve calendar months before each sample from a station-month rollup."""
    return temporal.antecedent_months(samples(spark, d), daily(spark, d), "station_id", "sample_id", "q").select("sample_id", "lag", F.round("m_sum", 4).alias("m_sum"), "m_min", "m_max", F.round("m_mean", 4).alias("m_mean"))


@query("""WITH e AS (SELECT event_id, user_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS x FROM $readings), n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM e),
k AS (SELECT *, max(CASE WHEN x IS NOT NULL THEN i END) OVER w AS p, min(CASE WHEN x IS NOT NULL THEN i END) OVER v AS nx FROM n WINDOW w AS (PARTITION BY user_id ORDER BY i), v AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT k.event_id, round(CASE WHEN k.x IS NOT NULL THEN k.x WHEN k.i - k.p <= 3 THEN CASE WHEN b.x IS NULL THEN a.x ELSE a.x + (b.x - a.x) * (k.i - k.p) / (k.nx - k.p) END END, 6) AS linear,
 round(coalesce((SELECT z.x FROM n z WHERE z.user_id = k.user_id AND z.i BETWEEN k.i - 7 AND k.i AND z.x IS NOT NULL ORDER BY z.i DESC LIMIT 1), 0), 6) AS forward
FROM k LEFT JOIN n a ON a.user_id = k.user_id AND a.i = k.p LEFT JOIN n b ON b.user_id = k.user_id AND b.i = k.nx""")
def imp1_gap_fill(spark, d):
    """IMP-1, IMP-2, WN-3: linear fill of at most three rows, forward fill of at most seven, then zero."""
    e = readings(spark, d).select("event_id", "user_id", F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("x"))
    a = temporal.fill_linear(e, ["user_id"], "event_id", "x").select("event_id", "user_id", "x", F.round("filled", 6).alias("linear"))
    return temporal.fill_forward(a, ["user_id"], "event_id", "x").select("event_id", "linear", F.round("filled", 6).alias("forward"))


@query("""WITH i AS (SELECT user_id, date, greatest(0, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS inc, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS raw FROM $readings)
SELECT user_id, CAST(date AS VARCHAR) AS date, round(sum(CASE WHEN raw IS NOT NULL THEN inc END), 4) AS total FROM i GROUP BY 1, 2""")
def ag11_increments(spark, d):
    """AG-11, WN-1: accumulated values to increments, none below zero, summed by day."""
    return temporal.increments(readings(spark, d), ["user_id"], ["ts", "event_id"], "value").groupBy("user_id", F.col("date").cast("string").alias("date")).agg(F.round(F.sum("increment"), 4).alias("total"))


@query("""SELECT user_id, CAST(date AS VARCHAR) AS date, round(avg(value), 4) AS mean, CASE max(CASE flag WHEN 'R' THEN 3 WHEN 'Y' THEN 2 ELSE 1 END) WHEN 3 THEN 'R' WHEN 2 THEN 'Y' ELSE 'G' END AS worst,
 count(DISTINCT hour(ts)) <= 2 AS is_daily, round(coalesce(avg(CASE WHEN hour(ts) = 6 THEN value END), avg(value)), 4) AS at_six FROM $readings GROUP BY user_id, date""")
def ag13_daily_flags(spark, d):
    """AG-13: daily means with the worst flag; by day also whether it has two hours at most, and the value at six o'clock or the mean."""
    hour = F.hour("ts")
    return readings(spark, d).groupBy("user_id", F.col("date").cast("string").alias("date")).agg(F.round(F.avg("value"), 4).alias("mean"), temporal.worst_flag("flag").alias("worst"), (F.countDistinct(hour) <= 2).alias("is_daily"), F.round(F.coalesce(F.avg(F.when(hour == 6, F.col("value"))), F.avg("value")), 4).alias("at_six"))


@query("""WITH f AS (SELECT user_id, date, event_type, arg_min(value, event_id) AS v FROM $readings GROUP BY 1, 2, 3)
SELECT user_id, CAST(date AS VARCHAR) AS date, max(CASE WHEN event_type = 'click' THEN v END) AS click, max(CASE WHEN event_type = 'purchase' THEN v END) AS purchase, max(CASE WHEN event_type = 'view' THEN v END) AS view FROM f GROUP BY 1, 2""")
def ag15_first_wins_pivot(spark, d):
    """AG-15, PV-1: the first arrival of a cell wins, then wide."""
    f = readings(spark, d).groupBy("user_id", "date", "event_type").agg(F.min_by("value", "event_id").alias("v"))
    return f.groupBy("user_id", F.col("date").cast("string").alias("date")).pivot("event_type", ["click", "purchase", "view"]).agg(F.first("v"))


@query("""SELECT station_id, sensor, ok, ln, price FROM (SELECT *, row_number() OVER (PARTITION BY station_id, sensor ORDER BY price DESC, ok, ln) AS r FROM $obs) WHERE r = 1""")
def flt8_largest_per_key(spark, d):
    """FLT-8, FLT-17, WN-12: the largest match per key, ties by an explicit order."""
    o = obs(spark, d)
    return temporal.dedupe(o, ["station_id", "sensor"], [F.desc("price"), F.col("ok"), F.col("ln")]).select("station_id", "sensor", "ok", "ln", "price")


@query("""SELECT part, q, round(quantile_cont(price, 0.5) OVER (PARTITION BY part ORDER BY price, ok, ln ROWS BETWEEN 199 PRECEDING AND CURRENT ROW), 4) AS med, ok, ln FROM (SELECT *, CAST(ok % 8 AS INT) AS part FROM $obs)""")
def wn2_rolling_median(spark, d):
    """A rolling median of 200 rows in the order of a value, within eight groups (WN-2 over all rows: `wn2_trend`)."""
    o = obs(spark, d).select((F.col("ok") % 8).cast("int").alias("part"), "q", "price", "ok", "ln")
    return stats.rolling_median_within(o, "part", ["price", "ok", "ln"], "price", 200).select("part", "q", F.round("median", 4).alias("med"), "ok", "ln")
