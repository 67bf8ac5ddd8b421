"""Queries of class strata, rank tests, interval scores, nearest lines and pixels, ordering and report assembly."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import water
from ..operators import spatial, stats
from .q_summary import _PRED, predictions
from .tables import obs, query, read, samples, stations


def _r(c, n=4):
    return F.round(c, n)


@query("""WITH m AS (SELECT cls, tp, secchi FROM $samples s JOIN (VALUES ('shallow', -1e300, 3.0), ('middle', 3.0, 10.0), ('deep', 10.0, 1e300), ('all', -1e300, 1e300)) c(cls, a, b) ON CASE cls WHEN 'shallow' THEN chla < 3 WHEN 'middle' THEN chla BETWEEN 3 AND 10 WHEN 'deep' THEN chla > 10 ELSE true END)
SELECT cls, count(tp + secchi) AS n, round(pow(corr(tp, secchi), 2), 6) AS r2, round(sqrt(avg((secchi - tp) * (secchi - tp))), 4) AS rmse, round(avg(secchi - tp), 4) AS bias FROM m GROUP BY cls""")
def st6_depth_strata(spark, d):
    """ST-6, FN-W25: a row belongs to its class and to "all"; one grouped pass. Depth is chla here."""
    z = F.col("chla")
    cls = F.filter(F.array(F.when(z < 3, "shallow").when(z <= 10, "middle").when(z > 10, "deep"), F.lit("all")), lambda c: c.isNotNull())
    m = samples(spark, d).select(F.explode(cls).alias("cls"), "tp", "secchi")
    n, r2, rmse, bias = stats.paired("tp", "secchi", 0)
    return m.groupBy("cls").agg(n, r2, rmse, bias).select("cls", "n", _r(F.col("r2"), 6).alias("r2"), _r(F.col("rmse")).alias("rmse"), _r(F.col("bias")).alias("bias"))


@query("""SELECT CASE WHEN tp <= 30 THEN 'clear' WHEN tp <= 60 THEN 'coloured' ELSE 'humic' END AS cls, count(*) AS n, round(avg((60 - 14.41 * ln(greatest(secchi, 0.01))) - (9.81 * ln(greatest(chla, 0.01)) + 30.6)), 4) AS offset_mean FROM $samples WHERE secchi IS NOT NULL GROUP BY 1""")
def st7_class_offset(spark, d):
    """ST-7, FN-W24: mean difference of two indices by colour class."""
    s = samples(spark, d).where("secchi IS NOT NULL")
    cls = water.right_closed(F.col("tp"), [30, 60], ["clear", "coloured", "humic"])
    return s.groupBy(cls.alias("cls")).agg(F.count("*").alias("n"), _r(F.avg(water.tsi_secchi(F.col("secchi")) - water.tsi_chla(F.col("chla")))).alias("offset_mean"))


@query("""WITH r AS (SELECT year(date) <= 1997 AS pre, rank() OVER (ORDER BY tp) + (count(*) OVER (PARTITION BY tp) - 1) / CAST(2 AS DOUBLE) AS mid, count(*) OVER (PARTITION BY tp) AS t FROM $samples),
a AS (SELECT CAST(count(*) FILTER (pre) AS DOUBLE) AS x, CAST(count(*) FILTER (NOT pre) AS DOUBLE) AS y, sum(mid) FILTER (pre) AS r1, sum(CAST(t AS DOUBLE) * t - 1) AS ties FROM r),
b AS (SELECT *, r1 - x * (x + 1) / 2 AS u, sqrt(x * y / 12 * (x + y + 1 - ties / ((x + y) * (x + y - 1)))) AS sd FROM a)
SELECT CAST(x AS BIGINT) AS n1, CAST(y AS BIGINT) AS n2, u, round((greatest(u, x * y - u) - x * y / 2 - 0.5) / sd, 6) AS z, (greatest(u, x * y - u) - x * y / 2 - 0.5) / sd > 1.959963984540054 AS significant FROM b""")
def st8_mann_whitney(spark, d):
    """ST-8: rank test from counts of distinct values and their running sums."""
    return stats.mann_whitney(samples(spark, d), "tp", F.year("date") <= 1997).withColumn("z", _r(F.col("z"), 6))


@query("""SELECT sensor, count(*) AS n, round(quantile_cont(log10(price / q / 1000), 0.05), 6) AS p5, round(quantile_cont(log10(price / q / 1000), 0.25), 6) AS p25, round(quantile_cont(log10(price / q / 1000), 0.5), 6) AS p50, round(quantile_cont(log10(price / q / 1000), 0.75), 6) AS p75, round(quantile_cont(log10(price / q / 1000), 0.95), 6) AS p95 FROM $obs WHERE q > 0 AND price > 0 GROUP BY 1""")
def st11_log_ratio(spark, d):
    """ST-11: box statistics of a log ratio by class."""
    o = obs(spark, d).where("q > 0 AND price > 0").withColumn("r", F.log10(F.col("price") / F.col("q") / 1000))
    qs = {"p5": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}
    n = o.groupBy("sensor").agg(F.count("*").alias("n"))
    return n.join(F.broadcast(stats.percentiles(o, ["sensor"], "r", qs)), "sensor").select("sensor", "n", *[_r(F.col(k), 6).alias(k) for k in qs])


@query("""SELECT year(date) AS yr, count(*) AS n, round(corr(tp, ln(1 + v)), 6) AS r FROM $samples GROUP BY 1""")
def st14_log_correlation(spark, d):
    """ST-14."""
    return samples(spark, d).groupBy(F.year("date").cast("long").alias("yr")).agg(F.count("*").alias("n"), _r(stats.correlation(F.col("tp"), F.log1p("v")), 6).alias("r"))


@query("""SELECT 'measured' AS origin, 'tp' AS param, round(avg(tp), 4) AS mean FROM $samples UNION ALL SELECT 'measured', 'chla', round(avg(chla), 4) FROM $samples UNION ALL SELECT * FROM (VALUES ('published', 'tp', CAST(14.4 AS DOUBLE)), ('published', 'chla', CAST(7.3 AS DOUBLE)))""")
def st15_with_literature(spark, d):
    """ST-15: measured means beside a constant table."""
    m = samples(spark, d).agg(_r(F.avg("tp")).alias("tp"), _r(F.avg("chla")).alias("chla"))
    long = m.select(F.lit("measured").alias("origin"), F.explode(F.create_map(F.lit("tp"), "tp", F.lit("chla"), "chla")).alias("param", "mean"))
    return long.unionByName(spark.createDataFrame([("published", "tp", 14.4), ("published", "chla", 7.3)], "origin string, param string, mean double"))


@query("""WITH a AS (SELECT year(date) AS yr, CASE WHEN year(date) <= 1997 THEN 'early' ELSE 'late' END AS era, avg(chla - tp) AS b, stddev_samp(chla - tp) AS s FROM $samples GROUP BY 1, 2)
SELECT yr, era, round(b, 4) AS bias, round(s, 4) AS sd, round(avg(b) OVER (PARTITION BY era), 4) AS era_bias FROM a""")
def ag26_era_bias(spark, d):
    """AG-26: annual bias with its deviation, and the mean of annual means by era."""
    e = F.col("chla") - F.col("tp")
    y = F.year("date").cast("long")
    a = samples(spark, d).groupBy(y.alias("yr")).agg(F.avg(e).alias("b"), F.stddev_samp(e).alias("s")).withColumn("era", F.when(F.col("yr") <= 1997, "early").otherwise("late"))
    return a.select("yr", "era", _r(F.col("b")).alias("bias"), _r(F.col("s")).alias("sd"), _r(F.avg("b").over(Window.partitionBy("era"))).alias("era_bias"))


@query("""WITH c AS (SELECT st.nation, CAST(s.sample_id % 5 AS INT) AS fold, count(*) AS n FROM $samples s JOIN $stations st ON s.station_id = st.station_id GROUP BY 1, 2)
SELECT nation, fold, n FROM c QUALIFY row_number() OVER (PARTITION BY nation ORDER BY n DESC, fold) = 1""")
def ag27_modal_fold(spark, d):
    """AG-27: the commonest fold of each basin, the smaller on ties."""
    s = samples(spark, d).join(stations(spark, d).select("station_id", "nation"), "station_id")
    c = s.groupBy("nation", (F.col("sample_id") % 5).cast("int").alias("fold")).agg(F.count("*").alias("n"))
    best = c.groupBy("nation").agg(F.max(F.struct("n", (-F.col("fold")).alias("f"))).alias("b"))
    return best.select("nation", (-F.col("b.f")).alias("fold"), F.col("b.n").alias("n"))


@query("""WITH c AS (SELECT year(date) // 5 * 5 AS period, CAST(least(floor(least(greatest(v / 1000, 1), 200) / 20), 9) AS INT) AS bin, count(*) AS n FROM $samples GROUP BY 1, 2)
SELECT period, bin, n, round(n / CAST(sum(n) OVER (PARTITION BY period) AS DOUBLE), 6) AS share FROM c""")
def ag34_ratio_density(spark, d):
    """AG-34: shares of ten bins of a ratio clipped to 1..200, by five-year period."""
    r = F.least(F.greatest(F.col("v") / 1000, F.lit(1.0)), F.lit(200.0))
    c = samples(spark, d).groupBy((F.floor(F.year("date") / 5) * 5).alias("period"), F.least(F.floor(r / 20), F.lit(9)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    return c.withColumn("share", _r(F.col("n") / F.sum("n").over(Window.partitionBy("period")), 6))


@query("""SELECT station_id, CAST(date_trunc('month', obs_date) AS DATE) AS month, sensor, count(*) AS n, string_agg(CAST(obs_date AS VARCHAR) || '/' || ok || '/' || ln, ',' ORDER BY obs_date, ok, ln) AS scenes FROM $obs GROUP BY 1, 2, 3""")
def ag36_scene_lists(spark, d):
    """AG-36: ordered scene lists of each station and month, passes kept apart."""
    o = obs(spark, d).groupBy("station_id", F.trunc("obs_date", "month").alias("month"), "sensor").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("obs_date", "ok", "ln"))).alias("a"))
    return o.withColumn("scenes", F.concat_ws(",", F.transform("a", lambda x: F.concat_ws("/", x["obs_date"], x["ok"], x["ln"])))).drop("a")


@query(_PRED + """, g AS (SELECT 'n=' || (CAST(sample_id % 2 = 0 AS INT) + CAST(sample_id % 3 = 0 AS INT) + CAST(sample_id % 5 = 0 AS INT)) AS grouping, y, yhat FROM p UNION ALL
SELECT name || '=' || CASE WHEN sample_id % k = 0 THEN 'yes' ELSE 'no' END, y, yhat FROM p, (VALUES ('a', 2), ('b', 3), ('c', 5)) v(name, k))
SELECT grouping, count(*) AS n, round(sqrt(avg((y - yhat) * (y - yhat))), 6) AS rmse, round(avg(abs(y - yhat)), 6) AS mae FROM g GROUP BY 1""")
def ev4_sensor_coverage(spark, d):
    """EV-4: scores by number of sensors and by presence of each; a row belongs to four groups."""
    k = F.col("sample_id")
    has = {"a": k % 2 == 0, "b": k % 3 == 0, "c": k % 5 == 0}
    n = water.sensor_count(*has.values())
    groups = F.array(F.concat(F.lit("n="), n.cast("string")), *[F.concat(F.lit(f"{s}="), F.when(c, "yes").otherwise("no")) for s, c in has.items()])
    rmse, _, mae, cnt = stats.metrics("y", "yhat", 0)
    return predictions(spark, d).withColumn("grouping", F.explode(groups)).groupBy("grouping").agg(cnt, rmse, mae).select("grouping", "n", _r(F.col("rmse"), 6).alias("rmse"), _r(F.col("mae"), 6).alias("mae"))


def _spread(c):
    """What widths are divided by: 1 where all values are equal."""
    return F.coalesce(F.nullif(F.col(c), F.lit(0.0)), F.lit(1.0))


_NOMINAL = {0.5: (0.25, 0.75), 0.8: (0.1, 0.9), 0.9: (0.05, 0.95), 0.95: (0.025, 0.975)}
_ALPHAS = [0.025, 0.05, 0.1, 0.25, 0.75, 0.9, 0.95, 0.975]


@query("""WITH c AS (SELECT *, CAST(floor(tp / 40) AS INT) AS cls FROM $samples), t AS (SELECT cls, unnest([CAST(0.025 AS DOUBLE), 0.05, 0.1, 0.25, 0.75, 0.9, 0.95, 0.975]) AS a, unnest(quantile_cont(v, [0.025, 0.05, 0.1, 0.25, 0.75, 0.9, 0.95, 0.975])) AS q FROM c WHERE station_id % 2 = 0 GROUP BY cls),
w AS (SELECT cls, quantile_cont(v, 0.975) - quantile_cont(v, 0.025) AS rng, count(*) AS n FROM c WHERE station_id % 2 = 1 GROUP BY 1),
k AS (SELECT c.cls, avg((2 * a - 1) * (v - q) + 2 * CASE WHEN v < q THEN (1 - a) * (q - v) ELSE a * (v - q) END) AS crps FROM c JOIN t ON c.cls = t.cls WHERE station_id % 2 = 1 GROUP BY 1),
i AS (SELECT c.cls, b.nominal, avg(CASE WHEN v >= lo.q AND v <= hi.q THEN 1.0 ELSE 0 END) AS picp, avg(hi.q - lo.q) AS sharp, avg(hi.q - lo.q + 2 / (1 - b.nominal) * (greatest(lo.q - v, 0) + greatest(v - hi.q, 0))) AS wink FROM c, (VALUES (CAST(0.5 AS DOUBLE), CAST(0.25 AS DOUBLE), CAST(0.75 AS DOUBLE)), (0.8, 0.1, 0.9), (0.9, 0.05, 0.95), (0.95, 0.025, 0.975)) b(nominal, la, ha), t lo, t hi WHERE lo.cls = c.cls AND hi.cls = c.cls AND lo.a = la AND hi.a = ha AND station_id % 2 = 1 GROUP BY 1, 2)
SELECT i.cls, nominal, n, round(picp, 4) AS picp, round(sharp, 2) AS sharpness, round(sharp / coalesce(nullif(rng, 0), 1), 5) AS pinaw, round(wink, 1) AS winkler, round(crps, 2) AS crps, round(avg(abs(picp - nominal)) OVER (PARTITION BY i.cls), 4) AS ece FROM i JOIN w ON i.cls = w.cls JOIN k ON i.cls = k.cls""")
def ev7_interval_scores(spark, d):
    """EV-7, EV-9: coverage, width, interval score, ranked probability score and calibration error of quantile forecasts (class quantiles of the other stations)."""
    s = samples(spark, d).select("station_id", F.floor(F.col("tp") / 40).cast("int").alias("cls"), "v")
    t = stats.percentiles(s.where("station_id % 2 = 0"), ["cls"], "v", {f"q{i}": a for i, a in enumerate(_ALPHAS)})
    own = s.where("station_id % 2 = 1")
    span = stats.percentiles(own, ["cls"], "v", {"r0": 0.025, "r1": 0.975})
    p = own.join(F.broadcast(t), "cls").join(F.broadcast(span), "cls")  # a row for each class
    v, q = F.col("v"), {a: F.col(f"q{i}") for i, a in enumerate(_ALPHAS)}
    crps = sum((stats.crps_term(v, q[a], a) for a in _ALPHAS[1:]), stats.crps_term(v, q[_ALPHAS[0]], _ALPHAS[0])) / len(_ALPHAS)
    each = []
    for i, (nom, (a, b)) in enumerate(_NOMINAL.items()):
        lo, hi = q[a], q[b]
        each += [F.avg(F.when(v.between(lo, hi), 1.0).otherwise(0.0)).alias(f"p{i}"), F.max(hi - lo).alias(f"s{i}"), F.avg(stats.winkler(v, lo, hi, F.lit(1 - nom))).alias(f"w{i}")]
    g = p.groupBy("cls").agg(F.count("*").alias("n"), F.avg(crps).alias("crps"), F.max(F.col("r1") - F.col("r0")).alias("rng"), *each)
    rows = F.array(*[F.struct(F.lit(nom).alias("nominal"), F.col(f"p{i}").alias("picp"), F.col(f"s{i}").alias("sharp"), F.col(f"w{i}").alias("wink")) for i, nom in enumerate(_NOMINAL)])
    ece = sum((F.abs(F.col(f"p{i}") - nom) for i, nom in enumerate(_NOMINAL)), F.lit(0.0)) / len(_NOMINAL)
    o = g.select("cls", "n", "crps", "rng", ece.alias("ece"), F.inline(rows))
    return o.select("cls", "nominal", "n", _r(F.col("picp")).alias("picp"), _r(F.col("sharp"), 2).alias("sharpness"), _r(F.col("sharp") / _spread("rng"), 5).alias("pinaw"), _r(F.col("wink"), 1).alias("winkler"), _r(F.col("crps"), 2).alias("crps"), _r(F.col("ece")).alias("ece"))


@query(_PRED + """, c AS (SELECT abs(y - yhat) AS s, row_number() OVER (ORDER BY abs(y - yhat)) AS r, count(*) OVER () AS n FROM p WHERE station_id % 2 = 0),
q AS (SELECT CAST(level AS DOUBLE) AS level, s AS q FROM c, (VALUES (0.8), (0.9), (0.95)) v(level) WHERE r = ceil(least(1.0, ceil((n + 1) * CAST(level AS DOUBLE)) / CAST(n AS DOUBLE)) * (n - 1)) + 1)
SELECT level, round(min(q), 6) AS q, round(avg(CASE WHEN abs(y - yhat) <= q THEN 1.0 ELSE 0 END), 6) AS picp FROM p, q WHERE station_id % 2 = 1 GROUP BY 1""")
def ev10_pooled_conformal(spark, d):
    """EV-10: one calibration for all folds."""
    p = predictions(spark, d).withColumn("s", F.abs(F.col("y") - F.col("yhat")))
    w = stats.pooled_widths(p.where("station_id % 2 = 0"), "s", [0.8, 0.9, 0.95]).agg(F.collect_list(F.struct("level", "q")).alias("w"))  # three entries
    t = p.where("station_id % 2 = 1").join(F.broadcast(w), F.lit(True)).select("s", F.inline("w"))
    return t.groupBy("level").agg(_r(F.min("q"), 6).alias("q"), _r(F.avg(F.when(F.col("s") <= F.col("q"), 1.0).otherwise(0.0)), 6).alias("picp"))


@query("""SELECT s.station_id, s.x, s.y, line_id, round(dist, 3) AS dist FROM (SELECT p.station_id, p.x, p.y, l.station_id AS line_id, sqrt(pow(p.x - l.x - t * 30000, 2) + pow(p.y - l.y - t * 40000, 2)) AS dist FROM (SELECT a.station_id AS ps, b.station_id AS ls, greatest(0, least(1, ((a.x - b.x) * 30000 + (a.y - b.y) * 40000) / CAST(2500000000 AS DOUBLE))) AS t FROM $stations a, stations b WHERE a.station_id % 10 <> 0 AND b.station_id % 10 = 0) m JOIN stations p ON p.station_id = ps JOIN stations l ON l.station_id = ls) s WHERE dist <= 5000 QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY dist, line_id) = 1""")
def jn14_nearest_line(spark, d):
    """JN-14: the nearest line at most 5 km away. Every tenth station starts a line of 50 km."""
    s = stations(spark, d)
    seg = s.where("station_id % 10 = 0").select(F.col("station_id").alias("line_id"), F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + 30000).alias("x2"), (F.col("y") + 40000).alias("y2"))
    pts = s.where("station_id % 10 <> 0").select("station_id", "x", "y")
    got = spatial.nearest_line(pts, seg, "station_id", "line_id", 5000.0, 10000.0)
    return pts.join(got, "station_id").withColumn("dist", _r(F.col("dist"), 3))


@query("""WITH pt AS (SELECT station_id, x, y FROM $stations WHERE station_id % 10 <> 0), pol AS (SELECT station_id AS poly_id, x, y FROM stations WHERE station_id % 10 = 0),
a AS (SELECT pt.station_id, min(poly_id) AS poly_id FROM pt JOIN pol ON pt.x >= pol.x AND pt.x < pol.x + 60000 AND pt.y >= pol.y AND pt.y < pol.y + 60000 GROUP BY 1),
b AS (SELECT station_id, line_id FROM (SELECT pt.station_id, l.poly_id AS line_id, abs(pt.y - l.y - 70000) AS dy, greatest(l.x - pt.x, pt.x - l.x - 60000, 0) AS dx FROM pt, pol l) WHERE sqrt(dx * dx + dy * dy) <= 5000 QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY sqrt(dx * dx + dy * dy), line_id) = 1)
SELECT pt.station_id, a.poly_id, CASE WHEN a.poly_id IS NULL THEN b.line_id END AS line_id, CASE WHEN a.poly_id IS NOT NULL THEN 'lake' WHEN b.line_id IS NOT NULL THEN 'river' ELSE 'none' END AS kind FROM pt LEFT JOIN a ON pt.station_id = a.station_id LEFT JOIN b ON pt.station_id = b.station_id""")
def jn15_polygon_then_line(spark, d):
    """JN-15: polygons first, the nearest line for the rest. Every tenth station has a square of 60 km and a line above it."""
    s = stations(spark, d).select("station_id", "x", "y")
    own = s.where("station_id % 10 = 0")
    x, y, k = F.col("x"), F.col("y"), 60000
    corner = [(x, y), (x + k, y), (x + k, y + k), (x, y + k)]
    ring = F.array(*[F.struct(a[0].alias("x1"), a[1].alias("y1"), b[0].alias("x2"), b[1].alias("y2")) for a, b in zip(corner, corner[1:] + corner[:1])])
    edges = own.select(F.col("station_id").alias("poly_id"), F.inline(ring))
    seg = own.select(F.col("station_id").alias("line_id"), x.alias("x1"), (y + 70000).alias("y1"), (x + k).alias("x2"), (y + 70000).alias("y2"))
    return spatial.polygon_or_line(s.where("station_id % 10 <> 0"), edges, seg, "station_id", "poly_id", "line_id", 5000.0, 60000.0).drop("dist")


@query("""WITH px AS (SELECT sensor, ok % 2000 AS pr, (ok * 13 + ln * 7) % 500 AS pc, max(q) AS value FROM $obs WHERE disc > 0.05 GROUP BY 1, 2, 3), an AS (SELECT station_id, station_id * 17 % 2000 AS r, station_id * 3 % 500 AS c FROM $stations)
SELECT station_id, sensor, pr, pc, value, (pr - r) * (pr - r) + (pc - c) * (pc - c) AS dist2 FROM an JOIN px ON pr BETWEEN r - 18 AND r + 18 AND pc BETWEEN c - 18 AND c + 18 QUALIFY row_number() OVER (PARTITION BY station_id, sensor ORDER BY dist2, pr, pc) = 1""")
def jn20_nearest_pixel(spark, d):
    """JN-20: nearest valid pixel within 18 rows and columns of each station's anchor, by scene."""
    px = obs(spark, d).where("disc > 0.05").groupBy("sensor", (F.col("ok") % 2000).alias("pr"), ((F.col("ok") * 13 + F.col("ln") * 7) % 500).alias("pc")).agg(F.max("q").alias("value"))
    k = F.col("station_id")
    an = stations(spark, d).select("station_id", (k * 17 % 2000).alias("r"), (k * 3 % 500).alias("c"))
    return spatial.nearest_pixel(an, px, "station_id", "sensor")


@query("""SELECT s.station_id, coalesce(n_name, 'unknown') AS name FROM $stations s LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 20) n ON s.nation = n_nationkey""")
def jn23_map_key(spark, d):
    """JN-23: a key looked up in a table of a few rows, with a default."""
    n = read(spark, d, "nation").where("n_nationkey < 20").select(F.col("n_nationkey").alias("nation"), F.col("n_name").alias("name"))
    return stations(spark, d).join(n, "nation", "left").select("station_id", F.coalesce("name", F.lit("unknown")).alias("name"))


@query("""WITH c AS (SELECT obs_date, CAST(floor(lat) AS INT) AS gy, CAST(floor(lon) AS INT) AS gx, avg(q) AS value FROM $obs o JOIN $stations s ON o.station_id = s.station_id GROUP BY 1, 2, 3)
SELECT s.station_id, c.obs_date, round(c.value, 4) AS value FROM stations s JOIN c ON CAST(floor(s.lat) AS INT) = gy AND CAST(floor(s.lon) AS INT) = gx""")
def jn24_grid_to_station(spark, d):
    """JN-24: every day's cell value at every station of the cell."""
    at = stations(spark, d).select("station_id", F.floor("lat").cast("int").alias("gy"), F.floor("lon").cast("int").alias("gx"))
    c = obs(spark, d).join(at, "station_id").groupBy("obs_date", "gy", "gx").agg(_r(F.avg("q")).alias("value"))
    return spatial.cell_series(at, c, ["gy", "gx"], "obs_date", "value").select("station_id", "obs_date", "value")


@query("""SELECT sample_id AS key, station_id, date, row_number() OVER (ORDER BY station_id, date, sample_id) - 1 AS sample_id FROM $samples""")
def so1_dense_ids(spark, d):
    """SO-1: dense numbers in the order of (station, date): a station's first number from running counts, then its own order."""
    s = samples(spark, d).select(F.col("sample_id").alias("key"), "station_id", "date")
    first = stats.running_counts(s, "station_id", {"n": F.count("*")}).select("station_id", (F.col("n_to") - F.col("n")).alias("first"))
    w = Window.partitionBy("station_id").orderBy("date", "key")
    return s.join(first, "station_id").select("key", "station_id", "date", (F.col("first") + F.row_number().over(w) - 1).alias("sample_id"))


@query("""SELECT station_id, n FROM (SELECT station_id, count(*) AS n FROM $samples GROUP BY 1) ORDER BY n DESC, station_id LIMIT 10""")
def so3_head_stations(spark, d):
    """SO-3: the head of an order, as the pilot report asks for."""
    return samples(spark, d).groupBy("station_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "station_id").limit(10)


@query("""SELECT o_orderpriority, year(date) AS yr, sample_id, v, rank FROM (SELECT o_orderpriority, CAST(o_orderdate AS DATE) AS date, o_orderkey AS sample_id, o_totalprice AS v, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 20""")
def wn10_top20(spark, d):
    """WN-10: the twenty largest of each class; Spark keeps twenty a class in each task before the shuffle."""
    o = read(spark, d, "orders").select("o_orderpriority", F.to_date("o_orderdate").alias("date"), F.col("o_orderkey").alias("sample_id"), F.col("o_totalprice").alias("v"))
    w = Window.partitionBy("o_orderpriority").orderBy(F.desc("v"), "sample_id")
    return o.withColumn("rank", F.row_number().over(w)).where("rank <= 20").select("o_orderpriority", F.year("date").cast("long").alias("yr"), "sample_id", "v", "rank")


@query("""WITH g AS (SELECT kind, station_id, CAST((dense_rank() OVER (PARTITION BY kind ORDER BY nation) - 1) % 5 + 1 AS INT) AS fold FROM (SELECT *, CASE WHEN seg < 'C' THEN 'lake' ELSE 'river' END AS kind FROM $stations))
SELECT station_id, kind, fold, CASE WHEN lat IS NULL THEN 60 ELSE CAST(floor(lat) AS INT) END AS band FROM g JOIN stations USING (station_id)""")
def sp6_round_robin(spark, d):
    """SP-6, SP-10: sorted groups dealt round-robin over five folds, lakes and rivers apart; latitude bands as fallback groups (60 where unknown)."""
    s = stations(spark, d).withColumn("kind", F.when(F.col("seg") < "C", "lake").otherwise("river"))
    g = s.select("kind", "nation").distinct().withColumn("fold", ((F.row_number().over(Window.partitionBy("kind").orderBy("nation")) - 1) % 5 + 1).cast("int"))
    return s.join(g, ["kind", "nation"]).select("station_id", "kind", "fold", F.coalesce(F.floor("lat"), F.lit(60)).cast("int").alias("band"))


@query("""WITH p AS (SELECT 'tp' AS param, tp AS x, station_id FROM $samples UNION ALL SELECT 'secchi', secchi, station_id FROM samples UNION ALL SELECT 'chla', chla, station_id FROM samples), r AS (SELECT * FROM (VALUES ('tp', 0, 50, 50), ('secchi', 0, 6, 10), ('chla', 0, 500, 100000000)) v(param, lo, hi, least))
SELECT p.param, count(DISTINCT station_id) AS stations, CASE WHEN count(DISTINCT station_id) >= any_value(least) THEN round(avg(x), 4) END AS mean FROM p JOIN r ON p.param = r.param WHERE x BETWEEN lo AND hi GROUP BY 1""")
def gr3_valid_layers(spark, d):
    """GR-3: values inside each parameter's range, and a layer only with enough stations, null otherwise."""
    rules = spark.createDataFrame([("tp", 0, 50, 50), ("secchi", 0, 6, 10), ("chla", 0, 500, 100000000)], "param string, lo int, hi int, least int")
    long = samples(spark, d).select("station_id", "tp", "secchi", "chla").unpivot("station_id", ["tp", "secchi", "chla"], "param", "x")
    g = long.join(F.broadcast(rules), "param").where("x BETWEEN lo AND hi").groupBy("param", "least").agg(F.countDistinct("station_id").alias("stations"), F.avg("x").alias("m"))  # rules: a row for each parameter
    return g.select("param", "stations", F.when(F.col("stations") >= F.col("least"), _r(F.col("m"))).alias("mean"))


@query("""WITH a AS (SELECT CAST(year(date) AS DOUBLE) AS yr, avg(tp) AS m, quantile_cont(tp, 0.25) AS p25, quantile_cont(tp, 0.75) AS p75 FROM $samples GROUP BY 1)
SELECT round(regr_slope(m, yr), 6) AS mean_slope, round(regr_slope(p25, yr), 6) AS p25_slope, round(regr_slope(p75, yr), 6) AS p75_slope, count(*) AS years FROM a""")
def gr8_trend(spark, d):
    """GR-8: slopes of annual means and quartiles."""
    t = samples(spark, d).withColumn("yr", F.year("date").cast("double"))
    a = t.groupBy("yr").agg(F.avg("tp").alias("m")).join(stats.percentiles(t, ["yr"], "tp", {"p25": 0.25, "p75": 0.75}), "yr", "left")
    s = lambda c: _r(F.regr_slope(F.col(c), F.col("yr")), 6)
    return a.agg(s("m").alias("mean_slope"), s("p25").alias("p25_slope"), s("p75").alias("p75_slope"), F.count("*").alias("years"))


@query("""WITH s AS (SELECT station_id, sensor, count(*) AS n FROM $obs GROUP BY 1, 2), w AS (SELECT station_id, max(n) FILTER (sensor = 'A') AS a, max(n) FILTER (sensor = 'N') AS b FROM s WHERE NOT (sensor = 'A' AND station_id % 5 = 0) GROUP BY 1)
SELECT station_id, coalesce(a, b, 0) AS n, CASE WHEN a IS NOT NULL THEN 'first' WHEN b IS NOT NULL THEN 'second' ELSE 'constant' END AS origin FROM w""")
def ev12_report_lookup(spark, d):
    """EV-12, EV-15: excluded results go (left anti), families are pivoted, the first family with a value wins, a constant last."""
    s = obs(spark, d).groupBy("station_id", "sensor").agg(F.count("*").alias("n"))
    out = s.select("station_id").distinct().where("station_id % 5 = 0").withColumn("sensor", F.lit("A"))
    w = s.join(out, ["station_id", "sensor"], "left_anti").groupBy("station_id").pivot("sensor", ["A", "N"]).agg(F.max("n"))
    return w.select("station_id", F.coalesce("A", "N", F.lit(0)).alias("n"), F.when(F.col("A").isNotNull(), "first").when(F.col("N").isNotNull(), "second").otherwise("constant").alias("origin"))


@query("""WITH c AS (SELECT sensor, obs_date, count(*) AS shape FROM $obs GROUP BY 1, 2), m AS (SELECT sensor, shape FROM (SELECT sensor, shape, count(*) AS k FROM c GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY sensor ORDER BY k DESC, shape) = 1)
SELECT c.sensor, c.obs_date, c.shape FROM c JOIN m ON c.sensor = m.sensor AND c.shape = m.shape""")
def flt16_modal_shape(spark, d):
    """FLT-16: days whose shape is the commonest one, the smaller on ties."""
    c = obs(spark, d).groupBy("sensor", "obs_date").agg(F.count("*").alias("shape"))
    k = c.groupBy("sensor", "shape").agg(F.count("*").alias("k")).groupBy("sensor").agg(F.max_by("shape", F.struct("k", -F.col("shape"))).alias("shape"))
    return c.join(k, ["sensor", "shape"], "left_semi")


@query("""SELECT event_id, event_type AS var, CASE WHEN value = -9 THEN NULL WHEN event_type = 'click' THEN round(value - 273.15, 4) WHEN event_type = 'view' THEN round(value / 100, 4) ELSE round(value * 1000, 4) END AS value, CASE event_type WHEN 'click' THEN 'C' WHEN 'view' THEN 'hPa' ELSE 'mm' END AS unit FROM $readings""")
def prj3_units(spark, d):
    """PRJ-3: units by a dictionary of factors and offsets, the sentinel -9 to null."""
    rule = {"click": (1.0, -273.15, "C"), "view": (0.01, 0.0, "hPa")}
    v, t = F.col("value"), F.col("event_type")
    val, unit = v * 1000, F.lit("mm")
    for k, (f, o, u) in rule.items():
        val, unit = F.when(t == k, v / round(1 / f) + o).otherwise(val), F.when(t == k, u).otherwise(unit)
    return read(spark, d, "events").select("event_id", t.alias("var"), F.when(v != -9, _r(val)).alias("value"), unit.alias("unit"))
