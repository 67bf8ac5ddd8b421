"""Queries of the remaining cases: files in and out, nearest neighbours at any distance, grids by layer, cleansing, aggregates and statistics by stratum."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import arrays, geo
from ..functions import water as wq
from ..operators import models, spatial, stats, temporal
from ..sources import readers, sinks
from .tables import daily, obs, query, read, readings, samples, stations


def _r(c, n=4):
    return F.round(c, n)


# files


@query("SELECT year(date) AS year, count(*) AS n, round(sum(v), 2) AS total FROM $samples WHERE year(date) IN (1996, 1997, 1999) GROUP BY 1")
def src1_file_years(spark, d):
    """SRC-1: yearly files, those of years that have none skipped, the year taken from the file's name."""
    path = sinks.scratch(spark, "years")
    for y in (1996, 1997, 1999):
        samples(spark, d).where(F.year("date") == y).select("sample_id", "v").write.parquet(f"{path}/table_{y}.parquet")
    there = [p for p in (f"{path}/table_{y}.parquet" for y in range(1996, 2001)) if readers.first_existing(spark, [p])]
    t = spark.read.parquet(*there).withColumn("year", F.regexp_extract(F.input_file_name(), r"table_(\d{4})", 1).cast("long"))
    return t.groupBy("year").agg(F.count("*").alias("n"), _r(F.sum("v"), 2).alias("total"))


@query("SELECT CAST(station_id AS VARCHAR) AS station_id, lat, lon FROM $stations WHERE station_id % 10 <> 0 AND station_id % 7 <> 0")
def src4_csv_stations(spark, d):
    """SRC-4: some columns of a CSV by name, ids as text, rows without coordinates dropped."""
    k, path = F.col("station_id"), sinks.scratch(spark, "stations")
    s = stations(spark, d).select("seg", F.when(k % 10 != 0, F.col("lat")).alias("lat"), F.when(k % 7 != 0, F.col("lon").cast("string")).otherwise("unknown").alias("lon"), "station_id")
    s.write.option("header", True).csv(path)
    return sinks.read_csv(spark, path, "station_id string, lat double, lon double", ["lat", "lon"])


@query("""WITH u AS (SELECT CAST(c_custkey AS VARCHAR) AS id, 'a' AS src, 0 AS pr, CAST(c_custkey % 89 AS DOUBLE) AS lat, c_custkey % 9 = 0 AS gap FROM customer UNION ALL SELECT CAST(s_suppkey * 3 AS VARCHAR) || '.0', 'b', 1, 50.0, s_suppkey % 5 = 0 FROM supplier UNION ALL SELECT CAST(p_partkey * 2 AS VARCHAR), 'c', 2, 40.0, p_partkey % 4 = 0 FROM part),
n AS (SELECT regexp_replace(id, '\\.0$', '') AS id, src, pr, lat FROM u WHERE NOT gap) SELECT id, arg_min(src, pr) AS src, arg_min(lat, pr) AS lat FROM n GROUP BY id ORDER BY id LIMIT 500""")
def src5_union_in_order(spark, d):
    """SRC-5: sources united with a tag, rows without a latitude dropped, the first source kept, in the order of ids, a pilot's first 500."""
    parts = [("customer", F.col("c_custkey").cast("string"), F.col("c_custkey") % 89, F.col("c_custkey") % 9), ("supplier", F.concat((F.col("s_suppkey") * 3).cast("string"), F.lit(".0")), F.lit(50), F.col("s_suppkey") % 5), ("part", (F.col("p_partkey") * 2).cast("string"), F.lit(40), F.col("p_partkey") % 4)]
    u = None
    for i, ((table, key, lat, gap), tag) in enumerate(zip(parts, "abc")):
        p = read(spark, d, table).select(F.regexp_replace(key, "\\.0$", "").alias("id"), F.lit(tag).alias("src"), F.lit(i).alias("pr"), F.when(gap != 0, lat.cast("double")).alias("lat"))
        u = p if u is None else u.unionByName(p)
    return temporal.dedupe(u.dropna(subset=["lat"]), ["id"], [F.col("pr")]).drop("pr").orderBy("id").limit(500)


@query("WITH o AS (SELECT station_id, 'tp' AS param, round(avg(tp), 4) AS x FROM $samples WHERE year(date) <= 1996 GROUP BY 1), n AS (SELECT station_id, 'tp' AS param, round(avg(chla), 4) AS x FROM $samples WHERE year(date) > 1996 GROUP BY 1) SELECT coalesce(n.station_id, o.station_id) AS station_id, 'tp' AS param, coalesce(n.x, o.x) AS x FROM o FULL JOIN n ON o.station_id = n.station_id")
def snk2_csv_results(spark, d):
    """SNK-2: a CSV of results, merged with new ones by key, the new kept."""
    y, path = F.year("date"), sinks.scratch(spark, "results")
    part = lambda rows, c: rows.groupBy("station_id").agg(_r(F.avg(c)).alias("x")).select("station_id", F.lit("tp").alias("param"), "x")
    s, schema = samples(spark, d), "station_id long, param string, x double"
    sinks.write_csv(part(s.where(y <= 1996), "tp"), f"{path}-old")
    old = sinks.read_csv(spark, f"{path}-old", schema, ["station_id", "param"])
    sinks.write_csv(sinks.merge_results(old, part(s.where(y > 1996), "chla"), ["station_id", "param"]), f"{path}-new")
    return sinks.read_csv(spark, f"{path}-new", schema, ["station_id", "param"])


# filters, projections, patches


@query("SELECT sample_id, tp FROM $samples s JOIN (SELECT station_id, CASE WHEN station_id % 8 <> 0 THEN lat END AS lat, lon FROM $stations) t ON s.station_id = t.station_id WHERE tp BETWEEN 5 AND 90 AND lat IS NOT NULL AND lon IS NOT NULL")
def flt2_valid_rows(spark, d):
    """FLT-2: rows within limits, both included, that have coordinates."""
    t = stations(spark, d).select("station_id", F.when(F.col("station_id") % 8 != 0, F.col("lat")).alias("lat"), "lon")
    return samples(spark, d).join(t, "station_id").where(F.col("tp").between(5, 90) & F.col("lat").isNotNull() & F.col("lon").isNotNull()).select("sample_id", "tp")


@query("WITH c AS (SELECT station_id, lat, lon, round_even(lat + 0.001, 1) AS la, round_even(lon + 0.001, 1) AS lo FROM $stations) SELECT station_id, lat, lon FROM (SELECT *, row_number() OVER (PARTITION BY la, lo ORDER BY station_id) AS r FROM c) WHERE r = 1")
def flt9_one_per_cell(spark, d):
    """FLT-9: one record for each cell of 0.1 degrees, the first by id."""
    s = stations(spark, d).withColumns({"la": F.bround(F.col("lat") + 0.001, 1), "lo": F.bround(F.col("lon") + 0.001, 1)})
    return temporal.dedupe(s, ["la", "lo"], [F.col("station_id")]).select("station_id", "lat", "lon")


@query("SELECT ok, ln FROM $obs o JOIN (SELECT nation AS cell, count(*) AS water FROM $stations GROUP BY 1) m ON o.ok % 25 = m.cell WHERE water > 3 AND (disc > 0.04) = (tax > 0.03)")
def flt14_agreement(spark, d):
    """FLT-14: pixels in cells that the mask table counts as water, on which two classifiers agree."""
    mask = stations(spark, d).groupBy(F.col("nation").alias("cell")).agg(F.count("*").alias("water")).where("water > 3")
    o = obs(spark, d).withColumn("cell", F.col("ok") % 25)
    return o.join(mask, "cell", "left_semi").where((F.col("disc") > 0.04) == (F.col("tax") > 0.03)).select("ok", "ln")


@query("WITH e AS (SELECT vec_id, unnest(embedding) AS v FROM embeddings), g AS (SELECT vec_id, bool_and(v BETWEEN -2.5 AND 2.5) AS ok, sum(CAST(v AS DOUBLE)) AS s FROM e GROUP BY 1) SELECT vec_id, CAST(ok AS INT) AS mask, CASE WHEN ok THEN round(s, 4) END AS total FROM g")
def flt15_valid_patch(spark, d):
    """FLT-15: a patch with an entry outside the sensor's range is null and its mask 0."""
    p, mask = arrays.valid_patch(F.transform("embedding", lambda v: v.cast("double")), -2.5, 2.5)
    e = read(spark, d, "embeddings").select("vec_id", p.alias("p"), mask.alias("mask"))
    return e.select("vec_id", "mask", _r(F.aggregate("p", F.lit(0.0), lambda s, x: s + x)).alias("total"))


@query("SELECT ok, ln, round(ok * 1e-4, 6) AS modis, round(ok * 2.75e-5 - 0.2, 8) AS landsat, round(ok / 10000.0, 6) AS s2 FROM $obs")
def prj4_counts(spark, d):
    """PRJ-4: raw counts to reflectance by scale and offset."""
    k = F.col("ok")
    return obs(spark, d).select("ok", "ln", _r(k * 1e-4, 6).alias("modis"), _r(k * 2.75e-5 - 0.2, 8).alias("landsat"), _r(k / 10000.0, 6).alias("s2"))


@query("""WITH e AS (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings), g AS (SELECT vec_id, sum(CASE WHEN i % 8 BETWEEN 2 AND 4 AND i // 8 BETWEEN 2 AND 4 THEN CAST(v AS DOUBLE) * (((i // 8 - 2) * 3 + i % 8 - 2) + 1) END) AS crop, sum(CAST(v AS DOUBLE) * ((i // 8 + 1) * 10 + i % 8 + 1 + 1)) AS padded FROM e GROUP BY 1)
SELECT vec_id, round(crop, 4) AS crop, round(padded - (SELECT sum(k + 1) FROM (SELECT unnest(range(100)) AS k) WHERE k // 10 IN (0, 9) OR k % 10 IN (0, 9)), 3) AS padded FROM g""")
def fna1_crop_and_pad(spark, d):
    """FN-A1: an 8 x 8 patch cropped to 3 x 3 and padded to 10 x 10 with -1; checked by sums weighted by place."""
    p = F.transform("embedding", lambda v: v.cast("double"))
    weighted = lambda a: F.aggregate(F.transform(a, lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return read(spark, d, "embeddings").select("vec_id", _r(weighted(arrays.crop_pad(p, 8, 8, 3))).alias("crop"), _r(weighted(arrays.crop_pad(p, 8, 8, 10, -1.0)), 3).alias("padded"))


@query("WITH e AS (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) SELECT vec_id, round(sum(CASE WHEN i % 4 <> 2 THEN (CAST(v AS DOUBLE) - (i % 4) * 0.5) / (1 + i % 4) ELSE 0 END), 4) AS total FROM e GROUP BY vec_id")
def fnw30_channels(spark, d):
    """FN-W30: four channels, each with its offset and scale, one corrupted."""
    p = F.transform("embedding", lambda v: v.cast("double"))
    x = arrays.normalise_channels(p, [0.0, 0.5, 1.0, 1.5], [1.0, 2.0, 3.0, 4.0], [2])
    return read(spark, d, "embeddings").select("vec_id", _r(F.aggregate(x, F.lit(0.0), lambda s, v: s + v)).alias("total"))


@query("WITH b AS (SELECT ok, ln, -q AS vv, disc - q AS vh, CASE WHEN ln % 3 = 0 THEN NULL ELSE disc * 40 END AS sd FROM $obs) SELECT ok, ln, round(vv - vh, 6) AS cross_db, vv > -10 AND (sd IS NULL OR sd < 2) AS ice FROM b")
def fnw21_radar(spark, d):
    """FN-W21: cross-ratio and ice flag, where there is one polarisation only by its brightness."""
    b = obs(spark, d).select("ok", "ln", (-F.col("q")).alias("vv"), (F.col("disc") - F.col("q")).alias("vh"), F.when(F.col("ln") % 3 != 0, F.col("disc") * 40).alias("sd"))
    return b.select("ok", "ln", _r(wq.cross_ratio(F.col("vv"), F.col("vh")), 6).alias("cross_db"), wq.ice_flag(F.col("vv"), F.col("sd")).alias("ice"))


@query("SELECT sample_id, CASE WHEN c > 0 AND c <= 30 THEN 'clear' WHEN c > 30 AND c <= 100 THEN 'coloured' WHEN c > 100 THEN 'humic' END AS right_closed, CASE WHEN c < 30 THEN 'clear' WHEN c < 100 THEN 'coloured' ELSE 'humic' END AS left_closed FROM (SELECT sample_id, sample_id % 141 AS c FROM $samples)")
def fnw24_colour_classes(spark, d):
    """FN-W24: colour classes in both conventions."""
    c = F.col("sample_id") % 141
    return samples(spark, d).select("sample_id", wq.colour_class(c).alias("right_closed"), wq.colour_class(c, True).alias("left_closed"))


@query("WITH p AS (SELECT station_id, count(tp) FILTER (sample_id % 3 = 0) AS w, count(secchi) FILTER (sample_id % 3 = 1) AS s FROM $samples GROUP BY 1) SELECT station_id, CASE WHEN w > 0 AND s > 0 THEN 0 WHEN w > 0 THEN 1 WHEN s > 0 THEN 2 ELSE 3 END AS score FROM p")
def fnw26_row_score(spark, d):
    """FN-W26: completeness of a row: 0 with both, 1 weather only, 2 satellite only, 3 neither."""
    k = F.col("sample_id") % 3
    p = samples(spark, d).groupBy("station_id").agg(F.count(F.when(k == 0, F.col("tp"))).alias("w"), F.count(F.when(k == 1, F.col("secchi"))).alias("s"))
    return p.select("station_id", wq.row_score(F.col("w") > 0, F.col("s") > 0).alias("score"))


@query("SELECT sample_id, CAST(year(date) // 5 * 5 AS VARCHAR) || '-' || CAST(year(date) // 5 * 5 + 4 AS VARCHAR) AS five, CAST(year(date) // 10 * 10 AS VARCHAR) || '-' || CAST(year(date) // 10 * 10 + 9 AS VARCHAR) AS ten FROM $samples")
def fnd3_periods(spark, d):
    """FN-D3: labels of five and of ten years."""
    y = F.year("date")
    return samples(spark, d).select("sample_id", geo.year_span(y, 5).alias("five"), geo.year_span(y, 10).alias("ten"))


@query("WITH k AS (SELECT station_id, CASE WHEN station_id % 11 <> 0 THEN lat END AS lat FROM $stations) SELECT CAST(trunc(lat) AS INT) AS lat_bin, CASE WHEN lat < 61 THEN 'south' ELSE 'north' END AS lat_split, count(*) AS n FROM k GROUP BY 1, 2")
def sp9_latitude_bins(spark, d):
    """SP-9, SP-4: groups by whole degrees of latitude; the split at 61 degrees, north for null."""
    lat = F.when(F.col("station_id") % 11 != 0, F.col("lat"))
    return stations(spark, d).groupBy(lat.cast("int").alias("lat_bin"), F.when(lat < 61, "south").otherwise("north").alias("lat_split")).agg(F.count("*").alias("n"))


# space

_SUP = "u AS (SELECT s_suppkey AS sup, 50 + (s_suppkey * 61 % 1500) / CAST(100 AS DOUBLE) AS rlat, 5 + (s_suppkey * 35 % 1300) / CAST(100 AS DOUBLE) AS rlon, s_acctbal AS bal2 FROM supplier WHERE s_suppkey % 5 = 0)"
_DIST = "2 * 6371000 * asin(sqrt(least(1, greatest(0, pow(sin(radians({1} - {0}) / 2), 2) + cos(radians({0})) * cos(radians({1})) * pow(sin(radians({3} - {2}) / 2), 2)))))"


def _suppliers(spark, d):
    k = F.col("s_suppkey")
    return read(spark, d, "supplier").where(k % 5 == 0).select(k.alias("sup"), (50 + k * 61 % 1500 / 100.0).alias("rlat"), (5 + k * 35 % 1300 / 100.0).alias("rlon"), F.col("s_acctbal").alias("bal2"))


@query(f"WITH {_SUP}, r AS (SELECT station_id, sup, {_DIST.format('lat', 'rlat', 'lon', 'rlon')} AS dist FROM $stations, u) SELECT station_id, sup, round(dist, 1) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY round(dist, 3), sup) AS k FROM r) WHERE k = 1")
def jn18_nearest_any(spark, d):
    """JN-18: the nearest point on the sphere, however far."""
    return spatial.nearest_on_sphere(stations(spark, d).select("station_id", "lat", "lon"), _suppliers(spark, d), "station_id", "sup").select("station_id", "sup", _r(F.col("dist"), 1).alias("dist"))


@query(f"WITH {_SUP}, r AS (SELECT station_id, sup, sqrt(pow(lat - rlat, 2) + pow(lon - rlon, 2)) AS deg FROM $stations, u) SELECT station_id, sup, round(deg, 6) AS deg FROM (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY round(deg, 9), sup) AS k FROM r WHERE deg < 0.25) WHERE k = 1")
def jn19_within_a_quarter_degree(spark, d):
    """JN-19: the nearest station by degrees, if it is less than a quarter of one away."""
    s = stations(spark, d).select("station_id", F.col("lon").alias("x"), F.col("lat").alias("y"))
    met = spatial.pairs_within(s, _suppliers(spark, d), 0.25, "x", "y", "rlon", "rlat").where("dist < 0.25")
    best = F.min_by(F.struct("sup", "dist"), F.struct(F.round("dist", 9), "sup")).alias("b")
    return met.groupBy("station_id").agg(best).select("station_id", "b.sup", _r(F.col("b.dist"), 6).alias("deg"))


@query(f"""WITH c AS (SELECT gy * 50 + gx AS cell, 50 + gy * 0.4 + 0.013 AS lat, 4 + gx * 0.4 + 0.017 AS lon FROM (SELECT unnest(range(50)) AS gy) a, (SELECT unnest(range(50)) AS gx) b), s AS (SELECT station_id, lat AS rlat, lon AS rlon, bal FROM $stations),
r AS (SELECT cell, station_id, bal, {_DIST.format('lat', 'rlat', 'lon', 'rlon')} AS dist FROM c, s) SELECT CAST(cell AS BIGINT) AS cell, station_id, bal FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY round(dist, 3), station_id) AS k FROM r) WHERE k = 1""")
def gr6_cell_covariates(spark, d):
    """GR-6: every grid cell takes the covariates of its nearest station."""
    c = spark.range(50).select(F.col("id").alias("gy")).withColumn("gx", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(49).cast("long"))))
    c = c.select((F.col("gy") * 50 + F.col("gx")).alias("cell"), (50 + F.col("gy") * 0.4 + 0.013).alias("lat"), (4 + F.col("gx") * 0.4 + 0.017).alias("lon"))
    s = stations(spark, d)
    near = spatial.nearest_on_sphere(c, s.select("station_id", F.col("lat").alias("rlat"), F.col("lon").alias("rlon")), "cell", "station_id")
    return near.join(s.select("station_id", "bal"), "station_id").select("cell", "station_id", "bal")


@query(f"""WITH m AS (SELECT a.station_id AS src, b.station_id AS dst, row_number() OVER (PARTITION BY a.station_id ORDER BY round({_DIST.format('a.lat', 'b.lat', 'a.lon', 'b.lon')}, 3), b.station_id) AS r FROM $stations a, $stations b WHERE a.station_id <> b.station_id),
u AS (SELECT src, dst FROM m WHERE r <= 8 UNION SELECT dst, src FROM m WHERE r <= 8) SELECT src, dst, round(1.0 / count(*) OVER (PARTITION BY src), 6) AS weight FROM u""")
def jn21_sphere_graph(spark, d):
    """JN-21: the symmetric graph of the eight nearest stations on the sphere, row-normalised; no cutoff."""
    return spatial.neighbour_graph(stations(spark, d).select("station_id", "lat", "lon"), "station_id").select("src", "dst", _r(F.col("weight"), 6).alias("weight"))


@query("""WITH p AS (SELECT nation AS pid, avg(x) AS cx, avg(y) AS cy FROM $stations GROUP BY nation), e AS (SELECT pid, cx + dx1 AS x1, cy + dy1 AS y1, cx + dx2 AS x2, cy + dy2 AS y2 FROM p,
 (VALUES (-20000.5, -10000.5, 20000.5, -10000.5), (20000.5, -10000.5, 0.5, 25000.5), (0.5, 25000.5, -20000.5, -10000.5)) v(dx1, dy1, dx2, dy2))
SELECT DISTINCT pid FROM (SELECT station_id, pid FROM $stations s, e GROUP BY station_id, pid HAVING sum(CASE WHEN (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / nullif(y2 - y1, 0) + x1 THEN 1 ELSE 0 END) % 2 = 1)""")
def jn13_polygons_with_points(spark, d):
    """JN-13: the polygons that hold a station at least."""
    s = stations(spark, d)
    tri = [(-20000.5, -10000.5, 20000.5, -10000.5), (20000.5, -10000.5, 0.5, 25000.5), (0.5, 25000.5, -20000.5, -10000.5)]
    p = s.groupBy(F.col("nation").alias("pid")).agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    e = p.withColumn("e", F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip("abcd", t)]) for t in tri])))
    e = e.select("pid", (F.col("cx") + F.col("e.a")).alias("x1"), (F.col("cy") + F.col("e.b")).alias("y1"), (F.col("cx") + F.col("e.c")).alias("x2"), (F.col("cy") + F.col("e.d")).alias("y2"))
    return spatial.polygons_with_points(s.select("station_id", "x", "y"), e, "station_id", "pid", 20_000.0)


_TURN = "degrees(asin(-sin({t}) * cos(radians({lo})) * cos(radians({la})) + cos({t}) * sin(radians({la}))))", "degrees(atan2(sin(radians({lo})) * cos(radians({la})), cos({t}) * cos(radians({lo})) * cos(radians({la})) + sin({t}) * sin(radians({la}))))"
_FORTH = [x.format(t="radians(60)", la="lat", lo="(lon - 15)") for x in _TURN]
_BACK = [x.format(t="radians(-60)", la="(-4 + i * 0.5)", lo="(-3 + j * 0.5)") for x in _TURN]


@query(f"""WITH r AS (SELECT station_id, lat, lon, {_FORTH[0]} AS rlat, {_FORTH[1]} AS rlon FROM $stations), c AS (SELECT *, CAST(least(greatest(round((rlat + 4) / 0.5), 0), 19) AS INT) AS i, CAST(least(greatest(round((rlon + 3) / 0.5), 0), 11) AS INT) AS j FROM r),
b AS (SELECT *, {_BACK[0]} AS cell_lat, {_BACK[1]} + 15 AS cell_lon FROM c) SELECT station_id, i AS row, j AS col, round(cell_lat, 6) AS cell_lat, round(cell_lon, 6) AS cell_lon, round({_DIST.format('lat', 'cell_lat', 'lon', 'cell_lon')}, 1) AS dist FROM b""")
def jn17_rotated_cells(spark, d):
    """JN-17, FN-G3: the nearest cell of a rotated-pole grid: index, clipped, its place back in degrees, the distance to it."""
    c = geo.rotated_cell(F.col("lat"), F.col("lon"), -30.0, 15.0, (-4.0, -3.0), 0.5, (20, 12))
    s = stations(spark, d).select("station_id", *[v.alias(k) for k, v in c.items()])
    return s.select("station_id", "row", "col", _r(F.col("cell_lat"), 6).alias("cell_lat"), _r(F.col("cell_lon"), 6).alias("cell_lon"), _r(F.col("dist"), 1).alias("dist"))


@query("SELECT station_id, round(lat, 7) AS lat, round(lon, 7) AS lon FROM $stations")
def fng2_there_and_back(spark, d):
    """FN-G2: to EPSG:3006 and back: coordinates come back."""
    e, n = geo.transverse_mercator(F.col("lat"), F.col("lon"))
    p = stations(spark, d).select("station_id", e.alias("e"), n.alias("n"))
    lat, lon = geo.inverse_transverse_mercator(F.col("e"), F.col("n"))
    return p.select("station_id", _r(lat, 7).alias("lat"), _r(lon, 7).alias("lon"))


_MERC = """WITH k AS (SELECT *, f * (2 - f) AS e2, f / (2 - f) AS n FROM (SELECT station_id, radians(lat) AS phi, radians(lon - 15) AS lam, 1 / 298.257222101 AS f FROM $stations)),
c AS (SELECT *, 6378137.0 / (1 + n) * (1 + n * n / 4 + pow(n, 4) / 64) AS sc, phi - sin(phi) * cos(phi) * (e2 + (5 * pow(e2, 2) - pow(e2, 3)) / 6 * pow(sin(phi), 2) + (104 * pow(e2, 3) - 45 * pow(e2, 4)) / 120 * pow(sin(phi), 4) + 1237 * pow(e2, 4) / 1260 * pow(sin(phi), 6)) AS conf,
 n / 2 - 2 * pow(n, 2) / 3 + 5 * pow(n, 3) / 16 + 41 * pow(n, 4) / 180 AS b1, 13 * pow(n, 2) / 48 - 3 * pow(n, 3) / 5 + 557 * pow(n, 4) / 1440 AS b2, 61 * pow(n, 3) / 240 - 103 * pow(n, 4) / 140 AS b3, 49561 * pow(n, 4) / 161280 AS b4 FROM k),
x AS (SELECT *, atan2(tan(conf), cos(lam)) AS xi, 0.5 * ln((1 + cos(conf) * sin(lam)) / (1 - cos(conf) * sin(lam))) AS et FROM c),
h AS (SELECT *, (exp(2 * et) + exp(-2 * et)) / 2 AS c1, (exp(4 * et) + exp(-4 * et)) / 2 AS c2, (exp(6 * et) + exp(-6 * et)) / 2 AS c3, (exp(8 * et) + exp(-8 * et)) / 2 AS c4, (exp(2 * et) - exp(-2 * et)) / 2 AS s1, (exp(4 * et) - exp(-4 * et)) / 2 AS s2, (exp(6 * et) - exp(-6 * et)) / 2 AS s3, (exp(8 * et) - exp(-8 * et)) / 2 AS s4 FROM x)
SELECT station_id, round(500000 + 0.9996 * sc * (et + b1 * cos(2 * xi) * s1 + b2 * cos(4 * xi) * s2 + b3 * cos(6 * xi) * s3 + b4 * cos(8 * xi) * s4), 2) AS easting, round(0.9996 * sc * (xi + b1 * sin(2 * xi) * c1 + b2 * sin(4 * xi) * c2 + b3 * sin(6 * xi) * c3 + b4 * sin(8 * xi) * c4), 2) AS northing FROM h"""


@query(_MERC)
def fng2_forward(spark, d):
    """FN-G2: easting and northing in EPSG:3006."""
    e, n = geo.transverse_mercator(F.col("lat"), F.col("lon"))
    return stations(spark, d).select("station_id", _r(e, 2).alias("easting"), _r(n, 2).alias("northing"))


# grids


@query("""WITH c AS (SELECT gx * 25 + gy AS cell, CAST(gx * 40000 AS DOUBLE) + 20000 AS x, CAST(gy * 40000 AS DOUBLE) + 20000 AS y FROM (SELECT unnest(range(25)) AS gx) a, (SELECT unnest(range(25)) AS gy) b),
l AS (SELECT station_id, year(date) AS yr, 'tp' AS param, avg(tp) AS v FROM $samples GROUP BY 1, 2 UNION ALL SELECT station_id, year(date), 'secchi', avg(secchi) FROM $samples GROUP BY 1, 2),
p AS (SELECT c.cell, s.station_id, sqrt((c.x - s.x) * (c.x - s.x) + (c.y - s.y) * (c.y - s.y)) AS dist FROM c, $stations s),
r AS (SELECT cell, param, yr, v, dist, row_number() OVER (PARTITION BY cell, param, yr ORDER BY dist, p.station_id) AS k FROM p JOIN l ON p.station_id = l.station_id WHERE dist <= 50000 AND v IS NOT NULL)
SELECT CAST(cell AS BIGINT) AS cell, param, yr, round(coalesce(avg(CASE WHEN dist = 0 THEN v END), sum(CASE WHEN k <= 12 AND dist > 0 THEN v / (dist * dist) END) / sum(CASE WHEN k <= 12 AND dist > 0 THEN 1 / (dist * dist) END)), 4) AS idw, count(*) AS n_stations FROM r WHERE k <= 20 GROUP BY 1, 2, 3""")
def gr4_layers(spark, d):
    """GR-4: a layer of the grid for each parameter and year, in one grouped plan."""
    c = spark.range(25).select(F.col("id").alias("gx")).withColumn("gy", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(24).cast("long"))))
    c = c.select((F.col("gx") * 25 + F.col("gy")).alias("cell"), (F.col("gx") * 40000.0 + 20000).alias("x"), (F.col("gy") * 40000.0 + 20000).alias("y"))
    s = samples(spark, d).select("station_id", F.year("date").cast("long").alias("yr"), "tp", "secchi")
    values = s.unpivot(["station_id", "yr"], ["tp", "secchi"], "param", "v").groupBy("station_id", "yr", "param").agg(F.avg("v").alias("v"))
    places = stations(spark, d).select("station_id", F.col("x").alias("rx"), F.col("y").alias("ry"))
    return spatial.idw_layers(c, places, values, "cell", "station_id", ["param", "yr"], "v").select("cell", "param", "yr", _r(F.col("idw")).alias("idw"), "n_stations")


@query("""WITH c AS (SELECT gx * 25 + gy AS cell, CAST(gx * 40000 AS DOUBLE) + 20000 AS x, CAST(gy * 40000 AS DOUBLE) + 20000 AS y FROM (SELECT unnest(range(25)) AS gx) a, (SELECT unnest(range(25)) AS gy) b),
l AS (SELECT station_id, year(date) AS yr, 'tp' AS param, avg(tp) AS v FROM $samples GROUP BY 1, 2 UNION ALL SELECT station_id, year(date), 'secchi', avg(secchi) FROM samples GROUP BY 1, 2 UNION ALL SELECT station_id, year(date), 'chla', avg(chla) FROM samples GROUP BY 1, 2),
u AS (SELECT * FROM (VALUES ('tp', 10, 70, 50), ('secchi', 0, 6, 10), ('chla', 0, 500, 100000000)) r(param, lo, hi, least)),
i AS (SELECT l.*, least FROM l JOIN u ON l.param = u.param WHERE v BETWEEN lo AND hi), o AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY param, yr) AS m FROM i) WHERE m >= least),
p AS (SELECT c.cell, s.station_id, sqrt((c.x - s.x) * (c.x - s.x) + (c.y - s.y) * (c.y - s.y)) AS dist FROM c, $stations s),
r AS (SELECT cell, param, yr, v, dist, row_number() OVER (PARTITION BY cell, param, yr ORDER BY dist, p.station_id) AS k FROM p JOIN o ON p.station_id = o.station_id WHERE dist <= 50000),
w AS (SELECT cell, param, yr, coalesce(avg(CASE WHEN dist = 0 THEN v END), sum(CASE WHEN k <= 12 AND dist > 0 THEN v / (dist * dist) END) / sum(CASE WHEN k <= 12 AND dist > 0 THEN 1 / (dist * dist) END)) AS idw, count(*) AS n FROM r WHERE k <= 20 GROUP BY 1, 2, 3)
SELECT CAST(c.cell AS BIGINT) AS cell, n.param, n.yr, round(idw, 4) AS idw, coalesce(w.n, 0) AS n_stations FROM c CROSS JOIN (SELECT DISTINCT param, yr FROM l) n LEFT JOIN w ON w.cell = c.cell AND w.param = n.param AND w.yr = n.yr""")
def gr4_product(spark, d):
    """GR-3, GR-4: the whole product in one job: ranges and least numbers of stations by parameter, a layer for each parameter and year, all cells of all layers."""
    c = spark.range(25).select(F.col("id").alias("gx")).withColumn("gy", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(24).cast("long"))))
    c = c.select((F.col("gx") * 25 + F.col("gy")).alias("cell"), (F.col("gx") * 40000.0 + 20000).alias("x"), (F.col("gy") * 40000.0 + 20000).alias("y"))
    s = samples(spark, d).select("station_id", F.year("date").cast("long").alias("yr"), "tp", "secchi", "chla")
    values = s.unpivot(["station_id", "yr"], ["tp", "secchi", "chla"], "param", "v").groupBy("station_id", "yr", "param").agg(F.avg("v").alias("v"))
    places = stations(spark, d).select("station_id", F.col("x").alias("rx"), F.col("y").alias("ry"))
    rules = spark.createDataFrame([("tp", 10.0, 70.0, 50), ("secchi", 0.0, 6.0, 10), ("chla", 0.0, 500.0, 100_000_000)], "param string, low double, high double, least int")
    return spatial.grid_product(c, places, values, rules, "cell", "station_id", "param", ["param", "yr"], "v").select("cell", "param", "yr", _r(F.col("idw")).alias("idw"), "n_stations")


@query(None)
def gr5_grid_forest(spark, d):
    """GR-7: for each parameter and every year of the samples a forest (20 trees) on covariates, easting and northing; its error out of fold by station, and the mean over years."""
    e, n = geo.transverse_mercator(F.col("lat"), F.col("lon"))
    s = stations(spark, d).select("station_id", "bal", e.alias("easting"), n.alias("northing"), F.pmod(F.xxhash64("station_id"), F.lit(3)).cast("int").alias("fold"))
    t = samples(spark, d).select("station_id", F.year("date").alias("yr"), "tp", "chla", "secchi").join(s, "station_id")
    out = models.layer_errors(t, ["bal", "easting", "northing"], ["tp", "chla", "secchi"], "yr", "fold", folds=3, trees=20)
    return out.withColumn("mean_rmse", F.avg("rmse").over(Window.partitionBy("param")))


@query(None)
def gr5_grid_layers(spark, d):
    """GR-5, GR-7: forests (10 trees) of two parameters in two years, and of one with too few stations, scored over a grid whose cells have the covariates of their nearest station; errors by groups of whole degrees of latitude."""
    cells = spark.range(25).select(F.col("id").alias("gx")).withColumn("gy", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(24).cast("long"))))
    cells = cells.select((F.col("gx") * 25 + F.col("gy")).alias("cell"), (F.col("gx") * 40000.0 + 20000).alias("x"), (F.col("gy") * 40000.0 + 20000).alias("y"))
    s = samples(spark, d).select("station_id", F.year("date").cast("long").alias("yr"), "tp", "chla").where("yr IN (1996, 1997)")
    values = s.unpivot(["station_id", "yr"], ["tp", "chla"], "param", "v").groupBy("station_id", "yr", "param").agg(F.avg("v").alias("v"))
    few = values.where("param = 'tp' AND yr = 1996 AND station_id < 5").withColumn("param", F.lit("few"))
    places = stations(spark, d).select("station_id", "lat", "x", "y", F.when(F.col("station_id") % 9 != 0, F.col("bal")).alias("bal"))
    out = models.grid_forests(values.unionByName(few), places, cells, "station_id", "cell", ["param", "yr"], "v", ["bal"], folds=3, trees=10)
    return out.select("cell", "param", "yr", _r(F.col("prediction")).alias("prediction"), "n", _r(F.col("rmse")).alias("rmse"))


# aggregates


@query("SELECT month(obs_date) AS mo, count(*) AS n, round(avg(q), 4) AS mean, round(median(q), 4) AS med FROM $daily GROUP BY 1")
def ag7_climatology(spark, d):
    """AG-7: mean and median by month of all years."""
    m = daily(spark, d).withColumn("mo", F.month("obs_date").cast("long"))
    med = stats.percentiles(m, ["mo"], "q", {"med": 0.5})
    return m.groupBy("mo").agg(F.count("*").alias("n"), _r(F.avg("q")).alias("mean")).join(F.broadcast(med), "mo").select("mo", "n", "mean", _r(F.col("med")).alias("med"))


@query("SELECT user_id, CAST(date AS VARCHAR) AS date, round(avg(value) - 273.15, 4) AS mean, round(min(value) - 273.15, 4) AS lo, round(max(value) - 273.15, 4) AS hi FROM $readings GROUP BY user_id, date")
def ag10_daily_extremes(spark, d):
    """AG-10: hourly values to daily mean, least and largest, from kelvin to degrees Celsius."""
    k = 273.15
    return readings(spark, d).groupBy("user_id", F.col("date").cast("string").alias("date")).agg(_r(F.avg("value") - k).alias("mean"), _r(F.min("value") - k).alias("lo"), _r(F.max("value") - k).alias("hi"))


@query("WITH s AS (SELECT user_id, event_type, count(*) FILTER (hour(ts) = 6) > 0 AS has FROM $readings GROUP BY 1, 2) SELECT r.user_id, r.event_type, CAST(date AS VARCHAR) AS date, round(greatest(0, CASE WHEN has THEN avg(value - 20) FILTER (hour(ts) = 6) ELSE avg(value - 20) END), 4) AS depth FROM readings r JOIN s ON r.user_id = s.user_id AND r.event_type = s.event_type GROUP BY r.user_id, r.event_type, date, has HAVING NOT has OR count(*) FILTER (hour(ts) = 6) > 0")
def ag12_fixed_hour(spark, d):
    """AG-12: the value at six o'clock; for a series that has none at all the daily mean; none below 0."""
    return temporal.at_hour(readings(spark, d).withColumn("x", F.col("value") - 20), ["user_id", "event_type"], "date", "ts", "x", 6).select("user_id", "event_type", F.col("date").cast("string").alias("date"), _r(F.greatest("x", F.lit(0.0))).alias("depth"))


@query("WITH s AS (SELECT user_id, event_type, count(DISTINCT hour(ts)) <= 2 AS is_daily FROM $readings GROUP BY 1, 2), j AS (SELECT r.*, is_daily FROM readings r JOIN s ON r.user_id = s.user_id AND r.event_type = s.event_type) SELECT user_id, event_type, CAST(date AS VARCHAR) AS date, is_daily, round(value, 4) AS x FROM j WHERE is_daily UNION ALL SELECT user_id, event_type, CAST(date AS VARCHAR), is_daily, round(avg(value), 4) FROM j WHERE NOT is_daily GROUP BY user_id, event_type, date, is_daily")
def ag14_daily_series(spark, d):
    """AG-14: a series with two distinct hours at most is daily already and keeps its rows; others become daily means."""
    return temporal.daily_series(readings(spark, d), ["user_id", "event_type"], "date", "ts", "value").select("user_id", "event_type", F.col("date").cast("string").alias("date"), "is_daily", _r(F.col("value")).alias("x"))


@query("WITH a AS (SELECT count(DISTINCT station_id) AS total FROM $samples) SELECT 'tp' AS param, count(DISTINCT CASE WHEN tp > 50 THEN station_id END) AS stations, round(100.0 * count(DISTINCT CASE WHEN tp > 50 THEN station_id END) / max(total), 4) AS share FROM $samples, a UNION ALL SELECT 'secchi', count(DISTINCT CASE WHEN secchi IS NOT NULL THEN station_id END), round(100.0 * count(DISTINCT CASE WHEN secchi IS NOT NULL THEN station_id END) / max(total), 4) FROM $samples, a")
def ag17_station_coverage(spark, d):
    """AG-17: for each parameter the stations that have a value, and their share."""
    s = samples(spark, d).select("station_id", F.when(F.col("tp") > 50, F.col("tp")).alias("tp"), "secchi")
    by = s.groupBy("station_id").agg(F.count("tp").alias("tp"), F.count("secchi").alias("secchi"))
    long = by.unpivot("station_id", ["tp", "secchi"], "param", "n")
    has = F.count(F.when(F.col("n") > 0, 1))
    return long.groupBy("param").agg(has.alias("stations"), _r(100.0 * has / F.count("*")).alias("share"))


@query("WITH s AS (SELECT station_id, count(DISTINCT year(date)) AS y FROM $samples GROUP BY 1) SELECT CAST(y AS BIGINT) AS bin, count(*) AS n, (SELECT median(y) FROM s) AS median FROM s GROUP BY 1")
def ag18_record_median(spark, d):
    """AG-18: histogram of years with a record, and their median."""
    s = samples(spark, d).groupBy("station_id").agg(F.countDistinct(F.year("date")).alias("bin"))
    return s.groupBy("bin").agg(F.count("*").alias("n")).join(F.broadcast(stats.percentiles(s, [], "bin", {"median": 0.5})), F.lit(True))


@query("SELECT ln, count(*) AS n, round(median(price), 4) AS med, round(quantile_cont(price, 0.25), 4) AS p25, round(quantile_cont(price, 0.75), 4) AS p75 FROM $obs GROUP BY ln")
def ag21_ordinal_band(spark, d):
    """AG-21: median and quartiles by an ordinal."""
    o = obs(spark, d)
    p = stats.percentiles(o, ["ln"], "price", {"med": 0.5, "p25": 0.25, "p75": 0.75})
    return o.groupBy("ln").agg(F.count("*").alias("n")).join(F.broadcast(p), "ln").select("ln", "n", *[_r(F.col(c)).alias(c) for c in ("med", "p25", "p75")])


@query("SELECT sensor, CASE WHEN q <= 10 THEN 'low' WHEN q <= 30 THEN 'mid' ELSE 'high' END AS bin, count(*) AS n, round(avg(CASE WHEN disc > 0.07 THEN 1.0 ELSE 0 END), 6) AS rate FROM $obs GROUP BY 1, 2")
def ag23_class_rate(spark, d):
    """AG-23: the rate of a flag by sensor and bin."""
    b = wq.right_closed(F.col("q"), [10, 30], ["low", "mid", "high"])
    return obs(spark, d).groupBy("sensor", b.alias("bin")).agg(F.count("*").alias("n"), _r(F.avg(F.when(F.col("disc") > 0.07, 1.0).otherwise(0.0)), 6).alias("rate"))


@query("SELECT count(*) AS n, round(100.0 * count(*) FILTER (tp <= 10) / count(*), 4) AS n_limited, round(100.0 * count(*) FILTER (tp > 10 AND tp <= 16) / count(*), 4) AS co_limited, round(100.0 * count(*) FILTER (tp > 16) / count(*), 4) AS p_limited FROM $samples")
def ag25_shares_in_a_row(spark, d):
    """AG-25: the shares of three regimes in one row."""
    share = lambda c: _r(100.0 * F.count(F.when(c, 1)) / F.count("*"))
    r = wq.nutrient_regime(F.col("tp"))
    return samples(spark, d).agg(F.count("*").alias("n"), *[share(r == v).alias(v.lower().replace("-", "_")) for v in ("N-limited", "co-limited", "P-limited")])


@query("WITH o AS (SELECT * FROM $obs WHERE disc < 0.08) SELECT station_id, CAST(obs_date AS VARCHAR) AS date, count(*) AS n, arg_max(price, (ok, ln, price)) AS mosaic, round(median(price), 4) AS med FROM o GROUP BY 1, 2")
def ag29_composites(spark, d):
    """AG-29: daily composites of overlapping tiles: the last valid scene on top, and the median, in one grouping: the scenes of a station and day are few."""
    o = obs(spark, d).where("disc < 0.08")
    o = o.withColumn("date", F.col("obs_date").cast("string"))
    return o.groupBy("station_id", "date").agg(F.count("*").alias("n"), F.max_by("price", F.struct("ok", "ln", "price")).alias("mosaic"), _r(F.percentile("price", 0.5)).alias("med"))


@query("WITH g AS (SELECT min(lat) AS a, max(lat) AS b, min(lon) AS c, max(lon) AS e, count(*) AS n FROM $stations GROUP BY floor((lat + 0.003) / 0.15), floor((lon + 0.003) / 0.15)) SELECT 'cluster_' || CAST(trunc((a + b) / 2) AS INT) || '_' || CAST(trunc((c + e) / 2) AS INT) AS id, n, n * 0.5 :: DOUBLE AS area_km2, round(a - 0.05, 6) AS lat0, round(b + 0.05, 6) AS lat9, round(c - 0.05, 6) AS lon0, round(e + 0.05, 6) AS lon9 FROM g")
def ag30_clusters(spark, d):
    """AG-30: stations in boxes of 0.15 degrees: an id by the centre, an area by the count, the box with a margin."""
    g = stations(spark, d).groupBy(F.floor((F.col("lat") + 0.003) / 0.15), F.floor((F.col("lon") + 0.003) / 0.15)).agg(F.count("*").alias("n"), F.min("lat").alias("a"), F.max("lat").alias("b"), F.min("lon").alias("c"), F.max("lon").alias("e"))
    mid = lambda x, y: ((F.col(x) + F.col(y)) / 2).cast("int")
    box = {"lat0": F.col("a") - 0.05, "lat9": F.col("b") + 0.05, "lon0": F.col("c") - 0.05, "lon9": F.col("e") + 0.05}
    return g.select(F.concat_ws("_", F.lit("cluster"), mid("a", "b"), mid("c", "e")).alias("id"), "n", (F.col("n") * 0.5).alias("area_km2"), *[_r(v, 6).alias(k) for k, v in box.items()])


@query("SELECT nation, count(DISTINCT year(date)) AS years, round(avg(tp), 4) AS mean, round(avg(tp) FILTER (year(date) >= 1999) - avg(tp) FILTER (year(date) <= 1996), 4) AS change FROM $samples s JOIN $stations t ON s.station_id = t.station_id GROUP BY nation")
def ag32_mean_map(spark, d):
    """AG-32: the long-period mean of each cell, and its change."""
    y, tp = F.year("date"), F.col("tp")
    s = samples(spark, d).join(stations(spark, d).select("station_id", "nation"), "station_id")
    return s.groupBy("nation").agg(F.countDistinct(y).alias("years"), _r(F.avg(tp)).alias("mean"), _r(F.avg(F.when(y >= 1999, tp)) - F.avg(F.when(y <= 1996, tp))).alias("change"))


@query("WITH e AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings), g AS (SELECT vec_id, (avg(v) FILTER (i % 8 >= 4) - avg(v) FILTER (i % 8 < 4)) AS gx, (avg(v) FILTER (i // 8 >= 4) - avg(v) FILTER (i // 8 < 4)) AS gy FROM e GROUP BY 1) SELECT vec_id, round(sqrt(gx * gx + gy * gy), 5) AS magnitude FROM g")
def ag33_magnitude(spark, d):
    """AG-33: magnitude of a patch's half-difference gradient."""
    e = read(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("p"))
    total = lambda keep: F.aggregate(F.filter("p", lambda v, i: keep(i)), F.lit(0.0), lambda s, x: s + x) / 32
    gx, gy = total(lambda i: i % 8 >= 4) - total(lambda i: i % 8 < 4), total(lambda i: F.floor(i / 8) >= 4) - total(lambda i: F.floor(i / 8) < 4)
    return e.select("vec_id", _r(F.hypot(gx, gy), 5).alias("magnitude"))


# statistics


@query("SELECT sensor, count(*) AS n, round(regr_slope(price, q), 4) AS slope, round(regr_intercept(price, q), 3) AS icept, round(corr(price, q), 6) AS r, round(regr_slope(log10(price), log10(q)), 6) AS log_slope, round(regr_slope(ln(1 + price), ln(1 + q)), 6) AS log1p_slope, round(regr_r2(ln(1 + price), ln(1 + q)), 6) AS log1p_r2 FROM $obs GROUP BY sensor")
def st3_regression(spark, d):
    """ST-3, ST-4: slope, intercept and r; in logarithms and in log1p."""
    p, q = F.col("price"), F.col("q")
    return obs(spark, d).groupBy("sensor").agg(F.count("*").alias("n"), _r(F.regr_slope(p, q)).alias("slope"), _r(F.regr_intercept(p, q), 3).alias("icept"), _r(stats.correlation(p, q), 6).alias("r"), _r(F.regr_slope(F.log10(p), F.log10(q)), 6).alias("log_slope"), _r(F.regr_slope(F.log1p(p), F.log1p(q)), 6).alias("log1p_slope"), _r(F.regr_r2(F.log1p(p), F.log1p(q)), 6).alias("log1p_r2"))


@query(None)
def st3_significance(spark, d):
    """ST-3: two-sided p of r by station, from Student's t with n - 2 degrees of freedom."""
    g = obs(spark, d).groupBy("station_id").agg(F.count("*").alias("n"), stats.correlation(F.col("disc"), F.col("tax")).alias("r"))
    t = F.col("r") * F.sqrt((F.col("n") - 2) / F.nullif(1 - F.col("r") * F.col("r"), F.lit(0.0)))
    return g.where("n > 2").withColumn("p", stats.t_probability(t, F.col("n") - 2))


_PAIRS = "p AS (SELECT sensor, ok % 2 = 0 AS flag, 'price' AS variable, price AS x, price * (1 + disc - tax) AS z FROM $obs UNION ALL SELECT sensor, ok % 2 = 0, 'q', q, q + 10 * disc FROM $obs)"


def _pairs(spark, d):
    o = obs(spark, d).withColumn("flag", F.col("ok") % 2 == 0)
    a = F.struct(F.lit("price").alias("variable"), F.col("price").alias("x"), (F.col("price") * (1 + F.col("disc") - F.col("tax"))).alias("z"))
    b = F.struct(F.lit("q").alias("variable"), F.col("q").alias("x"), (F.col("q") + 10 * F.col("disc")).alias("z"))
    return o.select("sensor", "flag", F.inline(F.array(a, b)))  # one join for both


@query(f"WITH {_PAIRS} SELECT sensor, variable, coalesce(CAST(flag AS VARCHAR), 'all') AS flag, count(*) AS n, round(sqrt(avg((z - x) * (z - x))), 4) AS rmse, round(avg(abs(z - x)), 4) AS mae, round(avg(z - x), 4) AS mbe, round(corr(ln(x), ln(z)), 6) AS r_log FROM p GROUP BY GROUPING SETS ((sensor, variable), (sensor, variable, flag))")
def st5_stratified(spark, d):
    """ST-5: errors and r of logarithms by sensor, variable and flag, and over both flags."""
    e = F.col("z") - F.col("x")
    p = _pairs(spark, d).withColumn("flag", F.explode(F.array(F.lit("all"), F.col("flag").cast("string"))))
    return p.groupBy("sensor", "variable", "flag").agg(F.count("*").alias("n"), _r(F.sqrt(F.avg(e * e))).alias("rmse"), _r(F.avg(F.abs(e))).alias("mae"), _r(F.avg(e)).alias("mbe"), _r(stats.correlation(F.ln("x"), F.ln("z")), 6).alias("r_log"))


@query(f"WITH {_PAIRS} SELECT sensor, flag, count(*) AS n, round(sqrt(avg((ln(z) - ln(x)) * (ln(z) - ln(x)))), 6) AS rmse, round(pow(corr(ln(x), ln(z)), 2), 6) AS r2 FROM p WHERE variable = 'price' GROUP BY 1, 2")
def st12_outcome(spark, d):
    """ST-12: error and R2 of logarithms by sensor and correction flag."""
    a, b = F.ln("x"), F.ln("z")
    return _pairs(spark, d).where("variable = 'price'").groupBy("sensor", "flag").agg(F.count("*").alias("n"), _r(F.sqrt(F.avg((b - a) * (b - a))), 6).alias("rmse"), _r(F.pow(stats.correlation(a, b), F.lit(2.0)), 6).alias("r2"))


@query("""WITH a AS (SELECT station_id, year(date) * 12 + month(date) AS p, avg(v) AS av FROM $samples GROUP BY 1, 2), b AS (SELECT station_id, year(obs_date) * 12 + month(obs_date) AS p, avg(q) AS bv FROM $daily GROUP BY 1, 2),
c AS (SELECT CAST(l.lag AS INT) AS lag, count(*) AS n, round(corr(av, bv), 6) AS r FROM (SELECT unnest(range(7)) AS lag) l, a JOIN b ON a.station_id = b.station_id WHERE a.p = b.p + l.lag GROUP BY l.lag HAVING count(*) > 20) SELECT arg_max(lag, r) AS lag, max(r) AS r, count(*) AS lags FROM c""")
def st9_best_lag(spark, d):
    """ST-9: the lag with the largest correlation."""
    from .q_joins import jn11_lag_correlogram

    return jn11_lag_correlogram(spark, d).agg(F.max_by("lag", F.struct("r", -F.col("lag"))).alias("lag"), F.max("r").alias("r"), F.count("*").alias("lags"))


@query("SELECT sample_id, CASE WHEN count(tp) OVER w >= 20 THEN round(quantile_cont(tp, 0.5) OVER w, 4) END AS med FROM $samples WINDOW w AS (ORDER BY v, sample_id ROWS BETWEEN 199 PRECEDING AND CURRENT ROW)")
def wn2_trend(spark, d):
    """WN-2: the median of the 200 rows up to each in the order of a value over all rows, from the twentieth on."""
    s = samples(spark, d).select("sample_id", "v", "tp")
    return stats.rolling_median(s, "v", "sample_id", "tp").select("sample_id", _r(F.col("median")).alias("med"))
