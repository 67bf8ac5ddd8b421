"""Queries of neighbourhood and patch windows, feature tiers, sinks, products, sampling and report tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import arrays, schema, water
from ..operators import models, spatial, stats, temporal
from ..sources import readers, sinks
from .q_summary import _PRED, predictions
from .tables import daily, obs, query, read, readings, samples, stations


def _r(c, n=4):
    return F.round(c, n)


@query("""WITH a AS (SELECT station_id, obs_date, sensor, avg(price) AS p FROM $obs GROUP BY 1, 2, 3), m AS (SELECT a.sensor || '-' || b.sensor AS pair, ln(greatest(a.p, 0.01)) AS x, ln(greatest(b.p, 0.01)) AS y FROM a JOIN a b ON a.station_id = b.station_id AND a.sensor < b.sensor AND abs(a.obs_date - b.obs_date) <= 3)
SELECT pair, count(*) AS n, round(pow(corr(x, y), 2), 6) AS r2, round(sqrt(avg((y - x) * (y - x))), 6) AS rmse FROM m GROUP BY 1 HAVING count(*) >= 10""")
def st13_sensor_agreement(spark, d):
    """ST-13, JN-8, ST-2: each pair of sensors within three days on a log scale, from one matchup."""
    a = obs(spark, d).groupBy("station_id", F.col("obs_date"), "sensor").agg(F.avg("price").alias("p"))
    left = a.select("station_id", F.col("obs_date").alias("date"), F.col("sensor").alias("s1"), "p")
    right = a.select("station_id", "obs_date", F.col("sensor").alias("s2"), F.col("p").alias("p2"))
    m = temporal.within_days(left, right, ["station_id"], 3).where("s1 < s2")
    log = lambda c: F.ln(water.clip(F.col(c), 0.01))
    n, r2, rmse, _ = stats.paired("x", "y")
    g = m.select(F.concat_ws("-", "s1", "s2").alias("pair"), log("p").alias("x"), log("p2").alias("y")).groupBy("pair").agg(n, r2, rmse)
    return g.where("n >= 10").select("pair", "n", _r(F.col("r2"), 6).alias("r2"), _r(F.col("rmse"), 6).alias("rmse"))


@query("""WITH m AS (SELECT * FROM $stations WHERE station_id IN (SELECT station_id FROM $samples)),
r AS (SELECT a.station_id, b.station_id AS other, row_number() OVER (PARTITION BY a.station_id ORDER BY round(2 * 6371000 * asin(sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))), 3), b.station_id) AS rank FROM m a JOIN m b ON a.station_id <> b.station_id),
e AS (SELECT station_id, other FROM r WHERE rank <= 8 UNION SELECT other, station_id FROM r WHERE rank <= 8),
g AS (SELECT * FROM $daily WHERE station_id % 5 <> 0),
l AS (SELECT station_id, other, row_number() OVER (PARTITION BY station_id ORDER BY other) AS rank FROM e),
n AS (SELECT station_id, other, rank FROM l WHERE rank <= 8 AND station_id IN (SELECT station_id FROM g) UNION ALL SELECT station_id, station_id, 0 FROM m),
w AS (SELECT s.sample_id, n.rank, g.q, row_number() OVER (PARTITION BY s.sample_id, n.rank ORDER BY g.obs_date DESC) AS back FROM samples s JOIN n ON n.station_id = s.station_id JOIN g ON g.station_id = n.other AND g.obs_date >= s.date - 30 AND g.obs_date < s.date)
SELECT s.sample_id, 9 AS nodes, round(coalesce(sum(q), 0), 4) AS total, round(coalesce(sum(q * (rank + 1) * (31 - back)), 0), 4) AS weighted, CAST(any_value(s.station_id) IN (SELECT station_id FROM g) AS INT) AS has FROM samples s LEFT JOIN w ON s.sample_id = w.sample_id GROUP BY s.sample_id""")
def wn6_neighbour_windows(spark, d):
    """WN-6: packed windows of thirty days of a station and the first eight of its neighbours in the symmetric graph of sampled stations, in the order of stations; has: the station has a series, which every fifth lacks. Checked by sums over nodes and positions."""
    s = samples(spark, d)
    st = stations(spark, d).join(s.select("station_id").distinct(), "station_id", "left_semi")
    near = temporal.local_nodes(spatial.neighbour_graph(st, "station_id", 8), st.select("station_id", F.col("station_id").alias("place")), "station_id", 8)
    w = temporal.neighbour_windows(s, near, daily(spark, d).where("station_id % 5 <> 0"), "station_id", "sample_id", "q", 30, 8)

    def sums(batches):
        for b in batches:
            x = b.column("seq").flatten().flatten().to_numpy().reshape(-1, 9, 30)
            total, weighted = x.sum(axis=(1, 2)), np.einsum("snd,n,d->s", x, np.arange(1.0, 10), np.arange(1.0, 31))
            nodes = b.column("seq").value_lengths()
            yield pa.RecordBatch.from_arrays([b.column("sample_id"), nodes, pa.array(total), pa.array(weighted), b.column("has")], names=["sample_id", "nodes", "total", "weighted", "has"])

    kind = w.schema["sample_id"].dataType.simpleString()
    out = w.select("sample_id", "seq", "has").mapInArrow(sums, f"sample_id {kind}, nodes int, total double, weighted double, has int")
    return out.select("sample_id", "nodes", _r("total").alias("total"), _r("weighted").alias("weighted"), "has")


@query("""WITH p AS (SELECT station_id, obs_date, embedding FROM $daily JOIN embeddings ON vec_id = (station_id * 31 + dayofyear(obs_date)) % (SELECT count(*) FROM embeddings) WHERE day(obs_date) % 3 <> 0),
e AS (SELECT station_id, obs_date, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM p),
f AS (SELECT station_id, obs_date, sum(CASE WHEN x < 0 OR i % 4 = 1 THEN 0 ELSE CAST(x AS DOUBLE) * i END) AS t FROM e GROUP BY 1, 2),
a AS (SELECT obs_date, row_number() OVER (ORDER BY obs_date) AS n FROM (SELECT DISTINCT obs_date FROM p)),
z AS (SELECT date, (SELECT count(*) FROM a WHERE a.obs_date < x.date) AS upto FROM (SELECT DISTINCT date FROM $samples) x)
SELECT s.sample_id, count(f.t) AS n_patches, round(coalesce(sum(t * (10 - (upto - n))), 0), 4) AS weighted FROM samples s JOIN z USING (date) LEFT JOIN (f JOIN a USING (obs_date)) ON f.station_id = s.station_id AND n > upto - 10 AND n <= upto GROUP BY 1""")
def wn7_patch_windows(spark, d):
    """WN-7: masked patches of the last ten days of the archive before each sample, the first of four channels set to 0, checked by weighted sums. The archive lacks every day of a month that three divides."""
    e = read(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("patch"))
    n = e.agg(F.count("*").alias("all_"))
    at = daily(spark, d).where(F.dayofmonth("obs_date") % 3 != 0).join(F.broadcast(n), F.lit(True))  # one row
    p = at.withColumn("vec_id", (F.col("station_id") * 31 + F.dayofyear("obs_date")) % F.col("all_")).join(e, "vec_id")
    p = p.select("station_id", "obs_date", "patch", F.transform("patch", lambda x: (x >= 0).cast("int")).alias("mask"))
    w = temporal.patch_windows(samples(spark, d), p, "station_id", "sample_id", 10, 64, [0], 4)
    add = lambda a, x: a + x
    total = F.aggregate(F.transform("seq", lambda s, i: F.aggregate(F.transform(s, lambda x, k: x * (k + 1)), F.lit(0.0), add) * (i + 1)), F.lit(0.0), add)
    return w.select("sample_id", F.col("n_patches").cast("long").alias("n_patches"), _r(F.when(F.col("n_patches") > 0, total).otherwise(0.0)).alias("weighted"))


@query("""SELECT sample_id, station_id, v FROM $samples ORDER BY CAST('0x' || substr(md5('42:' || sample_id), 1, 13) AS BIGINT), sample_id LIMIT 500""")
def so4_seeded_sample(spark, d):
    """SO-4: a seeded sample of at most 500 rows; the sampling is the feature."""
    return stats.seeded_sample(samples(spark, d).select("sample_id", "station_id", "v"), "sample_id", 500)


_ORDER = ["3-MEDIUM", "1-URGENT", "2-HIGH", "5-LOW"]


@query("""SELECT o_orderpriority AS tier, count(*) AS n, row_number() OVER (ORDER BY CASE o_orderpriority WHEN '3-MEDIUM' THEN 1 WHEN '1-URGENT' THEN 2 WHEN '2-HIGH' THEN 3 WHEN '5-LOW' THEN 4 ELSE 5 END, o_orderpriority) AS place FROM orders GROUP BY 1 ORDER BY place""")
def so2_custom_order(spark, d):
    """SO-2: groups in a stated order of categories, unknown ones last."""
    g = read(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("tier")).agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.orderBy(water.place_in(F.col("tier"), _ORDER), "tier"))  # a row for each category
    return g.withColumn("place", place.cast("long")).orderBy("place")


@query("""WITH s AS (SELECT o.sample_id, o.tp / 10 AS era5_t2m, o.chla AS mesan_wind, st.bal / 100 AS ero_area, o.secchi AS s2_secchi, CAST(o.sample_id % 3 AS DOUBLE) AS s2_days_offset, o.v AS derived_v, st.lat FROM $samples o JOIN $stations st ON o.station_id = st.station_id),
t AS (SELECT 'lat' AS name, lat AS x FROM s UNION ALL SELECT 'ero_area', ero_area FROM s UNION ALL SELECT 'era5_t2m', era5_t2m FROM s UNION ALL SELECT 'mesan_wind', mesan_wind FROM s UNION ALL SELECT 's2_secchi', s2_secchi FROM s),
u AS (SELECT * FROM (VALUES ('static', 'lat'), ('static', 'ero_area'), ('met', 'lat'), ('met', 'ero_area'), ('met', 'era5_t2m'), ('met_mesan', 'lat'), ('met_mesan', 'ero_area'), ('met_mesan', 'era5_t2m'), ('met_mesan', 'mesan_wind'), ('published_alg', 's2_secchi'), ('full', 'lat'), ('full', 'ero_area'), ('full', 'era5_t2m'), ('full', 'mesan_wind'), ('full', 's2_secchi')) v(tier, name))
SELECT tier, u.name, count(x) AS n, round(avg(x), 4) AS mean FROM u JOIN t ON u.name = t.name GROUP BY 1, 2""")
def prj8_feature_tiers(spark, d):
    """PRJ-8, PRJ-2, SE-4: feature columns by tier from the schema, units by prefix; every feature is summed once, then dealt to its tiers."""
    s = samples(spark, d).join(stations(spark, d).select("station_id", "lat", "bal"), "station_id")
    w = s.select("sample_id", F.col("lat"), F.col("bal").alias("ero_area"), (F.col("tp") / 10).alias("era5_t2m"), F.col("chla").alias("mesan_wind"), F.lit("p").alias("mesan_product"), F.col("secchi").alias("s2_secchi"), (F.col("sample_id") % 3).cast("double").alias("s2_days_offset"), F.lit("b").alias("s2_chl_a_name"), F.col("v").alias("derived_v"))
    w = schema.scale_by_prefix(w, {"ero_": 100.0})
    tiers = {t: schema.tier_columns(w.schema, t, ["lat", "ero_area", "lat"]) for t in schema.TIERS}
    names = schema.distinct_names([c for cs in tiers.values() for c in cs])
    long = w.select(*names).unpivot([], names, "name", "x").groupBy("name").agg(F.count("x").alias("n"), _r(F.avg("x")).alias("mean"))
    at = F.array(*[F.struct(F.lit(t).alias("tier"), F.lit(c).alias("c")) for t, cs in tiers.items() for c in cs])
    return long.select("name", "n", "mean", F.inline(at)).where("c = name").select("tier", "name", "n", "mean")


@query("""SELECT sample_id, CASE WHEN tp > 0 THEN round(least(greatest(1.7 / tp, 0.1), 40), 6) END AS secchi, round(chla * 0.8, 6) AS turbidity, round(coalesce(secchi, chla), 6) AS chl, CASE WHEN secchi IS NOT NULL THEN round(least(greatest(-0.5 * ln(greatest(secchi / 100, 1e-9) / greatest(tp / 1000, 1e-9)), 0), 20), 6) + 0 END AS cdom FROM $samples""")
def fnw22_colour_products(spark, d):
    """FN-W22."""
    tp, c, s = F.col("tp"), F.col("chla"), F.col("secchi")
    out = {"secchi": water.attenuation_secchi(tp), "turbidity": water.matter_turbidity(c), "chl": water.product_chla(F.coalesce(s, F.lit(float("nan"))), c), "cdom": water.product_cdom(s / 100, tp / 1000)}
    return samples(spark, d).select("sample_id", *[_r(x, 6).alias(k) for k, x in out.items()])


_PERIODS = {"p1": (1995, 1996), "p2": (1997, 1998), "p3": (1999, 2001)}


@query(_PRED + """, q AS (SELECT p.*, CASE WHEN year(s.date) <= 1996 THEN 'p1' WHEN year(s.date) <= 1998 THEN 'p2' ELSE 'p3' END AS period FROM p JOIN (SELECT o_orderkey AS id, o_orderdate AS date FROM orders) s ON s.id = p.sample_id),
w2 AS (SELECT cls, period, 1 - sum((y - yhat) * (y - yhat)) / (var_pop(y) * count(*)) AS r2, sqrt(avg((y - yhat) * (y - yhat))) AS rmse, avg(y - yhat) AS mbe, count(*) AS n FROM q GROUP BY 1, 2)
SELECT w.place, w.cls, coalesce(max(printf('%.3f', r2)) FILTER (period = 'p1'), '---') AS p1_r2, coalesce(max(printf('%.2f', rmse)) FILTER (period = 'p1'), '---') AS p1_rmse, coalesce(max(printf('%.3f', r2)) FILTER (period = 'p2'), '---') AS p2_r2, coalesce(max(printf('%.2f', rmse)) FILTER (period = 'p2'), '---') AS p2_rmse, coalesce(max(printf('%.3f', r2)) FILTER (period = 'p3'), '---') AS p3_r2, coalesce(max(printf('%.2f', rmse)) FILTER (period = 'p3'), '---') AS p3_rmse
FROM (VALUES (1, 'oligo'), (2, 'meso'), (3, 'eu'), (4, 'hyper')) w(place, cls) LEFT JOIN w2 ON w2.cls = w.cls GROUP BY 1, 2""")
def ev13_report_rows(spark, d):
    """EV-13, FN-S5: the wanted rows of a report in their order, a pair of cells for each period, --- where there is no result."""
    y = F.year("date")
    period = F.when(y <= 1996, "p1").when(y <= 1998, "p2").otherwise("p3")
    p = predictions(spark, d).join(samples(spark, d).select("sample_id", period.alias("period")), "sample_id")
    rmse, r2, _, _ = stats.metrics("y", "yhat", 1)
    m = p.groupBy("cls", "period").agg(rmse, r2)
    wide = m.groupBy("cls").pivot("period", list(_PERIODS)).agg(F.first("r2").alias("r2"), F.first("rmse").alias("rmse"))
    rows = spark.createDataFrame([(i + 1, c) for i, c in enumerate(["oligo", "meso", "eu", "hyper"])], "place int, cls string")
    cells = [water.fixed_decimals(F.col(f"{k}_{c}"), n).alias(f"{k}_{c}") for k in _PERIODS for c, n in (("r2", 3), ("rmse", 2))]
    return rows.join(F.broadcast(wide), "cls", "left").select("place", "cls", *cells).orderBy("place")  # a row for each class


@query(None)
def ml10_patch_boosted(spark, d):
    """ML-10: boosted trees on flattened patches, out of fold."""
    e = read(spark, d, "embeddings").select("vec_id", "embedding", "label", (F.col("vec_id") % 5).cast("int").alias("fold"))
    return models.patch_boosted(e, "embedding", "label", "fold", trees=5).select("vec_id", "fold", "label", "prediction")


@query("""SELECT o_orderkey, o_totalprice AS s2_o_totalprice, o_totalprice AS value, o_orderstatus AS s2_o_orderstatus FROM orders""")
def src6_first_existing(spark, d):
    """SRC-6, SRC-9: the first of several file names that exists, its columns prefixed, one of them found by pattern."""
    t = readers.read_first(spark, [f"{d}/sentinel2_*.parquet", f"{d}/orders.parquet"], ["o_orderkey"], "s2_")
    value = readers.pick_column(t.columns, "^s2_.*price")
    return t.select("o_orderkey", "s2_o_totalprice", F.col(value).alias("value"), "s2_o_orderstatus")


@query("""SELECT station_id, yr AS year, round(CASE WHEN yr <= 1997 THEN s ELSE -s END, 2) AS total FROM (SELECT station_id, year(date) AS yr, sum(v) AS s FROM $samples GROUP BY 1, 2)""")
def snk1_yearly_parts(spark, d):
    """SNK-1: yearly partitions; a second run adds the missing years and leaves those that are there."""
    a = samples(spark, d).groupBy("station_id", F.year("date").alias("year")).agg(F.sum("v").alias("total"))
    path = sinks.scratch(spark, "yearly")
    sinks.write_parts(a.where("year <= 1997"), path)
    sinks.write_parts(a.withColumn("total", -F.col("total")), path)
    back = spark.read.schema("station_id long, total double, year int").parquet(path)
    return back.select("station_id", F.col("year").cast("long").alias("year"), _r(F.col("total"), 2).alias("total"))


@query("""SELECT ok, ln, sensor AS owt_class_v1_provisional, disc - 0.05 AS blue, CASE WHEN sensor = 'A' THEN 'L2A' WHEN sensor = 'N' THEN 'L1C' END AS product_level, CASE WHEN disc - 0.05 < 0 THEN 1 ELSE 0 END AS rw_blue_negative_flag, CASE WHEN sensor = 'A' THEN 'sen2cor' WHEN sensor = 'N' THEN 'toa' END AS ac_method FROM $obs""")
def snk4_backfill(spark, d):
    """SNK-4, FN-S4: renamed class, flag of a negative band and method filled back; a second run changes nothing. The family comes from a file's name."""
    o = obs(spark, d).select("ok", "ln", F.col("sensor").alias("owt_class"), (F.col("disc") - 0.05).alias("blue"), F.when(F.col("sensor") == "A", "L2A").when(F.col("sensor") == "N", "L1C").alias("product_level"))
    once, _ = sinks.backfill(o, "sentinel2", {}, "blue")
    return sinks.backfill(once, "sentinel2", {}, "blue")[0]


@query("""SELECT event_id, CASE event_type WHEN 'click' THEN 'sentinel2' WHEN 'view' THEN 'modis' WHEN 'error' THEN 'landsat' ELSE 'unknown' END AS family FROM $readings""")
def fns4_family(spark, d):
    """FN-S4: sensor family in a file's name."""
    t = F.col("event_type")
    name = F.concat(F.lit("station_"), F.when(t == "click", "sentinel2_wq").when(t == "view", "modis_aqua").when(t == "error", "landsat").otherwise(t), F.lit("_2001.parquet"))
    return readings(spark, d).select("event_id", sinks.family(name).alias("family"))


@query("""WITH c AS (SELECT CAST(floor(lat) AS INT) AS gy, CAST(floor(lon) AS INT) AS gx, avg(tp) AS tp, avg(chla) AS chla FROM $samples s JOIN $stations st ON s.station_id = st.station_id GROUP BY 1, 2)
SELECT 'tp' AS variable, 'ug/l' AS unit, count(tp) AS n, round(avg(tp), 4) AS mean FROM c UNION ALL SELECT 'chla', 'ug/l', count(chla), round(avg(chla), 4) FROM c""")
def snk5_grid_product(spark, d):
    """SNK-5: a grid product whose columns carry their unit, range and method as metadata, written and read back."""
    about = {"tp": {"unit": "ug/l", "valid": "0..1000", "method": "cell mean"}, "chla": {"unit": "ug/l", "valid": "0..500", "method": "cell mean"}}
    c = samples(spark, d).join(stations(spark, d).select("station_id", "lat", "lon"), "station_id")
    c = c.groupBy(F.floor("lat").cast("int").alias("gy"), F.floor("lon").cast("int").alias("gx")).agg(F.avg("tp").alias("tp"), F.avg("chla").alias("chla"))
    path = sinks.scratch(spark, "grid")
    sinks.with_metadata(c, about).write.parquet(path)
    back = spark.read.parquet(path)
    unit = {f.name: f.metadata.get("unit") for f in back.schema}
    long = back.select("tp", "chla").unpivot([], ["tp", "chla"], "variable", "x").groupBy("variable").agg(F.count("x").alias("n"), _r(F.avg("x")).alias("mean"))
    return long.select("variable", F.try_element_at(F.create_map(*[F.lit(v) for k in about for v in (k, unit[k])]), F.col("variable")).alias("unit"), "n", "mean")


@query("""SELECT CAST(row_number() OVER (ORDER BY sensor) - 1 AS INT) AS index, sensor AS name, round(avg(q), 4) AS norm_offset, round(stddev_samp(q), 4) AS norm_scale, sensor = 'R' AS corrupted FROM $obs GROUP BY sensor""")
def snk6_channel_dictionary(spark, d):
    """SNK-6: a dictionary of channels as JSON, written and read back."""
    g = obs(spark, d).groupBy("sensor").agg(_r(F.avg("q")).alias("a"), _r(F.stddev_samp("q")).alias("s"))
    rows = [{"index": i, "name": r.sensor, "norm_offset": r.a, "norm_scale": r.s, "corrupted": r.sensor == "R"} for i, r in enumerate(g.orderBy("sensor").collect())]  # a row for each channel
    path, ddl = sinks.scratch(spark, "channels"), "index int, name string, norm_offset double, norm_scale double, corrupted boolean"
    sinks.write_dictionary(spark, rows, ddl, path)
    return spark.read.schema(ddl).json(path)


@query("""WITH l AS (SELECT ok, sensor, arg_max(q, (ln, CAST(q AS VARCHAR))) AS q FROM $obs WHERE sensor <> 'A' GROUP BY 1, 2)
SELECT CAST(ok AS VARCHAR) AS sample_id, string_agg('bio_' || sensor || '=' || CAST(q AS VARCHAR), ',' ORDER BY sensor) AS bio FROM l GROUP BY 1""")
def fnj3_open_codes(spark, d):
    """FN-J3: a map of all codes that have no column of their own."""
    o = obs(spark, d)
    entry = F.struct("ln", F.col("sensor").alias("propertyCode"), F.lit("G").alias("qualityCode"), F.array(F.struct(F.col("q").cast("string").alias("value"), F.lit("u").alias("unit"))).alias("observationValues"))
    rec = o.groupBy("ok", "station_id").agg(F.array_sort(F.collect_list(entry)).alias("observations"))
    js = rec.select(F.to_json(F.struct(F.col("ok").cast("string").alias("sampleId"), F.col("station_id").cast("string").alias("stationId"), F.lit("2001-01-01").alias("samplingDate"), "observations")).alias("json"))
    m = readers.open_columns(readers.sample_values(js), ["A"])
    return m.select("sample_id", F.array_join(F.transform(F.array_sort(F.map_entries("bio")), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("bio"))


@query("""SELECT station_id, arg_max(q, (obs_date, ok, ln, q)) AS q, max(obs_date) AS since FROM $obs GROUP BY 1""")
def fnj4_latest_position(spark, d):
    """FN-J4: the latest entry of an array. A station's entries come as an array a month, the latest of which wins, so that no row holds a whole station."""
    a = obs(spark, d).groupBy("station_id", F.trunc("obs_date", "month").alias("month")).agg(F.collect_list(F.struct(F.struct("obs_date", "ok", "ln").alias("from"), "q")).alias("a"))
    p = a.select("station_id", readers.latest(F.col("a")).alias("p")).groupBy("station_id").agg(F.max_by("p", "p.from").alias("p"))
    return p.select("station_id", "p.q", F.col("p.from.obs_date").alias("since"))


@query("""SELECT event_id, nullif(CAST(json_extract(props, '$.k') AS DOUBLE), 0) AS reading FROM events""")
def fnj5_live_reading(spark, d):
    """FN-J5: the first record of a live reading, renamed, its sentinel null."""
    e = read(spark, d, "events").select("event_id", F.from_json(F.concat(F.lit("["), "props", F.lit("]")), "array<map<string, double>>").alias("a"))
    return e.select("event_id", *readers.live_reading(F.col("a"), {"k": "reading"}, 0.0))


@query("""WITH k AS (SELECT vec_id, embedding AS e, CAST(unnest(range(1024)) AS INT) AS k FROM embeddings), p AS (SELECT vec_id, e, k, (k // 32) * (7 / CAST(31 AS DOUBLE)) AS y, (k % 32) * (7 / CAST(31 AS DOUBLE)) AS x FROM k),
c AS (SELECT *, CAST(least(floor(y), 6) AS INT) AS y0, CAST(least(floor(x), 6) AS INT) AS x0 FROM p),
v AS (SELECT vec_id, k, CAST(e[(k // 32 * 8 // 32) * 8 + k % 32 * 8 // 32 + 1] AS DOUBLE) AS near, CAST(e[y0 * 8 + x0 + 1] AS DOUBLE) * (1 - (y - y0)) * (1 - (x - x0)) + CAST(e[y0 * 8 + x0 + 2] AS DOUBLE) * (1 - (y - y0)) * (x - x0) + CAST(e[y0 * 8 + x0 + 9] AS DOUBLE) * (y - y0) * (1 - (x - x0)) + CAST(e[y0 * 8 + x0 + 10] AS DOUBLE) * (y - y0) * (x - x0) AS bil FROM c)
SELECT vec_id, 1024 AS n, round(sum(near * (k + 1)), 3) AS nearest, round(sum(bil * (k + 1)), 3) AS bilinear FROM v GROUP BY 1""")
def fna2_resize(spark, d):
    """FN-A2: patches of 8 x 8 to 32 x 32, nearest and bilinear, checked by weighted sums."""
    e = read(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("p"))
    e = e.select("vec_id", arrays.resize_nearest(F.col("p"), 8, 8).alias("a"), arrays.resize_bilinear(F.col("p"), 8, 8).alias("b"))
    total = lambda c: _r(F.aggregate(F.transform(c, lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x), 3)
    return e.select("vec_id", F.size("a").alias("n"), total("a").alias("nearest"), total("b").alias("bilinear"))


@query("""SELECT s.station_id, s.sample_id, s.tp, dd.q FROM $samples s JOIN $daily dd ON s.station_id = dd.station_id AND s.date = dd.obs_date WHERE s.secchi IS NOT NULL""")
def jn10_paired_rows(spark, d):
    """JN-10: equal station and day, rows with nulls dropped."""
    s = samples(spark, d).dropna(subset=["tp", "secchi"])
    return s.join(daily(spark, d).withColumnRenamed("obs_date", "date"), ["station_id", "date"]).dropna(subset=["q"]).select("station_id", "sample_id", "tp", "q")
