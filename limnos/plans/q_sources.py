"""Queries of readers, merges, patches, splits and the remaining projections."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import arrays, water
from ..operators import stats
from ..sources import readers, sinks
from .tables import daily, obs, query, readings, samples, stations


def _r(c, n=4):
    return F.round(c, n)


@query("""SELECT CAST(ok AS VARCHAR) AS sample_id, CAST(station_id AS VARCHAR) AS station_id, min(obs_date) AS date, arg_max(q, (ln, CAST(q AS VARCHAR))) FILTER (sensor = 'A') AS alpha, arg_max(q, (ln, CAST(q AS VARCHAR))) FILTER (sensor = 'N') AS nova FROM $obs GROUP BY ok, station_id""")
def src7_sample_records(spark, d):
    """SRC-7, FN-J1, FN-J2: nested JSON records to wide rows; unmapped codes go, the last repeat wins."""
    o = obs(spark, d)
    entry = F.struct("ln", F.col("sensor").alias("propertyCode"), F.lit("G").alias("qualityCode"), F.array(F.struct(F.lit(None).cast("string").alias("value"), F.lit("u").alias("unit")), F.struct(F.col("q").cast("string").alias("value"), F.lit("u").alias("unit"))).alias("observationValues"))
    rec = o.groupBy("ok", "station_id").agg(F.min("obs_date").alias("samplingDate"), F.array_sort(F.collect_list(entry)).alias("observations"))
    js = rec.select(F.to_json(F.struct(F.col("ok").cast("string").alias("sampleId"), F.col("station_id").cast("string").alias("stationId"), F.col("samplingDate").cast("string").alias("samplingDate"), "observations")).alias("json"))
    return readers.sample_rows(readers.sample_values(js), {"A": "alpha", "N": "nova"})


@query("""SELECT user_id, date_trunc('second', ts) AS ts, value, flag AS quality FROM $readings WHERE event_id % 11 <> 0 AND event_id % 13 <> 0""")
def src8_station_files(spark, d):
    """SRC-8: semicolon files with a preamble, an hour column and decimal commas, one for each user and day; broken lines go."""
    line = F.concat_ws(";", F.date_format("ts", "yyyy-MM-dd"), F.date_format("ts", "HH:mm:ss"), F.when(F.col("event_id") % 13 == 0, "x").otherwise(F.regexp_replace(F.col("value").cast("string"), r"\.", ",")), "flag", F.when(F.col("event_id") % 11 == 0, "too;many"))
    head = "Station;1\nNote;text\n\nDatum;Tid (UTC);Value;Quality\n"
    files = readings(spark, d).groupBy("user_id", "date").agg(F.concat(F.lit(head), F.array_join(F.collect_list(line), "\n")).alias("text"))
    return readers.station_readings(files).drop("date")


@query("""WITH a AS (SELECT station_id, year(date) AS yr, round(avg(v), 2) AS score FROM $samples GROUP BY 1, 2), n AS (SELECT station_id, yr, -score AS score FROM a WHERE yr % 2 = 0)
SELECT a.station_id, a.yr, coalesce(n.score, a.score) AS score FROM a LEFT JOIN n ON a.station_id = n.station_id AND a.yr = n.yr WHERE a.yr <> 1999""")
def snk2_merge_results(spark, d):
    """SNK-2, SNK-3: a result table merged with a newer one, the last of a key kept, finished keys left out."""
    a = samples(spark, d).groupBy("station_id", F.year("date").cast("long").alias("yr")).agg(_r(F.avg("v"), 2).alias("score"))
    out = sinks.merge_results(a, a.where("yr % 2 = 0").withColumn("score", -F.col("score")), ["station_id", "yr"])
    return sinks.not_done(out, a.where("yr = 1999").select("yr"), ["yr"])


@query("""WITH g AS (SELECT station_id, row_number() OVER (ORDER BY CAST('0x' || substr(md5('42:' || station_id), 1, 13) AS BIGINT)) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT station_id FROM $samples))
SELECT s.sample_id, s.station_id, CASE WHEN r <= floor(n * CAST(0.8 AS DOUBLE)) THEN 'train' WHEN r <= floor(n * CAST(0.8 AS DOUBLE)) + floor(n * CAST(0.1 AS DOUBLE)) THEN 'val' ELSE 'test' END AS split FROM samples s JOIN g ON s.station_id = g.station_id""")
def sp2_group_split(spark, d):
    """SP-2: groups shuffled by a seeded hash and cut at 80 and 90 %, without a global sort."""
    return stats.group_split(samples(spark, d).select("sample_id", "station_id"), "station_id")


@query("""SELECT * EXCLUDE r FROM (SELECT sample_id, year(date) AS yr, row_number() OVER (PARTITION BY year(date) ORDER BY CAST('0x' || substr(md5('42:' || sample_id), 1, 13) AS BIGINT), sample_id) AS r FROM $samples) WHERE r <= 100""")
def so5_cap_rows(spark, d):
    """SO-5: a seeded sample of at most 100 rows a year; the sampling is the feature."""
    return stats.cap_per_group(samples(spark, d).select("sample_id", F.year("date").cast("long").alias("yr")), "yr", "sample_id", 100)


@query("""SELECT station_id, ok, ln, CASE WHEN sensor = 'A' THEN q ELSE price / 1000 END AS blue, CASE WHEN sensor = 'A' THEN price / 1000 ELSE q END AS green, CASE sensor WHEN 'A' THEN 'sen2cor' WHEN 'N' THEN 'toa' END AS ac_method,
coalesce(nullif(disc, 0), nullif(tax, 0)) AS place, obs_date AS day, 'p' || ln || '_water_temp' AS slug FROM $obs WHERE year(obs_date) >= 1996 OR sensor <> 'A'""")
def prj5_bands_methods(spark, d):
    """PRJ-5, PRJ-7, PRJ-10, PRJ-11, FN-S2: bands by sensor and active years, method by level, first place, date from stamp or index, name slug."""
    a = F.col("sensor") == "A"
    o = obs(spark, d).where((F.year("obs_date") >= 1996) | ~a)
    method = F.try_element_at(F.create_map(F.lit("A"), F.lit("sen2cor"), F.lit("N"), F.lit("toa")), F.col("sensor"))
    index = F.when(F.col("ln") % 3 == 0, F.date_format("obs_date", "yyyy_MM_dd")).otherwise(F.concat(F.lit("scene_"), F.date_format("obs_date", "yyyyMMdd")))
    day = water.scene_date(F.when(F.col("ln") % 2 == 0, F.col("obs_date").cast("timestamp")), index)
    k = F.col("price") / 1000
    return o.select("station_id", "ok", "ln", F.when(a, F.col("q")).otherwise(k).alias("blue"), F.when(a, k).otherwise(F.col("q")).alias("green"), method.alias("ac_method"), water.first_place(F.col("disc"), F.col("tax")).alias("place"), day.alias("day"), water.column_slug(F.col("ln"), F.lit("Water  temp: daily")).alias("slug"))


@query("""SELECT sample_id, CASE WHEN chla > 18 THEN 4 WHEN tp / 4000 > 0.02 THEN 3 WHEN chla / greatest(tp / 2, 1e-9) < 0.8 THEN 2 WHEN chla / greatest(tp / 2, 1e-9) > 2 AND tp / 4000 < 0.005 THEN 1 ELSE 3 END AS owt, CASE WHEN chla <> 0 THEN round(least(tp / chla * 365, 3650), 4) END AS retention, round(sqrt(tp * tp + chla * chla), 6) AS wind, round(15 * pow(tp, CAST(0.3 AS DOUBLE)), 6) AS vollenweider FROM $samples""")
def fnw_types_expectations(spark, d):
    """FN-W14, FN-W19, FN-W32, FN-W33."""
    tp, c = F.col("tp"), F.col("chla")
    return samples(spark, d).select("sample_id", water.water_type(c, tp / 2, tp / 4000, c + 2).alias("owt"), _r(water.retention_days(tp, c)).alias("retention"), _r(water.wind_speed(tp, c), 6).alias("wind"), _r(water.expected_phosphorus(tp), 6).alias("vollenweider"))


@query("""WITH c AS (SELECT CAST(floor(lat) AS INT) AS gy, CAST(floor(lon) AS INT) AS gx, count(*) AS v FROM $stations WHERE station_id % 4 = 0 GROUP BY 1, 2)
SELECT s.station_id, CAST(sum(v) AS DOUBLE) AS total, count(v) AS valid, 9 AS size FROM stations s CROSS JOIN (VALUES (-1), (0), (1)) a(dy) CROSS JOIN (VALUES (-1), (0), (1)) b(dx) LEFT JOIN c ON gy = CAST(floor(lat) AS INT) + dy AND gx = CAST(floor(lon) AS INT) + dx GROUP BY 1""")
def fna3_cell_windows(spark, d):
    """FN-A3: 3 x 3 windows of cells with null beyond the edge, their sum and mask."""
    s = stations(spark, d).withColumns({"gy": F.floor("lat").cast("int"), "gx": F.floor("lon").cast("int")})
    c = s.where("station_id % 4 = 0").groupBy("gy", "gx").agg(F.count("*").cast("double").alias("v"))
    w = arrays.cell_windows(s, c, "station_id", "v", 1).withColumn("valid", F.aggregate("mask", F.lit(0).cast("long"), lambda a, x: a + x))
    total = F.aggregate(arrays.normalise(F.col("patch"), 0.0, 1.0), F.lit(0.0), lambda a, x: a + x)
    return w.select("station_id", F.when(F.col("valid") > 0, total).alias("total"), "valid", F.size("patch").alias("size"))


@query("""WITH k AS (SELECT DISTINCT station_id FROM $daily), days AS (SELECT station_id, CAST(g AS DATE) AS obs_date FROM k, (SELECT min(year(obs_date)) AS a, max(year(obs_date)) AS z FROM $daily) y, generate_series(make_date(y.a, 1, 1), make_date(y.z, 12, 31), INTERVAL 1 DAY) t(g))
SELECT days.station_id, CAST(date_trunc('month', days.obs_date) AS DATE) AS month, count(*) AS days, count(q) AS known, coalesce(sum(q), 0) AS q FROM days LEFT JOIN daily ON days.station_id = daily.station_id AND days.obs_date = daily.obs_date GROUP BY 1, 2""")
def fna4_calendar(spark, d):
    """FN-A4: series on the full calendar of the table's years with a mask, summed by month."""
    c = arrays.calendar_months(daily(spark, d), "station_id", "obs_date", "q")
    known = F.aggregate("mask", F.lit(0).cast("long"), lambda a, x: a + x)
    return c.select("station_id", "month", F.size("mask").cast("long").alias("days"), known.alias("known"), F.aggregate("values", F.lit(0.0), lambda a, x: a + x).alias("q"))


_CHANNELS = "c AS (SELECT ok, ln, sensor, price FROM $obs UNION ALL SELECT ok, ln, 'flat', 50.0 FROM obs UNION ALL SELECT ok, ln, 'small', q / 10 FROM obs)"


@query(f"""WITH {_CHANNELS}, p AS (SELECT sensor, quantile_cont(price, 0.01) AS lo, quantile_cont(price, 0.99) AS hi, max(price) AS top FROM c GROUP BY 1)
SELECT c.sensor, ok, ln, round(CASE WHEN top <= 10 THEN price WHEN hi - lo < 1e-8 THEN 0 ELSE least(greatest((price - lo) / nullif(hi - lo, 0), 0), 1) * 2 - 1 END, 6) AS scaled FROM c JOIN p ON c.sensor = p.sensor""")
def fnw31_clip_scale(spark, d):
    """FN-W31: channels with values over 10 clipped at their 1st and 99th percentile and scaled to -1..1; such a channel without a spread becomes 0. Two channels are added: one of equal values, one of values up to 5."""
    o = obs(spark, d).select("ok", "ln", "sensor", "price", "q")
    more = [o.withColumn("sensor", F.lit("flat")).withColumn("price", F.lit(50.0)), o.withColumn("sensor", F.lit("small")).withColumn("price", F.col("q") / 10)]
    c = o.unionByName(more[0]).unionByName(more[1]).drop("q")
    return stats.clip_scale(c, "sensor", "price").select("sensor", "ok", "ln", _r(F.col("scaled"), 6).alias("scaled"))


@query("""WITH m AS (SELECT CAST(floor(lat) AS INT) AS gy, CAST(floor(lon) AS INT) AS gx, count(*) AS k FROM $stations GROUP BY 1, 2)
SELECT s.station_id FROM stations s JOIN m ON gy = CAST(floor(s.lat) AS INT) AND gx = CAST(floor(s.lon) AS INT) WHERE k > 6""")
def flt14_mask(spark, d):
    """FLT-14: stations in cells that a mask table marks."""
    s = stations(spark, d).select("station_id", F.floor("lat").cast("int").alias("gy"), F.floor("lon").cast("int").alias("gx"))
    mask = s.groupBy("gy", "gx").agg(F.count("*").alias("k")).where("k > 6")
    return s.join(mask, ["gy", "gx"], "left_semi").select("station_id")
