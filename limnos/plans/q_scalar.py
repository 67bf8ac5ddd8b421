"""Queries of formulas, cleansing and reading."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..functions import water as wq
from ..operators import stats
from .tables import obs, query, read, readings, samples, stations


def _r(c, n=6):
    return F.round(c, n)


@query("""WITH b AS (SELECT o_orderkey AS id, CAST(o_orderkey % 31 AS DOUBLE) AS t, CAST(o_orderkey % 17 AS DOUBLE) AS dissolved, CAST(o_orderkey % 160 AS DOUBLE) AS colour, CAST(o_orderkey % 13 AS DOUBLE) AS a420, CAST(o_orderkey % 7 AS DOUBLE) AS a436 FROM orders),
s AS (SELECT *, 14.62 - 0.3898 * t + 0.006969 * t * t - 5.596e-5 * t * t * t AS sat FROM b)
SELECT id, round(sat, 6) AS sat, round(least(greatest(dissolved / nullif(sat, 0) * 100, 0), 200), 6) AS pct, round(greatest(sat - dissolved, 0), 6) AS deficit, round(0.174 * pow(greatest(colour, 0.1), 0.724), 6) AS cdom,
 round(CASE WHEN a436 <> 0 THEN least(greatest(a420 / a436, 0.5), 20) END, 6) AS ratio, round(CASE WHEN a436 <> 0 THEN least(greatest(ln(greatest(a420 / a436, 1e-6)) / 16, -0.05), 0.05) END, 6) AS slope FROM s""")
def fnw_oxygen_colour(spark, d):
    """FN-W1 to FN-W6."""
    k = F.col("o_orderkey")
    num = lambda m: (k % m).cast("double")
    t, do, colour, a, b = num(31), num(17), num(160), num(13), num(7)
    return read(spark, d, "orders").select(k.alias("id"), _r(wq.do_saturation(t)).alias("sat"), _r(wq.do_pct_saturation(do, t)).alias("pct"), _r(wq.do_deficit(do, t)).alias("deficit"), _r(wq.cdom_absorption_440(colour)).alias("cdom"), _r(wq.cdom_ratio(a, b)).alias("ratio"), _r(wq.spectral_slope(a, b)).alias("slope"))


@query("""SELECT sample_id, round(CASE WHEN tp <> 0 THEN least(greatest((v / 14.007) / (tp / 30.974), 0), 500) END, 6) AS np,
 CASE WHEN tp = 0 THEN NULL WHEN least(greatest((v / 14.007) / (tp / 30.974), 0), 500) <= 10 THEN 'N-limited' WHEN least(greatest((v / 14.007) / (tp / 30.974), 0), 500) <= 16 THEN 'co-limited' ELSE 'P-limited' END AS regime,
 round(CASE WHEN tp <> 0 THEN least(greatest(chla / tp, 0), 10) END, 6) AS chla_tp, CASE WHEN tp <= 8 THEN 'High' WHEN tp <= 24 THEN 'Good' WHEN tp <= 42 THEN 'Moderate' WHEN tp <= 80 THEN 'Poor' ELSE 'Bad' END AS status,
 round(9.81 * ln(greatest(chla, 0.01)) + 30.6, 6) AS t_chla, round(14.42 * ln(greatest(tp, 0.1)) + 4.15, 6) AS t_tp, round(CASE WHEN secchi IS NOT NULL THEN 60 - 14.41 * ln(greatest(secchi, 0.01)) END, 6) AS t_secchi,
 round((9.81 * ln(greatest(chla, 0.01)) + 30.6 + 14.42 * ln(greatest(tp, 0.1)) + 4.15 + coalesce(60 - 14.41 * ln(secchi), 0)) / CASE WHEN secchi IS NULL THEN 2 ELSE 3 END, 6) AS tsi,
 CASE WHEN tp > 0 AND tp <= 10 THEN 'oligotrophic' WHEN tp > 10 AND tp <= 35 THEN 'mesotrophic' WHEN tp > 35 AND tp <= 100 THEN 'eutrophic' WHEN tp > 100 THEN 'hypereutrophic' ELSE 'unknown' END AS trophic,
 round(ln(1 + v), 6) AS log_v, round(exp(ln(1 + tp)) - 1, 6) AS back FROM $samples""")
def fnw_nutrients_tsi(spark, d):
    """FN-W7 to FN-W12, FN-W15, FN-W29."""
    s = samples(spark, d)
    tp, chla, secchi, v = (F.col(c) for c in ("tp", "chla", "secchi", "v"))
    np_ = wq.np_molar_ratio(v, tp)
    parts = [wq.tsi_chla(chla), wq.tsi_tp(tp), wq.tsi_secchi(secchi)]
    return s.select("sample_id", _r(np_).alias("np"), wq.nutrient_regime(np_).alias("regime"), _r(wq.chla_tp_ratio(chla, tp)).alias("chla_tp"), wq.tp_status(tp).alias("status"), _r(parts[0]).alias("t_chla"), _r(parts[1]).alias("t_tp"), _r(parts[2]).alias("t_secchi"), _r(wq.mean_of(*parts)).alias("tsi"), wq.trophic_class(tp).alias("trophic"), _r(F.log1p(v)).alias("log_v"), _r(F.expm1(F.log1p(tp))).alias("back"))


@query("""WITH b AS (SELECT ok, ln AS line, disc - 0.03 AS blue, tax - 0.01 AS green, q / 100 AS red, (q + 3) / 110 AS re, (q - 4) / 300 AS nir FROM $obs),
t AS (SELECT *, least(greatest(610 * greatest(nir, 0) / greatest(1 - greatest(nir, 0) / 0.194, 0.05), 0), 500) AS turb, log10(greatest(blue, 1e-6) / greatest(green, 1e-6)) AS r, (re - red) / greatest(re + red, 1e-9) AS n FROM b),
c AS (SELECT *, least(greatest(pow(10, 0.366 - 3.067 * r + 1.93 * r * r + 0.649 * r * r * r), 0.01), 500) AS oc4, 14.039 + 86.115 * n + 194.325 * n * n AS n_chla FROM t)
SELECT ok, line, round(turb, 6) AS turb, round(oc4, 5) AS oc4, round(abs(least(greatest(-0.5 * ln(greatest(blue, 1e-6) / greatest(green, 1e-6)), 0), 20)), 6) AS cdom,
 round(least(greatest(1.7 / greatest(turb * 0.015 + 0.04, 0.1), 0.1), 40), 6) AS secchi, round(n, 6) AS ndci, round(n_chla, 5) AS n_chla, round(CASE WHEN n > -0.05 THEN n_chla ELSE oc4 END, 5) AS chla,
 round(least(1.7 / (greatest(turb, 0) * 0.015 + 0.04), 40), 6) AS secchi_t, CAST(blue < 0 AS INT) AS negative_blue FROM c""")
def fnw_bands(spark, d):
    """FN-W13, FN-W16 to FN-W18, FN-W20: band formulas with reflectances below zero among them, the flag of those, the index where it applies."""
    q = F.col("q")
    b = obs(spark, d).select("ok", F.col("ln").alias("line"), (F.col("disc") - 0.03).alias("blue"), (F.col("tax") - 0.01).alias("green"), (q / 100).alias("red"), ((q + 3) / 110).alias("re"), ((q - 4) / 300).alias("nir"))
    blue, green = F.col("blue"), F.col("green")
    turb, n, oc4 = wq.band_turbidity(F.col("nir")), wq.ndci(F.col("re"), F.col("red")), wq.band_chla(blue, green)
    out = {"turb": _r(turb), "oc4": _r(oc4, 5), "cdom": _r(F.abs(wq.band_cdom(blue, green))), "secchi": _r(wq.band_secchi(turb)), "ndci": _r(n), "n_chla": _r(wq.ndci_chla(n), 5)}
    out |= {"chla": _r(wq.chla_choice(n, oc4), 5), "secchi_t": _r(wq.secchi_from_turbidity(turb)), "negative_blue": wq.negative_blue(blue)}
    return b.select("ok", "line", *[c.alias(k) for k, c in out.items()])


@query("""SELECT ok, ln AS line, (ok & 56) = 0 AS clear_scene, (ok & 30) = 0 AS clear_patch, ok % 12 NOT IN (0, 1, 3, 7, 8, 9, 10, 11) AS scene_ok, (ok & 1) <> 0 AND (ok & 2) = 0 AND (ok & 12) = 0 AS water_ok,
 round(disc - tax, 6) AS cross_db, coalesce(-q > -10 AND disc < 2, false) AS ice, round(q * 200, 4) AS swe, CAST((sensor = 'A') AS INT) + CAST((q > 25) AS INT) AS n_sensors, (sensor = 'A' OR disc > 0.05) AS any_fail FROM $obs""")
def flt11_bit_masks(spark, d):
    """FLT-11, FLT-13, FN-W23, FN-W27, FN-W28."""
    bit = lambda m: F.col("ok").bitwiseAND(m)
    return obs(spark, d).select("ok", F.col("ln").alias("line"), (bit(56) == 0).alias("clear_scene"), (bit(30) == 0).alias("clear_patch"), wq.scene_clear(F.col("ok") % 12).alias("scene_ok"), ((bit(1) != 0) & (bit(2) == 0) & (bit(12) == 0)).alias("water_ok"), _r(wq.cross_ratio(F.col("disc"), F.col("tax"))).alias("cross_db"), wq.ice_flag(-F.col("q"), F.col("disc")).alias("ice"), _r(wq.snow_water(F.col("q")), 4).alias("swe"), wq.sensor_count(F.col("sensor") == "A", F.col("q") > 25).alias("n_sensors"), wq.any_flag(F.col("sensor") == "A", F.col("disc") > 0.05).alias("any_fail"))


@query("""WITH x AS (SELECT ok, ln, CASE WHEN ok % 29 = 0 THEN NULL ELSE ok % 12 END AS scene, ok * 173 % 8192 AS qa FROM $obs)
SELECT ok, ln AS line, scene NOT IN (0, 1, 3, 7, 8, 9, 10, 11) AS station_clear, scene NOT IN (3, 8, 9, 10) AS patch_clear, (qa & 1024) = 0 AND (qa & 2048) = 0 AS quality_clear FROM x""")
def flt12_scene_classes(spark, d):
    """FLT-12: scene classes that leave the surface in sight, for stations and for patches, and the older product's bits for clouds and cirrus."""
    scene, qa = F.when(F.col("ok") % 29 != 0, F.col("ok") % 12), F.col("ok") * 173 % 8192
    return obs(spark, d).select("ok", F.col("ln").alias("line"), wq.scene_clear(scene).alias("station_clear"), wq.scene_clear(scene, patch=True).alias("patch_clear"), wq.quality_clear(qa).alias("quality_clear"))


@query("""SELECT a.station_id, round(2 * 6371000 * asin(sqrt(pow(sin(radians(58 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(58)) * pow(sin(radians(15 - lon) / 2), 2))), 3) AS metres,
 'grid_' || CAST(round_even(lat, 0) AS INT) || '_' || CAST(round_even(lon, 0) AS INT) AS cell FROM $stations a""")
def fng_distance_cell(spark, d):
    """FN-G1, FN-G5."""
    la, lo = F.col("lat"), F.col("lon")
    return stations(spark, d).select("station_id", _r(geo.haversine(la, lo, F.lit(58.0), F.lit(15.0)), 3).alias("metres"), geo.cell_key(la, lo).alias("cell"))


@query(None)
def fng2_projections(spark, d):
    """FN-G2, FN-G4: planar coordinates; tests hold them against known points."""
    la, lo = F.col("lat"), F.col("lon")
    e, n = geo.transverse_mercator(la, lo)
    x, y = geo.laea(la, lo)
    return stations(spark, d).select("station_id", _r(e, 3).alias("easting"), _r(n, 3).alias("northing"), _r(x, 3).alias("laea_x"), _r(y, 3).alias("laea_y"))


@query("""SELECT sample_id, year(date) AS yr, month(date) AS mo, CASE WHEN month(date) BETWEEN 3 AND 5 THEN 'MAM' WHEN month(date) BETWEEN 6 AND 8 THEN 'JJA' WHEN month(date) BETWEEN 9 AND 11 THEN 'SON' ELSE 'DJF' END AS season,
 CAST(year(date) // 5 * 5 AS VARCHAR) || '-' || CAST(year(date) // 5 * 5 + 4 AS VARCHAR) AS period, CAST(floor((date - DATE '1995-01-01') / 28) AS BIGINT) AS bucket, date < DATE '1997-01-01' AS before_change, month(date) BETWEEN 5 AND 10 AS ice_free,
 CASE WHEN year(date) <= 1997 THEN 'A' WHEN year(date) <= 1999 THEN 'B' ELSE 'C' END AS product, replace(CAST(round(v, 2) AS VARCHAR), '.', ',') IS NOT NULL AS has_text, round(v, 2) AS parsed FROM $samples""")
def fnd_dates_text(spark, d):
    """FN-D1, FN-D3, FN-D4, FN-S1, FLT-6, PRJ-6, PRJ-9."""
    y, m = F.year("date"), F.month("date")
    five = F.floor(y / 5) * 5
    text = F.regexp_replace(F.round("v", 2).cast("decimal(18,2)").cast("string"), "\\.", ",")
    return samples(spark, d).select("sample_id", y.cast("long").alias("yr"), m.cast("long").alias("mo"), geo.season(m).alias("season"), F.concat_ws("-", five.cast("string"), (five + 4).cast("string")).alias("period"), F.floor(F.datediff("date", F.lit("1995-01-01").cast("date")) / 28).alias("bucket"), (F.col("date") < F.lit("1997-01-01").cast("date")).alias("before_change"), m.between(5, 10).alias("ice_free"), F.when(y <= 1997, "A").when(y <= 1999, "B").otherwise("C").alias("product"), text.isNotNull().alias("has_text"), F.round(F.expr("try_cast(replace(regexp_replace(cast(cast(round(v, 2) as decimal(18,2)) as string), '[.]', ','), ',', '.') as double)"), 2).alias("parsed"))


@query("""SELECT sample_id, CASE WHEN tp BETWEEN 5 AND 90 THEN tp END AS tp, CASE WHEN chla BETWEEN 1 AND 15 THEN chla END AS chla, CASE WHEN secchi BETWEEN 0.2 AND 6 THEN round(secchi, 6) END AS secchi FROM $samples WHERE v > 0""")
def flt1_range_screen(spark, d):
    """FLT-1, FLT-2, FLT-3: values outside physical limits to null."""
    limits = {"tp": (5, 90), "chla": (1, 15), "secchi": (0.2, 6)}
    s = samples(spark, d).where("v > 0")
    return s.select("sample_id", *[F.when(F.col(c).between(*lim), F.round(c, 6)).alias(c) for c, lim in limits.items()])


@query("""WITH b AS (SELECT nation, min(lat) + 2 AS a0, min(lat) + 4 AS a9, min(lon) + 2 AS b0, min(lon) + 4 AS b9 FROM $stations GROUP BY nation)
SELECT station_id, seg FROM $stations s WHERE lat BETWEEN 56 AND 68 AND EXISTS (SELECT 1 FROM b WHERE b.nation % 5 = 0 AND s.lat BETWEEN a0 - 0.05 AND a9 + 0.05 AND s.lon BETWEEN b0 - 0.05 AND b9 + 0.05)""")
def flt5_boxes(spark, d):
    """FLT-4, FLT-5: bounding box, and membership in any of several buffered boxes (one per nation group, at most 25: broadcast)."""
    s = stations(spark, d)
    b = s.where("nation % 5 = 0").groupBy("nation").agg((F.min("lat") + 2).alias("a0"), (F.min("lat") + 4).alias("a9"), (F.min("lon") + 2).alias("b0"), (F.min("lon") + 4).alias("b9")).drop("nation")
    inside = F.col("lat").between(F.col("a0") - 0.05, F.col("a9") + 0.05) & F.col("lon").between(F.col("b0") - 0.05, F.col("b9") + 0.05)
    return s.where(F.col("lat").between(56, 68)).join(F.broadcast(b), inside, "left_semi").select("station_id", "seg")


@query("""WITH u AS (SELECT CAST(c_custkey AS VARCHAR) AS id, 'a' AS src, 1 AS pr FROM customer UNION ALL SELECT CAST(s_suppkey * 3 AS VARCHAR) || '.0', 'b', 2 FROM supplier UNION ALL SELECT CAST(p_partkey * 2 AS VARCHAR), 'c', 3 FROM part),
n AS (SELECT regexp_replace(id, '\\.0$', '') AS id, src, pr FROM u) SELECT id, arg_min(src, pr) AS src FROM n GROUP BY id""")
def src5_station_union(spark, d):
    """SE-1, FN-S3: sources united by priority, ids normalised."""
    parts = [("customer", "c_custkey", 1, "a", ""), ("supplier", "s_suppkey", 3, "b", ".0"), ("part", "p_partkey", 2, "c", "")]
    u = None
    for i, (t, k, m, tag, end) in enumerate(parts):
        p = read(spark, d, t).select(F.concat((F.col(k) * m).cast("string"), F.lit(end)).alias("id"), F.lit(tag).alias("src"), F.lit(i).alias("pr"))
        u = p if u is None else u.unionByName(p)
    return u.withColumn("id", F.regexp_replace("id", "\\.0$", "")).groupBy("id").agg(F.min_by("src", "pr").alias("src"))


@query("""SELECT year(date) AS yr, count(*) AS n, round(sum(v), 2) AS total FROM $samples WHERE year(date) BETWEEN 1996 AND 1999 GROUP BY 1""")
def src1_yearly_scan(spark, d):
    """SRC-3: projected scan with the year tag and a pushed-down range of years."""
    o = read(spark, d, "orders").select("o_orderdate", "o_totalprice").where((F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp")) & (F.col("o_orderdate") < F.lit("2000-01-01").cast("timestamp")))
    return o.groupBy(F.year("o_orderdate").cast("long").alias("yr")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""SELECT sensor AS code, count(*) AS n, count(price) AS n_price, round(sum(CASE WHEN ln = 1 THEN price END), 2) AS first_lines FROM $obs GROUP BY 1""")
def src2_schema_drift(spark, d):
    """SRC-2: frames with different columns united by name, missing ones null."""
    o = obs(spark, d)
    a, b = o.where("ln = 1").select(F.col("sensor").alias("code"), "price", F.col("price").alias("p1")), o.where("ln <> 1").select(F.col("sensor").alias("code"), "price")
    return a.unionByName(b, allowMissingColumns=True).groupBy("code").agg(F.count("*").alias("n"), F.count("price").alias("n_price"), F.round(F.sum("p1"), 2).alias("first_lines"))


@query("""WITH m AS (SELECT median(tp) AS a, median(secchi) AS b FROM $samples) SELECT sample_id, coalesce(tp, a, 0) AS tp, round(coalesce(secchi, b, 0), 6) AS secchi FROM $samples, m""")
def imp3_median(spark, d):
    """IMP-3: column medians for what is missing, 0 if all is."""
    s = samples(spark, d)
    m = stats.percentiles(s, [], "tp", {"a": 0.5}).join(stats.percentiles(s, [], "secchi", {"b": 0.5}), F.lit(True), "full")  # one row
    return s.join(F.broadcast(m), F.lit(True), "left").select("sample_id", F.coalesce("tp", "a", F.lit(0.0)).alias("tp"), F.round(F.coalesce("secchi", "b", F.lit(0.0)), 6).alias("secchi"))


@query("""WITH e AS (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)
SELECT vec_id, round(avg(CASE WHEN i % 8 >= 4 THEN v END) - avg(CASE WHEN i % 8 < 4 THEN v END), 5) AS gx, round(avg(CASE WHEN i // 8 >= 4 THEN v END) - avg(CASE WHEN i // 8 < 4 THEN v END), 5) AS gy, round(avg(v), 5) AS mean,
 round(sum(CASE WHEN i % 8 BETWEEN 2 AND 5 AND i // 8 BETWEEN 2 AND 5 THEN v END), 4) AS centre, bool_and(v BETWEEN -3 AND 3) AS valid FROM e GROUP BY vec_id""")
def ag33_patch_gradient(spark, d):
    """AG-33, FN-A1, FLT-15: half-difference means of 8 x 8 patches, a centre crop, validity of all values."""
    e = read(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("p"))
    total = lambda keep: F.aggregate(F.filter("p", lambda v, i: keep(i)), F.lit(0.0), lambda s, x: s + x)
    col, row = (lambda i: i % 8), (lambda i: F.floor(i / 8))
    gx = (total(lambda i: col(i) >= 4) - total(lambda i: col(i) < 4)) / 32
    gy = (total(lambda i: row(i) >= 4) - total(lambda i: row(i) < 4)) / 32
    return e.select("vec_id", _r(gx, 5).alias("gx"), _r(gy, 5).alias("gy"), _r(total(lambda i: i >= 0) / 64, 5).alias("mean"), _r(total(lambda i: col(i).between(2, 5) & row(i).between(2, 5)), 4).alias("centre"), F.forall("p", lambda v: v.between(-3, 3)).alias("valid"))
