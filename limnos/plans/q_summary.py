"""Queries of aggregates, statistics, splits and scores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import stats, temporal
from .tables import daily, obs, query, readings, samples, stations


def _r(c, n=4):
    return F.round(c, n)


@query("""SELECT station_id, count(*) AS n, round(avg(tp), 4) AS tp, round(avg(chla), 4) AS chla, round(avg(secchi), 4) AS secchi, count(DISTINCT year(date)) AS years, min(year(date)) AS first_year, max(year(date)) AS last_year, round(arg_min(v, sample_id), 2) AS first_v FROM $samples GROUP BY 1""")
def ag1_station_parameters(spark, d):
    """AG-1, AG-16, AG-19, AG-20."""
    y = F.year("date").cast("long")
    return samples(spark, d).groupBy("station_id").agg(F.count("*").alias("n"), *[_r(F.avg(c)).alias(c) for c in ("tp", "chla", "secchi")], F.countDistinct(y).alias("years"), F.min(y).alias("first_year"), F.max(y).alias("last_year"), _r(F.min_by("v", "sample_id"), 2).alias("first_v"))


@query("""SELECT station_id, year(date) AS yr, count(*) AS n, round(avg(tp), 4) AS tp, round(avg(secchi), 4) AS secchi, round(sum(v), 2) AS v FROM $samples GROUP BY 1, 2""")
def ag2_annual_series(spark, d):
    """AG-2."""
    return samples(spark, d).groupBy("station_id", F.year("date").cast("long").alias("yr")).agg(F.count("*").alias("n"), _r(F.avg("tp")).alias("tp"), _r(F.avg("secchi")).alias("secchi"), _r(F.sum("v"), 2).alias("v"))


@query("""WITH l AS (SELECT 'tp' AS param, tp AS x FROM $samples UNION ALL SELECT 'chla', chla FROM $samples UNION ALL SELECT 'secchi', secchi FROM $samples)
SELECT param, count(x) AS n, round(100.0 * count(x) / count(*), 4) AS coverage, round(avg(x), 4) AS mean, round(stddev_samp(x), 4) AS sd, round(quantile_cont(x, 0.1), 4) AS p10, round(median(x), 4) AS med, round(quantile_cont(x, 0.9), 4) AS p90 FROM l GROUP BY param""")
def ag3_summary(spark, d):
    """AG-3, PV-2: wide to long, then one grouped pass and the percentiles from running counts."""
    long = samples(spark, d).select("sample_id", "tp", "chla", "secchi").unpivot("sample_id", ["tp", "chla", "secchi"], "param", "x")
    p = stats.percentiles(long, ["param"], "x", {"p10": 0.1, "med": 0.5, "p90": 0.9})
    out = long.groupBy("param").agg(F.count("x").alias("n"), _r(100.0 * F.count("x") / F.count("*")).alias("coverage"), _r(F.avg("x")).alias("mean"), _r(F.stddev_samp("x")).alias("sd"))
    return out.join(p, "param", "left").select(*out.columns, *[_r(F.col(c)).alias(c) for c in ("p10", "med", "p90")])


@query("""WITH p AS (SELECT CASE WHEN year(date) <= 1997 THEN 'pre' ELSE 'post' END AS period, tp FROM $samples),
a AS (SELECT median(tp) FILTER (period = 'pre') AS m0, median(tp) FILTER (period = 'post') AS m1, count(*) FILTER (period = 'pre') AS n_pre, count(*) FILTER (period = 'post') AS n_post, quantile_cont(tp, 0.75) FILTER (period = 'pre') - quantile_cont(tp, 0.25) FILTER (period = 'pre') AS iqr FROM p)
SELECT n_pre, n_post, round(m0, 4) AS med_pre, round(m1, 4) AS med_post, round(iqr, 4) AS iqr_pre, round((m1 - m0) / nullif(m0, 0) * 100, 4) AS step FROM a""")
def ag4_period_step(spark, d):
    """AG-4: medians of two periods, the first one's quartile range and the step in per cent; null where the first median is 0 or a period has no value."""
    s = samples(spark, d).withColumn("period", F.when(F.year("date") <= 1997, "pre").otherwise("post"))
    n = s.agg(*[F.count(F.when(F.col("period") == p, 1)).alias(f"n_{p}") for p in ("pre", "post")])
    q = stats.percentiles(s, ["period"], "tp", {"m": 0.5, "a": 0.25, "b": 0.75})
    pick = lambda p, c: F.max(F.when(F.col("period") == p, c))
    q = q.agg(pick("pre", F.col("m")).alias("m0"), pick("post", F.col("m")).alias("m1"), pick("pre", F.col("b") - F.col("a")).alias("iqr"))
    step = F.try_divide(F.col("m1") - F.col("m0"), F.col("m0")) * 100
    return n.join(F.broadcast(q), F.lit(True)).select("n_pre", "n_post", _r(F.col("m0")).alias("med_pre"), _r(F.col("m1")).alias("med_post"), _r(F.col("iqr")).alias("iqr_pre"), _r(step).alias("step"))  # one row


@query("""SELECT year(date) AS yr, count(*) AS n, round(median(tp), 4) AS med, round(quantile_cont(tp, 0.25), 4) AS p25, round(quantile_cont(tp, 0.75), 4) AS p75, round(100.0 * count(*) FILTER (tp < 8) / count(*), 4) AS below FROM $samples GROUP BY 1 HAVING count(*) >= 50""")
def ag5_annual_band(spark, d):
    """AG-5, AG-24: the yearly band of quartiles around the median and the share below a threshold, of years with fifty rows."""
    s = samples(spark, d).withColumn("yr", F.year("date").cast("long"))
    g = s.groupBy("yr").agg(F.count("*").alias("n"), _r(100.0 * F.count(F.when(F.col("tp") < 8, 1)) / F.count("*")).alias("below")).where("n >= 50")
    p = stats.percentiles(s, ["yr"], "tp", {"med": 0.5, "p25": 0.25, "p75": 0.75})
    return g.join(p, "yr", "left").select("yr", "n", *[_r(F.col(c)).alias(c) for c in ("med", "p25", "p75")], "below")


@query("""SELECT yr, cls, n, round(100.0 * n / sum(n) OVER (PARTITION BY yr), 4) AS share FROM (SELECT year(date) AS yr, CASE WHEN tp <= 8 THEN 'High' WHEN tp <= 42 THEN 'Mid' ELSE 'Bad' END AS cls, count(*) AS n FROM $samples GROUP BY 1, 2)""")
def ag6_class_share(spark, d):
    """AG-6, WN-11: shares of classes by year."""
    c = samples(spark, d).groupBy(F.year("date").cast("long").alias("yr"), F.when(F.col("tp") <= 8, "High").when(F.col("tp") <= 42, "Mid").otherwise("Bad").alias("cls")).agg(F.count("*").alias("n"))
    return c.withColumn("share", _r(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("yr"))))


@query("""WITH m AS (SELECT station_id, month(date) AS mo, avg(tp) AS t FROM $samples GROUP BY 1, 2), a AS (SELECT station_id, avg(t) FILTER (mo IN (6, 7, 8)) - avg(t) FILTER (mo IN (12, 1, 2)) AS amp FROM m GROUP BY 1)
SELECT seg, count(amp) AS n, round(avg(amp), 4) AS amp, round(median(amp), 4) AS med FROM a JOIN $stations s ON a.station_id = s.station_id GROUP BY seg""")
def ag22_amplitude(spark, d):
    """AG-22: station-month means to seasonal amplitude by class."""
    m = samples(spark, d).groupBy("station_id", F.month("date").alias("mo")).agg(F.avg("tp").alias("t"))
    part = lambda ms: F.avg(F.when(F.col("mo").isin(ms), F.col("t")))
    a = m.groupBy("station_id").agg((part([6, 7, 8]) - part([12, 1, 2])).alias("amp"))
    a = a.join(stations(spark, d).select("station_id", "seg"), "station_id")
    med = stats.percentiles(a, ["seg"], "amp", {"med": 0.5})
    return a.groupBy("seg").agg(F.count("amp").alias("n"), _r(F.avg("amp")).alias("amp")).join(med, "seg", "left").select("seg", "n", "amp", _r(F.col("med")).alias("med"))


@query("""WITH h AS (SELECT user_id, date_trunc('hour', ts) AS h, CAST(CAST(sum(CAST(value AS DECIMAL(18, 6))) AS DOUBLE) / count(value) AS DECIMAL(18, 8)) AS m FROM $readings GROUP BY 1, 2), e AS (SELECT user_id, unnest(generate_series(min(h), max(h), INTERVAL 1 HOUR)) AS h FROM h GROUP BY user_id)
SELECT e.user_id, count(*) AS bins, count(h.m) AS filled, round(CAST(sum(h.m) AS DOUBLE) / count(h.m), 4) AS mean FROM e LEFT JOIN h ON e.user_id = h.user_id AND e.h = h.h GROUP BY 1""")
def ag9_resample(spark, d):
    """AG-9, FN-D2: hourly bins, the empty ones restored from a full sequence. Sums are of decimals, so that their order does not matter."""
    total = F.sum(F.col("value").cast("decimal(18,6)")).cast("double")
    h = readings(spark, d).groupBy("user_id", F.date_trunc("hour", "ts").alias("h")).agg((total / F.count("value")).cast("decimal(18,8)").alias("m"))
    e = h.groupBy("user_id").agg(F.min("h").alias("a"), F.max("h").alias("b")).select("user_id", F.explode(F.sequence("a", "b", F.expr("interval 1 hour"))).alias("h"))
    return e.join(h, ["user_id", "h"], "left").groupBy("user_id").agg(F.count("*").alias("bins"), F.count("m").alias("filled"), _r(F.sum("m").cast("double") / F.count("m")).alias("mean"))


_BINS = " UNION ALL ".join(
    f"""SELECT '{step}' AS step, e.user_id, CAST({end} AS VARCHAR) AS bin, coalesce(n, 0) AS n, mean, med, coalesce(total, 0) AS total, hi FROM
(SELECT user_id, unnest(generate_series(min(date_trunc('{step}', ts)), max(date_trunc('{step}', ts)), INTERVAL 1 {step})) AS b FROM r GROUP BY 1) e
LEFT JOIN (SELECT user_id, date_trunc('{step}', ts) AS b, count(x) AS n, round(avg(x), 4) AS mean, round(median(x), 4) AS med, round(sum(x), 3) AS total, max(x) AS hi FROM r GROUP BY 1, 2) g ON g.user_id = e.user_id AND g.b = e.b"""
    for step, end in (("hour", "strftime(e.b, '%Y-%m-%d %H:%M:%S')"), ("day", "strftime(e.b, '%Y-%m-%d %H:%M:%S')"), ("month", "strftime(last_day(e.b), '%Y-%m-%d 00:00:00')"))
)


@query(f"WITH r AS (SELECT user_id, ts, CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS x FROM $readings) {_BINS}")
def ag9_steps(spark, d):
    """AG-9: series by hour, day and month, with empty bins: count, mean, median, sum and largest."""
    r = readings(spark, d).select("user_id", "ts", F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("x"))
    out = None
    for step in ("hour", "day", "month"):
        b = temporal.resample(r, ["user_id"], "ts", "x", step, ["count", "mean", "median", "sum", "max"])
        b = b.select(F.lit(step).alias("step"), "user_id", F.date_format("bin", "yyyy-MM-dd HH:mm:ss").alias("bin"), F.col("count").alias("n"), _r(F.col("mean")).alias("mean"), _r(F.col("median")).alias("med"), _r(F.col("sum"), 3).alias("total"), F.col("max").alias("hi"))
        out = b if out is None else out.unionByName(b)
    return out


@query("""SELECT 'year' AS unit, station_id, year(date) AS yr, 0 AS mo, count(secchi) AS n, round(avg(secchi), 4) AS mean, round(coalesce(sum(secchi), 0), 4) AS total, round(median(secchi), 4) AS med FROM $samples GROUP BY 2, 3
UNION ALL SELECT 'month', station_id, year(date), month(date), count(secchi), round(avg(secchi), 4), round(coalesce(sum(secchi), 0), 4), round(median(secchi), 4) FROM samples GROUP BY 2, 3, 4""")
def ag8_rollups(spark, d):
    """AG-8: mean, sum and median by station and year, and by station and month."""
    s = samples(spark, d).select("station_id", F.year("date").cast("long").alias("yr"), F.month("date").cast("long").alias("mo"), "secchi")
    of = lambda unit, rows: temporal.rollup(rows, ["station_id", "yr", "mo"], "secchi", ["count", "mean", "sum", "median"]).select(F.lit(unit).alias("unit"), "station_id", "yr", "mo", F.col("count").alias("n"), _r(F.col("mean")).alias("mean"), _r(F.col("sum")).alias("total"), _r(F.col("median")).alias("med"))
    return of("year", s.withColumn("mo", F.lit(0).cast("long"))).unionByName(of("month", s))


@query("""WITH s AS (SELECT station_id, count(DISTINCT year(date)) AS y FROM $samples GROUP BY 1) SELECT CAST(y AS BIGINT) AS bin, count(*) AS n FROM s GROUP BY 1""")
def ag18_record_length(spark, d):
    """AG-18: histogram of years with a record."""
    s = samples(spark, d).groupBy("station_id").agg(F.countDistinct(F.year("date")).alias("y"))
    return s.groupBy(F.width_bucket(F.col("y").cast("double"), F.lit(0.0), F.lit(26.0), F.lit(26).cast("int")).alias("b")).agg(F.count("*").alias("n")).select((F.col("b") - 1).alias("bin"), "n")


@query("""SELECT CAST(floor(lat / 0.15) AS BIGINT) AS cy, CAST(floor(lon / 0.15) AS BIGINT) AS cx, count(*) AS n, round(min(lat) - 0.02, 6) AS lat0, round(max(lat) + 0.02, 6) AS lat9, round(min(lon) - 0.02, 6) AS lon0, round(max(lon) + 0.02, 6) AS lon9 FROM $stations GROUP BY 1, 2""")
def ag30_station_boxes(spark, d):
    """AG-30."""
    b = 0.02
    return stations(spark, d).groupBy(F.floor(F.col("lat") / 0.15).alias("cy"), F.floor(F.col("lon") / 0.15).alias("cx")).agg(F.count("*").alias("n"), _r(F.min("lat") - b, 6).alias("lat0"), _r(F.max("lat") + b, 6).alias("lat9"), _r(F.min("lon") - b, 6).alias("lon0"), _r(F.max("lon") + b, 6).alias("lon9"))


@query("""SELECT nation, CAST(obs_date AS VARCHAR) AS date, count(*) FILTER (disc < 0.08) AS n_valid, round(1 - count(*) FILTER (disc < 0.08) / CAST(count(*) AS DOUBLE), 4) AS cloud, round(avg(q) FILTER (disc < 0.08), 4) AS mean, round(stddev_samp(q) FILTER (disc < 0.08), 4) AS sd, round(median(q), 4) AS med
FROM $obs o JOIN $stations s ON o.station_id = s.station_id GROUP BY 1, 2 HAVING count(*) FILTER (disc < 0.08) >= 2""")
def ag28_zonal(spark, d):
    """AG-28: zonal statistics of valid pixels with cloud fraction and minimum count, and the median of all pixels."""
    ok = F.when(F.col("disc") < 0.08, F.col("q"))
    j = obs(spark, d).join(stations(spark, d).select("station_id", "nation"), "station_id")
    j = j.withColumn("date", F.col("obs_date").cast("string"))
    g = j.groupBy("nation", "date").agg(F.count(ok).alias("n_valid"), _r(1 - F.count(ok) / F.count("*")).alias("cloud"), _r(F.avg(ok)).alias("mean"), _r(F.stddev_samp(ok)).alias("sd")).where("n_valid >= 2")
    return g.join(stats.percentiles(j, ["nation", "date"], "q", {"med": 0.5}), ["nation", "date"], "left").withColumn("med", _r(F.col("med")))


@query("""WITH g AS (SELECT nation, year(date) AS yr, avg(tp) AS x FROM $samples s JOIN $stations t ON s.station_id = t.station_id GROUP BY 1, 2)
SELECT yr, round(avg(x), 4) AS mean, round(stddev_pop(x), 4) AS sd, round(quantile_cont(x, 0.25), 4) AS p25, round(quantile_cont(x, 0.75), 4) AS p75, round(100.0 * count(x) / 25, 4) AS coverage FROM g GROUP BY yr""")
def ag31_grid_summary(spark, d):
    """AG-31: a grid's yearly mean, deviation, quartiles and coverage."""
    g = samples(spark, d).join(stations(spark, d).select("station_id", "nation"), "station_id").groupBy("nation", F.year("date").cast("long").alias("yr")).agg(F.avg("tp").alias("x"))
    p = stats.percentiles(g, ["yr"], "x", {"p25": 0.25, "p75": 0.75})
    a = g.groupBy("yr").agg(_r(F.avg("x")).alias("mean"), _r(F.stddev_pop("x")).alias("sd"), _r(100.0 * F.count("x") / 25).alias("coverage"))
    return a.join(p, "yr", "left").select("yr", "mean", "sd", _r(F.col("p25")).alias("p25"), _r(F.col("p75")).alias("p75"), "coverage")


@query("""WITH g AS (SELECT nation, avg(tp) FILTER (year(date) <= 1997) AS e, avg(tp) FILTER (year(date) >= 1999) AS l FROM $samples s JOIN $stations t ON s.station_id = t.station_id GROUP BY 1)
SELECT count(*) FILTER (l - e < -2) AS improved, count(*) FILTER (l - e > 2) AS worse, round(quantile_cont(abs(l - e), 0.95), 4) AS p95 FROM g""")
def ag32_change_map(spark, d):
    """AG-32: cells that changed between two periods, and the 95th percentile of changes."""
    y = F.year("date")
    g = samples(spark, d).join(stations(spark, d).select("station_id", "nation"), "station_id").groupBy("nation").agg((F.avg(F.when(y >= 1999, F.col("tp"))) - F.avg(F.when(y <= 1997, F.col("tp")))).alias("c"))
    p = stats.percentiles(g.withColumn("size", F.abs("c")), [], "size", {"p95": 0.95})
    return g.agg(F.count(F.when(F.col("c") < -2, 1)).alias("improved"), F.count(F.when(F.col("c") > 2, 1)).alias("worse")).join(F.broadcast(p), F.lit(True), "left").withColumn("p95", _r(F.col("p95")))  # one row


@query("""SELECT sensor, count(*) AS n, round(pow(corr(disc, tax), 2), 6) AS r2, round(sqrt(avg((tax - disc) * (tax - disc))), 6) AS rmse, round(avg(tax - disc), 6) AS bias, round(regr_slope(price, q), 4) AS slope, round(regr_intercept(price, q), 3) AS icept, round(regr_r2(ln(price), ln(q)), 6) AS log_r2 FROM $obs GROUP BY ROLLUP (sensor)""")
def st1_paired(spark, d):
    """ST-1: paired statistics and regressions by class and over all."""
    ln = lambda c: F.ln(F.col(c))
    n, r2, rmse, bias = stats.paired("disc", "tax")
    return obs(spark, d).rollup("sensor").agg(n, r2.alias("r2"), rmse.alias("rmse"), bias.alias("bias"), F.regr_slope("price", "q").alias("slope"), F.regr_intercept("price", "q").alias("icept"), F.regr_r2(ln("price"), ln("q")).alias("log_r2")).select("sensor", "n", _r(F.col("r2"), 6).alias("r2"), _r(F.col("rmse"), 6).alias("rmse"), _r(F.col("bias"), 6).alias("bias"), _r(F.col("slope")).alias("slope"), _r(F.col("icept"), 3).alias("icept"), _r(F.col("log_r2"), 6).alias("log_r2"))


@query("""WITH m AS (SELECT abs(o.obs_date - s.date) AS off, ln(o.q) AS a, ln(1 + s.tp) AS b FROM $samples s JOIN $obs o ON s.station_id = o.station_id AND abs(o.obs_date - s.date) <= 7)
SELECT CAST(w.w AS INT) AS w, count(*) AS n, round(pow(corr(a, b), 2), 6) AS r2 FROM (SELECT unnest(range(8)) AS w) w JOIN m ON m.off <= w.w GROUP BY 1 HAVING count(*) >= 5""")
def st10_window_sensitivity(spark, d):
    """ST-2, ST-10: one matchup at seven days, scored for tolerances of 0 to 7."""
    from ..operators.temporal import within_days

    m = within_days(samples(spark, d), obs(spark, d), ["station_id"], 7).select(F.abs("off").alias("off"), F.ln("q").alias("a"), F.log1p("tp").alias("b"))
    m = m.withColumn("w", F.explode(F.sequence(F.col("off"), F.lit(7))))
    return m.groupBy("w").agg(F.count("*").alias("n"), _r(F.pow(stats.correlation(F.col("a"), F.col("b")), F.lit(2.0)), 6).alias("r2")).where("n >= 5")


_PRED = "WITH t AS (SELECT s.station_id, s.sample_id, ln(1 + s.v) AS y, CASE WHEN s.tp <= 10 THEN 'oligo' WHEN s.tp <= 35 THEN 'meso' ELSE 'eu' END AS cls, CAST(s.sample_id % 5 AS INT) AS fold FROM $samples s), m AS (SELECT f.fold, t.cls, avg(y) AS yhat FROM t, (SELECT DISTINCT fold FROM t) f WHERE t.fold <> f.fold GROUP BY 1, 2), p AS (SELECT t.*, m.yhat FROM t JOIN m ON t.fold = m.fold AND t.cls = m.cls)"


def predictions(spark, d):
    """ML-1 and ML-5: out-of-fold class means as the floor model."""
    tp = F.col("tp")
    t = samples(spark, d).select("station_id", "sample_id", F.log1p("v").alias("y"), F.when(tp <= 10, "oligo").when(tp <= 35, "meso").otherwise("eu").alias("cls"), (F.col("sample_id") % 5).cast("int").alias("fold"))
    sums = t.groupBy("fold", "cls").agg(F.sum("y").alias("s"), F.count("*").alias("c"))
    all_ = Window.partitionBy("cls")
    m = sums.select("fold", "cls", ((F.sum("s").over(all_) - F.col("s")) / (F.sum("c").over(all_) - F.col("c"))).alias("yhat"))
    return t.join(m, ["fold", "cls"])


@query(_PRED + """ SELECT cls, count(*) AS n, round(sqrt(avg((y - yhat) * (y - yhat))), 6) AS rmse, round(1 - sum((y - yhat) * (y - yhat)) / (var_pop(y) * count(*)), 6) AS r2, round(avg(abs(y - yhat)), 6) AS mae FROM p GROUP BY ROLLUP (cls)""")
def ev1_metrics(spark, d):
    """EV-1, EV-2: error metrics by class and over all in one pass."""
    rmse, r2, mae, n = stats.metrics("y", "yhat")
    return predictions(spark, d).rollup("cls").agg(n, rmse, r2, mae).select("cls", "n", *[_r(F.col(c), 6).alias(c) for c in ("rmse", "r2", "mae")])


@query(_PRED + """, c AS (SELECT fold, abs(y - yhat) AS s, row_number() OVER (PARTITION BY fold ORDER BY abs(y - yhat)) AS r, count(*) OVER (PARTITION BY fold) AS n FROM p WHERE station_id % 2 = 0),
q AS (SELECT fold, level, s AS q FROM c, (VALUES (0.8), (0.9), (0.95)) v(level) WHERE r = ceil(least(1.0, ceil((n + 1) * CAST(level AS DOUBLE)) / CAST(n AS DOUBLE)) * (n - 1)) + 1)
SELECT p.fold, CAST(level AS DOUBLE) AS level, round(min(q), 6) AS q, round(avg(CASE WHEN abs(y - yhat) <= q THEN 1.0 ELSE 0 END), 6) AS picp, round(avg(2 * q + 2 / (1 - CAST(level AS DOUBLE)) * (greatest(yhat - q - y, 0) + greatest(y - yhat - q, 0))), 5) AS winkler FROM p JOIN q ON p.fold = q.fold WHERE station_id % 2 = 1 GROUP BY 1, 2""")
def ev5_conformal(spark, d):
    """EV-8, EV-11: split conformal by fold, calibrated on half of the stations: order statistic, coverage, interval score."""
    p = predictions(spark, d)
    cal = p.where("station_id % 2 = 0").withColumn("s", F.abs(F.col("y") - F.col("yhat")))
    q = stats.conformal_widths(cal, ["fold"], "s", [0.8, 0.9, 0.95])
    j = p.where("station_id % 2 = 1").join(F.broadcast(q), "fold")  # a row for each fold and level
    low, high = F.col("yhat") - F.col("q"), F.col("yhat") + F.col("q")
    inside = F.when(F.abs(F.col("y") - F.col("yhat")) <= F.col("q"), 1.0).otherwise(0.0)
    return j.groupBy("fold", "level").agg(_r(F.min("q"), 6).alias("q"), _r(F.avg(inside), 6).alias("picp"), _r(F.avg(stats.winkler(F.col("y"), low, high, 1 - F.col("level"))), 5).alias("winkler"))


@query("""WITH g AS (SELECT station_id, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, station_id) - 1 AS r FROM $samples GROUP BY 1)
SELECT CAST(CASE WHEN r // 5 % 2 = 0 THEN r % 5 ELSE 4 - r % 5 END AS INT) AS fold, count(*) AS n_groups, CAST(sum(n) AS BIGINT) AS n_rows FROM g GROUP BY 1""")
def sp5_group_folds(spark, d):
    """SP-5, SP-11: groups dealt over folds by size, counted."""
    f = stats.group_folds(samples(spark, d), "station_id")
    return f.groupBy("fold").agg(F.count("*").alias("n_groups"), F.sum("n_rows").alias("n_rows"))


@query("""WITH k AS (SELECT station_id, coalesce(CASE WHEN station_id % 3 = 0 THEN 'lake_' || nation END, CASE WHEN station_id % 3 = 1 THEN 'basin_' || seg END, 'grid_' || CAST(round_even(lat, 0) AS INT) || '_' || CAST(round_even(lon, 0) AS INT)) AS fold_key, CASE WHEN lat < 61 THEN 'south' ELSE 'north' END AS lat_split FROM $stations)
SELECT fold_key, count(*) AS n, count(*) FILTER (lat_split = 'north') AS north, count(*) FILTER (year(s.date) <= 1998) AS train FROM k JOIN $samples s ON k.station_id = s.station_id GROUP BY 1""")
def sp1_fold_keys(spark, d):
    """SP-1, SP-3, SP-4: fold keys by the first that applies, temporal and latitudinal splits; a null latitude is north."""
    from ..functions.geo import cell_key

    k = F.col("station_id")
    key = F.coalesce(F.when(k % 3 == 0, F.concat(F.lit("lake_"), F.col("nation").cast("string"))), F.when(k % 3 == 1, F.concat(F.lit("basin_"), F.col("seg"))), cell_key(F.col("lat"), F.col("lon")))
    s = stations(spark, d).select("station_id", key.alias("fold_key"), F.coalesce(F.col("lat") >= 61, F.lit(True)).alias("north"))
    j = samples(spark, d).join(s, "station_id")
    return j.groupBy("fold_key").agg(F.count("*").alias("n"), F.count(F.when(F.col("north"), 1)).alias("north"), F.count(F.when(F.year("date") <= 1998, 1)).alias("train"))


@query("""WITH w AS (SELECT * FROM (VALUES ('a', 1996, 1998), ('b', 1997, 1999), ('c', 1998, 2001)) v(win, train_to, val_to)), j AS (SELECT win, CASE WHEN year(date) <= train_to THEN 'train' ELSE 'val' END AS role, tp FROM $samples, w WHERE year(date) <= val_to)
SELECT win, role, count(*) AS n, round(avg(tp), 4) AS tp FROM j GROUP BY 1, 2""")
def sp7_rolling_origin(spark, d):
    """SP-7: rolling-origin windows and roles."""
    w = F.explode(F.array(*[F.struct(F.lit(a).alias("win"), F.lit(t).alias("train_to"), F.lit(v).alias("val_to")) for a, t, v in (("a", 1996, 1998), ("b", 1997, 1999), ("c", 1998, 2001))]))
    s = samples(spark, d).select(F.year("date").alias("y"), "tp", w.alias("w")).where(F.col("y") <= F.col("w.val_to"))
    return s.groupBy(F.col("w.win").alias("win"), F.when(F.col("y") <= F.col("w.train_to"), "train").otherwise("val").alias("role")).agg(F.count("*").alias("n"), _r(F.avg("tp")).alias("tp"))


@query("""WITH m AS (SELECT sensor, ok % 3 AS model, avg(q) AS score FROM $obs GROUP BY 1, 2) SELECT sensor, model, round(score, 6) AS score, round(score - max(score) OVER (PARTITION BY sensor), 6) AS off, score = max(score) OVER (PARTITION BY sensor) AS best FROM m""")
def wn9_best_per_target(spark, d):
    """WN-9: deviation from the best of a group, and the mark."""
    m = obs(spark, d).groupBy("sensor", (F.col("ok") % 3).alias("model")).agg(F.avg("q").alias("score"))
    top = F.max("score").over(Window.partitionBy("sensor"))
    return m.select("sensor", "model", _r(F.col("score"), 6).alias("score"), _r(F.col("score") - top, 6).alias("off"), (F.col("score") == top).alias("best"))


@query("""SELECT s.station_id, nation FROM $stations s JOIN (SELECT nation AS k, count(*) AS n FROM $stations GROUP BY 1 HAVING count(*) > 5) g ON s.nation = g.k""")
def flt10_multi_member(spark, d):
    """FLT-10: members of groups with more than five."""
    s = stations(spark, d)
    g = s.groupBy(F.col("nation").alias("k")).agg(F.count("*").alias("n")).where("n > 5")
    return s.join(g, F.col("nation") == F.col("k"), "left_semi").select("station_id", "nation")
