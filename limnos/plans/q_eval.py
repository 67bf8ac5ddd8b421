"""Queries of evaluation: floors, rolling origins, calibration in training order, interval scores by class, reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import models, stats
from .q_cases import _PAIRS, _pairs
from .q_models import TIERS, _table
from .tables import obs, query, samples, stations

FOLDS = 5
LEVELS = [0.8, 0.9, 0.95]


def _r(c, n=4):
    return F.round(c, n)


def _cls(tp):
    return F.when(tp <= 10, "oligo").when(tp <= 35, "meso").otherwise("eu")


def _rows(spark, d):
    s = samples(spark, d)
    return s.select("sample_id", "station_id", F.year("date").alias("yr"), F.log1p("v").alias("y"), _cls(F.col("tp")).alias("cls"), (F.col("sample_id") % FOLDS).cast("int").alias("fold"), (F.col("sample_id") % 4 == 0).alias("ac_failed"))


_T = "t AS (SELECT sample_id, station_id, year(date) AS yr, ln(1 + v) AS y, CASE WHEN tp <= 10 THEN 'oligo' WHEN tp <= 35 THEN 'meso' ELSE 'eu' END AS cls, CAST(sample_id % 5 AS INT) AS fold, sample_id % 4 = 0 AS ac_failed FROM $samples), f AS (SELECT unnest(range(5)) AS fold)"
_FLOOR = f"WITH {_T}, own AS (SELECT f.fold, t.station_id, arg_max(y, sample_id) AS p FROM t, f WHERE t.fold <> f.fold GROUP BY 1, 2), g AS (SELECT f.fold, avg(y) AS m FROM t, f WHERE t.fold <> f.fold GROUP BY 1), p AS (SELECT t.*, exp(y) - 1 AS a, exp(coalesce(own.p, g.m)) - 1 AS b FROM t JOIN g ON t.fold = g.fold LEFT JOIN own ON own.fold = t.fold AND own.station_id = t.station_id)"
_SCORES = "count(*) AS n, round(sqrt(avg((a - b) * (a - b))), 3) AS rmse, round(1 - sum((a - b) * (a - b)) / (var_pop(a) * count(*)), 5) AS r2, round(avg(abs(a - b)), 3) AS mae"


def _scores(n=3):
    rmse, r2, mae, count = stats.metrics("a", "b")
    return [count, _r(rmse, n).alias("rmse"), _r(r2, 5).alias("r2"), _r(mae, n).alias("mae")]


def _floor(spark, d):
    p = models.station_floor(_rows(spark, d), "station_id", "fold", "sample_id", "y", FOLDS)
    return p.withColumns({"a": F.expm1("y"), "b": F.expm1("prediction")})


@query(_FLOOR + f" SELECT fold, {_SCORES} FROM p GROUP BY fold")
def ml1_station_floor(spark, d):
    """ML-1: the station's last label in training order, else the training mean, scored by fold on the original scale."""
    return _floor(spark, d).groupBy("fold").agg(*_scores())


@query(_FLOOR + f" SELECT ac_failed, {_SCORES} FROM p GROUP BY ac_failed")
def ev3_by_correction(spark, d):
    """EV-3: scores by the flag of the atmospheric correction."""
    return _floor(spark, d).groupBy("ac_failed").agg(*_scores())


_WINDOWS = [("95-96", 1995, 1996, 1997, 1998), ("95-98", 1995, 1998, 1999, 2001), ("95-50", 1995, 2050, 2051, 2052)]
_ROLES = f"WITH {_T}, w AS (SELECT * FROM (VALUES ('95-96', 1995, 1996, 1997, 1998), ('95-98', 1995, 1998, 1999, 2001), ('95-50', 1995, 2050, 2051, 2052)) v(win, a, b, c, d)), j AS (SELECT win, t.*, CASE WHEN yr BETWEEN a AND b THEN 'train' ELSE 'test' END AS role FROM t, w WHERE yr BETWEEN a AND b OR yr BETWEEN c AND d), k AS (SELECT win FROM j GROUP BY win HAVING count(*) FILTER (role = 'train') >= 50 AND count(*) FILTER (role = 'test') >= 10), r AS (SELECT j.* FROM j JOIN k ON j.win = k.win)"


@query(_ROLES + " SELECT win, role, count(*) AS n, min(yr) AS first_year, max(yr) AS last_year FROM r GROUP BY 1, 2")
def sp7_windows(spark, d):
    """SP-7: rolling-origin windows and roles, without those with fewer than 50 training or 10 test rows."""
    return models.rolling_roles(_rows(spark, d), "yr", _WINDOWS).groupBy("win", "role").agg(F.count("*").alias("n"), F.min("yr").cast("long").alias("first_year"), F.max("yr").cast("long").alias("last_year"))


@query(_ROLES + f", own AS (SELECT win, station_id, arg_max(y, sample_id) AS p FROM r WHERE role = 'train' GROUP BY 1, 2), g AS (SELECT win, avg(y) AS m FROM r WHERE role = 'train' GROUP BY 1), p AS (SELECT r.win, exp(y) - 1 AS a, exp(coalesce(own.p, g.m)) - 1 AS b FROM r JOIN g ON r.win = g.win LEFT JOIN own ON own.win = r.win AND own.station_id = r.station_id WHERE role = 'test') SELECT win, {_SCORES} FROM p GROUP BY win")
def ml7_rolling_floor(spark, d):
    """ML-7: the station floor fitted on each window's training years and scored on its test years."""
    p = models.rolling_floor(models.rolling_roles(_rows(spark, d), "yr", _WINDOWS), "station_id", "sample_id", "y")
    return p.withColumns({"a": F.expm1("y"), "b": F.expm1("prediction")}).groupBy("win").agg(*_scores())


@query(None)
def ml7_rolling_models(spark, d):
    """ML-7: ridge and a forest (20 trees) by window."""
    t = _table(spark, d).join(samples(spark, d).select("sample_id", F.year("date").alias("yr")), "sample_id")
    ridge = models.rolling_origin(t, TIERS["full"], "y", "yr", ["ridge"], _WINDOWS)
    return ridge.unionByName(models.rolling_origin(t, TIERS["full"], "y", "yr", ["forest"], _WINDOWS, trees=20))


@query(None)
def ml6_targets(spark, d):
    """ML-6: tiers of features x models x targets, out of fold by station: ridge in one pass, forests of 10 trees, 5 boosted trees for the first target."""
    t = _table(spark, d).withColumn("y2", F.log1p("chla"))
    tiers = {"static": TIERS["static"], "full": ["lat", "lon", "bal", "tp", "secchi"]}
    out = models.ridge_tiers(t, [], tiers, ["y", "y2"], "fold").groupBy("target", "tier").agg(*stats.metrics("y", "prediction")).withColumn("model", F.lit("ridge"))
    for target, kind, trees in (("y", "forest", 10), ("y2", "forest", 10), ("y", "boosted", 5)):
        out = out.unionByName(models.ablation(t, tiers, [kind], target, "fold", trees=trees).withColumn("target", F.lit(target)))
    return out.select("tier", "model", "rmse", "r2", "mae", "n", "target")


@query(None)
def ml9_fourier_tabular(spark, d):
    """ML-9: ridge on random Fourier features (64 entries) with tabular columns beside them."""
    t = _table(spark, d).withColumns({"a": F.col("lat") - 60, "b": F.col("lon") - 15, "c": F.col("tp") / 100})
    return models.fourier_ridge(t, ["a", "b"], "y", "fold", dims=64, gamma=0.1, tabular=["c", "secchi"]).select("sample_id", "fold", "y", "prediction")


def calibrated(spark, d):
    """(calibration rows, validation rows) of all folds with the class mean of the fold's fit rows: of the rows outside the fold in the order of sample_id, the last fifth (ten at least) calibrate, the others fit."""
    t = _rows(spark, d)
    cut = stats.calibration_cut(t, "fold", "sample_id", FOLDS)
    long = t.withColumnRenamed("fold", "own").join(F.broadcast(cut), F.lit(True))  # a row of cut for each fold
    role = F.when(F.col("own") == F.col("fold"), "val").when(F.col("sample_id") >= F.col("cut"), "cal").otherwise("fit")
    long = long.withColumn("role", role)
    means = long.where("role = 'fit'").groupBy("fold", "cls").agg(F.avg("y").alias("yhat"))
    met = long.where("role <> 'fit'").join(F.broadcast(means), ["fold", "cls"])
    return met.where("role = 'cal'"), met.where("role = 'val'")


_CAL = f"WITH {_T}, n AS (SELECT f.fold, count(*) AS n, greatest(10, floor(count(*) * 0.2)) AS held FROM t, f WHERE t.fold <> f.fold GROUP BY 1), o AS (SELECT f.fold, t.sample_id, t.y, t.cls, t.fold AS own, row_number() OVER (PARTITION BY f.fold, t.fold <> f.fold ORDER BY sample_id) AS r FROM t, f), l AS (SELECT o.*, CASE WHEN own = o.fold THEN 'val' WHEN r > n.n - n.held THEN 'cal' ELSE 'fit' END AS role FROM o JOIN n ON o.fold = n.fold), m AS (SELECT fold, cls, avg(y) AS yhat FROM l WHERE role = 'fit' GROUP BY 1, 2), z AS (SELECT l.*, yhat FROM l JOIN m ON l.fold = m.fold AND l.cls = m.cls), v AS (SELECT unnest([0.8, 0.9, 0.95]) :: DOUBLE AS level)"
_Q = "ceil(least(1.0, ceil((n + 1) * level) / CAST(n AS DOUBLE)) * (n - 1)) + 1"


@query(_CAL + " SELECT fold, role, count(*) AS n, min(sample_id) AS first_id, max(sample_id) AS last_id FROM l GROUP BY 1, 2")
def sp8_calibration_cut(spark, d):
    """SP-8: of each fold's training order the last fifth, ten rows at least, calibrates."""
    t = _rows(spark, d)
    cut = stats.calibration_cut(t, "fold", "sample_id", FOLDS)
    long = t.withColumnRenamed("fold", "own").join(F.broadcast(cut), F.lit(True))
    role = F.when(F.col("own") == F.col("fold"), "val").when(F.col("sample_id") >= F.col("cut"), "cal").otherwise("fit")
    return long.groupBy("fold", role.alias("role")).agg(F.count("*").alias("n"), F.min("sample_id").alias("first_id"), F.max("sample_id").alias("last_id"))


@query(_CAL + f""", c AS (SELECT fold, abs(y - yhat) AS s, row_number() OVER (PARTITION BY fold ORDER BY abs(y - yhat)) AS r, count(*) OVER (PARTITION BY fold) AS n FROM z WHERE role = 'cal'),
q AS (SELECT fold, level, s AS q FROM c, v WHERE r = {_Q}), a AS (SELECT z.fold, level, avg(CASE WHEN abs(y - yhat) <= q THEN 1.0 ELSE 0 END) AS picp, 2 * min(q) AS width FROM z JOIN q ON z.fold = q.fold WHERE role = 'val' GROUP BY 1, 2)
SELECT level, round(avg(picp), 5) AS picp, round(abs(avg(picp) - level), 5) AS ece, round(avg(width), 5) AS width, count(*) AS n_folds FROM a GROUP BY level""")
def ev5_split_conformal(spark, d):
    """EV-5: split conformal in training order: coverage, its error and the width, averaged over folds."""
    cal, val = calibrated(spark, d)
    q = stats.conformal_widths(cal.withColumn("s", F.abs(F.col("y") - F.col("yhat"))), ["fold"], "s", LEVELS)
    inside = F.when(F.abs(F.col("y") - F.col("yhat")) <= F.col("q"), 1.0).otherwise(0.0)
    a = val.join(F.broadcast(q), "fold").groupBy("fold", "level").agg(F.avg(inside).alias("picp"), (2 * F.min("q")).alias("width"))
    return a.groupBy("level").agg(_r(F.avg("picp"), 5).alias("picp"), _r(F.abs(F.avg("picp") - F.col("level")), 5).alias("ece"), _r(F.avg("width"), 5).alias("width"), F.count("*").alias("n_folds"))


_STRATA = _CAL + f""", c AS (SELECT abs(y - yhat) AS s, row_number() OVER (ORDER BY abs(y - yhat)) AS r, count(*) OVER () AS n FROM z WHERE role = 'cal'), q AS (SELECT level, s AS q FROM c, v WHERE r = {_Q}),
i AS (SELECT quantile_cont(exp(y) - 1, 0.75) - quantile_cont(exp(y) - 1, 0.25) AS iqr FROM z WHERE role = 'val'),
e AS (SELECT level, coalesce(cls, 'all') AS cls, count(*) AS n, avg(CASE WHEN abs(y - yhat) <= q THEN 1.0 ELSE 0 END) AS picp, min(2 * q) AS width, avg(2 * q + 2 / (1 - level) * (greatest(yhat - q - y, 0) + greatest(y - yhat - q, 0))) AS winkler FROM z, q WHERE role = 'val' GROUP BY GROUPING SETS ((level), (level, cls)) HAVING count(*) >= 5)"""


def _strata(spark, d):
    cal, val = calibrated(spark, d)
    q = stats.conformal_widths(cal.withColumn("s", F.abs(F.col("y") - F.col("yhat"))), [], "s", LEVELS)
    iqr = stats.percentiles(val.withColumn("x", F.expm1("y")), [], "x", {"a": 0.25, "b": 0.75}).select((F.col("b") - F.col("a")).alias("iqr"))
    low, high = F.col("yhat") - F.col("q"), F.col("yhat") + F.col("q")
    inside = F.when(F.abs(F.col("y") - F.col("yhat")) <= F.col("q"), 1.0).otherwise(0.0)
    rows = val.join(F.broadcast(q), F.lit(True)).withColumn("cls", F.explode(F.array(F.lit("all"), F.col("cls"))))  # a row of q for each level
    e = rows.groupBy("level", "cls").agg(F.count("*").alias("n"), F.avg(inside).alias("picp"), F.min(2 * F.col("q")).alias("width"), F.avg(stats.winkler(F.col("y"), low, high, 1 - F.col("level"))).alias("winkler")).where("n >= 5")
    return e.join(F.broadcast(iqr), F.lit(True))


@query(_STRATA + " SELECT level, cls, n, round(picp, 5) AS picp, round(width / coalesce(nullif(iqr, 0), 1), 9) AS pinaw, round(winkler, 4) AS winkler, round(abs(picp - level), 5) AS ece FROM e, i")
def ev6_by_class(spark, d):
    """EV-6: interval scores by class and over all, at each level; widths are divided by the quartile range, by 1 where that is 0."""
    return _strata(spark, d).select("level", "cls", "n", _r(F.col("picp"), 5).alias("picp"), _r(F.col("width") / F.coalesce(F.nullif(F.col("iqr"), F.lit(0.0)), F.lit(1.0)), 9).alias("pinaw"), _r(F.col("winkler")).alias("winkler"), _r(F.abs(F.col("picp") - F.col("level")), 5).alias("ece"))


@query(_STRATA + " SELECT level, round(max(picp) FILTER (cls = 'all'), 5) AS overall, round(max(picp) FILTER (cls = 'oligo'), 5) AS oligo, round(max(picp) FILTER (cls = 'meso'), 5) AS meso, round(max(picp) FILTER (cls = 'eu'), 5) AS eu FROM e WHERE level = 0.9 GROUP BY level")
def ev13_interval_report(spark, d):
    """EV-13: the report's rows of one level, a column for each class in its order."""
    p = _strata(spark, d).where("level = 0.9").groupBy("level").pivot("cls", ["all", "oligo", "meso", "eu"]).agg(F.max("picp"))
    return p.select("level", _r(F.col("all"), 5).alias("overall"), *[_r(F.col(c), 5).alias(c) for c in ("oligo", "meso", "eu")])


_TIERED = "WITH m AS (SELECT sensor AS target, CAST(ok % 3 AS INT) AS model, CAST(ok // 3 % 4 AS INT) AS tier, avg(q) AS r2 FROM $obs GROUP BY 1, 2, 3)"


def _tiered(spark, d):
    return obs(spark, d).groupBy(F.col("sensor").alias("target"), (F.col("ok") % 3).cast("int").alias("model"), (F.floor(F.col("ok") / 3) % 4).cast("int").alias("tier")).agg(F.avg("q").alias("r2"))


@query(_TIERED + ", s AS (SELECT model, tier, round(sum(r2), 6) AS total FROM m GROUP BY 1, 2) SELECT model, tier, total FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY total DESC, tier) AS r FROM s) WHERE r = 1")
def wn8_best_tier(spark, d):
    """WN-8: of each model the tier with the largest sum over targets, the first of equal ones."""
    s = _tiered(spark, d).groupBy("model", "tier").agg(_r(F.sum("r2"), 6).alias("total"))
    return s.groupBy("model").agg(F.max_by(F.struct("tier", "total"), F.struct("total", -F.col("tier"))).alias("b")).select("model", "b.tier", "b.total")


@query(_TIERED + """, s AS (SELECT model, tier, round(sum(r2), 6) AS total FROM m GROUP BY 1, 2), b AS (SELECT model, arg_max(tier, total) AS tier FROM s GROUP BY 1), g AS (SELECT target, max(r2) AS best FROM m GROUP BY 1),
p AS (SELECT target, model, arg_max(tier, r2) AS peak_tier, max(r2) AS peak FROM m GROUP BY 1, 2)
SELECT m.target, m.model, m.tier, round(m.r2 - g.best, 6) AS off, g.best - m.r2 <= 0.05 AS marked, CASE WHEN g.best - m.r2 > 0.05 AND p.peak - m.r2 > 0.05 THEN p.peak_tier END AS peak_tier FROM m JOIN b ON m.model = b.model AND m.tier = b.tier JOIN g ON m.target = g.target JOIN p ON m.target = p.target AND m.model = p.model""")
def wn9_peak_elsewhere(spark, d):
    """WN-9, EV-14: the shown tier's distance from the target's best, the mark within a tolerance, and the tier where the model peaks if it is another by more than that."""
    m, tol = _tiered(spark, d), 0.05
    total = m.groupBy("model", "tier").agg(_r(F.sum("r2"), 6).alias("total"))
    shown = total.groupBy("model").agg(F.max_by("tier", "total").alias("tier"))
    best = F.max("r2").over(Window.partitionBy("target"))
    own = Window.partitionBy("target", "model")
    peaks = m.withColumns({"best": best, "peak": F.max("r2").over(own), "at": F.max(F.struct("r2", "tier")).over(own)["tier"]})
    behind = F.col("best") - F.col("r2")
    elsewhere = F.when((behind > tol) & (F.col("peak") - F.col("r2") > tol), F.col("at"))
    return peaks.join(F.broadcast(shown), ["model", "tier"]).select("target", "model", "tier", _r(-behind, 6).alias("off"), (behind <= tol).alias("marked"), elsewhere.alias("peak_tier"))


@query("""WITH m AS (SELECT sensor AS target, CAST(ok % 3 AS INT) AS model, avg(q) AS r2, stddev_samp(q) AS rmse, avg(disc) AS mae FROM $obs GROUP BY 1, 2)
SELECT target, round(max(r2), 6) AS r2, round(min(rmse), 6) AS rmse, round(min(mae), 8) AS mae FROM m GROUP BY target""")
def ag35_best_metrics(spark, d):
    """AG-35: of each target the largest R2 and the least errors over its models."""
    m = obs(spark, d).groupBy(F.col("sensor").alias("target"), F.col("ok") % 3).agg(F.avg("q").alias("r2"), F.stddev_samp("q").alias("rmse"), F.avg("disc").alias("mae"))
    return m.groupBy("target").agg(_r(F.max("r2"), 6).alias("r2"), _r(F.min("rmse"), 6).alias("rmse"), _r(F.min("mae"), 8).alias("mae"))


_WANTED = [("A", "price", "true"), ("A", "price", "false"), ("N", "price", "true"), ("N", "q", "none"), ("R", "q", "all"), ("R", "q", "false")]


@query(f"""WITH {_PAIRS}, s AS (SELECT sensor, variable, coalesce(CAST(flag AS VARCHAR), 'all') AS flag, count(*) AS n, sqrt(avg((z - x) * (z - x))) AS rmse, avg(z - x) AS mbe FROM p GROUP BY GROUPING SETS ((sensor, variable), (sensor, variable, flag))),
w AS (SELECT * FROM (VALUES (1, 'A', 'price', 'true'), (2, 'A', 'price', 'false'), (3, 'N', 'price', 'true'), (4, 'N', 'q', 'none'), (5, 'R', 'q', 'all'), (6, 'R', 'q', 'false')) v(place, sensor, variable, flag))
SELECT w.place, w.sensor, w.variable, w.flag, CASE WHEN w.variable = 'q' THEN printf('%.2f', rmse) ELSE printf('%.1f', rmse) END AS rmse, CASE WHEN w.variable = 'q' THEN printf('%+.2f', mbe) ELSE printf('%+.1f', mbe) END AS mbe, replace(format('{{:,}}', n), ',', '{{,}}') AS n FROM w JOIN s ON s.sensor = w.sensor AND s.variable = w.variable AND s.flag = w.flag""")
def ev13_matchup_rows(spark, d):
    """EV-13: the wanted rows of the matchup report in their order, formatted by variable; rows without a result are left out."""
    e = F.col("z") - F.col("x")
    p = _pairs(spark, d).withColumn("flag", F.explode(F.array(F.lit("all"), F.col("flag").cast("string"))))
    g = p.groupBy("sensor", "variable", "flag").agg(F.count("*").alias("n_"), F.sqrt(F.avg(e * e)).alias("rmse_"), F.avg(e).alias("mbe_"))
    wanted = spark.createDataFrame([(i + 1, *w) for i, w in enumerate(_WANTED)], "place int, sensor string, variable string, flag string")
    fine = F.col("variable") == "q"
    text = lambda c, sign: F.when(fine, F.format_string(f"%{sign}.2f", c)).otherwise(F.format_string(f"%{sign}.1f", c))
    met = F.broadcast(wanted).join(g, ["sensor", "variable", "flag"])
    return met.select("place", "sensor", "variable", "flag", text("rmse_", "").alias("rmse"), text("mbe_", "+").alias("mbe"), F.regexp_replace(F.format_number("n_", 0), ",", "{,}").alias("n"))


@query(f"""WITH {_PAIRS}, s AS (SELECT variable, flag, corr(x, z) AS r, sqrt(avg((z - x) * (z - x))) AS rmse FROM p GROUP BY 1, 2) SELECT row_number() OVER (ORDER BY variable, flag) AS place, variable, CASE WHEN flag THEN 'failure' ELSE 'ok' END AS condition, round(r * r, 3) AS r2, round(rmse, 1) AS rmse FROM s""")
def ev13_correction_rows(spark, d):
    """EV-13: the rows of the correction report, in the order of tier and condition."""
    e = F.col("z") - F.col("x")
    g = _pairs(spark, d).groupBy("variable", "flag").agg(stats.correlation(F.col("x"), F.col("z")).alias("r"), F.sqrt(F.avg(e * e)).alias("rmse"))  # a row for each tier and condition
    place = F.row_number().over(Window.orderBy("variable", "flag")).cast("long")
    return g.select(place.alias("place"), "variable", F.when(F.col("flag"), "failure").otherwise("ok").alias("condition"), _r(F.col("r") * F.col("r"), 3).alias("r2"), _r(F.col("rmse"), 1).alias("rmse"))


@query(_TIERED + " SELECT target, round(max(r2), 6) AS most, round(min(r2), 6) AS least FROM m GROUP BY target")
def ag35_best_and_worst(spark, d):
    """AG-35: the best and the worst score of each target."""
    return _tiered(spark, d).groupBy("target").agg(_r(F.max("r2"), 6).alias("most"), _r(F.min("r2"), 6).alias("least"))
