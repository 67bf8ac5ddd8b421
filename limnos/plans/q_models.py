"""Queries of fitted models; SQL cannot express the fits, tests hold them against closed forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import models
from .tables import query, samples, stations

TIERS = {"static": ["lat", "lon", "bal"], "full": ["lat", "lon", "bal", "tp", "chla", "secchi"]}


def _table(spark, d):
    s = samples(spark, d).join(stations(spark, d).select("station_id", "lat", "lon", "bal"), "station_id")
    return s.select("sample_id", "lat", "lon", "bal", "tp", "chla", "secchi", F.log1p("v").alias("y"), (F.col("station_id") % 5).cast("int").alias("fold"))


@query(None)
def ml6_ablation(spark, d):
    """ML-2, ML-6: ridge by tier of features, out of fold by station, a fit for each."""
    return models.ablation(_table(spark, d), TIERS, ["ridge"], "y", "fold")


@query(None)
def ml8_importance(spark, d):
    """ML-4, ML-8: importances in boosted trees."""
    return models.importances(_table(spark, d), TIERS["full"], "y", "boosted", trees=10)


@query(None)
def ml9_fourier_ridge(spark, d):
    """ML-9, FN-A5: ridge on random Fourier features."""
    t = _table(spark, d).withColumns({"a": F.col("lat") - 60, "b": F.col("lon") - 15})
    return models.fourier_ridge(t, ["a", "b"], "y", "fold", dims=64, gamma=0.1).select("sample_id", "fold", "y", "prediction")


@query(None)
def gr5_spatial_forest(spark, d):
    """ML-3: a forest on covariates and coordinates, scored out of fold."""
    return models.ablation(_table(spark, d), {"spatial": TIERS["static"]}, ["forest"], "y", "fold", trees=20)


def _targets(spark, d):
    return _table(spark, d).withColumn("y2", F.when(F.col("sample_id") % 3 != 0, F.log1p("chla")))


def _scores(p):
    return p.select("target", "tier", "model", F.round("rmse", 3).alias("rmse"), F.round("r2", 6).alias("r2"), F.round("mae", 3).alias("mae"), "n")


@query("""WITH t AS (SELECT sample_id, lat, bal, secchi, ln(1 + v) AS y, CASE WHEN sample_id % 3 <> 0 THEN ln(1 + chla) END AS y2, s.station_id % 5 AS fold FROM $samples s JOIN $stations st ON s.station_id = st.station_id),
l AS (SELECT 'y' AS target, y, fold, lat, bal, secchi FROM t UNION ALL SELECT 'y2', y2, fold, lat, bal, secchi FROM t WHERE y2 IS NOT NULL),
f AS (SELECT target, y, fold, 'lat' AS tier, lat AS x FROM l UNION ALL SELECT target, y, fold, 'bal', bal FROM l UNION ALL SELECT target, y, fold, 'secchi', secchi FROM l),
g AS (SELECT f.target, f.tier, fold, y, coalesce(x, med) AS x, med FROM f JOIN (SELECT target, tier, median(x) AS med FROM f GROUP BY ALL) m ON f.target = m.target AND f.tier = m.tier),
k AS (SELECT target, tier, fold, count(*) AS n, sum(x - med) AS sx, sum(y) AS sy, sum((x - med) * (x - med)) AS sxx, sum((x - med) * y) AS sxy FROM g GROUP BY ALL),
r AS (SELECT a.target, a.tier, a.fold, sum(b.n) AS n, sum(b.sx) / sum(b.n) AS mx, sum(b.sy) / sum(b.n) AS my, sum(b.sxx) AS sxx, sum(b.sxy) AS sxy FROM k a JOIN k b ON a.target = b.target AND a.tier = b.tier AND a.fold <> b.fold GROUP BY ALL),
w AS (SELECT *, sxx - n * mx * mx AS cxx, sxy - n * mx * my AS cxy FROM r), v AS (SELECT *, cxy / (cxx + cxx / n) AS slope FROM w),
p AS (SELECT g.target, g.tier, exp(y) - 1 AS a, exp(my + slope * (x - med - mx)) - 1 AS b FROM g JOIN v ON g.target = v.target AND g.tier = v.tier AND g.fold = v.fold)
SELECT target, tier, 'ridge' AS model, round(sqrt(avg((a - b) * (a - b))), 3) AS rmse, round(1 - sum((a - b) * (a - b)) / (var_pop(a) * count(*)), 6) AS r2, round(avg(abs(a - b)), 3) AS mae, count(*) AS n FROM p GROUP BY 1, 2""")
def ml5_single_features(spark, d):
    """ML-5: ridge of one feature for each of three tiers and two targets, out of fold, from sums of products in one pass."""
    return _scores(models.ridge_ablation(_targets(spark, d), {c: [c] for c in ("lat", "bal", "secchi")}, ["y", "y2"], "fold"))


@query(None)
def ml5_one_pass(spark, d):
    """ML-5, ML-6: ridge for all tiers of features and both targets, out of fold by station, from one table of sums of products."""
    return _scores(models.ridge_ablation(_targets(spark, d), {"static": TIERS["static"], "full": ["lat", "lon", "bal", "tp", "secchi"]}, ["y", "y2"], "fold"))
