"""Readers of station files and sample records."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RECORD = "struct<sampleId:string, stationId:string, samplingDate:string, observations:array<struct<propertyCode:string, qualityCode:string, observationValues:array<struct<value:string, unit:string>>>>>"


def first_existing(spark: SparkSession, patterns: list[str]) -> str | None:
    """The first pattern that matches a path of any file system that Spark reads; None if none does."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for p in patterns:
        path = jvm.org.apache.hadoop.fs.Path(p)
        if path.getFileSystem(conf).globStatus(path):
            return p
    return None


def prefixed(df: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    """All columns but the keys renamed with a prefix."""
    return df.withColumnsRenamed({c: f"{prefix}{c}" for c in df.columns if c not in keys})


def read_first(spark: SparkSession, patterns: list[str], keys: list[str], prefix: str) -> DataFrame | None:
    """The first existing of several names, its columns prefixed; None if no file exists."""
    p = first_existing(spark, patterns)
    return None if p is None else prefixed(spark.read.parquet(p), keys, prefix)


def pick_column(columns: list[str], pattern: str, never: str = "quality", fallback: str | None = None) -> str | None:
    """The first column that matches `pattern` and does not hold `never`, else the first that holds `fallback`, else None."""
    ok = [c for c in columns if never not in c]
    return next((c for c in ok if re.search(pattern, c)), next((c for c in ok if fallback and fallback in c), None))


def station_readings(files: DataFrame, text: str = "text") -> DataFrame:
    """Readings of semicolon files, a row for each file: the lines after the one that begins with `datum`, with an hour column if its second name says so.
    Adds ts, value (decimal comma or point) and quality (G where missing); drops `text`. Lines with more fields than the header, without a date or without a number go, as do files without a header; null texts give none."""
    f = files.withColumn("l_", F.split(text, "\r?\n"))
    at = F.array_position(F.transform("l_", lambda x: F.lower(F.trim(x)).startswith("datum")), True)
    f = f.withColumn("h_", at).where("h_ > 0").withColumn("head_", F.split(F.element_at("l_", F.col("h_").cast("int")), ";"))
    hour = F.coalesce(F.lower(F.get("head_", F.lit(1))).rlike("tid|time|utc"), F.lit(False)) & (F.size("head_") > 2)
    f = f.select(*[c for c in files.columns if c != text], F.size("head_").alias("n_"), hour.alias("hour_"), F.explode(F.slice("l_", F.col("h_").cast("int") + 1, F.greatest(F.size("l_") - F.col("h_").cast("int"), F.lit(0)))).alias("line_"))
    f = f.withColumn("f_", F.split("line_", ";")).where(F.size("f_") <= F.col("n_"))
    i = F.when(F.col("hour_"), 2).otherwise(1)
    day = F.get("f_", F.lit(0))
    ts = F.when(F.col("hour_"), F.try_to_timestamp(F.concat_ws(" ", F.trim(day), F.trim(F.get("f_", F.lit(1)))))).otherwise(F.try_to_timestamp(F.substring(day, 1, 10), F.lit("yyyy-MM-dd")))
    value = F.regexp_replace(F.trim(F.get("f_", i)), ",", ".").try_cast("double")
    flag = F.trim(F.get("f_", i + 1))
    out = f.withColumns({"ts": ts, "value": value, "quality": F.when(F.length(flag) > 0, flag).otherwise("G")}).drop("n_", "hour_", "line_", "f_")
    return out.where("ts IS NOT NULL AND value IS NOT NULL")


def sample_values(records: DataFrame, json: str = "json") -> DataFrame:
    """Long form of nested sample records: sample_id, station_id, date, pos, code, value, unit, quality, from the first non-null entry of each observation. Broken records give no rows."""
    r = records.select(F.from_json(json, RECORD).alias("r")).where("r.sampleId IS NOT NULL")
    o = r.select(F.col("r.sampleId").alias("sample_id"), F.col("r.stationId").alias("station_id"), F.to_date("r.samplingDate").alias("date"), F.posexplode("r.observations").alias("pos", "o"))
    v = F.get(F.filter("o.observationValues", lambda x: x["value"].isNotNull()), F.lit(0))
    return o.select("sample_id", "station_id", "date", "pos", F.col("o.propertyCode").alias("code"), v["value"].alias("value"), v["unit"].alias("unit"), F.col("o.qualityCode").alias("quality"))


def sample_rows(long: DataFrame, names: dict[str, str]) -> DataFrame:
    """Wide rows: a column for each mapped code, the last of a repeated code wins; codes that are not mapped go. Values that are not numbers become null."""
    code = F.col("code")
    pick = lambda c: F.max_by(F.when(code == c, F.regexp_replace("value", ",", ".").try_cast("double")), F.when(code == c, F.col("pos")))
    return long.groupBy("sample_id", "station_id", "date").agg(*[pick(c).alias(n) for c, n in names.items()])


def open_columns(long: DataFrame, names: list[str]) -> DataFrame:
    """A map bio_{code} to the value as text (numbers in canonical form, other texts trimmed) of all codes but `names`; the last wins."""
    v = F.coalesce(F.col("value").try_cast("double").cast("string"), F.trim("value"))
    last = Window.partitionBy("sample_id", "code").orderBy(F.desc("pos"))
    kept = long.where(~F.col("code").isin(names)).withColumn("r_", F.row_number().over(last)).where("r_ = 1")
    return kept.groupBy("sample_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.concat(F.lit("bio_"), "code"), v)))).alias("bio"))


def latest(positions: Column) -> Column:
    """The struct with the greatest `from` in an array of structs."""
    return F.array_max(F.transform(positions, lambda p: F.struct(p["from"].alias("from"), p.alias("p"))))["p"]


def live_reading(records: Column, names: dict[str, str], sentinel: float = -9.0) -> list[Column]:
    """Renamed fields of the first of an array of maps; the sentinel becomes null."""
    first = F.get(records, F.lit(0))
    return [F.nullif(first[k], F.lit(sentinel)).alias(n) for k, n in names.items()]
