"""Sinks: partitioned tables that are filled in, result tables that are merged, columns that are filled back, dictionaries."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .readers import first_existing

#: Sensor families by file name, their blue band, their correction method: fixed values.
FAMILIES = ["sentinel1", "sentinel2", "sentinel3", "modis", "landsat"]
LEVELS = {"L2A": "sen2cor", "L1C": "toa"}


def write_parts(df: DataFrame, path: str, by: str = "year", force: bool = False, files: int = 8) -> None:
    """Partitions by `by`, each of up to `files` files, so that a large one is not written by one task. Those that exist stay, or with `force` are replaced; the rest of the table is untouched either way."""
    spark = df.sparkSession
    if not force and first_existing(spark, [f"{path}/{by}=*"]):
        there = spark.read.parquet(path).select(by).distinct()
        df = df.join(F.broadcast(there), by, "left_anti")  # a row for each partition
    rest = [c for c in df.columns if c != by]
    df.repartition(F.col(by), F.pmod(F.xxhash64(*rest), F.lit(files))).write.partitionBy(by).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def merge_results(old: DataFrame, new: DataFrame, keys: list[str], keep: str = "last") -> DataFrame:
    """Both tables with one row for each key: the new one with keep `last`, the old one with `first`. Repeats inside a table fall by their values."""
    both = old.withColumn("age_", F.lit(0)).unionByName(new.withColumn("age_", F.lit(1)))
    age = F.desc("age_") if keep == "last" else F.asc("age_")
    rest = [c for c in new.columns if c not in keys]
    w = Window.partitionBy(*keys).orderBy(age, *rest)
    return both.withColumn("r_", F.row_number().over(w)).where("r_ = 1").drop("r_", "age_")


def not_done(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """The work whose keys have no result yet."""
    return work.join(done.select(*keys).distinct(), keys, "left_anti")


def write_csv(df: DataFrame, path: str) -> None:
    """A result table as one CSV with a header; for reports, whose rows are few."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str, needed: list[str]) -> DataFrame:
    """The columns of `schema` of a CSV with a header, in any order; rows that lack one of `needed` go."""
    head = spark.read.option("header", True).csv(path)
    want = [c.strip().split(" ", 1) for c in schema.split(",")]
    return head.select(*[F.col(n).try_cast(t).alias(n) for n, t in want]).dropna(subset=needed)


def family(name: Column) -> Column:
    """Sensor family in a file's name, unknown if none."""
    out = F.when(F.contains(name, F.lit(FAMILIES[0])), FAMILIES[0])
    for f in FAMILIES[1:]:
        out = out.when(F.contains(name, F.lit(f)), f)
    return out.otherwise("unknown")


def backfill(df: DataFrame, kind: str, methods: dict[str, str], blue: str | None = None) -> tuple[DataFrame, bool]:
    """The table with the columns of today, and whether anything changed: the renamed water type, the flag of negative blue, the method. A second call changes nothing."""
    out = df
    if "owt_class" in out.columns and "owt_class_v1_provisional" not in out.columns:
        out = out.withColumnRenamed("owt_class", "owt_class_v1_provisional")
    if "rw_blue_negative_flag" not in out.columns:
        flag = F.coalesce(F.col(blue) < 0, F.lit(False)).cast("int") if blue in out.columns else F.lit(0)
        out = out.withColumn("rw_blue_negative_flag", flag)
    if "ac_method" not in out.columns:
        by_level = kind == "sentinel2" and "product_level" in out.columns
        levels = F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv])
        out = out.withColumn("ac_method", F.try_element_at(levels, F.col("product_level")) if by_level else F.lit(methods.get(kind, "unknown")))
    return out, out is not df


def backfill_path(spark: SparkSession, path: str, to: str, kind: str, methods: dict[str, str], blue: str | None = None, dry_run: bool = False) -> bool:
    """As `backfill`, to a new path, which the caller swaps in; nothing is written if nothing changed, or on a dry run (False)."""
    out, changed = backfill(spark.read.parquet(path), kind, methods, blue)
    if changed and not dry_run:
        out.write.mode("errorifexists").parquet(to)
    return changed and not dry_run


def with_metadata(df: DataFrame, about: dict[str, dict]) -> DataFrame:
    """Columns with units, valid range, method and error as field metadata, which Parquet keeps."""
    return df.select(*[F.col(c).alias(c, metadata=about[c]) if c in about else F.col(c) for c in df.columns])


def write_dictionary(spark: SparkSession, rows: list[dict], schema: str, path: str) -> None:
    """A small dictionary (channels, variables) as JSON lines."""
    spark.createDataFrame([tuple(r.values()) for r in rows], schema).coalesce(1).write.mode("overwrite").json(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster shares (spark.checkpoint.dir). Where that is unset, a local one is set on a local master; a cluster needs the setting."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        top = tempfile.mkdtemp(prefix="spark-scratch-")
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"
