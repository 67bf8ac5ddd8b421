"""The domain's tables as views of the given ones, the same in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: The same views for the SQL twins.
VIEWS = {
    "samples": "SELECT o_orderkey AS sample_id, o_custkey AS station_id, CAST(o_orderdate AS DATE) AS date, o_totalprice AS v, CAST(o_orderkey % 97 AS DOUBLE) AS tp, CAST(o_orderkey % 41 AS DOUBLE) / 2 AS chla, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_orderkey % 23 AS DOUBLE) / 3 + 0.1 END AS secchi FROM orders",
    "obs": "SELECT o_custkey AS station_id, CAST(l_shipdate AS DATE) AS obs_date, l_returnflag AS sensor, l_quantity AS q, l_extendedprice AS price, l_discount AS disc, l_tax AS tax, l_orderkey AS ok, l_linenumber AS ln FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "stations": "SELECT c_custkey AS station_id, 55 + (c_custkey * 37 % 1400) / CAST(100 AS DOUBLE) AS lat, 11 + (c_custkey * 53 % 1300) / CAST(100 AS DOUBLE) AS lon, CAST(c_custkey * 7919 % 100000 AS DOUBLE) * 10 AS x, CAST(c_custkey * 104729 % 100000 AS DOUBLE) * 10 AS y, c_acctbal AS bal, c_mktsegment AS seg, c_nationkey AS nation FROM customer",
    "daily": "SELECT o_custkey AS station_id, CAST(l_shipdate AS DATE) AS obs_date, sum(l_quantity) AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2",
    "readings": "SELECT event_id, user_id, ts, CAST(ts AS DATE) AS date, event_type, value, CASE event_type WHEN 'purchase' THEN 'R' WHEN 'click' THEN 'Y' ELSE 'G' END AS flag FROM events",
}


def query(sql: str | None):
    """Registers a function under its name, with its SQL twin; views that the SQL names are put before it."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            used, text = [], sql
            for name, body in VIEWS.items():
                if f"${name}" in text:
                    text = text.replace(f"${name}", name)
                    used.append(f"{name} AS ({body})")
            text = text.strip()
            if used:
                text = f"WITH {', '.join(used)}, {text[5:]}" if text.upper().startswith("WITH ") else f"WITH {', '.join(used)} {text}"
            SQL[f.__name__] = text
        return f

    return put


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _num(c: Column) -> Column:
    return c.cast("double")


def samples(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return read(spark, d, "orders").select(k.alias("sample_id"), F.col("o_custkey").alias("station_id"), F.to_date("o_orderdate").alias("date"), F.col("o_totalprice").alias("v"), _num(k % 97).alias("tp"), (_num(k % 41) / 2).alias("chla"), F.when(k % 7 != 0, _num(k % 23) / 3 + 0.1).alias("secchi"))


def obs(spark: SparkSession, d: str) -> DataFrame:
    """A task keeps its share of the orders, two numbers each, in a table by key, and does not sort the lines, which are four times as many and wider."""
    o = read(spark, d, "orders").select("o_orderkey", "o_custkey").hint("shuffle_hash")
    j = read(spark, d, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return j.select(F.col("o_custkey").alias("station_id"), F.to_date("l_shipdate").alias("obs_date"), F.col("l_returnflag").alias("sensor"), F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("disc"), F.col("l_tax").alias("tax"), F.col("l_orderkey").alias("ok"), F.col("l_linenumber").alias("ln"))


def stations(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return read(spark, d, "customer").select(k.alias("station_id"), (55 + k * 37 % 1400 / 100.0).alias("lat"), (11 + k * 53 % 1300 / 100.0).alias("lon"), (_num(k * 7919 % 100000) * 10).alias("x"), (_num(k * 104729 % 100000) * 10).alias("y"), F.col("c_acctbal").alias("bal"), F.col("c_mktsegment").alias("seg"), F.col("c_nationkey").alias("nation"))


def daily(spark: SparkSession, d: str) -> DataFrame:
    return obs(spark, d).groupBy("station_id", "obs_date").agg(F.sum("q").alias("q"))


def readings(spark: SparkSession, d: str) -> DataFrame:
    flag = F.when(F.col("event_type") == "purchase", "R").when(F.col("event_type") == "click", "Y").otherwise("G")
    return read(spark, d, "events").select("event_id", "user_id", "ts", F.to_date("ts").alias("date"), "event_type", "value", flag.alias("flag"))
