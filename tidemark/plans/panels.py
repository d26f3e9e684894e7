"""Panels over the driver's tables, and the same ones as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.axes import Section, Series

TICKS = Series("asset", "time", ("event_id",))
MONTHS = Section("time", "asset")
MONTHLY = Series("asset", "time")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each event: ``x`` has gaps, ``z`` also NaN, ``y`` few values, ``p`` is a price and ``v`` a volume."""
    e = table(spark, sf_dir, "events")
    i, value = F.col("event_id"), F.col("value")
    return e.select(
        F.col("user_id").alias("asset"), F.col("ts").alias("time"), "event_id",
        F.when(i % 23 != 0, value - 50.0).alias("x"),
        F.when(i % 19 == 0, F.lit(float("nan"))).when(i % 23 != 0, value - 50.0).alias("z"),
        ((i % 13) - 6).cast("double").alias("y"), (value + 1.0).alias("p"), ((i % 7) + 1).cast("double").alias("v"),
    )


TICKS_SQL = """t AS (SELECT user_id AS asset, ts AS time, event_id,
  CASE WHEN event_id % 23 <> 0 THEN value - 50.0 END AS x,
  CASE WHEN event_id % 19 = 0 THEN CAST('nan' AS DOUBLE) WHEN event_id % 23 <> 0 THEN value - 50.0 END AS z,
  CAST(event_id % 13 - 6 AS DOUBLE) AS y, value + 1.0 AS p, CAST(event_id % 7 + 1 AS DOUBLE) AS v FROM events)"""


def months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Month by supplier: mean price, quantity and the supplier's nation as its sector; ``x`` has gaps."""
    grouped = (
        table(spark, sf_dir, "lineitem").groupBy(F.date_trunc("month", "l_shipdate").cast("date").alias("time"), F.col("l_suppkey").alias("asset"))
        .agg((F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")) / F.count(F.lit(1)) / 100.0).alias("px"), F.sum("l_quantity").alias("volume"))
    )
    sectors = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("asset"), F.col("s_nationkey").alias("sector"))
    return grouped.join(sectors, "asset").withColumn("x", F.when(F.col("asset") % 7 != F.month("time") % 7, F.col("px")))


MONTHS_SQL = """m AS (SELECT time, asset, px, volume, s_nationkey AS sector, CASE WHEN asset % 7 <> month(time) % 7 THEN px END AS x FROM
  (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS time, l_suppkey AS asset, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100.0 AS px, sum(l_quantity) AS volume
   FROM lineitem GROUP BY 1, 2) g JOIN supplier ON s_suppkey = asset)"""


def days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day by event type: a dense panel of few assets."""
    return (
        table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("time"), F.col("event_type").alias("asset"))
        .agg((F.sum(F.round(F.col("value") * 10000).cast("long")) / F.count(F.lit(1)) / 10000.0 + 1.0).alias("px"), F.count(F.lit(1)).alias("volume"))
    )


DAYS_SQL = """d AS (SELECT CAST(ts AS DATE) AS time, event_type AS asset, CAST(sum(CAST(round(value * 10000) AS BIGINT)) AS DOUBLE) / count(*) / 10000.0 + 1.0 AS px, count(*) AS volume FROM events GROUP BY 1, 2)"""


def finite(x: Column, decimals: int = 6) -> Column:
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(F.round(x, decimals) + 0.0)


def kind(x: Column) -> Column:
    return F.when(x.isNull(), "null").when(F.isnan(x), "nan").when(x == float("inf"), "inf").when(x == float("-inf"), "-inf").otherwise("number")


def finite_sql(x: str, decimals: int = 6) -> str:
    return f"CASE WHEN isnan({x}) OR isinf({x}) THEN NULL ELSE round({x}, {decimals}) + 0.0 END"


def kind_sql(x: str) -> str:
    return f"CASE WHEN ({x}) IS NULL THEN 'null' WHEN isnan({x}) THEN 'nan' WHEN ({x}) = CAST('inf' AS DOUBLE) THEN 'inf' WHEN ({x}) = CAST('-inf' AS DOUBLE) THEN '-inf' ELSE 'number' END"
