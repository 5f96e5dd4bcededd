"""Views of the driver's tables as perception data, with integer millimetres and micro-weights.

Every view is stated twice: as a DataFrame, and as a SQL common table expression for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Orders in a frame: the number of frames grows with the data.
ORDERS_PER_FRAME = 250


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame, pt (place in the frame), x_mm, y_mm, z_mm, cls (0..15), w_micro, gt (0..8, -1 excluded), pred (0..8, -2, -1)."""
    line = table(spark, sf_dir, "lineitem")
    tax = F.round(F.col("l_tax") * 100).cast("long")
    line = line.select(
        F.floor(F.col("l_orderkey") / ORDERS_PER_FRAME).cast("int").alias("frame"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice",
        ((F.col("l_partkey") - 1000) * 50).alias("x_mm"),
        ((F.col("l_suppkey") - 50) * 500).alias("y_mm"),
        ((F.col("l_quantity").cast("long") - 25) * 100).alias("z_mm"),
        F.pmod(F.col("l_partkey") + F.col("l_linenumber"), F.lit(16)).cast("int").alias("cls"),
        (1_000_000 - F.round(F.col("l_discount") * 100).cast("long") * 10_000).alias("w_micro"),
        F.when(F.pmod("l_suppkey", F.lit(10)) == 0, -1).otherwise(F.pmod(F.col("l_partkey") + F.col("l_linenumber") + F.pmod(tax, F.lit(2)), F.lit(9))).cast("int").alias("gt"),
    )
    order = W.partitionBy("frame").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    pred = F.when(F.col("cls") == 11, -2).when(F.col("cls") == 13, -1).otherwise(F.pmod("cls", F.lit(9))).cast("int")
    return line.withColumn("pt", F.row_number().over(order)).select("frame", "pt", "x_mm", "y_mm", "z_mm", "cls", "w_micro", "gt", pred.alias("pred"))


POINTS = """points AS (
  SELECT *, CAST(CASE WHEN cls = 11 THEN -2 WHEN cls = 13 THEN -1 ELSE cls % 9 END AS INTEGER) AS pred FROM (
    SELECT CAST(floor(l_orderkey / 250) AS INTEGER) AS frame,
      CAST(row_number() OVER (PARTITION BY CAST(floor(l_orderkey / 250) AS INTEGER)
           ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS INTEGER) AS pt,
      (l_partkey - 1000) * 50 AS x_mm, (l_suppkey - 50) * 500 AS y_mm, (CAST(l_quantity AS BIGINT) - 25) * 100 AS z_mm,
      CAST((l_partkey + l_linenumber) % 16 AS INTEGER) AS cls,
      1000000 - CAST(round(l_discount * 100) AS BIGINT) * 10000 AS w_micro,
      CAST(CASE WHEN l_suppkey % 10 = 0 THEN -1
           ELSE (l_partkey + l_linenumber + CAST(round(l_tax * 100) AS BIGINT) % 2) % 9 END AS INTEGER) AS gt
    FROM lineitem))"""


def key_sql(x: str, y: str, z: str, size: int) -> str:
    """The SQL of geometry.voxel_key()."""
    parts = [f"((CAST(floor({v} / {float(size)}) AS BIGINT) + 1048576) & 2097151)" for v in (x, y, z)]
    return f"(({parts[0]} << 42) | ({parts[1]} << 21) | {parts[2]})"


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, user_id, event_type, t_us (microseconds since 1970), v_cent of events."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.select("event_id", "user_id", "event_type", F.unix_micros("ts").alias("t_us"), F.round(F.col("value") * 100).cast("long").alias("v_cent"))


TICKS = """ticks AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS t_us, CAST(round(value * 100) AS BIGINT) AS v_cent FROM events)"""


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, event_type, frame (six-hour index), stamp_us, right, base, late: one observation per frame of a track."""
    t = ticks(spark, sf_dir).withColumn("frame", F.floor((F.col("t_us") - 1_704_067_200_000_000) / 21_600_000_000).cast("int"))
    return t.groupBy("user_id", "event_type", "frame").agg(
        F.min("t_us").alias("stamp_us"), F.sum("v_cent").alias("v"), F.min("event_id").alias("event_id")
    ).select("user_id", "event_type", "frame", "stamp_us", (F.pmod("v", F.lit(3)) > 0).alias("base"), (F.pmod("v", F.lit(4)) > 0).alias("temporal"))


TRACKS = f"""{TICKS}, tracks AS (
  SELECT user_id, event_type, CAST(floor((t_us - 1704067200000000) / 21600000000) AS INTEGER) AS frame, min(t_us) AS stamp_us,
         sum(v_cent) % 3 > 0 AS base, sum(v_cent) % 4 > 0 AS temporal
  FROM ticks GROUP BY 1, 2, 3)"""


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, t, x, y: where and when each frame was taken, on a walk over the scene that returns to its places."""
    frame = points(spark, sf_dir).select(F.col("frame").cast("long").alias("frame")).distinct()
    return frame.select(F.col("frame").alias("id"), F.col("frame").alias("t"), (F.pmod(F.col("frame") * 7919, F.lit(80)) * 1000).alias("x"), (F.pmod(F.col("frame") * 31, F.lit(40)) * 1000).alias("y"))


PLACES = """places AS (SELECT DISTINCT CAST(frame AS BIGINT) AS id, (CAST(frame AS BIGINT) * 7919) % 80 * 1000 AS x, (CAST(frame AS BIGINT) * 31) % 40 * 1000 AS y FROM points),
loops AS (SELECT a.id AS i, b.id AS j FROM places a JOIN places b ON b.id > a.id + 3 WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) < 900000000)"""
