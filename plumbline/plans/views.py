"""The driver's tables seen as captures, in Spark and as the same in SQL.

A user is a sequence, an event a pose record: its time is the seconds since the user's first event,
an ``error`` event is unposed, and the vector numbered ``event_id`` modulo the number of vectors gives
quaternion and translation. Nations are cameras, orders members of a corpus, line items raw codes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from plumbline.functions.text import micros


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.col("user_id").alias("seq_id"), micros(F.col("ts")).alias("us"), "event_type", "value")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq_id, pos, i, us, t, camera, pose_valid, event_id, event_type, value."""
    by = W.partitionBy("seq_id")
    return events(spark, sf_dir).select(
        "seq_id",
        (F.row_number().over(by.orderBy("us", "event_id")) - 1).cast("bigint").alias("pos"),
        F.col("event_id").alias("i"),
        "us",
        ((F.col("us") - F.min("us").over(by)).cast("double") / 1e6).alias("t"),
        (F.col("event_id") % 25).cast("int").alias("camera"),
        (F.col("event_type") != "error").alias("pose_valid"),
        "event_id",
        "event_type",
        "value",
    )


def posed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frames() with q_wxyz and tr."""
    e = table(spark, sf_dir, "embeddings")
    v = e.select(F.col("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    return (
        frames(spark, sf_dir)
        .withColumn("vec_id", F.col("event_id") % max(1, e.count()))
        .join(v, "vec_id")
        .withColumn("q_wxyz", F.slice("v", 1, 4))
        .withColumn("tr", F.slice("v", 5, 3))
        .drop("v", "vec_id")
    )


EVENTS_SQL = "ev AS (SELECT event_id, user_id AS seq_id, epoch_us(ts) AS us, event_type, value FROM events)"
FRAMES_SQL = (
    EVENTS_SQL
    + """, frames AS (
  SELECT seq_id, row_number() OVER (PARTITION BY seq_id ORDER BY us, event_id) - 1 AS pos, event_id AS i, us,
         CAST(us - min(us) OVER (PARTITION BY seq_id) AS DOUBLE) / 1e6 AS t, CAST(event_id % 25 AS INTEGER) AS camera,
         event_type <> 'error' AS pose_valid, event_id, event_type, value FROM ev)"""
)
POSED_SQL = (
    FRAMES_SQL
    + """, vec AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, (SELECT count(*) FROM embeddings) AS vectors FROM embeddings), posed AS (
  SELECT f.*, v[1] / sqrt(v[1]*v[1]+v[2]*v[2]+v[3]*v[3]+v[4]*v[4]) AS qw, v[2] / sqrt(v[1]*v[1]+v[2]*v[2]+v[3]*v[3]+v[4]*v[4]) AS qx,
         v[3] / sqrt(v[1]*v[1]+v[2]*v[2]+v[3]*v[3]+v[4]*v[4]) AS qy, v[4] / sqrt(v[1]*v[1]+v[2]*v[2]+v[3]*v[3]+v[4]*v[4]) AS qz,
         v[5] AS x, v[6] AS y, v[7] AS z FROM frames f JOIN vec ON vec_id = event_id % vectors), rot AS (
  SELECT *, 1-2*(qy*qy+qz*qz) AS m00, 2*(qx*qy-qw*qz) AS m01, 2*(qx*qz+qw*qy) AS m02, 2*(qx*qy+qw*qz) AS m10, 1-2*(qx*qx+qz*qz) AS m11,
         2*(qy*qz-qw*qx) AS m12, 2*(qx*qz-qw*qy) AS m20, 2*(qy*qz+qw*qx) AS m21, 1-2*(qx*qx+qy*qy) AS m22 FROM posed)"""
)
