"""A synthetic scene: a camera circles a sphere on a plane. Closed-form poses and depth, as expressions over ranges."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import geometry as g

RADIUS, HEIGHT, SPHERE = 4.0, 1.5, 1.0


def frames(spark: SparkSession, n: int, fps: float = 30.0, seq_id: str = "demo") -> DataFrame:
    """seq_id, pos, i, t, camera, pose_valid, q_wxyz, tr of one full circle; up is +z."""
    a = F.col("id") * (2 * math.pi / n)
    staged = spark.range(n).select("id", F.array(RADIUS * F.cos(a), RADIUS * F.sin(a), F.lit(HEIGHT)).alias("tr"))
    eye = g.elements(F.col("tr"), 3)
    zero = F.lit(0.0)
    m, _ = g.look_at(eye, [zero, zero, F.lit(SPHERE)], [zero, zero, F.lit(1.0)])
    posed = staged.withColumn("m", F.array(*m))
    return posed.select(F.lit(seq_id).alias("seq_id"), F.col("id").alias("pos"), F.col("id").alias("i"), (F.col("id") / fps).alias("t"), F.lit("0").alias("camera"), F.lit(True).alias("pose_valid"), F.array(*g.matrix_to_quat(g.elements(F.col("m"), 9))).alias("q_wxyz"), "tr")


def cameras(spark: SparkSession, width: int, height: int, seq_id: str = "demo") -> DataFrame:
    focal = 0.9 * width
    return spark.createDataFrame([(seq_id, "0", "PINHOLE", width, height, [focal, focal, width / 2, height / 2])], "seq_id string, camera string, model string, width int, height int, params array<double>")


def depth_pixels(frames_: DataFrame, width: int, height: int) -> DataFrame:
    """seq_id, i, u, v, depth along the optical axis (NaN where a ray hits nothing); one row per pixel."""
    focal = 0.9 * width
    grid = frames_.select("seq_id", "i", "tr", F.array(*g.quat_to_matrix(g.elements(F.col("q_wxyz"), 4))).alias("m"), F.explode(F.sequence(F.lit(0), F.lit(width * height - 1))).alias("p"))
    u, v = (F.col("p") % width), F.floor(F.col("p") / width)
    ray = g.rotated(g.elements(F.col("m"), 9), [(u + 0.5 - width / 2) / focal, (v + 0.5 - height / 2) / focal, F.lit(1.0)])
    staged = grid.withColumn("ray", F.array(*ray)).select("seq_id", "i", u.cast("int").alias("u"), v.cast("int").alias("v"), "tr", "ray")
    d, o = g.elements(F.col("ray"), 3), g.elements(F.col("tr"), 3)
    c = [o[0], o[1], o[2] - SPHERE]
    a, b = g.dot(d, d), g.dot(d, c)
    inside = b * b - a * (g.dot(c, c) - SPHERE * SPHERE)
    sphere = F.when(inside >= 0, (-b - F.sqrt(F.greatest(inside, F.lit(0.0)))) / a)
    plane = F.when(d[2] < 0, -o[2] / d[2])
    near = F.least(F.when(sphere > 0, sphere), F.when(plane > 0, plane))
    return staged.select("seq_id", "i", "u", "v", F.coalesce(near, F.lit(float("nan"))).alias("depth"))
