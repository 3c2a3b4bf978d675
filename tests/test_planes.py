"""The synthetic scene, and planes made from it."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import geometry as g
from plumbline.operators import planes
from plumbline.sources import synthetic


def test_scene_depth_lies_on_surfaces(spark):
    frames = synthetic.frames(spark, 4)
    depth = synthetic.depth_pixels(frames, 16, 12)
    k = [F.lit(14.4), F.lit(14.4), F.lit(8.0), F.lit(6.0)]
    pose = g.pose(g.elements(F.col("q_wxyz"), 4), g.elements(F.col("tr"), 3))
    hit = depth.join(frames, ["seq_id", "i"]).where("NOT isnan(depth)")
    points = hit.select(F.array(*g.unproject(F.col("u") + 0.5, F.col("v") + 0.5, F.col("depth"), k, pose)).alias("p")).collect()
    assert len(points) > 200
    for r in points:
        x, y, z = r.p
        assert abs(z) < 1e-6 or abs(np.sqrt(x * x + y * y + (z - 1) ** 2) - 1) < 1e-6
    assert all(abs(np.linalg.norm(r.q_wxyz) - 1) < 1e-9 for r in frames.collect())


def test_planes(spark):
    raw = np.arange(24, dtype="<u2")
    df = spark.createDataFrame([("s", 3, "d", 6, 4, bytearray(raw.tobytes()))], "seq_id string, i long, signal_id string, w int, h int, codes binary")
    px = planes.pixels(df)
    assert [(r.v, r.u, r.raw) for r in px.orderBy("v", "u").collect()] == [(k // 6, k % 6, k) for k in range(24)]
    values = px.withColumn("value", F.when(F.col("raw") < 2, F.lit(float("nan"))).otherwise(F.col("raw").cast("double")))
    small = {(r.v, r.u): r.value for r in planes.box_downsample(values, ["seq_id", "i"], 2).collect()}
    assert len(small) == 6 and small[(0, 0)] == 6.5 and small[(0, 1)] == 5.5
    c = planes.coverage(values, ["seq_id"]).first()
    assert (c.covered, c.least, c.most) == (22 / 24, 2.0, 23.0)
    r = planes.near_far(values, ["seq_id"]).first()
    assert abs(r.near - 1.9) < 1e-9 and abs(r.far - 24.15) < 1e-9
    with pytest.raises(Exception, match="codes"):
        planes.pixels(df.withColumn("w", F.lit(5))).collect()
    assert planes.should_stream(1000, 640, 480, 1, 2 << 30) and not planes.should_stream(10, 640, 480, 1, 2 << 30)
