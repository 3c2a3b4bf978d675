"""Column functions against numpy."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import geometry as g
from plumbline.functions import text, values


def quats(n=200, seed=0):
    q = np.random.default_rng(seed).normal(size=(n, 4))
    q[:4] = [[0, 1, 0, 0], [0, 0, 1, 0], [0, 0, 0, 1], [1, 0, 0, 0]]
    return q / np.linalg.norm(q, axis=1)[:, None]


def rot(q):
    w, x, y, z = q
    return np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]])


@pytest.fixture(scope="module")
def rows(spark):
    q, t = quats(), np.random.default_rng(1).normal(size=(200, 3))
    data = [(i, [float(v) for v in a], [float(v) for v in b]) for i, (a, b) in enumerate(zip(q, t, strict=True))]
    return q, t, spark.createDataFrame(data, "i int, q array<double>, t array<double>").cache()


def test_quaternion_matrix_and_back(rows):
    q, _, df = rows
    m = df.select("i", F.array(*g.quat_to_matrix(g.scaled(g.elements(F.col("q"), 4), F.lit(3.0)))).alias("m"))
    got = m.select("i", "m", F.array(*g.matrix_to_quat(g.elements(F.col("m"), 9))).alias("b")).orderBy("i").collect()
    for r, a in zip(got, q, strict=True):
        assert np.allclose(np.reshape(r.m, (3, 3)), rot(a), atol=1e-12)
        assert r.b[0] >= 0 and min(np.abs(r.b - a).max(), np.abs(np.array(r.b) + a).max()) < 1e-9


def test_inverse_and_flip(rows):
    q, t, df = rows
    pose = g.pose(g.elements(F.col("q"), 4), g.elements(F.col("t"), 3))
    m, tr = g.inverse(pose)
    got = df.select("i", F.array(*m).alias("m"), F.array(*tr).alias("tr"), F.array(*g.flip_gl_cv(g.flip_gl_cv(pose[0]))).alias("f")).orderBy("i").collect()
    for r, a, b in zip(got, q, t, strict=True):
        assert np.allclose(r.tr, -rot(a).T @ b) and np.allclose(np.reshape(r.m, (3, 3)), rot(a).T) and np.allclose(np.reshape(r.f, (3, 3)), rot(a))


def test_slerp(rows, spark):
    q, _, _ = rows
    pairs = [(i, [float(v) for v in q[i]], [float(v) for v in (q[i + 1] if i % 3 else q[i] + 1e-4)], u) for i in range(150) for u in (0.0, 0.3, 1.0)]
    df = spark.createDataFrame(pairs, "i int, a array<double>, b array<double>, u double")
    got = df.select("*", F.array(*g.slerp(g.elements(F.col("a"), 4), g.elements(F.col("b"), 4), F.col("u"))).alias("s")).collect()
    for r in got:
        a, b = np.array(r.a) / np.linalg.norm(r.a), np.array(r.b) / np.linalg.norm(r.b)
        b = -b if a @ b < 0 else b
        c = min(1.0, a @ b)
        th = math.acos(c)
        want = (1 - r.u) * a + r.u * b if c > 0.9995 else (math.sin((1 - r.u) * th) * a + math.sin(r.u * th) * b) / math.sin(th)
        assert np.allclose(r.s, want / np.linalg.norm(want), atol=1e-9)


def test_intrinsics_and_unprojection(spark):
    df = spark.createDataFrame([("PINHOLE", [1.0, 2.0, 3.0, 4.0]), ("RADIAL", [5.0, 6.0, 7.0, 0.1, 0.2]), ("SIMPLE_PINHOLE", [5.0, 6.0, 7.0]), ("NONE", [1.0])], "model string, params array<double>")
    got = [tuple(r) for r in df.select(*g.intrinsics(F.col("model"), F.col("params"))).collect()]
    assert got == [(1, 2, 3, 4), (5, 5, 6, 7), (5, 5, 6, 7), (None,) * 4]
    lit = lambda *v: [F.lit(float(x)) for x in v]
    p = spark.range(1).select(*g.unproject(*lit(10, 20, 2), lit(100, 100, 5, 5), g.pose(lit(1, 0, 0, 0), lit(1, 1, 1)))).first()
    assert np.allclose(list(p), [1.1, 1.3, 3.0])
    m, eye = g.look_at(lit(0, 0, 0), lit(0, 0, 1), lit(0, -1, 0))
    assert np.allclose(list(spark.range(1).select(*m).first()), np.eye(3).ravel())


def test_float16_all_codes(spark):
    got = spark.range(65536).select("id", values.float16(F.col("id").cast("int")).alias("v")).toPandas().sort_values("id").v.to_numpy()
    want = np.arange(65536, dtype=np.uint16).view(np.float16).astype(np.float64)
    assert np.array_equal(got, want, equal_nan=True) and np.array_equal(np.signbit(got[~np.isnan(want)]), np.signbit(want[~np.isnan(want)]))


def test_inverse_depth_codes_and_fold(spark):
    z = values.inverse_depth(F.col("id"), 0.3, 9.0)
    high, low = values.triangle_fold(F.col("id").cast("int"))
    df = spark.range(65536).select("id", values.quantize_inverse(z, 0.3, 9.0).alias("c"), values.triangle_unfold(high, low).alias("f"), z.alias("z"))
    assert df.where("id > 1 AND id < 65535 AND c <> id").count() == 0 and df.where("f <> id").count() == 0
    ends = df.where("id IN (0, 1, 65535)").orderBy("id").collect()
    assert math.isnan(ends[0].z) and abs(ends[1].z - 9.0) < 1e-9 and abs(ends[2].z - 0.3) < 1e-9


def test_requantize_and_dispatch(spark):
    got = [r[0] for r in spark.createDataFrame([(0.0025,), (0.0035,), (float("nan"),), (70.0,), (None,)], "d double").select(values.requantize(F.col("d"), 0.001)).collect()]
    assert got == [2, 4, 0, 0, 0]
    kind = "type string, scale double, offset double, invalid int, near double, far double, levels int"
    rows = [(7, ("linear", None, None, 7, None, None, None)), (8, ("linear", 2.0, 1.0, 7, None, None, None)), (9, ("labels",) + (None,) * 6), (10, None)]
    df = spark.createDataFrame(rows, f"raw int, m struct<{kind.replace(' ', ':').replace(',:', ',')}>")
    got = [r[0] for r in df.select(values.signal_value(F.col("raw"), F.col("m"))).collect()]
    assert math.isnan(got[0]) and got[1:] == [17.0, 9.0, 10.0]
    with pytest.raises(Exception, match="unknown value map"):
        spark.createDataFrame([(1, ("odd",) + (None,) * 6)], df.schema).select(values.signal_value(F.col("raw"), F.col("m"))).collect()


def test_text(spark):
    got = spark.createDataFrame([(1.9999999999,), (2.5,), (-1.0,)], "t double").select(text.stamp(F.col("t")).alias("s"), text.vtt_time(F.abs("t")).alias("v")).collect()
    assert got[0].s == (2, 0) and got[1].s == (2, 500_000_000) and got[2].s is None and got[1].v == "00:00:02.500"
    r = spark.createDataFrame([("/data/a/b.webm", "cam0_optical_frame", "x/Freiburg2_desk")], "u string, f string, p string")
    assert tuple(r.select(text.relative_uri(F.col("u"), F.lit("/data/")), text.camera_of_frame(F.col("f")), text.guessed_camera(F.col("p"))).first()) == ("a/b.webm", "cam0", "freiburg2")
