"""Metadata of common capture layouts as tables (pictures stay files; their paths are columns)."""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from plumbline.functions import geometry as g
from plumbline.functions import text
from plumbline.session import ship

#: Numbers of camera models in binary files, and how many parameters each has.
_BINARY_MODELS = {0: ("SIMPLE_PINHOLE", 3), 1: ("PINHOLE", 4), 2: ("SIMPLE_RADIAL", 4), 3: ("RADIAL", 5), 4: ("OPENCV", 8), 5: ("OPENCV_FISHEYE", 8)}


def detect(path: str) -> str | None:
    """Layout of a file or folder, by the files that it must have, in order of precedence."""
    has = lambda *names: all(os.path.exists(os.path.join(path, n)) for n in names)
    if os.path.basename(path) == "transforms.json":
        return "transforms"
    if path.endswith(".r3d"):
        return "record3d"
    if has("rgb.txt", "groundtruth.txt"):
        return "tum"
    if has("transforms.json"):
        return "transforms"
    if has("odometry.csv", "camera_matrix.csv"):
        return "stray"
    if has("keyframes"):
        return "polycam"
    if has("mav0") or has("cam0", "imu0"):
        return "euroc"
    if any(has(os.path.join(*d, n)) for d in ((), ("sparse",), ("sparse", "0")) for n in ("images.txt", "images.bin")):
        return "colmap"
    return None


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no, value: lines of one text file in order, without blank ones and comments."""
    whole = spark.read.text(path, wholetext=True)
    lines = whole.select(F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "value"))
    return lines.where((F.trim("value") != "") & ~F.ltrim(F.col("value")).startswith("#"))


def _fields(df: DataFrame, pattern: str = r"\s+") -> DataFrame:
    return df.withColumn("f", F.split(F.trim("value"), pattern))


def _double(k: int) -> Column:
    return F.get("f", F.lit(k)).try_cast("double")


def tum_list(spark: SparkSession, path: str) -> DataFrame:
    """pos, t, name of a list of stamped files."""
    rows = _fields(_lines(spark, path)).where(F.size("f") >= 2)
    return rows.select(F.col("line_no").cast("bigint").alias("pos"), _double(0).alias("t"), F.get("f", F.lit(1)).alias("name"))


def tum_truth(spark: SparkSession, path: str) -> DataFrame:
    """pos, t, q_wxyz, tr of a trajectory with scalar-last quaternions."""
    rows = _fields(_lines(spark, path)).where(F.size("f") >= 8)
    return rows.select(F.col("line_no").cast("bigint").alias("pos"), _double(0).alias("t"), F.array(*g.wxyz_from_xyzw([_double(k) for k in (4, 5, 6, 7)])).alias("q_wxyz"), F.array(_double(1), _double(2), _double(3)).alias("tr"))


def euroc_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """ns (integer, for exact joins), t, and the named columns."""
    rows = _fields(_lines(spark, path), r"\s*,\s*")
    numbers = [F.get("f", F.lit(k + 1)).alias(c) if c == "name" else _double(k + 1).alias(c) for k, c in enumerate(columns)]
    return rows.select(F.get("f", F.lit(0)).cast("bigint").alias("ns"), *numbers).withColumn("t", text.seconds_from_nanos(F.col("ns")))


def euroc_images(spark: SparkSession, root: str, camera: str = "cam0") -> DataFrame:
    return euroc_csv(spark, f"{root}/{camera}/data.csv", ["name"])


def euroc_truth(spark: SparkSession, root: str) -> DataFrame:
    rows = euroc_csv(spark, f"{root}/state_groundtruth_estimate0/data.csv", ["px", "py", "pz", "qw", "qx", "qy", "qz"])
    return rows.select("ns", "t", F.array("qw", "qx", "qy", "qz").alias("q_wxyz"), F.array("px", "py", "pz").alias("tr"))


def euroc_imu(spark: SparkSession, root: str) -> DataFrame:
    return euroc_csv(spark, f"{root}/imu0/data.csv", ["gx", "gy", "gz", "ax", "ay", "az"])


def euroc_sensor(spark: SparkSession, path: str) -> DataFrame:
    """t_bs (16 numbers), intrinsics, distortion, resolution of a sensor file."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(text.yaml_matrix(F.col("value"), "T_BS").alias("t_bs"), *[text.yaml_numbers(F.col("value"), k).alias(v) for k, v in (("intrinsics", "intrinsics"), ("distortion_coefficients", "distortion"), ("resolution", "resolution"))])


def colmap_cameras(spark: SparkSession, path: str) -> DataFrame:
    rows = _fields(_lines(spark, path))
    return rows.select(F.get("f", F.lit(0)).alias("camera"), F.get("f", F.lit(1)).alias("model"), F.get("f", F.lit(2)).cast("int").alias("width"), F.get("f", F.lit(3)).cast("int").alias("height"), F.transform(F.slice("f", 5, 100), lambda x: x.cast("double")).alias("params"))


def colmap_images(spark: SparkSession, path: str) -> DataFrame:
    """Records of two lines, the first with a world-to-camera pose. Rows by name, poses turned to camera-to-world."""
    whole = spark.read.text(path, wholetext=True)
    lines = whole.select(F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "value")).where(~F.col("value").startswith("#"))
    numbered = lines.withColumn("n", F.row_number().over(W.orderBy("line_no")) - 1).where("n % 2 = 0 AND trim(value) <> ''")
    rows = _fields(numbered)
    q, tr = g.inverse(g.pose([_double(k) for k in (1, 2, 3, 4)], [_double(k) for k in (5, 6, 7)]))
    posed = rows.select(F.get("f", F.lit(0)).alias("image_id"), F.get("f", F.lit(8)).alias("camera"), F.array_join(F.slice("f", 10, 100), " ").alias("name"), F.array(*q).alias("m"), F.array(*tr).alias("tr"))
    out = posed.select("image_id", "camera", "name", F.array(*g.matrix_to_quat(g.elements(F.col("m"), 9))).alias("q_wxyz"), "tr")
    return out.withColumn("i", F.row_number().over(W.orderBy("name")) - 1)


def binary_cameras(raw: bytes) -> Iterator[tuple]:
    """(camera, model, width, height, params) of a binary camera list."""
    (n,), at = struct.unpack_from("<Q", raw), 8
    for _ in range(n):
        camera, model, width, height = struct.unpack_from("<iiQQ", raw, at)
        if model not in _BINARY_MODELS:
            raise ValueError(f"unknown camera model {model}")
        name, count = _BINARY_MODELS[model]
        yield str(camera), name, width, height, list(struct.unpack_from(f"<{count}d", raw, at + 24))
        at += 24 + 8 * count


def binary_images(raw: bytes) -> Iterator[tuple]:
    """(image_id, camera, name, rotation wxyz, place) of a binary image list, world to camera."""
    (n,), at = struct.unpack_from("<Q", raw), 8
    for _ in range(n):
        image, *pose, camera = struct.unpack_from("<i7di", raw, at)
        end = raw.index(b"\0", at + 64)
        (points,) = struct.unpack_from("<Q", raw, end + 1)
        yield str(image), str(camera), raw[at + 64 : end].decode(), list(pose[:4]), list(pose[4:])
        at = end + 9 + 24 * points


def _binary(spark: SparkSession, path: str, rows, schema: str) -> DataFrame:
    ship(spark)
    whole = spark.read.format("binaryFile").load(path).select("content")
    return whole.mapInPandas(lambda parts: (pd.DataFrame(list(rows(bytes(c))), columns=[x.split()[0] for x in schema.split(", ")]) for p in parts for c in p["content"]), schema)


def colmap_binary_cameras(spark: SparkSession, path: str) -> DataFrame:
    return _binary(spark, path, binary_cameras, "camera string, model string, width int, height int, params array<double>")


def colmap_binary_images(spark: SparkSession, path: str) -> DataFrame:
    """Rows by name, poses turned to camera-to-world, as colmap_images()."""
    rows = _binary(spark, path, binary_images, "image_id string, camera string, name string, q array<double>, p array<double>")
    m, tr = g.inverse(g.pose(g.elements(F.col("q"), 4), g.elements(F.col("p"), 3)))
    posed = rows.select("image_id", "camera", "name", F.array(*m).alias("m"), F.array(*tr).alias("tr"))
    out = posed.select("image_id", "camera", "name", F.array(*g.matrix_to_quat(g.elements(F.col("m"), 9))).alias("q_wxyz"), "tr")
    return out.withColumn("i", F.row_number().over(W.orderBy("name")) - 1)


def transforms(spark: SparkSession, path: str, fps: float = 30.0) -> tuple[DataFrame, DataFrame]:
    """(cameras, frames) of a transforms file: frames by path, axes flipped, equal calibrations joined."""
    intr = "fl_x double, fl_y double, cx double, cy double, w double, h double, k1 double, k2 double, p1 double, p2 double"
    frame = "file_path string, depth_file_path string, transform_matrix array<array<double>>, " + intr
    inner = ", ".join(f"{a}:{b}" for a, b in (x.rsplit(" ", 1) for x in frame.split(", ")))
    doc = spark.read.schema(f"{intr}, frames array<struct<{inner}>>").json(path, multiLine=True)
    names = [x.split()[0] for x in intr.split(", ")]
    rows = doc.select(*[F.col(n).alias(f"d_{n}") for n in names], F.explode("frames").alias("f"))
    own = rows.select("f.file_path", "f.depth_file_path", F.flatten("f.transform_matrix").alias("m"), F.struct(*[F.coalesce(F.col(f"f.{n}"), F.col(f"d_{n}")).alias(n) for n in names]).alias("k"))
    own = own.withColumn("i", F.row_number().over(W.orderBy("file_path")) - 1).withColumn("key", F.to_json("k"))
    numbered = own.withColumn("first", F.min("i").over(W.partitionBy("key"))).withColumn("camera", (F.dense_rank().over(W.orderBy("first")) - 1).cast("string"))
    lens = F.when(F.coalesce("k.k1", "k.k2", "k.p1", "k.p2", F.lit(0.0)) != 0, "OPENCV").otherwise("PINHOLE")
    four = F.array("k.fl_x", "k.fl_y", "k.cx", "k.cy")
    rest = F.array(*[F.coalesce(F.col(f"k.{n}"), F.lit(0.0)) for n in ("k1", "k2", "p1", "p2")])
    cameras = numbered.groupBy("camera").agg(F.first("k").alias("k")).select("camera", lens.alias("model"), F.col("k.w").cast("int").alias("width"), F.col("k.h").cast("int").alias("height"), F.when(lens == "OPENCV", F.concat(four, rest)).otherwise(four).alias("params"))
    m = [F.col("m")[4 * r + c] for r in range(3) for c in range(3)]
    posed = numbered.withColumn("r", F.array(*g.flip_gl_cv(m))).withColumn("tr", F.array(*[F.col("m")[4 * r + 3] for r in range(3)]))
    frames = posed.select(F.col("i").cast("bigint").alias("i"), (F.col("i") / fps).alias("t"), "camera", F.array(*g.matrix_to_quat(g.elements(F.col("r"), 9))).alias("q_wxyz"), "tr", F.lit(True).alias("pose_valid"), "file_path", "depth_file_path")
    return cameras, frames


def stray_odometry(spark: SparkSession, path: str) -> DataFrame:
    """i, t, q_wxyz, tr of an odometry table with a header; axes flipped."""
    rows = spark.read.csv(path, header=True, ignoreLeadingWhiteSpace=True)
    number = lambda c: F.col(c).cast("double")
    m = g.flip_gl_cv(g.quat_to_matrix([number(c) for c in ("qw", "qx", "qy", "qz")]))
    turned = rows.select(number("frame").cast("bigint").alias("i"), number("timestamp").alias("t"), F.array(*m).alias("m"), F.array(*[number(c) for c in ("x", "y", "z")]).alias("tr"))
    return turned.select("i", "t", F.array(*g.matrix_to_quat(g.elements(F.col("m"), 9))).alias("q_wxyz"), "tr")


def polycam_cameras(spark: SparkSession, folder: str) -> DataFrame:
    """One row per key frame, in order of numeric name and then name; times from microseconds, axes flipped."""
    names = ["fx", "fy", "cx", "cy", "width", "height", "timestamp", *[f"t_{r}{c}" for r in range(3) for c in range(4)]]
    rows = spark.read.schema(", ".join(f"{n} double" for n in names)).json(f"{folder}/*.json", multiLine=True).withColumn("stem", F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1))
    m = [F.col(f"t_{r}{c}") for r in range(3) for c in range(3)]
    posed = rows.withColumn("r", F.array(*g.flip_gl_cv(m))).withColumn("tr", F.array("t_03", "t_13", "t_23"))
    order = W.orderBy(F.col("stem").try_cast("bigint").asc_nulls_last(), "stem")
    return posed.select(
        (F.row_number().over(order) - 1).cast("bigint").alias("i"), "stem", (F.col("timestamp") * 1e-6).alias("t"), F.array("fx", "fy", "cx", "cy").alias("params"), F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"),
        F.array(*g.matrix_to_quat(g.elements(F.col("r"), 9))).alias("q_wxyz"), "tr",
    )


def record3d_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Frames of a metadata document: poses scalar-last with y-up axes, times from the first stamp, column-major K."""
    doc = spark.read.schema("w int, h int, K array<double>, fps double, poses array<array<double>>, frameTimestamps array<double>").json(path, multiLine=True)
    rows = doc.select("w", "h", "fps", F.array(F.col("K")[0], F.col("K")[4], F.col("K")[6], F.col("K")[7]).alias("params"), "frameTimestamps", F.posexplode("poses").alias("i", "p"))
    stamp = F.get("frameTimestamps", F.col("i")) - F.col("frameTimestamps")[0]
    m = g.flip_gl_cv(g.quat_to_matrix(g.wxyz_from_xyzw([F.col("p")[k] for k in range(4)])))
    posed = rows.withColumn("r", F.array(*m))
    return posed.select(F.col("i").cast("bigint").alias("i"), F.coalesce(stamp, F.col("i") / F.col("fps")).alias("t"), "params", F.col("w").alias("width"), F.col("h").alias("height"), F.array(*g.matrix_to_quat(g.elements(F.col("r"), 9))).alias("q_wxyz"), F.array(*[F.col("p")[k] for k in (4, 5, 6)]).alias("tr"))
