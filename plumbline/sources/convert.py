"""Whole sequences from other layouts: lists, trajectories and calibrations joined to frames, cameras, rigs and samples.

Each function takes tables, keyed by seq_id where many sequences go through at once, so a folder of
recordings is one job; ``any_layout`` reads one folder by its layout. Pictures are named, not decoded.
"""

from __future__ import annotations

import io
import json
import os
import re
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from plumbline.functions import geometry as g
from plumbline.functions import text
from plumbline.operators import align
from plumbline.sources import layouts

MAX_DT = 0.02
#: Published calibrations (fx, fy, cx, cy at 640 x 480) of the recordings that a path can name.
CALIBRATIONS = {
    "freiburg1": (517.3, 516.5, 318.6, 255.3),
    "freiburg2": (520.9, 521.0, 325.1, 249.7),
    "freiburg3": (535.4, 539.2, 320.1, 247.6),
    "default": (525.0, 525.0, 319.5, 239.5),
}
_SEQ = ["seq_id"]


def _unposed(df: DataFrame) -> DataFrame:
    return df.withColumn("q_wxyz", F.when(F.col("pose_valid"), F.col("q_wxyz"))).withColumn("tr", F.when(F.col("pose_valid"), F.col("tr")))


def listed(images: DataFrame, depths: DataFrame | None, truth: DataFrame, max_dt: float = MAX_DT) -> DataFrame:
    """seq_id, i, t, camera, name, depth_name, pose_valid, q_wxyz, tr from stamped lists (seq_id, pos, t, name) and a trajectory (seq_id, pos, t, q_wxyz, tr).

    Pictures and depths go one to one, the closest first; pictures without one are left out. The
    nearest pose counts if it is closer than max_dt.
    """
    if depths is not None:
        pairs = align.greedy_pairs(images, depths, "seq_id", "t", "pos", max_dt)
        named = depths.select("seq_id", F.col("pos").alias("b"), F.col("name").alias("depth_name"))
        own = images.join(pairs.withColumnRenamed("a", "pos"), ["seq_id", "pos"]).join(named, ["seq_id", "b"]).drop("b")
    else:
        own = images.withColumn("depth_name", F.lit(None).cast("string"))
    own = own.withColumn("i", (F.row_number().over(W.partitionBy("seq_id").orderBy("pos")) - 1).cast("bigint"))
    found = align.nearest(own, truth, _SEQ, "t", "pos", tolerance=max_dt)
    return found.select("l.seq_id", "l.i", "l.t", F.lit("0").alias("camera"), "l.name", "l.depth_name", F.col("r").isNotNull().alias("pose_valid"), "r.q_wxyz", "r.tr")


def paired(left: DataFrame, right: DataFrame) -> DataFrame:
    """seq_id, ns, name, other: pictures of two cameras that were taken at the same nanosecond; others are dropped."""
    return left.select("seq_id", "ns", "name").join(right.select("seq_id", "ns", F.col("name").alias("other")), ["seq_id", "ns"])


def unpaired(left: DataFrame, right: DataFrame) -> DataFrame:
    """seq_id, dropped: how many pictures of the left camera have no right one."""
    return left.join(right, ["seq_id", "ns"], "left_anti").groupBy("seq_id").agg(F.count("*").alias("dropped"))


def first_frames(rows: DataFrame, most: int, order: str = "ns") -> DataFrame:
    """The first rows of each sequence."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy("seq_id").orderBy(order))).where(F.col("_n") <= most).drop("_n")


def flown(images: DataFrame, truth: DataFrame, body_to_camera: Column, max_dt: float = MAX_DT) -> DataFrame:
    """seq_id, i, t, camera, pose_valid, q_wxyz, tr: body poses interpolated to each picture (seq_id, ns, name), then taken to the camera.

    truth: seq_id, ns, q_wxyz, tr of the body; body_to_camera: array of 16 numbers, row by row.
    """
    at = text.seconds_from_nanos(F.col("ns"))
    own = images.withColumn("t", at).withColumn("i", (F.row_number().over(W.partitionBy("seq_id").orderBy("ns")) - 1).cast("bigint"))
    found = align.bracket(own, truth.withColumn("t", at), _SEQ, "t", "ns", max_dt)
    q, tr = align.interpolated_pose(F.col("a"), F.col("b"), F.col("u"))
    staged = found.select("l.seq_id", "l.i", "l.t", F.col("u").isNotNull().alias("pose_valid"), F.array(*q).alias("bq"), F.array(*tr).alias("bt"), body_to_camera.alias("c"))
    m = [F.col("c")[4 * r + k] for r in range(3) for k in range(3)]
    pose = g.compose(g.pose(g.elements(F.col("bq"), 4), g.elements(F.col("bt"), 3)), (m, [F.col("c")[4 * r + 3] for r in range(3)]))
    turned = staged.select("seq_id", "i", "t", "pose_valid", F.array(*pose[0]).alias("m"), F.array(*pose[1]).alias("tr"))
    return _unposed(turned.select("seq_id", "i", "t", F.lit("0").alias("camera"), "pose_valid", F.array(*g.matrix_to_quat(g.elements(F.col("m"), 9))).alias("q_wxyz"), "tr"))


def indexed(odometry: DataFrame, lengths: DataFrame) -> DataFrame:
    """seq_id, i, t, camera, pose_valid, q_wxyz, tr of every frame below ``frames`` (seq_id, frames), by index.

    odometry: seq_id, i, t, q_wxyz, tr. A frame without a pose has the time of the one before, or 0. No
    frame lies beyond the last pose.
    """
    last = odometry.groupBy("seq_id").agg((F.max("i") + 1).alias("posed"))
    every = lengths.join(last, "seq_id", "left").withColumn("n", F.least("frames", F.coalesce("posed", "frames"))).where("n > 0")
    every = every.select("seq_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("i"))
    joined = every.join(odometry, ["seq_id", "i"], "left").withColumn("pose_valid", F.col("q_wxyz").isNotNull())
    return joined.select("seq_id", "i", align.filled_forward(F.col("t"), ["seq_id"], "i", 0.0).alias("t"), F.lit("0").alias("camera"), "pose_valid", "q_wxyz", "tr")


def by_position(documents: DataFrame) -> DataFrame:
    """seq_id, i, t, camera, pose_valid, q_wxyz, tr from lists that may be shorter than the number of frames.

    documents: seq_id, frames, fps, poses array<array<double>> (scalar-last rotation, then place, axes
    y up), stamps array<double>. Times count from the first stamp; without one they are i / fps.
    """
    every = documents.where("frames > 0").select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("frames") - 1)).alias("i"))
    p, stamp = F.get("poses", F.col("i").cast("int")), F.get("stamps", F.col("i").cast("int"))
    rows = every.select("seq_id", "i", F.coalesce(stamp - F.get("stamps", F.lit(0)), F.col("i") / F.col("fps")).alias("t"), p.alias("p"))
    turned = rows.withColumn("m", F.array(*g.flip_gl_cv(g.quat_to_matrix(g.wxyz_from_xyzw([F.get("p", F.lit(k)) for k in range(4)])))))
    out = turned.select("seq_id", "i", "t", F.lit("0").alias("camera"), F.col("p").isNotNull().alias("pose_valid"), F.array(*g.matrix_to_quat(g.elements(F.col("m"), 9))).alias("q_wxyz"), F.array(*[F.get("p", F.lit(4 + k)) for k in range(3)]).alias("tr"))
    return _unposed(out)


def by_stem(cameras: DataFrame, depths: DataFrame, confidences: DataFrame) -> DataFrame:
    """Key frames (seq_id, stem, ..) with has_depth and has_confidence by name (seq_id, stem).

    Depth for some key frames but not all is an error; confidence for some is dropped.
    """
    joined = cameras.join(depths.select("seq_id", "stem", F.lit(True).alias("_d")), ["seq_id", "stem"], "left").join(confidences.select("seq_id", "stem", F.lit(True).alias("_c")), ["seq_id", "stem"], "left")
    all_of = W.partitionBy("seq_id")
    n, d, c = F.count("*").over(all_of), F.count("_d").over(all_of), F.count("_c").over(all_of)
    checked = joined.select("*", F.when((d > 0) & (d < n), F.raise_error(F.lit("some key frames have depth and some do not")).cast("boolean")).otherwise(d > 0).alias("has_depth"), (c == n).alias("has_confidence"))
    return checked.drop("_d", "_c")


def from_log(log: DataFrame) -> dict[str, DataFrame]:
    """frames, cameras, imu of a message log (seq_id, log_time, topic, message as exports.messages() has them).

    A calibration message stands for its picture; of several per camera the first one counts. Only
    transforms of optical frames are poses; the nearest within half the median distance of a camera's
    pictures is taken.
    """
    field = lambda path: F.get_json_object("message", path)
    t = field("$.header.stamp.sec").cast("double") + field("$.header.stamp.nanosec").cast("double") * 1e-9
    info = log.where(F.col("topic").endswith("/camera_info")).select(
        "seq_id", F.col("log_time").alias("ns"), t.alias("t"), text.camera_of_frame(field("$.header.frame_id")).alias("camera"), F.from_json(field("$.k"), "array<double>").alias("k"), field("$.width").cast("int").alias("width"), field("$.height").cast("int").alias("height")
    )
    number = lambda path: field(path).cast("double")
    rotation, place = [number(f"$.transform.rotation.{c}") for c in "wxyz"], [number(f"$.transform.translation.{c}") for c in "xyz"]
    tf = log.where(F.col("topic") == "/tf").select("seq_id", F.col("log_time").alias("ns"), t.alias("t"), text.camera_of_frame(field("$.child_frame_id")).alias("camera"), F.array(*rotation).alias("q_wxyz"), F.array(*place).alias("tr")).where("camera IS NOT NULL")
    found = align.nearest_by_median(info.select("seq_id", "camera", "ns", "t"), tf, ["seq_id", "camera"], "t", "ns")
    frames = found.select("l.seq_id", "l.camera", "l.ns", "l.t", F.col("r").isNotNull().alias("pose_valid"), "r.q_wxyz", "r.tr")
    frames = frames.withColumn("i", (F.row_number().over(W.partitionBy("seq_id").orderBy("t", "ns", "camera")) - 1).cast("bigint"))
    first = info.groupBy("seq_id", "camera").agg(F.min_by(F.struct("k", "width", "height"), "ns").alias("c"))
    k = F.col("c.k")
    cameras = first.select("seq_id", "camera", F.lit("PINHOLE").alias("model"), "c.width", "c.height", F.array(k[0], k[4], k[2], k[5]).alias("params"))
    turn, force = ([number(f"$.{name}.{c}") for c in "xyz"] for name in ("angular_velocity", "linear_acceleration"))
    imu = log.where(F.col("topic").startswith("/imu/")).select("seq_id", F.substr("topic", F.lit(6)).alias("imu_id"), t.alias("t"), *[c.alias(n) for c, n in zip(turn + force, ("gx", "gy", "gz", "ax", "ay", "az"), strict=True)])
    return {"frames": frames, "cameras": cameras, "imu": imu.orderBy("seq_id", "imu_id", "t")}


def rate(frames: DataFrame, digits: int = 3, default: float = 30.0, posed_only: bool = False, least: float | None = None) -> DataFrame:
    """seq_id, fps: (frames - 1) over the time from the first to the last, or the default where that can't be said."""
    own = F.when(F.col("pose_valid"), F.col("t")) if posed_only else F.col("t")
    span = F.max(own) - F.min(own)
    fps = F.when((F.count(own) > 1) & (span > 0), F.round((F.count(own) - 1) / span, digits))
    if least is not None:
        fps = F.greatest(fps, F.when(fps.isNotNull(), F.lit(least)))
    return frames.groupBy("seq_id").agg(F.coalesce(fps, F.lit(default)).alias("fps"))


def imu_rate(imu: DataFrame) -> DataFrame:
    """seq_id, imu_id, rate_hz: one over the median distance of samples; null for a single one."""
    gap = F.col("t") - F.lag("t").over(W.partitionBy("seq_id", "imu_id").orderBy("t"))
    middle = F.percentile("gap", F.lit(0.5))
    return imu.withColumn("gap", gap).groupBy("seq_id", "imu_id").agg(F.when(middle > 0, F.round(1 / middle, 1)).alias("rate_hz"))


def scaled_camera(cameras: DataFrame, width: Column, height: Column) -> DataFrame:
    """Pinhole cameras (params of width x height) for pictures of another size."""
    k = [F.col("params")[n] for n in range(4)]
    sx, sy = width / F.col("width"), height / F.col("height")
    return cameras.withColumn("params", F.array(k[0] * sx, k[1] * sy, k[2] * sx, k[3] * sy)).withColumn("width", width.cast("int")).withColumn("height", height.cast("int"))


# --- one folder ---


def _camera(spark: SparkSession, seq: str, width: int, height: int, params: list[float], model: str = "PINHOLE", camera: str = "0") -> DataFrame:
    return spark.createDataFrame([(seq, camera, model, width, height, [float(x) for x in params])], "seq_id string, camera string, model string, width int, height int, params array<double>")


def _world(spark: SparkSession, seq: str, up: list[float] | None, what: str) -> DataFrame:
    return spark.createDataFrame([(seq, (True, up, what))], "seq_id string, world struct<metric_scale:boolean,gravity_in_world:array<double>,description:string>")


def from_tum(spark: SparkSession, root: str, max_dt: float = MAX_DT) -> dict[str, DataFrame]:
    seq = _name(root)
    key = lambda df: df.withColumn("seq_id", F.lit(seq))
    depths = key(layouts.tum_list(spark, f"{root}/depth.txt")) if os.path.exists(f"{root}/depth.txt") else None
    frames = listed(key(layouts.tum_list(spark, f"{root}/rgb.txt")), depths, key(layouts.tum_truth(spark, f"{root}/groundtruth.txt")), max_dt)
    which = next((k for k in CALIBRATIONS if k in root.lower()), "default")
    return {"frames": frames, "cameras": _camera(spark, seq, 640, 480, CALIBRATIONS[which]), "sequences": _world(spark, seq, None, f"RGB-D lists of {seq}")}


def from_euroc(spark: SparkSession, root: str, max_dt: float = MAX_DT, stereo: bool = True, max_frames: int | None = None) -> dict[str, DataFrame]:
    seq, base = _name(root), os.path.join(root, "mav0") if os.path.isdir(os.path.join(root, "mav0")) else root
    key = lambda df: df.withColumn("seq_id", F.lit(seq))
    eyes = [c for c in ("cam0", "cam1") if os.path.exists(f"{base}/{c}/sensor.yaml")]
    sensors = {c: layouts.euroc_sensor(spark, f"{base}/{c}/sensor.yaml").first() for c in (*eyes, *(["imu0"] if os.path.exists(f"{base}/imu0/sensor.yaml") else []))}
    images = key(layouts.euroc_images(spark, base))
    if max_frames is not None:
        images = first_frames(images, max_frames)
    out: dict[str, DataFrame] = {}
    if stereo and os.path.exists(f"{base}/cam1/data.csv"):
        other = key(layouts.euroc_images(spark, base, "cam1"))
        out["dropped"] = unpaired(images, other)
        images = paired(images, other)
    out["frames"] = flown(images, key(layouts.euroc_truth(spark, base)), F.array(*[F.lit(x) for x in sensors["cam0"].t_bs]), max_dt)
    cams = [(seq, str(n), "OPENCV", int(s.resolution[0]), int(s.resolution[1]), [*s.intrinsics, *s.distortion]) for n, s in ((n, sensors[c]) for n, c in enumerate(eyes))]
    out["cameras"] = spark.createDataFrame(cams, "seq_id string, camera string, model string, width int, height int, params array<double>")
    bodies = spark.createDataFrame([(seq, str(n), list(sensors[c].t_bs)) for n, c in enumerate(eyes)], "seq_id string, camera string, m array<double>")
    out["rigs"] = _posed(bodies, "m").select("seq_id", F.lit("body").alias("rig_id"), "camera", "q_wxyz", "tr")
    if "imu0" in sensors:
        out["imu"] = key(layouts.euroc_imu(spark, base)).withColumn("imu_id", F.lit("imu0")).select("seq_id", "imu_id", "t", "gx", "gy", "gz", "ax", "ay", "az")
        both = spark.createDataFrame([(seq, "imu0", list(sensors["cam0"].t_bs), list(sensors["imu0"].t_bs))], "seq_id string, imu_id string, c array<double>, s array<double>")
        extrinsics = g.compose(g.inverse(_matrix("c")), _matrix("s"))
        placed = both.select("seq_id", "imu_id", F.array(*extrinsics[0]).alias("r"), F.array(*extrinsics[1]).alias("tr"))
        placed = placed.select("seq_id", "imu_id", F.struct(F.array(*g.matrix_to_quat(g.elements(F.col("r"), 9))).alias("q_wxyz"), "tr").alias("extrinsics"))
        out["imu_streams"] = imu_rate(out["imu"]).join(placed, ["seq_id", "imu_id"]).withColumn("description", F.lit("extrinsics: imu to camera 0"))
    out["sequences"] = _world(spark, seq, [0.0, 0.0, -1.0], f"stereo-inertial recording {seq}")
    return out


def _matrix(column: str) -> tuple:
    c = F.col(column)
    return [c[4 * r + k] for r in range(3) for k in range(3)], [c[4 * r + 3] for r in range(3)]


def _posed(df: DataFrame, column: str) -> DataFrame:
    m, tr = _matrix(column)
    staged = df.withColumn("_r", F.array(*m)).withColumn("tr", F.array(*tr))
    return staged.withColumn("q_wxyz", F.array(*g.matrix_to_quat(g.elements(F.col("_r"), 9)))).drop("_r")


def from_stray(spark: SparkSession, root: str, frames: int | None = None) -> dict[str, DataFrame]:
    seq = _name(root)
    odometry = layouts.stray_odometry(spark, f"{root}/odometry.csv").withColumn("seq_id", F.lit(seq))
    depths = len([n for n in os.listdir(f"{root}/depth") if n.endswith(".png")]) if os.path.isdir(f"{root}/depth") else 0
    with open(f"{root}/camera_matrix.csv") as f:
        k = [[float(x) for x in line.split(",")] for line in f if line.strip()]
    lengths = spark.createDataFrame([(seq, frames if frames is not None else depths)], "seq_id string, frames bigint")
    width, height = round(2 * k[0][2]), round(2 * k[1][2])
    return {"frames": indexed(odometry, lengths), "cameras": _camera(spark, seq, width, height, [k[0][0], k[1][1], k[0][2], k[1][2]]), "sequences": _world(spark, seq, [0.0, -1.0, 0.0], f"scan {seq}")}


def from_polycam(spark: SparkSession, root: str, corrected: bool = True) -> dict[str, DataFrame]:
    seq, base = _name(root), os.path.join(root, "keyframes") if os.path.isdir(os.path.join(root, "keyframes")) else root
    folder = f"{base}/corrected_cameras" if corrected and os.path.isdir(f"{base}/corrected_cameras") else f"{base}/cameras"
    own = layouts.polycam_cameras(spark, folder).withColumn("seq_id", F.lit(seq))
    stems = lambda sub: spark.createDataFrame([(seq, n.rsplit(".", 1)[0]) for n in sorted(os.listdir(f"{base}/{sub}"))] if os.path.isdir(f"{base}/{sub}") else [], "seq_id string, stem string")
    joined = by_stem(own, stems("depth"), stems("confidence"))
    frames = joined.select("seq_id", "i", "t", F.lit("0").alias("camera"), F.lit(True).alias("pose_valid"), "q_wxyz", "tr", "has_depth", "has_confidence")
    camera = own.where("i = 0").select("seq_id", F.lit("0").alias("camera"), F.lit("PINHOLE").alias("model"), "width", "height", "params")
    return {"frames": frames, "cameras": camera, "sequences": _world(spark, seq, [0.0, -1.0, 0.0], f"key frames of {seq}")}


def from_record3d(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """An archive: its metadata, and the frames that it holds, which must be numbered from 0 without a gap."""
    with open(path, "rb") as f, zipfile.ZipFile(io.BytesIO(f.read())) as z:
        names = z.namelist()
        meta = json.loads(z.read("metadata" if "metadata" in names else "metadata.json"))
    held = sorted(int(m[1]) for n in names if (m := re.fullmatch(r"rgbd/(\d+)\.jpg", n)))
    if not held or held != list(range(len(held))):
        raise ValueError("frames are not numbered from 0 without a gap")
    seq, k = _name(path), meta["K"]
    poses = [[float(x) for x in p] for p in meta.get("poses") or []]
    documents = spark.createDataFrame([(seq, len(held), float(meta.get("fps", 30)), poses, [float(x) for x in meta.get("frameTimestamps") or []])], "seq_id string, frames bigint, fps double, poses array<array<double>>, stamps array<double>")
    # the matrix is stored column by column
    return {"frames": by_position(documents), "cameras": _camera(spark, seq, int(meta["w"]), int(meta["h"]), [k[0], k[4], k[6], k[7]]), "sequences": _world(spark, seq, [0.0, -1.0, 0.0], f"archive {seq}")}


def from_transforms(spark: SparkSession, path: str, fps: float = 30.0) -> dict[str, DataFrame]:
    file = path if path.endswith(".json") else f"{path}/transforms.json"
    cameras, frames = layouts.transforms(spark, file, fps)
    return {"frames": frames.withColumn("seq_id", F.lit(_name(path))), "cameras": cameras.withColumn("seq_id", F.lit(_name(path)))}


def from_colmap(spark: SparkSession, root: str, fps: float = 30.0) -> dict[str, DataFrame]:
    base = next(p for p in (root, f"{root}/sparse", f"{root}/sparse/0") if os.path.exists(f"{p}/images.txt") or os.path.exists(f"{p}/images.bin"))
    if os.path.exists(f"{base}/images.bin"):
        cameras, images = layouts.colmap_binary_cameras(spark, f"{base}/cameras.bin"), layouts.colmap_binary_images(spark, f"{base}/images.bin")
    else:
        cameras, images = layouts.colmap_cameras(spark, f"{base}/cameras.txt"), layouts.colmap_images(spark, f"{base}/images.txt")
    key = lambda df: df.withColumn("seq_id", F.lit(_name(root)))
    return {"frames": key(images).select("seq_id", F.col("i").cast("bigint").alias("i"), (F.col("i") / fps).alias("t"), "camera", F.lit(True).alias("pose_valid"), "q_wxyz", "tr", "name"), "cameras": key(cameras)}


def any_layout(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """frames, cameras and what else the layout has of one sequence."""
    kind = layouts.detect(path)
    if kind is None:
        raise ValueError(f"{path} has no known layout")
    return {"tum": from_tum, "euroc": from_euroc, "stray": from_stray, "polycam": from_polycam, "record3d": from_record3d, "transforms": from_transforms, "colmap": from_colmap}[kind](spark, path)


def _name(path: str) -> str:
    return os.path.splitext(os.path.basename(os.path.normpath(path)))[0]
