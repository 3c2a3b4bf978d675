"""Tables to the text of other tools' formats: each export is a DataFrame of lines or messages, in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from plumbline.functions import geometry as g
from plumbline.functions import text, values


def _all(array: str, n: int) -> list[Column]:
    return [F.col(array)[k] for k in range(n)]


def poses_csv(frames: DataFrame) -> DataFrame:
    """seq_id, i, line: posed frames."""
    line = F.concat_ws(",", *[F.col(c).cast("string") for c in ("i", "t")], *[x.cast("string") for x in _all("q_wxyz", 4) + _all("tr", 3)], F.col("camera"))
    return frames.where("pose_valid").select("seq_id", "i", line.alias("line"))


def poses_vtt(frames: DataFrame) -> DataFrame:
    """seq_id, i, start, stop, body: one cue per posed frame, rebased to the first; a cue ends where the next starts, or after 1/30 s."""
    by = W.partitionBy("seq_id").orderBy("i")
    posed = frames.where("pose_valid").withColumn("t0", F.first("t").over(by)).withColumn("next", F.lead("t").over(by))
    start = F.col("t") - F.col("t0")
    stop = F.greatest(F.coalesce(F.col("next"), F.col("t") + 1 / 30) - F.col("t0"), start + 1e-3)
    body = F.format_string("i=%d t=%s camera=%s q_wxyz=%s tr=%s", "i", F.col("t").cast("string"), "camera", F.concat_ws(",", *[x.cast("string") for x in _all("q_wxyz", 4)]), F.concat_ws(",", *[x.cast("string") for x in _all("tr", 3)]))
    return posed.select("seq_id", "i", text.vtt_time(start).alias("start"), text.vtt_time(stop).alias("stop"), body.alias("body"))


def imu_csv(imu: DataFrame) -> DataFrame:
    """seq_id, i (number of the sample), line: samples in order of stream and time."""
    number = F.row_number().over(W.partitionBy("seq_id").orderBy("imu_id", "t")) - 1
    return imu.select("seq_id", number.alias("i"), F.concat_ws(",", "imu_id", *[F.col(c).cast("string") for c in ("t", "gx", "gy", "gz", "ax", "ay", "az")]).alias("line"))


#: Units of a depth picture's codes in metres.
DEPTH_UNIT = 1 / 5000


def depth_codes(raw: Column, value: Column, scale: Column, unit: float = DEPTH_UNIT) -> Column:
    """Codes of a 16-bit depth picture: as stored if its unit is this one, else rounded; what doesn't fit is 0."""
    return F.when(scale == unit, raw).otherwise(values.requantize(value, unit))


def npy(planes: DataFrame) -> DataFrame:
    """seq_id, i, signal_id, content: each plane of 16-bit codes as an array file of its own."""

    def head(w: Column, h: Column) -> Column:
        text_ = F.concat(F.lit("{'descr': '<u2', 'fortran_order': False, 'shape': ("), h.cast("string"), F.lit(", "), w.cast("string"), F.lit("), }"))
        return F.concat(F.rpad(text_, 117, " "), F.lit("\n"))

    # magic, version 1.0, and the length of the head: 128 bytes in all
    fixed = F.unhex(F.lit("934E554D5059" + "0100" + "7600"))
    return planes.select("seq_id", "i", "signal_id", F.concat(fixed, head(F.col("w"), F.col("h")).cast("binary"), F.col("codes")).alias("content"))


def refuse_hdr(streams: DataFrame) -> DataFrame:
    """The streams, of which none may be HDR: these exports hold 8 bits."""
    return streams.where(F.when(F.col("hdr"), F.raise_error(F.concat(F.lit("HDR stream "), "id", F.lit(" can't be exported at 8 bits"))).cast("boolean")).otherwise(True))


def tum_trajectory(frames: DataFrame) -> DataFrame:
    """Posed frames, scalar-last, six decimals."""
    return frames.where("pose_valid").select("seq_id", "i", F.format_string("%.6f %.6f %.6f %.6f %.6f %.6f %.6f %.6f", "t", *_all("tr", 3), *g.xyzw_from_wxyz(_all("q_wxyz", 4))).alias("line"))


def colmap_images(frames: DataFrame) -> DataFrame:
    """Posed frames numbered from 1, world-to-camera; the camera is its number in order of name."""
    posed = frames.where("pose_valid").withColumn("number", F.dense_rank().over(W.partitionBy("seq_id").orderBy("camera"))).withColumn("n", F.row_number().over(W.partitionBy("seq_id").orderBy("i")))
    m, tr = g.inverse(g.pose(_all("q_wxyz", 4), _all("tr", 3)))
    staged = posed.withColumn("m", F.array(*m)).withColumn("back", F.array(*tr))
    numbers = [*g.matrix_to_quat(g.elements(F.col("m"), 9)), *_all("back", 3)]
    return staged.select("seq_id", "i", F.concat_ws(" ", F.col("n").cast("string"), *[x.cast("string") for x in numbers], F.col("number").cast("string"), F.format_string("frame_%05d.png", "i")).alias("line"))


def colmap_cameras(cameras: DataFrame) -> DataFrame:
    number = F.row_number().over(W.partitionBy("seq_id").orderBy("camera"))
    return cameras.select("seq_id", "camera", F.concat_ws(" ", number.cast("string"), "model", F.col("width").cast("string"), F.col("height").cast("string"), F.array_join(F.col("params").cast("array<string>"), " ")).alias("line"))


def transforms_json(frames: DataFrame, cameras: DataFrame) -> DataFrame:
    """seq_id, document; captures with more than one camera are refused."""
    one = cameras.groupBy("seq_id").agg(F.count("*").alias("n"), F.first(F.struct("model", "params", "width", "height")).alias("c"))
    one = one.where(F.when(F.col("n") > 1, F.raise_error(F.lit("a transforms file holds one camera; export each camera on its own")).cast("boolean")).otherwise(True))
    m = g.flip_gl_cv(g.quat_to_matrix(_all("q_wxyz", 4)))
    rows = F.array(*[F.array(*m[3 * r : 3 * r + 3], F.col("tr")[r]) for r in range(3)], F.array(*[F.lit(x) for x in (0.0, 0.0, 0.0, 1.0)]))
    own = frames.where("pose_valid").select("seq_id", F.struct("i", F.format_string("images/frame_%05d.png", "i").alias("file_path"), rows.alias("transform_matrix")).alias("f"))
    listed = own.groupBy("seq_id").agg(F.transform(F.array_sort(F.collect_list("f")), lambda x: x.dropFields("i")).alias("frames"))
    k = g.intrinsics(F.col("c.model"), F.col("c.params"))
    document = F.struct(*[x.alias(n) for x, n in zip(k, ("fl_x", "fl_y", "cx", "cy"), strict=True)], F.col("c.width").alias("w"), F.col("c.height").alias("h"), "frames")
    return listed.join(one, "seq_id").select("seq_id", F.to_json(document).alias("document"))


def messages(frames: DataFrame, cameras: DataFrame, imu: DataFrame | None = None) -> DataFrame:
    """seq_id, log_time (ns), topic, schema, message (JSON): what a message log of a capture holds, without pictures."""
    stamp = text.stamp(F.col("t"))
    header = lambda frame: F.struct(stamp.alias("stamp"), frame.alias("frame_id"))
    log_time = F.round(F.col("t") * 1e9).cast("bigint").alias("log_time")
    named = lambda v, names: F.struct(*[x.alias(n) for x, n in zip(v, names, strict=True)])
    pose = F.struct(named(_all("tr", 3), "xyz").alias("translation"), named(_all("q_wxyz", 4), "wxyz").alias("rotation"))
    posed = frames.where("pose_valid").select("seq_id", log_time, F.lit("/tf").alias("topic"), F.lit("transform").alias("schema"), F.to_json(F.struct(header(F.lit("map")).alias("header"), text.optical_frame(F.col("camera")).alias("child_frame_id"), pose.alias("transform"))).alias("message"))
    k = g.intrinsics(F.col("model"), F.col("cam_params"))
    zero, one = F.lit(0.0), F.lit(1.0)
    matrices = {"k": [k[0], zero, k[2], zero, k[1], k[3], zero, zero, one], "p": [k[0], zero, k[2], zero, zero, k[1], k[3], zero, zero, zero, one, zero], "r": [one, zero, zero, zero, one, zero, zero, zero, one]}
    d = g.distortion(F.col("model"), F.col("cam_params"))
    with_camera = frames.join(cameras.withColumnRenamed("params", "cam_params"), ["seq_id", "camera"])
    info = with_camera.select(
        "seq_id", log_time, F.concat(F.lit("/camera/"), "camera", F.lit("/camera_info")), F.lit("calibration"),
        F.to_json(F.struct(header(text.optical_frame(F.col("camera"))).alias("header"), "width", "height", d["name"].alias("distortion_model"), d["d"].alias("d"), *[F.array(*v).alias(n) for n, v in matrices.items()])),
    )
    out = posed.union(info)
    if imu is not None:
        reading = F.struct(header(F.col("imu_id")).alias("header"), named([F.col(c) for c in ("gx", "gy", "gz")], "xyz").alias("angular_velocity"), named([F.col(c) for c in ("ax", "ay", "az")], "xyz").alias("linear_acceleration"), F.lit(-1.0).alias("orientation_covariance_0"))
        out = out.union(imu.select("seq_id", log_time, F.concat(F.lit("/imu/"), "imu_id"), F.lit("imu"), F.to_json(reading)))
    return out


def trim(frames: DataFrame, first: int, stop: int) -> DataFrame:
    """Frames [first, stop): the index is rebased, times stay."""
    return frames.where((F.col("i") >= first) & (F.col("i") < stop)).withColumn("i", F.col("i") - first)


def trim_imu(imu: DataFrame, kept: DataFrame) -> DataFrame:
    """Samples within the times of a capture's first and last kept frame, ends included."""
    span = kept.groupBy("seq_id").agg(F.min("t").alias("_a"), F.max("t").alias("_b"))
    return imu.join(span, "seq_id").where("t >= _a AND t <= _b").drop("_a", "_b")


def write_lines(lines: DataFrame, path: str, column: str = "line") -> None:
    """One folder per capture, lines in order of index within each file."""
    lines.repartition("seq_id").sortWithinPartitions("seq_id", "i").select("seq_id", column).write.partitionBy("seq_id").text(path)
