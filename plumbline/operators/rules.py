"""Conformance rules: each is one query whose rows are findings (seq_id, severity, section, message).

Tables are those of plumbline.sources: documents, cameras, streams, signals, frames, rigs, imu, tags.
Rules that a stopped capture doesn't reach (no document, say) find nothing for it, as joins drop it.
"""

from __future__ import annotations

from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from plumbline.functions import geometry as g
from plumbline.sources.records import CONVENTIONS

ERROR, WARNING, NOTE = "error", "warning", "note"
RANK = {ERROR: 0, WARNING: 1, NOTE: 2}
#: Roles a signal can have.
ROLES = ("depth", "confidence", "object_id", "semantic_id", "normal_packed", "custom")
UNIT_TOLERANCE = 1e-3
FRAME_BYTES, IMU_BYTES = 45, 32


def finding(rows: DataFrame, severity: str, section: str, message: Column | str) -> DataFrame:
    return rows.select("seq_id", F.lit(severity).alias("severity"), F.lit(section).alias("section"), (F.lit(message) if isinstance(message, str) else message).alias("message"))


def no_cameras(documents: DataFrame, cameras: DataFrame) -> DataFrame:
    return finding(documents.join(cameras, "seq_id", "left_anti"), ERROR, "4", "no cameras")


def camera_models(cameras: DataFrame) -> DataFrame:
    """Unknown model, wrong number of parameters, or a size that isn't positive."""
    known = F.create_map(*[F.lit(x) for k, v in g.CAMERA_MODELS.items() for x in (k, len(v))])
    arity = F.try_element_at(known, F.col("model"))
    return reduce(
        DataFrame.union,
        [
            finding(cameras.where(arity.isNull()), ERROR, "4", F.concat(F.lit("unknown camera model "), F.col("model"))),
            finding(cameras.where(arity != F.size("params")), ERROR, "4", F.concat(F.col("camera"), F.lit(": wrong number of parameters"))),
            finding(cameras.where((F.col("width") <= 0) | (F.col("height") <= 0)), ERROR, "4", F.concat(F.col("camera"), F.lit(": size is not positive"))),
        ],
    )


def conventions(documents: DataFrame) -> DataFrame:
    """documents.conventions: map<string,string>."""
    wanted = F.create_map(*[F.lit(x) for kv in CONVENTIONS.items() for x in kv])
    rows = documents.select("seq_id", "conventions", F.explode(wanted).alias("name", "value"))
    own = F.try_element_at("conventions", F.col("name"))
    return finding(rows.where(own.isNull()), WARNING, "3", F.concat(F.lit("no "), F.col("name"))).union(finding(rows.where(own != F.col("value")), ERROR, "3", F.concat(F.col("name"), F.lit(" is "), own)))


def unknown_cameras(rows: DataFrame, cameras: DataFrame, what: str) -> DataFrame:
    """rows (seq_id, camera) of frames, rigs or streams whose camera is not calibrated."""
    lost = rows.join(cameras, ["seq_id", "camera"], "left_anti").select("seq_id", "camera").distinct()
    return finding(lost, ERROR, "4", F.concat(F.lit(f"{what} names unknown camera "), F.col("camera")))


def index_order(frames: DataFrame) -> DataFrame:
    """The first record of a capture whose index is below the one before."""
    before = F.lag("i").over(W.partitionBy("seq_id").orderBy("pos"))
    bad = frames.withColumn("before", before).where("i < before").groupBy("seq_id").agg(F.min("pos").alias("pos"))
    return finding(bad, ERROR, "5", F.concat(F.lit("frame index goes back at record "), F.col("pos").cast("string")))


def duplicate_index(frames: DataFrame) -> DataFrame:
    twice = frames.groupBy("seq_id", "i").agg(F.count("*").alias("n")).where("n > 1").groupBy("seq_id").agg(F.min("i").alias("i"))
    return finding(twice, ERROR, "5", F.concat(F.lit("repeated frame index "), F.col("i").cast("string")))


def time_order(frames: DataFrame) -> DataFrame:
    """The first record of a capture whose time is before the one before's."""
    before = F.lag("t").over(W.partitionBy("seq_id").orderBy("pos"))
    bad = frames.withColumn("before", before).where("t < before").groupBy("seq_id").agg(F.min("pos").alias("pos"))
    return finding(bad, ERROR, "5", F.concat(F.lit("time goes back at record "), F.col("pos").cast("string")))


def unit_quaternions(frames: DataFrame) -> DataFrame:
    """Posed frames without a quaternion, or whose quaternion isn't of length one."""
    posed = frames.where("pose_valid")
    length = g.norm(g.elements(F.col("q_wxyz"), 4))
    at = F.concat(F.lit("frame "), F.col("i").cast("string"))
    return finding(posed.where(F.col("q_wxyz").isNull() | F.col("tr").isNull()), ERROR, "5", F.concat(at, F.lit(" is posed without a pose"))).union(
        finding(posed.where(F.col("q_wxyz").isNotNull()).where(F.abs(length - 1) > UNIT_TOLERANCE), ERROR, "5", F.concat(at, F.lit(" has no unit quaternion")))
    )


def no_poses(documents: DataFrame, frames: DataFrame) -> DataFrame:
    return finding(documents.join(frames, "seq_id", "left_anti"), WARNING, "5", "no poses")


def stream_cameras(streams: DataFrame, cameras: DataFrame) -> DataFrame:
    """Display streams (seq_id, id) that aren't a camera, where there are several to tell apart."""
    several = streams.withColumn("n", F.count("*").over(W.partitionBy("seq_id"))).where("n > 1").select("seq_id", F.col("id").alias("camera"))
    return unknown_cameras(several, cameras, "a stream")


def mixed_hdr(streams: DataFrame) -> DataFrame:
    """Captures of which some streams are HDR (hdr) and some are not."""
    both = streams.groupBy("seq_id").agg(F.countDistinct("hdr").alias("kinds")).where("kinds > 1")
    return finding(both, ERROR, "4", "some streams are HDR and some are not")


def camera_sizes(cameras: DataFrame, streams: DataFrame) -> DataFrame:
    """Cameras calibrated at another size than their stream has; a lone stream is that of every camera."""
    sized = streams.where("width IS NOT NULL AND height IS NOT NULL").withColumn("n", F.count("*").over(W.partitionBy("seq_id")))
    named = sized.select("seq_id", F.col("id"), F.col("width").alias("sw"), F.col("height").alias("sh"), "n")
    joined = cameras.join(named, "seq_id").where((F.col("n") == 1) | (F.col("id") == F.col("camera")))
    wrong = joined.where((F.col("width") != F.col("sw")) | (F.col("height") != F.col("sh")))
    size = lambda w, h: F.concat_ws("x", F.col(w).cast("string"), F.col(h).cast("string"))
    return finding(wrong, ERROR, "4", F.concat(F.col("camera"), F.lit(" is calibrated at "), size("width", "height"), F.lit(", its stream is "), size("sw", "sh")))


def signal_geometry(signals: DataFrame, stored: DataFrame) -> DataFrame:
    """Signals without an id, and those that declare another size than is stored (seq_id, id, stored_width, stored_height)."""
    nameless = finding(signals.where("id IS NULL"), ERROR, "6", "a signal has no id")
    both = signals.join(stored, ["seq_id", "id"]).where("width IS NOT NULL AND height IS NOT NULL AND (width <> stored_width OR height <> stored_height)")
    return nameless.union(finding(both, ERROR, "6", F.concat(F.col("id"), F.lit(" is stored at another size"))))


def overrides_beside_table(documents: DataFrame, tags: DataFrame) -> DataFrame:
    """Documents whose frames have parameters of their own, which a packed table beside them can't hold."""
    packed = tags.where(F.col("name").isin("FRAMES", "POSES")).select("seq_id").distinct()
    own = F.from_json(F.get_json_object("document", "$.frames"), "array<struct<params:array<double>>>")
    return finding(documents.where(F.exists(own, lambda f: F.size(f["params"]) > 0)).join(packed, "seq_id", "left_semi"), ERROR, "7", "frames have parameters of their own beside a packed table")


def declared_video(documents: DataFrame) -> DataFrame:
    """Captures whose document declares another number of video frames than are there."""
    declared = F.get_json_object("document", "$.video.frames").cast("bigint")
    off = documents.withColumn("declared", declared).where("declared > 0 AND video_frames IS NOT NULL AND declared <> video_frames")
    return finding(off, ERROR, "9", F.concat(F.col("declared").cast("string"), F.lit(" video frames are declared, "), F.col("video_frames").cast("string"), F.lit(" are there")))


def declared_frames(documents: DataFrame, frames: DataFrame) -> DataFrame:
    """Captures whose packed table declares another number of frames than it holds."""
    declared = documents.select("seq_id", F.get_json_object("document", "$.frames_binary.count").cast("bigint").alias("declared")).where("declared IS NOT NULL")
    held = frames.groupBy("seq_id").agg(F.count("*").alias("held"))
    off = declared.join(held, "seq_id", "left").where("declared <> coalesce(held, 0)")
    return finding(off, ERROR, "7", F.concat(F.col("declared").cast("string"), F.lit(" frames are declared, "), F.coalesce("held", F.lit(0)).cast("string"), F.lit(" are there")))


def rig_poses(rigs: DataFrame) -> DataFrame:
    """Rigs whose poses aren't four and three numbers, or whose rotation isn't of length one."""
    length = g.norm(g.elements(F.col("q_wxyz"), 4))
    at = F.concat(F.lit("rig "), F.col("rig_id"), F.lit(", camera "), F.col("camera"))
    whole = (F.size("q_wxyz") == 4) & (F.size("tr") == 3)
    return finding(rigs.where(~F.coalesce(whole, F.lit(False))), ERROR, "4", F.concat(at, F.lit(" has no whole pose"))).union(
        finding(rigs.where(whole).where(F.abs(length - 1) > UNIT_TOLERANCE), ERROR, "4", F.concat(at, F.lit(" has no unit quaternion")))
    )


def frame_parameters(frames: DataFrame, cameras: DataFrame) -> DataFrame:
    """Frames whose own parameters aren't as many as their camera's model has."""
    known = F.create_map(*[F.lit(x) for k, v in g.CAMERA_MODELS.items() for x in (k, len(v))])
    joined = frames.where("params IS NOT NULL").join(cameras.select("seq_id", "camera", "model"), ["seq_id", "camera"])
    return finding(joined.where(F.try_element_at(known, F.col("model")) != F.size("params")), ERROR, "5", F.concat(F.lit("frame "), F.col("i").cast("string"), F.lit(" has a wrong number of parameters")))


def index_range(frames: DataFrame) -> DataFrame:
    """Frames whose index doesn't fit a packed record."""
    return finding(frames.where("i < 0 OR i > 4294967295"), ERROR, "5", F.concat(F.lit("frame index "), F.col("i").cast("string"), F.lit(" is out of range")))


def beyond_end(frames: DataFrame, documents: DataFrame) -> DataFrame:
    """Pose records past the video's last frame (documents.video_frames)."""
    late = frames.join(documents.select("seq_id", "video_frames"), "seq_id").where("i >= video_frames").groupBy("seq_id").agg(F.count("*").alias("n"))
    return finding(late, ERROR, "5", F.concat(F.col("n").cast("string"), F.lit(" records past the end of the video")))


def value_maps(signals: DataFrame) -> DataFrame:
    """Value maps that lack what their type needs, odd roles, and geometry given by half."""
    m = F.col("value_map")
    rules = [
        (m["type"].eqNullSafe("inverse_depth") & (m["near"].isNull() | m["far"].isNull() | ~(m["near"] > 0) | ~(m["far"] > m["near"])), ERROR, "needs 0 < near < far"),
        (m["type"].eqNullSafe("inverse_depth") & (F.coalesce(m["levels"], F.lit(65536)) < 3), ERROR, "needs 3 levels or more"),
        (m["type"].eqNullSafe("linear") & (m["scale"] == 0), ERROR, "has scale 0"),
        (m["type"].eqNullSafe("labels") & m["labels"].isNull(), ERROR, "has no labels"),
        (m["type"].eqNullSafe("float16_bits") & m["invalid"].isNotNull(), WARNING, "states an invalid code for float16"),
        (m.isNull(), WARNING, "has no value map"),
        (m["type"].isNotNull() & ~m["type"].isin("linear", "inverse_depth", "labels", "identity", "float16_bits"), NOTE, "has an unknown value map"),
        (F.col("width").isNull() != F.col("height").isNull(), ERROR, "has one of width and height"),
        (~F.col("role").isin(*ROLES), WARNING, "has an unknown role"),
    ]
    return reduce(DataFrame.union, [finding(signals.where(c), s, "6", F.concat(F.col("id"), F.lit(f" {text}"))) for c, s, text in rules])


def record_lengths(tags: DataFrame) -> DataFrame:
    """Packed tags (name, value) that don't hold whole records; names are without the prefix."""
    size = F.when(F.col("name").startswith("IMU_"), IMU_BYTES).when(F.col("name").isin("FRAMES", "POSES"), FRAME_BYTES)
    return finding(tags.where(F.length("value") % size != 0), ERROR, "7", F.concat(F.col("name"), F.lit(" does not hold whole records")))


def imu_tags(imu_streams: DataFrame, tags: DataFrame) -> DataFrame:
    held = tags.where(F.col("name").startswith("IMU_")).select("seq_id", F.substr("name", F.lit(5)).alias("imu_id"))
    return finding(imu_streams.join(held, ["seq_id", "imu_id"], "left_anti"), ERROR, "8", F.concat(F.lit("no samples of "), F.col("imu_id")))


def document_format(documents: DataFrame, name: str | None = None) -> DataFrame:
    """Missing, unreadable or foreign documents, formats that aren't ``name`` (none given: any), and versions that aren't 0.x or 1.x."""
    own = F.get_json_object("document", "$.format")
    wrong = own.isNull() if name is None else ~own.eqNullSafe(F.lit(name))
    return reduce(
        DataFrame.union,
        [
            finding(documents.where("document IS NOT NULL").where(wrong), ERROR, "2", F.concat(F.lit("format is "), F.coalesce(own, F.lit("not stated")))),
            finding(documents.where("error IS NOT NULL"), ERROR, "2", F.concat(F.lit("unreadable: "), F.col("error"))),
            finding(documents.where("error IS NULL AND document IS NULL"), NOTE, "2", "no document: plain video"),
            finding(documents.where("document IS NOT NULL AND version IS NULL"), ERROR, "2", "no version"),
            finding(documents.where(~F.col("version").rlike(r"^[01]\.\d+$")), ERROR, "2", F.concat(F.lit("unknown version "), F.col("version"))),
        ],
    )


def layout(elements: DataFrame) -> DataFrame:
    """Captures without clusters, and those whose metadata comes only after the first one.

    elements: seq_id, name, start of top-level elements.
    """
    at = elements.groupBy("seq_id").agg(F.min(F.when(F.col("name") == "Cluster", F.col("start"))).alias("cluster"), F.min(F.when(F.col("name") == "Tags", F.col("start"))).alias("tags"))
    return finding(at.where("cluster IS NULL"), NOTE, "9", "no clusters").union(finding(at.where("tags > cluster"), WARNING, "9", "metadata comes after the first cluster"))


def report(*findings: DataFrame) -> DataFrame:
    """All findings by severity, then section (as text), then capture."""
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in RANK.items() for x in kv]), F.col("severity"))
    return reduce(DataFrame.unionByName, findings).orderBy(rank, "section", "seq_id", "message")


def by_severity(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity").agg(F.count("*").alias("n"))


def validate(tables: dict[str, DataFrame], name: str | None = None) -> DataFrame:
    """All rules over the tables of a set of captures; name: the format that documents should state.

    Each table is read once: what several rules read is cached, on disk if it must be.
    """
    d, c, f, s, t = (tables[k].persist(StorageLevel.MEMORY_AND_DISK) for k in ("documents", "cameras", "frames", "signals", "tags"))
    live = d.where("document IS NOT NULL")
    found = [
        document_format(d, name), conventions(live), no_cameras(live, c), camera_models(c), value_maps(s), record_lengths(t), no_poses(live, f),
        index_order(f), duplicate_index(f), time_order(f), unit_quaternions(f), unknown_cameras(f.where("pose_valid"), c, "a frame"), beyond_end(f, live.where("video_frames > 0")),
        unknown_cameras(tables["rigs"], c, "a rig"), rig_poses(tables["rigs"]), frame_parameters(f, c), index_range(f), overrides_beside_table(live, t), declared_video(live), declared_frames(live, f), imu_tags(tables["imu_streams"], t),
    ]
    if "streams" in tables:
        found += [stream_cameras(tables["streams"], c), mixed_hdr(tables["streams"]), camera_sizes(c, tables["streams"])]
    if "stored_signals" in tables:
        found.append(signal_geometry(s, tables["stored_signals"]))
    if "elements" in tables:
        found.append(layout(tables["elements"]))
    return report(*found)
