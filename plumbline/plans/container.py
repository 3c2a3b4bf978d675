"""Registered queries over capture files: tables go into containers' bytes and come back through the readers.

Each user's events are written as one capture (frames, cameras, a rig, samples, a signal, video), in
one of the forms that a file can have, and read again; the SQL gives the rows that went in.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import corpus, rules
from plumbline.plans.catalog import _lenses, _text_posed, query, r6
from plumbline.plans.views import EVENTS_SQL, FRAMES_SQL, POSED_SQL, frames
from plumbline.sources import captures, exports
from plumbline.streaming import live

#: Encoded frames of a capture: this many, or as many as it has poses.
VIDEO_FRAMES = 6
PIECE = 977

_VIDEO = "n AS (SELECT seq_id, count(*) AS n FROM frames GROUP BY 1), video AS (SELECT seq_id, unnest(range(least(n, 6))) AS k, n FROM n)"


def _captures(spark, sf) -> DataFrame:
    """seq_id, capture, video of every user."""
    f = _text_posed(spark, sf).withColumn("seq_id", F.col("seq_id").cast("string"))
    cameras = _lenses(spark, sf).withColumn("seq_id", F.col("seq_id").cast("string"))
    first = f.groupBy("seq_id").agg(F.min("camera").alias("camera"), F.count("*").alias("n"))
    rigs = first.select("seq_id", F.lit("rig0").alias("rig_id"), "camera", F.array(*[F.lit(x) for x in (1.0, 0.0, 0.0, 0.0)]).alias("q_wxyz"), F.array(F.lit(0.25), F.lit(0.0), F.col("n").cast("double")).alias("tr"))
    clicks = f.where("event_type = 'click'")
    imu = clicks.select("seq_id", F.lit("imu0").alias("imu_id"), "t", *[(F.col("event_id") % (7 + k)).cast("double").alias(c) for k, c in enumerate(("gx", "gy", "gz", "ax", "ay", "az"))])
    streams = first.select("seq_id", F.lit("imu0").alias("imu_id"), F.lit(200.0).alias("rate_hz"), F.lit("clicks").alias("description"), F.lit(None).cast("struct<q_wxyz:array<double>,tr:array<double>>").alias("extrinsics"))
    value_map = F.struct(F.lit("inverse_depth").alias("type"), F.lit(0.3).alias("near"), F.lit(9.0).alias("far"))
    signals = first.select("seq_id", F.lit("d").alias("id"), F.lit("depth").alias("role"), value_map.alias("value_map"), F.lit(16).alias("width"), F.lit(8).alias("height"))
    sequences = first.select("seq_id", F.struct((F.col("n") % 2 == 0).alias("metric_scale"), F.array(F.lit(0.0), F.lit(0.0), F.lit(-1.0)).alias("gravity_in_world"), F.lit("made").alias("description")).alias("world"))
    whole = captures.capture_json(f, cameras, signals, rigs, streams, imu, sequences=sequences)
    video = first.select("seq_id", F.transform(F.sequence(F.lit(0), F.least(F.lit(VIDEO_FRAMES), F.col("n")) - 1), lambda k: F.concat(F.lit("v"), k.cast("string")).cast("binary")).alias("video"))
    return whole.join(video, "seq_id")


def _files(spark, sf, form="auto", as_live=False) -> DataFrame:
    return captures.encode(_captures(spark, sf), form=form, live=as_live)


def _pose_columns(f: DataFrame) -> DataFrame:
    return f.select("seq_id", "i", "t", "camera", "pose_valid", r6(F.col("q_wxyz")[0]).alias("qw"), r6(F.col("tr")[2]).alias("z"))


_POSES = POSED_SQL + " SELECT CAST(seq_id AS VARCHAR) AS seq_id, pos AS i, t, CAST(camera AS VARCHAR) AS camera, pose_valid, round(CASE WHEN pose_valid THEN v[1] END, 6)+0.0 AS qw, round(CASE WHEN pose_valid THEN v[7] END, 6)+0.0 AS z FROM frames JOIN vec ON vec_id = event_id % vectors"


@query(_POSES)
def capture_frames_json(spark, sf):
    """Frames of the document itself."""
    return _pose_columns(captures.decode(_files(spark, sf, "json")))


@query(_POSES)
def capture_frames_table(spark, sf):
    """Frames of a packed table (poses in single precision, as the vectors are)."""
    return _pose_columns(captures.decode(_files(spark, sf, "binary")))


@query(_POSES)
def capture_frames_live(spark, sf):
    """Frames of a live file: chunks before the clusters, then a table that replaces them."""
    return _pose_columns(captures.decode(_files(spark, sf, as_live=True)))


@query(_POSES)
def capture_stream_events(spark, sf):
    """A live file in pieces of any size through the stateful parser."""
    whole = _files(spark, sf, as_live=True)
    cut = F.sequence(F.lit(0), F.floor((F.length("content") - 1) / PIECE).cast("int"))
    pieces = whole.select("seq_id", F.explode(cut).alias("chunk_no"), "content").select("seq_id", F.col("chunk_no").cast("bigint").alias("chunk_no"), F.expr(f"substring(content, CAST(chunk_no * {PIECE} + 1 AS INT), {PIECE})").alias("chunk"))
    return _pose_columns(live.frames_of_events(live.parse_stream(pieces)))


@query(FRAMES_SQL + ", n AS (SELECT seq_id, count(*) AS n, count_if(event_type = 'click') AS c FROM frames GROUP BY 1) SELECT CAST(seq_id AS VARCHAR) AS seq_id, 'FRAMES' AS name, true AS is_binary, CAST(45 * n AS BIGINT) AS bytes FROM n UNION ALL SELECT CAST(seq_id AS VARCHAR), 'IMU_imu0', true, CAST(32 * c AS BIGINT) FROM n UNION ALL SELECT CAST(seq_id AS VARCHAR), 'DOCUMENT', false, CAST(NULL AS BIGINT) FROM n")
def capture_tags(spark, sf):
    """Tags of a file with a packed table, and the bytes of packed ones."""
    t = captures.decode(_files(spark, sf, "binary"), "tags")
    return t.select("seq_id", "name", "is_binary", F.when(F.col("is_binary"), F.length("value")).cast("bigint").alias("bytes"))


@query(FRAMES_SQL + ", " + _VIDEO + " SELECT CAST(seq_id AS VARCHAR) AS seq_id, CAST(k AS INTEGER) AS ord, CAST(k AS BIGINT) AS first, CAST(1 AS BIGINT) AS frames, true AS independent FROM video")
def capture_clusters(spark, sf):
    """Clusters from the heads of their blocks."""
    return captures.decode(_files(spark, sf), "clusters").select("seq_id", "ord", "first", "frames", "independent")


@query(FRAMES_SQL + ", " + _VIDEO + " SELECT CAST(seq_id AS VARCHAR) AS seq_id, CAST(k AS BIGINT) AS i, CAST(k AS INTEGER) AS cluster, 'v' || k AS data FROM video WHERE k >= 2 AND k <= 4")
def capture_packets(spark, sf):
    """Encoded frames 2 to 4: only the clusters that hold them are read."""
    return captures.decode(_files(spark, sf), "packets", low=2, high=4).select("seq_id", "i", "cluster", F.col("data").cast("string").alias("data"))


@query(FRAMES_SQL + ", n AS (SELECT seq_id, count(*) AS n FROM frames GROUP BY 1) SELECT CAST(seq_id AS VARCHAR) AS seq_id, CAST(least(n, 6) AS INTEGER) AS cues, 1 AS clusters, true AS cheap FROM n")
def capture_headers(spark, sf):
    """Reads up to the first cluster: cues from the index, and no more bytes than the header or one probe (and the cues) has."""
    h = captures.decode(_files(spark, sf), "headers", header_only=True)
    return h.select("seq_id", "cues", "clusters", (F.col("fetched") <= 2 * F.greatest(F.col("extent"), F.lit(8192)) + 512).alias("cheap"))


@query(_POSES)
def capture_frames_of_headers(spark, sf):
    """The same frames from headers alone."""
    return _pose_columns(captures.decode(_files(spark, sf, "binary"), header_only=True))


@query(FRAMES_SQL + ", n AS (SELECT seq_id, count(*) AS n FROM frames GROUP BY 1) SELECT CAST(seq_id AS VARCHAR) AS seq_id, '1.3' AS version, n % 2 = 0 AS metric_scale, CAST(-1 AS DOUBLE) AS down, 'RDF' AS axes, CAST(least(n, 6) AS BIGINT) AS video_frames FROM n")
def capture_sequences(spark, sf):
    s = captures.decode(_files(spark, sf), "sequences").where("error IS NULL")
    return s.select("seq_id", "version", "world.metric_scale", F.col("world.gravity_in_world")[2].alias("down"), F.col("conventions")["camera_axes"].alias("axes"), "video_frames")


@query(FRAMES_SQL + " SELECT DISTINCT CAST(seq_id AS VARCHAR) AS seq_id, CAST(camera AS VARCHAR) AS camera, 'PINHOLE' AS model, 640 AS width, 5.1e2 AS fy FROM frames")
def capture_cameras(spark, sf):
    return captures.decode(_files(spark, sf), "cameras").select("seq_id", "camera", "model", "width", F.col("params")[1].alias("fy"))


@query(FRAMES_SQL + " SELECT CAST(seq_id AS VARCHAR) AS seq_id, 'rig0' AS rig_id, min(CAST(camera AS VARCHAR)) AS camera, 25e-2 AS x, CAST(count(*) AS DOUBLE) AS z FROM frames GROUP BY seq_id")
def capture_rigs(spark, sf):
    return captures.decode(_files(spark, sf), "rigs").select("seq_id", "rig_id", "camera", F.col("tr")[0].alias("x"), F.col("tr")[2].alias("z"))


@query(FRAMES_SQL + " SELECT CAST(seq_id AS VARCHAR) AS seq_id, 'imu0' AS imu_id, t, CAST(event_id % 7 AS DOUBLE) AS gx, CAST(event_id % 12 AS DOUBLE) AS az FROM frames WHERE event_type = 'click'")
def capture_imu(spark, sf):
    """Packed samples."""
    return captures.decode(_files(spark, sf), "imu").select("seq_id", "imu_id", "t", "gx", "az")


@query(FRAMES_SQL + " SELECT DISTINCT CAST(seq_id AS VARCHAR) AS seq_id, 'd' AS id, 'depth' AS role, 'inverse_depth' AS type, 3e-1 AS near, 8 AS height FROM frames")
def capture_signals(spark, sf):
    return captures.decode(_files(spark, sf), "signals").select("seq_id", "id", "role", "value_map.type", "value_map.near", "height")


@query(FRAMES_SQL + ", n AS (SELECT seq_id, count(*) AS n FROM frames GROUP BY 1) SELECT CAST(seq_id AS VARCHAR) AS seq_id, least(n, 6) AS clusters, n AS frames, CAST(1 AS BIGINT) AS heads, CAST(2 AS BIGINT) AS tags FROM n")
def capture_retagged(spark, sf):
    """Own tags replaced by those of another form of the file: head, clusters and video stay, the table is new."""
    plain = _files(spark, sf, "json")
    table = captures.decode(_files(spark, sf, "binary"), "tags").where("name <> 'IMU_imu0'").select("seq_id", "name", "value")
    document = table.where("name = 'DOCUMENT'").select("seq_id", "name", F.regexp_replace(F.col("value").cast("string"), '"imu":\\{.*?\\}\\}', '"imu":{}').cast("binary").alias("value"))
    again = captures.retag(plain, table.where("name <> 'DOCUMENT'").union(document))
    heads = again.select("seq_id", F.position(F.lit("webm"), F.substring(F.col("content").cast("binary"), 1, 64).cast("string")).alias("at")).where("at > 0").groupBy("seq_id").agg(F.count("*").alias("heads"))
    count = lambda relation, name: captures.decode(again, relation).groupBy("seq_id").agg(F.count("*").alias(name))
    return count("clusters", "clusters").join(count("frames", "frames"), "seq_id").join(heads, "seq_id").join(count("tags", "tags"), "seq_id")


@query(FRAMES_SQL + ", k AS (SELECT seq_id, count(*) AS frames, min(t) AS a, max(t) AS b FROM frames WHERE pos >= 1 AND pos < 4 GROUP BY 1), n AS (SELECT seq_id, count(*) AS n FROM frames GROUP BY 1), s AS (SELECT f.seq_id, count(*) AS samples FROM frames f JOIN k USING (seq_id) WHERE event_type = 'click' AND t >= a AND t <= b GROUP BY 1) SELECT CAST(k.seq_id AS VARCHAR) AS seq_id, frames, CAST(greatest(0, least(n, 4) - 1) AS BIGINT) AS packets, coalesce(samples, 0) AS samples, CAST(1 AS BIGINT) AS rigs FROM k JOIN n USING (seq_id) LEFT JOIN s USING (seq_id)")
def capture_trimmed(spark, sf):
    """Frames [1, 4) as a file of its own, read again: poses, video, samples and rig all come along."""
    whole = _files(spark, sf).persist(StorageLevel.DISK_ONLY)
    part = lambda relation: captures.decode(whole, relation)
    kept = exports.trim(part("frames"), 1, 4)
    again = captures.capture_json(kept, part("cameras"), part("signals"), part("rigs"), part("imu_streams"), exports.trim_imu(part("imu"), kept), part("streams"), part("sequences"))
    files = captures.encode(captures.with_packets(again, part("packets"), 1, 4))
    count = lambda relation, name: captures.decode(files, relation).groupBy("seq_id").agg(F.count("*").alias(name))
    out = count("frames", "frames").join(count("packets", "packets"), "seq_id", "left").join(count("imu", "samples"), "seq_id", "left").join(count("rigs", "rigs"), "seq_id")
    return out.select("seq_id", "frames", F.coalesce("packets", F.lit(0)).alias("packets"), F.coalesce("samples", F.lit(0)).alias("samples"), "rigs")


@query(FRAMES_SQL + ", k AS (SELECT seq_id, count(*) AS n, count_if(pose_valid) AS p FROM frames GROUP BY 1), z AS (SELECT CAST(seq_id AS VARCHAR) AS seq_id, CASE WHEN n > 6 THEN 'error' END AS a, CASE WHEN n > 6 THEN n - 6 || ' records past the end of the video' END AS m FROM k) SELECT seq_id, a AS severity, m AS message FROM z WHERE a IS NOT NULL")
def capture_validation(spark, sf):
    """What the rules say of whole files (unit length of the made-up rotations left out): more poses than video."""
    files = _files(spark, sf, "binary").persist(StorageLevel.DISK_ONLY)
    names = {"documents": "sequences"} | {k: k for k in ("cameras", "frames", "signals", "rigs", "imu", "imu_streams", "streams", "tags")}
    tables = {k: captures.decode(files, v) for k, v in names.items()}
    top = captures.decode(files, "elements").where("depth = 0")
    found = rules.validate(tables | {"elements": top}, "posed-video")
    return found.where("message NOT LIKE '%unit quaternion%'").select("seq_id", "severity", "message")


@query(FRAMES_SQL + " SELECT CAST(seq_id AS VARCHAR) AS uri, CAST(pos AS BIGINT) AS pos, t FROM frames WHERE seq_id = (SELECT seq_id FROM (SELECT seq_id, sum(count(*)) OVER (ORDER BY seq_id) AS hi, sum(count(*)) OVER (ORDER BY seq_id) - count(*) AS lo FROM frames GROUP BY 1) WHERE lo <= 123 AND hi > 123) AND pos = 123 - (SELECT max(hi) FROM (SELECT sum(count(*)) OVER (ORDER BY seq_id) AS hi FROM frames GROUP BY seq_id) WHERE hi <= 123)")
def frame_by_global_index(spark, sf):
    """Frame 123 of the corpus."""
    f = frames(spark, sf).withColumn("uri", F.col("seq_id").cast("string"))
    members = corpus.describe(f).select(F.col("seq_id").alias("mi"), F.col("seq_id").cast("string").alias("uri"), "frames")
    return corpus.frame_at(f, members, 123).select("uri", "pos", "t")


_ITER = POSED_SQL + " SELECT i, CAST(seq_id AS BIGINT) AS member, round(m00, 6)+0.0 AS m00, round(x, 6)+0.0 AS x FROM rot WHERE pose_valid AND seq_id % 4 = 1"


def _training(spark, sf, **options):
    f = _text_posed(spark, sf).withColumn("i", F.col("event_id"))
    members = corpus.describe(f).withColumn("mi", F.col("seq_id"))
    got = corpus.iter_frames(f, members, shard_of_members=(1, 4), posed_only=True, **options)
    norm = F.sqrt(sum((F.col("q_wxyz")[k] * F.col("q_wxyz")[k] for k in range(1, 4)), F.col("q_wxyz")[0] * F.col("q_wxyz")[0]))
    return got.select("i", "member", r6(F.col("c2w")[0]).alias("m00"), r6(F.col("c2w")[3]).alias("x"), norm.alias("norm")).drop("norm")


@query(_ITER)
def training_frames(spark, sf):
    """Posed frames of one shard of whole members, with their matrices."""
    return _training(spark, sf)


@query(EVENTS_SQL + " SELECT CAST(count(*) AS BIGINT) AS frames, CAST(count(DISTINCT event_id) AS BIGINT) AS different FROM ev WHERE event_type <> 'error'")
def training_order(spark, sf):
    """Three seeded shards with a shuffle buffer have every posed frame once."""
    f = _text_posed(spark, sf).withColumn("i", F.col("event_id"))
    members = corpus.describe(f).withColumn("mi", F.col("seq_id"))
    parts = [corpus.iter_frames(f, members, shard_of_members=(k, 3), seed=corpus.epoch_seed(5, 2), buffer=64, posed_only=True).select("i") for k in range(3)]
    return parts[0].union(parts[1]).union(parts[2]).agg(F.count("*").alias("frames"), F.countDistinct("i").alias("different"))


@query(FRAMES_SQL + ", c AS (SELECT DISTINCT seq_id, camera FROM frames), s AS (SELECT seq_id, count(*) AS n FROM frames GROUP BY 1) SELECT (SELECT string_agg(DISTINCT CAST(camera AS VARCHAR), ',' ORDER BY CAST(camera AS VARCHAR)) FROM c) AS cameras, '640x480' AS resolutions, 'd' AS signals, (SELECT string_agg(DISTINCT CASE WHEN n % 2 = 0 THEN 'true' ELSE 'false' END, ',' ORDER BY CASE WHEN n % 2 = 0 THEN 'true' ELSE 'false' END) FROM s) AS scales")
def corpus_sets(spark, sf):
    """Distinct cameras, resolutions, signals and scales of a corpus of files."""
    files = _files(spark, sf)
    members = captures.decode(files, "sequences").select("world.metric_scale")
    found = corpus.distinct_sets(captures.decode(files, "cameras"), captures.decode(files, "signals"), members)
    return found.select(*[F.array_join(c, ",").alias(c) for c in ("cameras", "resolutions", "signals", "scales")])
