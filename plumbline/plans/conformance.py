"""Registered queries: each conformance rule, the joins of the conversions, and planes, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import geometry as g
from plumbline.functions import text
from plumbline.operators import align, corpus, planes, rules
from plumbline.plans.catalog import _kind, _lenses, _text_posed, query, r6
from plumbline.plans.views import EVENTS_SQL, FRAMES_SQL, POSED_SQL, events, frames, posed, table
from plumbline.sources import convert, exports
from plumbline.streaming import live

# --- rules ------------------------------------------------------------------------------------------


def _suppliers(spark, sf) -> DataFrame:
    return table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("seq_id"), F.col("s_nationkey").alias("k"), F.col("s_suppkey").alias("n"))


def _said(found: DataFrame) -> DataFrame:
    return found.select("seq_id", "severity", "message")


_S = "WITH s AS (SELECT CAST(s_suppkey AS VARCHAR) AS seq_id, s_nationkey AS k, s_suppkey AS n FROM supplier)"


@query(_S + """ SELECT seq_id, 'error' AS severity, 'unknown camera model FISH' AS message FROM s WHERE k % 3 = 0
UNION ALL SELECT seq_id, 'error', 'c: wrong number of parameters' FROM s WHERE k % 3 = 1 AND n % 2 = 0
UNION ALL SELECT seq_id, 'error', 'c: size is not positive' FROM s WHERE n % 5 = 0""")
def rule_camera_models(spark, sf):
    model = F.when(F.col("k") % 3 == 0, "FISH").when(F.col("k") % 3 == 1, "RADIAL").otherwise("PINHOLE")
    params = F.when((F.col("k") % 3 == 1) & (F.col("n") % 2 == 1), F.array_repeat(F.lit(1.0), 5)).otherwise(F.array_repeat(F.lit(1.0), 4))
    return _said(rules.camera_models(_suppliers(spark, sf).select("seq_id", F.lit("c").alias("camera"), model.alias("model"), F.when(F.col("n") % 5 == 0, 0).otherwise(640).alias("width"), F.lit(480).alias("height"), params.alias("params"))))


@query(_S + """, e AS (SELECT * FROM (VALUES ('camera_axes', 'RDF'), ('pose_direction', 'camera_to_world'), ('quaternion_order', 'wxyz'), ('units', 'meters'), ('timestamp_units', 'seconds')) t(name, value))
SELECT seq_id, 'warning' AS severity, 'no ' || name AS message FROM s, e WHERE name NOT IN ('units', 'camera_axes')
UNION ALL SELECT seq_id, 'error', 'camera_axes is RUB' FROM s WHERE k % 2 = 0""")
def rule_conventions(spark, sf):
    stated = F.create_map(F.lit("units"), F.lit("meters"), F.lit("camera_axes"), F.when(F.col("k") % 2 == 0, "RUB").otherwise("RDF"))
    return _said(rules.conventions(_suppliers(spark, sf).select("seq_id", stated.alias("conventions"))))


@query(_S + """ SELECT seq_id, 'error' AS severity, 'd needs 0 < near < far' AS message FROM s WHERE k % 6 = 0
UNION ALL SELECT seq_id, 'error', 'd needs 3 levels or more' FROM s WHERE k % 6 = 0 AND n % 2 = 0
UNION ALL SELECT seq_id, 'error', 'd has scale 0' FROM s WHERE k % 6 = 1 AND n % 2 = 0
UNION ALL SELECT seq_id, 'error', 'd has no labels' FROM s WHERE k % 6 = 2
UNION ALL SELECT seq_id, 'warning', 'd states an invalid code for float16' FROM s WHERE k % 6 = 3 AND n % 2 = 1
UNION ALL SELECT seq_id, 'warning', 'd has no value map' FROM s WHERE k % 6 = 4
UNION ALL SELECT seq_id, 'note', 'd has an unknown value map' FROM s WHERE k % 6 = 5
UNION ALL SELECT seq_id, 'error', 'd has one of width and height' FROM s WHERE n % 3 = 0
UNION ALL SELECT seq_id, 'warning', 'd has an unknown role' FROM s WHERE n % 7 = 0""")
def rule_value_maps(spark, sf):
    k, n = F.col("k") % 6, F.col("n")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("inverse_depth", "linear", "labels", "float16_bits", "none", "cubic")]), (k + 1).cast("int"))
    m = F.struct(
        kind.alias("type"), F.when(n % 2 == 0, 0.0).otherwise(1.0).alias("scale"), F.lit(0.0).alias("offset"), F.when(n % 2 == 1, 7).alias("invalid"), F.lit(2.0).alias("near"), F.lit(1.0).alias("far"), F.when(n % 2 == 0, 2).alias("levels"), F.lit(None).cast("map<string,string>").alias("labels")
    )
    s = _suppliers(spark, sf).select("seq_id", F.lit("d").alias("id"), F.when(n % 7 == 0, "smell").otherwise("depth").alias("role"), F.when(k != 4, m).alias("value_map"), F.lit(16).alias("width"), F.when(n % 3 != 0, 16).alias("height"))
    return _said(rules.value_maps(s))


@query("SELECT CAST(page_id AS VARCHAR) AS seq_id, 'error' AS severity, 'FRAMES does not hold whole records' AS message FROM pages WHERE strlen(html) % 45 <> 0 UNION ALL SELECT CAST(page_id AS VARCHAR), 'error', 'IMU_a does not hold whole records' FROM pages WHERE strlen(html) % 32 <> 0")
def rule_record_lengths(spark, sf):
    p = table(spark, sf, "pages").select(F.col("page_id").cast("string").alias("seq_id"), F.explode(F.array(F.lit("FRAMES"), F.lit("IMU_a"), F.lit("OTHER"))).alias("name"), F.col("html").cast("binary").alias("value"))
    return _said(rules.record_lengths(p))


@query(_S + " SELECT seq_id, 'error' AS severity, 'no samples of imu' || k % 3 AS message FROM s WHERE n % 4 <> 0")
def rule_imu_tags(spark, sf):
    s = _suppliers(spark, sf).withColumn("imu_id", F.concat(F.lit("imu"), (F.col("k") % 3).cast("string")))
    tags = s.where("n % 4 = 0").select("seq_id", F.concat(F.lit("IMU_"), "imu_id").alias("name"))
    return _said(rules.imu_tags(s, tags))


def _documents(spark, sf) -> DataFrame:
    body = F.concat(F.lit('{"format":"'), F.when(F.col("n") % 3 == 0, "foreign").otherwise("posed-video"), F.lit('","video":{"frames":'), (F.col("k") + 1).cast("string"), F.lit('},"frames_binary":{"count":'), (F.col("n") % 3).cast("string"), F.lit('},"frames":[{"i":0,"params":['), F.when(F.col("n") % 5 == 0, "1.5").otherwise(""), F.lit("]}]}"))
    s = _suppliers(spark, sf)
    bad, plain = F.col("n") % 7 == 0, F.col("n") % 7 == 1
    return s.select("seq_id", "k", "n", F.when(~bad & ~plain, body).alias("document"), F.when(~bad & ~plain & (F.col("n") % 4 != 0), F.concat((F.col("n") % 3).cast("string"), F.lit(".0"))).alias("version"), F.when(bad, "no segment").alias("error"), F.lit(10).cast("bigint").alias("video_frames"))


_D = _S + ", d AS (SELECT *, n % 7 = 0 AS bad, n % 7 = 1 AS plain FROM s)"


@query(_D + """ SELECT seq_id, 'error' AS severity, 'unreadable: no segment' AS message FROM d WHERE bad
UNION ALL SELECT seq_id, 'note', 'no document: plain video' FROM d WHERE plain
UNION ALL SELECT seq_id, 'error', 'format is foreign' FROM d WHERE NOT bad AND NOT plain AND n % 3 = 0
UNION ALL SELECT seq_id, 'error', 'no version' FROM d WHERE NOT bad AND NOT plain AND n % 4 = 0
UNION ALL SELECT seq_id, 'error', 'unknown version 2.0' FROM d WHERE NOT bad AND NOT plain AND n % 4 <> 0 AND n % 3 = 2""")
def rule_document_format(spark, sf):
    return _said(rules.document_format(_documents(spark, sf), "posed-video"))


@query(_D + " SELECT seq_id, 'error' AS severity, k + 1 || ' video frames are declared, 10 are there' AS message FROM d WHERE NOT bad AND NOT plain AND k + 1 <> 10")
def rule_declared_video(spark, sf):
    return _said(rules.declared_video(_documents(spark, sf)))


@query(_D + " SELECT seq_id, 'error' AS severity, n % 3 || ' frames are declared, ' || n % 2 || ' are there' AS message FROM d WHERE NOT bad AND NOT plain AND n % 3 <> n % 2")
def rule_declared_frames(spark, sf):
    held = _suppliers(spark, sf).where("n % 2 = 1")
    return _said(rules.declared_frames(_documents(spark, sf), held))


@query(_D + " SELECT seq_id, 'error' AS severity, 'frames have parameters of their own beside a packed table' AS message FROM d WHERE NOT bad AND NOT plain AND n % 5 = 0 AND n % 2 = 0")
def rule_overrides(spark, sf):
    tags = _suppliers(spark, sf).where("n % 2 = 0").select("seq_id", F.lit("FRAMES").alias("name"))
    return _said(rules.overrides_beside_table(_documents(spark, sf), tags))


@query(_D + " SELECT seq_id, 'error' AS severity, 'no cameras' AS message FROM d WHERE n % 2 = 0")
def rule_no_cameras(spark, sf):
    d = _documents(spark, sf)
    return _said(rules.no_cameras(d, d.where("n % 2 = 1").select("seq_id")))


def _streams(spark, sf) -> DataFrame:
    """One stream or two of each supplier."""
    s = _suppliers(spark, sf)
    ids = F.when(F.col("n") % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("rgb")))
    return s.select("seq_id", "k", "n", F.posexplode(ids).alias("ord", "id")).withColumn("width", F.lit(640)).withColumn("height", (480 + F.col("k") % 2).cast("int")).withColumn("hdr", (F.col("ord") == 1) & (F.col("n") % 4 == 0))


@query(_S + " SELECT seq_id, 'error' AS severity, 'a stream names unknown camera b' AS message FROM s WHERE n % 2 = 0 AND k % 3 = 0")
def rule_stream_cameras(spark, sf):
    s = _streams(spark, sf)
    return _said(rules.stream_cameras(s, s.where("id = 'a' OR k % 3 <> 0").select("seq_id", F.col("id").alias("camera"))))


@query(_S + " SELECT seq_id, 'error' AS severity, 'some streams are HDR and some are not' AS message FROM s WHERE n % 4 = 0")
def rule_mixed_hdr(spark, sf):
    return _said(rules.mixed_hdr(_streams(spark, sf)))


@query(_S + " SELECT seq_id, 'error' AS severity, 'a is calibrated at 640x480, its stream is 640x481' AS message FROM s WHERE k % 2 = 1")
def rule_camera_sizes(spark, sf):
    cameras = _suppliers(spark, sf).select("seq_id", F.lit("a").alias("camera"), F.lit(640).alias("width"), F.lit(480).alias("height"))
    return _said(rules.camera_sizes(cameras, _streams(spark, sf)))


@query(_S + " SELECT seq_id, 'error' AS severity, CASE WHEN n % 5 = 0 THEN 'a signal has no id' ELSE 'd is stored at another size' END AS message FROM s WHERE n % 5 = 0 OR k % 2 = 0")
def rule_signal_geometry(spark, sf):
    s = _suppliers(spark, sf)
    signals = s.select("seq_id", F.when(F.col("n") % 5 != 0, "d").alias("id"), F.lit(16).alias("width"), F.lit(8).alias("height"))
    stored = s.select("seq_id", F.lit("d").alias("id"), F.lit(16).alias("stored_width"), F.when(F.col("k") % 2 == 0, 9).otherwise(8).alias("stored_height"))
    return _said(rules.signal_geometry(signals, stored))


@query(_S + " SELECT seq_id, 'error' AS severity, CASE WHEN n % 3 = 0 THEN 'rig r, camera c has no whole pose' ELSE 'rig r, camera c has no unit quaternion' END AS message FROM s WHERE n % 3 = 0 OR k % 2 = 0")
def rule_rig_poses(spark, sf):
    q = F.array(F.when(F.col("k") % 2 == 0, 2.0).otherwise(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0))
    rigs = _suppliers(spark, sf).select("seq_id", F.lit("r").alias("rig_id"), F.lit("c").alias("camera"), q.alias("q_wxyz"), F.when(F.col("n") % 3 == 0, F.array(F.lit(0.0))).otherwise(F.array_repeat(F.lit(0.0), 3)).alias("tr"))
    return _said(rules.rig_poses(rigs))


@query(FRAMES_SQL + " SELECT CAST(seq_id AS VARCHAR) AS seq_id, 'error' AS severity, 'frame ' || i || ' has a wrong number of parameters' AS message FROM frames WHERE event_id % 11 = 0")
def rule_frame_parameters(spark, sf):
    f = frames(spark, sf).select(F.col("seq_id").cast("string").alias("seq_id"), "i", F.lit("c").alias("camera"), F.when(F.col("event_id") % 11 == 0, F.array(F.lit(1.0))).when(F.col("event_id") % 2 == 0, F.array_repeat(F.lit(1.0), 4)).alias("params"))
    return _said(rules.frame_parameters(f, f.select("seq_id", "camera").distinct().withColumn("model", F.lit("PINHOLE"))))


@query(FRAMES_SQL + " SELECT CAST(seq_id AS VARCHAR) AS seq_id, 'error' AS severity, 'frame index ' || (i - 5) * 1000000 || ' is out of range' AS message FROM frames WHERE (i - 5) * 1000000 < 0 OR (i - 5) * 1000000 > 4294967295")
def rule_index_range(spark, sf):
    return _said(rules.index_range(frames(spark, sf).select(F.col("seq_id").cast("string").alias("seq_id"), ((F.col("i") - 5) * 1000000).alias("i"))))


@query(FRAMES_SQL + ", b AS (SELECT seq_id, count(*) AS n FROM frames WHERE pos >= seq_id % 9 GROUP BY 1) SELECT CAST(seq_id AS VARCHAR) AS seq_id, 'error' AS severity, n || ' records past the end of the video' AS message FROM b")
def rule_beyond_end(spark, sf):
    f = frames(spark, sf).withColumn("i", F.col("pos"))
    found = rules.beyond_end(f, f.select("seq_id").distinct().withColumn("video_frames", F.col("seq_id") % 9))
    return _said(found.withColumn("seq_id", F.col("seq_id").cast("string")))


@query("WITH c AS (SELECT conv_id, min(CASE WHEN role = 'user' THEN turn END) AS a, min(CASE WHEN role = 'assistant' THEN turn END) AS b FROM conversations GROUP BY 1) SELECT CAST(conv_id AS VARCHAR) AS seq_id, 'note' AS severity, 'no clusters' AS message FROM c WHERE b IS NULL UNION ALL SELECT CAST(conv_id AS VARCHAR), 'warning', 'metadata comes after the first cluster' FROM c WHERE a > b")
def rule_layout(spark, sf):
    """Turns as elements: a user's are tags, an assistant's clusters."""
    name = F.when(F.col("role") == "user", "Tags").when(F.col("role") == "assistant", "Cluster").otherwise("Void")
    return _said(rules.layout(table(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("seq_id"), name.alias("name"), F.col("turn").alias("start"))))


# --- conversions ------------------------------------------------------------------------------------


@query(FRAMES_SQL + """, l AS (SELECT * FROM frames WHERE event_type = 'purchase'), r AS (SELECT * FROM frames WHERE event_type = 'view'),
p AS (SELECT l.seq_id, l.i, l.t, r.i AS pi, r.t AS pt FROM l ASOF LEFT JOIN r ON l.seq_id = r.seq_id AND l.t >= r.t),
n AS (SELECT l.seq_id, l.i, r.i AS ni, r.t AS nt FROM l ASOF LEFT JOIN r ON l.seq_id = r.seq_id AND l.t <= r.t),
b AS (SELECT p.*, CASE WHEN nt IS NULL OR t - pt <= nt - t THEN pi ELSE ni END AS j, CASE WHEN nt IS NULL OR t - pt <= nt - t THEN t - pt ELSE nt - t END AS d FROM p JOIN n USING (seq_id, i))
SELECT seq_id, row_number() OVER (PARTITION BY seq_id ORDER BY i) - 1 AS i, CAST(i AS VARCHAR) AS name, coalesce(d < 7200, false) AS pose_valid, CASE WHEN d < 7200 THEN CAST(j AS DOUBLE) END AS x FROM b""")
def listed_sequence(spark, sf):
    """Pictures without depth, each with the nearest pose."""
    f = frames(spark, sf)
    images = _kind(f, "purchase").select("seq_id", F.col("i").alias("pos"), "t", F.col("i").cast("string").alias("name"))
    truth = _kind(f, "view").select("seq_id", F.col("i").alias("pos"), "t", F.array_repeat(F.lit(0.5), 4).alias("q_wxyz"), F.array(F.col("i").cast("double"), F.lit(0.0), F.lit(0.0)).alias("tr"))
    return convert.listed(images, None, truth, max_dt=7200.0).select("seq_id", "i", "name", "pose_valid", F.col("tr")[0].alias("x"))


@query(FRAMES_SQL + """, o AS (SELECT seq_id, 2 * pos AS i, t FROM frames WHERE pose_valid), n AS (SELECT seq_id, least(max(i) + 1, 40) AS n FROM o GROUP BY 1), e AS (SELECT seq_id, unnest(range(n)) AS i FROM n)
SELECT seq_id, i, coalesce(last_value(t IGNORE NULLS) OVER (PARTITION BY seq_id ORDER BY i ROWS UNBOUNDED PRECEDING), 0.0) AS t, t IS NOT NULL AS pose_valid FROM e LEFT JOIN o USING (seq_id, i)""")
def indexed_sequence(spark, sf):
    """Poses of every second frame, by index; times carried on."""
    f = frames(spark, sf)
    odometry = f.where("pose_valid").select("seq_id", (2 * F.col("pos")).alias("i"), "t", F.array_repeat(F.lit(0.5), 4).alias("q_wxyz"), F.array_repeat(F.lit(0.0), 3).alias("tr"))
    lengths = f.select("seq_id").distinct().withColumn("frames", F.lit(40).cast("bigint"))
    return convert.indexed(odometry, lengths).select("seq_id", "i", "t", "pose_valid")


@query("WITH c AS (SELECT c_custkey AS seq_id, c_nationkey AS p, c_custkey % 4 AS s FROM customer), e AS (SELECT *, unnest(range(p + 2)) AS i FROM c) SELECT seq_id, i, round(CASE WHEN i < s THEN i * 5e-1 ELSE i / 30.0 END, 6) AS t, i < p AS pose_valid, CASE WHEN i < p THEN CAST(i AS DOUBLE) END AS x FROM e")
def positional_sequence(spark, sf):
    """Lists of poses and stamps that are shorter than the video."""
    c = table(spark, sf, "customer")
    upto = lambda n, f: F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), f)).otherwise(F.array())
    p, s = F.col("c_nationkey").cast("int"), (F.col("c_custkey") % 4).cast("int")
    pose = lambda k: F.array(*[F.lit(0.5)] * 4, k.cast("double"), F.lit(0.0), F.lit(0.0))
    d = c.select(F.col("c_custkey").alias("seq_id"), (p + 2).cast("bigint").alias("frames"), F.lit(30.0).alias("fps"), upto(p, pose).cast("array<array<double>>").alias("poses"), upto(s, lambda k: 7 + k * 0.5).cast("array<double>").alias("stamps"))
    return convert.by_position(d).select("seq_id", "i", r6(F.col("t")).alias("t"), "pose_valid", F.col("tr")[0].alias("x"))


@query("WITH n AS (SELECT c_nationkey AS seq_id, c_custkey AS stem, c_nationkey % 3 = 0 AS d, c_nationkey % 2 = 0 OR c_custkey % 2 = 0 AS c FROM customer) SELECT seq_id, CAST(stem AS VARCHAR) AS stem, d AS has_depth, min(c) OVER (PARTITION BY seq_id) AS has_confidence FROM n")
def key_frames(spark, sf):
    """Depth is there for all or none of a sequence's key frames; confidence for some counts as none."""
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("seq_id"), F.col("c_custkey").cast("string").alias("stem"), F.col("c_custkey").alias("n"))
    return convert.by_stem(c, c.where("seq_id % 3 = 0"), c.where("seq_id % 2 = 0 OR n % 2 = 0")).select("seq_id", "stem", "has_depth", "has_confidence")


@query(FRAMES_SQL + ", p AS (SELECT seq_id, CASE WHEN pose_valid THEN t END AS t FROM frames) SELECT seq_id, CASE WHEN count(t) > 1 AND max(t) > min(t) THEN greatest(1.0, round((count(t) - 1) / (max(t) - min(t)), 3)) ELSE 5.0 END AS fps FROM p GROUP BY 1")
def posed_rate(spark, sf):
    """Frames per second of the posed frames, one at least."""
    return convert.rate(frames(spark, sf), default=5.0, posed_only=True, least=1.0)


@query(FRAMES_SQL + ", g AS (SELECT seq_id, t - lag(t) OVER (PARTITION BY seq_id ORDER BY t) AS d FROM frames) SELECT seq_id, 'imu0' AS imu_id, CASE WHEN median(d) > 0 THEN round(1 / median(d), 1) END AS rate_hz FROM g GROUP BY 1")
def sample_rate(spark, sf):
    return convert.imu_rate(frames(spark, sf).select("seq_id", F.lit("imu0").alias("imu_id"), "t"))


@query(FRAMES_SQL + ", n AS (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY us, event_id) AS n FROM frames) SELECT seq_id, event_id FROM n WHERE n <= 3")
def first_of_sequence(spark, sf):
    f = frames(spark, sf).withColumn("ns", F.struct("us", "event_id"))
    return convert.first_frames(f, 3).select("seq_id", "event_id")


@query("WITH " + "c AS (SELECT s_suppkey AS id, s_acctbal AS a FROM supplier) SELECT id, round(a / 2, 6) AS fx, round(a / 4, 6) AS fy, 25e-1 AS cy, 120 AS height FROM c")
def scaled_cameras(spark, sf):
    c = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.array(F.col("s_acctbal"), F.col("s_acctbal"), F.lit(10.0), F.lit(10.0)).alias("params"), F.lit(640).alias("width"), F.lit(480).alias("height"))
    s = convert.scaled_camera(c, F.lit(320), F.lit(120))
    return s.select("id", r6(F.col("params")[0]).alias("fx"), r6(F.col("params")[1]).alias("fy"), F.col("params")[3].alias("cy"), "height")


# --- planes, text, live -----------------------------------------------------------------------------

_PLANE = EVENTS_SQL + ", px AS (SELECT event_id AS i, p % 4 AS u, p // 4 AS v, (event_id * 131 + p * 977) % 65536 AS raw FROM ev, range(16) t(p)), val AS (SELECT *, CASE WHEN raw % 5 <> 0 THEN raw * 1e-3 END AS value FROM px)"


def _planes(spark, sf) -> DataFrame:
    """A plane of 4 x 4 codes for each event, little-endian."""
    codes = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda p: (F.col("event_id") * 131 + p * 977) % 65536)
    two = F.transform(codes, lambda c: F.concat(F.lpad(F.hex(c % 256), 2, "0"), F.lpad(F.hex(F.floor(c / 256)), 2, "0")))
    return events(spark, sf).select(F.lit("s").alias("seq_id"), F.col("event_id").alias("i"), F.lit("d").alias("signal_id"), F.lit(4).alias("w"), F.lit(4).alias("h"), F.unhex(F.array_join(two, "")).alias("codes"))


def _values(spark, sf) -> DataFrame:
    return planes.pixels(_planes(spark, sf)).withColumn("value", F.when(F.col("raw") % 5 != 0, F.col("raw") * 0.001).otherwise(F.lit(float("nan"))))


@query(_PLANE + " SELECT i, CAST(u AS INTEGER) AS u, CAST(v AS INTEGER) AS v, CAST(raw AS INTEGER) AS raw FROM px WHERE u = 1")
def plane_pixels(spark, sf):
    return planes.pixels(_planes(spark, sf)).where("u = 1").select("i", "u", "v", "raw")


@query(_PLANE + " SELECT i, CAST(u // 2 AS INTEGER) AS u, CAST(v // 2 AS INTEGER) AS v, round(avg(value), 6) AS value FROM val GROUP BY ALL")
def plane_downsample(spark, sf):
    small = planes.box_downsample(_values(spark, sf), ["i"], 2)
    return small.select("i", "u", "v", F.when(~F.isnan("value"), F.round("value", 6)).alias("value"))


@query(_PLANE + " SELECT i, count(value) / 16.0 AS covered, round(min(value), 6) AS least, round(max(value), 6) AS most FROM val GROUP BY 1")
def plane_coverage(spark, sf):
    return planes.coverage(_values(spark, sf), ["i"]).select("i", "covered", r6(F.col("least")).alias("least"), r6(F.col("most")).alias("most"))


@query("SELECT page_id, CASE WHEN starts_with(url, 'https:/') THEN substr(url, 8) ELSE url END AS short FROM pages")
def relative_uris(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.relative_uri(F.col("url"), F.lit("https:/")).alias("short"))


@query("SELECT c_custkey, c_custkey || '_optical_frame' AS frame, CAST(c_custkey AS VARCHAR) AS camera, CASE c_custkey % 3 WHEN 0 THEN 'freiburg1' WHEN 1 THEN 'freiburg2' ELSE 'default' END AS guess, round(c_custkey * 1e-9, 12) AS seconds FROM customer")
def names_and_stamps(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_custkey").cast("string").alias("s"))
    path = F.concat(F.lit("/data/"), F.when(F.col("c_custkey") % 3 == 0, "rgbd_FREIBURG1_x").when(F.col("c_custkey") % 3 == 1, "freiburg2").otherwise("office"))
    frame = text.optical_frame(F.col("s"))
    return c.select("c_custkey", frame.alias("frame"), text.camera_of_frame(frame).alias("camera"), text.guessed_camera(path).alias("guess"), F.round(text.seconds_from_nanos(F.col("c_custkey")), 12).alias("seconds"))


@query("SELECT s_suppkey, s_acctbal AS fx, CAST(s_nationkey AS DOUBLE) AS fy, CASE WHEN s_suppkey % 2 = 0 THEN 16 END AS n, CASE WHEN s_suppkey % 2 = 0 THEN s_acctbal END AS last FROM supplier")
def calibration_text(spark, sf):
    """Lists out of calibration files, over several lines; a matrix needs its 16 numbers."""
    s = table(spark, sf, "supplier")
    number = F.col("s_acctbal").cast("string")
    zeros = F.when(F.col("s_suppkey") % 2 == 0, ", ".join(["0"] * 15)).otherwise(", ".join(["0"] * 11))
    body = F.concat(F.lit("T_BS:\n  cols: 4\n  data: ["), zeros, F.lit(",\n   "), number, F.lit("]\nintrinsics: ["), number, F.lit(",\n "), F.col("s_nationkey").cast("string"), F.lit("]\n"))
    both = s.select("s_suppkey", text.yaml_numbers(body, "intrinsics").alias("k"), text.yaml_matrix(body, "T_BS").alias("m"))
    return both.select("s_suppkey", F.col("k")[0].alias("fx"), F.col("k")[1].alias("fy"), F.when(F.col("m").isNotNull(), F.size("m")).alias("n"), F.col("m")[15].alias("last"))


@query("WITH RECURSIVE f AS (SELECT user_id AS seq_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events), k AS (SELECT seq_id, n, event_id, us, us AS last, true AS kept FROM f WHERE n = 1 UNION ALL SELECT f.seq_id, f.n, f.event_id, f.us, CASE WHEN f.us - k.last >= 100000000000 THEN f.us ELSE k.last END, f.us - k.last >= 100000000000 FROM k JOIN f ON f.seq_id = k.seq_id AND f.n = k.n + 1) SELECT seq_id, event_id FROM k WHERE kept")
def paced_frames(spark, sf):
    """Frames at least 100,000 seconds apart, each counted from the last that was kept."""
    f = events(spark, sf).select("seq_id", "event_id", (F.col("us") / 1e6).alias("t"))
    return live.paced(f, 1e-5, 1e9).select("seq_id", "event_id")


@query("WITH c AS (SELECT CAST(c_custkey AS VARCHAR) AS uri, c_custkey AS n, c_nationkey AS k FROM customer) SELECT uri, 'missing' AS kind, 'does not exist' AS detail FROM c WHERE n % 5 = 0 UNION ALL SELECT uri, 'unreadable', 'bad' FROM c WHERE n % 5 = 1 UNION ALL SELECT uri, 'resolution', '640x480 -> 640x481' FROM c WHERE n % 5 > 1 AND k % 2 = 0 UNION ALL SELECT uri, 'sha256', 'a -> b' FROM c WHERE n % 5 > 1 AND n % 3 = 0")
def drift_of_files(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("uri"), F.col("c_custkey").alias("n"), F.col("c_nationkey").alias("k"))
    row = lambda df, h, s: df.select("uri", F.lit(640).alias("width"), h.cast("int").alias("height"), s.alias("sha256"))
    fresh = row(c.where("n % 5 > 1"), 480 + (F.col("k") % 2 == 0).cast("int"), F.when(F.col("n") % 3 == 0, "b").otherwise("a"))
    bad = c.where("n % 5 = 1").select("uri", F.lit("bad").alias("error"))
    return corpus.drift(row(c, F.lit(480), F.lit("a")), fresh, unreadable=bad)


@query(POSED_SQL + " SELECT seq_id, round(1.2 * max(greatest(abs(x), abs(y), abs(z))), 6) AS span, count(*) AS frames FROM posed WHERE pose_valid GROUP BY 1")
def parser_cache(spark, sf):
    """Posed frames and scene box of each sequence, as a trainer's parser keeps them."""
    p = posed(spark, sf).where("pose_valid")
    return p.groupBy("seq_id").agg(r6(1.2 * F.max(F.array_max(F.transform("tr", F.abs)))).alias("span"), F.count("*").alias("frames"))


def _log(spark, sf) -> DataFrame:
    f = _text_posed(spark, sf)
    imu = _kind(frames(spark, sf), "click").select("seq_id", F.lit("imu0").alias("imu_id"), "t", *[F.lit(0.0).alias(c) for c in ("gx", "gy", "gz", "ax", "ay")], (F.col("event_id") % 7).cast("double").alias("az"))
    return exports.messages(f, _lenses(spark, sf), imu)


@query(POSED_SQL + """, l AS (SELECT seq_id, camera, t, CAST(round(t * 1e9) AS BIGINT) AS ns FROM frames), r AS (SELECT f.seq_id, f.camera, t, v[5] AS x FROM frames f JOIN vec ON vec_id = event_id % vectors WHERE pose_valid),
g AS (SELECT seq_id, camera, t - lag(t) OVER (PARTITION BY seq_id, camera ORDER BY t) AS gap FROM l), lim AS (SELECT seq_id, camera, coalesce(median(gap) / 2, 1e0/60) AS tol FROM g GROUP BY ALL),
p AS (SELECT l.seq_id, l.camera, l.ns, l.t, r.t AS pt, r.x AS px FROM l ASOF LEFT JOIN r ON l.seq_id = r.seq_id AND l.camera = r.camera AND l.t >= r.t),
n AS (SELECT l.seq_id, l.camera, l.ns, r.t AS nt, r.x AS nx FROM l ASOF LEFT JOIN r ON l.seq_id = r.seq_id AND l.camera = r.camera AND l.t <= r.t),
b AS (SELECT p.seq_id, p.camera, p.ns, CASE WHEN nt IS NULL OR t - pt <= nt - t THEN px ELSE nx END AS x, CASE WHEN nt IS NULL OR t - pt <= nt - t THEN t - pt ELSE nt - t END AS d FROM p JOIN n USING (seq_id, camera, ns))
SELECT seq_id, CAST(camera AS VARCHAR) AS camera, ns, coalesce(d <= tol, false) AS pose_valid, round(CASE WHEN d <= tol THEN x END, 6) + 0.0 AS x FROM b JOIN lim USING (seq_id, camera)""")
def log_frames(spark, sf):
    """Frames out of a message log, each with the nearest transform of its camera."""
    return convert.from_log(_log(spark, sf))["frames"].select("seq_id", "camera", "ns", "pose_valid", r6(F.col("tr")[0]).alias("x"))


@query(FRAMES_SQL + " SELECT DISTINCT seq_id, CAST(camera AS VARCHAR) AS camera, 640 AS width, 5.1e2 AS fy, 2.4e2 AS cy FROM frames")
def log_cameras(spark, sf):
    return convert.from_log(_log(spark, sf))["cameras"].select("seq_id", "camera", "width", F.col("params")[1].alias("fy"), F.col("params")[3].alias("cy"))


@query(FRAMES_SQL + " SELECT seq_id, 'imu0' AS imu_id, round(t, 6) AS t, CAST(event_id % 7 AS DOUBLE) AS az FROM frames WHERE event_type = 'click'")
def log_samples(spark, sf):
    return convert.from_log(_log(spark, sf))["imu"].select("seq_id", "imu_id", r6(F.col("t")).alias("t"), "az")


@query(FRAMES_SQL + ", c AS (SELECT seq_id, pos FROM frames WHERE event_type = 'purchase' OR pos = 0) SELECT f.seq_id, f.pos, c.pos AS first, f.pos - c.pos AS inside FROM frames f ASOF JOIN c ON f.seq_id = c.seq_id AND f.pos >= c.pos")
def frame_cluster(spark, sf):
    """The cluster that each frame is in: the last that begins at or before it."""
    f = frames(spark, sf).select("seq_id", "pos", "event_type")
    found = align.last_before(f.select("seq_id", "pos"), f.where("event_type = 'purchase' OR pos = 0").select("seq_id", "pos"), ["seq_id"], "pos")
    return found.select("l.seq_id", "l.pos", F.col("r.pos").alias("first"), (F.col("l.pos") - F.col("r.pos")).alias("inside"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_partkey % 65536 AS INTEGER) WHEN round_even(l_extendedprice / 1000 / 0.0002, 0) BETWEEN 1 AND 65535 THEN CAST(round_even(l_extendedprice / 1000 / 0.0002, 0) AS INTEGER) ELSE 0 END AS code FROM lineitem")
def depth_export(spark, sf):
    """Depth pictures: codes as stored where their unit is that of the export."""
    c = table(spark, sf, "lineitem")
    scale = F.when(F.col("l_linenumber") % 2 == 0, exports.DEPTH_UNIT).otherwise(0.001)
    return c.select("l_orderkey", "l_linenumber", exports.depth_codes((F.col("l_partkey") % 65536).cast("int"), F.col("l_extendedprice") / 1000, scale).alias("code"))


@query(_PLANE + ", h AS (SELECT i, string_agg(lpad(hex(raw % 256), 2, '0') || lpad(hex(raw // 256), 2, '0'), '' ORDER BY v, u) AS body FROM px GROUP BY 1) SELECT i, CAST(160 AS BIGINT) AS bytes, '934E554D505901007600' AS magic, body FROM h")
def plane_array_files(spark, sf):
    n = exports.npy(_planes(spark, sf))
    return n.select("i", F.length("content").cast("bigint").alias("bytes"), F.hex(F.substring("content", 1, 10)).alias("magic"), F.hex(F.substring("content", 129, 32)).alias("body"))


@query("WITH c AS (SELECT s_suppkey AS id, s_acctbal AS a, s_nationkey AS k FROM supplier) SELECT id, round(CASE WHEN id % 2 = 0 THEN k ELSE a END, 6) AS fx, round(CASE WHEN id % 2 = 0 THEN 2.0 ELSE 3.0 END, 6) AS cx FROM c")
def camera_override(spark, sf):
    """Parameters of a frame's own replace those of its camera."""
    s = table(spark, sf, "supplier")
    own = F.when(F.col("s_suppkey") % 2 == 0, F.array(F.col("s_nationkey").cast("double"), F.lit(1.0), F.lit(2.0), F.lit(2.5)))
    k = g.intrinsics(F.lit("PINHOLE"), F.coalesce(own, F.array(F.col("s_acctbal"), F.lit(1.0), F.lit(3.0), F.lit(3.5))))
    return s.select(F.col("s_suppkey").alias("id"), r6(k[0]).alias("fx"), r6(k[2]).alias("cx"))


@query(FRAMES_SQL + ", u AS (SELECT seq_id, CASE WHEN isfinite(value) AND value > 0 THEN value END AS v FROM frames) SELECT seq_id, round(CASE WHEN count(v) > 0 THEN greatest(0.05, min(v)) ELSE 0.1 END, 6) AS near, round(CASE WHEN count(v) > 0 THEN max(v) ELSE 10.0 END, 6) AS far FROM u GROUP BY 1")
def depth_range(spark, sf):
    """The range of depths itself, as an imported log has it."""
    return planes.near_far(frames(spark, sf), ["seq_id"], margin=0.0).select("seq_id", r6(F.col("near")).alias("near"), r6(F.col("far")).alias("far"))
