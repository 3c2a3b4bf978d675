"""Registered queries: the engine's operators over the driver's tables, each with SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from plumbline.functions import geometry as g
from plumbline.functions import text, values
from plumbline.operators import align, corpus, planes, rules
from plumbline.plans.views import EVENTS_SQL, FRAMES_SQL, POSED_SQL, events, frames, posed, table
from plumbline.sources import convert, exports

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = f"WITH {sql}" if sql.startswith("ev AS") else sql
        return f

    return register


def r6(c: Column) -> Column:
    """Rounded to 6 places, without negative zero."""
    return F.round(c, 6) + F.lit(0.0)


def named(v: list[Column], *names: str) -> list[Column]:
    return [r6(c).alias(n) for c, n in zip(v, names, strict=True)]


def pose_of(q="q_wxyz", tr="tr"):
    return g.pose(g.elements(F.col(q), 4), g.elements(F.col(tr), 3))


def _kind(df: DataFrame, kind: str) -> DataFrame:
    return df.where(F.col("event_type") == kind)


# --- time joins -----------------------------------------------------------------------------------

_NEAREST = FRAMES_SQL + """, l AS (SELECT * FROM frames WHERE event_type = 'purchase'), r AS (SELECT * FROM frames WHERE event_type = 'view'),
p AS (SELECT l.seq_id, l.i, l.t, r.i AS pi, r.t AS pt FROM l ASOF LEFT JOIN r ON l.seq_id = r.seq_id AND l.t >= r.t),
n AS (SELECT l.seq_id, l.i, r.i AS ni, r.t AS nt FROM l ASOF LEFT JOIN r ON l.seq_id = r.seq_id AND l.t <= r.t),
b AS (SELECT p.*, ni, nt, CASE WHEN nt IS NULL OR t - pt <= nt - t THEN pi ELSE ni END AS j, CASE WHEN nt IS NULL OR t - pt <= nt - t THEN t - pt ELSE nt - t END AS d FROM p JOIN n USING (seq_id, i))"""


@query(_NEAREST + " SELECT seq_id, i, CASE WHEN d < 3600 THEN j END AS pose_i, round(CASE WHEN d < 3600 THEN d END, 6) AS dt, coalesce(d < 3600, false) AS pose_valid FROM b")
def nearest_pose(spark, sf):
    f = frames(spark, sf)
    found = align.nearest(_kind(f, "purchase"), _kind(f, "view"), ["seq_id"], "t", "i", tolerance=3600.0, bucket=86_400.0)
    return found.select("l.seq_id", "l.i", F.col("r.i").alias("pose_i"), r6(F.col("dt")).alias("dt"), F.col("r").isNotNull().alias("pose_valid"))


@query(_NEAREST + ", g AS (SELECT seq_id, t - lag(t) OVER (PARTITION BY seq_id ORDER BY t, i) AS gap FROM l), lim AS (SELECT seq_id, coalesce(median(gap) / 2, 1.0/60) AS tol FROM g GROUP BY 1) SELECT b.seq_id, i, CASE WHEN d <= tol THEN j END AS pose_i, round(CASE WHEN d <= tol THEN d END, 6) AS dt FROM b JOIN lim USING (seq_id)")
def nearest_median_tol(spark, sf):
    f = frames(spark, sf)
    found = align.nearest_by_median(_kind(f, "purchase"), _kind(f, "view"), ["seq_id"], "t", "i")
    return found.select("l.seq_id", "l.i", F.col("r.i").alias("pose_i"), r6(F.col("dt")).alias("dt"))


@query(_NEAREST + " SELECT seq_id, i, j AS plane_i, round(d, 6) AS dt FROM b")
def nearest_plane(spark, sf):
    """Nearest without a tolerance."""
    f = frames(spark, sf)
    return align.nearest(_kind(f, "purchase"), _kind(f, "view"), ["seq_id"], "t", "i").select("l.seq_id", "l.i", F.col("r.i").alias("plane_i"), r6(F.col("dt")).alias("dt"))


_BRACKET = FRAMES_SQL + """, l AS (SELECT * FROM frames WHERE event_type = 'purchase'), r AS (SELECT * FROM frames WHERE event_type = 'view'),
p AS (SELECT l.seq_id, l.i, l.t, r.i AS ai, r.t AS ta, r.value AS av FROM l ASOF LEFT JOIN r ON l.seq_id = r.seq_id AND l.t > r.t),
n AS (SELECT l.seq_id, l.i, r.i AS bi, r.t AS bt, r.value AS bv FROM l ASOF LEFT JOIN r ON l.seq_id = r.seq_id AND l.t <= r.t),
b AS (SELECT *, CASE WHEN ta IS NOT NULL AND bt IS NOT NULL THEN CASE WHEN bt - ta <= 2 * 100000.0 THEN CASE WHEN bt > ta THEN (t - ta) / (bt - ta) ELSE 0e0 END END
  WHEN abs(coalesce(ta, bt) - t) <= 100000.0 THEN 0e0 END AS u FROM p JOIN n USING (seq_id, i))"""


@query(_BRACKET + " SELECT seq_id, i, round(u, 6) AS u, round(CASE WHEN u IS NOT NULL THEN coalesce(av, bv) + u * (coalesce(bv, av) - coalesce(av, bv)) END, 6) AS value FROM b")
def bracket_lerp(spark, sf):
    f = frames(spark, sf)
    found = align.bracket(_kind(f, "purchase"), _kind(f, "view"), ["seq_id"], "t", "i", max_dt=100_000.0)
    return found.select("l.seq_id", "l.i", r6(F.col("u")).alias("u"), r6(g.lerp([F.col("a.value")], [F.col("b.value")], F.col("u"))[0]).alias("value"))


@query(POSED_SQL + """, n AS (SELECT *, lead(qw) OVER w AS bw, lead(qx) OVER w AS bx, lead(qy) OVER w AS by_, lead(qz) OVER w AS bz FROM posed WINDOW w AS (PARTITION BY seq_id ORDER BY pos)),
d AS (SELECT *, CASE WHEN qw*bw+qx*bx+qy*by_+qz*bz < 0 THEN -1.0 ELSE 1.0 END AS s, abs(qw*bw+qx*bx+qy*by_+qz*bz) AS c FROM n WHERE bw IS NOT NULL),
e AS (SELECT *, acos(least(1.0, c)) AS th FROM d), f AS (SELECT *, CASE WHEN c > 0.9995 THEN 0.75 ELSE sin(0.75*th)/sin(th) END AS ka, CASE WHEN c > 0.9995 THEN 0.25 ELSE sin(0.25*th)/sin(th) END AS kb FROM e),
h AS (SELECT seq_id, pos, ka*qw+kb*s*bw AS w, ka*qx+kb*s*bx AS x, ka*qy+kb*s*by_ AS y, ka*qz+kb*s*bz AS z FROM f)
SELECT seq_id, pos, round(w/sqrt(w*w+x*x+y*y+z*z), 6)+0.0 AS qw, round(x/sqrt(w*w+x*x+y*y+z*z), 6)+0.0 AS qx, round(y/sqrt(w*w+x*x+y*y+z*z), 6)+0.0 AS qy, round(z/sqrt(w*w+x*x+y*y+z*z), 6)+0.0 AS qz FROM h""")
def slerp_pose(spark, sf):
    """A quarter of the way from each pose to the next."""
    after = F.lead("q_wxyz").over(W.partitionBy("seq_id").orderBy("pos"))
    p = posed(spark, sf).withColumn("after", after).where("after IS NOT NULL")
    q = g.slerp(g.elements(F.col("q_wxyz"), 4), g.elements(F.col("after"), 4), F.lit(0.25))
    return p.select("seq_id", "pos", *named(q, "qw", "qx", "qy", "qz"))


_PAIR = EVENTS_SQL + ", a AS (SELECT seq_id, us // 172800000000 AS ns, min(event_id) AS i FROM ev WHERE event_type = 'view' GROUP BY ALL), b AS (SELECT seq_id, us // 172800000000 AS ns, min(event_id) AS j FROM ev WHERE event_type = 'click' GROUP BY ALL)"


def _stereo(spark, sf, kind, name):
    """One integer stamp for two days stands for a camera's exposures."""
    e = _kind(events(spark, sf), kind)
    return e.groupBy("seq_id", F.expr("us div 172800000000").alias("ns")).agg(F.min("event_id").alias(name))


@query(_PAIR + " SELECT a.seq_id, a.ns, i, j FROM a JOIN b USING (seq_id, ns)")
def ns_equi_pair(spark, sf):
    pairs = convert.paired(_stereo(spark, sf, "view", "name"), _stereo(spark, sf, "click", "name"))
    return pairs.select("seq_id", "ns", F.col("name").alias("i"), F.col("other").alias("j"))


@query(_PAIR + " SELECT seq_id, count(*) AS dropped FROM a ANTI JOIN b USING (seq_id, ns) GROUP BY 1")
def ns_unpaired(spark, sf):
    return convert.unpaired(_stereo(spark, sf, "view", "i"), _stereo(spark, sf, "click", "j").select("seq_id", "ns"))


_BEST = "row_number() OVER (PARTITION BY seq_id, a ORDER BY d, a, b) = 1 AND row_number() OVER (PARTITION BY seq_id, b ORDER BY d, a, b) = 1 AS best"


@query(
    "WITH RECURSIVE " + FRAMES_SQL + ", c AS (SELECT l.seq_id, l.i AS a, r.i AS b, abs(l.t - r.t) AS d FROM frames l JOIN frames r ON l.seq_id = r.seq_id AND abs(l.t - r.t) < 3600 WHERE l.event_type = 'purchase' AND r.event_type = 'view'), "
    f"k AS (SELECT *, {_BEST} FROM c UNION ALL SELECT seq_id, a, b, d, {_BEST} FROM (SELECT *, bool_or(best) OVER (PARTITION BY seq_id, a) OR bool_or(best) OVER (PARTITION BY seq_id, b) AS gone FROM k) WHERE NOT gone) "
    "SELECT seq_id, a, b FROM k WHERE best"
)
def greedy_pairs(spark, sf):
    """Closest one-to-one pairs; in SQL, rounds of pairs that are each other's best."""
    f = frames(spark, sf)
    return align.greedy_pairs(_kind(f, "purchase"), _kind(f, "view"), "seq_id", "t", "i", 3600.0)


@query(FRAMES_SQL + " SELECT seq_id, pos, coalesce(last_value(CASE WHEN pose_valid THEN t END IGNORE NULLS) OVER (PARTITION BY seq_id ORDER BY pos ROWS UNBOUNDED PRECEDING), 0.0) AS t FROM frames")
def fill_forward_t(spark, sf):
    f = frames(spark, sf)
    return f.select("seq_id", "pos", align.filled_forward(F.when(F.col("pose_valid"), F.col("t")), ["seq_id"], "pos", 0.0).alias("t"))


@query(FRAMES_SQL + " SELECT f.seq_id, f.pos, n.n_name AS camera, coalesce(s.s_suppkey, -1) AS supplier FROM frames f LEFT JOIN nation n ON f.camera = n.n_nationkey LEFT JOIN (SELECT s_nationkey, min(s_suppkey) AS s_suppkey FROM supplier GROUP BY 1) s ON s.s_nationkey = n.n_nationkey")
def camera_lookup(spark, sf):
    """Calibration of each frame's camera; optional second table by name, as stem joins have."""
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("camera"), F.col("n_name").alias("name"))
    s = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("camera")).agg(F.min("s_suppkey").alias("supplier"))
    return frames(spark, sf).join(n, "camera", "left").join(s, "camera", "left").select("seq_id", "pos", F.col("name").alias("camera"), F.coalesce("supplier", F.lit(-1)).alias("supplier"))


# --- geometry -------------------------------------------------------------------------------------

_M = ["m00", "m01", "m02", "m10", "m11", "m12", "m20", "m21", "m22"]


@query(POSED_SQL + " SELECT i, " + ", ".join(f"round({m}, 6)+0.0 AS {m}" for m in _M) + " FROM rot")
def quat_to_matrix(spark, sf):
    return posed(spark, sf).select("i", *named(g.quat_to_matrix(g.elements(F.col("q_wxyz"), 4)), *_M))


@query(POSED_SQL + " SELECT i, " + ", ".join(f"round(CASE WHEN qw < 0 THEN -{c} ELSE {c} END, 6)+0.0 AS {c}" for c in ("qw", "qx", "qy", "qz")) + " FROM rot")
def matrix_to_quat(spark, sf):
    """Back from the matrix: the quaternion with w >= 0."""
    m = posed(spark, sf).select("i", F.array(*g.quat_to_matrix(g.elements(F.col("q_wxyz"), 4))).alias("m"))
    return m.select("i", *named(g.matrix_to_quat(g.elements(F.col("m"), 9)), "qw", "qx", "qy", "qz"))


@query(POSED_SQL + " SELECT i, " + ", ".join(f"round({'' if k % 3 == 0 else '-'}{m}, 6)+0.0 AS {m}" for k, m in enumerate(_M)) + " FROM rot")
def gl_cv_flip(spark, sf):
    return posed(spark, sf).select("i", *named(g.flip_gl_cv(g.quat_to_matrix(g.elements(F.col("q_wxyz"), 4))), *_M))


@query(POSED_SQL + " SELECT i, round(-(m00*x+m10*y+m20*z), 6)+0.0 AS x, round(-(m01*x+m11*y+m21*z), 6)+0.0 AS y, round(-(m02*x+m12*y+m22*z), 6)+0.0 AS z, round(m10, 6)+0.0 AS m01 FROM rot")
def invert_pose(spark, sf):
    m, tr = g.inverse(pose_of())
    return posed(spark, sf).select("i", *named([*tr, m[1]], "x", "y", "z", "m01"))


@query(POSED_SQL + """, rig AS (SELECT seq_id AS rs, m00 AS r00, m01 AS r01, m02 AS r02, m10 AS r10, m11 AS r11, m12 AS r12, m20 AS r20, m21 AS r21, m22 AS r22, x AS rx, y AS ry, z AS rz FROM rot WHERE pos = 0),
oth AS (SELECT seq_id AS os, x AS ox, y AS oy, z AS oz FROM rot WHERE pos = 1),
k AS (SELECT *, ox-rx AS dx, oy-ry AS dy, oz-rz AS dz FROM rot JOIN rig ON rs = seq_id JOIN oth ON os = seq_id),
c AS (SELECT *, r00*dx+r10*dy+r20*dz AS cx, r01*dx+r11*dy+r21*dz AS cy, r02*dx+r12*dy+r22*dz AS cz FROM k)
SELECT i, round(m00*cx+m01*cy+m02*cz+x, 6)+0.0 AS x, round(m10*cx+m11*cy+m12*cz+y, 6)+0.0 AS y, round(m20*cx+m21*cy+m22*cz+z, 6)+0.0 AS z FROM c""")
def rig_derive(spark, sf):
    """Where another camera of the rig is: frame pose, back to the rig, out to the other camera."""
    whole = W.partitionBy("seq_id").orderBy("pos").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    at = lambda c, n: F.nth_value(c, n).over(whole)
    both = posed(spark, sf).select("i", "q_wxyz", "tr", at("q_wxyz", 1).alias("q0"), at("tr", 1).alias("t0"), at("q_wxyz", 2).alias("q1"), at("tr", 2).alias("t1")).where("q1 IS NOT NULL")
    derived = g.compose(g.compose(pose_of(), g.inverse(pose_of("q0", "t0"))), pose_of("q1", "t1"))
    return both.select("i", *named(derived[1], "x", "y", "z"))


_CAMERAS = "cam AS (SELECT s_suppkey AS id, CASE s_suppkey % 3 WHEN 0 THEN 'PINHOLE' WHEN 1 THEN 'SIMPLE_RADIAL' ELSE 'RADIAL' END AS model, s_acctbal AS a, CAST(s_nationkey AS DOUBLE) AS b FROM supplier)"


def cameras(spark, sf):
    """Suppliers as cameras of three models."""
    s = table(spark, sf, "supplier")
    model = F.element_at(F.array(F.lit("PINHOLE"), F.lit("SIMPLE_RADIAL"), F.lit("RADIAL")), (F.col("s_suppkey") % 3 + 1).cast("int"))
    return s.select(F.col("s_suppkey").alias("id"), model.alias("model"), F.array(F.col("s_acctbal"), F.col("s_nationkey").cast("double"), F.lit(3.5), F.lit(4.5), F.lit(0.1)).alias("params"))


@query("WITH " + _CAMERAS + " SELECT id, round(a * 0.5, 6) AS fx, round((CASE WHEN model = 'PINHOLE' THEN b ELSE a END) * 0.25, 6) AS fy, round((CASE WHEN model = 'PINHOLE' THEN 35e-1 ELSE b END) * 0.5, 6) AS cx, round((CASE WHEN model = 'PINHOLE' THEN 45e-1 ELSE 35e-1 END) * 25e-2, 6) AS cy FROM cam")
def camera_k_scaled(spark, sf):
    k = g.scaled_intrinsics(g.intrinsics(F.col("model"), F.col("params")), F.lit(640.0), F.lit(480.0), F.lit(320.0), F.lit(120.0))
    return cameras(spark, sf).select("id", *named(k, "fx", "fy", "cx", "cy"))


@query("WITH " + _CAMERAS + " SELECT id, 'plumb_bob' AS name, CASE model WHEN 'PINHOLE' THEN 0e0 ELSE 45e-1 END AS d0, CASE model WHEN 'RADIAL' THEN 1e-1 ELSE 0e0 END AS d1 FROM cam")
def distortion_model(spark, sf):
    d = g.distortion(F.col("model"), F.when(F.col("model") == "RADIAL", F.array(*[F.col("params")[k] for k in (0, 1, 2, 3, 4)])).otherwise(F.col("params")))
    return cameras(spark, sf).select("id", d["name"].alias("name"), d["d"][0].alias("d0"), d["d"][1].alias("d1"))


@query(POSED_SQL + ", s AS (SELECT *, (CAST(i % 320 AS DOUBLE) - 160) / 200 * (1 + value) AS a, (CAST(i % 240 AS DOUBLE) - 120) / 200 * (1 + value) AS b, 1 + value AS c FROM rot) SELECT i, round(m00*a+m01*b+m02*c+x, 6)+0.0 AS x, round(m10*a+m11*b+m12*c+y, 6)+0.0 AS y, round(m20*a+m21*b+m22*c+z, 6)+0.0 AS z FROM s WHERE i % 2 = 0 AND isfinite(value)")
def unproject_cloud(spark, sf):
    """A point cloud from every second pixel with a depth."""
    p = posed(spark, sf).where((F.col("i") % 2 == 0) & ~F.isnan("value") & (F.abs("value") < float("inf")))
    k = [F.lit(200.0), F.lit(200.0), F.lit(160.0), F.lit(120.0)]
    return p.select("i", *named(g.unproject((F.col("i") % 320).cast("double"), (F.col("i") % 240).cast("double"), 1 + F.col("value"), k, pose_of()), "x", "y", "z"))


@query(POSED_SQL + ", n AS (SELECT *, lead(qw) OVER w AS bw, lead(qx) OVER w AS bx, lead(qy) OVER w AS b2, lead(qz) OVER w AS bz FROM posed WINDOW w AS (PARTITION BY seq_id ORDER BY pos)) SELECT seq_id, pos, round(degrees(2*acos(least(1.0, abs(qw*bw+qx*bx+qy*b2+qz*bz)))), 4) AS degrees FROM n WHERE bw IS NOT NULL")
def rotation_error(spark, sf):
    after = F.lead("q_wxyz").over(W.partitionBy("seq_id").orderBy("pos"))
    p = posed(spark, sf).withColumn("after", after).where("after IS NOT NULL")
    return p.select("seq_id", "pos", F.round(g.rotation_error_degrees(g.elements(F.col("q_wxyz"), 4), g.elements(F.col("after"), 4)), 4).alias("degrees"))


# --- values ---------------------------------------------------------------------------------------

_CODES = "codes AS (SELECT l_orderkey, l_linenumber, CAST((l_partkey * 31 + l_suppkey * 7 + l_linenumber) % 65536 AS INTEGER) AS raw, l_extendedprice / 1000 AS depth FROM lineitem)"


def codes(spark, sf):
    """Line items as 16-bit codes and depths."""
    raw = ((F.col("l_partkey") * 31 + F.col("l_suppkey") * 7 + F.col("l_linenumber")) % 65536).cast("int")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", raw.alias("raw"), (F.col("l_extendedprice") / 1000).alias("depth"))


def _code_query(sql: str):
    return query(f"WITH {_CODES} SELECT l_orderkey, l_linenumber, {sql} FROM codes")


def _by_code(spark, sf, *columns):
    return codes(spark, sf).select("l_orderkey", "l_linenumber", *columns)


def _number(c: Column) -> Column:
    """NaN as null, so that any reader compares it alike."""
    return F.when(~F.isnan(c), r6(c))


@_code_query("CASE WHEN raw <> 77 THEN round(raw * 5e-4 - 1.5e0, 6)+0.0 END AS value")
def value_linear(spark, sf):
    return _by_code(spark, sf, _number(values.linear(F.col("raw"), 0.0005, -1.5, F.lit(77))).alias("value"))


@_code_query("CASE WHEN raw <> 0 THEN round(1/((raw-1)*((1/0.3-1/9.0)/65534)+1/9.0), 6)+0.0 END AS value")
def value_inverse_depth(spark, sf):
    return _by_code(spark, sf, _number(values.inverse_depth(F.col("raw"), 0.3, 9.0)).alias("value"))


@_code_query("CASE WHEN depth >= 0.3 AND depth <= 9.0 THEN CAST(round((1/depth-1/9.0)/(1/0.3-1/9.0)*65534)+1 AS INTEGER) ELSE 0 END AS code")
def depth_code(spark, sf):
    return _by_code(spark, sf, values.quantize_inverse(F.col("depth"), 0.3, 9.0).alias("code"))


@_code_query("CASE raw % 5 WHEN 0 THEN 'floor' WHEN 1 THEN 'wall' WHEN 2 THEN 'chair' END AS label")
def value_labels(spark, sf):
    names = F.create_map(*[F.lit(x) for x in ("0", "floor", "1", "wall", "2", "chair")])
    return _by_code(spark, sf, values.label(F.col("raw") % 5, names).alias("label"))


@_code_query("""CASE WHEN ((raw >> 10) & 31) = 31 THEN CASE WHEN (raw & 1023) = 0 THEN 1 ELSE 2 END ELSE 0 END AS special,
  CASE WHEN ((raw >> 10) & 31) = 31 THEN NULL ELSE round((CASE WHEN (raw & 32768) <> 0 THEN -1.0 ELSE 1.0 END) * (CASE WHEN ((raw >> 10) & 31) = 0 THEN (raw & 1023) * pow(2.0, -24) ELSE (1024 + (raw & 1023)) * pow(2.0, ((raw >> 10) & 31) - 25) END), 9)+0.0 END AS value""")
def float16_bits(spark, sf):
    v = values.float16(F.col("raw"))
    special = F.when(F.isnan(v), 2).when(F.abs(v) == float("inf"), 1).otherwise(0)
    return _by_code(spark, sf, special.alias("special"), F.when(special == 0, F.round(v, 9) + F.lit(0.0)).alias("value"))


@_code_query("raw >> 8 AS high, CASE WHEN ((raw >> 8) & 1) = 1 THEN 255 - (raw & 255) ELSE raw & 255 END AS low, raw AS back")
def triangle_fold(spark, sf):
    high, low = values.triangle_fold(F.col("raw"))
    return _by_code(spark, sf, high.alias("high"), low.alias("low"), values.triangle_unfold(high, low).alias("back"))


@_code_query("CASE WHEN round_even(depth / 0.0002, 0) BETWEEN 1 AND 65535 THEN CAST(round_even(depth / 0.0002, 0) AS INTEGER) ELSE 0 END AS code")
def depth_requant(spark, sf):
    return _by_code(spark, sf, values.requantize(F.col("depth"), 0.0002).alias("code"))


@_code_query("CASE raw % 3 WHEN 0 THEN CAST(raw AS DOUBLE) WHEN 1 THEN round(raw * 1e-3 + 5e-1, 6) ELSE CASE WHEN raw <> 0 THEN round(1/((raw-1)*((1/0.5-1/40.0)/65534)+1/40.0), 6) END END AS value")
def signal_values(spark, sf):
    """Dispatch on each row's value map."""
    which = F.col("raw") % 3
    m = F.struct(
        F.when(which == 1, "linear").when(which == 2, "inverse_depth").alias("type"), F.lit(0.001).alias("scale"), F.lit(0.5).alias("offset"), F.lit(None).cast("int").alias("invalid"),
        F.lit(0.5).alias("near"), F.lit(40.0).alias("far"), F.lit(65536).alias("levels"),
    )
    return _by_code(spark, sf, _number(values.signal_value(F.col("raw"), m)).alias("value"))


@_code_query("CAST(least(greatest((raw % 480) * 192 // 480, 0), 191) AS BIGINT) AS source_row")
def nearest_upsample(spark, sf):
    return _by_code(spark, sf, values.nearest_index(F.col("raw") % 480, F.lit(480), F.lit(192)).cast("bigint").alias("source_row"))


# --- rules ----------------------------------------------------------------------------------------


@query(FRAMES_SQL + ", d AS (SELECT seq_id, pos, value < lag(value) OVER (PARTITION BY seq_id ORDER BY pos) AS bad FROM frames) SELECT seq_id, 'time goes back at record ' || min(pos) AS message FROM d WHERE bad GROUP BY 1")
def monotonic_t(spark, sf):
    """First record whose time (here: value) falls."""
    f = frames(spark, sf).withColumn("t", F.col("value"))
    return rules.time_order(f).select("seq_id", "message")


@query(FRAMES_SQL + ", d AS (SELECT seq_id, pos, i % 97 < lag(i % 97) OVER (PARTITION BY seq_id ORDER BY pos) AS bad FROM frames) SELECT seq_id, 'frame index goes back at record ' || min(pos) AS message FROM d WHERE bad GROUP BY 1")
def index_order(spark, sf):
    return rules.index_order(frames(spark, sf).withColumn("i", F.col("i") % 97)).select("seq_id", "message")


@query(FRAMES_SQL + ", d AS (SELECT seq_id, i % 97 AS i FROM frames GROUP BY ALL HAVING count(*) > 1) SELECT seq_id, 'repeated frame index ' || min(i) AS message FROM d GROUP BY 1")
def dup_index(spark, sf):
    return rules.duplicate_index(frames(spark, sf).withColumn("i", F.col("i") % 97)).select("seq_id", "message")


@query(POSED_SQL + " SELECT seq_id, 'frame ' || i || ' has no unit quaternion' AS message FROM frames JOIN vec ON vec_id = event_id % vectors WHERE pose_valid AND abs(sqrt(v[1]*v[1]+v[2]*v[2]+v[3]*v[3]+v[4]*v[4]) - 1) > 0.001")
def quat_unit_rule(spark, sf):
    return rules.unit_quaternions(posed(spark, sf)).select("seq_id", "message")


@query(FRAMES_SQL + " SELECT DISTINCT seq_id, 'a frame names unknown camera ' || camera AS message FROM frames WHERE camera NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 4)")
def camera_anti(spark, sf):
    f = frames(spark, sf).select("seq_id", F.col("camera").cast("string").alias("camera"))
    known = table(spark, sf, "nation").where("n_regionkey < 4").select(F.col("n_nationkey").cast("string").alias("camera"))
    return rules.unknown_cameras(f, f.join(known, "camera").select("seq_id", "camera"), "a frame").select("seq_id", "message")


@query("SELECT CAST(s_suppkey AS VARCHAR) AS seq_id, 'a rig names unknown camera ' || s_nationkey AS message FROM supplier WHERE s_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900 AND c_custkey % 3 = 0)")
def rig_anti(spark, sf):
    rigs = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("seq_id"), F.col("s_nationkey").cast("string").alias("camera"))
    known = table(spark, sf, "customer").where("c_acctbal > 9900 AND c_custkey % 3 = 0").select(F.col("c_nationkey").cast("string").alias("camera")).distinct()
    return rules.unknown_cameras(rigs, rigs.join(known, "camera").select("seq_id", "camera"), "a rig").select("seq_id", "message")


@query(POSED_SQL + """, q AS (SELECT 'error' AS severity FROM frames JOIN vec ON vec_id = event_id % vectors WHERE pose_valid AND abs(sqrt(v[1]*v[1]+v[2]*v[2]+v[3]*v[3]+v[4]*v[4]) - 1) > 0.001),
d AS (SELECT DISTINCT seq_id FROM (SELECT seq_id, value < lag(value) OVER (PARTITION BY seq_id ORDER BY pos) AS bad FROM frames) WHERE bad),
n AS (SELECT c_custkey FROM customer ANTI JOIN events ON user_id = c_custkey)
SELECT severity, count(*) AS n FROM (SELECT severity FROM q UNION ALL SELECT 'error' FROM d UNION ALL SELECT 'warning' FROM n) GROUP BY 1""")
def findings_by_severity(spark, sf):
    p = posed(spark, sf)
    documents = table(spark, sf, "customer").select(F.col("c_custkey").alias("seq_id"))
    return rules.by_severity(rules.unit_quaternions(p).union(rules.time_order(frames(spark, sf).withColumn("t", F.col("value")))).union(rules.no_poses(documents, p.select("seq_id"))))


# --- corpus ---------------------------------------------------------------------------------------

_MEMBERS = FRAMES_SQL + ", members AS (SELECT seq_id, count(*) AS frames, CAST(count_if(pose_valid) AS BIGINT) AS posed_frames, min(t) AS t_start, max(t) AS t_end, array_to_string(list_sort(list(DISTINCT lpad(CAST(camera AS VARCHAR), 2, '0'))), ',') AS cameras FROM frames GROUP BY 1)"


def members(spark, sf):
    return corpus.describe(frames(spark, sf).withColumn("camera", F.lpad(F.col("camera").cast("string"), 2, "0")))


@query(_MEMBERS + " SELECT * FROM members")
def member_describe(spark, sf):
    return members(spark, sf).withColumn("cameras", F.array_join("cameras", ","))


@query(_MEMBERS + " SELECT count(*) AS members, CAST(sum(frames) AS BIGINT) AS frames, CAST(sum(posed_frames) AS BIGINT) AS posed_frames FROM members")
def manifest_totals(spark, sf):
    return corpus.totals(members(spark, sf))


@query("SELECT count(DISTINCT CASE WHEN c_acctbal >= 0 THEN c_nationkey % 2 = 0 END) AS scales, CAST(count_if(c_acctbal < 0) AS BIGINT) AS unknown, count(DISTINCT CASE WHEN c_acctbal >= 0 THEN c_nationkey % 2 = 0 END) > 1 AS mixed FROM customer")
def mixed_scale(spark, sf):
    scale = F.when(F.col("c_acctbal") >= 0, F.col("c_nationkey") % 2 == 0)
    return corpus.scale_mixture(table(spark, sf, "customer").select(scale.alias("metric_scale")))


_CORPUS = "m AS (SELECT c_custkey AS mi, CAST(1 + c_nationkey AS BIGINT) AS frames FROM customer), o AS (SELECT mi, frames, CAST(sum(frames) OVER (ORDER BY mi) - frames AS BIGINT) AS lo, CAST(sum(frames) OVER (ORDER BY mi) AS BIGINT) AS hi FROM m), n AS (SELECT CAST(sum(frames) AS BIGINT) AS n FROM m)"


def _customers(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("mi"), (F.col("c_nationkey") + 1).cast("bigint").alias("frames"))


@query("WITH " + _CORPUS + ", w AS (SELECT o_orderkey AS index, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey - n ELSE o_orderkey END AS asked, n FROM orders, n), x AS (SELECT *, CASE WHEN asked < 0 THEN asked + n ELSE asked END AS pos FROM w) SELECT asked AS index, mi AS member, pos - lo AS frame FROM x JOIN o ON pos >= lo AND pos < hi")
def locate_global(spark, sf):
    m = _customers(spark, sf)
    total = m.agg(F.sum("frames").alias("n")).first()["n"]
    asked = table(spark, sf, "orders").select(F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey") - total).otherwise(F.col("o_orderkey")).alias("index"))
    return corpus.locate(asked, m, total=total).select("index", "member", "frame")


@query("WITH " + _CORPUS + " SELECT CAST(mi % 4 AS INTEGER) AS shard, count(*) AS members, CAST(sum(frames) AS BIGINT) AS frames FROM m GROUP BY 1")
def shard_partition(spark, sf):
    m = _customers(spark, sf).withColumn("shard", corpus.shard_of(F.col("mi"), 4))
    return m.groupBy("shard").agg(F.count("*").alias("members"), F.sum("frames").alias("frames"))


@query("SELECT c_custkey AS mi, CAST(1 + c_nationkey AS BIGINT) AS frames, CAST(1 AS BIGINT) AS times, CAST(c_custkey % 3 AS INTEGER) AS plain FROM customer")
def shard_cover(spark, sf):
    """How often each member is in three seeded shards, and in which one it is without a seed."""
    m = _customers(spark, sf)
    parts = [corpus.shard(m, k, 3, seed=7) for k in range(3)]
    times = parts[0].union(parts[1]).union(parts[2]).groupBy("mi", "frames").agg(F.count("*").alias("times"))
    plain = [corpus.shard(m, k, 3).select("mi", F.lit(k).alias("plain")) for k in range(3)]
    return times.join(plain[0].union(plain[1]).union(plain[2]), "mi")


@query(FRAMES_SQL + " SELECT seq_id, pos, t FROM frames WHERE pose_valid")
def posed_only_scan(spark, sf):
    return frames(spark, sf).where("pose_valid").select("seq_id", "pos", "t")


@query(FRAMES_SQL + " SELECT seq_id, pos - 5 AS i, t FROM frames WHERE pos >= 5 AND pos < 20")
def trim_range(spark, sf):
    """Frames [5, 20) of every capture: the index is rebased, the time stays."""
    return exports.trim(frames(spark, sf).withColumn("i", F.col("pos")), 5, 20).select("seq_id", "i", "t")


@query(FRAMES_SQL + ", s AS (SELECT seq_id, min(t) AS a, max(t) AS b FROM frames WHERE pos >= 5 AND pos < 20 GROUP BY 1) SELECT f.seq_id, f.i FROM frames f JOIN s USING (seq_id) WHERE event_type = 'click' AND t >= a AND t <= b")
def trim_imu_semi(spark, sf):
    """Samples within the time of the kept frames, ends included."""
    f = frames(spark, sf)
    return exports.trim_imu(_kind(f, "click"), exports.trim(f.withColumn("i", F.col("pos")), 5, 20)).select("seq_id", "i")


@query(_MEMBERS + """, f AS (SELECT seq_id, CASE WHEN seq_id % 5 = 0 THEN frames + 1 ELSE frames END AS frames, posed_frames - seq_id % 2 AS posed_frames FROM members WHERE seq_id % 7 <> 3)
SELECT m.seq_id, 'missing' AS kind, 'does not exist' AS detail FROM members m ANTI JOIN f USING (seq_id)
UNION ALL SELECT m.seq_id, 'frames', m.frames || ' -> ' || f.frames FROM members m JOIN f USING (seq_id) WHERE m.frames <> f.frames
UNION ALL SELECT m.seq_id, 'frames', 'posed ' || m.posed_frames || ' -> ' || f.posed_frames FROM members m JOIN f USING (seq_id) WHERE m.posed_frames <> f.posed_frames""")
def drift_report(spark, sf):
    m = members(spark, sf).select("seq_id", "frames", "posed_frames")
    fresh = m.where("seq_id % 7 <> 3").select("seq_id", F.when(F.col("seq_id") % 5 == 0, F.col("frames") + 1).otherwise(F.col("frames")).alias("frames"), (F.col("posed_frames") - F.col("seq_id") % 2).alias("posed_frames"))
    return corpus.drift(m, fresh, "seq_id")


@query(FRAMES_SQL + ", s AS (SELECT seq_id, i, CASE event_type WHEN 'purchase' THEN 0 WHEN 'click' THEN 1 ELSE 2 END AS rank FROM frames), b AS (SELECT seq_id, min(rank) AS rank FROM s GROUP BY 1) SELECT seq_id, rank, i FROM s JOIN b USING (seq_id, rank)")
def precedence_resolve(spark, sf):
    """Table before chunks before the document's own records."""
    rank = F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "click", 1).otherwise(2)
    return corpus.precedence(frames(spark, sf).select("seq_id", "i", rank.alias("rank")), "seq_id", "rank").select("seq_id", "rank", "i")


@query("SELECT conv_id, sha256(string_agg(coalesce(text, ''), '' ORDER BY turn)) AS digest, count(*) AS chunks FROM conversations GROUP BY 1")
def tag_concat(spark, sf):
    """Repeated payloads, joined in file order."""
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))).alias("parts"))
    return c.select("conv_id", F.sha2(F.array_join(F.col("parts.text"), ""), 256).alias("digest"), F.size("parts").cast("bigint").alias("chunks"))


@query("SELECT conv_id, arg_max(text, turn) AS text FROM conversations GROUP BY 1")
def tag_last_wins(spark, sf):
    """Repeated text payloads: the last one."""
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.max_by("text", "turn").alias("text"))


@query("SELECT page_id, sha256(html) AS sha256, strlen(html) AS bytes FROM pages")
def content_sha256(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.sha2("html", 256).alias("sha256"), F.octet_length("html").cast("bigint").alias("bytes"))


# --- aggregates and windows -----------------------------------------------------------------------


@query(POSED_SQL + ", d AS (SELECT seq_id, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2) + pow(z - lag(z) OVER w, 2)) AS d FROM posed WHERE pose_valid WINDOW w AS (PARTITION BY seq_id ORDER BY pos)) SELECT seq_id, round(coalesce(sum(d), 0.0), 6) AS length FROM d GROUP BY 1")
def traj_length(spark, sf):
    before = F.lag("tr").over(W.partitionBy("seq_id").orderBy("pos"))
    step = g.norm([F.col("tr")[k] - before[k] for k in range(3)])
    return posed(spark, sf).where("pose_valid").select("seq_id", step.alias("d")).groupBy("seq_id").agg(F.round(F.coalesce(F.sum("d"), F.lit(0.0)), 6).alias("length"))


@query(POSED_SQL + ", e AS (SELECT seq_id, sqrt(x*x+y*y+z*z) AS d FROM posed WHERE pose_valid) SELECT seq_id, round(median(d), 6) AS median, round(max(d), 6) AS worst FROM e GROUP BY 1")
def ate_median(spark, sf):
    error = g.norm(g.elements(F.col("tr"), 3))
    return posed(spark, sf).where("pose_valid").groupBy("seq_id").agg(r6(F.percentile(error, F.lit(0.5))).alias("median"), r6(F.max(error)).alias("worst"))


@query(FRAMES_SQL + " SELECT seq_id, CASE WHEN count(*) > 1 AND max(t) > min(t) THEN round((count(*) - 1) / (max(t) - min(t)), 9) END AS fps, CASE WHEN count(*) > 1 AND max(t) > min(t) THEN round((max(t) - min(t)) / (count(*) - 1), 6) END AS mean_dt FROM frames GROUP BY 1")
def fps_estimate(spark, sf):
    span = F.max("t") - F.min("t")
    steps = F.count("*") - 1
    return frames(spark, sf).groupBy("seq_id").agg(F.when(span > 0, F.round(steps / span, 9)).alias("fps"), F.when(span > 0, r6(span / steps)).alias("mean_dt"))


@query(FRAMES_SQL + ", g AS (SELECT seq_id, t - lag(t) OVER (PARTITION BY seq_id ORDER BY pos) AS d FROM frames) SELECT seq_id, round(median(d), 6) AS median_dt FROM g WHERE d IS NOT NULL GROUP BY 1")
def median_dt(spark, sf):
    gap = F.col("t") - F.lag("t").over(W.partitionBy("seq_id").orderBy("pos"))
    return frames(spark, sf).select("seq_id", gap.alias("d")).where("d IS NOT NULL").groupBy("seq_id").agg(r6(F.percentile("d", F.lit(0.5))).alias("median_dt"))


@query(FRAMES_SQL + ", u AS (SELECT seq_id, CASE WHEN isfinite(value) AND value > 0 THEN value END AS v FROM frames) SELECT seq_id, round(CASE WHEN count(v) > 0 THEN greatest(0.05, min(v) * 0.95) ELSE 0.1 END, 6) AS near, round(CASE WHEN count(v) > 0 THEN greatest(2 * greatest(0.05, min(v) * 0.95), max(v) * 1.05) ELSE 10.0 END, 6) AS far FROM u GROUP BY 1")
def near_far_range(spark, sf):
    return planes.near_far(frames(spark, sf), ["seq_id"]).select("seq_id", r6(F.col("near")).alias("near"), r6(F.col("far")).alias("far"))


@query(POSED_SQL + " SELECT seq_id, round(1.2 * max(greatest(abs(x), abs(y), abs(z))), 6) AS span FROM posed WHERE pose_valid GROUP BY 1")
def scene_box(spark, sf):
    span = F.max(F.greatest(*[F.abs(c) for c in g.elements(F.col("tr"), 3)]))
    return posed(spark, sf).where("pose_valid").groupBy("seq_id").agg(r6(1.2 * span).alias("span"))


@query(FRAMES_SQL + " SELECT seq_id, CAST(count_if(event_type = 'click') AS BIGINT) AS imu, CAST(count_if(event_type = 'view') AS BIGINT) AS images, CASE WHEN count_if(event_type = 'view') > 0 THEN round(count_if(event_type = 'click') / count_if(event_type = 'view'), 6) END AS ratio FROM frames GROUP BY 1")
def imu_rate_ratio(spark, sf):
    imu, images = F.count_if(F.col("event_type") == "click"), F.count_if(F.col("event_type") == "view")
    return frames(spark, sf).groupBy("seq_id").agg(imu.alias("imu"), images.alias("images"), r6(F.try_divide(imu, images)).alias("ratio"))


@query(FRAMES_SQL + " SELECT seq_id, pos, t AS start, greatest(coalesce(lead(t) OVER (PARTITION BY seq_id ORDER BY pos), t + 1.0/30), t + 0.001) AS stop FROM frames WHERE pose_valid")
def cue_lead(spark, sf):
    after = F.lead("t").over(W.partitionBy("seq_id").orderBy("pos"))
    return frames(spark, sf).where("pose_valid").select("seq_id", "pos", F.col("t").alias("start"), F.greatest(F.coalesce(after, F.col("t") + 1.0 / 30), F.col("t") + 0.001).alias("stop"))


@query(FRAMES_SQL + ", c AS (SELECT seq_id, pos, count(*) OVER (PARTITION BY seq_id) AS n FROM frames WHERE event_type = 'purchase' OR pos = 0), n AS (SELECT seq_id, count(*) AS total FROM frames GROUP BY 1) SELECT c.seq_id, pos AS first, coalesce(lead(pos) OVER (PARTITION BY c.seq_id ORDER BY pos), total) - pos AS frames FROM c JOIN n USING (seq_id)")
def cluster_extent(spark, sf):
    """Frames of each cluster: up to the next one's first, or the end."""
    f = frames(spark, sf).withColumn("total", F.count("*").over(W.partitionBy("seq_id")))
    starts = f.where((F.col("event_type") == "purchase") | (F.col("pos") == 0))
    after = F.coalesce(F.lead("pos").over(W.partitionBy("seq_id").orderBy("pos")), F.col("total"))
    return starts.select("seq_id", F.col("pos").alias("first"), (after - F.col("pos")).alias("frames"))


@query(FRAMES_SQL + ", c AS (SELECT seq_id, pos, camera % 4 AS k FROM frames), f AS (SELECT seq_id, k, min(pos) AS first FROM c GROUP BY ALL), r AS (SELECT seq_id, k, row_number() OVER (PARTITION BY seq_id ORDER BY first) - 1 AS id FROM f) SELECT c.seq_id, pos, id AS camera FROM c JOIN r USING (seq_id, k)")
def camera_dedup_key(spark, sf):
    """Cameras numbered in the order in which their calibration is first seen."""
    f = frames(spark, sf).select("seq_id", "pos", (F.col("camera") % 4).alias("k"))
    first = F.min("pos").over(W.partitionBy("seq_id", "k"))
    return f.withColumn("first", first).select("seq_id", "pos", (F.dense_rank().over(W.partitionBy("seq_id").orderBy("first")) - 1).cast("bigint").alias("camera"))


@query(FRAMES_SQL + " SELECT seq_id, pos, round(pos / 30.0, 6) AS t, row_number() OVER (PARTITION BY seq_id ORDER BY lpad(CAST(i AS VARCHAR), 9, '0')) AS id FROM frames")
def synthesized_time(spark, sf):
    """Records sorted by file name get t = position / fps and ids from 1."""
    name = F.lpad(F.col("i").cast("string"), 9, "0")
    return frames(spark, sf).select("seq_id", "pos", r6(F.col("pos") / 30.0).alias("t"), F.row_number().over(W.partitionBy("seq_id").orderBy(name)).cast("bigint").alias("id"))


@query(_MEMBERS + " SELECT seq_id, frames, CAST(sum(frames) OVER (ORDER BY seq_id) AS BIGINT) AS \"end\" FROM members")
def cumulative_frames(spark, sf):
    return corpus.with_offsets(members(spark, sf).withColumn("mi", F.col("seq_id"))).select("seq_id", "frames", "end")


# --- text and export rows -------------------------------------------------------------------------


@query(FRAMES_SQL + ", n AS (SELECT event_id, CAST(floor(t) AS BIGINT) AS s, CAST(round((t - floor(t)) * 1e9) AS BIGINT) AS n FROM frames) SELECT event_id, s + CASE WHEN n >= 1000000000 THEN 1 ELSE 0 END AS sec, CASE WHEN n >= 1000000000 THEN 0 ELSE n END AS nanosec FROM n")
def stamp_split(spark, sf):
    """Seconds to whole seconds and nanoseconds, carried."""
    return frames(spark, sf).select("event_id", text.stamp(F.col("t")).alias("s")).select("event_id", "s.sec", "s.nanosec")


def _text_posed(spark, sf):
    """posed() as the exports take it: camera names, and positions as indices."""
    return posed(spark, sf).withColumn("camera", F.col("camera").cast("string")).withColumn("i", F.col("pos"))


_LENSES = "lens AS (SELECT DISTINCT seq_id, CAST(camera AS VARCHAR) AS camera FROM frames)"


def _lenses(spark, sf):
    """A calibration of each camera that a sequence uses."""
    own = frames(spark, sf).select("seq_id", F.col("camera").cast("string").alias("camera")).distinct()
    return own.select("seq_id", "camera", F.lit("PINHOLE").alias("model"), F.lit(640).alias("width"), F.lit(480).alias("height"), F.array(*[F.lit(x) for x in (500.0, 510.0, 320.0, 240.0)]).alias("params"))


@query(POSED_SQL + " SELECT seq_id, pos AS i, printf('%.6f %.6f %.6f %.6f %.6f %.6f %.6f %.6f', t, v[5], v[6], v[7], v[2], v[3], v[4], v[1]) AS line FROM frames JOIN vec ON vec_id = event_id % vectors WHERE pose_valid")
def tum_trajectory_text(spark, sf):
    return exports.tum_trajectory(_text_posed(spark, sf))


@query(POSED_SQL + " SELECT seq_id, pos AS i, CAST(pos AS VARCHAR) AS first, round(t, 6) AS t, round(v[1], 6) AS qw, round(v[7], 6) AS z, CAST(camera AS VARCHAR) AS camera, 10 AS fields FROM frames JOIN vec ON vec_id = event_id % vectors WHERE pose_valid")
def poses_csv(spark, sf):
    f = F.split("line", ",")
    n = lambda k: r6(f[k].cast("double"))
    return exports.poses_csv(_text_posed(spark, sf)).select("seq_id", "i", f[0].alias("first"), n(1).alias("t"), n(2).alias("qw"), n(8).alias("z"), f[9].alias("camera"), F.size(f).alias("fields"))


@query(FRAMES_SQL + """, p AS (SELECT seq_id, pos, t - min(t) OVER (PARTITION BY seq_id) AS a, greatest(coalesce(lead(t) OVER (PARTITION BY seq_id ORDER BY pos), t + 1e0/30) - min(t) OVER (PARTITION BY seq_id), t - min(t) OVER (PARTITION BY seq_id) + 1e-3) AS b FROM frames WHERE pose_valid),
m AS (SELECT seq_id, pos, CAST(round(a * 1000) AS BIGINT) AS ms, CAST(round(b * 1000) AS BIGINT) AS me FROM p)
SELECT seq_id, pos AS i, printf('%02d:%02d:%02d.%03d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) AS start, printf('%02d:%02d:%02d.%03d', me // 3600000, me // 60000 % 60, me // 1000 % 60, me % 1000) AS stop FROM m""")
def vtt_cues(spark, sf):
    return exports.poses_vtt(_text_posed(spark, sf)).select("seq_id", "i", "start", "stop")


@query(POSED_SQL + """ SELECT f.seq_id, CAST(round(t * 1e9) AS BIGINT) AS log_time, '/tf' AS topic, f.camera || '_optical_frame' AS frame, CAST(floor(t) AS BIGINT) AS sec, round(v[5], 6) AS number FROM frames f JOIN vec ON vec_id = event_id % vectors WHERE pose_valid
UNION ALL SELECT seq_id, CAST(round(t * 1e9) AS BIGINT), '/camera/' || camera || '/camera_info', camera || '_optical_frame', CAST(floor(t) AS BIGINT), 510.0 FROM frames
UNION ALL SELECT seq_id, CAST(round(t * 1e9) AS BIGINT), '/imu/imu0', 'imu0', CAST(floor(t) AS BIGINT), CAST(event_id % 7 AS DOUBLE) FROM frames WHERE event_type = 'click'""")
def message_rows(spark, sf):
    """The rows of a message log: transforms of posed frames, calibrations, samples."""
    f = _text_posed(spark, sf)
    imu = _kind(frames(spark, sf), "click").select("seq_id", F.lit("imu0").alias("imu_id"), "t", *[F.lit(0.0).alias(c) for c in ("gx", "gy", "gz", "ax", "ay")], (F.col("event_id") % 7).cast("double").alias("az"))
    log = exports.messages(f, _lenses(spark, sf), imu)
    field = lambda path: F.get_json_object("message", path)
    frame = F.coalesce(field("$.child_frame_id"), field("$.header.frame_id"))
    number = F.coalesce(field("$.transform.translation.x"), field("$.k[4]"), field("$.linear_acceleration.z")).cast("double")
    return log.select("seq_id", "log_time", "topic", frame.alias("frame"), field("$.header.stamp.sec").cast("bigint").alias("sec"), r6(number).alias("number"))


@query(POSED_SQL + ", w AS (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY pos) AS n, dense_rank() OVER (PARTITION BY seq_id ORDER BY CAST(camera AS VARCHAR)) AS c FROM rot WHERE pose_valid) SELECT seq_id, pos AS i, n, CAST(c AS BIGINT) AS c, round(-(m00*x+m10*y+m20*z), 5)+0.0 AS x, round(-(m02*x+m12*y+m22*z), 5)+0.0 AS z, printf('frame_%05d.png', pos) AS name FROM w")
def colmap_image_lines(spark, sf):
    f = F.split("line", " ")
    n = lambda k: F.round(f[k].cast("double"), 5) + F.lit(0.0)
    return exports.colmap_images(_text_posed(spark, sf)).select("seq_id", "i", f[0].cast("bigint").alias("n"), f[8].cast("bigint").alias("c"), n(5).alias("x"), n(7).alias("z"), f[9].alias("name"))


@query(FRAMES_SQL + ", " + _LENSES + " SELECT seq_id, camera, row_number() OVER (PARTITION BY seq_id ORDER BY camera) || ' PINHOLE 640 480 500.0 510.0 320.0 240.0' AS line FROM lens")
def colmap_camera_lines(spark, sf):
    return exports.colmap_cameras(_lenses(spark, sf))


@query(POSED_SQL + ", k AS (SELECT seq_id, count(*) AS frames, round(sum(x), 4) AS x, round(sum(-m01), 4) AS m01 FROM rot WHERE pose_valid GROUP BY 1) SELECT seq_id, frames, x, m01, 500.0 AS fl_x FROM k")
def transforms_documents(spark, sf):
    """One document per sequence, read again: how many frames, sums over their matrices, the focal length."""
    f = _text_posed(spark, sf).withColumn("camera", F.lit("0"))
    one = _lenses(spark, sf).groupBy("seq_id").agg(F.first("model").alias("model"), F.first("width").alias("width"), F.first("height").alias("height"), F.first("params").alias("params")).withColumn("camera", F.lit("0"))
    parsed = exports.transforms_json(f, one).select("seq_id", F.from_json("document", "fl_x double, frames array<struct<transform_matrix:array<array<double>>>>").alias("d"))
    rows = parsed.select("seq_id", "d.fl_x", F.explode("d.frames.transform_matrix").alias("m"))
    return rows.groupBy("seq_id").agg(F.count("*").alias("frames"), F.round(F.sum(F.col("m")[0][3]), 4).alias("x"), F.round(F.sum(F.col("m")[0][1]), 4).alias("m01"), F.max("fl_x").alias("fl_x"))


@query("SELECT page_id, url, (url LIKE 'http://%' OR url LIKE 'https://%') AS remote, CASE WHEN url LIKE 'http://%' OR url LIKE 'https://%' THEN url ELSE '/data/' || url END AS location FROM pages")
def resolve_uris(spark, sf):
    p = table(spark, sf, "pages")
    return p.select("page_id", "url", text.is_remote(F.col("url")).alias("remote"), text.resolve_uri(F.col("url"), F.lit("/data")).alias("location"))
