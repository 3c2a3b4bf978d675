"""Many captures as one frame-addressed corpus: manifests, lookup, shards, drift."""

from __future__ import annotations

import json
import random
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from plumbline.functions import geometry as g
from plumbline.session import ship

MANIFEST_VERSION = 1
#: Frames of a range of the global index; a lookup runs within such ranges.
INDEX_RANGE = 4096
MEMBER = T.StructType(
    [
        T.StructField("uri", T.StringType()), T.StructField("frames", T.LongType()), T.StructField("posed_frames", T.LongType()),
        T.StructField("cameras", T.ArrayType(T.StringType())), T.StructField("rgb_streams", T.ArrayType(T.StringType())), T.StructField("signals", T.ArrayType(T.StringType())),
        T.StructField("metric_scale", T.BooleanType()), T.StructField("t_start", T.DoubleType()), T.StructField("t_end", T.DoubleType()),
        T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("bytes", T.LongType()), T.StructField("sha256", T.StringType()),
    ]
)


def describe(frames: DataFrame, key: str = "seq_id") -> DataFrame:
    """One row per capture from its pose records: frames, posed_frames, t_start, t_end (0.0 if none), cameras."""
    return frames.groupBy(key).agg(
        F.count("*").alias("frames"),
        F.count_if("pose_valid").alias("posed_frames"),
        F.coalesce(F.min("t"), F.lit(0.0)).alias("t_start"),
        F.coalesce(F.max("t"), F.lit(0.0)).alias("t_end"),
        F.array_sort(F.collect_set("camera")).alias("cameras"),
    )


def totals(members: DataFrame) -> DataFrame:
    return members.agg(F.count("*").alias("members"), F.coalesce(F.sum("frames"), F.lit(0)).alias("frames"), F.coalesce(F.sum("posed_frames"), F.lit(0)).alias("posed_frames"))


def scale_mixture(members: DataFrame) -> DataFrame:
    """scales (distinct known ones), unknown (members without), mixed."""
    known = F.countDistinct("metric_scale")
    return members.agg(known.alias("scales"), F.count_if(F.col("metric_scale").isNull()).alias("unknown")).withColumn("mixed", F.col("scales") > 1)


def with_offsets(members: DataFrame, order: str = "mi") -> DataFrame:
    """Adds first (global index of the member's first frame) and end.

    Prefix sums in two steps, so no task sees all members: sums of ranges of the order, then within.
    """
    ranged = members.withColumn("_range", F.floor(F.col(order) / 65_536))
    sums = ranged.groupBy("_range").agg(F.sum("frames").alias("_frames"))
    starts = sums.withColumn("_start", F.coalesce(F.sum("_frames").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_frames")
    inside = F.coalesce(F.sum("frames").over(W.partitionBy("_range").orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return ranged.withColumn("first", inside).join(starts, "_range").withColumn("first", F.col("first") + F.col("_start")).withColumn("end", F.col("first") + F.col("frames")).drop("_range", "_start")


def locate(wanted: DataFrame, members: DataFrame, index: str = "index", order: str = "mi", total: int | None = None) -> DataFrame:
    """Adds member and frame to each global index; negative ones count from the end, others outside are dropped.

    Members and lookups are cut into ranges of the index and sorted together: the member of a lookup is
    the last that begins at or before it. Linear, whatever the number of members. ``total``: frames of
    all members, if known.
    """
    if total is None:
        total = members.agg(F.coalesce(F.sum("frames"), F.lit(0)).alias("n")).first()["n"]
    at = F.when(F.col(index) < 0, F.col(index) + total).otherwise(F.col(index))
    asked = wanted.select(F.struct(*wanted.columns).alias("_row"), at.alias("_at")).where((F.col("_at") >= 0) & (F.col("_at") < total))
    offsets = with_offsets(members, order).where("frames > 0")
    cuts = F.sequence(F.floor(F.col("first") / INDEX_RANGE), F.floor((F.col("end") - 1) / INDEX_RANGE))
    starts = offsets.select(F.col(order).alias("member"), "first", F.explode(cuts).alias("_cut")).select(F.greatest("first", F.col("_cut") * INDEX_RANGE).alias("_at"), "_cut", F.struct("member", "first").alias("_m"))
    both = starts.unionByName(asked.withColumn("_cut", F.floor(F.col("_at") / INDEX_RANGE)), allowMissingColumns=True)
    along = W.partitionBy("_cut").orderBy("_at", F.col("_row").isNotNull()).rowsBetween(W.unboundedPreceding, W.currentRow)
    found = both.withColumn("_m", F.last("_m", True).over(along)).where(F.col("_row").isNotNull())
    return found.select("_row.*", F.col("_m.member").alias("member"), (F.col("_at") - F.col("_m.first")).alias("frame"))


def shard_of(position: Column, count: int) -> Column:
    return F.pmod(position, F.lit(count)).cast("int")


def shard(members: DataFrame, index: int, count: int, seed: int | None = None, order: str = "mi") -> DataFrame:
    """Whole members dealt round-robin; with a seed, in an order that is repeatable (by hash, not a generator's)."""
    if not 0 <= index < count:
        raise ValueError(f"shard {index} of {count}")
    if seed is None:
        return members.where(shard_of(F.col(order), count) == index)
    return ranked(members, seed, order).where(shard_of(F.col("rank"), count) == index).drop("rank")


def ranked(members: DataFrame, seed: int, order: str = "mi") -> DataFrame:
    """Adds rank, from 0: the place of each member in a repeatable pseudo-random order.

    In two steps, so no task sees all members: counts of ranges of the draw, then ranks within.
    """
    drawn = members.withColumn("_draw", F.xxhash64(F.col(order), F.lit(seed))).withColumn("_range", F.shiftright("_draw", 48))
    counts = drawn.groupBy("_range").agg(F.count("*").alias("_n"))
    starts = counts.select("_range", F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    inside = F.row_number().over(W.partitionBy("_range").orderBy("_draw", order)) - 1
    return drawn.withColumn("_inside", inside).join(starts, "_range").withColumn("rank", F.col("_start") + F.col("_inside")).drop("_draw", "_range", "_inside", "_start")


def epoch_seed(seed: int, epoch: int) -> int:
    """The seed of a training epoch: every epoch has an order of its own."""
    return seed + epoch


def worker_shard(rank: int, world: int, worker: int = 0, workers: int = 1) -> tuple[int, int]:
    """(index, count) of a loader worker of a distributed job."""
    return rank * workers + worker, world * workers


def exact_shuffle(n: int, seed: int) -> list[int]:
    """The member order of a seeded generator, for replays; members are few enough for the driver."""
    order = list(range(n))
    random.Random(seed).shuffle(order)
    return order


def frame_at(frames: DataFrame, members: DataFrame, index: int, key: str = "uri") -> DataFrame:
    """The frame of a global index: the rows of frames (key, pos) of one member, filtered, not joined; IndexError beyond the corpus."""
    asked = members.sparkSession.createDataFrame([(index,)], "index bigint")
    found = locate(asked, members).first()
    if found is None:
        raise IndexError(f"frame {index}")
    uri = members.where(F.col("mi") == found.member).select(key).first()[0]
    return frames.where((F.col(key) == uri) & (F.col("pos") == found.frame))


def pose_fields(frames: DataFrame) -> DataFrame:
    """What a training step has of each frame: its place and time, and, where posed, its pose and matrix."""
    posed = F.col("pose_valid")
    m, tr = g.pose(g.elements(F.col("q_wxyz"), 4), g.elements(F.col("tr"), 3))
    rows = [x for r in range(3) for x in (*m[3 * r : 3 * r + 3], tr[r])] + [F.lit(x) for x in (0.0, 0.0, 0.0, 1.0)]
    return frames.withColumn("c2w", F.when(posed, F.array(*rows))).withColumn("q_wxyz", F.when(posed, F.col("q_wxyz"))).withColumn("tr", F.when(posed, F.col("tr")))


def wanted_signals(signals: DataFrame, fields: Sequence[str]) -> DataFrame:
    """seq_id, id, field: the signals that fields ask for (``signals``: all, ``depth``: those of that role, else by id) and the names they get."""
    asked = F.lit("signals" in fields) | F.col("id").isin(*fields) | (F.lit("depth" in fields) & (F.col("role") == "depth"))
    return signals.where(asked).select("seq_id", "id", F.when(F.col("role") == "depth", "depth").otherwise(F.col("id")).alias("field"))


def signal_by_role(signals: DataFrame, role: str) -> DataFrame:
    """The first signal of a role of each capture, in order of ``ord`` (or of id)."""
    order = "ord" if "ord" in signals.columns else "id"
    return signals.where(F.col("role") == role).groupBy("seq_id").agg(F.min_by("id", order).alias("id"))


def iter_frames(frames: DataFrame, members: DataFrame, fields: Sequence[str] = (), signals: DataFrame | None = None, planes: DataFrame | None = None, shard_of_members: tuple[int, int] | None = None, seed: int | None = None, buffer: int = 0, posed_only: bool = False, key: str = "seq_id") -> DataFrame:
    """The frames of a corpus, or of one shard's whole members, with the planes that fields ask for as a map by field.

    Without fields no plane is read. With a seed, members come in its order, and a buffer mixes frames
    further. Rows are ordered by member and frame (or as shuffled).
    """
    own = members if shard_of_members is None else shard(members, *shard_of_members, seed=seed)
    own = own.withColumn("rank", F.col("mi")) if seed is None else ranked(own, seed)
    rows = frames.where("pose_valid") if posed_only else frames
    out = pose_fields(rows).join(own.select(key, F.col("mi").alias("member"), "rank"), key)
    if fields and signals is not None and planes is not None:
        named = planes.join(wanted_signals(signals, fields).withColumnRenamed("id", "signal_id"), ["seq_id", "signal_id"])
        packed = named.groupBy("seq_id", "i").agg(F.map_from_entries(F.collect_list(F.struct("field", F.struct("w", "h", "codes")))).alias("planes"))
        out = out.join(packed, ["seq_id", "i"], "left")
    out = out.orderBy("rank", "pos")
    return shuffle_buffer(out, buffer, seed) if buffer > 1 and seed is not None else out


def shuffle_buffer(rows: DataFrame, size: int, seed: int) -> DataFrame:
    """Rows in an order that a buffer of ``size`` rows makes in each partition: when it is full, one of it at random goes out."""
    ship(rows.sparkSession)

    def mix(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rng, held = random.Random(seed * 1_000_003 + TaskContext.get().partitionId()), []
        for part in parts:
            out = []
            for row in range(part.num_rows):
                held.append(part.slice(row, 1))
                if len(held) >= size:
                    out.append(held.pop(rng.randrange(len(held))))
            if out:
                yield from pa.Table.from_batches(out).combine_chunks().to_batches()
        rng.shuffle(held)
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return rows.mapInArrow(mix, rows.schema)


def distinct_sets(cameras: DataFrame, signals: DataFrame, members: DataFrame) -> DataFrame:
    """One row: sorted distinct cameras, signals, resolutions and scales (as text; an unknown one counts) of a corpus."""
    size = F.concat_ws("x", F.col("width").cast("string"), F.col("height").cast("string"))
    a = cameras.agg(F.array_sort(F.collect_set("camera")).alias("cameras"), F.array_sort(F.collect_set(size)).alias("resolutions"), F.lit(1).alias("one"))
    b = signals.agg(F.array_sort(F.collect_set("id")).alias("signals"), F.lit(1).alias("one"))
    c = members.agg(F.array_sort(F.collect_set(F.coalesce(F.col("metric_scale").cast("string"), F.lit("none")))).alias("scales"), F.lit(1).alias("one"))
    return a.join(b, "one").join(c, "one").drop("one")


def shuffled(frames: DataFrame, seed: int, *keys: str) -> DataFrame:
    """All rows in a repeatable pseudo-random order."""
    return frames.orderBy(F.xxhash64(*keys, F.lit(seed)), *keys)


def drift(manifest: DataFrame, fresh: DataFrame, key: str = "uri", unreadable: DataFrame | None = None) -> DataFrame:
    """key, kind, detail for each way a manifest's row differs from a fresh one: missing, unreadable, frames (all and posed), resolution, cameras, bytes, sha256.

    unreadable: key and error of files that are there but can't be read.
    """
    bad = unreadable.select(key, F.col("error").alias("_error")) if unreadable is not None else manifest.select(key, F.lit(None).cast("string").alias("_error")).limit(0)
    both = manifest.alias("m").join(fresh.withColumn("_there", F.lit(True)).alias("f"), key, "left").join(bad, key, "left")
    m, f = (lambda c: F.col(f"m.{c}")), (lambda c: F.col(f"f.{c}"))
    have = set(manifest.columns) & set(fresh.columns)
    there = F.col("f._there").isNotNull()
    change = lambda c: F.concat_ws(" -> ", m(c).cast("string"), f(c).cast("string"))
    checks = [("missing", ~there & F.col("_error").isNull(), F.lit("does not exist")), ("unreadable", ~there & F.col("_error").isNotNull(), F.col("_error"))]
    if "frames" in have:
        checks.append(("frames", there & (m("frames") != f("frames")), change("frames")))
    if "posed_frames" in have:
        checks.append(("frames", there & (m("posed_frames") != f("posed_frames")), F.concat(F.lit("posed "), change("posed_frames"))))
    if {"width", "height"} <= have:
        size = lambda side: F.concat_ws("x", side("width").cast("string"), side("height").cast("string"))
        checks.append(("resolution", there & ((m("width") != f("width")) | (m("height") != f("height"))), F.concat_ws(" -> ", size(m), size(f))))
    if "cameras" in have:
        checks.append(("cameras", there & (F.array_sort(m("cameras")) != F.array_sort(f("cameras"))), F.concat_ws(" -> ", F.array_join(m("cameras"), ","), F.array_join(f("cameras"), ","))))
    checks += [(c, there & m(c).isNotNull() & f(c).isNotNull() & (m(c) != f(c)), change(c)) for c in ("bytes", "sha256") if c in have]
    found = F.array(*[F.when(hit, F.struct(F.lit(kind).alias("kind"), detail.alias("detail"))) for kind, hit, detail in checks])
    return both.select(key, F.inline(F.filter(found, lambda x: x.isNotNull())))


def precedence(sources: DataFrame, by: str, rank: str) -> DataFrame:
    """Rows of the best source (least rank) that a key has any of."""
    best = sources.groupBy(by).agg(F.min(rank).alias(rank))
    return sources.join(best, [by, rank])


def write_manifest(members: DataFrame, path: str, description: str = "") -> None:
    """A manifest is one small document; its members' rows are collected in order and written as JSON."""
    rows = [json.loads(r[0]) for r in members.orderBy("mi").select(F.to_json(F.struct(*[c for c in MEMBER.names if c in members.columns]))).toLocalIterator()]
    body = {"version": MANIFEST_VERSION, "description": description, "members": rows, "total_frames": sum(r.get("frames", 0) for r in rows), "total_posed_frames": sum(r.get("posed_frames", 0) for r in rows)}
    members.sparkSession.createDataFrame([(json.dumps(body, indent=1),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """mi and the known fields of each member; unknown ones are ignored, newer versions refused."""
    whole = spark.read.text(path, wholetext=True).where(F.length("value") > 0)
    kind = T.StructType([T.StructField("version", T.IntegerType()), T.StructField("members", T.ArrayType(MEMBER))])
    parsed = whole.select(F.from_json("value", kind).alias("m"))
    checked = parsed.where(F.when(F.coalesce(F.col("m.version"), F.lit(0)) > MANIFEST_VERSION, F.raise_error(F.lit("manifest version is newer than this reader")).cast("boolean")).otherwise(True))
    return checked.select(F.posexplode("m.members").alias("mi", "member")).select("mi", "member.*")
