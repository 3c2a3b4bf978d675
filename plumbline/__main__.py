"""Command line: python -m plumbline info|validate|index|collection|poses|extract|trim|convert|demo|detect ...

Exit codes: 0, or 1 if a check found something (validate: any error, with --strict any finding;
index: any unreadable file; collection --verify: any drift).
"""

from __future__ import annotations

import argparse
import sys
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import text
from plumbline.operators import corpus, rules
from plumbline.session import build_session
from plumbline.sources import captures, convert, exports, layouts, synthetic


def members_of(spark, path: str | list[str], checksum: bool = False, prefix: str = "POSED", relative_to: str | None = None, suffix: str = ".webm"):
    """Manifest rows of captures (files, folders, http addresses; one named twice counts twice), and the rows of files that can't be read; plain video is left out of both.

    Only metadata is read, no pictures.
    """
    paths = [path] if isinstance(path, str) else path
    if len(paths) > 1:
        good, bad = zip(*(members_of(spark, p, checksum, prefix, relative_to, suffix) for p in paths), strict=True)
        return reduce(DataFrame.unionByName, good), reduce(DataFrame.unionByName, bad)
    path = paths[0]
    t = captures.read_all(spark, path, prefix=prefix, suffix=suffix, mode="header")
    d = t["documents"]
    described = corpus.describe(t["frames"]).withColumnRenamed("cameras", "_used")
    cameras = t["cameras"].groupBy("seq_id").agg(F.array_sort(F.collect_set("camera")).alias("cameras"), F.max("width").alias("width"), F.max("height").alias("height"))
    signals = t["signals"].groupBy("seq_id").agg(F.array_sort(F.collect_list("id")).alias("signals"))
    streams = t["streams"].groupBy("seq_id").agg(F.array_sort(F.collect_list(F.struct("ord", "id"))).alias("s")).select("seq_id", F.col("s.id").alias("rgb_streams"))
    good = d.where("document IS NOT NULL AND error IS NULL").join(described, "seq_id", "left").join(cameras, "seq_id", "left").join(signals, "seq_id", "left").join(streams, "seq_id", "left")
    rows = good.select(
        "uri", F.coalesce("frames", F.lit(0)).alias("frames"), F.coalesce("posed_frames", F.lit(0)).alias("posed_frames"), "cameras", F.coalesce("rgb_streams", "cameras").alias("rgb_streams"), "signals", F.col("world.metric_scale").alias("metric_scale"),
        F.coalesce("t_start", F.lit(0.0)).alias("t_start"), F.coalesce("t_end", F.lit(0.0)).alias("t_end"), "width", "height", "bytes",
    )
    if checksum:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        rows = rows.join(files.select(F.regexp_replace("path", "^file:/*", "/").alias("uri"), F.sha2("content", 256).alias("sha256")), "uri", "left")
    else:
        rows = rows.withColumn("sha256", F.lit(None).cast("string"))
    if relative_to is not None:
        rows = rows.withColumn("uri", text.relative_uri(F.col("uri"), F.lit(relative_to)))
    return rows, d.where("error IS NOT NULL").select("uri", "error")


def numbered(members):
    """Members in order of path, numbered from 0."""
    from pyspark.sql.window import Window as W

    return members.withColumn("mi", F.row_number().over(W.orderBy("uri")) - 1)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="plumbline", description=__doc__)
    p.add_argument("--master", default="local[*]")
    p.add_argument("--prefix", default="POSED", help="prefix of the container's tag names")
    sub = p.add_subparsers(dest="command", required=True)
    for name, *options in (("info",), ("validate", "strict"), ("index", "checksum"), ("collection", "verify", "members", "checksum"), ("poses",), ("extract",), ("trim",), ("convert",), ("demo",), ("detect",)):
        s = sub.add_parser(name)
        s.add_argument("path")
        for o in options:
            s.add_argument(f"--{o}", action="store_true")
        if name in ("index", "poses", "extract", "trim", "convert"):
            s.add_argument("out")
        if name == "index":
            s.add_argument("--relative-to", help="folder that members' addresses are relative to")
            s.add_argument("--suffix", default=".webm")
        if name == "demo":
            s.add_argument("--count", type=int, default=30)
        if name == "poses":
            s.add_argument("--format", choices=("csv", "tum", "vtt"), default="csv")
        if name == "trim":
            s.add_argument("--frames", required=True, help="first:stop")
        if name == "collection":
            s.add_argument("--root", help="folder that holds the members, for --verify")
    a = p.parse_args(argv)
    if a.command == "detect":
        print(layouts.detect(a.path) or "unknown")
        return 0 if layouts.detect(a.path) else 1
    spark = build_session(a.master)
    captures.register(spark)
    if a.command == "info":
        rows, bad = members_of(spark, a.path, prefix=a.prefix)
        for r in rows.orderBy("uri").toLocalIterator():
            print(f"{r.uri}: {r.frames} frames ({r.posed_frames} posed), {r.t_start:.3f}-{r.t_end:.3f} s, cameras {', '.join(r.cameras or [])}")
        return int(bool(bad.head(1)))
    if a.command == "validate":
        found = rules.validate(captures.read_all(spark, a.path, prefix=a.prefix)).collect()
        for r in found:
            print(f"{r.seq_id}: {r.severity} [{r.section}] {r.message}")
        return int(any(r.severity == rules.ERROR for r in found) or (a.strict and bool(found)))
    if a.command == "index":
        rows, bad = members_of(spark, a.path.split(","), a.checksum, a.prefix, a.relative_to, a.suffix)
        corpus.write_manifest(numbered(rows), a.out)
        failed = bad.collect()
        for r in failed:
            print(f"{r.uri}: {r.error}", file=sys.stderr)
        return int(bool(failed))
    if a.command == "collection":
        m = corpus.read_manifest(spark, a.path)
        t = corpus.totals(m).first()
        print(f"{t.members} members, {t.frames} frames ({t.posed_frames} posed)")
        if a.members:
            for r in m.orderBy("mi").toLocalIterator():
                print(f"{r.mi}: {r.uri} {r.frames}")
        if a.verify:
            fresh, bad = members_of(spark, a.root or ".", a.checksum, a.prefix)
            drift = corpus.drift(m.drop("mi"), fresh, unreadable=bad).collect()
            for r in drift:
                print(f"{r.uri}: {r.kind}: {r.detail}")
            return int(bool(drift))
        return 0
    if a.command == "demo":
        captures.write(captures.capture_json(synthetic.frames(spark, a.count), synthetic.cameras(spark, 128, 96)), a.path, prefix=a.prefix)
        return 0
    if a.command == "convert":
        found = convert.any_layout(spark, a.path)
        captures.write(captures.capture_json(found["frames"], found["cameras"], rigs=found.get("rigs"), imu_streams=found.get("imu_streams"), imu=found.get("imu"), sequences=found.get("sequences")), a.out, prefix=a.prefix)
        return 0
    frames = captures.read(spark, a.path, "frames", prefix=a.prefix)
    if a.command == "extract":
        exports.write_lines(exports.poses_csv(frames), f"{a.out}/poses")
        exports.write_lines(exports.imu_csv(captures.read(spark, a.path, "imu", prefix=a.prefix)), f"{a.out}/imu")
        captures.read(spark, a.path, "sequences", prefix=a.prefix).select("seq_id", "document").write.partitionBy("seq_id").text(f"{a.out}/document")
        return 0
    if a.command == "poses":
        if a.format == "vtt":
            lines = exports.poses_vtt(frames).select("seq_id", "i", F.format_string("%s --> %s\n%s\n", "start", "stop", "body").alias("line"))
        else:
            lines = {"csv": exports.poses_csv, "tum": exports.tum_trajectory}[a.format](frames)
        exports.write_lines(lines, a.out)
        return 0
    first, _, stop = a.frames.partition(":")
    first, stop = int(first or 0), int(stop or 1 << 40)
    t = captures.read_all(spark, a.path, prefix=a.prefix)
    kept = exports.trim(frames, first, stop)
    noted = t["documents"].withColumn("world", F.col("world").withField("description", F.concat_ws("; ", "world.description", F.lit(f"frames {first} to {'the end' if stop == 1 << 40 else stop - 1} of a longer capture"))))
    whole = captures.capture_json(kept, t["cameras"], t["signals"], t["rigs"], t["imu_streams"], exports.trim_imu(t["imu"], kept), t["streams"], noted)
    captures.write(captures.with_packets(whole, captures.read(spark, a.path, "packets", prefix=a.prefix), first, stop), a.out, prefix=a.prefix)
    return 0


if __name__ == "__main__":
    sys.exit(main())
