"""Capture files as tables: a Python data source, table functions over bytes, and a writer.

``spark.read.format("posedvideo").option("relation", r).load(path)`` gives one relation: sequences,
cameras, frames, signals, rigs, imu, imu_streams, streams, tags, headers, packets, elements or clusters.
One file is one partition. Equality and range filters on ``seq_id`` and ``i`` are pushed to the reader.
Files are read in ranges: metadata relations pass over the clusters, ``packets`` reads the bytes of
those that hold wanted frames only. The path may be a file, a folder or an http(s) address. Options:
``prefix`` (of tag names), ``mode`` (``strict`` raises on a bad file, ``permissive`` gives it as an
error in ``sequences`` and leaves it out elsewhere, ``header`` is permissive and reads only up to the
first cluster, and what the index names), ``suffix`` of file names.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema

from plumbline.session import ship
from plumbline.sources import ebml, records

_MAP = "struct<type:string,scale:double,offset:double,invalid:int,near:double,far:double,levels:int,labels:map<string,string>>"
SCHEMAS = {
    "sequences": "seq_id string, uri string, version string, document string, world struct<metric_scale:boolean,gravity_in_world:array<double>,description:string>, conventions map<string,string>, video_frames bigint, bytes bigint, error string",
    "cameras": "seq_id string, camera string, model string, width int, height int, params array<double>",
    "frames": "seq_id string, pos bigint, i bigint, t double, camera string, q_wxyz array<double>, tr array<double>, pose_valid boolean, params array<double>",
    "signals": f"seq_id string, id string, role string, value_map {_MAP}, width int, height int",
    "rigs": "seq_id string, rig_id string, camera string, q_wxyz array<double>, tr array<double>",
    "imu_streams": "seq_id string, imu_id string, rate_hz double, description string, extrinsics struct<q_wxyz:array<double>,tr:array<double>>",
    "imu": "seq_id string, imu_id string, t double, gx double, gy double, gz double, ax double, ay double, az double",
    "streams": "seq_id string, ord int, id string, width int, height int, hdr boolean",
    "tags": "seq_id string, name string, is_binary boolean, value binary",
    "headers": "seq_id string, uri string, bytes bigint, extent bigint, fetched bigint, cues int, clusters int",
    "packets": "seq_id string, i bigint, cluster int, independent boolean, data binary",
    "elements": "seq_id string, name string, depth int, start bigint, payload bigint, end bigint",
    "clusters": "seq_id string, ord int, first bigint, frames bigint, start bigint, end bigint, independent boolean",
}


def _floats(x) -> list[float] | None:
    return None if x is None else [float(v) for v in x]


def relation_rows(relation: str, seq_id: str, uri: str, data: bytes, prefix: str) -> Iterator[tuple]:
    """Rows of one relation of one file."""
    if relation == "elements":
        for depth, e in ebml.walk(data, deep=True):
            yield seq_id, e.name, depth, e.start, e.payload, e.end
        return
    if relation == "clusters":
        first = 0
        for n, (start, end, blocks, key) in enumerate(ebml.clusters(data)):
            yield seq_id, n, first, blocks, start, end, key
            first += blocks
        return
    if relation == "tags":
        for name, value in ebml.all_tags(data).items():
            short = name.removeprefix(f"{prefix}_") if name != prefix else "DOCUMENT"
            yield seq_id, short, isinstance(value, bytes), value if isinstance(value, bytes) else value.encode()
        return
    found = records.parse_file(data, prefix)
    d = found["document"]
    if relation == "sequences":
        w = (d or {}).get("world") or {}
        world = (w.get("metric_scale"), _floats(w.get("gravity_in_world")), w.get("description")) if d is not None else None
        conventions = {k: str(v) for k, v in ((d or {}).get("conventions") or {}).items()}
        yield seq_id, uri, (d or {}).get("version"), json.dumps(d) if d is not None else None, world, conventions, sum(c[2] for c in found["clusters"]), len(data), None
    elif d is None:
        return
    elif relation == "cameras":
        for k, c in d.get("cameras", {}).items():
            yield seq_id, k, c.get("model"), c.get("width"), c.get("height"), _floats(c.get("params"))
    elif relation == "frames":
        for pos, f in enumerate(found["frames"]):
            yield seq_id, pos, f["i"], f["t"], f["camera"], f["q_wxyz"], f["tr"], f["pose_valid"], f["params"]
    elif relation == "signals":
        for s in d.get("signals") or []:
            m = s.get("value_map")
            value_map = None if m is None else (m.get("type"), *[None if m.get(k) is None else float(m[k]) for k in ("scale", "offset")], m.get("invalid"), *[None if m.get(k) is None else float(m[k]) for k in ("near", "far")], m.get("levels"), m.get("labels"))
            yield seq_id, s.get("id"), s.get("role"), value_map, s.get("width"), s.get("height")
    elif relation == "rigs":
        for rig, r in (d.get("rigs") or {}).items():
            for camera, p in (r.get("cameras") or {}).items():
                yield seq_id, rig, camera, _floats(p.get("q_wxyz")), _floats(p.get("tr"))
    elif relation == "imu_streams":
        for k, s in (d.get("imu") or {}).items():
            e = s.get("extrinsics")
            yield seq_id, k, None if s.get("rate_hz") is None else float(s["rate_hz"]), s.get("description"), None if e is None else (_floats(e.get("q_wxyz")), _floats(e.get("tr")))
    elif relation == "streams":
        for n, s in enumerate(d.get("rgb_streams") or []):
            s = s if isinstance(s, dict) else {"id": s}
            yield seq_id, n, str(s.get("id")), s.get("width"), s.get("height"), s.get("hdr") is not None and s.get("hdr") is not False
    elif relation == "imu":
        for k, samples in found["imu"].items():
            for row in samples:
                yield (seq_id, k, *row)


#: Relations that a file's clusters have no part in.
METADATA = ("cameras", "frames", "signals", "rigs", "imu", "imu_streams", "streams", "tags")


def file_rows(relation: str, uri: str, prefix: str, header_only: bool = False, low: int = 0, high: int = 1 << 62, fetch: ebml.Fetch | None = None, size: int | None = None) -> Iterator[tuple]:
    """Rows of one relation of a file, of which no more is read than that takes; low, high: of packets, inclusive."""
    name, fetch = _seq_id(uri), fetch or ebml.fetcher(uri)
    if relation == "elements":
        yield from relation_rows(relation, name, uri, fetch(0, size or ebml.file_size(uri) or 1 << 30), prefix)
        return
    found = ebml.skim(fetch, header_only)
    if relation in METADATA:
        yield from relation_rows(relation, name, uri, found.metadata, prefix)
    elif relation == "headers":
        yield name, uri, size or ebml.file_size(uri), found.extent, found.fetched, len(found.cues), len(found.clusters)
    elif relation == "sequences":
        row = list(next(relation_rows(relation, name, uri, found.metadata, prefix)))
        row[6] = None if header_only else sum(_count(fetch, c)[0] for c in found.clusters)
        row[7] = size or ebml.file_size(uri)
        yield tuple(row)
    else:  # clusters, packets
        first = 0
        for n, (start, payload, end) in enumerate(found.clusters):
            blocks, key, stop = _count(fetch, (start, payload, end))
            if relation == "clusters":
                yield name, n, first, blocks, start, stop, key
            elif first <= high and first + blocks > low:
                for i, (_, at, size, own) in enumerate(_of_first_track(fetch, payload, end), first):
                    if low <= i <= high:
                        yield name, i, n, own, fetch(at, size)
            first += blocks


def _of_first_track(fetch: ebml.Fetch, payload: int, end: int) -> list[tuple[int, int, int, bool]]:
    blocks = list(ebml.cluster_blocks(fetch, payload, end))
    return [b for b in blocks if b[0] == blocks[0][0]]


def _count(fetch: ebml.Fetch, cluster: tuple[int, int, int]) -> tuple[int, bool, int]:
    """(blocks of the first track, whether the first is a key frame, end) of a cluster."""
    start, payload, end = cluster
    own = _of_first_track(fetch, payload, end)
    return len(own), own[0][3] if own else True, end if end >= 0 else (own[-1][1] + own[-1][2] if own else payload)


def _is_remote(uri: str) -> bool:
    return uri.startswith(("http://", "https://"))


class _File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.relation, self.prefix = options.get("relation", "frames"), options.get("prefix", ebml.TAG_PREFIX)
        self.mode, self.path, self.suffix = options.get("mode", "permissive"), options["path"], options.get("suffix", ".webm")
        self.only: set[str] | None = None
        self.low, self.high = -(1 << 62), 1 << 62

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802  Spark's name
        for f in filters:
            column = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if column == "seq_id" and isinstance(f, EqualTo):
                self.only = {f.value} if self.only is None else self.only & {f.value}
            elif column == "i" and self.relation in ("frames", "packets") and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low, f.value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.high = min(self.high, f.value - isinstance(f, LessThan))
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        root = self.path.removeprefix("file://")
        if not os.path.exists(root) and not _is_remote(root):
            raise FileNotFoundError(root)
        paths = [os.path.join(d, n) for d, _, names in os.walk(root) for n in names if n.endswith(self.suffix)] if os.path.isdir(root) else [root]
        return [_File(p) for p in sorted(paths) if self.only is None or _seq_id(p) in self.only] or [_File("")]

    def read(self, partition: _File) -> Iterator[tuple]:
        if not partition.path:
            return
        rows = file_rows(self.relation, partition.path, self.prefix, self.mode == "header", self.low, self.high)
        try:
            if self.relation != "packets":  # a file whose end is bad gives no rows at all
                rows = list(rows)
            yield from (r for r in rows if self.relation != "frames" or self.low <= r[2] <= self.high)
        except (ValueError, IndexError, KeyError, TypeError, OSError) as e:
            if self.mode == "strict":
                raise
            if self.relation == "sequences":
                size = None if _is_remote(partition.path) else os.path.getsize(partition.path)
                yield _seq_id(partition.path), partition.path, None, None, None, None, None, size, f"{type(e).__name__}: {e}"


def _seq_id(path: str) -> str:
    return os.path.splitext(os.path.basename(path))[0]


class _Commit(WriterCommitMessage):
    def __init__(self, files: list[str]):
        self.files = files


class _Writer(DataSourceWriter):
    """Rows (seq_id, capture as JSON) to one file each; files of a failed job are removed."""

    def __init__(self, options: dict):
        self.path, self.prefix, self.form = options["path"].removeprefix("file://"), options.get("prefix", ebml.TAG_PREFIX), options.get("form", "auto")
        self.live = options.get("live", "false") == "true"

    def write(self, iterator) -> WriterCommitMessage:
        os.makedirs(self.path, exist_ok=True)
        done = []
        for row in iterator:
            video = row["video"] if "video" in row else None
            data = records.build_file(json.loads(row["capture"]), self.prefix, self.form, [bytes(v) for v in video or []], live=self.live)
            target = os.path.join(self.path, f"{row['seq_id']}.webm")
            with open(f"{target}.part", "wb") as f:
                f.write(data)
            os.replace(f"{target}.part", target)
            done.append(target)
        return _Commit(done)

    def commit(self, messages: list) -> None:
        pass

    def abort(self, messages: list) -> None:
        for m in messages:
            for f in m.files if m else ():
                if os.path.exists(f):
                    os.remove(f)


class PosedVideo(DataSource):
    @classmethod
    def name(cls) -> str:
        return "posedvideo"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("relation", "frames")]

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(dict(self.options))


def register(spark: SparkSession, prefix: str = ebml.TAG_PREFIX) -> None:
    """Make the format and the SQL table functions (for files whose tags have this prefix) known to a session."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PosedVideo)
    for name, relation in (("ebml_elements", "elements"), ("simple_tags", "tags"), ("capture_frames", "frames"), ("capture_imu", "imu")):
        spark.udtf.register(name, F.udtf(_table_function(relation, prefix), returnType=SCHEMAS[relation]))
    spark.udtf.register("unpack_frames", F.udtf(_unpacked_frames(), returnType="i bigint, t double, camera string, pose_valid boolean, q_wxyz array<double>, tr array<double>"))
    spark.udtf.register("unpack_imu", F.udtf(_unpacked_imu(), returnType="t double, gx double, gy double, gz double, ax double, ay double, az double"))


def _table_function(relation: str, prefix: str):
    class Rows:
        def eval(self, seq_id: str, content: bytes):
            yield from relation_rows(relation, seq_id, seq_id, bytes(content), prefix)

    return Rows


def _unpacked_frames():
    class Rows:
        def eval(self, raw: bytes, cameras: list):
            for f in records.unpack_frames(bytes(raw), list(cameras)):
                yield f["i"], f["t"], f["camera"], f["pose_valid"], f["q_wxyz"], f["tr"]

    return Rows


def _unpacked_imu():
    class Rows:
        def eval(self, raw: bytes):
            for row in records.unpack_imu(bytes(raw)):
                yield tuple(row)

    return Rows


def read(spark: SparkSession, path: str, relation: str = "frames", **options) -> DataFrame:
    register(spark, options.get("prefix", ebml.TAG_PREFIX))
    return spark.read.format("posedvideo").options(relation=relation, **options).load(path)


def read_all(spark: SparkSession, path: str, **options) -> dict[str, DataFrame]:
    """All relations, by the names that the rules use."""
    out = {r: read(spark, path, r, **options) for r in SCHEMAS if r not in ("headers", "packets")}
    out["documents"] = out.pop("sequences")
    return out


def decode(files: DataFrame, relation: str = "frames", prefix: str = ebml.TAG_PREFIX, header_only: bool = False, low: int = 0, high: int = 1 << 62) -> DataFrame:
    """One relation of files held as columns uri and content, of which no more is looked at than the relation takes."""
    ship(files.sparkSession)
    schema = T.StructType.fromDDL(SCHEMAS[relation])
    names, kind = schema.fieldNames(), to_arrow_schema(schema)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out = list(file_rows(relation, uri, prefix, header_only, low, high, lambda at, n, data=content: data[at : at + n], len(content)))
                if out:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], schema=kind)

    return files.select("uri", "content").mapInArrow(rows, SCHEMAS[relation])


def encode(captures: DataFrame, prefix: str = ebml.TAG_PREFIX, form: str = "auto", live: bool = False) -> DataFrame:
    """captures (seq_id, capture and, if there is one, video) to seq_id, uri, content: the files that write() would make."""
    ship(captures.sparkSession)
    own = captures if "video" in captures.columns else captures.withColumn("video", F.array().cast("array<binary>"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seqs, whole, videos = (c.to_pylist() for c in batch.columns)
            made = [records.build_file(json.loads(c), prefix, form, list(v or []), live=live) for c, v in zip(whole, videos, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(seqs), pa.array([f"{s}.webm" for s in seqs]), pa.array(made, pa.binary())], ["seq_id", "uri", "content"])

    return own.select(F.col("seq_id").cast("string"), "capture", "video").mapInArrow(rows, "seq_id string, uri string, content binary")


def retag(files: DataFrame, tags: DataFrame, prefix: str = ebml.TAG_PREFIX) -> DataFrame:
    """files (seq_id, uri, content) with their own tags replaced by those of tags (seq_id, name, value; names without the prefix, DOCUMENT for the document itself)."""
    ship(files.sparkSession)
    per_file = tags.groupBy("seq_id").agg(F.collect_list(F.struct("name", "value")).alias("tags"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seqs, uris, contents, new = (c.to_pylist() for c in batch.columns)
            out = []
            for content, mine in zip(contents, new, strict=True):
                named = {prefix if t["name"] == "DOCUMENT" else f"{prefix}_{t['name']}": t["value"].decode() if t["name"] == "DOCUMENT" else t["value"] for t in sorted(mine, key=lambda t: t["name"])}
                out.append(ebml.with_tags(content, named, prefix))
            yield pa.RecordBatch.from_arrays([pa.array(seqs), pa.array(uris), pa.array(out, pa.binary())], ["seq_id", "uri", "content"])

    return files.join(per_file, "seq_id").select("seq_id", "uri", "content", "tags").mapInArrow(rows, "seq_id string, uri string, content binary")


def read_binary(spark: SparkSession, path: str, relation: str = "frames", prefix: str = ebml.TAG_PREFIX) -> DataFrame:
    """One relation through Spark's own binaryFile source: for stores that only Spark can read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.webm").load(path)
    return decode(files.select(F.col("path").alias("uri"), "content"), relation, prefix)


def write(captures: DataFrame, path: str, **options) -> None:
    """captures: seq_id, capture (JSON of cameras, frames, ..) and, if there is one, video (array<binary>: a cluster's encoded frame each)."""
    register(captures.sparkSession)
    captures.select("seq_id", "capture", *(["video"] if "video" in captures.columns else [])).write.format("posedvideo").mode("append").options(path=path, **options).save()


def _by_id(a: Column, b: Column) -> Column:
    return F.when(a["id"] < b["id"], -1).when(a["id"] > b["id"], 1).otherwise(0)


def with_packets(captures: DataFrame, packets: DataFrame, first: int = 0, stop: int = 1 << 40) -> DataFrame:
    """captures with the encoded frames [first, stop) of a file as video; the first must be independent of those before it."""
    kept = packets.where((F.col("i") >= first) & (F.col("i") < stop))
    video = kept.groupBy("seq_id").agg(F.array_sort(F.collect_list(F.struct("i", "independent", "data"))).alias("p"))
    whole = F.when(F.col("p")[0]["independent"], F.col("p.data")).otherwise(F.raise_error(F.lit("the first kept frame depends on frames before it")).cast("array<binary>"))
    return captures.join(video.select("seq_id", whole.alias("video")), "seq_id", "left")


def capture_json(frames: DataFrame, cameras: DataFrame, signals: DataFrame | None = None, rigs: DataFrame | None = None, imu_streams: DataFrame | None = None, imu: DataFrame | None = None, streams: DataFrame | None = None, sequences: DataFrame | None = None) -> DataFrame:
    """seq_id, capture from tables as the relations have them; a capture's frames are put in order of index."""
    frame = F.struct(*[c for c in ("i", "t", "camera", "pose_valid", "q_wxyz", "tr", "params") if c in frames.columns])
    own = frames.groupBy("seq_id").agg(F.array_sort(F.collect_list(frame)).alias("frames"))
    cams = cameras.groupBy("seq_id").agg(F.map_from_entries(F.collect_list(F.struct("camera", F.struct("model", "width", "height", "params")))).alias("cameras"))
    out, parts = own.join(cams, "seq_id"), ["cameras", "frames"]
    entry = lambda df, key, value: df.groupBy("seq_id").agg(F.map_from_entries(F.collect_list(F.struct(key, value)))).toDF("seq_id", "m")
    extra: list[tuple[str, DataFrame]] = []
    if signals is not None:
        extra.append(("signals", signals.groupBy("seq_id").agg(F.array_sort(F.collect_list(F.struct("id", "role", "value_map", "width", "height")), _by_id)).toDF("seq_id", "m")))
    if streams is not None:
        listed = streams.groupBy("seq_id").agg(F.array_sort(F.collect_list(F.struct("ord", "id", "width", "height")))).toDF("seq_id", "m")
        extra.append(("rgb_streams", listed.withColumn("m", F.transform("m", lambda x: x.dropFields("ord")))))
    if rigs is not None:
        per_rig = rigs.groupBy("seq_id", "rig_id").agg(F.struct(F.map_from_entries(F.collect_list(F.struct("camera", F.struct("q_wxyz", "tr")))).alias("cameras")).alias("rig"))
        extra.append(("rigs", entry(per_rig, "rig_id", "rig")))
    if imu_streams is not None and imu is not None:
        samples = imu.groupBy("seq_id", "imu_id").agg(F.array_sort(F.collect_list(F.array("t", "gx", "gy", "gz", "ax", "ay", "az"))).alias("samples"))
        stream = imu_streams.join(samples, ["seq_id", "imu_id"], "left").withColumn("stream", F.struct("rate_hz", "description", "extrinsics", F.coalesce("samples", F.array()).alias("samples")))
        extra.append(("imu", entry(stream, "imu_id", "stream")))
    if sequences is not None:
        extra.append(("world", sequences.select("seq_id", F.col("world").alias("m"))))
    for name, df in extra:
        out = out.join(df.withColumnRenamed("m", name), "seq_id", "left")
        parts.append(name)
    return out.select("seq_id", F.to_json(F.struct(*parts)).alias("capture"))
