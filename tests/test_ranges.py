"""Reading parts of files: headers, clusters, packets, by path and by http."""

from __future__ import annotations

import json
import random
import struct
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import numpy as np
import pytest
from test_sources import capture

from plumbline.__main__ import main, members_of
from plumbline.operators import corpus, rules
from plumbline.sources import captures, convert, ebml, layouts, records
from plumbline.streaming import live


def whole(n=8, size=50_000, **kinds):
    return records.build_file(capture(n), video=[bytes([k]) * size for k in range(n)], **kinds)


def fetch_of(data):
    return lambda at, n: data[at : at + n]


@pytest.mark.parametrize("form", ["json", "binary"])
def test_header_costs_a_header(form):
    data = whole(form=form)
    first = ebml.clusters(data)[0][0]
    found = ebml.skim(fetch_of(data), header_only=True)
    assert found.extent == first and found.fetched <= max(first, ebml.PROBE) + 1024 < len(data) / 20
    assert records.parse_file(found.metadata)["frames"] == records.parse_file(data)["frames"]
    assert found.cues == ebml.cues(data) and len(found.cues) == 8
    every = ebml.skim(fetch_of(data))
    assert [(a, c) for a, _, c in every.clusters] == [(a, b) for a, b, _, _ in ebml.clusters(data)] and every.fetched < len(data) / 10


def test_live_files_are_skimmed_too():
    data = records.build_file(capture(70), live=True, video=[b"v" * 3000] * 3)
    found = ebml.skim(fetch_of(data))
    assert records.parse_file(found.metadata)["frames"] == records.parse_file(data)["frames"]
    assert len(found.clusters) == 3 and found.fetched < len(data)
    for cut in range(len(data) - 400, len(data), 7):  # a recording that stopped
        ebml.skim(fetch_of(data[:cut]))


def test_damaged_files_only_raise_value_errors(tmp_path):
    data, rng = whole(6, 40, form="binary"), random.Random(8)
    for n in range(400):
        bad = bytearray(data[: rng.randrange(1, len(data))] if rng.random() < 0.4 else data)
        for _ in range(rng.randrange(0, 6)):
            bad[rng.randrange(len(bad))] = rng.randrange(256)
        path = tmp_path / f"{n % 3}.webm"
        path.write_bytes(bad)
        for relation in captures.SCHEMAS:
            try:
                list(captures.file_rows(relation, str(path), "POSED", header_only=n % 2 == 0))
            except (ValueError, AttributeError, TypeError, KeyError, IndexError):
                pass


def test_live_writer(tmp_path):
    c = capture(70)
    document = {"format": "posed-video", "version": "1.3", "cameras": c["cameras"], "imu": {"imu0": {"count": 20}}}
    out = []
    writer = records.LiveWriter(out.append, document, sorted(c["cameras"]))
    for k, f in enumerate(c["frames"]):
        if k < 20:
            writer.add_imu("imu0", c["imu"]["imu0"]["samples"][k])
        writer.add_frame(f, b"v")
    stopped = b"".join(out)  # ten frames aren't written yet
    assert [f["i"] for f in records.parse_file(stopped)["frames"]] == list(range(60))
    assert writer.finish() == 70
    found = records.parse_file(b"".join(out))
    assert [f["i"] for f in found["frames"]] == list(range(70)) and len(found["imu"]["imu0"]) == 20
    assert records.write_streaming(str(tmp_path / "x.webm"), document, sorted(c["cameras"]), ((f, b"") for f in c["frames"])) == 70
    with pytest.raises(ValueError, match="no frames"):
        records.write_streaming(str(tmp_path / "y.webm"), document, [], iter([]))
    with pytest.raises(ValueError, match="back"):
        writer.add_frame({"i": 0, "t": -1.0})


def test_packets_touch_their_clusters_only():
    data, read = whole(), []

    def fetch(at, n):
        read.append((at, n))
        return data[at : at + n]

    rows = list(captures.file_rows("packets", "s.webm", "POSED", low=2, high=3, fetch=fetch, size=len(data)))
    assert [(r[1], r[2], r[3], r[4]) for r in rows] == [(k, k, True, bytes([k]) * 50_000) for k in (2, 3)]
    assert sum(n for _, n in read if n > 10_000) == 100_000


def test_retagging_keeps_head_and_times():
    video = [records.encode_cluster(t, b"x" * 9) for t in (0, 33, 70)]
    head = ebml.encode("EBML", ebml.encode("DocType", b"webm") + ebml.encode("Void", b"1234"))
    data = ebml.encode_file([records.encode_info(), ebml.encode_tags({"TITLE": "kept", "POSED_OLD": b"1"})], video, head=head)
    again = ebml.with_tags(data, {"POSED": "{}"})
    assert again.startswith(head) and [t for t, _ in ebml.cues(again)] == [0, 33, 70]
    assert ebml.all_tags(again) == {"TITLE": "kept", "POSED": "{}"}
    assert all(again[p : p + 4] == bytes.fromhex("1F43B675") for _, p in ebml.cues(again))


def test_golden_bytes():
    """Packed records, byte for byte."""
    frame = {"i": 7, "t": 0.5, "camera": "b", "pose_valid": True, "q_wxyz": [1, 0, 0, 0], "tr": [1, 2, 3]}
    assert records.pack_frames([frame], ["a", "b"]) == struct.pack("<IId7fB", 7, 1, 0.5, 1, 0, 0, 0, 1, 2, 3, 1)
    assert records.pack_imu([[0.25, 1, 2, 3, 4, 5, 6]]) == struct.pack("<d6f", 0.25, 1, 2, 3, 4, 5, 6)
    assert ebml.encode("Tags", b"") == bytes.fromhex("1254C36780") and ebml.encode_size(500) == b"\x41\xf4"


@pytest.fixture(scope="module")
def server(tmp_path_factory):
    data = whole()

    class Handler(BaseHTTPRequestHandler):
        def do_HEAD(self):  # noqa: N802
            self.send_response(200)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()

        def do_GET(self):  # noqa: N802
            a, b = self.headers["Range"].removeprefix("bytes=").split("-")
            part = data[int(a) : int(b) + 1]
            self.send_response(206 if part else 416)
            self.send_header("Content-Length", str(len(part)))
            self.end_headers()
            self.wfile.write(part)

        def log_message(self, *a):
            pass

    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}/far.webm"
    s.shutdown()


def test_remote_captures(spark, server):
    assert captures.read(spark, server, "frames", mode="header").where("pose_valid").count() == 7
    h = captures.read(spark, server, "headers", mode="header").first()
    assert h.bytes > 400_000 and h.fetched < 20_000
    assert [bytes(r.data)[:1] for r in captures.read(spark, server, "packets").where("i = 5").collect()] == [b"\x05"]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("some")
    (d / "a.webm").write_bytes(whole(form="binary"))
    (d / "b.webm").write_bytes(whole(5))
    (d / "bad.webm").write_bytes(b"\x00" * 30)
    return d


def test_manifest_trim_and_verify(spark, folder, tmp_path, capsys):
    rows, bad = members_of(spark, [f"{folder}/a.webm", str(folder)], relative_to=str(folder))
    assert sorted(r.uri for r in rows.collect()) == ["a.webm", "a.webm", "b.webm"] and bad.count() == 1
    assert main(["index", str(folder), str(tmp_path / "m"), "--checksum"]) == 1
    assert main(["collection", str(tmp_path / "m"), "--verify", "--checksum", "--root", str(folder)]) == 0
    assert main(["trim", f"{folder}/b.webm", str(tmp_path / "cut"), "--frames", "1:4"]) == 0
    t = captures.read_all(spark, str(tmp_path / "cut"))
    assert [r.i for r in t["frames"].orderBy("i").collect()] == [0, 1, 2] and t["rigs"].count() == 2 and t["signals"].count() == 1
    assert 0 < t["imu"].count() < 20 and "1 to 3" in t["documents"].first().world.description
    assert [bytes(r.data)[0] for r in captures.read(spark, str(tmp_path / "cut"), "packets").orderBy("i").collect()] == [1, 2, 3]
    assert not [r for r in rules.validate(t).collect() if r.severity == rules.ERROR]


def test_iteration(spark, folder):
    t = captures.read_all(spark, str(folder))
    members = corpus.describe(t["frames"]).selectExpr("*", "CASE seq_id WHEN 'a' THEN 0 ELSE 1 END AS mi")
    every = corpus.iter_frames(t["frames"], members)
    assert [(r.member, r.pos) for r in every.collect()] == [(0, k) for k in range(8)] + [(1, k) for k in range(5)]
    planes = spark.createDataFrame([("a", k, "d", 2, 1, bytearray(4)) for k in range(8)] + [("a", 0, "x", 2, 1, bytearray(4))], "seq_id string, i bigint, signal_id string, w int, h int, codes binary")
    signals = spark.createDataFrame([("a", "d", "depth"), ("a", "x", "custom"), ("b", "d", "depth")], "seq_id string, id string, role string")
    some = corpus.iter_frames(t["frames"], members, ["depth"], signals, planes, posed_only=True).collect()
    assert len(some) == 11 and all((r.planes is not None and set(r.planes) == {"depth"}) == (r.seq_id == "a") for r in some)
    assert all(np.allclose(np.array(r.c2w).reshape(4, 4)[:3, 3], r.tr) for r in some)
    mixed = [(r.member, r.pos) for r in corpus.shuffle_buffer(every.coalesce(1), 4, 3).collect()]
    assert sorted(mixed) == sorted((r.member, r.pos) for r in every.collect()) and mixed != sorted(mixed)
    assert corpus.frame_at(t["frames"].withColumnRenamed("seq_id", "uri"), members.withColumnRenamed("seq_id", "uri"), -1).first().i == 4
    with pytest.raises(IndexError):
        corpus.frame_at(t["frames"], members, 13, "seq_id")
    assert {r.seq_id: r.id for r in corpus.signal_by_role(signals, "depth").collect()} == {"a": "d", "b": "d"}
    with pytest.raises(Exception, match="HDR"):
        from plumbline.sources import exports

        exports.refuse_hdr(spark.createDataFrame([("a", "0", True)], "seq_id string, id string, hdr boolean")).collect()


def test_binary_lists(spark, tmp_path):
    cameras = struct.pack("<Q", 2) + struct.pack("<iiQQ4d", 1, 1, 640, 480, 1, 2, 3, 4) + struct.pack("<iiQQ3d", 2, 0, 64, 48, 5, 6, 7)
    images = struct.pack("<Q", 2) + struct.pack("<i7di", 9, 1, 0, 0, 0, 1, 2, 3, 2) + b"z.png\0" + struct.pack("<Q", 1) + bytes(24) + struct.pack("<i7di", 4, 1, 0, 0, 0, 0, 0, 1, 1) + b"a.png\0" + struct.pack("<Q", 0)
    (tmp_path / "cameras.bin").write_bytes(cameras)
    (tmp_path / "images.bin").write_bytes(images)
    found = convert.any_layout(spark, str(tmp_path))
    assert [(r.camera, r.model, r.params) for r in found["cameras"].collect()] == [("1", "PINHOLE", [1, 2, 3, 4]), ("2", "SIMPLE_PINHOLE", [5, 6, 7])]
    rows = found["frames"].orderBy("i").collect()
    assert [(r.name, r.camera, r.tr) for r in rows] == [("a.png", "1", [0, 0, -1]), ("z.png", "2", [-1, -2, -3])]
    with pytest.raises(ValueError, match="model"):
        list(layouts.binary_cameras(struct.pack("<QiiQQ", 1, 1, 99, 1, 1)))


def test_whole_recordings(spark, tmp_path):
    tum = tmp_path / "rgbd_freiburg1_x"
    tum.mkdir()
    (tum / "rgb.txt").write_text("# list\n0.00 rgb/0.png\n0.10 rgb/1.png\n0.20 rgb/2.png\n")
    (tum / "depth.txt").write_text("0.005 depth/0.png\n0.195 depth/2.png\n")
    (tum / "groundtruth.txt").write_text("0.01 1 2 3 0 0 0 1\n0.30 4 5 6 0 0 0 1\n")
    found = convert.any_layout(spark, str(tum))
    rows = found["frames"].orderBy("i").collect()
    assert [(r.i, r.t, r.name, r.depth_name, r.pose_valid, r.tr) for r in rows] == [(0, 0.0, "rgb/0.png", "depth/0.png", True, [1, 2, 3]), (1, 0.2, "rgb/2.png", "depth/2.png", False, None)]
    assert found["cameras"].first().params[0] == 517.3
    stray = tmp_path / "stray"
    (stray / "depth").mkdir(parents=True)
    for k in range(4):
        (stray / f"depth/{k}.png").write_bytes(b"")
    (stray / "camera_matrix.csv").write_text("100,0,32\n0,110,24\n0,0,1\n")
    (stray / "odometry.csv").write_text("timestamp, frame, x, y, z, qx, qy, qz, qw\n5.0, 1, 1, 2, 3, 0, 0, 0, 1\n6.0, 2, 1, 2, 4, 0, 0, 0, 1\n")
    rows = convert.any_layout(spark, str(stray))["frames"].orderBy("i").collect()
    assert [(r.i, r.t, r.pose_valid) for r in rows] == [(0, 0.0, False), (1, 5.0, True), (2, 6.0, True)]
    assert np.allclose(np.abs(rows[1].q_wxyz), [0, 1, 0, 0])  # axes flipped
    base = tmp_path / "mav"
    for cam, shift in (("cam0", 0.0), ("cam1", 0.11)):
        (base / cam).mkdir(parents=True)
        stamps = (1_000_000_000, 1_050_000_000, 1_100_000_000, 3_000_000_000)
        (base / cam / "data.csv").write_text("#t,name\n" + "".join(f"{s},{s}.png\n" for s in stamps[: 4 if cam == "cam0" else 3]))
        (base / cam / "sensor.yaml").write_text(f"T_BS:\n  data: [1, 0, 0, {shift}, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1]\nresolution: [752, 480]\nintrinsics: [458.0, 457.0, 367.0, 248.0]\ndistortion_coefficients: [0.1, 0.2, 0.3, 0.4]\n")
    (base / "state_groundtruth_estimate0").mkdir()
    (base / "state_groundtruth_estimate0/data.csv").write_text("#t\n" + "".join(f"{1_000_000_000 + 10_000_000 * k},{k},0,0,1,0,0,0\n" for k in range(12)))
    (base / "imu0").mkdir()
    (base / "imu0/data.csv").write_text("#t\n" + "".join(f"{1_000_000_000 + 5_000_000 * k},1,2,3,4,5,6\n" for k in range(5)))
    (base / "imu0/sensor.yaml").write_text("T_BS:\n  data: [1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0.5, 0, 0, 0, 1]\n")
    found = convert.any_layout(spark, str(base))
    rows = found["frames"].orderBy("i").collect()
    assert [(r.i, r.pose_valid) for r in rows] == [(0, True), (1, True), (2, True)] and np.allclose([r.tr[0] for r in rows], [0, 5, 10])
    assert found["dropped"].first().dropped == 1 and {r.camera: r.tr[0] for r in found["rigs"].collect()} == {"0": 0.0, "1": 0.11}
    stream = found["imu_streams"].first()
    assert stream.rate_hz == 200.0 and stream.extrinsics.tr[2] == 0.5
    captures.write(captures.capture_json(found["frames"], found["cameras"], rigs=found["rigs"], imu_streams=found["imu_streams"], imu=found["imu"], sequences=found["sequences"]), str(tmp_path / "out"))
    assert not [r for r in rules.validate(captures.read_all(spark, str(tmp_path / "out"))).collect() if r.severity == rules.ERROR and "end of the video" not in r.message]


def test_streams_of_live_players(spark):
    data = records.build_file(capture(70, cams=("0",)), live=True, video=[b"v" * 300] * 3)
    chunks = spark.createDataFrame([("s", k, bytearray(data[at : at + 700])) for k, at in enumerate(range(0, len(data), 700))], "seq_id string, chunk_no bigint, chunk binary")
    to = [(r.event, r.to) for r in live.routed(chunks).orderBy("n").collect()]
    assert ("cluster", "decoder") in to and all((e == "cluster") == (x == "decoder") for e, x in to)
    assert live.fold([(r.event, r.op, json.loads(r.payload)) for r in live.parse_stream(chunks).orderBy("n").collect()])["frames"] == json.loads(json.dumps(records.parse_file(data)["frames"]))
    frames = spark.createDataFrame([("s", k, k / 60) for k in range(60)], "seq_id string, i bigint, t double")
    assert [r.i for r in live.paced(frames, 15).orderBy("i").collect()] == list(range(0, 60, 4))
    assert [r.i for r in live.within_budget(frames, 2, 0.09).orderBy("i").collect()][:6] == [0, 1, 6, 7, 12, 13]


def test_joined_streams(spark, tmp_path):
    kind = "seq_id string, i bigint, at timestamp"
    rows = [("s", k, __import__("datetime").datetime(2024, 1, 1, 0, 0, k)) for k in range(8)]
    for name, some in (("a", rows), ("b", rows[3:6])):
        spark.createDataFrame(some, kind).withColumnRenamed("i", "i").write.parquet(str(tmp_path / name))
    a, b = (spark.readStream.schema(kind).parquet(str(tmp_path / n)) for n in "ab")
    q = live.join_decoded(a, b.withColumn("picture", b.i * 10)).writeStream.format("memory").queryName("joined").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.i, r.picture) for r in spark.table("joined").collect()) == [(3, 30), (4, 40), (5, 50)]
