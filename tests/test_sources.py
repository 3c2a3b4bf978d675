"""Container bytes, records, the data source, layouts and exports."""

from __future__ import annotations

import json
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.sources import captures, ebml, exports, layouts, records
from plumbline.streaming.live import StreamParser, fold, frames_of_events, parse_stream


def capture(n=8, unposed=(1,), cams=("cam0", "cam1"), imu=20):
    frames = []
    for i in range(n):
        a = 0.11 * i
        f = {"i": i, "t": i / 30, "camera": cams[i % len(cams)], "pose_valid": i not in unposed}
        if i not in unposed:
            f |= {"q_wxyz": [math.cos(a / 2), 0.0, math.sin(a / 2), 0.0], "tr": [0.05 * i, -0.02 * i, 1.25]}
        frames.append(f)
    return {
        "cameras": {c: {"model": "PINHOLE", "width": 16, "height": 16, "params": [17.6, 17.6, 8.0, 8.0]} for c in cams},
        "frames": frames,
        "signals": [{"id": "d", "role": "depth", "value_map": {"type": "inverse_depth", "near": 0.3, "far": 9.0}}],
        "world": {"metric_scale": True},
        "rigs": {"rig0": {"cameras": {c: {"q_wxyz": [1, 0, 0, 0], "tr": [0.12 * k, 0, 0]} for k, c in enumerate(cams)}}},
        "imu": {"imu0": {"rate_hz": 200.0, "samples": [[k / 200, *[float(k + j) for j in range(6)]] for k in range(imu)]}},
    }


@pytest.mark.parametrize("form", ["json", "binary"])
def test_file_round_trip(form):
    c = capture()
    found = records.parse_file(records.build_file(c, form=form, video=[b"x" * 50] * 8))
    assert [f["i"] for f in found["frames"]] == list(range(8))
    assert found["frames"][1]["q_wxyz"] is None and not found["frames"][1]["pose_valid"]
    for a, b in zip(found["frames"], c["frames"], strict=True):
        assert a["camera"] == b["camera"] and a["t"] == b["t"]
        if a["pose_valid"]:
            assert np.allclose(a["q_wxyz"] + a["tr"], b["q_wxyz"] + b["tr"], atol=1e-6)
    assert len(found["imu"]["imu0"]) == 20 and len(found["clusters"]) == 8


def test_precedence_and_repeats():
    c = capture()
    chunks = ebml.encode_tags({"POSED_POSES": records.pack_frames(c["frames"][:3], ["cam0", "cam1"])})
    base = ebml.encode_tags({"POSED": json.dumps({"format": "x", "version": "1.0", "cameras": c["cameras"], "frames": [{"i": 9, "t": 0.0}]})})
    assert len(records.parse_file(ebml.encode_file([base], []))["frames"]) == 1
    assert len(records.parse_file(ebml.encode_file([base, chunks, chunks], []))["frames"]) == 6
    table = ebml.encode_tags({"POSED_FRAMES": records.pack_frames(c["frames"], ["cam0", "cam1"])})
    assert len(records.parse_file(ebml.encode_file([base, chunks, table], []))["frames"]) == 8
    declared = ebml.encode_tags({"POSED": json.dumps({"cameras": {}, "frames_binary": {"count": 3}})})
    with pytest.raises(ebml.FormatError, match="missing"):
        records.parse_file(ebml.encode_file([declared], []))
    assert records.parse_file(ebml.encode_file([], []))["document"] is None


def test_index_cues_and_retagging():
    data = records.build_file(capture(), video=[b"a" * 10, b"b" * 20])
    assert data[ebml.seek_head(data)["Cluster"][0] :].startswith(bytes.fromhex("1F43B675"))
    assert [data[p : p + 4].hex() for _, p in ebml.cues(data)] == ["1f43b675"] * 2
    again = ebml.with_tags(data, {"POSED": "{}"})
    assert ebml.all_tags(again) == {"POSED": "{}"} and len(ebml.clusters(again)) == 2
    assert again[ebml.seek_head(again)["Cues"][0] :].startswith(bytes.fromhex("1C53BB6B"))


@given(st.lists(st.tuples(st.integers(0, 2**32 - 1), st.floats(allow_nan=False, allow_infinity=False), st.booleans()), max_size=20))
@settings(max_examples=60, deadline=None)
def test_packed_frames(rows):
    frames = [{"i": i, "t": t, "camera": "b", "pose_valid": v, "q_wxyz": [1, 0, 0, 0] if v else None, "tr": [1, 2, 3] if v else None} for i, t, v in rows]
    raw = records.pack_frames(frames, ["a", "b"])
    assert len(raw) == 45 * len(rows)
    assert [(f["i"], f["t"], f["pose_valid"]) for f in records.unpack_frames(raw, ["a", "b"])] == rows
    with pytest.raises(ebml.FormatError):
        records.unpack_frames(raw + b"x", ["a", "b"])


def test_damaged_bytes_only_raise_value_errors():
    data, rng = records.build_file(capture(), form="binary", video=[b"v" * 30] * 3), random.Random(20260808)
    for _ in range(400):
        bad = bytearray(data[: rng.randrange(1, len(data))] if rng.random() < 0.4 else data)
        for _ in range(rng.randrange(0, 6)):
            bad[rng.randrange(len(bad))] = rng.randrange(256)
        for relation in captures.SCHEMAS:
            try:
                list(captures.relation_rows(relation, "s", "u", bytes(bad), "POSED"))
            except (ValueError, AttributeError, TypeError, KeyError):
                pass


@pytest.mark.parametrize("size", [7, 977, 65536, 10**9])
def test_live_stream_equals_whole_file(size):
    data = records.build_file(capture(95), live=True, video=[b"v" * 300] * 4)
    parser, events = StreamParser(), []
    for k in range(0, len(data), size):
        events += parser.feed(data[k : k + size])
    whole = records.parse_file(data)
    got = fold(events)
    assert got["frames"] == whole["frames"] and got["imu"] == whole["imu"] and got["document"] == whole["document"]
    assert [e[0] for e in events][:2] == ["document", "frames"]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("captures")
    (d / "a.webm").write_bytes(records.build_file(capture(), form="binary", video=[b"x"] * 8))
    (d / "b.webm").write_bytes(records.build_file(capture(40, cams=("0",)), form="json", video=[b"x"] * 5))
    (d / "plain.webm").write_bytes(ebml.encode_file([], [records.encode_cluster(0, b"x")]))
    (d / "broken.webm").write_bytes(b"\x00" * 20)
    return str(d)


def test_data_source(spark, folder):
    t = captures.read_all(spark, folder)
    assert {(r.seq_id, r.n) for r in t["frames"].groupBy("seq_id").count().toDF("seq_id", "n").collect()} == {("a", 8), ("b", 40)}
    errors = {r.seq_id: (r.document is None, r.error is not None) for r in t["documents"].collect()}
    assert errors == {"a": (False, False), "b": (False, False), "plain": (True, False), "broken": (True, True)}
    some = t["frames"].where("seq_id = 'b' AND i >= 10 AND i < 12")
    assert sorted(r.i for r in some.collect()) == [10, 11] and some.rdd.getNumPartitions() == 1
    assert t["imu"].count() == 40 and t["rigs"].count() == 3
    assert sorted(captures.read_binary(spark, folder.replace("captures", "captures") + "/a.webm").toPandas()["i"]) == list(range(8))
    with pytest.raises(Exception, match="length|segment"):
        captures.read(spark, folder, "cameras", mode="strict").collect()


def test_rules_over_files(spark, folder):
    from plumbline.operators import rules

    found = rules.validate(captures.read_all(spark, folder)).collect()
    kinds = {(r.seq_id, r.severity) for r in found}
    assert ("broken", "error") in kinds and ("plain", "note") in kinds
    assert ("b", "error") in kinds  # 40 records, 5 video frames
    assert not [r for r in found if r.seq_id == "a" and r.severity == "error"]
    assert [rules.RANK[r.severity] for r in found] == sorted(rules.RANK[r.severity] for r in found)


def test_writer_and_table_functions(spark, folder, tmp_path):
    t = captures.read_all(spark, folder)
    captures.write(captures.capture_json(t["frames"], t["cameras"]), str(tmp_path))
    again = captures.read(spark, str(tmp_path)).where("seq_id = 'a'")
    key = lambda df: sorted((r.i, r.camera, tuple(r.tr or ())) for r in df.collect())
    assert key(again) == key(t["frames"].where("seq_id = 'a'"))
    spark.read.format("binaryFile").load(f"{folder}/a.webm").createOrReplaceTempView("files")
    assert spark.sql("SELECT count(*) FROM files, LATERAL ebml_elements('a', content) WHERE name = 'Cluster'").first()[0] == 8
    raw = spark.sql("SELECT value FROM files, LATERAL simple_tags('a', content) WHERE name = 'FRAMES'")
    raw.createOrReplaceTempView("raw")
    assert spark.sql("SELECT count(*) FROM raw, LATERAL unpack_frames(value, array('cam0', 'cam1'))").first()[0] == 8


def test_exports_and_layouts(spark, folder, tmp_path):
    t = captures.read_all(spark, folder)
    b, cams = t["frames"].where("seq_id = 'b'"), t["cameras"].where("seq_id = 'b'")
    exports.tum_trajectory(b).orderBy("i").select("line").coalesce(1).write.text(str(tmp_path / "tum"))
    back = layouts.tum_truth(spark, str(tmp_path / "tum")).orderBy("pos").collect()
    want = b.where("pose_valid").orderBy("i").collect()
    assert len(back) == 39 and all(np.allclose(x.q_wxyz + x.tr, y.q_wxyz + y.tr, atol=1e-6) for x, y in zip(back, want, strict=True))
    lines = exports.colmap_images(b).orderBy("i").collect()
    (tmp_path / "images.txt").write_text("# head\n" + "".join(f"{r.line}\n\n" for r in lines))
    poses = layouts.colmap_images(spark, str(tmp_path / "images.txt")).orderBy("i").collect()
    assert all(np.allclose(np.abs(x.q_wxyz), np.abs(y.q_wxyz), atol=1e-9) and np.allclose(x.tr, y.tr, atol=1e-9) for x, y in zip(poses, want, strict=True))
    (tmp_path / "transforms.json").write_text(exports.transforms_json(b, cams).first().document)
    cameras, frames = layouts.transforms(spark, str(tmp_path / "transforms.json"))
    assert cameras.count() == 1 and cameras.first().params == [17.6, 17.6, 8.0, 8.0]
    assert all(np.allclose(np.abs(x.q_wxyz), np.abs(y.q_wxyz), atol=1e-9) for x, y in zip(frames.orderBy("i").collect(), want, strict=True))
    assert layouts.detect(str(tmp_path / "transforms.json")) == "transforms"
    log = exports.messages(b, cams, t["imu"].where("seq_id = 'b'")).collect()
    assert len(log) == 39 + 40 + 20 and all(json.loads(r.message)["header"]["stamp"]["nanosec"] < 10**9 for r in log)
    cue = exports.poses_vtt(b).orderBy("i").first()
    assert (cue.start, cue.stop) == ("00:00:00.000", "00:00:00.067")
    trimmed = exports.trim(b, 5, 20)
    assert [r.i for r in trimmed.orderBy("i").collect()] == list(range(15))
    assert exports.trim_imu(t["imu"].where("seq_id = 'b'"), exports.trim(b, 0, 2)).count() == 7


def test_euroc_layout(spark, tmp_path):
    (tmp_path / "cam0").mkdir()
    (tmp_path / "cam0/data.csv").write_text("#timestamp [ns],filename\r\n1403715273262142976,a.png\r\n1403715273312143104,b.png\r\n")
    (tmp_path / "cam0/sensor.yaml").write_text("T_BS:\n  cols: 4\n  data: [1, 0, 0, 0.5,\n   0, 1, 0, 0,\n   0, 0, 1, 0, 0, 0, 0, 1]\nresolution: [752, 480]\nintrinsics: [458.654, 457.296, 367.215, 248.375]\ndistortion_coefficients: [-0.28, 0.07, 0.0002, 1.8e-05]\n")
    rows = layouts.euroc_images(spark, str(tmp_path)).orderBy("ns").collect()
    assert [r.ns for r in rows] == [1403715273262142976, 1403715273312143104] and rows[0].name == "a.png"
    s = layouts.euroc_sensor(spark, str(tmp_path / "cam0/sensor.yaml")).first()
    assert s.t_bs[3] == 0.5 and len(s.t_bs) == 16 and s.resolution == [752.0, 480.0] and s.distortion[3] == 1.8e-05


def test_stream_query(spark, tmp_path):
    data = records.build_file(capture(70, cams=("0",)), live=True, video=[b"v" * 300] * 3)
    pieces = [data[k : k + 700] for k in range(0, len(data), 700)]
    order = list(range(len(pieces)))
    random.Random(1).shuffle(order)
    kind = "seq_id string, chunk_no bigint, chunk binary"
    spark.createDataFrame([("s", k, bytearray(pieces[k])) for k in order], kind).repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = parse_stream(stream).writeStream.format("memory").queryName("live_events").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = frames_of_events(spark.table("live_events")).orderBy("i").collect()
    assert [r.i for r in got] == list(range(70))
