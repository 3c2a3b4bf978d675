"""Packed records, documents and capture files as plain data."""

from __future__ import annotations

import io
import json
from collections.abc import Callable, Iterable

import numpy as np

from plumbline.sources import ebml

#: Record layouts, little-endian.
FRAME = np.dtype([("i", "<u4"), ("camera", "<u4"), ("t", "<f8"), ("q", "<f4", 4), ("tr", "<f4", 3), ("flags", "u1")])
IMU = np.dtype([("t", "<f8"), ("gyro", "<f4", 3), ("accel", "<f4", 3)])
VERSION = "1.3"
BINARY_ABOVE = 10_000
#: The conventions that a document states.
CONVENTIONS = {"camera_axes": "RDF", "pose_direction": "camera_to_world", "quaternion_order": "wxyz", "units": "meters", "timestamp_units": "seconds"}


def pack_frames(frames: list[dict], cameras: list[str]) -> bytes:
    """Frames to records; an unposed one is stored with the identity, an unknown camera of one as the first."""
    out = np.zeros(len(frames), FRAME)
    number = {c: k for k, c in enumerate(cameras)}
    for row, f in zip(out, frames, strict=True):
        valid = f.get("pose_valid") is not False and f.get("q_wxyz") is not None
        camera = f.get("camera") or "0"
        if valid and camera not in number:
            raise ebml.FormatError(f"frame {f['i']}: unknown camera {camera}")
        row["i"], row["camera"], row["t"], row["flags"] = f["i"], number.get(camera, 0), f["t"], int(valid)
        row["q"], row["tr"] = (f["q_wxyz"], f["tr"]) if valid else ((1, 0, 0, 0), (0, 0, 0))
    return out.tobytes()


def unpack_frames(raw: bytes, cameras: list[str]) -> list[dict]:
    """Records to frames; unposed ones have no pose."""
    if len(raw) % FRAME.itemsize:
        raise ebml.FormatError(f"{len(raw)} bytes are not whole frame records")
    table = np.frombuffer(raw, FRAME)
    if len(table) and (not cameras or int(table["camera"].max()) >= len(cameras)):
        raise ebml.FormatError("a frame record names a camera that isn't there")
    valid = (table["flags"] & 1).astype(bool)
    return [
        {"i": int(r["i"]), "t": float(r["t"]), "camera": cameras[r["camera"]], "pose_valid": bool(v), "q_wxyz": [float(x) for x in r["q"]] if v else None, "tr": [float(x) for x in r["tr"]] if v else None, "params": None}
        for r, v in zip(table, valid, strict=True)
    ]


def pack_imu(samples: list[list[float]]) -> bytes:
    out = np.zeros(len(samples), IMU)
    if samples:
        a = np.asarray(samples, np.float64)
        out["t"], out["gyro"], out["accel"] = a[:, 0], a[:, 1:4], a[:, 4:7]
    return out.tobytes()


def unpack_imu(raw: bytes) -> list[list[float]]:
    if len(raw) % IMU.itemsize:
        raise ebml.FormatError(f"{len(raw)} bytes are not whole samples")
    t = np.frombuffer(raw, IMU)
    return np.column_stack([t["t"], t["gyro"].astype(float), t["accel"].astype(float)]).tolist() if len(t) else []


def json_frame(f: dict) -> dict:
    valid = f.get("pose_valid")
    valid = valid is not False
    own = lambda k: [float(x) for x in f[k]] if f.get(k) is not None else None
    return {"i": int(f["i"]), "t": float(f["t"]), "camera": str(f.get("camera") or "0"), "pose_valid": valid, "q_wxyz": own("q_wxyz") if valid else None, "tr": own("tr") if valid else None, "params": own("params")}


def resolve_frames(document: dict, tags: dict[str, str | bytes], prefix: str) -> list[dict]:
    """The frames of a file: its table, else its chunks, else the document's own."""
    declared = document.get("frames_binary")
    cameras = (declared or {}).get("cameras") or sorted(document.get("cameras") or {})
    table, chunks = tags.get(f"{prefix}_FRAMES"), tags.get(f"{prefix}_POSES")
    if isinstance(table, bytes):
        frames = unpack_frames(table, cameras)
        if declared and declared.get("count", len(frames)) != len(frames):
            raise ebml.FormatError(f"{declared['count']} frames declared, {len(frames)} found")
        return frames
    if isinstance(chunks, bytes):
        return unpack_frames(chunks, cameras)
    if declared:
        raise ebml.FormatError("a frame table is declared but missing")
    return [json_frame(f) for f in document.get("frames") or []]


def parse_file(data: bytes, prefix: str = ebml.TAG_PREFIX) -> dict:
    """document (None for plain video), frames, imu by stream, tags, clusters; data may lack its clusters."""
    tags = ebml.all_tags(data)
    raw = tags.get(prefix)
    found = {"document": None, "frames": [], "imu": {}, "tags": tags, "clusters": ebml.clusters(data)}
    if raw is None:
        return found
    if not isinstance(raw, str):
        raise ebml.FormatError("the document tag is binary")
    document = json.loads(raw)
    if not isinstance(document, dict):
        raise ebml.FormatError("the document is not an object")
    found["document"] = document
    found["frames"] = resolve_frames(document, tags, prefix)
    for stream in document.get("imu") or {}:
        samples = tags.get(f"{prefix}_IMU_{stream}")
        found["imu"][stream] = unpack_imu(samples) if isinstance(samples, bytes) else []
    return found


def build_file(capture: dict, prefix: str = ebml.TAG_PREFIX, form: str = "auto", video: list[bytes] = (), live: bool = False, chunk: int = 30) -> bytes:
    """A capture file. capture: cameras, frames, signals, world, rigs, imu {id: {samples, ..}}.

    form: how poses are stored, ``json``, ``binary`` or ``auto`` (binary above BINARY_ABOVE frames
    without own parameters). live: poses in chunks before each cluster, then one table.
    """
    frames = sorted(capture.get("frames") or [], key=lambda f: f["i"])
    cameras = sorted(capture.get("cameras") or {})
    own = any(f.get("params") for f in frames)
    if form == "auto":
        form = "binary" if len(frames) > BINARY_ABOVE and not own else "json"
    if form == "binary" and own:
        raise ValueError("frames with parameters of their own need the json form")
    if any(b["t"] < a["t"] for a, b in zip(frames, frames[1:], strict=False)):
        raise ValueError("frame times go back")
    imu = capture.get("imu") or {}
    document = {
        "format": capture.get("format", "posed-video"), "version": VERSION, "conventions": CONVENTIONS, "cameras": capture.get("cameras") or {},
        "frames": [] if live or form == "binary" else [{k: v for k, v in json_frame(f).items() if v is not None} for f in frames],
        "signals": capture.get("signals") or [], "world": capture.get("world") or {}, "rgb_streams": capture.get("rgb_streams") or [], "rigs": capture.get("rigs") or {},
        "imu": {k: {**{x: y for x, y in v.items() if x != "samples"}, "count": len(v.get("samples") or [])} for k, v in imu.items()},
    }
    tags: dict[str, str | bytes] = {}
    if form == "binary" and not live:
        document["frames_binary"] = {"version": 1, "count": len(frames), "cameras": cameras}
        tags[f"{prefix}_FRAMES"] = pack_frames(frames, cameras)
    tags = {prefix: json.dumps(document, separators=(",", ":")), **tags}
    samples = {f"{prefix}_IMU_{k}": pack_imu(v.get("samples") or []) for k, v in imu.items()}
    if not live:
        body = [encode_cluster(i, b) for i, b in enumerate(video)]
        return ebml.encode_file([encode_info(), ebml.encode_tags({**tags, **samples})], body)
    out = io.BytesIO()
    writer = LiveWriter(out.write, document, cameras, prefix, chunk)
    waiting = {k: list(v.get("samples") or []) for k, v in imu.items()}
    for n, f in enumerate(frames):
        for k, rows in waiting.items():
            while rows and (rows[0][0] <= f["t"] or n == len(frames) - 1):
                writer.add_imu(k, rows.pop(0))
        writer.add_frame(f, video[n // chunk] if n % chunk == 0 and n // chunk < len(video) else b"")
    writer.finish()
    return out.getvalue()


class LiveWriter:
    """Writes a capture while it is made: what is held is one chunk of frames, and the packed records for the table at the end.

    sink takes bytes. Poses and samples of a chunk come before its cluster, so a reader that has a
    picture has its pose; a recording that stops is whole up to its last chunk.
    """

    def __init__(self, sink: Callable[[bytes], object], document: dict, cameras: list[str], prefix: str = ebml.TAG_PREFIX, chunk: int = 30):
        self.sink, self.cameras, self.prefix, self.chunk = sink, cameras, prefix, chunk
        self.frames: list[dict] = []
        self.samples: dict[str, list] = {}
        self.payload, self.written, self.packed, self.last = b"", 0, [], None
        sink(b"".join([ebml.encode_head(), (0x18538067).to_bytes(4, "big"), b"\x01\xff\xff\xff\xff\xff\xff\xff", encode_info(), ebml.encode_tags({prefix: json.dumps(document | {"frames": []}, separators=(",", ":"))})]))

    def add_frame(self, frame: dict, payload: bytes = b"") -> None:
        if self.last is not None and frame["t"] < self.last:
            raise ValueError("frame times go back")
        self.last = frame["t"]
        self.frames.append(frame)
        self.payload += payload
        if len(self.frames) == self.chunk:
            self.flush()

    def add_imu(self, stream: str, sample: list[float]) -> None:
        self.samples.setdefault(stream, []).append(sample)

    def flush(self) -> None:
        if not self.frames:
            return
        raw = pack_frames(self.frames, self.cameras)
        tags = {f"{self.prefix}_POSES": raw} | {f"{self.prefix}_IMU_{k}": pack_imu(v) for k, v in self.samples.items() if v}
        self.sink(ebml.encode_tags(tags) + encode_cluster(self.written, self.payload))
        self.packed.append(raw)
        self.written += len(self.frames)
        self.frames, self.samples, self.payload = [], {}, b""

    def finish(self) -> int:
        """Writes what is left and the table of all frames; returns their number."""
        self.flush()
        rest = {f"{self.prefix}_IMU_{k}": pack_imu(v) for k, v in self.samples.items() if v}
        self.sink(ebml.encode_tags({f"{self.prefix}_FRAMES": b"".join(self.packed)} | rest))
        return self.written


def write_streaming(path: str, document: dict, cameras: list[str], frames: Iterable[tuple[dict, bytes]], prefix: str = ebml.TAG_PREFIX, chunk: int = 30) -> int:
    """A file from an iterator of (frame, encoded picture), one at a time; an empty one is an error."""
    with open(path, "wb") as f:
        writer = LiveWriter(f.write, document, cameras, prefix, chunk)
        for frame, payload in frames:
            writer.add_frame(frame, payload)
        if not writer.finish():
            raise ValueError("no frames")
    return writer.written


def encode_info() -> bytes:
    return ebml.encode("Info", ebml.encode("TimestampScale", ebml.encode_uint(1_000_000)))


def encode_cluster(time: int, payload: bytes) -> bytes:
    block = ebml.encode("SimpleBlock", b"\x81\x00\x00\x80" + payload)
    return ebml.encode("Cluster", ebml.encode("Timestamp", ebml.encode_uint(time)) + block)
