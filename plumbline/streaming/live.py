"""Live captures: bytes arrive in chunks and become events as soon as their elements are complete.

``StreamParser`` holds only the bytes of the element that isn't complete yet. ``parse_stream`` runs
one per capture as a stateful operator: chunks carry a number, so late or repeated ones are put in
order; state is checkpointed, and a recording that stops in the middle has given every event up to
its last complete element. A frame table replaces the frames before it (``op`` is replace).
"""

from __future__ import annotations

import json
import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window as W

from plumbline.session import ship
from plumbline.sources import ebml, records

EVENTS = "seq_id string, n bigint, event string, op string, payload string"


class StreamParser:
    """feed() takes bytes in any portions and gives (event, op, payload) in file order."""

    def __init__(self, prefix: str = ebml.TAG_PREFIX):
        self.prefix, self.rest, self.open, self.skip = prefix, b"", False, 0
        self.document: dict | None = None

    def feed(self, chunk: bytes) -> list[tuple[str, str, object]]:
        self.rest += chunk
        events: list[tuple[str, str, object]] = []
        at = 0
        while at < len(self.rest):
            if self.skip:
                step = min(self.skip, len(self.rest) - at)
                self.skip -= step
                at += step
                continue
            try:
                kind, p, _ = ebml.vint(self.rest, at, keep_marker=True)
                size, p, unknown = ebml.vint(self.rest, p)
            except ebml.FormatError as e:
                if len(self.rest) - at < 12 and "length" not in str(e):
                    break
                raise
            name = ebml.IDS.get(kind)
            if name == "Segment":
                self.open, at = True, p
            elif name == "Tags" and not unknown:
                if p + size > len(self.rest):
                    break
                events += self._tags(self.rest[at : p + size])
                at = p + size
            elif name == "Cluster" and unknown:
                events.append(("cluster", "append", None))
                at = p  # its children follow one by one
            else:
                if name == "Cluster":
                    if p + size > len(self.rest):
                        break
                    events.append(("cluster", "append", size))
                self.skip, at = size, p
        self.rest = self.rest[at:]
        return events

    def _tags(self, raw: bytes) -> Iterator[tuple[str, str, object]]:
        for name, string, binary in ebml.simple_tags(raw, ebml.element_at(raw, 0, len(raw))):
            if name == self.prefix and string is not None:
                self.document = json.loads(string)
                yield "document", "replace", self.document
                if self.document.get("frames"):
                    yield "frames", "replace", [records.json_frame(f) for f in self.document["frames"]]
            elif binary is not None and name in (f"{self.prefix}_POSES", f"{self.prefix}_FRAMES"):
                own = self.document or {}
                cameras = (own.get("frames_binary") or {}).get("cameras") or sorted(own.get("cameras") or {})
                table = name.endswith("_FRAMES")
                yield "frames", "replace" if table else "append", records.unpack_frames(binary, cameras)
            elif binary is not None and name.startswith(f"{self.prefix}_IMU_"):
                yield "imu", "append", {"id": name.removeprefix(f"{self.prefix}_IMU_"), "samples": records.unpack_imu(binary)}


def fold(events: list[tuple[str, str, object]]) -> dict:
    """What a listener knows after events: document, frames, imu."""
    out: dict = {"document": None, "frames": [], "imu": {}}
    for event, op, payload in events:
        if event == "document":
            out["document"] = payload
        elif event == "frames":
            out["frames"] = list(payload) if op == "replace" else out["frames"] + list(payload)
        elif event == "imu":
            out["imu"].setdefault(payload["id"], []).extend(payload["samples"])
    return out


def _processor(prefix: str) -> StatefulProcessor:
    class Parse(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.state = handle.getValueState("parser", "raw binary")

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
            held = pickle.loads(self.state.get()[0]) if self.state.exists() else {"next": 0, "n": 0, "parser": StreamParser(prefix), "early": {}}
            for part in rows:
                for no, chunk in zip(part["chunk_no"], part["chunk"], strict=True):
                    if no >= held["next"]:
                        held["early"][int(no)] = bytes(chunk)
            out = []
            while held["next"] in held["early"]:
                for event, op, payload in held["parser"].feed(held["early"].pop(held["next"])):
                    out.append((key[0], held["n"], event, op, json.dumps(payload)))
                    held["n"] += 1
                held["next"] += 1
            self.state.update((pickle.dumps(held),))
            yield pd.DataFrame(out, columns=["seq_id", "n", "event", "op", "payload"])

        def close(self) -> None:
            pass

    return Parse()


def _in_order(prefix: str):
    def parse(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seq, parser, n, before = None, StreamParser(prefix), 0, None
        for part in parts:
            out = []
            for own, no, chunk in zip(part["seq_id"], part["chunk_no"], part["chunk"], strict=True):
                if own != seq:
                    seq, parser, n, before = own, StreamParser(prefix), 0, None
                if no == before:  # repeated
                    continue
                before = no
                for event, op, payload in parser.feed(bytes(chunk)):
                    out.append((seq, n, event, op, json.dumps(payload)))
                    n += 1
            yield pd.DataFrame(out, columns=["seq_id", "n", "event", "op", "payload"])

    return parse


def parse_stream(chunks: DataFrame, prefix: str = ebml.TAG_PREFIX) -> DataFrame:
    """chunks (seq_id string, chunk_no bigint, chunk binary), streaming or not, to EVENTS.

    A stream needs state; a table is read once, sorted by number, and only one parser is held.
    """
    ship(chunks.sparkSession)
    if not chunks.isStreaming:
        return chunks.select("seq_id", "chunk_no", "chunk").repartition("seq_id").sortWithinPartitions("seq_id", "chunk_no").mapInPandas(_in_order(prefix), EVENTS)
    return chunks.groupBy("seq_id").transformWithStateInPandas(_processor(prefix), EVENTS, "Append", "None")


def frames_of_events(events: DataFrame) -> DataFrame:
    """Current frames of each capture: those since its last replacement."""
    frame = "array<struct<i:bigint,t:double,camera:string,pose_valid:boolean,q_wxyz:array<double>,tr:array<double>,params:array<double>>>"
    own = events.where("event = 'frames'")
    last = F.max(F.when(F.col("op") == "replace", F.col("n"))).over(W.partitionBy("seq_id"))
    kept = own.withColumn("last", last).where("n >= coalesce(last, -1)")
    return kept.select("seq_id", "n", F.inline(F.from_json("payload", frame)))


def join_decoded(poses: DataFrame, pictures: DataFrame, lateness: str = "10 seconds") -> DataFrame:
    """Poses with decoded pictures by capture and index; both streams carry an arrival time ``at`` that bounds the state."""
    a = poses.withWatermark("at", lateness).alias("a")
    b = pictures.withWatermark("at", lateness).alias("b")
    on = F.expr(f"a.seq_id = b.seq_id AND a.i = b.i AND b.at BETWEEN a.at - INTERVAL {lateness} AND a.at + INTERVAL {lateness}")
    return a.join(b, on).select("a.*", *[f"b.{c}" for c in pictures.columns if c not in poses.columns])


def paced(frames: DataFrame, fps: float, source_fps: float = 30.0) -> DataFrame:
    """Frames of each capture that are far enough from the last one that was kept: a period, less a quarter of one of the source's.

    One pass over frames sorted by time; only the time of the last kept frame is held.
    """
    ship(frames.sparkSession)
    least = 1 / fps - 1 / source_fps / 4

    def keep(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: tuple = (None, 0.0)
        for part in parts:
            chosen = []
            for seq, t in zip(part["seq_id"], part["t"], strict=True):
                chosen.append(seq != last[0] or t - last[1] >= least)
                if chosen[-1]:
                    last = (seq, t)
            yield part[chosen]

    return frames.repartition("seq_id").sortWithinPartitions("seq_id", "t").mapInPandas(keep, frames.schema)


def routed(chunks: DataFrame, prefix: str = ebml.TAG_PREFIX) -> DataFrame:
    """What a live player does with chunks: EVENTS, and in their midst the clusters that go on to a decoder (payload: bytes, or null if not known yet)."""
    return parse_stream(chunks, prefix).withColumn("to", F.when(F.col("event") == "cluster", "decoder").otherwise("listener"))


def within_budget(frames: DataFrame, most: int, handling: float) -> DataFrame:
    """Frames that a writer takes which handles ``most`` at once, each for ``handling`` seconds; others are dropped when they come."""
    ship(frames.sparkSession)

    def keep(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, busy = None, []
        for part in parts:
            chosen = []
            for seq, t in zip(part["seq_id"], part["t"], strict=True):
                if seq != now:
                    now, busy = seq, []
                busy = [x for x in busy if x > t]
                chosen.append(len(busy) < most)
                if chosen[-1]:
                    busy.append(t + handling)
            yield part[chosen]

    return frames.repartition("seq_id").sortWithinPartitions("seq_id", "t").mapInPandas(keep, frames.schema)
