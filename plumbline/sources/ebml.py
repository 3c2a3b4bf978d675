"""Matroska elements: reading with checked bounds, and writing of metadata.

The prefix of a container's own tag names is a parameter everywhere (``TAG_PREFIX`` is only the
default), so files of other writers of the format are read by giving theirs.
"""

from __future__ import annotations

import os
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

TAG_PREFIX = "POSED"

#: Element ids as stored.
IDS = {
    0x1A45DFA3: "EBML", 0x18538067: "Segment", 0x1254C367: "Tags", 0x7373: "Tag", 0x67C8: "SimpleTag", 0x45A3: "TagName", 0x4487: "TagString", 0x4485: "TagBinary",
    0x1F43B675: "Cluster", 0xE7: "Timestamp", 0xA3: "SimpleBlock", 0xA0: "BlockGroup", 0xEC: "Void", 0x1C53BB6B: "Cues", 0xBB: "CuePoint", 0xB3: "CueTime",
    0xB7: "CueTrackPositions", 0xF7: "CueTrack", 0xF1: "CueClusterPosition", 0x114D9B74: "SeekHead", 0x4DBB: "Seek", 0x53AB: "SeekID", 0x53AC: "SeekPosition",
    0x1549A966: "Info", 0x1654AE6B: "Tracks", 0x2AD7B1: "TimestampScale", 0x4489: "Duration",
    0x4286: "EBMLVersion", 0x42F7: "EBMLReadVersion", 0x42F2: "EBMLMaxIDLength", 0x42F3: "EBMLMaxSizeLength", 0x4282: "DocType", 0x4287: "DocTypeVersion", 0x4285: "DocTypeReadVersion",
}
NAMES = {v: k for k, v in IDS.items()}
MASTERS = {"Segment", "Tags", "Tag", "SimpleTag", "Cues", "CuePoint", "CueTrackPositions", "SeekHead", "Seek", "Cluster", "BlockGroup"}


class FormatError(ValueError):
    """What the bytes say can't be."""


@dataclass(frozen=True)
class Element:
    id: int
    start: int
    payload: int
    end: int
    #: Whether the size was stated (a live segment's and its last cluster's aren't).
    sized: bool = True

    @property
    def name(self) -> str:
        return IDS.get(self.id, f"0x{self.id:X}")


def vint(data: bytes, at: int, keep_marker: bool = False) -> tuple[int, int, bool]:
    """(value, position after it, whether all its bits are one)"""
    if not 0 <= at < len(data):
        raise FormatError(f"number at {at}, but there are {len(data)} bytes")
    lead = data[at]
    width = 9 - lead.bit_length()
    if width > 8:
        raise FormatError(f"number at {at} has no length")
    if at + width > len(data):
        raise FormatError(f"number at {at} is cut off")
    raw = int.from_bytes(data[at : at + width], "big")
    mask = (1 << 7 * width) - 1
    return (raw if keep_marker else raw & mask), at + width, raw & mask == mask


def element_at(data: bytes, at: int, limit: int) -> Element:
    """The element at a position of a parent that ends at limit; what overruns it ends there."""
    kind, p, _ = vint(data, at, keep_marker=True)
    size, p, unknown = vint(data, p)
    if p > limit:
        raise FormatError(f"element at {at} overruns its parent")
    return Element(kind, at, p, limit if unknown else min(p + size, limit), not unknown and p + size <= limit)


def children(data: bytes, parent: Element) -> Iterator[Element]:
    at = parent.payload
    while at < parent.end:
        e = element_at(data, at, parent.end)
        yield e
        if e.end <= at:
            raise FormatError(f"element at {at} is empty")
        at = e.end


def segment(data: bytes) -> Element:
    at = 0
    while at < len(data):
        e = element_at(data, at, len(data))
        if e.name == "Segment":
            return e
        at = e.end
    raise FormatError("no segment")


def walk(data: bytes, deep: bool = False) -> Iterator[tuple[int, Element]]:
    """(depth, element) of the segment's children, or of everything below it."""

    def below(parent: Element, depth: int) -> Iterator[tuple[int, Element]]:
        for e in children(data, parent):
            yield depth, e
            if deep and e.name in MASTERS:
                yield from below(e, depth + 1)

    yield from below(segment(data), 0)


def uint(data: bytes, e: Element) -> int:
    return int.from_bytes(data[e.payload : e.end], "big")


def simple_tags(data: bytes, tags: Element) -> Iterator[tuple[str, str | None, bytes | None]]:
    """(name, text or None, binary or None) of a Tags element; nested simple tags are ignored."""
    for tag in children(data, tags):
        if tag.name != "Tag":
            continue
        for simple in children(data, tag):
            if simple.name != "SimpleTag":
                continue
            name, string, binary = None, None, None
            for e in children(data, simple):
                body = data[e.payload : e.end]
                if e.name == "TagName":
                    name = body.decode("utf-8", "replace").rstrip("\0")
                elif e.name == "TagString":
                    string = body.decode("utf-8", "replace").rstrip("\0")
                elif e.name == "TagBinary":
                    binary = bytes(body)
            if name is not None:
                yield name, string, binary


def all_tags(data: bytes) -> dict[str, str | bytes]:
    """Every tag of the segment: binary ones joined in file order, of text ones the last."""
    out: dict[str, str | bytes] = {}
    for _, e in walk(data):
        if e.name != "Tags":
            continue
        for name, string, binary in simple_tags(data, e):
            if binary is not None:
                before = out.get(name, b"")
                out[name] = (before if isinstance(before, bytes) else b"") + binary
            elif string is not None:
                out[name] = string
    return out


def seek_head(data: bytes) -> dict[str, list[int]]:
    """Absolute positions by element name."""
    s, out = segment(data), {}
    for e in children(data, s):
        if e.name != "SeekHead":
            continue
        for seek in children(data, e):
            target, at = None, None
            for x in children(data, seek):
                if x.name == "SeekID":
                    target = IDS.get(int.from_bytes(data[x.payload : x.end], "big"))
                elif x.name == "SeekPosition":
                    at = s.payload + uint(data, x)
            if target and at is not None:
                out.setdefault(target, []).append(at)
    return out


def cues(data: bytes) -> list[tuple[int, int]]:
    """(time, absolute cluster position) of all cue points."""
    s, out = segment(data), []
    for e in children(data, s):
        for point in children(data, e) if e.name == "Cues" else ():
            when, where = None, None
            for x in children(data, point):
                if x.name == "CueTime":
                    when = uint(data, x)
                elif x.name == "CueTrackPositions":
                    where = next((s.payload + uint(data, y) for y in children(data, x) if y.name == "CueClusterPosition"), where)
            if when is not None and where is not None:
                out.append((when, where))
    return out


def clusters(data: bytes) -> list[tuple[int, int, int, bool]]:
    """(start, end, number of blocks of the first track, whether its first block is a key frame)"""
    out = []
    for _, e in walk(data):
        if e.name != "Cluster":
            continue
        blocks, key, track = 0, True, None
        for x in children(data, e):
            if x.name == "SimpleBlock":
                number, p, _ = vint(data, x.payload)
                if track is None:
                    track, key = number, bool(data[p + 2] & 0x80) if p + 2 < x.end else False
                blocks += number == track
        out.append((e.start, e.end, blocks, key))
    return out


# --- reading parts of a file ---

#: Bytes of the first read of a file.
PROBE = 8192
Fetch = Callable[[int, int], bytes]


def file_fetch(path: str) -> Fetch:
    """Reads ranges of a local file; what lies past its end is left out."""

    def fetch(at: int, n: int) -> bytes:
        with open(path, "rb") as f:
            f.seek(at)
            return f.read(max(0, min(n, os.fstat(f.fileno()).st_size - at)))  # a damaged size may be any number

    return fetch


def http_fetch(url: str, timeout: float = 30.0) -> Fetch:
    """Reads ranges of a remote file by range requests."""

    def fetch(at: int, n: int) -> bytes:
        request = urllib.request.Request(url, headers={"Range": f"bytes={at}-{at + n - 1}"})
        try:
            with urllib.request.urlopen(request, timeout=timeout) as reply:
                whole = reply.read(n if reply.status == 206 else at + n)
                return whole if reply.status == 206 else whole[at:]
        except urllib.error.HTTPError as e:
            if e.code == 416:
                return b""
            raise

    return fetch


def fetcher(uri: str) -> Fetch:
    return http_fetch(uri) if uri.startswith(("http://", "https://")) else file_fetch(uri.removeprefix("file://"))


def file_size(uri: str) -> int | None:
    """Bytes of a file; of a remote one, if its server tells."""
    if not uri.startswith(("http://", "https://")):
        return os.path.getsize(uri.removeprefix("file://"))
    with urllib.request.urlopen(urllib.request.Request(uri, method="HEAD"), timeout=30.0) as reply:
        length = reply.headers.get("Content-Length")
    return int(length) if length else None


class Ranges:
    """A file read in ranges: what has been read is kept, and how much that was is counted."""

    def __init__(self, fetch: Fetch, probe: int = PROBE):
        self.fetch, self.probe, self.held, self.base, self.fetched = fetch, probe, b"", 0, 0

    def read(self, at: int, n: int, ahead: int = 0) -> bytes:
        """n bytes from at on, fewer at the end of the file; ahead more are read with them."""
        if not (self.base <= at and at + n <= self.base + len(self.held)):
            self.held, self.base = self.fetch(at, max(n, ahead)), at
            self.fetched += len(self.held)
        return self.held[at - self.base : at - self.base + n]


@dataclass
class Skimmed:
    """What a file holds beside its pictures."""

    #: The file without its clusters: for simple_tags() and the like.
    metadata: bytes
    #: (start, payload, end) of each cluster that was passed; end -1 if it has no size.
    clusters: list[tuple[int, int, int]]
    #: Where the segment's payload begins, and the bytes before the first cluster.
    payload: int
    extent: int
    fetched: int
    cues: list[tuple[int, int]]


def skim(fetch: Fetch, header_only: bool = False) -> Skimmed:
    """Reads a file without its clusters' payloads; header_only: only up to the first cluster, and what the index names."""
    file = Ranges(fetch)
    file.read(0, PROBE)
    kept, found, at, payload, end, extent = [], [], 0, None, None, None
    while end is None or at < end:
        head = file.read(at, 12, 256)
        if not head:
            break
        try:
            kind, p, _ = vint(head, 0, keep_marker=True)
            size, p, unknown = vint(head, p)
        except FormatError:
            if len(head) < 12:
                break  # a head that the file's end cuts off
            raise
        name = IDS.get(kind)
        if name == "Segment":
            payload, at = at + p, at + p
            end = None if unknown else payload + size
        elif payload is None:
            at += p + size
        elif name == "Cluster":
            extent = at if extent is None else extent
            found.append((at, at + p, -1 if unknown else at + p + size))
            if header_only:
                break
            at += p if unknown else p + size
        elif unknown:
            raise FormatError(f"element at {at} has no size")
        else:
            if name not in ("Void", None, "SimpleBlock", "BlockGroup", "Timestamp"):
                body = file.read(at, p + size)
                if len(body) < p + size:
                    break
                kept.append(body)
            at += p + size
    if payload is None:
        raise FormatError("no segment")
    own = encode("EBML", b"") + encode("Segment", b"".join(kept))
    points = cues(own)
    if header_only:
        shift = payload - segment(own).payload
        heads = {n: [x + shift for x in where] for n, where in seek_head(own).items()}
        for name in ("Cues", "Tags"):
            for where in heads.get(name, []):
                if extent is not None and where > extent:
                    head = file.read(where, 12, 256)
                    if len(head) == 12 and IDS.get(vint(head, 0, keep_marker=True)[0]) == name:
                        size, p, _ = vint(head, vint(head, 0)[1])
                        kept.append(file.read(where, p + size))
        own = encode("EBML", b"") + encode("Segment", b"".join(kept))
        points = cues(own)
    inner = segment(own).payload
    return Skimmed(own, found, payload, at if extent is None else extent, file.fetched, [(t, where - inner + payload) for t, where in points])


def cluster_blocks(fetch: Fetch, start: int, end: int) -> Iterator[tuple[int, int, int, bool]]:
    """(track, offset of the frame's bytes, their number, whether a key frame) of a cluster's simple blocks, from heads alone."""
    file, at = Ranges(fetch), start
    while end < 0 or at < end:
        head = file.read(at, 24, 64)
        if len(head) < 2:
            return
        kind, p, _ = vint(head, 0, keep_marker=True)
        size, p, _ = vint(head, p)
        name = IDS.get(kind)
        if end < 0 and name in ("Cluster", "Tags", "Cues"):
            return
        if name == "SimpleBlock":
            track, q, _ = vint(head, p)
            yield track, at + q + 3, p + size - q - 3, bool(head[q + 2] & 0x80)
        at += p + size


# --- writing ---


def encode_size(n: int, width: int = 0) -> bytes:
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def encode(name: str, payload: bytes) -> bytes:
    kind = NAMES[name]
    return kind.to_bytes((kind.bit_length() + 7) // 8, "big") + encode_size(len(payload)) + payload


def encode_uint(n: int, width: int = 0) -> bytes:
    return n.to_bytes(width or max(1, (n.bit_length() + 7) // 8), "big")


def encode_tags(tags: dict[str, str | bytes]) -> bytes:
    body = b""
    for name, value in tags.items():
        kind, raw = ("TagString", value.encode()) if isinstance(value, str) else ("TagBinary", value)
        body += encode("Tag", encode("SimpleTag", encode("TagName", name.encode()) + encode(kind, raw)))
    return encode("Tags", body)


def encode_head() -> bytes:
    """What a file begins with."""
    fields = (("EBMLVersion", 1), ("EBMLReadVersion", 1), ("EBMLMaxIDLength", 4), ("EBMLMaxSizeLength", 8), ("DocTypeVersion", 4), ("DocTypeReadVersion", 2))
    return encode("EBML", b"".join(encode(n, encode_uint(v)) for n, v in fields) + encode("DocType", b"webm"))


def cluster_time(cluster: bytes) -> int:
    """Time stamp of an encoded cluster; 0 if it has none."""
    return next((uint(cluster, e) for e in children(cluster, element_at(cluster, 0, len(cluster))) if e.name == "Timestamp"), 0)


def encode_file(header: list[bytes], clusters_: list[bytes], tail: list[bytes] = (), seekable: bool = True, head: bytes | None = None) -> bytes:
    """A file: its head, an index of where header elements, the first cluster and the cues are, then these."""
    head = encode_head() if head is None else head

    def cue_list(at: int) -> bytes:
        points, body = [], at
        for c in clusters_:
            points.append(encode("CuePoint", encode("CueTime", encode_uint(cluster_time(c))) + encode("CueTrackPositions", encode("CueTrack", b"\1") + encode("CueClusterPosition", encode_uint(body, 8)))))
            body += len(c)
        return encode("Cues", b"".join(points))

    def seeks(offset: int) -> bytes:
        out, at = b"", offset
        parts = [*header, *clusters_[:1]]
        for part in parts:
            out += encode("Seek", encode("SeekID", part[: 9 - part[0].bit_length()]) + encode("SeekPosition", encode_uint(at, 8)))
            at += len(part)
        end = offset + sum(map(len, header)) + sum(map(len, clusters_)) + sum(map(len, tail))
        return encode("SeekHead", out + encode("Seek", encode("SeekID", encode_uint(NAMES["Cues"])) + encode("SeekPosition", encode_uint(end, 8))))

    index = seeks(0)
    index = seeks(len(index)) if seekable else b""
    first = len(index) + sum(map(len, header))
    body = b"".join([index, *header, *clusters_, *tail, cue_list(first)])
    return head + encode("Segment", body)


def with_tags(data: bytes, tags: dict[str, str | bytes], prefix: str = TAG_PREFIX) -> bytes:
    """The file with its own tags replaced: before the first cluster, foreign tags kept, padding dropped, index and cues rebuilt; what stands before the segment stays as it is."""
    header, body, tail = [], [], []
    before = data[: segment(data).start]
    for _, e in walk(data):
        raw = data[e.start : e.end]
        if e.name in ("SeekHead", "Void", "Cues"):
            continue
        if e.name == "Cluster":
            body.append(encode("Cluster", data[e.payload : e.end]))
        elif e.name == "Tags":
            foreign = {n: (b if b is not None else s) for n, s, b in simple_tags(data, e) if not (n == prefix or n.startswith(f"{prefix}_"))}
            if foreign:
                (tail if body else header).append(encode_tags(foreign))
        else:
            (tail if body else header).append(raw)
    return encode_file([*header, encode_tags(tags)], body, tail, head=before)
