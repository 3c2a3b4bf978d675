"""Substring dedup by content-defined chunks.

A gear hash rolls over the bytes (32 of them matter); a chunk ends where its low bits are zero, but
not before ``MIN_CHUNK`` bytes and after ``MAX_CHUNK`` at the latest. Cuts depend on nearby content
only, so an insertion shifts no chunk but its own. Chunks are compared by 128-bit digests; the first
(smallest id, then position) of each stays. Runs of repeated chunks are removed, all or those of at
least ``min_run`` bytes.

With ``extend``, as op3 has it, chunks are only where the search starts: a run of any length grows to
both sides, byte by byte and by at most ``REACH``, for as long as its text equals that around the
first occurrence. It is then removed if it has ``min_repeat`` bytes (``MIN_REPEAT``, which 51 words
always have), or covers its whole document. Only the bytes around first occurrences are moved for that.

A first aggregate counts 64-bit keys with map-side combining; only chunks whose key is repeated are
shuffled with their digests. Joins are equi-joins that may be split, so a chunk of a third of all
documents is no bottleneck. Texts are shuffled once, to be cut.

Null and empty texts have no chunks; a text of any length is cut like others. Ids are integers. Rows
that share an id are documents of their own, in order of a hash of the text, and a null id comes
last; rows alike in id and text are one document and get equal results. An empty table gives an empty
result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from plumbline.llm.cutting import RESULT, cut_all, in_order, without_spans
from plumbline.llm.shared import arrow_limits, as_bytes, materialise, slices

CUT_BITS = 4
MIN_CHUNK, MAX_CHUNK = 16, 256
#: Least bytes of an extended run, and how far it is extended to each side.
MIN_REPEAT = 100
REACH = 320
_GEAR = np.random.Generator(np.random.PCG64(20240)).integers(0, 1 << 32, 256, dtype=np.uint32)


def gear_hash(data: np.ndarray) -> np.ndarray:
    """Rolling hash at each byte over itself and the 31 before."""
    h = _GEAR[data]
    for k in (1, 2, 4, 8, 16):
        moved = h.copy()
        moved[k:] += h[:-k] << np.uint32(k)
        h = moved
    return h


def chunk_ends(text: bytes) -> list[int]:
    n = len(text)
    if n == 0:
        return []
    # the highest of the low bits sees the most bytes; taking bits 20.. needs 20 bytes of context
    h = gear_hash(np.frombuffer(text, np.uint8)) >> np.uint32(20)
    cuts = (np.flatnonzero((h & np.uint32((1 << CUT_BITS) - 1)) == 0) + 1).tolist()
    ends, at = [], 0
    for c in [*cuts, n]:
        if c - at < MIN_CHUNK and c < n:
            continue
        while c - at > MAX_CHUNK:
            at += MAX_CHUNK
            ends.append(at)
        if c > at:
            ends.append(c)
            at = c
    return ends


def _digests(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, start, end, 128-bit digest as two columns) of all chunks."""
    which, starts, ends, digests = [], [], [], []
    for i, t in enumerate(texts):
        e = chunk_ends(t)
        s = [0, *e[:-1]] if e else []
        which.append(np.full(len(e), i))
        starts += s
        ends += e
        digests += [xxhash.xxh3_128_digest(t[a:b]) for a, b in zip(s, e, strict=True)]
    return np.concatenate(which) if which else np.zeros(0, np.int64), np.array(starts, np.int64), np.array(ends, np.int64), np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in slices(batch.column(0)):
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(_digests(as_bytes(batch.column(0)[a:b]))[3][:, 0]))], ["d0"])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for a, b in slices(batch.column(1)):
            which, start, end, digest = _digests(as_bytes(batch.column(1)[a:b]))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.ascontiguousarray(digest[:, 0]), np.ascontiguousarray(digest[:, 1]), ids[a:b][which], start, end)], ["d0", "d1", "id", "start", "end"])


def _runs(own: DataFrame) -> DataFrame:
    """doc, start, end of the runs of repeated chunks, and where the first and the last of their chunks are met first: before (id, at), after (id, at)."""
    own = own.select(F.col("doc").alias("id"), "text").where("text IS NOT NULL")
    often = materialise(own.select("text").mapInArrow(_keys, "d0 bigint").groupBy("d0").agg(F.count("*").alias("n")).where("n > 1").select("d0"), "chunk-keys")
    chunks = own.mapInArrow(_chunks, "d0 bigint, d1 bigint, id bigint, start bigint, end bigint")
    met = materialise(chunks.join(often, "d0"), "chunks")
    first = materialise(met.groupBy("d0", "d1").agg(F.min(F.struct("id", "start")).alias("first"), F.count("*").alias("n")).where("n > 1").select("d0", "d1", "first"), "chunk-firsts")
    later = met.join(first, ["d0", "d1"]).where(F.struct("id", "start") != F.col("first")).select("id", "start", "end", "first")
    # islands of adjacent chunks; a document's chunks fit a task
    order = W.partitionBy("id").orderBy("start")
    islands = later.distinct().withColumn("new", (F.coalesce(F.lag("end").over(order), F.lit(-1)) != F.col("start")).cast("int"))
    numbered = islands.withColumn("run", F.sum("new").over(order))
    met_last = F.struct(F.col("first.id").alias("id"), (F.col("first.start") + F.col("end") - F.col("start")).alias("at"))
    met_first = F.struct(F.col("first.id").alias("id"), F.col("first.start").alias("at"))
    ends = numbered.groupBy("id", "run").agg(F.min(F.struct("start", met_first.alias("met"))).alias("a"), F.max(F.struct("end", met_last.alias("met"))).alias("b"))
    return ends.select(F.col("id").alias("doc"), F.col("a.start").alias("start"), F.col("b.end").alias("end"), F.col("a.met").alias("before"), F.col("b.met").alias("after"))


def repeated_runs(own: DataFrame, min_run: int = 0) -> DataFrame:
    """doc, start, end of the runs of chunks to remove; own: rows of in_order()."""
    return _runs(own).where(F.col("end") - F.col("start") >= min_run).select("doc", "start", "end")


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes before or after each point of a text."""
    for batch in batches:
        for a, b in slices(batch.column(1)):
            ids, at, ahead, found = [], [], [], []
            for i, text, points in zip(batch.column(0)[a:b].to_pylist(), as_bytes(batch.column(1)[a:b]), batch.column(2)[a:b].to_pylist(), strict=True):
                for p in points:
                    ids.append(i)
                    at.append(p["at"])
                    ahead.append(p["ahead"])
                    found.append(text[p["at"] : p["at"] + REACH] if p["ahead"] else text[max(0, p["at"] - REACH) : p["at"]])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(at, pa.int64()), pa.array(ahead, pa.bool_()), pa.array(found, pa.binary())], ["id", "at", "ahead", "bytes"])


def _alike(a: bytes, b: bytes, order: str) -> int:
    """Bytes that a and b have in common from the start (order big) or at the end (little); as long as one another."""
    return len(a) - ((int.from_bytes(a, order) ^ int.from_bytes(b, order)).bit_length() + 7) // 8


def extended(text: bytes, runs: list[dict], min_repeat: int = MIN_REPEAT) -> list[tuple[int, int]]:
    """Spans to remove: runs (start, end, before, after: bytes around the first occurrence) that are long enough, or are all of the text, once extended."""
    spans = []
    for r in runs:
        a, b, before, after = r["start"], r["end"], r["before"] or b"", r["after"] or b""
        k = min(a, len(before))
        a -= _alike(text[a - k : a], before[len(before) - k :], "little")
        k = min(len(text) - b, len(after))
        b += _alike(text[b : b + k], after[:k], "big")
        if b - a >= min_repeat or (a == 0 and b == len(text)):
            spans.append((a, b))
    return spans


def _cut(text: Column, runs: Column, min_repeat: int) -> Column:
    @F.arrow_udf(RESULT)
    def cut(texts: pa.Array, found: pa.Array) -> pa.Array:
        own = as_bytes(texts)
        spans = [extended(t, r or [], min_repeat) for t, r in zip(own, found.to_pylist(), strict=True)]
        return cut_all(own, [[a for a, _ in s] for s in spans], [[b for _, b in s] for s in spans])

    return cut(text, runs)


def _without_extended(own: DataFrame, id_col: str, min_repeat: int) -> DataFrame:
    runs = materialise(_runs(own).withColumnRenamed("doc", "id"), "chunk-runs")
    sides = [runs.select(F.col(f"{side}.id").alias("id"), F.col(f"{side}.at").alias("at"), F.lit(side == "after").alias("ahead")) for side in ("before", "after")]
    points = sides[0].union(sides[1]).distinct().groupBy("id").agg(F.collect_list(F.struct("at", "ahead")).alias("points"))
    # a document given more than once has several
    around = own.select(F.col("doc").alias("id"), "text").where("text IS NOT NULL").join(points, "id").select("id", "text", "points").mapInArrow(_contexts, "id bigint, at bigint, ahead boolean, bytes binary")
    around = materialise(around.groupBy("id", "at", "ahead").agg(F.max("bytes").alias("bytes")), "chunk-contexts")
    for side in ("before", "after"):
        found = around.where(F.col("ahead") == (side == "after")).select(F.struct("id", "at").alias(side), F.col("bytes").alias(f"{side}_bytes"))
        runs = runs.join(found, side, "left")
    runs = materialise(runs.select("id", F.struct("start", "end", F.col("before_bytes").alias("before"), F.col("after_bytes").alias("after")).alias("run")), "chunk-extended")
    grouped = runs.groupBy(F.col("id").alias("doc")).agg(F.collect_list("run").alias("runs"))
    joined = own.join(grouped, "doc", "left")
    return joined.select(F.col("id").alias(id_col), _cut(F.col("text"), F.col("runs"), min_repeat).alias("cut")).select(id_col, "cut.*")


def chunk_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", extend: bool = False, min_run: int = 0, min_repeat: int = MIN_REPEAT) -> DataFrame:
    """id_col, n_bytes, n_removed, n_spans, kept (bytes) for every row. min_run holds for runs of whole chunks, min_repeat with extend."""
    arrow_limits(docs.sparkSession)
    own = in_order(docs, id_col, text_col)
    if extend:
        return _without_extended(own, id_col, min_repeat)
    return without_spans(own, materialise(repeated_runs(own, min_run), "chunk-runs"), id_col)
