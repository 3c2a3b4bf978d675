"""Exact removal of repeated 100-byte strings with a distributed, common-prefix-aware merge sort.

Every string of ``WIDTH`` bytes has one anchor: the least hash among its ``GRAM``-byte grams, a
function of the string alone. Neighbouring strings with the same anchor form a block. Equal strings
have equal anchor grams, so strings whose anchor gram occurs once in the corpus are unique; blocks
with a repeated gram are the candidates (counted over all texts, combined before the shuffle).

1. Candidate blocks with equal content are combined before the sort, as equal keys are before a
   shuffle: all but the first are repeats in full.
2. First occurrences whose gram has several contents go through the sort. Each task sorts the
   suffixes that start at its blocks' anchors, front-codes the run (length of the prefix shared with
   the one before, then the rest) and cuts it by range; runs of a range are merged by a loser tree
   whose entries know the prefix they share with the last winner, so known prefixes are never
   compared again. The merged order gives the longest common prefix of neighbours, and so which
   strings around an anchor can be repeated at all; left contexts decide among these.
3. A range can't cut through a gram, so grams with more than ``max_contexts`` contents (a line that
   very many documents share) are taken out of it: each of their strings is a suffix of its own. They
   go through the same runs and trees, in ranges that cut anywhere; of strings that a run has twice
   only the first is kept.

Ranges are drawn from a sample of the suffixes themselves, and as many as keep a range near
``RANGE_SUFFIXES``. Equal block contents are told by 64-bit digest within a 64-bit gram hash. Joins
are equi-joins of written tables that may be split. Texts are shuffled twice: for the blocks to sort,
and to be cut.

Null and empty texts have no strings; texts of any length are read in overlapping pieces. Ids are
integers. Rows that share an id are documents of their own, in order of a hash of the text, and a
null id comes last; rows alike in id and text are one document and get equal results. An empty table
gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.cutting import in_order, without_spans
from plumbline.llm.shared import arrow_limits, as_bytes, materialise, slices

WIDTH = 100
GRAM = 24
MAX_CONTEXTS = 2048
#: Suffixes that a task sorts at once, and strings of crowded grams.
RUN_SUFFIXES = 1 << 16
RUN_STRINGS = 1 << 18
#: Suffixes of a range, about, and how many are drawn for each range's limits; only balance depends on these.
RANGE_SUFFIXES = 1 << 17
DRAWN = 16
#: Bytes of a text that are worked on at once.
PIECE_BYTES = 64 << 20
_POSITION = np.uint64(28)
_MULTIPLIERS = [np.uint64(pow(0x9E3779B97F4A7C15, k, 1 << 64)) for k in (1, 2, 4, 8)]


def blocks(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, number of strings, anchor position, gram hash) of each block of texts laid end to end."""
    none = np.zeros(0, np.int64)
    if len(data) < WIDTH:
        return none, none, none, none.astype(np.uint64)
    h = data.astype(np.uint64) + np.uint64(1)
    for k, m in zip((1, 2, 4), _MULTIPLIERS, strict=False):
        h = h[:-k] * m + h[k:]
    eight = h
    h = eight[:-8] * _MULTIPLIERS[3] + eight[8:]
    gram = h[: len(h) - 8] * _MULTIPLIERS[3] + eight[16 : 8 + len(h)]
    gram = (gram ^ (gram >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    gram ^= gram >> np.uint64(29)
    least = (gram >> _POSITION << _POSITION) | np.arange(len(gram), dtype=np.uint64)
    span, held = WIDTH - GRAM + 1, 1
    while held < span:
        step = min(held, span - held)
        least = np.minimum(least[:-step], least[step:])
        held += step
    anchor = (least & np.uint64((1 << int(_POSITION)) - 1)).astype(np.int64)
    text = np.repeat(np.arange(len(ends)), np.diff(np.r_[0, ends]))
    inside = np.flatnonzero(text[: len(anchor)] == text[WIDTH - 1 :])
    if not len(inside):
        return none, none, none, none.astype(np.uint64)
    own = anchor[inside]
    new = np.r_[True, (own[1:] != own[:-1]) | (np.diff(inside) != 1)]
    first = np.flatnonzero(new)
    return inside[first], np.diff(np.r_[first, len(inside)]), own[first], gram[own[first]]


def _sliced(texts: pa.Array) -> Iterator[tuple[int, int, bytes, np.ndarray, int]]:
    """(first text, end, their bytes, where each ends, offset of the bytes); a very long text comes alone, in pieces that share WIDTH - 1 bytes."""
    for a, b in slices(texts):
        own = as_bytes(texts[a:b])
        if b == a + 1:
            for at in range(0, max(1, len(own[0]) - WIDTH + 1), PIECE_BYTES):
                piece = own[0][at : at + PIECE_BYTES + WIDTH - 1]
                yield a, b, piece, np.array([len(piece)]), at
        else:
            yield a, b, b"".join(own), np.cumsum([len(t) for t in own]), 0


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, data, ends, _ in _sliced(batch.column(0)):
            h, n = np.unique(blocks(np.frombuffer(data, np.uint8), ends)[3], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["gram", "n"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """gram, content digest, doc, and start, number of strings and anchor offset packed as one number."""
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for a, b, data, ends, offset in _sliced(batch.column(1)):
            start, count, anchor, gram = blocks(np.frombuffer(data, np.uint8), ends)
            content = np.fromiter((xxhash.xxh3_64_intdigest(data[x : x + n + WIDTH - 1]) for x, n in zip(start.tolist(), count.tolist(), strict=True)), np.uint64, len(start))
            text = np.searchsorted(ends, start, side="right")
            at = start - np.r_[0, ends][text] + offset
            packed = (at << 14) | (count << 7) | (anchor - start)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (gram.view(np.int64), content.view(np.int64), ids[a:b][text], packed)], ["gram", "content", "doc", "at"])


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the longest common prefix, of which ``known`` bytes are known."""
    low, high = known, min(len(a), len(b))
    if a[low:high] == b[low:high]:
        return high
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


def front_code(entries: list[tuple]) -> bytes:
    """A sorted run of (suffix, left context, strings, id, start) as one binary."""
    shared, before = [], b""
    for e in entries:
        shared.append(common_prefix(before, e[0]))
        before = e[0]
    tails = [e[0][k:] for e, k in zip(entries, shared, strict=True)]
    head = np.array([len(entries)], np.int64).tobytes()
    small = np.array([shared, [len(t) for t in tails], [len(e[1]) for e in entries], [e[2] for e in entries]], np.uint8).tobytes()
    return b"".join([head, small, np.array([[e[3] for e in entries], [e[4] for e in entries]], np.int64).tobytes(), *tails, *[e[1] for e in entries]])


def decoded(run: bytes) -> Iterator[tuple[bytes, int, tuple]]:
    """(suffix, prefix shared with the one before, (left context, strings, id, start)) in order."""
    n = int(np.frombuffer(run, np.int64, 1)[0])
    shared, tail, left, strings = np.frombuffer(run, np.uint8, 4 * n, 8).reshape(4, n).tolist()
    ids, starts = np.frombuffer(run[8 + 4 * n : 8 + 20 * n], np.int64).reshape(2, n).tolist()
    at, suffix = 8 + 20 * n, b""
    other = at + sum(tail)
    for i in range(n):
        suffix = suffix[: shared[i]] + run[at : at + tail[i]]
        yield suffix, shared[i], (run[other : other + left[i]], strings[i], ids[i], starts[i])
        at += tail[i]
        other += left[i]


class LoserTree:
    """Merges front-coded runs. Each waiting entry knows the prefix it shares with the entry that beat it."""

    def __init__(self, runs: list[bytes]):
        self.runs = [decoded(r) for r in runs]
        k = self.k = max(1, len(runs))
        self.now: list = [None] * k
        self.shared = [0] * k
        self.loser = [0] * k
        for i, r in enumerate(self.runs):
            self.now[i] = next(r, None)
        winner = [0] * (2 * k)
        winner[k:] = range(k)
        for node in range(k - 1, 0, -1):
            winner[node], self.loser[node] = self._play(winner[2 * node], winner[2 * node + 1])
        self.top = winner[1] if k > 1 else 0

    def _play(self, a: int, b: int) -> tuple[int, int]:
        """(winner, loser)"""
        x, y = self.now[a], self.now[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        p, q = self.shared[a], self.shared[b]
        if p != q:
            return (a, b) if p > q else (b, a)
        s, t = x[0], y[0]
        p = common_prefix(s, t, p)
        if s[p:] <= t[p:]:
            self.shared[b] = p
            return a, b
        self.shared[a] = p
        return b, a

    def __iter__(self) -> Iterator[tuple[bytes, int, tuple]]:
        """(suffix, prefix shared with the one before, the rest) in order."""
        while self.runs and (entry := self.now[self.top]) is not None:
            own = self.top
            yield entry[0], self.shared[own], entry[2]
            self.now[own] = after = next(self.runs[own], None)
            self.shared[own] = after[1] if after else 0
            node = (own + self.k) // 2
            while node:
                own, self.loser[node] = self._play(own, self.loser[node])
                node //= 2
            self.top = own


def repeats_in_group(group: list[tuple[bytes, tuple]], shared: list[int]) -> Iterator[tuple[int, int]]:
    """(id, start) of strings that occur earlier; suffixes of one gram, in order, with the prefix each shares with the one before."""
    found: dict[bytes, tuple[int, int]] = {}
    seen: list[tuple[bytes, tuple[int, int]]] = []
    for i, (suffix, (left, strings, who, start)) in enumerate(group):
        longest = max(shared[i] if i else 0, shared[i + 1] if i + 1 < len(group) else 0)
        whole = left + suffix
        for j in range(min(strings, len(left) - WIDTH + longest + 1)):
            key, at = whole[j : j + WIDTH], (who, start + j)
            seen.append((key, at))
            if (known := found.get(key)) is None or at < known:
                found[key] = at
    for key, at in seen:
        if found[key] != at:
            yield at


def _spans(repeats: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(id, start, end) of the bytes that strings at these places cover."""
    out: list[list[int]] = []
    for who, at in sorted(repeats):
        if out and out[-1][0] == who and at <= out[-1][2]:
            out[-1][2] = at + WIDTH
        else:
            out.append([who, at, at + WIDTH])
    return [tuple(x) for x in out]


def merge_runs(runs: list[bytes]) -> list[tuple[int, int, int]]:
    """(id, start, end) of repeats among the strings of all runs of a range."""
    out: list[tuple[int, int, int]] = []
    group: list[tuple[bytes, tuple]] = []
    shared: list[int] = []
    for suffix, common, rest in LoserTree(runs):
        if common < GRAM and group:
            if len(group) > 1:
                out += _spans(list(repeats_in_group(group, shared)))
            group, shared = [], []
        group.append((suffix, rest))
        shared.append(common)
    if len(group) > 1:
        out += _spans(list(repeats_in_group(group, shared)))
    return out


def merge_strings(runs: list[bytes]) -> list[tuple[int, int, int]]:
    """(doc, start, end) of all but the first of equal strings, among runs of whole strings."""
    repeats: list[tuple[int, int]] = []
    first: tuple[int, int] | None = None
    for _, common, (_, _, who, start) in LoserTree(runs):
        at = (who, start)
        if common < WIDTH:
            first = at
        else:
            repeats.append(max(first, at))
            first = min(first, at)
    return _spans(repeats)


_RUN_ROWS = pa.schema([("part", pa.int32()), ("run", pa.binary()), ("doc", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])


def _sorted_runs(splitters: list[bytes], crowd_splitters: list[bytes]):
    parts = len(splitters) + 1

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(doc, text, blocks) to front-coded runs by range, of suffixes and (parts from ``parts`` on) of crowded strings, and to spans of strings that a run repeats."""
        held: list[tuple] = []
        crowd: list[tuple] = []

        def rows(runs: dict[int, bytes], spans: list[tuple[int, int, int]]) -> pa.RecordBatch:
            m, n = len(runs), len(spans)
            ids, starts, ends = zip(*spans, strict=True) if n else ((), (), ())
            return pa.RecordBatch.from_arrays(
                [pa.array([*runs, *[None] * n], pa.int32()), pa.array([*runs.values(), *[None] * n], pa.binary()), *[pa.array([*[None] * m, *x], pa.int64()) for x in (ids, starts, ends)]], schema=_RUN_ROWS
            )

        def ranged(entries: list[tuple], limits: list[bytes], first: int, width: int) -> dict[int, bytes]:
            ranges: dict[int, list[tuple]] = {}
            for e in entries:
                ranges.setdefault(first + bisect_right(limits, e[0][:width]), []).append(e)
            return {k: front_code(v) for k, v in ranges.items()}

        def flush_suffixes() -> pa.RecordBatch:
            held.sort()
            out = rows(ranged(held, splitters, 0, GRAM), [])
            held.clear()
            return out

        def flush_strings() -> pa.RecordBatch:
            crowd.sort()  # of equal strings, the first document's comes first
            kept: list[tuple] = []
            again: list[tuple[int, int]] = []
            for e in crowd:
                if kept and kept[-1][0] == e[0]:
                    again.append((e[3], e[4]))
                else:
                    kept.append(e)
            crowd.clear()
            return rows(ranged(kept, crowd_splitters, parts, WIDTH), _spans(again))

        for batch in batches:
            for who, text, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = text.encode()
                for b in own:
                    start, strings, anchor = b["at"] >> 14, (b["at"] >> 7) & 127, b["at"] & 127
                    if b["crowded"]:
                        crowd += [(data[s : s + WIDTH], b"", 1, who, s) for s in range(start, start + strings)]
                    else:
                        held.append((data[start + anchor : start + strings + WIDTH - 1], data[start : start + anchor], strings, who, start))
                if len(held) >= RUN_SUFFIXES:
                    yield flush_suffixes()
                if len(crowd) >= RUN_STRINGS:
                    yield flush_strings()
        if held:
            yield flush_suffixes()
        if crowd:
            yield flush_strings()

    return make


def _merge(parts: int):
    def merge(key, runs: pd.DataFrame) -> pd.DataFrame:
        found = (merge_runs if key[0] < parts else merge_strings)(runs["run"].tolist())
        return pd.DataFrame(found, columns=["doc", "start", "end"]).astype("int64")

    return merge


def _splitters(own: DataFrame, open_: DataFrame, parts: int) -> list[bytes]:
    """Limits of ``parts`` ranges, at most, from suffixes (crowded: strings) drawn by hash; the sample has DRAWN of them for each range."""
    if parts < 2:
        return []
    drawn = open_.orderBy(F.xxhash64("doc", "at")).limit(DRAWN * parts)
    start, strings, anchor = F.shiftright("at", 14), F.shiftright("at", 7).bitwiseAND(127), F.col("at").bitwiseAND(127)
    # a crowded block's strings start anywhere in it
    begin = F.when(F.col("crowded"), start + F.pmod(F.xxhash64("at", "doc"), strings)).otherwise(start + anchor)
    length = F.when(F.col("crowded"), WIDTH).otherwise(GRAM)
    points = F.broadcast(drawn.select("doc", begin.cast("int").alias("begin"), length.alias("length")))
    cut = F.col("text").cast("binary").substr(F.col("begin") + 1, F.col("length"))
    found = sorted(bytes(r[0]) for r in own.join(points, "doc").select(cut).distinct().toLocalIterator())
    return sorted({found[k * len(found) // parts] for k in range(1, parts)}) if found else []


def repeated_spans(own: DataFrame, max_contexts: int = MAX_CONTEXTS) -> DataFrame:
    """doc, start, end of byte spans covered by strings that also start earlier; own: rows of in_order()."""
    spark = own.sparkSession
    own = own.select("doc", "text").where("text IS NOT NULL")
    often = own.select("text").mapInArrow(_grams, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).where("n > 1").select("gram")
    often = materialise(often, "grams")
    met = materialise(own.mapInArrow(_blocks, "gram bigint, content bigint, doc bigint, at bigint").join(often, "gram"), "blocks")
    firsts = materialise(met.groupBy("gram", "content").agg(F.min(F.struct("doc", "at")).alias("first"), F.count("*").alias("n")).select("gram", "content", "first", "n"), "firsts")

    copies = met.join(firsts.where("n > 1"), ["gram", "content"]).where(F.struct("doc", "at") != F.col("first"))
    start = F.shiftright("at", 14)
    whole = copies.select("doc", start.alias("start"), (start + F.shiftright("at", 7).bitwiseAND(127) + WIDTH - 1).alias("end"))
    whole = materialise(whole, "copies")

    contexts = materialise(firsts.groupBy("gram").agg(F.count("*").alias("contexts")).where("contexts > 1"), "contexts")
    open_ = firsts.join(contexts, "gram").select(F.col("first.doc").alias("doc"), F.col("first.at").alias("at"), (F.col("contexts") > max_contexts).alias("crowded"))
    open_ = materialise(open_, "open")
    strings = F.shiftright("at", 7).bitwiseAND(127)
    rows = {r.crowded: r.n for r in open_.groupBy("crowded").agg(F.sum(F.when(F.col("crowded"), strings).otherwise(1)).alias("n")).collect()}
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    limits = [_splitters(own, open_.where(F.col("crowded") == crowded), max(least, -(-rows[crowded] // RANGE_SUFFIXES))) if crowded in rows else [] for crowded in (False, True)]
    by_doc = open_.groupBy("doc").agg(F.collect_list(F.struct("at", "crowded")).alias("blocks"))
    runs = own.join(by_doc, "doc").select("doc", "text", "blocks").mapInArrow(_sorted_runs(*limits), "part int, run binary, doc bigint, start bigint, end bigint")
    runs = materialise(runs, "runs")
    merged = runs.where("part IS NOT NULL").select("part", "run").groupBy("part").applyInPandas(_merge(len(limits[0]) + 1), "doc bigint, start bigint, end bigint")
    return whole.union(materialise(merged, "merged")).union(runs.where("part IS NULL").select("doc", "start", "end"))


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_contexts: int = MAX_CONTEXTS) -> DataFrame:
    """id_col, n_bytes, n_removed, n_spans, kept (bytes) for every row."""
    arrow_limits(docs.sparkSession)
    own = in_order(docs, id_col, text_col)
    return without_spans(own, materialise(repeated_spans(own, max_contexts), "spans"), id_col)
