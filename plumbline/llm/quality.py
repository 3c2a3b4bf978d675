"""Quality rules from repetition: suffix arrays over words and over bytes, and their common-prefix intervals.

For each document the suffixes of its word sequence are sorted by prefix doubling; neighbours in
that order give the longest-common-prefix array. Every position's longest repeat is the larger of
the two prefixes it shares with its neighbours, so the union of ``[i, i + longest(i))`` is the union
of all maximal repeated substrings. Two limits follow: the covered fraction of the words, and the
longest single repeat. Both are held over words and, as text without spaces has few, over bytes.
Only documents in which some window of ``MIN_REPEAT_BYTES`` is repeated need the suffix array over
bytes: sorted hashes of the windows tell which, and no longer repeat is in any other.

Documents of a slice of an Arrow batch are sorted together (the document is the first part of the
key, so no match crosses documents). Nothing is shuffled and each slice is bounded.

Null and empty texts have no words and fail the base rule. Texts of any length are judged whole; a
long one takes about 60 bytes of memory, and 4 more for each doubling of its longest repeat, for each
word, and as much for each byte if a window of ``MIN_REPEAT_BYTES`` is repeated. Rows are judged one
by one: repeated rows get equal results, and ids play no part. A limit that is just met is kept (so
ties don't matter). An empty table gives an empty result. Input columns other than the text are
passed through untouched; one with the name of the result is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.shared import Numbering, arrow_limits, as_bytes, slices

#: Words that a repeat must have before its span counts, and the two limits.
MIN_REPEAT_WORDS = 8
MAX_COVERED_FRACTION = 0.2
MAX_LONGEST_FRACTION = 0.15
#: The same over bytes; README has the figures of labelled documents.
MIN_REPEAT_BYTES = 48
MAX_COVERED_BYTES = 0.25
MAX_LONGEST_BYTES = 0.15

RESULT = (
    "struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,n_repeat_words:bigint,"
    "base_failed:boolean,kept:boolean,covered_words:bigint,longest_repeat:bigint,"
    "covered_bytes:bigint,longest_bytes:bigint>"
)
NAMES = [x.split(":")[0] for x in RESULT[7:-1].split(",")]

_PACKED = np.zeros(256, np.int64)
_PACKED[[b for b in range(256) if b & 0xC0 != 0x80 and b not in b" \t\n\v\f\r"]] = 1
_PACKED[list(b"#*$%&|<>")] += 1 << 32


def longest_repeats(doc: np.ndarray, word: np.ndarray) -> np.ndarray:
    """For each position, the length of the longest run of words from it that another position of its document has too."""
    n = len(word)
    if n < 2:
        return np.zeros(n, np.int64)
    key = doc.astype(np.int64) * (int(word.max()) + 1) + word
    order = np.argsort(key, kind="stable")
    first = np.empty(n, bool)
    first[0], first[1:] = True, key[order][1:] != key[order][:-1]
    start = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = start
    size = np.bincount(start, minlength=n)
    end = np.searchsorted(doc, doc, side="right")
    levels, step = [rank.astype(np.int32)], 1
    active = np.flatnonzero(size[rank] > 1)
    while len(active):
        ahead = active + step
        inside = ahead < end[active]
        second = np.where(inside, rank[np.minimum(ahead, n - 1)] + 1, 0)
        mine = rank[active]
        o = np.argsort(mine * (n + 1) + second, kind="stable")
        a, m, s = active[o], mine[o], second[o]
        k = np.arange(len(a))
        new_group = np.r_[True, m[1:] != m[:-1]]
        new_part = new_group | np.r_[True, s[1:] != s[:-1]]
        group_at = np.maximum.accumulate(np.where(new_group, k, 0))
        part_at = np.maximum.accumulate(np.where(new_part, k, 0))
        rank[a] = m + part_at - group_at
        part_size = np.diff(np.r_[np.flatnonzero(new_part), len(a)])
        active = np.sort(a[np.repeat(part_size > 1, part_size)])
        step *= 2
        if len(active):
            levels.append(rank.astype(np.int32))
    suffixes = np.empty(n, np.int64)
    suffixes[rank] = np.arange(n)
    left, right = suffixes[:-1], suffixes[1:]
    shared = np.zeros(n - 1, np.int64)
    for level in range(len(levels) - 1, -1, -1):
        at = levels[level]
        x, y = left + shared, right + shared
        ok = (x < n) & (y < n)
        same = ok & (at[np.minimum(x, n - 1)] == at[np.minimum(y, n - 1)])
        shared += same * (1 << level)
    # a level is kept while some group is left, so a last step of the same size may still be open
    longest = np.zeros(n, np.int64)
    longest[suffixes[1:]] = shared
    np.maximum.at(longest, suffixes[:-1], shared)
    return longest


def _covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Running count of covered positions, from 0 up to n."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lengths, -1)
    return np.r_[0, np.cumsum(np.cumsum(edge[:n]) > 0)]


def _with_repeats(data: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Numbers of the documents data[at[k]:at[k + 1]] where a window of so many bytes (a multiple of 8) is repeated, and few others."""
    n = len(data) - size + 1
    if n < 2:
        return np.zeros(0, np.int64)
    eight = data[: len(data) - 7].astype(np.uint64)
    for k in range(1, 8):
        eight |= data[k : len(data) - 7 + k].astype(np.uint64) << np.uint64(8 * k)
    h = np.zeros(n, np.uint64)
    for k in range(0, size, 8):
        h = (h ^ eight[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    length = np.maximum(np.diff(at) - size + 1, 0)
    doc = np.repeat(np.arange(len(length)), length)
    first = np.repeat(at[:-1] - (np.cumsum(length) - length), length)
    h = (h[np.arange(len(doc)) + first] ^ doc.astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
    order = np.argsort(h)
    h, doc = h[order], doc[order]
    return np.unique(doc[1:][(h[1:] == h[:-1]) & (doc[1:] == doc[:-1])])


def repeated_bytes(texts: list[bytes], min_repeat: int) -> tuple[np.ndarray, np.ndarray]:
    """For each text, the bytes that repeats of at least min_repeat cover, and the longest repeat's (0 below min_repeat)."""
    covered, top = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    at = np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64)
    found = _with_repeats(np.frombuffer(b"".join(texts), np.uint8), at, max(8, min_repeat // 8 * 8))
    if len(found):
        size = np.array([len(texts[k]) for k in found.tolist()], np.int64)
        ends = np.cumsum(size)
        doc = np.repeat(np.arange(len(found)), size)
        longest = longest_repeats(doc, np.frombuffer(b"".join(texts[k] for k in found.tolist()), np.uint8))
        spans = np.flatnonzero(longest >= min_repeat)
        cover = _covered(spans, longest[spans], len(longest))
        covered[found] = cover[ends] - cover[ends - size]
        np.maximum.at(top, found[doc[spans]], longest[spans])
    return covered, top


def measure(texts: list[bytes], min_repeat: int, max_covered: float, max_longest: float, min_bytes: int = MIN_REPEAT_BYTES, max_covered_bytes: float = MAX_COVERED_BYTES, max_longest_bytes: float = MAX_LONGEST_BYTES) -> list[np.ndarray]:
    """The fields of RESULT for a list of UTF-8 texts."""
    count, number = len(texts), Numbering()
    words = [t.split() for t in texts]
    n_words = np.array([len(w) for w in words], np.int64)
    total = int(n_words.sum())
    word = np.fromiter((number[x] for w in words for x in w), np.int64, total)
    doc = np.repeat(np.arange(count), n_words)
    ends = np.cumsum(n_words)
    begins = ends - n_words
    longest = longest_repeats(doc, word)
    windows = np.flatnonzero(longest >= 5)
    five = _covered(windows, np.full(len(windows), 5), total)
    spans = np.flatnonzero(longest >= min_repeat)
    cover = _covered(spans, longest[spans], total)
    n_repeat, covered = five[ends] - five[begins], cover[ends] - cover[begins]
    top = np.zeros(count, np.int64)
    np.maximum.at(top, doc, longest)
    packed = np.r_[0, np.cumsum(_PACKED[np.frombuffer(b"".join(texts), np.uint8)])]
    at = np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64)
    sums = packed[at[1:]] - packed[at[:-1]]
    dup = np.array([len(x) - len(set(x)) for x in ([y for y in t.split(b"\n") if y.strip()] for t in texts)], np.int64)
    failed = (n_words < 10) | (100 * n_repeat > 20 * n_words)
    kept = ~failed & (covered <= max_covered * n_words) & ((top < min_repeat) | (top <= max_longest * n_words))
    n_bytes = np.diff(at)
    covered_bytes, top_bytes = repeated_bytes(texts, min_bytes)
    kept &= (covered_bytes <= max_covered_bytes * n_bytes) & (top_bytes <= max_longest_bytes * n_bytes)
    return [n_words, sums & 0xFFFFFFFF, sums >> 32, dup, n_repeat, failed, kept, covered, top, covered_bytes, top_bytes]


def quality(
    text: "Column | str",
    min_repeat: int = MIN_REPEAT_WORDS,
    max_covered: float = MAX_COVERED_FRACTION,
    max_longest: float = MAX_LONGEST_FRACTION,
    min_bytes: int = MIN_REPEAT_BYTES,
    max_covered_bytes: float = MAX_COVERED_BYTES,
    max_longest_bytes: float = MAX_LONGEST_BYTES,
) -> Column:
    """A struct column of RESULT for a text column."""

    @F.arrow_udf(RESULT)
    def judged(texts: pa.Array) -> pa.Array:
        parts: list[list[np.ndarray]] = [measure(as_bytes(texts[a:b]), min_repeat, max_covered, max_longest, min_bytes, max_covered_bytes, max_longest_bytes) for a, b in slices(texts)]
        columns = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 5 + [np.zeros(0, bool)] * 2 + [np.zeros(0, np.int64)] * 4
        return pa.StructArray.from_arrays([pa.array(x) for x in columns], NAMES)

    return judged(text)


def with_quality(df: DataFrame, text: str = "text", out: str = "quality", **limits) -> DataFrame:
    """df with the struct column ``out`` (it replaces a column of that name)."""
    arrow_limits(df.sparkSession)
    return df.withColumn(out, quality(text, **limits))
