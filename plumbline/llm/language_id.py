"""Language identification by prediction by partial matching over bytes.

For each language a tree of byte contexts up to ``ORDER`` is counted on labelled texts. A byte's
probability in a context is count / (total + distinct); an unseen byte costs the escape
distinct / (total + distinct) and is predicted by the next shorter context, down to 1/256. Statistics
are frozen: a text's code length under each language is the exact sum over its bytes, and the
shortest wins. The score is the winner's share of 2^-length per language, over the text's length
scaled to at most ``SCORE_BYTES``.

Training texts are a sample of labelled rows: about ``TRAIN_ROWS`` per language and at most
``TRAIN_BYTES`` of them, and ``ALL_ROWS`` and ``ALL_BYTES`` in all, so with very many languages each
has fewer, but none is left out. It is drawn by a hash of the id, so reruns agree. The model's size
follows from these bounds and is broadcast. Prediction is one pass without a shuffle, for each
slice of a batch a few table lookups per byte, and reads whole texts.

Null texts, and texts without a letter, get ``und`` with score 0, as does everything if no row is
labelled. Texts of any length are read whole. Ties go to the language first by name. A row with a null
id is neither held out nor learned from; rows that repeat an id are all held out or all not, and each
is predicted from its own text. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.shared import arrow_limits, as_bytes, slices

ORDER = 4
TRAIN_ROWS = 400
TRAIN_BYTES = 1_500_000
#: Bounds of the whole sample, shared evenly by the languages; each has LEAST_ROWS, or all it has, in any case.
LEAST_ROWS = 25
ALL_ROWS = 100_000
ALL_BYTES = 256_000_000
SCORE_BYTES = 64
_LETTER = regex.compile(r"\p{L}")


def training_rows(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, rows: int = TRAIN_ROWS) -> list[tuple[str, bytes]]:
    """About ``rows`` rows of each language (fewer, if there are very many), drawn by hash of the id; the bound holds for any table size."""
    usable = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    counts = usable.groupBy(lang_col).agg(F.count("*").alias("n")).orderBy(lang_col).collect()
    if not counts:
        return []
    rows = max(LEAST_ROWS, min(rows, ALL_ROWS // len(counts)))
    most = min(TRAIN_BYTES, ALL_BYTES // len(counts))
    draw = F.pmod(F.xxhash64(F.col(id_col), F.lit(41)), F.lit(1 << 30)) / float(1 << 30)
    # literals of the plan: nothing is shuffled for the sample
    share = F.try_element_at(F.create_map(*[F.lit(x) for r in counts for x in (r[0], min(1.0, rows / r.n))]), F.col(lang_col))
    drawn = usable.where(draw < share).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), draw.alias("draw"))
    got = drawn.orderBy("draw").limit(rows * len(counts) * 2).select("lang", "text").toLocalIterator()
    held: dict[str, int] = {}
    out = []
    for lang, text in got:
        data = text.encode()
        if held.get(lang, 0) + len(data) <= most or lang not in held:
            held[lang] = held.get(lang, 0) + len(data)
            out.append((lang, data))
    return out


def _grams(data: np.ndarray, n: int) -> np.ndarray:
    """Integer codes of all n-byte windows."""
    out = np.zeros(max(0, len(data) - n + 1), np.uint64)
    for k in range(n):
        out = (out << np.uint64(8)) | data[k : k + len(out)]
    return out


class Table:
    """Open-addressed hash from code to row number; rows counts the codes."""

    def __init__(self, codes: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(codes)) * 2.5))))
        self.keys = np.full(1 << self.bits, np.uint64(1) << np.uint64(63), np.uint64)
        self.rows = np.full(1 << self.bits, len(codes), np.int32)
        left, probe = np.arange(len(codes)), 0
        while len(left):
            at = self._slot(codes[left], probe)
            free = self.rows[at] == len(codes)
            won = left[free][np.unique(at[free], return_index=True)[1]]
            slot = self._slot(codes[won], probe)
            self.keys[slot], self.rows[slot] = codes[won], won
            left = np.setdiff1d(left, won, assume_unique=True)
            probe += 1
        self.probes, self.count = probe, len(codes)

    def _slot(self, codes: np.ndarray, probe: int) -> np.ndarray:
        h = codes * np.uint64(0x9E3779B97F4A7C15)
        return (((h >> np.uint64(64 - self.bits)) + np.uint64(probe)) & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def find(self, codes: np.ndarray) -> np.ndarray:
        """Row of each code, or the number of rows if it is none."""
        out = np.full(len(codes), self.count, np.int32)
        left = np.arange(len(codes))
        for probe in range(self.probes):
            at = self._slot(codes[left], probe)
            rows = self.rows[at]
            hit = self.keys[at] == codes[left]
            out[left[hit]] = rows[hit]
            left = left[~hit & (rows != self.count)]
            if not len(left):
                break
        return out


class Model:
    """Code lengths, in bits, by order: of seen grams, and of the escape from seen contexts."""

    def __init__(self, rows: list[tuple[str, bytes]], order: int = ORDER):
        self.order = order
        self.langs = sorted({lang for lang, _ in rows})
        counts: list[list[dict]] = []
        for n in range(1, order + 2):
            per = []
            for lang in self.langs:
                codes = [_grams(np.frombuffer(t, np.uint8).astype(np.uint64), n) for x, t in rows if x == lang]
                per.append(np.unique(np.concatenate(codes), return_counts=True))
            counts.append(per)
        width = len(self.langs)
        self.grams: list[Table] = []
        self.bits: list[np.ndarray] = []
        self.contexts: list[Table] = []
        self.escapes: list[np.ndarray] = []
        below: tuple[Table, np.ndarray] | None = None
        for k in range(order + 1):  # k: bytes of context
            seen = np.unique(np.concatenate([np.zeros(0, np.uint64), *[c for c, _ in counts[k]]]))
            contexts = np.unique(seen >> np.uint64(8))
            total, kinds = np.zeros((len(contexts), width)), np.zeros((len(contexts), width))
            count = np.zeros((len(seen), width))
            for i, (codes, c) in enumerate(counts[k]):
                count[np.searchsorted(seen, codes), i] = c
                at = np.searchsorted(contexts, codes >> np.uint64(8))
                total[:, i] = np.bincount(at, c, len(contexts))
                kinds[:, i] = np.bincount(at, minlength=len(contexts))
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
                own = -np.log2(count / (total + kinds)[np.searchsorted(contexts, seen >> np.uint64(8))])
            if below is None:
                lower = np.full((len(seen), width), 8.0)
            else:
                short = seen & np.uint64((1 << (8 * k)) - 1)
                lower = below[1][below[0].find(short)]
            fallback = escape[np.searchsorted(contexts, seen >> np.uint64(8))] + lower
            bits = np.where(count > 0, own, fallback)
            self.grams.append(Table(seen))
            self.bits.append(np.vstack([bits, np.full((1, width), np.nan)]))
            self.contexts.append(Table(contexts))
            self.escapes.append(np.vstack([escape, np.zeros((1, width))]))
            below = (self.grams[-1], self.bits[-1])

    def lengths(self, data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Code length of each text, texts x languages; data holds them end to end."""
        width = len(self.langs)
        total = np.zeros((len(begins), width))
        doc = np.repeat(np.arange(len(begins)), ends - begins)
        room = np.minimum(np.arange(len(data)) - begins[doc], self.order)  # bytes of context there are
        code = np.zeros(len(data), np.uint64)
        for k in range(self.order + 1):
            code[k:] |= data[: len(data) - k].astype(np.uint64) << np.uint64(8 * k)
        left = np.arange(len(data))
        for k in range(self.order, -1, -1):
            at = left[room[left] >= k]
            wait = left[room[left] < k]
            gram = code[at] & np.uint64((1 << (8 * (k + 1))) - 1)
            row = self.grams[k].find(gram)
            hit = row < self.grams[k].count
            for i in range(width):
                total[:, i] += np.bincount(doc[at[hit]], self.bits[k][row[hit], i], len(begins))
            miss = at[~hit]
            if len(miss):
                context = self.contexts[k].find(gram[~hit] >> np.uint64(8))
                for i in range(width):
                    total[:, i] += np.bincount(doc[miss], self.escapes[k][context, i], len(begins))
                    if k == 0:
                        total[:, i] += 8.0 * np.bincount(doc[miss], minlength=len(begins))
            left = np.r_[wait, miss]
        return total


def _has_letter(text: bytes) -> bool:
    return bool(text) and (any(65 <= (b & 0xDF) <= 90 for b in text[:64]) or _LETTER.search(text.decode()) is not None)


def language(text: Column, model: Model, spark) -> Column:
    """struct<lang_pred, score> of a text column under a frozen model."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def predicted(texts: pa.Array) -> pa.Array:
        m = shared.value
        langs, scores = [], []
        for a, b in slices(texts, 1 << 20):
            own = as_bytes(texts[a:b])
            ends = np.cumsum([len(t) for t in own])
            begins = np.r_[0, ends[:-1]]
            bits = m.lengths(np.frombuffer(b"".join(own), np.uint8), begins, ends) if m.langs else np.zeros((len(own), 0))
            for t, x in zip(own, bits, strict=True):
                if not m.langs or not _has_letter(t):
                    langs.append("und")
                    scores.append(0.0)
                    continue
                best = int(np.argmin(x))
                scale = min(1.0, SCORE_BYTES / len(t))
                langs.append(m.langs[best])
                scores.append(float(1 / np.exp2(-np.minimum((x - x[best]) * scale, 1000.0)).sum()))
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    return predicted(text)


def held_out(id_col: str) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4)) == 2, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """id_col, held_out, lang_pred, score; learns from rows that aren't held out."""
    spark = docs.sparkSession
    arrow_limits(spark)
    model = Model(training_rows(docs.where(~held_out(id_col)), id_col, text_col, lang_col))
    return docs.select(F.col(id_col), held_out(id_col).alias("held_out"), language(F.col(text_col), model, spark).alias("p")).select(id_col, "held_out", "p.*")
