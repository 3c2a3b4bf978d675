"""Byte-level BPE encoding and decoding by longest matches with backtracking.

The bytes of a piece are read as Latin-1, so an Aho-Corasick automaton over the vocabulary finds
every token that starts at each position. Encoding takes the longest token, steps to shorter ones or
back to the previous token when it can't go on, and never tries a dead position twice: linear in the
piece. Two tokens may stand side by side exactly if merging their joint bytes gives these two again;
a sequence is what the merges give if all its neighbours are so. That test undoes merges towards the
border between the two and is memoised.

Pieces (matches of the pattern) are independent; a bounded cache holds their encodings. Work is a
scalar Arrow UDF: no shuffle, and memory is bounded by the batch and the cache.

Null and empty texts encode to no tokens and decode to no bytes; texts of any length are encoded whole,
and a long piece takes time and memory in proportion. Rows are encoded one by one: repeated rows, and
rows without an id, get the tokens of their own text. Equally long tokens at a position can't differ,
so there are no ties. An empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.shared import concat, slices

#: Entries of a worker's caches; a full cache is emptied.
CACHE_ENTRIES = 150_000


def load_ranks(path: str) -> list[bytes]:
    """Token bytes by id from a file of ``base64 rank`` lines."""
    with open(path, "rb") as f:
        ranks = {int(b): base64.b64decode(a) for a, b in (x.split() for x in f if x.strip())}
    return [ranks[i] for i in range(len(ranks))]


class _Pieces(dict):
    """Encodings by piece, made when first asked for; long pieces aren't kept."""

    def __init__(self, encoder: BytePairEncoder):
        self.encoder = encoder

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(self.encoder.encode_bytes(piece.encode().decode("latin-1")), np.int32).tobytes()
        if len(piece) <= 64:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[piece] = ids
        return ids


class BytePairEncoder:
    def __init__(self, tokens: list[bytes], pattern: str, halves: list[tuple[int, int] | None] | None = None):
        import ahocorasick
        import regex

        self.tokens = tokens
        self.names = [t.decode("latin-1") for t in tokens]
        self.ids = {t: i for i, t in enumerate(self.names)}
        self.split = regex.compile(pattern).findall
        self.automaton = ahocorasick.Automaton()
        for i, t in enumerate(self.names):
            self.automaton.add_word(t, i)
        self.automaton.make_automaton()
        self.sizes = [len(t) for t in tokens]
        self.halves = halves or self.last_merges()
        self.shorter: dict[int, int] = {}
        self.fits: dict[int, bool] = {}
        self.pieces = _Pieces(self)

    def last_merges(self) -> list[tuple[int, int] | None]:
        """For each token the two that its last merge joins; None for single bytes."""
        return [tuple(self.ids[x] for x in self.merged(t, 2)) if len(t) > 1 else None for t in self.names]

    def merged(self, data: str, least: int = 1) -> list[str]:
        """What the merges make of a short string, one by one, until ``least`` parts are left."""
        parts = list(data)
        while len(parts) > least:
            ranks = [self.ids.get(a + b, 1 << 40) for a, b in zip(parts, parts[1:], strict=False)]
            best = min(ranks)
            if best == 1 << 40:
                break
            at = ranks.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the joint bytes of two tokens gives these two again.

        Both tokens' merges are undone from the latest on, towards the border between them. The pair
        breaks if the two parts at the border have a merge that comes before the one just undone: of
        equal ranks, the merge further left comes first.
        """
        key = left << 32 | right
        if (known := self.fits.get(key)) is not None:
            return known
        if len(self.fits) >= CACHE_ENTRIES:
            self.fits.clear()
        ids, names, halves = self.ids, self.names, self.halves
        before, known = 1 << 40, True
        a, b = left, right
        while True:
            if (joint := ids.get(names[a] + names[b])) is not None and joint < before:
                known = False
                break
            outer, inner = halves[a], halves[b]
            if outer and (a > b or not inner):
                before, a = a, outer[1]
            elif inner:
                before, b = b + 1, inner[0]
            else:
                break
        self.fits[key] = known
        return known

    def next_shorter(self, token: int) -> int:
        """The longest token that is a proper prefix of this one, or -1."""
        if (found := self.shorter.get(token)) is None:
            name, found = self.names[token], -1
            for n in range(len(name) - 1, 0, -1):
                if (found := self.ids.get(name[:n], -1)) >= 0:
                    break
            self.shorter[token] = found
        return found

    def encode_bytes(self, data: str) -> list[int]:
        """Token ids of one piece, its bytes given as Latin-1."""
        if (whole := self.ids.get(data)) is not None:
            return [whole]
        longest = [-1] * len(data)
        sizes = self.sizes
        for end, token in self.automaton.iter(data):
            longest[end - sizes[token] + 1] = token  # later ends are longer
        alive = bytearray(b"\1" * (len(data) + 1))
        out: list[int] = []
        at, token = 0, longest[0]
        while at < len(data):
            last = out[-1] if out else -1
            while token >= 0 and not (alive[at + sizes[token]] and (last < 0 or self.compatible(last, token))):
                token = self.next_shorter(token)
            if token >= 0:
                out.append(token)
                at += sizes[token]
                token = longest[at] if at < len(data) else -1
            else:
                alive[at] = 0
                token = out.pop()  # its end is dead now, so a shorter one follows
                at -= sizes[token]
        return out

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit token ids of a text."""
        return b"".join(map(self.pieces.__getitem__, self.split(text)))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class Vocabulary:
    """What is broadcast. A worker's encoder lives in its copy, so both go when Spark drops the broadcast."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens, self.pattern = tokens, pattern
        self.halves = BytePairEncoder(tokens, pattern).halves
        self.built: BytePairEncoder | None = None

    def encoder(self) -> BytePairEncoder:
        if self.built is None:
            self.built = BytePairEncoder(self.tokens, self.pattern, self.halves)
        return self.built


def _encoded(e: BytePairEncoder, texts: pa.Array) -> tuple[pa.Array, list[bytes]]:
    """(ids, the same as bytes of 32-bit numbers) of a slice."""
    raw = [e.encode(x) if x else b"" for x in texts.to_pylist()]
    offsets = np.cumsum([0, *(len(x) // 4 for x in raw)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(raw), np.int32))), raw


def bpe(spark: SparkSession, tokens: list[bytes], pattern: str):
    """(encode, decode, both): text to array<int> of token ids, ids to binary, and text to a struct of ids and the bytes decoded from them.

    The vocabulary is broadcast; its size is fixed. ``both`` does one after the other in one worker.
    """
    shared = spark.sparkContext.broadcast(Vocabulary(tokens, pattern))

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        e = shared.value.encoder()
        parts = [_encoded(e, texts[a:b])[0] for a, b in slices(texts)]
        return concat(parts, pa.list_(pa.int32()))

    @F.arrow_udf("binary")
    def decode(ids: pa.Array) -> pa.Array:
        known = shared.value.tokens
        return pa.array([b"".join(map(known.__getitem__, x.as_py() or ())) for x in ids], pa.binary())

    @F.arrow_udf("struct<ids:array<int>,decoded:binary>")
    def both(texts: pa.Array) -> pa.Array:
        e, parts = shared.value.encoder(), []
        for a, b in slices(texts):
            ids, raw = _encoded(e, texts[a:b])
            back = pa.array([e.decode(np.frombuffer(x, np.int32).tolist()) for x in raw], pa.binary())
            parts.append(pa.StructArray.from_arrays([ids, back], ["ids", "decoded"]))
        return concat(parts, pa.struct([("ids", pa.list_(pa.int32())), ("decoded", pa.binary())]))

    return encode, decode, both


def ids_digest(ids: Column) -> Column:
    """sha256 of the decimal ids joined by one space."""
    return F.sha2(F.concat_ws(" ", ids.cast("array<string>")), 256)
