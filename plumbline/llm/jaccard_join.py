"""Exact n-gram Jaccard join (similarity 0.8 on word 5-shingles) as a grouped prefix join.

1. Each text becomes its set of distinct shingles (64-bit hashes), ordered by one global order: rare
   shingles by hash, then the most frequent ones of the corpus, least frequent first. Two sets with
   similarity 0.8 share one of their first ``n // 5 + 1`` shingles.
2. Texts with equal sets form a class; classes with equal size and prefix form a group, which enters
   the join once.
3. Groups meet in buckets, one for each prefix shingle. All pairs of a bucket are never made: first
   each member is only paired with its bucket's smallest member. Candidates pass a test of size and
   position (what is left of both sets from the bucket's shingle on must suffice) and a lower bound
   of the symmetric difference from parity bitmaps, then are verified on whole sets.
4. Verified links give components. What has met all of its bucket is left out of it, and the rest is
   parted by size of set, as only sets within a fourth of one another can be similar. Parts of buckets
   (and of groups) that still hold more than one component are expanded to members and dealt to cells
   of at most about ``2 * BLOCK_BYTES`` of bitmaps: blocks of members that aren't in the part's main
   component, against one another and against blocks of those that are; members of the main component
   never meet. A cell compares bitmaps as one matrix
   product and returns only what may be a link: first the nearest pair of any two components, so that
   large components join by one link, then, of the buckets that still hold several components, every
   pair left. A pair that is never tried therefore lies inside a component: components are exact.

jaccard_join() returns components, not the links: pairs inside one component are mostly never tried.
similar_pairs() and link_counts() do the whole join: every two classes that meet are compared in cells.

The order of shingles is a matter of speed only; its statistic reads all texts, but leaves out of each
batch of about a million shingles those that occur once in it, so counts are lower bounds and depend
on the layout. It keeps the ``HOT_SHINGLES`` most frequent, which bounds its broadcast. Buckets of those are salted. Buckets are
streamed, not collected; a cell has a bounded size. Comparisons in cells grow with (members outside
the main component) x (members), as a matrix product; a crowd of texts that are all just too
different is the worst case.

Edge cases: null or empty texts have no shingles and no links. Texts of any length are whole sets of
any size, their bitmaps grow with them. Rows are judged by their own text: rows that repeat an id
stay rows of their own, repeated rows get equal results, and a null id takes part in links but names
no component (null, if no id is reachable). Ids must be integers. Ties can't occur. An empty table
gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.components import components
from plumbline.llm.shared import Numbering, arrow_limits, as_bytes, drop_scratch, drop_since, materialise, scratch_so_far, slices, unused

SHINGLE_WORDS = 5
#: How many of the most frequent shingles are told apart in the global order: 2 MB of broadcast.
HOT_SHINGLES = 1 << 18
#: A shingle must occur this often to be one of them.
HOT_COUNT = 8
SALTS = 64
#: Least length of a parity bitmap; it has two to four bits for each shingle beyond that.
BITMAP_BYTES = 128
#: Bitmaps of a block, and of what is unpacked for a matrix product at once.
BLOCK_BYTES = 256 << 10
_UNPACKED = 512 << 10
_COUNT_AT_ONCE = 1 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _hashes(numbers: Numbering) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w, 7) for w in numbers), np.uint64, len(numbers))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_sets(texts: list[bytes], width: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each UTF-8 text; a text of fewer words is one shingle."""
    number = Numbering()
    words = [t.lower().split() for t in texts]
    counts = [len(w) for w in words]
    ids = np.fromiter((number[x] for w in words for x in w), np.int64, sum(counts))
    of = _hashes(number)[ids] if len(ids) else np.zeros(0, np.uint64)
    rolled = np.zeros(max(0, len(of) - width + 1), np.uint64)
    for k in range(width):
        rolled = rolled * _MIX + of[k : k + len(rolled)]
    rolled = _mixed(rolled)
    out, at = [], 0
    for n in counts:
        if n >= width:
            found = np.sort(rolled[at : at + n - width + 1])
            out.append(found[np.r_[True, found[1:] != found[:-1]]])
        elif n:
            h = np.uint64(n)
            with np.errstate(over="ignore"):
                for x in of[at : at + n]:
                    h = h * _MIX + x
            out.append(_mixed(np.array([h ^ np.uint64(n << 32)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


def frequent_shingles(docs: DataFrame, text_col: str, keep: int = HOT_SHINGLES, least: int = HOT_COUNT) -> np.ndarray:
    """Hashes of the most frequent shingles, least frequent first; at most ``keep`` reach the driver."""

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            h, c = np.unique(np.concatenate(held) if held else np.zeros(0, np.uint64), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(h[c > 1].view(np.int64)), pa.array(c[c > 1])], ["h", "c"])

        for batch in batches:
            texts = batch.column(0)
            for a, b in slices(texts):
                held += shingle_sets(as_bytes(texts[a:b]))
                if sum(map(len, held)) >= _COUNT_AT_ONCE:
                    yield flush()
        yield flush()

    counted = docs.select(text_col).mapInArrow(repeated, "h bigint, c bigint").groupBy("h").agg(F.sum("c").alias("c"))
    top = counted.where(F.col("c") >= least).orderBy(F.desc("c"), "h").limit(keep).toArrow()
    return top.column("h").to_numpy()[::-1].astype(np.int64).view(np.uint64)


def _bitmap(found: np.ndarray) -> bytes:
    """Parity of the number of shingles in each of the bitmap's bits; their number is a power of two."""
    size = max(BITMAP_BYTES * 8, 1 << (2 * len(found) - 1).bit_length()) if len(found) else BITMAP_BYTES * 8
    bits = np.bincount(((found >> np.uint64(13)) % np.uint64(size)).astype(np.int64), minlength=size) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def _folded(bitmaps: np.ndarray, size: int) -> np.ndarray:
    """Rows of bitmaps as bitmaps of fewer bytes: parities of halves add up."""
    while bitmaps.shape[1] > size:
        half = bitmaps.shape[1] // 2
        bitmaps = bitmaps[:, :half] ^ bitmaps[:, half:]
    return bitmaps


_SIGNATURE = "struct<n:bigint,s0:bigint,s1:bigint,n_hot:int,prefix:array<bigint>,bits:binary>"


def _signatures(spark: SparkSession, hot: np.ndarray):
    order = np.argsort(hot)
    shared = spark.sparkContext.broadcast((hot[order], order))

    @F.arrow_udf(_SIGNATURE)
    def signature(texts: pa.Array) -> pa.Array:
        names, ranks = shared.value
        n, s0, s1, n_hot, prefixes, bits = [], [], [], [], [], []
        for a, b in slices(texts):
            for found in shingle_sets(as_bytes(texts[a:b])):
                first = len(found) // 5 + 1 if len(found) else 0
                at = np.searchsorted(names, found)
                is_hot = (names[np.minimum(at, len(names) - 1)] == found) if len(names) else np.zeros(len(found), bool)
                rare = found[~is_hot]
                late = found[is_hot][np.argsort(ranks[at[is_hot]])] if len(rare) < first else rare[:0]
                prefix = np.r_[rare[:first], late[: max(0, first - len(rare))]]
                digest = xxhash.xxh3_128_digest(found.tobytes())
                n.append(len(found))
                s0.append(int.from_bytes(digest[:8], "little", signed=True))
                s1.append(int.from_bytes(digest[8:], "little", signed=True))
                n_hot.append(max(0, first - len(rare)))
                prefixes.append(prefix.view(np.int64))
                bits.append(_bitmap(found))
        offsets = np.cumsum([0, *map(len, prefixes)]).astype(np.int32)
        flat = np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64)
        return pa.StructArray.from_arrays(
            [pa.array(n, pa.int64()), pa.array(s0, pa.int64()), pa.array(s1, pa.int64()), pa.array(n_hot, pa.int32()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(bits, pa.binary())],
            ["n", "s0", "s1", "n_hot", "prefix", "bits"],
        )

    return signature


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (token, salt, hot, gid, n, left), sorted, to those whose bucket has company, each with its bucket's first row.

    A run of equal (token, salt) is a bucket; only its first row is held, however long it is.
    """
    head: tuple | None = None  # token, salt, hot, gid, n, left, whether it has been emitted
    for batch in batches:
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(6)]
        if not len(columns[0]):
            continue
        if head is not None and not head[6]:
            columns, head = [np.r_[h, c] for h, c in zip(head[:6], columns, strict=True)], None
        token, salt, hot, gid, n, left = columns
        new = np.r_[True, (token[1:] != token[:-1]) | (salt[1:] != salt[:-1])]
        joined = head is not None and head[0] == token[0] and head[1] == salt[0]
        starts = np.flatnonzero(new)
        run = np.cumsum(new) - 1
        company = np.diff(np.r_[starts, len(token)]) > 1
        pivot, pivot_n, pivot_left = (c[starts].copy() for c in (gid, n, left))
        if joined:
            pivot[0], pivot_n[0], pivot_left[0], company[0] = head[3], head[4], head[5], True
        keep = company[run] | hot
        emitted = bool(company[-1] or hot[-1])
        head = (token[-1], salt[-1], hot[-1], pivot[-1], pivot_n[-1], pivot_left[-1], emitted)
        if not emitted:
            keep &= run != run[-1]
        if keep.any():
            names = ["token", "gid", "n", "left", "pivot", "pivot_n", "pivot_left", "hot"]
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (token, gid, n, left, pivot[run], pivot_n[run], pivot_left[run], hot)], names)


def _possible(n_a: str, left_a: str, n_b: str, left_b: str) -> Column:
    """Whether two sets can be similar whose first common shingle leaves so many of each from there on."""
    a, b = F.col(n_a), F.col(n_b)
    return (5 * F.least(a, b) >= 4 * F.greatest(a, b)) & (9 * F.least(left_a, left_b) >= 4 * (a + b))


def _distance():
    @F.arrow_udf("bigint")
    def distance(a: pa.Array, b: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True):
            if len(x) != len(y):
                size = min(len(x), len(y))
                x, y = (_folded(np.frombuffer(v, np.uint8)[None, :], size).tobytes() for v in (x, y))
            out.append((int.from_bytes(x) ^ int.from_bytes(y)).bit_count())
        return pa.array(out, pa.int64())

    return distance


def _rows_at_once(size: int) -> int:
    return max(1, _UNPACKED // size)


def _signs(bitmaps: np.ndarray) -> np.ndarray:
    return 1.0 - 2.0 * np.unpackbits(bitmaps, axis=1).astype(np.float32)


def near_pairs(x: tuple, y: tuple | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of x, row of y, least difference) of pairs of different components that may be links.

    x, y: arrays n, left, component, home and a list of bitmaps. Without y, pairs of x, each once. One of
    a pair must be at home.
    """
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    other = x if y is None else y
    sizes_x, sizes_y = (np.fromiter(map(len, v[4]), np.int64, len(v[4])) for v in (x, other))
    for size_x in np.unique(sizes_x).tolist():
        for size_y in np.unique(sizes_y).tolist():
            if max(size_x, size_y) > 2 * min(size_x, size_y):
                continue  # sizes of sets are within a fourth of one another
            size, rows_x, rows_y = min(size_x, size_y), np.flatnonzero(sizes_x == size_x), np.flatnonzero(sizes_y == size_y)
            step = _rows_at_once(size)
            for i in range(0, len(rows_x), step):
                own = rows_x[i : i + step]
                signs = _signs(_folded(np.frombuffer(b"".join(x[4][k] for k in own.tolist()), np.uint8).reshape(len(own), size_x), size))
                for j in range(0, len(rows_y), step):
                    far = rows_y[j : j + step]
                    theirs = signs if y is None and size_x == size_y and i == j else _signs(_folded(np.frombuffer(b"".join(other[4][k] for k in far.tolist()), np.uint8).reshape(len(far), size_y), size))
                    difference = (8 * size - signs @ theirs.T) / 2
                    n_x, n_y = x[0][own][:, None], other[0][far][None, :]
                    ok = (9 * difference <= n_x + n_y) & (x[2][own][:, None] != other[2][far][None, :]) & (x[3][own][:, None] | other[3][far][None, :])
                    ok &= (5 * np.minimum(n_x, n_y) >= 4 * np.maximum(n_x, n_y)) & (9 * np.minimum(x[1][own][:, None], other[1][far][None, :]) >= 4 * (n_x + n_y))
                    if y is None:
                        ok &= own[:, None] < far[None, :]
                    p, q = np.nonzero(ok)
                    if len(p):
                        found.append((own[p], far[q], difference[p, q]))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.float32)
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


#: A member in a cell: side 0 meets side 1, and side 2 is both.
_CELL = ["bucket", "of_group", "part", "x", "y", "side", "id", "n", "left", "component", "home", "bits"]
_KEYS = _CELL[:5]


def _compared(nearest_only: bool):
    """Sorted rows of cells to pairs a, b that may be links; of each two components in a cell only the nearest pair, if so wished."""

    def cell(rows: list[np.ndarray | list]) -> tuple[np.ndarray, np.ndarray]:
        side, ids, n, left, component, home, bits = rows
        parts = [np.flatnonzero(side == k) for k in (0, 1, 2)]
        pick = lambda at: (n[at], left[at], component[at], home[at], [bits[k] for k in at.tolist()])
        if len(parts[2]):
            a, b, far = near_pairs(pick(parts[2]), None)
            a, b = parts[2][a], parts[2][b]
        else:
            a, b, far = near_pairs(pick(parts[0]), pick(parts[1]))
            a, b = parts[0][a], parts[1][b]
        if nearest_only and len(a):
            low, high = np.minimum(component[a], component[b]), np.maximum(component[a], component[b])
            order = np.lexsort((np.maximum(ids[a], ids[b]), np.minimum(ids[a], ids[b]), far, high, low))
            first = order[np.r_[True, (np.diff(low[order]) != 0) | (np.diff(high[order]) != 0)]]
            a, b = a[first], b[first]
        return np.minimum(ids[a], ids[b]), np.maximum(ids[a], ids[b])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list | None = None
        key: tuple | None = None
        out: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            a, b = (np.concatenate(c) for c in zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        def ended() -> None:
            rows = [np.concatenate([part[c] for part in held]) for c in range(6)]
            out.append(cell([*rows, [v for part in held for v in part[6]]]))

        for batch in batches:
            keys = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(5)]
            if not len(keys[0]):
                continue
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(5, 11)]
            bits = batch.column(11).to_pylist()
            new = np.zeros(len(keys[0]), bool)
            for c in keys:
                new[1:] |= c[1:] != c[:-1]
            starts = [0, *np.flatnonzero(new).tolist(), len(new)]
            for a, b in zip(starts, starts[1:], strict=False):
                own = tuple(c[a] for c in keys)
                if held is not None and own != key:
                    ended()
                    held = None
                key = own
                held = [] if held is None else held
                held.append([*(c[a:b] for c in columns), bits[a:b]])
            if sum(len(x[0]) for x in out) > 1 << 16:
                yield flush()
        if held is not None:
            ended()
        if out:
            yield flush()

    return compare


def _parted(placed: DataFrame) -> DataFrame:
    """Members of buckets (bucket, of_group, id, n, left, component) in parts that may hold a link between two components; adds part and home.

    A part is a class of sizes; it is visited by what is one class smaller and stands early enough in
    its order to be the smaller set of a pair. Each pair has one part in which one of both is at home.
    """
    size = F.floor(F.log(F.col("n")) / F.log(F.lit(1.26))).cast("int")  # sets whose sizes differ by a fourth are one class apart at most
    smaller = 9 * F.col("left") >= 8 * F.col("n")
    dealt = placed.withColumn("size", size).withColumn("part", F.explode(F.when(smaller, F.array("size", F.col("size") + 1)).otherwise(F.array("size"))))
    dealt = dealt.withColumn("home", F.col("part") == F.col("size")).drop("size")
    by = ["bucket", "of_group", "part"]
    open_ = dealt.groupBy(*by).agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.bool_or("home").alias("any_home"), F.bool_or(smaller).alias("any_smaller"))
    return dealt.join(open_.where("lo <> hi AND any_home AND any_smaller").select(*by), by)


def _across(parted: DataFrame, bitmaps: DataFrame, nearest_only: bool) -> DataFrame:
    """Pairs a, b that may be links, of members of different components that meet; parted: rows of _parted()."""
    by = ["bucket", "of_group", "part"]
    rows = parted.groupBy(*by, "component").agg(F.count("*").alias("rows"), F.sum(F.lit(BITMAP_BYTES) + F.col("n")).alias("bytes"))
    every = rows.groupBy(*by).agg(F.max(F.struct("rows", "component", "bytes")).alias("m"), F.sum("bytes").alias("bytes"), F.count("*").alias("components"))
    blocks = lambda size: F.ceil(size / BLOCK_BYTES).cast("int")
    shape = every.select(*by, F.col("m.component").alias("main"), blocks(F.col("m.bytes")).alias("mains"), blocks(F.col("bytes") - F.col("m.bytes")).alias("others"), (F.col("components") == 2).alias("alone"))
    open_ = parted.join(shape, by).withColumn("of_main", F.col("component") == F.col("main"))
    block = F.pmod(F.xxhash64("id"), F.when(F.col("of_main"), F.col("mains")).otherwise(F.col("others"))).cast("int")
    cell = lambda x, y, side: F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"), side.cast("int").alias("side"))
    own, others, mains = F.col("block"), F.sequence(F.lit(0), F.col("others") - 1), F.sequence(F.col("others"), F.col("others") + F.col("mains") - 1)
    to_others = F.transform(others, lambda k: cell(F.least(own, k), F.greatest(own, k), F.when(k == own, 2).when(k > own, 0).otherwise(1)))
    to_mains = F.transform(mains, lambda k: cell(own, k, F.lit(0)))
    from_main = F.transform(others, lambda k: cell(k, own + F.col("others"), F.lit(1)))
    # with one other component, its members never meet either
    to_others = F.when(F.col("alone"), F.array().cast("array<struct<x:int,y:int,side:int>>")).otherwise(to_others)
    dealt = open_.withColumn("block", block).withColumn("cell", F.explode(F.when(F.col("of_main"), from_main).otherwise(F.concat(to_others, to_mains))))
    dealt = dealt.select(*by, "cell.*", "id", "n", "left", "component", "home").join(bitmaps.toDF("id", "bits"), "id").select(*_CELL)
    return dealt.repartition(*_KEYS).sortWithinPartitions(*_KEYS).mapInArrow(_compared(nearest_only), "a bigint, b bigint").distinct()


def _shared_count():
    @F.arrow_udf("bigint")
    def shared(a: pa.Array, b: pa.Array) -> pa.Array:
        out = []
        for p, q in zip(a, b, strict=True):
            x, y = (np.frombuffer(v.as_py(), np.uint64) for v in (p, q))
            out.append(int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()))
        return pa.array(out, pa.int64())

    return shared


def _set_of():
    @F.arrow_udf("binary")
    def whole(texts: pa.Array) -> pa.Array:
        return pa.array([s.tobytes() for a, b in slices(texts) for s in shingle_sets(as_bytes(texts[a:b]))], pa.binary())

    return whole


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, label: str) -> DataFrame:
    """Of distinct pairs a, b of classes, those with 100 * intersection >= 80 * union; materialised. docs: id, key, text."""
    sides = classes.select("cls", "n", "bits")
    near = (
        pairs.join(sides.toDF("a", "na", "bits_a"), "a")
        .join(sides.toDF("b", "nb", "bits_b"), "b")
        .where((5 * F.least("na", "nb") >= 4 * F.greatest("na", "nb")) & (9 * _distance()(F.col("bits_a"), F.col("bits_b")) <= F.col("na") + F.col("nb")))
        .select("a", "b", "na", "nb")
    )
    near = materialise(near, f"{label}-near")
    ids = near.select(F.col("a").alias("cls")).union(near.select("b")).distinct()
    wanted = ids.join(classes.select("cls", F.col("id").alias("w_id"), F.col("key").alias("w_key")), "cls")
    texts = docs.join(wanted.hint("merge"), F.col("id").eqNullSafe(F.col("w_id")) & (F.col("key") == F.col("w_key")))
    # repeated rows give a set several times
    sets = materialise(texts.select("cls", _set_of()(F.col("text")).alias("found")).groupBy("cls").agg(F.min("found").alias("found")), f"{label}-sets")
    common = (
        near.hint("merge").join(sets.toDF("a", "found_a"), "a")
        .join(sets.toDF("b", "found_b").hint("merge"), "b")
        .select("a", "b", "na", "nb", _shared_count()(F.col("found_a"), F.col("found_b")).alias("common"))
    )
    links = materialise(common.where(100 * F.col("common") >= 80 * (F.col("na") + F.col("nb") - F.col("common"))).select("a", "b"), f"{label}-links")
    drop_scratch(near, sets)
    return links


def _meet(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, ...]:
    """docs (id, key, text), signatures of all rows, classes, members of groups of several classes (cls, n, gid), and what met in a bucket (token, gid, n, left, pivot, pivot_n, pivot_left, hot)."""
    spark = docs.sparkSession
    arrow_limits(spark)
    signature = _signatures(spark, frequent_shingles(docs, text_col))
    docs = docs.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))
    signed = materialise(docs.select("id", "key", signature(F.col("text")).alias("s")).select("id", "key", "s.*"), "signatures")
    # of rows with the same set, the one with the smallest id stands for the class
    first = signed.where("n > 0").groupBy("n", "s0", "s1").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "key", "n_hot", "prefix", "bits")).alias("c"))
    classes = first.select("n", "s0", "s1", "c.id", "c.key", "c.n_hot", "c.prefix", "c.bits").withColumn("cls", F.monotonically_increasing_id())
    classes = materialise(classes.withColumn("p0", F.xxhash64("n", "prefix")).withColumn("p1", F.xxhash64("prefix", "n", F.lit(1))), "classes")
    # both tables stay to the end; of their columns only those are read that are asked for
    small = classes.drop("prefix", "n_hot")
    groups = small.groupBy("n", "p0", "p1").agg(F.min("cls").alias("gid"), F.count("*").alias("members"))

    # members of groups with more than one class
    crowd = materialise(small.select("n", "p0", "p1", "cls").join(groups.where("members > 1"), ["n", "p0", "p1"]).select("cls", "n", "gid"), "crowds")
    others = crowd.where("cls <> gid").select("cls")
    heads = classes.select("cls", "n", "n_hot", "prefix").join(others, "cls", "left_anti")
    tokens = heads.select(F.posexplode("prefix").alias("pos", "token"), F.col("cls").alias("gid"), "n", F.col("n_hot"), F.size("prefix").alias("first"))
    hot = F.col("pos") >= F.col("first") - F.col("n_hot")
    salted = tokens.select("token", F.when(hot, F.pmod(F.xxhash64("gid"), F.lit(SALTS))).otherwise(F.lit(0)).cast("int").alias("salt"), hot.alias("hot"), "gid", "n", (F.col("n") - F.col("pos")).alias("left"))
    met = salted.repartition("token", "salt").sortWithinPartitions("token", "salt", "gid").mapInArrow(_meetings, "token bigint, gid bigint, n bigint, left bigint, pivot bigint, pivot_n bigint, pivot_left bigint, hot boolean")
    met = materialise(met, "meetings")
    return docs, signed, classes, crowd, met


def _members(met: DataFrame, crowd: DataFrame, met_all: Column) -> DataFrame:
    """bucket, of_group, id, n, left of every class in its buckets and its group, but of those rows that have met all others (met_all, of met)."""
    every = met.select(F.col("token").alias("bucket"), F.lit(False).alias("of_group"), "gid", "n", "left", met_all.alias("met_all")).join(crowd.select("gid", "cls"), "gid", "left")
    every = every.withColumn("id", F.coalesce("cls", "gid")).where(~F.col("met_all") | (F.col("id") != F.col("gid"))).select("bucket", "of_group", "id", "n", "left")
    return every.union(crowd.select(F.col("gid").alias("bucket"), F.lit(True), F.col("cls"), "n", "n"))


def _joined(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, key (hash of the text), n, class_id, component (a number of its own; null without shingles), component_id for every row."""
    before = scratch_so_far()
    docs, signed, classes, crowd, met = _meet(docs, id_col, text_col)
    compact, small = signed.select("id", "key", "n", "s0", "s1"), classes.drop("prefix", "n_hot")
    stars = met.where("pivot <> gid").where(_possible("n", "left", "pivot_n", "pivot_left")).select(F.col("pivot").alias("a"), F.col("gid").alias("b"))
    pivots = met.where("hot").select("token", "pivot").distinct()
    least = pivots.groupBy("token").agg(F.min("pivot").alias("a"))
    between = pivots.join(least, "token").where("a <> pivot").select("a", F.col("pivot").alias("b"))
    inside = crowd.where("cls <> gid").select(F.col("gid").alias("a"), F.col("cls").alias("b"))
    pairs = materialise(stars.union(between).union(inside).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    links = _verified(pairs, small, docs, "stars")

    # what is left: members of different components that meet in a bucket or a group; the first of a bucket that isn't salted has met all others
    every = _members(met, crowd, ~F.col("hot") & (F.col("gid") == F.col("pivot")))
    placed, known = every, components(links)
    for nearest_only in (True, False):
        placed = placed.select("bucket", "of_group", "id", "n", "left").join(known, "id", "left").select("bucket", "of_group", "id", "n", "left", F.coalesce("component", "id").alias("component"))
        mixed = placed.groupBy("bucket", "of_group").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("bucket", "of_group")
        placed = materialise(placed.join(mixed, ["bucket", "of_group"]), "placed")
        parted = materialise(_parted(placed), "parted")
        found = materialise(_across(parted, small.select("cls", "bits"), nearest_only).join(pairs, ["a", "b"], "left_anti"), "across")
        more = _verified(found, small, docs, "across")
        if more.head(1):
            links = links.union(more)
            known = components(links)
        pairs = pairs.union(found)
    drop_since(before, signed, classes, known)

    by_class = small.select("n", "s0", "s1", "cls", "id").join(known.withColumnRenamed("id", "cls"), "cls", "left").select("n", "s0", "s1", "id", F.coalesce("component", "cls").alias("component"))
    names = by_class.groupBy("component").agg(F.min("id").alias("component_id"))
    named = by_class.join(names, "component").select("n", "s0", "s1", F.col("id").alias("class_id"), "component", "component_id")
    return compact.join(named, ["n", "s0", "s1"], "left").select("id", "key", "n", F.when(F.col("n") > 0, F.col("class_id")).otherwise(F.col("id")).alias("class_id"), "component", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_shingles, class_id (smallest id with the same set), component_id for every row."""
    return _joined(docs, id_col, text_col).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "class_id", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, but of each component only one: that with the smallest id (no id comes last), of repeated rows any.

    Rows without shingles are linked with nothing and all stay.
    """
    before = scratch_so_far()
    found = materialise(_joined(docs, id_col, text_col).where("n > 0").select("id", "key", "component"), "placed-rows")
    drop_since(before, found)
    rank = F.struct(F.col("id").isNull().alias("no_id"), "id", "key")
    stays = found.groupBy("component").agg(F.min(rank).alias("r")).select("component", F.col("r.id").alias("s_id"), F.col("r.key").alias("s_key"))
    own = F.col("id").eqNullSafe(F.col("s_id")) & (F.col("key") == F.col("s_key"))
    judged = found.groupBy("component", "id", "key").agg(F.count("*").alias("rows")).join(stays, "component").select("id", "key", "rows", own.alias("stays"))
    judged = materialise(judged.where(~F.col("stays") | (F.col("rows") > 1)).select(F.col("id").alias("j_id"), F.col("key").alias("j_key"), "stays"), "copies")
    drop_scratch(found)
    keyed = docs.select(*docs.columns, F.col(id_col).cast("bigint").alias(i := unused(docs, "id")), F.xxhash64(text_col).alias(k := unused(docs, "key")))
    same = F.col(i).eqNullSafe(F.col("j_id")) & (F.col(k) == F.col("j_key"))
    kept = keyed.join(judged, same, "left_anti").select(*docs.columns)
    twice = judged.where("stays")
    if twice.head(1):
        again = keyed.join(twice, same).groupBy(i, k).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("row"))
        kept = kept.union(again.select("row.*"))
    return kept


def similar_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """All links: pairs a, b of classes of equal sets, each once, and the rows: id_col, n_shingles, cls, class_id.

    Every two classes that meet are compared in cells, also those of one component. The pairs are as
    many as there are links, so with the square of a crowd of texts that are all alike.
    """
    before = scratch_so_far()
    docs, signed, classes, crowd, met = _meet(docs, id_col, text_col)
    small = classes.drop("prefix", "n_hot")
    every = _members(met, crowd, F.lit(False)).withColumn("component", F.col("id"))
    found = materialise(_across(materialise(_parted(every), "parted"), small.select("cls", "bits"), False), "across")
    pairs = _verified(found, small, docs, "all")
    drop_since(before, signed, classes, pairs)
    named = small.select("n", "s0", "s1", "cls", F.col("id").alias("class_id"))
    rows = signed.select("id", "n", "s0", "s1").join(named, ["n", "s0", "s1"], "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "cls", "class_id")
    return pairs, rows


def link_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_shingles, n_links (other rows that a row is linked with, its copies among them) for every row."""
    pairs, rows = similar_pairs(docs, id_col, text_col)
    sizes = rows.where("cls IS NOT NULL").groupBy("cls").agg(F.count("*").alias("rows"))
    both = pairs.select("a", "b").union(pairs.select("b", "a")).toDF("cls", "other")
    linked = both.join(sizes.toDF("other", "others"), "other").groupBy("cls").agg(F.sum("others").alias("others"))
    counted = sizes.join(linked, "cls", "left").select("cls", (F.col("rows") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    return rows.join(counted, "cls", "left").select(id_col, "n_shingles", F.coalesce("n_links", F.lit(0)).alias("n_links"))
