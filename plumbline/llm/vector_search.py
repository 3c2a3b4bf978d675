"""Nearest neighbours by cosine with vantage-point trees, one per shard, and one that deals out the shards.

On unit vectors the distance sqrt(2 - 2 cos) is a metric. A node of a tree holds a vantage point and
the median distance to it; one child holds what is nearer, the other the rest. A query first goes
down to one leaf, whose vectors bound its k-th distance t; then it visits every child that the
triangle inequality doesn't exclude: those with |d - median| <= factor * t on the far side. Factor 1
is exact search; smaller factors prune more. Equal distances can't be split, so copies of one vector
stay together in a leaf of any size.

The same holds between shards. A tree over a sample of at most ``ROUTER_ROWS`` vectors gives each row
of the table its leaf; a leaf of more than ``SHARD_BYTES`` is several shards, by hash of the id. Each
query visits its own leaf first, and in a second round only the leaves that its bound still reaches.
Of copies of one vector only the k + 1 with the smallest ids are candidates, as no other can be among
the k nearest. A task holds one shard and reads its queries in blocks of ``BLOCK_ROWS``; beyond
``SHARD_QUERIES`` queries in all, shards are copied and the queries shared out. What a task holds
therefore doesn't grow with the table.

Each shard returns its k best per query, and these are merged by query. Scores are computed in double
precision from the original vectors, scaled by a power of two against over- and underflow, in one
fixed order of summation, so copies tie exactly; ties go to the smaller id.

Vectors that are null, zero, or hold null or non-finite components take no part, neither as query
nor as candidate, and rows with a null id neither. Rows with equal ids are one candidate each; each
query row has results of its own, in which no row with its id is a candidate. Vectors of another
length than the query's are not compared. An empty table gives an empty result. Extra columns are
ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from plumbline.llm.shared import arrow_limits, materialise

NEIGHBOURS = 5
QUERY_EVERY = 50
#: Share of the exact search radius that is visited. Recall is measured in the tests.
FACTOR = 0.9
#: Vectors of a shard, in double precision.
SHARD_BYTES = 8 << 20
#: Rows that the dealing tree is fitted on, at most.
ROUTER_ROWS = 16384
SHARD_QUERIES = 1 << 18
BLOCK_ROWS = 1024
LEAF_ROWS = 256
#: What rounding may add to a distance near 0.
_SLACK = 1e-7


def usable(vector: Column) -> Column:
    numbers = F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))
    return numbers & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))


def scaled(rows: np.ndarray) -> np.ndarray:
    """Each row times a power of two that brings its largest component near 1; ratios stay exact."""
    _, exponent = np.frexp(np.abs(rows).max(axis=1))
    return np.ldexp(rows, -exponent[:, None])


def unit(rows: np.ndarray) -> np.ndarray:
    rows = scaled(rows)
    return rows / np.sqrt((rows * rows).sum(axis=1))[:, None]


def matrices(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, vectors) of each length in a list array."""
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.r_[0, np.cumsum(lengths)[:-1]] if len(lengths) else lengths
    for n in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == n)
        yield rows, flat[starts[rows][:, None] + np.arange(n)]


def _distance(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * cosine))


class VantageTree:
    def __init__(self, unit: np.ndarray, leaf_rows: int = LEAF_ROWS):
        self.unit, self.nodes = unit, []
        rng = np.random.default_rng(0)
        self.root = self._build(np.arange(len(unit)), rng, leaf_rows)

    def _build(self, rows: np.ndarray, rng, leaf_rows: int) -> int:
        """Iterative, so depth is no limit."""
        self.nodes = [None]
        work = [(0, rows)]
        while work:
            at, rows = work.pop()
            if len(rows) > leaf_rows:
                vantage = int(rows[rng.integers(len(rows))])
                d = _distance(self.unit[rows] @ self.unit[vantage])
                middle = float(np.median(d))
                near = d <= middle
                if near.all():
                    near = d < middle
                if near.any() and not near.all():
                    low, high = len(self.nodes), len(self.nodes) + 1
                    self.nodes += [None, None]
                    self.nodes[at] = (vantage, float(d[near].max()), float(d[~near].min()), low, high)
                    work += [(low, rows[near]), (high, rows[~near])]
                    continue
            self.nodes[at] = rows
        return 0

    def search(self, queries: np.ndarray, factor: float, bound: np.ndarray, scan) -> None:
        """scan(query numbers, rows) sees each leaf that a query visits and returns those queries' k-th distances; bound: those known before."""
        count, bound = len(queries), bound.copy()
        home = np.zeros(count, np.int64)
        for descend in (True, False):
            work = [(0, np.arange(count))]
            while work:
                at, who = work.pop()
                node = self.nodes[at]
                if isinstance(node, np.ndarray):
                    if descend:
                        home[who] = at
                    else:
                        who = who[home[who] != at]
                    if len(who):
                        bound[who] = np.minimum(bound[who], scan(who, node))
                    continue
                vantage, inner, outer, low, high = node
                d = _distance(queries[who] @ self.unit[vantage])
                first_low = d <= (inner + outer) / 2
                if descend:
                    sides = ((low, first_low), (high, ~first_low))
                else:
                    t = factor * bound[who] + _SLACK
                    sides = ((low, d - inner <= t), (high, outer - d <= t))
                for child, chosen in sides:
                    if chosen.any():
                        work.append((child, who[chosen]))


class Router:
    """A vantage-point tree whose leaves are numbered; each vector belongs to one."""

    def __init__(self, sample: np.ndarray, leaves: int):
        rng = np.random.default_rng(1)
        self.vantage: list[np.ndarray] = []
        self.middle: list[float] = []
        self.children: list[list[int]] = []  # of a node: another node, or -1 - leaf
        done = 0
        open_: list[tuple] = [(-len(sample), 0, None, np.arange(len(sample)))]  # the largest first
        tie = 0
        while open_:
            _, _, parent, rows = heapq.heappop(open_)
            split = None
            if done + len(open_) + 1 < leaves and len(rows) > 1:
                vantage = sample[rows[rng.integers(len(rows))]]
                d = _distance(sample[rows] @ vantage)
                middle = float(np.median(d))
                near = d <= middle
                if near.all():
                    middle = float(np.nextafter(middle, 0))
                    near = d <= middle
                split = near if near.any() and not near.all() else None
            if split is None:
                at, done = -1 - done, done + 1
            else:
                at = len(self.vantage)
                self.vantage.append(vantage)
                self.middle.append(middle)
                self.children.append([0, 0])
                for side, part in enumerate((rows[split], rows[~split])):
                    tie += 1
                    heapq.heappush(open_, (-len(part), tie, (at, side), part))
            if parent is not None:
                self.children[parent[0]][parent[1]] = at
        self.leaves = done

    def visited(self, units: np.ndarray, bound: np.ndarray | None = None) -> list[list[int]]:
        """Leaves of each vector: its own (no bound), or all within bound of it."""
        out: list[list[int]] = [[] for _ in units]
        work = [(0 if self.vantage else -1, np.arange(len(units)))]
        while work:
            at, who = work.pop()
            if at < 0:
                for i in who.tolist():
                    out[i].append(-1 - at)
                continue
            d = _distance(units[who] @ self.vantage[at])
            if bound is None:
                low = d <= self.middle[at]
                sides = (low, ~low)
            else:
                sides = (d - self.middle[at] <= bound[who], self.middle[at] - d <= bound[who])
            work += [(child, who[chosen]) for child, chosen in zip(self.children[at], sides, strict=True) if chosen.any()]
        return out


def best_in_shard(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, factor: float, tree: VantageTree | None = None, known: np.ndarray | None = None):
    """(query number, id, score) arrays of the k best of a shard for each query; known: scores that a k-th best already has."""
    vectors, queries = scaled(vectors), scaled(queries)
    norms, query_norms = np.sqrt((vectors * vectors).sum(axis=1)), np.sqrt((queries * queries).sum(axis=1))
    tree = tree or VantageTree(vectors / norms[:, None])
    asked = queries / query_norms[:, None]
    known = np.full(len(queries), -np.inf) if known is None else known
    found: list[list[tuple[float, int]]] = [[] for _ in queries]

    def scan(who: np.ndarray, rows: np.ndarray) -> np.ndarray:
        close = asked[who] @ tree.unit[rows].T
        out = np.empty(len(who))
        for n, q in enumerate(who.tolist()):
            row = close[n]
            mine = np.flatnonzero(ids[rows] != query_ids[q])
            least = known[q]
            if len(mine) > k:
                least = max(least, np.partition(row[mine], len(mine) - k)[len(mine) - k])
            if len(found[q]) == k:
                least = max(least, -found[q][-1][0])
            mine = mine[row[mine] >= least - 1e-9]
            if len(mine):
                at = rows[mine]
                score = (vectors[at] * queries[q]).sum(axis=1) / (norms[at] * query_norms[q])
                found[q] = sorted([*found[q], *zip((-score).tolist(), ids[at].tolist(), strict=True)])[:k]
            out[n] = np.inf if len(found[q]) < k else float(_distance(np.array(-found[q][-1][0])))
        return out

    tree.search(asked, factor, np.where(np.isfinite(known), _distance(np.where(np.isfinite(known), known, 0.0)), np.inf), scan)
    kept = [[x for x in f if -x[0] >= known[q]] for q, f in enumerate(found)]
    return (
        np.repeat(np.arange(len(queries)), [len(x) for x in kept]),
        np.array([i for x in kept for _, i in x], np.int64),
        np.array([-s for x in kept for s, _ in x], np.float64),
    )


_SHARD = ["length", "leaf", "sub", "rep"]
_FOUND = "q bigint, query_id bigint, id bigint, score double"


def _search(k: int, factor: float):
    """Rows of shards (side 0: vectors, then side 1: queries), sorted, to each query's best in the shard. Holds one shard and a block of queries."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple | None = None
        own: list[tuple[np.ndarray, np.ndarray]] = []
        asked: list[tuple] = []
        shard: tuple | None = None

        def answer() -> pa.RecordBatch:
            nonlocal shard
            if shard is None:
                ids, rows = (np.concatenate(c) for c in zip(*own, strict=True))
                shard = (ids, rows, VantageTree(unit(rows)))
                own.clear()
            ids, numbers, known, rows = (np.concatenate(c) for c in zip(*asked, strict=True))
            asked.clear()
            at, near, score = best_in_shard(shard[0], shard[1], ids, rows, k, factor, shard[2], known)
            return pa.RecordBatch.from_arrays([pa.array(numbers[at]), pa.array(ids[at]), pa.array(near), pa.array(score)], ["q", "query_id", "id", "score"])

        for batch in batches:
            names = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            keys = [names[c].to_numpy(zero_copy_only=False) for c in _SHARD]
            if not len(keys[0]):
                continue
            side, ids, q, known = (names[c].to_numpy(zero_copy_only=False) for c in ("side", "id", "q", "known"))
            new = np.zeros(len(side), bool)
            for c in (*keys, side):
                new[1:] |= c[1:] != c[:-1]
            starts = [0, *np.flatnonzero(new).tolist(), len(new)]
            for a, b in zip(starts, starts[1:], strict=False):
                if (here := tuple(c[a] for c in keys)) != key:
                    if asked and (own or shard):
                        yield answer()
                    own, asked, shard, key = [], [], None, here
                rows = next(matrices(names["v"][a:b]))[1]
                if side[a] == 0:
                    own.append((ids[a:b], rows))
                elif own or shard:
                    for x in range(0, len(rows), BLOCK_ROWS):
                        y = min(x + BLOCK_ROWS, len(rows))
                        asked.append((ids[a + x : a + y], q[a + x : a + y], known[a + x : a + y], rows[x:y]))
                        if sum(len(z[0]) for z in asked) >= BLOCK_ROWS:
                            yield answer()
        if asked and (own or shard):
            yield answer()

    return search


def _routers(clean: DataFrame, shard_bytes: int) -> dict[int, Router]:
    """A dealing tree for each length of vector in a bounded sample."""
    drawn = clean.orderBy(F.xxhash64("id"), "id").limit(ROUTER_ROWS).select("v").toArrow().column("v").combine_chunks()
    rows = clean.count()
    out = {}
    for at, some in matrices(drawn):
        distinct = np.unique(unit(some), axis=0)
        wanted = -(-rows * len(at) * some.shape[1] * 8 // (len(drawn) * shard_bytes))
        out[some.shape[1]] = Router(distinct, min(wanted, max(1, len(distinct) // 8)))
    return out


def nearest(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    query_every: int = QUERY_EVERY,
    k: int = NEIGHBOURS,
    factor: float = FACTOR,
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """query_id, rank, id_col, score: each query's k nearest rows, nearest first."""
    spark = vectors.sparkSession
    arrow_limits(spark)
    vector = F.col(vector_col)
    if vectors.schema[vector_col].dataType.elementType != T.FloatType():
        vector = vector.cast("array<double>")
    clean = vectors.select(F.col(id_col).cast("bigint").alias("id"), vector.alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))
    asked = materialise(clean.where(F.pmod("id", F.lit(query_every)) == 0).select(F.monotonically_increasing_id().alias("q"), "id", "v", F.size("v").alias("length")), "queries")
    routers = spark.sparkContext.broadcast(_routers(clean, shard_bytes))

    def leaves(batch: pa.Array, bound: np.ndarray | None) -> pa.Array:
        out: list[list[int]] = [[0]] * len(batch)
        for at, rows in matrices(batch):
            if rows.shape[1] in routers.value:
                found = routers.value[rows.shape[1]].visited(unit(rows), None if bound is None else bound[at])
                for i, x in zip(at.tolist(), found, strict=True):
                    out[i] = x
        return pa.array(out, pa.list_(pa.int32()))

    @F.arrow_udf("array<int>")
    def home(batch: pa.Array) -> pa.Array:
        return leaves(batch, None)

    @F.arrow_udf("array<int>")
    def reached(batch: pa.Array, known: pa.Array) -> pa.Array:
        score = known.to_numpy(zero_copy_only=False).astype(np.float64)
        some = np.isfinite(score)
        return leaves(batch, np.where(some, factor * _distance(np.where(some, score, 0.0)) + _SLACK, np.inf))

    copies = W.partitionBy("v").orderBy("id")
    few = clean.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k + 1)
    dealt = materialise(few.select("id", "v", F.size("v").alias("length"), F.element_at(home(F.col("v")), 1).alias("leaf")), "vectors")
    reps = max(1, -(-asked.count() // SHARD_QUERIES))
    shape = dealt.groupBy("length", "leaf").agg(F.ceil(F.count("*") * F.col("length") * 8 / shard_bytes).cast("int").alias("subs"))
    shape = materialise(shape, "shards")
    shards = dealt.join(shape, ["length", "leaf"]).select(
        "length", "leaf", F.pmod(F.xxhash64("id"), F.col("subs")).cast("int").alias("sub"), F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"), F.lit(0).alias("side"), "id", F.lit(0).cast("bigint").alias("q"), F.lit(0.0).alias("known"), "v"
    )

    def visit(queries: DataFrame) -> DataFrame:
        """queries: q, id, v, known, length, leaf."""
        sent = queries.join(shape, ["length", "leaf"]).select(
            "length", "leaf", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)).alias("sub"), F.pmod(F.xxhash64("q"), F.lit(reps)).cast("int").alias("rep"), F.lit(1).alias("side"), "id", "q", "known", "v"
        )
        both = shards.unionByName(sent).repartition(*_SHARD).sortWithinPartitions(*_SHARD, "side")
        return both.mapInArrow(_search(k, factor), _FOUND)

    best = W.partitionBy("q").orderBy(F.desc("score"), "id")
    ranked = lambda found: found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    first = materialise(ranked(visit(asked.select("q", "id", "v", "length", F.element_at(home(F.col("v")), 1).alias("leaf"), F.lit(float("-inf")).alias("known")))), "near")
    known = first.groupBy("q").agg(F.max(F.when(F.col("rank") == k, F.col("score"))).alias("known"))
    bounded = asked.join(known, "q", "left").select("q", "id", "v", "length", F.coalesce("known", F.lit(float("-inf"))).alias("known"))
    again = bounded.withColumn("home", F.element_at(home(F.col("v")), 1)).withColumn("leaf", F.explode(reached(F.col("v"), F.col("known")))).where("leaf <> home")
    found = first.drop("rank").unionByName(visit(again.select("q", "id", "v", "length", "leaf", "known")))
    return ranked(found).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")
