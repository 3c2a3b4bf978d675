"""Time joins between sensors.

Nearest and bracketing joins are one union and windows over it: linear after a sort, where a
comparison join would be quadratic. The windows run within buckets of time, so one long sequence is
many tasks; what a bucket needs from beyond its ends are the last and first rows of other buckets, one
pair per bucket, which a window over the buckets brings in. The greedy one-to-one join leaves out rows
without a counterpart and cuts the others where no pair reaches across. Only these islands go through
Python, one after the other in sorted partitions: a task holds the stamps and names of one island, and
takes time in proportion to them (and a logarithm).
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from plumbline.functions import geometry as g
from plumbline.session import ship


#: Length of a time bucket; results don't depend on it.
BUCKET = 3600.0


def _sides(left: DataFrame, right: DataFrame, by: list[str], t: str, order: str, bucket: float) -> DataFrame:
    """Rows of both sides: by, _bucket, t, _order, l (struct, left rows), r (struct, right rows)."""
    one, two = F.struct(*left.columns), F.struct(*right.columns)
    a = left.select(*by, t, F.col(order).alias("_order"), one.alias("l"), F.lit(None).cast(right.select(two.alias("r")).schema["r"].dataType).alias("r"))
    b = right.select(*by, t, F.col(order).alias("_order"), F.lit(None).cast(left.select(one.alias("l")).schema["l"].dataType).alias("l"), two.alias("r"))
    return a.unionByName(b).withColumn("_bucket", F.floor(F.col(t) / bucket))


def _beyond(both: DataFrame, by: list[str], t: str, smallest_of_ties: bool) -> DataFrame:
    """by, _bucket, _before (last right row of earlier buckets), _after (first of later ones); of rows at one time the last is that with the largest order, or the smallest."""
    is_right = F.col("r").isNotNull()
    up = F.when(is_right, F.struct(t, "_order"))
    last = F.min_by("r", F.when(is_right, F.struct((-F.col(t)).alias("t"), "_order"))) if smallest_of_ties else F.max_by("r", up)
    ends = both.groupBy(*by, "_bucket").agg(last.alias("_last"), F.min_by("r", up).alias("_first"))
    along = W.partitionBy(*by).orderBy("_bucket")
    return ends.select(*by, "_bucket", F.last("_last", True).over(along.rowsBetween(W.unboundedPreceding, -1)).alias("_before"), F.first("_first", True).over(along.rowsBetween(1, W.unboundedFollowing)).alias("_after"))


def nearest(left: DataFrame, right: DataFrame, by: list[str], t: str, order: str, tolerance: float | None = None, inclusive: bool = False, bucket: float = BUCKET) -> DataFrame:
    """Each left row (struct l) with the right row nearest in time (struct r, null if none is within tolerance) and dt.

    Ties go to the earlier right row, then to the smaller ``order``.
    """
    both = _sides(left, right, by, t, order, bucket)
    part = W.partitionBy(*by, "_bucket")
    is_left = F.col("l").isNotNull()
    before = part.orderBy(t, is_left, F.desc("_order")).rowsBetween(W.unboundedPreceding, W.currentRow)
    # from here on: right rows at the same time are before this one already
    after = part.orderBy(t, is_left, "_order").rowsBetween(W.currentRow, W.unboundedFollowing)
    seen = both.withColumn("_p", F.last("r", True).over(before)).withColumn("_n", F.first("r", True).over(after)).where(is_left)
    seen = seen.join(_beyond(both, by, t, True), [*by, "_bucket"]).withColumn("_p", F.coalesce("_p", "_before")).withColumn("_n", F.coalesce("_n", "_after"))
    back, ahead = F.col(t) - F.col("_p")[t], F.col("_n")[t] - F.col(t)
    use_back = F.col("_n").isNull() | (F.col("_p").isNotNull() & (back <= ahead))
    picked = seen.withColumn("_r", F.when(use_back, F.col("_p")).otherwise(F.col("_n"))).withColumn("_dt", F.abs(F.col("_r")[t] - F.col(t)))
    near = F.lit(True) if tolerance is None else (F.col("_dt") <= tolerance) if inclusive else (F.col("_dt") < tolerance)
    return picked.select("l", F.when(near, F.col("_r")).alias("r"), F.when(near, F.col("_dt")).alias("dt"))


def nearest_by_median(left: DataFrame, right: DataFrame, by: list[str], t: str, order: str) -> DataFrame:
    """nearest(), accepting up to half the median distance of a key's left stamps; 1/60 for a single one."""
    gaps = left.select(*by, (F.col(t) - F.lag(t).over(W.partitionBy(*by).orderBy(t, order))).alias("gap"))
    limits = gaps.groupBy(*by).agg(F.coalesce(F.percentile("gap", F.lit(0.5)) / 2, F.lit(1 / 60)).alias("limit"))
    found = nearest(left, right, by, t, order)
    for k in by:
        found = found.withColumn(k, F.col("l")[k])
    near = F.col("dt") <= F.col("limit")
    return found.join(limits, by).select("l", F.when(near, F.col("r")).alias("r"), F.when(near, F.col("dt")).alias("dt"))


def bracket(left: DataFrame, right: DataFrame, by: list[str], t: str, order: str, max_dt: float, bucket: float = BUCKET) -> DataFrame:
    """Each left row (l) with the right rows around it (a before, b at or after) and the fraction u between them.

    A gap of more than twice max_dt gives neither. Before the first and after the last right row, that
    row is both a and b (u = 0) if it is within max_dt.
    """
    both = _sides(left, right, by, t, order, bucket)
    part = W.partitionBy(*by, "_bucket")
    is_right = F.col("r").isNotNull()
    order_by = part.orderBy(t, is_right, "_order")  # left rows first: a right row at the same time comes after
    seen = both.withColumn("_a", F.last("r", True).over(order_by.rowsBetween(W.unboundedPreceding, -1))).withColumn("_b", F.first("r", True).over(order_by.rowsBetween(1, W.unboundedFollowing)))
    seen = seen.where(F.col("l").isNotNull()).join(_beyond(both, by, t, False), [*by, "_bucket"])
    a, b = F.coalesce("_a", "_before"), F.coalesce("_b", "_after")
    inside = a.isNotNull() & b.isNotNull()
    edge = F.coalesce(a, b)
    near_edge = ~inside & (F.abs(edge[t] - F.col(t)) <= max_dt)
    bridged = inside & (b[t] - a[t] <= 2 * max_dt)
    span = b[t] - a[t]
    return seen.select(
        "l",
        F.when(bridged, a).when(near_edge, edge).alias("a"),
        F.when(bridged, b).when(near_edge, edge).alias("b"),
        F.when(bridged, F.when(span > 0, (F.col(t) - a[t]) / span).otherwise(0.0)).when(near_edge, 0.0).alias("u"),
    )


def last_before(left: DataFrame, right: DataFrame, by: list[str], at: str) -> DataFrame:
    """Each left row (l) with the last right row (r) whose ``at`` isn't beyond its own; null if there is none."""
    one, two = F.struct(*left.columns), F.struct(*right.columns)
    a = left.select(*by, at, one.alias("l"))
    both = a.unionByName(right.select(*by, at, two.alias("r")), allowMissingColumns=True)
    order = W.partitionBy(*by).orderBy(at, F.col("l").isNotNull()).rowsBetween(W.unboundedPreceding, W.currentRow)
    return both.withColumn("_r", F.last("r", True).over(order)).where(F.col("l").isNotNull()).select("l", F.col("_r").alias("r"))


def interpolated_pose(a: Column, b: Column, u: Column) -> tuple[g.Vector, g.Vector]:
    """(quaternion, translation) between two pose structs with array fields q_wxyz and tr."""
    return g.slerp(g.elements(a["q_wxyz"], 4), g.elements(b["q_wxyz"], 4), u), g.lerp(g.elements(a["tr"], 3), g.elements(b["tr"], 3), u)


def greedy_pairs(left: DataFrame, right: DataFrame, by: str, t: str, order: str, max_dt: float) -> DataFrame:
    """by, a, b (values of ``order``): pairs closer than max_dt, the closest first, each row used once.

    Rows without a key or a stamp pair with nothing; a null in ``order`` is the last of ties.
    """
    ship(left.sparkSession)
    both = left.select(by, t, F.col(order).alias("i"), F.lit(0).alias("side")).union(right.select(by, t, F.col(order), F.lit(1))).where(F.col(by).isNotNull() & F.col(t).isNotNull())
    is_left, stamps = F.col("side") == 0, [F.when(F.col("side") == side, F.col(t)) for side in (0, 1)]
    # both windows run from their start, which is linear; one that ends at the partition's end would be quadratic
    in_time, back = W.partitionBy(by).orderBy(t, "side", "i"), W.partitionBy(by).orderBy(F.desc(t), F.desc("side"), F.desc("i"))
    both = both.withColumns({f"_next{side}": F.min(stamps[side]).over(back.rowsBetween(W.unboundedPreceding, W.currentRow)) for side in (0, 1)})
    both = both.withColumns({f"_last{side}": F.max(stamps[side]).over(in_time.rowsBetween(W.unboundedPreceding, -1)) for side in (0, 1)})
    behind, ahead = F.when(is_left, F.col("_last1")).otherwise(F.col("_last0")), F.when(is_left, F.col("_next1")).otherwise(F.col("_next0"))
    near = (F.col(t) - behind < max_dt) | (ahead - F.col(t) < max_dt)
    across = (F.col("_next1") - F.col("_last0") < max_dt) | (F.col("_next0") - F.col("_last1") < max_dt)
    rows = both.withColumn("new", ~F.coalesce(across, F.lit(False))).where(near).withColumn("island", F.sum(F.col("new").cast("int")).over(in_time))
    rows = rows.select(by, t, "i", "side", "new", "island").repartition(by, "island").sortWithinPartitions(by, "island", t, "side", "i")
    return rows.mapInArrow(_greedy(by, t, max_dt), f"{by} {left.schema[by].dataType.simpleString()}, a bigint, b bigint")


def closest_first(left: list[tuple[float, int]], right: list[tuple[float, int]], max_dt: float) -> list[tuple[int, int]]:
    """Pairs of names of stamped rows (t, name), the closest first, ties by name; each row once, all closer than max_dt.

    The closest pair that is left always stands side by side in time, as whatever stood between would
    be closer still. So only neighbours wait in a heap, and a pair that goes brings its neighbours
    together. Rows of one side at one time are one node.
    """
    nodes: dict[tuple[float, int], list[int]] = {}
    for side, rows in enumerate((left, right)):
        for t, name in rows:
            nodes.setdefault((t, side), []).append(name)
    order = sorted(nodes)
    waiting = [sorted(nodes[k], reverse=True) for k in order]  # the smallest name last
    before, after = list(range(-1, len(order) - 1)), [*range(1, len(order)), -1]
    heap: list[tuple] = []

    def offer(x: int, y: int) -> None:
        if x < 0 or y < 0 or order[x][1] == order[y][1]:
            return
        a, b = (x, y) if order[x][1] == 0 else (y, x)
        dt = abs(order[x][0] - order[y][0])
        if dt < max_dt:
            heapq.heappush(heap, (dt, waiting[a][-1], waiting[b][-1], a, b))

    for x in range(len(order) - 1):
        offer(x, x + 1)
    out = []
    while heap:
        _, i, j, a, b = heapq.heappop(heap)
        if not waiting[a] or not waiting[b] or waiting[a][-1] != i or waiting[b][-1] != j or (after[a] != b and before[a] != b):
            continue  # one of them has gone, or been joined by another since
        out.append((i, j))
        for x in (a, b):
            waiting[x].pop()
        for x in (a, b):
            if not waiting[x]:
                p, n = before[x], after[x]
                if p >= 0:
                    after[p] = n
                if n >= 0:
                    before[n] = p
                offer_pair = (p, n)
                if all(v >= 0 and waiting[v] for v in offer_pair):
                    offer(*offer_pair)
        for x in (a, b):
            if waiting[x]:
                for y in (before[x], after[x]):
                    if y >= 0 and waiting[y]:
                        offer(x, y)
    return out


def _greedy(by: str, t: str, max_dt: float):
    """Pairs of sorted rows; an island begins where new is true, and may go on in the next batch."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, key, sides, out = None, None, ([], []), []

        def close() -> None:
            for a, b in closest_first(*sides, max_dt):
                out.append((key, None if a == math.inf else a, None if b == math.inf else b))

        def found() -> pa.RecordBatch:
            columns = zip(*out, strict=True) if out else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(c, of) for c, of in zip(columns, (kind, pa.int64(), pa.int64()), strict=True)], [by, "a", "b"])

        for rows in batches:
            kind = rows.schema.field(by).type
            for k, stamp, name, side, new in zip(*(rows.column(c).to_pylist() for c in (by, t, "i", "side", "new")), strict=True):
                if new:
                    close()
                    key, sides = k, ([], [])
                sides[side].append((stamp, math.inf if name is None else name))
            yield found()
            out.clear()
        close()
        if out:
            yield found()

    return pairs


def filled_forward(value: Column, by: list[str], order: str, default) -> Column:
    """The value, or the last one before it, or the default."""
    return F.coalesce(F.last(value, True).over(W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)), F.lit(default))
