"""Mixing sources to target weights along a time-varying curriculum, in DataFrame operations only.

Each source has a weight and a schedule: its relative rate at training time 0 and at time 1, linear
between. Shares of all words are found by water filling: no source gives more than ``max_repeats``
times its size, and what it cannot give is shared by weight among the rest. A source's documents are
put in a repeatable pseudo-random order; the mix takes whole passes over that order and then a last,
partial one. Integrating a source's schedule gives its cumulative demand for words; inverting that at
the middle of each document's words gives the document's training position, by which the result is
range-sorted.

Running sums within a source go through hash buckets and groups of buckets (sums per group, per bucket
in each group, then within each bucket), so a source with a third of all rows is spread over many
tasks and none of the three steps sees more than about the square root of its buckets. The per-source
table has one row for each source, is sorted in one task and joined under Spark's own size check.

Null text: size 0; texts of any length are counted whole. Null source: a source of its own, last in
the order. Documents of size 0 are returned with taken 0. Repeated and null ids: every row is a
document of its own, in order of text hash; rows alike in all columns may be taken differently often.
Ties of the draw go by id, then by text hash. Extra columns are ignored, and carried by
mixed_documents whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from plumbline.llm.shared import materialise, unused

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
#: Relative rate of a source at the start and at the end, repeating over the sources like the weights.
SCHEDULES = ((1.0, 1.0), (0.5, 1.5), (1.5, 0.5))
MAX_REPEATS = 3
#: Documents per hash bucket of a source, roughly; the number of buckets grows with the table.
BUCKET_ROWS = 512


def _cycle(rank: Column, values) -> Column:
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), (F.pmod(rank - 1, F.lit(len(values))) + 1).cast("int"))


def source_targets(sizes: DataFrame, weights=WEIGHTS, schedules=SCHEDULES, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(no_source, source, source_size) to the same with target, rate0 and rate1; one row per source.

    Water filling in closed form: in order of size over weight, a source is filled to its limit if at
    the level reached there the sources before it, full, and the rest, by weight, would still not use
    up the total.
    """
    by_name = W.orderBy("no_source", "source")
    by_ratio = W.orderBy("ratio", "no_source", "source")
    everything = W.partitionBy()
    ranked = (
        sizes.withColumn("n", F.row_number().over(by_name))
        .withColumn("weight", _cycle(F.col("n"), weights))
        .withColumn("rate0", _cycle(F.col("n"), [a for a, _ in schedules]))
        .withColumn("rate1", _cycle(F.col("n"), [b for _, b in schedules]))
        .withColumn("most", F.lit(float(max_repeats)) * F.col("source_size"))
        .withColumn("ratio", F.col("most") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything).cast("double"))
    )
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(0, W.unboundedFollowing)
    return (
        ranked.withColumn("left", F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
        .withColumn("level", F.col("left") / F.sum("weight").over(onward))
        .withColumn("full", F.col("level") > F.col("ratio"))
        .withColumn("open_level", F.min(F.when(~F.col("full"), F.struct("ratio", "level"))).over(everything)["level"])
        .withColumn("target", F.when(F.col("full"), F.col("most")).otherwise(F.least(F.col("most"), F.col("weight") * F.coalesce("open_level", F.lit(0.0)))))
        .select("no_source", "source", "source_size", "target", "rate0", "rate1")
    )


def _inverse_share(share: Column, rate0: Column, rate1: Column) -> Column:
    """The time at which a linear rate has served this share of its whole demand."""
    mean = (rate0 + rate1) / 2
    slope = rate1 - rate0
    served = share * mean
    # rate0 t + slope t^2 / 2 = served, in the form that stays exact for a flat schedule
    return F.coalesce(F.try_divide(2 * served, rate0 + F.sqrt(F.greatest(rate0 * rate0 + 2 * slope * served, F.lit(0.0)))), F.lit(0.0))


def mix(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """id_col, size, source_size, target, taken, passes, position (words of training at its first use; null if none), sorted by position.

    The last pass ends in the middle of one document of each source, which is taken in part; with
    ``whole_documents`` it is taken whole if more than half of it would be.
    """
    return placed(docs, id_col, **options).select(id_col, "size", "source_size", "target", "taken", "passes", "position").orderBy("position", id_col)


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The mix itself: the rows of docs, each as often as it is taken, in order of training position."""
    key, at = unused(docs, "key"), unused(docs, "at")
    keyed = docs.withColumn(key, F.xxhash64(*docs.columns))
    # rows alike in all columns stand for one another: their places are told by id and key
    taken = placed(keyed, id_col, key_col=key, whole_documents=True, **options)
    taken = materialise(taken.select(F.col(id_col).alias("p_id"), F.col("key").alias("p_key"), "taken", "passes", "middle", "source_size", "target", "rate0", "rate1", "total_words"), "mix")
    uses = taken.where("taken > 0").select("*", F.explode(F.sequence(F.lit(0), F.round("passes").cast("int") - 1)).alias("use"))
    position = _inverse_share(F.least(F.lit(1.0), (F.col("use") * F.col("source_size") + F.col("middle")) / F.col("target")), F.col("rate0"), F.col("rate1")) * F.col("total_words")
    uses = uses.select(F.col("p_id").alias(i := unused(docs, "p_id")), F.col("p_key").alias(k := unused(docs, "p_key")), position.alias(at))
    twice = taken.groupBy("p_id", "p_key").agg(F.count("*").alias("rows")).where("rows > 1").select(F.col("p_id").alias(i), F.col("p_key").alias(k))
    same = F.col(id_col).eqNullSafe(F.col(i)) & (F.col(key) == F.col(k))
    own = keyed
    if twice.head(1):
        again = keyed.join(twice, same, "left_semi").groupBy(id_col, key).agg(F.any_value(F.struct(*keyed.columns)).alias("row")).select("row.*")
        own = keyed.join(twice, same, "left_anti").unionByName(again)
    return own.join(uses, same).orderBy(at, id_col, key).select(*docs.columns)


def placed(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights=WEIGHTS,
    schedules=SCHEDULES,
    max_repeats: int = MAX_REPEATS,
    seed: int = 17,
    whole_documents: bool = False,
    key_col: str | None = None,
) -> DataFrame:
    """What mix() returns and how each position came about, unsorted; with key_col, that column as ``key``."""
    sized = docs.select(
        F.col(id_col),
        F.col(source_col).isNull().alias("no_source"),
        F.coalesce(F.col(source_col), F.lit("")).alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.col(id_col), F.lit(seed)).alias("draw"),
        F.xxhash64(F.col(text_col)).alias("tie"),
        (F.lit(None).cast("bigint") if key_col is None else F.col(key_col)).alias("key"),
    )
    # one aggregate gives the sizes of buckets, and these the sizes of groups and sources: the texts are read once for it
    rows = F.greatest(F.lit(16), F.ceil(F.lit(_row_estimate(docs)) / BUCKET_ROWS)).cast("long")
    sized = sized.withColumn("bucket", F.pmod(F.shiftrightunsigned("draw", 1), rows))
    buckets = materialise(sized.groupBy("no_source", "source", "bucket").agg(F.sum("size").alias("bucket_size")), "mix-buckets")
    grouped = buckets.withColumn("group", F.floor(F.col("bucket") / F.ceil(F.sqrt(rows))))
    groups = grouped.groupBy("no_source", "source", "group").agg(F.sum("bucket_size").alias("group_size"))
    before_it = lambda size, order, *by: F.coalesce(F.sum(size).over(W.partitionBy("no_source", "source", *by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    group_starts = groups.withColumn("group_start", before_it("group_size", "group")).drop("group_size")
    starts = grouped.withColumn("in_group", before_it("bucket_size", "bucket", "group")).join(group_starts, ["no_source", "source", "group"])
    starts = starts.select("no_source", "source", "bucket", (F.col("group_start") + F.col("in_group")).alias("bucket_start"))
    targets = source_targets(buckets.groupBy("no_source", "source").agg(F.sum("bucket_size").alias("source_size")), weights, schedules, max_repeats)
    in_bucket = W.partitionBy("no_source", "source", "bucket").orderBy("draw", id_col, "tie", "key").rowsBetween(W.unboundedPreceding, -1)
    passes = F.floor(F.try_divide("target", F.col("source_size"))).cast("long")
    rest = F.floor(F.col("target") - F.col("full_passes") * F.col("source_size") + F.lit(1e-6)).cast("long")
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - F.col("before")))
    if whole_documents:
        part = F.when(2 * part > F.col("size"), F.col("size")).otherwise(F.lit(0).cast("long"))
    middle = F.col("before") + F.least(F.col("size"), F.greatest(F.col("taken"), F.lit(1))) / 2
    share = F.coalesce(F.least(F.lit(1.0), F.try_divide(F.col("middle"), F.col("target"))), F.lit(0.0))
    every = F.col("total_words")
    return (
        sized.withColumn("in_bucket", F.coalesce(F.sum("size").over(in_bucket), F.lit(0)))
        .join(starts, ["no_source", "source", "bucket"])
        .join(targets.withColumn("total_words", F.sum("source_size").over(W.partitionBy())), ["no_source", "source"])
        .withColumn("before", F.col("bucket_start") + F.col("in_bucket"))
        .withColumn("full_passes", F.coalesce(passes, F.lit(0).cast("long")))
        .withColumn("taken", F.least(max_repeats * F.col("size"), F.col("full_passes") * F.col("size") + part))
        .withColumn("passes", F.coalesce(F.try_divide(F.col("taken").cast("double"), F.col("size")), F.lit(0.0)))
        .withColumn("middle", middle.cast("double"))
        .withColumn("position", F.when(F.col("taken") > 0, _inverse_share(share, F.col("rate0"), F.col("rate1")) * every))
    )


def _row_estimate(docs: DataFrame) -> int:
    """Rows of the table; a count that reads no column of Parquet."""
    return docs.count()
