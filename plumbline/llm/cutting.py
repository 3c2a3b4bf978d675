"""Numbering documents in order, and removing byte spans from their texts, for the operators that find repeats."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.shared import as_bytes, materialise

RESULT = "struct<n_bytes:bigint,n_removed:bigint,n_spans:bigint,kept:binary>"


def in_order(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, doc, text of every row; doc orders documents and tells them apart.

    Where ids are distinct and not null, doc is the id. Else rows are ordered by id (null last), then
    by a hash of the text; rows alike in both are one document, given more than once.
    """
    own = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    if not own.groupBy("id").agg(F.count("*").alias("n")).where("n > 1 OR id IS NULL").head(1):
        return own.select("id", F.col("id").alias("doc"), "text")
    keyed = own.withColumn("key", F.xxhash64("text"))
    # numbers rise with the partitions of a range sort, and within them
    numbers = keyed.select("id", "key").distinct().orderBy(F.col("id").asc_nulls_last(), "key").select(F.col("id").alias("of"), F.col("key").alias("its_key"), F.monotonically_increasing_id().alias("doc"))
    numbers = materialise(numbers, "documents")
    return keyed.join(numbers, F.col("id").eqNullSafe(F.col("of")) & (F.col("key") == F.col("its_key"))).select("id", "doc", "text")


def remove_spans(text: bytes, begins: list[int], ends: list[int]) -> tuple[int, int, bytes]:
    """(bytes removed, maximal removed runs, what stays) for spans in any order, overlapping or not."""
    removed, runs, parts, at, last = 0, 0, [], 0, -1
    for a, b in sorted(zip(begins, ends, strict=True)):
        if a > last:
            runs += 1
            parts.append(text[at:a])
            removed += b - a
            at = last = b
        elif b > last:
            removed += b - last
            at = last = b
    parts.append(text[at:])
    return removed, runs, b"".join(parts)


def cut_all(texts: list[bytes], begins: list[list[int] | None], ends: list[list[int] | None]) -> pa.Array:
    """RESULT of each text without its spans."""
    got = [remove_spans(t, x or [], y or []) for t, x, y in zip(texts, begins, ends, strict=True)]
    return pa.StructArray.from_arrays(
        [pa.array(np.array([len(t) for t in texts], np.int64)), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.binary())],
        ["n_bytes", "n_removed", "n_spans", "kept"],
    )


def _cut(text: Column, begins: Column, ends: Column) -> Column:
    @F.arrow_udf(RESULT)
    def cut(texts: pa.Array, a: pa.Array, b: pa.Array) -> pa.Array:
        return cut_all(as_bytes(texts), a.to_pylist(), b.to_pylist())

    return cut(text, begins, ends)


def without_spans(own: DataFrame, spans: DataFrame, id_col: str) -> DataFrame:
    """id_col and the fields of RESULT for each row of in_order(); spans: doc, start, end in bytes, any number per document."""
    grouped = spans.groupBy("doc").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    joined = own.join(grouped, "doc", "left")
    return joined.select(F.col("id").alias(id_col), _cut(F.col("text"), F.col("spans.start"), F.col("spans.end")).alias("cut")).select(id_col, "cut.*")
