"""Signal planes: dense 16-bit planes as binaries, exploded pixels, resampling and summaries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.session import ship

#: Share of memory above which planes are written one at a time, and bytes of a display pixel.
STREAM_FRACTION, PIXEL_BYTES = 0.25, 4


def should_stream(frames: int, width: int, height: int, streams: int, memory: int, fraction: float = STREAM_FRACTION) -> bool:
    """Whether a capture's pixels would take more than a share of memory."""
    return frames * width * height * PIXEL_BYTES * streams > fraction * memory


def pixels(planes: DataFrame) -> DataFrame:
    """planes (seq_id, i, signal_id, w, h, codes: little-endian 16 bits) to one row per pixel: seq_id, i, signal_id, u, v, raw."""
    ship(planes.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for seq, i, signal, w, h, codes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = np.frombuffer(codes, "<u2")
                if len(raw) != w * h:
                    raise ValueError(f"{seq}, frame {i}: {len(raw)} codes, {w} x {h} pixels")
                p = np.arange(len(raw))
                yield pa.RecordBatch.from_arrays([pa.array([seq] * len(raw)), pa.array(np.full(len(raw), i)), pa.array([signal] * len(raw)), pa.array((p % w).astype(np.int32)), pa.array((p // w).astype(np.int32)), pa.array(raw.astype(np.int32))], ["seq_id", "i", "signal_id", "u", "v", "raw"])

    return planes.select("seq_id", F.col("i").cast("bigint"), "signal_id", F.col("w").cast("int"), F.col("h").cast("int"), "codes").mapInArrow(rows, "seq_id string, i bigint, signal_id string, u int, v int, raw int")


def _seen(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def box_downsample(values: DataFrame, by: list[str], factor: int, value: str = "value") -> DataFrame:
    """Mean of each block of pixels; NaN is left out, and a block of nothing else is NaN."""
    cells = values.groupBy(*by, F.floor(F.col("u") / factor).cast("int").alias("u"), F.floor(F.col("v") / factor).cast("int").alias("v"))
    return cells.agg(F.coalesce(F.avg(_seen(F.col(value))), F.lit(float("nan"))).alias(value))


def coverage(values: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """covered (share of pixels with a value), least and most of the rest."""
    v = _seen(F.col(value))
    return values.groupBy(*by).agg((F.count(v) / F.count("*")).alias("covered"), F.min(v).alias("least"), F.max(v).alias("most"))


def near_far(values: DataFrame, by: list[str], value: str = "value", default: tuple[float, float] = (0.1, 10.0), margin: float = 0.05) -> DataFrame:
    """Depth range that holds the finite positive values with a margin (5 %); without one, the range itself."""
    v = F.col(value)
    use = F.when(~F.isnan(v) & (v > 0) & (v < float("inf")), v)
    near = F.greatest(F.lit(0.05), F.min(use) * (1 - margin))
    far = F.greatest(2 * near, F.max(use) * (1 + margin)) if margin else F.max(use)
    return values.groupBy(*by).agg(F.coalesce(near, F.lit(default[0])).alias("near"), F.coalesce(far, F.lit(default[1])).alias("far"))
