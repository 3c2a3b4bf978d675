"""What the corpus operators share: scratch tables, Arrow batches, text helpers."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from plumbline.session import ship

#: Upper bound of one Arrow batch sent to a Python worker, and of the slices worked on at once.
BATCH_BYTES = 4 << 20
SLICE_BYTES = 1 << 20

_scratch: dict[str, SparkSession] = {}


def arrow_limits(spark: SparkSession) -> None:
    """Keep Python workers small: long documents make large batches otherwise."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2048")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a local one only where none is configured and all runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        import tempfile

        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="plumbline-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _delete_all() -> None:
    for path, spark in list(_scratch.items()):
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the JVM may be gone at exit
            pass


atexit.register(_delete_all)


def release(spark: SparkSession) -> None:
    """Let Spark drop shuffle files that nothing refers to any more."""
    gc.collect()
    spark._jvm.System.gc()


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, and survives a lost executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/plumbline/{label}-{uuid.uuid4().hex}"
    _scratch[path] = spark
    df.write.parquet(path)
    schema = df.schema
    del df
    release(spark)
    return spark.read.schema(schema).parquet(path)


def drop_scratch(*tables: DataFrame) -> None:
    """Delete tables written by materialise() that nothing needs any more."""
    for df in tables:
        held = {f.split("/plumbline/")[1].split("/")[0] for f in df.inputFiles()[:1] if "/plumbline/" in f}
        for path in [p for p in _scratch if p.rsplit("/", 1)[1] in held]:
            _delete(_scratch.pop(path), path)


def unused(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def scratch_so_far() -> set[str]:
    return set(_scratch)


def drop_since(before: set[str], *keep: DataFrame) -> None:
    """Delete the tables that materialise() has written since, but for those that ``keep`` reads."""
    held = {f.split("/plumbline/")[1].split("/")[0] for df in keep for f in df.inputFiles() if "/plumbline/" in f}
    for path in [p for p in _scratch if p not in before and p.rsplit("/", 1)[1] not in held]:
        _delete(_scratch.pop(path), path)


def slices(arr: pa.Array, limit: int | None = None) -> Iterator[tuple[int, int]]:
    """[start, end) ranges of a string or binary array, each of about limit bytes at most."""
    sizes = pc.fill_null(pc.binary_length(arr), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    start, held, limit = 0, 0, limit or SLICE_BYTES
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > limit:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes)
    trim_memory()


def trim_memory() -> None:
    """Give freed memory back: idle Python workers stay alive for a while, beside those of the next stage."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def as_bytes(arr: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string array, null as empty."""
    return [x or b"" for x in arr.cast(pa.binary()).to_pylist()]


def concat(parts: list[pa.Array], kind: pa.DataType) -> pa.Array:
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


class Numbering(dict):
    """Numbers keys in order of first sight."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n
