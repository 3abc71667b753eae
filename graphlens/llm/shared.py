"""Helpers common to the operators: the shared folder, bounded batches, vectorised words.

Words are handled per Arrow batch: the text column is split in Arrow's C++ kernels, the
words are dictionary-encoded, and Python looks only at the distinct words of a batch.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that one vectorised step holds at once; a longer text is one step by itself.
SLICE_BYTES = 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors and the driver share (spark.checkpoint.dir).

    Set here only where the session has none, as in local tests.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = held.get() if held.isDefined() else tempfile.mkdtemp(prefix="graphlens-shared-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, parts: int | None = None) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage and survives lost executors.

    parts: tasks that write it at most, for tables known to be small.
    """
    path = shared_path(df.sparkSession, name)
    (df if parts is None else df.coalesce(parts)).write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more: all that was made of them is stored itself.

    Tables that stored() has not made are left alone.
    """
    for df in tables:
        if path := vars(df).get("stored_at"):  # as an attribute of its own, not a column of that name
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def forget_shuffles(spark: SparkSession) -> None:
    """Have the driver's JVM collect: Spark deletes shuffle files only when it finds that no plan refers to them."""
    spark._jvm.System.gc()


def bounded_batches(spark: SparkSession, rows: int = 2_000, size: int = 2 * SLICE_BYTES) -> None:
    """Let Spark hand at most so many rows and bytes at once to a Python worker (one row at least).

    The bounds are settings of the session, read when a plan runs; smaller ones stay.
    """
    for key, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        key = f"spark.sql.execution.arrow.{key}"
        if not 0 < int(str(spark.conf.get(key)).rstrip("b")) <= most:
            spark.conf.set(key, str(most))


def release() -> None:
    """Give freed memory back to the system: a worker's peak then is that of one slice."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def rows_of(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most `limit` bytes in the text column (one row at least)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64))
        at = 0
        while at < n:
            base = size[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(size, base + limit, "right")))
            yield batch.slice(at, end - at)
            at = end
            release()


def texts(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    """The text column with nulls as empty texts, in buffers of its own.

    Some of Arrow's string functions misread the offsets of a slice.
    """
    array = pc.fill_null(batch.column(column).cast(pa.large_string()), "")
    offsets, data = buffers(array)
    return from_buffers(offsets, data.copy())


def buffers(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets from 0 and bytes of an array of large strings."""
    offsets = np.frombuffer(array.buffers()[1], np.int64, len(array) + 1, array.offset * 8) if len(array) else np.zeros(1, np.int64)
    data = np.frombuffer(array.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return offsets - offsets[0], data


def from_buffers(offsets: np.ndarray, data: np.ndarray) -> pa.Array:
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(data))


def split(array: pa.Array, by: str = " ") -> tuple[pa.Array, np.ndarray]:
    """Flat parts and, per row, where its parts start and end (length rows + 1)."""
    parts = pc.split_pattern(array, by)
    offsets = np.asarray(parts.offsets).astype(np.int64)
    return parts.values.slice(offsets[0], offsets[-1] - offsets[0]), offsets - offsets[0]


def coded(values: pa.Array) -> tuple[np.ndarray, list[str]]:
    """Codes of the values and the distinct values."""
    found = values.dictionary_encode()
    return np.asarray(found.indices), found.dictionary.to_pylist()


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start..start+length of every run, one run after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    out = np.repeat(starts - (ends - lengths), lengths)
    out += np.arange(total, dtype=np.int64)
    return out


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of the values of each row."""
    total = np.concatenate(([0], np.cumsum(values, dtype=values.dtype if values.dtype == np.float64 else np.int64)))
    return total[offsets[1:]] - total[offsets[:-1]]


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective), in place of a keyed hash of integers."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def words_of(array: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words (runs of letters and marks) in lower case, empty strings among them, by row."""
    parts = pc.split_pattern_regex(pc.utf8_lower(array), r"[^\p{L}\p{M}]+")
    offsets = np.asarray(parts.offsets).astype(np.int64)
    return parts.values.slice(offsets[0], offsets[-1] - offsets[0]), offsets - offsets[0]
