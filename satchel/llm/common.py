"""Shared plumbing of the training-data operators: shared folders, Arrow batches, tables."""

from __future__ import annotations

import ctypes
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import fresh_name, fresh_path, join_dealt, release, shared_dir, stored

__all__ = ["as_bytes", "batch_of", "bound_batches", "fresh_name", "fresh_path", "join_dealt", "kept", "keyed", "lots", "map_batches", "release", "shared_dir", "stored", "table", "tidy", "trim"]

#: Bytes that one Arrow batch carries into Python at most, but for one longer row.
BATCH_BYTES = "8m"


def bound_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes for this session, so that very long texts do not add up to a huge batch."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def lots(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """(first, end) of stretches of texts of `most` bytes together, or of one longer text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, "right")))
        yield lo, hi
        lo = hi


#: What a worker process keeps from task to task.
_KEPT: dict = {}


def kept(key: object, make: Callable[[], object]) -> object:
    """What make gives, once for each worker process, until this runs a task of another kind (see tidy)."""
    if key not in _KEPT:
        _KEPT[key] = make()
    return _KEPT[key]


def trim() -> None:
    """Give free memory back to the system."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keeps: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, in which the worker gives free memory back to the system about once a second and at the end: it stays, idle,
    beside the tasks that follow. Unless the task `keeps` them, things that were kept for other tasks go first."""

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps:
            _KEPT.clear()
        last = time.monotonic()
        for out in run(batches):
            yield out
            if time.monotonic() > last + 1:
                del out
                trim()
                last = time.monotonic()
        trim()

    return inner


def map_batches(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """mapInArrow with one output batch for each input batch."""
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield f(batch)

    return df.mapInArrow(tidy(run), schema)


def batch_of(names: list[str], columns: list, types: list) -> pa.RecordBatch:
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, types, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=names)


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns that an operator reads, under fixed names; other columns cannot clash."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
