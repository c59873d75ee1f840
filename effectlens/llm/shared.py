"""Tables that an operator writes for itself, in the folder that all machines of the cluster share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import suppress
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from effectlens.sources.scratch import scratch as new_table


BATCH_BYTES = 4 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Batches to Python workers are closed at 4 MB in this session: the default row count knows nothing of long texts."""
    now = spark.conf.get(BATCH_SETTING).removesuffix("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def frugal(run: Callable) -> Callable:
    """run, giving back at a partition's end what its allocators hold: workers outlive their tasks."""

    @wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with suppress(OSError, AttributeError):  # other C libraries than glibc have no such call
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return wrapped


def slices(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """(start, end) of pieces of a column of at most `most` bytes of text, or of one longer text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(ends):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield at, end
        at = end


def stored(df: DataFrame, name: str, *partitions: str) -> DataFrame:
    """df as a table just written: later plans start from it, and lost executors don't cost it."""
    path = new_table(df.sparkSession, name)
    schema = df.schema
    df.write.partitionBy(*partitions).parquet(path) if partitions else df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)
