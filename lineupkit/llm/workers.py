"""Care for the memory of Python workers, which live on from task to task."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa
from pyspark.sql import SparkSession

_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def release() -> None:
    """Give freed memory back to the system, so that one stage's peak is not the next one's floor."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: nothing to do
        pass


def bound_batches(spark: SparkSession, size: str = "4194304") -> None:
    """Bound the Arrow batches sent to workers by bytes, unless the session has a bound of its own.

    Ten thousand rows of long texts are tens of MB, held once by the executor and twice by the worker.
    """
    if spark.conf.get(_BATCH_BYTES, None) is None:
        spark.conf.set(_BATCH_BYTES, size)
