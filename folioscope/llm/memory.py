"""Memory of Python workers, which live on from task to task: what a task has freed goes back to the system."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa


def release() -> None:
    """Give freed memory of Arrow's pool and, where the C library can, of the heap back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def trimmed(run):
    """A function over batches that releases memory when its task ends."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def free_shuffles(spark) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more: it does so when the driver's garbage is
    collected, which on its own may be long after."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
