"""What the operators share: bounded Arrow batches, the shared folder, table reading."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import _STORED, forget, shared, stored

__all__ = ["_STORED", "forget", "shared", "stored"]

#: Rows and text bytes that one Arrow batch brings to Python at most (a single longer text still comes whole).
BATCH_ROWS = 512
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Rows that cross to Python at once: texts may be long, so few. Spark has no smaller scope for this than the session; its own bound by bytes (64 MB) stays."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def utf8(column: Column | str) -> Column:
    """The text's bytes; null counts as empty, and each malformed sequence as U+FFFD."""
    return F.coalesce(F.make_valid_utf8(column).cast("binary"), F.lit(b""))


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that each slice holds about BATCH_BYTES."""
    each = max(1, int(batch.num_rows * BATCH_BYTES / max(BATCH_BYTES, batch.nbytes)))
    for at in range(0, batch.num_rows, each):
        yield batch.slice(at, each)


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str) -> DataFrame:
    """Applies ``make()(batch)`` to every batch; ``make`` runs once per task, on the executor."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            for part in slices(batch):
                yield each(part)

    return df.mapInArrow(run, schema)


_CACHES: dict[str, Callable[[], None]] = {}


def claim(name: str, clear: Callable[[], None]) -> None:
    """Called in a Python worker by an operator: workers are used again by later stages, so caches of other operators are dropped and their memory goes back to the machine."""
    others = [x for x in _CACHES if x != name]
    for other in others:
        _CACHES.pop(other)()
    if others:
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # glibc has it
            ctypes.CDLL(None).malloc_trim(0)
    _CACHES[name] = clear
