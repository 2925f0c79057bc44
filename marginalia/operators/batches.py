"""Arrow batches of bounded bytes, so that a Python stage and its JVM hold few texts at once however long they are."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Bytes of text in a slice; a longer text is a slice of its own.
SLICE = 1_000_000


def slices(batches: Iterable[pa.RecordBatch], column: int = 1, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The rows of batches in slices whose texts or binaries in `column` sum up to `most` bytes, or to less."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            end = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(at, end - at)
            at = end


def _give_back() -> None:
    """Memory that a worker doesn't use any more goes back, as workers outlive their stage."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only some C libraries can
        ctypes.CDLL(None).malloc_trim(0)


def map_batches(df: DataFrame, run, schema) -> DataFrame:
    """mapInArrow over batches of about `SLICE` bytes.

    The bound is a setting of the session, the same for all operators; a lower one stays.
    """
    spark, name = df.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    bytes_of = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    if not 0 < bytes_of(spark.conf.get(name)) <= SLICE:
        spark.conf.set(name, str(SLICE))

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            _give_back()

    return df.mapInArrow(whole, schema)
