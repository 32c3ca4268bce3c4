"""Arrow batches in Python workers, with little memory held at a time and none kept."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame

#: Bytes of a batch on its way to a worker, unless the session asks for less; bytes and rows handled at a time.
BATCH_BYTES, SLICE_BYTES, SLICE_ROWS = 4 << 20, 1 << 20, 500
_MOST = "spark.sql.execution.arrow.maxBytesPerBatch"


def mapped(df: DataFrame, run: Callable[[Iterator], Iterator], schema) -> DataFrame:
    """``df.mapInArrow`` with batches of at most ``BATCH_BYTES`` (one row at least), set in the session where it allows more."""
    conf = df.sparkSession.conf
    number, unit = re.fullmatch(r"(-?\d+)([kmgtp]?)b?", conf.get(_MOST).strip().lower()).groups()
    if not 0 < int(number) << 10 * " kmgtp".index(unit or " ") <= BATCH_BYTES:
        conf.set(_MOST, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def filled(df: DataFrame, rows: int) -> DataFrame:
    """``df`` in so few of its partitions, joined without a shuffle, that they have ``rows`` rows on average; as it is if they have."""
    parts, n = df.rdd.getNumPartitions(), df.count()
    return df.coalesce(max(1, n // rows)) if parts > 1 and n < parts * rows else df


def trim() -> None:
    """Give freed memory back to the system."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if give := getattr(ctypes.CDLL(None), "malloc_trim", None):
        give(0)


def slices(batches: Iterator, rows: int = SLICE_ROWS, nbytes: int = SLICE_BYTES) -> Iterator:
    """The batches by few rows and bytes (one row at least), since whole texts become Python values; freed memory goes back at the end."""
    for b in batches:
        step = max(1, min(rows, b.num_rows * nbytes // max(1, b.nbytes)))
        for lo in range(0, b.num_rows, step):
            yield b.slice(lo, step)
    trim()
