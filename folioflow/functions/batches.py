"""Python columns over whole texts in batches of bounded rows and bytes, which give their memory back."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: A batch holds whole texts, several times over once they are Python's: at most so many rows and bytes of them at once.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def limit_batches(spark: SparkSession) -> None:
    """Batches of at most ``BATCH_ROWS`` rows and about ``BATCH_BYTES``, for the session from then on; settings below these stay."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(name).lower().removesuffix("b")
        if now.lstrip("-").isdigit() and not 0 < int(now) <= most:
            spark.conf.set(name, str(most))


def release() -> None:
    """Give memory that a finished task held back to the system, as workers live on."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        return


def text_column(f: Callable[..., pd.Series], kind) -> Callable[..., Column]:
    """``f`` of one or several series as a column function in batches of bounded size."""

    @F.pandas_udf(kind)
    def one(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        try:
            for batch in batches:
                yield f(batch)
        finally:
            release()

    @F.pandas_udf(kind)
    def several(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        try:
            for batch in batches:
                yield f(*batch)
        finally:
            release()

    def column(*columns) -> Column:
        limit_batches(SparkSession.active())
        return (one if len(columns) == 1 else several)(*columns)

    return column
