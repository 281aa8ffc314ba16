"""Arrow-batched functions that are declared before a session exists, and batches bounded by bytes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql.functions import arrow_udf, pandas_udf

BATCH_BYTES = 4 << 20


def batched(kind: str) -> Callable[[Callable], Callable[..., Column]]:
    """A pandas function, or one over iterators of Arrow arrays, as a function of columns; the type is read when it is first used."""

    def declare(fn: Callable) -> Callable[..., Column]:
        @wraps(fn)
        def column(*columns) -> Column:
            if spark := SparkSession.getActiveSession():
                bound_batches(spark)
            return (arrow_udf if "pa." in str(fn.__annotations__) else pandas_udf)(fn, kind)(*columns)

        return column

    return declare


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of some BATCH_BYTES: texts and pages may be long, and a batch of 10,000 of them large."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def parts(batch: pa.RecordBatch | pa.Array) -> Iterator[pa.RecordBatch | pa.Array]:
    """A batch in parts of some BATCH_BYTES, so that only that much is held as Python objects at once."""
    rows = max(1, int(len(batch) * BATCH_BYTES / max(batch.nbytes, 1)))
    for at in range(0, len(batch), rows):
        yield batch.slice(at, rows)
