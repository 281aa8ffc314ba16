"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_made: list[str] = []
FREE_SHUFFLE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; a temporary one only in one process, where none is named."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='strandline-')}"
        _made.append(urlparse(found).path)
        spark.sparkContext._conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def materialise(df: DataFrame, name: str, level: int = 3, free: bool = False) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage, survives lost executors, is read many times.

    With ``free`` the shuffle files of its making go at once; else they stay until the driver collects its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/strandline/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(FREE_SHUFFLE)
    spark.conf.set(FREE_SHUFFLE, str(free or before == "true").lower())
    try:
        df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", str(level)).parquet(path)
    finally:
        spark.conf.set(FREE_SHUFFLE, before)
    return spark.read.schema(df.schema).parquet(path)


def remove(df: DataFrame) -> None:
    """Deletes a table of ``materialise`` that nothing reads any more."""
    files = df.inputFiles()
    if files:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


@atexit.register
def _sweep() -> None:
    for path in _made:
        shutil.rmtree(path, ignore_errors=True)


def doc_crc(doc_id: Column | str = "doc_id") -> Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary"))


SLICE_BYTES = 4 << 20


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in parts of some SLICE_BYTES, so that only that much is held as Python objects at once."""
    rows = max(1, int(batch.num_rows * SLICE_BYTES / max(batch.nbytes, 1)))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches of a task in parts; what Arrow has freed goes back to the system after each."""
    for batch in batches:
        yield from slices(batch)
        del batch
        pa.default_memory_pool().release_unused()


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of some SLICE_BYTES: texts may be long, and a batch of 10,000 of them large."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(SLICE_BYTES))


def map_texts(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """``fn`` over Arrow batches, made once for each task by calling ``fn()``."""
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = fn()
        for part in batches_of(batches):
            yield each(part)

    return df.mapInArrow(run, schema)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts of a batch; null is the empty text."""
    return [t or "" for t in batch.column(name).to_pylist()]


def small(df: DataFrame, most: int) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``most`` rows, else as it is: a larger one is joined by shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
