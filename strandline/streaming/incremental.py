"""Incremental runs over a folder that files arrive in, by Structured Streaming. The transforms are those of the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import text as tx
from strandline.sources import alto


def arriving_pages(spark: SparkSession, folder: str, per_trigger: int = 1000) -> DataFrame:
    """Pages of XML files as they arrive."""
    files = (
        spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary")
        .option("pathGlobFilter", "*.xml").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_trigger).load(folder)
    )
    return alto.parse(files.select("path", "content"))


CYCLE = "interval 146097 days"  # 400 years: watermarks begin in 1970, and earlier rows would count as late


def matches_by_category(rows: DataFrame, time: str, text: str = "text", late: str = "30 days", window: str = "365 days") -> DataFrame:
    """``since, until, category, n``: matching sentences by window of time. Later rows than ``late`` are left out, which bounds the state."""
    moved = rows.select((F.col(time) + F.expr(CYCLE)).alias("at"), text).withWatermark("at", late)
    sentences = moved.select("at", F.explode(tx.sentences(F.col(text))).alias("sentence"))
    found = sentences.select("at", F.explode(F.array_distinct(F.transform(tx.categories(F.col("sentence")), lambda m: m["category"]))).alias("category"))
    counts = found.groupBy(F.window("at", window).alias("w"), "category").agg(F.count(F.lit(1)).alias("n"))
    return counts.select((F.col("w.start") - F.expr(CYCLE)).alias("since"), (F.col("w.end") - F.expr(CYCLE)).alias("until"), "category", "n")


def counts_by_window(events: DataFrame, time: str, key: str, late: str = "1 day", window: str = "1 day") -> DataFrame:
    """Events by key and window of time."""
    return events.withWatermark(time, late).groupBy(F.window(time, window).alias("window"), key).agg(F.count(F.lit(1)).alias("n"))


def run_once(rows: DataFrame, path: str, checkpoint: str, mode: str = "append", format: str = "parquet"):
    """Handle all that has arrived and stop; the next run goes on from there."""
    query = rows.writeStream.format(format).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    query.awaitTermination()
    return query
