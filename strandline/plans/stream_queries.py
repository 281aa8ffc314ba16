"""Incremental runs as queries: each handles all that is there and returns what it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.plans.registry import query, shared_folder
from strandline.streaming import incremental


@query("""
SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2
HAVING day + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)""")
def stream_daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by day and type as a stream writes them: days that the watermark has passed."""
    folder = shared_folder(spark, "stream")
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    rows = rows.withColumn("ts", F.col("ts").cast("timestamp"))
    counts = incremental.counts_by_window(rows, "ts", "event_type").select(F.col("window.start").alias("day"), "event_type", "n")
    incremental.run_once(counts, f"{folder}/out", f"{folder}/state")
    return spark.read.schema(counts.schema).parquet(f"{folder}/out")
