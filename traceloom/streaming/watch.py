"""New files of a folder as a stream: extracted once each, kept by the checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from traceloom.session import scratch_path, ship
from traceloom.sources.readers import extracted


def watch_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """A stream of FILES rows, one for each new file."""
    ship(spark)
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("pathGlobFilter", glob).load(path)
    return extracted(files)


def store_new_files(spark: SparkSession, path: str, out: str, checkpoint: str | None = None, glob: str = "*") -> StreamingQuery:
    """Extract what is new in a folder and append it to a parquet table; ends when all is read."""
    stream = watch_files(spark, path, glob)
    return stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint or scratch_path(spark, "watch")).trigger(availableNow=True).start()


def late_counts(events: DataFrame, window: str = "1 hour", watermark: str = "2 hours") -> DataFrame:
    """Events by type and window of event time; later ones than the watermark are dropped by Spark."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
    return e.groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
