"""The row checkers over a stream of item files, and windowed counts of events with late data. Beyond the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.operators import checks


def stream_findings(items: DataFrame) -> DataFrame:
    """Findings of a stream of items: the batch projection as it is, as it keeps no state."""
    return checks.findings(checks.with_audit(items))


def drop_repeats(items: DataFrame, time: str, delay: str = "1 hour") -> DataFrame:
    """Items whose signature was seen within the watermark's delay are dropped."""
    signed = items.withColumn("signature", F.sha2(F.lower(F.trim("task")), 256))
    return signed.withWatermark(time, delay).dropDuplicatesWithinWatermark(["signature"])


def windowed_counts(events: DataFrame, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, value) per tumbling window; events later than the delay don't count."""
    w = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).groupBy(F.window("ts", width).alias("w"), "event_type")
    return w.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "event_type", "n", "value")


def run_once(stream: DataFrame, name: str, mode: str = "append") -> StreamingQuery:
    """Runs all that is available into a memory table."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def replay(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table's Parquet file as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").parquet(sf_dir)
