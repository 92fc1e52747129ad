"""Windowed aggregates of streams, and running a stream over what is there now."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retrix.sources.tables import ensure_checkpoint_dir, table


def event_stream(spark: SparkSession, directory: str, name: str = "events", files_per_trigger: int = 8) -> DataFrame:
    """The table as a stream of files."""
    schema = table(spark, directory, name).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{directory}/{name}.parquet*")


def counts(stream: DataFrame, time_col: str, width: str, *by: str, late: str | None = None) -> DataFrame:
    """Count and total of ``value`` by window and groups; with ``late`` a watermark lets windows end."""
    rows = stream.withColumn("at", F.col(time_col).cast("timestamp"))
    if late:
        rows = rows.withWatermark("at", late)
    return rows.groupBy(F.window("at", width).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def run_now(frame: DataFrame, mode: str = "complete", batch=None) -> str:
    """Runs a stream over all that is there and gives the folder of its last result. State and results lie in the
    shared folder, so a lost executor costs a retry, not the result."""
    spark = frame.sparkSession
    base = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"

    def write(part: DataFrame, number: int) -> None:
        (batch(part) if batch else part).write.mode("overwrite" if mode == "complete" else "append").parquet(f"{base}/out")

    stream = frame.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(write).start()
    stream.awaitTermination()
    return f"{base}/out"


def hourly_counts(spark: SparkSession, directory: str) -> DataFrame:
    """Hour, type, count and total of all events."""
    result = run_now(counts(event_stream(spark, directory), "ts", "1 hour", "event_type"))
    return spark.read.parquet(result).select(F.col("w.start").cast("timestamp_ntz").alias("hour"), "event_type", "n", F.round("total", 4).alias("total"))
