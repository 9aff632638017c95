"""Scripts and feedback that arrive over time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

DELAY = "10 minutes"


def run_to_table(stream: DataFrame, label: str) -> DataFrame:
    """Process everything available into a parquet folder and read the result."""
    spark = stream.sparkSession
    path = scratch_path(spark, label)
    query = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", path + "-state")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def run_batches(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], label: str) -> DataFrame:
    """Apply a batch job to each micro-batch. A repeated batch overwrites its own folder, so results stay exact."""
    spark = stream.sparkSession
    path = scratch_path(spark, label)

    def write(batch: DataFrame, epoch: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    query = (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", path + "-state")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.parquet(path).drop("epoch")


def read_stream(spark: SparkSession, folder: str, file_name: str) -> DataFrame:
    """Stream the parquet files of ``folder`` that match ``file_name``."""
    schema = spark.read.parquet(f"{folder}/{file_name}").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", file_name).parquet(folder)


def arrivals(scripts: DataFrame, width: str = "1 day") -> DataFrame:
    """Scripts per dialect and tumbling window; late rows are dropped by the watermark."""
    return (
        scripts.withWatermark("ts", DELAY)
        .groupBy(F.window("ts", width).alias("w"), "dialect")
        .agg(F.count("*").alias("scripts"), F.sum(F.length("src")).alias("chars"))
        .select(F.col("w.start").alias("window_start"), "dialect", "scripts", "chars")
    )


def distinct_texts(scripts: DataFrame) -> DataFrame:
    """Each text once within the watermark delay."""
    return (
        scripts.withColumn("text_hash", F.md5("src"))
        .withWatermark("ts", DELAY)
        .dropDuplicatesWithinWatermark(["text_hash"])
        .select("text_hash")
    )


def feedback_sessions(entries: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Bursts of feedback per contact: a pause longer than ``gap`` closes a session."""
    return (
        entries.withWatermark("ts", DELAY)
        .groupBy(F.session_window("ts", gap).alias("w"), "contactPerson")
        .agg(F.count("*").alias("entries"))
        .select("contactPerson", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "entries")
    )
