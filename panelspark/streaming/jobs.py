"""Structured Streaming jobs: landed files in, exactly-once tables out. The same functions serve batch and stream."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from panelspark.sources.sinks import ids_digest


def work_dir(spark: SparkSession, tag: str) -> str:
    """A fresh folder below the shared one (``spark.checkpoint.dir``), else below the warehouse, which is shared on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def event_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 4) -> DataFrame:
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def land(events: DataFrame, path: str, files: int = 6) -> None:
    """Lays a table out as landed files, in time order so that a watermark has something to follow."""
    events.repartitionByRange(files, "ts").sortWithinPartitions("ts").write.parquet(path)


def run_to_parquet(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    query = (
        stream.writeStream.format("parquet").outputMode(mode).option("path", f"{path}/out").option("checkpointLocation", f"{path}/state")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out")


def dedup_stream(stream: DataFrame, keys: list[str], delay: str = "2 days") -> DataFrame:
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def daily_sums(rows: DataFrame, delay: str = "1 day") -> DataFrame:
    """Tumbling local days; a stream appends a day once the watermark is past it."""
    if rows.isStreaming:
        rows = rows.withWatermark("ts", delay)
    day = F.window("ts", "1 day", startTime="16 hours")
    return rows.groupBy(day, "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(
        F.col("window.start").alias("start"), "event_type", "n", "total"
    )


def sliding_activity(rows: DataFrame, delay: str = "1 day") -> DataFrame:
    if rows.isStreaming:
        rows = rows.withWatermark("ts", delay)
    return rows.groupBy(F.window("ts", "5 days", "1 day"), "event_type").agg(F.count("*").alias("n")).select(
        F.col("window.start").alias("start"), "event_type", "n"
    )


def sessions_of(rows: DataFrame, gap: str = "6 hours", delay: str = "1 day") -> DataFrame:
    if rows.isStreaming:
        rows = rows.withWatermark("ts", delay)
    return rows.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select(
        "user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n"
    )


def run_manifest(versions: DataFrame) -> DataFrame:
    """Per type: rows, first and last time, and a digest that does not depend on order."""
    return versions.groupBy("event_type").agg(
        F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"), ids_digest(F.col("event_id")).alias("digest")
    )
