"""A stream of command lines into an event store.

Every micro-batch is one batch of the store, named after the stream and the batch's number. A batch that is replayed
after a failure replaces itself and gets the same ids, so each line is stored exactly once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tagmill.sources.store import EventStore


def line_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """The lines of new text files of a folder; files_per_trigger bounds a micro-batch. Large files are split by Spark."""
    raw = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder)
    lines = raw.select(F.col("value").alias("line"), F.expr("unix_millis(_metadata.file_modification_time)").alias("arrival"), F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("block"))
    return lines.where(F.length(F.trim("line")) > 0)


def socket_stream(spark: SparkSession, host: str, port: int) -> DataFrame:
    """Lines from a socket, for development: what was lost while nobody listened does not come again."""
    raw = spark.readStream.format("socket").option("host", host).option("port", port).option("includeTimestamp", "true").load()
    return raw.select(F.col("value").alias("line"), F.expr("unix_millis(timestamp)").alias("arrival"), F.lit(f"{host}:{port}").alias("source"), F.lit(0).cast("long").alias("block"))


def kafka_stream(spark: SparkSession, servers: str, topic: str, offsets_per_trigger: int = 1_000_000) -> DataFrame:
    """Lines from a Kafka topic (needs Spark's Kafka connector on the class path); replays come from its offsets."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("maxOffsetsPerTrigger", offsets_per_trigger).load()
    return raw.select(F.col("value").cast("string").alias("line"), F.expr("unix_millis(timestamp)").alias("arrival"), F.concat_ws("/", "topic", F.lpad(F.col("partition").cast("string"), 6, "0")).alias("source"), F.col("offset").alias("block"))


def numbered(batch: DataFrame) -> DataFrame:
    """Lines of a micro-batch with their place in the source: the block, then the order in which it is read."""
    at = batch.withColumn("_at", F.monotonically_increasing_id())
    return at.select("line", "arrival", F.concat_ws("#", "source", F.lpad(F.col("block").cast("string"), 20, "0")).alias("source"), F.col("_at").alias("pos"))


def ingest_stream(store: EventStore, lines: DataFrame, checkpoint: str, name: str = "stream", refused: str | None = None, once: bool = True) -> StreamingQuery:
    """Start ingesting; refused lines go to the folder `refused` by batch, or are left out."""

    def write(batch: DataFrame, number: int) -> None:
        bad = store.append(numbered(batch), f"{name}-{number}")
        if refused:
            bad.write.mode("overwrite").parquet(f"{refused}/batch={number}")

    writer = lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).start()
