"""Event feeds on Structured Streaming: windowed rates, sessions, duplicates; each also runs as a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

LATE = "1 hour"


def read_stream(spark: SparkSession, folder: str, glob: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(folder)


def _watermarked(events: DataFrame, ts: str) -> DataFrame:
    """A stream with its event time as a timestamp and a watermark; a batch as it is."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, LATE) if events.isStreaming else events


def tumbling(events: DataFrame, ts: str = "ts", width: str = "1 hour") -> DataFrame:
    """Counts, sums and failure counts per window and type; late rows beyond the watermark are left to the batch."""
    rows = _watermarked(events, ts)
    out = rows.groupBy(F.window(ts, width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


def deduplicated(events: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    return _watermarked(events, ts).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def sessions(events: DataFrame, key: str = "user_id", ts: str = "ts", gap: str = "30 minutes") -> DataFrame:
    rows = _watermarked(events, ts)
    out = rows.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select(key, F.col("w.start").alias("session_start"), "n")


def run_available(stream: DataFrame, folder: str, checkpoint: str) -> DataFrame:
    """Everything available, written to a Parquet folder and read back."""
    query = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start(folder)
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(folder)


def run_complete(stream: DataFrame, folder: str, checkpoint: str) -> DataFrame:
    """An aggregate over everything available: each batch's whole result goes to a folder of its own, and the last one is
    read back."""
    spark, last = stream.sparkSession, []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/{number}")
        last[:] = [number]

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("complete").start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/{last[0]}") if last else spark.createDataFrame([], stream.schema)


def run_updates(stream: DataFrame, folder: str, checkpoint: str) -> DataFrame:
    """An aggregate over everything available: the rows that a batch changed are a partition named by the batch, written
    anew when it is replayed; all of them are read back, with their batch."""
    spark = stream.sparkSession
    write = lambda batch, number: batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")
    # a folder that can be read, whether or not there are batches
    write(spark.createDataFrame([], stream.schema), -1)
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("update").start().awaitTermination()
    return spark.read.schema(StructType([*stream.schema.fields, StructField("batch", LongType())])).parquet(folder)


def unseen(events: DataFrame, done: DataFrame) -> DataFrame:
    """Events whose id is not among those done before (a static table), as a stream or a batch."""
    return events.join(done.select("id").distinct(), "id", "left_anti")
