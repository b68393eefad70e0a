"""Streaming forms of the event queries; state is bounded by a watermark.

Event time is without zone: inside a stream it is the instant at which UTC shows
it, and results show UTC again, so days and sessions are those of the batch in
any session zone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.time import instant, utc
from ..sources.scratch import Scratch
from ..sources.tables import SCHEMAS


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of files, with event time as an instant."""
    rows = spark.readStream.schema(SCHEMAS["events"]).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    return rows.withColumn("ts", instant("ts"))


def _marked(stream: DataFrame, delay: str | None) -> DataFrame:
    return stream if delay is None else stream.withWatermark("ts", delay)


def tumbling(stream: DataFrame, delay: str | None = "1 day", length: str = "1 day") -> DataFrame:
    """Events of each window and type; late ones count until the watermark passes, or always without a delay."""
    counted = _marked(stream, delay).groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n"))
    return counted.select(utc("window.start").alias("window_start"), "event_type", "n")


def sessions(stream: DataFrame, delay: str | None = "1 day", gap: str = "30 minutes") -> DataFrame:
    """Each user's sessions, parted by gaps."""
    w = F.session_window("ts", gap)
    found = _marked(stream, delay).groupBy(w, "user_id").agg(F.count("*").alias("n"))
    return found.select("user_id", utc("session_window.start").alias("session_start"), utc("session_window.end").alias("session_end"), "n")


def deduplicated(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """Events without repeats of an id within the watermark."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"]).select("event_id", utc("ts").alias("ts"), "user_id", "event_type")


def drain(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """Runs a stream over what is there now, and reads what it wrote: of an aggregate, only what the watermark closed.

    Output and progress are in the shared folder while the application lives, so a
    restarted run goes on where it was, each row written once.
    """
    root = Scratch(spark, "stream").root
    query = stream.writeStream.format("parquet").outputMode("append").option("path", f"{root}/rows").option("checkpointLocation", f"{root}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/rows")


def drain_whole(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """Runs an aggregate over what is there now, and reads its whole result, open windows and sessions included.

    Each batch writes the whole result anew beside the last one's, so a
    restarted run repeats a batch without harm.  State is as large as the result.
    """
    root = Scratch(spark, "stream").root
    last = f"{root}/none"
    spark.createDataFrame([], stream.schema).write.parquet(last)

    def write(rows: DataFrame, batch: int) -> None:
        nonlocal last
        path = f"{root}/rows-{batch}"
        rows.write.mode("overwrite").parquet(path)
        last = path

    query = stream.writeStream.outputMode("complete").option("checkpointLocation", f"{root}/progress").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(last)
