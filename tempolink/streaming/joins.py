"""Joins of two streams in a range of time, unmatched rows included."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.time import instant, utc
from ..sources.scratch import Scratch
from ..sources.tables import SCHEMAS

#: Later than any event.
END = "9000-01-01 00:00:00"


def views_before(stream: DataFrame, delay: str = "1 day", within: str = "30 minutes") -> DataFrame:
    """(event_id, user_id, ts, view_id, view_ts): each purchase with each view by its user in the time before it, or without one.

    Views count from ``within`` before the purchase up to, not with, its own time.
    A purchase without a view is given out when the watermark of both sides shows
    that none can come; until then state holds it, and views as long as a purchase
    may need them.  Rows later than ``delay`` are dropped.  Rows without time are
    in no stream; a purchase without user has no view; repeats count each.
    """
    stream = stream.where("ts IS NOT NULL")
    bought = stream.where("event_type = 'purchase'").select("event_id", "user_id", "ts").withWatermark("ts", delay)
    seen = stream.where("event_type = 'view'").select(F.col("event_id").alias("view_id"), F.col("user_id").alias("view_user"), F.col("ts").alias("view_ts")).withWatermark("view_ts", delay)
    on = (F.col("user_id") == F.col("view_user")) & (F.col("view_ts") < F.col("ts")) & (F.col("view_ts") >= F.col("ts") - F.expr(f"INTERVAL {within}"))
    joined = bought.join(seen, on, "leftOuter")
    # by time, as a condition on other columns would go below the watermark, which then never saw the last events
    return joined.where(F.col("ts") < instant(F.lit(END))).select("event_id", "user_id", utc("ts").alias("ts"), "view_id", utc("view_ts").alias("view_ts"))


class Drained:
    """A stateful query over what is there, in runs that go on where the last one stopped.

    ``run`` takes in what is new; ``finish`` also reads a last event of each kind at
    ``END``, which closes all that is open; queries leave out what has that time.
    Rows are written once, to the shared folder.
    """

    def __init__(self, spark: SparkSession, kinds: list[str]):
        self.spark, self.kinds, self.root = spark, kinds, Scratch(spark, "stream").root
        self._add([])

    def _add(self, kinds: list[str]) -> None:
        rows = [(-1, None, -1, kind, None, None) for kind in kinds]
        self.spark.createDataFrame(rows, SCHEMAS["events"]).coalesce(1).write.mode("append").parquet(f"{self.root}/end")

    def run(self, stream: DataFrame, of: Callable[..., DataFrame], **how) -> DataFrame:
        last = self.spark.readStream.schema(SCHEMAS["events"]).parquet(f"{self.root}/end")
        result = of(stream.unionByName(last.withColumn("ts", instant(F.lit(END)))), **how)
        query = result.writeStream.format("parquet").outputMode("append").option("path", f"{self.root}/rows").option("checkpointLocation", f"{self.root}/progress").trigger(availableNow=True).start()
        query.awaitTermination()
        return self.spark.read.schema(result.schema).parquet(f"{self.root}/rows")

    def finish(self, stream: DataFrame, of: Callable[..., DataFrame], **how) -> DataFrame:
        self.run(stream, of, **how)
        self._add(self.kinds)
        return self.run(stream, of, **how)
