"""Tumbling bins over a stream of events, with late data dropped behind a watermark."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def source(spark: SparkSession, folder: str, pattern: str = "events.parquet") -> DataFrame:
    return spark.readStream.schema(EVENTS).option("pathGlobFilter", pattern).parquet(folder)


def tumbling(events: DataFrame, width: str, late: str = "2 hours") -> DataFrame:
    """Counts and sums (in hundredths) per type and bin; a bin closes ``late`` after its end."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = timed.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("total"))
    return out.select("event_type", F.col("window.start").cast("timestamp_ntz").alias("start"), "n", "total")


def drained(spark: SparkSession, path: str, width: str) -> DataFrame:
    """All bins of the files that are there now, closed or not."""
    folder, _, name = path.rpartition("/")
    view = "bins_" + uuid.uuid4().hex
    run = tumbling(source(spark, folder, name), width).writeStream.outputMode("complete").format("memory").queryName(view).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.table(view)
