"""Windowed counts with a watermark, and the last event of each key kept as state.

An extension: the functions take a streaming or a batch DataFrame alike.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, folder: str, schema) -> DataFrame:
    """Files of a folder as they come; watermarks need ts to be an instant, so a local time is taken in the session's zone."""
    return spark.readStream.schema(schema).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes", by: str = "event_type") -> DataFrame:
    """(start, key, n, total) for each event-time window."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    got = events.withWatermark("ts", late).groupBy(w.alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return got.select(F.col("w.start").alias("start"), by, "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(user_id, start, end, n) of bursts of events."""
    got = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return got.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def running_last(events: DataFrame) -> DataFrame:
    """A stream of (user_id, event_id, value): the newest event of each user so far, as state."""

    def step(key, batches, state):
        best = state.get if state.exists else None
        for pdf in batches:
            r = pdf.sort_values(["ts", "event_id"]).iloc[-1]
            new = (r.ts.value, int(r.event_id), float(r.value))
            best = new if best is None or new[:2] > tuple(best[:2]) else best
        if best is not None:
            state.update(tuple(best))
            yield pd.DataFrame({"user_id": [key[0]], "event_id": [best[1]], "value": [best[2]]})

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long, value double", "ts long, event_id long, value double", "update", "NoTimeout")


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now and return what it gave."""
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
