"""Extension: bars from a stream of events, with event-time windows and a watermark. No counterpart among the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def event_bars(events: DataFrame, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """ticker (event type), window start, and first, last, least and largest value, and the number of events, of each window.

    Works on a stream (append mode: a bar comes out when the watermark has passed it) and on a table alike. First and last are by time,
    then by event id.
    """
    keyed = events.withWatermark("ts", late) if events.isStreaming else events
    when = F.struct("ts", "event_id", "value")
    bars = keyed.groupBy(F.col("event_type").alias("ticker"), F.window("ts", width)).agg(
        F.min(when)["value"].alias("px_open"), F.max(when)["value"].alias("px_last"), F.max("value").alias("px_high"), F.min("value").alias("px_low"), F.count(F.lit(1)).alias("n_events")
    )
    return bars.select("ticker", F.col("window.start").alias("start"), "px_open", "px_last", "px_high", "px_low", "n_events")


def write_bars(stream: DataFrame, path: str, checkpoint: str, **options):
    """Starts the query: new bars are appended to Parquet; state and progress live in `checkpoint`."""
    return event_bars(stream, **options).writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
