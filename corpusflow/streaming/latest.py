"""Latest value per key over an event stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_latest(
    events: DataFrame, by: Sequence[str], order: Sequence[str], value: str, *,
    event_time: str = "ts", event_id: Sequence[str] = ("event_id",), delay: str = "1 hour", span: str = "1 day",
) -> DataFrame:
    """Updates (by..., value, _order): the value of the newest event per key and span of time seen so far.

    Events may be late by `delay` behind the newest event time and still count; later ones are dropped, as are events
    whose id came before within it. State is one row per id within the delay and per key and open span; both end when
    the watermark passes them. The maximum of the order columns decides, so a reader that keeps the row of the
    greatest `_order` per key (`read_newest`) has the latest value, whatever the order of arrival.
    """
    at = F.struct(*order)
    timed = events.withColumn("_time", F.col(event_time).cast("timestamp")).withWatermark("_time", delay)
    once = timed.dropDuplicatesWithinWatermark(list(event_id))
    newest = once.groupBy(*by, F.window("_time", span).alias("_span")).agg(
        F.max_by(value, at).alias(value), F.max(at).alias("_order"))
    return newest.drop("_span")
