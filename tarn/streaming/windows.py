"""Time-based operators on streams; each also takes a batch DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, time: str, width: str, keys: Sequence[str], late: str, **aggregates: Column) -> DataFrame:
    """Aggregates of each key and window; rows later than ``late`` are left out of closed windows."""
    window = F.window(F.col(time), width)
    out = events.withWatermark(time, late).groupBy(window.alias("w"), *keys).agg(*(a.alias(n) for n, a in aggregates.items()))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, *aggregates)


def sliding(events: DataFrame, time: str, width: str, slide: str, keys: Sequence[str], late: str, **aggregates: Column) -> DataFrame:
    window = F.window(F.col(time), width, slide)
    out = events.withWatermark(time, late).groupBy(window.alias("w"), *keys).agg(*(a.alias(n) for n, a in aggregates.items()))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, *aggregates)


def sessions(events: DataFrame, time: str, gap: str, keys: Sequence[str], late: str, **aggregates: Column) -> DataFrame:
    window = F.session_window(F.col(time), gap)
    out = events.withWatermark(time, late).groupBy(window.alias("w"), *keys).agg(*(a.alias(n) for n, a in aggregates.items()))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, *aggregates)


def deduplicated(events: DataFrame, time: str, keys: Sequence[str], late: str) -> DataFrame:
    """The first row of each key within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))


def interval_joined(left: DataFrame, right: DataFrame, left_time: str, right_time: str, on: Column, before: str, late: str) -> DataFrame:
    """Pairs for which the right row comes at most ``before`` ahead of the left one; state is bounded by both watermarks."""
    one, two = left.withWatermark(left_time, late), right.withWatermark(right_time, late)
    near = (F.col(right_time) <= F.col(left_time)) & (F.col(right_time) >= F.col(left_time) - F.expr(f"INTERVAL {before}"))
    return one.join(two, on & near)


def each_batch(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str):
    """Run a batch function, such as an as-of join with a table, on every micro-batch until the input is used up."""
    return stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
